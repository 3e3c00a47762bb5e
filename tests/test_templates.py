"""Template flattening, checks and extension merges."""

import json

from pyspark.sql import functions as F

from formlake.operators.lint import lint_templates
from formlake.operators.merge import merge_templates
from formlake.operators.templates import flatten_templates, root_issues, templates_from_texts

SMALL = {
    "version": 3,
    "questionnaire": [{
        "type": "block", "id": "kitchen", "text": "Kitchen inspection",
        "items": [
            {"type": "line", "id": "inspector", "text": "Inspector", "required": True, "maxlength": 40,
             "inputTitle": "Full name", "placeholder": "Name"},
            {"type": "radiogroup", "id": "heat", "text": "Heat source", "defaultChoice": True,
             "choices": [{"gas": "Gas"}, {"coil": "Coil"}, {"wood": "Wood"}],
             "choicesConds": [{"wood": "!gas"}]},
            {"type": "spacer"},
            {"type": "block", "id": "cold", "text": "Cold store", "cond": "gas || coil", "items": [
                {"type": "block", "text": "Shelves", "items": [
                    {"type": "yesno", "id": "raw_below", "text": "Raw food below?", "yes": "Yes", "no": "No"}]},
                {"type": "tip", "id": "move_raw", "cond": "raw_below/no", "text": "Move it down", "warn": "yes",
                 "severity": "medium", "todo": "Rearrange shelves"}]},
            {"type": "box", "id": "notes", "text": "Notes"},
        ]}],
}
# A comment line and a string continuation, as template files may contain.
SMALL_TEXT = "// inspection form\n" + json.dumps(SMALL, indent=1).replace('"Cold store"', '"Cold " +\n  "store"')


def test_flatten_preorder_and_choices(spark):
    items = flatten_templates(templates_from_texts(spark, {"small": SMALL_TEXT}))
    rows = [(r.ordinal, r.item_id, r.type, r.parent_id, r.depth, r.is_choice) for r in items.orderBy("ordinal").collect()]
    assert [r[1] for r in rows] == [
        "kitchen", "inspector", "heat", "gas", "coil", "wood", "heat_none", "_anon_0_2", "cold", "_anon_0_3_0",
        "raw_below", "move_raw", "notes"]
    assert [r[0] for r in rows] == list(range(13))
    by_id = {r[1]: r for r in rows}
    assert by_id["coil"][2] == "radio" and by_id["coil"][3] == "heat" and by_id["coil"][5]
    assert by_id["raw_below"][4] == 3 and by_id["raw_below"][3] == "_anon_0_3_0"
    assert items.where("item_id = 'cold'").first().text == "Cold store"
    assert items.where("item_id = 'wood'").first().cond == "!gas"
    tip = items.where("item_id = 'move_raw'").first()
    assert tip.warn and tip.severity == "medium" and tip.ancestors == ["kitchen", "cold"]
    name = items.where("item_id = 'inspector'").first()
    assert (name.input_title, name.placeholder) == ("Full name", "Name")


def test_flatten_has_no_depth_limit(spark):
    item = {"type": "line", "id": "l39", "text": "x"}
    for i in range(38, -1, -1):
        item = {"type": "block", "id": f"b{i}", "text": "b", "items": [item]}
    items = flatten_templates(templates_from_texts(spark, {"deep": json.dumps({"questionnaire": [item]})}))
    assert [(r.item_id, r.depth) for r in items.orderBy("ordinal").collect()] == [
        *[(f"b{i}", i) for i in range(39)], ("l39", 39)]


def test_lint_reports_every_broken_property(spark):
    bad = {"questionnaire": [{"type": "block", "text": "R", "items": [
        {"type": "tip", "id": "t", "severity": "huge"}, {"type": "yesno", "id": "y"}]}]}
    texts = templates_from_texts(spark, {"bad": json.dumps(bad), "broken": "{"})
    found = {(r.template_id, r.item_id, r.detail) for r in lint_templates(flatten_templates(texts), texts).collect()}
    assert {d for _, i, d in found if i == "t"} == {
        "text is mandatory", "severity must be medium, high or critical", "severity needs warn=yes"}
    assert {d for _, i, d in found if i == "y"} == {"text is mandatory", "yes and no are mandatory"}
    assert ("broken", None, "template is not valid JSON with a questionnaire") in found


def test_lint_finds_duplicates_unknown_types_and_refs(spark):
    bad = {"questionnaire": [{"type": "block", "text": "R", "items": [
        {"type": "line", "id": "x", "text": "X"}, {"type": "line", "id": "x", "text": "X2"},
        {"type": "dropdown", "id": "d", "text": "D"}, {"type": "yesno", "id": "y", "text": "Y"},
        {"type": "line", "id": "z", "text": "Z", "cond": "nothere && x"},
        {"type": "line", "id": "w", "text": "W", "cond": "x & z"},
        {"type": "tip", "id": "t", "text": "T", "severity": "huge"}]}]}
    items = flatten_templates(templates_from_texts(spark, {"bad": json.dumps(bad)}))
    found = {(r.item_id, r.rule) for r in lint_templates(items).collect()}
    assert ("x", "duplicate_id") in found
    assert ("d", "unknown_type") in found
    assert ("y", "property") in found
    assert ("z", "unknown_reference") in found
    assert ("w", "invalid_condition") in found
    assert ("t", "property") in found


def test_root_checks(spark):
    two_roots = {"questionnaire": [{"type": "block", "text": "a", "items": []}, {"type": "line", "id": "b"}]}
    t = templates_from_texts(spark, {"two": json.dumps(two_roots), "broken": "{not json"})
    assert {r.template_id for r in root_issues(t).collect()} == {"two", "broken"}


BASE = {"version": 1, "questionnaire": [{"type": "block", "text": "R", "items": [
    {"type": "block", "id": "b1", "text": "B1", "items": [{"type": "line", "id": "l1", "text": "L1"}]},
    {"type": "block", "id": "b2", "text": "B2", "items": []}]}]}


def _ext(version, items, ns=None):
    d = {"version": version, "extensions": items}
    if ns:
        d["namespace"] = ns
    return json.dumps(d)


def _merge(spark, exts):
    base = spark.createDataFrame([("t", json.dumps(BASE))], "template_id string, text string")
    ext = spark.createDataFrame([("t", i, e) for i, e in enumerate(exts)], "template_id string, apply_order int, text string")
    items, errors = merge_templates(base, ext)
    return [r.item_id for r in items.orderBy("ordinal").collect()], [r.error for r in errors.collect()]


def test_two_extensions_after_the_same_target(spark):
    first = _ext(1, [{"type": "line", "id": "first", "text": "F", "insertAfter": "l1"}])
    second = _ext(1, [{"type": "line", "id": "second", "text": "S", "insertAfter": "l1"}])
    ids, errors = _merge(spark, [first, second])
    assert errors == []
    assert ids.index("l1") + 1 == ids.index("second") and ids.index("second") + 1 == ids.index("first")


def test_extension_of_an_extension_and_unnamed_blocks(spark):
    first = _ext(1, [{"type": "block", "text": "unnamed", "insertAfter": "l1", "items": [{"type": "line", "id": "in", "text": "I"}]}])
    second = _ext(1, [{"type": "line", "id": "next", "text": "N", "insertAfter": "in"},
                      {"type": "line", "id": "prev", "text": "P", "insertBefore": "in"}])
    base = spark.createDataFrame([("t", json.dumps(BASE))], "template_id string, text string")
    ext = spark.createDataFrame([("t", 300 + i, e) for i, e in enumerate([first, second])],
                                "template_id string, apply_order int, text string")
    items, errors = merge_templates(base, ext)
    rows = [(r.item_id, r.parent_id, r.depth) for r in items.orderBy("ordinal").collect()]
    assert errors.count() == 0
    assert rows[2:7] == [("l1", "b1", 2), ("_ext300_anon_0", "b1", 2), ("prev", "_ext300_anon_0", 3),
                         ("in", "_ext300_anon_0", 3), ("next", "_ext300_anon_0", 3)]


def test_many_items_after_one_target_keep_their_order(spark):
    ext = _ext(1, [{"type": "line", "id": f"a{i}", "text": "A", "insertAfter": "l1"} for i in range(6)])
    base = spark.createDataFrame([("t", json.dumps(BASE))], "template_id string, text string")
    items, _ = merge_templates(base, spark.createDataFrame([("t", 300, ext)], "template_id string, apply_order int, text string"))
    ids = [r.item_id for r in items.orderBy("ordinal").collect()]
    assert ids[ids.index("l1") + 1:ids.index("l1") + 7] == ["a5", "a4", "a3", "a2", "a1", "a0"]


def test_insert_before_and_namespace(spark):
    ext = _ext(1, [{"type": "block", "id": "nb", "text": "N", "insertBefore": "b2",
                    "items": [{"type": "check", "id": "c", "text": "C"}]}], ns="acme")
    ids, errors = _merge(spark, [ext])
    assert errors == []
    assert ids[ids.index("acme:nb") + 1] == "acme:c" and ids[ids.index("acme:c") + 1] == "b2"


def test_merge_errors(spark):
    both = _ext(1, [{"type": "line", "id": "x", "text": "X", "insertAfter": "l1", "insertBefore": "l1"}])
    _, errors = _merge(spark, [both])
    assert len(errors) == 1 and "either insertBefore or insertAfter" in errors[0]
    _, errors = _merge(spark, [_ext(2, [{"type": "line", "id": "x", "text": "X", "insertAfter": "l1"}])])
    assert errors == ["extension version does not match the base template"]
    ids, errors = _merge(spark, [_ext(1, [{"type": "line", "id": "x", "text": "X", "insertAfter": "nope"}])])
    assert ids == [] and "was not found" in errors[0]


def test_export_round_trip_and_diff(spark):
    from formlake.operators.export import export_templates, template_diff
    from formlake.plans.queries import vendor_template_text

    cols = ["item_id", "ordinal", "depth", "parent_id", "type", "text", "cond", "warn", "severity", "todo",
            "required", "maxlength", "default_choice", "is_choice"]
    items = flatten_templates(templates_from_texts(spark, {"small": SMALL_TEXT, "vendor": vendor_template_text()}),
                              materialize=False)
    exported = export_templates(items).withColumnRenamed("json", "text")
    again = flatten_templates(exported, materialize=False)
    key = lambda df: sorted(tuple(r) for r in df.select("template_id", *cols).collect())
    assert key(again) == key(items)
    assert template_diff(items, again).count() == 0
    changed = items.withColumn("text", F.when(F.col("item_id") == "notes", "changed").otherwise(F.col("text")))
    d = {(r.item_id, r.change) for r in template_diff(items, changed.where("item_id <> 'move_raw'")).collect()}
    assert d == {("notes", "changed"), ("move_raw", "removed")}


def test_merged_template_is_linted_exported_and_evaluated(spark):
    """Whatever a flattened template can do: the merge of two extensions, one into the other's block."""
    from formlake.operators.bulk import evaluate_many
    from formlake.operators.evaluate import CompiledTemplate, load_items
    from formlake.operators.export import export_templates, template_diff

    first = _ext(1, [{"type": "block", "id": "nb", "text": "N", "insertAfter": "b1", "cond": "l1/value", "items": [
        {"type": "checkgroup", "id": "g", "text": "G", "defaultChoice": True, "choices": [{"c1": "One"}, {"c2": "Two"}], "choicesConds": [{"c2": "l1/value"}]}]}], "x")
    second = _ext(1, [{"type": "tip", "id": "tp", "text": "T", "insertAfter": "x:g", "cond": "x:c1", "warn": "yes", "severity": "high", "name": "n"}], "y")
    base = spark.createDataFrame([("t", json.dumps(BASE))], "template_id string, text string")
    ext = spark.createDataFrame([("t", i, e) for i, e in enumerate([first, second])], "template_id string, apply_order int, text string")
    items, errors = merge_templates(base, ext)
    assert errors.count() == 0 and lint_templates(items, order=True).count() == 0
    exported = export_templates(items).withColumnRenamed("json", "text")
    again = flatten_templates(exported)
    assert template_diff(items, again).count() == 0
    columns = ["item_id", "ordinal", "depth", "parent_id", "parent_type", "ancestors", "type", "cond", "version"]
    assert sorted(map(str, items.select(columns).collect())) == sorted(map(str, again.select(columns).collect()))
    answers = spark.createDataFrame([(1, {"l1": "a", "x:c1": "checked"}), (2, {"x:c1": "checked"}), (3, {"l1": "a"})], "qid int, answers map<string,string>")
    want = CompiledTemplate(load_items(again)).active_tips(answers, ["qid"]).collect()
    got = evaluate_many(answers.selectExpr("qid", "answers", "'t' AS template_id"), items, "active_tips", ["qid"]).drop("template_id").collect()
    assert [r.qid for r in want] == [1] and got == want
