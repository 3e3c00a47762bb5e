"""Templates are worked on within their rows: nothing is written in between, and depth has no limit."""

import json

from pyspark.sql import functions as F

from formlake.functions.conditions import condition_errors
from formlake.operators import bulk, export, lint
from formlake.operators.merge import merge_templates
from formlake.operators.templates import flatten_templates, item_issues, root_issues
from formlake.plans import queries as Q


def _templates(spark, *texts):
    rows = F.array(*[F.struct(F.lit(f"t{i}").alias("template_id"), F.lit(json.dumps(t)).alias("text")) for i, t in enumerate(texts)])
    return spark.range(1).select(F.inline(rows))


def _nested(depth):
    item = {"type": "line", "id": f"i{depth}", "text": "x"}
    for d in range(depth - 1, -1, -1):
        item = {"type": "block", "id": f"i{d}", "text": "x", "items": [item, {"type": "check", "id": f"c{d}", "text": "y", "cond": "c0 &&"}]}
    return {"version": 1, "questionnaire": [item]}


def _written(df):
    return "LogicalRDD" in df._jdf.queryExecution().analyzed().toString()


def test_depth_and_order(spark):
    rows = flatten_templates(_templates(spark, _nested(40), {"version": 2, "questionnaire": []}, _nested(1))).collect()
    got = sorted((r.ordinal, r.item_id, r.depth) for r in rows if r.template_id == "t0")
    want = [(f"i{d}", d) for d in range(41)] + [(f"c{d}", d + 1) for d in range(39, -1, -1)]
    assert [g[1:] for g in got] == want and [g[0] for g in got] == list(range(81))
    assert sorted(r.item_id for r in rows if r.template_id == "t2") == ["c0", "i0", "i1"] and {r.template_id for r in rows} == {"t0", "t2"}


def test_nothing_is_written_between_the_steps(spark):
    base = _templates(spark, _nested(3))
    items = flatten_templates(base)
    ext = {"version": 1, "namespace": "n", "extensions": [{"type": "block", "id": "b", "text": "b", "insertAfter": "i1", "items": [
        {"type": "line", "id": "e", "text": "e"}]}, {"type": "line", "id": "z", "text": "z", "insertBefore": "n:e"}]}
    merged, errors = merge_templates(base, _templates(spark, ext).withColumn("apply_order", F.lit(0)))
    found = lint.lint_templates(items, base, order=True)
    again = flatten_templates(export.export_templates(items).withColumnRenamed("json", "text"))
    for df in (items, merged, errors, found, bulk.template_programs(items), again):
        assert not _written(df)
    assert [r.item_id for r in merged.orderBy("ordinal").collect()] == ["i0", "i1", "i2", "i3", "c2", "c1", "n:b", "n:z", "n:e", "c0"]
    assert errors.count() == 0 and export.template_diff(items, again).count() == 0
    rules = {(r.item_id, r.rule) for r in found.collect()}
    # pre-order puts c0 last, so the others refer to an item further down
    assert rules >= {(f"c{d}", "invalid_condition") for d in range(3)} | {("c1", "forward_reference"), ("c2", "forward_reference")}
    assert ("c0", "forward_reference") not in rules and not any(rule == "unknown_reference" for _, rule in rules)


def test_lint_of_rows_and_table_agree_and_names_every_step(spark):
    """Items in rows and as a table give the same findings, those of each operator on its own together."""
    twice = {"version": 1, "questionnaire": [{"type": "block", "id": "r", "text": "r", "items": [
        {"type": "line", "id": "a", "text": "a", "cond": "b && nothing"}, {"type": "line", "id": "a", "text": "", "cond": "a/value"},
        {"type": "check", "id": "b", "text": "b", "cond": 'matches(a/value) & "x'}, {"type": "odd", "id": "c", "cond": "c || \"nothing\""},
        {"type": "checkgroup", "id": "g", "text": "g", "choices": [{"a": "A"}, {"h": "H"}], "choicesConds": [{"h": "!g"}]}, {"type": "check", "id": "p", "text": "p", "cond": "p"}]}, {"type": "info"}]}
    base = _templates(spark, twice, _nested(2), {"version": 1, "questionnaire": []})
    items = flatten_templates(base)
    found = sorted(map(str, lint.lint_templates(items, base, order=True).collect()))
    assert found == sorted(map(str, lint.lint_templates(flatten_templates(base, in_rows=True, fields=lint.FIELDS), base, order=True).collect()))
    bad = condition_errors(items, keys=("template_id", "item_id", "ordinal")).select("template_id", "item_id", F.lit("invalid_condition").alias("rule"), F.col("reason").alias("detail"))
    steps = [item_issues(items), lint.unknown_references(items), bad, lint.forward_references(items), lint.reference_cycles(bulk.template_programs(items)), root_issues(base)]
    assert found == sorted(str(r) for step in steps for r in step.collect()) and all(step.count() for step in steps)


def test_registered_lint_reports_roots(spark, monkeypatch):
    """template_lint includes the root checks (F2), as its name in the coverage list says."""
    two = {"version": 1, "questionnaire": [{"type": "info", "id": "a", "text": "a"}, {"type": "info", "id": "b", "text": "b"}]}
    monkeypatch.setattr(Q.ad, "order_templates", lambda spark, sf_dir: _templates(spark, two, _nested(1)))
    rows = {(r.template_id, r.rule, r.detail) for r in Q.template_lint(spark, "").where("rule = 'root'").collect()}
    assert rows == {("t0", "root", "expected one root item, found 2")}


def test_items_in_rows_are_not_brought_together_again(spark, monkeypatch):
    """From the texts on a template stays one row: only texts and answers are collected."""
    monkeypatch.setattr(Q.ad, "order_reviews", lambda spark, sf_dir, flawed=False: _templates(spark, _nested(1)))
    monkeypatch.setattr(Q.ad, "order_answers", lambda spark, sf_dir: spark.sql("SELECT 'q' AS qid, 't0' AS template_id, map('c0', 'checked') AS answers"))
    for query in (Q.visibility_many_templates, Q.tips_many_templates, Q.unanswered_many_templates):
        assert query(spark, "")._jdf.queryExecution().optimizedPlan().toString().count("collect_list") == 1
    # lint reads the texts once for the rows and once for the roots
    assert Q.template_lint_order(spark, "")._jdf.queryExecution().optimizedPlan().toString().count("collect_list") == 2


def test_deep_templates_beside_shallow_ones(spark):
    """The levels looked at one by one and those of the fold join without a gap."""
    for depth in (2, 3, 4, 5, 9):
        rows = flatten_templates(_templates(spark, _nested(depth), {"version": 1, "questionnaire": [{"type": "line", "id": "x", "text": "x"}]})).collect()
        assert sorted((r.ordinal, r.item_id) for r in rows if r.template_id == "t0") == list(enumerate(
            [f"i{d}" for d in range(depth + 1)] + [f"c{d}" for d in range(depth - 1, -1, -1)]))
        assert [(r.ordinal, r.item_id) for r in rows if r.template_id == "t1"] == [(0, "x")]
