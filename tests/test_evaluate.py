"""Visibility, completeness and field checks of a compiled template."""

import json

from formlake.operators.evaluate import CompiledTemplate, load_items
from formlake.operators.templates import flatten_templates, templates_from_texts

# The nested questionnaire, answer states and expected counts of the reference's
# completeness test, and its conditions-against-items cases below.
NESTED = {"questionnaire": [{"type": "block", "text": "root", "items": [
    {"id": "box_id", "type": "box", "text": "b"},
    {"id": "line_id", "type": "line", "text": "l"},
    {"type": "block", "text": "inner", "items": [
        {"id": "tip_id", "type": "tip", "text": "t"},
        {"id": "whytip_id", "type": "tip", "why": "whytext", "severity": "high", "text": "w"}]},
    {"id": "yesno_id", "type": "yesno", "yes": "Y", "no": "N", "text": "yn"},
    {"id": "radio_id", "type": "radio", "text": "r1"},
    {"id": "radio_id2", "type": "radio", "text": "r2"},
    {"type": "spacer"},
    {"id": "check_id", "type": "check", "text": "c"}]}]}


def _compiled(spark, template, **kw):
    items = flatten_templates(templates_from_texts(spark, {"t": json.dumps(template)}))
    return CompiledTemplate(load_items(items), **kw)


def test_unanswered_counts_follow_the_answers(spark):
    tpl = _compiled(spark, NESTED)
    states = [
        {},
        {"yesno_id": "yes"},
        {"yesno_id": "yes", "line_id": "blah"},
        {"yesno_id": "yes", "line_id": "", "radio_id": "checked"},
        {"yesno_id": "yes", "line_id": "", "radio_id": "checked", "box_id": "blah2"},
        {"yesno_id": "yes", "line_id": "", "radio_id": "checked", "box_id": "blah2"},
    ]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(states)], "qid int, answers map<string,string>")
    got = {r.qid: r.unanswered for r in tpl.unanswered_counts(df, ["qid"]).where("block_id = '_anon_0'").collect()}
    assert [got[i] for i in range(len(states))] == [4, 3, 2, 2, 1, 1]


ITEMS = {"questionnaire": [{"type": "block", "text": "root", "items": [
    {"type": "line", "id": "line1_id", "text": "l", "inputType": "date", "required": True, "maxlength": 10},
    {"type": "radio", "id": "radio1_id", "text": "r1"},
    {"type": "radio", "id": "radio2_id", "text": "r2"},
    {"type": "check", "id": "check1_id", "text": "c"},
    {"type": "yesno", "id": "yesno1_id", "text": "yn", "yes": "Y", "no": "N"},
    {"type": "checkgroup", "id": "checkgroup1_id", "defaultChoice": False,
     "choices": [{"checkchoice1_id": "c1"}, {"checkchoice2_id": "c2"}]},
    {"type": "radiogroup", "id": "radiogroup1_id", "defaultChoice": False,
     "choices": [{"radiochoice1_id": "r1"}, {"radiochoice2_id": "r2"}]},
    {"type": "block", "id": "admin_block", "auth": "admin", "text": "a", "items": [
        {"type": "line", "id": "hidden_line", "text": "h"}]},
]}]}
ANSWERS = {"radio1_id": "checked", "yesno1_id": "yes", "checkchoice1_id": "checked", "line1_id": "",
           "radio2_id": "", "check1_id": "", "checkchoice2_id": "", "radiochoice1_id": ""}
CASES = [
    ("radio1_id", True), ("radio2_id", False), ("!radio1_id", False), ("!radio2_id", True),
    ("checkgroup1_id", True), ("checkchoice1_id", True), ("!checkchoice2_id", True), ("!radiogroup1_id", True),
    ("!radiochoice1_id", True), ("!radiochoice2_id", True), ("radio1_id && yesno1_id/yes", True),
    ("radio1_id && yesno1_id/no", False), ("radio2_id && yesno1_id/yes", False),
    ("radio2_id || yesno1_id/yes", True), ("!radiogroup1_id && yesno1_id/yes", True),
    ("checkgroup1_id && yesno1_id/yes", True),
]


def test_conditions_against_items(spark):
    tpl = _compiled(spark, ITEMS)
    df = spark.createDataFrame([(1, ANSWERS)], "qid int, answers map<string,string>")
    from formlake.functions.conditions import compile_condition

    row = tpl.with_conditions(df).select(*[compile_condition(c, tpl).alias(f"c{i}") for i, (c, _) in enumerate(CASES)]).first()
    assert [row[f"c{i}"] for i in range(len(CASES))] == [e for _, e in CASES]


def test_admin_block_hidden_unless_admin_mode(spark):
    df = spark.createDataFrame([(1, ANSWERS)], "qid int, answers map<string,string>")
    vis = {r.item_id: r.visible for r in _compiled(spark, ITEMS).item_visibility(df, ["qid"]).collect()}
    assert vis["admin_block"] is False and vis["hidden_line"] is False and vis["radio1_id"] is True
    vis = {r.item_id: r.visible for r in _compiled(spark, ITEMS, admin_mode=True).item_visibility(df, ["qid"]).collect()}
    assert vis["admin_block"] is True and vis["hidden_line"] is True


def test_field_issues(spark):
    tpl = _compiled(spark, ITEMS)
    df = spark.createDataFrame([(1, {"line1_id": ""}), (2, {"line1_id": "2024-13-45"}), (3, {"line1_id": "2024-01-05"}),
                                (4, {"line1_id": "2024-01-05 too long"})], "qid int, answers map<string,string>")
    got = {(r.qid, r.rule) for r in tpl.field_issues(df, ["qid"]).collect()}
    assert got == {(1, "required_missing"), (2, "input_type_violation"), (4, "maxlength_violation"),
                   (4, "input_type_violation")}


def test_registered_item_type(spark):
    from pyspark.sql import functions as F

    from formlake.operators.evaluate import ItemKind, register_item_type

    register_item_type("rating", ItemKind(value=lambda raw, it: F.coalesce(raw, F.lit("")),
                                          checked=lambda v, ref: v.try_cast("int") >= 3,
                                          answered=lambda v: v != ""))
    t = {"questionnaire": [{"type": "block", "text": "r", "items": [
        {"type": "rating", "id": "stars", "text": "How good?"},
        {"type": "tip", "id": "praise", "text": "Thanks", "cond": "stars"}]}]}
    tpl = _compiled(spark, t)
    df = spark.createDataFrame([(1, {"stars": "4"}), (2, {"stars": "1"}), (3, {})], "qid int, answers map<string,string>")
    vis = {r.qid for r in tpl.active_tips(df, ["qid"]).collect()}
    assert vis == {1}
    got = {r.qid: r.unanswered for r in tpl.unanswered_counts(df, ["qid"]).collect()}
    assert got == {1: 0, 2: 0, 3: 1}


def test_evaluate_per_template(spark):
    from formlake.operators.evaluate import evaluate_per_template

    a = {"questionnaire": [{"type": "block", "text": "r", "items": [
        {"type": "check", "id": "x", "text": "x"}, {"type": "tip", "id": "tx", "text": "t", "cond": "x", "warn": "yes"}]}]}
    b = {"questionnaire": [{"type": "block", "text": "r", "items": [
        {"type": "yesno", "id": "y", "text": "y", "yes": "Y", "no": "N"},
        {"type": "tip", "id": "ty", "text": "t", "cond": "y/no"}]}]}
    items = flatten_templates(templates_from_texts(spark, {"a": json.dumps(a), "b": json.dumps(b)}), materialize=False)
    subs = spark.createDataFrame([(1, "a", {"x": "checked"}), (2, "a", {}), (3, "b", {"y": "no"}), (4, "b", {"y": "yes"})],
                                 "qid int, template_id string, answers map<string,string>")
    got = {(r.qid, r.item_id) for r in evaluate_per_template(subs, items, "active_tips", ["qid"]).collect()}
    assert got == {(1, "tx"), (3, "ty")}
