"""Store rules: sanitising, search, status slots, audit semantics of the log."""

import datetime as dt

from pyspark.sql import functions as F

from formlake.functions.text import action_items, sanitize, valid_qid, valid_username
from formlake.operators import audit, diff, store
from formlake.schemas import EVENT_LOG


def test_sanitize_order_and_null(spark):
    df = spark.createDataFrame([("a-|-b",), ("it's; --x|y",), (None,)], "s string")
    assert [r.x for r in df.select(sanitize("s").alias("x")).collect()] == ["a--b", "its xy", None]


def test_action_items_in_key_order(spark):
    df = spark.createDataFrame([({"b": "see AB-1 and CD-22", "a": "XY-3", "c": "none"},), ({"a": "x"},)],
                               "m map<string,string>")
    assert [r.x for r in df.select(action_items("m").alias("x")).collect()] == ["XY-3,AB-1,CD-22", None]


def test_id_and_user_rules(spark):
    df = spark.createDataFrame([("ABCDEF123456", "alice@x.org"), ("ABC", "bob smith"), ("ABCDEF12345!", "#x")],
                               "q string, u string")
    got = [(r.a, r.b) for r in df.select(valid_qid("q").alias("a"), valid_username("u").alias("b")).collect()]
    assert got == [(True, True), (False, True), (False, False)]


def test_wildcards_and_status_slots(spark):
    df = spark.createDataFrame([("Q1", "Alpha_1", "Draft"), ("Q2", "AlphaX1", "Approved"), ("Q3", "beta", "")],
                               "qid string, app_name string, app_status string")
    df = df.withColumn("app_tid", F.lit("")).withColumn("app_pid", F.lit("")).withColumn("app_champion", F.lit(""))
    assert {r.qid for r in store.wildcard_search(df, "alpha_1").collect()} == {"Q1", "Q2"}
    assert store.status_slots("sd") == ["", "", "Submitted", "Draft"]
    assert {r.qid for r in store.status_filter(df, "sd").collect()} == {"Q1", "Q3"}
    assert store.status_filter(df, None).count() == 0


def _log(spark, events):
    rows = []
    for seq, (qid, op, status, minute) in enumerate(events):
        t = dt.datetime(2024, 1, 1, 0, minute)
        rows.append((qid, status, "", "", "app", "c", "m", f"u{seq}", t, f'{{"v": {seq}}}', None, "", None,
                     seq, op, t))
    return spark.createDataFrame(rows, EVENT_LOG)


def test_audit_semantics(spark):
    log = _log(spark, [("q", "save", "Draft", 1), ("q", "save", "Submitted", 2), ("q", "delete", None, 3),
                       ("q", "save", "Draft", 4), ("r", "delete", None, 5), ("r", "save", "Draft", 6)])
    a = [(r.audit_id, r.app_status, r.user_name) for r in audit.audit_log(log).orderBy("audit_id").collect()]
    # re-save moves the first version; delete moves the second and writes the tombstone;
    # the insert after the delete and the delete of an absent qid leave no audit row
    assert a == [(2, "Draft", "u0"), (4, "Submitted", "u1"), (5, "DELETED", "ADMIN")]
    cur = {r.qid: r.app_status for r in store.current_state(log).collect()}
    assert cur == {"q": "Draft", "r": "Draft"}
    assert audit.transition_violations(log).collect() == []


def test_latest_values_and_diff(spark):
    ch = spark.createDataFrame([("q", "a", "1", dt.datetime(2024, 1, 1), 1), ("q", "a", "2", dt.datetime(2024, 1, 2), 2),
                                ("q", "b", "x", dt.datetime(2024, 1, 1), 3), ("q", "q_version_0_1", "c", dt.datetime(2024, 1, 3), 4)],
                               "qid string, key string, value string, ts timestamp, seq long")
    cur = store.latest_values(ch).select("qid", "key", "value")
    saved = store.latest_values(ch.where("seq <= 1")).select("qid", "key", "value")
    d = {(r.key, r.current_value, r.saved_value) for r in diff.answer_diff(cur, saved).collect()}
    assert d == {("a", "2", "1"), ("b", "x", None)}
    assert diff.answer_diff(cur, cur).count() == 0
