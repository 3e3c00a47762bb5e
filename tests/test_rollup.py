"""Levels of the risk rollup against plain distinct counts, sketches against the levels, first hits, mail bodies, encoding."""

from __future__ import annotations

from urllib.parse import quote

from pyspark.sql import functions as F

from formlake.functions.text import request_content, url_component
from formlake.operators import requests, rollup, store


def _tables(spark):
    n = 6000
    tips = spark.range(n).select(F.format_string("q%d", F.col("id") % 2500).alias("qid"), F.format_string("t%d", F.when(F.col("id") % 2500 < 900, 0).otherwise(F.col("id") % 5)).alias("template_id"),
                                 F.when(F.col("id") % 7 == 0, None).otherwise(F.element_at(F.array(F.lit("low"), F.lit("high")), (F.col("id") % 2 + 1).cast("int"))).alias("severity"),
                                 (F.col("id") % 11 != 3).alias("warn"))
    status = spark.range(2400).select(F.format_string("q%d", F.col("id")).alias("qid"), F.when(F.col("id") % 3 == 0, "Draft").otherwise("Approved").alias("app_status"))
    return tips, status


def test_levels_and_sketches(spark):
    tips, status = _tables(spark)
    got = {tuple(r[:4]): tuple(r[4:]) for r in rollup.risk_levels(tips, status).collect()}
    states = {r.qid: r.app_status for r in status.collect()}
    rows = [(r.template_id, r.severity or "", states.get(r.qid, "Deleted"), r.qid) for r in tips.collect() if r.warn]
    want: dict = {}
    for row in rows:
        for level in range(8):
            key = (*[None if level & (4 >> i) else row[i] for i in range(3)], level)
            n, ids = want.setdefault(key, [0, set()])
            want[key][0] = n + 1
            ids.add(row[3])
    assert got == {k: (n, len(ids)) for k, (n, ids) in want.items()}
    # sketches of two overlapping shards add up on every level
    halves = [rollup.risk_sketches(part, status) for part in (tips.where("qid < 'q2'"), tips.where("qid >= 'q2'"))]
    for axes in rollup.LEVELS:
        for r in rollup.merge_sketches(halves[0].unionByName(halves[1]), axes).collect():
            n, ids = got[(r.template_id, r.severity, r.app_status, r.level)]
            assert r.n_warnings == n and abs(r.n_submissions - ids) <= 1 + .07 * ids
    twice = halves[0].unionByName(halves[0])
    once = {tuple(r[:3]): r.n_submissions for r in rollup.merge_sketches(halves[0], ["severity"]).collect()}
    again = {tuple(r[:3]): r.n_submissions for r in rollup.merge_sketches(twice, ["severity"]).collect()}
    assert again.keys() == once.keys() and all(abs(again[k] - n) <= .07 * n for k, n in once.items())  # repeats count once
    assert rollup.risk_levels(tips.limit(0), status).count() <= 4  # only levels over everything


def test_first_hits(spark):
    rows = [(1, "b", "2024-01-02"), (1, "a", "2024-01-02"), (1, "c", "2024-01-01"), (2, "z", None), (2, "y", "2020-01-01"), (3, "n", None), (3, "m", None)]
    df = spark.createDataFrame(rows, "term_id long, qid string, ts string").withColumn("timestamp", F.col("ts").cast("timestamp")).drop("ts")
    assert {r.term_id: r.qid for r in store.first_hits(df, ["term_id"]).collect()} == {1: "a", 2: "y", 3: "m"}


def test_bodies(spark):
    df = spark.createDataFrame([("q", "A"), ("q", "B"), ("{}", "C"), ("q", "?")], "qid string, body_template string")
    bodies = {"A": "{}|{}|{}|{}|{}.", "B": "{}{}{}{}{}{}", "C": "x{} {}", "D": ""}
    got = [r.body for r in requests.notice_bodies(df, "h", F.lit("s$1"), F.lit(None).cast("string"), bodies).collect()]
    assert got == ["h|q|q|s$1|.", "", "xh {}", ""]


def test_url_component(spark):
    texts = ["", "a b+c", "ä/ö?&=#%", "!~*'()-_.", "日本\n\t", "%20+", "x" * 100_000, None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(url_component("t")).collect()] == [None if t is None else quote(t, safe="!~*'()-_.") for t in texts]
    assert [r[0] for r in df.select(request_content("a=%s&b=%s", "t", F.lit(3))).collect()][1::6] == ["a=a%20b%2Bc&b=3", None]
