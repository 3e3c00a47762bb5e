"""Skew-safe window helpers against plain windows, and plan properties the design relies on."""

import datetime as dt
import json
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from formlake.operators import windows
from formlake.operators.evaluate import CompiledTemplate, load_items
from formlake.operators.templates import flatten_templates, templates_from_texts


def _events(spark, n=3000, seed=7):
    rnd = random.Random(seed)
    base = dt.datetime(2024, 1, 1)
    rows = []
    for seq in range(n):
        key = "hot" if rnd.random() < 0.6 else f"k{rnd.randrange(20)}"  # one key holds most rows
        ts = base + dt.timedelta(minutes=rnd.randrange(60 * 24 * 20))
        val = None if rnd.random() < 0.3 else f"v{rnd.randrange(5)}"
        rows.append((key, ts, seq, val))
    return spark.createDataFrame(rows, "k string, ts timestamp, seq long, v string")


def test_bucketed_windows_match_plain_windows(spark):
    df = _events(spark)
    w = Window.partitionBy("k").orderBy("ts", "seq")
    plain = (df.withColumn("p", F.lag("v").over(w)).withColumn("first", F.lag(F.lit(1)).over(w).isNull())
             .withColumn("nx", F.lead("ts").over(w)).withColumn("n", F.row_number().over(w))
             .withColumn("c", F.last("v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))))
    b = windows.time_bucket("ts")
    got = windows.with_previous(df, ["k"], ["ts", "seq"], ["v"], b)
    got = windows.with_next(got, ["k"], ["ts", "seq"], "ts", b, "nx")
    got = windows.with_row_number(got, ["k"], ["ts", "seq"], b, "n")
    got = windows.carry_forward(got.withColumn("c", F.col("v")), ["k"], ["ts", "seq"], ["c"], b)
    got = got.select("seq", F.col("_prev.v").alias("p"), F.col("_prev").isNull().alias("first"), "nx", "n", "c")
    expect = {r.seq: (r.p, r.first, r.nx, r.n, r.c) for r in plain.collect()}
    assert {r.seq: (r.p, r.first, r.nx, r.n, r.c) for r in got.collect()} == expect


def test_evaluation_is_one_narrow_stage(spark):
    t = {"questionnaire": [{"type": "block", "text": "r", "items": [
        {"type": "yesno", "id": "y", "text": "y", "yes": "Y", "no": "N"},
        {"type": "tip", "id": "t", "text": "t", "cond": "y/no", "warn": "yes"}]}]}
    items = flatten_templates(templates_from_texts(spark, {"t": json.dumps(t)}), materialize=False)
    tpl = CompiledTemplate(load_items(items))
    subs = spark.range(1000).select(F.col("id").alias("qid"),
                                    F.create_map(F.lit("y"), F.when(F.col("id") % 2 == 0, "no").otherwise("yes")).alias("answers"))
    out = tpl.active_tips(subs, ["qid"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "PythonUDF" not in plan and "BatchEvalPython" not in plan
    assert out.count() == 500


def test_as_of_filter_reaches_the_scan(spark, tmp_path):
    from formlake.operators.audit import revision_as_of
    from formlake.schemas import EVENT_LOG

    t = dt.datetime(2024, 1, 1)
    log = spark.createDataFrame([("q", "Draft", "", "", "a", "c", None, "u", t, "{}", None, "", None, 1, "save", t)],
                                EVENT_LOG)
    log.write.parquet(str(tmp_path / "log"))
    plan = revision_as_of(spark.read.parquet(str(tmp_path / "log")), "2024-06-01 00:00:00")._jdf \
        .queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(event_ts" in plan and "GreaterThan(event_ts" in plan
