"""Answer diffs: current vs saved answers, and change-by-change revision diffs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formlake.operators.windows import time_bucket, with_previous


def answer_diff(current: DataFrame, saved: DataFrame, keys=("qid",)) -> DataFrame:
    """Keys of the *current* answers whose value differs from the saved one.

    Both inputs are long ``(qid, key, value)``. Keys starting with ``q_version`` are skipped,
    a key missing from the saved answers counts as changed, keys only in ``saved`` are ignored.
    """
    cur = current.where(~F.col("key").startswith("q_version"))
    s = saved.select(*keys, "key", F.col("value").alias("saved_value"))
    j = cur.join(s, [*keys, "key"], "left")
    return (j.where(~F.col("value").eqNullSafe(F.col("saved_value")))
            .select(*keys, "key", F.col("value").alias("current_value"), "saved_value"))


def answer_diff_maps(df: DataFrame, current: str = "answers", saved: str = "saved") -> DataFrame:
    """K1 for two map columns in one row (row-local, no shuffle)."""
    e = F.explode(F.map_entries(F.map_filter(F.col(current), lambda k, v: ~k.startswith("q_version"))))
    x = df.select("*", e.alias("_e"))
    sv = F.col(saved)[F.col("_e.key")]
    return (x.where(~F.col("_e.value").eqNullSafe(sv))
            .select(*[c for c in df.columns if c not in (current, saved)],
                    F.col("_e.key").alias("key"), F.col("_e.value").alias("current_value"), sv.alias("saved_value")))


def any_modified(diff: DataFrame, keys=("qid",)) -> DataFrame:
    """I4: does a submission have any changed key."""
    return diff.groupBy(*keys).agg(F.count("*").alias("n_changed"))


def revision_diff(changes: DataFrame) -> DataFrame:
    """K3: per change event, the previous value of the same (qid, key): added or changed.

    Events that re-write the same value are not differences.
    """
    p = with_previous(changes, ["qid", "key"], ["ts", "seq"], ["value"], time_bucket("ts"))
    p = p.withColumn("old_value", F.col("_prev.value"))
    kind = (F.when(F.col("_prev").isNull(), F.lit("added"))
            .when(~F.col("value").eqNullSafe(F.col("old_value")), F.lit("changed")))
    return (p.withColumn("change", kind).where(F.col("change").isNotNull())
            .select("qid", "key", "seq", "ts", "old_value", F.col("value").alias("new_value"), "change"))


def pending_changes(changes: DataFrame, last_save: DataFrame) -> DataFrame:
    """Distinct keys changed since each submission's last save ``(qid, saved_ts)``."""
    j = changes.join(last_save, "qid", "left")
    return (j.where(F.col("saved_ts").isNull() | (F.col("ts") > F.col("saved_ts")))
            .groupBy("qid").agg(F.count_distinct("key").alias("pending")))
