"""Warnings by template, severity and status on every level, exactly or from sketches that add up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

AXES = ["template_id", "severity", "app_status"]
LEVELS = [["template_id", "severity", "app_status"], ["template_id", "severity"], ["template_id", "app_status"],
          ["severity", "app_status"], ["template_id"], ["severity"], ["app_status"], []]
SKETCH_LG_K = 12  # 2^12 registers: a standard error of about 1.6 %
_ALL = "_all"


def _level(axes: list[str]) -> int:
    """4, 2 and 1 for the axes (in their order) that a level sums over."""
    return sum(4 >> i for i, axis in enumerate(AXES) if axis not in axes)


def _with_status(tips: DataFrame, status: DataFrame) -> DataFrame:
    known = status.select("qid", "app_status")
    return tips.where("warn").join(known, "qid", "left").withColumn("app_status", F.coalesce("app_status", F.lit("Deleted")))


def risk_levels(tips: DataFrame, status: DataFrame) -> DataFrame:
    """(template_id, severity, app_status, level, n_warnings, n_submissions) for every level of the three axes.

    An axis that a level sums over is null there, and its bit is set in ``level`` (4, 2, 1). ``tips`` are active
    tips (qid, template_id, severity, warn), ``status`` has one row a qid; a submission without one is
    ``Deleted``. Submissions are brought to a row each first, with their warnings by severity, so every
    level is a plain sum and no level needs distinct ids: a submission answers one template.
    """
    per = _with_status(tips, status).groupBy("template_id", "qid", "app_status").agg(F.collect_list(F.coalesce("severity", F.lit(""))).alias("s"))
    found = F.transform(F.array_distinct("s"), lambda x: F.struct(
        F.lit(False).alias(_ALL), x.alias("severity"), F.size(F.filter("s", lambda y: y == x)).cast("long").alias("n")))
    whole = F.array(F.struct(F.lit(True).alias(_ALL), F.lit(None).cast("string").alias("severity"), F.size("s").cast("long").alias("n")))
    rows = per.select("template_id", "app_status", F.inline(F.concat(whole, found)))
    keys = [_ALL, "severity", "template_id", "app_status"]
    sets = [[_ALL, "severity", *more] for more in (["template_id", "app_status"], ["template_id"], ["app_status"], [])]
    summed = rows.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in keys]).agg(
        F.sum("n").alias("n_warnings"), F.count(F.lit(1)).alias("n_submissions"),
        (F.grouping("template_id") * 4 + F.grouping("app_status")).cast("int").alias("level"))
    return summed.select(*AXES, (F.col("level") + F.when(F.col(_ALL), 2).otherwise(0)).cast("int").alias("level"),
                         "n_warnings", "n_submissions")


def risk_sketches(tips: DataFrame, status: DataFrame) -> DataFrame:
    """The finest level with a sketch of its submissions: rows of any days or shards that ``merge_sketches`` adds up."""
    return _with_status(tips, status).groupBy("template_id", F.coalesce("severity", F.lit("")).alias("severity"), "app_status").agg(
        F.count(F.lit(1)).alias("n_warnings"), F.hll_sketch_agg("qid", SKETCH_LG_K).alias("submissions"))


def merge_sketches(sketches: DataFrame, axes: list[str]) -> DataFrame:
    """One level of ``risk_levels`` from sketches, however often they hold a submission: n_submissions is an estimate."""
    merged = sketches.groupBy(*axes).agg(F.sum("n_warnings").alias("n_warnings"),
                                         F.hll_sketch_estimate(F.hll_union_agg("submissions")).alias("n_submissions"))
    return merged.select(*[F.col(a) if a in axes else F.lit(None).cast("string").alias(a) for a in AXES],
                         F.lit(_level(axes)).alias("level"), "n_warnings", "n_submissions")
