"""Mixing sources to target weights by temperature, with DataFrame functions only.

A source's weight is its token share raised to an exponent and normalised. The exponent is
narrowed down between 0 (all sources equal) and 1 (as they are): the smallest that keeps every
source within a repetition limit, or the one that meets a target entropy. Weights become copies
of documents: each source gets its whole number of epochs, and the rest of its budget is filled
from a permutation of its blocks, documents in order of a hash within each block. Blocks hold
about ``BLOCK_DOCS`` documents, so running sums never run over a whole source in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table

BLOCK_DOCS = 2048
SECTIONS = 32      # parts into which the exponent's interval is cut per step
STEPS = 6
NO_SOURCE = "<null>"


def _tokens(text) -> F.Column:
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def _number(text: F.Column) -> F.Column:
    """The first 32 bits of a text's MD5."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def source_shares(docs: DataFrame, *, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(source, docs, tokens); a null source is the source ``<null>``."""
    return docs.select(F.coalesce(F.col(source_col).cast("string"), F.lit(NO_SOURCE)).alias("source"),
                       _tokens(F.col(text_col)).alias("n")).groupBy("source").agg(
        F.count(F.lit(1)).alias("docs"), F.sum("n").alias("tokens"))


def exponent(shares: DataFrame, *, repetition: float | None = None, entropy: float | None = None,
             budget: float | None = None) -> float:
    """The smallest exponent in [0, 1], to four decimals, within the repetition limit or target entropy.

    ``budget`` in tokens; None stands for the least budget that uses every source whole at least
    once. Entropy is in nats and falls as the exponent grows: the largest exponent that still
    reaches the target is meant there. Per step one row for each section comes to the driver.
    """
    top, total = shares.agg(F.max("tokens"), F.sum("tokens")).first()
    if not top:
        return 1.0
    if budget is not None and repetition is not None and budget > repetition * total:
        raise ValueError(f"a budget of {budget} tokens needs {total} tokens more than {repetition} times")
    share = shares.where("tokens > 0").select((F.col("tokens") / F.lit(float(top))).alias("t"))
    lo, hi = 0.0, 1.0
    for _ in range(STEPS):
        grid = [lo + (hi - lo) * k / SECTIONS for k in range(SECTIONS + 1)]
        found = share.select("t", F.explode(F.array(*map(F.lit, grid))).alias("a")).groupBy("a").agg(
            F.sum(F.pow("t", "a")).alias("z"), F.sum(F.pow("t", "a") * F.log("t")).alias("zl"),
            F.max(F.pow("t", F.col("a") - 1)).alias("most"), F.min(F.pow("t", F.col("a") - 1)).alias("least"))
        fits = {}
        for r in found.collect():
            epochs = r["most"] / r["least"] if budget is None else budget / top * r["most"] / r["z"]
            fits[r["a"]] = (math.log(r["z"]) - r["a"] * r["zl"] / r["z"] < entropy if entropy is not None
                            else epochs <= (repetition or math.inf))
        good = [a for a in grid if fits[a]]
        hi = min(good, default=1.0)
        lo = max([a for a in grid if a < hi], default=0.0) if hi > 0 else 0.0
        if hi == 0:
            break
    return math.ceil(hi * 1e4 - 1e-6) / 1e4


def epochs_of(shares: DataFrame, a: float, budget: float | None) -> DataFrame:
    """shares with weight and epochs (how often the source's tokens are used on the whole)."""
    power = F.when(F.col("tokens") > 0, F.pow(F.col("tokens").cast("double"), F.lit(a))).otherwise(0.0)
    z, top = shares.agg(F.sum(power), F.max("tokens")).first()
    weight = power / F.lit(z or 1.0)
    if budget is None:
        epochs = F.pow(F.col("tokens") / F.lit(float(top or 1)), F.lit(a - 1))
    else:
        epochs = F.lit(float(budget)) * weight / F.col("tokens")
    return shares.withColumn("weight", weight).withColumn("epochs", F.when(F.col("tokens") > 0, epochs).otherwise(1.0))


def mix_sources(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
                repetition: float | None = 4.0, entropy: float | None = None, budget: float | None = None,
                seed: str = "mix") -> DataFrame:
    """Per row of ``docs``: doc_id, source, n_tokens, weight (of its source), copies.

    Every document gets its source's whole epochs; one more copy goes to the documents that a
    permutation puts first, as long as their running token count stays within the rest of the
    budget. A document without tokens costs nothing and gets a copy more. Null
    sources are mixed as ``<null>``, null texts have no tokens; repeated rows and rows without id
    are placed like any other (equal rows next to each other). A budget that no mixture within the
    repetition limit can fill is a ValueError. Texts of any length are counted whole, an empty table
    gives no rows, and columns of other names are never read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(source_col).cast("string"), F.lit(NO_SOURCE)).alias("source"),
                       _tokens(F.col(text_col)).alias("n_tokens"))
    rows = table(rows, "mix-rows")
    shares = table(rows.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_tokens").alias("tokens")), "mix-shares")
    plan = epochs_of(shares, exponent(shares, repetition=repetition, entropy=entropy, budget=budget), budget).select(
        "source", "weight", F.floor("epochs").cast("long").alias("whole"),
        F.floor((F.col("epochs") - F.floor("epochs")) * F.col("tokens") + 1e-6).cast("long").alias("rest"),
        F.ceil(F.col("docs") / F.lit(float(BLOCK_DOCS))).cast("long").alias("blocks"))
    key = F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    placed = rows.join(plan, "source").withColumn("place", F.md5(key)).withColumn("block", F.pmod(_number(key), F.col("blocks")))
    inside = Window.partitionBy("source", "block").orderBy("place", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    turn = F.md5(F.concat_ws(":", F.lit(seed), "source", F.col("block").cast("string")))
    sums = placed.groupBy("source", "block").agg(F.sum("n_tokens").alias("block_tokens")).withColumn("turn", turn)
    before = Window.partitionBy("source").orderBy("turn", "block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("source", "block", F.coalesce(F.sum("block_tokens").over(before), F.lit(0)).alias("before"))
    return (placed.withColumn("within", F.sum("n_tokens").over(inside)).join(starts, ["source", "block"])
            .select("doc_id", "source", "n_tokens", F.round("weight", 6).alias("weight"),
                    (F.col("whole") + (F.col("before") + F.col("within") <= F.col("rest")).cast("long")).alias("copies")))


def mix_sql(repetition: float = 4.0, seed: str = "mix") -> str:
    """DuckDB SQL of ``mix_sources`` over documents for a repetition limit and the least budget."""
    return f"""
WITH r AS (SELECT doc_id, coalesce(source, '{NO_SOURCE}') AS source,
                  len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens FROM documents),
s AS (SELECT source, count(*) AS docs, sum(n_tokens)::BIGINT AS tokens FROM r GROUP BY 1),
x AS (SELECT max(tokens)::DOUBLE AS top, min(tokens) FILTER (tokens > 0)::DOUBLE AS low FROM s),
e AS (SELECT top, CASE WHEN top = low THEN 0.0 ELSE
        ceil(greatest(0.0, 1 - ln({repetition}) / ln(top / low)) * 1e4 - 1e-6) / 1e4 END AS a FROM x),
q AS (SELECT source, docs, tokens, CASE WHEN tokens > 0 THEN pow(tokens::DOUBLE, a) ELSE 0.0 END AS p,
             CASE WHEN tokens > 0 THEN pow(tokens / top, a - 1) ELSE 1.0 END AS epochs FROM s, e),
t AS (SELECT source, round(p / sum(p) OVER (), 6) AS weight, floor(epochs)::BIGINT AS whole,
             floor((epochs - floor(epochs)) * tokens + 1e-6)::BIGINT AS rest, ceil(docs / {BLOCK_DOCS}.0)::BIGINT AS blocks FROM q),
b AS (SELECT doc_id, source, n_tokens, weight, whole, rest, md5('{seed}:' || coalesce(doc_id::VARCHAR, '')) AS place, blocks FROM r JOIN t USING (source)),
c AS (SELECT *, ('0x' || substr(place, 1, 8))::BIGINT % blocks AS block FROM b),
d AS (SELECT *, sum(n_tokens) OVER (PARTITION BY source ORDER BY md5('{seed}:' || source || ':' || block), block, place, doc_id, n_tokens
                                    ROWS UNBOUNDED PRECEDING) AS upto FROM c)
SELECT doc_id, source, n_tokens, weight, whole + (upto <= rest)::BIGINT AS copies FROM d"""
