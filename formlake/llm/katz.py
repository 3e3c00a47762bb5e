"""Language-model scores by Katz backoff.

N-gram counts of the training documents are discounted after Good and Turing (counts up to
``GT_MAX``), and each context's left-over mass goes to the next shorter context by a backoff weight
normalised exactly over the words it was seen with. Probabilities and weights are tables hashed by
context; a text is scored level by level: a token's n-gram is looked up at the highest order, and
tokens that are not found take the context's weight and go on one order below. The lowest order
holds one symbol for all unseen words. Bigrams, the order registered, are kept in packed blocks
(``katz_blocks``); ``Model`` holds any other order as plain tables.
"""

from __future__ import annotations

import math
import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, binary_column, gram_hashes, lower_words, table
from .katz_blocks import END, PairModel

ORDER = 2
GT_MAX = 5
START = xxhash.xxh3_64_intdigest(b"\x00 start")
LEAST = 1e-12


def is_training(doc_id) -> bool:
    """Whether a document is learned from: crc32 of its id as text, mod 10, is not 0."""
    return zlib.crc32(str(doc_id).encode()) % 10 != 0


def _events(rows: DataFrame, order: int) -> DataFrame:
    """Per text its distinct n-grams: doc_id, row, train, c1.. (context hashes by length), w, n (occurrences)."""
    names = ["doc_id", "row", "train", *[f"c{k}" for k in range(1, order)], "w", "n"]

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for doc, row, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), binary_column(batch, "text")):
                w = np.append(hashes.of(lower_words(blob)), np.uint64(END))
                padded = np.concatenate((np.full(order - 1, START, np.uint64), w))
                columns = [gram_hashes(padded[order - 1 - k:-1], k) for k in range(1, order)] + [w]
                whole = gram_hashes(padded, order)
                _, first, n = np.unique(whole, return_index=True, return_counts=True)
                out[0].append(pa.array([doc] * len(first), pa.int64()))
                out[1].append(np.full(len(first), row, np.int64))
                out[2].append(np.full(len(first), doc is not None and is_training(doc)))
                for k, c in enumerate(columns):
                    out[3 + k].append(c[first].view(np.int64))
                out[-1].append(n.astype(np.int32))
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(out[0]), *[pa.array(np.concatenate(c)) for c in out[1:]]], names=names)

    kinds = ["long", "long", "boolean", *["long"] * (order - 1), "long", "int"]
    return rows.select("doc_id", "row", "text").mapInArrow(run, ", ".join(f"{a} {b}" for a, b in zip(names, kinds)))


def discounts(n: dict[int, int]) -> dict[int, float]:
    """Good-Turing ratios for counts 1..GT_MAX from the counts of counts.

    The counts of counts are smoothed first, by a line through their logarithms against those of the
    counts (least squares), as neighbouring ones of real texts are too uneven to be divided. A falling
    line steeper than -1 gives ratios within (0, 1) for every count. Only a table whose counts of counts
    do not fall like that, a few words that all recur, has no Good-Turing estimate: (r - 1/2) / r then.
    """
    seen = [(math.log(r), math.log(n[r])) for r in range(1, GT_MAX + 2) if n.get(r)]
    x, y = (sum(c) / max(len(seen), 1) for c in zip(*seen)) if seen else (0.0, 0.0)
    spread = sum((a - x) ** 2 for a, _ in seen)
    power = sum((a - x) * (b - y) for a, b in seen) / spread + 1 if spread else 0.0
    if power >= 0:
        return {r: (r - 0.5) / r for r in range(1, GT_MAX + 1)}
    rest = (GT_MAX + 1) ** power  # share of the mass of counts of one that the larger counts keep
    return {r: ((1 + 1 / r) ** power - rest) / (1 - rest) for r in range(1, GT_MAX + 1)}


def _discounted(counts: DataFrame) -> DataFrame:
    """``counts`` with column ``dc``: the discounted count."""
    few = {r["c"]: r["count"] for r in counts.where(F.col("c") <= GT_MAX + 1).groupBy("c").count().collect()}
    ratio = reduce(lambda e, rd: e.when(F.col("c") == rd[0], F.lit(rd[1])), discounts(few).items(), F.when(F.lit(False), 1.0)).otherwise(1.0)
    return counts.withColumn("dc", F.col("c") * ratio)


class Model:
    """Tables of a fitted model: ``grams[k]`` (ck, w, p, cw), ``weights[k]`` (ck, alpha); numbers N, V, p(unseen)."""

    def __init__(self, events: DataFrame, order: int = ORDER):
        self.order = order
        train = events.where("train")
        words = _discounted(table(train.groupBy("w").agg(F.sum("n").alias("c")), "counts-1"))
        total = words.agg(F.sum("c"), F.count(F.lit(1)), F.sum("dc")).first()
        self.tokens, self.types, kept = total[0] or 0, total[1], total[2] or 0.0
        base = float(self.tokens) if kept < self.tokens else self.tokens + 1.0
        self.unseen = 1.0 - kept / base
        self.grams = [table(words.select("w", (F.col("dc") / base).alias("p"), F.col("c").alias("cw")), "grams-1")]
        self.weights: list[DataFrame | None] = [None]
        for k in range(1, order):
            lower = [f"c{k - 1}"] if k > 1 else []
            counts = _discounted(table(train.groupBy(f"c{k}", "w").agg(F.sum("n").alias("c"), *[F.first(x).alias(x) for x in lower]),
                                       f"counts-{k + 1}"))
            context = counts.groupBy(f"c{k}").agg(F.sum("c").alias("all"), F.sum("dc").alias("kept")).select(
                f"c{k}", "kept", F.when(F.col("kept") < F.col("all") - 1e-9, F.col("all")).otherwise(F.col("all") + 1).alias("all"))
            below = self.grams[k - 1].withColumnRenamed("p", "p_below")
            grams = table(counts.join(context, f"c{k}").join(below, [*lower, "w"]).select(
                f"c{k}", "w", (F.col("dc") / F.col("all")).alias("p"), "cw", "p_below"), f"grams-{k + 1}")
            self.weights.append(table(grams.groupBy(f"c{k}").agg(
                (F.greatest(1 - F.sum("p"), F.lit(LEAST)) / F.greatest(1 - F.sum("p_below"), F.lit(LEAST))).alias("alpha")),
                f"weights-{k + 1}"))
            self.grams.append(grams.drop("p_below"))

    def score(self, events: DataFrame) -> DataFrame:
        """(doc_id, row, tokens, known, base, score) summed over each text's tokens."""
        parts, rest = [], events.withColumn("logp", F.lit(0.0))
        for k in range(self.order - 1, 0, -1):
            found = rest.join(self.grams[k], [f"c{k}", "w"], "left")
            parts.append(found.where("p is not null").select("doc_id", "row", "n", "cw", (F.col("logp") + F.log10("p")).alias("logp")))
            rest = found.where("p is null").drop("p", "cw").join(self.weights[k], f"c{k}", "left").withColumn(
                "logp", F.col("logp") + F.log10(F.coalesce("alpha", F.lit(1.0)))).drop("alpha", f"c{k}")
        parts.append(rest.join(self.grams[0], "w", "left").select(
            "doc_id", "row", "n", "cw", (F.col("logp") + F.log10(F.coalesce("p", F.lit(max(self.unseen, LEAST))))).alias("logp")))
        rows = reduce(DataFrame.unionByName, parts)
        base = F.log10((F.coalesce("cw", F.lit(0)) + 0.1) / F.lit(self.tokens + 0.1 * (self.types + 1)))
        return rows.groupBy("doc_id", "row").agg(
            F.sum("n").alias("tokens"), F.sum(F.when(F.col("cw") > 0, F.col("n")).otherwise(0)).alias("known"),
            F.sum(F.col("n") * base).alias("base"), F.sum(F.col("n") * F.col("logp")).alias("score"))


def score_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    Every text ends with one end token; null and empty texts have that one only. A null id is
    scored, not learned from, and its ``held_out`` is null. Repeated rows each count in training
    and each get the same scores. With nothing to learn from all tokens are unseen.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    held = F.when(F.col("doc_id").isNotNull(), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0)
    if order == 2:
        # a row's key: its id with a 32-bit hash of the text, for null ids a 64-bit one
        rows = rows.select("doc_id", F.coalesce("doc_id", F.lit(0)).alias("id"), "text", F.coalesce(~held, F.lit(False)).alias("train"),
                           F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.hash("text").cast("long")).alias("row"))
        model = PairModel(rows, discounts, GT_MAX)
        summed = model.score().withColumnsRenamed({"id": "d", "row": "r"})
        same = (F.coalesce("doc_id", F.lit(0)) == F.col("d")) & (F.col("row") == F.col("r"))
    else:
        rows = rows.withColumn("row", F.xxhash64("doc_id", "text"))
        events = _events(rows, order)
        model = Model(events, order)
        summed = model.score(events).withColumnsRenamed({"doc_id": "d", "row": "r"})
        same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("row") == F.col("r"))
    ids = rows.groupBy("doc_id", "row").agg(F.count(F.lit(1)).alias("copies"))
    out = ids.join(summed, same).select(
        "doc_id", held.alias("held_out"), (F.col("tokens") / F.col("copies")).cast("long").alias("n_tokens"),
        (F.col("known") / F.col("copies")).cast("long").alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") / F.col("copies")).alias("base_score"), (F.col("score") / F.col("copies")).alias("score"), "copies")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("copies", "copy")
