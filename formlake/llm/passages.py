"""Substring dedup of repeated passages with super-k-mer partitioning.

A window is ``WINDOW`` consecutive words; its minimiser is the smallest hash of the ``GRAM``-word
runs inside it. Consecutive windows of a document with the same minimiser form one stretch (a
super-k-mer): their words travel as one packed string to the minimiser's bucket, and equal windows
always meet there. Minimisers that occur in one document only are left out first, so only stretches
that may repeat travel at all. Equal strings are one before anything is expanded; in a bucket the
windows of its distinct strings are sorted and each finds the smallest document that holds it. A
bucket with very many windows is cut further by the hash of single windows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, binary_column, gram_hashes, sliding_min, table
from .minhash_forest import _groups

WINDOW = 50
GRAM = 16
BUCKET_WINDOWS = 131_072  # windows of a bucket's distinct strings that are expanded in one task


def stretches(h: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minimiser, first window, windows) of the stretches of a text with word hashes ``h``."""
    if len(h) < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = sliding_min(gram_hashes(h, gram), window - gram + 1)
    cut = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
    return low[cut], cut, np.diff(np.append(cut, len(low)))


def _stretch_rows(rows: DataFrame, window: int) -> DataFrame:
    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            keys, docs, starts, counts = [], [], [], []
            for doc, blob in zip(batch.column(0).to_pylist(), binary_column(batch, "text")):
                k, s, n = stretches(hashes.of(blob.split()), window)
                keys.append(k)
                docs.append(np.full(len(k), doc, np.int64))
                starts.append(s)
                counts.append(n)
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(docs)),
                                                  pa.array(np.concatenate(starts).astype(np.int32)), pa.array(np.concatenate(counts).astype(np.int32))],
                                                 names=["key", "doc_id", "start", "n"])

    return rows.mapInArrow(run, "key long, doc_id long, start int, n int")


def _pack(window: int):
    """Cuts the listed stretches out of each text: (key, sid, packed, doc_id, start, n)."""

    def run(batches):
        for batch in batches:
            out = ([], [], [], [], [], [])
            for doc, blob, listed in zip(batch.column(0).to_pylist(), binary_column(batch, "text"), batch.column(2).to_pylist()):
                words = blob.split()
                for s in listed:
                    packed = b" ".join(words[s["start"]:s["start"] + s["n"] + window - 1])
                    for column, value in zip(out, (s["key"], hashlib.blake2b(packed, digest_size=16).digest(), packed, doc, s["start"], s["n"])):
                        column.append(value)
                if len(out[0]) >= 2000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names)
                    out = ([], [], [], [], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names)

    types = [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int32(), pa.int32()]
    names = ["key", "sid", "packed", "doc_id", "start", "n"]
    return run


def _window_digests(words: list[bytes], window: int) -> list[bytes]:
    return [hashlib.blake2b(b" ".join(words[i:i + window]), digest_size=16).digest() for i in range(len(words) - window + 1)]


def _count_bucket(window: int):
    """Per bucket: (sid, first_doc, hits): the windows of the string that start in a smaller document."""

    def run(batches):
        def flush(out):
            return pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.list_(pa.int32()))], names=["sid", "hits"])

        out = ([], [])
        for _, g in _groups(batches, ["sid", "packed", "first_doc"]):
            if len(g["sid"]) < 2:
                continue
            rows = []  # (window's words, document, string, offset), sorted: equal windows side by side
            for k, (packed, doc) in enumerate(zip(g["packed"], g["first_doc"])):
                words = packed.split(b" ")
                rows += [(b" ".join(words[i:i + window]), doc, k, i) for i in range(len(words) - window + 1)]
            rows.sort()
            hits: dict[int, list[int]] = {}
            least = None
            for j, (w, doc, k, i) in enumerate(rows):
                if j == 0 or w != rows[j - 1][0]:
                    least = doc
                if doc > least:
                    hits.setdefault(k, []).append(i)
            for k, found in hits.items():
                out[0].append(g["sid"][k])
                out[1].append(sorted(found))
            if len(out[0]) > 2000:
                yield flush(out)
                out = ([], [])
        yield flush(out)

    return run


def _hot_hits(strings: DataFrame, window: int) -> DataFrame:
    """The same for buckets too large for a task: windows travel singly, by their own digest."""

    def run(batches):
        for batch in batches:
            for sid, packed, doc in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("sid", "packed", "first_doc"))):
                digests = _window_digests(packed.split(b" "), window)
                yield pa.RecordBatch.from_arrays([pa.array([sid] * len(digests), pa.binary()), pa.array([doc] * len(digests), pa.int64()),
                                                  pa.array(range(len(digests)), pa.int32()), pa.array(digests, pa.binary())],
                                                 names=["sid", "first_doc", "i", "digest"])

    windows = table(strings.select("sid", "packed", "first_doc").mapInArrow(run, "sid binary, first_doc long, i int, digest binary"), "hot-windows")
    least = windows.groupBy("digest").agg(F.min("first_doc").alias("least"))
    return windows.join(least, "digest").where("first_doc > least").groupBy("sid").agg(F.sort_array(F.collect_set("i")).alias("hits"))


def repeated_windows(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, runs): runs [start, end) of words covered by windows that start in a smaller document."""
    found = table(_stretch_rows(rows, window), "stretches")
    shared = found.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a <> b").select("key")
    listed = found.join(shared, "key").groupBy("doc_id").agg(F.collect_list(F.struct("key", "start", "n")).alias("listed"))
    packed = table(rows.join(listed.hint("merge"), "doc_id").select("doc_id", "text", "listed").mapInArrow(
        _pack(window), "key long, sid binary, packed binary, doc_id long, start int, n int"), "packed-stretches")
    strings = table(packed.groupBy("key", "sid").agg(F.first("packed").alias("packed"), F.min("doc_id").alias("first_doc"),
                                                  F.first("n").alias("n")), "strings")
    size = strings.groupBy("key").agg(F.count(F.lit(1)).alias("strings"), F.sum("n").alias("windows")).where("strings > 1")
    sized = strings.join(size, "key")
    hits = (sized.where(F.col("windows") <= BUCKET_WINDOWS).select("key", "sid", "packed", "first_doc")
            .repartition("key").sortWithinPartitions("key").mapInArrow(_count_bucket(window), "sid binary, hits array<int>"))
    hot = sized.where(F.col("windows") > BUCKET_WINDOWS)
    if not hot.isEmpty():
        hits = hits.unionByName(_hot_hits(hot, window))
    # in the smallest document of a string only the hits count, in any other all its windows
    placed = packed.select("sid", "doc_id", "start", "n").join(strings.select("sid", "first_doc"), "sid").join(hits, "sid", "left")
    first = F.col("doc_id") == F.col("first_doc")
    single = F.transform(F.col("hits"), lambda i: F.struct((F.col("start") + i).alias("a"), (F.col("start") + i + window).alias("b")))
    whole = F.array(F.struct(F.col("start").alias("a"), (F.col("start") + F.col("n") + F.lit(window - 1)).alias("b")))
    return (placed.where(~first | F.col("hits").isNotNull()).select("doc_id", F.when(first, single).otherwise(whole).alias("runs"))
            .groupBy("doc_id").agg(F.flatten(F.collect_list("runs")).alias("runs")))


def drop_repeated_passages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_removed, text (the kept words joined by one space).

    Null and empty texts have no words. A null id orders before every other id and so keeps its
    passages. Rows of one id are one document: windows that only they share stay; each row
    loses the words that its own text repeats from smaller ids.
    """
    low = -2**63
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(low)).alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    copies = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if not copies.isEmpty():
        return _of_repeated_ids(rows, copies, window, low)
    return _removed(rows, repeated_windows(rows, window), "doc_id", window, low)


def _removed(rows: DataFrame, runs: DataFrame, key: str, window: int, low: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            ids, total, removed, kept = [], [], [], []
            for doc, blob, found in zip(batch.column(0).to_pylist(), binary_column(batch, "text"), batch.column(2).to_pylist()):
                words = blob.split()
                gone = np.zeros(len(words) + 1, np.int64)
                for r in found or ():
                    gone[r["a"]] += 1
                    gone[r["b"]] -= 1
                gone = np.cumsum(gone)[:len(words)] > 0
                ids.append(None if doc == low else doc)
                total.append(len(words))
                removed.append(int(gone.sum()))
                kept.append(b" ".join(words) if not removed[-1] else b" ".join([w for w, g in zip(words, gone.tolist()) if not g]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total, pa.int64()), pa.array(removed, pa.int64()),
                                              pa.array([k.decode() for k in kept], pa.string())], names=["doc_id", "n_words", "n_removed", "text"])

    joined = rows.join(runs.hint("merge"), key, "left").select("doc_id", "text", "runs")
    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, text string")


def _of_repeated_ids(rows: DataFrame, copies: DataFrame, window: int, low: int) -> DataFrame:
    """The way for tables in which ids repeat: texts of one id are told apart by a digest.

    Stretches are found per text; a window repeats if a smaller id holds it, so texts are numbered
    by their id's order and windows of the same id are compared by that id alone.
    """
    texts = table(rows.withColumn("text_key", F.sha2("text", 256)), "texts")
    distinct = texts.dropDuplicates(["doc_id", "text_key"])
    # one text per id and pass: the k-th text of every id, against all texts of smaller ids
    from pyspark.sql import Window

    numbered = table(distinct.withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy("text_key"))), "numbered")
    joined = numbered.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("k", "text"))).alias("parts"))
    # a separator of window words that no text holds keeps windows from spanning two texts
    wall = F.concat(F.lit(" "), F.array_join(F.array_repeat(F.lit("\x00"), 1), " "), F.lit(" "))
    whole = joined.select("doc_id", F.array_join(F.transform("parts", lambda p: F.concat(p["text"], wall, F.col("doc_id").cast("string"), wall)), "").alias("text"))
    offsets = _word_counts(numbered)
    runs = repeated_windows(whole, window)
    at = offsets.join(runs, "doc_id").select("doc_id", "text_key", F.transform(
        F.filter("runs", lambda r: (r["a"] < F.col("first") + F.col("words")) & (r["b"] > F.col("first"))),
        lambda r: F.struct((F.greatest(r["a"], F.col("first")) - F.col("first")).cast("int").alias("a"),
                           (F.least(r["b"], F.col("first") + F.col("words")) - F.col("first")).cast("int").alias("b"))).alias("runs"))
    joined = texts.join(at, ["doc_id", "text_key"], "left").select("doc_id", "text", "runs")
    return _removed(joined.drop("runs").withColumn("key", F.xxhash64("doc_id", "text")),
                    joined.select(F.xxhash64("doc_id", "text").alias("key"), "runs").dropDuplicates(["key"]), "key", window, low)


def _word_counts(numbered: DataFrame) -> DataFrame:
    """(doc_id, text_key, first, words): where each text of an id starts among the id's joined words."""
    from pyspark.sql import Window

    counted = numbered.select("doc_id", "text_key", "k", F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]+")).alias("words"))
    before = Window.partitionBy("doc_id").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    return counted.select("doc_id", "text_key", "words", F.coalesce(F.sum(F.col("words") + 3).over(before), F.lit(0)).alias("first"))
