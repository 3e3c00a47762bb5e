"""Benchmark decontamination by winnowing.

Of every run of ``WINDOW - GRAM + 1`` consecutive word k-grams the smallest hash is kept (the
rightmost on ties), in documents and benchmark items alike, so any shared span of ``WINDOW`` words
has a kept hash in common. Fingerprints are joined and each hit is extended word by word to its
whole run; runs of at least ``WINDOW`` words count. Items of fewer words are one window, found by
the hash of their whole sequence and compared word by word.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, binary_column, giving_back, gram_hashes, sliding_min, table

WINDOW = 10
GRAM = 5
SMALL_BENCHMARK_BYTES = 16 << 20  # beyond this the fingerprints are joined instead of sent to every task
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_WORDS = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in _LOWER)


def plain_words(blob: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z."""
    return blob.translate(_WORDS).split()


def winnow(grams: np.ndarray, width: int) -> np.ndarray:
    """Positions kept: in every run of ``width`` grams the rightmost smallest (all grams' smallest if fewer)."""
    if len(grams) == 0:
        return np.zeros(0, np.int64)
    width = min(width, len(grams))
    low = sliding_min(grams, width)
    at = np.arange(len(grams))
    best = np.zeros(len(low), np.int64)
    for shift in range(width):
        best = np.where(grams[shift:shift + len(low)] == low, at[shift:shift + len(low)], best)
    return np.unique(best)


def fingerprints(words: list[bytes], hashes: WordHashes) -> np.ndarray:
    """Fingerprints of a benchmark item's or a document's words: hashes of kept grams."""
    h = hashes.of(words)
    grams = gram_hashes(h, GRAM)
    return grams[winnow(grams, WINDOW - GRAM + 1)]


class Index:
    """Fingerprints of a set of items, and the extension of hits."""

    def __init__(self, items: list[tuple[str, bytes]]):
        self.hashes = WordHashes()
        self.items = []
        seeds, short = [], {}
        for item_id, blob in items:
            words = plain_words(blob)
            if not words:
                continue
            n = len(self.items)
            self.items.append((item_id, words))
            h = self.hashes.of(words)
            if len(words) >= WINDOW:
                grams = gram_hashes(h, GRAM)
                seeds += [(int(grams[p]), n, p) for p in winnow(grams, WINDOW - GRAM + 1).tolist()]
            else:
                short.setdefault(len(words), []).append((int(gram_hashes(h, len(words))[0]), n))
        self.seeds: dict[int, list] = {}
        for value, n, p in seeds:
            self.seeds.setdefault(value, []).append((n, p))
        self.keys = np.array(sorted(self.seeds), np.uint64)
        self.short = {}
        for length, found in short.items():
            by = {}
            for value, n in found:
                by.setdefault(value, []).append(n)
            self.short[length] = (np.array(sorted(by), np.uint64), by)

    @staticmethod
    def _among(values: np.ndarray, keys: np.ndarray) -> np.ndarray:
        if len(keys) == 0 or len(values) == 0:
            return np.zeros(0, np.int64)
        at = np.searchsorted(keys, values)
        at[at == len(keys)] = 0
        return np.flatnonzero(keys[at] == values)

    def matches(self, words: list[bytes]) -> list[tuple[int, int, int]]:
        """(item, start, end) of the document's runs of words that are covered by occurring windows."""
        out = []
        h = self.hashes.of(words)
        if len(words) >= WINDOW and len(self.keys):
            grams = gram_hashes(h, GRAM)
            kept = winnow(grams, WINDOW - GRAM + 1)
            reached: dict[tuple[int, int], int] = {}
            for p in kept[self._among(grams[kept], self.keys)].tolist():
                for n, q in self.seeds[int(grams[p])]:
                    if reached.get((n, p - q), -1) >= p + GRAM:
                        continue
                    item = self.items[n][1]
                    if words[p:p + GRAM] != item[q:q + GRAM]:
                        continue
                    a, b = p, p + GRAM
                    while a > 0 and q - (p - a) > 0 and words[a - 1] == item[q - (p - a) - 1]:
                        a -= 1
                    while b < len(words) and q + (b - p) < len(item) and words[b] == item[q + (b - p)]:
                        b += 1
                    reached[n, p - q] = b
                    if b - a >= WINDOW:
                        out.append((n, a, b))
        for length, (keys, by) in self.short.items():
            grams = gram_hashes(h, length)
            for p in self._among(grams, keys).tolist():
                out += [(n, p, p + length) for n in by[int(grams[p])] if words[p:p + length] == self.items[n][1]]
        return out


def _covered(runs: list[tuple[int, int]]) -> int:
    total, reach = 0, 0
    for a, b in sorted(runs):
        total += max(0, b - max(a, reach))
        reach = max(reach, b)
    return total


def _digest(ids) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


OUT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                  item_id_col: str = "item_id", item_text_col: str = "text",
                  small_bytes: int = SMALL_BENCHMARK_BYTES) -> DataFrame:
    """Per row of ``docs``: its id, n_words, n_hit, n_items, items_sha256, contaminated.

    A null text has no words; items without words match nothing; items of one id count once, a
    null item id is written as an empty string. Repeated rows and null document ids give a row each. If the benchmark's
    texts take at most ``small_bytes`` (counted first) each task gets them and one pass without a
    shuffle does all; otherwise fingerprints of both sides are joined and only documents with a
    common fingerprint are compared with the items in question.
    """
    items = benchmark.select(F.coalesce(F.col(item_id_col).cast("string"), F.lit("")).alias("item_id"),
                             F.coalesce(F.col(item_text_col).cast("string"), F.lit("")).alias("item_text"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("item_text") + 64)).first()[0] or 0
    return _sent(rows, items) if size <= small_bytes else _joined(rows, items)


def _sent(rows: DataFrame, items: DataFrame) -> DataFrame:
    texts = [(r[0], r[1].encode()) for r in items.collect()]  # at most small_bytes, checked by the caller

    def run(batches):
        index = Index(texts)
        for batch in batches:
            out = ([], [], [], [], [])
            for blob in binary_column(batch, "text"):
                words = plain_words(blob)
                runs = index.matches(words)
                hit = _covered([r[1:] for r in runs])
                ids = {index.items[r[0]][0] for r in runs}
                for column, value in zip(out, (len(words), hit, len(ids), _digest(ids), hit > 0)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, out[:2]), pa.array(out[2], pa.int64()),
                                              pa.array(out[3], pa.string()), pa.array(out[4], pa.bool_())],
                                             names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return rows.mapInArrow(giving_back(run), f"doc_id long, {OUT}")


def _keys(texts: DataFrame, name: str, lengths: list[int], item: bool) -> DataFrame:
    """(key, keys of the side ``name``): kept gram hashes, and the sequence hashes of short windows."""

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            keys, counts = [], []
            for blob in binary_column(batch, "text"):
                words = plain_words(blob)
                counts.append(len(words))
                h = hashes.of(words)
                found = [gram_hashes(h, length) for length in lengths if not item or len(words) == length]
                if len(words) >= WINDOW:
                    grams = gram_hashes(h, GRAM)
                    found.append(grams[winnow(grams, WINDOW - GRAM + 1)])
                keys.append(np.unique(np.concatenate(found or [np.zeros(0, np.uint64)])).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()),
                                              pa.array(keys, pa.list_(pa.int64()))], names=[name, "n_words", "keys"])

    return texts.mapInArrow(run, f"{name} {dict(texts.dtypes)[name]}, n_words long, keys array<long>")


def _joined(rows: DataFrame, items: DataFrame) -> DataFrame:
    """The way for benchmarks of any size; rows are told apart by id and text."""
    items = items.where("item_text <> ''")
    keyed_items = table(_keys(items.select("item_id", F.col("item_text").alias("text")), "item_id", list(range(1, WINDOW)), True), "item-keys")
    short = keyed_items.where((F.col("n_words") > 0) & (F.col("n_words") < WINDOW)).select("n_words").distinct()
    lengths = sorted(int(r[0]) for r in short.collect())  # at most nine numbers: only these lengths can be met in documents
    item_keys = keyed_items.select("item_id", F.explode("keys").alias("key"))
    keyed = rows.withColumn("row_key", F.unhex(F.md5(F.concat_ws("\x00", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), "text"))))
    doc_keys = _keys(keyed.select("row_key", "text"), "row_key", lengths, False)
    pairs = doc_keys.select("row_key", F.explode("keys").alias("key")).join(item_keys, "key").select(
        "row_key", "item_id").distinct()
    found = (pairs.join(keyed.select("row_key", "text").distinct(), "row_key")
             .join(items.distinct(), "item_id").select("row_key", "text", "item_id", "item_text"))

    def run(batches):
        for batch in batches:
            out = ([], [], [], [])
            for key, blob, item, text in zip(batch.column(0).to_pylist(), binary_column(batch, "text"),
                                             batch.column(2).to_pylist(), binary_column(batch, "item_text")):
                for _, a, b in Index([(item, text)]).matches(plain_words(blob)):
                    for column, value in zip(out, (key, item, a, b)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.string()),
                                              pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64())],
                                             names=["row_key", "item_id", "a", "b"])

    hits = found.mapInArrow(run, "row_key binary, item_id string, a long, b long")
    spans = F.sort_array(F.collect_set(F.struct("a", "b")))
    union = F.aggregate(spans, F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
                        lambda s, x: F.struct((s["n"] + F.greatest(x["b"] - F.greatest(x["a"], s["end"]), F.lit(0))).alias("n"),
                                              F.greatest(x["b"], s["end"]).alias("end")), lambda s: s["n"])
    per = hits.groupBy("row_key").agg(union.alias("n_hit"), F.sort_array(F.collect_set("item_id")).alias("ids"))
    words = _keys(keyed.select("row_key", "text"), "row_key", [], False).select("row_key", "n_words").distinct()
    return (keyed.select("doc_id", "row_key").join(words, "row_key").join(per, "row_key", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("ids", ","), F.lit("")), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated")))
