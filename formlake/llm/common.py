"""Helpers shared by the corpus operators: shared-folder tables, words and hashes, components."""

from __future__ import annotations

import sys
import types
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formlake.session import ensure_checkpoint_dir

SHINGLE_WORDS = 5
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
WORD_CACHE = 200_000  # entries of a task's word-hash memo; it is emptied when full
TOGETHER_BYTES = 1 << 20  # texts up to this size in all are hashed together
LONG_WORD = 64  # bytes; longer words are hashed one by one
_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_MULTIPLIERS = np.random.default_rng(20250101).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


# --- tables in the shared folder -------------------------------------------------------------

def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that ``spark.checkpoint.dir`` names."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors.

    Nothing reads the write's own shuffle files once it is done, so Spark is told to delete them then.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete the files of a table made by ``table`` that nothing reads any more."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(parent)
        path.getFileSystem(conf).delete(path, True)


def hash_share(key: F.Column, wanted: int, total: int) -> F.Column:
    """Whether a row is in the sample of about ``wanted`` of ``total`` rows that 64-bit hashes ``key`` choose."""
    if wanted >= total:
        return F.lit(True)
    return key < F.lit((wanted << 64) // total - (1 << 63))


LARGE_BYTES = 16 << 20  # arrays from this size on are mapped on their own


def _libc():
    import ctypes

    libc = ctypes.CDLL(None)
    return libc if hasattr(libc, "mallopt") and hasattr(libc, "malloc_trim") else None  # glibc only


def of_worker(name: str, key, make):
    """``make()``, which this Python worker keeps from task to task while ``name`` and ``key`` stay; it keeps one such thing only."""
    kept = sys.modules.setdefault("_kept_of_worker", types.ModuleType("_kept_of_worker")).__dict__
    if kept.get("name") != name or kept.get("key") != key:
        kept["value"] = None  # goes before the next one is made
        kept["name"], kept["key"], kept["value"] = name, key, make()
    return kept["value"]


def giving_back(run, keep: bool = False):
    """A task function whose freed memory goes back to the system: large arrays at once, the rest when the task ends.

    Workers live on between tasks, idle ones too, and the allocators keep what arrays leave free. glibc
    raises the size from which it maps arrays on their own as it sees larger ones, up to 32 MB; here it stays.
    Unless ``keep``, what ``of_worker`` kept for an operator that ran before goes as well.
    """
    def call(batches):
        if not keep:
            of_worker("", None, lambda: None)
        libc = _libc()
        if libc is not None:
            libc.mallopt(-3, LARGE_BYTES)  # M_MMAP_THRESHOLD
            libc.mallopt(-1, 4 * LARGE_BYTES)  # M_TRIM_THRESHOLD
        try:
            yield from run(batches)
        finally:
            import gc

            gc.collect()
            pa.default_memory_pool().release_unused()
            if libc is not None:
                libc.malloc_trim(0)

    return call


def binary_column(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A string column as UTF-8 bytes, null as empty."""
    col = batch.column(batch.schema.get_field_index(name))
    return [b or b"" for b in col.cast(pa.binary() if pa.types.is_string(col.type) else pa.large_binary()).to_pylist()]


# --- words and hashes ------------------------------------------------------------------------

def lower_words(blob: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z (bytes methods touch ASCII only)."""
    return blob.lower().split()


class WordHashes(dict):
    """word -> 64-bit hash, memoised within a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _hashed_together(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``lower_words`` of ``texts``, one text after the other, and each text's number of words.

    A word's length, then its bytes, eight at a time, are mixed into its hash.
    """
    raw = b" ".join([b"", *texts, b" " * 16]).lower()
    b = np.frombuffer(raw, np.uint8)
    space = (b == 32) | ((b - np.uint8(9)) < 5)
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    start, size = edge[::2], edge[1::2] - edge[::2]
    eights = np.frombuffer(raw, "<u8", len(raw) // 8)

    def mixed(h, at, left):
        i, shift = at >> 3, ((at & 7) << 3).astype(np.uint64)
        read = (eights[i] >> shift) | ((eights[i + 1] << np.uint64(1)) << (np.uint64(63) - shift))
        return mix64(h ^ (read & _LOW_BYTES[np.minimum(left, 8)]))

    out = mixed(size.astype(np.uint64) * _MULTIPLIERS[0], start, size)
    more, done = np.flatnonzero(size > 8), 8
    while len(more) and done < LONG_WORD:
        out[more] = mixed(out[more], start[more] + done, size[more] - done)
        done += 8
        more = more[size[more] > done]
    for i in more.tolist():
        out[i] = xxhash.xxh3_64_intdigest(raw[start[i]:start[i] + size[i]])
    ends = np.cumsum([len(t) + 1 for t in texts])
    return out, np.diff(np.searchsorted(start, ends), prepend=0)


def text_hashes(texts: list[bytes], end: int):
    """Per text the 64-bit hashes of its ``lower_words``, and ``end`` after them. Not the hashes of ``WordHashes``."""
    sizes = np.cumsum([len(t) for t in texts])
    at = 0
    while at < len(texts):
        # as many as fit, one at least
        stop = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + TOGETHER_BYTES, "right")))
        words, many = _hashed_together(texts[at:stop])
        ends = np.cumsum(many)
        yield from np.split(np.insert(words, ends, np.uint64(end)), ends[:-1] + np.arange(1, len(ends)))
        at = stop


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` consecutive words, from the words' hashes (empty if fewer than k)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n] * _MULTIPLIERS[0]
    for i in range(1, k):
        out = out + h[i:i + n] * _MULTIPLIERS[i]
    return mix64(out + np.uint64(k))


def shingles(h: np.ndarray, k: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes of a text; a text of fewer words is one shingle, of none the empty set."""
    if len(h) == 0:
        return np.zeros(0, np.uint64)
    return np.unique(gram_hashes(h, min(k, len(h))))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values, by doubling."""
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:len(out) - step], out[step:])
        have += step
    return out


# --- connected components --------------------------------------------------------------------

def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b long): rows (id, component), component = smallest id reachable.

    Alternating large-star and small-star steps: each is a minimum per node (combined before
    the shuffle) joined back to the edges, so that a node with very many links is split by AQE
    and never gathered. Only isolated nodes have no row.
    """
    mark = None
    e = state = table(edges.where("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where(
            "u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("a"), "m", "u")
        small = small.select(F.col("a").alias("u"), F.col("m").alias("v")).unionByName(
            small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        new = table(small, "components")
        seen = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_table(state)
        e = state = new
        if not seen[0] or tuple(seen) == mark:
            break
        mark = tuple(seen)
    stars = e.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("id"), "component")
    return stars.unionByName(stars.select(F.col("component").alias("id"), "component").distinct())
