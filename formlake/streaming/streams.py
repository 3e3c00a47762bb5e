"""Structured Streaming twins of the event-driven operators.

Each ``*_stream`` function takes a streaming DataFrame and returns a started
``StreamingQuery`` writing to a sink folder; ``run_to_table`` drives a query over all
available input (``availableNow``) and reads its sink back as a batch DataFrame. Sinks and
checkpoints live under the session's reliable checkpoint folder, so a restarted query
resumes from its offsets and state after executor or driver loss.

* M1/M9 answers: change events, radio picks made exclusive by a stream-static join with the
  template, latest value per (qid, key) kept in state (update mode, ``foreachBatch`` append).
* M2 autosave: 2-second tumbling windows per (qid, key) with a watermark (update mode).
* M3 audit: ``ordered.AuditProcessor`` keyed by qid holds events to the watermark and puts out the
  audit rows of every later update/delete (the triggers' behaviour), replaced when an event arrives late.
* M4 notices: stateless, one notice per saved version.
* M5 error digests: ``applyInPandasWithState`` keyed by the logging source; the state is the
  digest counter and at most ``capacity - 1`` waiting records.
* M6 rate limits: per-client hour/day window counts above the limit (update mode).
* M7 sessions: ``ordered.SessionProcessor`` extends, opens and joins sessions per client.
* M8 oversized bodies: stateless filter after a broadcast join with the path limits.

Update-mode results are appended per micro-batch with the batch id and compacted on read
(latest batch per key), so windows still open when the input ends are reported as well.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from formlake.operators import requests as rq
from formlake.operators import store
from formlake.streaming import ordered
from formlake.session import ensure_checkpoint_dir

WATERMARK = "10 minutes"


def stream_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for one stream's sink and checkpoint under the reliable checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _is_folder(spark: SparkSession, path: str) -> bool:
    fs, p = _file_system(spark, path)
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def read_stream(spark: SparkSession, directory: str, glob: str = "*.parquet",
                max_files: int | None = None) -> DataFrame:
    """Stream the parquet files of ``directory`` matching ``glob`` (schema from the files).

    Event-time columns stored without time zone are read as UTC timestamps, which is what
    watermarks require.
    """
    table = f"{directory}/{glob}"
    if "*" not in glob and _is_folder(spark, table):  # a table of part files is read as it is
        directory, glob = table, "*.parquet"
    schema = spark.read.option("pathGlobFilter", glob).parquet(directory).schema
    r = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    df = r.parquet(directory)
    ntz = [f.name for f in schema.fields if f.dataType.typeName() == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in ntz}) if ntz else df


def to_ntz(df: DataFrame) -> DataFrame:
    """Back to time-zone-free timestamps (as stored in the source tables)."""
    ts = [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp"]
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ts}) if ts else df


def _append(df: DataFrame, base: str, mode: str = "append") -> StreamingQuery:
    return (df.writeStream.outputMode(mode).format("parquet").option("path", f"{base}/out")
            .option("checkpointLocation", f"{base}/chk").trigger(availableNow=True).start())


def _batches(df: DataFrame, base: str, mode: str = "update") -> StreamingQuery:
    """Update/complete-mode results appended per micro-batch with their batch id."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("_batch", F.lit(batch_id)).write.mode("append").parquet(f"{base}/out")

    return (df.writeStream.outputMode(mode).foreachBatch(write)
            .option("checkpointLocation", f"{base}/chk").trigger(availableNow=True).start())


def run_to_table(spark: SparkSession, name: str, start: Callable[[str], StreamingQuery],
                 read: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Start a stream with ``start(base)``, process everything available, return its sink as a batch DataFrame."""
    base = stream_dir(spark, name)
    q = start(base)
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    fs, p = _file_system(spark, f"{base}/out")
    if not fs.exists(p):  # no batch ran: nothing was written
        return None
    out = spark.read.parquet(f"{base}/out")
    return read(out) if read else out


# ---------------------------------------------------------------------------
# M1 / M9
# ---------------------------------------------------------------------------
def answers_stream(changes: DataFrame, items: DataFrame, base: str) -> StreamingQuery:
    """Latest value per (qid, key); radio picks expanded by a stream-static broadcast join."""
    exclusive = store.radio_exclusive(changes, items)
    latest = (exclusive.groupBy("qid", "key")
              .agg(F.max_by(F.struct("value", "ts", "seq"), F.struct("ts", "seq")).alias("_l"))
              .select("qid", "key", "_l.value", "_l.ts", "_l.seq"))
    return _batches(latest, base, "update")


def compact_latest(out: DataFrame) -> DataFrame:
    """Read side of ``answers_stream``: last emitted value per (qid, key)."""
    return store.latest_values(out.drop("_batch"))


def compact(keys: list[str]) -> Callable[[DataFrame], DataFrame]:
    """Read side of update-mode sinks: the row of the latest micro-batch per key."""
    def read(out: DataFrame) -> DataFrame:
        cols = [c for c in out.columns if c not in keys and c != "_batch"]
        return (out.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.col("_batch")).alias("_l"))
                .select(*keys, "_l.*"))
    return read


# ---------------------------------------------------------------------------
# M2
# ---------------------------------------------------------------------------
def autosave_stream(changes: DataFrame, base: str, interval: str = rq.AUTOSAVE_INTERVAL) -> StreamingQuery:
    w = F.window("ts", interval)
    out = (changes.withWatermark("ts", WATERMARK)
           .groupBy("qid", w.alias("w"), "key")
           .agg(F.max_by(F.struct("value", "seq"), F.struct("ts", "seq")).alias("_l"))
           .select("qid", F.col("w.start").alias("batch_start"), "key", F.col("_l.value").alias("value"),
                   F.col("_l.seq").alias("seq")))
    return _batches(out, base, "update")


# ---------------------------------------------------------------------------
# M3
# ---------------------------------------------------------------------------
def audit_stream(log: DataFrame, base: str, watermark: str = WATERMARK) -> StreamingQuery:
    """Audit rows as the log streams in, in whatever order within the watermark; read with ``ordered.latest_audit``."""
    return ordered.with_rocksdb(log.sparkSession, lambda: _batches(ordered.audit_rows(log, watermark), base, "update"))


# ---------------------------------------------------------------------------
# M6 / M7 / M8
# ---------------------------------------------------------------------------
def rate_limit_stream(requests: DataFrame, base: str, unit: str = "day", client: str = "client",
                      limits: dict[str, int] | None = None) -> StreamingQuery:
    """Windows in which a client went over its budget: ``(client, window_start, n_requests, rejected)``."""
    lim = (limits or rq.RATE_LIMITS)[unit]
    out = (requests.withWatermark("ts", WATERMARK)
           .groupBy(client, F.window("ts", f"1 {unit}").alias("w"))
           .agg(F.count("*").alias("n_requests"))
           .where(F.col("n_requests") > lim)
           .select(client, F.col("w.start").alias("window_start"), "n_requests",
                   (F.col("n_requests") - lim).alias("rejected")))
    return _batches(out, base, "update")


def sessions_stream(requests: DataFrame, base: str, client: str = "client",
                    gap_seconds: int = rq.SESSION_LIFETIME_SECONDS, watermark: str = WATERMARK) -> StreamingQuery:
    """Sessions per client, open ones included, in whatever order requests arrive within the watermark;
    read with ``ordered.latest_sessions``."""
    rows = ordered.session_rows(requests, client, gap_seconds, watermark)
    return ordered.with_rocksdb(requests.sparkSession, lambda: _batches(rows, base, "update"))


DIGEST_OUT = StructType([StructField("source", StringType()), StructField("digest_id", LongType()),
                         StructField("first_seq", LongType()), StructField("last_seq", LongType()),
                         StructField("n_records", LongType()), StructField("n_errors", LongType()),
                         StructField("body", StringType())])
DIGEST_STATE = StructType([StructField("next_id", LongType()), StructField("ts_us", ArrayType(LongType())),
                           StructField("seq", ArrayType(LongType())), StructField("level", ArrayType(StringType())),
                           StructField("message", ArrayType(StringType()))])


def _digest_group(capacity: int):
    cols = ["ts", "seq", "level", "message"]

    def fn(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        next_id, ts_us, seqs, levels, msgs = state.get if state.exists else (0, [], [], [], [])
        parts = [p[cols] for p in pdfs]
        if ts_us:
            parts.insert(0, pd.DataFrame({"ts": pd.to_datetime(list(ts_us), unit="us"), "seq": list(seqs),
                                          "level": list(levels), "message": list(msgs)}))
        buf = pd.concat(parts, ignore_index=True).sort_values(["ts", "seq"]).reset_index(drop=True)
        full = (len(buf) // capacity) * capacity
        out = []
        for start in range(0, full, capacity):
            chunk = buf.iloc[start:start + capacity]
            errors = chunk[chunk["level"] == "ERROR"]
            out.append((key[0], next_id, int(chunk["seq"].min()), int(chunk["seq"].max()), capacity,
                        len(errors), "\r\n".join(errors["message"])))
            next_id += 1
        rest = buf.iloc[full:]  # fewer than ``capacity`` records wait for the next batch
        state.update((next_id, [int(t.value // 1000) for t in rest["ts"]], [int(s) for s in rest["seq"]],
                      list(rest["level"]), list(rest["message"])))
        yield pd.DataFrame(out, columns=[f.name for f in DIGEST_OUT.fields])

    return fn


def error_digest_stream(logs: DataFrame, base: str, source: str = "source",
                        capacity: int = rq.ERROR_DIGEST_CAPACITY) -> StreamingQuery:
    """M5: every ``capacity`` ERROR/CRITICAL records of a source make a digest. The state per
    source is the digest counter and at most ``capacity - 1`` waiting records."""
    buffered = (logs.where(F.col("level").isin("ERROR", "CRITICAL"))
                .select(F.col(source).alias("source"), "ts", "seq", "level", "message"))
    out = buffered.groupBy("source").applyInPandasWithState(
        _digest_group(capacity), DIGEST_OUT, DIGEST_STATE, "append", GroupStateTimeout.NoTimeout)
    return _append(out, base)


def notices_stream(log: DataFrame, base: str) -> StreamingQuery:
    """M4: a notice row per saved version as the log streams in (stateless)."""
    return _append(rq.review_notices(log), base)


def oversized_stream(requests: DataFrame, base: str) -> StreamingQuery:
    return _append(rq.oversized_requests(requests), base)
