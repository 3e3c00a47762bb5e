"""Streams whose results depend on event order, kept right whatever order the rows arrive in.

A processor holds a key's rows (or sessions) until the watermark has passed them, one state entry
each, so that a row that arrives late still finds its place. What a batch changes is put out at once
and replaces what was put out before: every row carries ``version``, a counter of its key, and ``live``,
false where it no longer holds. The read side takes the latest version; rows behind the watermark
are final, since Spark drops what comes later than that. A timer for the oldest held entry folds all
that the watermark has passed into the key's last known row, so state stays within the watermark's delay.

``transformWithState`` keeps state in RocksDB; ``with_rocksdb`` selects it for the started query.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from formlake.schemas import SUBMISSION_COLUMNS

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"

_TEXTS = [c for c in SUBMISSION_COLUMNS if c != "timestamp"]
_VERSION = ", ".join(["op string", "timestamp long", *[f"{c} string" for c in _TEXTS]])
_FIELDS = ["op", "timestamp", *_TEXTS]
AUDIT_ROW = ", ".join(["audit_id long", "at long", "version long", "live boolean", "timestamp long", *[f"{c} string" for c in _TEXTS]])


def with_rocksdb(spark: SparkSession, start: Callable):
    """Start a query with RocksDB state and leave the session's setting as it was."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        return start()
    finally:
        spark.conf.set(PROVIDER, before)


class AuditProcessor(StatefulProcessor):
    """M3: per qid, the audit rows of every event whose predecessor left the submission present."""

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", f"at long, seq long, {_VERSION}")
        # how often rows came, and the last version that the watermark has passed (nulls if none)
        self.past = handle.getValueState("past", f"calls long, known boolean, {_VERSION}")

    def _rows(self, key, seq: int, before: tuple | None, op: str, version: int, new: bool, at: int):
        live = before is not None and before[0] != "delete"
        if not live and new:
            return
        values = dict(zip(_FIELDS, before)) if live else dict.fromkeys(_FIELDS)
        values["qid"] = key[0]
        del values["op"]
        yield Row(audit_id=2 * seq, at=at, version=version, live=live, **values)
        if op == "delete":
            gone = {**values, "app_status": "DELETED", "user_name": "ADMIN", "answer": None, "comments": None, "action_items": None, "submitter_email": None}
            yield Row(audit_id=2 * seq + 1, at=at, version=version, live=live, **gone)

    def handleInputRows(self, key, rows, timerValues):
        # state is read and written as a whole: a call a row costs far more than the rows themselves
        past = self.past.get() if self.past.exists() else None
        held = {(h[0], h[1]): tuple(h[2:]) for h in self.held.get()} if past else {}
        new = {}
        for row in rows:
            place = (row["at"], row["seq"])
            if place not in held and place not in new:  # a repeated delivery changes nothing
                new[place] = tuple(row[f] for f in _FIELDS)
        if not new:
            return
        self.held.appendList([(*place, *version) for place, version in new.items()])
        held.update(new)
        version = (past[0] if past else 0) + 1
        last = tuple(past[2:]) if past and past[1] else None
        self.past.update((version, last is not None, *(last or (None,) * len(_FIELDS))))
        places = sorted(held)
        self.handle.registerTimer(places[0][0] // 1000 + 1)
        for i, place in enumerate(places):
            # an event is put out if it is new or has a new event right before it
            if place in new or (i and places[i - 1] in new):
                before = held[places[i - 1]] if i else last
                yield from self._rows(key, place[1], before, held[place][0], version, place in new, place[0])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = sorted((tuple(h) for h in self.held.get()), key=lambda h: h[:2])
        done = [h for h in held if h[0] < passed]
        rest = held[len(done):]
        if done:
            self.past.update((self.past.get()[0], True, *done[-1][2:]))
            if rest:
                self.held.put(rest)
            else:
                self.held.clear()
        if rest:
            self.handle.registerTimer(rest[0][0] // 1000 + 1)
        return iter(())


def audit_rows(log: DataFrame, watermark: str) -> DataFrame:
    """Versions of audit rows from a streamed log, in update mode; ``latest_audit`` reads them."""
    rows = log.withWatermark("event_ts", watermark).select(
        "event_ts", "seq", F.unix_micros("event_ts").alias("at"), "op", F.unix_micros("timestamp").alias("timestamp"), *_TEXTS)
    return rows.groupBy("qid").transformWithState(AuditProcessor(), AUDIT_ROW, "update", "eventTime")


def latest_audit(out: DataFrame) -> DataFrame:
    """Read side of ``audit_rows``: the audit rows that hold, with all their columns."""
    cols = [c for c in out.columns if c not in ("audit_id", "version", "_batch")]
    last = out.groupBy("audit_id").agg(F.max_by(F.struct(*cols), "version").alias("l")).select("audit_id", "l.*").where("live")
    return last.select("audit_id", *[F.timestamp_micros(c).alias(c) if c == "timestamp" else F.col(c) for c in SUBMISSION_COLUMNS],
                       F.timestamp_micros("at").alias("audit_timestamp"))


SESSION_ROW = "client string, start long, last long, n long, version long, live boolean"


class SessionProcessor(StatefulProcessor):
    """M7: per client, sessions that a request extends, opens or joins."""

    def __init__(self, gap_seconds: int):
        self.gap = gap_seconds * 1_000_000

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "start long", "last long, n long")
        self.calls = handle.getValueState("calls", "n long")

    def handleInputRows(self, key, rows, timerValues):
        old = {start[0]: tuple(s) for start, s in self.open.iterator()}
        parts = sorted([(start, *s) for start, s in old.items()] + [(row["at"], row["at"], row["n"]) for row in rows])
        now: dict[int, tuple[int, int]] = {}
        start = None
        for at, last, n in parts:
            if start is not None and at <= now[start][0] + self.gap:  # as session_window, which joins what touches
                now[start] = max(now[start][0], last), now[start][1] + n
            else:
                start, now[at] = at, (last, n)
        version = (self.calls.get()[0] if self.calls.exists() else 0) + 1
        self.calls.update((version,))
        for at in old:
            if at not in now:
                self.open.removeKey((at,))
                yield Row(client=key[0], start=at, last=at, n=0, version=version, live=False)
        for at, session in now.items():
            if old.get(at) != session:
                self.open.updateValue((at,), session)
                yield Row(client=key[0], start=at, last=session[0], n=session[1], version=version, live=True)
        self._wait()

    def _wait(self) -> None:
        ends = [s[0] for _, s in self.open.iterator()]
        if ends:
            self.handle.registerTimer((min(ends) + self.gap) // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        for start in [start[0] for start, s in self.open.iterator() if s[0] + self.gap < passed]:
            self.open.removeKey((start,))
        self._wait()
        return iter(())


def session_rows(requests: DataFrame, client: str, gap_seconds: int, watermark: str) -> DataFrame:
    """Versions of sessions from streamed requests, in update mode; ``latest_sessions`` reads them."""
    rows = requests.withWatermark("ts", watermark).select(F.col(client).alias("client"), "ts", F.unix_micros("ts").alias("at"), F.lit(1).cast("long").alias("n"))
    return rows.groupBy("client").transformWithState(SessionProcessor(gap_seconds), SESSION_ROW, "update", "eventTime")


def latest_sessions(out: DataFrame, gap_seconds: int) -> DataFrame:
    """Read side of ``session_rows``: ``(client, session_start, session_end, n_requests)`` of the sessions that hold."""
    last = out.groupBy("client", "start").agg(F.max_by(F.struct("last", "n", "live"), "version").alias("l")).where("l.live")
    return last.select("client", F.timestamp_micros("start").alias("session_start"),
                       F.timestamp_micros(F.col("l.last") + F.lit(gap_seconds * 1_000_000)).alias("session_end"), F.col("l.n").alias("n_requests"))
