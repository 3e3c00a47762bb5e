"""Audit and session streams over shuffled files equal their batch twins."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from formlake.operators import audit, requests
from formlake.schemas import EVENT_LOG
from formlake.streaming import ordered, streams

START = dt.datetime(2024, 1, 1)


def _files(spark, rows, schema, folder, n=6, seed=1):
    """Rows dealt at random over ``n`` files, some delivered twice."""
    rng = random.Random(seed)
    dealt = [[] for _ in range(n)]
    for r in rows:
        dealt[rng.randrange(n)].append(r)
    for k, part in enumerate(dealt):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(folder))
    return str(folder)


def _log(n=400, seed=2):
    """Events of a few submissions, one with a third of all; many in the same second."""
    rng, rows = random.Random(seed), []
    for seq in range(n):
        qid = "hot" if rng.random() < 0.34 else f"q{rng.randrange(25)}"
        ts = START + dt.timedelta(seconds=rng.randrange(n // 2), microseconds=rng.choice([0, 500_000]))
        op = "delete" if rng.random() < 0.2 else "save"
        rows.append((qid, rng.choice(["Draft", "Submitted", None]), "t", "", f"app{seq % 3}", None, "m@x", f"u{seq}", ts, f'{{"a": "{seq}"}}',
                     None, "", None, seq, op, ts))
    return rows


def test_audit_stream_over_shuffled_files(spark, tmp_path):
    rows = _log()
    want = audit.audit_log(spark.createDataFrame(rows, EVENT_LOG))
    folder = _files(spark, rows, EVENT_LOG, tmp_path / "log")
    _files(spark, rows[::9], EVENT_LOG, tmp_path / "log", n=1)  # delivered again
    log = streams.read_stream(spark, folder, max_files=1)
    got = streams.run_to_table(spark, "audit", lambda base: streams.audit_stream(log, base, "1 hour"), ordered.latest_audit)
    assert got.columns == want.columns and want.count() > 100
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_audit_state_is_released_behind_the_watermark(spark, tmp_path):
    """Files in order of time, a delay far shorter than the whole: predecessors come from the released last version."""
    rows = sorted(_log(seed=5), key=lambda r: (r[15], r[13]))
    rows = [(*r[:8], START + 60 * (r[8] - START), *r[9:15], START + 60 * (r[15] - START)) for r in rows]
    want = audit.audit_log(spark.createDataFrame(rows, EVENT_LOG))
    folder = tmp_path / "log"
    for k in range(0, len(rows), 80):
        part = rows[k:k + 80]
        random.Random(k).shuffle(part)
        spark.createDataFrame(part, EVENT_LOG).coalesce(1).write.mode("append").parquet(str(folder))
    log = streams.read_stream(spark, str(folder), max_files=1)
    got = streams.run_to_table(spark, "audit", lambda base: streams.audit_stream(log, base, "1 minute"), ordered.latest_audit)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("spread", [300, 4000])
def test_sessions_stream_over_shuffled_files(spark, tmp_path, spread):
    rng = random.Random(spread)
    rows = [(START + dt.timedelta(seconds=rng.randrange(spread * 10)), "hot" if rng.random() < 0.34 else f"c{rng.randrange(12)}") for _ in range(500)]
    rows += [(START + dt.timedelta(seconds=300 * k), "exact") for k in range(5)]  # exactly a lifetime apart
    schema = "ts timestamp, client string"
    want = requests.user_sessions(spark.createDataFrame(rows, schema))
    req = streams.read_stream(spark, _files(spark, rows, schema, tmp_path / "req", seed=3), max_files=1)
    got = streams.run_to_table(spark, "sessions", lambda base: streams.sessions_stream(req, base, watermark="1 day"),
                               lambda out: ordered.latest_sessions(out, requests.SESSION_LIFETIME_SECONDS))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
