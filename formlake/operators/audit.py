"""Audit history and revisions, derived from the submission log with window functions.

The reference keeps an Audit table filled by triggers: every update or delete copies the
OLD row (delete adds a ``DELETED`` tombstone), inserts are not recorded. Here the log holds
every version, so the audit table is a view: each version that is followed by another event
becomes an audit row stamped with the time of that next event.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formlake.operators.windows import time_bucket, with_next, with_previous, with_row_number
from formlake.schemas import SUBMISSION_COLUMNS

# Allowed status transitions (from, to); None = new submission. Fixed values of the lifecycle.
TRANSITIONS = [
    (None, "Draft"), (None, "Submitted"),
    ("Draft", "Draft"), ("Draft", "Submitted"),
    ("Submitted", "Submitted"), ("Submitted", "In Review"),
    ("In Review", "Submitted"), ("In Review", "Approved"),
    ("Approved", "In Review"),
]
REVIEWER_ONLY = [("Submitted", "In Review"), ("In Review", "Approved"), ("Approved", "In Review")]

_ORDER = ["event_ts", "seq"]


def _with_previous(log: DataFrame) -> DataFrame:
    """Attach the previous event of the same qid (``_prev`` struct) in log order.

    Skew-safe: a busy qid is split into daily buckets (``windows.with_previous``).
    """
    return with_previous(log, ["qid"], _ORDER, log.columns, time_bucket("event_ts"))


def audit_log(log: DataFrame) -> DataFrame:
    """H1: AUDIT rows ``(audit_id, <submission columns>, audit_timestamp)``.

    An event whose predecessor left the qid present (any non-delete op) moves that
    predecessor into the audit table; a delete also writes the tombstone. ``audit_id`` is
    ``2*seq`` (+1 for the tombstone): unique and in change order without a global sort.
    """
    p = _with_previous(log).where(F.col("_prev").isNotNull() & (F.col("_prev.op") != "delete"))
    old = F.struct(*[F.col("_prev")[c].alias(c) for c in SUBMISSION_COLUMNS],
                   (F.col("seq") * 2).alias("audit_id"), F.col("event_ts").alias("audit_timestamp"))
    tomb_vals = {c: F.col("_prev")[c] for c in SUBMISSION_COLUMNS}
    tomb_vals.update({"app_status": F.lit("DELETED"), "user_name": F.lit("ADMIN"),
                      "answer": F.lit(None).cast("string"), "comments": F.lit(None).cast("string"),
                      "action_items": F.lit(None).cast("string"), "submitter_email": F.lit(None).cast("string")})
    tomb = F.struct(*[tomb_vals[c].alias(c) for c in SUBMISSION_COLUMNS],
                    (F.col("seq") * 2 + 1).alias("audit_id"), F.col("event_ts").alias("audit_timestamp"))
    rows = F.when(F.col("op") == "delete", F.array(old, tomb)).otherwise(F.array(old))
    out = p.select(F.inline(rows))
    return out.select("audit_id", *SUBMISSION_COLUMNS, "audit_timestamp")


def revisions(audit: DataFrame, current: DataFrame) -> DataFrame:
    """Audit rows keyed ``qid-audit_id`` UNION ALL current rows keyed by qid."""
    cols = ["app_status", "app_tid", "app_pid", "app_name", "app_champion", "app_team_email",
            "user_name", "timestamp", "submitter_email", "action_items"]
    a = audit.select(F.col("qid").alias("owner_qid"),
                     F.concat_ws("-", "qid", F.col("audit_id").cast("string")).alias("revision_id"), *cols)
    c = current.select(F.col("qid").alias("owner_qid"), F.col("qid").alias("revision_id"), *cols)
    return a.unionByName(c)


def newest_first(revs: DataFrame) -> DataFrame:
    """H4: revisions with ``position`` 1 for a submission's newest (by timestamp, ties by revision id), nulls last.

    A submission's revisions are numbered by day, so one with a third of all revisions is split.
    """
    back = F.coalesce(-F.unix_micros(F.col("timestamp").cast("timestamp")), F.lit(2**63 - 1))
    numbered = with_row_number(revs.withColumn("_back", back), ["owner_qid"], ["_back", "revision_id"],
                               F.floor(F.col("_back") / F.lit(86_400_000_000)), "position")
    return numbered.drop("_back")


def latest_saved(audit: DataFrame, current: DataFrame) -> DataFrame:
    """H3: per qid the newest audit version (by audit_timestamp, audit_id), else the current row."""
    newest = (audit.groupBy("qid")
              .agg(F.max_by(F.struct("answer", "audit_id", "app_status"),
                            F.struct("audit_timestamp", "audit_id")).alias("_a")))
    j = newest.join(current.select("qid", F.col("answer").alias("_cur")), "qid", "full_outer")
    return j.select("qid",
                    F.when(F.col("_a").isNotNull(), F.col("_a.answer")).otherwise(F.col("_cur")).alias("answer"),
                    F.when(F.col("_a").isNotNull(), F.lit("audit")).otherwise(F.lit("current")).alias("source"),
                    F.col("_a.audit_id").alias("audit_id"))


def version_intervals(log: DataFrame) -> DataFrame:
    """Each saved version with ``valid_from`` and ``valid_to`` (next event of the qid, or null)."""
    return (with_next(log, ["qid"], _ORDER, "event_ts", time_bucket("event_ts"), "valid_to")
            .where(F.col("op") != "delete")
            .withColumn("valid_from", F.col("event_ts")))


def revision_as_of(log: DataFrame, at) -> DataFrame:
    """H6: the version of every qid valid at time ``at``.

    No window is needed: the valid version is the latest event at or before ``at`` (partial
    ``max_by`` per qid over a filter that reaches the Parquet scan), and it stays valid until
    the qid's first event after ``at`` (``min`` per qid). A delete as latest event means none.
    """
    t = F.lit(at).cast(log.schema["event_ts"].dataType)
    cols = [c for c in log.columns if c != "qid"]
    upto = (log.where(F.col("event_ts") <= t).groupBy("qid")
            .agg(F.max_by(F.struct(*cols), F.struct("event_ts", "seq")).alias("_v")).select("qid", "_v.*"))
    after = log.where(F.col("event_ts") > t).groupBy("qid").agg(F.min("event_ts").alias("valid_to"))
    return (upto.join(after, "qid", "left").where(F.col("op") != "delete")
            .withColumn("valid_from", F.col("event_ts")))


def status_durations(log: DataFrame) -> DataFrame:
    """H7: time spent per (qid, status), in microseconds, summed over closed intervals."""
    v = version_intervals(log).where(F.col("valid_to").isNotNull())
    dur = F.unix_micros(F.col("valid_to").cast("timestamp")) - F.unix_micros(F.col("valid_from").cast("timestamp"))
    return (v.groupBy("qid", "app_status")
            .agg(F.sum(dur).alias("duration_us"), F.count("*").alias("n_versions")))


def transition_violations(log: DataFrame, reviewers: DataFrame | None = None) -> DataFrame:
    """Status changes that the lifecycle does not allow.

    ``reviewers(user_name)`` lists who may review/approve; without it only the transition
    table is checked. Returns ``(qid, seq, from_status, to_status, reason)``.
    """
    spark = log.sparkSession
    allowed = spark.createDataFrame([(f, t) for f, t in TRANSITIONS], "from_status string, to_status string")
    p = _with_previous(log).where(F.col("op") != "delete")
    prev_status = F.when(F.col("_prev").isNotNull() & (F.col("_prev.op") != "delete"), F.col("_prev.app_status"))
    t = p.select("qid", "seq", "user_name", prev_status.alias("from_status"), F.col("app_status").alias("to_status"))
    ok = (F.col("a.from_status").eqNullSafe(F.col("t.from_status"))) & (F.col("a.to_status") == F.col("t.to_status"))
    bad = t.alias("t").join(F.broadcast(allowed.alias("a")), ok, "left_anti")
    out = bad.select("qid", "seq", "from_status", "to_status", F.lit("transition not allowed").alias("reason"))
    if reviewers is not None:
        rev = spark.createDataFrame(REVIEWER_ONLY, "from_status string, to_status string")
        need = t.alias("t").join(F.broadcast(rev.alias("a")), ok, "left_semi")
        unauth = (need.join(reviewers.select("user_name").distinct(), "user_name", "left_anti")
                  .select("qid", "seq", "from_status", "to_status", F.lit("reviewer required").alias("reason")))
        out = out.unionByName(unauth)
    return out


def audit_is_append_only(previous: DataFrame, current: DataFrame) -> DataFrame:
    """H2: rows of an earlier audit snapshot missing from (or changed in) the newer one."""
    return previous.exceptAll(current)
