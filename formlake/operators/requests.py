"""Request logs, sessions, rate limits, size guards, error digests and review notices.

These re-aim the reference's server-side limits (per-client rate limits, session lifetime,
per-path body limits, error-mail buffer, review notification mails) as batch jobs over
request/log tables. ``formlake.streaming`` runs the same logic on streams.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formlake.functions.text import project_summary, valid_username
from formlake.operators.windows import with_row_number
from formlake.session import cut_lineage

# ---------------------------------------------------------------------------
# Fixed values of the reference's production configuration.
# ---------------------------------------------------------------------------
RATE_LIMITS = {"day": 200, "hour": 50}
SESSION_LIFETIME_SECONDS = 300
PERMISSIBLE_CONTENT_LENGTHS = {"/submit": 1024 * 1024, "/savedraft": 1024 * 1024, "/diff": 256, "/loadone": 256,
                               "/status": 256, "/submissions": 256, "/logout": 256, "/login": 256}
DEFAULT_CONTENT_LENGTH = 256
PERMISSIBLE_CONTENT_TYPE = "application/x-www-form-urlencoded"
ERROR_DIGEST_CAPACITY = 10
AUTOSAVE_INTERVAL = "2 seconds"
MAIL_SUBJECT = "QID: %s : Security Architecture Review for project: %s"
NOTICE_KIND = {"Draft": "MAIL_BODY_DRAFT", "Submitted": "MAIL_BODY_SUBMITTED",
               "In Review": "MAIL_BODY_IN_REVIEW", "Approved": "MAIL_BODY_APPROVED"}


# ---------------------------------------------------------------------------
# M6: rate limits
# ---------------------------------------------------------------------------
def rate_limit_violations(requests: DataFrame, limits: dict[str, int] | None = None,
                          client: str = "client") -> DataFrame:
    """Requests beyond a client's per-hour or per-day budget (fixed UTC windows; every request counts).

    The rank is taken per (client, window), so one busy client is spread over its windows.
    Returns ``(client, seq, ts, rank_hour, rank_day)`` for rejected requests.
    """
    lim = limits or RATE_LIMITS
    out = requests
    # rank inside the window; a busy client's window is split further (hours of a day, minutes of an hour)
    for unit, finer in (("hour", "minute"), ("day", "hour")):
        out = (with_row_number(out.withColumn("_w", F.date_trunc(unit, "ts")), [client, "_w"], ["ts", "seq"],
                               F.date_trunc(finer, "ts"), f"rank_{unit}")
               .withColumn(f"rank_{unit}", F.col(f"rank_{unit}").cast("long")).drop("_w"))
    return (out.where((F.col("rank_hour") > lim["hour"]) | (F.col("rank_day") > lim["day"]))
            .select(client, "seq", "ts", "rank_hour", "rank_day"))


# ---------------------------------------------------------------------------
# M7: sessions
# ---------------------------------------------------------------------------
def user_sessions(requests: DataFrame, client: str = "client",
                  gap_seconds: int = SESSION_LIFETIME_SECONDS) -> DataFrame:
    """A session lasts ``gap_seconds`` after the client's last request (refreshed by each request)."""
    sw = F.session_window("ts", f"{gap_seconds} seconds")
    return (requests.groupBy(client, sw.alias("s"))
            .agg(F.count("*").alias("n_requests"))
            .select(client, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"),
                    "n_requests"))


# ---------------------------------------------------------------------------
# Oversized bodies
# ---------------------------------------------------------------------------
def path_limits(spark) -> DataFrame:
    return spark.createDataFrame(list(PERMISSIBLE_CONTENT_LENGTHS.items()), "path string, max_length long")


def oversized_requests(requests: DataFrame) -> DataFrame:
    """Form posts whose body exceeds the path's limit (256 bytes unless configured)."""
    lim = F.broadcast(path_limits(requests.sparkSession))  # fixed table of 8 rows
    j = requests.join(lim, "path", "left")
    limit = F.coalesce(F.col("max_length"), F.lit(DEFAULT_CONTENT_LENGTH))
    return (j.where((F.col("content_length") > limit)
                    & F.coalesce(F.col("content_type").contains(PERMISSIBLE_CONTENT_TYPE), F.lit(False)))
            .select("ts", "client", "path", "content_length", limit.alias("max_length")))


# ---------------------------------------------------------------------------
# users
# ---------------------------------------------------------------------------
def invalid_usernames(users: DataFrame, col: str = "user_name") -> DataFrame:
    return users.where(~valid_username(col))


def reviewer_flags(directory: DataFrame, group: str, extra_accounts: list[str]) -> DataFrame:
    """May a user approve: member of the reviewer group, or listed explicitly."""
    ok = F.array_contains(F.coalesce("memberOf", F.array().cast("array<string>")), group) | \
        F.col("account").isin(*[a for a in extra_accounts if a])
    return directory.select("account", "mail", ok.alias("is_reviewer"))


# ---------------------------------------------------------------------------
# Distributed dense rank (no single-partition window)
# ---------------------------------------------------------------------------
def global_rank(df: DataFrame, order: list[str], partitions: int | None = None) -> DataFrame:
    """0-based rank of every row in ``order`` across the whole table.

    Range-partition and sort, checkpoint (so that counting and numbering see the same
    partitions), count rows per partition, and add the prefix sum of the earlier partitions
    to the position inside the partition. Only the per-partition counts (one row per
    partition) are brought together.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    ranged = ranged.withColumn("_pid", F.spark_partition_id()).withColumn("_mid", F.monotonically_increasing_id())
    ranged = cut_lineage(ranged)
    counts = ranged.groupBy("_pid").agg(F.count("*").alias("_n"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0))).select("_pid", "_off")
    local = F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33)
    return (ranged.join(F.broadcast(offsets), "_pid")  # one row per partition
            .withColumn("rank", F.col("_off") + local).drop("_pid", "_mid", "_off"))


# ---------------------------------------------------------------------------
# M5: error digests
# ---------------------------------------------------------------------------
def error_digests(logs: DataFrame, capacity: int = ERROR_DIGEST_CAPACITY, source: str | None = None) -> DataFrame:
    """Every ``capacity`` buffered records (ERROR and CRITICAL) make one digest; the body keeps
    only the ERROR records. An incomplete last buffer is not sent.

    Without ``source`` all records share one buffer (one server process) and are numbered with
    the distributed ``global_rank``. With ``source`` (e.g. the process or host column) every
    source has its own buffer, numbered with a bucketed per-source row number, so a busy
    source is split by hour. Returns ``([source,] digest_id, first_seq, last_seq, n_records,
    n_errors, body)``.
    """
    buffered = logs.where(F.col("level").isin("ERROR", "CRITICAL"))
    if source is None:
        keys = []
        ranked = global_rank(buffered, ["ts", "seq"])
    else:
        keys = [source]
        ranked = with_row_number(buffered, [source], ["ts", "seq"], F.date_trunc("hour", "ts"), "rank") \
            .withColumn("rank", F.col("rank") - 1)
    ranked = ranked.withColumn("digest_id", F.floor(F.col("rank") / capacity))
    line = F.when(F.col("level") == "ERROR", F.struct("rank", "message"))
    g = (ranked.groupBy(*keys, "digest_id")  # groups hold at most ``capacity`` rows
         .agg(F.count("*").alias("n_records"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"),
              F.count(line).alias("n_errors"), F.collect_list(line).alias("_lines")))
    body = F.array_join(F.transform(F.array_sort("_lines"), lambda x: x["message"]), "\r\n")
    return (g.where(F.col("n_records") == capacity)
            .select(*keys, F.col("digest_id").cast("long").alias("digest_id"), "first_seq", "last_seq",
                    "n_records", "n_errors", body.alias("body")))


# ---------------------------------------------------------------------------
# M2: autosave batches
# ---------------------------------------------------------------------------
def autosave_batches(changes: DataFrame, interval: str = AUTOSAVE_INTERVAL) -> DataFrame:
    """Pending changes flushed every ``interval``: the last value per key in each window wins."""
    w = F.window("ts", interval)
    return (changes.groupBy("qid", w.alias("w"), "key")
            .agg(F.max_by(F.struct("value", "seq"), F.struct("ts", "seq")).alias("_l"))
            .select("qid", F.col("w.start").alias("batch_start"), "key", F.col("_l.value").alias("value"),
                    F.col("_l.seq").alias("seq")))


# ---------------------------------------------------------------------------
# Review notices
# ---------------------------------------------------------------------------
def review_notices(log: DataFrame) -> DataFrame:
    """One notice per save-draft, submit, review and approval: subject and body template."""
    kinds = F.create_map(*[x for k, v in NOTICE_KIND.items() for x in (F.lit(k), F.lit(v))])
    saved = log.where((F.col("op") != "delete") & F.col("app_status").isin(*NOTICE_KIND.keys()))
    return saved.select("qid", "seq", "app_status",
                        F.format_string(MAIL_SUBJECT, F.col("qid"), F.col("app_name")).alias("subject"),
                        kinds[F.col("app_status")].alias("body_template"))


# Texts of the mails, configuration: {} stands for host, qid, qid, project summary and the user's name.
NOTICE_BODIES = {
    "MAIL_BODY_DRAFT": 'Your answers to questionnaire <a href="{}{}">{}</a> are saved as a draft. {}{}',
    "MAIL_BODY_SUBMITTED": 'Questionnaire <a href="{}{}">{}</a> waits for a review.<br />{}<br />Regards, {}',
    "MAIL_BODY_IN_REVIEW": 'Questionnaire <a href="{}{}">{}</a> is being reviewed. {}{}',
    "MAIL_BODY_APPROVED": 'Questionnaire <a href="{}{}">{}</a> is approved. {}{}',
}
PLACES = 5


def notice_bodies(notices: DataFrame, host: str, summary: Column, user: Column,
                  bodies: dict[str, str] = NOTICE_BODIES) -> DataFrame:
    """``body`` of each notice, the text of its ``body_template`` with its places filled in order.

    A text with more places than values, or of an unknown name, gives an empty body; a null value is
    empty. The places are filled by splitting the text, so values that hold ``{}`` are left as they are.
    """
    texts = F.create_map(*[x for k, v in bodies.items() for x in (F.lit(k), F.lit(v))])
    parts = F.split(texts[F.col("body_template")], r"\{\}")
    values = F.array(F.lit(host), F.col("qid"), F.col("qid"), F.coalesce(summary, F.lit("")), F.coalesce(user, F.lit("")))
    filled = F.array_join(F.transform(parts, lambda part, i: F.concat(F.when(i > 0, F.get(values, i - 1)).otherwise(F.lit("")), part)), "")
    return notices.withColumn("body", F.when(F.size(parts) <= PLACES + 1, filled).otherwise(F.lit("")))


def review_mails(log: DataFrame, reviewers: list[str], host: str = "", bodies: dict[str, str] = NOTICE_BODIES) -> DataFrame:
    """A mail per notice of ``review_notices``: subject, body and recipients.

    The project summary comes from the version's own answers; the submitter is the saving user.
    """
    summary = project_summary(F.from_json("answer", "map<string,string>"))
    saved = log.select("qid", "seq", "user_name", summary.alias("_summary"))
    mails = review_notices(log).join(saved, ["qid", "seq"])
    mails = notice_bodies(mails, host, F.when(F.col("app_status") == "Submitted", F.col("_summary")),
                          F.when(F.col("app_status") == "Submitted", F.col("user_name")), bodies)
    return notice_recipients(mails, reviewers, F.col("user_name")).drop("_summary", "user_name", "body_template")


def notice_recipients(notices: DataFrame, reviewers: list[str], submitter: Column) -> DataFrame:
    """Reviewers plus the submitter of each notice."""
    return notices.withColumn("recipients", F.array_union(F.array(*[F.lit(r) for r in reviewers]),
                                                          F.array(submitter)))
