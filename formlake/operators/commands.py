"""Reviewer commands as events of the log.

A status or delete command is folded into the submission log: it finds the version that is valid at its
time, writes one more version of it (or ends it), and everything derived from the log, the current row,
audit rows, durations, sees it like any other event. Commands on a submission that is not there at that
time go to a second output instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formlake.functions.text import sanitize
from formlake.operators.windows import carry_forward, time_bucket, with_previous
from formlake.schemas import EVENT_LOG, SUBMISSION_COLUMNS

STATUS = {"a": "Approved", "r": "In Review"}  # fixed values: any other flag means In Review
NOT_FOUND = 500
_ORDER = ["event_ts", "seq"]


def apply_commands(log: DataFrame, commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(log, rejected)``: the log with the accepted commands in it, and the commands that found nothing.

    ``commands`` are ``(qid, command, status, user, event_ts, seq)`` with the command ``status`` or ``delete``;
    ``seq`` is of the log's own sequence. An accepted status command becomes an event of op ``status``:
    the last saved version with the new status, user and time, in its columns and its answers; commands on
    commands build on the same saved version. ``rejected`` has the command and ``error`` 500.

    The saved version and whether it still stands are carried forward per submission with bucketed
    windows, so a submission with very many events is split.
    """
    own = [c for c in SUBMISSION_COLUMNS if c != "qid"]
    saved = log.select("qid", *_ORDER, "op", F.struct(*own).alias("version"), (F.col("op") != "delete").alias("stands"),
                       F.lit(None).cast("string").alias("flag"), F.lit(None).cast("string").alias("by"), F.lit(False).alias("asked"))
    asked = commands.select(sanitize("qid").alias("qid"), *_ORDER, F.when(F.col("command") == "delete", "delete").otherwise("status").alias("op"),
                            F.lit(None).cast(saved.schema["version"].dataType).alias("version"),
                            F.when(F.col("command") == "delete", False).alias("stands"), F.col("status").alias("flag"), F.col("user").alias("by"), F.lit(True).alias("asked"))
    events = carry_forward(saved.unionByName(asked), ["qid"], _ORDER, ["version", "stands"], time_bucket("event_ts"))
    events = with_previous(events, ["qid"], _ORDER, ["stands"], time_bucket("event_ts"), "before")
    found = F.coalesce(F.col("before.stands"), F.lit(False))
    status = F.col("asked") & (F.col("op") == "status")
    new_status = F.when(F.col("flag") == "a", STATUS["a"]).otherwise(STATUS["r"])
    answers = F.coalesce(F.from_json("version.answer", "map<string,string>"), F.create_map().cast("map<string,string>"))
    answer = F.to_json(F.map_concat(answers, F.create_map(F.lit("app_status"), new_status, F.lit("timestamp"), F.date_format("event_ts", "yyyy-MM-dd HH:mm:ss"))))
    changed = {"app_status": new_status, "user_name": F.col("by"), "timestamp": F.col("event_ts"), "answer": answer}
    columns = [F.when(status, changed[c]).otherwise(F.col("version")[c]).alias(c) if c in changed else F.col("version")[c].alias(c) for c in own]
    out = events.where(~F.col("asked") | found).select("qid", *columns, "seq", "op", "event_ts")
    rejected = events.where(F.col("asked") & ~found).select("qid", F.col("op").alias("command"), F.col("flag").alias("status"), F.col("by").alias("user"),
                                                          *_ORDER, F.lit(NOT_FOUND).alias("error"))
    return out.select(*[f.name for f in EVENT_LOG.fields]), rejected
