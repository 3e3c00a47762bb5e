"""Answer files and snapshots: import, export, lookup.

Files are read with Spark's file sources (``text`` with ``wholetext``, ``binaryFile`` with
recursive lookup), so a directory tree of any size is split across tasks. Per-directory
rules (versions ordered by modification time, one qid per directory) are window functions
partitioned by directory.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from formlake.functions.text import (answer_file_name, deterministic_token, latest_file_target_name,
                                     template_id_from_path)
from formlake.operators.requests import global_rank
from formlake.operators.store import submission_columns
from formlake.schemas import AUDIT, SUBMISSION

ADMIN_USER = "admin"
ADMIN_USER_EMAIL = "admin@example.com"
_EMPTY_MAP = "map<string,string>"


def _with_version_flag(answers: Column, flag_key: str = "q_version_0_2", set_key: str = "q_version_0_1",
                       when_both_missing: bool = False) -> Column:
    missing = answers[flag_key].isNull() if not when_both_missing else \
        (answers["q_version_0_1"].isNull() & answers["q_version_0_2"].isNull())
    return F.when(missing, F.map_concat(answers, F.create_map(F.lit(set_key), F.lit("checked")))).otherwise(answers)


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    """A1: one row per answer file ``(path, answers, error)``; a file that is not a JSON object of
    strings gets ``error``. When both version flags are missing ``q_version_0_1`` is set."""
    raw = (spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").text(path)
           .select(F.col("_metadata.file_path").alias("path"), F.col("value")))
    m = F.from_json("value", _EMPTY_MAP)
    return raw.select("path", F.when(m.isNotNull(), _with_version_flag(m, when_both_missing=True)).alias("answers"),
                      F.when(m.isNull(), F.lit("not a JSON object")).alias("error"))


def import_revisions(spark: SparkSession, path: str, admin_user: str = ADMIN_USER,
                     admin_mail: str = ADMIN_USER_EMAIL) -> tuple[DataFrame, DataFrame]:
    """A2: every file of a directory is a version of one submission, in modification-time order.

    The qid of the directory's first readable file (or a token derived from the directory) is
    forced on all its files; status, login user/mail and the version flag get defaults; the
    file time becomes the version time. ``seq`` numbers all files of the import by time and path, so that it
    is unique across directories, also where two of them name the same qid; unreadable files take a
    number too. Returns ``(log, rejected)`` where ``log`` has the EVENT_LOG schema (``op='import'``) and
    ``rejected`` lists unreadable files.
    """
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
             .select("path", "modificationTime", F.col("content")))
    parsed = files.select("path", "modificationTime",
                          F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("dir"),
                          F.from_json(F.decode("content", "UTF-8"), _EMPTY_MAP).alias("a"))
    good = parsed.where(F.col("a").isNotNull())
    rejected = parsed.where(F.col("a").isNull()).select("path", F.lit("not a JSON object").alias("error"))
    w = Window.partitionBy("dir").orderBy("modificationTime", "path")
    first_qid = F.first(F.coalesce(F.col("a")["qid"], deterministic_token(F.col("dir"))), ignorenulls=True) \
        .over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    a = F.col("a")
    defaults = F.map_concat(
        a, F.create_map(F.lit("qid"), first_qid,
                        F.lit("app_status"), F.coalesce(a["app_status"], F.lit("Submitted")),
                        F.lit("login_user"), F.coalesce(a["login_user"], F.lit(admin_user)),
                        F.lit("login_userMail"), F.coalesce(a["login_userMail"], F.lit(admin_mail))))
    # numbered from the listing alone, without the files' contents
    place = global_rank(files.select("path", "modificationTime"), ["modificationTime", "path"]).select("path", (F.col("rank") + 1).cast("long").alias("seq"))
    versioned = good.select("path", "modificationTime",
                            F.when(F.coalesce(a["q_version_0_2"], F.lit("")) == "",
                                   F.map_concat(defaults, F.create_map(F.lit("q_version_0_1"), F.lit("checked"))))
                            .otherwise(defaults).alias("answers")).join(place, "path")
    cols = submission_columns(versioned, "answers", ts=F.col("modificationTime"),
                              keep=[F.col("seq"), F.lit("import").alias("op"),
                                    F.col("modificationTime").alias("event_ts")])
    return cols, rejected


def answer_files(current: DataFrame) -> DataFrame:
    """A3: ``(file_name, content)`` of the answer file of every submission."""
    return current.select(answer_file_name("qid", "app_name", "app_champion", "app_team_email", "app_tid",
                                           "app_pid").alias("file_name"),
                          F.col("answer").alias("content"))


def write_answer_files(current: DataFrame, path: str) -> None:
    """A3 sink: JSON lines with the file name kept as a column (no file per submission)."""
    answer_files(current).write.mode("append").json(path)


def latest_file_per_dir(files: DataFrame) -> DataFrame:
    """A4: the newest file of every directory and the name it is copied under."""
    d = files.withColumn("dir", F.regexp_extract("path", r"^(.*)/[^/]*$", 1))
    w = Window.partitionBy("dir").orderBy(F.desc("modificationTime"), F.desc("path"))
    newest = d.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    m = F.from_json(F.decode("content", "UTF-8"), _EMPTY_MAP)
    return newest.select("dir", "path", latest_file_target_name(deterministic_token(F.col("dir")), m["app_name"],
                                                                 m["app_champion"], m["app_team_email"]).alias("target"))


def export_snapshot(tables: dict[str, DataFrame], path: str, stamp: str | None = None) -> str:
    """A5: every table as JSON lines under ``path/<stamp>/<table>``, one backup per run; its stamp.

    ``stamp`` is the UTC time in sortable form unless given. An existing backup is never replaced.
    """
    stamp = stamp or datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%S%fZ")
    for name, df in tables.items():
        df.write.mode("errorifexists").json(f"{path}/{stamp}/{name}")
    return stamp


def restore_snapshot(spark: SparkSession, path: str, stamp: str) -> dict[str, DataFrame]:
    """Read back the two store tables of the backup ``stamp``."""
    return {"Answers": spark.read.schema(SUBMISSION).json(f"{path}/{stamp}/Answers"),
            "Audit": spark.read.schema(AUDIT).json(f"{path}/{stamp}/Audit")}


def find_answer_file(files: DataFrame, term: str) -> DataFrame:
    """Files whose name contains ``term`` (case-insensitive), ordered by name."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return files.where(F.lower(name).contains(term.lower())).orderBy(name)


def served_templates(templates: DataFrame, allowed: list[str]) -> DataFrame:
    """Only allow-listed questionnaires are loadable (substring of the path).

    The allow-list is configuration (a few names); it is broadcast.
    """
    spark = templates.sparkSession
    allow = F.broadcast(spark.createDataFrame([(a,) for a in allowed], "allowed string"))
    return templates.join(allow, F.col("path").contains(F.col("allowed")), "left_semi")


def template_ids(paths: DataFrame) -> DataFrame:
    """A10 for a table of paths."""
    return paths.select("path", template_id_from_path("path").alias("template_id"))
