"""Submission store: current state, answers, upserts, status changes, searches, grids.

Everything is derived from an append-only log (``schemas.EVENT_LOG``) or change events
(``schemas.CHANGES``); the current state is a view of the log, never updated in place.
Latest-wins per key uses ``max_by`` so Spark aggregates partially on the map side before
shuffling: a key with a third of all events still ships one row per map task.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formlake.functions import text
from formlake.functions.text import action_items, like_contains_pattern, sanitize, truthy
from formlake.operators.broadcast import small
from formlake.schemas import SUBMISSION_COLUMNS

STATUS_FLAGS = {"a": "Approved", "r": "In Review", "s": "Submitted", "d": "Draft"}  # fixed values


# ---------------------------------------------------------------------------
# Latest value per (qid, key) and the merged answer map
# ---------------------------------------------------------------------------
def latest_values(changes: DataFrame, keys=("qid", "key"), order=("ts", "seq")) -> DataFrame:
    """Latest ``value`` per key by ``(ts, seq)``; other columns of that event are kept."""
    payload = [c for c in changes.columns if c not in keys]
    best = F.max_by(F.struct(*payload), F.struct(*order)).alias("_b")
    return changes.groupBy(*keys).agg(best).select(*keys, "_b.*")


def answers_map(latest: DataFrame, key: str = "qid") -> DataFrame:
    """One row per submission with ``answers map<string,string>`` (one entry per distinct key of
    that submission, i.e. bounded by the questions it answers, not by its number of edits)."""
    return latest.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("answers"))


def radio_exclusive(changes: DataFrame, items: DataFrame) -> DataFrame:
    """Picking a radio writes ``checked`` for it and ``''`` for the other radios of its container.

    ``items`` is a flattened template (bounded size), so both joins are broadcast after a size check.
    """
    radios = items.where(F.col("type") == "radio").select(F.col("item_id").alias("key"), "parent_id")
    mates = radios.select(F.col("key").alias("mate"), F.col("parent_id"))
    picks = changes.join(small(radios), "key", "left")
    expanded = (picks.join(small(mates), "parent_id", "left")
                .where(F.col("mate").isNull() | (F.col("value") == "checked") | (F.col("mate") == F.col("key"))))
    new_key = F.coalesce(F.col("mate"), F.col("key"))
    new_val = (F.when(F.col("mate").isNull() | (F.col("mate") == F.col("key")), F.col("value"))
               .otherwise(F.lit("")))
    rest = [c for c in changes.columns if c not in ("key", "value")]
    return expanded.select(*rest, new_key.alias("key"), new_val.alias("value")).select(*changes.columns)


# ---------------------------------------------------------------------------
# G1: current state from the log
# ---------------------------------------------------------------------------
def current_state(log: DataFrame) -> DataFrame:
    """Latest version per qid by ``(event_ts, seq)``; qids whose latest event is a delete vanish."""
    cols = [c for c in log.columns if c != "qid"]
    latest = log.groupBy("qid").agg(F.max_by(F.struct(*cols), F.struct("event_ts", "seq")).alias("_l"))
    return latest.select("qid", "_l.*").where(F.col("op") != "delete")


# ---------------------------------------------------------------------------
# Answers → submission columns, defaults
# ---------------------------------------------------------------------------
def submission_columns(df: DataFrame, answers: str = "answers", ts: Column | None = None,
                       namespace: str | None = None, keep: list[Column] | tuple = ()) -> DataFrame:
    """B1: the 13 stored columns from an answer map (tid/pid from namespaced keys), plus ``keep``.

    ``namespace`` is the prefix of the tracker id keys, ``text.TRACKER_NAMESPACE`` unless given.
    """
    a = F.col(answers)
    namespace = text.TRACKER_NAMESPACE if namespace is None else namespace
    return df.select(
        sanitize(a["qid"]).alias("qid"),
        sanitize(a["app_status"]).alias("app_status"),
        F.coalesce(sanitize(F.when(truthy(a[namespace + "app_tid"]), a[namespace + "app_tid"])), F.lit("")).alias("app_tid"),
        F.coalesce(sanitize(F.when(truthy(a[namespace + "app_pid"]), a[namespace + "app_pid"])), F.lit("")).alias("app_pid"),
        sanitize(a["app_name"]).alias("app_name"),
        sanitize(a["app_champion"]).alias("app_champion"),
        sanitize(a["app_team_email"]).alias("app_team_email"),
        sanitize(a["login_user"]).alias("user_name"),
        (ts if ts is not None else F.current_timestamp()).alias("timestamp"),
        F.to_json(a).alias("answer"),
        F.lit(None).cast("string").alias("comments"),
        F.coalesce(action_items(a), F.lit("")).alias("action_items"),
        sanitize(a["login_userMail"]).alias("submitter_email"),
        *keep,
    )


def apply_save_defaults(answers: Column, path: Column, user: Column, mail: Column, new_qid: Column,
                        ts: Column | None = None) -> Column:
    """Qid filled when missing, q_version flag (an empty flag is a missing one), status from the action,
    login fields and the save time (``ts``, now unless given)."""
    status = F.when(path.endswith("/submit"), F.lit("Submitted")).otherwise(F.lit("Draft"))
    extra = F.create_map(F.lit("app_status"), status, F.lit("login_user"), user, F.lit("login_userMail"), mail,
                         F.lit("timestamp"), F.date_format(ts if ts is not None else F.current_timestamp(), "yyyy-MM-dd HH:mm:ss"))
    with_qid = F.when(truthy(answers["qid"]), answers).otherwise(F.map_concat(answers, F.create_map(F.lit("qid"), new_qid)))
    ver = F.when(F.coalesce(answers["q_version_0_1"], F.lit("")) == "",
                 F.create_map(F.lit("q_version_0_2"), F.lit("checked"))).otherwise(F.create_map().cast("map<string,string>"))
    return F.map_concat(with_qid, ver, extra)


def apply_load_defaults(answers: Column, new_qid: Column) -> Column:
    """Qid generated when missing; q_version_0_1 set when absent."""
    with_qid = F.when(truthy(answers["qid"]), answers).otherwise(F.map_concat(answers, F.create_map(F.lit("qid"), new_qid)))
    ver = F.when(F.coalesce(answers["q_version_0_1"], F.lit("")) == "",
                 F.create_map(F.lit("q_version_0_1"), F.lit("checked"))).otherwise(F.create_map().cast("map<string,string>"))
    return F.map_concat(with_qid, ver)


def load_answer_view(df: DataFrame) -> DataFrame:
    """The stored answer map with ``app_status`` overwritten by the row's column."""
    m = F.from_json("answer", "map<string,string>")
    return df.withColumn("answers", F.map_concat(F.coalesce(m, F.create_map().cast("map<string,string>")),
                                                 F.create_map(F.lit("app_status"), F.col("app_status"))))


# ---------------------------------------------------------------------------
# Status changes
# ---------------------------------------------------------------------------
def set_status(current: DataFrame, commands: DataFrame) -> DataFrame:
    """Apply ``commands(qid, status, user, ts)``; ``'a'`` → Approved, anything else → In Review.

    Returns the updated rows plus ``error`` (500 for unknown qids, else null).
    """
    cmd = commands.select(sanitize("qid").alias("qid"), F.col("status").alias("_flag"),
                          F.col("user").alias("_user"), F.col("ts").alias("_ts"))
    j = cmd.join(current, "qid", "left")
    new_status = F.when(F.col("_flag") == "a", F.lit("Approved")).otherwise(F.lit("In Review"))
    m = F.coalesce(F.from_json("answer", "map<string,string>"), F.create_map().cast("map<string,string>"))
    new_answer = F.to_json(F.map_concat(m, F.create_map(F.lit("app_status"), new_status,
                                                        F.lit("timestamp"), F.date_format("_ts", "yyyy-MM-dd HH:mm:ss"))))
    found = F.col("app_name").isNotNull() | F.col("timestamp").isNotNull()
    return j.select(
        "qid",
        F.when(found, new_status).alias("app_status"),
        *[c for c in SUBMISSION_COLUMNS if c not in ("qid", "app_status", "user_name", "timestamp", "answer")],
        F.when(found, F.col("_user")).alias("user_name"),
        F.when(found, F.col("_ts")).alias("timestamp"),
        F.when(found, new_answer).alias("answer"),
        F.when(~found, F.lit(500)).alias("error"),
    )


# ---------------------------------------------------------------------------
# Searches and filters
# ---------------------------------------------------------------------------
SEARCH_COLUMNS = ["app_tid", "app_name", "app_champion", "qid", "app_pid"]


def wildcard_search(current: DataFrame, keyword: str) -> DataFrame:
    """``%kw%`` case-insensitive LIKE on tid, name, champion, qid or pid (``%``/``_`` stay wildcards)."""
    pat = like_contains_pattern(F.lit(keyword))
    cond = None
    for c in SEARCH_COLUMNS:
        hit = F.coalesce(F.ilike(F.col(c), pat), F.lit(False))
        cond = hit if cond is None else (cond | hit)
    return current.where(cond)


def status_slots(flags: str | None) -> list[str] | None:
    """The four IN slots from the flags a, r, s, d; unset slots are ``''``. None → no rows."""
    if flags is None or len(flags) > 4:
        return None
    return [STATUS_FLAGS[k] if k in flags else "" for k in ("a", "r", "s", "d")]


def status_filter(current: DataFrame, flags: str | None) -> DataFrame:
    slots = status_slots(flags)
    if slots is None:
        return current.limit(0)
    return current.where(F.col("app_status").isin(*slots))


GRID_COLUMNS = [("qid", "Col0_qid"), ("app_status", "Col1_app_status"), ("app_name", "Col2_app_name"),
                ("app_champion", "Col3_app_champion"), ("app_team_email", "Col4_app_team_email"),
                ("app_tid", "Col5_app_tid"), ("app_pid", "Col6_app_pid"),
                ("user_name", "Col7_last_modified_by"), ("timestamp", "Col8_last_modified"),
                ("submitter_email", "Col9_submitter_email"), ("action_items", "ColA_action_items")]


def submissions_grid(df: DataFrame) -> DataFrame:
    """The 11 grid columns, in sorted label order."""
    return df.select(*[F.col(src).alias(dst) for src, dst in sorted(GRID_COLUMNS, key=lambda x: x[1])])


SEARCH_ROW = [("qid", "qid"), ("app_status", "app_status"), ("app_tid", "app_tid"), ("app_pid", "app_pid"),
              ("app_name", "app_name"), ("app_champion", "app_champion"), ("app_team_email", "app_team_email"),
              ("user_name", "modified_by"), ("timestamp", "last_modified"), ("answer", "app_answer"),
              ("comments", "comments"), ("action_items", "action_items"), ("submitter_email", "submitter_email")]


def search_rows(df: DataFrame, with_answer: bool = True) -> DataFrame:
    """The renamed search-result columns (the large answer column is optional)."""
    return df.select(*[F.col(s).alias(d) for s, d in SEARCH_ROW if with_answer or d != "app_answer"])


def grid_text_filter(grid: DataFrame, text: str, columns: list[str] | None = None) -> DataFrame:
    """Rows where any cell contains the filter text (both upper-cased)."""
    cols = columns or grid.columns
    f = text.upper()
    cond = None
    for c in cols:
        hit = F.coalesce(F.upper(F.col(c).cast("string")).contains(f), F.lit(False))
        cond = hit if cond is None else (cond | hit)
    return grid.where(cond)


PIECE_LENGTHS = [1, 2, 3, 4, 6, 8, 12, 16, 24, 32]


def _grams(text: Column, n: Column | int) -> Column:
    """All distinct pieces of ``n`` characters."""
    n = F.lit(n) if isinstance(n, int) else n
    pieces = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.substring(text, i, n))
    return F.when(F.length(text) >= n, F.array_distinct(pieces)).otherwise(F.array().cast("array<string>"))


def keyword_hits(rows: DataFrame, words: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of ``rows`` with the ``term_id`` of every keyword (term_id, kw) that one of ``columns`` contains.

    Case does not matter; ``%`` and ``_`` in a keyword are wildcards. Keywords are compared with the distinct
    texts of the columns, however many rows hold them. A keyword's pieces of the greatest length in
    ``PIECE_LENGTHS`` that one of its literal parts reaches are looked up among the texts' pieces, and its rarest
    one joined; only texts that hold it are compared with the keyword. Hits go back to the rows by their
    text. A keyword without any literal part asks only for a length, so it needs no text.
    """
    wild = F.col("kw").rlike("[%_]")
    literal = F.when(wild, F.lower(sanitize("kw"))).otherwise(F.lower("kw"))
    parts = F.filter(F.split(literal, "[%_]"), lambda p: p != "")
    longest = F.array_max(F.transform(parts, F.length))
    size = F.array_max(F.filter(F.array(*[F.lit(n) for n in PIECE_LENGTHS]), lambda n: n <= longest))
    blanks = F.when(longest.isNull(), F.length(F.regexp_replace(literal, "[^_]", "")))
    terms = words.where(F.col("kw").isNotNull()).select(
        "term_id", F.lower("kw").alias("_kw"), F.lower(like_contains_pattern(F.col("kw"))).alias("_pat"), wild.alias("_wild"),
        parts.alias("_parts"), size.alias("_size"), blanks.alias("_blanks"))
    kinds = terms.select("_size", "_blanks").distinct().collect()  # piece lengths, and lengths asked for by wildcards alone
    sizes, lengths = sorted(k[0] for k in kinds if k[0] is not None), sorted(k[1] for k in kinds if k[1] is not None)
    lowered = F.array(*[F.lower(c) for c in columns])
    texts_of = F.array_distinct(F.filter(lowered, lambda x: x.isNotNull()))
    out = [rows.limit(0).select(F.lit(None).cast(terms.schema["term_id"].dataType).alias("term_id"), *rows.columns)]

    def hit(text: Column) -> Column:
        return F.when(F.col("_wild"), F.like(text, F.col("_pat"))).otherwise(F.contains(text, F.col("_kw")))

    if sizes:
        word = ["_kw", "_pat", "_wild"]
        asked = terms.where(F.col("_size").isNotNull())
        candidates = asked.select(*word, F.explode(F.array_distinct(F.flatten(F.transform("_parts", lambda p: _grams(p, F.col("_size")))))).alias("_gram")).distinct()
        texts = rows.select(F.explode(texts_of).alias("_text")).distinct()
        pieces = texts.select("_text", F.explode(F.concat(*[_grams(F.col("_text"), n) for n in sizes])).alias("_gram"))
        held = pieces.groupBy("_gram").agg(F.count(F.lit(1)).alias("_n"))
        rarest = candidates.join(held, "_gram", "left").groupBy(*word).agg(
            F.min_by(F.struct("_gram", "_n"), F.struct(F.coalesce("_n", F.lit(0)), F.col("_gram"))).alias("_r"))
        rarest = rarest.where(F.col("_r._n").isNotNull()).select(*word, F.col("_r._gram").alias("_gram"))
        pairs = pieces.join(rarest, "_gram").where(hit(F.col("_text"))).select("_text", *word)
        # a row comes once for a keyword, by its first column that contains it
        at = rows.withColumn("_lowered", lowered).select("*", F.posexplode("_lowered").alias("_at", "_text")).where(F.col("_text").isNotNull())
        found = at.join(pairs, "_text").where(~F.exists(F.slice("_lowered", F.lit(1), F.col("_at")), lambda x: F.coalesce(hit(x), F.lit(False))))
        out.append(found.join(asked.select("term_id", *word), word).select("term_id", *rows.columns))
    if lengths:
        reach = F.array_max(F.transform(texts_of, F.length))
        fits = rows.select("*", F.explode(F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= reach)).alias("_blanks"))
        out.append(fits.join(terms.select("term_id", "_blanks"), "_blanks").select("term_id", *rows.columns))
    return functools.reduce(DataFrame.unionByName, out[1:] or out)


def first_hits(hits: DataFrame, by: list[str], newest: str = "timestamp") -> DataFrame:
    """H5: of each ``by`` group the one row with the newest ``newest``; ties go to the smallest qid.

    One row of a group leaves a map task, so a term with very many hits is no hot group.
    """
    cols = [c for c in hits.columns if c not in by]
    order = F.struct(F.col(newest).isNull(), -F.unix_micros(F.col(newest).cast("timestamp")), F.col("qid"))
    return hits.groupBy(*by).agg(F.min_by(F.struct(*cols), order).alias("_hit")).select(*by, "_hit.*")


def search_dispatch(current: DataFrame, audit: DataFrame, terms: DataFrame) -> DataFrame:
    """C4 for a table of terms ``(term_id, term)``: ``qid-audit_id`` → revision lookup (C3), a
    single word → wildcard search (C1), anything else → rejected.

    Returns ``(term_id, kind, qid, app_status, app_name, audit_id, error)``.
    """
    parts = F.split("term", "-")
    t = terms.select("term_id", "term", parts.alias("_p"), F.size(parts).alias("_n"))
    rev = t.where((F.col("_n") == 2) & F.col("_p")[0].rlike("^[0-9A-Za-z]+$") & F.col("_p")[1].try_cast("bigint").isNotNull())
    rev = rev.select("term_id", sanitize(F.col("_p")[0]).alias("qid"), F.col("_p")[1].try_cast("long").alias("audit_id"))
    rev_hits = (rev.join(audit.select("qid", "audit_id", "app_status", "app_name"), ["qid", "audit_id"], "inner")
                .select("term_id", F.lit("revision").alias("kind"), "qid", F.lit("Revision").alias("app_status"),
                        "app_name", "audit_id", F.lit(None).cast("string").alias("error")))
    words = t.where(F.col("_n") == 1).select("term_id", sanitize("term").alias("kw"))
    word_hits = keyword_hits(current.select("qid", "app_status", "app_name", *[F.col(c).alias(f"_c{i}") for i, c in enumerate(SEARCH_COLUMNS)]),
                             words, [f"_c{i}" for i in range(len(SEARCH_COLUMNS))]).select(
        "term_id", F.lit("search").alias("kind"), "qid", "app_status", "app_name",
        F.lit(None).cast("long").alias("audit_id"), F.lit(None).cast("string").alias("error"))
    bad = (t.where((F.col("_n") > 2) | ((F.col("_n") == 2) & ~(F.col("_p")[0].rlike("^[0-9A-Za-z]+$")
                                                               & F.col("_p")[1].try_cast("bigint").isNotNull())))
           .select("term_id", F.lit("rejected").alias("kind"), F.lit(None).cast("string").alias("qid"),
                   F.lit(None).cast("string").alias("app_status"), F.lit(None).cast("string").alias("app_name"),
                   F.lit(None).cast("long").alias("audit_id"), F.lit("invalid search term").alias("error")))
    return rev_hits.unionByName(word_hits).unionByName(bad)


def existing_qids(batch: DataFrame, current: DataFrame) -> DataFrame:
    """Rows of ``batch`` whose qid is already stored (use ``new_qids`` for the rest)."""
    return batch.join(current.select("qid"), "qid", "left_semi")


def new_qids(batch: DataFrame, current: DataFrame) -> DataFrame:
    return batch.join(current.select("qid"), "qid", "left_anti")
