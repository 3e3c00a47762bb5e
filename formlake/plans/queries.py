"""Named queries over the driver's test tables (registered in ``__spark_entry__``).

Every query reads the test tables through ``adapters`` and runs the library's operators, so
its work grows with the tables. The matching SQL oracles live in ``oracle.py``.
"""

from __future__ import annotations

from collections.abc import Callable
from importlib import resources

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formlake.functions.text import action_items, request_content, sanitize
from formlake.functions import conditions
from formlake.operators import answers, audit, bulk, commands, diff, export, lint, merge, requests, rollup, store
from formlake.operators.broadcast import small
from formlake.schemas import VALUE_TYPES
from formlake.operators.evaluate import CompiledTemplate, load_items
from formlake.operators.templates import flatten_templates, templates_from_texts
from formlake.plans import adapters as ad
from formlake.streaming import ordered, streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

# Parameters of the registered queries (fixed, part of the query definitions).
SEARCH_KEYWORD = "Customer#00000012_'"
STATUS_FLAGS = "srd"
GRID_FILTER = "building"
SAVED_CUTOFF = "2024-01-15 00:00:00"
AS_OF = "2024-01-20 12:00:00"
VENDOR_TEMPLATE = "vendor_review"
MAIL_REVIEWERS = ["reviews@example.com"]
MAIL_HOST = "https://forms.example.com/?id="


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def vendor_template_text() -> str:
    return resources.files("formlake.resources").joinpath(f"{VENDOR_TEMPLATE}.json").read_text()


_ITEMS: dict[str, tuple] = {}


def _vendor_item_rows(spark: SparkSession):
    """Flatten the shipped template once per process; it is configuration of bounded size."""
    text = vendor_template_text()
    if text not in _ITEMS:
        df = flatten_templates(templates_from_texts(spark, {VENDOR_TEMPLATE: text}), materialize=False)
        _ITEMS[text] = (df.schema, load_items(df))
    return _ITEMS[text]


def vendor_items(spark: SparkSession) -> DataFrame:
    schema, rows = _vendor_item_rows(spark)
    return spark.createDataFrame(rows, schema)


def _vendor_answers(spark: SparkSession, sf_dir: str):
    """Latest answers per submission (radio picks made exclusive) and the compiled template."""
    _, rows = _vendor_item_rows(spark)
    changes = store.radio_exclusive(ad.answer_changes(spark, sf_dir), vendor_items(spark))
    answers = store.answers_map(store.latest_values(changes))
    return answers, CompiledTemplate(rows)


# ---------------------------------------------------------------------------
# Store: searches, grids, filters
# ---------------------------------------------------------------------------
@query
def wildcard_search(spark, sf_dir):
    return store.search_rows(store.wildcard_search(ad.submissions(spark, sf_dir), SEARCH_KEYWORD), with_answer=False)


@query
def status_grid(spark, sf_dir):
    df = store.status_filter(ad.submissions(spark, sf_dir), STATUS_FLAGS)
    return store.submissions_grid(df).orderBy(F.col("Col2_app_name").asc(), F.col("Col8_last_modified").desc())


@query
def grid_text_filter(spark, sf_dir):
    grid = store.submissions_grid(ad.submissions(spark, sf_dir))
    return store.grid_text_filter(grid, GRID_FILTER,
                                  [c for c in grid.columns if c != "Col8_last_modified"])


# ---------------------------------------------------------------------------
# Log-derived state and history
# ---------------------------------------------------------------------------
@query
def upsert_current(spark, sf_dir):
    cur = store.current_state(ad.submission_log(spark, sf_dir))
    return cur.select("qid", "app_status", "user_name", "timestamp", "answer", "seq")


@query
def audit_log(spark, sf_dir):
    a = audit.audit_log(ad.submission_log(spark, sf_dir))
    return a.select("audit_id", "qid", "app_status", "user_name", "timestamp", "answer", "audit_timestamp")


@query
def revisions(spark, sf_dir):
    log = ad.submission_log(spark, sf_dir)
    r = audit.revisions(audit.audit_log(log), store.current_state(log))
    return r.select("owner_qid", "revision_id", "app_status", "user_name", "timestamp")


@query
def latest_saved(spark, sf_dir):
    log = ad.submission_log(spark, sf_dir)
    return audit.latest_saved(audit.audit_log(log), store.current_state(log))


@query
def revision_as_of(spark, sf_dir):
    v = audit.revision_as_of(ad.submission_log(spark, sf_dir), AS_OF)
    return v.select("qid", "seq", "app_status", "valid_from", "valid_to")


@query
def status_durations(spark, sf_dir):
    return audit.status_durations(ad.submission_log(spark, sf_dir))


@query
def transition_violations(spark, sf_dir):
    return audit.transition_violations(ad.submission_log(spark, sf_dir))


# ---------------------------------------------------------------------------
# Answers and diffs
# ---------------------------------------------------------------------------
@query
def merge_answers(spark, sf_dir):
    changes = store.radio_exclusive(ad.answer_changes(spark, sf_dir), vendor_items(spark))
    return store.latest_values(changes).select("qid", "key", "value")


@query
def answer_diff(spark, sf_dir):
    changes = store.radio_exclusive(ad.answer_changes(spark, sf_dir), vendor_items(spark))
    current = store.latest_values(changes)
    saved = store.latest_values(changes.where(F.col("ts") < F.lit(SAVED_CUTOFF).cast("timestamp")))
    return diff.answer_diff(current.select("qid", "key", "value"), saved.select("qid", "key", "value"))


@query
def revision_diff(spark, sf_dir):
    changes = store.radio_exclusive(ad.answer_changes(spark, sf_dir), vendor_items(spark))
    return diff.revision_diff(changes).select("qid", "key", "seq", "old_value", "new_value", "change")


@query
def conversation_revision_diff(spark, sf_dir):
    d = diff.revision_diff(ad.conversation_versions(spark, sf_dir))
    return d.select("qid", "key", "seq", F.md5(F.coalesce("old_value", F.lit(""))).alias("old_md5"),
                    F.md5("new_value").alias("new_md5"), "change")


# ---------------------------------------------------------------------------
# Template evaluation over all submissions
# ---------------------------------------------------------------------------
@query
def item_visibility(spark, sf_dir):
    answers, tpl = _vendor_answers(spark, sf_dir)
    return tpl.item_visibility(answers, ["qid"])


@query
def active_tips(spark, sf_dir):
    answers, tpl = _vendor_answers(spark, sf_dir)
    return tpl.active_tips(answers, ["qid"])


@query
def todo_list(spark, sf_dir):
    answers, tpl = _vendor_answers(spark, sf_dir)
    return tpl.todo_list(answers, ["qid"])


@query
def unanswered_count(spark, sf_dir):
    answers, tpl = _vendor_answers(spark, sf_dir)
    return tpl.unanswered_counts(answers, ["qid"])


@query
def field_issues(spark, sf_dir):
    answers, tpl = _vendor_answers(spark, sf_dir)
    return tpl.field_issues(answers, ["qid"])


@query
def risk_rollup(spark, sf_dir):
    answers, tpl = _vendor_answers(spark, sf_dir)
    tips = tpl.active_tips(answers, ["qid"]).where("warn")
    status = store.current_state(ad.submission_log(spark, sf_dir)).select("qid", "app_status")
    j = tips.join(status, "qid", "left").withColumn("app_status", F.coalesce("app_status", F.lit("Deleted")))
    return (j.groupBy("severity", "app_status")
            .agg(F.count("*").alias("n_warnings"), F.count_distinct("qid").alias("n_submissions")))


# ---------------------------------------------------------------------------
# Scalar rules over whole texts
# ---------------------------------------------------------------------------
@query
def action_items_docs(spark, sf_dir):
    t = ad.answer_texts(spark, sf_dir)
    return t.select("doc_id", action_items("answers").alias("action_items"))


@query
def sanitize_docs(spark, sf_dir):
    d = ad.table(spark, sf_dir, "documents")
    s = sanitize("text")
    return d.select("doc_id", F.length(s).alias("sanitized_len"), F.md5(s).alias("sanitized_md5"))


# ---------------------------------------------------------------------------
# Requests, sessions, limits, digests, notices
# ---------------------------------------------------------------------------
@query
def rate_limit_violations(spark, sf_dir):
    return requests.rate_limit_violations(ad.requests(spark, sf_dir), client="gateway")


@query
def user_sessions(spark, sf_dir):
    return requests.user_sessions(ad.requests(spark, sf_dir))


@query
def oversized_requests(spark, sf_dir):
    return requests.oversized_requests(ad.requests(spark, sf_dir))


@query
def error_digest(spark, sf_dir):
    return requests.error_digests(ad.log_records(spark, sf_dir))


@query
def autosave_batches(spark, sf_dir):
    return requests.autosave_batches(ad.answer_changes(spark, sf_dir))


@query
def review_notices(spark, sf_dir):
    return requests.review_notices(ad.submission_log(spark, sf_dir))


# ---------------------------------------------------------------------------
# Templates at scale: one generated template per order
# ---------------------------------------------------------------------------
@query
def flatten_template(spark, sf_dir):
    items = flatten_templates(ad.order_templates(spark, sf_dir))
    return items.select("template_id", "item_id", "ordinal", "depth", "parent_id", "type", "cond")


@query
def template_lint(spark, sf_dir):
    """Root findings, broken rules, repeated ids, rejected conditions and unknown references."""
    templates = ad.order_templates(spark, sf_dir)
    return lint.lint_templates(flatten_templates(templates, in_rows=True, fields=lint.FIELDS), templates)


@query
def condition_tokens(spark, sf_dir):
    items = flatten_templates(ad.order_templates(spark, sf_dir))
    return conditions.condition_tokens(items).select("template_id", "item_id",
                                                     F.col("pos").cast("int").alias("pos"), "token", "kind")


@query
def merge_templates(spark, sf_dir):
    items, _ = merge.merge_templates(ad.order_templates(spark, sf_dir), ad.order_extensions(spark, sf_dir))
    return items.select("template_id", "item_id", "ordinal", "depth", "parent_id", "type", "source")


@query
def answers_stream(spark, sf_dir):
    """M1/M9 on a stream of change events; same result as ``merge_answers``."""
    ch = ad.answer_changes(spark, sf_dir, streams.read_stream(spark, sf_dir, "events.parquet"))
    items = vendor_items(spark)
    out = streams.run_to_table(spark, "answers", lambda base: streams.answers_stream(ch, items, base),
                               streams.compact_latest)
    return streams.to_ntz(_or_empty(spark, out, "qid string, key string, value string").select("qid", "key", "value"))


@query
def autosave_stream(spark, sf_dir):
    """M2 on a stream; same result as ``autosave_batches``."""
    ch = ad.answer_changes(spark, sf_dir, streams.read_stream(spark, sf_dir, "events.parquet"))
    out = streams.run_to_table(spark, "autosave", lambda base: streams.autosave_stream(ch, base),
                               streams.compact(["qid", "batch_start", "key"]))
    return _or_empty(spark, out, "qid string, batch_start timestamp_ntz, key string, value string, seq bigint")


@query
def audit_stream(spark, sf_dir):
    """M3: audit rows from a streamed log with per-qid state; same result as ``audit_log``."""
    log = ad.submission_log(spark, sf_dir, streams.read_stream(spark, sf_dir, "events.parquet"))
    out = streams.run_to_table(spark, "audit", lambda base: streams.audit_stream(log, base), ordered.latest_audit)
    out = _or_empty(spark, out, "audit_id long, qid string, app_status string, user_name string, timestamp timestamp_ntz, answer string, audit_timestamp timestamp_ntz")
    return out.select("audit_id", "qid", "app_status", "user_name",
                      F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "answer",
                      F.col("audit_timestamp").cast("timestamp_ntz").alias("audit_timestamp"))


@query
def sessions_stream(spark, sf_dir):
    """M7 on a stream; same result as ``user_sessions``."""
    req = ad.requests(spark, sf_dir, streams.read_stream(spark, sf_dir, "events.parquet"))
    out = streams.run_to_table(spark, "sessions", lambda base: streams.sessions_stream(req, base),
                               lambda rows: ordered.latest_sessions(rows, requests.SESSION_LIFETIME_SECONDS))
    return _or_empty(spark, out, "client string, session_start timestamp_ntz, session_end timestamp_ntz, "
                                 "n_requests bigint")


@query
def oversized_stream(spark, sf_dir):
    """M8 on a stream; same result as ``oversized_requests``."""
    req = ad.requests(spark, sf_dir, streams.read_stream(spark, sf_dir, "events.parquet"))
    out = streams.run_to_table(spark, "oversized", lambda base: streams.oversized_stream(req, base))
    return _or_empty(spark, out, "ts timestamp_ntz, client string, path string, content_length bigint, "
                                 "max_length bigint")


@query
def rate_limit_stream(spark, sf_dir):
    """M6 on a stream: gateway-days over the daily budget."""
    req = ad.requests(spark, sf_dir, streams.read_stream(spark, sf_dir, "events.parquet"))
    out = streams.run_to_table(spark, "ratelimit",
                               lambda base: streams.rate_limit_stream(req, base, "day", client="gateway"),
                               streams.compact(["gateway", "window_start"]))
    return _or_empty(spark, out, "gateway string, window_start timestamp_ntz, n_requests bigint, rejected bigint")


def _or_empty(spark, df, schema):
    return streams.to_ntz(df) if df is not None else spark.createDataFrame([], schema)


@query
def answer_items(spark, sf_dir):
    """Merged answers matched to the template's value items."""
    items = vendor_items(spark)
    latest = store.latest_values(store.radio_exclusive(ad.answer_changes(spark, sf_dir), items))
    return answers.answer_items(latest.select("qid", "key", "value"), items).select("qid", "key", "type", "value")


@query
def unknown_answers(spark, sf_dir):
    """Keys of every stored version's answer JSON that name no template item."""
    log = ad.submission_log(spark, sf_dir)
    long = log.select("qid", "seq", F.explode(F.from_json("answer", "map<string,string>")).alias("key", "value"))
    return answers.unknown_answers(long, vendor_items(spark)).select("qid", "seq", "key", "value")


@query
def diff_toc(spark, sf_dir):
    """K2: changed answers whose item is displayed for the current answers."""
    changes = store.radio_exclusive(ad.answer_changes(spark, sf_dir), vendor_items(spark))
    current = store.latest_values(changes).select("qid", "key", "value")
    saved = store.latest_values(changes.where(F.col("ts") < F.lit(SAVED_CUTOFF).cast("timestamp")))
    d = diff.answer_diff(current, saved.select("qid", "key", "value"))
    amap, tpl = _vendor_answers(spark, sf_dir)
    return answers.diff_toc(d, tpl.item_visibility(amap, ["qid"]))


@query
def visibility_transitions(spark, sf_dir):
    """Items shown or hidden by each change event."""
    _, rows = _vendor_item_rows(spark)
    tpl = CompiledTemplate(rows)
    changes = store.radio_exclusive(ad.answer_changes(spark, sf_dir), vendor_items(spark))
    keys = [i for i in tpl.order if tpl.items[i].type in VALUE_TYPES]
    return answers.visibility_transitions(answers.answer_versions(changes, keys), tpl)


@query
def export_roundtrip(spark, sf_dir):
    """Flatten, export back to JSON, flatten again; the template diff must be empty."""
    items = flatten_templates(ad.order_templates(spark, sf_dir))
    exported = export.export_templates(items).withColumnRenamed("json", "text")
    again = flatten_templates(exported)
    return export.template_diff(items, again).select("template_id", "item_id", "change",
                                                     F.array_join("fields", ",").alias("fields"))


@query
def status_changes(spark, sf_dir):
    """Reviewer commands (clicks → review, purchases → approve) applied to the current state."""
    e = ad.table(spark, sf_dir, "events").where(F.col("event_type").isin("click", "purchase"))
    cmds = e.select(F.concat(F.lit("U"), F.lpad(F.col("user_id").cast("string"), 11, "0")).alias("qid"),
                    F.when(F.col("event_type") == "purchase", "a").otherwise("r").alias("status"),
                    F.concat(F.lit("reviewer"), (F.col("user_id") % 3).cast("string")).alias("user"), "ts")
    cur = store.current_state(ad.submission_log(spark, sf_dir))
    return store.set_status(cur, cmds).select("qid", "app_status", "user_name", "timestamp", "error")


@query
def audit_append_only(spark, sf_dir):
    """H2: the audit derived from an earlier prefix of the log must be contained in today's audit."""
    log = ad.submission_log(spark, sf_dir)
    earlier = audit.audit_log(log.where(F.col("event_ts") < F.lit(SAVED_CUTOFF).cast("timestamp")))
    return audit.audit_is_append_only(earlier, audit.audit_log(log)).select(
        "audit_id", "qid", "app_status", "audit_timestamp")


@query
def modified_submissions(spark, sf_dir):
    """I4: submissions with changed answers since the saved state, and how many keys changed."""
    return diff.any_modified(answer_diff(spark, sf_dir))


@query
def pending_changes(spark, sf_dir):
    """Distinct keys changed after each submission's last save before the cut-off."""
    log = ad.submission_log(spark, sf_dir)
    saves = (log.where((F.col("op") == "save") & (F.col("event_ts") < F.lit(SAVED_CUTOFF).cast("timestamp")))
             .groupBy("qid").agg(F.max("event_ts").alias("saved_ts")))
    return diff.pending_changes(ad.answer_changes(spark, sf_dir), saves)


@query
def submission_rows(spark, sf_dir):
    """Stored columns (incl. ticket keys found in the answers) from each merged answer map."""
    amap, _ = _vendor_answers(spark, sf_dir)
    with_qid = amap.withColumn("answers", F.map_concat("answers", F.create_map(F.lit("qid"), F.col("qid"))))
    rows = store.submission_columns(with_qid, ts=F.lit(None).cast("timestamp"))
    return rows.select("qid", "app_status", "app_tid", "app_pid", "user_name", "action_items")


@query
def tip_headings(spark, sf_dir):
    """The heading shown for every active tip (custom title, warning with risk level, or tip)."""
    from formlake.functions.text import tip_label

    amap, tpl = _vendor_answers(spark, sf_dir)
    tips = tpl.active_tips(amap, ["qid"])
    meta = vendor_items(spark).select("item_id", "custom_title", F.col("severity").alias("raw_severity"))
    return (tips.join(small(meta), "item_id")
            .select("qid", "item_id", tip_label("custom_title", "warn", "raw_severity").alias("heading")))


@query
def error_digest_by_source(spark, sf_dir):
    """M5 with one buffer per logging process (source)."""
    return requests.error_digests(ad.log_records(spark, sf_dir), source="source")


@query
def error_digest_stream(spark, sf_dir):
    """M5 on a stream, one buffer per source; same result as ``error_digest_by_source``."""
    logs = ad.log_records(spark, sf_dir, streams.read_stream(spark, sf_dir, "events.parquet"))
    out = streams.run_to_table(spark, "digests", lambda base: streams.error_digest_stream(logs, base))
    return _or_empty(spark, out, streams.DIGEST_OUT)


@query
def notices_stream(spark, sf_dir):
    """M4 on a stream of log events; same result as ``review_notices``."""
    log = ad.submission_log(spark, sf_dir, streams.read_stream(spark, sf_dir, "events.parquet"))
    out = streams.run_to_table(spark, "notices", lambda base: streams.notices_stream(log, base))
    return _or_empty(spark, out, "qid string, seq bigint, app_status string, subject string, body_template string")


@query
def revision_lookup(spark, sf_dir):
    """Every audit row looked up again through its ``qid-audit_id`` search term."""
    log = ad.submission_log(spark, sf_dir)
    aud = audit.audit_log(log)
    terms = aud.select(F.col("audit_id").alias("term_id"),
                       F.concat_ws("-", "qid", F.col("audit_id").cast("string")).alias("term"))
    empty = log.limit(0).select(*[F.col(c) for c in log.columns])
    return store.search_dispatch(empty, aud, terms)


@query
def search_batch(spark, sf_dir):
    """A batch of search terms (the nation names) dispatched against all submissions."""
    terms = ad.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("term_id"),
                                                     F.col("n_name").alias("term"))
    audit_rows = spark.createDataFrame([], "qid string, audit_id long, app_status string, app_name string")
    return store.search_dispatch(ad.submissions(spark, sf_dir), audit_rows, terms)


@query
def template_siblings(spark, sf_dir):
    """Previous and next item of every item of the generated templates."""
    from formlake.operators.templates import siblings

    return siblings(flatten_templates(ad.order_templates(spark, sf_dir)))


@query
def merge_errors(spark, sf_dir):
    _, errors = merge.merge_templates(ad.order_templates(spark, sf_dir), ad.order_extensions(spark, sf_dir))
    return errors


@query
def visibility_many_templates(spark, sf_dir):
    """D1(b), D8: every order's answers against its own generated questionnaire."""
    items = flatten_templates(ad.order_reviews(spark, sf_dir), in_rows=True, fields=bulk.ITEM_FIELDS)
    return bulk.evaluate_many(ad.order_answers(spark, sf_dir), items, "item_visibility", ["qid"])


@query
def tips_many_templates(spark, sf_dir):
    """D1(b), D9: the active tips of every order's questionnaire."""
    items = flatten_templates(ad.order_reviews(spark, sf_dir), in_rows=True, fields=bulk.ITEM_FIELDS)
    return bulk.evaluate_many(ad.order_answers(spark, sf_dir), items, "active_tips", ["qid"])


@query
def unanswered_many_templates(spark, sf_dir):
    """D1(b), I2: unanswered questions per block of every order's questionnaire."""
    items = flatten_templates(ad.order_reviews(spark, sf_dir), in_rows=True, fields=bulk.ITEM_FIELDS)
    return bulk.evaluate_many(ad.order_answers(spark, sf_dir), items, "unanswered_counts", ["qid"])


@query
def template_lint_order(spark, sf_dir):
    """Root findings, rejected conditions, cycles and forward references of flawed questionnaires."""
    templates = ad.order_reviews(spark, sf_dir, flawed=True)
    return lint.lint_templates(flatten_templates(templates, in_rows=True, fields=lint.FIELDS), templates, order=True)


@query
def search_terms(spark, sf_dir):
    """Terms with and without wildcards, short, empty and rejected ones against all submissions."""
    audit_rows = spark.createDataFrame([], "qid string, audit_id long, app_status string, app_name string")
    found = store.search_dispatch(ad.submissions(spark, sf_dir), audit_rows, ad.search_terms(spark, sf_dir))
    return found.select("term_id", "kind", "qid", "app_status", "app_name", "error")


@query
def search_customers(spark, sf_dir):
    """C1 for a batch that grows with the data: every customer's name, a wildcard in it, against all submissions."""
    words = ad.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("term_id"), F.lower(F.replace("c_name", F.lit("#"), F.lit("_"))).alias("kw"))
    return store.keyword_hits(ad.submissions(spark, sf_dir), words, store.SEARCH_COLUMNS).select("term_id", "qid", "app_name")


@query
def search_first_hits(spark, sf_dir):
    """H5: the newest submission that each customer's name is found in."""
    words = ad.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("term_id"), F.lower(F.replace("c_name", F.lit("#"), F.lit("_"))).alias("kw"))
    found = store.keyword_hits(ad.submissions(spark, sf_dir), words, store.SEARCH_COLUMNS)
    return store.first_hits(found.select("term_id", "qid", "app_status", "timestamp"), ["term_id"])


@query
def revisions_newest_first(spark, sf_dir):
    """H4: every submission's revisions, numbered from the newest."""
    log = ad.submission_log(spark, sf_dir)
    r = audit.newest_first(audit.revisions(audit.audit_log(log), store.current_state(log)))
    return r.select("owner_qid", "revision_id", "app_status", F.col("position").cast("long").alias("position"))


@query
def review_mails(spark, sf_dir):
    """Subject, body and recipients of every notice."""
    return requests.review_mails(ad.submission_log(spark, sf_dir), MAIL_REVIEWERS, MAIL_HOST)


@query
def encoded_docs(spark, sf_dir):
    """Every whole document text as a request's content."""
    content = request_content("doc=%s&text=%s", "doc_id", "text")
    return ad.table(spark, sf_dir, "documents").select("doc_id", F.length(content).cast("long").alias("n_chars"), F.md5(content).alias("content_md5"))


@query
def risk_levels(spark, sf_dir):
    """Warnings of all templates on every level of template, severity and status."""
    answers, tpl = _vendor_answers(spark, sf_dir)
    own = tpl.active_tips(answers, ["qid"]).select("qid", F.lit(VENDOR_TEMPLATE).alias("template_id"), "severity", "warn")
    items = flatten_templates(ad.order_reviews(spark, sf_dir), in_rows=True, fields=bulk.ITEM_FIELDS)
    orders = bulk.evaluate_many(ad.order_answers(spark, sf_dir), items, "active_tips", ["qid"]).select(own.columns)
    status = store.current_state(ad.submission_log(spark, sf_dir)).select("qid", "app_status").unionByName(
        ad.submissions(spark, sf_dir).select("qid", "app_status"))
    return rollup.risk_levels(own.unionByName(orders), status)


@query
def merged_visibility(spark, sf_dir):
    """F8, D1(b): every order's questionnaire merged with an extension, then evaluated over the order's answers."""
    items, _ = merge.merge_templates(ad.order_reviews(spark, sf_dir), ad.review_extensions(spark, sf_dir))
    return bulk.evaluate_many(ad.order_answers(spark, sf_dir), items, "item_visibility", ["qid"])


@query
def commands_current(spark, sf_dir):
    """The one current row of every submission after status and delete commands were folded into its log."""
    log, _ = commands.apply_commands(*ad.reviewed_log(spark, sf_dir))
    return store.current_state(log).select("qid", "app_status", "user_name", "timestamp", "seq", F.from_json("answer", "map<string,string>")["app_status"].alias("answer_status"))


@query
def commands_audit(spark, sf_dir):
    """The audit rows that the commands leave behind."""
    log, _ = commands.apply_commands(*ad.reviewed_log(spark, sf_dir))
    return audit.audit_log(log).select("audit_id", "qid", "app_status", "user_name", "timestamp", "audit_timestamp")


@query
def commands_rejected(spark, sf_dir):
    """Commands on submissions that were not there at their time."""
    return commands.apply_commands(*ad.reviewed_log(spark, sf_dir))[1]
