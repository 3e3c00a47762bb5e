"""Stand-in inputs built from the driver's test tables.

Each adapter is a plain projection of a test table into a schema the library expects (rows
only: no library work happens here). The same rules are written as SQL in ``oracle.py``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _qid(prefix: str, col: str):
    return F.concat(F.lit(prefix), F.lpad(F.col(col).cast("string"), 11, "0"))


def _k():
    return F.get_json_object("props", "$.k").try_cast("bigint")


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current submissions from orders ⋈ customer ⋈ nation (SUBMISSION schema)."""
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer")
    n = table(spark, sf_dir, "nation")  # 25 rows by definition of the schema
    status = (F.when(F.col("o_orderstatus") == "P", "In Review")
              .when(F.col("o_orderstatus") == "F", "Approved")
              .when(F.substring("o_orderpriority", 1, 1).isin("1", "2"), "Submitted")
              .otherwise("Draft"))
    j = o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    user = F.concat(F.lit("user"), F.col("o_custkey").cast("string"))
    return j.select(
        _qid("Q", "o_orderkey").alias("qid"), status.alias("app_status"),
        F.col("n_name").alias("app_tid"), F.col("o_orderpriority").alias("app_pid"),
        F.col("c_name").alias("app_name"), F.col("c_mktsegment").alias("app_champion"),
        F.concat(F.lower("c_mktsegment"), F.lit("@example.com")).alias("app_team_email"),
        user.alias("user_name"), F.col("o_orderdate").alias("timestamp"),
        F.to_json(F.create_map(F.lit("app_name"), F.col("c_name"))).alias("answer"),
        F.lit(None).cast("string").alias("comments"), F.lit("").alias("action_items"),
        F.concat(user, F.lit("@example.com")).alias("submitter_email"))


def submission_log(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """EVENT_LOG from events: every event saves a version of its user's submission; errors delete it."""
    e = events if events is not None else table(spark, sf_dir, "events")
    status = (F.when(F.col("event_type") == "signup", "Draft").when(F.col("event_type") == "view", "Submitted")
              .when(F.col("event_type") == "click", "In Review").when(F.col("event_type") == "purchase", "Approved"))
    answer = F.concat(F.lit('{"'), F.col("event_type"), F.lit('": "'), _k().cast("string"), F.lit('"}'))
    return e.select(
        _qid("U", "user_id").alias("qid"), status.alias("app_status"), F.lit("").alias("app_tid"),
        F.lit("").alias("app_pid"), F.concat(F.lit("app"), (F.col("user_id") % 17).cast("string")).alias("app_name"),
        F.col("event_type").alias("app_champion"), F.lit(None).cast("string").alias("app_team_email"),
        F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("user_name"),
        F.col("ts").alias("timestamp"), answer.alias("answer"), F.lit(None).cast("string").alias("comments"),
        F.lit("").alias("action_items"), F.lit(None).cast("string").alias("submitter_email"),
        F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "error", "delete").otherwise("save").alias("op"),
        F.col("ts").alias("event_ts"))


def answer_changes(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """CHANGES for the shipped vendor template: one answer change per event (rule by event type)."""
    e = (events if events is not None else table(spark, sf_dir, "events")).select(
        "user_id", "event_id", "ts", "event_type", _k().alias("k"))
    k = F.col("k")
    t = F.col("event_type")
    key = (F.when(t == "signup", "has_policy")
           .when((t == "view") & (k % 4 < 2), "uses_cloud")
           .when(t == "view", "cert_iso")
           .when(t == "click", F.when(k % 3 == 0, "tier_shared").when(k % 3 == 1, "tier_dedicated").otherwise("tier_onprem"))
           .when(t == "purchase", "vendor_code")
           .when(t == "error", "incident_log"))
    value = (F.when(t == "signup", F.when(k % 3 == 0, "yes").when(k % 3 == 1, "no").otherwise(""))
             .when((t == "view") & (k % 4 < 2), F.when(k % 2 == 0, "checked").otherwise(""))
             .when(t == "view", F.when(k % 4 == 2, "checked").otherwise(""))
             .when(t == "click", F.lit("checked"))
             .when(t == "purchase", F.when(k % 5 == 0, F.concat(F.lit("x"), k.cast("string")))
                   .otherwise(F.concat(F.lit("VC"), (k * k).cast("string"))))
             .when(t == "error", F.when(k % 4 == 0, F.concat(F.lit("Sev 1 outage, see OPS-"), k.cast("string")))
                   .when(k % 4 == 1, F.lit("minor glitch")).when(k % 4 == 2, F.lit(""))
                   .otherwise(F.concat(F.lit("tracked as INC-"), k.cast("string")))))
    return e.select(_qid("U", "user_id").alias("qid"), key.alias("key"), value.alias("value"),
                    F.col("ts").alias("ts"), F.col("event_id").alias("seq"))


def requests(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """REQUESTS from events: client = user (behind one of two gateways), path = event type, body size = value."""
    e = events if events is not None else table(spark, sf_dir, "events")
    path = F.concat(F.lit("/"), F.when(F.col("event_type") == "purchase", "submit")
                    .when(F.col("event_type") == "click", "savedraft").otherwise(F.col("event_type")))
    ctype = F.when(F.col("event_id") % 3 == 0, "application/json").otherwise("application/x-www-form-urlencoded")
    return e.select(F.col("ts"), F.concat(F.lit("client"), F.col("user_id").cast("string")).alias("client"),
                    F.concat(F.lit("gw"), (F.col("user_id") % 2).cast("string")).alias("gateway"),
                    path.alias("path"), ctype.alias("content_type"),
                    F.round(F.col("value") * 1000).cast("bigint").alias("content_length"),
                    F.col("event_id").alias("seq"))


def log_records(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """LOG records from events: errors are ERROR, purchases CRITICAL, the rest INFO; the record's
    source (the server process that logged it) is one of four hosts, by user."""
    e = events if events is not None else table(spark, sf_dir, "events")
    level = (F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "purchase", "CRITICAL")
             .otherwise("INFO"))
    msg = F.concat(F.col("event_type"), F.lit(" by user "), F.col("user_id").cast("string"))
    host = F.concat(F.lit("host"), (F.col("user_id") % 4).cast("string"))
    return e.select("ts", level.alias("level"), msg.alias("message"), F.col("event_id").alias("seq"),
                    host.alias("source"))


def answer_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answer maps from documents: the whole text plus a reference key ``<LANG>-<doc_id>``."""
    d = table(spark, sf_dir, "documents")
    ref = F.concat(F.upper("lang"), F.lit("-"), F.col("doc_id").cast("string"))
    return d.select("doc_id", F.create_map(F.lit("reference"), ref, F.lit("text"), F.col("text")).alias("answers"))


def conversation_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CHANGES from conversations: conversation = submission, turn = revision, role = key."""
    c = table(spark, sf_dir, "conversations")
    return c.select(_qid("C", "conv_id").alias("qid"), F.col("role").alias("key"), F.col("text").alias("value"),
                    F.timestamp_seconds(F.col("turn")).alias("ts"), F.col("turn").alias("seq"))


def order_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One template JSON text per order: a root block, one block per line item, one question each.

    Question type by return flag (R yesno, A check, N line; quantity above 48 an unknown type),
    yes/no labels only on open lines, and a condition per line block written from the line's
    numbers. Only JSON text is produced here; parsing and flattening is the library's work.
    """
    li = table(spark, sf_dir, "lineitem")
    # Lines of an order in a total order (line numbers repeat in the test data).
    key = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax",
           "l_returnflag", "l_linestatus"]
    per_order = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(*key))).alias("lines"))
    ok = F.col("l_orderkey").cast("string")

    def block(x, i):
        pk, sk, n = x["l_partkey"].cast("string"), x["l_suppkey"].cast("string"), (i + 1).cast("string")
        qtype = (F.when(x["l_quantity"] > 48, "dropdown").when(x["l_returnflag"] == "R", "yesno")
                 .when(x["l_returnflag"] == "A", "check").otherwise("line"))
        open_line = x["l_linestatus"] == "O"
        question = F.struct(qtype.alias("type"), F.concat(F.lit("q_"), pk).alias("id"),
                            F.concat(F.lit("Part "), pk).alias("text"),
                            F.when(open_line & (qtype == "yesno"), F.lit("Yes")).alias("yes"),
                            F.when(open_line & (qtype == "yesno"), F.lit("No")).alias("no"))
        cond = (F.when(i == 0, F.lit(None))
                .when(x["l_discount"] >= 0.08, F.concat(F.lit("q_"), pk, F.lit("/yes && !(q_"), sk, F.lit(")")))
                .when(x["l_tax"] >= 0.06, F.concat(F.lit('matches(q_'), pk, F.lit('/value, "^[0-9]+$")')))
                .when(x["l_quantity"] < 3, F.concat(F.lit("q_"), pk, F.lit(" & q_"), sk))
                .when(x["l_quantity"] < 5, F.concat(F.lit("(q_"), pk, F.lit(" q_"), sk, F.lit(")")))
                .otherwise(F.concat(F.lit("q_"), pk, F.lit(" || ^o"), ok, F.lit("_l1"))))
        return F.struct(F.lit("block").alias("type"), F.concat(F.lit("o"), ok, F.lit("_l"), n).alias("id"),
                        F.concat(F.lit("Line "), n).alias("text"), cond.alias("cond"),
                        F.array(question).alias("items"))

    lines = F.transform("lines", block)
    root = F.struct(F.lit("block").alias("type"), F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("id"),
                    F.concat(F.lit("Order "), F.col("l_orderkey").cast("string")).alias("text"), lines.alias("items"))
    doc = F.struct(F.lit(1).alias("version"), F.array(root).alias("questionnaire"))
    return per_order.select(_qid("T", "l_orderkey").alias("template_id"), F.to_json(doc).alias("text"))


def order_extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One extension per order: a review block inserted after line 1 (odd orders) or before the
    last line (even orders); every 7th order has another version, every 11th a missing target."""
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("last"))
    j = o.join(li, o.o_orderkey == li.l_orderkey)
    ok = F.col("o_orderkey").cast("string")
    target_line = F.when(F.col("o_orderkey") % 11 == 0, F.lit(9)).when(F.col("o_orderkey") % 2 == 1, F.lit(1)) \
        .otherwise(F.col("last"))
    target = F.concat(F.lit("o"), ok, F.lit("_l"), target_line.cast("string"))
    item = F.struct(F.lit("block").alias("type"), F.lit("review").alias("id"), F.lit("Review notes").alias("text"),
                    F.when(F.col("o_orderkey") % 2 == 0, target).alias("insertBefore"),
                    F.when(F.col("o_orderkey") % 2 == 1, target).alias("insertAfter"),
                    F.array(F.struct(F.lit("line").alias("type"), F.lit("note").alias("id"),
                                     F.lit("Reviewer note").alias("text"))).alias("items"))
    doc = F.struct(F.when(F.col("o_orderkey") % 7 == 0, F.lit(2)).otherwise(F.lit(1)).alias("version"),
                   F.lit("ext").alias("namespace"), F.array(item).alias("extensions"))
    return j.select(_qid("T", "o_orderkey").alias("template_id"), F.lit(0).alias("apply_order"),
                    F.to_json(doc).alias("text"))


def _review_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(l_orderkey, lines)``: an order's lines in a total order, each with its question's type and answer."""
    li = table(spark, sf_dir, "lineitem")
    key = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
    quantity = F.col("l_quantity").cast("bigint")
    kind = F.when(F.col("l_returnflag") == "R", "yesno").when(F.col("l_returnflag") == "A", "check").otherwise("line")
    answer = (F.when(F.col("l_returnflag") == "R", F.when(quantity % 3 == 0, "yes").when(quantity % 3 == 1, "no").otherwise(""))
              .when(F.col("l_returnflag") == "A", F.when(quantity % 2 == 0, "checked").otherwise(""))
              .otherwise(F.when(F.col("l_linestatus") == "O", F.col("l_partkey").cast("string")).otherwise("")))
    return li.select("l_orderkey", F.struct(*key, kind.alias("kind"), answer.alias("answer")).alias("x")).groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list("x")).alias("lines"))


def order_reviews(spark: SparkSession, sf_dir: str, flawed: bool = False) -> DataFrame:
    """One questionnaire per order whose conditions depend on the line before: a root ``o``, a block
    ``l<n>`` per line with a question ``q<n>`` and a tip ``t<n>``.

    ``flawed`` puts mistakes in: lines 2 and 3 wait for each other (every 5th order), a second root
    (every 7th), a call with one argument too few on line 1 (every 9th).
    """
    def block(x, i):
        n, before = (i + 1).cast("string"), i.cast("string")
        q, b = F.concat(F.lit("q"), before), F.concat(F.lit("^l"), before)
        cond = (F.when(i == 0, F.lit(None))
                .when(x["l_tax"] >= 0.06, F.concat(F.lit("matches("), q, F.lit('/value, "^[0-9]{4}") || '), b))
                .when(x["l_discount"] >= 0.05, F.concat(q, F.lit(" && !("), b, F.lit(" && q1/value)")))
                .when(x["l_quantity"] < 10, F.concat(F.lit("!"), q, F.lit(' || contains(q1/value, "7") && '), b))
                .otherwise(F.concat(F.lit("("), q, F.lit("/yes || "), q, F.lit("/value) && ^o"))))
        if flawed:
            pair = (F.col("l_orderkey") % 5 == 0) & (F.size("lines") >= 3)
            cond = (F.when(pair & (i == 1), "q3").when(pair & (i == 2), "q2")
                    .when((F.col("l_orderkey") % 9 == 0) & (i == 0), "contains(q1/value)").otherwise(cond))
        question = F.struct(x["kind"].alias("type"), F.concat(F.lit("q"), n).alias("id"), F.concat(F.lit("Line "), n).alias("text"),
                            F.when(x["kind"] == "yesno", "Yes").alias("yes"), F.when(x["kind"] == "yesno", "No").alias("no"),
                            F.lit(None).cast("string").alias("cond"), F.lit(None).cast("string").alias("warn"))
        tip = F.struct(F.lit("tip").alias("type"), F.concat(F.lit("t"), n).alias("id"), F.lit("Check the line").alias("text"),
                       F.lit(None).cast("string").alias("yes"), F.lit(None).cast("string").alias("no"),
                       F.concat(F.lit("q"), n, F.lit("/yes || q"), n, F.lit("/value")).alias("cond"), F.lit("yes").alias("warn"))
        return F.struct(F.lit("block").alias("type"), F.concat(F.lit("l"), n).alias("id"), F.concat(F.lit("Line "), n).alias("text"),
                        cond.alias("cond"), F.array(question, tip).alias("items"))

    lines = F.transform("lines", block)
    root = F.array(F.struct(F.lit("block").alias("type"), F.lit("o").alias("id"), F.lit("Order").alias("text"), lines.alias("items")))
    if flawed:
        extra = F.array(F.struct(F.lit("block").alias("type"), F.lit("extra").alias("id"), F.lit("Extra").alias("text"), F.slice(lines, 1, 0).alias("items")))
        root = F.when(F.col("l_orderkey") % 7 == 0, F.concat(root, extra)).otherwise(root)
    doc = F.struct(F.lit(1).alias("version"), root.alias("questionnaire"))
    return _review_lines(spark, sf_dir).select(_qid("T", "l_orderkey").alias("template_id"), F.to_json(doc).alias("text"))


def order_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(qid, template_id, answers)``: every order's answers to its own questionnaire."""
    entries = F.transform("lines", lambda x, i: F.struct(F.concat(F.lit("q"), (i + 1).cast("string")), x["answer"]))
    return _review_lines(spark, sf_dir).select(_qid("Q", "l_orderkey").alias("qid"), _qid("T", "l_orderkey").alias("template_id"),
                                               F.map_from_entries(entries).alias("answers"))


def search_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(term_id, term)``: for every nation its name, the name with a ``_``, its ends with a ``%`` between, two
    pairs of its letters, only wildcards, and two spellings that are rejected."""
    n = table(spark, sf_dir, "nation")
    name, size = F.col("n_name"), F.length("n_name")
    kinds = [F.lower(name), F.concat(F.substring(name, 1, 2), F.lit("_"), F.expr("substring(n_name, 4)")),
             F.concat(F.substring(name, 1, 2), F.lit("%"), F.expr("right(n_name, 2)")), F.substring(name, 1, 2), F.lower(F.substring(name, 2, 2)),
             F.repeat(F.lit("_"), F.col("n_nationkey") + 16), F.concat(name, F.lit("-x-1")), F.concat(F.lit("no word-"), size.cast("string")),
             F.concat(F.lit("#0000"), F.col("n_nationkey").cast("string"), F.lit("%")), F.concat(F.lit("back\\"), name)]
    terms = F.array(*[F.struct((F.lit(100 * i) + F.col("n_nationkey")).alias("term_id"), k.alias("term")) for i, k in enumerate(kinds)])
    return n.select(F.inline(terms))


def review_extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One extension per questionnaire of ``order_reviews``: a block after line 1 with a note and a tip on line 1's answer."""
    def item(kind, name, text, cond=None, **more):
        fields = {"type": kind, "id": name, "text": text, "cond": cond, **more}
        return F.struct(*[F.lit(v).cast("string").alias(k) if not hasattr(v, "alias") else v.alias(k) for k, v in fields.items()])

    inside = F.array(item("line", "note", "Reviewer note"), item("tip", "check", "Look at line 1", "q1/value"))
    block = item("block", "review", "Review", "^l1", insertAfter="l1", items=inside)
    doc = F.struct(F.lit(1).alias("version"), F.lit("ext").alias("namespace"), F.array(block).alias("extensions"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey").distinct()
    return lines.select(_qid("T", "l_orderkey").alias("template_id"), F.lit(0).alias("apply_order"), F.to_json(doc).alias("text"))


def reviewed_log(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """``(log, commands)`` from events: signups and views save, clicks and purchases are status commands, errors delete commands."""
    log = submission_log(spark, sf_dir)
    save = F.col("app_champion").isin("signup", "view")
    commands = log.where(~save).select("qid", F.when(F.col("app_champion") == "error", "delete").otherwise("status").alias("command"),
                                       F.when(F.col("app_champion") == "purchase", "a").otherwise("r").alias("status"),
                                       F.concat(F.lit("reviewer"), (F.col("seq") % 3).cast("string")).alias("user"), "event_ts", "seq")
    return log.where(save), commands
