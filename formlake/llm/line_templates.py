"""Line dedup with a log-template tree, in DataFrame functions only.

A line's path in the tree is fixed: its token count, then its leading tokens, with tokens that
hold a digit generalised. Lines of one leaf share that path; in a leaf a token value that recurs at
its position in enough documents is a constant, any other is a variable field. The line's constants
and fields are its template, and lines whose template recurs in enough documents are dropped.
Leaves that cannot hold such a template are left before any token is looked at.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

LEAD = 2            # leading tokens that make the path
MIN_DOCS = 10       # documents in which a template, and a constant, must occur
MIN_CONSTANT = 0.5  # share of a template's tokens that must be constants
FIELD = "<*>"


def _spaced(line: F.Column) -> F.Column:
    """The line's tokens joined by one space; what costs a look at every character runs only where it changes something."""
    odd = reduce(F.Column.__or__, [line.contains(c) for c in "\t\x0b\f\r"])
    plain = F.when(odd, F.translate(line, "\t\x0b\f\r", "    ")).otherwise(line)
    return F.trim(F.when(plain.contains("  "), F.regexp_replace(plain, " {2,}", " ")).otherwise(plain))


def _general(token: F.Column) -> F.Column:
    return F.when(token.rlike("[0-9]"), FIELD).otherwise(token)


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, row, pos, line, leaf) of every line with a token, spaced evenly; (doc_id, row) names a row's text."""
    lines = docs.select("doc_id", "row", F.posexplode(F.split("text", "\n")).alias("pos", "line")).select(
        "doc_id", "row", "pos", _spaced(F.col("line")).alias("line")).where("line <> ''")
    lines = lines.select("*", (F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "), F.lit(""))) + 1).alias("n"),
                         F.split(F.substring_index("line", " ", LEAD), " ").alias("lead"))
    lead = [_general(F.get("lead", F.lit(i))) for i in range(LEAD)]  # null where a line is shorter
    return lines.select("doc_id", "row", "pos", "line", F.concat_ws(" ", F.col("n").cast("string"), *lead).alias("leaf"))


def recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, row, pos) of the lines whose template recurs in at least ``min_docs`` documents."""
    lines = lines_of(docs)
    leaves = (lines.select("leaf", "doc_id", "row").distinct().groupBy("leaf").count()
              .where(F.col("count") >= min_docs).select("leaf"))
    busy = table(lines.join(leaves, "leaf"), "busy-lines")
    tokens = busy.select("leaf", "doc_id", "row", "pos", F.posexplode(F.split("line", " ")).alias("i", "token"))
    constants = (tokens.select("leaf", "i", "token", "doc_id", "row").distinct().groupBy("leaf", "i", "token").count()
                 .where(F.col("count") >= min_docs).select("leaf", "i", "token", F.lit(True).alias("constant")))
    fields = tokens.join(constants, ["leaf", "i", "token"], "left").groupBy("doc_id", "row", "pos", "leaf").agg(
        F.sort_array(F.collect_set(F.struct("i", F.when(F.col("constant"), F.col("token")).otherwise(FIELD).alias("t")))).alias("f"),
        F.avg(F.coalesce("constant", F.lit(False)).cast("double")).alias("share"))
    templates = table(fields.where(F.col("share") >= MIN_CONSTANT).select(
        "doc_id", "row", "pos", F.concat_ws(" ", F.size("f").cast("string"), F.array_join("f.t", " ")).alias("template"), "leaf"), "templates")
    recurring = (templates.select("leaf", "template", "doc_id", "row").distinct().groupBy("leaf", "template").count()
                 .where(F.col("count") >= min_docs).select("leaf", "template"))
    return templates.join(recurring, ["leaf", "template"], "left_semi").select("doc_id", "row", "pos")


def drop_template_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """Per row of ``docs``: doc_id, n_lines, n_dropped, text (the kept lines joined by line feeds).

    A null text is empty; an empty text is one empty line. Lines without tokens are kept and count
    for nothing. Equal rows count as one document and lose the same lines; a null id is an id like
    any other. The hot leaf or template is a counted group, summed before the shuffle.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("row", F.xxhash64("doc_id", "text"))
    gone = recurring_lines(rows, min_docs).groupBy(F.col("doc_id").alias("d"), F.col("row").alias("r")).agg(
        F.collect_set("pos").alias("gone"))
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda line, i: ~F.array_contains("gone", i)), "\n")
    return rows.join(gone, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("row") == F.col("r")), "left").select(
        "doc_id", F.size(F.split("text", "\n")).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"), F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("text"))


LINES_SQL = f"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                  unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
t AS (SELECT doc_id, pos, list_filter(regexp_split_to_array(line, '[ \\t\\x0B\\f\\r]+'), lambda x: x <> '') AS tokens FROM l),
f AS (SELECT doc_id, pos, tokens, len(tokens) || ' ' || array_to_string(list_transform(tokens[1:{LEAD}],
             lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '{FIELD}' ELSE x END), ' ') AS leaf FROM t WHERE len(tokens) > 0),
b AS (SELECT f.* FROM f JOIN (SELECT leaf FROM f GROUP BY leaf HAVING count(DISTINCT doc_id) >= {MIN_DOCS}) USING (leaf)),
w AS (SELECT doc_id, pos, leaf, unnest(tokens) AS token, unnest(range(len(tokens))) AS i FROM b),
c AS (SELECT leaf, i, token FROM w GROUP BY ALL HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
m AS (SELECT w.doc_id, w.pos, w.leaf, string_agg(coalesce(c.token, '{FIELD}'), ' ' ORDER BY w.i) AS template,
             avg((c.token IS NOT NULL)::INT) AS share
      FROM w LEFT JOIN c ON w.leaf = c.leaf AND w.i = c.i AND w.token = c.token GROUP BY 1, 2, 3),
n AS (SELECT * FROM m WHERE share >= {MIN_CONSTANT}),
g AS (SELECT n.doc_id, n.pos FROM n JOIN (SELECT leaf, template FROM n GROUP BY ALL HAVING count(DISTINCT doc_id) >= {MIN_DOCS}) USING (leaf, template))
SELECT l.doc_id, count(*) AS n_lines, count(g.pos) AS n_dropped,
       sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (g.pos IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id"""
