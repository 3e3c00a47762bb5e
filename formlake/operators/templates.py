"""Template processing: normalise, flatten, check.

A template is a recursive JSON tree. Spark has no recursive types, so ``flatten_templates``
parses one level at a time in a fold within the template's row and keeps what lies deeper as raw
text for the next round, so nesting has no limit. Item paths (array of positions) give the pre-order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from formlake.functions.text import DEFAULT_CHOICE_TEXT
from formlake import schemas
from formlake.schemas import GROUP_TYPES, ITEM, ITEM_JSON_FIELDS, KNOWN_TYPES, VALUE_TYPES
from formlake.session import computed_once, let


# ---------------------------------------------------------------------------
# Template text → JSON text
# ---------------------------------------------------------------------------
def normalize_template_text(text) -> Column:
    """Join ``" +`` string continuations, turn ``\\x`` escapes into ``\\u00`` and drop ``//`` lines.

    A newline is put in front first so that a comment on the very first line is dropped too.
    """
    t = F.concat(F.lit("\n"), text if isinstance(text, Column) else F.col(text))
    t = F.regexp_replace(t, r'" \+[ ]*\r?\n[ ]*"', "")
    t = F.regexp_replace(t, r"\\x", r"\\\\u00")
    t = F.regexp_replace(t, r"\n[ ]*//[^\r\n]*", "")
    return t


def read_templates(spark, path: str, recursive: bool = True) -> DataFrame:
    """One row per template file: ``(template_id, path, text)``."""
    from formlake.functions.text import template_id_from_path

    df = (spark.read.option("wholetext", "true").option("recursiveFileLookup", str(recursive).lower())
          .text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw")))
    return df.select(template_id_from_path("path").alias("template_id"), "path",
                     normalize_template_text("raw").alias("text"))


def templates_from_texts(spark, texts: dict[str, str]) -> DataFrame:
    """Small helper for tests and shipped templates: ``{template_id: json text}``."""
    rows = [(k, v) for k, v in texts.items()]
    df = spark.createDataFrame(rows, "template_id string, raw string")
    return df.select("template_id", normalize_template_text("raw").alias("text"))


# ---------------------------------------------------------------------------
# flatten
# ---------------------------------------------------------------------------
def _item_struct() -> StructType:
    """One item as written in JSON; nested ``items`` kept as raw JSON text."""
    return StructType([StructField(n, t) for n, t in ITEM_JSON_FIELDS] + [StructField("items", StringType())])


TOP_SCHEMA = StructType([StructField("version", IntegerType()), StructField("namespace", StringType()),
                         StructField("questionnaire", StringType()), StructField("extensions", StringType())])


def _item_id(x: Column, path: Column) -> Column:
    """Template id, or a stable generated one for blocks/infos/spacers written without id."""
    return F.coalesce(x["id"], F.concat(F.lit("_anon_"), F.array_join(path.cast("array<string>"), "_")))


_NULL_FIELDS = ["insertBefore", "insertAfter",
                "auth", "className", "severity", "why", "name", "todo", "customTitle", "default", "required",
                "inputType", "inputPattern", "inputTitle", "placeholder", "maxlength", "yes", "no", "defaultChoice"]


def _row(path: Column, item_id: Column, parent_id: Column, parent_type: Column, ancestors: Column, version: Column,
         x: Column | None, fields: list[str] | None = None, **over) -> Column:
    """One output row (struct) of the item table; with ``fields`` it has only these, after its path."""
    def g(name):
        if name in over:
            return over[name]
        return F.lit(None) if x is None else x[name]

    warn = over.get("warn_bool")
    if warn is None:
        warn = F.coalesce(F.lower(x["warn"]).isin("yes", "true"), F.lit(False))
    row = {
        "path": path, "version": version, "depth": F.size(path) - 1, "item_id": item_id,
        "parent_id": parent_id.cast("string"), "parent_type": parent_type.cast("string"),
        "ancestors": ancestors, "type": g("type").cast("string"),
        "text": g("text").cast("string"), "cond": g("cond").cast("string"),
        "auth": g("auth").cast("string"), "class_name": g("className").cast("string"),
        "warn": warn, "severity": g("severity").cast("string"),
        "why": g("why").cast("string"), "name": g("name").cast("string"),
        "todo": g("todo").cast("string"), "custom_title": g("customTitle").cast("string"),
        "default_value": g("default").cast("string"), "required": g("required").cast("boolean"),
        "input_type": g("inputType").cast("string"), "input_pattern": g("inputPattern").cast("string"),
        "input_title": g("inputTitle").cast("string"), "placeholder": g("placeholder").cast("string"),
        "maxlength": g("maxlength").cast("int"), "yes": g("yes").cast("string"),
        "no": g("no").cast("string"), "default_choice": g("defaultChoice").cast("boolean"),
        "is_choice": over.get("is_choice", F.lit(False)),
        "has_id": x["id"].isNotNull() if x is not None else F.lit(True),
        "insert_before": g("insertBefore").cast("string"),
        "insert_after": g("insertAfter").cast("string")}
    return F.struct(*[c.alias(n) for n, c in row.items() if fields is None or n == "path" or n in fields])


def _choice_rows(node: Column, fields: list[str] | None) -> Column:
    """One row per choice of a group, and the optional default choice."""
    x, path, version = node["x"], node["path"], node["version"]
    iid = _item_id(x, path)
    child_anc = F.concat(node["anc"], F.array(iid))
    choice_type = F.when(x["type"] == "checkgroup", "check").when(x["type"] == "radiogroup", "radio")
    no_maps = F.array().cast("array<map<string,string>>")
    conds = F.coalesce(x["choicesConds"], no_maps)
    nulls = {f: F.lit(None) for f in _NULL_FIELDS}

    def choice_row(c, j):
        key = F.map_keys(c)[0]
        cond = F.try_element_at(F.filter(conds, lambda cc: F.map_contains_key(cc, key)), F.lit(1))[key]
        return _row(F.concat(path, F.array(j)), key, iid, x["type"], child_anc, version, None, fields, type=choice_type,
                    text=F.map_values(c)[0], cond=cond, is_choice=F.lit(True), warn_bool=F.lit(False), **nulls)

    choices = F.transform(F.coalesce(x["choices"], no_maps), choice_row)
    n = F.size(F.coalesce(x["choices"], no_maps))
    none_row = _row(F.concat(path, F.array(n)), F.concat(iid, F.lit("_none")), iid, x["type"], child_anc, version, None, fields,
                    type=choice_type, text=F.lit(DEFAULT_CHOICE_TEXT), cond=F.lit(None), is_choice=F.lit(True),
                    warn_bool=F.lit(False), **nulls)
    return F.concat(choices, F.filter(F.array(none_row), lambda r: F.coalesce(x["defaultChoice"], F.lit(False))))


def _rows_of_items(nodes: Column, fields: list[str] | None = None) -> Column:
    """The nodes' items themselves, and (for groups) their choices, in order."""
    items = F.transform(nodes, lambda n: _row(n["path"], _item_id(n["x"], n["path"]), n["pid"], n["ptype"], n["anc"], n["version"], n["x"], fields))
    groups = F.filter(nodes, lambda n: n["x"]["type"].isin(*GROUP_TYPES.keys()))
    choices = F.flatten(F.transform(groups, lambda n: _choice_rows(n, fields)))
    return F.sort_array(F.concat(items, choices))


def _children(node: Column) -> Column:
    """The items right below a node, as nodes; their text is parsed here, one level."""
    x = node["x"]
    iid = _item_id(x, node["path"])
    # parsed as a property, so that odd values are treated as those of any other property
    kids = F.from_json(F.concat(F.lit('{"items":'), x["items"], F.lit("}")), StructType([StructField("items", ArrayType(_item_struct()))]))["items"]
    return _nodes(kids, node["version"], node["path"], iid, x["type"], F.concat(node["anc"], F.array(iid)))


def _nodes(items: Column, version: Column, path: Column, pid: Column, ptype: Column, anc: Column) -> Column:
    kept = F.coalesce(items, F.array().cast(ArrayType(_item_struct())))
    return F.transform(kept, lambda x, i: F.struct(
        version.alias("version"), F.concat(path, F.array(i)).alias("path"), pid.alias("pid"), ptype.alias("ptype"), anc.alias("anc"), x.alias("x")))


_NODES = StructType([StructField("version", IntegerType()), StructField("path", ArrayType(IntegerType())), StructField("pid", StringType()),
                     StructField("ptype", StringType()), StructField("anc", ArrayType(StringType())), StructField("x", _item_struct())])


_KIDS = StructType([StructField("items", ArrayType(StructType([StructField("items", StringType())])))])
_SHALLOW = 4


def _depth(lists: Column) -> Column:
    """How many levels the item lists (JSON texts) have, and one more. Only this fold goes on for as many rounds
    as the texts have room for, as its state is empty after the last level."""
    def below(s, _):
        kids = F.filter(F.flatten(F.transform(s["open"], lambda x: F.coalesce(
            F.from_json(F.concat(F.lit('{"items":'), x, F.lit("}")), _KIDS)["items"]["items"], F.array().cast("array<string>")))), lambda x: x.isNotNull())
        return F.when(F.size(s["open"]) == 0, s).otherwise(F.struct(kids.alias("open"), (s["n"] + 1).alias("n")))

    # a level takes at least the twelve characters of {"items":[]}
    most = (F.coalesce(F.array_max(F.transform(lists, F.length)), F.lit(0)) / 12).cast("int") + 2
    return F.aggregate(F.sequence(F.lit(1), most), F.struct(lists.alias("open"), F.lit(1).alias("n")), below, lambda s: s["n"])


def _all_nodes(top: Column) -> Column:
    """The nodes of the templates whose top items are ``top``, on all levels.

    The upper levels are looked at one after the other; only for templates that go deeper their depth is counted and
    the rest is a fold, a round of which copies the nodes found so far.
    """
    below = lambda nodes: F.flatten(F.transform(nodes, _children))

    def deeper(s, _):
        return F.struct(F.concat(s["nodes"], s["open"]).alias("nodes"), below(s["open"]).alias("open"))

    def rest(nodes, left):
        lists = F.filter(F.transform(left, lambda node: node["x"]["items"]), lambda x: x.isNotNull())
        start = F.struct(nodes.alias("nodes"), left.alias("open"))
        more = F.aggregate(F.sequence(F.lit(1), let(lists, _depth)), start, deeper, lambda s: s["nodes"])
        return F.when(F.size(left) == 0, nodes).otherwise(more)

    def level(n, nodes, left):
        if n == _SHALLOW:
            return rest(nodes, left)
        return F.when(F.size(left) == 0, nodes).otherwise(let(below(left), lambda kids: level(n + 1, F.concat(nodes, left), kids)))

    return let(top.cast(ArrayType(_NODES)), lambda nodes: let(below(nodes), lambda kids: level(1, nodes, kids)))


def texts_by_template(templates: DataFrame) -> DataFrame:
    """``(template_id, texts)``: a row per template with all its texts, null ones too, in the order of the ids within a partition.

    The rows are sorted while they are small, so that joins by template id need not sort what is made of them.
    """
    return templates.groupBy("template_id").agg(F.collect_list(F.struct("text")).alias("texts")).sortWithinPartitions("template_id")


def rows_of_texts(texts: Column, field: str = "questionnaire", fields: list[str] | None = None) -> Column:
    """array of item rows (path first, which gives the order), in pre-order, of a template's ``texts``; no null texts."""
    schema = StructType([StructField("version", IntegerType()), StructField(field, ArrayType(_item_struct()))])
    none = F.array().cast("array<int>")
    nodes = F.flatten(F.transform(F.transform(texts, lambda text: F.from_json(text, schema)), lambda t: _nodes(
        t[field], t["version"], none, F.lit(None).cast("string"), F.lit(None).cast("string"), F.array().cast("array<string>"))))
    return let(_all_nodes(nodes), lambda found: _rows_of_items(found, fields))


def known_texts() -> Column:
    return F.filter(F.transform("texts", lambda t: t["text"]), lambda text: text.isNotNull())


def flatten_templates(templates: DataFrame, field: str = "questionnaire", materialize: bool = False, ordinals: bool = True, in_rows: bool = False,
                      fields: list[str] | None = None) -> DataFrame:
    """F1 + F10: ITEM rows (see ``schemas.ITEM``) plus ``has_id``/``path`` columns, for any nesting.

    ``templates`` has ``template_id`` and ``text`` (normalised JSON). A template is flattened within its row:
    a fold parses one level a round, until no items are left, and the rows' paths give the pre-order. Nothing
    is materialised and no job is run. Texts are brought together by template id first, as texts of one id share
    their ordinals; rows stay with their template from there on, so grouping by template moves no items.
    ``materialize`` writes the rows to the checkpoint folder, which no operator here needs. With ``in_rows`` a template
    stays one row ``(template_id, items)``, its items in order, which the operators on whole templates take as well
    (``by_template``) and need not bring together again; ``fields`` are the properties that its items are to have there, if not all.
    """
    from formlake.session import cut_lineage

    one = texts_by_template(templates).select("template_id", computed_once(known_texts()).alias("texts"))
    one = one.select("template_id", computed_once(rows_of_texts(F.col("texts"), field, fields if in_rows else None)).alias("items"))
    if in_rows:
        return one.where(F.size("items") > 0)
    out = one.select("template_id", F.posexplode("items").alias("ordinal", "row"))
    out = out.select("template_id", "ordinal" if ordinals else F.lit(None).cast("int").alias("ordinal"), "row.*")
    out = out.select(*[c.name for c in ITEM.fields], "has_id", "path", "insert_before", "insert_after")
    return cut_lineage(out) if materialize else out


def by_template(items: DataFrame, fields: list[str]) -> DataFrame:
    """One row per template ``(template_id, items)``: its items in order, as structs with ``fields`` among others. ``items`` are a
    table of items or come ``in_rows`` from ``flatten_templates``."""
    if "items" in items.columns:
        return items.select("template_id", "items")
    one = items.groupBy("template_id").agg(F.collect_list(F.struct("ordinal", *fields)).alias("items"))
    return one.withColumn("items", computed_once(F.sort_array("items")))


# ---------------------------------------------------------------------------
# Checks → (template_id, item_id, rule, detail)
# ---------------------------------------------------------------------------
def root_issues(templates: DataFrame) -> DataFrame:
    """exactly one root, a block with items; also unparseable templates.

    The texts are brought together by template id as for flattening, so a job that does both reads them once.
    """
    t = texts_by_template(templates).select("template_id", F.explode("texts.text").alias("text"))
    t = t.select("template_id", F.from_json("text", TOP_SCHEMA).alias("t"))
    q = F.from_json(F.col("t.questionnaire"), ArrayType(_item_struct()))
    detail = (F.when(F.col("t").isNull() | q.isNull(), "template is not valid JSON with a questionnaire")
              .when(F.size(q) != 1, F.concat(F.lit("expected one root item, found "), F.size(q).cast("string")))
              .when(q[0]["type"] != "block", "root item must be a block")
              .when(q[0]["items"].isNull(), "root block has no items"))
    return (t.select("template_id", F.lit(None).cast("string").alias("item_id"), F.lit("root").alias("rule"),
                     detail.alias("detail")).where(F.col("detail").isNotNull()))


ISSUE_FIELDS = ["item_id", "type", "text", "is_choice", "has_id", "yes", "no", "default_choice", "auth", "class_name", "severity", "warn"]


def item_issues(items: DataFrame) -> DataFrame:
    """F3 unknown type, F4 duplicate ids, F5 missing id, F12 property rules (every broken one)."""
    one = by_template(items, ISSUE_FIELDS).withColumn("again", computed_once(repeated_ids("items")))
    rows = one.select("template_id", "again", F.posexplode("items").alias("i", "x"))
    return findings_of(rows, rules_of_item(F.col("x")), F.when(F.col("i") == 0, F.col("again")))


def findings_of(rows: DataFrame, *found: Column) -> DataFrame:
    """The findings (arrays, with nulls in between) of rows with ``template_id``."""
    none = F.array().cast("array<struct<item_id:string,rule:string,detail:string>>")
    return rows.select("template_id", F.inline(F.concat(*[F.coalesce(f, none) for f in found]))).where(F.col("rule").isNotNull())


def rules_of_item(x: Column) -> Column:
    """F3, F5, F12 on one item: its findings, null for the rules that it keeps."""
    return F.array(*[F.when(broken, finding(x["item_id"], rule, detail)) for broken, rule, detail in row_rules(lambda name: x[name])])


def finding(item_id: Column, rule, detail: Column) -> Column:
    rule = rule if isinstance(rule, Column) else F.lit(rule)
    return F.struct(item_id.alias("item_id"), rule.alias("rule"), detail.cast("string").alias("detail"))


def repeated_ids(items) -> Column:
    """ids that a template uses more than once, from its ids in order."""
    used = F.sort_array(F.transform(F.filter(items, lambda x: x["has_id"]), lambda x: F.struct(x["item_id"].alias("id"), x["is_choice"].alias("choice"))))

    def of(ids):
        starts = F.filter(F.transform(ids, lambda x, i: F.when((i == 0) | ~F.get(ids, i - 1)["id"].eqNullSafe(x["id"]), i)), lambda i: i.isNotNull())

        def runs(starts):
            n = lambda i, k: F.coalesce(F.get(starts, k + 1), F.size(ids)) - i
            return F.filter(F.transform(starts, lambda i, k: F.when(n(i, k) > 1, finding(
                F.get(ids, i)["id"], duplicate_rule(F.exists(F.slice(ids, i + 1, n(i, k)), lambda x: x["choice"])), n(i, k)))), lambda f: f.isNotNull())

        return let(starts, runs)

    ids = F.transform(items, lambda x: x["item_id"])
    none = F.array().cast("array<struct<item_id:string,rule:string,detail:string>>")
    return let(ids, lambda all_ids: F.when(F.size(F.array_distinct(all_ids)) == F.size(all_ids), none).otherwise(let(used, of)))


def duplicate_rule(choice: Column) -> Column:
    return F.when(choice, "duplicate_choice_id").otherwise("duplicate_id")


def row_rules(of) -> list[tuple[Column, str, Column]]:
    """(broken, rule, detail) for the rules that need one item only; ``of(name)`` is a column of the item."""
    t = of("type")
    no_text = (t.isin(*VALUE_TYPES) & ~of("is_choice") & (F.coalesce(of("text"), F.lit("")) == "")
               | t.isin("block", "info") & of("text").isNull())
    hidden = schemas.INVISIBLE_CLASS
    broken = [
        (no_text, "text is mandatory"),
        ((t == "yesno") & (of("yes").isNull() | of("no").isNull()), "yes and no are mandatory"),
        (t.isin(*GROUP_TYPES.keys()) & of("default_choice").isNull(), "defaultChoice is mandatory"),
        (of("auth") != "admin", "auth must be admin"),
        (of("class_name") != hidden, f"className must be {hidden}"),
        (~of("severity").isin("medium", "high", "critical"), "severity must be medium, high or critical"),
        (of("severity").isNotNull() & ~of("warn"), "severity needs warn=yes")]

    return [(~F.coalesce(t, F.lit("")).isin(*KNOWN_TYPES), "unknown_type", t),
            (t.isin(*VALUE_TYPES) & ~of("has_id") & ~of("is_choice"), "missing_id", t),
            *[(cond, "property", F.lit(detail)) for cond, detail in broken]]


def siblings(items: DataFrame) -> DataFrame:
    """Previous and next item in the same container."""
    from pyspark.sql import Window

    w = Window.partitionBy("template_id", "parent_id").orderBy("ordinal")
    return items.select("template_id", "item_id", "parent_id",
                        F.lag("item_id").over(w).alias("previous_id"), F.lead("item_id").over(w).alias("next_id"))
