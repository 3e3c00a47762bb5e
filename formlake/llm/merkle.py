"""Merkle manifest of a dataset by time-forward processing.

Every row is a leaf; per source, leaves in id order form a tree of ``ARITY`` children a node, and the
sources' subroots, in source order, form one more. A node's label is (last leaf below it, level):
in that order every child comes before its parent. A forward sweep reads leaves in label order, and a
priority queue keyed by label delivers each digest to its parent; a reversed sweep, in descending
order, delivers every node the proof of its parent preceded by its own siblings, down to the leaves.

Between tasks Spark's sorted shuffle is that queue: a tree is cut into blocks of ``ARITY ** levels``
consecutive nodes, which hold whole subtrees, and what leaves a block (one digest up, one proof down)
is delivered to the block above or below in the next round. In a task the queue holds at most
``ARITY`` messages a level, as labels close a subtree before the next one starts.
"""

from __future__ import annotations

import heapq
from binascii import hexlify, unhexlify
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_table, table

ARITY = 3
BLOCK_LEVELS = 7   # a block holds 3^7 = 2,187 consecutive nodes and the levels above them
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_digest(fields: list[Column]) -> Column:
    """SHA-256 of the fields, each ``-`` if null, else its UTF-8 byte count, ``:`` and its value."""
    parts = []
    for field in fields:
        value = field.cast("string")
        parts.append(F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)))
    return F.unhex(F.sha2(F.concat(*parts), 256))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (tree, ...) with idx, its place among the tree's rows in the given order, and n, their number.

    Rows are range-partitioned and sorted; only a row for each (partition, tree) is added up.
    """
    keys = ["tree", *order]
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id())
    placed = table(ranged.withColumn("part", F.shiftright("at", 33)), "merkle-ordered")
    parts = placed.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("rows"), F.min("at").alias("first"))
    tree = Window.partitionBy("tree")
    before = tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("tree", "part", (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first")).alias("shift"),
                         F.sum("rows").over(tree).alias("n"))
    return placed.join(parts, ["tree", "part"]).withColumn("idx", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def _label(level: int, idx: int, n: int, power: list[int]) -> tuple[int, int]:
    return min((idx + 1) * power[level], n) - 1, level


def _columns(batch: pa.RecordBatch) -> list[list]:
    return [batch.column(i).to_pylist() for i in range(batch.num_columns)]


RUN = "tree string, n long, block long, level int, idx long, end long, children binary, digest binary"


def _forward(levels: int, arity: int):
    """Per block, its inner nodes: the digests that each received, and the own digest of the block's top."""
    names = [f.split()[0] for f in RUN.split(", ")]
    types = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]

    def run(batches):
        power = [arity ** k for k in range(levels + 1)]
        here, queue, out = None, [], []
        for batch in batches:
            for tree, n, block, idx, digest in zip(*_columns(batch)):
                if (tree, block) != here:
                    if queue:
                        raise RuntimeError("a message was sent past the end of its block")
                    here = tree, block
                # the leaf sends its digest to its parent; then all whose children are complete do
                heapq.heappush(queue, (*_label(1, idx // arity, n, power), idx, hexlify(digest)))
                while queue and queue[0][0] == idx:
                    end, level = queue[0][:2]
                    received = []
                    while queue and queue[0][:2] == (end, level):
                        received.append(heapq.heappop(queue))
                    parent = received[0][2] // arity
                    children = b"".join(r[3] for r in received)
                    own = sha256(children).digest()
                    top = level == levels or power[level] >= n
                    out.append((tree, n, block, level, parent, end, unhexlify(children), own if top else None))
                    if not top:
                        heapq.heappush(queue, (*_label(level + 1, parent // arity, n, power), parent, hexlify(own)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * len(types), types)], names=names)
            out = []
        if queue:
            raise RuntimeError("a message was sent past the end of its block")

    return run


PROOF = "tree string, idx long, doc_id long, digest binary, subroot string, proof string, folded string"


def _backward(levels: int, arity: int):
    """Per block, every leaf's proof: levels ended by ``;``, each the siblings before, ``.``, the siblings behind."""
    names = [f.split()[0] for f in PROOF.split(", ")]
    types = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.string(), pa.string()]

    def flush(out):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * len(types), types)], names=names)

    def fold(leaf: str, proof: str) -> str:
        for step in proof.split(";")[:-1]:
            left, right = step.split(".")
            leaf = sha256((left + leaf + right).encode()).hexdigest()
        return leaf

    def run(batches):
        power = [arity ** k for k in range(levels + 1)]
        here, queue, out, subroot = None, [], [], None
        for batch in batches:
            for tree, block, end, level, n, idx, digest, doc_id, presented, proof, root in zip(*_columns(batch)):
                if proof is not None:  # what the block above delivers to this block's top
                    if queue:
                        raise RuntimeError("a proof did not reach its node")
                    top = next(k for k in range(levels + 1) if k == levels or power[k] >= n)
                    last, k = _label(top, block if top == levels else 0, n, power)
                    here, subroot, queue = (tree, block), root, [(-last, -k, proof)]
                    continue
                if not queue or (tree, block) != here or queue[0][:2] != (-end, -level):
                    raise RuntimeError("a node received no proof")
                mine = heapq.heappop(queue)[2]
                if level == 0:
                    shown = digest if presented is None else presented
                    out.append((tree, idx, doc_id, digest, subroot, mine, fold(shown.hex(), mine)))
                    if len(out) >= 2000:
                        yield flush(out)
                        out = []
                    continue
                children = [digest[i:i + 32].hex() for i in range(0, len(digest), 32)]
                for i in range(len(children)):
                    last, k = _label(level - 1, idx * arity + i, n, power)
                    heapq.heappush(queue, (-last, -k, "".join(children[:i]) + "." + "".join(children[i + 1:]) + ";" + mine))
        if queue:
            raise RuntimeError("a proof did not reach its node")
        yield flush(out)

    return run


def _climb(nodes: DataFrame, levels: int, arity: int) -> tuple[list[tuple[DataFrame, DataFrame]], DataFrame]:
    """Forward sweeps until every tree has one node: the (nodes, inner nodes) of each round, and (tree, digest) of the tops."""
    width, rounds, tops = arity ** levels, [], []
    while True:
        nodes = nodes.withColumn("block", F.floor(F.col("idx") / width).cast("long"))
        runs = table(nodes.where("n > 1").select("tree", "n", "block", "idx", "digest").repartition("tree", "block")
                     .sortWithinPartitions("tree", "block", "idx").mapInArrow(_forward(levels, arity), RUN), "merkle-runs")
        rounds.append((nodes, runs))
        tops += [nodes.where("n = 1").select("tree", "digest"),
                 runs.where((F.col("n") <= width) & F.col("digest").isNotNull()).select("tree", "digest")]
        above = runs.where((F.col("n") > width) & F.col("digest").isNotNull())
        if above.isEmpty():
            break
        nodes = above.select("tree", F.ceil(F.col("n") / width).cast("long").alias("n"), "idx", "digest",
                             F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("binary").alias("presented"))
    heads = tops[0]
    for more in tops[1:]:
        heads = heads.unionByName(more)
    return rounds, heads


def _deliver(rounds: list[tuple[DataFrame, DataFrame]], proofs: DataFrame, levels: int, arity: int) -> DataFrame:
    """Reversed sweeps from the trees' tops, whose (tree, proof, subroot) is given, to every leaf."""
    width, none = arity ** levels, F.lit(None)
    below = None
    for depth in reversed(range(len(rounds))):
        nodes, runs = rounds[depth]
        sizes = nodes.where("idx = 0").select("tree", "n")
        heads = sizes.where(F.col("n") <= width).join(proofs, "tree").select("tree", F.lit(0).cast("long").alias("block"), "n", "proof", "subroot")
        if below is not None:  # the tops of this round's blocks are the nodes of the round above
            heads = heads.unionByName(below.join(sizes, "tree").select("tree", F.col("idx").alias("block"), "n", "proof", "subroot"))
        long, binary = none.cast("long"), none.cast("binary")
        columns = ["tree", "block", "end", "level", "n", "idx", "digest", "doc_id", "presented", "proof", "subroot"]
        sent = heads.select("tree", "block", F.lit(2**62).alias("end"), F.lit(0).alias("level"), "n", long.alias("idx"), binary.alias("digest"),
                            long.alias("doc_id"), binary.alias("presented"), "proof", "subroot")
        inner = runs.select("tree", "block", "end", "level", "n", "idx", F.col("children").alias("digest"), long.alias("doc_id"),
                            binary.alias("presented"), none.cast("string").alias("proof"), none.cast("string").alias("subroot"))
        leaves = nodes.select("tree", "block", F.col("idx").alias("end"), F.lit(0).alias("level"), "n", "idx", "digest", "doc_id", "presented",
                              none.cast("string").alias("proof"), none.cast("string").alias("subroot"))
        found = (sent.unionByName(inner).unionByName(leaves).select(columns).repartition("tree", "block")
                 .sortWithinPartitions("tree", "block", F.desc("end"), F.desc("level")).mapInArrow(_backward(levels, arity), PROOF))
        below = table(found.select("tree", "idx", "proof", "subroot"), "merkle-proofs") if depth else found
    return below


def merkle_manifest(docs: DataFrame, *, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", source_col: str = "source",
                    shown: dict[str, Column] | None = None, levels: int = BLOCK_LEVELS, arity: int = ARITY) -> DataFrame:
    """Per row of ``docs``: doc_id, leaf, subroot, root, proof, folded_root, verified; digests as lowercase hex.

    ``shown`` replaces fields by the values that are presented for checking; folded_root is what their
    leaf and the proof give, verified whether that is the root. Without it every row verifies.

    Nulls are hashed as ``-`` and so differ from empty texts; a null source is a tree of its own, the
    first; null ids come first in their tree. Rows of equal id, equal rows included, are leaves of
    their own in the order of their digests. A very long text is hashed whole by Spark and does not
    travel. An empty table gives no rows. Columns other than the named ones are not read.
    """
    spark = docs.sparkSession
    values = {name: F.col(name) for name in fields}
    rows = docs.select(F.when(F.col(source_col).isNull(), "").otherwise(F.concat(F.lit("+"), F.col(source_col).cast("string"))).alias("tree"),
                       F.col(id_col).cast("long").alias("doc_id"), leaf_digest(list(values.values())).alias("digest"),
                       leaf_digest(list((values | (shown or {})).values())).alias("presented"))
    rows = table(rows.withColumn("presented", F.when(F.col("presented") != F.col("digest"), F.col("presented"))), "merkle-leaves")
    nodes = numbered(rows, ["doc_id", "digest", "presented"])
    rounds, heads = _climb(nodes, levels, arity)
    drop_table(rows)
    heads = table(heads, "merkle-subroots")
    single = heads.select(F.lit("").alias("tree"), F.concat(F.lit("+"), "tree").alias("name"), "digest",
                          F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("binary").alias("presented"))
    upper, top = _climb(numbered(single, ["name"]), levels, arity)
    root = top.select(F.lower(F.hex("digest"))).first()
    if root is None:
        return spark.createDataFrame([], "doc_id long, leaf string, subroot string, root string, proof string, folded_root string, verified boolean")
    # a subroot's place among the subroots leads back to its tree
    names = upper[0][0].select("idx", F.expr("substring(name, 2)").alias("of"))
    proofs = _deliver(upper, spark.createDataFrame([("", "", "")], "tree string, proof string, subroot string"), levels, arity)
    proofs = table(proofs.select("idx", "digest", "proof").join(names, "idx").select(
        F.col("of").alias("tree"), "proof", F.lower(F.hex("digest")).alias("subroot")), "merkle-tops")
    root = F.lit(root[0])
    return _deliver(rounds, proofs, levels, arity).select(
        "doc_id", F.lower(F.hex("digest")).alias("leaf"), "subroot", root.alias("root"), "proof", F.col("folded").alias("folded_root"),
        (F.col("folded") == root).alias("verified"))


def proof_digests(proof: Column) -> Column:
    """A proof's sibling digests alone, one after the other."""
    return F.translate(proof, ".;", "")


_TREE = """{up} AS (SELECT tree, 0 AS level, idx, digest, n FROM {leaves} UNION ALL
  SELECT tree, level + 1, idx // 3, sha256(string_agg(digest, '' ORDER BY idx)), (max(n) + 2) // 3 FROM {up} WHERE n > 1 GROUP BY tree, level, idx // 3),
{sib} AS (SELECT a.tree, a.level, a.idx, coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS l,
              coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS r
       FROM {up} a LEFT JOIN {up} b ON a.tree = b.tree AND a.level = b.level AND a.idx // 3 = b.idx // 3 AND a.idx <> b.idx
       WHERE a.n > 1 GROUP BY ALL),
{walk} AS (SELECT tree, leaf, 0 AS level, idx, '' AS proof, shown AS folded FROM {starts} UNION ALL
  SELECT w.tree, w.leaf, w.level + 1, w.idx // 3, w.proof || s.l || s.r, sha256(s.l || w.folded || s.r)
  FROM {walk} w JOIN {sib} s ON w.tree = s.tree AND w.level = s.level AND w.idx = s.idx),
{end} AS (SELECT * FROM {walk} QUALIFY row_number() OVER (PARTITION BY tree, leaf ORDER BY level DESC) = 1)"""


def _digest_sql(text: str) -> str:
    def part(c):
        return f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"

    return "sha256(" + " || ".join(part(text if c == "text" else c) for c in FIELDS) + ")"


# DuckDB SQL of the registered query: arity 3, text shown without line feeds where 2 divides the id's CRC-32
MERKLE_SQL = f"""
WITH RECURSIVE c AS (SELECT *, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))) AS crc FROM documents),
l AS (SELECT doc_id, CASE WHEN source IS NULL THEN '' ELSE '+' || source END AS tree, {_digest_sql("text")} AS digest,
             {_digest_sql("(CASE WHEN (4294967295 - crc) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END)")} AS shown FROM c),
leaves AS (SELECT *, row_number() OVER w - 1 AS idx, row_number() OVER w - 1 AS leaf, count(*) OVER (PARTITION BY tree) AS n
           FROM l WINDOW w AS (PARTITION BY tree ORDER BY doc_id NULLS FIRST, digest, shown)),
{_TREE.format(up="up", leaves="leaves", sib="sib", walk="walk", starts="leaves", end="ends")},
subroots AS (SELECT 't' AS tree, tree AS name, digest, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n FROM up WHERE n = 1),
starts AS (SELECT s.tree, e.tree || ' ' || e.leaf AS leaf, s.idx, e.folded AS shown FROM ends e JOIN subroots s ON e.tree = s.name),
{_TREE.format(up="up2", leaves="subroots", sib="sib2", walk="walk2", starts="starts", end="ends2")},
root AS (SELECT digest AS root FROM up2 WHERE n = 1)
SELECT v.doc_id, v.digest AS leaf, s.digest AS subroot, root, sha256(e.proof || f.proof) AS proof_sha256, f.folded AS folded_root, f.folded = root AS verified
FROM leaves v JOIN ends e ON v.tree = e.tree AND v.leaf = e.leaf JOIN ends2 f ON f.leaf = v.tree || ' ' || v.leaf
JOIN subroots s ON s.name = v.tree, root"""
