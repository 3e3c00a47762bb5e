"""MinHash near-dedup with an LSH forest.

Each text's set of 5-word shingles gets ``POOL`` min-hash values. A tree of the forest is one fixed
order of these values: sorting the signatures in that order puts texts with a long common prefix
next to each other, and all texts that share a prefix of some depth form a region. Texts that
share at least ``LADDER[0]`` leading values in some tree are candidates; where a region is dense
(more than ``REGION_ROWS`` rows) it is cut by the next, deeper prefix of ``LADDER``, so that sparse
regions stay shallow and dense ones grow deep. Within a region the sorted neighbours and all rows
with similar whole signatures are tied into a spanning forest; the forests of all trees give
clusters of candidates. In a cluster the links are decided on the full shingle sets.

Texts with equal sets are one class from the start (a group of exact copies is one row). A cluster
too large for a task is again cut into regions of adaptive depth, in every tree, and decided there;
besides, all its rows are compared with its centres, the rows nearest to the cluster's most
frequent signature values, as the copies of one text may be like that text alone.

Rows of a region too large for its limits at the shallowest depth are crowded: a linked pair of them may
agree in no deeper prefix. What the regions and centres left apart among them is settled exactly:
linked sets share one of their rarest shingles, and rows of different components that do are
compared on their full sets in blocks.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WordHashes, binary_column, components, giving_back, lower_words, shingles, table

POOL = 64
TREES = 24
LADDER = (3, 5, 8, 12, 18, 26)   # prefix lengths at which a region may be cut
REGION_ROWS = 1024               # rows of a region compared with one another
CLUSTER_ROWS = 4096              # rows and
CENTRES = 4                      # rows of a larger cluster that all its rows are compared with
CLUSTER_SHINGLES = 2_000_000     # shingles of a cluster decided in one task
PERCENT = 85                     # links: 100 * intersection >= PERCENT * union
BLOCK_ROWS = 1024                # rows of a block of crowded rows compared with one another
RARITY_BITS = 20                 # shingles are ordered by the count of their hash bucket, of so many bits
SLACK = 5.0                      # standard deviations below the threshold at which signatures still count as similar

_RNG = np.random.default_rng(7)
_A = _RNG.integers(1, 2**63, POOL, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 2**63, POOL, dtype=np.uint64)
ORDERS = np.array([np.random.default_rng(1000 + t).permutation(POOL)[:LADDER[-1]] for t in range(TREES)])


def signature(s: np.ndarray) -> np.ndarray:
    """POOL min-hash values (32 bits each) of a non-empty set of shingle hashes."""
    low = np.full(POOL, np.iinfo(np.uint64).max)
    for i in range(0, len(s), 2048):
        part = s[None, i:i + 2048] * _A[:, None] + _B[:, None]
        low = np.minimum(low, part.min(1))
    return (low >> np.uint64(32)).astype("<u4")


def similar_floor(percent: int = PERCENT) -> int:
    """Equal signature values below which a linked pair is practically never seen."""
    p = percent / 100
    return max(1, int(np.floor(POOL * p - SLACK * np.sqrt(POOL * p * (1 - p)))))


def _sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, set_id, sig); set_id is a 128-bit digest of the set, null if it is empty."""

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            counts, keys, sigs = [], [], []
            for blob in binary_column(batch, "text"):
                s = shingles(hashes.of(lower_words(blob)))
                counts.append(len(s))
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sigs.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(keys, pa.binary()),
                                              pa.array(sigs, pa.binary())], names=["doc_id", "n_shingles", "set_id", "sig"])

    return docs.mapInArrow(giving_back(run), "doc_id long, n_shingles long, set_id binary, sig binary")


def _prefix_keys(rows: DataFrame, depth: int) -> DataFrame:
    """(key, tree, rep, ...): a row per tree with the key of the signature's prefix of ``depth`` values."""

    def run(batches):
        weights = np.random.default_rng(77).integers(1, 2**63, depth, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u4").reshape(-1, POOL)
            for t in range(TREES):
                key = (sig[:, ORDERS[t][:depth]].astype(np.uint64) * weights).sum(1, dtype=np.uint64)
                key = (key ^ (key >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(t * 1000 + depth)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.full(len(key), t, np.int32)),
                                                  batch.column(0), batch.column(2)], names=["key", "tree", "rep", "n_shingles"])

    return rows.select("rep", "sig", "n_shingles").mapInArrow(run, "key long, tree int, rep long, n_shingles long")


def regions(members: DataFrame, rows_limit: int, shingles_limit: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(key, rep): regions of every tree within the limits, each at the depth that its density asks for.

    Also (rep) of the crowded rows, those of regions that the least depth leaves too large (None if none is).

    A region that is too large at the greatest depth holds signatures that agree in all leading
    values; it is dealt into parts by hash, each with the region's smallest rep as a common neighbour.
    """
    done, live, crowded = [], None, None
    for depth in LADDER:
        keyed = _prefix_keys(members, depth)
        keyed = keyed.withColumn("parent", F.lit(None).cast("long")) if live is None else keyed.join(live, ["tree", "rep"])
        size = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.sum("n_shingles").alias("total"), F.min("rep").alias("first"))
        fits = F.col("rows") <= rows_limit
        if shingles_limit is not None:
            fits &= (F.col("total") <= shingles_limit) | (F.col("rows") == 2)
        if live is None:
            size = size.where("rows > 1")
        marked = table(keyed.join(size.withColumn("fits", fits), "key"), "regions")
        done.append(marked.where("fits and rows > 1").select("key", "rep"))
        if live is not None:  # a row alone at this depth stays with the first row of the region it comes from
            alone = F.explode(F.array("rep", "parent")).alias("rep")
            done.append(marked.where("rows = 1 and rep <> parent").select(F.xxhash64(F.lit("alone"), "tree", F.lit(depth), "rep").alias("key"), alone))
        rest = marked.where("not fits")
        if rest.isEmpty():
            break
        if live is None:
            crowded = rest.select("rep").distinct()
        live = rest.select("tree", "rep", F.col("first").alias("parent"))
        last = rest
    else:
        parts = F.greatest(F.ceil(F.col("rows") / F.lit(rows_limit / 2)),
                           F.ceil(F.col("total") / F.lit((shingles_limit or 2**62) / 2)), F.lit(2))
        dealt = last.withColumn("parts", parts.cast("long"))
        own = dealt.where("rep <> first").select(
            F.xxhash64("key", F.pmod(F.xxhash64("rep"), F.col("parts"))).alias("key"), "rep")
        first = dealt.where("rep = first").select("key", "rep", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).select(
            F.xxhash64("key", F.col("part").cast("long")).alias("key"), "rep")
        done += [own, first]
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out, crowded


def around_centres(dense: DataFrame) -> DataFrame:
    """(key, rep): the rows of each cluster dealt by hash into parts, each with all centres of the cluster."""
    place = F.transform(F.sequence(F.lit(0), F.lit(POOL - 1)), lambda i: F.substring(F.hex("sig"), i * 8 + 1, F.lit(8)))
    values = dense.select("component", "rep", F.posexplode(place).alias("i", "v"))
    usual = values.groupBy("component", "i", "v").count().groupBy("component", "i").agg(
        F.max_by("v", F.struct("count", "v")).alias("v"))
    likeness = values.join(usual, ["component", "i", "v"]).groupBy("component", "rep").count()
    best = Window.partitionBy("component").orderBy(F.desc("count"), "rep")
    centres = likeness.withColumn("turn", F.row_number().over(best)).where(F.col("turn") <= CENTRES).select("component", "rep")
    size = dense.groupBy("component").agg(F.greatest(
        F.ceil(2 * F.count(F.lit(1)) / F.lit(CLUSTER_ROWS)), F.ceil(2 * F.sum("n_shingles") / F.lit(CLUSTER_SHINGLES))).cast("long").alias("parts"))
    key = F.xxhash64(F.lit("centres"), "component", "part").alias("key")
    dealt = dense.join(size, "component").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")))
    shown = centres.join(size, "component").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    return dealt.select(key, "rep").unionByName(shown.select(key, "rep")).distinct()


def _groups(batches, columns: list[str]):
    """Rows of sorted Arrow batches as (key, {column: list}) per run of equal keys."""
    key, held = None, None
    for batch in batches:
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.diff(keys)) + 1
        edges = [0, *cuts.tolist(), len(keys)]
        values = {c: batch.column(batch.schema.get_field_index(c)).to_pylist() for c in columns}
        for a, b in zip(edges, edges[1:]):
            if a == b:
                continue
            if held is not None and keys[a] == key:
                for c in columns:
                    held[c] += values[c][a:b]
                continue
            if held is not None:
                yield key, held
            key, held = keys[a], {c: values[c][a:b] for c in columns}
    if held is not None:
        yield key, held


def _candidate_forest(floor: int):
    """Per region: edges of a spanning forest over rows with similar signatures."""

    def run(batches):
        a_out, b_out = [], []

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], names=["a", "b"])

        for _, g in _groups(batches, ["rep", "sig"]):
            reps = g["rep"]
            sig = np.frombuffer(b"".join(g["sig"]), "<u4").reshape(-1, POOL)
            if len(reps) == 2:
                if (sig[0] == sig[1]).sum() >= floor:
                    a_out.append(reps[0])
                    b_out.append(reps[1])
            else:
                order = np.lexsort(sig.T[::-1])
                sig = sig[order]
                todo = np.arange(len(order))
                while len(todo) > 1:  # grow one tree after the other
                    front, todo = [todo[0]], todo[1:]
                    while front and len(todo):
                        i = front.pop()
                        near = (sig[todo] == sig[i]).sum(1) >= floor
                        for j in todo[near].tolist():
                            a_out.append(reps[order[i]])
                            b_out.append(reps[order[j]])
                            front.append(j)
                        todo = todo[~near]
            if len(a_out) >= 5000:
                yield flush()
                a_out, b_out = [], []
        yield flush()

    return run


def _decide(percent: int):
    """Per cluster: a spanning forest of the links, decided on the full sets."""

    def run(batches):
        hashes = WordHashes()

        def sets():
            for batch in batches:
                found = [shingles(hashes.of(lower_words(t))).tobytes() for t in binary_column(batch, "text")]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.large_binary())],
                                                 names=["key", "rep", "set"])

        for _, g in _groups(sets(), ["rep", "set"]):
            if len(g["rep"]) < 2:
                continue
            a, b = linked(g["rep"], [np.frombuffer(s, np.uint64) for s in g["set"]], percent)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def linked(reps: list[int], sets: list[np.ndarray], percent: int = PERCENT) -> tuple[list[int], list[int]]:
    """Spanning links among all pairs of sets, exactly: rows meet through the postings of their shingles."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), sizes)
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(code, kind="stable")
    posted = owner[order]
    starts = np.concatenate(([0], np.cumsum(np.bincount(code))))
    ends = np.cumsum(sizes)
    a_out, b_out, todo = [], [], np.ones(n, bool)
    for seed in range(n):
        if not todo[seed]:
            continue
        todo[seed] = False
        front = [seed]
        while front:
            i = front.pop()
            codes = code[ends[i] - sizes[i]:ends[i]]
            shared = np.zeros(n, np.int64)
            lens = starts[codes + 1] - starts[codes]
            busy = lens > 1
            for chunk in np.array_split(np.flatnonzero(busy), max(1, int(lens[busy].sum() // 4_000_000) + 1)):
                if len(chunk):
                    at = np.repeat(starts[codes[chunk]] - np.concatenate(([0], np.cumsum(lens[chunk])[:-1])), lens[chunk])
                    shared += np.bincount(posted[at + np.arange(len(at))], minlength=n)
            link = todo & (100 * shared >= percent * (sizes + sizes[i] - shared)) & (shared > 0)
            for j in np.flatnonzero(link).tolist():
                a_out.append(reps[i])
                b_out.append(reps[j])
                front.append(j)
            todo &= ~link
    return a_out, b_out


def crowded_groups(rows: DataFrame, percent: int) -> DataFrame:
    """(key, rep): groups in which all linked rows (rep, component, text) of different components meet.

    Sets of at least ``percent`` likeness share one of the first |s| - ceil(|s| * percent / 100) + 1 shingles
    of any fixed order (here rare ones first) and differ in size by one band at most. Rows of one
    such shingle and band make a group; a larger one is dealt into blocks that meet in pairs, but
    for two blocks of its largest component.
    """
    buckets = 1 << RARITY_BITS

    def sets(batch):
        hashes = WordHashes()
        return [shingles(hashes.of(lower_words(t))) for t in binary_column(batch, "text")]

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for s in sets(batch):
                total += 0 if not len(s) else np.bincount((s & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], names=["bucket", "n"])

    counted = rows.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    often = np.zeros(buckets, np.int64)
    often[counted["bucket"].to_numpy()] = counted["n"].to_numpy()

    def prefixes(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            found = []
            for s in sets(batch):
                first = np.lexsort((s, often[(s & np.uint64(buckets - 1)).astype(np.int64)]))
                found.append((len(s), s[first[:len(s) + 1 + -percent * len(s) // 100]] if len(s) else s))
            each = np.array([len(f) for _, f in found])
            n = np.array([n for n, _ in found])
            band = np.floor(np.log(np.maximum(n, 1)) / np.log(100 / percent) + 1e-9).astype(np.int64) if percent < 100 else n
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([f for _, f in found]).view(np.int64)), pa.array(np.repeat(band, each)),
                 *(pa.array(np.repeat(batch.column(i).to_numpy(), each)) for i in (0, 1)), pa.array(np.repeat(n, each))],
                names=["shingle", "own", "rep", "component", "n"])

    listed = table(rows.select("rep", "component", "text").mapInArrow(prefixes, "shingle long, own long, rep long, component long, n long")
                   .withColumn("band", F.explode(F.array("own", F.col("own") + 1))), "prefixes")
    rank = F.struct("rows", "component")
    held = listed.groupBy("shingle", "band", "component").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("n").alias("total"), F.max("own").alias("own"))
    held = held.groupBy("shingle", "band").agg(
        F.count(F.lit(1)).alias("components"), F.max("own").alias("own"), F.max_by("component", rank).alias("major"),
        F.max("rows").alias("major_rows"), F.max_by("total", rank).alias("major_total"), F.sum("rows").alias("rows"), F.sum("total").alias("total"))
    held = held.where("components > 1 and own = band")  # rows of the lower band alone meet there

    def parts(rows: str, total: str):
        need = F.greatest(F.ceil(2 * F.expr(rows) / F.lit(BLOCK_ROWS)), F.ceil(2 * F.expr(total) / F.lit(CLUSTER_SHINGLES)))
        whole = (F.col("rows") <= BLOCK_ROWS) & (F.col("total") <= CLUSTER_SHINGLES)
        return F.when(whole, F.lit(1)).otherwise(need).cast("long")

    held = held.select("shingle", "band", "major", parts("major_rows", "major_total").alias("majors"),
                       parts("rows - major_rows", "total - major_total").alias("minors"))
    met = listed.join(held, ["shingle", "band"])
    is_major = F.col("component") == F.col("major")
    met = met.withColumn("part", F.pmod(F.xxhash64("rep"), F.when(is_major, F.col("majors")).otherwise(F.col("minors"))))

    def key(kind: str, a, b):
        return F.xxhash64("shingle", "band", F.lit(kind), a, b)

    minors, majors = (F.sequence(F.lit(0).cast("long"), F.col(c) - 1) for c in ("minors", "majors"))
    across = F.when(is_major, F.transform(minors, lambda i: key("across", i, F.col("part")))).otherwise(
        F.transform(majors, lambda j: key("across", F.col("part"), j)))
    among = F.when(~is_major, F.transform(F.filter(minors, lambda i: i != F.col("part")), lambda i: key(
        "among", F.least(i, F.col("part")), F.greatest(i, F.col("part"))))).otherwise(F.array().cast("array<bigint>"))
    return met.select(F.explode(F.concat(across, among)).alias("key"), "rep").distinct()


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Null and empty texts have no shingles and link with nothing (component_id their own id, kept). A
    null id is never linked: component_id null, kept true. Rows of one id are one document: they
    share a component and are all kept or all dropped. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    sketches = table(_sketches(rows), "sketches")
    usable = sketches.where("set_id is not null and doc_id is not null")
    classes = table(usable.groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"),
                                                 F.first("n_shingles").alias("n_shingles")), "classes")
    found, crowded = regions(classes, REGION_ROWS)
    signed = found.join(classes.select("rep", "sig").groupBy("rep").agg(F.first("sig").alias("sig")), "rep")
    forest = table(signed.select("key", "rep", "sig").repartition("key").sortWithinPartitions("key").mapInArrow(
        _candidate_forest(similar_floor(percent)), "a long, b long").distinct(), "candidates")
    # all sets of an id that has several texts are nodes of that id; equal ids need no candidate edge
    cluster = table(components(forest), "clusters")
    members = cluster.join(classes.groupBy(F.col("rep").alias("id")).agg(F.sum("n_shingles").alias("n_shingles"),
                                                                        F.first("sig").alias("sig")), "id")
    size = members.groupBy("component").agg(F.count(F.lit(1)).alias("rows"), F.sum("n_shingles").alias("total"))
    small = (F.col("rows") <= CLUSTER_ROWS) & (F.col("total") <= CLUSTER_SHINGLES) | (F.col("rows") == 2)
    sized = table(members.join(size.select("component", small.alias("small")), "component"), "cluster-members")
    groups = sized.where("small").select(F.col("component").alias("key"), F.col("id").alias("rep"))
    if not sized.where("not small").isEmpty():
        dense = sized.where("not small").select("component", F.col("id").alias("rep"), "sig", "n_shingles")
        cut, more = regions(dense, CLUSTER_ROWS, CLUSTER_SHINGLES)
        groups = groups.unionByName(cut).unionByName(around_centres(dense))
        if more is not None:
            crowded = more if crowded is None else crowded.unionByName(more).distinct()
    texts = rows.select(F.col("doc_id").alias("rep"), "text")
    # a sort-merge join at every size: the representatives grow with the corpus
    links = _links(groups, texts, percent)
    # one id may stand for several sets: its sets' representatives are tied
    ties = usable.join(classes.select("set_id", "rep"), "set_id").where("doc_id <> rep").select(
        F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    links = links.unionByName(_repeated(usable, ties))
    if crowded is not None:
        links = table(links, "links")
        apart = crowded.join(components(links), F.col("rep") == F.col("id"), "left").select(
            "rep", F.coalesce("component", "rep").alias("component"))
        full = table(apart.hint("merge").join(texts, "rep"), "crowded")
        links = links.unionByName(_links(crowded_groups(full, percent), full.select("rep", "text"), percent))
    return _answer(sketches, links, classes)


def _links(groups: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """(a, b): spanning links of each group of ``groups`` (key, rep), decided on its full texts."""
    return (groups.hint("merge").join(texts, "rep").select("key", "rep", "text").repartition("key").sortWithinPartitions("key")
            .mapInArrow(_decide(percent), "a long, b long"))


def _repeated(usable: DataFrame, ties: DataFrame) -> DataFrame:
    """Ties of ids that occur with more than one set (an id that occurs once needs none)."""
    many = usable.groupBy(F.col("doc_id").alias("a")).agg(F.min("set_id").alias("x"), F.max("set_id").alias("y")).where("x <> y")
    return ties.join(many.select("a"), "a", "left_semi")


def _answer(sketches: DataFrame, links: DataFrame, classes: DataFrame) -> DataFrame:
    groups = components(links)
    known = classes.select("set_id", "rep").join(groups, F.col("rep") == F.col("id"), "left").select(
        "set_id", F.coalesce("component", "rep").alias("found"))
    out = sketches.select("doc_id", "n_shingles", "set_id").join(known, "set_id", "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("found", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id")))
