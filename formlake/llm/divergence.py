"""Audit of how a language's sources differ in their words, with in-mapper stripes.

Each task folds whole documents into hash stripes, term -> (document frequency, count for each source),
and spills them when they hold ``STRIPE_CELLS`` cells; spilled stripes are sorted and merged by
(language, term). Merged stripes of a language are dealt over buckets, each bucket is given the
language's totals once, and its stripes directly emit their terms' divergences and, summed over the
bucket, their share of the divergence of every two sources.

A pair's divergence is summed over the terms that occur in one of the two at least; all others add
the same amount, which depends on the two totals alone. Sources are cut into tiles of ``TILE``, so
that a task's sums take ``TILE * TILE`` numbers however many sources there are.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import binary_column, drop_table, table

MIN_DOCS = 30            # documents of a language in which a kept term occurs
TOP_TERMS = 50
SMOOTHING = 5
UNIT = 1_000_000_000     # probabilities are whole numbers of this unit
STRIPE_CELLS = 400_000   # cells of a task's stripes before they are spilled
BUCKET_STRIPES = 4_000   # merged stripes in a bucket, about
TILE = 512
BLOCK_CELLS = 1_000_000  # cells of the matrix that a task fills at once

# Everything but ASCII letters and bytes of other characters separates terms; A-Z become a-z.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TERM_BYTES).split()


STRIPE = "lang string, term string, docs long, sources array<string>, counts array<long>"


def _stripe_batch(rows: list[tuple]) -> pa.RecordBatch:
    lang, term, docs, sources, counts = zip(*rows) if rows else ((),) * 5
    return pa.RecordBatch.from_arrays(
        [pa.array(lang, pa.string()), pa.array(term, pa.string()), pa.array(docs, pa.int64()),
         pa.array(sources, pa.list_(pa.string())), pa.array(counts, pa.list_(pa.int64()))], names=["lang", "term", "docs", "sources", "counts"])


def _fold(batches):
    """Documents (lang, source, text) to spilled stripes."""
    docs: dict[str, Counter] = defaultdict(Counter)             # language -> term -> documents
    counts: dict[tuple[str, str], Counter] = defaultdict(Counter)  # (language, source) -> term -> occurrences
    cells = 0

    def spill():
        sources_of = defaultdict(list)
        for lang, source in counts:
            sources_of[lang].append(source)
        for lang, seen in docs.items():
            # cells in order of their source; a stable sort by term makes them stripes
            place = dict(zip(seen, range(len(seen))))
            stripes = [counts[lang, source] for source in sources_of[lang]]
            term = np.fromiter((i for stripe in stripes for i in map(place.__getitem__, stripe)), np.int64)
            order = np.argsort(term, kind="stable")
            source = np.repeat(np.arange(len(stripes)), [len(s) for s in stripes])[order]
            n = np.fromiter((c for stripe in stripes for c in stripe.values()), np.int64)[order]
            ends = np.concatenate(([0], np.cumsum(np.bincount(term, minlength=len(seen))))).astype(np.int32)
            rows = pa.RecordBatch.from_arrays(
                [pa.repeat(pa.scalar(lang, pa.string()), len(seen)), pa.array(list(seen), pa.binary()).cast(pa.string()),
                 pa.array(np.fromiter(seen.values(), np.int64, len(seen))),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(sources_of[lang], pa.string()).take(pa.array(source))),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(n))], names=["lang", "term", "docs", "sources", "counts"])
            for k in range(0, len(seen), 20_000):
                yield rows.slice(k, 20_000)
        docs.clear()
        counts.clear()

    for batch in batches:
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), binary_column(batch, "text")):
            words = terms_of(text)
            seen, stripe = docs[lang], counts[lang, source]
            cells -= len(seen) + len(stripe)
            stripe.update(words)
            seen.update(set(words))
            cells += len(seen) + len(stripe) + 1
            if cells >= STRIPE_CELLS:
                yield from spill()
                cells = 0
    yield from spill()


def _merge(min_docs: int):
    """Stripes sorted by (language, term) to one stripe a term, kept if it is in enough documents."""

    def run(batches):
        here, docs, total, out = None, 0, {}, []  # the last term of a batch may go on in the next one
        for batch in batches:
            if not batch.num_rows:
                continue
            lang, term, lists = batch.column(0), batch.column(1), batch.column(3)
            new = [pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False) for c in (lang, term)]
            starts = np.flatnonzero(np.concatenate(([True], new[0] | new[1])))
            stops = np.append(starts[1:], batch.num_rows)
            seen = np.add.reduceat(batch.column(2).to_numpy(), starts)
            # only terms in enough documents, and those at the batch's ends, are opened
            opened = seen >= min_docs
            opened[[0, -1]] = True
            cells = lists.offsets.to_numpy()
            sources, counts = lists.values, batch.column(4).values
            for k in np.flatnonzero(opened).tolist():
                key = lang[int(starts[k])].as_py(), term[int(starts[k])].as_py()
                if key != here:
                    if here and docs >= min_docs:
                        out.append((*here, docs, list(total), list(total.values())))
                    here, docs, total = key, 0, {}
                docs += int(seen[k])
                at, size = int(cells[starts[k]]), int(cells[stops[k]] - cells[starts[k]])
                for source, n in zip(sources.slice(at, size).to_pylist(), counts.slice(at, size).to_pylist()):
                    total[source] = total.get(source, 0) + n
            if len(out) >= 5_000:
                yield _stripe_batch(out)
                out = []
        if here and docs >= min_docs:
            out.append((*here, docs, list(total), list(total.values())))
        yield _stripe_batch(out)

    return run


def stripes_of(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """Merged stripes (lang, term, docs, sources, counts) of docs (lang, source, text)."""
    spilled = docs.select("lang", "source", "text").mapInArrow(_fold, STRIPE)
    return spilled.repartition("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(_merge(min_docs), STRIPE)


def _probability(count, total, terms):
    """1 + floor(UNIT * (count + SMOOTHING) / (total + SMOOTHING * terms)), exactly, for numpy arrays or whole numbers."""
    return 1 + UNIT * (count + SMOOTHING) // (total + SMOOTHING * terms)


def _whole(values) -> np.ndarray:
    """Whole numbers as 64-bit integers if UNIT times them fits, else as Python's."""
    return np.array(values, np.int64 if max(values, default=0) < 2**62 // UNIT else object)


EMIT = "lang string, source string, part string, item string, value long"


def _emit(min_tile: int, block_cells: int):
    """Per (language, bucket, tiles): divergences of the stripes' terms, and sums for every two sources."""

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 5, (*[pa.string()] * 4, pa.int64()))],
                                          names=["lang", "source", "part", "item", "value"])

    class Group:
        """The totals of a language's sources in two tiles, and the sums over the stripes met so far."""

        def __init__(self, lang, tile_a, tile_b, terms, total, sources, totals):
            self.lang, self.terms, self.total, self.diagonal = lang, terms, total, tile_a == tile_b
            mine = {*range(tile_a * min_tile, (tile_a + 1) * min_tile), *range(tile_b * min_tile, (tile_b + 1) * min_tile)}
            kept = [k for k in sorted(mine) if k < len(sources)]
            self.cut = sum(k < (tile_a + 1) * min_tile for k in kept)
            self.names, self.totals = [sources[k] for k in kept], _whole([totals[k] for k in kept])
            self.place = {s: i for i, s in enumerate(self.names)}
            self.zero = _probability(self.totals * 0, self.totals, terms).astype(np.int64)
            self.sums = np.zeros((len(kept), len(kept)), np.int64)
            self.waiting = []

        def add(self, term, sources, counts):
            self.waiting.append((term, [(self.place[s], n) for s, n in zip(sources, counts) if s in self.place], sum(counts)))
            return len(self.waiting) * max(1, len(self.names)) >= block_cells

        def flush(self):
            rows, size = [], len(self.names)
            if not self.waiting:
                return rows
            at = [(k, i, n) for k, (_, cells, _) in enumerate(self.waiting) for i, n in cells]
            if at:
                k, i = (np.array([c[j] for c in at], np.int64) for j in (0, 1))
                p = np.broadcast_to(self.zero, (len(self.waiting), size)).copy()
                held = np.zeros(p.shape, bool)
                p[k, i] = _probability(_whole([c[2] for c in at]), self.totals[i], self.terms).astype(np.int64)
                held[k, i] = True
                if self.diagonal:
                    q = np.asarray(_probability(_whole([w[2] for w in self.waiting]), self.total, self.terms)).astype(np.int64)
                    f = p[k, i] - q[k]
                    rows += [(self.lang, self.names[c], "term", self.waiting[r][0], v)
                             for r, c, v in zip(k[f > 0].tolist(), i[f > 0].tolist(), f[f > 0].tolist())]
                for s in range(size):
                    # a term that both sources hold is counted where the smaller one is s
                    some = held[:, s]
                    lo, hi = (0, size) if self.diagonal else (self.cut, size) if s < self.cut else (0, self.cut)
                    if not some.any() or lo == hi:
                        continue
                    f = np.abs(p[some, lo:hi] - p[some, s, None]) - np.abs(self.zero[lo:hi] - self.zero[s])
                    if lo < s:
                        f[:, :s - lo][held[some, lo:min(s, hi)]] = 0
                    self.sums[s, lo:hi] += f.sum(0)
            self.waiting = []
            return rows

        def pairs(self):
            both = self.sums + self.sums.T
            for a, b in zip(*(x.tolist() for x in np.nonzero(np.triu(both, 1)))):
                yield self.lang, self.names[a], "pair", self.names[b], int(both[a, b])

    def run(batches):
        here, group, rows = None, None, []
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist()
                       for c in ("lang", "bucket", "tile_a", "tile_b", "term", "terms", "total", "sources", "counts")]
            for lang, bucket, a, b, term, terms, total, sources, counts in zip(*columns):
                if term is None:  # a bucket's totals come before its stripes
                    if group is not None:
                        rows += group.flush()
                        rows += group.pairs()
                    here, group = (lang, bucket, a, b), Group(lang, a, b, terms, total, sources, counts)
                elif (lang, bucket, a, b) != here:
                    raise RuntimeError("stripes without totals")
                elif group.add(term, sources, counts):
                    rows += group.flush()
                if len(rows) >= 20_000:
                    yield batch_of(rows)
                    rows = []
        if group is not None:
            rows += group.flush()
            rows += group.pairs()
        yield batch_of(rows)

    return run


def _exact(count: Column | str, total: Column | str, terms: Column | str) -> Column:
    """``_probability`` for columns."""
    return F.expr(f"1 + cast(({UNIT} * cast({count} + {SMOOTHING} as decimal(28, 0))) div cast({total} + {SMOOTHING} * {terms} as decimal(28, 0)) as long)")


def source_divergences(docs: DataFrame, *, lang_col: str = "lang", source_col: str = "source", text_col: str = "text",
                       min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): how a language's sources differ from each other, and by which terms.

    Part ``pair`` ranks all other sources of the language by the summed difference of probabilities,
    part ``term`` the terms that the source uses more than its language does, down to ``top_terms``.

    Null texts, languages and sources are read as empty ones; documents without terms count for their
    group, which has pairs like any other. Every row counts, repeated ones too. Equal values are
    ranked by item. A very long text is folded whole. An empty table gives no rows. Columns other
    than the three are not read.
    """
    def read(name):
        return F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)

    rows = docs.select(read(lang_col).alias("lang"), read(source_col).alias("source"), read(text_col).alias("text"))
    stripes = table(stripes_of(rows, min_docs), "stripes")
    groups = table(rows.select("lang", "source").distinct(), "stripe-groups")
    used = stripes.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("c")).groupBy("lang", F.col("c.sources").alias("source")).agg(
        F.sum("c.counts").alias("total"))
    terms = stripes.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"))
    totals = table(groups.join(used, ["lang", "source"], "left").join(terms, "lang", "left").select(
        "lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("terms", F.lit(0)).alias("terms")), "stripe-totals")
    widest, kept = (totals.groupBy("lang").count().agg(F.max("count")).first()[0] or 0), stripes.count()
    tiles, buckets = -(-widest // TILE), max(1, -(-kept // BUCKET_STRIPES))
    pairs_of_tiles = F.explode(F.expr(f"flatten(transform(sequence(0, {max(tiles, 1) - 1}), a -> transform(sequence(a, {max(tiles, 1) - 1}), b -> struct(a, b))))"))
    bucket = F.pmod(F.xxhash64("term"), F.lit(buckets))
    heads = totals.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "total"))).alias("all"), F.max("terms").alias("terms"),
                                       F.sum("total").alias("total"))
    heads = (stripes.select("lang", bucket.alias("bucket")).distinct().join(heads, "lang")
             .select("lang", "bucket", F.lit(None).cast("string").alias("term"), "terms", "total", F.col("all.source").alias("sources"), F.col("all.total").alias("counts")))
    none = F.lit(None).cast("long")
    dealt = heads.unionByName(stripes.select("lang", bucket.alias("bucket"), "term", none.alias("terms"), none.alias("total"), "sources", "counts"))
    dealt = dealt.select("*", pairs_of_tiles.alias("tiles")).select("lang", "bucket", F.col("tiles.a").alias("tile_a"), F.col("tiles.b").alias("tile_b"),
                                                                   "term", "terms", "total", "sources", "counts")
    keys = ["lang", "bucket", "tile_a", "tile_b"]
    emitted = table(dealt.repartition(*keys).sortWithinPartitions(*keys, F.asc_nulls_first("term")).mapInArrow(_emit(TILE, BLOCK_CELLS), EMIT), "divergences")
    drop_table(stripes)
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    best = emitted.where("part = 'term'").withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top_terms)
    # what a pair's sums leave out: terms that neither source holds add the same amount each
    one = totals.select("lang", "source", "terms", F.when(F.col("terms") > 0, _exact("0", "total", "terms")).otherwise(0).alias("p"))
    other = one.select("lang", F.col("source").alias("item"), F.col("p").alias("q"))
    both = one.join(other, "lang").where("source <> item").select(
        "lang", "source", "item", F.least("source", "item").alias("lo"), F.greatest("source", "item").alias("hi"), (F.col("terms") * F.abs(F.col("p") - F.col("q"))).alias("base"))
    sums = emitted.where("part = 'pair'").groupBy("lang", F.col("source").alias("lo"), F.col("item").alias("hi")).agg(F.sum("value").alias("more"))
    pairs = both.join(sums, ["lang", "lo", "hi"], "left").select("lang", "source", F.lit("pair").alias("part"), "item",
                                                                 (F.col("base") + F.coalesce("more", F.lit(0))).alias("value"))
    columns = ["lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank")]
    return pairs.withColumn("rank", F.row_number().over(by_value)).select(columns).unionByName(best.select(columns))


DIVERGENCE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS c FROM w GROUP BY ALL HAVING count(DISTINCT row) >= {MIN_DOCS}),
o AS (SELECT lang, source, term, count(*) AS c FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT g.lang, g.source, coalesce(t.n, 0) AS n, coalesce(s.v, 0) AS v, coalesce(s.n, 0) AS all_n FROM g
      LEFT JOIN (SELECT lang, source, sum(c) AS n FROM o GROUP BY ALL) t ON g.lang = t.lang AND g.source = t.source
      LEFT JOIN (SELECT lang, count(*) AS v, sum(c) AS n FROM k GROUP BY ALL) s ON g.lang = s.lang),
p AS (SELECT v.lang, v.source, k.term, coalesce(o.c, 0) AS c,
             1 + ({UNIT}::HUGEINT * (coalesce(o.c, 0) + {SMOOTHING})) // (v.n + {SMOOTHING} * v.v)::HUGEINT AS p,
             1 + ({UNIT}::HUGEINT * (k.c + {SMOOTHING})) // (v.all_n + {SMOOTHING} * v.v)::HUGEINT AS q
      FROM v JOIN k ON v.lang = k.lang LEFT JOIN o ON v.lang = o.lang AND v.source = o.source AND k.term = o.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term
      WHERE a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
      UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE c > 0 AND p > q)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM r
QUALIFY part = 'pair' OR rank <= {TOP_TERMS}"""
