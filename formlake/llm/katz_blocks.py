"""Bigram Katz model kept in packed blocks, for scoring a whole corpus with little shuffled.

A bigram goes to the bucket of its first word, so that a context's counts and totals meet in one
place; a frequent first word is sliced over several buckets by its second word. What travels is one
compressed block per piece of text and bucket, not one row per bigram:

1. blocks of all texts meet in their buckets, and each bucket's training counts are written next to
   its texts' blocks, with the counts of counts, the unigram counts (every word but the end is a
   first word, and the end symbol stands before every text) and the second words of the bucket;
2. the second words' unigram probabilities come back to the buckets, one block per bucket and part of
   the words, which gives each context's left-over mass above and below, hence the table of backoff weights;
3. texts' blocks are read with their bucket's counts, without a further shuffle: bigrams found add
   their discounted probability to their texts, those not found leave as rows and are joined with
   the backoff weights and the unigram table.
"""

from __future__ import annotations

from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_column, drop_table, giving_back, mix64, table, text_hashes

CHUNK_TOKENS = 1_000_000  # tokens of one piece of text in a task
BUCKET_TOKENS = 2_500_000  # tokens of a bucket, about
PART_TOKENS = 10_000_000  # tokens a part of the words, about: second words meet their probabilities by parts
HEAVY_SHARE = 1 / 50_000  # only words with this share of all tokens can be sliced, so at most 50,000 of them
END = xxhash.xxh3_64_intdigest(b"\x00 end")
MERGE_PAIRS = 500_000  # bigrams that wait for a merge beyond twice the merged ones
HELD_BYTES = 32 << 20  # texts' blocks that a bucket keeps at hand while it counts; what exceeds them is joined later
_ITEMS = "kind string, bucket int, key long, n long, few long, counts binary, texts array<binary>"


# --- blocks ----------------------------------------------------------------------------------

def pack(*arrays: np.ndarray) -> bytes:
    """Whole-number arrays, each in its narrowest type with like bytes side by side, compressed."""
    parts = [len(arrays).to_bytes(2, "little")]
    for a in arrays:
        a = np.ascontiguousarray(a, np.min_scalar_type(int(a.max())) if len(a) else np.uint8)
        parts += [a.itemsize.to_bytes(1, "little"), len(a).to_bytes(8, "little"), a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(block: bytes) -> list[np.ndarray]:
    """The arrays of ``pack`` as uint64."""
    raw = zstandard.ZstdDecompressor().decompress(block)
    out, at = [], 2
    for _ in range(int.from_bytes(raw[:2], "little")):
        width, size = raw[at], int.from_bytes(raw[at + 1:at + 9], "little")
        at += 9
        a = np.frombuffer(raw, np.uint8, width * size, at).reshape(width, size).T
        out.append(np.ascontiguousarray(a).view(f"<u{width}").reshape(-1).astype(np.uint64))
        at += width * size
    return out


class Codes:
    """Numbers for words: frequent ones (at most 1 / HEAVY_SHARE) by rank, so that blocks hold whole hashes of rare words only."""

    def __init__(self, ranked: np.ndarray):
        self.ranked = ranked.astype(np.uint64)
        self.rank = np.argsort(self.ranked)
        self.ascending = self.ranked[self.rank]

    def order(self, words: np.ndarray) -> tuple[np.ndarray, int]:
        """How to put ascending distinct ``words`` in code order (frequent ones by rank, then the rest), and how many are frequent."""
        if not len(self.ranked):
            return np.arange(len(words)), 0
        i = np.minimum(np.searchsorted(self.ascending, words), len(self.ranked) - 1)
        often = self.ascending[i] == words
        return np.concatenate((np.flatnonzero(often)[np.argsort(self.rank[i[often]])], np.flatnonzero(~often))), int(often.sum())

    def coded(self, words: np.ndarray, often: int) -> tuple[np.ndarray, np.ndarray]:
        """Steps of ranks and of hashes for distinct words in code order."""
        ranks = self.rank[np.searchsorted(self.ascending, words[:often])]
        return np.diff(ranks, prepend=0), np.diff(words[often:], prepend=np.uint64(0))

    def words(self, ranks: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        return np.concatenate((self.ranked[np.cumsum(ranks).astype(np.int64)], np.cumsum(hashes, dtype=np.uint64)))


def _runs(values: np.ndarray) -> np.ndarray:
    """Where each run of equal neighbours starts."""
    return np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.zeros(0, np.int64)


def _dense(numbers: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ones of ``numbers`` (below ``size``), ascending, and each number's place among them."""
    mark = np.zeros(size, bool)
    mark[numbers] = True
    return np.flatnonzero(mark), (np.cumsum(mark, dtype=np.int32) - 1)[numbers]


def _stepped(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Steps within the runs that start at ``at``, each run's first value whole."""
    step = np.diff(values, prepend=0)
    step[at] = values[at]
    return step


def _absolute(step: np.ndarray, per: np.ndarray) -> np.ndarray:
    """The values of ``_stepped``, from the runs' lengths."""
    total = np.cumsum(step)
    start = np.cumsum(per) - per
    return total - np.repeat(total[start] - step[start], per)


def pack_pairs(codes: Codes, words: np.ndarray, often: int, u: np.ndarray, w: np.ndarray, *more: np.ndarray) -> bytes:
    """A block of bigrams given as numbers into ``words`` (in code order) and sorted by (u, w); ``more`` goes along as it is."""
    at = _runs(u)
    used, place = _dense(w, len(words))
    return pack(*codes.coded(words[u[at]], int(np.searchsorted(u[at], often))), np.diff(at, append=len(u)),
                *codes.coded(words[used], int(np.searchsorted(used, often))), _stepped(place, at), *more)


def unpack_pairs(codes: Codes, block: bytes) -> list[np.ndarray]:
    """Hashes of first and second words, grouped by first word, and what went along."""
    u, w, run, step, more = _opened(codes, block)
    return [np.repeat(u, run), w[_absolute(step, run)], *more]


def _opened(codes: Codes, block: bytes):
    ur, uh, run, wr, wh, step, *more = unpack(block)
    return codes.words(ur, uh), codes.words(wr, wh), run.astype(np.int64), step.astype(np.int64), more


def share_words(codes: Codes, blocks: list[bytes], words: np.ndarray) -> list[bytes]:
    """``blocks``, whose words are ``words``, with one list of words before them instead of one in each; their order stays. Empties ``blocks``."""
    order, often = codes.order(words)
    words = words[order]
    own, none = Codes(words), np.zeros(0, np.uint64)
    out = [pack(*codes.coded(words, often))]
    blocks.reverse()
    while blocks:
        u, w, run, step, more = _opened(codes, blocks.pop())
        out.append(pack(own.coded(u, len(u))[0], none, run, own.coded(w, len(w))[0], none, step, *more))
    return out


def pair_keys(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix64(mix64(u) + w)


def buckets_of(u: np.ndarray, w: np.ndarray, heavy: tuple[np.ndarray, np.ndarray], buckets: int) -> np.ndarray:
    """A bigram's bucket: that of its first word, moved by its slice where that word is heavy (``heavy``: words ascending, slices)."""
    place = mix64(u)
    if len(heavy[0]):
        i = np.minimum(np.searchsorted(heavy[0], u), len(heavy[0]) - 1)
        slices = np.where(heavy[0][i] == u, heavy[1][i], np.uint64(1))
        place = place + mix64(w + np.uint64(1)) % slices
    return (place % np.uint64(buckets)).astype(np.int64)


# --- from texts to blocks --------------------------------------------------------------------

def _slices(batches, rows: int = 500):
    """A few rows at a time, so that a batch's texts are not all copied at once."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def _pieces(batches):
    """(ids, tags, training flags, word hashes with the end symbol after each text) of pieces of at most about CHUNK_TOKENS."""
    ids, tags, train, words, held = [], [], [], [], 0
    for batch in _slices(batches):
        for doc, tag, learn, w in zip(*(batch.column(i).to_pylist() for i in range(3)), text_hashes(binary_column(batch, "text"), END)):
            if held and held + len(w) > CHUNK_TOKENS:
                yield ids, tags, train, words
                ids, tags, train, words, held = [], [], [], [], 0
            ids.append(doc)
            tags.append(tag)
            train.append(learn)
            words.append(w)
            held += len(w)
    if held:
        yield ids, tags, train, words


def frequent_words(rows: DataFrame) -> tuple[int, dict[int, int]]:
    """Tokens of ``rows`` and the words (hashes) that hold at least HEAVY_SHARE of them, the end symbol among them.

    A piece of text reports words from half that share on, so at most 100,000 a piece; what is lost
    this way is under half the share, and the result only says where bigrams meet.
    """
    def run(batches):
        seen, held = [], 0

        def report():
            keys, n = np.unique(np.concatenate(seen), return_counts=True)
            often = (n >= held * HEAVY_SHARE / 2) | (keys == np.uint64(END))
            return pa.RecordBatch.from_arrays([pa.array(np.append(keys[often], np.uint64(0)).view(np.int64)), pa.array(np.append(n[often], held)),
                                               pa.array([True] * int(often.sum()) + [False])], names=["w", "n", "word"])

        for batch in _slices(batches):
            for w in text_hashes(binary_column(batch, "text"), END):
                seen.append(w)
                held += len(w)
                if held > CHUNK_TOKENS:
                    yield report()
                    seen, held = [], 0
        if held:
            yield report()

    found = table(rows.select("text").mapInArrow(giving_back(run), "w long, n long, word boolean"), "katz-frequent")
    tokens = found.where("not word").agg(F.sum("n")).first()[0] or 0
    often = found.where("word").groupBy("w").agg(F.sum("n").alias("n")).where(F.col("n") >= tokens * HEAVY_SHARE).collect()
    drop_table(found)
    return tokens, {r["w"]: r["n"] for r in often}


def _numbered(words: list[np.ndarray], codes: Codes):
    """A piece's distinct words in code order, how many are frequent, each token's number and the number of the token before it."""
    ascending, place = np.unique(np.concatenate(words), return_inverse=True)
    order, often = codes.order(ascending)
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))
    place = number[place]
    # every text ends with the end symbol, so the next one starts after it
    return ascending[order], often, place, np.concatenate((place[-1:], place[:-1]))


def _cuts(bucket: np.ndarray, buckets: int):
    """(bucket, positions in order) for every bucket that occurs."""
    small = bucket.astype(np.min_scalar_type(buckets))
    order = np.argsort(small, kind="stable")
    at = np.concatenate(([0], np.cumsum(np.bincount(small, minlength=buckets))))
    return {b: order[at[b]:at[b + 1]] for b in np.flatnonzero(np.diff(at)).tolist()}


def _block_rows(out: dict[int, bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(out), pa.int32()), pa.array(list(out.values()), pa.binary())], names=["bucket", "block"])


def _text_blocks(rows: DataFrame, heavy, buckets: int, codes: Codes) -> DataFrame:
    """Per piece and bucket: its bigrams with, for each, the texts it occurs in and how often, and the texts' keys and whether they are learned from."""
    def run(batches):
        for ids, tags, train, words in _pieces(batches):
            many, sizes = len(ids), [len(x) for x in words]
            w, often, event, before = _numbered(words, codes)
            words.clear()  # arrays as long as the piece go as soon as they are used
            # at most CHUNK_TOKENS tokens, or one text alone: three numbers fit into 63 bits
            wide, deep = (len(w) - 1).bit_length(), (many - 1).bit_length()
            before <<= wide
            event |= before
            del before
            event <<= deep
            event |= np.repeat(np.arange(many), sizes)
            event, n = np.unique(event, return_counts=True)
            n, doc = n.astype(np.int32), (event & ((1 << deep) - 1)).astype(np.int32)
            event >>= deep
            at = _runs(event)
            per = np.diff(at, append=len(event)).astype(np.int32)
            event = event[at]
            u, v = (event >> wide).astype(np.int32), (event & ((1 << wide) - 1)).astype(np.int32)
            del event, at
            bucket = buckets_of(w[u], w[v], heavy, buckets).astype(np.int32)
            pairs, events = _cuts(bucket, buckets), _cuts(np.repeat(bucket, per), buckets)
            del bucket
            id_of, tag_of = np.array(ids, np.int64).view(np.uint64), np.array(tags, np.int64).view(np.uint64)
            train_of = np.array(train, np.uint8)
            out = {}
            for b, s in pairs.items():
                e = events[b]
                here, number = _dense(doc[e], many)
                out[b] = pack_pairs(codes, w, often, u[s], v[s], per[s], _stepped(number, np.cumsum(per[s]) - per[s]), n[e], id_of[here], tag_of[here], train_of[here])
            yield _block_rows(out)

    return rows.select("id", "row", "train", "text").mapInArrow(giving_back(run), "bucket int, block binary")


def _by_bucket(batches, columns: list[str]):
    """(bucket, rows) for every run of equal buckets in a partition, which holds one bucket; rows are read as they come."""
    def rows():
        for batch in batches:
            of = [batch.column(batch.schema.get_field_index(c)) for c in columns]
            for i in range(batch.num_rows):
                yield tuple(c[i].as_py() for c in of)
    yield from groupby(rows(), key=lambda r: r[0])


def _meet(df: DataFrame, many: int, by: str, *order: str) -> DataFrame:
    """One partition per bucket, or what else ``by`` numbers."""
    df = df.repartitionById(many, F.col(by))
    return df.sortWithinPartitions(by, *order) if order else df


def parts_of(words: np.ndarray, parts: int) -> np.ndarray:
    """A word's part, as Spark's pmod gives it."""
    return np.mod(words.view(np.int64), parts)


# --- counts ----------------------------------------------------------------------------------

class _Distinct:
    """Distinct words of blocks, united whenever twice as many wait."""

    def __init__(self):
        self.words, self.waiting, self.held = np.zeros(0, np.uint64), [], 0

    def add(self, *words: np.ndarray) -> None:
        self.waiting += words
        self.held += sum(map(len, words))
        if self.held > 2 * len(self.words) + MERGE_PAIRS:
            self.united()

    def united(self) -> np.ndarray:
        self.words = np.unique(np.concatenate((self.words, *self.waiting)))
        self.waiting, self.held = [], 0
        return self.words


def _merged(parts: tuple[list, list, list]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One entry per bigram of ``parts`` (first words, second words, counts), which are emptied on the way."""
    whole = []
    for x in parts:
        whole.append(np.concatenate(x))
        x.clear()
    u, w, n = whole
    del whole
    key = pair_keys(u, w)
    order = np.argsort(key)
    at = _runs(key[order])
    del key
    n = np.add.reduceat(n[order], at)
    at = order[at]
    del order
    u = u[at]
    return u, w[at], n


def _in_code_order(codes: Codes, u: np.ndarray, w: np.ndarray):
    """Distinct words in code order, how many are frequent, and the bigrams' sorted numbers with the order that sorts them."""
    ascending = np.union1d(np.unique(u), np.unique(w))
    order, often = codes.order(ascending)
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))
    key = number[np.searchsorted(ascending, u)] * len(order) + number[np.searchsorted(ascending, w)]
    sort = np.argsort(key)
    return ascending[order], often, *np.divmod(key[sort], len(order)), sort


def _items(kind: str, bucket: int, key, n, few, counts=None, texts=None) -> pa.RecordBatch:
    key = np.ascontiguousarray(key, np.uint64).view(np.int64)
    blank = len(key)
    return pa.RecordBatch.from_arrays([
        pa.array([kind] * blank), pa.array(np.full(blank, bucket, np.int32)), pa.array(key), pa.array(np.asarray(n, np.int64)), pa.array(np.asarray(few, np.int64)),
        pa.nulls(blank, pa.binary()) if counts is None else pa.array([counts], pa.binary()),
        pa.nulls(blank, pa.list_(pa.binary())) if texts is None else pa.array([texts], pa.list_(pa.binary()))],
        names=["kind", "bucket", "key", "n", "few", "counts", "texts"])


def _count(blocks: DataFrame, buckets: int, parts_in_all: int, gt_max: int, codes: Codes) -> DataFrame:
    """Items: 'block' (a bucket's counts and texts), 'late' (further texts of a bucket), 'word' (first word, occurrences, bigrams that
    are discounted), 'seen' (a block of second words for each part, in code order), 'stat' (counts of counts)."""
    def run(batches):
        for bucket, rows in _by_bucket(batches, ["bucket", "block"]):
            parts, merged, held, texts, used, size = ([], [], []), 0, 0, [], _Distinct(), 0
            for _, block in rows:
                if texts and size + len(block) > HELD_BYTES:
                    yield _items("late", bucket, [0], [0], [0], None, share_words(codes, texts, used.united()))
                    texts, used, size = [], _Distinct(), 0
                texts.append(block)
                size += len(block)
                u, w, run, place, (per, step, n, _, _, train) = _opened(codes, block)
                used.add(u, w)
                u, w, per = np.repeat(u, run), w[_absolute(place, run)], per.astype(np.int64)
                n = np.add.reduceat(n * train[_absolute(step.astype(np.int64), per)], np.cumsum(per) - per)
                learned = n > 0
                for x, y in zip(parts, (u[learned], w[learned], n[learned].astype(np.int64))):
                    x.append(y)
                del u, w, run, place, per, step, n, train, learned
                held += len(parts[0][-1])
                if held > 2 * merged + MERGE_PAIRS:
                    for x, y in zip(parts, _merged(parts)):
                        x.append(y)
                    merged = held = len(parts[0][0])
            learned = _merged(parts) if held else None
            texts = share_words(codes, texts, used.united())
            del used
            if learned is None:
                yield _items("block", bucket, [0], [0], [0], None, texts)
                continue
            u, w, n = learned
            del learned
            words, often, u, w, sort = _in_code_order(codes, u, w)
            n, at, seen = n[sort], _runs(u), _dense(w, len(words))[0]
            r, many = np.unique(n[n <= gt_max + 1], return_counts=True)
            few = np.add.reduceat((n <= gt_max).astype(np.int64), at)
            yield _items("block", bucket, [0], [0], [0], pack_pairs(codes, words, often, u, w, n), texts)
            del texts, w, sort
            for part, of in _cuts(parts_of(words[seen], parts_in_all), parts_in_all).items():
                of = seen[of]
                yield _items("seen", bucket, [part], [0], [0], pack(*codes.coded(words[of], int(np.searchsorted(of, often)))))
            for kind, key, number, less in (("word", words[u[at]], np.add.reduceat(n, at), few), ("stat", r, many, np.zeros(len(r)))):
                for i in range(0, len(key), 100_000):
                    s = slice(i, i + 100_000)
                    yield _items(kind, bucket, key[s], number[s], less[s])

    return _meet(blocks, buckets, "bucket").mapInArrow(giving_back(run), _ITEMS)


class PairModel:
    """``words`` (w, c, few, p), count blocks with the texts to score (``items``) and ``weights`` (u, alpha) of a bigram model of ``rows``."""

    def __init__(self, rows: DataFrame, discounts, gt_max: int):
        tokens, often = frequent_words(rows)
        self.buckets = b = int(max(2 * rows.sparkSession.sparkContext.defaultParallelism, tokens // BUCKET_TOKENS + 1))
        self.parts = int(max(2 * rows.sparkSession.sparkContext.defaultParallelism, tokens // PART_TOKENS + 1))
        slices = {w: -(-n * 2 * b // tokens) for w, n in often.items() if n * 2 * b > tokens}
        heavy = np.array(sorted(np.uint64(w & (2**64 - 1)) for w in slices), np.uint64)
        self.heavy = heavy, np.array([min(slices[int(w)], b) for w in heavy.view(np.int64)], np.uint64)
        codes = self.codes = Codes(np.array(sorted(often, key=lambda w: (-often[w], w)), np.int64).view(np.uint64))
        items = self.items = table(_count(_text_blocks(rows, self.heavy, b, codes), b, self.parts, gt_max, codes), "katz-counts")
        counted = table(items.where("kind = 'word'").groupBy(F.col("key").alias("w")).agg(F.sum("n").alias("c"), F.sum("few").alias("few")), "katz-words")
        ones = discounts({r["c"]: r["count"] for r in counted.where(F.col("c") <= gt_max + 1).groupBy("c").count().collect()})
        twos = discounts({r["key"]: r["n"] for r in items.where("kind = 'stat'").groupBy("key").agg(F.sum("n").alias("n")).collect()})
        kept = F.col("c") * reduce(lambda e, rd: e.when(F.col("c") == rd[0], F.lit(rd[1])), ones.items(), F.when(F.lit(False), 1.0)).otherwise(1.0)
        total = counted.agg(F.sum("c"), F.count(F.lit(1)), F.sum(kept)).first()
        self.tokens, self.types, mass = total[0] or 0, total[1], total[2] or 0.0
        base = float(self.tokens) if mass < self.tokens else self.tokens + 1.0
        self.unseen = 1.0 - mass / base
        self.words = counted.withColumn("p", kept / base)
        self.ratio = np.array([1.0, *[twos[r] for r in range(1, gt_max + 1)], 1.0])
        # contexts whose bigrams lie in several buckets: their whole totals, a row for each sliced word
        whole = self.words.where(F.col("w").isin([int(w) for w in heavy.view(np.int64)])).select("w", "c", "few").collect() if len(heavy) else []
        whole = sorted((np.uint64(r["w"] & (2**64 - 1)), r["c"], r["few"]) for r in whole)
        self.whole = np.array([w for w, _, _ in whole], np.uint64), np.array([c for _, c, _ in whole], np.float64), np.array([f for _, _, f in whole], np.int64)
        self.weights = table(self._weights(items), "katz-weights")

    def _discounted(self):
        ratio = self.ratio
        return lambda n: n * ratio[np.minimum(n, len(ratio) - 1).astype(np.int64)]

    def _weights(self, items: DataFrame) -> DataFrame:
        """Backoff weight of every context: mass left over above by mass left over below."""
        none, parts, discounted, codes = F.lit(None), self.parts, self._discounted(), self.codes
        asked = self.words.select(F.pmod("w", F.lit(parts)).cast("int").alias("part"), F.lit(-1).alias("bucket"), "w", "p", none.cast("binary").alias("block")).unionByName(
            items.where("kind = 'seen'").select(F.col("key").cast("int").alias("part"), "bucket", none.cast("long").alias("w"), none.cast("double").alias("p"),
                                                F.col("counts").alias("block")))

        def answer(batches):
            words, probs, now, known = [], [], None, None
            for batch in batches:
                of, bs = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
                for at, end in zip(s := _runs(of), [*s[1:], len(of)]):
                    if of[at] != now:
                        words, probs, now, known = [], [], of[at], None
                    split = int(at + np.searchsorted(bs[at:end], 0))  # the part's words come first
                    words.append(batch.column(2).slice(at, split - at).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
                    probs.append(batch.column(3).slice(at, split - at).to_numpy(zero_copy_only=False).astype(np.float64))
                    for b, block in zip(bs[split:end].tolist(), batch.column(4).slice(split, end - split)):
                        if known is None:
                            known, p = np.concatenate(words), np.concatenate(probs)
                            order = np.argsort(known)
                            known, p = known[order], p[order]
                        found = p[np.searchsorted(known, codes.words(*unpack(block.as_py())))]
                        yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([now], pa.int32()), pa.array(
                            [zstandard.ZstdCompressor(level=1).compress(found.tobytes())], pa.binary())], names=["bucket", "part", "block"])

        both = _meet(asked, parts, "part", "bucket").mapInArrow(giving_back(answer), "bucket int, part int, block binary").unionByName(
            items.where("kind = 'block' and counts is not null").select("bucket", F.lit(parts).alias("part"), F.col("counts").alias("block")))

        def run(batches):
            for _, rows in _by_bucket(batches, ["bucket", "part", "block"]):
                probs = []
                for _, part, block in rows:  # the parts' answers, then the counts
                    if part < parts:
                        probs.append(np.frombuffer(zstandard.ZstdDecompressor().decompress(block), np.float64))
                        continue
                    u, w, run, step, (n,) = _opened(codes, block)
                    lower = np.empty(len(w))
                    lower[np.argsort(parts_of(w, parts), kind="stable")] = np.concatenate(probs)
                    first = np.cumsum(run) - run
                    yield pa.RecordBatch.from_arrays([
                        pa.array(u.view(np.int64)), pa.array(np.add.reduceat(n, first).astype(np.int64)), pa.array(np.add.reduceat(discounted(n), first)),
                        pa.array(np.add.reduceat(lower[_absolute(step, run)], first))], names=["u", "c", "kept", "below"])

        sums = _meet(both, self.buckets, "bucket", "part").mapInArrow(giving_back(run), "u long, c long, kept double, below double")
        total = sums.groupBy("u").agg(F.sum("c").alias("c"), F.sum("kept").alias("kept"), F.sum("below").alias("below"))
        full = F.when(F.col("kept") < F.col("c") - 1e-9, F.col("c")).otherwise(F.col("c") + 1)
        return total.select("u", (F.greatest(1 - F.col("kept") / full, F.lit(1e-12)) / F.greatest(1 - F.col("below"), F.lit(1e-12))).alias("alpha"))

    def score(self) -> DataFrame:
        """(id, row, tokens, known, base, score) summed over each text's tokens; once, for the texts' blocks go then."""
        late = self.items.where("kind = 'late'").select("bucket", "texts").join(
            self.items.where("kind = 'block'").select("bucket", "counts"), "bucket").select("counts", "texts")
        both = self.items.where("kind = 'block'").select("counts", "texts").unionByName(late)
        discounted, codes, (big, big_c, big_few), lost = self._discounted(), self.codes, self.whole, self.ratio

        def run(batches):
            for counts, texts in ((c.as_py(), t.values) for batch in batches for c, t in zip(batch.column(0), batch.column(1))):
                key, logs, ctx, total, full = _tables(codes, counts, discounted, len(lost) - 2)
                own = Codes(codes.words(*unpack(texts[0].as_py())))
                for block in (t.as_py() for t in texts[1:]):  # one at a time
                    u, w, per, step, n, ids, tags, _ = unpack_pairs(own, block)
                    per, n = per.astype(np.int64), n.astype(np.float64)
                    first = _runs(u)
                    run = np.diff(first, append=len(u))
                    c, f = _looked_up(ctx, total, u[first]), _looked_up(ctx, full, u[first])
                    if len(big):
                        sliced = np.isin(u[first], big)
                        c = np.where(sliced, _looked_up(big, big_c, u[first]), c)
                        f = np.where(sliced, _looked_up(big, big_c + (big_few == 0), u[first]), f)
                    g = pair_keys(u, w)
                    order = np.argsort(g)  # ascending, so that the search walks the keys once
                    logp = np.full(len(g), np.nan)
                    logp[order] = _looked_up(key, logs, g[order], np.nan)
                    hit = ~np.isnan(logp)
                    logp = np.where(hit, logp - np.repeat(np.log10(np.maximum(f, 1)), run), 0.0)
                    base, seen = np.repeat(np.log10(c + 0.1), run), np.repeat(c > 0, run)
                    pair = np.repeat(np.arange(len(u)), per)
                    doc = _absolute(step.astype(np.int64), per)
                    size = len(ids)
                    gone = ~hit[pair]
                    sums = [np.bincount(doc, n, size), np.bincount(doc, n * seen[pair], size), np.bincount(doc, n * base[pair], size),
                            np.bincount(doc, n * logp[pair], size)]
                    blank = pa.nulls(size, pa.int64())
                    yield _part(ids, tags, sums, blank, blank)
                    if gone.any():
                        d, zero = doc[gone], np.zeros(int(gone.sum()))
                        yield _part(ids[d], tags[d], [n[gone], zero, zero, zero], pa.array(u[pair[gone]].view(np.int64)), pa.array(w[pair[gone]].view(np.int64)))

        parts = table(both.mapInArrow(
            giving_back(run), "id long, row long, n long, known long, base double, score double, u long, w long"), "katz-parts")
        drop_table(self.items)
        backed = parts.where("u is not null").join(self.weights, "u", "left").join(self.words.select("w", "p"), "w", "left").select(
            "id", "row", F.lit(0).cast("long").alias("n"), "known", "base",
            (F.col("n") * (F.log10(F.coalesce("alpha", F.lit(1.0))) + F.log10(F.coalesce("p", F.lit(max(self.unseen, 1e-12)))))).alias("score"))
        return parts.where("u is null").drop("u", "w").unionByName(backed).groupBy("id", "row").agg(
            F.sum("n").alias("tokens"), F.sum("known").alias("known"),
            (F.sum("base") - F.sum("n") * F.lit(float(np.log10(self.tokens + 0.1 * (self.types + 1))))).alias("base"), F.sum("score").alias("score"))


def _tables(codes: Codes, counts: bytes | None, discounted, gt_max: int):
    """Of a bucket's counts: bigram keys, logs of their discounted counts, contexts, their totals and what they are divided by."""
    if counts is None:
        none = np.zeros(0)
        return none.astype(np.uint64), none, none.astype(np.uint64), none, none
    u, w, n = unpack_pairs(codes, counts)
    at = _runs(u)
    up = np.argsort(u[at])
    total = np.add.reduceat(n, at).astype(np.float64)[up]
    full = total + (np.add.reduceat((n <= gt_max).astype(np.int64), at) == 0)[up]
    key = pair_keys(u, w)
    ctx = u[at][up]
    del u, w, at
    order = np.argsort(key)
    return key[order], np.log10(discounted(n[order].astype(np.float64))), ctx, total, full


def _looked_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, none: float = 0.0) -> np.ndarray:
    """Values at ``wanted`` among ascending ``keys``, ``none`` where there is none."""
    if not len(keys):
        return np.full(len(wanted), none)
    i = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[i] == wanted, values[i], none)


def _part(ids, tags, sums, u, w) -> pa.RecordBatch:
    n, known, base, score = sums
    return pa.RecordBatch.from_arrays([
        pa.array(np.ascontiguousarray(ids).view(np.int64)), pa.array(np.ascontiguousarray(tags).view(np.int64)), pa.array(np.rint(n).astype(np.int64)),
        pa.array(np.rint(known).astype(np.int64)), pa.array(base), pa.array(score), u, w], names=["id", "row", "n", "known", "base", "score", "u", "w"])
