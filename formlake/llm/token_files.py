"""Token-id files: Simple-8b words in blocks, with escapes and per-block offsets.

A shard holds whole documents in ascending id order. Layout (little endian):

    8 bytes  magic ``S8BSHRD1``
    6 x u64  documents D, ids N, blocks B, ids per block, 64-bit words W, first document's row
    D x i64  document ids (the null id as -2**63)
    D x u64  end offset of each document in the shard's id stream
    B x u64  word offset of each block
    W x u64  Simple-8b words

In a word the top four bits are the selector: how many ids follow and with how many bits each.
Selector 0 is the escape: the next word is one raw 64-bit id. A block holds a fixed number of ids
(the last one fewer) and starts at a word boundary, so blocks decode independently; encoding and
decoding run over all blocks, or all words of a selector, at once.
"""

from __future__ import annotations

import os
import string
import uuid
import zlib
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import giving_back, of_worker, shared_path, table

MAGIC = b"S8BSHRD1"
BLOCK_IDS = 1024
SHARD_IDS = 4_000_000  # a shard is closed when it holds this many ids
PIECE_BYTES = 8 << 20  # bytes of texts whose chunks are encoded together
CACHE_WORDS = 400_000  # entries of a worker's memo of words of letters
CACHE_BYTES = 16 << 20  # bytes of these words
CACHE_CHUNKS = 50_000  # entries of its memo of other chunks
CACHE_LETTERS = 64  # letters of such a chunk at most
END_ID = 1
NULL_ID = -2**63
# Ids per word and bits per id of each selector (60 payload bits); 0 is the escape.
PACK = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20),
        (2, 30), (1, 60))
ESCAPE = 0
LIMITS = np.array([1 << bits for _, bits in PACK], np.uint64)


# --- the code --------------------------------------------------------------------------------

def encode_ids(ids: np.ndarray, block: int = BLOCK_IDS) -> tuple[np.ndarray, np.ndarray]:
    """Simple-8b words of ``ids`` and the word offset of each block (64 blocks at a time, for the cache)."""
    words, offsets, done = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], 0
    for i in range(0, len(ids), 64 * block):
        w, o = _encode(np.ascontiguousarray(ids[i:i + 64 * block], np.uint64), block)
        words.append(w)
        offsets.append(o + np.uint64(done))
        done += len(w)
    return np.concatenate(words), np.concatenate(offsets)


def _encode(ids: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(ids)
    n_blocks = -(-n // block)
    pos = np.arange(n_blocks, dtype=np.int64) * block
    ends = np.minimum(pos + block, n)
    room = np.repeat(ends, ends - pos) - np.arange(n)  # ids from each position to the end of its block
    width = np.searchsorted(LIMITS, ids, side="right").astype(np.uint8)  # narrowest sufficient entry of BITS
    take = np.zeros(n, np.int64)  # ids that a word starting here holds; 0: escape
    sel = np.zeros(n, np.uint8)
    least, most = int(width.min()), int(width.max())
    for s in range(len(PACK) - 1, least - 1, -1):  # from few wide ids to many narrow ones: the last fit wins
        count = PACK[s][0]
        if count > n:
            break
        ok = room[:n - count + 1] >= count
        if s < most:
            wide = np.concatenate((np.zeros(1, np.int32), np.cumsum(width > s, dtype=np.int32)))
            ok &= wide[count:] == wide[:n - count + 1]
        np.copyto(take[:len(ok)], count, where=ok)
        np.copyto(sel[:len(ok)], s + 1, where=ok)
    step = np.maximum(take, 1)
    starts = []
    live = np.arange(n_blocks)
    while len(live):  # one word of every block per round
        p = pos[live]
        starts.append(p)
        pos[live] = p + step[p]
        live = live[pos[live] < ends[live]]
    starts = np.sort(np.concatenate(starts))
    cost = np.where(take[starts] == 0, 2, 1)
    out_at = np.cumsum(cost) - cost
    words = np.zeros(int(cost.sum()), np.uint64)
    for s, (count, bits) in enumerate(PACK):
        mine = sel[starts] == s + 1
        first = starts[mine]
        value = np.full(len(first), (s + 1) << 60, np.uint64)
        for i in range(count if len(first) else 0):
            value |= ids[first + i] << np.uint64(i * bits)
        words[out_at[mine]] = value
    escaped = take[starts] == 0
    words[out_at[escaped] + 1] = ids[starts[escaped]]  # the selector word itself is zero
    return words, out_at[np.searchsorted(starts, np.arange(n_blocks) * block)].astype(np.uint64)


def decode_ids(words: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` ids of Simple-8b ``words``, which start at a block offset."""
    words = np.asarray(words, np.uint64)
    sel = (words >> np.uint64(60)).astype(np.int64)
    head = np.flatnonzero(~_raw_words(sel))
    counts = np.array([1] + [c for c, _ in PACK] + [0])[sel[head]]
    at = np.concatenate(([0], np.cumsum(counts)))
    if at[-1] != n:
        raise ValueError(f"corrupt words: {at[-1]} ids, expected {n}")
    out = np.zeros(n, np.uint64)
    for s, (count, bits) in enumerate(PACK):
        mine = sel[head] == s + 1
        w, first = words[head[mine]], at[:-1][mine]
        for i in range(count if len(first) else 0):
            out[first + i] = (w >> np.uint64(i * bits)) & np.uint64((1 << bits) - 1)
    escaped = sel[head] == ESCAPE
    out[at[:-1][escaped]] = words[head[escaped] + 1]
    return out


def _raw_words(sel: np.ndarray) -> np.ndarray:
    """Which words are raw ids after an escape. A raw id may look like an escape, so these are walked in order."""
    raw = np.zeros(len(sel), bool)
    free = 0
    for z in np.flatnonzero(sel == ESCAPE).tolist():
        if z >= free:
            raw[z + 1] = True
            free = z + 2
    return raw


def pack_shard(doc_ids: list, arrays: list[np.ndarray], first_row: int, block: int = BLOCK_IDS) -> bytes:
    ids = np.concatenate(arrays) if arrays else np.zeros(0, np.uint32)
    words, offsets = encode_ids(ids, block)
    ends = np.cumsum([len(a) for a in arrays], dtype=np.uint64) if arrays else np.zeros(0, np.uint64)
    head = np.array([len(doc_ids), len(ids), len(offsets), block, len(words), first_row], "<u8")
    docs = np.array([NULL_ID if d is None else d for d in doc_ids], "<i8")
    return b"".join([MAGIC, head.tobytes(), docs.tobytes(), ends.astype("<u8").tobytes(),
                     offsets.astype("<u8").tobytes(), words.astype("<u8").tobytes()])


def read_block(blob: bytes, i: int) -> np.ndarray:
    """The ids of block ``i`` of a shard alone, found by its offset."""
    d, n, b, block, w, _ = (int(x) for x in np.frombuffer(blob, "<u8", 6, 8))
    offsets = np.append(np.frombuffer(blob, "<u8", b, 56 + 16 * d), w).astype(np.int64)
    words = np.frombuffer(blob, "<u8", w, 56 + 16 * d + 8 * b)
    return decode_ids(words[offsets[i]:offsets[i + 1]], min(block, n - i * block))


def unpack_shard(blob: bytes) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(document id, offset in the shard, ids) of every document of a shard file, in order."""
    if blob[:8] != MAGIC:
        raise ValueError("not a token shard")
    d, n, b, block, w, _ = (int(x) for x in np.frombuffer(blob, "<u8", 6, 8))
    at = 56
    docs = np.frombuffer(blob, "<i8", d, at)
    ends = np.frombuffer(blob, "<u8", d, at + 8 * d).astype(np.int64)
    words = np.frombuffer(blob, "<u8", w, at + 16 * d + 8 * b)
    ids = decode_ids(words, n)
    start = 0
    for doc, end in zip(docs.tolist(), ends.tolist()):
        yield None if doc == NULL_ID else doc, start, ids[start:end]
        start = end


# --- the tokenizer ---------------------------------------------------------------------------

# Letters for which NFC and lower-casing work letter by letter: ASCII and Latin-1.
_LETTERS = string.ascii_letters + "".join(chr(c) for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7))
_PLAIN = f"\\A[{_LETTERS}]+\\z"


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in own}
    for b in range(256):
        if b not in table:
            table[b] = chr(256 + len(table) - len(own))
    return table


class Chunks:
    """Encodes texts with a ``tokenizers`` file whose pre-tokenizer drops white space.

    No token then spans a space or line feed, so a text's ids are those of its chunks between
    spaces, one after the other. The distinct chunks of a few texts are encoded together: chunks of
    ASCII and Latin-1 letters with trailing ASCII punctuation are lower-cased, cut before the
    punctuation (a pre-token boundary) and their distinct letters given to the model itself in
    the byte-level alphabet, which skips the costly normaliser; every other chunk goes through
    the whole pipeline. A bounded number of both is kept from call to call, the letters' as arrays.
    ``plain`` says that the file is of that kind.
    """

    def __init__(self, path: str, plain: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.plain = plain
        self.letters = _byte_letters()
        self.whole: dict[str, array] = {}
        self.known = pa.array([], pa.large_string()), np.zeros(0, np.uint32), np.zeros(0, np.int32)  # words, ids, ids of each

    @staticmethod
    def of_worker(path: str) -> Chunks:
        """The encoder that this Python worker keeps from task to task."""
        return of_worker("token chunks", path, lambda: Chunks(path))

    def _wholes(self, chunks: list[str]) -> list[array]:
        """Ids of chunks that take the whole pipeline."""
        missing = [c for c in dict.fromkeys(chunks) if c not in self.whole]
        new = dict(zip(missing, (array("I", e.ids) for e in self.tokenizer.encode_batch(missing, add_special_tokens=False))))
        found = [new[c] if c in new else self.whole[c] for c in chunks]
        if len(self.whole) + len(new) > CACHE_CHUNKS:
            self.whole = {}
        self.whole.update(islice(((c, i) for c, i in new.items() if len(c) <= CACHE_LETTERS), CACHE_CHUNKS))
        return found

    def _bodies(self, bodies: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct lower-case words of letters, and how many each has."""
        bodies = bodies.cast(pa.large_string())
        words, ids, lengths = self.known
        at = pc.index_in(bodies, words)
        missing = bodies.filter(at.is_null())
        found, counts = array("I"), []
        for body in missing.to_pylist():
            tokens = self.model.tokenize(body if body.isascii() else body.encode().decode("latin-1").translate(self.letters))
            found.extend([t.id for t in tokens])
            counts.append(len(tokens))
        ids = np.concatenate((ids, np.frombuffer(found, np.uint32)))
        lengths = np.concatenate((lengths, np.array(counts, np.int32)))
        at = at.to_numpy(zero_copy_only=False)
        new = np.isnan(at)
        at = np.where(new, len(words) + np.cumsum(new) - 1, at).astype(np.int64)
        out = _taken(ids, lengths, at), lengths[at]
        # beyond the bound only what these texts hold is kept
        kept = pa.concat_arrays([words, missing]), ids, lengths
        for kept in (kept, (bodies, *out), (pa.array([], pa.large_string()), ids[:0].copy(), lengths[:0].copy())):
            if len(kept[0]) <= CACHE_WORDS and kept[0].nbytes <= CACHE_BYTES:
                break
        self.known = kept
        return out

    def _distinct(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct chunks, and how many each has."""
        body = pc.ascii_rtrim(chunks, string.punctuation)
        plain = pc.match_substring_regex(body, _PLAIN) if self.plain else pa.array(np.zeros(len(chunks), bool))
        is_plain = plain.to_numpy(zero_copy_only=False)
        bodies = pc.utf8_lower(body.filter(plain)).dictionary_encode()
        marks = pc.utf8_ltrim(chunks.filter(plain), _LETTERS).dictionary_encode()
        ids, counts = self._bodies(bodies.dictionary)
        others = self._wholes(marks.dictionary.to_pylist() + chunks.filter(pa.array(~is_plain)).to_pylist())
        ids = np.concatenate((ids, *(np.frombuffer(o, np.uint32) for o in others)))
        lengths = np.concatenate((counts, np.array([len(o) for o in others], np.int32), np.zeros(1, np.int32)))
        # of two parts each: letters and marks, or the whole and nothing
        parts = np.full((len(chunks), 2), len(lengths) - 1, np.int32)
        parts[is_plain, 0] = bodies.indices.to_numpy(zero_copy_only=False)
        parts[is_plain, 1] = marks.indices.to_numpy(zero_copy_only=False) + len(counts)
        parts[~is_plain, 0] = np.arange(len(marks.dictionary), len(others)) + len(counts)
        return _taken(ids, lengths, parts.reshape(-1)), lengths[parts].sum(axis=1)

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of ``texts``, one text after the other and each with ``end_id`` behind it, and where each ends."""
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        many = np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False), dtype=np.int64)
        coded = split.flatten().dictionary_encode()
        ids, lengths = self._distinct(coded.dictionary)
        # the end id is one more chunk, behind the last one of each text
        chunk = np.insert(coded.indices.to_numpy(zero_copy_only=False), many, len(lengths))
        ids, lengths = np.append(ids, np.uint32(end_id)), np.append(lengths, 1)
        return _taken(ids, lengths, chunk), np.cumsum(lengths[chunk])[many + np.arange(len(many))]


def _taken(ids: np.ndarray, lengths: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """The ids of ``runs``, one run after the other, where ``ids`` holds runs of ``lengths``."""
    size = lengths[runs]
    stop = np.cumsum(size, dtype=np.int64)
    at = np.repeat((np.cumsum(lengths, dtype=np.int64) - lengths)[runs] - (stop - size), size)
    at += np.arange(len(at))
    return ids[at]


def _pieces(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Consecutive rows whose texts hold about PIECE_BYTES, or one row of more."""
    for batch in batches:
        size = np.cumsum(pc.binary_length(batch.column(batch.schema.get_field_index(column))).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + PIECE_BYTES, side="right")))
            yield batch.slice(at, end - at)
            at = end


# --- the operator ----------------------------------------------------------------------------

def _open(directory: str):
    if "://" not in directory:
        directory = "file://" + directory.removeprefix("file:")
    return pafs.FileSystem.from_uri(directory)


def write_token_shards(docs: DataFrame, directory: str, tokenizer_path: str, *, id_col: str = "doc_id",
                       text_col: str = "text", end_id: int = END_ID, shard_ids: int = SHARD_IDS,
                       block: int = BLOCK_IDS) -> DataFrame:
    """Encode every whole text (null: empty) and write shard files in ascending id order; the manifest.

    Texts are range-partitioned by id and each task streams its sorted rows into shards, written
    to a temporary name and renamed, with names that a repeated task gives again. Ties of ids are
    ordered by text, the null id comes first. Memory: one shard. The manifest (part, shard, path,
    n_docs, n_tokens, start) has a row a file; only those counts meet on the driver, to be summed.
    """
    spark = docs.sparkSession
    ordered = (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
               .repartitionByRange(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
               .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")
               .withColumn("part", F.spark_partition_id()))

    def write(batches):
        chunks = Chunks.of_worker(tokenizer_path)
        filesystem, root = _open(directory)
        filesystem.create_dir(root, recursive=True)
        doc_ids, arrays, held, shard, rows = [], [], 0, 0, 0

        def close(part):
            name = f"{root}/part-{part:06d}-{shard:06d}.s8b"
            temporary = f"{name}.{uuid.uuid4().hex}.tmp"
            with filesystem.open_output_stream(temporary) as out:
                out.write(pack_shard(doc_ids, arrays, rows, block))
            filesystem.move(temporary, name)
            return pa.RecordBatch.from_pydict({"part": [part], "shard": [shard], "path": [name],
                                               "n_docs": [len(doc_ids)], "n_tokens": [held]}, manifest_schema)

        part = None
        for piece in _pieces(batches, "text"):
            docs, texts, parts = (piece.column(piece.schema.get_field_index(n)) for n in ("doc_id", "text", "part"))
            part = parts[0].as_py()
            ids, ends = chunks.encode(texts, end_id)
            for doc, own in zip(docs.to_pylist(), np.split(ids, ends[:-1])):
                doc_ids.append(doc)
                arrays.append(own)
                held += len(own)
                if held >= shard_ids:
                    yield close(part)
                    rows, shard = rows + len(doc_ids), shard + 1
                    doc_ids, arrays, held = [], [], 0
        if doc_ids:
            yield close(part)

    manifest_schema = pa.schema([("part", pa.int64()), ("shard", pa.int64()), ("path", pa.string()),
                                 ("n_docs", pa.int64()), ("n_tokens", pa.int64())])
    manifest = table(ordered.mapInArrow(giving_back(write, keep=True), "part long, shard long, path string, n_docs long, n_tokens long"),
                     "token-manifest")
    files = manifest.select("part", "shard", "path", "n_docs", "n_tokens").orderBy("part", "shard").collect()
    rows, start = [], 0
    for f in files:
        rows.append((*f, start))
        start += f["n_tokens"]
    return spark.createDataFrame(rows, "part long, shard long, path string, n_docs long, n_tokens long, start long")


def read_token_shards(manifest: DataFrame, directory: str, with_ids: bool = True) -> DataFrame:
    """Read shard files back: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked, ids."""
    files = max(1, manifest.count())

    def read(batches):
        filesystem, _ = _open(directory)
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()),
                            ("ids_crc32", pa.int64()), ("ids", pa.list_(pa.int64()))])
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with filesystem.open_input_file(path) as f:
                    blob = f.read()
                out = ([], [], [], [], [])
                for doc, at, ids in unpack_shard(blob):
                    for column, value in zip(out, (doc, start + at, len(ids), zlib.crc32(ids.astype("<u4").tobytes()),
                                                   ids.astype(np.int64) if with_ids else None)):
                        column.append(value)
                    if len(out[0]) >= 500:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(out, schema)], schema=schema)
                        out = ([], [], [], [], [])
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(out, schema)], schema=schema)

    return (manifest.select("path", "start").repartition(files).mapInArrow(
        giving_back(read), "doc_id long, start long, n_tokens long, ids_crc32 long, ids array<long>"))


def token_digest(docs: DataFrame, tokenizer_path: str, **names) -> DataFrame:
    """Write the shards in the shared folder and return each document's digest as read from the files."""
    directory = shared_path(docs.sparkSession, "token-shards")
    return read_token_shards(write_token_shards(docs, directory, tokenizer_path, **names), directory, False).drop("ids")
