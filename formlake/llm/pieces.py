"""SentencePiece encoding of merge-type (BPE) models by backtracking, and decoding.

A text's encoding is what merging the best-scored neighbours gives, leftmost first. Instead of merging
the whole text, longest pieces are taken from left to right: an Aho-Corasick pass finds the longest
piece at every position, and a piece may follow another if merging the two pieces' characters again
gives just these two. Where it may not, the next shorter piece is tried; where none is left, the
position is marked in a bitfield of failed positions and the piece before it is shortened. A text
in which all neighbours fit is the encoding, so it is found without merging anything long.

Texts are encoded in stretches that no piece can reach over: from a word into the space before the
next one, or between characters that no piece holds side by side. Where a model's pieces allow such
cuts is read from the model itself.
"""

from __future__ import annotations

import math
import re
import struct
import sys
import types
from array import array
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"        # how pieces spell a space
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6  # kinds of pieces in a model file
KNOWN_STRETCHES = 200_000  # entries of each of the two generations of a worker's memo of encoded stretches
KNOWN_PAIRS = 500_000      # entries of its memo of pieces that may follow each other
MEMO_CHARS = 32            # longer stretches are encoded anew
OUT_IDS = 2_000_000        # ids in a batch that leaves a task
OUT_BYTES = 8_000_000      # bytes of texts in such a batch


# --- the model file --------------------------------------------------------------------------

def _fields(blob: bytes):
    """(number, value) of a message's fields: whole numbers, floats of four bytes, or bytes."""
    at = 0

    def number():
        nonlocal at
        value = shift = 0
        while True:
            byte = blob[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(blob):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        elif key & 7 == 2:
            size = number()
            yield key >> 3, blob[at:at + size]
            at += size
        elif key & 7 == 5:
            yield key >> 3, struct.unpack("<f", blob[at:at + 4])[0]
            at += 4
        else:
            yield key >> 3, blob[at:at + 8]
            at += 8


class Model:
    """Pieces, scores and spelling rules of a model file; refuses models whose rules it does not know."""

    def __init__(self, path: str):
        self.pieces: list[tuple[str, float, int]] = []
        trainer, rules = {}, {}
        for field, value in _fields(Path(path).read_bytes()):
            if field == 1:
                piece = dict(_fields(value))
                self.pieces.append((piece[1].decode(), piece.get(2, 0.0), piece.get(3, NORMAL)))
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                rules = dict(_fields(value))
        kinds = {k for *_, k in self.pieces}
        if trainer.get(3, 1) != 2 or not kinds <= {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("not a merge-type model of normal and byte pieces")
        if rules.get(2) or rules.get(4, 1) or not rules.get(5, 1) or not trainer.get(35) or trainer.get(24):
            raise ValueError("only models that keep texts and their white space as they are, with byte pieces, are known")
        self.prefix = SPACE if rules.get(3, 1) else ""
        self.unknown = trainer[44].decode() if 44 in trainer else " ⁇ "
        self.ids = {p: i for i, (p, _, k) in enumerate(self.pieces) if k == NORMAL}
        self.scores = {p: s for p, s, k in self.pieces if k == NORMAL}
        self.byte_ids = [0] * 256
        for i, (p, _, k) in enumerate(self.pieces):
            if k == BYTE:
                self.byte_ids[int(p[3:-1], 16)] = i


# --- encoding --------------------------------------------------------------------------------

def _stretches(pieces) -> str:
    """A pattern that cuts a text where no piece can reach over the cut.

    Characters that stand next to each other in a piece, and those tied to them, are one family; a
    stretch is a run of one family with the spaces before it. A character of no family is alone.
    """
    if any(SPACE in p.lstrip(SPACE) for p in pieces):
        return ".+"
    family: dict[str, str] = {}

    def root(c: str) -> str:
        while family.setdefault(c, c) != c:
            family[c] = c = family[family[c]]
        return c

    for word in (p.lstrip(SPACE) for p in pieces):
        for a, b in zip(word, word[1:]):
            family[root(a)] = root(b)
        if len(word) == 1 and word not in family and SPACE + word in pieces:
            family[word] = word  # only ever joined to a space before it
    runs: dict[str, list[str]] = {}
    for c in family:
        runs.setdefault(root(c), []).append(c)
    space = f"[ {SPACE}]"
    runs = ["[" + re.escape("".join(sorted(cs))) + "]+" for cs in sorted(runs.values(), key=len, reverse=True)]
    return "|".join([f"{space}*(?:{'|'.join(runs)})"] * bool(runs) + [f"{space}+", "."])


class Encoder:
    def __init__(self, model: Model):
        import ahocorasick

        self.model, self.scores = model, model.scores
        self.automaton = ahocorasick.Automaton()
        for piece in self.scores:
            self.automaton.add_word(piece, len(piece))
        self.automaton.make_automaton()
        self.shorter: dict[str, str] = {}
        self.fits: dict[tuple[str, str], bool] = {}
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.stretch = re.compile(_stretches(self.scores), re.S)

    def merged(self, text: str) -> list[str]:
        """The plain rule: the best-scored neighbours are joined first, of equal ones the leftmost."""
        parts, score, none = list(text), self.scores.get, -math.inf
        ranks = [score(a + b, none) for a, b in zip(parts, parts[1:])]
        while ranks:
            best = max(ranks)
            if best == none:
                break
            i = ranks.index(best)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = score(parts[i - 1] + parts[i], none)
            if i < len(ranks):
                ranks[i] = score(parts[i] + parts[i + 1], none)
        return parts

    def fit(self, left: str, right: str) -> bool:
        """Whether merging the two pieces' characters gives the two again; with ``left`` empty, whether a piece gives itself."""
        if len(self.fits) >= KNOWN_PAIRS:
            self.fits.clear()
        known = self.fits[left, right] = self.merged(left + right) == ([left, right] if left else [right])
        return known

    def next_shorter(self, piece: str) -> str | None:
        """The longest piece that a piece starts with, at least its first character; None for one character."""
        if len(piece) == 1:
            return None
        found = self.shorter.get(piece)
        if found is None:
            found = self.shorter[piece] = next(piece[:k] for k in range(len(piece) - 1, 0, -1) if k == 1 or piece[:k] in self.scores)
        return found

    def split(self, text: str) -> list[str]:
        """A stretch's pieces, by backtracking; characters without a piece stand for themselves."""
        size = len(text)
        longest, fits = [1] * size, self.fits
        for end, length in self.automaton.iter(text):
            start = end - length + 1
            if length > longest[start]:
                longest[start] = length
        failed, pieces, at, left = None, [], 0, ""  # failed: once there is one, a bit for each position
        piece = text[:longest[0]]
        while True:
            end = at + len(piece)
            if not (failed and failed[end >> 3] >> (end & 7) & 1):
                fit = fits.get((left, piece))
                if fit is None:
                    fit = self.fit(left, piece)
                if fit:
                    pieces.append(piece)
                    if end == size:
                        return pieces
                    at, left = end, piece
                    piece = text[at:at + longest[at]]
                    continue
            piece = self.next_shorter(piece)
            if piece is None:  # nothing fits here: the piece before must end elsewhere
                failed = failed or bytearray(size // 8 + 1)
                failed[at >> 3] |= 1 << (at & 7)
                piece = pieces.pop()
                at -= len(piece)
                left = pieces[-1] if pieces else ""

    def stretch_ids(self, text: str) -> bytes:
        """Ids of a stretch as 32-bit integers."""
        ids, pieces = self.model.ids, self.split(text)
        try:
            return array("i", map(ids.__getitem__, pieces)).tobytes()
        except KeyError:  # characters without a piece are spelled in bytes
            spelled = self.model.byte_ids
            return array("i", [i for p in pieces for i in ((ids[p],) if p in ids else [spelled[b] for b in p.encode()])]).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of a text as 32-bit integers."""
        if not text:
            return b""
        memo, out = self.memo, []
        for stretch in self.stretch.findall(self.model.prefix + text):
            ids = memo.get(stretch)
            if ids is None:
                ids = self.older.get(stretch) or self.stretch_ids(stretch.replace(" ", SPACE))
                if len(stretch) <= MEMO_CHARS:
                    if len(memo) >= KNOWN_STRETCHES:  # what is still in use moves on from the older one
                        self.older, self.memo = memo, {}
                        memo = self.memo
                    memo[stretch] = ids
            out.append(ids)
        return b"".join(out)


def _id_batch(docs: list, found: list[bytes]) -> pa.RecordBatch:
    ends = np.zeros(len(found) + 1, np.int32)
    np.cumsum([len(f) // 4 for f in found], out=ends[1:])
    ids = pa.array(np.frombuffer(b"".join(found), np.int32))
    return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), ids)], names=["doc_id", "ids"])


def encode_texts(docs: DataFrame, model: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, ids (array of the ids of the whole text, without begin and end).

    ``model`` is the path of the model file, the same on every machine. Null and empty texts have no
    ids. Rows are encoded each for itself, so nulls in the id, repeated rows and ties change
    nothing; a very long text is encoded whole, stretch by stretch. An empty table gives no rows.
    Columns other than the two are not read.
    """
    def run(batches):
        # a worker keeps its encoder, and with it what it has encoded before, from task to task
        kept = sys.modules.setdefault("_piece_encoders", types.ModuleType("_piece_encoders")).__dict__
        encoder = kept.get(model)
        if encoder is None:
            encoder = kept[model] = Encoder(Model(model))
        for batch in batches:
            docs, found, size = [], [], 0
            for doc, text in zip(batch.column(0), batch.column(1)):
                ids = encoder.encode(text.as_py() or "")
                docs.append(doc.as_py())
                found.append(ids)
                size += len(ids) // 4
                if size >= OUT_IDS:
                    yield _id_batch(docs, found)
                    docs, found, size = [], [], 0
            yield _id_batch(docs, found)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, ids array<int>")


# --- decoding --------------------------------------------------------------------------------

class Decoder:
    def __init__(self, model: Model):
        self.prefix = bool(model.prefix)
        self.kinds = [k for *_, k in model.pieces]
        self.spelled = [bytes([int(p[3:-1], 16)]) if k == BYTE else b"" if k == CONTROL else model.unknown.encode() if k == UNKNOWN
                        else p.replace(SPACE, " ").encode() for p, _, k in model.pieces]
        self.control = {i for i, k in enumerate(self.kinds) if k == CONTROL}
        self.first = [SPACE if k == NORMAL and p.startswith(SPACE) else "" for p, _, k in model.pieces]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: the space that encoding puts first is taken away; bytes that are no UTF-8 become U+FFFD each."""
        parts = list(map(self.spelled.__getitem__, ids))
        if self.prefix:  # control pieces do not count as the first one
            first = next((k for k, i in enumerate(ids) if self.kinds[i] != CONTROL), None)
            if first is not None and self.first[ids[first]]:
                parts[first] = parts[first][1:]
        try:
            if self.control.isdisjoint(ids):
                return b"".join(parts).decode()
        except UnicodeDecodeError:
            pass
        # bytes on both sides of a control piece are not one character
        out, run = [], []
        for i, part in zip(ids, parts):
            if i in self.control:
                out.append(_each_invalid_byte(b"".join(run)))
                run = []
            run.append(part)
        return "".join(out) + _each_invalid_byte(b"".join(run))


def _each_invalid_byte(blob: bytes) -> str:
    out = []
    while blob:
        try:
            out.append(blob.decode())
            break
        except UnicodeDecodeError as e:
            out.append(blob[:e.start].decode() + "�")
            blob = blob[e.start + 1:]
    return "".join(out)


def decode_ids(encoded: DataFrame, model: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row of ``encoded``: doc_id, ids, text. Null and empty ids give the empty text, which stays a row."""
    def run(batches):
        decoder = Decoder(Model(model))
        for batch in batches:
            lists, start, size, texts = batch.column(1), 0, 0, []
            for k in range(batch.num_rows):
                ids = lists[k].values
                texts.append(decoder.decode(ids.to_numpy(zero_copy_only=False).tolist()) if ids is not None else "")
                size += len(texts[-1])
                if size >= OUT_BYTES or k + 1 == batch.num_rows:
                    part = batch.slice(start, len(texts))
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])
                    start, size, texts = k + 1, 0, []

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(
        run, "doc_id long, ids array<int>, text string")
