"""Merkle manifest, source divergences and pieces against brute force, the SentencePiece library and odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, idx long, tree string, term string, ids string, rank int"


@pytest.fixture(scope="module")
def rows():
    """Nulls in every column, empty and very long texts, repeated rows, ties and a hot source."""
    rng = random.Random(5)
    words = ["Ärger", "the", "The", "of", "x1y", "naïve", "日本", "a", "\x00", "don't", "pages"]

    def prose(n):
        return rng.choice(["", " ", "\n"]).join(rng.choice(words) + rng.choice([" ", "\n", "  ", ", "]) for _ in range(n))

    out = [(i, prose(rng.randrange(60)), rng.choice(["en", "de", "en", None, ""]), rng.choice(["hot", "hot", "b", "c", None, ""]), i * 3) for i in range(230)]
    out += [(7, None, "en", "b", None), (None, "the of", "en", "hot", 3), (None, None, None, None, None), (9, "", "fr", "only", 0),
            (11, "same", "en", "hot", 4), (11, "same", "en", "hot", 4), (500, "the " * 60_000, "en", "b", 240_000), (501, "x" * 150_000, "de", "hot", None)]
    return [(*r, "junk", -1, "junk", "junk", "junk", -1) for r in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# --- Merkle manifest -------------------------------------------------------------------------

def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(values):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree_of(leaves):
    """(root, for each leaf its siblings: (left digests, right digests) from below)."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([h(*now[i:i + 3]) for i in range(0, len(now), 3)])
    paths = []
    for i in range(len(leaves)):
        path = []
        for level in levels[:-1]:
            run = level[i // 3 * 3:i // 3 * 3 + 3]
            path.append((run[:i % 3], run[i % 3 + 1:]))
            i //= 3
        paths.append(path)
    return levels[-1][0], paths


def manifest_truth(rows):
    trees = defaultdict(list)
    for doc, text, lang, source, n, *_ in rows:
        even = doc is not None and zlib.crc32(str(doc).encode()) % 2 == 0
        shown = text.replace("\n", "") if even and text is not None else text
        trees[source].append(((doc is not None, doc or 0), leaf_of((doc, source, lang, n, text)), leaf_of((doc, source, lang, n, shown)), doc))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    below = {s: tree_of([leaf for _, leaf, _, _ in sorted(trees[s], key=lambda r: r[:3])]) for s in order}
    root, upper = tree_of([below[s][0] for s in order])
    out = []
    for s, top in zip(order, upper):
        for (_, leaf, shown, doc), path in zip(sorted(trees[s], key=lambda r: r[:3]), below[s][1]):
            folded = shown
            for left, right in path + top:
                folded = h(*left, folded, *right)
            proof = "".join(d for left, right in path + top for d in left + right)
            out.append((doc, leaf, below[s][0], root, h(proof), folded, folded == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("levels", [1, 2, 7])
def test_merkle_manifest(spark, docs, rows, levels):
    from pyspark.sql import functions as F

    from formlake.llm.merkle import merkle_manifest, proof_digests

    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    text = F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    found = merkle_manifest(docs, shown={"text": text}, levels=levels)
    got = found.select("doc_id", "leaf", "subroot", "root", F.sha2(proof_digests(F.col("proof")), 256), "folded_root", "verified")
    assert sorted(map(tuple, got.collect()), key=str) == manifest_truth(rows)


def test_merkle_manifest_of_few_rows(spark, none):
    from formlake.llm.merkle import merkle_manifest

    assert merkle_manifest(none).collect() == []
    one = spark.createDataFrame([(1, "t", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    row = merkle_manifest(one).first()
    assert row.leaf == row.subroot == row.root == row.folded_root == leaf_of((1, "s", "en", 1, "t")) and row.proof == "" and row.verified


# --- source divergences ----------------------------------------------------------------------

def divergence_truth(rows, min_docs):
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        groups.add((lang, source))
        docs[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        sources = sorted(s for g, s in groups if g == lang)

        def shares(count):
            n = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 5) // (n + 5 * len(kept)) for t in kept}

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", sorted(terms, key=lambda x: (-x[0], x[1].encode()))[:50])):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(ranked)]
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_source_divergences(docs, rows, small, monkeypatch):
    from formlake.llm import divergence

    if small:  # spills, buckets and tiles of a few
        for name, value in {"STRIPE_CELLS": 20, "BUCKET_STRIPES": 2, "TILE": 2, "BLOCK_CELLS": 3}.items():
            monkeypatch.setattr(divergence, name, value)
    got = divergence.source_divergences(docs).select("lang", "source", "part", "item", "value", "rank")
    assert sorted(map(tuple, got.collect())) == divergence_truth(rows, 30)
    few = divergence.source_divergences(docs, min_docs=1).select("lang", "source", "part", "item", "value", "rank")
    assert sorted(map(tuple, few.collect())) == divergence_truth(rows, 1)


def test_source_divergences_of_nothing(spark, none):
    from formlake.llm.divergence import source_divergences

    assert source_divergences(none).collect() == []
    blank = spark.createDataFrame([(None, "en", "a"), ("1 2", "en", "b"), ("", None, None)], "text string, lang string, source string")
    assert sorted(map(tuple, source_divergences(blank).collect())) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_probabilities_of_huge_counts_are_exact():
    from formlake.llm.divergence import _probability, _whole

    huge = [10**13 + 7, 3, 9 * 10**15]
    got = _probability(_whole(huge), _whole([10**16 + 1] * 3), 12_345)
    assert [int(x) for x in got] == [1 + 10**9 * (c + 5) // (10**16 + 1 + 5 * 12_345) for c in huge]


# --- pieces ----------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def model():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library(model):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model)


def test_pieces_of_rows(docs, rows, none, model, library):
    from formlake.llm.pieces import decode_ids, encode_texts

    encoded = encode_texts(docs, model)
    want = sorted(((r[0], library.encode(r[1] or "")) for r in rows), key=str)
    assert sorted(((r.doc_id, list(r.ids)) for r in encoded.collect()), key=str) == want
    decoded = decode_ids(encoded, model).collect()
    assert sorted(((r.doc_id, r.text) for r in decoded), key=str) == sorted(((d, library.decode(i)) for d, i in want), key=str)
    assert encode_texts(none, model).collect() == [] and decode_ids(encode_texts(none, model), model).collect() == []


def test_pieces_equal_the_library(model, library):
    import numpy as np

    from formlake.llm.pieces import Decoder, Encoder, Model

    read = Model(model)
    encoder, decoder, rng = Encoder(read), Decoder(read), random.Random(2)
    pieces = list(read.scores)
    kinds = [lambda: "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 12))),
             lambda: "".join(rng.choice("ab  \n\t▁é門") for _ in range(rng.randrange(40))),
             lambda: "".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x3000), rng.randrange(0x10000, 0x11000)])) for _ in range(30)),
             lambda: " " * rng.randrange(90) + rng.choice(["a", "the", "", "\n"]) + " " * rng.randrange(60),
             lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(1, 60))),
             lambda: rng.choice("abcdefx-=.") * rng.randrange(1, 120)]
    for k in range(6000):
        text = kinds[k % len(kinds)]()
        ids = np.frombuffer(encoder.encode(text), np.int32).tolist()
        assert ids == library.encode(text), repr(text)
        assert decoder.decode(ids) == library.decode(ids)
        ids = [rng.choice([rng.randrange(3), rng.randrange(3, 259), rng.randrange(32_000), 28705]) for _ in range(rng.randrange(10))]
        assert decoder.decode(ids) == library.decode(ids), ids
    for text in ("x" * 200_000, "".join(rng.choice("etaoinshrdlu") for _ in range(100_000)), " " * 100_000):
        assert np.frombuffer(encoder.encode(text), np.int32).tolist() == library.encode(text)


def test_backtracking_equals_merging(model):
    """Without the cut into stretches: whole strings, merged plainly."""
    from formlake.llm.pieces import Encoder, Model

    encoder, rng = Encoder(Model(model)), random.Random(4)
    for _ in range(3000):
        text = "".join(rng.choice(["lowe", "er", "re", "st", "ing", "in", "▁the", "▁", "e", "es", "▁▁▁"]) for _ in range(rng.randrange(1, 12)))
        assert encoder.split(text) == encoder.merged(text)
