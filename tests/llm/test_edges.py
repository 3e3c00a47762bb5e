"""Edges of the corpus operators: few or extreme components, repeated labelled ids, impossible budgets, hash samples."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F


def test_vectors_of_few_and_of_extreme_components(spark):
    from formlake.llm.vectors import near_vectors

    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=1 + i % 3).tolist(), "a") for i in range(120)]
    rows += [(200, [1e-170, 2e-170], "b"), (201, [1e-170, 2e-170], "b"), (202, [1.0, 2.0], "b"), (203, [-1e-170, 0.0], "b"),
             (204, [1e200, 1e200], "c"), (205, [1e200, 1e200], "c"), (206, [1e308, 1.1e308], "c"), (207, [5e-324, 0.0], "c")]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept)
           for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()}
    x = {i: np.array(v) / np.abs(v).max() for i, v, _ in rows}
    x = {i: v / np.sqrt(v @ v) for i, v in x.items()}
    near = {i: {j for j, w, k in rows if j != i and k == label and len(w) == len(v) and x[i] @ x[j] >= .93} for i, v, label in rows}
    assert near[200] == {201, 202} and near[204] == {205, 206}
    assert {i: g[0] for i, g in got.items()} == {i: len(n) for i, n in near.items()}
    for i, n in near.items():
        group, todo = {i}, [i]
        while todo:
            fresh = near[todo.pop()] - group
            group |= fresh
            todo += fresh
        assert got[i][1:] == (min(group), i == min(group))


def test_one_text_of_a_labelled_id_is_learned_from(spark):
    from formlake.llm.toxicity import score_toxicity, training_rows

    docs = spark.createDataFrame([(7, f"text {i}") for i in range(500)] + [(i, f"other {i}") for i in range(100, 140)] + [(None, "n")],
                                 "doc_id long, text string")
    labels = spark.createDataFrame([(7, 1), (7, 0)] + [(i, i % 2) for i in range(100, 140)], "doc_id long, toxic int")
    used = labels.where("crc32(cast(cast(doc_id as string) as binary)) % 3 <> 1").select("doc_id").distinct().count()
    got = training_rows(docs, labels)
    assert got.count() == used and sorted(map(str, got.collect())) == sorted(map(str, training_rows(docs.repartition(5), labels).collect()))
    assert training_rows(docs, labels, sample_rows=5).count() < used
    assert score_toxicity(docs, labels).count() == 541


@pytest.mark.parametrize("total", [1_000, 10**11, 10**15])
def test_hash_share_is_never_rounded_to_nothing(spark, total):
    from formlake.llm.common import hash_share

    bound = spark.range(1).select((F.lit(-2**63) + F.lit((4_000 << 64) // max(total, 4_001))).alias("b")) if total > 4_000 else None
    if bound is not None:  # the least hash is in the sample, and the share is right to one part in a million
        b = bound.first()[0]
        assert abs((b + 2**63) / 2**64 * total - 4_000) < 4_000 / 1e6 + total / 2**64
        assert spark.range(1).where(hash_share(F.lit(b - 1), 4_000, total)).count() == 1
        assert spark.range(1).where(hash_share(F.lit(b), 4_000, total)).count() == 0
    else:
        assert spark.range(10).where(hash_share(F.xxhash64("id"), 4_000, total)).count() == 10


def test_hash_share_of_rows(spark):
    from formlake.llm.common import hash_share

    n = spark.range(100_000).where(hash_share(F.xxhash64("id"), 5_000, 100_000)).count()
    assert 4_600 < n < 5_400


def test_impossible_budget(spark):
    from formlake.llm.mixture import mix_sources

    docs = spark.createDataFrame([(i, "a" if i % 3 else "b", "one two three") for i in range(100)], "doc_id long, source string, text string")
    with pytest.raises(ValueError):
        mix_sources(docs, repetition=1.0, budget=1000.0)
    got = mix_sources(docs, repetition=2.0, budget=450.0).collect()
    assert max(r.copies for r in got) <= 2 and abs(sum(r.copies * r.n_tokens for r in got) - 450) <= 6


def test_a_worker_keeps_one_operators_state():
    from formlake.llm import common

    made = []

    def state(name, key):
        return common.of_worker(name, key, lambda: made.append((name, key)) or len(made))

    def run(batches):
        yield from batches

    state("a", [1])
    first = len(made)
    assert state("a", [1]) == first and list(common.giving_back(run, keep=True)([7])) == [7] and state("a", [1]) == first
    assert state("b", [1]) == first + 1 and state("a", [1]) == first + 2  # one at a time
    assert list(common.giving_back(run)([7, 8])) == [7, 8] and state("a", [1]) == first + 3  # another operator ran
    assert made[-4:] == [("a", [1]), ("b", [1]), ("a", [1]), ("a", [1])]


def test_katz_counts_are_merged_in_place(monkeypatch):
    from formlake.llm import katz_blocks as kb

    u, w, n = (np.array(x) for x in ([5, 5, 9, 5], [1, 2, 1, 1], [1, 2, 3, 4]))
    parts = ([u[:2].astype(np.uint64), u[2:].astype(np.uint64)], [w[:2].astype(np.uint64), w[2:].astype(np.uint64)], [n[:2], n[2:]])
    got = kb._merged(parts)
    assert sorted(zip(*(x.tolist() for x in got))) == [(5, 1, 5), (5, 2, 2), (9, 1, 3)]
    assert parts == ([], [], [])
    monkeypatch.setattr(kb, "MERGE_PAIRS", 3)
    words = kb._Distinct()
    for i in range(50):
        words.add(np.arange(4, dtype=np.uint64), np.array([i % 7], np.uint64))
        assert words.held <= 2 * len(words.words) + 3
    assert words.united().tolist() == list(range(7))


def test_words_are_hashed_whole_texts_at_once(monkeypatch):
    import random

    from formlake.llm import common

    rng = random.Random(4)
    pieces = [b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r", b"a", b"A", b"\x00", "é".encode(), b"\x1c", b"\x85", b"\xa0", b"\xff", b"z"]
    texts = [b"".join(rng.choices(pieces, k=rng.choice([0, 1, 5, 30, 300]))) for _ in range(300)]
    texts += [b"q" * n for n in (7, 8, 9, 16, 63, 64, 65, 72, 1000)] + [b"", b" ", b"Q" * 1000 + b" " + b"\x00" * 3, b"\x00" * 2]
    for together in (1, 50, 1 << 20):
        monkeypatch.setattr(common, "TOGETHER_BYTES", together)
        got = list(common.text_hashes(texts, 5))
        hash_of, word_of = {}, {}
        for text, h in zip(texts, got, strict=True):
            words = common.lower_words(text)
            assert len(h) == len(words) + 1 and h[-1] == 5
            for word, x in zip(words, h.tolist()):
                assert hash_of.setdefault(word, x) == x and word_of.setdefault(x, word) == word
        assert len(hash_of) > 500
    assert list(common.text_hashes([], 5)) == []


def test_katz_second_words_travel_in_blocks(spark):
    from formlake.llm import katz_blocks as kb
    from formlake.llm.katz import GT_MAX, discounts

    rows = [(i, i, " ".join(f"w{(i * 37 + j * j) % 900}" for j in range(200)), i % 5 > 0) for i in range(40)]
    model = kb.PairModel(spark.createDataFrame(rows, "id long, row long, text string, train boolean"), discounts, GT_MAX)
    seen = model.items.where("kind = 'seen'")
    blocks = [(r["bucket"], r["key"], kb.Codes.words(model.codes, *kb.unpack(r["counts"]))) for r in seen.collect()]
    assert len({(b, part) for b, part, _ in blocks}) == len(blocks) <= model.buckets * model.parts
    assert sum(len(words) for _, _, words in blocks) > 2 * len(blocks)  # not a row for each word
    assert all((kb.parts_of(words, model.parts) == part).all() for _, part, words in blocks)
    first = {w for _, _, text, train in rows if train for w in text.split()}
    assert len({int(w) for _, _, words in blocks for w in words}) == len(first) + 1  # and the end
