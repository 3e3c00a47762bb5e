"""Toxicity scores: Levenshtein automata intersected with a lexicon trie, and context windows.

A lexicon (whole words, and stems that stand for all words they begin) is learned from labelled
training rows by smoothed log-odds of document frequency. The trie of its terms is intersected
with the Levenshtein automata of bounded edit distance; the product is determinised lazily, so a
text word costs one table step per character and most die after a few. A stem is granted the edits of
its length as a word is; a word's beginning within them is a hit, whatever ending follows. For each hit the words
around it decide whether it stands in quotation or is abuse. A logistic model over hit counts by
edit distance and context gives the score.
"""

from __future__ import annotations

import bisect
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import giving_back, hash_share, of_worker

SAMPLE_ROWS = 20_000   # labelled training rows used to fit, at most (chosen by hash of the id)
MIN_RATIO = 10.8       # likelihood ratio of a term over chance (one in a thousand)
MIN_DOCS = 5           # labelled documents that a term must occur in
MIN_LOG_ODDS = 2.5
STEM_LENGTHS = range(4, 9)
WINDOW = 8             # words looked at on either side of a hit
THRESHOLD = 0.7
STATES = 100_000       # determinised states kept by a worker
MEMO = 300_000         # words remembered by a worker
COUNTED_TERMS = 400_000  # terms counted by a task before they are handed on
_TOKEN = re.compile(r"[^\W_]+|[\"“”«»„]")
_QUOTES = frozenset("\"“”«»„")
FEATURES = ("exact", "near", "distinct", "density", "quoted", "clustered")


def allowed_edits(term: str) -> int:
    """Edits granted to a term: longer words are still recognisable with more of them."""
    return 0 if len(term) < 5 else 1 if len(term) < 8 else 2


class LexiconAutomaton:
    """Trie of the lexicon times the terms' Levenshtein automata, determinised as words need it."""

    def __init__(self, terms: list[tuple[str, bool]]):
        """``terms``: (text, whether it is a stem that any ending may follow)."""
        self.children: list[dict[str, int]] = [{}]
        self.grant = [0]              # most edits that a term below the node is granted
        self.ends: list[tuple[int, bool] | None] = [None]
        self.names: list[str] = [""]
        for term, stem in terms:
            node, grant = 0, allowed_edits(term)
            self.grant[0] = max(self.grant[0], grant)
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.grant.append(0)
                    self.ends.append(None)
                    self.names.append(self.names[node] + c)
                node = self.children[node][c]
                self.grant[node] = max(self.grant[node], grant)
            self.ends[node] = (grant, stem or bool(self.ends[node] and self.ends[node][1]))
        self.reset()

    def reset(self) -> None:
        self.numbers: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.steps: list[dict[str, int]] = []
        self.known: set[str] = set()
        self.hits: dict[str, tuple[int, str]] = {}
        self.dead = self._number({}, None)
        self.start = self._number(self._closure({0: 0}), None)

    def _closure(self, nodes: dict[int, int]) -> dict[int, int]:
        """Adds the nodes reached by leaving out letters of a term."""
        todo = list(nodes)
        while todo:
            node = todo.pop()
            edits = nodes[node] + 1
            for child in self.children[node].values():
                if edits <= self.grant[child] and nodes.get(child, 99) > edits:
                    nodes[child] = edits
                    todo.append(child)
        return nodes

    def _number(self, nodes: dict[int, int], stem: tuple[int, str] | None) -> int:
        key = (tuple(sorted(nodes.items())), stem)
        n = self.numbers.get(key)
        if n is None:
            n = self.numbers[key] = len(self.states)
            self.states.append(key)
            self.steps.append({})
        return n

    def _step(self, state: int, c: str) -> int:
        nodes, stem = self.states[state]
        after: dict[int, int] = {}

        def reach(node, edits):
            if edits <= self.grant[node] and after.get(node, 99) > edits:
                after[node] = edits

        for node, edits in nodes:
            child = self.children[node].get(c)
            if child is not None:
                reach(child, edits)
            reach(node, edits + 1)
            for other in self.children[node].values():
                reach(other, edits + 1)
        after = self._closure(after)
        for node, edits in after.items():
            end = self.ends[node]
            if end and end[1] and edits <= end[0] and (stem is None or (edits, self.names[node]) < stem):
                stem = (edits, self.names[node])
        if stem is not None:  # terms of more edits are no nearer; without an edit the stem is the nearest
            after = {node: edits for node, edits in after.items() if edits <= stem[0]} if stem[0] else {}
        n = self.steps[state][c] = self._number(after, stem)
        return n

    def find(self, word: str) -> tuple[int, str] | None:
        """(edits, term) of the nearest term within its granted edits, or None."""
        state, steps, dead = self.start, self.steps, self.dead
        for c in word:
            nxt = steps[state].get(c)
            state = self._step(state, c) if nxt is None else nxt
            if state == dead:
                return None
        nodes, stem = self.states[state]
        best = stem
        for node, edits in nodes:
            end = self.ends[node]
            if end and edits <= end[0] and (best is None or (edits, self.names[node]) < best):
                best = (edits, self.names[node])
        return best

    def hits_among(self, words: set[str]) -> dict[str, tuple[int, str]]:
        """What ``find`` gives for those of ``words`` that hit; words are remembered within a bound."""
        if len(self.states) > STATES or len(self.known) > MEMO:
            self.reset()
        for word in words.difference(self.known):
            found = self.find(word)
            if found is not None:
                self.hits[word] = found
        self.known |= words
        return {w: self.hits[w] for w in words & self.hits.keys()}

    @staticmethod
    def of_worker(terms: list[tuple[str, bool]]) -> LexiconAutomaton:
        """The automaton of ``terms`` that this Python worker keeps from task to task (the last one only)."""
        return of_worker("lexicon automaton", terms, lambda: LexiconAutomaton(terms))


def features(text: str, lexicon: LexiconAutomaton) -> list[float]:
    """Features of a whole text, see FEATURES; zeros for an empty one."""
    tokens = _TOKEN.findall(text.lower())
    found = lexicon.hits_among(set(tokens))
    if not found:
        return [0.0] * len(FEATURES)
    hits = [(i, *found[token]) for i, token in enumerate(tokens) if token in found]
    exact = near = quoted = clustered = 0.0
    marks = [i for i, token in enumerate(tokens) if token in _QUOTES]
    for j, (i, edits, _) in enumerate(hits):
        before = bisect.bisect(marks, i)
        if before % 2 and before < len(marks):  # after an open quotation mark, before one that closes it
            quoted += 1
        elif edits == 0:
            exact += 1
        else:
            near += 1
        clustered += j > 0 and i - hits[j - 1][0] <= WINDOW
    return [math.log1p(exact), math.log1p(near), math.log1p(len({h[2] for h in hits})),
            math.log1p(1000.0 * len(hits) / max(1, len(tokens))), math.log1p(quoted), math.log1p(clustered)]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights (intercept first) by Newton steps with a ridge penalty."""
    a = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(a.shape[1])
    penalty = ridge * np.eye(a.shape[1])
    penalty[0, 0] = 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (p - y) + penalty @ w
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + penalty, grad)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def learn_lexicon(labelled: DataFrame) -> list[tuple[str, bool]]:
    """Terms and stems from rows (text, toxic 0/1); those come to the driver that occur with toxic rows beyond chance."""

    def run(batches):
        counts: tuple[Counter, Counter] = (Counter(), Counter())  # documents by term, of label 0 and 1

        def flush():
            out = [pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array([label] * len(c), pa.int32()),
                                               pa.array(list(c.values()), pa.int64())], names=["term", "toxic", "n"])
                   for label, c in enumerate(counts)]
            for c in counts:
                c.clear()
            return out

        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = set(_TOKEN.findall((text or "").lower())) - _QUOTES
                terms = {w + "$" for w in words}
                for n in STEM_LENGTHS:
                    terms.update([w[:n] for w in words if len(w) >= n])
                counts[1 if label else 0].update(terms)
                if len(counts[0]) + len(counts[1]) > COUNTED_TERMS:
                    yield from flush()
        yield from flush()

    total = labelled.agg(F.sum("toxic"), F.count(F.lit(1))).first()
    bad, good = total[0] or 0, (total[1] or 0) - (total[0] or 0)
    if not bad or not good:
        return []
    counted = labelled.select("text", F.col("toxic").cast("int")).mapInArrow(run, "term string, toxic int, n long").groupBy("term").agg(
        F.sum(F.col("toxic") * F.col("n")).alias("bad"), F.sum((1 - F.col("toxic")) * F.col("n")).alias("good"))
    odds = F.log((F.col("bad") + 0.5) / (bad + 1)) - F.log((F.col("good") + 0.5) / (good + 1))
    n = F.col("bad") + F.col("good")

    def surprise(count: str, rate: float):
        return F.when(F.col(count) > 0, F.col(count) * F.log(F.col(count) / (n * F.lit(rate)))).otherwise(0.0)

    ratio = 2 * (surprise("bad", bad / (bad + good)) + surprise("good", good / (bad + good)))
    best = (counted.where(n >= MIN_DOCS).withColumn("odds", odds)
            .where((F.col("odds") >= MIN_LOG_ODDS) & (ratio >= MIN_RATIO)).collect())  # terms of the sampled rows
    kept: list[tuple[str, bool]] = []
    stems: set[str] = set()
    known = {r["term"]: r for r in best}
    for r in sorted(best, key=lambda r: (r["term"].endswith("$"), len(r["term"]), r["term"])):
        term = r["term"].removesuffix("$")
        stem = term == r["term"]
        if any(term[:n] in stems for n in STEM_LENGTHS):
            continue
        if stem:
            whole = known.get(term + "$")
            if whole is not None and whole["bad"] >= 0.9 * r["bad"]:
                continue  # the stem is hardly more than this word
            if any(o["bad"] >= 0.9 * r["bad"] for t, o in known.items() if t.startswith(term) and len(t) > len(term)):
                continue  # nor more than one longer term
            stems.add(term)
        kept.append((term, stem))
    return sorted(kept, key=lambda t: (-known[t[0] if t[1] else t[0] + "$"]["odds"], t))


def training_rows(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                  label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(text, toxic) of at most about ``sample_rows`` labelled ids with crc32(id as text) mod 3 <> 1, one text of each."""
    usable = (labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
              .select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic"))
              .where("crc32(cast(cast(doc_id as string) as binary)) % 3 <> 1")
              .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    picked = usable.where(hash_share(F.xxhash64("doc_id"), sample_rows, usable.count()))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = texts.join(F.broadcast(picked), "doc_id")  # bounded by sample_rows
    return found.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("toxic").alias("toxic")).select("text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, **names) -> tuple[list[tuple[str, bool]], np.ndarray]:
    """(lexicon, weights); with no labels of both kinds the lexicon is empty and scores are even odds or the base rate."""
    rows = training_rows(docs, labels, **names)
    lexicon = learn_lexicon(rows)
    scored = _scan(rows.withColumn("doc_id", F.col("toxic").cast("long")), lexicon, None)
    got = scored.select("doc_id", "found").collect()  # bounded by sample_rows
    if not got:
        return lexicon, np.zeros(len(FEATURES) + 1)
    return lexicon, fit_logistic(np.array([r[1] for r in got]), np.array([float(r[0]) for r in got]))


def _scan(rows: DataFrame, lexicon: list[tuple[str, bool]], weights: np.ndarray | None) -> DataFrame:
    """Features (``weights`` None) or scores of whole texts, in one narrow pass."""

    def run(batches):
        automaton = LexiconAutomaton.of_worker(lexicon)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            found = [features(t or "", automaton) for t in texts]
            if weights is None:
                yield pa.RecordBatch.from_arrays([ids, pa.array(found, pa.list_(pa.float64()))], names=["doc_id", "found"])
                continue
            z = np.array(found).reshape(-1, len(FEATURES)) @ weights[1:] + weights[0]
            score = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            held = [None if i is None else zlib.crc32(str(i).encode()) % 3 == 1 for i in ids.to_pylist()]
            yield pa.RecordBatch.from_arrays([ids, pa.array(held, pa.bool_()), pa.array(score, pa.float64()),
                                              pa.array((score >= THRESHOLD).astype(np.int32))],
                                             names=["doc_id", "held_out", "score", "predicted"])

    out = "doc_id long, found array<double>" if weights is None else "doc_id long, held_out boolean, score double, predicted int"
    return rows.select("doc_id", "text").mapInArrow(giving_back(run, keep=True), out)


def score_toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                   label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted (1 if score >= 0.7).

    Whole texts are scored; null and empty texts have no hits and get the model's base score. A
    null id is never used for learning and has a null ``held_out``; repeated rows give a row each.
    Without usable labels every score is 0.5. Labels, language, source and id are no inputs.
    """
    lexicon, weights = fit(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, sample_rows=sample_rows)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return _scan(rows, lexicon, weights)
