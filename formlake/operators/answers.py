"""Answers against a template: matching, unknown keys, visible diffs, visibility changes.

The template side is a flattened item table of bounded size (broadcast); the answer side is
long ``(qid, key, value)`` or a map column, partitioned by qid.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formlake.operators.broadcast import small
from formlake.operators.evaluate import CompiledTemplate
from formlake.operators.windows import carry_forward, time_bucket, with_previous
from formlake.schemas import VALUE_TYPES

NO_VALUE_TYPES = ["block", "info", "spacer", "checkgroup", "radiogroup"]


def long_answers(df: DataFrame, keys=("qid",), answers: str = "answers") -> DataFrame:
    """Map column → ``(keys…, key, value)`` rows."""
    return df.select(*keys, F.explode(answers).alias("key", "value"))


def answer_items(answers: DataFrame, items: DataFrame) -> DataFrame:
    """Answers matched to their value item (type attached)."""
    it = items.where(F.col("type").isin(*VALUE_TYPES)).select(F.col("item_id").alias("key"), F.col("type"))
    return answers.join(small(it), "key")


def unknown_answers(answers: DataFrame, items: DataFrame) -> DataFrame:
    """Answers whose key names no item of the template."""
    return answers.join(small(items.select(F.col("item_id").alias("key"))), "key", "left_anti")


def valueless_answers(answers: DataFrame, items: DataFrame) -> DataFrame:
    """Answers addressed to blocks, groups, infos or spacers."""
    it = items.where(F.col("type").isin(*NO_VALUE_TYPES)).select(F.col("item_id").alias("key"))
    return answers.join(small(it), "key", "left_semi")


def diff_toc(diff: DataFrame, visibility: DataFrame) -> DataFrame:
    """K2: changed keys whose item exists and is displayed (``visibility`` from ``item_visibility``)."""
    shown = visibility.where("visible").select("qid", F.col("item_id").alias("key"))
    return diff.join(shown, ["qid", "key"], "left_semi")


def answer_versions(changes: DataFrame, keys: list[str]) -> DataFrame:
    """The answer map after every change event: ``(qid, ts, seq, answers)``.

    Rows of one event (same ``(qid, ts, seq)``) are folded first; then each template key
    carries its last value forward with one window per qid. ``keys`` are the template's value
    item ids (bounded), so every version map is bounded too.
    """
    per_event = changes.groupBy("qid", "ts", "seq").agg(
        *[F.max(F.when(F.col("key") == k, F.col("value"))).alias(f"_k{i}") for i, k in enumerate(keys)])
    carried = carry_forward(per_event, ["qid"], ["ts", "seq"], [f"_k{i}" for i in range(len(keys))],
                            time_bucket("ts"))
    entries = F.array(*[F.struct(F.lit(k).alias("key"), F.col(f"_k{i}").alias("value")) for i, k in enumerate(keys)])
    return carried.select("qid", "ts", "seq",
                          F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull())).alias("answers"))


def visibility_transitions(versions: DataFrame, tpl: CompiledTemplate) -> DataFrame:
    """Items that become shown or hidden from one version of a submission to the next.

    The previous version's answers are brought into the same row with ``lag`` over the qid's
    versions. An index from answer keys to the items they can show or hide says what to look at: a
    condition is evaluated, before and now, only where a key has changed that an item in need of it
    depends on; items that no answer moves are never looked at.
    """
    pairs = (with_previous(versions, ["qid"], ["ts", "seq"], ["answers"], time_bucket("ts"))
             .withColumn("prev_answers", F.col("_prev.answers")).where(F.col("_prev").isNotNull()).drop("_prev"))
    moved = tpl.visibility_keys()
    keys = sorted(set().union(*moved.values()))
    if not keys:
        return pairs.limit(0).select("qid", "seq", F.lit("").alias("item_id"), F.lit("").alias("event"))
    changed = {k: f"__changed_{n}" for n, k in enumerate(keys)}
    pairs = pairs.withColumns({c: ~F.col(tpl.answers)[k].eqNullSafe(F.col("prev_answers")[k]) for k, c in changed.items()})
    pairs = pairs.where(functools.reduce(lambda a, b: a | b, [F.col(c) for c in changed.values()]))

    def any_changed(of: set[str]):
        return functools.reduce(lambda a, b: a | b, [F.col(changed[k]) for k in sorted(of)])

    users: dict[str, set[str]] = {}
    for i, of in moved.items():
        for condition in tpl.needed_conditions(i):
            users.setdefault(condition, set()).update(of)
    gates = {condition: any_changed(of) for condition, of in users.items()}
    before = tpl.over("prev_answers", "p")
    evaluated = before.with_conditions(tpl.over(tpl.answers, "").with_conditions(pairs, gates), gates)
    flips = [F.when(any_changed(of) & (tpl.visible(i) != before.visible(i)),
                    F.struct(F.lit(i).alias("item_id"), F.when(tpl.visible(i), "SHOWN").otherwise("HIDDEN").alias("event")))
             for i, of in moved.items()]
    return evaluated.select("qid", "seq", F.inline(F.filter(F.array(*flips), lambda f: f.isNotNull())))
