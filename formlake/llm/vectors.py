"""Embedding near-dedup: epsilon grid order join.

Unit vectors are rotated to the data's principal axes and sorted by their grid cells on the leading
axes (cell width epsilon, the distance that the cosine threshold allows). The sequence is cut into
blocks with bounding boxes; block pairs whose boxes lie within epsilon are joined, each by
recursively halving both sequences and skipping halves that are provably distant, down to
intervals whose cosines are computed at once in double precision. Equal vectors are one point with
a multiplicity, so that groups of copies never meet as pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, table

THRESHOLD = 0.93
AXES = 4          # leading principal dimensions of the grid and the boxes
BLOCK = 512       # vectors of a block
LEAF = 64         # intervals up to this length are compared directly
SAFE = (1e-100, 1e100)  # largest components whose squares and their sums neither vanish nor overflow
MARGIN = 1e-6     # slack of the boxes for rounding; the cosines decide


def _points(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(vec_id, label, dim, vec): vec the components as little-endian doubles, null if the vector can't link."""

    def run(batches):
        for batch in batches:
            dims, blobs = [], []
            for values in batch.column(2).to_pylist():
                blob, dim = None, 0
                if values and not any(v is None for v in values):
                    x = np.array(values, "<f8")
                    if x.any() and np.isfinite(x).all():
                        blob, dim = _scaled(x).tobytes(), len(x)
                blobs.append(blob)
                dims.append(dim)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(dims, pa.int32()),
                                              pa.array(blobs, pa.binary())], names=["vec_id", "label", "dim", "vec"])

    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"),
                          F.col(vec_col).cast("array<double>").alias("vec"))
    return rows.mapInArrow(run, "vec_id long, label string, dim int, vec binary")


def _scaled(x: np.ndarray) -> np.ndarray:
    """``x``, brought to a size whose squares are in range by a power of two where they are not."""
    top = float(np.abs(x).max())
    return x if SAFE[0] < top < SAFE[1] else np.ldexp(x, -math.frexp(top)[1])


def _unit(blobs: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(blobs), "<f8").reshape(len(blobs), -1)
    return x / np.sqrt((x * x).sum(1))[:, None]


def principal_axes(points: DataFrame, axes: int = AXES) -> dict[int, np.ndarray]:
    """dim -> matrix (dim, axes) of leading eigenvectors of the second moments over all points."""

    def run(batches):
        for batch in batches:
            total: dict[int, np.ndarray] = {}
            for dim in set(batch.column(0).to_pylist()):
                x = _unit([b for d, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if d == dim])
                total[dim] = x.T @ x
            for dim, m in total.items():
                yield pa.RecordBatch.from_arrays([pa.array([dim] * dim, pa.int32()), pa.array(range(dim), pa.int32()),
                                                  pa.array(list(m), pa.list_(pa.float64()))], names=["dim", "row", "sums"])

    cells = points.select("dim", "vec").mapInArrow(run, "dim int, row int, sums array<double>").select(
        "dim", "row", F.posexplode("sums").alias("col", "x")).groupBy("dim", "row", "col").agg(F.sum("x").alias("x"))
    out: dict[int, np.ndarray] = {}
    for r in cells.collect():  # dim x dim numbers
        out.setdefault(r["dim"], np.zeros((r["dim"], r["dim"])))[r["row"], r["col"]] = r["x"]
    return {d: np.linalg.eigh((m + m.T) / 2)[1][:, ::-1][:, :axes] for d, m in out.items()}


def _blocks(classes: DataFrame, axes: dict[int, np.ndarray], eps: float) -> DataFrame:
    """Blocks of the sorted sequence: label, dim, blk, lo, hi (boxes), ids, counts, vecs."""

    def cells(batches):
        for batch in batches:
            dims, blobs = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            out = [np.floor((_unit([b]) @ axes[d])[0] / eps).astype(int).tolist() for d, b in zip(dims, blobs)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int32()))], names=[*batch.schema.names, "cell"])

    placed = classes.mapInArrow(cells, "label string, rep long, dim int, vec binary, n long, cell array<int>")
    order = ["label", "dim", *[F.get("cell", F.lit(i)) for i in range(AXES)], "rep"]
    ordered = placed.repartitionByRange(*order).sortWithinPartitions(*order)

    def cut(batches):
        held: list[tuple] = []

        def block():
            x = _unit([r[2] for r in held])
            y = x @ axes[held[0][1]]
            return pa.RecordBatch.from_arrays([
                pa.array([held[0][0]], pa.string()), pa.array([held[0][1]], pa.int32()), pa.array([held[0][3]], pa.int64()),
                pa.array([y.min(0).tolist()], pa.list_(pa.float64())), pa.array([y.max(0).tolist()], pa.list_(pa.float64())),
                pa.array([[r[3] for r in held]], pa.list_(pa.int64())), pa.array([[r[4] for r in held]], pa.list_(pa.int64())),
                pa.array([b"".join(r[2] for r in held)], pa.binary())],
                names=["label", "dim", "blk", "lo", "hi", "ids", "counts", "vecs"])

        for batch in batches:
            c = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
            for row in zip(c["label"], c["dim"], c["vec"], c["rep"], c["n"]):
                if held and (held[0][:2] != row[:2] or len(held) >= BLOCK):
                    yield block()
                    held = []
                held.append(row)
        if held:
            yield block()

    return ordered.mapInArrow(cut, "label string, dim int, blk long, lo array<double>, hi array<double>, ids array<long>, "
                                   "counts array<long>, vecs binary")


def _block_pairs(blocks: DataFrame, eps: float) -> DataFrame:
    """(label, dim, a, b), a <= b: blocks of a label with boxes within eps, found by equal cells of two axes."""
    meta = blocks.select("label", "dim", "blk", "lo", "hi")

    def cell(x, shift):
        return (F.floor(x / F.lit(eps)) + shift).cast("int")

    def spread(wide: int):
        out = meta
        for i in (0, 1):
            lo = F.get(F.col("lo"), F.lit(i))
            hi = F.get(F.col("hi"), F.lit(i))
            out = out.withColumn(f"c{i}", F.explode(F.sequence(F.coalesce(cell(lo, -wide), F.lit(0)), F.coalesce(cell(hi, wide), F.lit(0)))))
        return out

    a = spread(0).select("label", "dim", "c0", "c1", F.col("blk").alias("a"), F.col("lo").alias("la"), F.col("hi").alias("ha"))
    b = spread(1).select("label", "dim", "c0", "c1", F.col("blk").alias("b"), F.col("lo").alias("lb"), F.col("hi").alias("hb"))
    gap = F.aggregate(F.zip_with(F.zip_with("la", "hb", lambda x, y: x - y), F.zip_with("lb", "ha", lambda x, y: x - y),
                                 lambda x, y: F.greatest(x, y, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x * x)
    near = gap <= (eps + MARGIN) ** 2
    # the smaller block of a pair is the left one; a itself is among its own neighbours
    return a.join(b, ["label", "dim", "c0", "c1"]).where(near).select(
        "label", "dim", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _join_kernel(axes: dict[int, np.ndarray], threshold: float, eps: float):
    """Joins block pairs; yields link counts (id, null, n) and a spanning forest of links (id, other, 0)."""
    limit = (eps + MARGIN) ** 2

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                dim, same = row["dim"], row["a"] == row["b"]
                xa = _unit([row["va"][i:i + 8 * dim] for i in range(0, len(row["va"]), 8 * dim)])
                xb = xa if same else _unit([row["vb"][i:i + 8 * dim] for i in range(0, len(row["vb"]), 8 * dim)])
                ya, yb = xa @ axes[dim], xb @ axes[dim]
                na, nb = np.array(row["na"]), np.array(row["nb"])
                links_a, links_b = np.zeros(len(xa), np.int64), np.zeros(len(xb), np.int64)
                parent = list(range(len(xa) + len(xb)))
                forest = []

                def root(i):
                    while parent[i] != i:
                        parent[i] = parent[parent[i]]
                        i = parent[i]
                    return i

                def join(a0, a1, b0, b1):
                    if same and b1 <= a0:
                        return
                    gap = np.maximum(0, np.maximum(ya[a0:a1].min(0) - yb[b0:b1].max(0), yb[b0:b1].min(0) - ya[a0:a1].max(0)))
                    if float(gap @ gap) > limit:
                        return
                    if max(a1 - a0, b1 - b0) > LEAF:
                        if a1 - a0 > LEAF:
                            m = (a0 + a1) // 2
                            parts = [(a0, m), (m, a1)]
                        else:
                            parts = [(a0, a1)]
                        if b1 - b0 > LEAF:
                            m = (b0 + b1) // 2
                            others = [(b0, m), (m, b1)]
                        else:
                            others = [(b0, b1)]
                        for p in parts:
                            for q in others:
                                join(*p, *q)
                        return
                    hit = xa[a0:a1] @ xb[b0:b1].T >= threshold
                    if same:
                        hit &= np.arange(a0, a1)[:, None] < np.arange(b0, b1)[None, :]
                    links_a[a0:a1] += hit @ nb[b0:b1]
                    links_b[b0:b1] += na[a0:a1] @ hit
                    for i, j in zip(*np.nonzero(hit)):
                        u, v = int(a0 + i), int(b0 + j) + (0 if same else len(xa))
                        ru, rv = root(u), root(v)
                        if ru != rv:
                            parent[ru] = rv
                            forest.append((row["ia"][u], row["ib"][int(b0 + j)]))

                join(0, len(xa), 0, len(xb))
                ids = [*row["ia"], *row["ib"], *[f[0] for f in forest]]
                others = [None] * (len(xa) + len(xb)) + [f[1] for f in forest]
                n = [*links_a.tolist(), *links_b.tolist(), *[0] * len(forest)]
                keep = [k for k in range(len(ids)) if n[k] or others[k] is not None]
                yield pa.RecordBatch.from_arrays([pa.array([c[k] for k in keep], pa.int64()) for c in (ids, others, n)],
                                                 names=["id", "other", "n"])

    return run


def near_vectors(vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                 threshold: float = THRESHOLD) -> DataFrame:
    """Per row: vec_id, n_links (other rows linked directly), component_id (smallest id reachable), kept.

    Only rows of equal, non-null label and equal dimension are compared; links are cosine >=
    ``threshold``. Vectors that are null, empty, zero or hold null or non-finite components, and
    rows without label or id, link with nothing: n_links 0, component_id their own id (null for a
    null id), kept true. Repeated rows are copies of a vector and link with one another. The
    threshold must be positive, as the grid holds for angles under a right one.
    """
    eps = math.sqrt(2 - 2 * threshold)
    points = table(_points(vectors, id_col, vec_col, label_col), "vectors")
    usable = points.where("vec is not null and label is not null and vec_id is not null")
    classes = table(usable.groupBy("label", "dim", "vec").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"))
                    .select("label", "rep", "dim", "vec", "n"), "vector-classes")
    axes = principal_axes(classes.select("dim", "vec"))
    blocks = table(_blocks(classes, axes, eps), "vector-blocks")
    pairs = _block_pairs(blocks, eps)
    side = blocks.select("label", "dim", "blk", "ids", "counts", "vecs")
    tasks = (pairs.join(side.select("label", "dim", F.col("blk").alias("a"), F.col("ids").alias("ia"), F.col("counts").alias("na"),
                                    F.col("vecs").alias("va")), ["label", "dim", "a"])
             .join(side.select("label", "dim", F.col("blk").alias("b"), F.col("ids").alias("ib"), F.col("counts").alias("nb"),
                               F.col("vecs").alias("vb")), ["label", "dim", "b"]))
    found = table(tasks.select("dim", "a", "b", "ia", "na", "va", "ib", "nb", "vb").mapInArrow(
        _join_kernel(axes, threshold, eps), "id long, other long, n long"), "vector-links")
    groups = components(found.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")))
    per = (found.where("other is null").groupBy("id").agg(F.sum("n").alias("others"))
           .join(groups, "id", "full"))
    known = classes.join(per, F.col("rep") == F.col("id"), "left").select(
        "label", "dim", "vec", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"),
        F.coalesce("component", "rep").alias("component_id"))
    out = points.join(known, ["label", "dim", "vec"], "left").select(
        "vec_id", F.when(F.col("vec_id").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
        F.when(F.col("vec_id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("component_id", "vec_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").isNull() | (F.col("vec_id") == F.col("component_id")))
