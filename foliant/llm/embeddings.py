"""Embedding near-duplicates by a pivot-permutation index.

Every vector is described by its nearest reference points, in order. Inverted lists hold, for each label and
pivot, the vectors that name the pivot; vectors of one list that share enough pivots are compared by exact
cosine.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import connected_components, merge_labels, numpy_column, stage

#: Vectors that serve as pivots: the square root of the number of different vectors, within these bounds, and no more
#: than fit in so many bytes, since every task holds them.
PIVOTS, PIVOT_BYTES = (32, 32768), 64 << 20
#: Pivots that describe a vector, and how many of them two vectors must share to be compared.
NEAREST, SHARED = 8, 2
#: Vectors of one list that one task holds; longer lists are compared block by block.
BLOCK = 1024


def usable(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """Rows that can link: labelled, no null or non-finite component, not zero."""
    picked = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = F.expr("forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(v, x -> x <> 0)")
    return picked.where("label IS NOT NULL AND vec_id IS NOT NULL AND v IS NOT NULL").where(fine)


def unit_rows(lists: pa.Array, width: int) -> np.ndarray:
    """The vectors as rows of unit length; scaled first, so that squares neither overflow nor vanish."""
    rows = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def pivots_of(classes: DataFrame, n: int) -> np.ndarray:
    """The vectors of the lowest hashes: a bounded sample, the same for the same vectors."""
    rows = classes.select("v", F.xxhash64("v").alias("h")).orderBy("h", "v").limit(n).collect()
    return np.array([r.v for r in rows], dtype=np.float64)


def described(classes: DataFrame, pivots: np.ndarray, nearest: int) -> DataFrame:
    """`classes` with nearest (array<int>): the pivots nearest to each vector, in order."""
    width = pivots.shape[1]
    lows = pivots / np.abs(pivots).max(axis=1, keepdims=True)
    unit = (lows / np.sqrt((lows * lows).sum(axis=1, keepdims=True))).T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = unit_rows(batch.column("v"), width) @ unit
            top = np.argsort(-score, axis=1, kind="stable")[:, :nearest].astype(np.int32)
            lists = pa.ListArray.from_arrays(np.arange(len(top) + 1, dtype=np.int32) * top.shape[1], pa.array(top.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "nearest"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in classes.schema) + ", nearest array<int>"
    return classes.mapInArrow(run, schema)


def list_links(table: pa.Table, width: int, threshold: float, shared: int, pivot_count: int) -> pa.Table:
    """Links within one list, or between two blocks of it: what each class gains, and edges that span them.

    A pair that meets in several lists counts in that of its lowest shared pivot.
    """
    pivot, side = table.column("pivot")[0].as_py(), numpy_column(table, "side")
    lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
    vectors = unit_rows(table.column("v").combine_chunks(), width)
    top = table.column("nearest").combine_chunks().flatten().to_numpy().reshape(len(vectors), -1)
    named = np.zeros((len(vectors), pivot_count), dtype=np.float32)
    np.put_along_axis(named, top.astype(np.int64), 1.0, axis=1)
    below = named.copy()
    below[:, pivot:] = 0
    node, copies = numpy_column(table, "node"), numpy_column(table, "n")
    a = np.flatnonzero(side == lo)
    b = a if lo == hi else np.flatnonzero(side == hi)
    near = (vectors[a] @ vectors[b].T >= threshold) & (named[a] @ named[b].T >= shared) & (below[a] @ below[b].T == 0)
    if lo == hi:
        np.fill_diagonal(near, False)
    gain = np.zeros(len(vectors), dtype=np.int64)
    gain[a] += near @ copies[b]
    if lo != hi:
        gain[b] += near.T @ copies[a]
    labels = np.arange(len(vectors))
    i, j = np.nonzero(near)
    merge_labels(labels, a[i], b[j])
    found = np.flatnonzero((gain > 0) | (labels != np.arange(len(vectors))))
    return pa.table({"node": node[found], "gain": gain[found], "root": node[labels[found]]})


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, nearest: int = NEAREST, shared: int = SHARED, block: int = BLOCK, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of `vectors`.

    Links hold within a label, at a cosine of `threshold` or more. Vectors that are null, zero or hold a
    null or non-finite component, and rows without a label, link with nothing. Equal vectors are reduced to
    one class each first. Vectors of another width than the table's first pivot's are compared by width.
    Repeated ids stay repeated; an empty table gives an empty result.
    """
    base = vectors.select(F.col(id_col).cast("long").alias("vec_id"))
    good = usable(vectors, id_col, vector_col, label_col).withColumn("width", F.size("v"))
    classes = stage(good.groupBy("label", "width", "v").agg(F.min("vec_id").alias("node"), F.count("*").alias("n")), "classes")
    ids = stage(good.select("vec_id", "label", "width", "v").join(classes, ["label", "width", "v"]).select("vec_id", "node", "n"), "ids")
    gains, edges = None, None
    for (width,) in classes.select("width").distinct().orderBy("width").collect():  # widths, one as a rule
        own = classes.where(F.col("width") == width)
        found = linked(own, width, threshold, nearest, shared, block)
        gains = found if gains is None else gains.union(found)
    if gains is None:
        return base.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    gains = stage(gains, "gains")
    edges = gains.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    links = gains.groupBy("node").agg(F.sum("gain").alias("gain"))
    parts = connected_components(edges)
    known = classes.select("node").join(links, "node", "left").join(parts, "node", "left")
    known = ids.join(known, "node").select("vec_id", (F.col("n") - 1 + F.coalesce("gain", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    alone = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    rest = F.expr("label IS NULL OR vec_id IS NULL OR v IS NULL OR NOT (forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(v, x -> x <> 0))")
    alone = alone.where(F.coalesce(rest, F.lit(True))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return known.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def linked(classes: DataFrame, width: int, threshold: float, nearest: int, shared: int, block: int) -> DataFrame:
    """(node, gain, root) of all lists of one width."""
    count = max(PIVOTS[0], min(PIVOTS[1], PIVOT_BYTES // (8 * max(1, width)), math.isqrt(classes.count())))
    pivots = pivots_of(classes, count)
    count, nearest = len(pivots), min(nearest, len(pivots))
    known = stage(described(classes.select("label", "node", "n", "v"), pivots, nearest), "described")
    lists = known.select("*", F.explode("nearest").alias("pivot"))
    sizes = known.select("label", F.explode("nearest").alias("pivot")).groupBy("label", "pivot").agg(F.count("*").alias("size"))
    blocks = lists.join(sizes, ["label", "pivot"]).withColumn("blocks", F.ceil(F.col("size") / block).cast("int"))
    blocks = blocks.withColumn("side", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    pairs = blocks.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    pairs = pairs.select("label", "pivot", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"), "side", "node", "n", "v", "nearest")
    need = min(shared, nearest)
    run = lambda table: list_links(table, width, threshold, need, count)
    return pairs.groupBy("label", "pivot", "lo", "hi").applyInArrow(run, "node long, gain long, root long")
