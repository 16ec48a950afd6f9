"""Shared plumbing of the corpus operators: staged tables, Arrow mapping, components."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SCRATCH: dict[str, SparkSession] = {}
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one where a session of one process names none (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='foliant-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


@contextmanager
def shuffles_end(spark: SparkSession) -> Iterator[None]:
    """Within the block, a query's shuffle files go when it ends: a written table needs them no more."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: cuts lineage, survives lost executors.

    The table is removed by `unstage`, or when the driver's interpreter ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with shuffles_end(spark):
        df.write.option("compression", "zstd").parquet(path)
    _SCRATCH[path] = spark
    back = spark.read.schema(df.schema).parquet(path)
    back._staged_at = path
    return back


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to be none of the columns."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


#: Keys that meet more rows than this share of the whole are hot: there are at most so many of them.
HOT = 1000


def hot_join(left: DataFrame, right: DataFrame, on: str | list[str], size: str, total: int, least: int = 10_000) -> DataFrame:
    """`left` joined with `right` (one row a key; `size`: the rows of `left` that hold the key, `total` in all).

    Keys that hold more than one of HOT parts of `left`, and more than `least` rows, are at most HOT rows, which are
    broadcast, so their rows stay where they are; the others are dealt by the key.
    """
    bar = max(least, total // HOT)
    hot, cold = right.where(F.col(size) > bar), right.where(F.col(size) <= bar)
    rest = left.join(F.broadcast(hot.select(on)), on, "left_anti").join(cold, on)
    return left.join(F.broadcast(hot), on).unionByName(rest)


def unstage(*tables: DataFrame) -> None:
    for table in tables:
        path = getattr(table, "_staged_at", None)
        if path in _SCRATCH:
            _remove(_SCRATCH.pop(path), path)


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _remove_all() -> None:
    for path, spark in list(_SCRATCH.items()):
        try:
            if spark.sparkContext._jsc is not None:
                _remove(spark, path)
        except Exception:  # noqa: BLE001  the gateway may be gone by now
            return


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run`, after which a worker, which Spark keeps for other tasks, gives back the memory that it no longer uses."""

    def leaner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
        if trim is not None:
            trim(0)

    return leaner


def mixed(h: np.ndarray) -> np.ndarray:
    """A finaliser: every bit of the input reaches every bit of the result."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def row_runs(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int, most: int | None = None) -> Iterator[tuple[pa.Table, bool]]:
    """Tables of whole runs of equal keys, of about `rows` rows each, from batches sorted by the keys.

    Only one such table is held at a time. A run of more than `most` rows (default `rows`, no limit if negative)
    comes in several tables, each with False beside it; what comes with True holds whole runs alone.
    """
    most = rows if most is None else most
    held: list[pa.RecordBatch] = []
    size, split = 0, None  # split: the key of a run of which a part has left already

    def key_of(batch: pa.RecordBatch, i: int) -> tuple:
        return tuple(batch.column(k)[i].as_py() for k in keys)

    def cut(last: bool) -> Iterator[tuple[pa.Table, bool]]:
        nonlocal held, size, split
        table = pa.Table.from_batches(held).combine_chunks()
        codes = [table.column(k).combine_chunks().to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(max(0, table.num_rows - 1), dtype=bool)
        for c in codes:
            change |= c[1:] != c[:-1]
        edges = np.flatnonzero(change) + 1
        begin = 0
        if split is not None:  # the rest of a split run
            same = split == tuple(table.column(k)[0].as_py() for k in keys)
            begin = int(edges[0]) if same and len(edges) else table.num_rows if same else 0
            if begin:
                yield table.slice(0, begin), False
            if begin < table.num_rows or not same:
                split = None
        end = table.num_rows if last else int(edges[-1]) if len(edges) else begin
        if end > begin:
            yield table.slice(begin, end - begin), True
        left = table.slice(max(end, begin))
        if left.num_rows and 0 <= most <= left.num_rows and not last:
            split = tuple(left.column(k)[0].as_py() for k in keys)
            yield left, False
            left = left.slice(left.num_rows)
        held, size = [b for b in left.to_batches() if b.num_rows], left.num_rows

    grow = rows
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size >= grow:
            yield from cut(False)
            grow = max(rows, 2 * size)  # a long whole run is not looked through at every batch
    if size:
        yield from cut(True)


def numpy_column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).combine_chunks().to_numpy(zero_copy_only=False)


def merge_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join, in place, the classes of a[i] and b[i]; labels holds each row's root, the smallest row of its class."""
    while len(a):
        la, lb = labels[a], labels[b]
        differ = la != lb
        if not differ.any():
            return
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        np.minimum.at(labels, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = labels[labels]
            if np.array_equal(up, labels):
                break
            labels[:] = up


#: Tasks that the edges of one node are dealt over.
SALTS = 8


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of `edges` (a, b: long); component is the smallest node reachable.

    Alternating large-star and small-star steps. Every step is an aggregate with partial sums and an
    equi-join in which a hub's edges are dealt over SALTS tasks; each round is a staged table.
    """
    edges = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    now = stage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        sign = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if sign == seen or sign[0] == 0:
            break
        seen = sign
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = _with_lowest(both, low).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        small = _with_lowest(large, large.groupBy("a").agg(F.min("b").alias("m")))
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b")))
        after = stage(small.where("a <> b").distinct(), "edges")
        unstage(now)
        now = after
    out = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return out.union(roots)


def _with_lowest(edges: DataFrame, low: DataFrame) -> DataFrame:
    """`edges` (a, b) with m, the lowest neighbour of a."""
    salted = low.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return edges.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int")).join(salted, ["a", "salt"]).drop("salt")
