"""Importance resampling towards a target distribution of hashed word n-grams.

Within a task, the words of a block of texts become numbers, and a suffix array over them, cut at the longest n-gram,
brings equal n-grams together: a run of neighbours whose common prefix is long enough is one n-gram. It is hashed
once, and its bucket is scattered back to all its places. Counts per bucket are Spark's, over all texts; a document's
weight is the mean gain of its features, and Gumbel noise from its id makes the highest scores a sample without
replacement.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import stage, unstage
from foliant.llm.order import placed

BUCKETS = 10_000
#: The longest n-gram, the fewest words of a document that may be drawn, and how many in a hundred are.
LONGEST, MIN_WORDS, PERCENT, SEED = 1, 20, 10, 2024
#: Bytes of text in one suffix array; a longer text has one to itself.
BLOCK = 8 << 20
#: Words are runs of ASCII letters and digits and of all beyond ASCII; A-Z are lower-cased and no other letter is.
FOLDED = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def suffix_array(ids: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in the order of the `depth` words from there, and how many of these each shares with the one before.

    ids: words as numbers from 1; 0 parts texts and ends every comparison. Ranks double their reach until depth.
    """
    n = len(ids)
    rank, reach = ids.astype(np.int64), 1
    while reach < depth:
        step = min(reach, depth - reach)
        after = np.zeros(n, dtype=np.int64)
        after[: max(0, n - step)] = rank[step:]
        _, rank = np.unique(rank * (after.max(initial=0) + 1) + after, return_inverse=True)
        reach += step
    order = np.argsort(rank, kind="stable")
    common, same = np.zeros(n, dtype=np.int64), np.ones(max(0, n - 1), dtype=bool)
    padded = np.concatenate([ids, np.zeros(depth, dtype=ids.dtype)])
    for k in range(depth):
        here = padded[order + k]
        same &= (here[1:] == here[:-1]) & (here[1:] != 0)
        common[1:] += same
    return order, common


def feature_buckets(texts: list[list[bytes]], longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of every n-gram of up to `longest` words of every text, text by text, and how many each text has."""
    numbers: defaultdict[bytes, int] = defaultdict(count(1).__next__)
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    ids = np.zeros(int(lengths.sum()) + len(texts), dtype=np.int64)
    ends = np.cumsum(lengths + 1)
    for words, end in zip(texts, ends.tolist(), strict=True):
        ids[end - 1 - len(words) : end - 1] = list(map(numbers.__getitem__, words))
    order, common = suffix_array(ids, longest)
    left = np.repeat(ends - 1, lengths + 1) - np.arange(len(ids))  # words from a place to its text's end
    spelt = [b"", *numbers]
    place, bucket = [], []
    for n in range(1, longest + 1):
        whole = left[order] >= n
        at = order[whole]
        # A new run begins where fewer than n words are shared; places left out share with none that stay.
        run = np.cumsum((common < n)[whole]) - 1
        firsts = at[np.flatnonzero(np.diff(run, prepend=-1))]
        hashed = np.fromiter((zlib.crc32(b" ".join([spelt[i] for i in gram])) % buckets for gram in ids[firsts[:, None] + np.arange(n)].tolist()), dtype=np.int64, count=len(firsts))
        place.append(at)
        bucket.append(hashed[run])
    place, bucket = np.concatenate(place), np.concatenate(bucket)
    text = np.searchsorted(ends, place, side="right")
    each = np.bincount(text, minlength=len(texts))
    return bucket[np.argsort(text, kind="stable")], each


def features(docs: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, id_col: str | None = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, buckets) of every row: the buckets of its n-grams as little-endian 32-bit numbers."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]]]]:
        for batch in batches:
            texts, first, taken = batch.column(1), 0, 0
            for row, size in enumerate(pc.binary_length(texts).fill_null(0).to_pylist()):
                if row > first and taken + size > BLOCK:
                    yield batch.slice(first, row - first), split(texts.slice(first, row - first))
                    first, taken = row, 0
                taken += size
            if first < batch.num_rows:
                yield batch.slice(first), split(texts.slice(first))

    def split(texts: pa.Array) -> list[list[bytes]]:
        return [(t or b"").translate(FOLDED).split() for t in texts.cast(pa.binary()).to_pylist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches):
            found, each = feature_buckets(texts, longest, buckets)
            ends = np.concatenate([[0], np.cumsum(4 * each)]).astype(np.int32)
            packed = pa.Array.from_buffers(pa.binary(), len(each), [None, pa.py_buffer(ends), pa.py_buffer(found.astype("<i4"))])
            words = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), words, packed], ["doc_id", "n_words", "buckets"])

    own = F.lit(None).cast("long") if id_col is None else F.col(id_col).cast("long")
    return docs.select(own.alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_words long, buckets binary")


def bucket_counts(found: DataFrame, buckets: int) -> np.ndarray:
    """How many features each bucket holds: every task sums its own, and one number a bucket comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            total += np.bincount(held(batch.column(0)), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], ["bucket", "n"])

    out = np.zeros(buckets, dtype=np.int64)
    for row in found.select("buckets").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row.bucket] = row.n
    return out


def held(packed: pa.Array) -> np.ndarray:
    """All numbers of an array of packed ones."""
    return np.frombuffer(b"".join(packed.to_pylist()), dtype="<i4")


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A bucket's gain in thousandths of a nat: how much likelier the target is to hold it, one feature added to each."""
    buckets = len(source)
    ratio = (target + 1.0) * (source.sum() + buckets) / ((source + 1.0) * (target.sum() + buckets))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weighed(found: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the mean gain of each row's features, rounded down; 0 without any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = batch.column(2)
            each = np.array([len(b) // 4 for b in packed.to_pylist()], dtype=np.int64)
            sums = np.concatenate([[0], np.cumsum(gain[held(packed)])])
            ends = np.cumsum(each)
            weight = (sums[ends] - sums[ends - each]) // np.maximum(each, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(each), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    return found.select("doc_id", "n_words", "buckets").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of `docs`; rank is 1, 2, 3... for the drawn, else null.

    target: a table with a column `text`. Of the rows with at least min_words words, `percent` in a hundred are drawn,
    those of the highest scores, equal ones by the smaller id. A null or empty text has no feature and weight 0; a
    null id is hashed as an empty one and comes before others at equal scores; repeated rows are weighed, and drawn,
    each for itself; an empty table has no rows, and with an empty target every bucket counts one there.
    """
    found = stage(features(docs, longest, buckets, id_col, text_col), "features")
    wanted = features(target, longest, buckets, None)
    gain = gains(bucket_counts(found, buckets), bucket_counts(wanted, buckets))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    noise = F.expr("floor(-1000 * ln(-ln((h + 0.5D) / 4294967296D)))")
    scored = weighed(found, gain).withColumn("h", F.conv(F.substring(digest, 1, 8), 16, 10).cast("double"))
    scored = stage(scored.withColumn("score", (F.col("weight") + noise).cast("long")).drop("h"), "scored")
    unstage(found)
    fit = F.col("n_words") >= min_words
    drawn = scored.where(fit).count() * percent // 100
    ranked = placed(scored.where(fit).select("doc_id", "n_features", "weight", "score"), [F.col("score").desc(), F.col("doc_id").asc_nulls_first()])
    rank = F.when(F.col("position") < drawn, F.col("position") + 1)
    rest = scored.where(~fit).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    return ranked.select("doc_id", "n_features", "weight", "score", rank.alias("rank")).unionByName(rest)
