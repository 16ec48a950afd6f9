"""SimHash near-duplicates by pigeonhole blocks.

Fingerprints are split into blocks so that any two within `distance` bits share a whole block; rows are
dealt by block, verified by Hamming distance, and linked into components.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import connected_components, fresh, lean, merge_labels, mixed, numpy_column, row_runs, stage

BITS = 64
#: What tells the hashes of one fingerprint of a text from those of the next.
STEP = 0x9E3779B97F4A7C15
#: Rows of one block value that are compared directly; longer runs are split by further blocks first.
RUN = 512
#: Distinct fingerprints that a block value may hold on average before longer keys are taken.
PER_BLOCK = 2048
#: Parts, at least, that the rows of one kind of block are dealt in by a hash of their block value; rows of one part on average.
PARTS, PER_PART = 16, 1 << 15
#: Rows that a task packs at one go, packed rows that it reads at one go.
PACK, ROWS = 1 << 16, 64


def shingle_hashes(text: str | None, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of all word shingles of a lower-case text, repeats included; of the whole sequence if it is shorter."""
    got = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not got:
        return np.zeros(0, np.uint64)
    if len(got) < words:
        hashes = [xxhash.xxh64_intdigest(b" ".join(got), seed)]
    else:
        shingles = map(b" ".join, zip(*(got[i:] for i in range(words)), strict=False))
        hashes = map(xxhash.xxh64_intdigest, shingles, repeat(seed))
    return np.fromiter(hashes, dtype=np.uint64)


def fingerprint(text: str | None, words: int, seed: int = 42) -> int:
    """Majority bits of the hashes of all word shingles, as an unsigned number; no words: zero."""
    return majority(shingle_hashes(text, words, seed))


def fingerprint_family(text: str | None, words: int, size: int) -> list[int]:
    """fingerprint() and size - 1 more of the same shingles, whose hashes are mixed with another constant each."""
    hashes = shingle_hashes(text, words)
    return [majority(hashes if k == 0 else mixed(hashes ^ np.uint64(k * STEP % (1 << 64)))) for k in range(size)]


def majority(hashes: np.ndarray) -> int:
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = np.ascontiguousarray(hashes[at : at + (1 << 15)]).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def names(size: int) -> list[str]:
    return ["fp", *[f"fp{k}" for k in range(1, size)]]


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text", size: int = 1) -> DataFrame:
    """(doc_id, fp long, …): one row per input row, with `size` fingerprints. A null or blank text has fingerprints of zero."""
    fields = names(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint_family(t.as_py(), words, size) for t in batch.column(1)], dtype=np.uint64).reshape(-1, size)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(np.ascontiguousarray(fps[:, k]).view(np.int64)) for k in range(size)]], ["doc_id", *fields])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(lean(run), "doc_id long, " + ", ".join(f"{c} long" for c in fields))


def block_plan(n: int, distance: int, bits: int = BITS, per_block: int = PER_BLOCK) -> list[int]:
    """Masks such that two fingerprints within `distance` bits agree under one of them at least.

    With b blocks any b - distance of them form a key. More blocks mean longer keys and more copies of each
    row; the first plan whose keys leave about `per_block` rows a value is taken.
    """
    for blocks in range(distance + 1, distance + 5):
        edges = [bits * i // blocks for i in range(blocks + 1)]
        parts = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(edges, edges[1:], strict=False)]
        keep = blocks - distance
        if n <= per_block << (bits * keep // blocks):
            break
    return [sum(c) for c in combinations(parts, keep)]


def link_close(labels: np.ndarray, rows: np.ndarray, fps: np.ndarray, free: list[int], distance: int) -> None:
    """Join the classes of all rows (indices into labels and fps) within `distance` bits of one another.

    free: the bits in which the rows may differ. Long runs are split by blocks of these bits again, so that
    the direct comparisons stay few; no pair is left out.
    """
    if len(rows) > RUN and len(free) >= 4 * (distance + 1):
        for part in np.array_split(np.array(free), distance + 1):
            mask = np.uint64(sum(1 << int(i) for i in part))
            rest = [i for i in free if i not in set(part.tolist())]
            key = fps[rows] & mask
            order = np.argsort(key, kind="stable")
            link_runs(labels, rows[order], key[order], fps, rest, distance)
        return
    own = fps[rows]
    for step in range(1, len(rows)):
        near = np.flatnonzero(np.bitwise_count(own[:-step] ^ own[step:]) <= distance)
        merge_labels(labels, rows[near], rows[near + step])


def link_runs(labels: np.ndarray, rows: np.ndarray, keys: np.ndarray, fps: np.ndarray, free: list[int], distance: int) -> None:
    """link_close() for every run of equal keys; short runs are compared all at once, one step apart at a time."""
    if len(rows) < 2:
        return
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    lengths = np.diff(np.append(starts, len(rows)))
    for at in np.flatnonzero(lengths > RUN):
        link_close(labels, rows[starts[at] : starts[at] + lengths[at]], fps, free, distance)
    left = np.repeat(np.where(lengths > RUN, 0, lengths), lengths) - (np.arange(len(rows)) - np.repeat(starts, lengths))
    own = fps[rows]
    index = np.flatnonzero(left > 1)
    for step in range(1, RUN):
        if step > 1:
            index = index[left[index] > step]
        if not len(index):
            return
        near = index[np.bitwise_count(own[index] ^ own[index + step]) <= distance]
        if len(near):
            merge_labels(labels, rows[near], rows[near + step])


def packed_by_block(rows: DataFrame, masks: list[int], fields: list[str], parts: int) -> DataFrame:
    """(kind, part, packed): `rows` once for each of the fingerprints `fields` and each mask, by a hash of what the mask shows of it.

    packed: node and fingerprint of all rows of a task that fall in one part, so that few and long rows are dealt and sorted.
    """

    def packs(node: np.ndarray, fps: np.ndarray, kind: int) -> pa.RecordBatch:
        part = (mixed(fps & np.uint64(masks[kind % len(masks)])) % np.uint64(parts)).astype(np.uint16 if parts <= 1 << 16 else np.int64)
        order, counts = np.argsort(part, kind="stable"), np.bincount(part, minlength=parts)
        pairs, found = np.stack((node[order], fps[order].view(np.int64)), axis=1), np.flatnonzero(counts)
        offsets = np.concatenate(([0], 16 * np.cumsum(counts[found]))).astype(np.int32)
        packed = pa.Array.from_buffers(pa.binary(), len(found), [None, pa.py_buffer(offsets), pa.py_buffer(pairs)])
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(found), kind, np.int32)), pa.array(found.astype(np.int32)), packed], ["kind", "part", "packed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def leave() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            held.clear()
            for first in range(0, table.num_rows, PACK):
                own = table.slice(first, PACK)
                for k, field in enumerate(fields):
                    fps = numpy_column(own, field).view(np.uint64)
                    for i in range(len(masks)):
                        yield packs(numpy_column(own, "node"), fps, k * len(masks) + i)

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= PACK:
                yield from leave()
        if held:
            yield from leave()

    return rows.select("node", *fields).mapInArrow(lean(run), "kind int, part int, packed binary")


def linked_labels(fps: np.ndarray, mask: int, distance: int) -> np.ndarray:
    """The class of each fingerprint, by those that agree under the mask and are within `distance` bits.

    Where many agree, they are told apart by one more block of the other bits, each in turn, all at once: as in link_close().
    """
    labels, free = np.arange(len(fps)), [i for i in range(BITS) if not mask >> i & 1]
    key = fps & np.uint64(mask)
    order = np.argsort(key)
    lengths = np.diff(np.flatnonzero(np.concatenate(([True], key[order][1:] != key[order][:-1], [True]))))
    if int((lengths.astype(np.float64) ** 2).sum()) <= 32 * (distance + 1) * len(fps) or len(free) < 4 * (distance + 1):
        link_runs(labels, order, key[order], fps, free, distance)
        return labels
    for part in np.array_split(np.array(free), distance + 1):
        key = fps & np.uint64(mask | sum(1 << int(i) for i in part))
        order = np.argsort(key)
        link_runs(labels, order, key[order], fps, [i for i in free if i not in set(part.tolist())], distance)
    return labels


def close_links(reps: DataFrame, distance: int, per_block: int = PER_BLOCK, fields: list[str] | None = None) -> DataFrame:
    """Edges (a, b) that span every group of rows chained by at most `distance` bits of one of their fingerprints.

    reps: (node long, fp long, …), fingerprints distinct. Within a part only a spanning forest leaves.
    """
    n, fields = reps.count(), fields or ["fp"]
    masks, parts = block_plan(n, distance, per_block=per_block), max(PARTS, 1 << (n // PER_PART).bit_length())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, _ in row_runs(batches, ["kind", "part"], ROWS, most=-1):
            kind, part = numpy_column(table, "kind"), numpy_column(table, "part")
            edges = [0, *(np.flatnonzero((kind[1:] != kind[:-1]) | (part[1:] != part[:-1])) + 1).tolist(), len(kind)]
            for lo, hi in zip(edges, edges[1:], strict=False):
                rows = np.frombuffer(b"".join(table.column("packed").slice(lo, hi - lo).to_pylist()), dtype=np.int64).reshape(-1, 2)
                node, fps = np.ascontiguousarray(rows[:, 0]), np.ascontiguousarray(rows[:, 1]).view(np.uint64)
                labels = linked_labels(fps, masks[int(kind[lo]) % len(masks)], distance)
                linked = np.flatnonzero(labels != np.arange(len(node)))
                if len(linked):
                    yield pa.RecordBatch.from_arrays([pa.array(node[linked]), pa.array(node[labels[linked]])], ["a", "b"])

    dealt = packed_by_block(reps, masks, fields, parts).repartition("kind", "part").sortWithinPartitions("kind", "part")
    return dealt.mapInArrow(lean(run), "a long, b long")


def components(fps: DataFrame, distance: int = 3) -> DataFrame:
    """(doc_id, fp, component_id): rows chained by at most `distance` bits of one of their fingerprints share the smallest doc_id.

    Rows of equal fingerprints are first reduced to one each, so a group of copies costs one row however large
    it is. Rows without a doc_id keep a null component unless an equal fingerprint has one.
    """
    fields = fps.columns[1:]
    reps = stage(fps.groupBy(*fields).agg(F.min("doc_id").alias("node")), "reps")
    found = connected_components(close_links(reps.where("node IS NOT NULL"), distance, fields=fields))
    classes = reps.join(found, "node", "left").select(*fields, F.coalesce("component", "node").alias("component_id"))
    return fps.join(classes, fields).select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, words: int = 3, distance: int = 3, id_col: str = "doc_id", text_col: str = "text", size: int = 1) -> DataFrame:
    """(doc_id, fp, component_id) per row of `docs`.

    size: fingerprints of each text, of which one must be close; pairs of one similarity lie at scattered distances,
    and each fingerprint is another chance. Nulls and blank texts have fingerprints of zero and link like any
    other; repeated rows stay repeated; an empty table gives an empty result; other columns of `docs` play no part.
    """
    fps = stage(fingerprints(docs, words, id_col, text_col, size), "fps")
    return components(fps, distance)


def simhash_dedup(docs: DataFrame, words: int = 5, distance: int = 3, id_col: str = "doc_id", text_col: str = "text", size: int = 1) -> DataFrame:
    """`docs` with one document of each group: the one whose id is the group's smallest. Columns stay as they are."""
    found = near_duplicates(docs, words, distance, id_col, text_col, size)
    (gone,) = fresh(docs.columns, "gone")
    drop = found.where("doc_id <> component_id").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(drop, docs[id_col].cast("long") == F.col(gone), "left_anti")
