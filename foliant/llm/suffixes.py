"""Exact repeated-substring dedup over a sampled, hash-compared suffix array.

Every window of `width` bytes contains an anchor, chosen by its content alone: the `gram`-byte string of the
lowest hash. Equal windows hold equal anchors at equal places, so only suffixes that begin at anchors are
sorted, and only where an anchor's string occurs again. Within such a group suffixes, forwards and backwards,
are merge-sorted; two of them are compared by binary search over prefix hashes for their common extension, and
what the sort finds is verified byte by byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import hot_join, mixed, numpy_column, row_runs, stage, unstage

WIDTH, GRAM = 200, 64
#: Bytes hashed at one go; longer documents are cut into overlapping tiles.
TILE = 1 << 20
#: Rows of one sort, and different contexts that one anchor string may have in it. Beyond, windows are counted singly.
ROWS, HEAVY = 16384, 20000
_RANDOM = np.random.default_rng(20240229)
BYTE = _RANDOM.integers(1, 1 << 63, (2, 256), dtype=np.uint64)
BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base, and of its inverse, modulo 2^64."""
    if which not in _POWERS or len(_POWERS[which][0]) <= n:
        base = BASES[which]
        steps = (base, pow(base, -1, 1 << 64))
        _POWERS[which] = tuple(np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(n, s, np.uint64)))) for s in steps)
    up, down = _POWERS[which]
    return up, down


def prefix_hashes(raw: np.ndarray, which: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = powers(which, len(raw) + 1)
    return np.concatenate(([np.uint64(0)], np.cumsum(BYTE[which][raw] * down[: len(raw)], dtype=np.uint64))), up


def sliding(values: np.ndarray, width: int, pick) -> np.ndarray:  # noqa: ANN001  np.minimum or np.maximum
    """The pick of every `width` values that stand together."""
    size = 1
    while 2 * size <= width:
        values = pick(values[:-size], values[size:])
        size *= 2
    return pick(values[: len(values) - (width - size)], values[width - size :]) if width > size else values


def anchors(parts: list[tuple[bytes, int, int]], width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(part, position, string hash, context hash) of the anchors of each part's windows.

    parts: bytes, and the first and the last-but-one start of the windows that count. An anchor's context is
    all that windows around it may cover.
    """
    sizes = np.array([len(b) for b, _, _ in parts])
    starts = np.concatenate(([0], np.cumsum(sizes)))
    raw = np.frombuffer(b"".join(b for b, _, _ in parts), dtype=np.uint8)
    none = np.zeros(0, np.int64)
    if len(raw) < width:
        return none, none, none, none
    first, up = prefix_hashes(raw, 0)
    hashes = mixed((first[gram:] - first[:-gram]) * up[: len(raw) + 1 - gram]) | np.uint64(1)
    span = width - gram + 1
    lowest = sliding(hashes, span, np.minimum)
    counts = np.zeros(len(lowest) + 1, dtype=np.int64)
    for start, (_, lo, hi) in zip(starts, parts, strict=False):
        if hi > lo:
            counts[start + lo] += 1
            counts[start + hi] -= 1
    lowest[np.cumsum(counts[:-1]) == 0] = 0  # windows that don't count
    padded = np.concatenate((np.zeros(span - 1, np.uint64), lowest, np.zeros(span - 1, np.uint64)))
    chosen = np.flatnonzero(sliding(padded, span, np.maximum) == hashes)
    part = np.searchsorted(starts, chosen, side="right") - 1
    lo = np.maximum(chosen - (width - gram), starts[part])
    hi = np.minimum(chosen + width, starts[part + 1])
    second, up = prefix_hashes(raw, 1)
    context = mixed((second[hi] - second[lo]) * up[lo] + (chosen - lo).astype(np.uint64) * np.uint64(BASES[0]) + (hi - lo).astype(np.uint64))
    return part, chosen - starts[part], hashes[chosen].view(np.int64), context.view(np.int64)


def tiles(raw: bytes, width: int, gram: int) -> Iterator[tuple[int, tuple[bytes, int, int]]]:
    """A document's parts: the place of each, its bytes, and which of its windows count."""
    windows = len(raw) - width + 1
    for lo in range(0, max(0, windows), TILE):
        hi = min(lo + TILE, windows)
        at = max(0, lo - (width - gram))
        yield at, (raw[at : hi + 2 * width], lo - at, hi - at)


def utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def anchor_rows(docs: DataFrame, width: int, gram: int) -> DataFrame:
    """(id, digest, pos, g, c): every anchor of every text of `docs` (id, digest, text)."""

    def rows(ids: pa.Array, digests: pa.Array, held: list) -> pa.RecordBatch:
        part, pos, g, c = anchors([p for _, _, p in held], width, gram)
        doc, at = np.array([d for d, _, _ in held], dtype=np.int64)[part], np.array([a for _, a, _ in held], dtype=np.int64)[part]
        _, once = np.unique(np.stack([doc, pos + at]), axis=1, return_index=True) if len(doc) and len(held) != len({d for d, _, _ in held}) else (None, slice(None))
        doc = pa.array(doc[once])
        return pa.RecordBatch.from_arrays([ids.take(doc), digests.take(doc), pa.array((pos + at)[once]), pa.array(g[once]), pa.array(c[once])], ["id", "digest", "pos", "g", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for i, text in enumerate(batch.column("text")):
                for at, part in tiles(utf8(text.as_py()), width, gram):
                    held.append((i, at, part))
                    size += len(part[0])
                if size >= TILE:
                    yield rows(batch.column("id"), batch.column("digest"), held)
                    held, size = [], 0
            if held:
                yield rows(batch.column("id"), batch.column("digest"), held)

    return docs.mapInArrow(run, "id long, digest long, pos long, g long, c long")


def prefix_matrix(rows: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, lengths, and the hash of every prefix, of rows no longer than `width`."""
    size = np.array([len(r) for r in rows], dtype=np.int64)
    signs = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in rows), dtype=np.uint8).reshape(-1, width)
    hashes = np.zeros((len(rows), width + 1), dtype=np.uint64)
    base = np.uint64(BASES[1])
    for t in range(width):
        hashes[:, t + 1] = hashes[:, t] * base + BYTE[0][signs[:, t]]
    return signs, size, hashes


def common_extension(hashes: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How long rows i and j agree, by binary search over their prefix hashes."""
    lo, hi = np.zeros(len(i), np.int64), np.minimum(size[i], size[j])
    while (lo < hi).any():
        mid = (lo + hi + 1) >> 1
        same = hashes[i, mid] == hashes[j, mid]
        lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
    return lo


def sorted_suffixes(signs: np.ndarray, size: np.ndarray, hashes: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, shared): rows sorted within each group, and how long each agrees with the one before it in its group.

    A bottom-up merge sort: at each level every row finds its rank in the neighbouring run by binary search.
    """
    n = len(size)
    order, place = np.arange(n), np.arange(n)
    edges = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True])))
    counts = np.diff(edges)
    start, stop = np.repeat(edges[:-1], counts), np.repeat(edges[1:], counts)

    def less(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        t = common_extension(hashes, size, i, j)
        ended = t >= np.minimum(size[i], size[j])
        at = np.minimum(t, signs.shape[1] - 1)
        return np.where(ended, size[i] < size[j], signs[i, at] < signs[j, at])

    run = 1
    while run < counts.max(initial=0):
        which = (place - start) // run
        lo = np.minimum(start + (which ^ 1) * run, stop)
        low, hi = lo.copy(), np.minimum(lo + run, stop)
        left = which % 2 == 0
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            mid = (lo[open_] + hi[open_]) >> 1
            own, other, first = order[open_], order[mid], left[open_]
            right = np.where(first, less(other, own), ~less(own, other))
            lo[open_], hi[open_] = np.where(right, mid + 1, lo[open_]), np.where(right, hi[open_], mid)
            open_ = open_[lo[open_] < hi[open_]]
        merged = np.empty(n, dtype=np.int64)
        merged[start + (which & ~1) * run + (place - start - which * run) + (lo - low)] = order
        order = merged
        run *= 2
    shared = np.zeros(n, dtype=np.int64)
    inner = np.flatnonzero(place > start)
    i, j = order[inner - 1], order[inner]
    shared[inner] = common_extension(hashes, size, i, j)
    # collision verification: the bytes themselves
    depth = np.arange(signs.shape[1])
    agree = (signs[i] == signs[j]) | (depth >= shared[inner, None])
    at = np.minimum(shared[inner], signs.shape[1] - 1)
    differ = (shared[inner] >= np.minimum(size[i], size[j])) | (signs[i, at] != signs[j, at])
    if not (agree.all() and differ.all()):
        return sorted_bytes(signs, size, group)
    return order, shared


def sorted_bytes(signs: np.ndarray, size: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """sorted_suffixes() without hashes, for the sort in which two of them collided."""
    own = [bytes(s[:n]) for s, n in zip(signs, size, strict=True)]
    order = np.array(sorted(range(len(own)), key=lambda i: (group[i], own[i])), dtype=np.int64)
    # groups are runs already, and keep their places
    rank = {g: k for k, g in enumerate(dict.fromkeys(group.tolist()))}
    order = order[np.argsort([rank[group[i]] for i in order], kind="stable")]
    shared = np.zeros(len(own), dtype=np.int64)
    for k in range(1, len(own)):
        i, j = order[k - 1], order[k]
        if group[i] == group[j]:
            most = min(size[i], size[j])
            apart = np.flatnonzero(signs[i, :most] != signs[j, :most])
            shared[k] = apart[0] if len(apart) else most
    return order, shared


def repeated_windows(left: list[bytes], right: list[bytes], group: np.ndarray, width: int, gram: int) -> np.ndarray:
    """[row, o]: whether the window that begins o bytes before the row's anchor occurs in another row of its group."""
    span = width - gram + 1
    forward, backward = prefix_matrix(right, width), prefix_matrix([x[::-1] for x in left], max(1, width - gram))
    n, out = len(right), np.zeros((len(right), span), dtype=bool)
    order_r, shared_r = sorted_suffixes(*forward, group)
    order_l, shared_l = sorted_suffixes(*backward, group)
    class_r, class_l = np.empty(n, np.int64), np.empty(n, np.int64)
    new = np.concatenate(([True], group[1:] != group[:-1]))
    for o in range(span):
        class_r[order_r] = np.cumsum(new | (shared_r < width - o))
        class_l[order_l] = np.cumsum(new | (shared_l < o))
        fits = np.flatnonzero((forward[1] >= width - o) & (backward[1] >= o))
        _, where, times = np.unique(class_r[fits] * (n + 1) + class_l[fits], return_inverse=True, return_counts=True)
        out[fits, o] = times[where] > 1
    return out


def spans_of(cover: np.ndarray, pos: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, from, to) of the bytes that each row's repeated windows cover."""
    edge = np.diff(np.pad(cover, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, first = np.nonzero(edge == 1)
    _, last = np.nonzero(edge == -1)
    return row, pos[row] - (last - 1), pos[row] - first + width


def resolved(contexts: DataFrame, width: int, gram: int) -> DataFrame:
    """(id, digest, from, to) for the contexts of few-sided anchors, sorted partition by partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _ in row_runs(batches, ["g"], ROWS, most=-1):  # a string has at most `heavy` contexts
            cover = repeated_windows(part.column("l").to_pylist(), part.column("r").to_pylist(), numpy_column(part, "g"), width, gram)
            cover[numpy_column(part, "n") > 1] = False
            row, lo, hi = spans_of(cover, numpy_column(part, "pos"), width)
            own = pa.array(row)
            yield pa.RecordBatch.from_arrays([part.column("id").combine_chunks().take(own), part.column("digest").combine_chunks().take(own), pa.array(lo), pa.array(hi)], ["id", "digest", "from", "to"])

    return contexts.select("g", "id", "digest", "pos", "n", "l", "r").repartition("g").sortWithinPartitions("g").mapInArrow(run, "id long, digest long, `from` long, `to` long")


def counted_windows(contexts: DataFrame, width: int, gram: int) -> DataFrame:
    """resolved() for anchors with very many contexts: their windows are counted one by one, dealt by content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                left, right = batch.column("l")[k].as_py(), batch.column("r")[k].as_py()
                whole, last = left + right, len(left) + len(right) - width
                if last < 0:
                    continue
                hashes = [hashlib.blake2b(whole[s : s + width], digest_size=16).digest() for s in range(last + 1)]
                starts = np.arange(last + 1) + batch.column("pos")[k].as_py() - len(left)
                own = pa.array(np.full(last + 1, k))
                yield pa.RecordBatch.from_arrays([batch.column("id").take(own), batch.column("digest").take(own), pa.array(starts), pa.array(hashes, pa.binary())], ["id", "digest", "from", "h"])

    rows = contexts.select("id", "digest", "pos", "l", "r").mapInArrow(run, "id long, digest long, `from` long, h binary")
    rows = rows.groupBy("id", "digest", "from").agg(F.first("h").alias("h"))  # a window may hold several anchors
    again = rows.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    return rows.join(again, "h").select("id", "digest", "from", (F.col("from") + width).alias("to"))


def repeated_spans(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, heavy: int = HEAVY) -> DataFrame:
    """(id, digest, spans array<struct<from, to>>): bytes of `docs` (id, digest, text) in strings that occur twice."""
    every = stage(anchor_rows(docs, width, gram), "anchors")
    again = stage(every.groupBy("g").agg(F.count("*").alias("m")).where("m > 1"), "again")
    rows = stage(hot_join(every, again, "g", "m", every.count()).drop("m"), "repeated")
    unstage(every, again)
    # equal contexts are one row from here on: what all windows around the anchor cover is repeated
    one = F.min(F.struct("id", "digest", "pos")).alias("one")
    contexts = stage(rows.groupBy("g", "c").agg(F.count("*").alias("n"), one), "contexts")
    sides = contexts.groupBy("g").agg(F.count("*").alias("sides"), F.sum((F.col("n") == 1).cast("long")).alias("open"))
    sides = stage(sides.where("open > 0 AND sides > 1"), "sides")
    wanted = hot_join(contexts, sides, "g", "sides", contexts.count()).select("one.id", "one.digest", F.struct("one.pos", "g", "n", "sides").alias("w"))
    lists = stage(wanted.groupBy("id", "digest").agg(F.collect_list("w").alias("wanted")), "wanted")  # within one document
    cut = stage(cut_contexts(docs, lists, width, gram), "cut")
    few = resolved(cut.where(F.col("sides") <= heavy), width, gram)
    many = counted_windows(cut.where(F.col("sides") > heavy), width, gram)
    whole = rows.join(contexts.where("n > 1").select("g", "c"), ["g", "c"]).select("id", "digest", (F.col("pos") - (width - gram)).alias("from"), (F.col("pos") + width).alias("to"))
    spans = whole.unionByName(few).unionByName(many)
    return spans.groupBy("id", "digest").agg(F.collect_list(F.struct("from", "to")).alias("spans"))  # within one document


def cut_contexts(docs: DataFrame, lists: DataFrame, width: int, gram: int) -> DataFrame:
    """(g, n, sides, id, digest, pos, l, r): what stands before and from each wanted anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, out, left, right = [], [], [], []
            for i, (text, wanted) in enumerate(zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist(), strict=True)):
                raw = utf8(text)
                for w in wanted:
                    doc.append(i)
                    out.append((w["g"], w["n"], w["sides"], w["pos"]))
                    left.append(raw[max(0, w["pos"] - (width - gram)) : w["pos"]])
                    right.append(raw[w["pos"] : w["pos"] + width])
            own, numbers = pa.array(doc, pa.int64()), np.array(out, dtype=np.int64).reshape(-1, 4)
            arrays = [*(pa.array(numbers[:, k]) for k in range(3)), batch.column("id").take(own), batch.column("digest").take(own), pa.array(numbers[:, 3]), pa.array(left, pa.binary()), pa.array(right, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["g", "n", "sides", "id", "digest", "pos", "l", "r"])

    once = docs.join(lists, ["id", "digest"]).select("id", "digest", "text", "wanted")
    return once.mapInArrow(run, "g long, n long, sides long, id long, digest long, pos long, l binary, r binary").dropDuplicates(["g", "id", "digest", "pos"])


def merged(spans: list[dict] | None, size: int) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes."""
    out: list[list[int]] = []
    for lo, hi in sorted((max(0, s["from"]), min(size, s["to"])) for s in spans or ()):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(lo, hi) for lo, hi in out]


def dedup_substrings(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, heavy: int = HEAVY, with_bytes: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans[, kept]) per row of `docs`.

    Removes every byte of a text that lies in a `width`-byte string which also starts elsewhere, in this text
    or another. A null text is empty; texts shorter than `width` stay; repeated rows are copies of each
    other and lose what they share; rows may lack an id. kept: the bytes left, which need not be valid
    UTF-8. An empty table gives an empty result; other columns of `docs` play no part.
    """
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("id"), F.xxhash64(F.col(text_col)).alias("digest"), F.col(text_col).alias("text"), F.col(id_col).isNull().alias("lost"))
    keyed = base.where(F.octet_length("text") >= width)
    found = repeated_spans(keyed.select("id", "digest", "text"), width, gram, heavy)
    joined = base.join(found, ["id", "digest"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, runs, digests, spans, kept = [], [], [], [], [], []
            for text, found in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                raw = utf8(text)
                own = merged(found, len(raw))
                left, at = [], 0
                for lo, hi in own:
                    left.append(raw[at:lo])
                    at = hi
                left = b"".join([*left, raw[at:]])
                sizes.append(len(raw))
                removed.append(len(raw) - len(left))
                runs.append(len(own))
                digests.append(hashlib.sha256(left).hexdigest())
                spans.append([{"from": lo, "to": hi} for lo, hi in own])
                kept.append(left)
            ids = pa.array([None if lost else i for i, lost in zip(batch.column("id").to_pylist(), batch.column("lost").to_pylist(), strict=True)], pa.int64())
            arrays = [ids, pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digests, pa.string()), pa.array(spans, pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())])))]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
            if with_bytes:
                arrays, names = [*arrays, pa.array(kept, pa.binary())], [*names, "kept"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<`from`: long, `to`: long>>"
    return joined.mapInArrow(run, schema + ", kept binary" if with_bytes else schema)
