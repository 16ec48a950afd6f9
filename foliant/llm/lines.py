"""Fuzzy line dedup: SimHash of normalised lines, pigeonhole blocks, edit similarity, one line of each group stays.

Lines are reduced to distinct ones by a digest of their whole normal form. Fingerprints are the majority bits of hashed character
n-grams, several of each line; lines within DISTANCE bits in one of them are candidates, found exactly by
pigeonhole blocks, and edit similarity decides every one.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm import simhash
from foliant.llm.common import connected_components, fresh, hot_join, lean, merge_labels, numpy_column, row_runs, stage, unstage

SIMILARITY = 0.8
#: Lines with so many words, or so many signs (in any script), are compared; shorter ones go only if they are equal.
MIN_WORDS, MIN_SIGNS = 5, 20
#: Characters of a feature; fingerprints of a line; bits in which lines may differ in one of them. Shorter features are
#: common to lines of one language, whose fingerprints then lie close together and chain into one huge group.
GRAM, FINGERPRINTS, DISTANCE = 8, 3, 4
#: Pairs of lines whose distance is computed at one go, and bytes of their tables.
PAIRS, TABLE = 4096, 32 << 20
#: Signs hashed at one go; pairs looked at in one step; lines of one block of a group; texts compared at one go.
CHUNK, RUN, BLOCK, TEXTS = 1 << 16, 1 << 18, 1024, 1 << 14
#: Documents whose lines a task holds at one go.
DOCS = 1024
#: Distinct lines of which a map is broadcast, with a bit each: 16 MB. Of more, the numbers that are asked for are dealt.
MAPPED = 1 << 27
#: Tasks that the rows of one group are dealt over.
SALTS = 16
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_SIGNS: dict[str, bool] = {}
#: What is no letter, digit or line end in ASCII, as a blank.
ASCII = {i: " " for i in range(128) if chr(i) != "\n" and not chr(i).isalnum()}


def plain(text: str) -> str:
    """Lower case, with a blank for each sign that is no letter, mark, digit or line end."""
    low = text.lower()
    if low.isascii():
        return low.translate(ASCII)
    for c in set(low):
        sign = _SIGNS.get(c)
        if sign is None:
            sign = _SIGNS[c] = c not in "\n " and unicodedata.category(c)[0] not in "LMN"
        if sign:
            low = low.replace(c, " ")
    return low


def normal_forms(text: str) -> list[str]:
    """For each line its letters, marks and digits in lower case; each run of all else is one blank."""
    text = plain(text)
    while "  " in text:
        text = text.replace("  ", " ")
    return text.replace(" \n", "\n").replace("\n ", "\n").strip(" ").split("\n")


def normal_form(line: str) -> str:
    """normal_forms() of what is one line."""
    return normal_forms(line)[0]


def is_fuzzy(form: str) -> bool:
    return len(form) >= MIN_SIGNS or form.count(" ") + 1 >= MIN_WORDS


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance, a column of the table at a time in the bits of one number."""
    if not a or not b:
        return len(a) or len(b)
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << len(a) - 1
    plus, minus, score = full, 0, len(a)
    for c in b:
        same = where.get(c, 0)
        vertical = same | minus
        across = (((same & plus) + plus) ^ plus) | same
        up, down = minus | ~(across | plus) & full, plus & across
        score += 1 if up & top else -1 if down & top else 0
        up, down = (up << 1 | 1) & full, down << 1 & full
        plus, minus = down | ~(vertical | up) & full, up & vertical
    return score


def edit_distances(a: list[str], b: list[str]) -> np.ndarray:
    """edit_distance() of each a[i] and b[i]: columns of 64 rows a word, all pairs at once."""
    longest = max(map(len, [*a, *b]), default=0)
    if len(a) * (2 + longest / 300) < longest / 4:  # few and long: one at a time is faster
        return np.array([edit_distance(x, y) for x, y in zip(a, b, strict=True)], dtype=np.int64)
    swap = [(y, x) if len(x) < len(y) else (x, y) for x, y in zip(a, b, strict=True)]
    order = np.argsort([-len(y) for _, y in swap], kind="stable")  # pairs that end early stand last
    rows, cols = [swap[i][0] for i in order], [swap[i][1] for i in order]
    m, n = np.array([len(x) for x in rows]), np.array([len(x) for x in cols])
    out = np.empty(len(order), dtype=np.int64)
    if not len(order) or not m.max():
        out[:] = 0
        return out
    points = np.frombuffer("".join(rows + cols).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    letters, ids = np.unique(points, return_inverse=True)
    size, words = len(letters), int(m.max() + 63) // 64
    if len(order) > 1 and len(order) * size * words * 8 > TABLE:
        half = len(order) // 2
        for part in (order[:half], order[half:]):
            out[part] = edit_distances([a[i] for i in part], [b[i] for i in part])
        return out
    own, at = np.repeat(np.arange(len(m)), m), np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
    where = np.zeros((words, len(m) * size), dtype=np.uint64)
    np.bitwise_or.at(where, (at // 64, own * size + ids[: m.sum()]), np.uint64(1) << (at % 64).astype(np.uint64))
    ids = ids[m.sum() :]
    starts, base = np.cumsum(n) - n, np.arange(len(m)) * size
    plus, minus = np.full((words, len(m)), np.uint64((1 << 64) - 1)), np.zeros((words, len(m)), dtype=np.uint64)
    one, top = np.uint64(1), np.uint64(63)
    alive = np.searchsorted(-n, -np.arange(n.max(initial=0)), side="left")  # pairs with n > column
    for column, k in enumerate(alive.tolist()):
        at = base[:k] + ids[starts[:k] + column]
        up, down = np.ones(k, dtype=np.uint64), np.zeros(k, dtype=np.uint64)
        for w in range(words):
            same, p, q = where[w][at], plus[w, :k], minus[w, :k]
            vertical = same | q
            same |= down
            across = (((same & p) + p) ^ p) | same
            rise, fall = q | ~(across | p), p & across
            next_up, next_down = rise >> top, fall >> top
            rise, fall = rise << one | up, fall << one | down
            plus[w, :k] = fall | ~(vertical | rise)
            minus[w, :k] = rise & vertical
            up, down = next_up, next_down
    rows_in = np.clip(m[None, :] - 64 * np.arange(words)[:, None], 0, 64)
    mask = np.where(rows_in == 64, np.uint64((1 << 64) - 1), (one << np.minimum(rows_in, 63).astype(np.uint64)) - one)
    out[order] = n + np.bitwise_count(plus & mask).sum(axis=0).astype(np.int64) - np.bitwise_count(minus & mask).sum(axis=0).astype(np.int64)
    return out


def common_prefix(a: str, b: str) -> int:
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def stripped(a: str, b: str) -> tuple[str, str]:
    """Both without what they begin and end with alike."""
    k = common_prefix(a, b)
    a, b = a[k:], b[k:]
    k = common_prefix(a[::-1], b[::-1])
    return a[: len(a) - k], b[: len(b) - k]


def distance_at_most(a: str, b: str, anchor: int = 12) -> int:
    """An upper bound of the edit distance: that of the parts before and after anchors which stand in both."""
    a, b = stripped(a, b)
    if min(len(a), len(b)) < 2 * anchor:
        return edit_distance(a, b)
    for eighth in (4, 2, 6, 3, 5, 1, 7):  # from the middle
        at = max(0, len(a) * eighth // 8 - anchor // 2)
        near = len(b) * at // len(a)
        found = b.find(a[at : at + anchor], max(0, near - len(b) // 4), near + len(b) // 4 + anchor)
        if found >= 0:
            return distance_at_most(a[:at], b[:found], anchor) + distance_at_most(a[at + anchor :], b[found + anchor :], anchor)
    return edit_distance(a, b) if min(len(a), len(b)) < 4 * anchor else max(len(a), len(b))


def similar_pairs(text: list[str], a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Whether the edit similarity of each text[a[i]] and text[b[i]], 1 - distance / longer length, reaches `least`."""
    size = np.array([len(t) for t in text])
    limit, out = (1 - least) * np.maximum(size[a], size[b]) + 1e-9, np.zeros(len(a), dtype=bool)
    parts = [stripped(text[i], text[j]) for i, j in zip(a.tolist(), b.tolist(), strict=True)]
    short = np.array([min(len(x), len(y)) for x, y in parts], dtype=np.int64)
    long = np.array([max(len(x), len(y)) for x, y in parts], dtype=np.int64)
    for i in np.flatnonzero(long - short <= limit).tolist():
        out[i] = long[i] <= limit[i] or distance_at_most(*parts[i]) <= limit[i]
    left = np.flatnonzero(~out & (long - short <= limit))
    left, first = left[np.argsort(long[left], kind="stable")], 0
    while first < len(left):  # pairs of one batch take about equally long
        to = min(first + PAIRS, int(np.searchsorted(long[left], 1.25 * long[left[first]] + 32, side="right")))
        own = left[first:to]
        out[own] = edit_distances([parts[i][0] for i in own], [parts[i][1] for i in own]) <= limit[own]
        first = to
    return out


def similar(a: str, b: str, least: float = SIMILARITY) -> bool:
    """similar_pairs() of one pair."""
    return bool(similar_pairs([a, b], np.array([0]), np.array([1]), least)[0])


def mix(h: np.ndarray) -> np.ndarray:
    """mixed(), in place."""
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h ^= h >> np.uint64(33)
        h *= np.uint64(factor)
    h ^= h >> np.uint64(33)
    return h


def bit_planes(rows: np.ndarray) -> list[np.ndarray]:
    """The number of rows that have each bit, for each column and bit: its binary digits, lowest first.

    Three rows are added at a time, all columns and bits at once: what their sum carries are rows of the next digit.
    """
    planes = []
    while len(rows):
        carried = []
        while len(rows) > 1:
            k = max(1, len(rows) // 3)
            a, b = rows[:k], rows[k : 2 * k]
            odd, both = a ^ b, a & b
            if len(rows) > 2:
                c = rows[2 * k : 3 * k]
                both |= odd & c
                odd ^= c
            carried.append(both)
            rows = np.concatenate((odd, rows[3 * k :])) if len(rows) > 3 * k else odd
        planes.append(rows[0])
        rows = np.concatenate(carried) if carried else rows[:0]
    return planes


def more_than(planes: list[np.ndarray], bound: np.ndarray) -> np.ndarray:
    """For each column the bits whose number exceeds its bound; planes as of bit_planes()."""
    above, level = np.zeros(len(bound), dtype=np.uint64), np.full(len(bound), np.uint64((1 << 64) - 1))
    for i in reversed(range(max(len(planes), int(bound.max()).bit_length()))):
        digit = planes[i] if i < len(planes) else np.zeros(len(bound), dtype=np.uint64)
        asked = np.uint64(0) - ((bound >> i) & 1).astype(np.uint64)
        above |= level & digit & ~asked
        level &= ~(digit ^ asked)
    return above


def line_prints(forms: list[str]) -> np.ndarray:
    """FINGERPRINTS fingerprints of each form: majority bits of its hashed n-grams, of its letters if it has fewer than GRAM.

    Forms of about one length are the columns of a matrix, padded with blanks, whose n-grams do not count.
    """
    out = np.zeros((len(forms), FINGERPRINTS), dtype=np.uint64)
    sizes = np.array([max(GRAM, len(x)) for x in forms], dtype=np.int64)
    order, at = np.argsort(sizes, kind="stable"), 0
    while at < len(forms):
        to = at + 1
        while to < len(forms) and (to + 1 - at) * sizes[order[to]] <= CHUNK:
            to += 1
        own, width = order[at:to], int(sizes[order[to - 1]])
        text = "".join([forms[i].ljust(width) for i in own.tolist()])
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").reshape(len(own), width)
        grams, factor, step = points.T.astype(np.uint64, order="C"), int(BASE), 1
        while step < GRAM:  # of one sign, two, four, eight
            grams = grams[:-step] * np.uint64(factor) + grams[step:]
            factor, step = factor * factor % (1 << 64), 2 * step
        counts = sizes[own] - GRAM + 1
        past = np.arange(counts[0], len(grams))[:, None] >= counts
        hashes = np.empty((len(grams), FINGERPRINTS, len(own)), dtype=np.uint64)
        hashes[:, 0] = mix(grams)
        for k in range(1, FINGERPRINTS):
            hashes[:, k] = mix(grams ^ np.uint64(k * int(BASE) % (1 << 64)))
        hashes[counts[0] :].transpose(0, 2, 1)[past] = 0
        planes = bit_planes(hashes.reshape(len(grams), -1))
        out[own] = more_than(planes, np.tile(counts // 2, FINGERPRINTS)).reshape(FINGERPRINTS, -1).T
        at = to
    return out


def forms_of(rows: DataFrame) -> DataFrame:
    """(id, digest, line, h1, h2, form, fp, fp1, …) of every line of `rows` (id, digest, text) that holds a letter or digit.

    h1, h2: BLAKE2b of the form, 128 bits; fp, fp1, …: line_prints(), null for lines that are not compared.
    """
    fields = simhash.names(FINGERPRINTS)

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        at, line, hashes, forms = [], [], bytearray(), []
        for i, text in enumerate(batch.column("text").to_pylist()):
            for k, form in enumerate(normal_forms(text or "")):
                if form:
                    at.append(i)
                    line.append(k)
                    hashes += hashlib.blake2b(form.encode("utf-8", "surrogatepass"), digest_size=16).digest()
                    forms.append(form)
        own, both = pa.array(at, pa.int64()), np.frombuffer(bytes(hashes), dtype=">i8").astype(np.int64).reshape(-1, 2)
        fuzzy = list(dict.fromkeys(f for f in forms if is_fuzzy(f)))
        place = dict(zip(fuzzy, range(len(fuzzy)), strict=True))
        spot, prints = pa.array([place.get(f) for f in forms], pa.int64()), line_prints(fuzzy).view(np.int64)
        arrays = [*(batch.column(c).take(own) for c in ("id", "digest")), pa.array(line, pa.int32()), pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(forms, pa.string())]
        arrays += [pa.array(np.ascontiguousarray(prints[:, k])).take(spot) for k in range(FINGERPRINTS)]
        return pa.RecordBatch.from_arrays(arrays, ["id", "digest", "line", "h1", "h2", "form", *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, DOCS):
                yield of(batch.slice(first, DOCS))

    return rows.mapInArrow(lean(run), "id long, digest long, line int, h1 long, h2 long, form string, " + ", ".join(f"{c} long" for c in fields))


def blocked(hits: DataFrame, block: int) -> DataFrame:
    """`hits` (node, group) with lo, hi and side: groups of more than `block` rows become pairs of blocks, which a task compares."""
    large = hits.groupBy("group").agg(F.count("*").alias("n")).where(F.col("n") > block)
    large = large.select("group", F.ceil(F.col("n") / block).cast("int").alias("blocks"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    every = hits.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(large, ["group", "salt"], "left").fillna(1, ["blocks"])
    every = every.select("node", "group", "blocks", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int").alias("side"))
    dealt = every.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    return dealt.select("node", "group", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"), "side")


def linked_groups(text: list[str], prints: np.ndarray, side: np.ndarray, edges: np.ndarray, least: float, distance: int) -> np.ndarray:
    """The class of each text: within each group of rows edges[g] to edges[g + 1], those within `distance` bits that are similar.

    prints[row]: fingerprints. Texts of two sides are compared with one another, those of one side too if it is the only
    one. In the k-th round the k-th text of each group meets those after it, all groups at once.
    """
    own, lo, hi = np.arange(len(text)), edges[:-1], edges[1:]
    lo, hi = lo[hi > lo], hi[hi > lo]
    if not len(lo):
        return own
    two = np.minimum.reduceat(side, lo) != np.maximum.reduceat(side, lo)
    k, asked = 0, [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    while True:
        if not len(lo) or sum(len(a) for a, _ in asked) >= PAIRS:  # few pairs wait for those of later rounds
            a, b = (np.concatenate(x) for x in zip(*asked, strict=True))
            asked = asked[:1]
            for first in range(0, len(a), PAIRS):
                x, y = a[first : first + PAIRS], b[first : first + PAIRS]
                apart = own[x] != own[y]
                x, y = x[apart], y[apart]
                same = similar_pairs(text, x, y, least)
                merge_labels(own, x[same], y[same])
        if not len(lo):
            return own
        for part in np.array_split(np.arange(len(lo)), max(1, int((hi - lo - k).sum()) // RUN)):
            n = hi[part] - lo[part] - k - 1
            a = np.repeat(lo[part] + k, n)
            b = a + 1 + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            fits = (own[a] != own[b]) & (~np.repeat(two[part], n) | (side[a] != side[b]))
            a, b = a[fits], b[fits]
            close = (np.bitwise_count(prints[a] ^ prints[b]) <= distance).any(axis=1)
            asked.append((a[close], b[close]))
        k += 1
        longer = hi - lo > k + 1
        lo, hi, two = lo[longer], hi[longer], two[longer]


def picked(lines: DataFrame, nodes: DataFrame, n: int, most: int = MAPPED) -> DataFrame:
    """The rows of `lines` (node, …; n rows in all, numbered from zero in each piece) whose node is among `nodes` (node).

    Up to `most` lines, the nodes are a map of bits, in rows of 32,768, which is broadcast: a bit for each line, however
    many nodes there are, and lines stay where they are.
    """
    if n > most:
        return lines.join(nodes, "node", "left_semi")
    bits = F.bitmap_construct_agg(F.bitmap_bit_position("node")).alias("bits")
    maps = nodes.groupBy(F.bitmap_bucket_number("node").alias("bucket")).agg(bits)
    at = F.bitmap_bit_position(lines["node"])
    byte = F.conv(F.hex(F.substring(maps["bits"], (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    asked = (maps["bucket"] == F.bitmap_bucket_number(lines["node"])) & (F.getbit(byte, (at % 8).cast("int")) == 1)
    return lines.join(F.broadcast(maps), asked, "left_semi")


def similar_links(rows: DataFrame, least: float, distance: int) -> DataFrame:
    """Edges (a, b) that span the lines of each block pair of `rows` (node, form, fp, fp1, …, group, lo, hi, side) that are similar."""
    fields = simhash.names(FINGERPRINTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, _ in row_runs(batches, ["group", "lo", "hi"], TEXTS, most=-1):  # a run has 2 * BLOCK rows or so at most
            node, text, side = numpy_column(table, "node"), table.column("form").to_pylist(), numpy_column(table, "side")
            prints = np.stack([numpy_column(table, c).view(np.uint64) for c in fields], axis=1)
            keys = np.stack([numpy_column(table, c) for c in ("group", "lo", "hi")])
            edges = np.concatenate(([0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1, [len(node)]))
            own = linked_groups(text, prints, side, edges, least, distance)
            linked = np.flatnonzero(own != np.arange(len(node)))
            yield pa.RecordBatch.from_arrays([pa.array(node[linked]), pa.array(node[own[linked]])], ["a", "b"])

    keys = ["group", "lo", "hi"]
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(lean(run), "a long, b long")


def repeated_lines(rows: DataFrame, least: float = SIMILARITY, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """(id, digest, removed array<int>): the lines that repeat an earlier one, exactly or by edit similarity.

    rows: (id long; digest long, of the text; text), equal rows only once. Earlier is the smaller (id, digest, line),
    rows without an id last. Lines are equal if their whole normal forms are, told by a cryptographic digest of 128 bits.
    Texts are written once and not dealt; later only those of lines that are compared are read again.
    """
    fields = simhash.names(FINGERPRINTS)
    whole = stage(forms_of(rows).withColumn("node", F.monotonically_increasing_id()), "forms")
    total = whole.count()
    distinct = whole.groupBy("h1", "h2").agg(F.min("node").alias("node"), F.count("*").alias("n"), *[F.min(c).alias(c) for c in fields])
    distinct = stage(distinct, "distinct")
    alike = stage(distinct.where("fp IS NOT NULL").groupBy(*fields).agg(F.min("node").alias("node"), F.count("*").alias("n")), "alike")
    # different lines of equal fingerprints share a chain too
    same = stage(alike.where("n > 1").select(*fields, F.col("node").alias("b")), "same")
    same = distinct.select(F.col("node").alias("a"), *fields).join(same, fields).where("a <> b").select("a", "b")
    chains = connected_components(simhash.close_links(alike, distance, fields=fields).unionByName(same))
    hits = stage(chains.select("node", F.col("component").alias("group")), "hits")
    unstage(alike)
    # only texts that are compared are dealt
    texts = picked(whole.select("node", "form", *fields), hits.select("node"), total)
    edges = stage(similar_links(blocked(hits, block).join(texts, "node"), least, distance), "links")
    unstage(hits)
    groups = stage(connected_components(edges), "groups")
    unstage(edges)
    own = stage(picked(distinct.select("node", "h1", "h2", "n"), groups.select("node"), total).join(groups, "node"), "own")
    exact = distinct.where("n > 1").join(own, "node", "left_anti").select("h1", "h2", "n", F.col("node").alias("group"))
    repeats = stage(own.select("h1", "h2", "n", F.col("component").alias("group")).unionByName(exact), "repeats")
    spots = stage(hot_join(whole.select("id", "digest", "line", "h1", "h2", "node"), repeats.hint("shuffle_hash"), ["h1", "h2"], "n", total).drop("h1", "h2", "n"), "spots")
    unstage(whole, distinct, groups, own, repeats)
    first = F.min(F.struct(F.col("id").isNull().alias("lost"), "id", "digest", "line", "node")).alias("first")
    keep = stage(spots.groupBy("group").agg(first, F.count("*").alias("n")).select("group", "n", F.col("first.node").alias("keep")), "keep")
    gone = hot_join(spots, keep, "group", "n", total).where("node <> keep")
    found = stage(gone.groupBy("id", "digest").agg(F.collect_set("line").alias("removed")), "removed")  # within one document
    unstage(spots, keep)
    return found


#: In place of a row's line numbers: every line that holds a letter or digit.
EVERY = -1


def without_lines(docs: DataFrame, text_col: str, removed_col: str) -> DataFrame:
    """`docs` with the lines numbered in `removed_col` cut from the text, and their number in that column's place."""
    names = docs.columns
    at, places = names.index(text_col), names.index(removed_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            removed = batch.column(places).to_pylist()
            for i, gone in enumerate(removed):
                if gone and texts[i] is not None:
                    rows = texts[i].split("\n")
                    gone = set(gone) if gone[0] != EVERY else {k for k, x in enumerate(normal_forms(texts[i])) if x}
                    removed[i] = gone
                    texts[i] = "\n".join(x for k, x in enumerate(rows) if k not in gone)
            arrays = list(batch.columns)
            arrays[at], arrays[places] = pa.array(texts, pa.string()), pa.array([len(g or ()) for g in removed], pa.int64())
            yield pa.RecordBatch.from_arrays(arrays, names)

    schema = ", ".join(f"`{f.name}` {'long' if f.name == removed_col else f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(lean(run), schema)


def dedup_lines(docs: DataFrame, least: float = SIMILARITY, distance: int = DISTANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with repeated lines cut from the text, and n_removed_lines (a column of that name is replaced).

    Of each group of equal or similar lines the one with the smallest (id, text digest, line) stays. Every line with a
    letter or digit goes if it equals an earlier one; those with MIN_WORDS words or MIN_SIGNS signs also if they are
    similar to another and within `distance` bits of it in one of FINGERPRINTS fingerprints. Every row stays, if with an empty text; a null text stays null. Rows count one by one: those
    that share an id but not a text, or lack an id (they come last), repeat one another like any others; of rows that
    share both, one keeps what is new in it and the others nothing. An empty table gives an empty result. Other
    columns stay, whatever they are called.
    """
    docs = docs.drop("n_removed_lines")
    own_id, own_digest, row, gone, *of = fresh(docs.columns, "own_id", "own_digest", "row", "gone", "id_of", "digest_of", "first_of")
    keyed = docs.withColumns({own_id: F.col(id_col).cast("long"), own_digest: F.xxhash64(text_col)})
    same = lambda other: keyed[own_id].eqNullSafe(other[of[0]]) & (keyed[own_digest] == other[of[1]])
    slim = keyed.where(F.col(text_col).isNotNull()).select(F.col(own_id).alias("id"), F.col(own_digest).alias("digest"), F.col(text_col).alias("text"))
    single, others = keyed, None
    if slim.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").first() is not None:  # without a look at the texts
        twice = stage(slim.groupBy(F.col("id").alias(of[0]), F.col("digest").alias(of[1])).agg(F.count("*").alias("n")).where("n > 1").drop("n"), "twice")
        # rows that share id and text are numbered and written, so that one of them stays the first
        copies = stage(keyed.join(twice, same(twice), "left_semi").withColumn(row, F.monotonically_increasing_id()), "copies")
        firsts = stage(copies.groupBy(F.col(own_id).alias(of[0]), F.col(own_digest).alias(of[1])).agg(F.min(row).alias(of[2])), "firsts")
        if firsts.first() is not None:
            own = copies.join(firsts, copies[own_id].eqNullSafe(firsts[of[0]]) & (copies[own_digest] == firsts[of[1]]))
            single = keyed.join(twice, same(twice), "left_anti").unionByName(own.where(F.col(row) == F.col(of[2])).select(keyed.columns))
            others = own.where(F.col(row) != F.col(of[2])).select(*docs.columns, F.array(F.lit(EVERY)).alias("n_removed_lines"))
    found = repeated_lines(single.where(F.col(text_col).isNotNull()).select(F.col(own_id).alias("id"), F.col(own_digest).alias("digest"), F.col(text_col).alias("text")), least, distance)
    found = found.select(F.col("id").alias(of[0]), F.col("digest").alias(of[1]), F.col("removed").alias(gone)).hint("shuffle_hash")
    match = single[own_id].eqNullSafe(found[of[0]]) & (single[own_digest] == found[of[1]])
    joined = single.join(found, match, "left").select(*docs.columns, F.col(gone).alias("n_removed_lines"))
    return without_lines(joined if others is None else joined.unionByName(others), text_col, "n_removed_lines")
