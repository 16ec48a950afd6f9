"""Byte-level BPE: texts to token ids by the ranks of a vocabulary file, and ids back to bytes.

A text is split by a pattern. Pieces that are no token themselves are merged together in padded matrices, one for
each range of lengths: in every round each row merges its leftmost pair of the lowest rank, which a hash table over
pairs of ids gives, and the row closes up by one column. A row without a pair left leaves its matrix.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import fresh, mixed

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: The rank of a pair that is no token.
NONE = np.int32(2**31 - 1)
#: Cells of one matrix. Pieces of more bytes than LONG are merged each by itself.
CELLS, LONG = 1 << 20, 256
#: Pieces that a worker remembers, and the longest one remembered, in characters.
MEMORY, LONG_PIECE = 600_000, 64
#: Characters encoded at a time, and pieces of a longer text.
AT_ONCE, PIECES = 1 << 20, 1 << 16

#: Code points that the pattern library takes for letters or numbers, from a Unicode version later than the
#: one that the tokenizer goes by, where they stand for neither. First and last of each range.
NEWER_LETTERS = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F),
    (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1),
    (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A),
    (0x11DB0, 0x11DDB), (0x11DF1, 0x11DF1), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF3), (0x187F8, 0x187FF),
    (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128),
    (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF),
    (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF),
    (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)
NEWER_NUMBERS = ((0x11DE0, 0x11DE9), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16FF4, 0x16FF6))


def ranges(of: tuple) -> str:
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in of)


class Splitter:
    """Pieces of texts by a pattern whose \\p{L} and \\p{N} are those of the tokenizer's Unicode version."""

    def __init__(self, pattern: str) -> None:
        self.plain = regex.compile(pattern)
        # Within a negated set the newer ones are added back, as it is the letters and numbers there that are left out.
        inside = regex.sub(r"\[\^([^\]]*)\\p\{L\}\\p\{N\}\]", lambda m: f"(?:[^{m[1]}\\\\p{{l}}\\\\p{{n}}]|[{ranges(NEWER_LETTERS + NEWER_NUMBERS)}])".replace("\\\\", "\\"), pattern)
        inside = inside.replace(r"\p{L}", f"[\\p{{L}}--[{ranges(NEWER_LETTERS)}]]").replace(r"\p{N}", f"[\\p{{N}}--[{ranges(NEWER_NUMBERS)}]]")
        self.strict = regex.compile("(?V1)" + inside.replace(r"\p{l}", r"\p{L}").replace(r"\p{n}", r"\p{N}"))
        self.newer = re.compile(f"[{ranges(NEWER_LETTERS + NEWER_NUMBERS)}]")

    def __call__(self, text: str) -> Iterator[list[str]]:
        """The text's pieces, in lists of bounded length."""
        pattern = self.plain if text.isascii() or not self.newer.search(text) else self.strict
        if len(text) <= AT_ONCE:
            yield pattern.findall(text)
            return
        found = pattern.finditer(text)
        while some := [m.group() for m in islice(found, PIECES)]:
            yield some


class PairTable:
    """The rank of each pair of ids that joins to a token: an open hash table with linear steps."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray) -> None:
        size = 1 << max(4, int(2 * len(left)).bit_length())
        self.mask = np.uint64(size - 1)
        self.keys, self.ranks = np.full(size, -1, dtype=np.int64), np.full(size, NONE, dtype=np.int32)
        keys = self.key(left, right)
        slot, rest = self.slot(keys), np.arange(len(keys))
        while len(rest):
            free = rest[self.keys[slot[rest]] == -1]
            self.keys[slot[free]] = keys[free]  # of several that ask for a slot, the last has it
            mine = self.keys[slot[rest]] == keys[rest]
            self.ranks[slot[rest[mine]]] = rank[rest[mine]]
            rest = rest[~mine]
            slot[rest] = (slot[rest] + 1) & int(self.mask)

    @staticmethod
    def key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left.astype(np.int64) << 32) | right.astype(np.int64)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return (mixed(keys.view(np.uint64)) & self.mask).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of pairs (one-dimensional, no id negative)."""
        keys = self.key(left, right)
        slot = self.slot(keys)
        met = self.keys[slot]
        out = np.where(met == keys, self.ranks[slot], NONE)
        rest = np.flatnonzero((met != keys) & (met != -1))
        while len(rest):
            slot[rest] = (slot[rest] + 1) & int(self.mask)
            met = self.keys[slot[rest]]
            hit = met == keys[rest]
            out[rest[hit]] = self.ranks[slot[rest[hit]]]
            rest = rest[~hit & (met != -1)]
        return out


class Encoder:
    """Token ids of texts and bytes of token ids, by a file of ranks; an id is its token's rank."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        pairs = [(self.ranks[t[:k]], self.ranks[t[k:]], r) for t, r in self.ranks.items() for k in range(1, len(t)) if t[:k] in self.ranks and t[k:] in self.ranks]
        self.pairs = PairTable(*np.array(pairs, dtype=np.int64).reshape(-1, 3).T)
        self.of_byte = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.split = Splitter(pattern)
        self.known: dict[str, bytes] = {}
        spelt: list[bytes] = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            spelt[rank] = token
        self.start = np.concatenate([[0], np.cumsum([len(t) for t in spelt])])
        self.spelt = np.frombuffer(b"".join(spelt), dtype=np.uint8)

    def merged(self, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of ids (padded with -1 behind their lengths) with all merges done, and their lengths."""
        out, ends = np.full_like(ids, -1), lengths.copy()
        rows = np.arange(len(ids))
        rank = np.full((len(ids), max(1, ids.shape[1] - 1)), NONE, dtype=np.int32)
        pair = np.arange(rank.shape[1])[None, :] < (lengths - 1)[:, None]
        y, x = np.nonzero(pair)
        rank[y, x] = self.pairs(ids[y, x], ids[y, x + 1])
        lengths = lengths.copy()
        while True:
            at = rank.argmin(axis=1)
            low = rank[np.arange(len(rank)), at]
            done = low == NONE
            if done.any():  # rows without a pair leave
                out[rows[done], : ids.shape[1]] = ids[done]
                ends[rows[done]] = lengths[done]
                ids, rank, rows, lengths, at, low = (a[~done] for a in (ids, rank, rows, lengths, at, low))
            if not len(rows):
                return out, ends
            every = np.arange(len(rows))
            ids[every, at] = low
            width = ids.shape[1] - 1
            column = np.arange(width)[None, :]
            ids = np.take_along_axis(ids, column + (column > at[:, None]), axis=1)
            lengths -= 1
            # A pair is named after its left member: the merged one has its right neighbour's place behind it now.
            rank = np.concatenate([rank, np.full((len(rank), 1), NONE, dtype=np.int32)], axis=1)
            column = np.arange(max(1, width - 1))[None, :]
            rank = np.take_along_axis(rank, column + (column > at[:, None]), axis=1)
            for y, x in ((every[at > 0], at[at > 0] - 1), (every[at < lengths - 1], at[at < lengths - 1])):
                rank[y, x] = self.pairs(ids[y, x], ids[y, x + 1])
            last = at >= lengths - 1
            fits = last & (at < rank.shape[1])
            rank[every[fits], at[fits]] = NONE

    def merged_long(self, ids: np.ndarray) -> np.ndarray:
        """One long row with all merges done. A round merges the leftmost pair of the lowest rank and, along with it, the
        pairs of that rank that would follow: all up to the first whose new neighbours join at a still lower rank."""
        rank = np.full(len(ids), NONE, dtype=np.int32)
        rank[:-1] = self.pairs(ids[:-1], ids[1:])
        while len(ids) > 1 and (low := rank.min()) != NONE:
            at = np.flatnonzero(rank == low)
            head = np.flatnonzero(np.diff(at, prepend=-2) != 1)
            at = at[(np.arange(len(at)) - np.repeat(head, np.diff(np.append(head, len(at))))) % 2 == 0]
            new = np.full(len(at), low, dtype=np.int32)
            before = ids[np.maximum(at - 1, 0)].copy()
            before[1:][np.diff(at) == 2] = low
            lower = np.zeros(len(at), dtype=bool)
            some = at > 0
            lower[some] = self.pairs(before[some], new[some]) < low
            some = at + 2 < len(ids)
            lower[some] |= self.pairs(new[some], ids[at[some] + 2]) < low
            if lower.any():
                at = at[: int(lower.argmax()) + 1]
            keep = np.ones(len(ids), dtype=bool)
            keep[at + 1] = False
            ids[at] = low
            ids, rank = ids[keep], rank[keep]
            at = at - np.arange(len(at))
            changed = np.union1d(at, at[at > 0] - 1)
            rank[changed[changed == len(ids) - 1]] = NONE
            changed = changed[changed < len(ids) - 1]
            rank[changed] = self.pairs(ids[changed], ids[changed + 1])
        return ids

    def pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Each piece's ids, as little-endian 32-bit numbers; bytes that are a token are that token."""
        out: list[bytes] = [b""] * len(pieces)
        sizes = np.array([len(p) for p in pieces], dtype=np.int64)
        for i, piece in enumerate(pieces):
            whole = self.ranks.get(piece)
            if whole is not None:
                out[i], sizes[i] = np.array([whole], dtype="<u4").tobytes(), 0
            elif len(piece) > LONG:
                ids = self.of_byte[np.frombuffer(piece, dtype=np.uint8)]
                out[i], sizes[i] = self.merged_long(ids).astype("<u4").tobytes(), 0
        for power in range(1, LONG.bit_length()):
            bucket = np.flatnonzero((sizes > 1 << power - 1) & (sizes <= 1 << power))
            for first in range(0, len(bucket), CELLS >> power):
                some = bucket[first : first + (CELLS >> power)]
                lengths = sizes[some]
                ids = np.full((len(some), 1 << power), -1, dtype=np.int32)
                filled = np.arange(1 << power)[None, :] < lengths[:, None]
                ids[filled] = self.of_byte[np.frombuffer(b"".join(pieces[i] for i in some.tolist()), dtype=np.uint8)]
                ids, lengths = self.merged(ids, lengths)
                flat = ids[np.arange(ids.shape[1])[None, :] < lengths[:, None]].astype("<u4").tobytes()
                ends = (4 * np.cumsum(lengths)).tolist()
                for i, a, b in zip(some.tolist(), [0, *ends], ends, strict=False):
                    out[i] = flat[a:b]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids, as little-endian 32-bit numbers."""
        out: list[list[bytes]] = [[] for _ in texts]
        waiting: list[tuple[int, list[str]]] = []
        size = 0

        def settle() -> None:
            if len(self.known) > MEMORY:
                self.known = {}
            new = [*set().union(*(p for _, p in waiting)).difference(self.known)]
            self.known.update(zip(new, self.pieces([p.encode() for p in new]), strict=True))
            for row, pieces in waiting:
                out[row].append(b"".join(map(self.known.__getitem__, pieces)))
            for piece in new:
                if len(piece) > LONG_PIECE:
                    del self.known[piece]
            waiting.clear()

        for row, text in enumerate(texts):
            for pieces in self.split(text):
                waiting.append((row, pieces))
                size += len(pieces)
                if size > PIECES:
                    settle()
                    size = 0
        settle()
        return [b"".join(parts) for parts in out]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the ids' tokens, one after another."""
        first, sizes = self.start[ids], self.start[ids + 1] - self.start[ids]
        ends = np.cumsum(sizes)
        return self.spelt[np.repeat(first - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(vocabulary: str, pattern: str | None) -> Encoder:
    """vocabulary: a file name known to public_tokenizers, or a path; pattern: None for that of public_tokenizers."""
    import public_tokenizers

    pattern = pattern or public_tokenizers.PATTERN
    if (vocabulary, pattern) not in _ENCODERS:
        path = vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary)
        _ENCODERS[vocabulary, pattern] = Encoder(str(path), pattern)
    return _ENCODERS[vocabulary, pattern]


def runs(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Consecutive rows of at most so much size in all, or a single one: first and last + 1."""
    first, held = 0, 0
    for row, size in enumerate(sizes):
        if row > first and held + size > most:
            yield first, row
            first, held = row, 0
        held += size
    if first < len(sizes):
        yield first, len(sizes)


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str | None = None, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """`docs` with its texts' ids (little-endian unsigned 32-bit numbers in a binary column) in place of the texts.

    A null text counts as empty and has no id; repeated rows are encoded each; an empty table stays empty; all other
    columns stay as they are, whatever their names; one called like ids_col is replaced.
    """
    kept = [c for c in docs.columns if c not in (text_col, ids_col)]
    (text,) = fresh(kept, "__text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, pattern).encode
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for first, end in runs(pc.binary_length(texts).fill_null(0).to_pylist(), 4 * AT_ONCE):
                ids = encode([t or "" for t in texts.slice(first, end - first).to_pylist()])
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(first, end - first) for i in range(len(kept))), pa.array(ids, pa.binary())], [*kept, ids_col])

    picked = docs.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{text_col}`").alias(text))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema if f.name != text), f"`{ids_col}` binary"])
    return picked.mapInArrow(run, schema)


def decode(tokens: DataFrame, vocabulary: str = VOCABULARY, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """`tokens` with the bytes that its ids stand for in one more column (binary; empty for null ids).

    Bytes and not text: ids that end within a character have no text. A column called like bytes_col is replaced.
    """
    kept = [c for c in tokens.columns if c != bytes_col]
    at = kept.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = encoder(vocabulary, None).decode
        for batch in batches:
            sizes = pc.binary_length(batch.column(at)).fill_null(0).to_pylist()
            for first, end in runs(sizes, 4 * AT_ONCE):
                part = batch.slice(first, end - first)
                spelt = [decode(np.frombuffer(ids or b"", dtype="<u4").astype(np.int64)).tobytes() for ids in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(spelt, pa.binary())], [*kept, bytes_col])

    picked = tokens.select(*(F.col(f"`{c}`") for c in kept))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema), f"`{bytes_col}` binary"])
    return picked.mapInArrow(run, schema)
