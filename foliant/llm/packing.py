"""Best-fit packing of tokenised documents into sequences of bounded length.

Linear grouping scheme: large pieces are rounded up within groups of equal cardinality, the few sizes left
are packed by an optimised set of configurations, actual pieces take their slots, and the small ones go,
longest first, to the fullest sequence that still holds them. Pieces are dealt to shards at random, and
each shard is packed by itself; a shard loses at most about one sequence.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import numpy_column, stage

CAPACITY = 4096
END_ID = 1
#: Pieces of one shard, on average: a bound on what one task packs.
SHARD = 16384
#: Pieces longer than this share of a sequence are large; a configuration then holds two at most.
LARGE = 1 / 3
GROUPS = 96
#: Words that a worker remembers, and the longest one remembered, in characters.
MEMORY, LONG_WORD = 600_000, 64
#: Texts encoded by one call of the tokeniser.
AT_ONCE = 256
#: Sizes and capacity are rounded to this many tokens while configurations are sought.
GRAIN = 8


#: Words beyond these characters, and those that may hold a special token, go through the tokeniser itself.
PLAIN = re.compile("[!-~\u00a1-\u024f]*")


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 stands for itself, other bytes for the letters from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = (b for b in range(256) if b not in set(own))
    return {b: chr(b) for b in own} | {b: chr(0x100 + i) for i, b in enumerate(other)}


def word_pattern(file: dict) -> regex.Pattern | None:
    """The pattern that splits words, if a vocabulary's file has the steps that WordEncoder takes by itself, else None."""
    normal, before = file.get("normalizer") or {}, file.get("pre_tokenizer") or {}
    steps, splits = normal.get("normalizers") or [normal], before.get("pretokenizers") or [before]
    known = {"NFC", "Lowercase"} <= {x.get("type") for x in steps} <= {"NFC", "Lowercase", "Replace"}
    blanks = all(x["pattern"] == {"Regex": r"\s+"} and x["content"] == " " for x in steps if x.get("type") == "Replace")
    if not known or not blanks or [x.get("type") for x in splits] != ["Split", "ByteLevel"]:
        return None
    split, level = splits
    if not (split.get("invert") and split.get("behavior") == "Removed" and "Regex" in split["pattern"]) or level.get("add_prefix_space") or level.get("use_regex"):
        return None
    return regex.compile(split["pattern"]["Regex"])


class WordEncoder:
    """Token ids of whole texts, as little-endian unsigned 32-bit bytes.

    Where the file says that texts are lower-cased and split by a pattern that never joins what a blank or a line
    end separates, each word between these is encoded once and remembered, and a plain word's parts go to the
    merge model directly. Texts of a vocabulary with other steps go through the tokeniser whole.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.known: dict[str, bytes] = {"": b""}
        self.parts: dict[str, bytes] = {}
        with open(path, encoding="utf-8") as f:
            self.token = word_pattern(json.load(f))

    def part(self, part: str) -> bytes:
        got = self.parts.get(part)
        if got is None:
            spelt = part if part.isascii() else part.encode().decode("latin-1").translate(self.letters)
            got = array("I", [t.id for t in self.model.tokenize(spelt)]).tobytes()
            if len(part) <= LONG_WORD:
                self.parts[part] = got
        return got

    def word(self, word: str) -> bytes:
        if PLAIN.fullmatch(word) and "<|" not in word:
            return b"".join(map(self.part, self.token.findall(word.lower())))
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def __call__(self, texts: list[str]) -> list[bytes]:
        if self.token is None:
            return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        split = [t.replace("\n", " ").split(" ") for t in texts]
        if len(self.known) > MEMORY:
            self.known = {"": b""}
        if len(self.parts) > MEMORY:
            self.parts = {}
        new = set().union(*split) - self.known.keys()
        self.known.update((w, self.word(w)) for w in new)
        out = [b"".join(map(self.known.__getitem__, words)) for words in split]
        for word in new:
            if len(word) > LONG_WORD:
                del self.known[word]
        return out


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(vocabulary: str) -> WordEncoder:
    """vocabulary: a file name known to public_tokenizers, or a path."""
    if vocabulary not in _ENCODERS:
        path = vocabulary
        if "/" not in vocabulary:
            import public_tokenizers

            path = public_tokenizers.path(vocabulary)
        _ENCODERS[vocabulary] = WordEncoder(str(path))
    return _ENCODERS[vocabulary]


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each text's ids and the end id, cut only where over `capacity`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(vocabulary), np.array([END_ID], dtype="<u4").tobytes()
        for batch in batches:
            doc, piece, start, length, crc = [], [], [], [], []
            for first in range(0, batch.num_rows, AT_ONCE):
                texts = [t or "" for t in batch.column(1).slice(first, AT_ONCE).to_pylist()]
                for row, ids in enumerate(encode(texts), first):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        doc.append(row)
                        piece.append(k)
                        start.append(at // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
            own = batch.column(0).take(pa.array(doc, pa.int64()))
            arrays = [own, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "piece", "start", "length", "ids_crc32"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_configuration(prices: np.ndarray, reach: np.ndarray, most: int) -> np.ndarray:
    """How many of each size fill one sequence at the highest total price; `most` items at most.

    reach[i, c]: the room left in room c after one item of size i, or the last index where it doesn't fit.
    """
    rooms = reach.shape[1]
    last, picks = np.append(np.zeros(rooms), -np.inf), []
    for _ in range(most):
        value = last[reach] + prices[:, None]
        pick = value.argmax(axis=0)
        best = value[pick, np.arange(rooms)]
        pick[best <= last[:-1] + 1e-12] = -1
        picks.append(pick)
        last = np.append(np.maximum(best, last[:-1]), -np.inf)
    counts, room = np.zeros(len(prices)), rooms - 1
    for pick in reversed(picks):
        if pick[room] >= 0:
            counts[pick[room]] += 1
            room = reach[pick[room], room]
    return counts


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, most: int, rounds: int = 2000) -> tuple[np.ndarray, np.ndarray]:
    """Configurations (columns) and how often each is used to meet the demand with the fewest sequences.

    The linear programme's columns come one at a time from its dual prices. rounds only ends a search that
    degenerates: any basis met on the way is feasible.
    """
    grains, rooms = -(-sizes // GRAIN), capacity // GRAIN + 1
    reach = np.arange(rooms)[None, :] - grains[:, None]
    reach[reach < 0] = rooms
    basis = np.diag(np.maximum(1, capacity // GRAIN // grains).astype(float))
    used = demand / np.diag(basis)
    for _ in range(rounds):
        prices = np.linalg.solve(basis.T, np.ones(len(sizes)))
        column = best_configuration(prices, reach, most)
        if column @ prices <= 1 + 1e-7:
            break
        direction = np.linalg.solve(basis, column)
        ratio = np.full(len(sizes), np.inf)
        grows = direction > 1e-9
        ratio[grows] = np.maximum(used[grows], 0) / direction[grows]
        leave = int(np.argmin(ratio))
        step = ratio[leave]
        basis[:, leave] = column
        used -= step * direction
        used[leave] = step
    return basis, np.maximum(used, 0)


def pack(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of every piece; lengths are from 1 to capacity."""
    n = len(lengths)
    sequence, members = np.full(n, -1, dtype=np.int64), []
    order = np.argsort(-lengths, kind="stable")
    whole = order[lengths[order] == capacity]
    large = order[(lengths[order] < capacity) & (lengths[order] > capacity * LARGE)]
    members += [[i] for i in whole.tolist()]
    rest = order[lengths[order] <= capacity * LARGE].tolist()
    if len(large):
        queues, sizes = [], []
        for group in np.array_split(large, min(GROUPS, len(large))):
            if sizes and lengths[group[0]] == sizes[-1]:
                queues[-1] += group.tolist()
            else:
                queues.append(group.tolist())
                sizes.append(int(lengths[group[0]]))
        basis, used = configurations(np.array(sizes), np.array([float(len(q)) for q in queues]), capacity, int(1 / LARGE))
        for column, times in zip(basis.T.astype(int), np.floor(used + 1e-6).astype(int), strict=True):
            for _ in range(times):
                members.append([q.pop() for q, k in zip(queues, column, strict=True) for _ in range(min(k, len(q)))])
        members = [m for m in members if m]
        rest = sorted((i for q in queues for i in q), key=lambda i: -lengths[i]) + rest
    left = [capacity - int(lengths[m].sum()) for m in members]
    by_room: dict[int, list[int]] = {}
    rooms = 0  # bit r is set if some sequence has room for exactly r
    for b, r in enumerate(left):
        by_room.setdefault(r, []).append(b)
        rooms |= 1 << r
    for i in rest:
        size = int(lengths[i])
        fits = rooms >> size
        if fits:
            r = size + (fits & -fits).bit_length() - 1
            b = by_room[r].pop()
            if not by_room[r]:
                rooms ^= 1 << r
            members[b].append(i)
        else:
            r, b = capacity, len(members)
            members.append([i])
        by_room.setdefault(r - size, []).append(b)
        rooms |= 1 << (r - size)
    offset = np.zeros(n, dtype=np.int64)
    for b, m in enumerate(members):
        sequence[m] = b
        offset[m] = [0, *accumulate(lengths[m].tolist())][:-1]
    return sequence, offset


def best_fit(cut: DataFrame, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """The rows of `cut` (column length) with sequence_id and offset. `cut` is read twice: give it staged."""
    shards = max(1, -(-cut.count() // shard))
    names = [*cut.columns, "sequence_id", "offset"]

    def run(table: pa.Table) -> pa.Table:
        sequence, offset = pack(numpy_column(table, "length"), capacity)
        own = table.column("__shard")[0].as_py() << 32
        arrays = [table.column(c) for c in names[:-2]]
        return pa.table([*arrays, pa.array(own + sequence), pa.array(offset)], names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema) + ", sequence_id long, offset long"
    dealt = cut.withColumn("__shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)))
    return dealt.groupBy("__shard").applyInArrow(run, schema)


def pack_documents(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", capacity: int = CAPACITY, shard: int = SHARD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of every row of `docs`.

    A null text counts as empty and holds the end id alone; repeated rows are packed as often as they
    occur; an empty table gives an empty result; other columns of `docs` play no part.
    """
    return best_fit(stage(pieces(docs, vocabulary, capacity, id_col, text_col), "pieces"), capacity, shard)
