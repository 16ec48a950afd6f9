import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from foliant.llm import packing

VOCABULARY = "word_bpe_49k.json"
TEXTS = ["Hello  World's\tfoo\x0bbar baz\x1cqq", "<|endoftext|> hi<|endoftext|> <|startoftext|>", "é é x ́y Σας İ", "12 345a's don't we'LL", "", "  \n ", "a" * 5000 + " b", None, "word " * 9000, "same"]


def slow_ids(text):
    tok = Tokenizer.from_file(str(public_tokenizers.path(VOCABULARY)))
    return [*tok.encode(text or "", add_special_tokens=False).ids, 1]


def test_words_encode_like_whole_texts():
    texts = [t or "" for t in TEXTS]
    got = packing.WordEncoder(str(public_tokenizers.path(VOCABULARY)))(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [slow_ids(t)[:-1] for t in texts]


def check(lengths, capacity):
    sequence, offset = packing.pack(lengths, capacity)
    for s in np.unique(sequence):
        own = np.flatnonzero(sequence == s)
        own = own[np.argsort(offset[own])]
        assert offset[own].tolist() == [0, *np.cumsum(lengths[own]).tolist()[:-1]]
        assert lengths[own].sum() <= capacity
    return sequence.max() + 1


@pytest.mark.parametrize("seed", range(4))
def test_packing_is_gapless_and_near_the_lower_bound(seed):
    rng = np.random.default_rng(seed)
    lengths = np.minimum(4096, rng.lognormal(6.5, 1.2, 4000).astype(int) + 1)
    assert check(lengths, 4096) <= -(-lengths.sum() // 4096) * 1.005 + 1


def test_few_sizes_and_ties():
    assert check(np.array([2048] * 10 + [1366] * 3), 4096) == 7
    assert check(np.array([4096] * 3), 4096) == 3
    assert check(np.array([1]), 4096) == 1


def test_pack_documents_round_trip(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(9, "same", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, piece string")
    got = packing.pack_documents(df, VOCABULARY, shard=4).collect()
    want = []
    for i, t, _ in rows:
        ids = slow_ids(t)
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want.append((i, k, at, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes())))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    for s in {r.sequence_id for r in got}:
        own = sorted((r.offset, r.length) for r in got if r.sequence_id == s)
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 4096


def test_empty_table(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
