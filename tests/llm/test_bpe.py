import base64
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from foliant.llm import bpe, registry

PATH = public_tokenizers.path(bpe.VOCABULARY)


@pytest.fixture(scope="module")
def own():
    return bpe.Encoder(str(PATH), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def theirs(own):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})


def numbers(packed):
    return np.frombuffer(packed, "<u4").tolist()


def test_every_kind_of_character_splits_as_the_library_splits(own, theirs):
    edges = {c + d for pair in bpe.NEWER_LETTERS + bpe.NEWER_NUMBERS for c in pair for d in (-1, 0, 1)}
    points = [c for c in sorted(edges | set(range(0x3100)) | set(range(0x3100, 0x110000, 97))) if not 0xD800 <= c < 0xE000]
    texts = [f"a{c}a 1{c}1 {c}{c} .{c}.  {c}" for c in map(chr, points)]
    assert [numbers(g) for g in own.encode(texts)] == [theirs.encode_ordinary(t) for t in texts]


def test_random_texts_and_long_pieces(own, theirs):
    rng = random.Random(5)
    texts = ["", " ", "\n\n \n", "a" * 5000, "ab" * 4000, "=" * 999 + " " * 999, "日本" * 2000, "it's we'LL <|endoftext|>", "é" * 300 + "́"]
    texts += ["".join(rng.choice("ab cdé中文日本語 \n\t'sthe1234567!?=-_😀 ") for _ in range(rng.randint(0, 300))) for _ in range(200)]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(200, 3000))) for letters in ("ab", "etaoinshr", "中文日本語", "=-") for _ in range(4)]
    got = own.encode(texts)
    assert [numbers(g) for g in got] == [theirs.encode_ordinary(t) for t in texts]
    assert [own.decode(np.array(numbers(g), dtype=np.int64)).tobytes().decode() for g in got] == texts


def test_a_text_encoded_in_parts(own, theirs, monkeypatch):
    text = "one two, three's 44 \n\n five  " * 500
    want = theirs.encode_ordinary(text)
    monkeypatch.setattr(bpe, "AT_ONCE", 100)
    monkeypatch.setattr(bpe, "PIECES", 7)
    assert numbers(own.encode([text])[0]) == want


def slow(ranks, piece):
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        joins = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not joins:
            return [ranks[p] for p in parts]
        i = min(joins)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@pytest.mark.parametrize("seed", range(6))
def test_any_order_of_ranks(tmp_path, seed):
    """Ranks that no training would give: a merge may open a pair of a lower rank than its own."""
    rng = random.Random(seed)
    grown = {"".join(rng.choice("abc") for _ in range(rng.randint(2, 6))).encode() for _ in range(60)}
    tokens = [bytes([b]) for b in range(256)] + rng.sample(sorted(grown), len(grown))
    file = tmp_path / "own.tiktoken"
    file.write_bytes(b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate(tokens)))
    own = bpe.Encoder(str(file), ".+")
    pieces = [bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 40))) for _ in range(120)]
    want = [[own.ranks[p]] if p in own.ranks else slow(own.ranks, p) for p in pieces]
    assert [numbers(g) for g in own.pieces(pieces)] == want
    long = [own.of_byte[np.frombuffer(p, dtype=np.uint8)] for p in pieces]
    assert [own.merged_long(ids).tolist() for ids in long] == [slow(own.ranks, p) for p in pieces]


def test_encode_and_decode_tables(spark, theirs):
    rows = [(1, "Hello wörld's", "x", "y"), (2, None, None, None), (3, "", "", ""), (3, "", "", ""), (None, "中文 42\n" * 3000, "x", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, __text string, decoded string")
    tokens = bpe.encode(df)
    assert tokens.columns == ["doc_id", "__text", "decoded", "ids"]
    got = bpe.decode(tokens).collect()
    assert sorted((str(r.doc_id), numbers(r.ids), bytes(r.decoded)) for r in got) == sorted((str(i), theirs.encode_ordinary(t or ""), (t or "").encode()) for i, t, _, _ in rows)
    assert bpe.decode(bpe.encode(df.limit(0))).count() == 0


def test_query(spark, tmp_path, theirs):
    import hashlib

    rows = [(i, t) for i, t in enumerate(["", None, "same text", "same text", "Zażółć gęślą  jaźń\n" * 50, "x" * 700])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: tuple(r[1:]) for r in registry.op11_byte_bpe(spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()}
    for i, t in rows:
        ids = theirs.encode_ordinary(t or "")
        assert got[i] == (len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
