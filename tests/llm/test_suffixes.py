import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from foliant.llm import suffixes

SCHEMA = "doc_id long, text string, id string, spans string"


def slow(rows, width):
    raws = [(t or "").encode() for _, t in rows]
    times = Counter(r[i : i + width] for r in raws for i in range(len(r) - width + 1))
    out = []
    for (doc_id, _), r in zip(rows, raws):
        gone = bytearray(len(r))
        for i in range(len(r) - width + 1):
            if times[r[i : i + width]] > 1:
                gone[i : i + width] = b"\1" * width
        kept = bytes(c for c, g in zip(r, gone) if not g)
        runs = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((str(doc_id), len(r), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def corpus(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randint(1, 7)))
    passages = [" ".join(word() for _ in range(rng.randint(3, 40))) for _ in range(8)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 5)):
            p = rng.choice(passages)
            lo = rng.randrange(len(p))
            parts.append(rng.choice([p, p[lo:], p[:lo], " ".join(word() for _ in range(20))]))
        rows.append((i, "".join(parts)))
    rows += [(100, None), (101, ""), (102, "a" * 300), (103, "ab" * 90), (104, rows[3][1]), (3, rows[3][1]), (3, "other"), (None, rows[5][1]), (None, "z" * 90)]
    return rows


@pytest.mark.parametrize(("seed", "width", "gram", "heavy", "tile"), [(1, 40, 12, 20000, 1 << 20), (2, 40, 12, 2, 1 << 20), (3, 24, 8, 20000, 64)])
def test_removals_match_brute_force(spark, monkeypatch, seed, width, gram, heavy, tile):
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)
    monkeypatch.setattr(suffixes, "TILE", tile)
    got = suffixes.dedup_substrings(df, width, gram, heavy).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == slow(rows, width)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)


def test_suffixes_sort_like_bytes():
    rng = np.random.default_rng(0)
    rows = [bytes(rng.integers(97, 99, rng.integers(0, 20), dtype=np.uint8)) for _ in range(300)]
    group = np.sort(rng.integers(0, 9, 300))
    signs, size, hashes = suffixes.prefix_matrix(rows, 20)
    order, shared = suffixes.sorted_suffixes(signs, size, hashes, group)
    plain, depth = suffixes.sorted_bytes(signs, size, group)
    assert [rows[i] for i in order] == [rows[i] for i in plain] and shared.tolist() == depth.tolist()
    assert [(group[i], rows[i]) for i in order] == sorted((group[i], rows[i]) for i in range(300))


def test_collisions_are_noticed(monkeypatch):
    rows, group = [b"abx", b"aby", b"cd", b"ca"], np.zeros(4, np.int64)
    signs, size, hashes = suffixes.prefix_matrix(rows, 3)
    order, shared = suffixes.sorted_suffixes(signs, size, np.zeros_like(hashes), group)
    assert order.tolist() == [0, 1, 3, 2] and shared.tolist() == [0, 2, 0, 1]


def test_every_window_holds_an_anchor_chosen_by_content():
    rng = np.random.default_rng(1)
    raw = bytes(rng.integers(97, 101, 5000, dtype=np.uint8))
    _, pos, g, _ = suffixes.anchors([(raw, 0, len(raw) - 199)], 200, 64)
    assert np.diff(np.concatenate(([0], pos, [len(raw) - 64]))).max() <= 137
    _, other, h, _ = suffixes.anchors([(b"x" * 333 + raw, 333, 333 + len(raw) - 199)], 200, 64)
    assert (other - 333).tolist() == pos.tolist() and (g == h).all()


def test_empty_table(spark):
    assert suffixes.dedup_substrings(spark.createDataFrame([], SCHEMA)).count() == 0
