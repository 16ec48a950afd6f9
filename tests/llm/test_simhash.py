import random

import numpy as np
import pytest
import xxhash

from foliant.llm import simhash

SCHEMA = "doc_id long, text string, fp string"


def slow_fingerprint(text, n=3, k=0):
    raw = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    words, word = [], b""
    for c in raw + b" ":
        if c == 0x20 or 9 <= c <= 13:
            words += [word] if word else []
            word = b""
        else:
            word += bytes([c])
    shingles = [b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    hs = [slow_mixed(xxhash.xxh64_intdigest(s, 42), k) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_mixed(h, k):
    """The k-th hash of a shingle from its first one."""
    if k:
        h ^= k * 0x9E3779B97F4A7C15 % 2**64
        h = (h ^ h >> 33) * 0xFF51AFD7ED558CCD % 2**64
        h = (h ^ h >> 33) * 0xC4CEB9FE1A85EC53 % 2**64
        h ^= h >> 33
    return h


def slow_family(text, n, size):
    return [slow_fingerprint(text, n, k) for k in range(size)]


def slow_components(ids, fps, distance):
    fps = [f if isinstance(f, list) else [f] for f in fps]
    near = lambda a, b: any((x ^ y).bit_count() <= distance for x, y in zip(a, b))
    low = dict(zip(ids, ids))
    changed = True
    while changed:
        changed = False
        for i, a in zip(ids, fps):
            for j, b in zip(ids, fps):
                if low[j] < low[i] and near(a, b):
                    low[i] = low[j]
                    changed = True
    return low


TEXTS = ["", None, "  \t\n", "One", "one two", "ONE two three", "one\x0btwo\x0cthree four", "á É ü é x y", "a" * 5000 + " b c d", "x y z " * 400]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint_is_the_majority_of_shingle_hashes(text):
    assert simhash.fingerprint(text, 3) == slow_fingerprint(text)


@pytest.mark.parametrize("distance", [3, 5])
@pytest.mark.parametrize("n", [10, 10**6, 10**9])
def test_some_mask_covers_every_close_pair(distance, n):
    masks, rng = simhash.block_plan(n, distance), random.Random(n)
    for _ in range(300):
        x = sum(1 << b for b in rng.sample(range(64), distance))
        assert any(not x & m for m in masks)


def test_near_duplicates_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash, "RUN", 8)
    rng = random.Random(1)
    base = [" ".join(rng.choice("abcdefgh") * 3 for _ in range(rng.randint(0, 60))) for _ in range(25)]
    texts = base + [t.upper() for t in base[:5]] + [f"{t} tail" for t in base] + [None, "", "Hi"] + ["same text again and again"] * 20
    rows = [(i * 3 + 1, t, "clash") for i, t in enumerate(texts)]
    rng.shuffle(rows)
    got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA), 3, 3).collect()}
    fps = [slow_fingerprint(t) for _, t, _ in rows]
    want = slow_components([i for i, _, _ in rows], fps, 3)
    assert got == {i: (f, want[i]) for (i, _, _), f in zip(rows, fps)}


def test_links_of_random_neighbours_match_brute_force(monkeypatch):
    monkeypatch.setattr(simhash, "RUN", 8)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    fps = [int(b) for b in base]
    for b in base:
        for _ in range(25):
            fps.append(int(b) ^ sum(1 << int(i) for i in rng.choice(64, rng.integers(1, 6), replace=False)))
    fps = np.unique(np.array(fps, dtype=np.uint64))
    labels = np.arange(len(fps))
    for k, mask in enumerate(simhash.block_plan(len(fps), 3)):
        key = fps & np.uint64(mask)
        order = np.argsort(key, kind="stable")
        simhash.link_runs(labels, order, key[order], fps, [i for i in range(64) if not mask >> i & 1], 3)
    want = slow_components(list(range(len(fps))), [int(f) for f in fps], 3)
    assert labels.tolist() == [want[i] for i in range(len(fps))]


def test_more_fingerprints_find_more_near_copies(spark):
    """Pairs at a five-word similarity of 0.8 to 0.95: what one and what three fingerprints find at 7 bits; what is found agrees with brute force."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghijkl", k=5))
    rows = []
    for i in range(120):
        words = [word() for _ in range(150)]
        new = words[:]
        for k in rng.sample(range(150), 2):
            new[k] = "zzzzz"
        rows += [(2 * i, " ".join(words), "x"), (2 * i + 1, " ".join(new), "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    caught = {}
    for size in (1, 3):
        got = {r.doc_id: r.component_id for r in simhash.near_duplicates(df, 5, 7, size=size).collect()}
        want = slow_components([i for i, _, _ in rows], [slow_family(t, 5, size) for _, t, _ in rows], 7)
        assert got == want
        caught[size] = sum(got[2 * i + 1] == 2 * i for i in range(120)) / 120
    assert caught[3] > 0.9 and caught[3] > caught[1]


def test_empty_table_and_missing_ids(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = simhash.near_duplicates(spark.createDataFrame([(None, "a b c", "x"), (4, "a b c", "x"), (4, "a b c", "x")], SCHEMA)).collect()
    assert sorted((str(r.doc_id), r.component_id) for r in rows) == [("4", 4), ("4", 4), ("None", 4)]


def test_dedup_keeps_one_of_each_group_and_all_columns(spark):
    df = spark.createDataFrame([(7, "p q r s t u", "a"), (3, "p q r s t u", "b"), (9, "other words stand here alone now", None)], SCHEMA)
    got = simhash.simhash_dedup(df)
    assert got.columns == df.columns and sorted(r.doc_id for r in got.collect()) == [3, 9]


@pytest.mark.parametrize("distance", [3, 4, 7])
def test_large_blocks_are_split_by_further_bits(distance, monkeypatch):
    """As by brute force, with thousands of fingerprints that agree under a mask; few of them are compared one by one."""
    rng = np.random.default_rng(distance)
    base = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    near = [int(b) ^ sum(1 << int(i) for i in rng.choice(64, rng.integers(1, distance + 3), replace=False)) for b in base[:800]]
    fps = np.unique(np.concatenate((base, np.array(near, dtype=np.uint64))))
    mask = simhash.block_plan(len(fps), distance)[0]
    fps = np.unique(fps & ~np.uint64(mask) | np.uint64(mask & 0x5A5A5A5A5A5A5A5A))
    pairs, link = [], simhash.link_runs
    monkeypatch.setattr(simhash, "link_runs", lambda labels, rows, keys, *rest: pairs.append((np.unique(keys, return_counts=True)[1] ** 2).sum()) or link(labels, rows, keys, *rest))
    want = np.arange(len(fps))
    for i in range(len(fps)):
        close = np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= distance)
        simhash.merge_labels(want, np.full(len(close), i), close)
    assert simhash.linked_labels(fps, mask, distance).tolist() == want.tolist() and len(np.unique(want)) < len(fps) - 300
    assert sum(pairs) < len(fps) ** 2 / 4
