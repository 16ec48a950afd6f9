import os

import numpy as np
import pytest

from foliant.llm import embeddings

SCHEMA = "vec_id long, embedding array<float>, label int, width string"


def slow(rows, threshold=0.98):
    def fine(v):
        return v is not None and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)

    near = {i: set() for i, *_ in rows}
    for i, u, a, _ in rows:
        for j, v, b, _ in rows:
            if i != j and a == b and a is not None and fine(u) and fine(v):
                u1, v1 = np.array(u, dtype=np.float32).astype(float), np.array(v, dtype=np.float32).astype(float)
                if u1 @ v1 / np.sqrt(u1 @ u1) / np.sqrt(v1 @ v1) >= threshold:
                    near[i].add(j)
    low = {i: i for i in near}
    for _ in near:
        low = {i: min([low[i], *(low[j] for j in near[i])]) for i in near}
    return {i: (len(near[i]), low[i], low[i] == i) for i in near}


@pytest.mark.parametrize("block", [4, 1024])
def test_links_match_brute_force(spark, block):
    rng = np.random.default_rng(5)
    rows, vec = [], 0
    for label in (0, 1, None):
        for _ in range(12):
            centre = rng.normal(size=16)
            for _ in range(rng.integers(1, 7)):
                rows.append((vec, (centre * rng.uniform(0.5, 3) + rng.normal(size=16) * 0.03).tolist(), label, "x"))
                vec += 1
    rows += [(vec + k, [1.0, 2.0] * 8, 1, "copy") for k in range(9)]
    rows += [(900, None, 1, None), (901, [0.0] * 16, 1, None), (902, [float("nan")] * 16, 1, None), (903, [None] * 16, 1, None), (904, [float("inf")] + [1.0] * 15, 1, None)]
    order = rng.permutation(len(rows))
    df = spark.createDataFrame([rows[i] for i in order], SCHEMA)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df, block=block).collect()}
    assert got == slow(rows)


def test_empty_table(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def measured_recall(spark, rows):
    """The share of all links at 0.98 that the index finds; it may find none below."""
    got = {r.vec_id: r.n_links for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    want = {}
    for label in {r[2] for r in rows}:
        own = [r for r in rows if r[2] == label and r[1] is not None]
        v = np.array([r[1] for r in own], dtype=np.float32).astype(float)
        ok = np.isfinite(v).all(axis=1) & (v != 0).any(axis=1)
        v[ok] /= np.sqrt((v[ok] * v[ok]).sum(axis=1, keepdims=True))
        near = (v @ v.T >= 0.98) & ok & ok[:, None]
        np.fill_diagonal(near, False)
        want |= dict(zip((r[0] for r in own), near.sum(axis=1).tolist()))
    assert all(got[i] <= n for i, n in want.items())
    return sum(got[i] for i in want) / max(1, sum(want.values()))


def test_recall_on_clustered_vectors(spark):
    """5,000 vectors, most of them within 0.98 of some others at all distances: at least 0.9 of the links, by brute force."""
    rng, rows = np.random.default_rng(11), []
    for _ in range(500):
        centre = rng.normal(size=48)
        for _ in range(10):
            rows.append((len(rows), (centre + rng.normal(size=48) * rng.uniform(0.02, 0.16)).tolist(), len(rows) % 3 // 2))
    assert measured_recall(spark, rows) >= 0.9


@pytest.mark.skipif(not os.path.exists("/root/testdata/check_s/embeddings.parquet"), reason="no tables")
def test_recall_on_the_given_vectors(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet("/root/testdata/check_s/embeddings.parquet").select("vec_id", "embedding", "label").collect() if r.label is not None]
    assert measured_recall(spark, rows) >= 0.9


def test_unusable_vectors_and_missing_ids(spark):
    rows = [(None, [1.0, 2.0], 1, ""), (5, [1.0, 2.0], 1, ""), (5, [1.0, 2.0], 1, ""), (6, [1.0], 1, ""), (7, [], 1, "")]
    got = sorted(((r.vec_id or -1, r.n_links, r.component_id) for r in embeddings.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == sorted([(-1, 0, None), (5, 1, 5), (5, 1, 5), (6, 0, 6), (7, 0, 7)], key=str)
    unusable = spark.createDataFrame([(1, None, 1, ""), (2, [0.0], 1, "")], SCHEMA)
    assert [r.n_links for r in embeddings.near_duplicates(unusable).collect()] == [0, 0]
