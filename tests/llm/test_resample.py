import hashlib
import math
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from foliant.llm import registry, resample

SCHEMA = "doc_id long, text string, score string, rank string, n_words string, position string"
WORD = "0123456789abcdefghijklmnopqrstuvwxyz"


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return "".join(c if c in WORD or ord(c) >= 128 else " " for c in low).split(" ")


def grams(text, longest):
    own = [w for w in words(text) if w]
    return [" ".join(own[i : i + n]) for n in range(1, longest + 1) for i in range(len(own) - n + 1)]


def slow(rows, target, longest=1, buckets=10000, percent=10, least=20):
    of = {}

    def bucket(gram):
        if gram not in of:
            of[gram] = zlib.crc32(gram.encode()) % buckets
        return of[gram]

    found = [(r[0], [bucket(g) for g in grams(r[1], longest)], len(grams(r[1], 1))) for r in rows]
    source, wanted = Counter(b for _, f, _ in found for b in f), Counter(bucket(g) for t in target for g in grams(t, longest))
    s_all, t_all = sum(source.values()), sum(wanted.values())
    gain = {b: math.floor(1000 * math.log((wanted[b] + 1) * (s_all + buckets) / ((source[b] + 1) * (t_all + buckets)))) for b in source}
    out = []
    for doc, f, n in found:
        h = int(hashlib.sha256(f"2024:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        out.append([doc, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    fit = sorted((x for x in out if x[5] >= least), key=lambda x: (-x[3], x[0] is not None, x[0] or 0))
    for k, x in enumerate(fit[: len(fit) * percent // 100], 1):
        x[4] = k
    return sorted(str(tuple(x[:5])) for x in out)


def corpus(n, seed):
    rng = random.Random(seed)
    vocabulary = ["alpha", "Beta", "gamma-ray", "ÉTÉ", "été", "中文", "x1", "it's", "the", "of "]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60))) for _ in range(n)]
    return texts, [" ".join(rng.choice(vocabulary[:3]) for _ in range(12)) for _ in range(9)] + [None, ""]


@pytest.mark.parametrize(("longest", "buckets"), [(1, 10000), (3, 64)])
def test_resampling_equals_brute_force(spark, longest, buckets, monkeypatch):
    texts, target = corpus(300, longest)
    rows = [(i, t, "a", "b", "c", "d") for i, t in enumerate(texts)] + [(None, "word " * 30, None, None, None, None), (901, None, "", "", "", ""), (902, "", "", "", "", ""), (903, "!!! \n", "", "", "", ""), (904, "long " * 30000, "", "", "", "")]
    rows += [rows[5]] * 2
    monkeypatch.setattr(resample, "BLOCK", 3000)
    df = spark.createDataFrame(rows, SCHEMA)
    got = resample.resample(df, spark.createDataFrame([(t, "z") for t in target], "text string, doc_id string"), longest, buckets)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(str(tuple(r)) for r in got.collect()) == slow(rows, target, longest, buckets)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    some = spark.createDataFrame([(1, "word " * 25, "", "", "", "")], SCHEMA)
    assert resample.resample(none, some).count() == 0
    assert [tuple(r) for r in resample.resample(some, none.select("text"), percent=100).collect()] == [eval(x) for x in slow([(1, "word " * 25)], [], percent=100)]  # noqa: S307


@pytest.mark.parametrize("depth", [1, 2, 3, 5, 8])
def test_suffix_array_brings_equal_grams_together(depth):
    rng = np.random.default_rng(depth)
    ids = rng.integers(0, 4, 400)
    order, common = resample.suffix_array(ids, depth)
    assert sorted(order.tolist()) == list(range(400))
    held = np.concatenate([ids, np.zeros(depth, dtype=ids.dtype)])
    for i in range(1, 400):
        a, b = held[order[i - 1] :][:depth], held[order[i] :][:depth]
        shared = 0
        while shared < depth and a[shared] == b[shared] and a[shared]:
            shared += 1
        assert common[i] == shared
        assert a.tolist() <= b.tolist()


def test_sql_equals_the_query(spark, tmp_path):
    texts, target = corpus(200, 9)
    rows = [(i, t) for i, t in enumerate(texts)] + [(500, None), (501, ""), (None, "x " * 40)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(t,) for t in target], "text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    found = registry.op13_importance_resampling(spark, str(tmp_path))
    want = con.execute(registry.OP13_SQL).fetchall()
    assert sorted(str(tuple(r)) for r in found.select("doc_id", "n_features", "weight", "score", "rank").collect()) == sorted(map(str, want))
