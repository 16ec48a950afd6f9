import hashlib
import math

from foliant.llm import mixing

SCHEMA = "doc_id long, text string, source string, copy_no string"


def slow_count(seed, doc_id, rate):
    u = int(hashlib.md5(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:13], 16) / 2**52
    k, p = 0, math.exp(-rate) if rate > 0 else 1.0
    total = p
    while round(total, 12) <= u:
        k += 1
        p *= rate / k
        total += p
    return k


def test_counts_invert_the_poisson_distribution(spark):
    rows = [(i, f"t{i}", "a" if i % 3 else "b", "clash") for i in range(600)] + [(None, None, None, None), (3, "again", "b", "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    weights = {"a": 1.0, "b": 3.0}
    n = {s: sum(r[2] == s for r in rows) for s in "ab"}
    rate = {s: round(weights[s] / 4 * len(rows) / n[s], 9) for s in "ab"} | {None: 0.0}
    got = mixing.mix(df, weights, seed=5).collect()
    want = []
    for doc_id, text, source, _ in rows:
        want += [(doc_id, text, k) for k in range(1, slow_count(5, doc_id, rate[source]) + 1)]
    assert sorted((r.doc_id, r.text, r.copy_no) for r in got) == sorted(want)
    share = sum(r.source == "b" for r in got) / len(got)
    assert 0.68 < share < 0.82


def test_order_is_global_and_high_rates_hold(spark):
    df = spark.createDataFrame([(i, "t", "only", "") for i in range(40)], SCHEMA)
    got = mixing.mix(df, {"only": 1.0}, epochs=300.0).collect()
    assert abs(len(got) - 12000) < 600


def test_without_weights_and_empty(spark):
    df = spark.createDataFrame([(i, "t", "big" if i % 10 else "small", "") for i in range(1000)], SCHEMA)
    got = mixing.mix(df).groupBy("source").count().collect()
    assert {r.source: round(r["count"] / 1000, 1) for r in got} in ({"big": 0.8, "small": 0.2}, {"big": 0.7, "small": 0.2}, {"big": 0.8, "small": 0.3}, {"big": 0.7, "small": 0.3})
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0


def test_many_sources_go_another_way_to_the_same_rows(spark, monkeypatch):
    rows = [(i, f"t{i}", f"s{i % 7}" if i % 8 else None, "") for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = sorted((r.doc_id, r.copy_no) for r in mixing.mix(df).collect())
    monkeypatch.setattr(mixing, "SOURCES", 2)
    assert sorted((r.doc_id, r.copy_no) for r in mixing.mix(df).collect()) == want
