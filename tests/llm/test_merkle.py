import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from foliant.llm import merkle, registry

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, tree string, position string"
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(values):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes, fan):
    """The top of a tree, and for each leaf its steps (left, right)."""
    steps, own = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, at in enumerate(own):
            first = at // fan * fan
            run = nodes[first : first + fan]
            steps[i].append(("".join(run[: at - first]), "".join(run[at - first + 1 :])))
            own[i] = at // fan
        nodes = [digest(*nodes[i : i + fan]) for i in range(0, len(nodes), fan)]
    return nodes[0], steps


def slow(rows, altered, fan):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf(r[:5]), leaf(altered(r)[:5])))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    tops = {s: climb([x[2] for x in sorted(groups[s])], fan) for s in order}
    root, outer = climb([tops[s][0] for s in order], fan)
    out = []
    for k, s in enumerate(order):
        for x, steps in zip(sorted(groups[s]), tops[s][1]):
            path, folded = steps + outer[k], x[3]
            for left, right in path:
                folded = digest(left, folded, right)
            out.append((x[1] if x[0] else None, x[2], tops[s][0], root, digest(*(a + b for a, b in path)), folded, folded == root))
    return sorted(map(str, out))


def lowered(r):
    touched = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
    return (*r[:4], r[4].translate({c: c + 32 for c in range(65, 91)}) if touched and r[4] is not None else r[4])


def rows(n, sources, seed):
    rng = random.Random(seed)
    out = [(i * 7 % 1009, rng.choice(sources), rng.choice(["en", None]), rng.choice([None, 3, 10]), rng.choice(["Über Ab", "", None, "plain", "Z" * 3000]), "c", "d", "e") for i in range(n)]
    return out + out[:2] + ([(None, sources[0], None, None, None, None, None, None)] * 3 if n > 10 else [])


@pytest.mark.parametrize(("n", "sources", "fan"), [(700, ["hot"] * 6 + ["b", None, "", "é", "Z"], 16), (90, [f"s{i}" for i in range(40)], 3), (30, ["one"], 2), (1, ["one"], 16), (1, [None], 16), (17, ["a"], 16)])
def test_proofs_equal_brute_force(spark, n, sources, fan):
    every = rows(n, sources, n) if n > 1 else rows(1, sources, 1)[:1]
    df = spark.createDataFrame(every, SCHEMA)
    touched = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    now = F.when(touched, F.translate("text", registry.UPPER, registry.LOWER)).otherwise(F.col("text"))
    got = merkle.verified(df, COLUMNS, "source", "doc_id", fan, {"text": now})
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(str(tuple(r)) for r in got.collect()) == slow(every, lowered, fan)


def test_empty_table(spark):
    assert merkle.verified(spark.createDataFrame([], SCHEMA), COLUMNS, "source", "doc_id").count() == 0


def test_hot_nodes_and_many_groups_go_other_ways_to_the_same_rows(spark, monkeypatch):
    from foliant.llm import order

    every = rows(400, ["hot"] * 5 + [f"s{i}" for i in range(30)], 3)
    monkeypatch.setattr(order, "SMALL", 0)

    def low_bar(left, right, on, size, total, least=0):
        bar = 20
        hot, cold = right.where(F.col(size) > bar), right.where(F.col(size) <= bar)
        rest = left.join(F.broadcast(hot.select(on)), on, "left_anti").join(cold, on)
        return left.join(F.broadcast(hot), on).unionByName(rest)

    monkeypatch.setattr(order, "hot_join", low_bar)
    monkeypatch.setattr(merkle, "hot_join", low_bar)
    got = merkle.verified(spark.createDataFrame(every, SCHEMA), COLUMNS, "source", "doc_id", 4)
    assert sorted(str(tuple(r)) for r in got.collect()) == slow(every, lambda r: r, 4)
