import difflib
import random
import re

import pytest
from pyspark.sql import functions as F

from foliant.operators import figures, injection

SCHEMA = "page_id long, md string, figures array<struct<caption:string,path:string>>"


def key(text):
    return re.sub("[：:;；,，.。．、]+$", "", re.sub(r"\s+", "", re.sub(figures.POSITION, "", text or ""))).strip()


def likeness(a, b):
    if not a or not b:
        return 0.0
    return 1.0 if a == b else 0.95 if a in b or b in a else difflib.SequenceMatcher(None, a, b).ratio()


def slow(md, found):
    """Every line against every caption, one figure after another."""
    if not found:
        return re.sub(figures.POSITION, "", md or "")
    page, taken = (md or "").splitlines(), []
    for caption, path in found[::-1]:
        scores = [0.0 if i in taken else likeness(key(x.strip()), key((caption or "").strip())) for i, x in enumerate(page)]
        if scores and max(scores) >= 0.72:
            at = scores.index(max(scores))
            taken.append(at)
            page = page[:at] + [f"![{caption or ''}]({path or ''})", ""] + page[at:]
    return re.sub(figures.POSITION, "", "\n".join(page))


def result(spark, rows):
    df = spark.createDataFrame([(i, md, found) for i, (md, found) in enumerate(rows)], SCHEMA)
    return [r.md for r in injection.inject(df).orderBy("page_id").collect()]


def test_injection_puts_each_figure_before_its_caption(spark):
    md = "图1 plan\ntext\n图2 section [[position: 左]]"
    rows = [(md, [("图1 plan", "a.png"), ("图2 section", "b.png")]), ("nothing alike", [("图9 other", "c.png")]), ("a [[position: 左]]\n", []), (None, None), (None, [("图1", "a")]), ("图1", [(None, None), ("。", "x")])]
    want = ["![图1 plan](a.png)\n\n图1 plan\ntext\n![图2 section](b.png)\n\n图2 section ", "nothing alike", "a \n", "", "", "图1"]
    assert result(spark, rows) == want == [slow(*r) for r in rows]


@pytest.mark.parametrize("seed", range(3))
def test_injection_equals_every_line_against_every_caption(spark, seed):
    rng = random.Random(seed)
    letters = ["ab", "图12-.", "abcdefgh ", "the plan of 图"][seed % 4]

    def text(n):
        return "".join(rng.choice(letters) for _ in range(n))

    def changed(t):
        t = list(t)
        for _ in range(rng.randint(0, max(1, len(t) // 4))):
            t[rng.randrange(len(t)) : rng.randrange(len(t)) + 1] = rng.choice(["", text(1), text(2), "x"])
            t = t or ["y"]
        return "".join(t)

    rows = []
    for _ in range(150):
        captions = [text(rng.choice([1, 2, 3, 5, 8, 14, 30, 70])) for _ in range(rng.randint(1, 4))]
        page = [rng.choice([changed(rng.choice(captions)), rng.choice(captions), text(rng.randint(0, 40)), text(3) + rng.choice(captions) + text(50), "", rng.choice(captions) + "。 "]) for _ in range(rng.randint(0, 9))]
        rows.append(("\n".join(page), [(c, f"p{i}.png") for i, c in enumerate(captions)]))
    rows.append(("z" * 50000 + "\n" + "ab" * 300, [("ab" * 290, "long.png"), ("z", "z.png")]))
    assert result(spark, rows) == [slow(*r) for r in rows]


def test_what_the_bounds_rule_out_is_not_alike(spark):
    rng = random.Random(7)
    pairs = [("".join(rng.choice("abc") for _ in range(rng.randint(1, 16))), "".join(rng.choice("abcd") for _ in range(rng.randint(1, 16)))) for _ in range(6000)]
    for a, _ in pairs[:3000]:
        b = list(a)
        for _ in range(rng.randint(0, 3)):
            b.insert(rng.randint(0, len(b)), rng.choice("abcx"))
            b.pop(rng.randrange(len(b)))
        pairs.append((a, "".join(b)))
    df = spark.createDataFrame(pairs, "a string, b string")
    out = df.select("a", "b", injection.may_be_alike(F.col("a"), F.col("b"), injection.grams(F.col("b"))).alias("may")).collect()
    alike = [r.may for r in out if difflib.SequenceMatcher(None, r.a, r.b).ratio() >= 0.72]
    assert len(alike) > 200 and all(alike)
    assert sum(r.may for r in out[:6000]) < 1500
