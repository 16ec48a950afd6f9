import random
import zlib
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.llm import charlm, toxicity

DOCS = "doc_id long, text string, lang string, score string, toxic string"
LABELS = "doc_id long, quality int, toxic int"
WORDS = "the and of this house garden river walks slowly under green trees while people talk about weather today".split()


def decoder():
    codes, owner = charlm.encode(["you idiot moron clown pathetic scum worthless trash " * 3 + " ".join(WORDS)], True)
    keys, n = np.unique(charlm.grams(codes, owner, 3)[0], return_counts=True)
    return toxicity.Decoder(charlm.KneserNey.of_counts(keys, n, 3, False))


@pytest.mark.parametrize(("noisy", "word"), [("1d10t", "idiot"), ("m0r0n!", "moron"), ("$cum", "scum"), ("p4th3t1c", "pathetic"), ("id*ot", "idiot"), ("idiooooot", "idiot"), ("i.d.i.o.t", "idiot"), ("tr@sh,", "trash"), ("idiot***", "idiot"), ("garden.", "garden")])
def test_noise_is_undone(noisy, word):
    assert word in toxicity.restore(decoder(), noisy)


def test_spelt_out_words_are_found():
    assert toxicity.spaced_runs("you i d i o t and a b") == ["i d i o t"]
    assert decoder()(toxicity.lattice("m 0 r o n", True))[0] == "moron"
    read = toxicity.Reader(decoder())
    assert {"=idiot", "=a"} <= read("you are a i d i o t") and "=scum" in read("s c u m")


@pytest.mark.parametrize("word", ["1d10t", "sc*m", "ttrash", "c10wn"])
def test_search_finds_the_best_reading_of_all(word):
    decode, places = decoder(), toxicity.lattice(word, False)
    best = []
    for choice in product(*places):
        text, total, last = "", 0.0, ""
        for letter, cost in choice:
            if letter == "=" and not text:
                total = -1e9
            write = letter if letter not in ("", "=") else ""
            total += cost + (decode.cost(("  " + text)[-2:], write) if write else 0.0)
            text += write
        best.append((total + decode.cost(("  " + text)[-2:], " "), text))
    assert decode(places, 1)[0] == max(best)[1]


def test_scores(spark):
    rng = random.Random(9)
    docs, labels = [], []
    for i in range(400):
        words = rng.choices(WORDS, k=rng.randint(5, 60))
        toxic = i % 4 == 0
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(["idiot", "moron.", "Scum"]))
        docs.append((i, " ".join(words), "en", "s", "t"))
        labels.append((i, 1, int(toxic)))
    docs += [(500, None, None, None, None), (501, "", "en", "", ""), (502, "what an 1d10t", "en", "", ""), (503, "m o r o n they said", "en", "", ""), (None, "idiot", "", "", ""), (504, "x" * 20000 + " scum", "", "", "")]
    labels += [(None, 1, 1), (7, None, None), (9999, 1, 1), (4, 1, 1)]
    found = toxicity.score(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)).collect()
    got = {r.doc_id: r for r in found}
    assert len(found) == len(docs) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found)
    assert all(got[i].predicted == int(i % 4 == 0) for i in range(400))
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(400))
    assert [got[i].predicted for i in (500, 501, 502, 503, 504, None)] == [0, 0, 1, 1, 1, 1]


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "idiot", "", "", "")], DOCS)
    empty = spark.createDataFrame([], LABELS)
    assert [r.predicted for r in toxicity.score(docs, empty).collect()] == [0]
    assert toxicity.score(docs.limit(0), empty).count() == 0


def slow_cover(sets, least):
    left, rules = [set(x) for x in sets], []
    while True:
        count = {f: sum(f in x for x in left) for x in left for f in x}
        best = max(count, key=lambda f: (count[f], f[0] == "=", len(f), f), default=None)
        if best is None or count[best] < least:
            return rules
        rules.append(best)
        left = [x for x in left if best not in x]


def test_cover_is_that_of_one_rule_after_another(spark):
    rng = random.Random(2)
    names = [f"{rng.choice('=^')}{'abcdefgh'[: rng.randint(1, 8)]}{i}" for i in range(25)]
    sets = [set(rng.choices(names, weights=range(1, 26), k=rng.randint(1, 5))) for _ in range(120)]
    rows = [(i, 1, f) for i, x in enumerate(sets) for f in x]
    got = [r.f for r in toxicity.cover(spark.createDataFrame(rows, "id long, n long, f string"), 3).collect()]
    assert sorted(got) == sorted(slow_cover(sets, 3)) and len(got) > 5


def rare_rule_tables(spark, n=24_000):
    """Toxic words that few of many labelled texts hold, each at a place of its own."""
    rng = random.Random(8)
    docs, labels = [], []
    for i in range(n):
        words, kind = rng.choices(WORDS, k=8), i % 2
        if kind:
            words[3] = "scum" if i % 1499 else ["1d10t", "idiot", "idi0t"][i % 3]
        docs.append((i, " ".join(words) + f" {i}", "en", "s", "t"))
        labels.append((i, 1, kind))
    extra = [(n + i, w, "en", "s", "t") for i, w in enumerate(["zounds here", "zounds there"])]
    last = spark.range(n).where("id % 2 = 1 AND crc32(CAST(id AS string)) % 5 <> 0").orderBy(F.desc(F.xxhash64("id"))).limit(8)  # no sample by lowest hashes holds them
    rare = [r.id for r in last.collect()]
    for i in rare:
        docs[i] = (i, f"zounds {i}", "en", "s", "t")
    return spark.createDataFrame(docs + extra, DOCS), spark.createDataFrame(labels, LABELS), len(rare)


def test_every_labelled_text_teaches(spark):
    """Eight toxic texts of 24,000 labelled ones hold a word of their own: a rule."""
    docs, labels, n = rare_rule_tables(spark)
    assert n >= toxicity.LEAST
    got = {r.doc_id: r for r in toxicity.score(docs, labels).where("doc_id >= 24000").collect()}
    assert [got[i].predicted for i in (24000, 24001)] == [1, 1] and got[24000].rules == ["=zounds"]


def test_beyond_tables_and_parts_scores_are_the_same(spark):
    docs, labels, _ = rare_rule_tables(spark, 400)
    more = spark.createDataFrame([(1000, "m o r o n i d 1 0 t", "", "", ""), (1001, "s.c.u.m $cum scuuum", "", "", ""), (1002, None, "", "", ""), (None, "sc*m", "", "", "")], DOCS)
    want = sorted(map(tuple, toxicity.score(docs.union(more), labels).collect()), key=str)
    assert sorted(map(tuple, toxicity.score(docs.union(more), labels, most=20, part=1).collect()), key=str) == want
    assert any(r[0] == 1001 and r[3] for r in want)


def test_filter_learns_from_every_labelled_text(spark):
    docs, labels, _ = rare_rule_tables(spark)
    left = toxicity.without_toxic(docs, labels)
    assert left.columns == docs.columns and left.where("doc_id >= 24000").count() == 0
    assert left.where("doc_id < 24000 AND doc_id % 2 = 0").count() == 12_000


def test_texts_of_a_batch_are_read_in_pieces():
    """A worker holds a part of a batch's texts as strings, and reads all of them."""
    import tracemalloc

    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([f"{i} " + "x" * 5000 for i in range(4000)])], ["text"])
    tracemalloc.start()
    seen = [x for x in toxicity.read_batch(lambda t: t[:5], batch, "text")]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen == [f"{i} xxxxx"[:5] for i in range(4000)] and peak < 8e6
