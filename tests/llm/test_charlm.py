import math
import random
import zlib
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pytest

from foliant.llm import charlm, language, quality

SCHEMA = "doc_id long, text string, lang string, source string, label string, n_words string"
EN = ["the cat sat on the mat and the dog ran off", "there is no other way than this one", "she then had the hat in her hand"]
DE = ["der hund und die katze sind nicht im haus", "ich habe das nicht gewusst und gehe", "wir sind heute schon zu spät gekommen"]


def slow_probability(counts, order, gram, modified, alphabet=256):
    """Interpolated Kneser-Ney straight from its definition, over strings."""
    p = 1 / alphabet
    for k in range(1, order + 1):
        if k == order:
            c = counts
        else:
            tails, level = {g[1:] for g in counts}, None
            for n in range(order - 1, k - 1, -1):
                seen = {g for g in (counts if n == order - 1 else level)}
                level = Counter(g[1:] for g in seen)
            c = level
            assert tails
        n = [max(1, sum(v == i for v in c.values())) for i in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1])
        d = [y] * 3 if not modified else [min(max(i - (i + 1) * y * n[i] / n[i - 1], 0.1), i - 0.05) for i in (1, 2, 3)]
        own = {g: v for g, v in c.items() if g[:-1] == gram[-k:][:-1]}
        total = sum(own.values())
        if total:
            freed = sum(d[min(v, 3) - 1] for v in own.values()) / total
            v = own.get(gram[-k:], 0)
            p = (v - d[min(v, 3) - 1] if v else 0) / total + freed * p
    return p


@pytest.mark.parametrize("modified", [False, True])
@pytest.mark.parametrize("order", [2, 3, 4])
def test_probabilities_follow_the_definition(order, modified):
    codes, owner = charlm.encode(EN + EN[:1] + DE, True)
    keys, n = np.unique(charlm.grams(codes, owner, order)[0], return_counts=True)
    text = lambda key: "".join(chr(int(key) >> 16 * i & 0xFFFF) for i in reversed(range(order)))
    counts = {text(k): int(v) for k, v in zip(keys, n)}
    model = charlm.KneserNey.of_counts(keys, n, order, modified)
    asked = list(counts)[:40] + ["the " [:order], "xqzk"[:order], " spä"[:order], "neez"[:order]]
    packed = np.array([sum(ord(c) << 16 * i for i, c in enumerate(reversed(g))) for g in asked], dtype=np.uint64)
    want = [slow_probability(counts, order, g, modified) for g in asked]
    assert np.allclose(model.probability(packed), want, rtol=1e-9)


def test_counts_cover_every_text(spark):
    rows = [("a", "Aa  bb"), ("a", "x"), ("b", None), ("b", "aa bb"), (None, "zz")]
    got = {(r.label, r.key): r.n for r in charlm.count_grams(spark.createDataFrame(rows, "label string, text string"), 2, True).collect()}
    want = defaultdict(int)
    for label, text in rows:
        if text:
            s = " " + " ".join(text.lower().split()) + " "
            for i in range(len(s) - 1):
                want[label, ord(s[i]) << 16 | ord(s[i + 1])] += 1
    assert got == dict(want)


def test_language_of_held_out_texts(spark):
    rows = [(i, (EN if i % 2 else DE)[i // 2 % 3] + f" {i}", "en" if i % 2 else "de", "s", "x", "y") for i in range(60)]
    rows += [(100, None, "en", "s", "", ""), (101, "", "en", "s", "", ""), (102, "12 34 !", None, None, "", ""), (103, "the dog and the cat", None, None, "", ""), (None, "der hund", "de", "", "", ""), (104, "😀", "en", "", "", "")]
    got = {r.doc_id: r for r in language.identify(spark.createDataFrame(rows, SCHEMA)).collect()}
    for doc_id, _, lang, *_ in rows[:60]:
        assert got[doc_id].lang_pred == lang and 0 <= got[doc_id].score <= 1
        assert got[doc_id].held_out == (zlib.crc32(str(doc_id).encode()) % 3 == 1)
    assert [got[i].lang_pred for i in (100, 101, 102, 103, 104)] == ["und", "und", "und", "en", "und"]
    assert got[None].held_out is False and got[100].score == 0


def test_language_with_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "some text", None, "", "", "")], SCHEMA)
    assert [r.lang_pred for r in language.identify(df).collect()] == ["und"]
    assert language.identify(df.limit(0)).count() == 0


def slow_base(text):
    text, blanks = text or "", " \t\n\x0b\x0c\r"
    words, word = [], ""
    for c in text + " ":
        if c in blanks:
            words += [word] if word else []
            word = ""
        else:
            word += c
    lines = text.split("\n")
    dup = sum(1 for i, x in enumerate(lines) if x.strip(blanks) and x in lines[:i])
    times = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {i + j for i in range(len(words) - 2) if times[tuple(words[i : i + 3])] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


@pytest.mark.parametrize("text", [None, "", " \n ", "a b c a b c", "a a a a a", "x\x1cy z é\n\nq\nq\n q\nq", "one two three four one two three\none two", "#<>| a*b"])
def test_base_counts(text):
    assert quality.base_counts(text) == slow_base(text)


def test_bands_reject_strange_texts_and_keep_plain_ones(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices(" ".join(EN if i % 2 else DE).split(), k=60)), "en" if i % 2 else "de", "s", "", "") for i in range(80)]
    odd = " ".join(f"{w}*%#$&" for w in rows[1][1].split())
    rows += [(200, odd, "en", "s", "", ""), (201, None, "en", "s", "", ""), (202, "few words", None, "s", "", ""), (203, rows[3][1], None, "s", "", "")]
    got = {r.doc_id: r for r in quality.quality_rules(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i].kept for i in range(80)) and got[203].kept
    assert not got[200].kept and not got[200].base_failed
    assert got[201].base_failed and got[202].base_failed and not got[202].kept
    assert quality.quality_rules(spark.createDataFrame([], SCHEMA)).count() == 0
    assert math.isfinite(got[5].perplexity)


def texts_and_labels():
    rng = random.Random(12)
    return [("en" if i % 2 else "de", " ".join(rng.choices(" ".join(EN if i % 2 else DE).split(), k=12))) for i in range(60)] + [(None, "not learned"), ("en", None)]


@pytest.mark.parametrize("modified", [False, True])
def test_models_counted_by_spark_equal_those_of_counts_at_hand(spark, modified):
    rows = texts_and_labels()
    found = charlm.fit(spark.createDataFrame(rows, "label string, text string"), modified=modified)
    assert found.labels == ["de", "en"]
    for label, model in zip(found.labels, found.models):
        codes, owner = charlm.encode([t for x, t in rows if x == label and t], True)
        keys, n = np.unique(charlm.grams(codes, owner, 4)[0], return_counts=True)
        want = charlm.KneserNey.of_counts(keys, n, 4, modified)
        for a, b in zip(model.levels, want.levels):
            assert all(np.allclose(x.astype(float), y.astype(float)) for x, y in zip(a, b))


def test_pruned_models_keep_their_mass(spark):
    """With room for a quarter of the n-grams: discounts and totals stay those of all, probabilities sum to one, the loss is stated."""
    df = spark.createDataFrame(texts_and_labels(), "label string, text string")
    whole, small = charlm.fit(df), charlm.fit(df, most=150)
    sizes = [sum(len(m.levels[k][0]) for m in small.models) for k in range(4)]
    assert max(sizes) <= 150 < sum(len(m.levels[3][0]) for m in whole.models)
    letters = np.arange(256, dtype=np.uint64)  # the alphabet that the lowest order spreads over
    for label in (0, 1):
        kept, full = small.models[label].levels[3], whole.models[label].levels[3]
        at, there = charlm.look_up(full[0], kept[0])
        assert there.all() and np.allclose(kept[1], full[1][at])
        for context in ("the", "und", " xq", "nic"):
            base = sum(ord(c) << 16 * (3 - i) for i, c in enumerate(context))
            assert all(abs(m.models[label].probability(letters | np.uint64(base)).sum() - 1) < 1e-6 for m in (small, whole))
    texts = [t for _, t in texts_and_labels() if t]
    loss = small.cross_entropy(texts)[0].min(axis=1) / whole.cross_entropy(texts)[0].min(axis=1)
    assert 1 <= loss.mean() < 1.5


def slow_codes(text, letters_only):
    kept = "".join(c.lower() if c.isalpha() else " " if letters_only or c.isspace() else "0" if c.isdigit() else c for c in text)
    return f" {' '.join(kept.split())} " if kept.split() else " "


def slow_entropy(text, counts, modified, letters_only):
    """(nats, number) of a text's 4-grams."""
    s = slow_codes(text, letters_only)
    own = [s[i : i + 4] for i in range(len(s) - 3)]
    return -sum(math.log(slow_probability(counts, 4, g, modified)) for g in own), len(own)


def slow_counts(texts, letters_only):
    return Counter(s[i : i + 4] for s in (slow_codes(t, letters_only) for t in texts if t) for i in range(len(s) - 3))


def test_language_query_matches_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(" ".join(EN if i % 2 else DE).split(), k=rng.randint(1, 4))), "en" if i % 2 else "de", "s", "", "") for i in range(24)]
    rows += [(50, "gehe the", None, "s", "", ""), (51, "zzz", "en", "s", "", ""), (52, "", "en", "s", "", "")]
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    models = {x: slow_counts([t for i, t, lang, *_ in rows if lang == x and not held(i)], True) for x in ("de", "en")}
    got = {r.doc_id: r for r in language.identify(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i, text, *_ in rows:
        if not any(map(str.isalpha, text)):
            assert got[i].lang_pred == "und"
            continue
        h = {x: (lambda e, n: e / max(1, n))(*slow_entropy(text, c, False, True)) for x, c in models.items()}
        best = min(h, key=lambda x: (h[x], x))
        assert got[i].lang_pred == best and got[i].held_out == held(i)
        assert math.isclose(got[i].score, 1 / sum(math.exp(-language.SHARPNESS * (v - h[best])) for v in h.values()), rel_tol=1e-4)


def test_quality_query_matches_brute_force(spark):
    rng = random.Random(5)
    words = " ".join(EN + DE).split()
    rows = [(i, " ".join(rng.choices(words, k=52)), "en" if i % 2 else None, "s", "", "") for i in range(14)]
    rows += [(30, "x9 $y " * 20 + " ".join(f"#{w}!" for w in words[:40]), "en", "s", "", ""), (31, "short", "en", "s", "", ""), (32, None, None, "s", "", "")]
    counts = slow_counts([t for _, t, *_ in rows], False)
    logs = {i: (slow_entropy(t or "", counts, True, False)[0]) / max(1, slow_base(t)[0]) for i, t, *_ in rows}
    failed = {i: (lambda b: b[0] < 50 or 100 * b[4] > 50 * b[0])(slow_base(t)) for i, t, *_ in rows}
    middle = lambda v: sorted(v)[-(-len(v) // 2) - 1]
    got = {r.doc_id: r for r in quality.quality_rules(spark.createDataFrame(rows, SCHEMA)).collect()}
    for lang in ("en", None):
        own = [i for i, _, x, *_ in rows if x == lang]
        fine = [logs[i] for i in own if not failed[i]]
        mid = middle(fine)
        width = max(quality.REACH * mid, 1.4826 * quality.DEVIATIONS * middle([abs(x - mid) for x in fine]))
        for i in own:
            assert got[i].base_failed == failed[i] and math.isclose(math.log(got[i].perplexity), logs[i], rel_tol=1e-4, abs_tol=1e-9)
            assert got[i].kept == (not failed[i] and abs(logs[i] - mid) <= width)


@pytest.mark.parametrize("most", [1, 60, 150])
def test_language_beyond_the_tables_is_that_of_whole_models(spark, most):
    """With room for few n-grams in the workers, the others are joined: entropies are those of models of all."""
    train = spark.createDataFrame(texts_and_labels(), "label string, text string")
    texts = [" ".join(x) for x in product(EN[:2], DE)] + ["", None, "12", "zzz qqq", "中文 the", EN[0] * 40]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {r.doc_id: r for r in language.predict(docs, train).collect()}
    got = {r.doc_id: r for r in language.predict(docs, train, most=most).collect()}
    assert got.keys() == want.keys()
    for i, r in want.items():
        assert got[i].lang_pred == r.lang_pred and math.isclose(got[i].score, r.score, rel_tol=1e-4)
        assert got[i].cross_entropy == r.cross_entropy or math.isclose(got[i].cross_entropy, r.cross_entropy, rel_tol=1e-6)


@pytest.mark.parametrize("most", [40, 150])
def test_perplexity_beyond_the_tables_is_that_of_the_whole_model(spark, most):
    rng = random.Random(5)
    words = " ".join(EN + DE).split()
    rows = [(i, " ".join(rng.choices(words, k=52)), "en" if i % 2 else None, "s", "", "") for i in range(14)] + [(30, "x9 $y " * 20, "en", "s", "", ""), (32, None, None, "s", "", "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    want = {r.doc_id: r for r in quality.quality_rules(docs).collect()}
    got = {r.doc_id: r for r in quality.quality_rules(docs, most=most).collect()}
    assert got.keys() == want.keys()
    for i, r in want.items():
        assert got[i].kept == r.kept and got[i].n_words == r.n_words and math.isclose(got[i].perplexity, r.perplexity, rel_tol=1e-4)
