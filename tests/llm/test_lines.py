import random
import unicodedata

import numpy as np
import pyarrow as pa
import pytest

from foliant.llm import lines
from foliant.llm.common import row_runs

SCHEMA = "doc_id long, text string, lang string, line string, n_removed_lines string"
WORDS = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november oscar papa".split()


def slow_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def slow_form(line):
    """A normal form of its own: what is no letter, mark or digit parts words."""
    return " ".join("".join(c if unicodedata.category(c)[0] in "LMN" else " " for c in line.lower()).split())


PRINTS = {}


def slow_prints(form):
    """Majority bits of hashed runs of eight letters, three times with other hashes."""
    if form not in PRINTS:
        own, base, out = form.ljust(8), 0x9E3779B97F4A7C15, []
        for k in range(3):
            hashes = []
            for i in range(len(own) - 7):
                h = 0
                for c in own[i : i + 8]:
                    h = (h * base + ord(c)) % 2**64
                h = slow_mixed(h)
                hashes.append(h if k == 0 else slow_mixed(h ^ k * base % 2**64))
            out.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
        PRINTS[form] = out
    return PRINTS[form]


def slow_mixed(h):
    h = (h ^ h >> 33) * 0xFF51AFD7ED558CCD % 2**64
    h = (h ^ h >> 33) * 0xC4CEB9FE1A85EC53 % 2**64
    return h ^ h >> 33


def slow_similar(a, b, least=0.8):
    if a == b:
        return True
    both = all(len(x) >= 20 or len(x.split()) >= 5 for x in (a, b))
    longer = max(len(a), len(b))  # edit_distance() is checked by slow_distance() above
    if not both or abs(len(a) - len(b)) >= longer / 4:
        return False
    close = any((x ^ y).bit_count() <= lines.DISTANCE for x, y in zip(slow_prints(a), slow_prints(b)))
    return close and 1 - lines.edit_distance(a, b) / longer >= least - 1e-9


def slow_removed(rows):
    """{(row, line)} that go, for rows (doc_id, text), each a row of its own; equal rows in any order."""
    spots = []
    for row, (doc_id, text) in sorted(enumerate(rows), key=lambda x: (x[1][0] is None, x[1][0] or 0, x[1][1] or "")):
        spots += [(row, k, slow_form(x)) for k, x in enumerate((text or "").split("\n")) if slow_form(x)]
    label = list(range(len(spots)))
    for i in range(len(spots)):
        for j in range(i):
            if label[i] != label[j] and slow_similar(spots[i][2], spots[j][2]):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return {spots[i][:2] for i in range(len(spots)) if label[i] != i}


def slow_texts(rows):
    gone = slow_removed(rows)
    return [(i, t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (row, k) not in gone)) for row, (i, t) in enumerate(rows)]


def kept(spark, rows):
    """What dedup_lines() leaves of rows (doc_id, text)."""
    got = lines.dedup_lines(spark.createDataFrame([(i, t, "en", "x", "y") for i, t in rows], SCHEMA))
    assert got.columns == SCHEMA.replace(",", "").split()[::2]
    return sorted(((r.doc_id, r.text) for r in got.collect()), key=str)


def test_edit_distance():
    rng = random.Random(0)
    for _ in range(300):
        a, b = ("".join(rng.choices("abé ", k=rng.randrange(30))) for _ in "ab")
        assert lines.edit_distance(a, b) == slow_distance(a, b)
    assert lines.similar("", "") and not lines.similar("", "abc") and lines.similar("abcde", "abcdx")


def test_edit_distances_of_many_pairs(monkeypatch):
    rng = random.Random(1)
    pairs = [["".join(rng.choices("abé你 ", k=rng.choice([0, 1, 30, 63, 64, 65, 128, 200]))) for _ in "ab"] for _ in range(120)]
    pairs += [[a, a[:40] + "x" + a[45:]] for a, _ in pairs]
    want = [lines.edit_distance(a, b) for a, b in pairs]
    assert lines.edit_distances([a for a, _ in pairs], [b for _, b in pairs]).tolist() == want
    monkeypatch.setattr(lines, "TABLE", 4096)
    assert lines.edit_distances([a for a, _ in pairs], [b for _, b in pairs]).tolist() == want
    assert lines.edit_distances([], []).tolist() == [] and lines.edit_distances(["", ""], ["", ""]).tolist() == [0, 0]


def test_normal_form():
    for x in ["  Read MORE… ", "a_b-c", "हिन्दी में, लिखा", "ÄÖ ß", "--", "", "x" * 9000 + "!", "2021: 3,5 %", "สวัสดีครับ"]:
        assert lines.normal_form(x) == slow_form(x)


def test_removed_lines_match_brute_force(spark):
    rng = random.Random(3)
    base = [" ".join(rng.choices(WORDS, k=rng.randint(2, 40))) for _ in range(24)]
    pool = base + [x.replace("alpha", "alphas", 1) for x in base] + [x + " end" for x in base] + [x.title() + "." for x in base]
    rows = [(i * 2, "\n".join(rng.choices(pool, k=rng.randint(0, 5)))) for i in range(40)]
    rows += [(1000 + i, base[0] + "\n\n" + base[5]) for i in range(30)] + [(None, base[0]), (None, "only here, in a row without an id"), (2000, None), (2001, "")]
    shuffled = rows[:]
    rng.shuffle(shuffled)
    assert kept(spark, shuffled) == sorted(slow_texts(rows), key=str)


def test_lines_are_equal_only_if_their_texts_are(spark):
    """Digits tell lines apart, whatever their form or hash may be."""
    rows = [(1, "2023 1111 2222 3333 4444"), (2, "1999 8888 7777 6666 5555"), (3, "2023 1111 2222 3333 4445"), (4, "7"), (5, "8"), (6, "7.")]
    assert kept(spark, rows) == [(1, rows[0][1]), (2, rows[1][1]), (3, ""), (4, "7"), (5, "8"), (6, "")]


def test_rows_that_share_an_id_are_rows_of_their_own(spark):
    rows = [(5, "first line that stands twice\nand more of it"), (5, "a line found nowhere else at all\nfirst line that stands twice"), (6, "first line that stands twice")]
    assert kept(spark, rows) == sorted(slow_texts(rows), key=str)
    twice = [(7, "the whole text of this row is here twice")] * 3
    assert kept(spark, twice) == sorted([(7, ""), (7, ""), twice[0]], key=str)


def test_short_lines_go_if_they_are_equal(spark):
    cjk = "这是一个没有空格的很长的句子用来检查重复的行是否会被删除掉"
    rows = [(0, f"Chapter one\n{cjk}\n--"), (1, f"CHAPTER one:\nChapter two\n{cjk[:-1]}\n--")]
    assert kept(spark, rows) == [(0, rows[0][1]), (1, "Chapter two\n--")]


def test_large_groups_are_compared_block_by_block(spark):
    rng = random.Random(5)
    base = "this template stands on a great many pages and was written by user number"
    rows = [(i, f"{base} {''.join(rng.choices('abcdefgh', k=6))}") for i in range(60)] + [(100, "an unrelated line which resembles none of the others here")]
    df = spark.createDataFrame([(i, i, t) for i, t in rows], "id long, digest long, text string")
    gone = {(r.id, k) for r in lines.repeated_lines(df, block=16).collect() for k in r.removed}
    assert gone == {(i, 0) for i in range(1, 60)}


def test_prints_are_majorities_of_hashed_grams():
    forms = ["abc", "a b", "the quick brown fox", "你好世界你好", "x" * 600 + "yz"]
    assert lines.line_prints(forms).tolist() == [slow_prints(f) for f in forms]
    assert lines.line_prints([]).shape == (0, 3)


def test_recall_of_word_edits(spark):
    """Lines of 80 words of which one is replaced: most pairs are found, and no other line goes."""
    rng = random.Random(8)
    word = lambda letters: "".join(rng.choices(letters, k=rng.randint(3, 7)))
    base = [[word("abcdefghijklmnop") for _ in range(80)] for _ in range(200)]
    rows = [(i, " ".join(x)) for i, x in enumerate(base)]
    for i, x in enumerate(base):
        rows.append((1000 + i, " ".join([*x[: i % 80], word("qrstuvwxyz"), *x[i % 80 + 1 :]])))
    found = [i for i, t in kept(spark, rows) if not t]
    assert all(i >= 1000 for i in found) and len(found) >= 0.6 * 200


def test_empty_table(spark):
    assert lines.dedup_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def test_groups_are_linked_by_edit_similarity():
    rng = random.Random(2)
    words = lambda: ["".join(rng.choices("abcdefghé", k=5)) for _ in range(9)]
    texts, base = [], [words() for _ in range(6)]
    for w in base * 4:
        new = w[:]
        new[rng.randrange(9)] = "zzzzz"
        texts.append(" ".join(new))
    edges = np.array([0, 10, 10, 24])
    own = lines.linked_groups(texts, lines.line_prints(texts), np.zeros(24, int), edges, 0.8, lines.DISTANCE)
    for lo, hi in ((0, 10), (10, 24)):
        want = list(range(lo, hi))  # by brute force
        for i in range(lo, hi):
            for j in range(lo, i):
                if slow_similar(texts[i], texts[j]):
                    x, y = want[i - lo], want[j - lo]
                    want = [min(x, y) if z in (x, y) else z for z in want]
        assert own[lo:hi].tolist() == want


@pytest.mark.parametrize("rows", [1, 3, 50])
@pytest.mark.parametrize("most", [-1, 4])
def test_row_runs_hold_whole_runs(rows, most):
    rng = np.random.default_rng(rows)
    key = np.sort(rng.integers(0, 8, 60))
    batches = [pa.RecordBatch.from_arrays([pa.array(key[i : i + n]), pa.array(np.arange(60)[i : i + n])], ["k", "v"]) for i in range(0, 60, 7) for n in [7]]
    got = list(row_runs(iter(batches), ["k"], rows, most=most))
    assert [v for t, _ in got for v in t.column("v").to_pylist()] == list(range(60))
    whole = [t.column("k").to_pylist() for t, is_whole in got if is_whole]
    split = [t.column("k").to_pylist() for t, is_whole in got if not is_whole]
    assert most > 0 or not split
    keys = [k for t in whole for k in dict.fromkeys(t)]
    assert len(keys) == len(set(keys)) and not set(keys) & {k for t in split for k in t} and all(len(set(t)) == 1 for t in split)


def test_lines_are_picked_by_a_map_of_bits(spark):
    """As by a join; the map that is broadcast is a row for 32,768 lines, not one for each line asked for."""
    from pyspark.sql import functions as F

    rows = spark.range(0, 100_000, 1, 3).select((F.col("id") % 3 * (1 << 33) + F.floor(F.col("id") / 3)).alias("node"), F.col("id").alias("n"))
    rng = random.Random(1)
    numbers = [0, 7, 8, 32_767, 32_768, 33_332, (1 << 33) - 1, 1 << 33, (1 << 34) + 33_000] + [rng.randrange(3) * (1 << 33) + rng.randrange(40_000) for _ in range(3000)]
    nodes = spark.createDataFrame([(x,) for x in set(numbers)], "node long")
    want = {tuple(r) for r in rows.join(nodes, "node", "left_semi").collect()}
    for most in (1 << 27, 10):
        found = lines.picked(rows, nodes, 100_000, most)
        assert {tuple(r) for r in found.collect()} == want and len(want) > 2000 and found.columns == ["node", "n"]
    plan = lines.picked(rows, nodes, 100_000)._jdf.queryExecution().executedPlan().toString()
    assert "bitmap_construct_agg" in plan and "BroadcastHashJoin" in plan and not hasattr(lines, "BROADCAST")


def test_texts_are_not_dealt(spark, monkeypatch):
    """Of the staged tables one alone holds the lines' texts; lines are told apart by digests, and only texts that are compared are read again."""
    staged = {}
    monkeypatch.setattr(lines, "stage", lambda df, name, own=lines.stage: staged.setdefault(name, []).append(df.columns) or own(df, name))
    rows = [(i, f"the same sentence stands on all of these pages but number {i % 3}\nanother line number {i}") for i in range(12)]
    assert kept(spark, rows) == sorted(slow_texts(rows), key=str)
    assert [name for name, columns in staged.items() for c in columns if "form" in c] == ["forms"]
