import math
import random

import pytest

from foliant.model import BOX
from foliant.operators import matching

W, H = 1000.0, 800.0


def hull(boxes):
    return (min(b[0] for b in boxes), min(b[1] for b in boxes), max(b[2] for b in boxes), max(b[3] for b in boxes))


def share(a, b):
    inside = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
    return inside / max((a[2] - a[0]) * (a[3] - a[1]), 1)


def long(b):
    return max((b[2] - b[0]) / max(b[3] - b[1], 1), (b[3] - b[1]) / max(b[2] - b[0], 1))


def slow_zones(boxes):
    """For each first cell the closure of its row under reach, as sets; boxes from top to bottom."""
    size = [(b[2] - b[0], b[3] - b[1]) for b in boxes]
    taken, zones = set(), []
    for first, (w, h) in enumerate(size if len(boxes) >= 6 else []):
        alike = lambda part: {j for j, (_, g) in enumerate(size) if abs(g - h) < h * part}  # noqa: E731, B023
        x, y = boxes[first][:2]
        row = {j for j in alike(0.4) - taken if abs(boxes[j][1] - y) < h * 0.6 and abs(boxes[j][0] - x) < W * 0.8} | {first}
        if first in taken or min(w, h) < 12 or long(boxes[first]) > 8 or len(row) < 4:
            continue
        edge, before = max(boxes[j][1] for j in row), None
        start = min(boxes[j][1] for j in row) - 2 * h
        while edge != before:
            before, edge = edge, max([edge, *(boxes[j][1] for j in alike(0.5) if boxes[j][1] <= edge + 4 * h)])
        cells = row | {j for j in alike(0.5) if start <= boxes[j][1] <= edge}
        if len(cells) >= 8:
            zones.append(hull([boxes[j] for j in cells]))
            taken |= cells
    return zones


def band(p, k, n):
    """(upper, lower, middle, left, right, strip0, strip1) of caption k of n."""
    if "左" in p or "右" in p:
        upper, lower, middle = 0, H, H / 2
    else:
        upper = max(0, math.floor(H * (k / n)) - 200) if k else 0
        lower = min(H, math.floor(H * ((k + 1) / n)) + 200) if k < n - 1 else H
        middle = H * (k + 0.5) / n
    strip = max(0, math.floor(middle - H * 0.15)), min(H, math.floor(middle + H * 0.15))
    if "上" in p or "顶部" in p:
        lower, strip = min(lower, 480), (40, 360)
    elif "下" in p or "底部" in p:
        strip = 440, 760
    if not ("上" in p or "顶部" in p) and "中" in p:
        upper, lower = max(upper, 120), min(lower, 680)
    only = ("左" in p) - ("右" in p)
    return upper, lower, middle, 470 if only < 0 else 0, 530 if only > 0 else W, *strip


def worth(b, p, k, i, middle):
    size, x, y = (b[2] - b[0]) * (b[3] - b[1]), (b[0] + b[2]) / 2 / W, (b[1] + b[3]) / 2 / H
    if "上" in p or "顶部" in p:
        place = 1.5 if y < 0.45 else -3 if y > 0.6 else 0
    elif "下" in p or "底部" in p:
        place = 1.5 if y > 0.55 else -3 if y < 0.4 else 0
    else:
        place = (0.8 if 0.25 < y < 0.75 else -1) if "中" in p else 0
    only = ("左" in p) - ("右" in p)
    beside = 0 if not only else (-3 if x > 0.55 else 1) if only > 0 else (-3 if x < 0.45 else 1)
    return size * (1 - (4 * abs(y * H - middle) / H + 0.1 * abs(k - i) + (0.2 if long(b) > 2.8 else 0)) + place + beside)


def slow_match(positions, boxes):
    boxes = sorted(boxes, key=lambda b: (b[1], b[0]))
    zones = slow_zones(boxes)
    in_zone = [max((share(b, z) for z in zones), default=0) for b in boxes]
    free, found, bare = {i for i, s in enumerate(in_zone) if s <= 0.6}, [], []
    for k, p in enumerate((p or "").strip() for p in positions):
        upper, lower, middle, left, right, s0, s1 = band(p, k, len(positions))
        if not free:
            bare.append((k, 80.0, s0, 920.0, s1))
            continue
        seed = max(free, key=lambda i: (round(worth(boxes[i], p, k, i, middle), 6), -i))
        s = boxes[seed]
        mid = lambda b: ((b[0] + b[2]) / 2, (b[1] + b[3]) / 2)
        parts = [b for b, z in zip(boxes, in_zone) if left <= mid(b)[0] <= right and upper <= mid(b)[1] <= lower and z <= 0.5 and long(b) <= 15]
        whole, dx, dy = s, max(60, math.floor((s[2] - s[0]) * 0.6)), max(64, math.floor((s[3] - s[1]) * 0.3))
        group = [s]
        for _ in range(12):
            lo = max(whole[0] - dx, 0, left), max(whole[1] - dy, 0, upper)
            hi = min(whole[2] + dx, W, right), min(whole[3] + dy, H, lower)
            near = lambda b: abs(mid(b)[0] - mid(s)[0]) < max((s[2] - s[0]) * 1.2, 350) and abs(mid(b)[1] - mid(s)[1]) < max(s[3] - s[1], 200)
            group = [s] + [b for b in parts if b in group or near(b) or (b[2] >= lo[0] and b[0] <= hi[0] and b[3] >= lo[1] and b[1] <= hi[1])]
            whole = hull(group)
            dx, dy = max(30, math.floor((whole[2] - whole[0]) * 0.2)), max(30, math.floor((whole[3] - whole[1]) * 0.15))
        free = {i for i in free if i != seed and share(boxes[i], whole) <= 0.6}
        found.append((k, *whole))
    return found + bare


def random_page(rng):
    boxes = []
    for _ in range(rng.randint(0, 6)):
        x, y = rng.randint(0, 900), rng.randint(0, 700)
        boxes.append((x, y, x + rng.randint(1, 400), y + rng.randint(1, 300)))
    for _ in range(rng.choice([0, 0, 1, 2])):  # a grid of cells, some out of line
        x, y, w, h = rng.randint(0, 500), rng.randint(0, 600), rng.randint(8, 60), rng.randint(8, 30)
        rows = [(x + c * (w + 5), y + r * rng.choice([h + 4, h * 2, h * 5]) + rng.randint(0, 4)) for r in range(rng.randint(1, 4)) for c in range(rng.randint(2, 5))]
        boxes += [(a, b, a + w, b + h + rng.randint(0, 3)) for a, b in rows]
    rng.shuffle(boxes)
    return list(dict.fromkeys(tuple(map(float, b)) for b in boxes))


def test_zones_equal_closures_of_rows(spark):
    rng = random.Random(2)
    pages = [random_page(rng) for _ in range(250)] + [[]]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)] + [(999, None)], f"page_id long, boxes array<{BOX}>")
    got = {}
    for r in matching.zone_page_boxes(df, W).orderBy("page_id", "k").collect():
        got.setdefault(r.page_id, []).append((r.x0, r.y0, r.x1, r.y1))
    want = {i: z for i, z in ((i, slow_zones(sorted(p, key=lambda b: (b[1], b[0])))) for i, p in enumerate(pages)) if z}
    assert got == want and len(want) > 30
    assert max(map(len, want.values())) > 1
    grid = [(x * 50.0, y * 30.0, x * 50 + 40.0, y * 30 + 24.0) for y in range(3) for x in range(4)]
    few = spark.createDataFrame([(1, grid), (2, grid[:5])], f"page_id long, boxes array<{BOX}>")
    assert [tuple(r) for r in matching.zone_page_boxes(few, W).collect()] == [(1, 0, 0.0, 0.0, 190.0, 84.0)]


@pytest.mark.parametrize("seed", range(2))
def test_matching_equals_a_choice_at_a_time(spark, seed):
    rng = random.Random(seed)
    names = [None, "", "左上", "右下", " 中 ", "上", "底部", "左右", "elsewhere", "左", "右", "顶部中间"]
    pages = [([rng.choice(names) for _ in range(rng.randint(0, 4))], random_page(rng)) for _ in range(250)]
    df = spark.createDataFrame([(i, p, b) for i, (p, b) in enumerate(pages)] + [(999, ["上"], None)], f"page_id long, positions array<string>, boxes array<{BOX}>")
    got = {}
    for r in matching.match_page_captions(df, W, H).collect():
        got.setdefault(r.page_id, []).append(tuple(r[1:]))
    for i, (positions, boxes) in enumerate(pages):
        assert sorted(got.get(i, [])) == sorted(tuple(map(float, x)) for x in slow_match(positions, boxes)), (positions, boxes)
    assert got[999] == [(0, 80.0, 40.0, 920.0, 360.0)]


def test_empty_table(spark):
    none = spark.createDataFrame([], f"page_id long, positions array<string>, boxes array<{BOX}>")
    assert matching.match_page_captions(none, W, H).count() == 0 and matching.zone_page_boxes(none, W).count() == 0
