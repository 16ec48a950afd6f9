import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.operators import regions
from foliant.operators.crops import spread

IMAGE = "page_id long, height int, width int, nChannels int, data binary"


def pages(spark, arrays, ids=None):
    rows = [(i, None, None, None, None) if a is None else (i, *a.shape[:2], 1, a.tobytes()) for i, a in zip(ids or range(len(arrays)), arrays)]
    return spark.createDataFrame(rows, IMAGE).select("page_id", F.struct("height", "width", "nChannels", "data").alias("image"))


def slow_boxes(ink):
    """Boxes around what hangs together, corners included, a pixel at a time."""
    ink, out = ink.copy(), []
    for y, x in zip(*np.nonzero(ink)):
        if not ink[y, x]:
            continue
        todo, ys, xs = [(y, x)], [], []
        ink[y, x] = False
        while todo:
            a, b = todo.pop()
            ys.append(a)
            xs.append(b)
            for c in range(max(0, a - 1), min(ink.shape[0], a + 2)):
                for d in range(max(0, b - 1), min(ink.shape[1], b + 2)):
                    if ink[c, d]:
                        ink[c, d] = False
                        todo.append((c, d))
        out.append((min(xs), min(ys), max(xs) + 1, max(ys) + 1))
    return sorted(out)


def boxes_of(spark, arrays):
    """ink_boxes() of each bitmap, taken as ink as it is."""
    sized = pages(spark, [np.where(a, 0, 255).astype(np.uint8) for a in arrays]).withColumns({"y0": F.lit(0), "y1": F.col("image.height")})
    found = regions.ink_boxes(regions.ink_slabs(sized, lambda page: page < 128)).collect()
    return [sorted((int(r.x0), int(r.y0), int(r.x1), int(r.y1)) for r in found if r.page_id == i) for i in range(len(arrays))]


def test_boxes_of_random_bitmaps(spark, monkeypatch):
    rng = np.random.default_rng(4)
    arrays = [rng.random((rng.integers(1, 40), rng.integers(1, 150))) < share for share in (0.05, 0.2, 0.35, 0.5, 0.8, 1.0, 0.0) for _ in range(4)]
    spiral = np.zeros((41, 41), dtype=bool)
    for k in range(0, 20, 2):
        spiral[k, k : 41 - k] = spiral[40 - k, k : 41 - k] = spiral[k : 41 - k, 40 - k] = True
        spiral[k + 2 : 41 - k, k] = True
        spiral[k + 2, k : k + 3] = True
    arrays.append(spiral)
    want = [slow_boxes(a) for a in arrays]
    assert boxes_of(spark, arrays) == want
    monkeypatch.setattr(regions, "LINKS", 7)
    monkeypatch.setattr(regions, "TILE", 5)
    assert boxes_of(spark, arrays) == want


def test_smallest_reachable():
    rng = np.random.default_rng(1)
    for n, m in ((1, 0), (50, 30), (300, 290), (300, 900)):
        a, b = rng.integers(0, n, (2, m))
        want = list(range(n))
        for _ in range(n):
            for x, y in zip(a.tolist(), b.tolist()):
                want[x] = want[y] = min(want[x], want[y])
        assert regions.reachable(n, a, b).tolist() == want
    path = np.arange(9999)
    assert not regions.reachable(10000, path, path + 1).any()


def test_a_large_page_in_bounded_memory(spark):
    """Ten million pixels with forty blocks of stripes."""
    page = np.full((2500, 4000), 255, dtype=np.uint8)
    for y in range(5):
        for x in range(8):
            page[y * 500 + 20 : y * 500 + 400, x * 500 + 20 : x * 500 + 400] = np.indices((380, 380)).sum(axis=0) % 17 * 15
    got = regions.page_boxes(pages(spark, [page]), most=100).collect()
    assert len(got) == 40 and all(380 < r.x1 - r.x0 < 430 and 380 < r.y1 - r.y0 < 430 for r in got)


def slow_regions(page):
    side, (h, w) = min(page.shape), page.shape
    a, b = max(3, int(side * 0.008)), max(3, int(side * 0.015))
    ink = spread(~spread(~spread(page < 245, a, a), a, a), b, b)
    found = [x for x in slow_boxes(ink) if (x[2] - x[0]) * (x[3] - x[1]) / (h * w) >= 0.015 and x[2] - x[0] >= 40 and x[3] - x[1] >= 40]
    gap, again = max(w, h) * 0.01, True
    while again:
        again = False
        for i, p in enumerate(found):
            for j, q in enumerate(found[:i]):
                if p[0] <= q[2] + gap and q[0] <= p[2] + gap and p[1] <= q[3] + gap and q[1] <= p[3] + gap:
                    found = [x for k, x in enumerate(found) if k not in (i, j)] + [(min(p[0], q[0]), min(p[1], q[1]), max(p[2], q[2]), max(p[3], q[3]))]
                    again = True
                    break
            if again:
                break
    return sorted(found, key=lambda b: (-(b[2] - b[0]) * (b[3] - b[1]), b[1], b[0]))[:8]


def slow_figure(page, y0, y1):
    y0 = max(0, min(y0, page.shape[0] - 1))
    band = page[y0 : max(y0 + 1, min(y1, page.shape[0]))]
    if min(band.shape) < 30:
        return None
    band = band[: max(int(band.shape[0] * 0.55), int(band.shape[0] * (1.0 - 0.22)))]
    kx, ky = max(3, int(band.shape[1] * 0.01)), max(3, int(band.shape[0] * 0.01))
    best = []
    for a, b, c, d in slow_boxes(~spread(~spread(band < 245, kx, ky), kx, ky)):
        w, h = c - a, d - b
        if w * h / band.size >= 0.08 and min(w, h) >= 40 and max(w / h, h / w) <= 12:
            best.append((-(w * h + h * 200 - b * 50 + min(w, band.shape[1] * 0.9) * 20), b + y0, a, (a, b + y0, c, d + y0)))
    return min(best)[3] if best else None


def sketch(rng, h, w):
    page = np.full((h, w), 255, dtype=np.uint8)
    for _ in range(rng.integers(0, 9)):
        y, x = rng.integers(0, h), rng.integers(0, w)
        page[y : y + rng.integers(1, h), x : x + rng.integers(1, w // 2)] = rng.integers(0, 250)
    for _ in range(rng.integers(0, 5)):  # holes and specks
        y, x = rng.integers(0, h), rng.integers(0, w)
        page[y : y + rng.integers(1, 30), x : x + rng.integers(1, 30)] = 255
    return page


def test_regions_and_figures_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    arrays = [sketch(rng, int(rng.integers(90, 260)), int(rng.integers(120, 400))) for _ in range(60)]
    images = pages(spark, [*arrays, None])
    got = {}
    for r in regions.page_boxes(images).orderBy("page_id", "k").collect():
        got.setdefault(r.page_id, []).append((r.x0, r.y0, r.x1, r.y1))
    want = [slow_regions(a) for a in arrays]
    assert [got.get(i, []) for i in range(61)] == [*want, []]
    assert sum(map(len, want)) > 20 and max(map(len, want)) > 1
    spans = [(int(rng.integers(-20, 60)), int(rng.integers(0, 260))) for _ in arrays]
    y = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate([*spans, (0, 9)])], "page_id long, y0 int, y1 int")
    figures = {r.page_id: (r.x0, r.y0, r.x1, r.y1) for r in regions.main_figures(images.join(y, "page_id")).collect()}
    wanted = [slow_figure(a, *s) for a, s in zip(arrays, spans)]
    assert [figures.get(i) for i in range(61)] == [*wanted, None]
    assert sum(f is not None for f in wanted) > 10


def test_empty_tables(spark):
    none = pages(spark, [np.zeros((5, 5), dtype=np.uint8)]).limit(0)
    assert regions.page_boxes(none).count() == 0
    assert regions.main_figures(none.withColumns({"y0": F.lit(0), "y1": F.lit(9)})).count() == 0


# Bands


def slow_bands(density, captions):
    h = len(density)
    top, bottom = int(h * 0.04), h - int(h * 0.04)
    inside = np.array(density[top:bottom])
    rows = [y + top for y, v in enumerate(inside) if v <= max(0.002, np.percentile(inside, 20))]
    spans = []
    for y in rows:
        if spans and y - spans[-1][1] <= 6:
            spans[-1][1] = y
        else:
            spans.append([y, y])
    middles = [(a + b) // 2 for a, b in spans if b - a >= 8]
    if captions <= 1 or not middles:
        return [(top, bottom)]
    if len(middles) > captions - 1:
        middles = [middles[i] for i in np.linspace(0, len(middles) - 1, captions - 1).round().astype(int)]
    edges = [top]
    for m in sorted(set(middles)):
        if m - edges[-1] > 40:
            edges.append(m)
    if bottom - edges[-1] > 40:
        edges.append(bottom)
    return list(zip(edges, edges[1:])) or [(top, bottom)]


@pytest.mark.parametrize("seed", range(3))
def test_bands_equal_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    profiles = []
    for _ in range(60):
        parts = [rng.random(rng.integers(5, 90)) * (0.001 if k % 2 else 0.3) for k in range(rng.integers(1, 14))]
        profiles.append((np.concatenate(parts).tolist(), int(rng.integers(0, 8))))
    profiles += [([0.0] * 200, 3), ([0.5] * 200, 3), ([0.1], 2), ([0.0] * 30, None), ([], 2), (None, 2)]
    df = spark.createDataFrame([(i, d, c) for i, (d, c) in enumerate(profiles)], "i int, d array<double>, c int")
    got = [[tuple(b) for b in r.b] for r in df.select("i", regions.figure_bands(F.col("d"), F.col("c")).alias("b")).orderBy("i").collect()]
    assert got == [slow_bands(d, c or 0) if d else [] for d, c in profiles]
    assert max(map(len, got)) > 3
