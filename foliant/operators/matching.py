"""Captions and the figures on their page: table cells that are no figures, boxes that make up one, and which is whose.

All of it is expressions over a page's boxes, in order from top to bottom. What depends on earlier choices is a fold
with the choices so far as its state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import let, strip
from foliant.model import BOX
from foliant.operators import figures

#: The signs of a position, the shares of the page that it prefers and shuns, and what either is worth.
TOP, BOTTOM, MIDDLE, LEFT, RIGHT = "上|顶部", "下|底部", "中", "左", "右"
GOOD, BAD, CENTRAL, OFF_CENTRE, SIDE_GOOD = 1.5, -3.0, 0.8, -1.0, 1.0
#: Costs of distance from the aimed height, of each rank off, and of a long box.
HEIGHT_COST, RANK_COST, LONG_COST, LONG = 4.0, 0.1, 0.2, 2.8
#: A box belongs to a zone of cells, or to a figure that is taken, beyond these shares.
ZONE_SHARE, GROW_SHARE, TAKEN_SHARE, LONGEST = 0.6, 0.5, 0.6, 15.0
#: Cells of one height, their smallest side and longest shape, how near they stand in a row and below each other
#: (in heights of the cell that begins the row, or widths of the page), and how many make a row and a zone.
CELL_SIDE, CELL_LONGEST, ROW_HEIGHT, ROW_TOP, ROW_LEFT, LIKE_HEIGHT, ABOVE, BELOW, ROW_CELLS, ZONE_CELLS, PAGE_CELLS = 12, 8, 0.4, 0.6, 0.8, 0.5, 2, 4, 4, 8, 6
#: How near a figure's parts lie to the box that it begins with, in sides of the box or of the page; what a
#: figure reaches around itself, at first and once it has grown, in sides; the least of it, in pixels; and the rounds.
NEAR_BOX, NEAR_PAGE, REACH_BOX, REACH_PAGE, REACH_GROWN, REACH_LEAST, ROUNDS = (1.2, 1.0), (0.35, 0.25), (0.6, 0.3), (0.06, 0.08), (0.2, 0.15), 30.0, 12
#: Fixed value: the share of the page's width left out on each side of a strip.
STRIP_SIDE = 0.08
AIM = "struct<upper:double,lower:double,middle:double,left:double,right:double,strip0:double,strip1:double,down:int,across:int>"


def aims(positions: Column, width: float, height: float) -> Column:
    """array<AIM>: the band of the page that each caption's figure must lie in, and the strip to cut if no box is left."""
    n = F.size(positions)
    down = lambda share: F.floor(F.lit(height) * share).cast("double")

    def aim(p: Column, k: Column) -> Column:
        p = F.coalesce(p, F.lit(""))
        beside, top, bottom, centre_ = p.rlike(f"{LEFT}|{RIGHT}"), p.rlike(TOP), p.rlike(BOTTOM), p.rlike(MIDDLE)
        slack = down(F.lit(0.25))
        upper = F.when(beside | (k == 0), 0.0).otherwise(F.greatest(F.lit(0.0), down(k / n) - slack))
        lower = F.when(beside | (k == n - 1), height).otherwise(F.least(F.lit(height), down((k + 1) / n) + slack))
        middle = F.when(beside, height / 2).otherwise(F.lit(height) * (k + 0.5) / n)
        only = lambda one, other: p.contains(one) & ~p.contains(other)
        return F.struct(
            F.when(~top & centre_, F.greatest(upper, down(F.lit(0.15)))).otherwise(upper).alias("upper"),
            F.when(top, F.least(lower, down(F.lit(0.6)))).when(centre_, F.least(lower, down(F.lit(0.85)))).otherwise(lower).alias("lower"),
            middle.alias("middle"),
            F.when(only(RIGHT, LEFT), float(int(width * 0.47))).otherwise(0.0).alias("left"),
            F.when(only(LEFT, RIGHT), float(int(width * 0.53))).otherwise(float(width)).alias("right"),
            F.when(top, down(F.lit(0.05))).when(bottom, down(F.lit(0.55))).otherwise(F.greatest(F.lit(0.0), F.floor(middle - height * 0.15))).cast("double").alias("strip0"),
            F.least(F.lit(height), F.when(top, down(F.lit(0.45))).when(bottom, down(F.lit(0.95))).otherwise(F.floor(middle + height * 0.15)).cast("double")).alias("strip1"),
            F.when(top, 1).when(bottom, 2).when(centre_, 3).otherwise(0).alias("down"),
            F.when(only(LEFT, RIGHT), 1).when(only(RIGHT, LEFT), 2).otherwise(0).alias("across"),
        ).cast(AIM)

    return F.transform(positions, aim)


def suits(k: Column, aim: Column, b: Column, rank: Column, width: float, height: float) -> Column:
    """How well a box suits a caption: its area, times what its place and its rank on the page leave of it."""
    c, down, across = figures.centre(b), aim["down"], aim["across"]
    x, y = c["x"] / max(width, 1), c["y"] / max(height, 1)
    vertical = (
        F.when(down == 1, F.when(y < 0.45, GOOD).when(y > 0.6, BAD).otherwise(0.0))
        .when(down == 2, F.when(y > 0.55, GOOD).when(y < 0.4, BAD).otherwise(0.0))
        .when(down == 3, F.when((y > 0.25) & (y < 0.75), CENTRAL).otherwise(OFF_CENTRE))
        .otherwise(0.0)
    )
    beside = F.when(across == 1, F.when(x > 0.55, BAD).otherwise(SIDE_GOOD)).when(across == 2, F.when(x < 0.45, BAD).otherwise(SIDE_GOOD)).otherwise(0.0)
    cost = HEIGHT_COST * F.abs(c["y"] - aim["middle"]) / max(height, 1) + RANK_COST * F.abs(k - rank) + F.when(figures.aspect(b, 1.0) > LONG, LONG_COST).otherwise(0.0)
    return (b["x1"] - b["x0"]) * (b["y1"] - b["y0"]) * (1.0 - cost + vertical + beside)


def downwards(boxes: Column) -> Column:
    """Boxes from top to bottom, those of one height from left to right."""
    keyed = F.transform(F.coalesce(boxes, F.array().cast(f"array<{BOX}>")), lambda b, i: F.struct(b["y0"], b["x0"], i, b.alias("b")))
    return F.transform(F.sort_array(keyed), lambda x: x["b"])


def joined(a: Column, b: Column) -> Column:
    return figures.box(F.least(a["x0"], b["x0"]), F.least(a["y0"], b["y0"]), F.greatest(a["x1"], b["x1"]), F.greatest(a["y1"], b["y1"]))


def all_joined(boxes: Column) -> Column:
    """The box around all of an array that isn't empty."""
    return F.aggregate(boxes, F.get(boxes, F.lit(0)).cast(BOX), lambda a, b: joined(a, b).cast(BOX))


# Zones of cells


def table_zones(boxes: Column, width: float) -> Column:
    """array<BOX>: around what looks like the cells of a table. boxes: from top to bottom.

    A row of ROW_CELLS boxes of like height begins a zone. Boxes of like height belong to it from ABOVE heights over the
    row on, and down to the first gap of more than BELOW heights: in order from top to bottom, that is where no next
    one is near enough any more. Cells of one zone begin no other.
    """
    cell = "struct<i:int,w:double,h:double,b:" + BOX + ">"
    kind = f"struct<used:array<int>,zones:array<{BOX}>>"
    cells = F.transform(boxes, lambda b, i: F.struct(i.alias("i"), (b["x1"] - b["x0"]).alias("w"), (b["y1"] - b["y0"]).alias("h"), b.alias("b")).cast(cell))
    numbers = lambda some: F.transform(some, lambda c: c["i"])
    tops = lambda some: F.transform(some, lambda c: c["b"]["y0"])

    def over(every: Column) -> Column:
        def row_of(s: Column, c: Column) -> Column:
            near = lambda o: (F.abs(o["h"] - c["h"]) < c["h"] * ROW_HEIGHT) & (F.abs(o["b"]["y0"] - c["b"]["y0"]) < c["h"] * ROW_TOP) & (F.abs(o["b"]["x0"] - c["b"]["x0"]) < width * ROW_LEFT)
            return F.filter(every, lambda o: (o["i"] == c["i"]) | (near(o) & ~F.array_contains(s["used"], o["i"])))

        def zone_of(row: Column, c: Column) -> Column:
            like = F.filter(every, lambda o: F.abs(o["h"] - c["h"]) < c["h"] * LIKE_HEIGHT)
            end = F.aggregate(tops(like), F.array_max(tops(row)), lambda e, t: F.when((t > e) & (t <= e + c["h"] * BELOW), t).otherwise(e))
            start = F.array_min(tops(row)) - c["h"] * ABOVE
            inside = lambda edges: F.filter(like, lambda o: o["b"]["y0"].between(edges["a"], edges["b"]))
            held = let(F.struct(start.alias("a"), end.alias("b")), inside)
            return F.concat(row, F.filter(held, lambda o: ~F.array_contains(numbers(row), o["i"])))

        def step(s: Column, c: Column) -> Column:
            fit = (c["w"] >= CELL_SIDE) & (c["h"] >= CELL_SIDE) & (F.greatest(c["w"] / F.greatest(c["h"], F.lit(1.0)), c["h"] / F.greatest(c["w"], F.lit(1.0))) <= CELL_LONGEST)
            with_zone = lambda z: F.when(F.size(z) >= ZONE_CELLS, F.struct(F.concat(s["used"], numbers(z)).alias("used"), F.array_append(s["zones"], all_joined(F.transform(z, lambda o: o["b"]))).alias("zones"))).otherwise(s).cast(kind)
            found = let(row_of(s, c), lambda row: F.when(F.size(row) >= ROW_CELLS, let(zone_of(row, c), with_zone)).otherwise(s))
            return F.when(fit & ~F.array_contains(s["used"], c["i"]), found).otherwise(s).cast(kind)

        start = F.struct(F.array().cast("array<int>").alias("used"), F.array().cast(f"array<{BOX}>").alias("zones")).cast(kind)
        return F.aggregate(every, start, step, lambda s: s["zones"])

    return F.when(F.size(boxes) >= PAGE_CELLS, let(cells, over)).otherwise(F.array().cast(f"array<{BOX}>"))


# Figures


def around(b: Column, pads: tuple[Column, Column], aim: Column, width: float, height: float) -> Column:
    """A box grown by the pads, within the page and the caption's band."""
    grown = figures.expanded(b, *pads, F.lit(float(width)), F.lit(float(height)))
    return figures.box(F.greatest(grown["x0"], aim["left"]), F.greatest(grown["y0"], aim["upper"]), F.least(grown["x1"], aim["right"]), F.least(grown["y1"], aim["lower"]))


def meets(a: Column, b: Column) -> Column:
    return (a["x1"] >= b["x0"]) & (a["x0"] <= b["x1"]) & (a["y1"] >= b["y0"]) & (a["y0"] <= b["y1"])


def figure_around(seed: Column, parts: Column, aim: Column, width: float, height: float) -> Column:
    """The box around a seed and all of `parts` that are near its centre, or that the growing whole reaches.

    What a whole reaches, a larger whole reaches too: so the whole alone is what the next round needs to know, and rounds
    end with the first that adds nothing.
    """
    kind = f"struct<whole:{BOX},done:boolean>"
    side = lambda b: (b["x1"] - b["x0"], b["y1"] - b["y0"])
    page = (float(width), float(height))

    def first(s: Column) -> Column:
        w, h = side(s)
        a = figures.centre(s)
        pads = tuple(F.greatest(F.lit(float(int(p * q))), F.floor(z * r).cast("double")) for p, q, z, r in zip(page, REACH_PAGE, (w, h), REACH_BOX, strict=True))

        def near(b: Column) -> Column:
            c = figures.centre(b)
            apart = (F.abs(c["x"] - a["x"]), F.abs(c["y"] - a["y"]))
            bound = tuple(F.greatest(z * r, F.lit(p * q)) for z, r, p, q in zip((w, h), NEAR_BOX, page, NEAR_PAGE, strict=True))
            return (apart[0] < bound[0]) & (apart[1] < bound[1])

        reach = lambda r: F.aggregate(parts, s.cast(BOX), lambda u, b: F.when(near(b) | meets(b, r), joined(u, b)).otherwise(u).cast(BOX))
        return let(around(s, pads, aim, width, height), reach)

    def again(s: Column, _: Column) -> Column:
        w, h = side(s["whole"])
        pads = tuple(F.greatest(F.lit(REACH_LEAST), F.floor(z * r).cast("double")) for z, r in zip((w, h), REACH_GROWN, strict=True))
        reach = lambda r: F.aggregate(parts, s["whole"].cast(BOX), lambda u, b: F.when(meets(b, r), joined(u, b)).otherwise(u).cast(BOX))
        grown = let(around(s["whole"], pads, aim, width, height), reach)
        return F.when(s["done"], s).otherwise(let(grown, lambda g: F.struct(g.alias("whole"), (g == s["whole"]).alias("done")))).cast(kind)

    start = F.struct(let(seed, first).alias("whole"), F.lit(False).alias("done")).cast(kind)
    return F.aggregate(F.sequence(F.lit(2), F.lit(ROUNDS)), start, again, lambda s: s["whole"])


def matched(aim: Column, boxes: Column, zones: Column, width: float, height: float) -> Column:
    """array<struct<k, box>>: captions in order take the best box that is left and its figure, then the others get a strip.

    boxes: from top to bottom. A box that lies in a zone of cells is no figure and no part of one; what lies in a figure
    that is taken isn't left.
    """
    pair = f"array<struct<k:int,box:{BOX}>>"
    kind = f"struct<free:array<int>,found:{pair},bare:{pair}>"
    in_zone = lambda b: F.coalesce(F.array_max(F.transform(zones, lambda z: figures.inside_share(b, z))), F.lit(0.0))
    ready = F.transform(boxes, lambda b: F.struct(b.alias("b"), in_zone(b).alias("share"), figures.aspect(b, 1.0).alias("long"), figures.centre(b).alias("c")))
    margin = float(int(width * STRIP_SIDE))

    def over(every: Column) -> Column:
        def parts(a: Column) -> Column:
            within = lambda o: o["c"]["x"].between(a["left"], a["right"]) & o["c"]["y"].between(a["upper"], a["lower"])
            return F.transform(F.filter(every, lambda o: within(o) & (o["share"] <= GROW_SHARE) & (o["long"] <= LONGEST)), lambda o: o["b"])

        def step(s: Column, k: Column) -> Column:
            def take(a: Column) -> Column:
                best = F.array_max(F.transform(s["free"], lambda i: F.struct(suits(k, a, F.get(every, i)["b"], i, width, height).alias("v"), (-i).alias("back"))))

                def with_seed(i: Column) -> Column:
                    def taken(whole: Column) -> Column:
                        left = F.filter(s["free"], lambda j: (j != i) & (figures.inside_share(F.get(every, j)["b"], whole) <= TAKEN_SHARE))
                        return F.struct(left.alias("free"), F.array_append(s["found"], F.struct(k.cast("int").alias("k"), whole.alias("box"))).alias("found"), s["bare"].alias("bare")).cast(kind)

                    return let(let(parts(a), lambda p: figure_around(F.get(every, i)["b"], p, a, width, height)), taken)

                return let(-best["back"], with_seed)

            strip_ = lambda a: figures.box(F.lit(margin), a["strip0"], F.lit(width - margin), a["strip1"])
            bare = lambda a: F.struct(s["free"].alias("free"), s["found"].alias("found"), F.array_append(s["bare"], F.struct(k.cast("int").alias("k"), strip_(a).alias("box"))).alias("bare")).cast(kind)
            return let(F.get(aim, k), lambda a: F.when(F.size(s["free"]) > 0, take(a)).otherwise(bare(a))).cast(kind)

        free = F.filter(F.transform(every, lambda o, i: F.when(o["share"] <= ZONE_SHARE, i)), lambda i: i.isNotNull())
        start = F.struct(free.alias("free"), F.array().alias("found"), F.array().alias("bare")).cast(kind)
        order = F.when(F.size(aim) > 0, F.sequence(F.lit(0), F.size(aim) - 1)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(order, start, step, lambda s: F.concat(s["found"], s["bare"]))

    return let(ready, over)


def zone_page_boxes(pages: DataFrame, width: float) -> DataFrame:
    """pages (page_id, boxes): (page_id, k, x0, y0, x1, y1) of each page's zones of cells."""
    zones = pages.select("page_id", downwards(F.col("boxes")).alias("boxes")).select("page_id", F.posexplode(table_zones(F.col("boxes"), float(width))).alias("k", "b"))
    return zones.select("page_id", "k", "b.*")


def match_page_captions(pages: DataFrame, width: float, height: float, one_table: bool = False) -> DataFrame:
    """pages (page_id, positions array<string>, boxes): (page_id, k, x0, y0, x1, y1) of each caption's figure.

    A null position says nothing; a page without boxes gets strips; one without captions has no row. one_table: pages hold
    one table, the topmost zone of cells; boxes in further zones are figures.
    """
    ready = pages.select("page_id", F.transform("positions", strip).alias("positions"), downwards(F.col("boxes")).alias("boxes"))
    ready = ready.withColumn("aim", aims(F.col("positions"), float(width), float(height))).withColumn("zones", table_zones(F.col("boxes"), float(width)))
    ready = ready.withColumn("zones", F.slice("zones", 1, 1)) if one_table else ready
    found = ready.select("page_id", F.explode(matched(F.col("aim"), F.col("boxes"), F.col("zones"), float(width), float(height))).alias("p"))
    return found.select("page_id", "p.k", "p.box.*")
