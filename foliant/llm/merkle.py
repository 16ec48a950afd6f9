"""A Merkle manifest of a dataset, with a proof for every row.

Rows are leaves; runs of FAN consecutive nodes become one node until a group's subroot is left, and the subroots
make a tree of their own. A node's coordinate is its tree, level and position. The coordinates of the siblings that
a leaf's proof needs follow from the leaf's position and its group's size alone: they are exploded, looked up in the
table of all nodes, put in order, concatenated and folded. The leaves of one run need the same coordinates but for
their own run, so these are exploded once a run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import hot_join, stage, unstage
from foliant.llm.order import looked_up, placed

FAN = 16
#: The tree of the subroots, beside the groups' trees, which are numbered from 0.
TOP = -1
#: Nodes that fewer runs of leaves ask for are not hot.
HOT_NODE = 1000


def field(value: Column) -> Column:
    """A value as a leaf holds it: `-` if null, else its UTF-8 byte count, a colon and itself."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(values: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def levels(base: DataFrame, fan: int) -> list[DataFrame]:
    """Every level's nodes (tree, position, members, digest), from the leaves up; each is a staged table.

    base: the leaves, with members, the number of nodes of the tree at that level.
    """
    found, most = [base], base.agg(F.max("members")).first()[0] or 0
    while most > 1:
        run = F.expr(f"position div {fan}")
        above = found[-1].where("members > 1").groupBy("tree", run.alias("position"))
        above = above.agg(F.expr(f"(max(members) + {fan - 1}) div {fan}").alias("members"), F.sort_array(F.collect_list(F.struct("position", "digest"))).alias("run"))
        digest = F.sha2(F.array_join(F.transform("run", lambda x: x["digest"]), ""), 256)
        found.append(stage(above.select("tree", "position", "members", digest.alias("digest")), "nodes"))
        most = -(-most // fan)
    return found


def manifest(rows: DataFrame, columns: list[str], group: str, order: str, fan: int = FAN, altered: dict[str, Column] | None = None) -> dict[str, DataFrame]:
    """The staged tables of a manifest: leaves, nodes and the root.

    rows: any table; columns: what a leaf is made of, in order; group: the column whose values have subroots, null first,
    then in UTF-8 order; order: the column in which a group's leaves ascend, null first, equal ones by their
    digests. altered: for each column, what it reads now; the leaf recomputed from these stands beside the original.

    leaves: order, group_key, leaf, now, position, members, tree, groups; nodes: tree, level, position, members,
    digest; root: digest (no row for an empty table). Repeated rows are leaves of their own.
    """
    now = [(altered or {}).get(c, F.col(f"`{c}`")) for c in columns]
    key = F.when(F.col(group).isNull(), "").otherwise(F.concat(F.lit("="), F.col(group).cast("string")))
    # Equal leaves of one order value differ at most in what they read now, which settles their order.
    narrow = rows.select(F.col(order).alias("__order"), key.alias("group_key"), leaf([F.col(f"`{c}`") for c in columns]).alias("leaf"), leaf(now).alias("now"))
    narrow = stage(narrow, "leaves")
    own = stage(placed(narrow, ["__order", "leaf", "now"], "group_key"), "leaves")
    groups = stage(own.groupBy("group_key").agg(F.max("members").alias("size")), "groups")
    total = own.count()
    numbers = placed(groups, ["group_key"]).select("group_key", "size", F.col("position").alias("tree"), F.col("members").alias("groups"))
    numbers = stage(numbers, "groups")
    leaves = stage(looked_up(own, numbers, "group_key", "size", total).drop("size"), "leaves")
    unstage(narrow, own, groups)
    below = levels(leaves.select("tree", "position", "members", F.col("leaf").alias("digest")), fan)
    subroots = [x.where("members = 1").select("tree", "digest") for x in below]
    for x in subroots[1:]:
        subroots[0] = subroots[0].unionByName(x)
    number = F.lit(numbers.count()).cast("long").alias("members")
    base = stage(subroots[0].select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("position"), number, "digest"), "subroots")
    top = levels(base, fan)
    nodes = [x.withColumn("level", F.lit(level)) for side in (below, top) for level, x in enumerate(side)]
    for x in nodes[1:]:
        nodes[0] = nodes[0].unionByName(x)
    root = top[-1].where("members = 1").select("digest")
    return {"leaves": leaves, "nodes": nodes[0], "root": root, "below": len(below), "above": len(top)}


def coordinates(below: int, above: int, fan: int) -> Column:
    """An array of (step, tree, level, own, first, last): the runs that a run of leaves meets on its way to the root.

    below, above: levels of the deepest group's tree and of the tree of subroots. The run itself is left out. A level
    with a single node takes no step.
    """

    def run(step: int, tree: Column, level: int, own: str, most: str) -> Column:
        first = f"({own} div {fan}) * {fan}"
        fields = [F.lit(step), tree, F.lit(level), F.expr(own), F.expr(first), F.expr(f"least({first} + {fan - 1}, {most} - 1)")]
        named = F.struct(*(c.alias(n) for c, n in zip(fields, ("step", "tree", "level", "own", "first", "last"), strict=True)))
        return F.when(F.expr(f"{most} > 1"), named)

    ups = lambda count, level: f"(({count} + {fan**level - 1}) div {fan**level})"
    inner = [run(x, F.col("tree"), x, f"(run div {fan ** (x - 1)})", ups("members", x)) for x in range(1, below)]
    outer = [run(below + x, F.lit(TOP).cast("long"), x, f"(tree div {fan**x})", ups("groups", x)) for x in range(above)]
    return F.filter(F.array(*inner, *outer), lambda x: x.isNotNull())


def joined(parts: Column) -> Column:
    return F.array_join(parts, "")


def way(step: int) -> Column:
    """What stands left and right of the own node at a step, from the coordinates met; null if the step isn't taken."""

    def side(k: int) -> Column:
        there = F.filter("met", lambda x: (x["step"] == step) & (x["side"] == k))
        return joined(F.transform(there, lambda x: x["digest"]))

    return F.when(F.exists("met", lambda x: x["step"] == step), F.struct(side(-1).alias("left"), side(1).alias("right")))


def proofs(found: dict[str, DataFrame], fan: int = FAN) -> DataFrame:
    """(order value, leaf, subroot, root, proof, folded_root) for each leaf of a manifest.

    proof: the array of (left, right): at each step to the root, the sibling digests before and after the own node,
    concatenated. folded_root: what the leaf as it reads now comes to with these.
    """
    leaves, nodes = found["leaves"], found["nodes"]
    own = F.struct("position", "__order", "leaf", "now")
    runs = leaves.groupBy("tree", F.expr(f"position div {fan}").alias("run"))
    runs = stage(runs.agg(F.max("members").alias("members"), F.max("groups").alias("groups"), F.sort_array(F.collect_list(own)).alias("own")), "runs")
    asked = runs.select("tree", "run", F.explode(coordinates(found["below"], found["above"], fan)).alias("c"))
    asked = asked.select("tree", "run", "c", F.explode(F.expr("sequence(c.first, c.last)")).alias("at"))
    side = F.expr("CAST(sign(at - c.own) AS int)")
    asked = stage(asked.select("tree", "run", F.col("c.step").alias("step"), F.struct(F.col("c.tree").alias("tree"), F.col("c.level").alias("level"), F.col("at").alias("position")).alias("coordinate"), side.alias("side")), "asked")
    wanted = stage(asked.groupBy("coordinate").agg(F.count("*").alias("size")), "wanted")
    total = wanted.agg(F.sum("size")).first()[0] or 0
    inner = nodes.where((F.col("level") > 0) | (F.col("tree") == TOP))  # a run has its own leaves
    table = inner.select(F.struct("tree", "level", "position").alias("coordinate"), "digest").join(wanted, "coordinate")
    met = hot_join(asked, table, "coordinate", "size", total, least=HOT_NODE)
    met = met.groupBy("tree", "run").agg(F.sort_array(F.collect_list(F.struct("step", F.col("coordinate.position").alias("position"), "side", "digest"))).alias("met"))
    steps = [way(step) for step in range(1, found["below"] + found["above"])]
    subroot = F.filter("met", lambda x: (x["step"] == found["below"]) & (x["side"] == 0))
    none = F.array().cast("array<struct<left: string, right: string>>")
    met = met.select("tree", "run", F.filter(F.array(*steps), lambda x: x.isNotNull()).alias("above"), F.get(F.transform(subroot, lambda x: x["digest"]), 0).alias("subroot"))
    whole = F.lit((found["root"].first() or [None])[0]).cast("string")
    each = runs.join(met, ["tree", "run"], "left").select("members", "own", F.posexplode("own").alias("i", "leaf"), "subroot", F.coalesce("above", none).alias("above"))
    left = joined(F.transform(F.expr("slice(own, 1, i)"), lambda x: x["leaf"]))
    right = joined(F.transform(F.expr(f"slice(own, i + 2, {fan})"), lambda x: x["leaf"]))
    first = F.when(F.col("members") > 1, F.array(F.struct(left.alias("left"), right.alias("right")))).otherwise(none)
    each = each.select(F.col("leaf.__order").alias("__order"), F.col("leaf.leaf").alias("leaf"), F.col("leaf.now").alias("now"), F.coalesce("subroot", whole).alias("subroot"), whole.alias("root"), F.concat(first, "above").alias("proof"))
    return each.withColumn("folded_root", F.aggregate("proof", F.col("now"), lambda d, s: F.sha2(F.concat(s["left"], d, s["right"]), 256)))


def verified(rows: DataFrame, columns: list[str], group: str, order: str, fan: int = FAN, altered: dict[str, Column] | None = None) -> DataFrame:
    """(order, leaf, subroot, root, proof_sha256, folded_root, verified) for every row; see `manifest` for the arguments.

    A null in any column is a `-` of the leaf, and a null group is a group; an empty table has no rows; repeated
    rows have a proof each; columns of other names play no part.
    """
    each = proofs(manifest(rows, columns, group, order, fan, altered), fan)
    whole = joined(F.transform("proof", lambda x: F.concat(x["left"], x["right"])))
    return each.select(F.col("__order").alias(order), "leaf", "subroot", "root", F.sha2(whole, 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
