"""Operators on neuron trees: node tables ``tree_id, n, type, x, y, z, r, parent`` (parent -1: root)."""

from __future__ import annotations

import math
from functools import reduce
from itertools import product

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dendrovox.functions.grid import AXES, flip_y
from dendrovox.operators import components as D
from dendrovox.operators import voxels as V
from dendrovox.plans.iterate import MAX_ROUNDS, apart, materialize, release

TREE = ("tree_id",)


def renumber(nodes: DataFrame, keep_type: bool = False) -> DataFrame:
    """Nodes (with ``line``, their order) renumbered 1..N; a parent that is nowhere becomes 1, of equal ids the last counts."""
    number = F.row_number().over(Window.partitionBy(*TREE).orderBy("line"))
    new = nodes.withColumn("_new", number)
    last = new.groupBy(*TREE, F.col("n").alias("parent")).agg(F.max_by("_new", "line").alias("_parent"))
    parent = F.when(F.col("parent") == -1, -1).otherwise(F.coalesce("_parent", F.lit(1))).cast("long")
    kind = F.col("type") if keep_type else F.lit(0)
    return new.join(last, [*TREE, "parent"], "left").select(*TREE, F.col("_new").cast("long").alias("n"), kind.alias("type"), "x", "y", "z", "r", parent.alias("parent"))


def children(nodes: DataFrame) -> DataFrame:
    """``tree_id, n, children`` of every node, children in node order."""
    lists = nodes.where("parent <> -1").groupBy(*TREE, F.col("parent").alias("n")).agg(F.sort_array(F.collect_list("n")).alias("children"))
    return nodes.select(*TREE, "n").join(lists, [*TREE, "n"], "left").withColumn("children", F.coalesce("children", F.array().cast("array<bigint>")))


def _doubled(steps: DataFrame) -> DataFrame:
    """``tree_id, n, up, hops`` of each node's farthest ancestor by pointer doubling, from ``tree_id, n, up`` of the nodes that have a parent."""
    jump = materialize(steps.select(*TREE, "n", "up", F.lit(1).cast("long").alias("hops")), "jumps")
    for _ in range(MAX_ROUNDS):
        ahead = jump.select(*TREE, F.col("n").alias("up"), F.col("up").alias("_up"), F.col("hops").alias("_hops"))
        met = jump.join(apart(ahead), [*TREE, "up"], "left")
        after = materialize(met.select(*TREE, "n", F.coalesce("_up", "up").alias("up"), (F.col("hops") + F.coalesce("_hops", F.lit(0))).alias("hops"), F.col("_up").isNotNull().alias("moved")), "jumps")
        moved = not after.where("moved").isEmpty()
        release(jump)
        jump = after.drop("moved")
        jump._kept_at = after._kept_at
        if not moved:
            return jump
    raise RuntimeError(f"ancestors did not settle in {MAX_ROUNDS} rounds; is there a cycle?")


def _above(steps: DataFrame, start: DataFrame) -> DataFrame:
    """``tree_id, n``: the strict ancestors, by ``steps`` (``tree_id, n, up``), of the nodes of ``start``.

    A mark climbs by doubled jumps: when all ancestors within 2^k are marked, the jumps of 2^k steps mark those up to
    twice as far. A round's rows are the nodes, never pairs of a node and an ancestor.
    """
    jump = materialize(steps.select(*TREE, "n", "up"), "jumps")
    marked = materialize(start.select(*TREE, "n").join(apart(jump), [*TREE, "n"]).select(*TREE, F.col("up").alias("n")).distinct(), "marks")
    for _ in range(MAX_ROUNDS):
        new = marked.join(apart(jump), [*TREE, "n"]).select(*TREE, F.col("up").alias("n")).distinct()
        new = materialize(new.join(apart(marked), [*TREE, "n"], "left_anti"), "marks")
        if new.isEmpty():
            return marked
        marked = materialize(marked.unionByName(new), "marks")
        ahead = jump.select(*TREE, F.col("n").alias("up"), F.col("up").alias("_up"))
        jump = materialize(jump.join(apart(ahead), [*TREE, "up"]).select(*TREE, "n", F.col("_up").alias("up")), "jumps")
    raise RuntimeError(f"ancestors did not settle in {MAX_ROUNDS} rounds; is there a cycle?")


def depth(nodes: DataFrame) -> DataFrame:
    """``tree_id, n, depth``: 0 for every root, else one more than the parent's."""
    far = _doubled(nodes.where("parent <> -1").select(*TREE, "n", F.col("parent").alias("up")))
    return nodes.select(*TREE, "n").join(apart(far), [*TREE, "n"], "left").select(*TREE, "n", F.coalesce("hops", F.lit(0)).cast("long").alias("depth"))


def _voxel(nodes: DataFrame, volumes: DataFrame, flip: str) -> DataFrame:
    """Nodes with the voxel they lie in: truncated, capped at the volume's last voxel, y flipped."""
    dims = volumes.select(F.col("volume_id").alias("tree_id"), "depth", "height", "width")
    at = nodes.join(dims, list(TREE))
    whole = {"z": (F.col("z"), "depth"), "y": (flip_y(F.col("y"), F.col("height"), flip), "height"), "x": (F.col("x"), "width")}
    cut = lambda c: F.when(c >= 0, F.floor(c)).otherwise(F.ceil(c)).cast("int")
    return at.select("*", *[F.least(cut(c), F.col(d) - 1).alias(f"v{a}") for a, (c, d) in whole.items()]).drop("depth", "height", "width")


def nodes_in_mask(nodes: DataFrame, mask: DataFrame, volumes: DataFrame, flip: str = "h") -> DataFrame:
    """Nodes (but n 0 and 1) whose voxel is foreground; a place outside is not."""
    inside = mask.select(F.col("volume_id").alias("tree_id"), *[F.col(a).alias(f"v{a}") for a in AXES])
    at = _voxel(nodes.where("n > 1"), volumes, flip)
    return at.join(apart(inside), [*TREE, "vz", "vy", "vx"], "left_semi").select(*nodes.columns)


def prune_in_soma(nodes: DataFrame, mask: DataFrame, volumes: DataFrame, flip: str = "h", enabled: bool = False) -> DataFrame:
    """Without the unbranched leaf fibres whose leaf lies in the cell body, up to and without their branch point.

    Off by default: the rule it stands for removes nothing.
    """
    if not enabled:
        return nodes
    count = nodes.where("parent <> -1").groupBy(*TREE, F.col("parent").alias("n")).agg(F.count(F.lit(1)).alias("k"))
    known = nodes.join(count, [*TREE, "n"], "left").withColumn("k", F.coalesce("k", F.lit(0)))
    leaves = nodes_in_mask(nodes, mask, volumes, flip).join(known.where("k = 0").select(*TREE, "n"), [*TREE, "n"], "left_semi")
    unary = known.where("k = 1 and parent <> -1").select(*TREE, F.col("n").alias("parent"))
    steps = nodes.join(unary, [*TREE, "parent"], "left_semi").select(*TREE, "n", F.col("parent").alias("up"))
    gone = _above(steps, leaves).union(leaves.where("parent <> -1").select(*TREE, "n")).distinct()
    return nodes.join(apart(gone), [*TREE, "n"], "left_anti")


def connect_to_soma(nodes: DataFrame, soma: DataFrame, volumes: DataFrame, iterations: int = 4, flip: str = "h") -> DataFrame:
    """Trees re-rooted at their grown cell body: nodes with new parents and ``orphan``.

    The mask is dilated; its 6-component that holds the root (y not flipped) counts, without such a one its only
    component, and of several the tree stays as it is. E: the nodes in it. Strict ancestors of E but the root go. Of E, childless nodes go and others
    hang from node 1; so do children of removed E nodes. Other children of removed nodes are kept as orphans.
    """
    grown = V.dilate(soma, volumes, iterations)
    labelled = materialize(D.connected_components(grown, volumes, 6), "labelled")
    roots = _voxel(nodes.where("n = 1"), volumes, "none").select(F.col("tree_id").alias("volume_id"), *[F.col(f"v{a}").alias(a) for a in AXES])
    held = labelled.join(roots, ["volume_id", *AXES], "left_semi").select("volume_id", "component_id").distinct()
    only = labelled.groupBy("volume_id").agg(F.min("component_id").alias("component_id"), F.max("component_id").alias("_last")).where("component_id = _last")
    chosen = held.union(only.select("volume_id", "component_id")).distinct()
    part = labelled.join(chosen, ["volume_id", "component_id"], "left_semi").select("volume_id", *AXES)
    e = materialize(nodes_in_mask(nodes, part, volumes, flip).select(*TREE, "n"), "inside")
    steps = nodes.where("parent <> -1").select(*TREE, "n", F.col("parent").alias("up"))
    above = _above(steps, e).where("n <> 1")
    leaf = nodes.join(steps.select(*TREE, F.col("up").alias("n")), [*TREE, "n"], "left_anti").select(*TREE, "n")
    ends = e.join(apart(leaf), [*TREE, "n"], "left_semi")
    gone = materialize(above.unionByName(ends).distinct(), "gone")
    inside, outside = e.join(apart(gone), [*TREE, "n"], "left_anti"), gone.join(apart(e), [*TREE, "n"], "left_anti")
    gone_inside = gone.join(apart(e), [*TREE, "n"], "left_semi")
    flag = lambda df, name, key="n": apart(df.select(*TREE, F.col("n").alias(key), F.lit(True).alias(name)))
    kept = nodes.join(apart(gone), [*TREE, "n"], "left_anti").join(flag(inside, "_in"), [*TREE, "n"], "left")
    kept = kept.join(flag(gone_inside, "_hang", "parent"), [*TREE, "parent"], "left").join(flag(outside, "_lost", "parent"), [*TREE, "parent"], "left")
    new = F.when(F.coalesce("_in", "_hang"), F.lit(1).cast("long")).otherwise(F.col("parent"))
    orphan = F.coalesce(F.col("_lost"), F.lit(False)) & F.col("_in").isNull()
    return kept.select(*TREE, "n", "type", *("x", "y", "z", "r"), new.alias("parent"), orphan.alias("orphan"))


def to_full_resolution(nodes: DataFrame, dims: DataFrame) -> DataFrame:
    """Coordinates doubled, y flipped, clamped into the full-resolution volume (``tree_id, depth, height, width``); type 247."""
    at = nodes.join(dims.select(*TREE, "depth", "height", "width"), list(TREE))
    put = lambda c, d: F.least(F.greatest(c, F.lit(0.0)), (F.col(d) - 1).cast("double"))
    return at.select(
        *TREE, "n", F.lit(247).alias("type"),
        put(F.col("x") * 2, "width").alias("x"), put(F.col("height") - F.col("y") * 2 - 1, "height").alias("y"), put(F.col("z") * 2, "depth").alias("z"),
        "r", "parent",
    )


def snap_markers(markers: DataFrame, nodes: DataFrame, hit: float = 100, reach: float = 100000) -> DataFrame:
    """The markers (``tree_id, ord, x, y, z``) and, after them, each one's snapped copy (``snapped``).

    A marker snaps to the first root nearer than ``hit`` (squared), else to the nearest node nearer than ``reach``, the
    first of equals, else it stays; snapped coordinates are truncated, those of node 1 before measuring. Nodes are keyed by
    cells of a grid, and a marker looks at its cell and the 26 around it: what it finds no farther away than a cell's side is nearer than all
    else. Markers that find nothing so near look again on a grid twice as coarse, up to the reach.
    """
    axes = ("x", "y", "z")
    cut = lambda c: F.when(c >= 0, F.floor(c)).otherwise(F.ceil(c)).cast("double")
    places = nodes.select(*TREE, "n", "parent", *[F.when(F.col("n") == 1, cut(F.col(a))).otherwise(F.col(a)).alias(f"n{a}") for a in axes])
    around = F.array(*[F.struct(*[F.lit(v).alias(a) for v, a in zip(o, axes, strict=True)]) for o in product((-1, 0, 1), repeat=3)])
    d2 = sum(((F.col(a) - F.col(f"n{a}")) * (F.col(a) - F.col(f"n{a}")) for a in axes), F.lit(0.0))
    root = (d2 < hit) & (F.col("parent") == -1)
    order = F.struct(F.when(root, 0).otherwise(1).alias("a"), F.when(root, F.col("n").cast("double")).otherwise(d2).alias("b"), F.col("n").alias("c"))

    def nearest(todo: DataFrame, side: float) -> DataFrame:
        cells = lambda prefix: [F.floor(F.col(f"{prefix}{a}") / side).alias(f"_{a}") for a in axes]
        asked = todo.select(*TREE, "ord", *axes, *cells("")).withColumn("_o", F.explode(around))
        asked = asked.select(*TREE, "ord", *axes, *[(F.col(f"_{a}") + F.col(f"_o.{a}")).alias(f"_{a}") for a in axes])
        met = asked.join(places.select("*", *cells("n")), [*TREE, *[f"_{a}" for a in axes]]).where(root | (d2 < reach))
        return met.groupBy(*TREE, "ord").agg(F.min(F.struct(order.alias("o"), d2.alias("d2"), *[f"n{a}" for a in axes])).alias("b"))

    side, todo, found = max(16.0, math.sqrt(hit)), markers.select(*TREE, "ord", *axes).distinct(), []
    while True:
        best = materialize(nearest(todo, side), "nearest")
        last = side * side >= reach
        sure = best if last else best.where((F.col("b.o.a") == 0) | (F.col("b.d2") <= side * side))
        found.append(sure)
        todo = materialize(todo.join(sure, [*TREE, "ord"], "left_anti"), "markers")
        if last or todo.isEmpty():
            break
        side *= 2
    best = reduce(DataFrame.unionByName, found)
    moved = markers.join(best, [*TREE, "ord"], "left").select(*TREE, "ord", *[cut(F.coalesce(F.col(f"b.n{a}"), F.col(a))).alias(a) for a in axes], F.lit(True).alias("snapped"))
    return markers.select(*TREE, "ord", "x", "y", "z", F.lit(False).alias("snapped")).unionByName(moved)


def rasterize_tree(nodes: DataFrame, plane: str = "xy", soma_radius: int = 3) -> DataFrame:
    """Pixels of the tree's edges on a plane, one wide, and a disc around node 1: ``tree_id`` and the plane's axes.

    An edge is sampled at every step of its longer side, halves rounded up; ends are truncated. Nodes 0 and 1 and
    edges from a parent of 0 or -1 draw nothing.
    """
    a, b = V.PLANES[plane]
    at = nodes.select(*TREE, "n", "parent", F.floor(a).cast("int").alias("a"), F.floor(b).cast("int").alias("b"))
    up = at.select(*TREE, F.col("n").alias("parent"), F.col("a").alias("pa"), F.col("b").alias("pb"))
    edge = at.where("n > 1 and parent > 0").join(up, [*TREE, "parent"])
    steps = F.greatest(F.abs(F.col("pa") - F.col("a")), F.abs(F.col("pb") - F.col("b")))
    edge = edge.withColumn("_s", steps).withColumn("_t", F.explode(F.sequence(F.lit(0), F.col("_s"))))
    on = lambda p, q: F.when(F.col("_s") == 0, F.col(p)).otherwise(F.floor((2 * F.col(p) * F.col("_s") + 2 * (F.col(q) - F.col(p)) * F.col("_t") + F.col("_s")) / (2 * F.col("_s")))).cast("int")
    lines = edge.select(*TREE, on("a", "pa").alias(a), on("b", "pb").alias(b))
    r = range(-soma_radius, soma_radius + 1)
    disc = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in r for j in r if i * i + j * j <= soma_radius * soma_radius])
    soma = at.where("n = 1").withColumn("_d", F.explode(disc)).select(*TREE, (F.col("a") + F.col("_d.i")).alias(a), (F.col("b") + F.col("_d.j")).alias(b))
    return lines.union(soma).distinct()


def overlay_mip(vox: DataFrame, nodes: DataFrame, plane: str = "xy") -> DataFrame:
    """Projection of the scaled volume with ``on_tree``, for volumes that have a tree."""
    a, b = V.PLANES[plane]
    base = V.mip(V.minmax_uint8(vox), plane).join(nodes.select(F.col("tree_id").alias("volume_id")).distinct(), "volume_id", "left_semi")
    drawn = rasterize_tree(nodes, plane).select(F.col("tree_id").alias("volume_id"), a, b, F.lit(True).alias("on_tree"))
    return base.join(drawn, ["volume_id", a, b], "left").withColumn("on_tree", F.coalesce("on_tree", F.lit(False)))


def tree_ends(nodes: DataFrame) -> DataFrame:
    """``head`` (a root) and ``tail`` (childless) of each node."""
    parents = nodes.where("parent <> -1").select(*TREE, F.col("parent").alias("n"), F.lit(True).alias("_p")).distinct()
    return nodes.join(parents, [*TREE, "n"], "left").select(*TREE, "n", (F.col("parent") == -1).alias("head"), F.col("_p").isNull().alias("tail"))
