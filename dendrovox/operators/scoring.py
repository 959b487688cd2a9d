"""Scores of predictions against ground truth: path connectivity and block-wise topology."""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dendrovox.functions.grid import AXES, KEYS, ddl, neighbours
from dendrovox.operators import components as D
from dendrovox.operators import geodesic as G
from dendrovox.operators import voxels as V
from dendrovox.plans.iterate import materialize

BLOCK = ("bz", "by", "bx")


def path_masks(paths: DataFrame, seg: DataFrame, threshold: float = 0.5, value: str = "seg", keys=KEYS) -> DataFrame:
    """Path points with ``seg`` (0 where it has no row) and ``from_break``: at or behind the first break, seen from the source."""
    at = paths.join(seg.select(*keys, *AXES, F.col(value).alias("seg")), [*keys, *AXES], "left").withColumn("seg", F.coalesce("seg", F.lit(0)))
    walk = Window.partitionBy(*keys, "path_id").orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)
    return at.withColumn("from_break", F.max(F.when(F.col("seg") < threshold, 1).otherwise(0)).over(walk))


def path_loss(
    pairs: DataFrame,
    predecessors: DataFrame | None,
    somas: DataFrame,
    volumes: DataFrame,
    num_paths: int = 10,
    threshold: float = 0.5,
    smooth: float = 1e-6,
    max_density: float = 0.05,
    seed: int = 0,
    keys=KEYS,
) -> DataFrame:
    """``keys, loss`` of each volume of ``volumes``.

    ``pairs`` has ``gt`` (0 or 1), ``pred`` and ``seg`` for each stored voxel. Starts are drawn from the ground truth outside
    the thrice dilated component of the segmentation at the soma. 0 where there is no soma or one at the origin, no
    predecessor, or a segmentation denser (by its sum) than ``max_density``.
    """
    gt = pairs.where("gt = 1").select(*keys, *AXES)
    held = volumes.join(pairs.groupBy(*keys).agg(F.sum("seg").alias("_held")), list(keys), "left")
    fit = held.where(F.coalesce("_held", F.lit(0.0)) <= F.lit(max_density) * F.col("depth") * F.col("height") * F.col("width")).select(*keys)
    fit = fit.join(somas.where("z + y + x <> 0").select(*keys).distinct(), list(keys), "left_semi")
    zero = volumes.select(*keys, F.lit(0.0).alias("loss"))
    if predecessors is None:
        return zero
    fit = materialize(fit.join(predecessors.where("pred_code <> -1").select(*keys).distinct(), list(keys), "left_semi"), "fit")
    cut = lambda df: df.join(fit, list(keys), "left_semi")
    seg = cut(pairs).where(F.col("seg") >= threshold).select(*keys, *AXES)
    found = D.component_of(seg, cut(somas), volumes, 26, keys)
    missed = V.mask_sub(cut(gt), V.dilate(found, volumes, 3, keys), keys)
    starts = G.sample_points(missed, num_paths, seed, keys)
    paths = G.trace_paths(predecessors, starts, keys=keys)
    walked = path_masks(paths, pairs, threshold, keys=keys)
    walked = walked.join(pairs.select(*keys, *AXES, "pred"), [*keys, *AXES], "left").withColumn("pred", F.coalesce("pred", F.lit(0.0)))
    each = walked.groupBy(*keys, "path_id").agg(
        F.sum(F.greatest(F.lit(threshold) - F.col("pred"), F.lit(0.0))).alias("below"),
        F.sum((1 - F.col("pred")) * F.col("from_break")).alias("behind"),
        F.count(F.lit(1)).alias("n"),
    )
    part = (F.col("below") + smooth) * (F.col("behind") + smooth) / (F.lit(0.5) * F.col("n") * F.col("n"))
    loss = each.groupBy(*keys).agg(F.sum(part).alias("_loss"))
    return zero.join(loss, list(keys), "left").select(*keys, F.coalesce("_loss", "loss").alias("loss"))


#: Half of the offsets to the 26 neighbours.
HALF = [o for o in neighbours(26) if o > (0, 0, 0)]


def _barcode(place: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(birth, death) of the zero-dimensional intervals of one block's voxels under 26-connectivity, by the elder rule; an endless one dies at 1.

    Voxels are ranked by value and place. Each hangs from its lowest neighbour, so basins of local minima come out of
    pointer jumping over arrays; a pair of basins joins where its lowest pass is. Only these passes are taken one by one.
    """
    place = place - place.min(axis=0) + 1
    order = np.lexsort((place[:, 2], place[:, 1], place[:, 0], value))
    place, value = place[order], value[order]
    shape, n = place.max(axis=0) + 2, len(value)
    spot = (place[:, 0] * shape[1] + place[:, 1]) * shape[2] + place[:, 2]
    rank = np.full(int(shape.prod()), n, np.int64)
    rank[spot] = np.arange(n)
    low, one, other = np.arange(n), [], []
    for dz, dy, dx in HALF:
        step = (dz * shape[1] + dy) * shape[2] + dx
        there = rank[spot + step]
        np.minimum(low, there, out=low)
        np.minimum(low, rank[spot - step], out=low)
        near = there < n
        one.append(np.flatnonzero(near))
        other.append(there[near])
    while (low[low] != low).any():
        low = low[low]
    one, other = np.concatenate(one), np.concatenate(other)
    a, b, at = low[one], low[other], np.maximum(one, other)
    apart = a != b
    a, b, at = np.minimum(a, b)[apart], np.maximum(a, b)[apart], at[apart]
    passes = np.lexsort((at, b, a))
    a, b, at = a[passes], b[passes], at[passes]
    first = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])) if len(a) else np.empty(0, bool)
    a, b, at = a[first], b[first], at[first]
    passes = np.argsort(at, kind="stable")
    up = {int(m): int(m) for m in np.flatnonzero(low == np.arange(n))}

    def root(p: int) -> int:
        while up[p] != p:
            up[p] = up[up[p]]
            p = up[p]
        return p

    born, died = [], []
    for p, q, r in zip(a[passes].tolist(), b[passes].tolist(), at[passes].tolist(), strict=True):
        p, q = root(p), root(q)
        if p != q:
            old, young = min(p, q), max(p, q)
            up[young] = old
            if value[young] < value[r]:
                born.append(value[young])
                died.append(value[r])
    left = [p for p in up if up[p] == p]
    return np.append(born, value[left]), np.append(died, np.ones(len(left)))


def h0_barcode(blocks: DataFrame, value: str, keys=KEYS) -> DataFrame:
    """``birth, death`` of each block's intervals, on the filtration value 1 - v; zero-length ones are left out.

    ``blocks`` has block keys, places and values. A group is a block, which bounds it. An interval that never
    dies ends at 1.
    """
    by = [*keys, *BLOCK]

    def run(voxels: pa.Table) -> pa.Table:
        place = np.stack([voxels[a].to_numpy().astype(np.int64) for a in AXES], axis=1)
        birth, death = _barcode(place, 1.0 - voxels[value].to_numpy().astype(float))
        return pa.table({**{k: pa.repeat(voxels[k][0], len(birth)) for k in by}, "birth": birth, "death": death})

    cut = blocks.select(*by, *AXES, value)
    return cut.groupBy(*by).applyInArrow(run, ddl(cut, by, "birth double, death double"))


def bottleneck_distance(a: np.ndarray, b: np.ndarray) -> float:
    """Bottleneck distance of two diagrams (rows of birth, death), where points may go to the diagonal.

    All points on the diagonal cost half the longest interval, so only pairs nearer than that are looked at. At a distance
    t, points whose way to the diagonal is longer than t must find a partner within t. If those of one side can all be
    matched, and those of the other side can, both can be at once (Mendelsohn and Dulmage), so the sides are matched apart.
    """
    half_a, half_b = (a[:, 1] - a[:, 0]) / 2, (b[:, 1] - b[:, 0]) / 2
    most = max(half_a.max(initial=0.0), half_b.max(initial=0.0))
    order = np.argsort(b[:, 0], kind="stable")
    lo, hi = np.searchsorted(b[order, 0], a[:, 0] - most), np.searchsorted(b[order, 0], a[:, 0] + most, side="right")
    i = np.repeat(np.arange(len(a)), hi - lo)
    j = order[np.arange(len(i)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)]
    cost = np.abs(a[i] - b[j]).max(axis=1) if len(i) else np.empty(0)
    near = cost <= most
    i, j, cost = i[near], j[near], cost[near]
    values = np.unique(np.concatenate([[0.0], half_a, half_b, cost]))

    def fits(t: float) -> bool:
        ok = cost <= t
        return _all_matched(np.flatnonzero(half_a > t), i[ok], j[ok]) and _all_matched(np.flatnonzero(half_b > t), j[ok], i[ok])

    low, high = 0, len(values) - 1
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if fits(values[mid]) else (mid + 1, high)
    return float(values[low])


def _all_matched(must: np.ndarray, left: np.ndarray, right: np.ndarray) -> bool:
    """Whether all of ``must`` can be matched along the edges ``left[e], right[e]`` (Hopcroft and Karp: shortest augmenting paths by layers)."""
    order = np.argsort(left, kind="stable")
    first, end = np.searchsorted(left[order], must), np.searchsorted(left[order], must, side="right")
    if (first == end).any():
        return False
    partners = [right[order[f:e]].tolist() for f, e in zip(first, end, strict=True)]
    mate: list[int] = [-1] * len(must)
    taken: dict[int, int] = {}
    while True:
        layer = {u: 0 for u in range(len(must)) if mate[u] < 0}
        if not layer:
            return True
        now, reached = list(layer), False
        while now and not reached:
            after = []
            for u in now:
                for v in partners[u]:
                    w = taken.get(v)
                    if w is None:
                        reached = True
                    elif w not in layer:
                        layer[w] = layer[u] + 1
                        after.append(w)
            now = after
        if not reached:
            return False
        spot = [0] * len(must)
        for start in [u for u in range(len(must)) if mate[u] < 0]:
            path = [start]  # nodes of the left side; spot[u] - 1 is the partner that u tries
            while path:
                u = path[-1]
                if spot[u] == len(partners[u]):
                    path.pop()
                    continue
                v = partners[u][spot[u]]
                spot[u] += 1
                w = taken.get(v)
                if w is None:
                    for x in reversed(path):
                        v = partners[x][spot[x] - 1]
                        taken[v], mate[x] = x, v
                    break
                if layer.get(w) == layer[u] + 1:
                    path.append(w)


def bottleneck(gt_bars: DataFrame, pred_bars: DataFrame, keys=KEYS) -> DataFrame:
    """``distance`` of each block's two diagrams; a block may have one of them only."""
    by = [*keys, *BLOCK]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        one, other = (np.stack([bars[c].to_numpy() for c in ("birth", "death")], axis=1) for bars in (left, right))
        head = left if len(left) else right
        return pa.table({**{k: head[k].slice(0, 1) for k in by}, "distance": [bottleneck_distance(one, other)]})

    return gt_bars.groupBy(*by).cogroup(pred_bars.groupBy(*by)).applyInArrow(run, ddl(gt_bars, by, "distance double"))


def topology_loss(pairs: DataFrame, volumes: DataFrame, block=(10, 20, 20), keys=KEYS) -> DataFrame:
    """``keys, loss``: the sum of the blocks' bottleneck distances. Blocks are dense: voxels without a row are 0."""
    full = V.dense(pairs.withColumn("gt", F.col("gt").cast("double")), volumes, "gt", keys)
    full = full.join(pairs.select(*keys, *AXES, "pred"), [*keys, *AXES], "left").withColumn("pred", F.coalesce("pred", F.lit(0.0)))
    tiles = materialize(V.tile(full, block, keys), "tiles")
    each = bottleneck(h0_barcode(tiles, "gt", keys), h0_barcode(tiles, "pred", keys), keys)
    loss = each.groupBy(*keys).agg(F.sum("distance").alias("_loss"))
    return volumes.select(*keys).join(loss, list(keys), "left").select(*keys, F.coalesce("_loss", F.lit(0.0)).alias("loss"))
