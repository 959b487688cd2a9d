"""Shortest paths over foreground voxels: distance fields, predecessors, paths.

A distance is kept as its counts of face, edge and corner steps, so equal routes are exactly equal whatever
their order. Volumes are cut into tiles: a task settles one tile's voxels from what is known at its border, tiles
exchange the border voxels that changed, and only tiles that get some are settled, and written, again. Paths are walked
the same way: a task walks a path through its tile and hands its head over to the next. So the rounds grow
with the tiles that a path crosses, not with its voxels, and no task holds more than a tile.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dendrovox.functions.grid import AXES, KEYS, TILE, TILES, ddl, neighbours
from dendrovox.plans.iterate import Log, Versions, kept, materialize, release
from dendrovox.plans.iterate import settle as settled

#: Tiles that a shortest path may cross; more raises.
MAX_TILES = 10_000
#: Path heads that a task takes into a tile at once; more are dealt to several tasks.
HEADS = 65_536
#: Voxels by which a streamline may leave its tile before it is handed over; less, and one that swings across a border costs a round a step.
MARGIN = 4
STEPS = ("n_face", "n_edge", "n_corner")


def _place(keys) -> list[str]:
    return [*keys, *AXES]


def _tile(columns=AXES) -> list:
    return [F.floor(F.col(a) / TILE).cast("int").alias(t) for a, t in zip(columns, TILES, strict=True)]


def step_length(offset, z_weight: float = 1.0) -> float:
    return math.sqrt((offset[0] * z_weight) ** 2 + offset[1] ** 2 + offset[2] ** 2)


def _spots(rows: pa.Table, rim: int = 1) -> np.ndarray:
    """Places of a tile's voxels, and of those just outside, in an array with a rim."""
    spot = np.zeros(len(rows), np.int64)
    for a, t in zip(AXES, TILES, strict=True):
        spot = spot * (TILE + 2 * rim) + (rows[a].to_numpy().astype(np.int64) - rows[t].to_numpy() * TILE + rim)
    return spot


def settle(rows: pa.Table, offsets, z_weight: float) -> pa.Table:
    """One tile: its own voxels (``own``) and border voxels of others, with the distances known so far.

    A front of improved voxels advances through arrays until none improves. The start is the border, or, the first time, the sources.
    """
    own = rows["own"].to_numpy(zero_copy_only=False)
    spot, size = _spots(rows), (TILE + 2) ** 3
    mine = np.zeros(size + 2 * (TILE + 2) ** 2, bool)  # steps from the rim may lead past the array's ends
    mine[spot[own]] = True
    best, counts = np.full(size, np.inf), np.zeros((3, size), np.int32)
    dist = rows["dist"].to_numpy()
    order = np.argsort(-dist, kind="stable")  # of a place's rows the nearest is written last
    best[spot[order]] = dist[order]
    for k, s in enumerate(STEPS):
        counts[k, spot[order]] = rows[s].to_numpy()[order]
    jump = np.array([((dz * (TILE + 2)) + dy) * (TILE + 2) + dx for dz, dy, dx in offsets])
    kind = np.array([sum(map(abs, o)) - 1 for o in offsets])
    length = np.array([step_length(o, z_weight) for o in offsets])
    changed = np.zeros(size, bool)
    front = np.unique(spot[(dist < np.inf) & ~own] if not own.all() else spot[dist < np.inf])
    while len(front):
        to = front[:, None] + jump[None, :]
        one, step = np.nonzero(mine[to])
        to, from_ = to[one, step], front[one]
        n = counts[:, from_]
        n[kind[step], np.arange(len(step))] += 1
        d = n[0] + n[1] * math.sqrt(2) + n[2] * math.sqrt(3) if z_weight == 1.0 else np.round(best[from_] + length[step], 9)
        better = d < best[to]
        to, d, n = to[better], d[better], n[:, better]
        np.minimum.at(best, to, d)
        won = d == best[to]
        counts[:, to[won]] = n[:, won]
        front = np.unique(to[won])
        changed[front] = True
    at = spot[own]
    new = {"dist": pa.array(best[at]), "changed": pa.array(changed[at]), **{s: pa.array(counts[k, at]) for k, s in enumerate(STEPS)}}
    kept = rows.filter(pa.array(own))
    return pa.table({c: new.get(c, kept[c]) for c in rows.column_names})


def geodesic_distance(mask: DataFrame, sources: DataFrame, connectivity: int = 26, keys=KEYS, z_weight: float = 1.0) -> DataFrame:
    """Distance of the voxels reached from any source of their volume: ``n_face, n_edge, n_corner, dist``.

    Only foreground is entered; a source is 0 even on background. Voxels that are not reached have no row.
    """
    at = lambda df, dist: df.select(*[F.col(k) for k in keys], *[F.col(a).cast("int").alias(a) for a in AXES], F.lit(dist).alias("dist"))
    rows = at(mask, math.inf).union(at(sources, 0.0)).groupBy(*_place(keys)).agg(F.min("dist").alias("dist"))
    rows = rows.select(*_place(keys), *_tile(), "dist", *[F.lit(0).cast("int").alias(s) for s in STEPS], F.lit(True).alias("own"), F.lit(False).alias("changed"))
    columns, offsets = rows.columns, neighbours(connectivity)
    schema, group = rows.schema, [*keys, *TILES]
    run = lambda tile: settle(tile, offsets, z_weight)
    state = Versions(group, "field")
    news = state.put(rows.groupBy(*group).applyInArrow(run, schema)).where("changed or dist = 0")
    for _ in range(MAX_TILES):
        border = materialize(_border(news, columns), "border")
        if border.isEmpty():
            break
        active = state.now(border.select(*group).distinct())
        news = state.put(active.unionByName(border).groupBy(*group).applyInArrow(run, schema)).where("changed")
        release(border)
    else:
        raise RuntimeError(f"distances did not settle in {MAX_TILES} rounds")
    return state.now().where(F.col("dist") < math.inf).select(*_place(keys), *STEPS, "dist")


def _touched(rows: DataFrame) -> DataFrame:
    """A row for its own tile and for each other that it touches: how many tiles on, as ``_tz, _ty, _tx``."""
    out = rows
    for a, t in zip(AXES, TILES, strict=True):
        inner = F.pmod(F.col(a), F.lit(TILE))
        out = out.withColumn(f"_{t}", F.explode(F.array_compact(F.array(F.lit(0), F.when(inner == 0, -1), F.when(inner == TILE - 1, 1)))))
    return out


def _border(news: DataFrame, columns) -> DataFrame:
    """The rows of ``news`` as border rows of each other tile that touches them."""
    out = _touched(news).where(" or ".join(f"_{t} <> 0" for t in TILES))
    for t in TILES:
        out = out.withColumn(t, F.col(t) + F.col(f"_{t}"))
    return out.withColumn("own", F.lit(False)).select(*columns)


def _coder(offsets, out):
    """A function of a tile's field (``own``) and that of its border voxels: the field with ``pred_code``."""
    wide = TILE + 2

    def code(rows: pa.Table) -> pa.Table:
        own, spot = rows["own"].to_numpy(zero_copy_only=False), _spots(rows)
        size, edge = wide**3, wide * wide + wide + 1  # steps from the rim may lead past the array's ends
        dist, counts = np.full(size + 2 * edge, np.inf), np.full((3, size + 2 * edge), -9, np.int32)
        dist[spot + edge] = rows["dist"].to_numpy()
        for k, s in enumerate(STEPS):
            counts[k, spot + edge] = rows[s].to_numpy()
        at = spot[own] + edge
        best, found = np.full(len(at), np.inf), np.full(len(at), -1, np.int32)
        for dz, dy, dx in sorted(offsets, reverse=True):  # from the least predecessor by place on
            from_ = at - ((dz * wide + dy) * wide + dx)
            need = counts[:, at].copy()
            need[abs(dz) + abs(dy) + abs(dx) - 1] -= 1
            won = (counts[:, from_] == need).all(axis=0) & (dist[from_] < best)
            best[won], found[won] = dist[from_[won]], (dz + 1) * 9 + (dy + 1) * 3 + dx + 1
        return rows.filter(pa.array(own)).select(out).append_column("pred_code", pa.array(found))

    return code


def predecessor(field: DataFrame, connectivity: int = 26, keys=KEYS) -> DataFrame:
    """The field with ``pred_code``: the offset from predecessor to voxel; -1 for a source.

    Of several optimal predecessors the least by (dist, z, y, x). A task takes a tile and the border voxels around it, so a voxel is
    shuffled once, and not once for each neighbour.
    """
    out = [*_place(keys), *[c for c in field.columns if c not in _place(keys)]]
    rows = _touched(field.select(*out, *_tile()))
    own = F.expr(" and ".join(f"_{t} = 0" for t in TILES))
    rows = rows.select(*out, *[(F.col(t) + F.col(f"_{t}")).alias(t) for t in TILES], own.alias("own"))
    return rows.groupBy(*keys, *TILES).applyInArrow(_coder(neighbours(connectivity), out), ddl(field, out, "pred_code int"))


def predecessor_sparse(pred: DataFrame, keys=KEYS) -> DataFrame:
    return pred.where("pred_code <> -1").select(*_place(keys), "pred_code")


def predecessor_dense(pred: DataFrame, volumes: DataFrame, keys=KEYS) -> DataFrame:
    """A row for every voxel of the volumes; -1 where there is no predecessor."""
    from dendrovox.operators.voxels import dense

    moved = dense(pred.withColumn("pred_code", F.col("pred_code") + 1), volumes, "pred_code", keys)
    return moved.withColumn("pred_code", F.col("pred_code") - 1)


def _walker(max_len: int | None):
    """A function of path heads in a tile and the tile's predecessor codes: the points behind the heads, and where they leave."""
    wide = TILE + 2

    def walk(heads: pa.Table, codes: pa.Table) -> pa.Table:
        names = [*heads.column_names, "head"]
        if not len(heads) or not len(codes):
            return heads.slice(0, 0).append_column("head", pa.array([], pa.bool_()))
        grid = np.full(wide**3, -1, np.int8)
        grid[_spots(codes)] = codes["pred_code"].to_numpy()
        code = np.arange(27)
        jump = -(((code // 9 - 1) * wide + code // 3 % 3 - 1) * wide + code % 3 - 1)
        who, spot, step = np.arange(len(heads)), _spots(heads), heads["step"].to_numpy().astype(np.int64)
        out = []
        while len(who):
            c = grid[spot]
            go = c >= 0 if max_len is None else (c >= 0) & (step < max_len)
            who, spot, step = who[go], spot[go] + jump[c[go]], step[go] + 1
            rest = spot % wide, spot // wide % wide, spot // wide**2
            left = np.zeros(len(spot), bool)
            for r in rest:
                left |= (r == 0) | (r == wide - 1)
            out.append((who, step, rest, left))
            who, spot, step = who[~left], spot[~left], step[~left]
        who, step, left = (np.concatenate([o[k] for o in out]) for k in (0, 1, 3))
        found = heads.take(pa.array(who))
        new = {"step": pa.array(step.astype(np.int32)), "head": pa.array(left)}
        for k, (a, t) in enumerate(zip(AXES, TILES, strict=True)):
            new[a] = pa.array((np.concatenate([o[2][2 - k] for o in out]) - 1 + found[t].to_numpy() * TILE).astype(np.int32))
        return pa.table({c: new.get(c, found[c] if c in found.column_names else None) for c in names})

    return walk


def _met_in_tiles(heads: DataFrame, tiles: DataFrame, keys):
    """Heads and the rows of the tiles they are in, both by tile and share: a tile that many heads are in is dealt to several tasks."""
    group = [*keys, *TILES]
    shares = heads.groupBy(*group).agg((1 + F.floor(F.count(F.lit(1)) / HEADS)).cast("int").alias("_shares"))
    dealt = heads.join(shares, group).withColumn("_share", F.pmod(F.xxhash64("path_id"), F.col("_shares")).cast("int")).drop("_shares")
    held = tiles.join(shares, group).withColumn("_share", F.explode(F.sequence(F.lit(0), F.col("_shares") - 1))).drop("_shares")
    return dealt.groupBy(*group, "_share"), held.groupBy(*group, "_share"), dealt


def trace_paths(pred: DataFrame, starts: DataFrame, max_len: int | None = 400, keys=KEYS) -> DataFrame:
    """Paths from ``starts`` (``path_id, z, y, x``) back to their source: ``keys, path_id, step, z, y, x``.

    At most ``max_len + 1`` points. Paths are walked tile by tile; a round takes every path through one tile.
    """
    codes = materialize(pred.where("pred_code >= 0").select(*_place(keys), "pred_code", *_tile()), "codes")
    points = Log(pred.sparkSession, "paths")
    out = [*keys, "path_id", "step", *AXES]
    new = points.append(starts.select(*keys, "path_id", F.lit(0).alias("step"), *[F.col(a).cast("int").alias(a) for a in AXES], F.lit(True).alias("head")))
    for _ in range(MAX_TILES):
        heads = new.where("head").drop("head").select("*", *_tile())
        if heads.isEmpty():
            return points.all().select(out)
        left, right, dealt = _met_in_tiles(heads, codes, keys)
        walked = left.cogroup(right).applyInArrow(_walker(max_len), ddl(dealt, dealt.columns, "head boolean"))
        new = points.append(walked.select(*out, "head"))
    raise RuntimeError(f"paths did not end in {MAX_TILES} tiles")


def sample_points(mask: DataFrame, m: int, seed: int = 0, keys=KEYS) -> DataFrame:
    """``m`` foreground points of each volume without replacement (all, if it has fewer), drawn by md5 of seed and place."""
    drawn = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(a).cast("string") for a in AXES]))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(drawn, *AXES))
    return mask.select(*_place(keys)).withColumn("_rank", rank).where(F.col("_rank") <= m).select(*_place(keys), F.col("_rank").alias("path_id"))


def sample_paths(pred: DataFrame, k: int, seed: int = 0, max_len: int | None = 400, keys=KEYS) -> DataFrame:
    """``k`` paths of each volume from distinct random starts; none from volumes with fewer than ``k`` voxels."""
    sparse = predecessor_sparse(pred, keys)
    enough = sparse.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= k)
    starts = sample_points(sparse.join(enough, list(keys), "left_semi"), k, seed, keys)
    return trace_paths(sparse, starts, max_len, keys)


def fmm_distance(mask: DataFrame, sources: DataFrame, keys=KEYS) -> DataFrame:
    """First-generation distance field: the geodesic distance, the source forced into the mask."""
    return geodesic_distance(mask, sources, 26, keys)


def path_tree(mask: DataFrame, sources: DataFrame, connectivity: int = 6, keys=KEYS) -> DataFrame:
    """The shortest paths of every reached voxel as a tree: a row for each voxel with its ``pred_code`` (-1 for a source).

    A path is the way from voxel to voxel along the codes; ``paths_of`` writes them out.
    """
    return materialize(predecessor(geodesic_distance(mask, sources, connectivity, keys), connectivity, keys), "tree")


def paths_of(tree: DataFrame, keys=KEYS) -> DataFrame:
    """The path of every voxel of a path tree, ``path_id`` being its place: ``path_id, step, z, y, x``."""
    starts = tree.select(*keys, F.concat_ws(",", *[F.col(a).cast("string") for a in AXES]).alias("path_id"), *AXES)
    return trace_paths(tree, starts, None, keys)


def _descent(step: float, tolerance: float, max_steps: int):
    """A function of heads in a tile and the slopes of it and its margin: the heads' next points, as long as they stay in these."""
    rim = MARGIN + 1
    wide = TILE + 2 * rim

    def descend(heads: pa.Table, slopes: pa.Table) -> pa.Table:
        names = [*heads.column_names, "head"]
        if not len(heads) or not len(slopes):
            return heads.slice(0, 0).append_column("head", pa.array([], pa.bool_()))
        known, slope, spot = np.zeros(wide**3, bool), np.zeros((3, wide**3)), _spots(slopes, rim)
        known[spot] = True
        for k, a in enumerate(AXES):
            slope[k, spot] = slopes[f"g{a}"].to_numpy()
        base = np.array([heads[t][0].as_py() * TILE for t in TILES], float)[:, None]
        at = np.stack([heads[a].to_numpy() for a in AXES])
        goal = np.stack([heads[f"s{a}"].to_numpy().astype(float) for a in AXES])
        who, n, out = np.arange(len(heads)), heads["step"].to_numpy().astype(np.int64), []
        while len(who):
            low = np.floor(at)
            part, cell = at - low, (low - base).astype(np.int64) + rim
            total, met = np.zeros(at.shape), np.zeros(len(who), bool)
            for corner in np.ndindex(2, 2, 2):
                c = [cell[k] + corner[k] for k in range(3)]
                spot = (c[0] * wide + c[1]) * wide + c[2]
                weight = np.prod([part[k] if corner[k] else 1 - part[k] for k in range(3)], axis=0)
                total += weight * slope[:, spot]
                met |= known[spot]
            norm = np.sqrt((total * total).sum(axis=0))
            go = met & (norm > 1e-12) & (n < max_steps) & (((at - goal) ** 2).sum(axis=0) > tolerance * tolerance)
            who, n = who[go], n[go] + 1
            at, goal = at[:, go] + step * total[:, go] / norm[go], goal[:, go]
            inner = np.floor(at) - base
            left = ((inner < -MARGIN) | (inner >= TILE + MARGIN)).any(axis=0)
            out.append((who, n, at, left))
            who, n, at, goal = who[~left], n[~left], at[:, ~left], goal[:, ~left]
        found = heads.take(pa.array(np.concatenate([o[0] for o in out])))
        new = {"step": pa.array(np.concatenate([o[1] for o in out]).astype(np.int32)), "head": pa.array(np.concatenate([o[3] for o in out]))}
        new |= {a: pa.array(np.concatenate([o[2][k] for o in out])) for k, a in enumerate(AXES)}
        return pa.table({c: new.get(c, found[c] if c in found.column_names else None) for c in names})

    return descend


def streamline(field: DataFrame, targets: DataFrame, sources: DataFrame, step: float = 0.5, tolerance: float = 1.0, max_steps: int | None = None, keys=KEYS) -> DataFrame:
    """Descent from ``targets`` (``path_id, z, y, x``) along a dense field's gradient, by unit-length steps times ``step``.

    The gradient is interpolated from the eight voxels around the head. A path ends within ``tolerance`` of its
    volume's source, at a zero gradient or outside the grid. ``ended`` is false for a path that has done none of these
    after ``max_steps``; unless given, that is twice the field's largest distance by steps, and ten. A round takes every path as
    far as it goes within its tile and the margin around it, so each handing over takes a path ``MARGIN`` voxels into its next tile.
    """
    from dendrovox.operators.voxels import gradient

    if max_steps is None:
        far = field.where(~F.isnan(F.col("dist").cast("double")) & (F.col("dist") < float("inf"))).agg(F.max("dist")).first()[0]
        max_steps = math.ceil(2 * max(float(far or 0), 0.0) / step) + 10
    slope = gradient(field, "dist", keys).select(*_place(keys), *[F.col(f"g{a}").cast("double").alias(f"g{a}") for a in AXES])
    inner = {t: F.pmod(F.col(a), F.lit(TILE)) for a, t in zip(AXES, TILES, strict=True)}
    for t, i in inner.items():  # a tile's margin belongs to its neighbours, too, and so does the far corner of each of its cells
        slope = slope.select("*", F.explode(F.array_compact(F.array(F.lit(0), F.when(i <= MARGIN, F.lit(-1)), F.when(i >= TILE - MARGIN, F.lit(1))))).alias(f"_{t}"))
    slopes = materialize(slope.select(*_place(keys), *[f"g{a}" for a in AXES], *[(F.floor(F.col(a) / TILE).cast("int") + F.col(f"_{t}")).alias(t) for a, t in zip(AXES, TILES, strict=True)]), "slopes")
    goal = sources.select(*keys, *[F.col(a).alias(f"s{a}") for a in AXES])
    points = Log(field.sparkSession, "streamlines")
    out = [*keys, "path_id", "step", *AXES]
    new = points.append(targets.select(*keys, "path_id", F.lit(0).alias("step"), *[F.col(a).cast("double").alias(a) for a in AXES], F.lit(True).alias("head")))
    while True:
        heads = new.where("head").drop("head").join(goal, list(keys)).select("*", *_tile())
        if heads.isEmpty():
            break
        left, right, dealt = _met_in_tiles(heads, slopes, keys)
        walked = left.cogroup(right).applyInArrow(_descent(step, tolerance, max_steps), ddl(dealt, dealt.columns, "head boolean"))
        new = points.append(walked.select(*out, "head"))
    every = points.all().select(out)
    d2 = sum(((F.col(a) - F.col(f"s{a}")) * (F.col(a) - F.col(f"s{a}")) for a in AXES), F.lit(0.0))
    cut = every.where(F.col("step") == max_steps).join(goal, list(keys)).where(d2 > tolerance * tolerance).select(*keys, "path_id").distinct()
    return every.join(cut.withColumn("_cut", F.lit(True)), [*keys, "path_id"], "left").withColumn("ended", F.col("_cut").isNull()).drop("_cut")


def batch_predecessor(mask: DataFrame, sources: DataFrame, volumes: DataFrame, keys=("volume_id", "batch_idx", "channel_idx")) -> DataFrame:
    """Predecessors of each (batch, channel) whose foreground is a single 26-component and which has a source."""
    from dendrovox.operators.components import component_count

    mask = kept(mask, "mask")
    boxes = mask.select(*keys).distinct().join(volumes, [k for k in keys if k in volumes.columns])
    single = settled(lambda: component_count(mask, boxes, 26, keys).where("single").select(*keys), "single")
    fit = mask.join(single, list(keys), "left_semi").join(sources.select(*keys).distinct(), list(keys), "left_semi")
    from_ = sources.join(single, list(keys), "left_semi")
    return predecessor(geodesic_distance(fit, from_, 26, keys), 26, keys)


def volume_predecessors(mask: DataFrame, volumes: DataFrame, keys=KEYS) -> DataFrame:
    """Sparse predecessors of each volume from its cell body's center."""
    from dendrovox.operators.components import soma_center

    mask, volumes = kept(mask, "mask"), kept(volumes, "volumes")
    center = lambda: soma_center(mask, volumes, keys).where("cz is not null")
    source = settled(lambda: center().select(*keys, *[F.floor(f"c{a}").cast("int").alias(a) for a in AXES]), "source")
    return predecessor_sparse(predecessor(geodesic_distance(mask, source, 26, keys), 26, keys), keys)


def paths_to_swc(paths: DataFrame, keys=KEYS) -> DataFrame:
    """Paths as tree nodes ``n, type, x, y, z, r, parent``: the shared source is node 1, each path runs out from it."""
    longest = paths.groupBy(*keys, "path_id").agg(F.max("step").alias("_last"))
    out = paths.join(longest, [*keys, "path_id"]).withColumn("_from", F.col("_last") - F.col("step"))
    kept = out.where("_from > 0")
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("path_id", "_from")) + 1
    parent = F.when(F.col("_from") == 1, F.lit(1)).otherwise(number - 1)
    row = lambda n, p: [n.cast("long").alias("n"), F.lit(247).alias("type"), "x", "y", "z", F.lit(1.0).alias("r"), p.cast("long").alias("parent")]
    first = out.where("_from = 0").groupBy(*keys).agg(F.min_by(F.struct(*AXES), "path_id").alias("s")).select(*keys, "s.*")
    return first.select(*keys, *row(F.lit(1), F.lit(-1))).union(kept.select(*keys, *row(number, parent)))


def paths_on_mip(paths: DataFrame, k: int = 5, keys=KEYS) -> DataFrame:
    """The first ``k`` paths of each volume on the xy plane: ``path_id, step, y, x``."""
    chosen = paths.select(*keys, "path_id").distinct().withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("path_id"))).where(F.col("_r") <= k)
    return paths.join(chosen.select(*keys, "path_id"), [*keys, "path_id"], "left_semi").select(*keys, "path_id", "step", "y", "x")


def source_of_paths(paths: DataFrame, keys=KEYS) -> DataFrame:
    """The start whose path has a single point, which is the source."""
    one = paths.groupBy(*keys, "path_id").agg(F.count(F.lit(1)).alias("_n"), *[F.first(a).alias(a) for a in AXES])
    return one.where("_n = 1").select(*_place(keys))
