"""Intensity and mask operators on voxel tables.

A voxel table has the key columns (``volume_id`` by default), ``z, y, x`` and a value column; a mask is the
keys and places of its foreground voxels. Work is partitioned by (volume, place), so one large volume spreads over all
tasks; only aggregates, which combine map-side, group by volume.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dendrovox.functions.grid import AXES, KEYS, ball, cross, ddl, inside, shifted
from dendrovox.operators import runs as R
from dendrovox.plans.iterate import Versions, materialize

#: Fixed rule of the lattice: the two axes that a projection keeps.
PLANES = {"xy": ("y", "x"), "xz": ("z", "x"), "yz": ("z", "y")}


def _place(keys) -> list[str]:
    return [*keys, *AXES]


def per_volume(vox: DataFrame, keys, **aggs: Column) -> DataFrame:
    """``vox`` with aggregates of its volume as columns."""
    return vox.join(vox.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()]), list(keys))


def binarize(vox: DataFrame, rule: str = "gt", threshold: float = 0.5, value: str = "intensity", keys=KEYS) -> DataFrame:
    """Mask of the voxels above a threshold (``gt``), equal to it (``eq``), or above that share of their volume's maximum (``max_frac``)."""
    v = F.col(value)
    if rule == "max_frac":
        return per_volume(vox, keys, _top=F.max(value)).where(v > F.col("_top") * threshold).select(*_place(keys))
    return vox.where(v > threshold if rule == "gt" else v == threshold).select(*_place(keys))


def minmax_uint8(vox: DataFrame, value: str = "intensity", keys=KEYS) -> DataFrame:
    """Values scaled to 0..255 over their volume, truncated; 0 where the volume is constant."""
    scaled = per_volume(vox, keys, _lo=F.min(value), _hi=F.max(value))
    new = F.when(F.col("_hi") > F.col("_lo"), F.floor((F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * 255)).otherwise(0)
    return scaled.select(*_place(keys), new.cast("int").alias(value))


def gamma(vox: DataFrame, gamma: float = 0.5, epsilon: float = 1e-7, p: float = 1.0, retain_stats: bool = False, seed: int = 0, value: str = "intensity", keys=KEYS) -> DataFrame:
    """``((v - min) / (range + epsilon)) ** gamma * range + min`` over each volume.

    ``retain_stats`` brings mean and deviation back to the old ones. ``p``: share of volumes changed, drawn by md5.
    """
    s = per_volume(vox, keys, _lo=F.min(value), _rng=F.max(value) - F.min(value), _avg=F.avg(value), _sd=F.stddev_pop(value))
    s = s.withColumn("_new", F.pow((F.col(value) - F.col("_lo")) / (F.col("_rng") + epsilon), gamma) * F.col("_rng") + F.col("_lo"))
    if retain_stats:
        s = per_volume(s, keys, _avg2=F.avg("_new"), _sd2=F.stddev_pop("_new"))
        s = s.withColumn("_new", (F.col("_new") - F.col("_avg2")) / (F.col("_sd2") + 1e-8) * F.col("_sd") + F.col("_avg"))
    if p < 1:
        drawn = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])), 1, 8), 16, 10).cast("double") / (1 << 32)
        s = s.withColumn("_new", F.when(drawn < p, F.col("_new")).otherwise(F.col(value)))
    return s.select(*_place(keys), F.col("_new").alias(value))


def block_max(vox: DataFrame, factor: int = 2, value: str = "intensity", keys=KEYS) -> DataFrame:
    """Down-sampling: maximum over blocks of ``factor`` voxels a side; blocks at the edge are padded with 0."""
    cells = [F.floor(F.col(a) / factor).cast("int").alias(a) for a in AXES]
    return vox.groupBy(*keys, *cells).agg(F.max(value).alias(value))


def mip(vox: DataFrame, plane: str = "xy", value: str = "intensity", keys=KEYS) -> DataFrame:
    """Maximum-intensity projection onto ``xy``, ``xz`` or ``yz``."""
    if plane not in PLANES:
        raise ValueError(f"plane {plane!r} is none of {sorted(PLANES)}")
    return vox.groupBy(*keys, *PLANES[plane]).agg(F.max(value).alias(value))


def mip_side_by_side(a: DataFrame, b: DataFrame, volumes: DataFrame, keys=KEYS) -> DataFrame:
    """Projections ``a`` and ``b`` of the same volumes, ``b`` to the right of ``a``."""
    moved = b.join(volumes.select(*keys, "width"), list(keys)).withColumn("x", F.col("x") + F.col("width")).drop("width")
    return a.unionByName(moved)


def mask_and(a: DataFrame, b: DataFrame, keys=KEYS) -> DataFrame:
    return a.join(b.select(*_place(keys)), _place(keys), "left_semi")


def mask_or(a: DataFrame, b: DataFrame, keys=KEYS) -> DataFrame:
    return a.select(*_place(keys)).union(b.select(*_place(keys))).distinct()


def mask_sub(a: DataFrame, b: DataFrame, keys=KEYS) -> DataFrame:
    return a.join(b.select(*_place(keys)), _place(keys), "left_anti")


def dilate(mask: DataFrame, volumes: DataFrame, iterations: int = 1, keys=KEYS, offsets=None) -> DataFrame:
    """Dilation by ``iterations`` crosses (or the given offsets), within the volume."""
    grown = R.dilate(R.of_mask(mask, keys), volumes, offsets or cross(iterations), keys)
    return R.to_mask(grown, keys)


def erode(mask: DataFrame, offsets, keys=KEYS) -> DataFrame:
    """Places all of whose offsets are foreground; outside the volume is background."""
    return R.to_mask(R.erode(R.of_mask(mask, keys), offsets, keys), keys)


def open_mask(mask: DataFrame, volumes: DataFrame, radius: float, keys=KEYS) -> DataFrame:
    """Opening by a ball: erosion, then dilation."""
    eroded = R.erode(R.of_mask(mask, keys), ball(radius), keys)
    return R.to_mask(R.dilate(eroded, volumes, ball(radius), keys), keys)


def progressive_open(mask: DataFrame, volumes: DataFrame, keys=KEYS) -> DataFrame:
    """Ten openings by shrinking balls (``runs.ball_rows``), each applied if it leaves anything of its volume.

    The radius starts at half the least extent of the largest 6-component and falls by a tenth of that. All volumes
    share each round; the loop runs over ten radii, not over volumes. A round writes the volumes that it opened; one
    whose balls have become too small for a voxel takes no part any more.
    """
    sizes = materialize(min_diameter(mask, volumes, keys), "diameters")
    state = Versions(keys, "opened")
    state.put(R.of_mask(mask, keys))
    for i in range(10):
        radii = sizes.select(*keys, (F.col("min_diameter") * (10 - i) / 10 / 2).cast("double").alias("r")).where("r >= 1")
        if radii.isEmpty():
            break
        balls = materialize(R.ball_rows(radii), "balls")
        state.put(R.open_by_radius(state.now(radii.select(*keys)), radii, balls, keys))
    return R.to_mask(state.now(), keys)


def crop(mask: DataFrame, keys=KEYS) -> tuple[DataFrame, DataFrame]:
    """(the mask moved to the origin of its tight box; the boxes: origin ``z0, y0, x0`` and extents ``depth, height, width``)."""
    low = [F.min(a).alias(f"{a}0") for a in AXES]
    size = [(F.max(a) - F.min(a) + 1).alias(d) for a, d in zip(AXES, ("depth", "height", "width"), strict=True)]
    box = mask.groupBy(*keys).agg(*low, *size)
    moved = mask.join(box, list(keys)).select(*keys, *[(F.col(a) - F.col(f"{a}0")).alias(a) for a in AXES])
    return moved, box


def restore(mask: DataFrame, box: DataFrame, keys=KEYS) -> DataFrame:
    """The inverse of ``crop``."""
    return mask.join(box, list(keys)).select(*keys, *[(F.col(a) + F.col(f"{a}0")).alias(a) for a in AXES])


def min_diameter(mask: DataFrame, volumes: DataFrame, keys=KEYS) -> DataFrame:
    """Least extent of the box around the largest 6-component: ``keys, min_diameter``."""
    from dendrovox.operators.components import largest_component

    _, box = crop(largest_component(mask, volumes, 6, keys), keys)
    return box.select(*keys, F.least("depth", "height", "width").alias("min_diameter"))


def _distance2(centers: tuple[str, str, str]) -> Column:
    return sum(((F.col(a) - F.col(c)) * (F.col(a) - F.col(c)) for a, c in zip(AXES, centers, strict=True)), F.lit(0))


def zero_outside_sphere(vox: DataFrame, centers: DataFrame, radius: float = 25, value: str = "intensity", keys=KEYS) -> DataFrame:
    """Values farther than ``radius`` from their volume's center (``cz, cy, cx``) become 0."""
    near = vox.join(centers.select(*keys, "cz", "cy", "cx"), list(keys))
    far = _distance2(("cz", "cy", "cx")) > radius * radius
    return near.select(*_place(keys), F.when(far, F.lit(0)).otherwise(F.col(value)).alias(value))


def stamp_ball(mask: DataFrame, centers: DataFrame, volumes: DataFrame, radius: float = 5, keys=KEYS) -> DataFrame:
    """The mask, with a ball around each center (``cz, cy, cx``) that it does not cover."""
    places = centers.select(*keys, *[F.col(f"c{a}").cast("int").alias(a) for a in AXES])
    bare = places.join(mask.select(*_place(keys)), _place(keys), "left_anti")
    return mask_or(mask, inside(shifted(bare, ball(radius), list(keys)).select(*_place(keys)), volumes, keys), keys)


def grow_to_size(mask: DataFrame, volumes: DataFrame, min_voxels: int = 100, keys=KEYS) -> DataFrame:
    """Each object (``keys`` may include its id) dilated by one step until it has ``min_voxels``; empty or stuck ones stop."""
    count = lambda runs: runs.groupBy(*keys).agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("_n"))
    state = Versions(keys, "grown")
    last = state.put(R.of_mask(mask, keys))
    before = None
    while True:
        sizes = count(last).where(F.col("_n") < min_voxels)
        short = sizes if before is None else sizes.join(before, list(keys)).where("_n > _before").drop("_before")
        short = materialize(short, "short")
        if short.isEmpty():
            return R.to_mask(state.now(), keys)
        grown = state.now(short.select(*keys)).withColumn("_r", F.explode(R.literal_rows(R.rows_of(cross(1)))))
        spread = R.within(R.moved(grown, 1, keys), volumes, keys)
        before = short.select(*keys, F.col("_n").alias("_before"))
        last = state.put(R.covered(spread, F.lit(1), keys))


def invert_distance_uint8(dist: DataFrame, volumes: DataFrame, value: str = "dist", keys=KEYS) -> DataFrame:
    """``max - d`` on the foreground, scaled to 0..255 and truncated; the least is 0, at the maximum and in the background."""
    s = per_volume(dist, keys, _top=F.max(value), _span=F.max(value) - F.min(value)).join(volumes.select(*keys), list(keys), "left_semi")
    new = F.when(F.col("_span") > 0, F.floor((F.col("_top") - F.col(value)) / F.col("_span") * 255)).otherwise(0)
    return s.select(*_place(keys), new.cast("int").alias("inverted"))


def _grid(volumes: DataFrame, keys) -> DataFrame:
    """Every place of the volumes."""
    grid = volumes.select(*keys, *[F.col(d) for d in ("depth", "height", "width")])
    for a, d in zip(AXES, ("depth", "height", "width"), strict=True):
        grid = grid.withColumn(a, F.explode(F.sequence(F.lit(0), F.col(d) - 1)))
    return grid.select(*_place(keys))


def dense(vox: DataFrame, volumes: DataFrame, value: str = "intensity", keys=KEYS) -> DataFrame:
    """A row for every voxel of the volumes, 0 where ``vox`` has none."""
    full = _grid(volumes, keys).join(vox.select(*_place(keys), value), _place(keys), "left")
    return full.withColumn(value, F.coalesce(F.col(value), F.lit(0).cast(vox.schema[value].dataType)))


def _along(axis: str, keys) -> object:
    return Window.partitionBy(*keys, *[a for a in AXES if a != axis]).orderBy(axis)


def diffuse(vox: DataFrame, volumes: DataFrame, niter: int = 1, kappa: float = 50, gamma: float = 0.1, option: int = 1, value: str = "intensity", keys=KEYS) -> DataFrame:
    """Edge-stopping diffusion (Perona and Malik 1990) on the dense grid, with no flux through the border.

    Conductance: exp(-(d / kappa)^2) for option 1, 1 / (1 + (d / kappa)^2) for option 2. The public formula is our
    definition.
    """
    now = dense(vox, volumes, value, keys).withColumn(value, F.col(value).cast("double"))
    for i in range(niter):
        flux = F.lit(0.0)
        for a in AXES:
            for side in (F.lag, F.lead):
                d = F.coalesce(side(value).over(_along(a, keys)) - F.col(value), F.lit(0.0))
                c = F.exp(-F.pow(d / kappa, 2)) if option == 1 else 1 / (1 + F.pow(d / kappa, 2))
                flux = flux + c * d
        now = now.withColumn(value, F.col(value) + gamma * flux)
        if i % 4 == 3:
            now = materialize(now, "diffused")
    return now


def diff_mask(a: DataFrame, b: DataFrame, keys=KEYS) -> DataFrame:
    """255 where exactly one of the masks is set."""
    x = a.select(*_place(keys), F.lit(1).alias("_a")).join(b.select(*_place(keys), F.lit(1).alias("_b")), _place(keys), "full_outer")
    return x.where("_a is null or _b is null").select(*_place(keys), F.lit(255).alias("diff"))


#: Lines of a chunk along each of the two other axes.
LINES = 8


def _nearest_in_lines(axis: str, keys, limit: float | None):
    """A function of a chunk of lines: for each place of a line the least ``d2 + (i - j)^2`` over its rows, by offsets growing until none can win."""
    others = [a for a in AXES if a != axis]
    most = np.iinfo(np.int64).max // 4

    def run(rows: pa.Table) -> pa.Table:
        size = rows["_n"][0].as_py()
        place = {a: rows[a].to_numpy().astype(np.int64) for a in AXES}
        names, line = np.unique(place[others[0]] << 32 | place[others[1]], return_inverse=True)
        first = np.full((len(names), size), most, np.int64)
        first[line, place[axis]] = rows["d2"].to_numpy()
        best, d = first.copy(), 1
        top = most if limit is None else int(limit * limit)
        while d < size and d * d <= min(int(best.max()), top):
            np.minimum(best[:, d:], first[:, :-d] + d * d, out=best[:, d:])
            np.minimum(best[:, :-d], first[:, d:] + d * d, out=best[:, :-d])
            d += 1
        one, at = np.nonzero(best <= min(top, most - 1))
        new = {others[0]: names[one] >> 32, others[1]: names[one] & 0xFFFFFFFF, axis: at}
        head = {k: pa.repeat(rows[k][0], len(at)) for k in keys}
        return pa.table({**head, **{a: pa.array(new[a].astype(np.int32)) for a in AXES}, "d2": pa.array(best[one, at])})

    return run


def squared_distance(mask: DataFrame, volumes: DataFrame, max_radius: float | None = None, keys=KEYS) -> DataFrame:
    """``d2``: squared Euclidean distance of each voxel to the nearest foreground voxel, up to ``max_radius``.

    Exact and separable, axis after axis. A task takes a chunk of ``LINES`` x ``LINES`` neighbouring lines into an array; within a line an
    offset is tried as long as its square may still improve some place, so the cost follows the distances, not the square of the line.
    """
    now = mask.select(*_place(keys)).distinct().withColumn("d2", F.lit(0).cast("long"))
    for a, d in zip(reversed(AXES), ("width", "height", "depth"), strict=True):
        chunk = [F.floor(F.col(b) / LINES).cast("int").alias(f"_{b}") for b in AXES if b != a]
        rows = now.join(volumes.select(*keys, F.col(d).alias("_n")), list(keys)).select("*", *chunk)
        by = [*keys, *[f"_{b}" for b in AXES if b != a]]
        now = rows.groupBy(*by).applyInArrow(_nearest_in_lines(a, list(keys), max_radius), ddl(now, [*_place(keys), "d2"]))
    return now


def edt(mask: DataFrame, volumes: DataFrame, max_radius: float | None = None, keys=KEYS) -> DataFrame:
    """Euclidean distance of every background voxel to the nearest foreground voxel of its volume: ``d2, dist``."""
    found = squared_distance(mask, volumes, max_radius, keys)
    return found.where("d2 > 0").select(*_place(keys), "d2", F.sqrt("d2").alias("dist"))


def gradient(field: DataFrame, value: str = "dist", keys=KEYS) -> DataFrame:
    """Gradient of the negated field of a dense grid: central differences, one-sided at the border (``gz, gy, gx``)."""
    out = [*_place(keys)]
    for a in AXES:
        w = _along(a, keys)
        before, after, here = F.lag(value).over(w), F.lead(value).over(w), F.col(value)
        up = F.when(before.isNull() & after.isNull(), 0.0).when(before.isNull(), after - here).when(after.isNull(), here - before).otherwise((after - before) / 2)
        out.append((-up).alias(f"g{a}"))
    return field.select(*out)


def tile(pair: DataFrame, block: tuple[int, int, int] = (10, 20, 20), keys=KEYS) -> DataFrame:
    """``pair`` (``gt, pred``) with block keys ``bz, by, bx``, without the blocks in which both sums are 0."""
    cells = [F.floor(F.col(a) / n).cast("int").alias(f"b{a}") for a, n in zip(AXES, block, strict=True)]
    keyed = pair.select("*", *cells)
    full = keyed.groupBy(*keys, "bz", "by", "bx").agg(F.sum("gt").alias("_g"), F.sum("pred").alias("_p")).where("_g <> 0 or _p <> 0")
    return keyed.join(full.select(*keys, "bz", "by", "bx"), [*keys, "bz", "by", "bx"], "left_semi")


def foreground_density(mask: DataFrame, volumes: DataFrame, keys=KEYS) -> DataFrame:
    """``keys, density``: the foreground's share of the volume; 0 for volumes without any."""
    n = mask.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    box = F.col("depth").cast("double") * F.col("height") * F.col("width")
    return volumes.join(n, list(keys), "left").select(*keys, (F.coalesce("_n", F.lit(0)) / box).alias("density"))


def foreground_points(vox: DataFrame, value: str = "intensity", keys=KEYS) -> DataFrame:
    """Places where the value is 1."""
    return vox.where(F.col(value) == 1).select(*_place(keys))


def add_soma_to_skeleton(skeleton: DataFrame, soma: DataFrame, keys=KEYS) -> DataFrame:
    """Skeleton or soma, of the volumes that have both."""
    both = skeleton.select(*keys).distinct().join(soma.select(*keys).distinct(), list(keys))
    return mask_or(skeleton, soma, keys).join(both, list(keys), "left_semi")
