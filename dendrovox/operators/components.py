"""Connected components of masks, and the cell-body (soma) operators built on them.

Component ids are the least linear index (raster order) of the component, so "first component" is the least id.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dendrovox.functions.grid import AXES, KEYS, TILE, TILES, ddl, flip_y, linear, neighbours, shifted
from dendrovox.operators import voxels as V
from dendrovox.plans.iterate import connected_components as components_of_edges
from dendrovox.plans.iterate import kept, materialize, release, settle


def _place(keys) -> list[str]:
    return [*keys, *AXES]


def _label_tile(offsets):
    """A function that labels one tile's voxels: ``part`` is the least index ``k`` of the voxel's component within the tile."""
    wide = TILE + 2
    steps = np.array([(dz * wide + dy) * wide + dx for dz, dy, dx in offsets])

    def label(voxels: pa.Table) -> pa.Table:
        voxels = voxels.sort_by("k")
        spot = np.zeros(len(voxels), np.int64)
        for a in AXES:
            spot = spot * wide + voxels[a].to_numpy() % TILE + 1
        grid = np.full(wide**3, -1, np.int32)
        grid[spot] = np.arange(len(spot))
        met = grid[spot[:, None] + steps[None, :]]
        one, step = np.nonzero(met >= 0)
        other = met[one, step]
        up = np.arange(len(spot))
        while True:
            a, b = up[one], up[other]
            apart = a != b
            if not apart.any():
                break
            np.minimum.at(up, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
            while (over := up[up] != up).any():
                up[over] = up[up[over]]
        return voxels.append_column("part", pa.array(voxels["k"].to_numpy()[up]))

    return label


def connected_components(mask: DataFrame, volumes: DataFrame, connectivity: int = 26, keys=KEYS) -> DataFrame:
    """The mask with ``component_id`` (6 or 26 neighbours). ``keys`` may hold more than the volume's.

    Two levels: a task labels a tile; then only the labels that touch across tile borders are contracted.
    """
    on = [k for k in keys if k in volumes.columns]
    tile = [F.floor(F.col(a) / TILE).cast("int").alias(t) for a, t in zip(AXES, TILES, strict=True)]
    m = mask.select(*_place(keys)).join(volumes.select(*on, "height", "width"), on).select(*_place(keys), linear().cast("long").alias("k"), *tile).distinct()
    half = [o for o in neighbours(connectivity) if o > (0, 0, 0)]
    schema = ddl(m, m.columns, "part long")
    m = materialize(m.groupBy(*keys, *TILES).applyInArrow(_label_tile(half), schema), "voxels")
    inner = [F.col(a) % TILE for a in AXES]
    rim = m.where(reduce(lambda a, b: a | b, [(i == 0) | (i == TILE - 1) for i in inner]))
    ahead = shifted(rim, half, [*keys, *TILES, "part"])
    ahead = ahead.where(reduce(lambda a, b: a | b, [F.floor(F.col(a) / TILE) != F.col(t) for a, t in zip(AXES, TILES, strict=True)]))
    met = ahead.select(*_place(keys), F.col("part").alias("from")).join(rim.select(*_place(keys), "part"), _place(keys))
    node = lambda k: F.struct(*keys, F.col(k).alias("k"))
    parts = components_of_edges(met.select(node("from").alias("a"), node("part").alias("b")))
    named = parts.select(*[F.col(f"node.{k}").alias(k) for k in keys], F.col("node.k").alias("part"), F.col("component.k").alias("component_id"))
    return m.join(named, [*keys, "part"], "left").select(*_place(keys), F.coalesce("component_id", "part").alias("component_id"))


def component_sizes(labelled: DataFrame, keys=KEYS) -> DataFrame:
    return labelled.groupBy(*keys, "component_id").agg(F.count(F.lit(1)).alias("n_voxels"))


def _best(sizes: DataFrame, keys, *order) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return sizes.withColumn("_rank", rank).where("_rank = 1").select(*keys, "component_id")


def largest_component(mask: DataFrame, volumes: DataFrame, connectivity: int = 6, keys=KEYS) -> DataFrame:
    """Voxels of each volume's largest component; the first of equals."""
    labelled = materialize(connected_components(mask, volumes, connectivity, keys), "labelled")
    best = _best(component_sizes(labelled, keys), keys, F.desc("n_voxels"), "component_id")
    return labelled.join(best, [*keys, "component_id"], "left_semi").select(*_place(keys))


def remove_small(mask: DataFrame, volumes: DataFrame, min_size: int, connectivity: int = 6, keys=KEYS) -> DataFrame:
    """Components of ``min_size`` voxels or more, with their (stable) ``component_id``."""
    labelled = materialize(connected_components(mask, volumes, connectivity, keys), "labelled")
    large = component_sizes(labelled, keys).where(F.col("n_voxels") >= min_size)
    return labelled.join(large, [*keys, "component_id"], "left_semi").select(*_place(keys), "component_id")


def adaptive_remove_small(mask: DataFrame, volumes: DataFrame, start: int = 100, max_objects: int = 3, connectivity: int = 6, keys=KEYS) -> DataFrame:
    """Components that stay when the least size doubles from ``start`` until at most ``max_objects`` of a volume remain.

    No loop: the last threshold is the least ``start * 2^k`` above the size of the (max_objects + 1)-th component.
    """
    labelled = materialize(connected_components(mask, volumes, connectivity, keys), "labelled")
    sizes = component_sizes(labelled, keys)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n_voxels"), "component_id"))
    over = F.max(F.when(F.col("_rank") == max_objects + 1, F.col("n_voxels")))
    limit = sizes.withColumn("_rank", rank).groupBy(*keys).agg(over.alias("_size"))
    doublings = F.sequence(F.lit(0), F.lit(40))
    level = F.element_at(F.filter(F.transform(doublings, lambda k: F.lit(start).cast("long") * F.pow(F.lit(2), k).cast("long")), lambda t: t > F.coalesce("_size", F.lit(0))), 1)
    kept = sizes.join(limit.select(*keys, level.alias("_least")), list(keys)).where("n_voxels >= _least")
    return labelled.join(kept, [*keys, "component_id"], "left_semi").select(*_place(keys), "component_id")


def component_of(mask: DataFrame, seeds: DataFrame, volumes: DataFrame, connectivity: int = 26, keys=KEYS) -> DataFrame:
    """Voxels of the component that holds the volume's seed (``z, y, x``); none if the seed is background."""
    labelled = materialize(connected_components(mask, volumes, connectivity, keys), "labelled")
    chosen = labelled.join(seeds.select(*_place(keys)), _place(keys)).select(*keys, "component_id").distinct()
    return labelled.join(chosen, [*keys, "component_id"], "left_semi").select(*_place(keys))


def component_count(mask: DataFrame, volumes: DataFrame, connectivity: int = 6, keys=KEYS) -> DataFrame:
    """``keys, n_components, single``; volumes without foreground have none."""
    n = connected_components(mask, volumes, connectivity, keys).groupBy(*keys).agg(F.count_distinct("component_id").alias("n"))
    out = volumes.select(*keys).join(n, list(keys), "left").select(*keys, F.coalesce("n", F.lit(0)).alias("n_components"))
    return out.withColumn("single", F.col("n_components") == 1)


def centroid(mask: DataFrame, volumes: DataFrame, which: str = "largest", keys=KEYS) -> DataFrame:
    """Mean voxel ``cz, cy, cx`` of the ``largest`` (first of equals) or the ``first`` 26-component; null without foreground."""
    labelled = materialize(connected_components(mask, volumes, 26, keys), "labelled")
    order = (F.desc("n_voxels"), "component_id") if which == "largest" else ("component_id",)
    best = _best(component_sizes(labelled, keys), keys, *order)
    mean = labelled.join(best, [*keys, "component_id"], "left_semi").groupBy(*keys).agg(*[F.avg(a).alias(f"c{a}") for a in AXES])
    return volumes.select(*keys).join(mean, list(keys), "left")


def distance_to_background(mask: DataFrame, volumes: DataFrame, z_weight: float = 1.5, keys=KEYS) -> DataFrame:
    """Weighted shortest path of each foreground voxel from the background of its volume: ``dist``.

    Our definition of an external distance tool: steps to the 26 neighbours, a step's length with z weighted.
    """
    from dendrovox.operators.geodesic import geodesic_distance

    rim = V.mask_sub(V.dilate(mask, volumes, keys=keys, offsets=[(0, 0, 0), *neighbours(26)]), mask, keys)
    field = geodesic_distance(mask, rim, 26, keys, z_weight)
    return field.where("dist > 0").select(*_place(keys), "dist")  # only the rim is at 0


def _grown_core(field, volumes: DataFrame, mask: DataFrame, keys) -> DataFrame:
    """The core, over half the greatest value of the field that ``field`` gives, grown within the mask."""
    core = settle(lambda: V.binarize(field(), "max_frac", 0.5, "dist", keys), "core")
    region = settle(lambda: V.mask_and(V.dilate(core, volumes, 5, keys), mask, keys), "region")
    release(core)
    return region


def soma_region(mask: DataFrame, volumes: DataFrame, keys=KEYS) -> DataFrame:
    """The cell body: the core far from the background, grown, cleaned and opened."""
    mask, volumes = kept(mask, "mask"), kept(volumes, "volumes")
    region = _grown_core(lambda: distance_to_background(mask, volumes, keys=keys), volumes, mask, keys)
    return _cleaned(settle(lambda: largest_component(region, volumes, 6, keys), "region"), volumes, keys)


def _cleaned(region: DataFrame, volumes: DataFrame, keys=KEYS) -> DataFrame:
    opened = settle(lambda: V.progressive_open(region, volumes, keys), "opened")
    return settle(lambda: largest_component(opened, volumes, 6, keys), "cleaned")


def soma_center(mask: DataFrame, volumes: DataFrame, keys=KEYS) -> DataFrame:
    return centroid(soma_region(mask, volumes, keys), volumes, "largest", keys)


def simple_soma_center(mask: DataFrame, volumes: DataFrame, keys=KEYS) -> DataFrame:
    """Centroid of the largest part of the core at 0.95 of the greatest distance to the background."""
    core = V.binarize(distance_to_background(mask, volumes, keys=keys), "max_frac", 0.95, "dist", keys)
    return centroid(core, volumes, "largest", keys)


def multi_soma_region(mask: DataFrame, markers: DataFrame, volumes: DataFrame, keys=KEYS) -> DataFrame:
    """Cell bodies of volumes with several markers (full-resolution ``z, y, x``): up to three objects are opened
    each on its own and grown to 100 voxels; a marker that none covers gets a ball."""
    mask, volumes = kept(mask, "mask"), kept(volumes, "volumes")
    region = _grown_core(lambda: distance_to_background(mask, volumes, keys=keys), volumes, mask, keys)
    objects = settle(lambda: adaptive_remove_small(region, volumes, keys=keys).withColumnRenamed("component_id", "object_id"), "objects")
    deep = (*keys, "object_id")
    boxes = materialize(objects.select(*deep).distinct().join(volumes, list(keys)), "boxes")
    cleaned = V.grow_to_size(_cleaned(objects, boxes, deep), boxes, 100, deep)
    places = markers.select(*keys, *[F.floor(F.col(a) / 2).cast("int").alias(f"c{a}") for a in AXES])
    return V.stamp_ball(cleaned.select(*_place(keys)).distinct(), places, volumes, 5, keys)


def main_soma_region(mask: DataFrame, markers: DataFrame, volumes: DataFrame, radius: float = 25, keys=KEYS) -> DataFrame:
    """The cell body within ``radius`` of the volume's marker (full-resolution ``z, y, x``, halved and truncated)."""
    half = lambda a: F.when(F.col(a) >= 0, F.floor(F.col(a) / 2)).otherwise(F.ceil(F.col(a) / 2))
    centers = markers.select(*keys, *[half(a).cast("int").alias(f"c{a}") for a in AXES])
    mask, volumes = kept(mask, "mask"), kept(volumes, "volumes")
    near = lambda: V.zero_outside_sphere(distance_to_background(mask, volumes, keys=keys), centers, radius, "dist", keys).where("dist > 0")
    region = _grown_core(near, volumes, mask, keys)
    return _cleaned(settle(lambda: largest_component(region, volumes, 6, keys), "region"), volumes, keys)


def soma_markers(regions: DataFrame, label_markers: DataFrame | None, volumes: DataFrame, keys=KEYS) -> DataFrame:
    """A marker for each 6-component of the cell bodies: ``component_id, x, y, z, main``.

    With label markers (``ord, x, y, z``, full resolution) the main one is nearest to the first of them (halved,
    truncated), the first of equals, and y is flipped as height - y - 1; without, the first component is main and y is
    flipped as height - y.
    """
    labelled = connected_components(regions, volumes, 6, keys)
    each = labelled.groupBy(*keys, "component_id").agg(*[F.avg(a).alias(f"c{a}") for a in AXES])
    each = each.join(volumes.select(*keys, "height"), list(keys))
    if label_markers is None:
        at, order, flip = each, ["component_id"], "h"
    else:
        first = label_markers.groupBy(*keys).agg(F.min_by(F.struct(*AXES), "ord").alias("m")).select(*keys, *[F.floor(F.col(f"m.{a}") / 2).alias(f"m{a}") for a in AXES])
        at = each.withColumn("cy", flip_y(F.col("cy"), F.col("height"), "h_minus_1")).join(first, list(keys), "left")
        d2 = sum(((F.col(f"c{a}") - F.col(f"m{a}")) * (F.col(f"c{a}") - F.col(f"m{a}")) for a in AXES), F.lit(0))
        at, order, flip = at.withColumn("_d2", d2), [F.asc_nulls_last("_d2"), "component_id"], "none"
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    y = flip_y(F.col("cy"), F.col("height"), flip)
    return at.withColumn("_rank", rank).select(*keys, "component_id", F.col("cx").alias("x"), y.alias("y"), F.col("cz").alias("z"), (F.col("_rank") == 1).alias("main"))
