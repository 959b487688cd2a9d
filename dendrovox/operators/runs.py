"""Masks as runs along x, and morphology on them.

A run is ``keys, z, y, x0, x1``: foreground from x0 to x1 with background at both ends. A structuring element is cut into rows
along x (``dz, dy, lo, hi``), so dilation and erosion cost runs times rows of the element, neither its volume nor the
length of a line. Both are one sweep along each line: a dilated voxel is covered by one moved run at least, an eroded one by one for each row
of the element.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dendrovox.functions.grid import AXES, KEYS, Offset

RUN = ("x0", "x1")


def of_mask(mask: DataFrame, keys=KEYS) -> DataFrame:
    """The mask's runs; repeated voxels count once."""
    line = Window.partitionBy(*keys, "z", "y").orderBy("x")
    first = F.coalesce(F.col("x") - F.lag("x").over(line) > 1, F.lit(True)).cast("int")
    part = mask.select(*keys, *AXES).withColumn("_first", first).withColumn("_run", F.sum("_first").over(line))
    return part.groupBy(*keys, "z", "y", "_run").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("_run")


def to_mask(runs: DataFrame, keys=KEYS) -> DataFrame:
    return runs.select(*keys, "z", "y", F.explode(F.sequence("x0", "x1")).alias("x"))


def rows_of(offsets: list[Offset]) -> list[tuple[int, int, int, int]]:
    """The rows ``dz, dy, lo, hi`` of an element; a row with gaps is several."""
    out: list[list[int]] = []
    for dz, dy, dx in sorted(set(offsets)):
        if out and out[-1][:2] == [dz, dy] and out[-1][3] == dx - 1:
            out[-1][3] = dx
        else:
            out.append([dz, dy, dx, dx])
    return [tuple(r) for r in out]


def literal_rows(rows) -> Column:
    return F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(r, ("dz", "dy", "lo", "hi"), strict=True)]) for r in rows])


def covered(runs: DataFrame, need: Column, keys=KEYS) -> DataFrame:
    """The runs of the places that lie in ``need`` of the given (overlapping) runs or more; ``need`` is constant in a line."""
    ends = F.array(F.struct(F.col("x0").alias("x"), F.lit(1).alias("d")), F.struct((F.col("x1") + 1).alias("x"), F.lit(-1).alias("d")))
    at = runs.select(*keys, "z", "y", need.alias("_need"), F.explode(ends).alias("e")).select(*keys, "z", "y", "_need", "e.x", "e.d")
    line = Window.partitionBy(*keys, "z", "y").orderBy("x")
    on = F.sum("d").over(line.rangeBetween(Window.unboundedPreceding, 0)) >= F.col("_need")
    edges = at.withColumn("_on", on).withColumn("_turn", F.col("_on") != F.coalesce(F.lag("_on").over(line), F.lit(False))).where("_turn")
    closed = edges.withColumn("x1", (F.lead("x").over(line) - 1).cast("int"))
    return closed.where("_on").select(*keys, "z", "y", F.col("x").cast("int").alias("x0"), "x1")


def moved(runs: DataFrame, sign: int, keys, more=()) -> DataFrame:
    """Runs with a row ``_r`` of the element, moved by it (1) or back by it (-1)."""
    move = lambda c, by: (F.col(c) + sign * F.col(f"_r.{by}")).cast("int")
    return runs.select(*keys, *more, move("z", "dz").alias("z"), move("y", "dy").alias("y"), move("x0", "lo").alias("x0"), move("x1", "hi").alias("x1"))


def within(runs: DataFrame, volumes: DataFrame, keys=KEYS) -> DataFrame:
    """The parts of the runs that lie in their volume; ``keys`` may hold more than the volume's."""
    on = [k for k in keys if k in volumes.columns]
    at = runs.join(volumes.select(*on, "depth", "height", "width"), on)
    at = at.where("z >= 0 and z < depth and y >= 0 and y < height")
    return at.select(*keys, "z", "y", F.greatest("x0", F.lit(0)).alias("x0"), F.least(F.col("x1"), F.col("width") - 1).alias("x1")).where("x0 <= x1")


def dilate(runs: DataFrame, volumes: DataFrame, offsets: list[Offset], keys=KEYS) -> DataFrame:
    """Dilation by the offsets, within the volume."""
    each = runs.withColumn("_r", F.explode(literal_rows(rows_of(offsets))))
    return covered(within(moved(each, 1, keys), volumes, keys), F.lit(1), keys)


def erode(runs: DataFrame, offsets: list[Offset], keys=KEYS) -> DataFrame:
    """Places all of whose offsets are foreground; outside the volume is background."""
    rows = rows_of(offsets)
    each = runs.withColumn("_r", F.explode(literal_rows(rows)))
    return covered(moved(each, -1, keys).where("x0 <= x1"), F.lit(len(rows)), keys)


def ball_rows(radii: DataFrame) -> DataFrame:
    """``r, dz, dy, lo, hi, n_rows`` of the sampled ball of each radius ``r``.

    The ball is sampled on ``int(2 r + 1)`` evenly spaced points from -r to r along each axis, both ends among them, and holds the
    points at distance r or less. So a fractional radius gives a grid that isn't the voxels': spaced a little over one, of
    half-integers, or without any point inside. Offsets count from the first sample; an opening is the same from any origin.
    """
    points = F.floor(2 * F.col("r") + 1).cast("int")
    n = radii.select("r").distinct().withColumn("n", points).where("n > 1")
    spot = lambda i: i * (2 * F.col("r") / (F.col("n") - 1)) - F.col("r")
    for name in ("dz", "dy", "dx"):
        n = n.withColumn(name, F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    square = reduce(lambda a, b: a + b, [spot(F.col(c)) * spot(F.col(c)) for c in ("dx", "dy", "dz")])
    rows = n.where(square <= F.col("r") * F.col("r")).groupBy("r", "dz", "dy").agg(F.min("dx").alias("lo"), F.max("dx").alias("hi"))
    return rows.join(rows.groupBy("r").agg(F.count(F.lit(1)).alias("n_rows")), "r")


def open_by_radius(runs: DataFrame, radii: DataFrame, balls: DataFrame, keys=KEYS) -> DataFrame:
    """Opening of each volume by the ball of its radius (``keys, r``); a ball without points leaves nothing."""
    named = F.struct("dz", "dy", "lo", "hi").alias("_r")
    rows = balls.select("r", named, "n_rows")
    each = runs.join(radii.select(*keys, "r"), list(keys)).join(rows, "r")
    eroded = covered(moved(each, -1, keys, ["n_rows"]).where("x0 <= x1"), F.col("n_rows"), keys)
    back = eroded.join(radii.select(*keys, "r"), list(keys)).join(rows, "r")
    return covered(moved(back, 1, keys), F.lit(1), keys)
