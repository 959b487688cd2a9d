"""Column helpers for voxel grids: offsets, linear indexes, neighbour codes, axis flips."""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AXES = ("z", "y", "x")
KEYS = ("volume_id",)
#: Voxels along a tile's side, and the columns that name a tile.
TILE = 32
TILES = ("tz", "ty", "tx")
Offset = tuple[int, int, int]


def neighbours(connectivity: int = 26) -> list[Offset]:
    """Offsets (dz, dy, dx) of the 6 or 26 neighbours."""
    most = {6: 1, 18: 2, 26: 3}[connectivity]
    return [o for o in product((-1, 0, 1), repeat=3) if 0 < sum(map(abs, o)) <= most]


def cross(radius: int) -> list[Offset]:
    """Offsets within ``radius`` steps along the axes: ``radius`` dilations by the 6-neighbour cross."""
    r = range(-radius, radius + 1)
    return [o for o in product(r, r, r) if sum(map(abs, o)) <= radius]


def ball(radius: float) -> list[Offset]:
    """Offsets at Euclidean distance ``radius`` or less."""
    r = range(-int(radius), int(radius) + 1)
    return [o for o in product(r, r, r) if sum(c * c for c in o) <= radius * radius]


def offset_array(offsets: list[Offset]) -> Column:
    """Offsets as a literal array of structs ``dz, dy, dx``."""
    return F.array(*[F.struct(*[F.lit(c).alias(f"d{a}") for a, c in zip(AXES, o, strict=True)]) for o in offsets])


def shifted(df: DataFrame, offsets: list[Offset], keep: list[str]) -> DataFrame:
    """A row for each row and offset: ``keep``, the offset ``dz, dy, dx`` and the place ``z, y, x`` it leads to."""
    each = df.select(*keep, *AXES, F.explode(offset_array(offsets)).alias("_o"))
    return each.select(*keep, "_o.*", *[(F.col(a) + F.col(f"_o.d{a}")).cast("int").alias(a) for a in AXES])


def linear(dims: tuple[str, str] = ("height", "width")) -> Column:
    """Linear index of a voxel, in raster order."""
    return (F.col("z").cast("long") * F.col(dims[0]) + F.col("y")) * F.col(dims[1]) + F.col("x")


def encode_neighbor(dz: Column, dy: Column, dx: Column) -> Column:
    """Code 0..26 of an offset of -1, 0 or 1 on each axis; 13 is no offset."""
    return ((dz + 1) * 9 + (dy + 1) * 3 + dx + 1).cast("int")


def decode_neighbor(code: Column) -> list[Column]:
    """The offset ``dz, dy, dx`` of a code."""
    return [(F.floor(code / 9) - 1).cast("int").alias("dz"), (F.floor(code / 3) % 3 - 1).cast("int").alias("dy"), (code % 3 - 1).cast("int").alias("dx")]


def flip_y(y: Column, height: Column, flip: str) -> Column:
    """``none``: y; ``h``: height - y; ``h_minus_1``: height - y - 1."""
    return {"none": y, "h": height - y, "h_minus_1": height - y - 1}[flip]


def inside(df: DataFrame, volumes: DataFrame, keys=KEYS) -> DataFrame:
    """Rows of ``df`` whose place lies in their volume (``depth, height, width``)."""
    bound = df.join(volumes.select(*keys, "depth", "height", "width"), list(keys))
    ok = reduce(lambda a, b: a & b, [(F.col(a) >= 0) & (F.col(a) < F.col(d)) for a, d in zip(AXES, ("depth", "height", "width"), strict=True)])
    return bound.where(ok).drop("depth", "height", "width")


def ddl(df: DataFrame, names, more: str = "") -> str:
    """A schema of some columns of ``df`` and ``more`` columns."""
    return ", ".join([*(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names), *filter(None, [more])])
