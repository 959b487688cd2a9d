"""Registered queries of the voxel operators, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dendrovox.functions.grid import ball, cross
from dendrovox.operators import voxels as V
from dendrovox.plans.fixtures import fixture, with_fixtures
from dendrovox.plans.iterate import materialize

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):

    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = with_fixtures(sql)
        return f

    return put


def vox(spark, d) -> DataFrame:
    return fixture(spark, d, "f_voxel")


def dims(spark, d) -> DataFrame:
    return fixture(spark, d, "f_volume")


def mask(spark, d, least: int) -> DataFrame:
    return V.binarize(vox(spark, d), "gt", least - 1)


def centers(spark, d) -> DataFrame:
    """The volumes' source voxels as centers."""
    s = fixture(spark, d, "f_source")
    return s.select("volume_id", F.floor(F.col("k") / 576).cast("int").alias("cz"), (F.floor(F.col("k") / 24) % 24).cast("int").alias("cy"), (F.col("k") % 24).alias("cx"))


def r6(c) -> F.Column:
    return F.round(c, 6)


def offsets_sql(offsets) -> str:
    return "(select * from (values " + ", ".join(map(str, offsets)) + ") o(dz, dy, dx))"


M = "select volume_id, z, y, x from f_voxel where intensity >= {}"
IN = "z between 0 and 11 and y between 0 and 23 and x between 0 and 23"
CENTER = "select volume_id, k // 576 as cz, k // 24 % 24 as cy, k % 24 as cx from f_source"


def moved_sql(src: str, offsets) -> str:
    return f"select distinct volume_id, z + dz as z, y + dy as y, x + dx as x from ({src}) m, {offsets_sql(offsets)}"


@register("s02_read_voxels", "select volume_id, count(*) as n, cast(sum(intensity) as bigint) as total from f_voxel group by volume_id")
def s02(spark: SparkSession, d: str) -> DataFrame:
    from dendrovox.plans.iterate import new_path
    from dendrovox.sources.files import read_voxels, write_voxels

    path = new_path(spark, "voxels")
    write_voxels(vox(spark, d), path, 4)
    return read_voxels(spark, path).groupBy("volume_id").agg(F.count(F.lit(1)).alias("n"), F.sum("intensity").alias("total"))


@register("v01_binarize_gt", M.format(128))
def v01(spark, d):
    return V.binarize(vox(spark, d), "gt", 127.5)


@register("v01_binarize_max", "select v.volume_id, z, y, x from f_voxel v join (select volume_id, max(intensity) as m from f_voxel group by volume_id) using (volume_id) where intensity > m * 0.95")
def v01b(spark, d):
    return V.binarize(vox(spark, d), "max_frac", 0.95)


@register("v01_binarize_eq", "select volume_id, z, y, x from f_voxel where intensity = 200")
def v01c(spark, d):
    return V.binarize(vox(spark, d), "eq", 200)


STATS = "(select volume_id, min(intensity) as lo, max(intensity) as hi, avg(intensity) as mean, stddev_pop(intensity) as sd from f_voxel group by volume_id) s"


@register("v02_minmax_uint8", f"select v.volume_id, z, y, x, case when hi > lo then cast(floor(cast(intensity - lo as double) / (hi - lo) * 255) as int) else 0 end as intensity from f_voxel v join {STATS} using (volume_id)")
def v02(spark, d):
    return V.minmax_uint8(vox(spark, d))


GAMMA = f"select v.volume_id, z, y, x, mean, sd, intensity as old, pow((intensity - lo) / (hi - lo + 1e-7), 0.5) * (hi - lo) + lo as g from f_voxel v join {STATS} using (volume_id)"


@register("v03_gamma", f"select volume_id, z, y, x, round(g, 6) as intensity from ({GAMMA})")
def v03(spark, d):
    return V.gamma(vox(spark, d)).withColumn("intensity", r6("intensity"))


@register("v03_gamma_stats", f"with g as ({GAMMA}), s as (select volume_id, avg(g) as m2, stddev_pop(g) as sd2 from g group by volume_id) select volume_id, z, y, x, round((g - m2) / (sd2 + 1e-8) * sd + mean, 6) as intensity from g join s using (volume_id)")
def v03b(spark, d):
    return V.gamma(vox(spark, d), retain_stats=True).withColumn("intensity", r6("intensity"))


@register("v03_gamma_gated", f"select volume_id, z, y, x, round(case when cast('0x' || md5('3:' || cast(volume_id as varchar))[1:8] as bigint) / 4294967296.0 < 0.5 then g else old end, 6) as intensity from ({GAMMA})")
def v03c(spark, d):
    return V.gamma(vox(spark, d), p=0.5, seed=3).withColumn("intensity", r6("intensity"))


@register("v04_block_max", "select volume_id, z // 2 as z, y // 2 as y, x // 2 as x, max(intensity) as intensity from f_voxel group by 1, 2, 3, 4")
def v04(spark, d):
    return V.block_max(vox(spark, d))


for _plane, (_a, _b) in V.PLANES.items():
    register(f"v05_mip_{_plane}", f"select volume_id, {_a}, {_b}, max(intensity) as intensity from f_voxel group by all")(lambda spark, d, plane=_plane: V.mip(vox(spark, d), plane))


@register("v06_side_by_side", "select volume_id, y, x, max(intensity) as intensity from f_voxel group by all union all select volume_id, y, x + 24 as x, max(case when intensity >= 128 then 255 else 0 end) as intensity from f_voxel group by all")
def v06(spark, d):
    v = vox(spark, d)
    other = v.withColumn("intensity", F.when(F.col("intensity") >= 128, 255).otherwise(0))
    return V.mip_side_by_side(V.mip(v), V.mip(other), dims(spark, d))


@register("v07_mask_and", "select volume_id, z, y, x from f_voxel where intensity >= 128 and intensity <= 200")
def v07(spark, d):
    return V.mask_and(mask(spark, d, 128), vox(spark, d).where("intensity <= 200"))


@register("v07_mask_or", "select volume_id, z, y, x from f_voxel where intensity >= 200 or intensity <= 100")
def v07b(spark, d):
    return V.mask_or(mask(spark, d, 200), vox(spark, d).where("intensity <= 100"))


@register("v07_mask_sub", "select volume_id, z, y, x from f_voxel where intensity >= 128 and intensity < 200")
def v07c(spark, d):
    return V.mask_sub(mask(spark, d, 128), mask(spark, d, 200))


@register("v08_dilate", f"select * from ({moved_sql(M.format(240), cross(2))}) where {IN}")
def v08(spark, d):
    return V.dilate(mask(spark, d, 240), dims(spark, d), 2)


def eroded_sql(src: str, offsets) -> str:
    return f"select volume_id, z - dz as z, y - dy as y, x - dx as x from ({src}) m, {offsets_sql(offsets)} group by 1, 2, 3, 4 having count(*) = {len(offsets)}"


@register("v09_erode", eroded_sql(M.format(60), cross(1)))
def v09(spark, d):
    return V.erode(mask(spark, d, 60), cross(1))


@register("v09_open", f"select * from ({moved_sql(eroded_sql(M.format(60), ball(1)), ball(1))}) where {IN}")
def v09b(spark, d):
    return V.open_mask(mask(spark, d, 60), dims(spark, d), 1)


BOX = "select volume_id, min(z) as z0, min(y) as y0, min(x) as x0, max(z) - min(z) + 1 as depth, max(y) - min(y) + 1 as height, max(x) - min(x) + 1 as width from f_voxel where intensity >= 245 group by volume_id"


@register("v11_crop", f"select m.volume_id, z - z0 as z, y - y0 as y, x - x0 as x from ({M.format(245)}) m join ({BOX}) using (volume_id)")
def v11(spark, d):
    return V.crop(mask(spark, d, 245))[0]


@register("v11_crop_boxes", BOX)
def v11b(spark, d):
    return V.crop(mask(spark, d, 245))[1]


@register("v11_restore", M.format(245))
def v11c(spark, d):
    return V.restore(*V.crop(mask(spark, d, 245)))


@register("v13_zero_outside", f"select v.volume_id, z, y, x, case when (z - cz) * (z - cz) + (y - cy) * (y - cy) + (x - cx) * (x - cx) > 64 then 0 else intensity end as intensity from f_voxel v join ({CENTER}) c using (volume_id)")
def v13(spark, d):
    return V.zero_outside_sphere(vox(spark, d), centers(spark, d), 8)


@register("v14_stamp_ball", f"select volume_id, z, y, x from ({M.format(220)}) union select * from (select volume_id, cz + dz as z, cy + dy as y, cx + dx as x from ({CENTER}) c anti join ({M.format(220)}) m on c.volume_id = m.volume_id and cz = z and cy = y and cx = x, {offsets_sql(ball(5))}) where {IN}")
def v14(spark, d):
    return V.stamp_ball(mask(spark, d, 220), centers(spark, d), dims(spark, d), 5)


@register("v16_invert_distance", "with s as (select volume_id, max(intensity) as top, max(intensity) - min(intensity) as span from f_voxel group by volume_id) select v.volume_id, z, y, x, cast(floor(cast(top - intensity as double) / span * 255) as int) as inverted from f_voxel v join s using (volume_id)")
def v16(spark, d):
    return V.invert_distance_uint8(vox(spark, d), dims(spark, d), "intensity")


GRID = "select volume_id, cast(z as int) as z, cast(y as int) as y, cast(x as int) as x from f_volume, range(12) a(z), range(24) b(y), range(24) c(x)"
DENSE = f"select g.volume_id, g.z, g.y, g.x, coalesce(intensity, 0) as v from ({GRID}) g left join f_voxel f on g.volume_id = f.volume_id and g.z = f.z and g.y = f.y and g.x = f.x"


def _flux(axis: str, side: str) -> str:
    others = ", ".join(["volume_id", *[a for a in "zyx" if a != axis]])
    return f"coalesce(cast({side}(v) over (partition by {others} order by {axis}) as double) - v, 0.0)"


_FLUXES = [(_a + _s[1], _flux(_a, _s)) for _a in "zyx" for _s in ("lag", "lead")]


@register("v17_diffuse", f"with g as ({DENSE}), f as (select *, {', '.join(f'{e} as {n}' for n, e in _FLUXES)} from g) select volume_id, z, y, x, round(v + 0.1 * ({' + '.join(f'exp(-pow({n} / 50, 2)) * {n}' for n, _ in _FLUXES)}), 6) as intensity from f")
def v17(spark, d):
    return V.diffuse(vox(spark, d), dims(spark, d)).withColumn("intensity", r6("intensity"))


@register("v18_diff_mask", "select volume_id, z, y, x, 255 as diff from f_voxel where (intensity >= 128) <> (intensity < 200)")
def v18(spark, d):
    return V.diff_mask(mask(spark, d, 128), vox(spark, d).where("intensity < 200"))


@register("v19_edt", f"select g.volume_id, g.z, g.y, g.x, cast(min((g.z - m.z) * (g.z - m.z) + (g.y - m.y) * (g.y - m.y) + (g.x - m.x) * (g.x - m.x)) as bigint) as d2, round(sqrt(min((g.z - m.z) * (g.z - m.z) + (g.y - m.y) * (g.y - m.y) + (g.x - m.x) * (g.x - m.x))), 6) as dist from ({GRID}) g join ({M.format(240)}) m on g.volume_id = m.volume_id group by all having min((g.z - m.z) * (g.z - m.z) + (g.y - m.y) * (g.y - m.y) + (g.x - m.x) * (g.x - m.x)) > 0")
def v19(spark, d):
    return V.edt(mask(spark, d, 240), dims(spark, d)).withColumn("dist", r6("dist"))


def _slope(axis: str) -> str:
    others = ", ".join(["volume_id", *[a for a in "zyx" if a != axis]])
    w = f"over (partition by {others} order by {axis})"
    return f"round(-(case when lag(v) {w} is null then lead(v) {w} - v when lead(v) {w} is null then v - lag(v) {w} else (lead(v) {w} - lag(v) {w}) / 2.0 end), 6) + 0.0 as g{axis}"


@register("v20_gradient", f"with g as (select volume_id, z, y, x, cast(v as double) as v from ({DENSE})) select volume_id, z, y, x, {', '.join(map(_slope, 'zyx'))} from g")
def v20(spark, d):
    g = V.gradient(V.dense(vox(spark, d), dims(spark, d)).withColumn("intensity", F.col("intensity").cast("double")), "intensity")
    return g.withColumns({f"g{a}": r6(f"g{a}") + 0.0 for a in "zyx"})


@register("v21_tile", "with t as (select *, z // 10 as bz, y // 20 as \"by\", x // 20 as bx from f_pair) select * from t where (volume_id, bz, \"by\", bx) in (select (volume_id, bz, \"by\", bx) from t group by volume_id, bz, \"by\", bx having sum(gt) <> 0 or sum(pred) <> 0)")
def v21(spark, d):
    return V.tile(fixture(spark, d, "f_pair"))


@register("v22_density", "select volume_id, round(sum(case when intensity >= 200 then 1 else 0 end) / (12.0 * 24 * 24), 6) as density from f_voxel group by volume_id")
def v22(spark, d):
    return V.foreground_density(mask(spark, d, 200), dims(spark, d)).withColumn("density", r6("density"))


@register("v23_points", "select volume_id, z, y, x from f_pair where gt = 1")
def v23(spark, d):
    return V.foreground_points(fixture(spark, d, "f_pair"), "gt")


@register("v24_skeleton_soma", "select volume_id, z, y, x from f_voxel where (intensity between 100 and 110 or intensity >= 245) and volume_id in (select volume_id from f_voxel where intensity >= 245) and volume_id in (select volume_id from f_voxel where intensity between 100 and 110)")
def v24(spark, d):
    return V.add_soma_to_skeleton(vox(spark, d).where("intensity between 100 and 110"), mask(spark, d, 245))
