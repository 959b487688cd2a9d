"""Registered queries of the tree, catalog and file operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from dendrovox.functions.grid import ball, cross
from dendrovox.operators import catalog as R

from dendrovox.operators import trees as T
from dendrovox.operators import voxels as V
from dendrovox.plans.field_queries import comp_sql
from dendrovox.plans.fixtures import fixture
from dendrovox.plans.iterate import materialize, new_path
from dendrovox.plans.voxel_queries import IN, M, dims, mask, moved_sql, register, vox
from dendrovox.sources import files as S


def nodes(spark, d) -> DataFrame:
    return fixture(spark, d, "f_node")


# ---- trees


@register("t01_renumber", """
with l as (select tree_id, line, string_split(value, ' ') as p from f_swc_line where value not like '#%'),
n as (select tree_id, line, cast(p[1] as bigint) as old, cast(p[3] as double) as x, cast(p[4] as double) as y, cast(p[5] as double) as z, cast(p[6] as double) as r, cast(p[7] as bigint) as up, row_number() over (partition by tree_id order by line) as n from l),
m as (select tree_id, old, arg_max(n, line) as new from n group by 1, 2)
select n.tree_id, n.n, 0 as type, x, y, z, r, case when up = -1 then -1 else coalesce(m.new, 1) end as parent from n left join m on n.tree_id = m.tree_id and n.up = m.old""")
def t01(spark, d):
    return T.renumber(S.parse_swc(fixture(spark, d, "f_swc_line")))


@register("t02_children", "select f.tree_id, f.n, array_to_string(coalesce(c, []), ',') as children from f_node f left join (select tree_id, parent as n, list(n order by n) as c from f_node where parent <> -1 group by all) using (tree_id, n)")
def t02(spark, d):
    return T.children(nodes(spark, d)).withColumn("children", F.array_join(F.col("children").cast("array<string>"), ","))


DEPTH = "dep(tree_id, n, depth) as (select tree_id, n, cast(0 as bigint) from f_node where parent = -1 union all select f.tree_id, f.n, d.depth + 1 from dep d join f_node f on f.tree_id = d.tree_id and f.parent = d.n)"


@register("t03_depth", f"with recursive {DEPTH} select tree_id, n, depth from dep")
def t03(spark, d):
    return T.depth(nodes(spark, d))


def node_voxel_sql(src: str, flip: str = "24 - y") -> str:
    return f"select *, least(cast(trunc(z) as int), 11) as vz, least(cast(trunc({flip}) as int), 23) as vy, least(cast(trunc(x) as int), 23) as vx from {src}"


@register("t04_nodes_in_mask", f"select tree_id, n, type, x, y, z, r, parent from ({node_voxel_sql('f_node')}) q semi join ({M.format(128)}) m on q.tree_id = m.volume_id and vz = m.z and vy = m.y and vx = m.x where n > 1")
def t04(spark, d):
    return T.nodes_in_mask(nodes(spark, d), mask(spark, d, 128), dims(spark, d))


KIDS = "kid as (select tree_id, parent as n, count(*) as k from f_node where parent <> -1 group by 1, 2)"
INSIDE = f"ins as (select tree_id, n from ({node_voxel_sql('f_node')}) q semi join ({{}}) m on q.tree_id = m.volume_id and vz = m.z and vy = m.y and vx = m.x where n > 1)"


@register("t05_prune_in_soma", f"""with recursive {KIDS}, {INSIDE.format(M.format(128))},
gon(tree_id, n) as (select i.tree_id, i.n from ins i anti join kid k on i.tree_id = k.tree_id and i.n = k.n
  union select f.tree_id, f.parent from gon g join f_node f on g.tree_id = f.tree_id and g.n = f.n join kid k on k.tree_id = f.tree_id and k.n = f.parent and k.k = 1 join f_node u on u.tree_id = f.tree_id and u.n = f.parent and u.parent <> -1)
select f.* from f_node f anti join gon g on f.tree_id = g.tree_id and f.n = g.n""")
def t05(spark, d):
    return T.prune_in_soma(nodes(spark, d), mask(spark, d, 128), dims(spark, d), enabled=True)


@register("t05_prune_off", "select * from f_node")
def t05b(spark, d):
    return T.prune_in_soma(nodes(spark, d), mask(spark, d, 128), dims(spark, d))


SOMA = "select tree_id as volume_id, cast(trunc(z) as int) as z, cast(trunc(y) as int) as y, cast(trunc(x) as int) as x from f_node where n = 1 and tree_id in (select volume_id from f_volume)"


def connected_sql(soma: str) -> str:
    grown = f"select * from ({moved_sql(f'select * from ({moved_sql(soma, ball(2))}) where {IN}', cross(4))}) where {IN}"
    return f"""with recursive {comp_sql(grown, 6)}, {KIDS},
held as (select distinct l.volume_id, l.component_id from lab l join ({SOMA}) r using (volume_id, z, y, x)),
only_one as (select volume_id, min(component_id) as component_id from lab group by 1 having count(distinct component_id) = 1),
ok as (select * from held union select * from only_one),
{INSIDE.format('select volume_id, z, y, x from lab where (volume_id, component_id) in (select (volume_id, component_id) from ok)')},
anc(tree_id, n) as (select i.tree_id, f.parent from ins i join f_node f using (tree_id, n) where f.parent <> -1 union select a.tree_id, f.parent from anc a join f_node f using (tree_id, n) where f.parent <> -1),
gon as (select tree_id, n from anc where n <> 1 union select i.tree_id, i.n from ins i anti join kid k on i.tree_id = k.tree_id and i.n = k.n),
flag as (select f.*, (f.tree_id, f.n) in (select (tree_id, n) from ins) as e, (f.tree_id, f.parent) in (select (tree_id, n) from gon) as up_gone, (f.tree_id, f.parent) in (select (tree_id, n) from ins) as up_e from f_node f anti join gon g on f.tree_id = g.tree_id and f.n = g.n)
select tree_id, n, type, x, y, z, r, case when e or (up_gone and up_e) then 1 else parent end as parent, (not e) and up_gone and not up_e as orphan from flag"""


def connected(spark, d, of) -> DataFrame:
    n = nodes(spark, d).join(dims(spark, d).select(F.col("volume_id").alias("tree_id")), "tree_id", "left_semi")
    places = n.where(of).select(F.col("tree_id").alias("volume_id"), *[F.floor(a).cast("int").alias(a) for a in "zyx"]).distinct()
    return T.connect_to_soma(nodes(spark, d), V.dilate(places, dims(spark, d), offsets=ball(2)), dims(spark, d))


@register("t06_connect_to_soma", connected_sql(SOMA))
def t06(spark, d):
    return connected(spark, d, F.col("n") == 1)


SOMAS = SOMA.replace("n = 1", "({})")


@register("t06_connect_to_somas", connected_sql(SOMAS.format("n = 1 or n % 40 = 0")))
def t06b(spark, d):
    return connected(spark, d, (F.col("n") == 1) | (F.col("n") % 40 == 0))


@register("t06_connect_elsewhere", connected_sql(SOMAS.format("n = 9 or (n = 20 and tree_id % 2 = 0)")))
def t06c(spark, d):
    return connected(spark, d, (F.col("n") == 9) | ((F.col("n") == 20) & (F.col("tree_id") % 2 == 0)))


@register("t07_full_resolution", "select f.tree_id, n, 247 as type, least(greatest(x * 2, 0), 47.0)::double as x, least(greatest(48 - y * 2 - 1, 0), 47.0)::double as y, least(greatest(z * 2, 0), 23.0)::double as z, r, parent from f_node f join f_volume v on f.tree_id = v.volume_id")
def t07(spark, d):
    full = dims(spark, d).select(F.col("volume_id").alias("tree_id"), *[(F.col(c) * 2).alias(c) for c in ("depth", "height", "width")])
    return T.to_full_resolution(nodes(spark, d), full)


def tree_markers(spark, d) -> DataFrame:
    return fixture(spark, d, "f_marker").withColumnRenamed("image_id", "tree_id")


SNAPPED = """
with p as (select m.image_id as tree_id, m.ord, m.x, m.y, m.z, f.n, f.x as nx, f.y as ny, f.z as nz, (m.x - f.x) * (m.x - f.x) + (m.y - f.y) * (m.y - f.y) + (m.z - f.z) * (m.z - f.z) as d2, f.parent
  from f_marker m left join (select tree_id, n, parent, case when n = 1 then trunc(x) else x end as x, case when n = 1 then trunc(y) else y end as y, case when n = 1 then trunc(z) else z end as z from ({})) f on m.image_id = f.tree_id),
q as (select *, d2 < 100 and parent = -1 as hit from p),
r as (select *, row_number() over (partition by tree_id, ord order by case when hit then 0 when d2 < 100000 then 1 else 2 end, case when hit then n else d2 end, n) as rank from q)
select image_id as tree_id, ord, x, y, z, false as snapped from f_marker
union all select tree_id, ord, trunc(case when hit or d2 < 100000 then nx else x end), trunc(case when hit or d2 < 100000 then ny else y end), trunc(case when hit or d2 < 100000 then nz else z end), true from r where rank = 1"""


@register("t08_snap_markers", SNAPPED.format("select * from f_node"))
def t08(spark, d):
    return T.snap_markers(tree_markers(spark, d), nodes(spark, d))


@register("t08_snap_between_voxels", SNAPPED.format("select tree_id, n, parent, x + 0.75 as x, y + 0.75 as y, z + 0.75 as z from f_node"))
def t08b(spark, d):
    moved = nodes(spark, d).withColumns({a: F.col(a) + 0.75 for a in ("x", "y", "z")})
    return T.snap_markers(tree_markers(spark, d), moved)


def raster_sql(a: str, b: str) -> str:
    disc = ", ".join(str((i, j)) for i in range(-3, 4) for j in range(-3, 4) if i * i + j * j <= 9)
    put = lambda p, q: f"cast(case when s = 0 then {p} else floor((2 * {p} * s + 2 * ({q} - {p}) * t + s) / (2.0 * s)) end as int)"
    return f"""(with e as (select c.tree_id, cast(floor(c.{a}) as int) as a, cast(floor(c.{b}) as int) as b, cast(floor(u.{a}) as int) as pa, cast(floor(u.{b}) as int) as pb, greatest(abs(cast(floor(u.{a}) as int) - cast(floor(c.{a}) as int)), abs(cast(floor(u.{b}) as int) - cast(floor(c.{b}) as int))) as s from f_node c join f_node u on c.tree_id = u.tree_id and c.parent = u.n where c.n > 1 and c.parent > 0),
l as (select *, unnest(range(s + 1)) as t from e)
select tree_id, {put('a', 'pa')} as {a}, {put('b', 'pb')} as {b} from l
union select tree_id, cast(floor({a}) as int) + i, cast(floor({b}) as int) + j from f_node, (values {disc}) o(i, j) where n = 1)"""


for _plane, (_a, _b) in V.PLANES.items():
    register(f"t09_rasterize_{_plane}", f"select * from {raster_sql(_a, _b)}")(lambda spark, d, plane=_plane: T.rasterize_tree(nodes(spark, d), plane))


@register("t10_overlay", f"""with s as (select volume_id, min(intensity) as lo, max(intensity) as hi from f_voxel group by 1),
p as (select v.volume_id, y, x, max(cast(floor(cast(intensity - lo as double) / (hi - lo) * 255) as int)) as intensity from f_voxel v join s using (volume_id) group by all)
select p.volume_id, p.y, p.x, intensity, r.tree_id is not null as on_tree from p left join {raster_sql('y', 'x')} r on p.volume_id = r.tree_id and p.y = r.y and p.x = r.x where volume_id in (select tree_id from f_node)""")
def t10(spark, d):
    return T.overlay_mip(vox(spark, d), nodes(spark, d))


@register("t11_ends", "select tree_id, n, parent = -1 as head, (tree_id, n) not in (select (tree_id, parent) from f_node) as tail from f_node")
def t11(spark, d):
    return T.tree_ends(nodes(spark, d))


# ---- catalogs


def name_a(spark, d) -> DataFrame:
    return fixture(spark, d, "f_name_a")


def name_b(spark, d) -> DataFrame:
    return fixture(spark, d, "f_name_b")


def marker_files(spark, d) -> DataFrame:
    return fixture(spark, d, "f_marker_file")


@register("r01_reconcile", "select name, 'a' as side from f_name_a where name not in (select name from f_name_b) union all select name, 'b' from f_name_b where name not in (select name from f_name_a)")
def r01(spark, d):
    return R.reconcile(name_a(spark, d), name_b(spark, d))


TOKEN = "list_filter(string_split(name, '_'), lambda t: len(t) > 2 and regexp_full_match(t, 'R[0-9]+'))[1]"
NAMED = f"case when contains(name, '_P') and contains(name, '_T') and contains(name, '_R') then coalesce(cast(substr({TOKEN}, 2) as double), 1000) / 1000 end"


def flat_spacing(df: DataFrame) -> DataFrame:
    return df.select("id", "name", *[F.round(f"spacing.{a}", 6).alias(f"s{a}") for a in "zyx"])


@register("r02_spacing_from_name", f"select id, name, case when {NAMED} is not null then 1.0::double end as sz, round({NAMED}, 6) as sy, round({NAMED}, 6) as sx from f_name_a")
def r02(spark, d):
    return flat_spacing(R.spacing_from_name(name_a(spark, d)))


NUMBERED = "select *, try_cast(string_split(name, '.')[1] as {kind}) as num from f_name_n"


@register("r03_spacing_lookup", f"select id, name, 1.0::double as sz, round(coalesce(resolution / 1000, 1.0), 6) as sy, round(coalesce(resolution / 1000, 1.0), 6) as sx from ({NUMBERED.format(kind='double')}) left join f_raw_info on num = number")
def r03(spark, d):
    return flat_spacing(R.spacing_lookup(fixture(spark, d, "f_name_n"), fixture(spark, d, "f_raw_info")))


@register("r03_spacing_strict", f"select id, name, 1.0::double as sz, round(resolution / 1000, 6) as sy, round(resolution / 1000, 6) as sx from ({NUMBERED.format(kind='bigint')}) join f_raw_info on num = number")
def r03b(spark, d):
    return flat_spacing(R.spacing_lookup(fixture(spark, d, "f_name_n"), fixture(spark, d, "f_raw_info"), True))


def markers_sql(images: str = "f_name_a") -> str:
    return f"select i.id, i.name, coalesce(e.marker, n.marker) as marker from {images} i left join (select regexp_replace(name, '\\.[^.]*$', '') as st, min(name) as marker from f_marker_file group by 1) e on regexp_replace(i.name, '\\.[^.]*$', '') = e.st left join (select string_split(name, '_')[1] as k, min(name) as marker from f_marker_file group by 1) n on string_split(i.name, '_')[1] = n.k"


for _mode in ("int", "string"):
    register(f"r04_markers_{_mode}", markers_sql())(lambda spark, d, mode=_mode: R.resolve_markers(name_a(spark, d), marker_files(spark, d), mode))
for _mode, _test in ((0, "marker is null"), (1, "marker is not null"), (2, "true")):
    register(f"r05_policy_{_mode}", f"select id, name from ({markers_sql()}) where {_test}")(lambda spark, d, mode=_mode: R.soma_policy(name_a(spark, d), marker_files(spark, d), mode))


def catalog(spark, d) -> DataFrame:
    """The catalog of the first folder; spacings by names without ``_plain``, so that some are known numbers."""
    named = name_a(spark, d).withColumn("name", F.replace("name", F.lit("_plain"), F.lit("")))
    images = name_a(spark, d).select("name", F.concat(F.lit("/data/"), "name").alias("path"))
    sizes = name_a(spark, d).select("id", (F.col("id") % 7 + 10).cast("int").alias("depth"), (F.col("id") % 5 + 20).cast("int").alias("height"), (F.col("id") % 3 + 30).cast("int").alias("width"))
    spacing = R.spacing_lookup(named, fixture(spark, d, "f_raw_info"))
    return R.build_catalog(images, sizes, spacing)


CATALOG = "(select id as \"ID\", regexp_replace(name, '\\.[^.]*$', '') as full_name, 'image_' || lpad(cast(id as varchar), cast(greatest(3, length(cast(id as varchar))) as int), '0') as nnunet_name, coalesce(resolution / 1000, 1.0) as sy, cast(id % 7 + 10 as int) as depth, cast(id % 5 + 20 as int) as height, cast(id % 3 + 30 as int) as width, '/data/' || name as v3draw_path from f_name_a left join f_raw_info on try_cast(string_split(replace(name, '_plain', ''), '.')[1] as double) = number)"


@register("r06_build_catalog", f"select \"ID\", full_name, nnunet_name, round(sy, 6) as sy, depth, height, width, v3draw_path from {CATALOG}")
def r06(spark, d):
    return catalog(spark, d).select("ID", "full_name", "nnunet_name", F.round("spacing.y", 6).alias("sy"), F.col("img_size.z").alias("depth"), F.col("img_size.y").alias("height"), F.col("img_size.x").alias("width"), "v3draw_path")


def numbered_files(spark, d) -> DataFrame:
    return name_a(spark, d).select(F.concat(F.format_string("image_%03d", F.col("id") + 20), F.lit(".tif")).alias("name"))


NUMBERED = "(select 'image_' || lpad(cast(id + 20 as varchar), cast(greatest(3, length(cast(id + 20 as varchar))) as int), '0') as st from f_name_a)"


@register("r07_rename", f"select st || '.tif' as name, full_name || '.tif' as new_name from {NUMBERED} f left join {CATALOG} c on f.st = c.nnunet_name")
def r07(spark, d):
    return R.rename_by_mapping(numbered_files(spark, d), catalog(spark, d))


@register("r07_missing", f"select st || '.tif' as name from {NUMBERED} f anti join {CATALOG} c on f.st = c.nnunet_name")
def r07b(spark, d):
    return R.missing_mappings(numbered_files(spark, d), catalog(spark, d))


def twice(spark, d) -> DataFrame:
    """Files of which some ids have two."""
    return name_a(spark, d).select("name").union(marker_files(spark, d).select("name"))


TWICE = "(select name, cast(string_split(name, '_')[1] as bigint) as id from (select name from f_name_a union all select name from f_marker_file))"


@register("r08_traced_list", f"select name, id, row_number() over (partition by id order by name) > 1 as duplicate from {TWICE}")
def r08(spark, d):
    return R.traced_list(twice(spark, d))


@register("r09_keep_listed", "select id, name from f_name_a where id in (select id from f_listed)")
def r09(spark, d):
    return R.keep_listed(name_a(spark, d), fixture(spark, d, "f_listed"))


@register("r10_keep_in_both", "select id, name from f_name_a where id in (select id from f_listed) and id in (select number from f_raw_info)")
def r10(spark, d):
    return R.keep_in_both(name_a(spark, d), fixture(spark, d, "f_listed"), fixture(spark, d, "f_raw_info").select(F.col("number").alias("id")))


@register("r11_find_tree", "select a.id, a.name, case when b.name is not null then '/t/' || regexp_replace(b.name, '\\.[^.]*$', '') || '.swc' end as tree from f_name_a a left join f_name_b b on a.name = b.name")
def r11(spark, d):
    swc = F.concat(R.stem(F.col("name")), F.lit(".swc"))
    trees = name_b(spark, d).select(swc.alias("name"))
    return R.find_tree(name_a(spark, d), trees.withColumn("path", F.concat(F.lit("/t/"), "name")).union(trees.withColumn("path", F.concat(F.lit("/u/"), "name"))))


@register("r12_align_versions", "select a.name, '/0/' || a.name as v0, '/1/' || a.name as v1, '/2/' || a.name as v2 from f_name_a a join f_name_b b on a.name = b.name where a.id in (select id from f_listed)")
def r12(spark, d):
    at = lambda df, k: df.select("name", F.concat(F.lit(f"/{k}/"), "name").alias("path"))
    return R.align_versions(at(name_a(spark, d), 0), at(name_b(spark, d), 1), at(R.keep_listed(name_a(spark, d), fixture(spark, d, "f_listed")), 2))


@register("r13_pair_runs", "select a.name, a.id as id_a, b.id as id_b from f_name_a a join f_name_b b using (name)")
def r13(spark, d):
    return R.pair_runs(name_a(spark, d), name_b(spark, d))


@register("r14_stale_outputs", f"select id, name from f_name_b where name in (select name from ({markers_sql()}) where marker is not null)")
def r14(spark, d):
    return R.stale_outputs(name_b(spark, d), name_a(spark, d), marker_files(spark, d))


@register("r15_marker_names", "select id, replace(replace(name, '.marker', '.v3draw.marker'), 'v3draw.marker', 'marker') as name from f_marker_file")
def r15(spark, d):
    old = marker_files(spark, d).withColumn("name", F.regexp_replace("name", r"\.marker$", ".v3draw.marker"))
    return R.normalise_marker_names(old)


@register("r16_parse_size", f"select \"ID\", depth, height, width from {CATALOG}")
def r16(spark, d):
    return R.parse_size(S.catalog_text(catalog(spark, d))).select("ID", "depth", "height", "width")


@register("r17_first_n", "select id, name from f_name_a order by name limit 10")
def r17(spark, d):
    return R.first_n(name_a(spark, d))


@register("r18_lookup_spacing", f"select a.id, a.name, round(c.sy, 6) as xy_spacing from f_name_a a left join {CATALOG} c on a.id = c.\"ID\"")
def r18(spark, d):
    return R.lookup_spacing(name_a(spark, d), catalog(spark, d)).withColumn("xy_spacing", F.round("xy_spacing", 6))


def scratch(spark, d) -> DataFrame:
    extra = F.when(F.col("id") % 3 == 0, "_gsdt").when(F.col("id") % 3 == 1, "_ini").otherwise("")
    return name_a(spark, d).select("id", F.concat(R.stem(F.col("name")), extra, F.when(F.col("id") % 2 == 0, ".tif").otherwise(".swc")).alias("name"))


@register("r19_drop_scratch", "select id, regexp_replace(name, '\\.[^.]*$', '') || '.tif' as name from f_name_a where id % 3 = 2 and id % 2 = 0")
def r19(spark, d):
    return R.drop_scratch(scratch(spark, d))


# ---- sources and sinks


@register("s01_manifest", "select '/root/x' || (id % 5) || '/' || name as path, name, id as length from (select id, case when id % 4 = 0 then replace(name, '.tif', '_ini.tif') else replace(name, '_P01', '') end as name from f_name_a) where not contains(name, '_i') and not contains(name, '_p')")
def s01(spark, d):
    name = F.when(F.col("id") % 4 == 0, F.replace("name", F.lit(".tif"), F.lit("_ini.tif"))).otherwise(F.replace("name", F.lit("_P01"), F.lit("")))
    files = name_a(spark, d).select(F.concat(F.lit("/root/x"), (F.col("id") % 5).cast("string"), F.lit("/"), name).alias("path"), F.col("id").alias("length"))
    return S.manifest_rows(files).select("path", "name", "length")


@register("s01_scan_files", "select count(*) as n from f_volume")
def s01b(spark, d):
    path = new_path(spark, "manifest")
    dims(spark, d).repartition("volume_id").write.partitionBy("volume_id").json(path)
    found = S.scan_manifest(spark, path, ".json")
    return found.agg(F.count_distinct(F.regexp_extract("path", "volume_id=([0-9]+)", 1)).alias("n"))


LINE = "cast(n as varchar) || ' ' || type || ' ' || printf('%.3f %.3f %.3f %.3f', x, y, z, r) || ' ' || parent"


@register("s03_read_swc", "select tree_id, n, 0 as type, x, y, z, r, parent from f_node where tree_id < 3")
def s03(spark, d):
    path = new_path(spark, "swc")
    S.write_swc(nodes(spark, d).where("tree_id < 3"), path)
    found = S.read_swc(spark, f"{path}/*/*.txt")
    tree = F.regexp_extract("tree_id", "tree_id=([0-9]+)", 1).cast("long")
    return found.withColumn("tree_id", tree).drop("line")


@register("s03_read_swc_all", "select tree_id, n, 0 as type, x, y, z, r, parent from f_node")
def s03b(spark, d):
    path = new_path(spark, "swc")
    S.write_swc(nodes(spark, d), path)
    found = S.read_swc(spark, f"{path}/*/*.txt")
    tree = F.regexp_extract("tree_id", "tree_id=([0-9]+)", 1).cast("long")
    return found.withColumn("tree_id", tree).drop("line")


@register("s04_swc_lines", f"select tree_id, n, {LINE} as value from f_node")
def s04(spark, d):
    return S.swc_lines(nodes(spark, d))


@register("s04_swc_lines_shifted", "select f.tree_id, n + 100 as n, cast(n + 100 as varchar) || ' 0 ' || printf('%.3f %.3f %.3f %.3f', x, 24 - y, z, r) || ' ' || case when parent = -1 then -1 else parent + 100 end as value from f_node f join f_volume v on f.tree_id = v.volume_id")
def s04b(spark, d):
    return S.swc_lines(nodes(spark, d), 100, dims(spark, d).withColumnRenamed("volume_id", "tree_id"))


MARKER_TEXT = "printf('%.3f, %.3f, %.3f, 1, 1, , , ', x, y, z) || case when ord % 3 = 0 then '255,0,0' else '0,255,0' end"


def main_markers(spark, d) -> DataFrame:
    return fixture(spark, d, "f_marker").withColumn("main", F.col("ord") % 3 == 0)


def marker_files_at(spark, d) -> str:
    """The folder to which the markers were written, a file for each image."""
    path = new_path(spark, "markers")
    S.write_markers(main_markers(spark, d), path)
    return path


@register("s05_markers", "select image_id, row_number() over (partition by image_id order by ord) - 1 as ord, x / 2 as x, y / 2 as y, z / 2 as z, 1.0::double as r, case when ord % 3 = 0 then 255 else 0 end as red from f_marker")
def s05(spark, d):
    found = S.read_markers(spark, f"{marker_files_at(spark, d)}/*/*.txt", 0.5)
    image = F.regexp_extract("image_id", "image_id=([0-9]+)", 1).cast("long")
    return found.select(image.alias("image_id"), F.col("ord").cast("long").alias("ord"), "x", "y", "z", "r", F.col("color.r").alias("red"))


@register("s06_marker_lines", f"select image_id, ord, {MARKER_TEXT} as value from f_marker")
def s06(spark, d):
    """The lines as the files hold them, numbered again by the markers' order."""
    text = spark.read.text(f"{marker_files_at(spark, d)}/*/*.txt", wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), "image_id=([0-9]+)", 1).cast("long").alias("image_id"), F.posexplode(F.split("value", "\n")).alias("_line", "value"))
    order = F.row_number().over(Window.partitionBy("image_id").orderBy("ord")) - 1
    numbered = main_markers(spark, d).select("image_id", "ord").withColumn("_line", order)
    return text.where("value <> ''").join(numbered, ["image_id", "_line"]).select("image_id", "ord", "value")


@register("s07_catalog_csv", f"select \"ID\", full_name, nnunet_name, '(' || depth || ', ' || height || ', ' || width || ')' as img_size, v3draw_path from {CATALOG}")
def s07(spark, d):
    path = new_path(spark, "catalog")
    S.write_catalog(catalog(spark, d), path)
    return S.read_catalog(spark, path).drop("spacing")


@register("s08_key_list", "select id from f_listed")
def s08(spark, d):
    path = new_path(spark, "keys")
    fixture(spark, d, "f_listed").select(F.col("id").alias("ID")).write.option("header", "true").csv(path)
    return S.read_key_list(spark, path)


@register("s09_spacing_sidecar", f"select nnunet_name as name, '{{\"spacing\":[1.0,' || cast(sy as varchar) || ',' || cast(sy as varchar) || ']}}' as value from {CATALOG}")
def s09(spark, d):
    path = new_path(spark, "sidecars")
    S.write_spacing(catalog(spark, d), path)
    return spark.read.text(path).select("name", "value")


@register("s10_predecessor_store", "select volume_id, z, y, x, intensity % 27 as pred_code from f_voxel")
def s10(spark, d):
    path = new_path(spark, "predecessors")
    S.save_predecessor(vox(spark, d).withColumn("pred_code", F.col("intensity") % 27), path)
    return S.load_predecessor(spark, path)


@register("s11_path_store", "select volume_id, z as path_id, y as step, z, y, x from f_voxel where intensity >= 240")
def s11(spark, d):
    path = new_path(spark, "paths")
    S.save_paths(mask(spark, d, 240).select("volume_id", F.col("z").alias("path_id"), F.col("y").alias("step"), "z", "y", "x"), path)
    return S.load_paths(spark, path).withColumn("volume_id", F.col("volume_id").cast("long"))


@register("s12_pending", "select id, name from f_name_a where name not in (select name from f_name_b) or id not in (select id from f_listed)")
def s12(spark, d):
    return S.pending(name_a(spark, d), name_b(spark, d), R.keep_listed(name_a(spark, d), fixture(spark, d, "f_listed")))


@register("s12_stream", "select id, name from f_name_a where id not in (select id from f_listed)")
def s12b(spark, d):
    from dendrovox.streaming.incremental import process_new

    source, sink, done = (new_path(spark, n) for n in ("arrivals", "processed", "progress"))
    name_a(spark, d).write.parquet(source)
    listed = materialize(fixture(spark, d, "f_listed"), "listed")

    def run(rows: DataFrame, batch: int) -> None:
        rows.join(listed, "id", "left_anti").write.mode("overwrite").parquet(f"{sink}/batch={batch}")

    process_new(spark, source, "id long, name string", run, done).awaitTermination()
    return spark.read.parquet(sink).select("id", "name")
