"""Registered queries of the component, geodesic and scoring operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from dendrovox.functions.grid import AXES, ball, cross, decode_neighbor, encode_neighbor, neighbours
from dendrovox.operators import components as D
from dendrovox.operators import geodesic as G
from dendrovox.operators import scoring as L
from dendrovox.operators import voxels as V
from dendrovox.plans.fixtures import fixture
from dendrovox.plans.iterate import materialize
from dendrovox.plans.voxel_queries import IN, M, centers, dims, mask, moved_sql, offsets_sql, r6, register, vox

DIMS = "z * 576 + y * 24 + x"


def place_cols(k: str = "k") -> str:
    return f"cast({k} // 576 as int) as z, cast({k} // 24 % 24 as int) as y, cast({k} % 24 as int) as x"


def comp_sql(src: str, conn: int, name: str = "lab") -> str:
    """CTEs that end in ``name(volume_id, z, y, x, k, component_id)``, for a leading WITH RECURSIVE."""
    return f"""{name}_n as materialized (select volume_id, z, y, x, {DIMS} as k from ({src})),
{name}_h as materialized (select volume_id, k as a, z + dz as z, y + dy as y, x + dx as x from {name}_n, {offsets_sql(neighbours(conn))}),
{name}_e as materialized (select h.volume_id as v, h.a, b.k as b from {name}_h h join {name}_n b using (volume_id, z, y, x)),
{name}_c(v, k, c) using key (v, k) as (select volume_id, k, k from {name}_n union
  select v, k, min(c) from (
    select e.v, e.b as k, p.c from {name}_c p join {name}_e e on p.v = e.v and p.k = e.a join recurring.{name}_c r on r.v = e.v and r.k = e.b where p.c < r.c
    union all select r.v, r.k, q.c from recurring.{name}_c r join recurring.{name}_c q on q.v = r.v and q.k = r.c where q.c < r.c) group by v, k),
{name} as materialized (select n.*, cast(c.c as bigint) as component_id from {name}_n n join {name}_c c on n.volume_id = c.v and n.k = c.k)"""


for _conn, _least in ((6, 128), (26, 200)):
    register(f"d01_components_{_conn}", f"with recursive {comp_sql(M.format(_least), _conn)} select volume_id, z, y, x, component_id from lab")(
        lambda spark, d, conn=_conn, least=_least: D.connected_components(mask(spark, d, least), dims(spark, d), conn)
    )

LARGEST = "(select volume_id, arg_min(component_id, (-n) * 100000 + component_id) as component_id from (select volume_id, component_id, count(*) as n from {0} group by all) group by volume_id)"


@register("d02_largest", f"with recursive {comp_sql(M.format(110), 6)} select volume_id, z, y, x from lab join {LARGEST.format('lab')} using (volume_id, component_id)")
def d02(spark, d):
    return D.largest_component(mask(spark, d, 110), dims(spark, d))


@register("d03_remove_small", f"with recursive {comp_sql(M.format(128), 6)} select volume_id, z, y, x, component_id from lab where (volume_id, component_id) in (select (volume_id, component_id) from lab group by volume_id, component_id having count(*) >= 20)")
def d03(spark, d):
    return D.remove_small(mask(spark, d, 128), dims(spark, d), 20)


@register("d04_adaptive", f"""with recursive {comp_sql(M.format(150), 6)},
s as (select volume_id, component_id, count(*) as n, row_number() over (partition by volume_id order by count(*) desc, component_id) as r from lab group by volume_id, component_id),
t as (select volume_id, min(5 * pow(2, k)) filter (5 * pow(2, k) > fourth) as least from (select volume_id, coalesce(max(n) filter (r = 4), 0) as fourth from s group by 1), range(40) q(k) group by 1)
select volume_id, z, y, x, component_id from lab join s using (volume_id, component_id) join t using (volume_id) where n >= least""")
def d04(spark, d):
    return D.adaptive_remove_small(mask(spark, d, 150), dims(spark, d), 5)


@register("d05_component_of", f"with recursive {comp_sql(M.format(200), 26)} select l.volume_id, l.z, l.y, l.x from lab l join (select lab.volume_id, component_id from lab join f_source s on lab.volume_id = s.volume_id and lab.k = s.k) c using (volume_id, component_id)")
def d05(spark, d):
    return D.component_of(mask(spark, d, 200), centers_as_places(spark, d), dims(spark, d))


def centers_as_places(spark, d):
    return centers(spark, d).select("volume_id", *[F.col(f"c{a}").cast("int").alias(a) for a in AXES])


@register("d06_count", f"with recursive {comp_sql(M.format(200), 26)} select volume_id, count(distinct component_id) as n_components, count(distinct component_id) = 1 as single from lab group by 1")
def d06(spark, d):
    return D.component_count(mask(spark, d, 200), dims(spark, d), 26)


MEAN = "round(avg(z), 6) as cz, round(avg(y), 6) as cy, round(avg(x), 6) as cx"


def rounded(df, columns):
    return df.withColumns({c: r6(c) for c in columns})


@register("d07_centroid_largest", f"with recursive {comp_sql(M.format(200), 26)} select volume_id, {MEAN} from lab join {LARGEST.format('lab')} using (volume_id, component_id) group by 1")
def d07(spark, d):
    return rounded(D.centroid(mask(spark, d, 200), dims(spark, d)), ["cz", "cy", "cx"])


@register("d07_centroid_first", f"with recursive {comp_sql(M.format(200), 26)} select volume_id, {MEAN} from lab join (select volume_id, min(component_id) as component_id from lab group by 1) using (volume_id, component_id) group by 1")
def d07b(spark, d):
    return rounded(D.centroid(mask(spark, d, 200), dims(spark, d), "first"), ["cz", "cy", "cx"])


def bg_sql(src: str) -> str:
    """CTEs that end in ``bg(volume_id, z, y, x, dist)``: weighted distance of the foreground from the background."""
    return f"""bg_n as materialized (select volume_id, z, y, x, {DIMS} as k from ({src})),
bg_s as materialized (select distinct m.volume_id, m.z * 576 + m.y * 24 + m.x as k from ({moved_sql(src, neighbours(26))}) m anti join bg_n n on m.volume_id = n.volume_id and m.z = n.z and m.y = n.y and m.x = n.x where m.{IN.replace(' and ', ' and m.').replace('between 0 and m.', 'between 0 and ')}),
bg_e as materialized (select a.volume_id as v, a.k as a, b.k as b, w from (select volume_id, z, y, x, k from bg_n union all select volume_id, {place_cols()}, k from bg_s) a, (select *, sqrt(dz * dz * 2.25 + dy * dy + dx * dx) as w from {offsets_sql(neighbours(26))}), bg_n b where a.volume_id = b.volume_id and b.z = a.z + dz and b.y = a.y + dy and b.x = a.x + dx),
bg_d(v, k, dist) using key (v, k) as (select volume_id, k, cast(0 as double) from bg_s union
  select q.v, q.k, q.dist from (select e.v, e.b as k, min(p.dist + w) as dist from bg_d p join bg_e e on p.v = e.v and p.k = e.a group by 1, 2) q left join recurring.bg_d r on r.v = q.v and r.k = q.k where r.k is null or q.dist < r.dist - 1e-9),
bg as materialized (select n.volume_id, n.z, n.y, n.x, d.dist from bg_n n join bg_d d on n.volume_id = d.v and n.k = d.k)"""


@register("d08_distance_to_background", f"with recursive {bg_sql(M.format(60))} select volume_id, z, y, x, round(dist, 6) as dist from bg")
def d08(spark, d):
    return D.distance_to_background(mask(spark, d, 60), dims(spark, d)).withColumn("dist", r6("dist"))


def opened_sql(src: str, name: str) -> str:
    """CTEs that end in ``name(volume_id, z, y, x)``: the ten openings by sampled balls, written from their definition."""
    out = [f"{name}_0 as materialized ({src})", comp_sql(f"select * from {name}_0", 6, f"{name}_l")]
    out.append(f"{name}_s as materialized (select volume_id, least(max(z) - min(z), max(y) - min(y), max(x) - min(x)) + 1 as d from {name}_l join {LARGEST.format(name + '_l')} using (volume_id, component_id) group by 1)")
    for i in range(10):
        t = f"{name}_{i}"
        spot = lambda c: f"(({c} * (2 * r / (n - 1)) - r) * ({c} * (2 * r / (n - 1)) - r))"
        out.append(f"{t}r as materialized (select volume_id, cast(d * {10 - i} as double) / 10 / 2 as r from {name}_s)")
        out.append(f"{t}b as materialized (select r, a as dz, b as dy, c as dx, count(*) over (partition by r) as n_all from (select distinct r, cast(floor(2 * r + 1) as int) as n from {t}r where r >= 1) q, lateral (select unnest(range(n)) as a), lateral (select unnest(range(n)) as b), lateral (select unnest(range(n)) as c) where {spot('c')} + {spot('b')} + {spot('a')} <= r * r)")
        out.append(f"{t}e as materialized (select volume_id, r, m.z - dz as z, m.y - dy as y, m.x - dx as x from {t} m join {t}r using (volume_id) join {t}b using (r) group by volume_id, r, m.z - dz, m.y - dy, m.x - dx having count(*) = max(n_all))")
        out.append(f"{t}o as materialized (select distinct volume_id, e.z + dz as z, e.y + dy as y, e.x + dx as x from {t}e e join {t}b using (r))")
        out.append(f"{name}_{i + 1} as materialized (select * from {t}o union all select volume_id, z, y, x from {t} where volume_id not in (select volume_id from {t}o))")
    return ",\n".join([*out, f"{name} as (select * from {name}_10)"])


def largest_sql(src: str, conn: int, name: str) -> str:
    """CTEs that end in ``name(volume_id, z, y, x)``: the largest component."""
    return f"{comp_sql(src, conn, name + '_l')}, {name} as materialized (select volume_id, z, y, x from {name}_l join {LARGEST.format(name + '_l')} using (volume_id, component_id))"


def cleaned_sql(src: str, name: str) -> str:
    return f"{opened_sql(src, name + '_p')}, {largest_sql(f'select * from {name}_p', 6, name)}"


def core_sql(field: str, name: str, share: float = 0.5) -> str:
    """CTE ``name``: the field above a share of its maximum, dilated five times, within the mask."""
    core = f"select volume_id, z, y, x from ({field}) join (select volume_id, max(dist) as top from ({field}) group by 1) using (volume_id) where dist > {share} * top + 1e-9"
    return f"{name} as materialized (select m.volume_id, m.z, m.y, m.x from ({moved_sql(core, cross(5))}) q join ({M.format(60)}) m on q.volume_id = m.volume_id and q.z = m.z and q.y = m.y and q.x = m.x)"


SOMA = f"{bg_sql(M.format(60))}, {core_sql('select * from bg', 'core')}, {largest_sql('select * from core', 6, 'reg')}, {cleaned_sql('select * from reg', 'soma')}"
CENTERED = f"{SOMA}, {largest_sql('select * from soma', 26, 'mid')}"


@register("d09_soma_region", f"with recursive {SOMA} select volume_id, z, y, x from soma")
def d09(spark, d):
    return D.soma_region(mask(spark, d, 60), dims(spark, d))


@register("d10_soma_center", f"with recursive {CENTERED} select volume_id, {MEAN} from f_volume left join mid using (volume_id) group by 1")
def d10(spark, d):
    return rounded(D.soma_center(mask(spark, d, 60), dims(spark, d)), ["cz", "cy", "cx"])


CORE = "select volume_id, z, y, x from bg join (select volume_id, max(dist) as top from bg group by 1) using (volume_id) where dist > 0.95 * top + 1e-9"


@register("d11_simple_soma_center", f"with recursive {bg_sql(M.format(60))}, {comp_sql(CORE, 26)} select volume_id, {MEAN} from lab join {LARGEST.format('lab')} using (volume_id, component_id) group by 1")
def d11(spark, d):
    return rounded(D.simple_soma_center(mask(spark, d, 60), dims(spark, d)), ["cz", "cy", "cx"])


def volume_markers(spark, d):
    return fixture(spark, d, "f_marker").withColumnRenamed("image_id", "volume_id")


#: Objects are told apart by volume times 10,000 plus their first voxel.
KEPT = f"""{comp_sql('select * from core', 6, 'ob')},
obs as (select volume_id, component_id, count(*) as n, row_number() over (partition by volume_id order by count(*) desc, component_id) as r from ob group by volume_id, component_id),
obt as (select volume_id, min(100 * pow(2, k)) filter (100 * pow(2, k) > fourth) as least from (select volume_id, coalesce(max(n) filter (r = 4), 0) as fourth from obs group by 1), range(40) q(k) group by 1),
kept as materialized (select volume_id * 10000 + component_id as volume_id, z, y, x from ob join obs using (volume_id, component_id) join obt using (volume_id) where n >= least)"""
GROWN = ",\n".join(f"gr{k + 1} as materialized (select volume_id, z, y, x from gr{k} where volume_id not in (select volume_id from gr{k} group by 1 having count(*) < 100) union all select * from ({moved_sql(f'select * from gr{k} where volume_id in (select volume_id from gr{k} group by 1 having count(*) < 100)', cross(1))}) where {IN})" for k in range(12))
ALL_MARKERS = "select image_id as volume_id, cast(floor(z / 2) as int) as z, cast(floor(y / 2) as int) as y, cast(floor(x / 2) as int) as x from f_marker"


@register("d12_multi_soma_region", f"""with recursive {bg_sql(M.format(60))}, {core_sql('select * from bg', 'core')}, {KEPT}, {cleaned_sql('select * from kept', 'som')},
gr0 as (select * from som), {GROWN}, done as materialized (select distinct volume_id // 10000 as volume_id, z, y, x from gr12)
select * from done union select * from ({moved_sql(f'select c.* from ({ALL_MARKERS}) c join (select volume_id from f_volume) using (volume_id) anti join done m on c.volume_id = m.volume_id and c.z = m.z and c.y = m.y and c.x = m.x', ball(5))}) where {IN}""")
def d12(spark, d):
    return D.multi_soma_region(mask(spark, d, 60), volume_markers(spark, d), dims(spark, d))


MARKED = "select bg.* from bg join (select image_id as volume_id, floor(arg_min(z, ord) / 2) as mz, floor(arg_min(y, ord) / 2) as my, floor(arg_min(x, ord) / 2) as mx from f_marker group by 1) using (volume_id) where (z - mz) * (z - mz) + (y - my) * (y - my) + (x - mx) * (x - mx) <= {0} and dist > 0"


@register("d13_main_soma_region", f"with recursive {bg_sql(M.format(60))}, near as materialized ({MARKED.format(81)}), {core_sql('select * from near', 'core')}, {largest_sql('select * from core', 6, 'reg')}, {cleaned_sql('select * from reg', 'soma')} select volume_id, z, y, x from soma")
def d13(spark, d):
    first = volume_markers(spark, d).groupBy("volume_id").agg(F.min_by(F.struct("z", "y", "x"), "ord").alias("m")).select("volume_id", "m.*")
    return D.main_soma_region(mask(spark, d, 60), first, dims(spark, d), 9)


@register("d14_soma_markers", f"""with recursive {comp_sql(M.format(240), 6)},
c as (select volume_id, component_id, avg(z) as cz, 24 - avg(y) - 1 as cy, avg(x) as cx from lab group by all),
m as (select image_id as volume_id, floor(arg_min(z, ord) / 2) as mz, floor(arg_min(y, ord) / 2) as my, floor(arg_min(x, ord) / 2) as mx from f_marker group by 1),
r as (select c.*, row_number() over (partition by volume_id order by (cz - mz) * (cz - mz) + (cy - my) * (cy - my) + (cx - mx) * (cx - mx) nulls last, component_id) as rank from c left join m using (volume_id))
select volume_id, component_id, round(cx, 6) as x, round(cy, 6) as y, round(cz, 6) as z, rank = 1 as main from r""")
def d14(spark, d):
    return rounded(D.soma_markers(mask(spark, d, 240), volume_markers(spark, d), dims(spark, d)), ["x", "y", "z"])


@register("d14_soma_markers_single", f"""with recursive {comp_sql(M.format(240), 6)},
c as (select volume_id, component_id, avg(z) as cz, 24 - avg(y) as cy, avg(x) as cx from lab group by all)
select volume_id, component_id, round(cx, 6) as x, round(cy, 6) as y, round(cz, 6) as z, row_number() over (partition by volume_id order by component_id) = 1 as main from c""")
def d14b(spark, d):
    return rounded(D.soma_markers(mask(spark, d, 240), None, dims(spark, d)), ["x", "y", "z"])


@register("g01_encode", f"select volume_id, z, y, x, (z % 3) * 9 + (y % 3) * 3 + x % 3 as code, z % 3 - 1 as dz, y % 3 - 1 as dy, x % 3 - 1 as dx from f_voxel")
def g01(spark, d):
    v = vox(spark, d).select("volume_id", *AXES)
    coded = v.withColumn("code", encode_neighbor(F.col("z") % 3 - 1, F.col("y") % 3 - 1, F.col("x") % 3 - 1))
    return coded.select("*", *decode_neighbor(F.col("code")))


def geo_sql(src: str, conn: int = 26, sources: str = "select volume_id, k from f_source", name: str = "geo") -> str:
    """CTEs that end in ``name(volume_id, z, y, x, k, n_face, n_edge, n_corner, dist)``."""
    g = name
    return f"""{g}_n as materialized (select volume_id, z, y, x, {DIMS} as k from ({src})),
{g}_o as (select *, abs(dz) + abs(dy) + abs(dx) as kind from {offsets_sql(neighbours(conn))}),
{g}_a as materialized (select * from {g}_n union select volume_id, {place_cols()}, k from ({sources})),
{g}_e as materialized (select a.volume_id as v, a.k as a, b.k as b, kind from {g}_a a, {g}_o, {g}_n b where a.volume_id = b.volume_id and b.z = a.z + dz and b.y = a.y + dy and b.x = a.x + dx),
{g}_d(v, k, n1, n2, n3, dist) using key (v, k) as (select volume_id, cast(k as bigint), 0, 0, 0, cast(0 as double) from ({sources}) union
  select q.v, q.k, q.s.n1, q.s.n2, q.s.n3, q.s.dist from (
    select v, k, arg_min({{'n1': n1, 'n2': n2, 'n3': n3, 'dist': n1 + n2 * sqrt(2) + n3 * sqrt(3)}}, n1 + n2 * sqrt(2) + n3 * sqrt(3)) as s
    from (select e.v, cast(e.b as bigint) as k, p.n1 + cast(kind = 1 as int) as n1, p.n2 + cast(kind = 2 as int) as n2, p.n3 + cast(kind = 3 as int) as n3 from {g}_d p join {g}_e e on p.v = e.v and p.k = e.a)
    group by v, k) q left join recurring.{g}_d r on r.v = q.v and r.k = q.k where r.k is null or q.s.dist < r.dist),
{g} as materialized (select v as volume_id, {place_cols()}, k, n1 as n_face, n2 as n_edge, n3 as n_corner, dist from {g}_d)"""


def pred_sql(conn: int = 26, name: str = "geo") -> str:
    """CTE ``pre``: the field with ``pred_code`` and the predecessor's index ``p`` (null: none)."""
    g = name
    return f"""{g}_m as materialized (select b.volume_id, b.k, arg_min({{'code': (dz + 1) * 9 + (dy + 1) * 3 + dx + 1, 'p': a.k}}, {{'d': a.dist, 'z': a.z, 'y': a.y, 'x': a.x}}) as s
  from {g} a, {g}_o, {g} b where a.volume_id = b.volume_id and b.z = a.z + dz and b.y = a.y + dy and b.x = a.x + dx
  and b.n_face = a.n_face + cast(kind = 1 as int) and b.n_edge = a.n_edge + cast(kind = 2 as int) and b.n_corner = a.n_corner + cast(kind = 3 as int) group by 1, 2),
pre as materialized (select {g}.*, coalesce(m.s.code, -1) as pred_code, m.s.p as p from {g} left join {g}_m m using (volume_id, k))"""


def field(spark, d, least: int = 200, conn: int = 26):
    return G.geodesic_distance(mask(spark, d, least), centers_as_places(spark, d), conn)


def pred(spark, d, least: int = 200, conn: int = 26):
    return materialize(G.predecessor(field(spark, d, least, conn), conn), "predecessors")


for _conn in (6, 26):
    register(f"g02_distance_{_conn}", f"with recursive {geo_sql(M.format(200), _conn)} select volume_id, z, y, x, n_face, n_edge, n_corner, round(dist, 6) as dist from geo")(
        lambda spark, d, conn=_conn: field(spark, d, 200, conn).withColumn("dist", r6("dist"))
    )


@register("g03_predecessor", f"with recursive {geo_sql(M.format(200))}, {pred_sql()} select volume_id, z, y, x, n_face, n_edge, n_corner, round(dist, 6) as dist, pred_code from pre")
def g03(spark, d):
    return pred(spark, d).withColumn("dist", r6("dist"))


@register("g04_sparse", f"with recursive {geo_sql(M.format(200))}, {pred_sql()} select volume_id, z, y, x, pred_code from pre where pred_code <> -1")
def g04(spark, d):
    return G.predecessor_sparse(pred(spark, d))


@register("g04_dense", f"with recursive {geo_sql(M.format(200))}, {pred_sql()} select g.volume_id, cast(g.k // 576 as int) as z, cast(g.k // 24 % 24 as int) as y, cast(g.k % 24 as int) as x, coalesce(pred_code, -1) as pred_code from (select volume_id, q.k from f_volume, range(6912) q(k)) g left join pre on g.volume_id = pre.volume_id and g.k = pre.k")
def g04b(spark, d):
    return G.predecessor_dense(G.predecessor_sparse(pred(spark, d)), dims(spark, d))


def drawn_sql(src: str, m: int, seed: int = 0, name: str = "st") -> str:
    return f"{name} as materialized (select * from (select *, cast(row_number() over (partition by volume_id order by md5('{seed}:' || z || ':' || y || ':' || x), z, y, x) as int) as path_id from ({src})) where path_id <= {m})"


def trace_sql(starts: str = "st", most: int = 400) -> str:
    """CTE ``tr(volume_id, path_id, step, k)``: walks over ``pre``."""
    return f"""tr(volume_id, path_id, step, k) as (select volume_id, path_id, 0, cast({DIMS} as bigint) from {starts} union all
  select t.volume_id, t.path_id, t.step + 1, p.p from tr t join pre p on t.volume_id = p.volume_id and t.k = p.k where p.p is not null and t.step < {most})"""


@register("g05_trace", f"with recursive {geo_sql(M.format(200))}, {pred_sql()}, {drawn_sql('select volume_id, z, y, x from pre', 20)}, {trace_sql()} select volume_id, path_id, step, {place_cols()} from tr")
def g05(spark, d):
    p = pred(spark, d)
    return G.trace_paths(p, G.sample_points(p, 20))


@register("g05_trace_capped", f"with recursive {geo_sql(M.format(200))}, {pred_sql()}, {drawn_sql('select volume_id, z, y, x from pre', 20)}, {trace_sql(most=3)} select volume_id, path_id, step, {place_cols()} from tr")
def g05b(spark, d):
    p = pred(spark, d)
    return G.trace_paths(p, G.sample_points(p, 20), 3)


@register("g06_sample", f"with {drawn_sql(M.format(200), 25, 7)} select volume_id, z, y, x, path_id from st")
def g06(spark, d):
    return G.sample_points(mask(spark, d, 200), 25, 7)


SPARSE = "select volume_id, z, y, x from pre where pred_code <> -1"
FULL = f"{SPARSE} and volume_id in (select volume_id from pre where pred_code <> -1 group by 1 having count(*) >= 5)"
SAMPLED = f"with recursive {geo_sql(M.format(200))}, {pred_sql()}, {drawn_sql(FULL, 5, 1)}, {trace_sql()}"


@register("g07_sample_paths", f"{SAMPLED} select volume_id, path_id, step, {place_cols()} from tr")
def g07(spark, d):
    return G.sample_paths(pred(spark, d), 5, 1)


@register("g08_fmm_distance", f"with recursive {geo_sql(M.format(220))} select volume_id, z, y, x, round(dist, 6) as dist from geo")
def g08(spark, d):
    return G.fmm_distance(mask(spark, d, 220), centers_as_places(spark, d)).select("volume_id", *AXES, r6("dist").alias("dist"))


@register("g09_path_tree", f"with recursive {geo_sql(M.format(128), 6)}, {pred_sql()}, tree_st as (select volume_id, z || ',' || y || ',' || x as path_id, z, y, x from pre), {trace_sql('tree_st', 100000)} select volume_id, path_id, step, {place_cols()} from tr")
def g09(spark, d):
    return G.paths_of(G.path_tree(mask(spark, d, 128), centers_as_places(spark, d), 6))


@register("g10_streamline")
def g10(spark, d):
    f = field(spark, d, 60)
    full = materialize(V.dense(f, dims(spark, d), "dist"), "dense")
    starts = G.sample_points(f, 3).select("volume_id", "path_id", *AXES)
    return G.streamline(full, starts, centers_as_places(spark, d))


SINGLE = "select volume_id, z, y, x from lab where volume_id in (select volume_id from lab group by 1 having count(distinct component_id) = 1)"


@register("g11_batch_predecessor", f"with recursive {comp_sql(M.format(60), 26)}, {geo_sql(SINGLE, 26, 'select volume_id, k from f_source where volume_id in (select volume_id from lab group by 1 having count(distinct component_id) = 1)')}, {pred_sql()} select volume_id, volume_id % 2 as batch_idx, 0 as channel_idx, z, y, x, pred_code from pre")
def g11(spark, d):
    keyed = lambda df: df.withColumn("batch_idx", F.col("volume_id") % 2).withColumn("channel_idx", F.lit(0))
    keys = ("volume_id", "batch_idx", "channel_idx")
    return G.batch_predecessor(keyed(mask(spark, d, 60)), keyed(centers_as_places(spark, d)), dims(spark, d), keys).select(*keys, *AXES, "pred_code")


MIDDLE = "select volume_id, cast(floor(avg(z)) as int) * 576 + cast(floor(avg(y)) as int) * 24 + cast(floor(avg(x)) as int) as k from mid group by 1"


@register("g12_volume_predecessors", f"with recursive {CENTERED}, src as materialized ({MIDDLE}), {geo_sql(M.format(60), 26, 'select volume_id, k from src')}, {pred_sql()} select volume_id, z, y, x, pred_code from pre where pred_code <> -1")
def g12(spark, d):
    return G.volume_predecessors(mask(spark, d, 60), dims(spark, d))


@register("g13_paths_to_swc", f"""{SAMPLED},
w as (select volume_id, path_id, max(step) over (partition by volume_id, path_id) - step as f, {place_cols()} from tr),
num as (select *, row_number() over (partition by volume_id order by path_id, f) + 1 as n from w where f > 0)
select volume_id, n, 247 as type, x, y, z, 1.0::double as r, case when f = 1 then 1 else n - 1 end as parent from num
union all select volume_id, 1, 247, x, y, z, 1.0::double, -1 from w where f = 0 and path_id = 1""")
def g13(spark, d):
    return G.paths_to_swc(G.sample_paths(pred(spark, d), 5, 1))


@register("g14_paths_on_mip", f"{SAMPLED} select volume_id, path_id, step, cast(k // 24 % 24 as int) as y, cast(k % 24 as int) as x from tr where path_id <= 3")
def g14(spark, d):
    return G.paths_on_mip(G.sample_paths(pred(spark, d), 5, 1), 3)


@register("g15_source_of_paths", f"with recursive {geo_sql(M.format(200))}, {pred_sql()} select volume_id, z, y, x from pre where pred_code = -1")
def g15(spark, d):
    p = pred(spark, d)
    starts = p.select("volume_id", linear_fixed().alias("path_id"), *AXES)
    return G.source_of_paths(G.trace_paths(p, starts))


def linear_fixed():
    return F.col("z") * 576 + F.col("y") * 24 + F.col("x")


WALK = "tm as (select t.*, coalesce(p.pred, 0) as seg, max(case when coalesce(p.pred, 0) < 0.5 then 1 else 0 end) over (partition by t.volume_id, path_id order by step desc rows between unbounded preceding and current row) as from_break from tr t left join f_pair p on t.volume_id = p.volume_id and t.k = p.z * 576 + p.y * 24 + p.x)"


@register("l01_path_masks", f"{SAMPLED}, {WALK} select volume_id, path_id, step, {place_cols()}, round(seg, 6) as seg, from_break from tm")
def l01(spark, d):
    paths = G.sample_paths(pred(spark, d), 5, 1)
    return L.path_masks(paths, fixture(spark, d, "f_pair"), 0.5, "pred").withColumn("seg", r6("seg"))


SEG = "select volume_id, z, y, x from f_pair where pred >= 0.5"
FOUND = "select l.volume_id, l.z, l.y, l.x from lab l join (select lab.volume_id, component_id from lab join f_source s on lab.volume_id = s.volume_id and lab.k = s.k) c using (volume_id, component_id)"
NEAR = f"select * from ({moved_sql(FOUND, cross(3))}) where {IN}"
MISSED = f"select m.volume_id, m.z, m.y, m.x from ({M.format(200)}) m anti join ({NEAR}) q on m.volume_id = q.volume_id and m.z = q.z and m.y = q.y and m.x = q.x"


def pairs(spark, d):
    return fixture(spark, d, "f_pair").withColumn("seg", F.col("pred"))


#: A segmentation that is dense in every other volume and sparse in the rest; the ground truth is alike in all.
SPARSE_SEG = "select *, case when volume_id % 2 = 1 or pred >= 0.85 then pred else 0 end as seg from f_pair"
FIT = f"fit as materialized (select volume_id from ({SPARSE_SEG}) group by 1 having sum(seg) <= 0.05 * 12 * 24 * 24)"
SEG_WALK = f"tm as (select t.*, coalesce(p.pred, 0) as pred, max(case when coalesce(p.seg, 0) < 0.5 then 1 else 0 end) over (partition by t.volume_id, path_id order by step desc rows between unbounded preceding and current row) as from_break from tr t left join ({SPARSE_SEG}) p on t.volume_id = p.volume_id and t.k = p.z * 576 + p.y * 24 + p.x)"


def alternating(spark, d):
    """The pairs with the segmentation of ``SPARSE_SEG``."""
    return fixture(spark, d, "f_pair").withColumn("seg", F.when((F.col("volume_id") % 2 == 1) | (F.col("pred") >= 0.85), F.col("pred")).otherwise(0.0))


@register("l02_path_loss", f"""with recursive {FIT}, {comp_sql(f'select volume_id, z, y, x from ({SPARSE_SEG}) where seg >= 0.5 and volume_id in (select volume_id from fit)', 26)}, {geo_sql(M.format(200))}, {pred_sql()}, {drawn_sql(MISSED, 10)}, {trace_sql()}, {SEG_WALK},
per as (select volume_id, path_id, (sum(greatest(0.5 - pred, 0)) + 1e-6) * (sum((1 - pred) * from_break) + 1e-6) / (0.5 * count(*) * count(*)) as part from tm group by 1, 2),
los as (select volume_id, sum(part) as loss from per group by 1)
select v.volume_id, round(coalesce(case when s.k > 0 and v.volume_id in (select volume_id from fit) then loss end, 0), 6) as loss from f_volume v left join los using (volume_id) left join f_source s using (volume_id)""")
def l02(spark, d):
    return L.path_loss(alternating(spark, d), pred(spark, d), centers_as_places(spark, d), dims(spark, d)).withColumn("loss", r6("loss"))


@register("l02_path_loss_guard", f"with {FIT} select volume_id, true as none from f_volume where volume_id not in (select volume_id from fit)")
def l02b(spark, d):
    """Volumes that the density guard alone takes out: their loss is 0, and is not without the guard."""
    seg, p = alternating(spark, d), pred(spark, d)
    loss = lambda most, name: L.path_loss(seg, p, centers_as_places(spark, d), dims(spark, d), max_density=most).withColumnRenamed("loss", name)
    held = V.foreground_density(seg.where("seg > 0"), dims(spark, d)).select("volume_id")
    sums = seg.groupBy("volume_id").agg(F.sum("seg").alias("_s")).join(dims(spark, d), "volume_id").where("_s > 0.05 * depth * height * width")
    return held.join(sums, "volume_id", "left_semi").join(loss(0.05, "kept"), "volume_id").select("volume_id", (F.col("kept") == 0).alias("none"))


def tiles(spark, d):
    return materialize(V.tile(fixture(spark, d, "f_pair")), "tiles")


@register("l03_barcode")
def l03(spark, d):
    return L.h0_barcode(tiles(spark, d), "pred")


@register("l04_bottleneck")
def l04(spark, d):
    t = tiles(spark, d)
    return L.bottleneck(L.h0_barcode(t, "gt"), L.h0_barcode(t, "pred"))


@register("l05_topology_loss")
def l05(spark, d):
    return L.topology_loss(fixture(spark, d, "f_pair"), dims(spark, d))


@register("v10_progressive_open", f"with recursive {opened_sql(M.format(60), 'op')} select volume_id, z, y, x from op")
def v10(spark, d):
    return V.progressive_open(mask(spark, d, 60), dims(spark, d))


@register("v15_grow_to_size", f"with gr0 as (select volume_id, {place_cols()} from f_source), {GROWN} select volume_id, z, y, x from gr12")
def v15(spark, d):
    return V.grow_to_size(centers_as_places(spark, d), dims(spark, d), 100)


@register("v12_min_diameter", f"with recursive {comp_sql(M.format(110), 6)} select volume_id, least(max(z) - min(z), max(y) - min(y), max(x) - min(x)) + 1 as min_diameter from lab join {LARGEST.format('lab')} using (volume_id, component_id) group by 1")
def v12(spark, d):
    return V.min_diameter(mask(spark, d, 110), dims(spark, d))
