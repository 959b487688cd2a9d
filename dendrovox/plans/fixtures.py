"""Test inputs derived from the driver's tables by SQL that Spark and DuckDB both run (see FIXTURES.md)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ("lineitem", "orders", "customer")
SQL = {
    "f_voxel": """
select volume_id, z, y, x, max(intensity) as intensity
from (select cast(floor(l_orderkey / 1500) as bigint) as volume_id,
             cast(l_orderkey % 12 as int) as z,
             cast(cast(floor(l_extendedprice) as bigint) % 24 as int) as y,
             cast(cast(floor(l_extendedprice / 24) as bigint) % 24 as int) as x,
             cast(floor(l_quantity * 5) as int) as intensity
      from lineitem) t
group by volume_id, z, y, x""",
    "f_volume": "select distinct volume_id, 12 as depth, 24 as height, 24 as width from f_voxel",
    "f_pair": """
select volume_id, z, y, x,
       case when intensity >= 200 then 1 else 0 end as gt,
       cast((z * 37 + y * 11 + x * 5 + intensity) % 101 as double) / 100 as pred
from f_voxel""",
    "f_source": """
select volume_id, min(z * 576 + y * 24 + x) as k from f_voxel
where intensity >= 200 group by volume_id""",
    "f_node": """
select tree_id, n, 0 as type,
       cast(cast(floor(o_totalprice) as bigint) % 24 as double) as x,
       cast(cast(floor(o_totalprice / 24) as bigint) % 24 as double) as y,
       cast(o_orderkey % 12 as double) as z,
       cast(1 as double) as r,
       case when n = 1 then -1 else greatest(1, n - 1 - o_orderkey % 7) end as parent
from (select cast(floor(o_orderkey / 150) as bigint) as tree_id,
             cast(row_number() over (partition by floor(o_orderkey / 150) order by o_orderkey) as bigint) as n,
             o_orderkey, o_totalprice from orders) t""",
    "f_swc_line": """
select tree_id, n as line,
       cast(n * 10 as string) || ' 3 ' || cast(cast(x as int) as string) || ' ' || cast(cast(y as int) as string)
       || ' ' || cast(cast(z as int) as string) || ' 1 '
       || case when parent = -1 then '-1' else cast(parent * 10 as string) end as value
from f_node
union all
select distinct tree_id, cast(0 as bigint) as line, '# comment' as value from f_node""",
    "f_marker": """
select cast(floor(o_orderkey / 1500) as bigint) as image_id,
       cast(floor(o_orderkey / 500) as bigint) as ord,
       cast((cast(floor(o_totalprice) as bigint) % 24) * 2 as double) as x,
       cast((cast(floor(o_totalprice / 24) as bigint) % 24) * 2 as double) as y,
       cast((cast(floor(o_orderkey / 500) as bigint) * 5 % 12) * 2 as double) as z
from orders where o_orderkey % 500 = 7""",
    "f_name_a": """
select c_custkey as id,
       case when c_custkey % 5 = 0 then cast(c_custkey as string) || '_plain.tif'
            when c_custkey % 5 = 1 then cast(c_custkey as string) || '_P01_T02_Rx_S1.tif'
            else cast(c_custkey as string) || '_P01_T02_R' || cast(200 + c_custkey % 300 as string) || '_S1.tif' end as name
from customer""",
    "f_name_n": """
select id, name from f_name_a
union all
select id, cast(id as string) || case when id % 3 = 0 then '.tif' when id % 3 = 1 then '.0.tif' else '_plain.tif' end as name from f_name_a where id % 5 = 0""",
    "f_name_b": """
select id, name from f_name_a where id % 3 <> 0
union all
select id + 1000000 as id, cast(id + 1000000 as string) || '_extra.tif' as name from f_name_a where id % 7 = 0""",
    "f_raw_info": """
select c_custkey as number, cast(200 + c_custkey % 300 as double) as resolution
from customer where c_custkey % 10 = 0""",
    "f_marker_file": """
select c_custkey as id,
       case when c_custkey % 2 = 0 then cast(c_custkey as string) || '_plain.marker'
            else cast(c_custkey as string) || '_other.marker' end as name
from customer where c_custkey % 4 < 2""",
    "f_listed": "select c_custkey as id from customer where c_mktsegment = 'BUILDING'",
}


def needed(sql: str) -> list[str]:
    """Fixtures that a query reads, those that they read before them."""
    out: list[str] = []
    for name in SQL:
        if re.search(rf"\b{name}\b", sql):
            out += [n for n in [*needed(SQL[name]), name] if n not in out]
    return out


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    for t in BASE:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    for n in needed(SQL[name]):
        spark.sql(SQL[n]).createOrReplaceTempView(n)
    return spark.sql(SQL[name])


def with_fixtures(sql: str) -> str:
    """A DuckDB query with the fixtures that it reads as a leading WITH."""
    views = ", ".join(f"{n} as ({SQL[n].strip()})" for n in needed(sql))
    body = sql.strip()
    if not views:
        return body
    if (m := re.match(r"with\s+(recursive\s+)?", body, re.I)) is not None:
        return f"with {m[1] or ''}{views}, {body[m.end():]}"
    return f"with {views} {body}"
