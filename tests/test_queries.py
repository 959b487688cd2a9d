"""Registered queries against their SQL twins on the smallest tables."""

import glob
import os

import duckdb
import numpy as np
import pytest

from dendrovox.plans import field_queries, table_queries, voxel_queries  # noqa: F401

SF = "/root/testdata/sf0.001"
#: Iterative queries whose twins take long; a few stand for all here, the driver's gate runs every one.
SLOW = {"v10_progressive_open", "d09_soma_region", "d10_soma_center", "d12_multi_soma_region", "d13_main_soma_region", "g12_volume_predecessors", "d01_components_6", "d02_largest", "d03_remove_small", "d06_count", "v12_min_diameter", "g09_path_tree", "t06_connect_to_soma"}
#: The smallest tables have a source with too few neighbours for these.
EMPTY = {"g07_sample_paths", "g13_paths_to_swc", "g14_paths_on_mip", "l01_path_masks"}
TWINS = voxel_queries.ORACLES
FAST = sorted(n for n in TWINS if n not in SLOW)


def plain(x):
    if isinstance(x, float) and x != x:
        return None
    if isinstance(x, (list, tuple, np.ndarray)):
        return [plain(y) for y in x]
    return x


def ordered(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(repr([plain(row[k]) for k in order]) for row in rows)


@pytest.mark.parametrize("name", FAST)
def test_query_equals_its_sql(spark, name):
    got = voxel_queries.QUERIES[name](spark, SF)
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    want = con.execute(TWINS[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    rows = [tuple(r) for r in got.collect()]
    assert (rows or name in EMPTY) and ordered(rows, got.columns) == ordered(want.fetchall(), columns)
