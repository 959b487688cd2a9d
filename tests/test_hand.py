"""Small cases with known answers, and properties."""

import itertools
import math
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from dendrovox.functions import grid
from dendrovox.operators import components as D
from dendrovox.operators import geodesic as G
from dendrovox.operators import scoring as L
from dendrovox.operators import trees as T
from dendrovox.operators import voxels as V
from dendrovox.plans.iterate import materialize
from dendrovox.sources import files as S

PLACE = "volume_id long, z int, y int, x int"


def mask_of(spark, *volumes):
    return spark.createDataFrame([(v, *p) for v, places in enumerate(volumes) for p in places], PLACE)


def dims_of(spark, n=1, size=(12, 24, 24)):
    return spark.createDataFrame([(v, *size) for v in range(n)], "volume_id long, depth int, height int, width int")


def places(df):
    return {tuple(r[a] for a in "zyx") for r in df.collect()}


def test_neighbour_codes_invert(spark):
    df = spark.range(27).select(F.col("id").cast("int").alias("code"))
    back = df.select("code", *grid.decode_neighbor(F.col("code"))).withColumn("again", grid.encode_neighbor(F.col("dz"), F.col("dy"), F.col("dx")))
    rows = back.collect()
    assert all(r["code"] == r["again"] for r in rows)
    assert {(r["dz"], r["dy"], r["dx"]) for r in rows} == set(itertools.product((-1, 0, 1), repeat=3))


def test_flips(spark):
    r = spark.range(1).select(*[grid.flip_y(F.lit(3), F.lit(10), f).alias(f) for f in ("none", "h", "h_minus_1")]).first()
    assert tuple(r) == (3, 7, 6)


def test_components_of_touching_corners(spark):
    mask = mask_of(spark, [(0, 0, 0), (1, 1, 1), (1, 1, 2), (5, 5, 5)], [(2, 2, 2)])
    dims = dims_of(spark, 2)
    six = {(r["volume_id"], r["component_id"]) for r in D.connected_components(mask, dims, 6).collect()}
    all_ = {(r["volume_id"], r["component_id"]) for r in D.connected_components(mask, dims, 26).collect()}
    assert len(six) == 4 and len(all_) == 3 and (0, 0) in all_
    sizes = D.component_sizes(D.connected_components(mask, dims, 26)).agg(F.sum("n_voxels")).first()[0]
    assert sizes == mask.count()


def test_largest_component_takes_the_first_of_equals(spark):
    mask = mask_of(spark, [(0, 0, 0), (0, 0, 1), (4, 4, 4), (4, 4, 5)])
    assert places(D.largest_component(mask, dims_of(spark))) == {(0, 0, 0), (0, 0, 1)}
    assert D.largest_component(mask.where("false"), dims_of(spark)).count() == 0


def test_seed_on_background_has_no_component(spark):
    mask = mask_of(spark, [(0, 0, 0)])
    assert D.component_of(mask, mask_of(spark, [(3, 3, 3)]), dims_of(spark)).count() == 0


def test_distance_along_an_l_turn_and_island(spark):
    mask = mask_of(spark, [(0, 0, x) for x in range(5)] + [(0, y, 4) for y in range(1, 4)] + [(9, 9, 9)])
    got = {tuple(r[a] for a in "zyx"): r for r in G.geodesic_distance(mask, mask_of(spark, [(0, 0, 0)])).collect()}
    assert (9, 9, 9) not in got
    r = got[(0, 3, 4)]
    assert (r["n_face"], r["n_edge"], r["n_corner"]) == (5, 1, 0) and r["dist"] == pytest.approx(5 + math.sqrt(2))
    assert got[(0, 0, 0)]["dist"] == 0


def test_source_on_background_is_zero(spark):
    got = {tuple(r[a] for a in "zyx"): r["dist"] for r in G.geodesic_distance(mask_of(spark, [(0, 0, 1)]), mask_of(spark, [(0, 0, 0)])).collect()}
    assert got == {(0, 0, 0): 0.0, (0, 0, 1): 1.0}


def test_distance_crosses_tiles(spark):
    n = 3 * G.TILE
    mask = mask_of(spark, [(0, 0, x) for x in range(n)] + [(0, 1, n - 1)])
    far = G.geodesic_distance(mask, mask_of(spark, [(0, 0, 0)])).agg(F.max("dist"), F.count(F.lit(1))).first()
    assert far[0] == pytest.approx(n - 2 + math.sqrt(2)) and far[1] == n + 1


def test_predecessor_of_a_tie_is_the_least(spark):
    mask = mask_of(spark, [(0, 0, 1), (0, 1, 0), (0, 1, 2), (0, 2, 1)])
    pred = G.predecessor(G.geodesic_distance(mask, mask_of(spark, [(0, 0, 1)])))
    code = {tuple(r[a] for a in "zyx"): r["pred_code"] for r in pred.collect()}
    assert code[(0, 0, 1)] == -1
    assert code[(0, 2, 1)] == 9 + 2 * 3 + 2  # from (0, 1, 0), the lesser of two: offset (0, 1, 1)


def test_paths_cost_their_distance_and_are_capped(spark):
    mask = mask_of(spark, [(0, y, x) for y in range(6) for x in range(6) if (y + x) % 5])
    field = G.geodesic_distance(mask, mask_of(spark, [(0, 0, 1)]))
    pred = G.predecessor(field)
    starts = field.select("volume_id", F.concat_ws(",", "z", "y", "x").alias("path_id"), "z", "y", "x")
    dist = {f"{r['z']},{r['y']},{r['x']}": r["dist"] for r in field.collect()}
    paths = {}
    for r in G.trace_paths(pred, starts).collect():
        paths.setdefault(r["path_id"], {})[r["step"]] = (r["z"], r["y"], r["x"])
    for p, steps in paths.items():
        walk = [steps[k] for k in range(len(steps))]
        assert walk[-1] == (0, 0, 1)
        assert sum(math.dist(a, b) for a, b in zip(walk, walk[1:], strict=False)) == pytest.approx(dist[p])
    assert G.trace_paths(pred, starts, 2).groupBy("path_id").count().agg(F.max("count")).first()[0] == 3


def test_paths_become_one_tree(spark):
    mask = mask_of(spark, [(0, 0, x) for x in range(6)])
    pred = G.predecessor(G.geodesic_distance(mask, mask_of(spark, [(0, 0, 2)])))
    nodes = G.paths_to_swc(G.sample_paths(pred, 2, 0)).collect()
    ids = {r["n"] for r in nodes}
    assert ids == set(range(1, len(nodes) + 1)) and all(r["parent"] in ids or r["parent"] == -1 for r in nodes)
    assert sum(r["parent"] == -1 for r in nodes) == 1


def test_streamline_descends_to_the_source(spark):
    dims, mask = dims_of(spark, 1, (1, 1, 12)), mask_of(spark, [(0, 0, x) for x in range(12)])
    field = V.dense(G.geodesic_distance(mask, mask_of(spark, [(0, 0, 0)])), dims, "dist")
    target = spark.createDataFrame([(0, 1, 0, 0, 8)], "volume_id long, path_id int, z int, y int, x int")
    heads = G.streamline(field, target, mask_of(spark, [(0, 0, 0)]), 1.0).orderBy("step").collect()
    assert [r["x"] for r in heads] == [8.0, 7.0, 6.0, 5.0, 4.0, 3.0, 2.0, 1.0]


def test_streamline_ends_or_says_that_it_has_not(spark):
    mask = mask_of(spark, [(0, 0, x) for x in range(32)])
    field = V.dense(G.geodesic_distance(mask, mask_of(spark, [(0, 0, 0)])), dims_of(spark, 1, (1, 1, 32)), "dist")
    target = spark.createDataFrame([(0, 1, 0, 0, 24)], "volume_id long, path_id int, z int, y int, x int")
    heads = G.streamline(field, target, mask_of(spark, [(0, 0, 0)]), 4.0).collect()
    assert min(r["x"] for r in heads) == 0.0 and len(heads) == 7 and all(r["ended"] for r in heads)
    short = G.streamline(field, target, mask_of(spark, [(0, 0, 0)]), 1.0, max_steps=4).collect()
    assert min(r["x"] for r in short) == 20.0 and not any(r["ended"] for r in short)


def test_morphology_properties(spark):
    rng = np.random.default_rng(1)
    mask = mask_of(spark, [tuple(map(int, p)) for p in np.argwhere(rng.random((6, 8, 8)) < 0.8)])
    dims = dims_of(spark, 1, (6, 8, 8))
    opened, grown = V.open_mask(mask, dims, 1), V.dilate(mask, dims, 1)
    assert places(opened) <= places(mask) <= places(grown)
    assert places(V.restore(*V.crop(mask))) == places(mask)
    radii = dims.select("volume_id", F.lit(1.0).alias("r"))
    assert places(V._open_by_volume(mask, radii, dims, 1.0, ("volume_id",))) == places(opened)
    assert V.crop(mask.where("false"))[0].count() == 0


def test_grow_to_size_stops_on_empty_and_full(spark):
    dims = dims_of(spark, 1, (2, 2, 2))
    assert V.grow_to_size(mask_of(spark, [(0, 0, 0)]), dims, 100).count() == 8
    assert V.grow_to_size(mask_of(spark, [(0, 0, 0)]).where("false"), dims, 100).count() == 0


def test_progressive_open_keeps_what_no_ball_fits(spark):
    line = mask_of(spark, [(0, 0, x) for x in range(5)])
    assert places(V.progressive_open(line, dims_of(spark))) == places(line)


def toy(cubes):
    block = np.zeros((10, 20, 20))
    for z, y, x in cubes:
        block[z : z + 2, y : y + 2, x : x + 2] = 1
    return pd.DataFrame([(*p, block[p]) for p in np.ndindex(block.shape)], columns=["z", "y", "x", "value"])


def test_barcode_of_toy_cubes():
    frame = toy([(5, 5, 1), (5, 5, 3), (5, 5, 5)])
    assert L._barcode(frame.assign(value=1 - frame["value"])) == [(0.0, 1.0)]
    frame = toy([(5, 5, 1), (5, 5, 9)])
    assert sorted(L._barcode(frame.assign(value=1 - frame["value"]))) == [(0.0, 1.0), (0.0, 1.0)]


def brute_bottleneck(a, b):
    half = lambda p: (p[1] - p[0]) / 2
    best = math.inf
    n, m = len(a), len(b)
    for k in range(min(n, m) + 1):
        for left in itertools.combinations(range(n), k):
            for right in itertools.permutations(range(m), k):
                cost = [max(abs(a[i][0] - b[j][0]), abs(a[i][1] - b[j][1])) for i, j in zip(left, right, strict=True)]
                cost += [half(a[i]) for i in range(n) if i not in left] + [half(b[j]) for j in range(m) if j not in right]
                best = min(best, max(cost, default=0.0))
    return best


def test_bottleneck_against_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(60):
        a, b = (np.sort(rng.integers(0, 9, (rng.integers(0, 5), 2)) / 8, axis=1) for _ in range(2))
        assert L.bottleneck_distance(a, b) == pytest.approx(brute_bottleneck(a.tolist(), b.tolist()))


def test_topology_loss_of_equal_volumes_is_zero(spark):
    pairs = spark.createDataFrame([(0, 1, 1, x, 1, 1.0) for x in range(3)], f"{PLACE}, gt int, pred double")
    assert [r["loss"] for r in L.topology_loss(pairs, dims_of(spark)).collect()] == [0.0]
    other = pairs.withColumn("pred", F.when(F.col("x") == 1, 0.0).otherwise(1.0))
    assert L.topology_loss(other, dims_of(spark)).first()["loss"] > 0


NODES = "tree_id long, line int, n long, type int, x double, y double, z double, r double, parent long"


def test_renumber_with_missing_parent_two_roots_and_repeated_ids(spark):
    rows = [(1, 1, 10, 3, 0.0, 0.0, 0.0, 1.0, -1), (1, 2, 20, 3, 0.0, 0.0, 0.0, 1.0, 10), (1, 3, 20, 3, 0.0, 0.0, 0.0, 1.0, 99), (1, 4, 30, 3, 0.0, 0.0, 0.0, 1.0, 20), (1, 5, 40, 3, 0.0, 0.0, 0.0, 1.0, -1)]
    got = {r["n"]: r["parent"] for r in T.renumber(spark.createDataFrame(rows, NODES)).collect()}
    assert got == {1: -1, 2: 1, 3: 1, 4: 3, 5: -1}


def test_depth_of_two_roots(spark):
    rows = [(1, k, k, 0, 0.0, 0.0, 0.0, 1.0, p) for k, p in ((1, -1), (2, 1), (3, 2), (4, -1), (5, 4), (6, 3))]
    got = {r["n"]: r["depth"] for r in T.depth(spark.createDataFrame(rows, NODES)).collect()}
    assert got == {1: 0, 2: 1, 3: 2, 4: 0, 5: 1, 6: 3}


def test_swc_text_round_trip(spark, tmp_path):
    (tmp_path / "a.swc").write_text("# a comment\n\n 1 3 1.5 2 3 1 -1\n2  3 4 5 6 1 1\n")
    rows = S.read_swc(spark, f"file://{tmp_path}/*.swc").orderBy("n").collect()
    assert [(r["n"], r["x"], r["parent"]) for r in rows] == [(1, 1.5, -1), (2, 4.0, 1)]


def test_path_loss_guards_on_the_segmentation(spark):
    line, source = [(6, 12, x) for x in range(2, 22)], [(6, 12, 2)]
    mask, at = mask_of(spark, line, line), mask_of(spark, source, source)
    codes = G.predecessor(G.geodesic_distance(mask, at, 26), 26)
    rows = [(v, *p, 1, 0.2, 1.0 if p[2] < 5 else 0.0) for v in (0, 1) for p in line]
    rows += [(1, z, y, x, 0, 0.0, 1.0) for z in (0, 1) for y in range(24) for x in range(24)]  # dense, apart from the line
    pairs = spark.createDataFrame(rows, f"{PLACE}, gt int, pred double, seg double")
    loss = {r["volume_id"]: r["loss"] for r in L.path_loss(pairs, codes, at, dims_of(spark, 2)).collect()}
    assert loss[0] > 0 and loss[1] == 0
    assert L.path_loss(pairs, codes, at, dims_of(spark, 2), max_density=1.0).where("loss > 0").count() == 2


def test_tables_of_nodes_are_not_broadcast(spark):
    """A node table's file is a hundredth of it in memory, so its size as a file may not decide for a broadcast."""
    nodes = spark.createDataFrame([(0, n, n, 0, float(n), 1.0, 1.0, 1.0, n - 1 if n > 1 else -1) for n in range(1, 9)], NODES)
    soma = mask_of(spark, [(1, 1, 1)])
    for df in (T.depth(nodes), T.connect_to_soma(nodes, soma, dims_of(spark), 1, "none")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_a_mask_is_not_broadcast_to_nodes(spark):
    nodes = spark.createDataFrame([(0, 2, 2, 0, 1.0, 1.0, 1.0, 1.0, 1)], NODES)
    found = T.nodes_in_mask(nodes, materialize(mask_of(spark, [(1, 1, 1)])), dims_of(spark), "none")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 1 and re.search(r"SortMergeJoin.*LeftSemi", plan)


def test_sidecars_are_written_by_several_tasks(spark, tmp_path, monkeypatch):
    """They are small, so by their bytes Spark would join all into one task."""
    monkeypatch.setattr(S, "SIDECARS", 10, raising=False)
    images = spark.range(40).select(F.format_string("image_%03d", "id").alias("nnunet_name"), F.struct(F.lit(1.0).alias("z"), F.lit(2.0).alias("y"), F.lit(3.0).alias("x")).alias("spacing"))
    S.write_spacing(images, f"file://{tmp_path}/sidecars")
    files = list((tmp_path / "sidecars").glob("name=*/part-*"))
    assert len(files) == 40 and len({f.name.split("-")[1] for f in files}) > 1
    assert spark.read.text(f"file://{tmp_path}/sidecars").where("value = '{\"spacing\":[1.0,2.0,3.0]}'").count() == 40


def test_streamline_swinging_across_a_border_stays_in_a_task(spark, monkeypatch):
    rounds = []
    append = G.Log.append
    monkeypatch.setattr(G.Log, "append", lambda self, rows: rounds.append(1) or append(self, rows))
    size = (40, 3, 3)
    field = spark.createDataFrame([(0, *p, float(abs(p[0] - 32))) for p in itertools.product(*map(range, size))], PLACE + ", dist double")
    target = spark.createDataFrame([(0, 1, 30.25, 1.0, 1.0)], "volume_id long, path_id int, z double, y double, x double")
    got = G.streamline(field, target, mask_of(spark, [(0, 0, 0)]), 0.5, max_steps=30).orderBy("step").collect()
    assert [r["z"] for r in got] == [30.25, 30.75, 31.25] + [31.75, 32.25] * 14
    assert not any(r["ended"] for r in got) and len(rounds) < 5


def test_predecessors_are_found_by_tiles(spark):
    """Across a tile's border as within it, and without a row for each voxel and neighbour."""
    mask = mask_of(spark, [(0, 0, x) for x in range(28, 37)], [(1, 0, 0), (0, 0, 1), (0, 1, 0), (1, 1, 1)])
    sources = spark.createDataFrame([(0, 0, 0, 28), (1, 1, 0, 0), (1, 0, 0, 1), (1, 0, 1, 0)], PLACE)
    found = G.predecessor(G.geodesic_distance(mask, sources))
    codes = {(r["volume_id"], r["z"], r["y"], r["x"]): r["pred_code"] for r in found.collect()}
    assert codes == {(0, 0, 0, 28): -1, **{(0, 0, 0, x): 14 for x in range(29, 37)}, (1, 1, 0, 0): -1, (1, 0, 0, 1): -1, (1, 0, 1, 0): -1, (1, 1, 1, 1): 25}
    joined = spark.createDataFrame([(0, 0, 0, 0, 0, 0, 0, 0.0)], PLACE + ", n_face int, n_edge int, n_corner int, dist double")
    assert "Join" not in G.predecessor(joined)._jdf.queryExecution().executedPlan().toString()


def test_distance_to_background_is_read_off_the_field(spark):
    """The rim is at 0, the mask is not; so the field is not joined with the mask again."""
    mask = mask_of(spark, [(z, y, x) for z in (1, 2, 3) for y in (1, 2, 3) for x in (0, 1, 2)])
    found = D.distance_to_background(mask, dims_of(spark, 1, (5, 5, 5)))
    dist = {(r["z"], r["y"], r["x"]): r["dist"] for r in found.collect()}
    assert len(dist) == 27 and dist[1, 1, 0] == 1.0 and dist[2, 2, 1] == 2.0
    assert not re.search(r"Join \[volume_id#\d+L, z#", found._jdf.queryExecution().executedPlan().toString())
