"""Compositions and loops that SQL does not express, against plain Python on sets of voxels."""

import heapq
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dendrovox.operators import components as D
from dendrovox.operators import geodesic as G
from dendrovox.operators import runs as R
from dendrovox.operators import scoring as L
from dendrovox.operators import voxels as V

SIZE = (12, 24, 24)
FACES = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]
AROUND = [o for o in itertools.product((-1, 0, 1), repeat=3) if any(o)]


def plus(p, o):
    return tuple(a + b for a, b in zip(p, o, strict=True))


def inside(p):
    return all(0 <= a < n for a, n in zip(p, SIZE, strict=True))


def number(p):
    return (p[0] * SIZE[1] + p[1]) * SIZE[2] + p[2]


def components(mask, around):
    left, out = set(mask), []
    while left:
        todo = [left.pop()]
        part = set(todo)
        while todo:
            p = todo.pop()
            for q in (plus(p, o) for o in around):
                if q in left:
                    left.remove(q)
                    part.add(q)
                    todo.append(q)
        out.append(part)
    return sorted(out, key=lambda c: (-len(c), min(map(number, c))))


def largest(mask, around=FACES):
    return (components(mask, around) or [set()])[0]


def dilate(mask, steps):
    for _ in range(steps):
        mask = {q for p in mask for q in (p, *(plus(p, o) for o in FACES)) if inside(q)}
    return mask


def ball(r):
    k = int(r)
    return [o for o in itertools.product(range(-k, k + 1), repeat=3) if sum(a * a for a in o) <= r * r + 1e-12]


def sampled_ball(r):
    """The ball as the imaging library's public definition samples it: a grid of ``int(2 r + 1)`` points from -r to r."""
    n = 2 * r + 1
    z, y, x = np.mgrid[-r : r : n * 1j, -r : r : n * 1j, -r : r : n * 1j]
    return [tuple(map(int, p)) for p in np.argwhere(x**2 + y**2 + z**2 <= r * r)]


def opened(mask, r):
    """All translates of the sampled ball that lie within the mask."""
    near = sampled_ball(r)
    if not near:
        return set()
    starts = {tuple(a - b for a, b in zip(p, near[0], strict=True)) for p in mask}
    fits = {s for s in starts if all(plus(s, o) in mask for o in near)}
    return {plus(s, o) for s in fits for o in near}


def progressive_open(mask):
    if not mask:
        return mask
    big = largest(mask)
    d = min(max(p[a] for p in big) - min(p[a] for p in big) + 1 for a in range(3))
    for i in range(10):
        mask = opened(mask, d * (10 - i) / 10 / 2) or mask
    return mask


def shortest(mask, sources, zw):
    far, todo = dict.fromkeys(sources, 0.0), [(0.0, s) for s in sources]
    heapq.heapify(todo)
    while todo:
        d, p = heapq.heappop(todo)
        if d > far[p]:
            continue
        for o in AROUND:
            q = plus(p, o)
            new = d + math.sqrt((zw * o[0]) ** 2 + o[1] ** 2 + o[2] ** 2)
            if q in mask and new < far.get(q, math.inf) - 1e-12:
                far[q] = new
                heapq.heappush(todo, (new, q))
    return far


def to_background(mask):
    rim = {q for p in mask for q in (plus(p, o) for o in AROUND) if inside(q)} - mask
    far = shortest(mask, rim, 1.5)
    return {p: d for p, d in far.items() if p in mask}


def above(field, share):
    top = max(field.values(), default=0)
    return {p for p, d in field.items() if d > top * share}


def cleaned(mask):
    return largest(progressive_open(mask))


def mean(part):
    return tuple(sum(p[a] for p in part) / len(part) for a in range(3))


def soma_region(mask):
    return cleaned(largest(dilate(above(to_background(mask), 0.5), 5) & mask))


def blob(rnd, center, r):
    return {p for p in (plus(center, o) for o in ball(r)) if inside(p) and rnd.random() < 0.98}


@pytest.fixture(scope="module")
def masks():
    rnd = random.Random(5)
    fibre = {(6, 12, x) for x in range(2, 22)} | {(5, 12, x) for x in range(2, 22)}
    one = blob(rnd, (5, 11, 8), 4.3) | fibre
    two = blob(rnd, (5, 6, 6), 3.6) | blob(rnd, (6, 17, 17), 4.1) | {(2, 2, 20), (2, 2, 21)}
    three = {p for p in itertools.product(*map(range, SIZE)) if rnd.random() < 0.3} | blob(rnd, (5, 12, 12), 3)
    return [one, two, three]


@pytest.fixture(scope="module")
def tables(spark, masks):
    rows = [(v, *p) for v, m in enumerate(masks) for p in m]
    mask = spark.createDataFrame(rows, "volume_id long, z int, y int, x int")
    dims = spark.createDataFrame([(v, *SIZE) for v in range(len(masks))], "volume_id long, depth int, height int, width int")
    return mask, dims


def by_volume(df, n=3):
    out = [set() for _ in range(n)]
    for r in df.collect():
        out[r["volume_id"]].add((r["z"], r["y"], r["x"]))
    return out


def test_progressive_open(tables, masks):
    assert by_volume(V.progressive_open(*tables)) == [progressive_open(m) for m in masks]


def test_opening_by_balls_of_any_radius(spark, tables, masks):
    """Element and opening at whole, half and other radii, on noise and on solid blobs."""
    mask, _ = tables
    runs = R.of_mask(mask)
    assert by_volume(R.to_mask(runs)) == masks
    for r in (0.55, 1.0, 1.5, 2.0, 2.25, 2.5, 3.15, 3.85):
        radii = spark.createDataFrame([(v, r) for v in range(len(masks))], "volume_id long, r double")
        rows = R.ball_rows(radii)
        element = {(x["dz"], x["dy"], k) for x in rows.collect() for k in range(x["lo"], x["hi"] + 1)}
        assert element == set(sampled_ball(r))
        assert by_volume(R.to_mask(R.open_by_radius(runs, radii, rows))) == [opened(m, r) for m in masks]


def test_components_across_tiles(spark):
    """Components that cross tile borders at faces, edges and corners, in both neighbourhoods."""
    rnd = random.Random(3)
    size = (5, 40, 70)
    cells = {(2, y, x) for y in range(40) for x in range(70) if rnd.random() < 0.45} | {(z, 31, 31) for z in range(5)} | {(3, 32, 32), (4, 33, 33)}
    mask = spark.createDataFrame([(7, *p) for p in cells], "volume_id long, z int, y int, x int")
    dims = spark.createDataFrame([(7, *size)], "volume_id long, depth int, height int, width int")
    for conn, around in ((6, FACES), (26, AROUND)):
        want = {}
        for c in components(cells, around):
            least = min((p[0] * size[1] + p[1]) * size[2] + p[2] for p in c)
            want |= {p: least for p in c}
        got = {(r["z"], r["y"], r["x"]): r["component_id"] for r in D.connected_components(mask, dims, conn).collect()}
        assert got == want


def test_least_diameter_and_largest_component(tables, masks):
    want = [largest(m) for m in masks]
    assert by_volume(D.largest_component(*tables)) == want
    got = {r["volume_id"]: r["min_diameter"] for r in V.min_diameter(*tables).collect()}
    assert got == {v: min(max(p[a] for p in m) - min(p[a] for p in m) + 1 for a in range(3)) for v, m in enumerate(want)}


def test_growing_to_a_size(spark, tables):
    _, dims = tables
    small = [{(0, 0, 0)}, {(5, 5, 5), (5, 5, 9)}, set(itertools.product((3,), range(12), range(12)))]
    mask = spark.createDataFrame([(v, *p) for v, m in enumerate(small) for p in m], "volume_id long, z int, y int, x int")
    want = []
    for m in small:
        while len(m) < 100:
            m = dilate(m, 1)
        want.append(m)
    assert by_volume(V.grow_to_size(mask, dims, 100)) == want


def test_distance_to_background(tables, masks):
    got = D.distance_to_background(*tables).collect()
    want = {(v, *p): d for v, m in enumerate(masks) for p, d in to_background(m).items()}
    assert {(r["volume_id"], r["z"], r["y"], r["x"]) for r in got} == set(want)
    assert all(abs(r["dist"] - want[r["volume_id"], r["z"], r["y"], r["x"]]) < 1e-6 for r in got)


def test_soma_region_and_centers(tables, masks):
    regions = [soma_region(m) for m in masks]
    assert by_volume(D.soma_region(*tables)) == regions
    for center, want in ((D.soma_center(*tables), regions), (D.simple_soma_center(*tables), [above(to_background(m), 0.95) for m in masks])):
        got = {r["volume_id"]: (r["cz"], r["cy"], r["cx"]) for r in center.collect()}
        for v, m in enumerate(want):
            assert got[v] == pytest.approx(mean(largest(m, AROUND)))


def test_regions_of_several_somas(spark, tables, masks):
    mask, dims = tables
    marks = [(0, 10, 22, 16), (1, 10, 12, 12), (1, 12, 34, 34), (1, 4, 40, 6), (2, 10, 24, 24)]
    markers = spark.createDataFrame(marks, "volume_id long, z int, y int, x int")
    want = []
    for v, m in enumerate(masks):
        region, least = dilate(above(to_background(m), 0.5), 5) & m, 100
        while len(kept := [c for c in components(region, FACES) if len(c) >= least]) > 3:
            least *= 2
        out = set()
        for c in kept:
            c = cleaned(c)
            while 0 < len(c) < 100:
                c = dilate(c, 1)
            out |= c
        bare = [p for w, *p in marks if w == v and tuple(a // 2 for a in p) not in out]
        out |= {q for p in bare for q in (plus(tuple(a // 2 for a in p), o) for o in ball(5)) if inside(q)}
        want.append(out)
    assert by_volume(D.multi_soma_region(mask, markers, dims)) == want


def test_main_soma_region(spark, tables, masks):
    mask, dims = tables
    marks = {0: (11, 23, 17), 1: (12, 35, 34), 2: (10, 24, 25)}
    markers = spark.createDataFrame([(v, *p) for v, p in marks.items()], "volume_id long, z int, y int, x int")
    want = []
    for v, m in enumerate(masks):
        near = {p: d for p, d in to_background(m).items() if sum((a - b // 2) ** 2 for a, b in zip(p, marks[v], strict=True)) <= 49 and d > 0}
        want.append(cleaned(largest(dilate(above(near, 0.5), 5) & m)))
    assert by_volume(D.main_soma_region(mask, markers, dims, 7)) == want


def test_volume_predecessors_lead_to_the_soma(tables, masks):
    rows = G.volume_predecessors(*tables).collect()
    for v, m in enumerate(masks):
        source = tuple(int(a) for a in mean(largest(soma_region(m), AROUND)))
        far = shortest(m, [source], 1.0) if source in m else {}
        code = {(r["z"], r["y"], r["x"]): r["pred_code"] for r in rows if r["volume_id"] == v}
        assert {p for p in code if code[p] != -1} <= set(far)
        reached = {p for p, d in far.items() if d > 0}
        assert {p for p in code if code[p] != -1} == reached
        for p in list(reached)[::7]:
            o = (code[p] // 9 - 1, code[p] // 3 % 3 - 1, code[p] % 3 - 1)
            back = [q for q in (plus(p, o), plus(p, tuple(-a for a in o))) if q in far]
            assert any(abs(far[q] + math.sqrt(sum(a * a for a in o)) - far[p]) < 1e-6 for q in back)


def bars_of(field):
    """Intervals by merging components at every threshold."""
    out, born = [], {}
    parts: list[tuple[float, set]] = []
    for p in sorted(field, key=lambda p: field[p]):
        met = [c for c in parts if any(plus(p, o) in c[1] for o in AROUND)]
        born = min([field[p], *(c[0] for c in met)])
        for c in met:
            parts.remove(c)
        olds = sorted(c[0] for c in met)
        out += [(b, field[p]) for b in olds[1:] if b < field[p]]
        parts.append((born, set().union({p}, *(c[1] for c in met))))
    return sorted(out + [(b, 1.0) for b, _ in parts])


def matched(a, b):
    """Bottleneck distance by trying every matching."""
    best = math.inf
    for n in range(min(len(a), len(b)) + 1):
        for some in itertools.combinations(range(len(a)), n):
            for other in itertools.permutations(range(len(b)), n):
                pair = [max(abs(a[i][0] - b[j][0]), abs(a[i][1] - b[j][1])) for i, j in zip(some, other, strict=True)]
                alone = [(d - c) / 2 for k, (c, d) in enumerate(a) if k not in some] + [(d - c) / 2 for k, (c, d) in enumerate(b) if k not in other]
                best = min(best, max([*pair, *alone, 0.0]))
    return best


def test_topology_loss(spark):
    rnd = random.Random(8)
    rows = [(v, z, y, x, rnd.randint(0, 4) / 4, rnd.randint(0, 4) / 4) for v in (0, 1) for z, y, x in itertools.product(range(2), range(3), range(3)) if rnd.random() < 0.45]
    pairs = spark.createDataFrame(rows, "volume_id long, z int, y int, x int, gt double, pred double")
    dims = spark.createDataFrame([(0, 2, 3, 3), (1, 2, 3, 3)], "volume_id long, depth int, height int, width int")
    tiles = V.tile(pairs)
    got = {}
    for name in ("gt", "pred"):
        for r in L.h0_barcode(tiles, name).collect():
            got.setdefault((r["volume_id"], name), []).append((r["birth"], r["death"]))
    loss = {r["volume_id"]: r["loss"] for r in L.topology_loss(pairs, dims).select("volume_id", F.col("loss")).collect()}
    for v in (0, 1):
        bars = {}
        for k, name in ((4, "gt"), (5, "pred")):
            field = {r[1:4]: 1 - r[k] for r in rows if r[0] == v}
            bars[name] = [b for b in bars_of(field) if b[0] < b[1]]
            assert sorted(b for b in got.get((v, name), []) if b[0] < b[1]) == bars[name]
        assert loss[v] == pytest.approx(matched(bars["gt"], bars["pred"]))
