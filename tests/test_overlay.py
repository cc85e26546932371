"""Unions, repairs and inward buffers against places tested one by one."""

import math
import random
import time

import pytest

from rillgrid.functions import geometry, overlay
from rillgrid.plans import QUERIES


def odd(x, y, rings):
    hits = 0
    for ring in rings:
        for p, q in zip(ring, ring[1:], strict=False):
            hits += (p[1] > y) != (q[1] > y) and x < (q[0] - p[0]) * (y - p[1]) / (q[1] - p[1]) + p[0]
    return hits % 2 == 1


def covered(x, y, polygons):
    return sum(odd(x, y, [p[0]]) and not any(odd(x, y, [h]) for h in p[1:]) for p in polygons)


def distance(x, y, ring):
    best = math.inf
    for (a, b), (c, d) in zip(ring, ring[1:], strict=False):
        t = max(0, min(1, ((x - a) * (c - a) + (y - b) * (d - b)) / ((c - a) ** 2 + (d - b) ** 2 or 1)))
        best = min(best, math.hypot(x - a - t * (c - a), y - b - t * (d - b)))
    return best


def shape(rng, whole):
    pick = (lambda: rng.randint(0, 12)) if whole else (lambda: rng.uniform(0, 12))
    points = []
    while len(set(points)) < 3:
        points = [(pick(), pick()) for _ in range(rng.randint(3, 6))]
    return [*points, points[0]]


@pytest.mark.parametrize("whole", [False, True])
def test_unions_and_repairs(whole):
    rng = random.Random(4)
    for _ in range(80):
        parts = [[shape(rng, whole)] for _ in range(rng.randint(1, 5))]
        for made, want in ((overlay.united(parts), lambda x, y: any(odd(x, y, p) for p in parts)), (overlay.repaired([p[0] for p in parts]), lambda x, y: odd(x, y, [p[0] for p in parts]))):  # noqa: B023
            for p in made:
                assert all(len(set(r[:-1])) == len(r) - 1 and r[0] == r[-1] for r in p)
            for _ in range(150):
                x, y = rng.uniform(-1, 13), rng.uniform(-1, 13)
                if min(distance(x, y, p[0]) for p in parts) > 1e-6:
                    assert covered(x, y, made) == want(x, y)


def test_boxes_that_share_sides_become_one():
    box = lambda a, b, c, d: [[(a, b), (c, b), (c, d), (a, d), (a, b)]]
    [made] = overlay.united([box(0, 0, 2, 1), box(2, 0, 4, 1), box(1, 0, 3, 1), box(0, 0, 2, 1)])
    assert len(made) == 1 and len(made[0]) == 5
    [ring] = overlay.united([box(0, 0, 3, 1), box(0, 2, 3, 3), box(0, 0, 1, 3), box(2, 0, 3, 3)])
    assert len(ring) == 2
    assert overlay.united([]) == []


def test_inward_buffers():
    rng = random.Random(6)
    for _ in range(15):
        a = sorted(rng.uniform(0, 2 * math.pi) for _ in range(rng.randint(4, 8)))
        ring = [(10 * math.cos(t) * (s := rng.uniform(0.4, 1)), 10 * math.sin(t) * s) for t in a]
        ring.append(ring[0])
        if max((q - p) % (2 * math.pi) for p, q in zip(a, a[1:] + a[:1], strict=True)) > 3:
            continue
        made = overlay.shrunk([ring], 1.0)
        for _ in range(300):
            x, y = rng.uniform(-10, 10), rng.uniform(-10, 10)
            far = distance(x, y, ring)
            if abs(far - 1) > 0.03 and far > 1e-6:  # arcs are pieces of lines
                assert covered(x, y, made) == (odd(x, y, [ring]) and far > 1)


def test_repairs_of_many_are_made_together():
    """Each place is covered once if its polygon's rings say so, whatever lies beside it in the batch."""
    rng = random.Random(8)
    shapes = [[shape(rng, k % 2) for _ in range(rng.randint(1, 2))] for k in range(400)]
    # Repaired first and united after, this one lost three parts.
    shapes.append([[(11.423491820825184, 7.879878068528869), (7.778433654748492, 3.533913325193669), (8.431506632745423, 5.95792387191394), (1.3702877483041198, 3.7440591204068454), (4.1201096553431755, 9.554436134222684), (3.101049999185951, 3.041497787816986), (8.761826769421932, 11.720859307863503), (11.423491820825184, 7.879878068528869)],
                   [(5.1798665657972975, 11.70664116926355), (2.704488159823225, 4.767784429770268), (0.42391255964357777, 11.51871980669149), (5.348022196108605, 6.075711757973652), (5.119980324331118, 9.986938853913522), (11.723713872634873, 7.569262039465682), (8.340610699349597, 5.41014032571278), (5.1798665657972975, 11.70664116926355)]])
    kinds = [geometry.encode(geometry.POLYGON, s) if k % 3 else geometry.encode(geometry.MULTI_POLYGON, [[r] for r in s]) for k, s in enumerate(shapes)]
    for k, (rings, made) in enumerate(zip(shapes, overlay._valid([None, *kinds])[1:], strict=True)):
        found = geometry.polygons(made)
        assert all(len(set(r[:-1])) == len(r) - 1 and r[0] == r[-1] for p in found for r in p)
        for _ in range(60):
            x, y = rng.uniform(-1, 13), rng.uniform(-1, 13)
            if min(distance(x, y, r) for r in rings) > 1e-6:
                assert covered(x, y, found) == (odd(x, y, rings) if k % 3 else any(odd(x, y, [r]) for r in rings))


def test_repairs_are_quick(spark):
    """20,000 bow ties, squares with a hole at their border, spikes and lines: one by one they took over 20 s of one core."""
    shapes = (
        [[(0, 0), (2, 2), (2, 0), (0, 2), (0, 0)]], [[(0, 0), (2, 0), (2, 2), (0, 2), (0, 0)], [(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)]],
        [[(0, 0), (2, 0), (2, 1), (5, 1), (2, 1), (0, 1), (0, 0)]], [[(0, 0), (3, 3), (1, 1), (0, 0)]],
    )
    wkbs = [geometry.encode(geometry.POLYGON, [[(x + k % 700, y + 40.0 * k) for x, y in r] for r in shapes[k % 4]]) for k in range(20_000)]
    rows = spark.createDataFrame([(k, bytearray(w)) for k, w in enumerate(wkbs)], "k long, geom binary")
    began = time.process_time()
    made = overlay._valid(wkbs)
    assert time.process_time() - began < 10
    assert [len(geometry.polygons(w)) for w in made] == [(2, 1, 1, 0)[k % 4] for k in range(20_000)]
    area = rows.select("k", geometry.polygon_area(overlay.make_valid(rows.geom)).alias("a")).collect()
    assert all(abs(r["a"] - (2, 3, 2, 0)[r["k"] % 4]) < 1e-6 for r in area)


def test_columns(spark):
    bow = geometry.encode(geometry.POLYGON, [[(0, 0), (2, 2), (2, 0), (0, 2), (0, 0)]])
    line = geometry.encode(geometry.LINE, [(0, 0), (1, 1)])
    rows = spark.createDataFrame([(1, bytearray(bow)), (2, bytearray(line)), (3, None)], "k long, geom binary")
    got = {r["k"]: r["g"] for r in rows.select("k", overlay.make_valid(rows.geom).alias("g")).collect()}
    assert got[2] is None and got[3] is None and len(geometry.polygons(bytes(got[1]))) == 2
    assert rows.select(overlay.buffer_in(rows.geom, 5.0).alias("g")).where("g is not null").count() == 0
    assert overlay.union_by(rows, ["k"]).count() == 1


def test_inward_buffers_of_many():
    """Rings that turn one way are cut together; they match the places of each alone, others go their own way."""
    rng = random.Random(9)
    shapes = []
    for k in range(300):
        a = sorted(rng.uniform(0, 2 * math.pi) for _ in range(rng.randint(3, 8)))
        ring = [(10 * math.cos(t), 6 * math.sin(t) + 1e6 * (k % 2)) for t in (a if k % 4 < 2 else a[::-1])]
        shapes.append([*ring, ring[0]])
    hollow = geometry.encode(geometry.POLYGON, [[(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)], [(4, 4), (6, 4), (6, 6), (4, 6), (4, 4)]])
    made = overlay._less([*(geometry.encode(geometry.POLYGON, [r]) for r in shapes), None, hollow], 1.0)
    for k, (ring, wkb) in enumerate(zip(shapes, made, strict=False)):
        found = geometry.polygons(wkb)
        for _ in range(60):
            x, y = rng.uniform(-10, 10), rng.uniform(-6, 6) + 1e6 * (k % 2)
            if abs((far := distance(x, y, ring)) - 1) > 1e-6:
                assert covered(x, y, found) == (odd(x, y, [ring]) and far > 1)
    assert made[-2] is None and len(geometry.polygons(made[-1])[0]) == 2


def test_buffers_query_takes_each_row_by_itself(spark, tmp_path):
    """Nothing is joined or shuffled, so keys that come twice stay two rows."""
    spark.createDataFrame([(7,), (7,), (8,)], "o_orderkey long").selectExpr("o_orderkey", "timestamp'2020-07-01' AS o_orderdate").write.parquet(str(tmp_path / "orders.parquet"))
    made = QUERIES["fn_neg_buffer"](spark, str(tmp_path))
    assert sorted(map(tuple, made.select("cut_id", "area", "diamond").collect())) == [(7, 900.0, True), (7, 900.0, True), (8, 900.0, True)]
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Repartition" not in plan
