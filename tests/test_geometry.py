"""Geometry, projections and operators on cases worked out by hand."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitewright.functions import geometry as G
from sitewright.functions import projection as P
from sitewright.operators import curves, dedup, roofs, spatial

SQUARE = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]


def ring(points):
    return F.array(*[G.point(F.lit(x), F.lit(y)) for x, y in points])


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def rect(x0, y0, x1, y1):
    return F.struct(*[F.lit(float(v)).alias(n) for v, n in zip((x0, y0, x1, y1), ("x0", "y0", "x1", "y1"))])


def test_area_open_and_closed(spark):
    assert one(spark, G.ring_area(ring([(0, 0), (2, 0), (2, 2), (0, 2)]))) == 4
    assert one(spark, G.ring_area(ring([(0, 0), (2, 0), (2, 2), (0, 2), (0, 0)]))) == 4
    assert one(spark, G.ring_area(ring([(0, 0), (2, 0)]))) == 0


def test_clip(spark):
    square = ring([(0, 0), (2, 0), (2, 2), (0, 2)])
    assert one(spark, G.ring_area(G.clip(square, rect(1, 1, 3, 3)))) == 1
    holed = F.array(ring([(0, 0), (4, 0), (4, 4), (0, 4)]), ring([(1, 1), (3, 1), (3, 3), (1, 3)]))
    assert one(spark, G.area_in_rect(holed, rect(0, 0, 4, 4))) == 12
    assert one(spark, G.area_in_rect(holed, rect(1.5, 1.5, 2.5, 2.5))) == 0
    assert one(spark, G.area_in_rect(F.array(square), rect(2, 0, 3, 3))) == 0
    assert one(spark, F.size(G.clip_polygon(holed, rect(5, 5, 6, 6)))) == 0


@pytest.mark.parametrize(("x", "y", "inside"), [(0, 0, True), (10, 10, False), (5, 5, True), (10, 5, False), (0, 5, True), (-1, 5, False)])
def test_in_ring_edges(spark, x, y, inside):
    assert one(spark, G.in_ring(F.lit(float(x)), F.lit(float(y)), ring(SQUARE))) is inside


def test_representative_point_of_a_u(spark):
    u = [(0, 0), (6, 0), (6, 6), (4, 6), (4, 2), (2, 2), (2, 6), (0, 6)]
    p = one(spark, G.representative_point(ring(u)))
    assert (p["x"], p["y"]) == (1.0, 4.0)
    assert tuple(one(spark, G.representative_point(ring([(0, 1), (4, 1), (2, 1)])))) == (2.0, 1.0)


def test_ring_key_ignores_start_and_winding(spark):
    turned = SQUARE[2:] + SQUARE[:2]
    assert one(spark, G.ring_key(ring(SQUARE)) == G.ring_key(ring(turned))) and one(spark, G.ring_key(ring(SQUARE)) == G.ring_key(ring(turned[::-1])))
    assert not one(spark, G.ring_key(ring(SQUARE)) == G.ring_key(ring([(0, 0), (10, 0), (10, 10), (1, 10)])))


def test_nearest_on_segment(spark):
    lit = lambda *v: [F.lit(float(x)) for x in v]
    at = one(spark, G.nearest_on_segment(*lit(1, 1, 0, 0, 4, 0)))
    assert (at["x"], at["y"], at["t"], at["distance"]) == (1, 0, 0.25, 1)
    assert one(spark, G.nearest_on_segment(*lit(1, 1, 2, 2, 2, 2)))["t"] == 0


def test_drop_collinear_is_a_fold(spark):
    line = [(0, 0), (1, 0.04), (2, 0), (3, 1), (4, 2), (5, 5)]
    kept = one(spark, G.drop_collinear(ring(line)))
    assert [tuple(p) for p in kept] == curves.straighten([(float(x), float(y)) for x, y in line])


def test_pos_list(spark):
    assert [tuple(p) for p in one(spark, G.parse_pos_list(F.lit(" 1 2  3 4.5 ")))] == [(1, 2), (3, 4.5)]
    with pytest.raises(Exception, match="pairs"):
        one(spark, G.parse_pos_list(F.lit("1 2 3")))


def test_few_samples_fall_back(spark):
    tiny = [(0.0, 51.0), (1e-5, 51.0), (1e-5, 51.00001), (0.0, 51.00001)]
    assert one(spark, F.size(G.interior_samples(ring(tiny)))) >= 1
    assert one(spark, F.size(G.interior_samples(F.slice(ring(tiny), 1, 0)))) == 0


def test_projection_round_trip(spark):
    lat, lon = np.array([50.1, 52.65757, 58.2]), np.array([-5.4, 1.71792, -3.3])
    e, n = P.tm_forward_array(lat, lon)
    back = P.tm_inverse_array(e, n)
    assert np.allclose(back[0], lat, atol=1e-9) and np.allclose(back[1], lon, atol=1e-9)
    p = one(spark, P.tm_forward(F.lit(52.65757), F.lit(1.71792)))
    assert abs(p["e"] - e[1]) < 1e-6 and abs(p["n"] - n[1]) < 1e-6
    u = one(spark, P.utm_project(F.lit(51.5), F.lit(-3.2), F.lit("30U")))
    lat2, lon2 = P.utm_unproject_array(np.array([u["e"]]), np.array([u["n"]]), "30U")
    assert abs(lat2[0] - 51.5) < 1e-8 and abs(lon2[0] + 3.2) < 1e-8


def test_shift_grid_round_trip():
    y, x = np.mgrid[0:1251, 0:701]
    grid = P.ShiftGrid(90 + np.sin(x / 50), -50 + np.cos(y / 70))
    lat, lon = np.array([51.4, 54.0]), np.array([-3.2, -1.0])
    e, n = grid.to_grid(lat, lon)
    back = grid.from_grid(e, n)
    assert np.allclose(back[0], lat, atol=1e-8) and np.allclose(back[1], lon, atol=1e-8)
    assert np.isnan(grid.at(np.array([-5.0]), np.array([5.0]))[0][0])


def test_outside_the_grid_is_an_error(spark):
    with pytest.raises(Exception, match="outside"):
        one(spark, P.grid_square(F.lit(-1.0), F.lit(0.0)))
    assert one(spark, P.grid_square(F.lit(318_000.0), F.lit(176_000.0))) == "ST"


def test_chains_stop_at_junctions():
    cross = [((0, 0), (1, 0)), ((1, 0), (2, 0)), ((1, 0), (1, 1)), ((1, 1), (1, 2))]
    assert sorted(map(len, curves.chain(cross, {(1, 0)}))) == [2, 2, 3]
    ring_ = curves.chain([((0, 0), (1, 0)), ((1, 0), (1, 1)), ((1, 1), (0, 0))])
    assert len(ring_) == 1 and ring_[0][0] == ring_[0][-1]


def test_directed_is_the_same_for_any_start():
    r = [(1, 1), (0, 0), (1, 0), (1, 1)]
    assert curves.directed(r) == curves.directed(r[::-1]) == curves.directed([(0, 0), (1, 0), (1, 1), (0, 0)])


def test_latest_keeps_the_first_of_equal_versions(spark):
    rows = spark.createDataFrame([(1, 2, 5, "b"), (1, 2, 1, "a"), (1, 1, 0, "old"), (2, None, 0, "none")], "id int, version int, ord int, v string")
    assert {r["id"]: r["v"] for r in dedup.latest(rows, ["id"], "version", ["ord"]).collect()} == {1: "a", 2: "none"}


def test_greedy_match_does_not_depend_on_partitions(spark):
    rows = [(i, j, round(0.1 + ((i * 7 + j * 11) % 10) / 10, 2)) for i in range(12) for j in range(12) if (i + j) % 3 == 0]
    df = spark.createDataFrame(rows, "i long, j long, iou double")
    taken_i, taken_j, want = set(), set(), []
    for i, j, s in sorted(rows, key=lambda r: (-r[2], r[0], r[1])):
        if i not in taken_i and j not in taken_j:
            taken_i.add(i)
            taken_j.add(j)
            want.append((i, j, s))
    for parts in (1, 7):
        assert sorted(map(tuple, spatial.greedy_matches(df.repartition(parts)).collect())) == sorted(want)


def test_fusion_equals_one_by_one(spark):
    boxes = [(k * 3.0, (k * 7) % 5 * 1.0, k * 3.0 + 6, (k * 7) % 5 + 5.0) for k in range(15)]
    corners = lambda b: [(b[0], b[1]), (b[2], b[1]), (b[2], b[3]), (b[0], b[3])]
    middle = lambda b: ((b[0] + b[2]) / 2, (b[1] + b[3]) / 2)
    holds = lambda b, p: b[0] <= p[0] < b[2] and b[1] <= p[1] < b[3]
    base, accepted, want = boxes[:2], list(boxes[:2]), []
    for k, b in enumerate(boxes[2:]):
        if not any(holds(a, middle(b)) or holds(b, middle(a)) for a in accepted):
            accepted.append(b)
            want.append(k)
    frame = lambda bs: spark.createDataFrame([(k, [{"x": x, "y": y} for x, y in corners(b)]) for k, b in enumerate(bs)], "ord long, ring array<struct<x:double,y:double>>")
    got = spatial.fuse(frame(base).select("ring"), frame(boxes[2:]), 4.0)
    assert sorted(r["ord"] for r in got.collect()) == want


def test_roof_forms():
    e, n = np.meshgrid(np.arange(12.0), np.arange(8.0))
    flat = np.column_stack([e.ravel(), n.ravel(), np.full(e.size, 4.0)])
    assert roofs.form(flat)["shape"] == "flat"
    gable = np.column_stack([e.ravel(), n.ravel(), (7 - 0.7 * np.abs(e - 5.5)).ravel()])
    got = roofs.form(gable)
    assert got["shape"] == "gable" and got["direction"] == 0
    assert roofs.form(flat[:10]) is None
    a, b = roofs.ridge_segment(np.array([0.7, 0, 0]), np.array([-0.7, 0, 7.0]), [(0, 0), (10, 0), (10, 8), (0, 8)])
    assert {a[1], b[1]} == {0, 8} and abs(a[0] - 5) < 1e-9 and abs(a[2] - 3.5) < 1e-9


def test_simplify_and_padded_extent():
    line = [(0.0, 0.0), (1.0, 0.1), (2.0, 0.0), (3.0, 5.0), (4.0, 0.0)]
    assert curves.simplify(line, 1.0) == [(0.0, 0.0), (2.0, 0.0), (3.0, 5.0), (4.0, 0.0)]
    assert curves.simplify(line[:1], 1.0) == line[:1]
    grid = P.ShiftGrid(np.full((1251, 701), 90.0), np.full((1251, 701), -50.0))
    far = P.ShiftGrid(np.full((2, 2), 90.0), np.full((2, 2), -50.0))
    a, b = grid.extent(-3.2, 51.4, -3.1, 51.5, 200.0), far.extent(-3.2, 51.4, -3.1, 51.5, 200.0)
    assert a[0] < a[2] and abs(a[0] - b[0] - 90) < 1e-6 and abs(a[1] - b[1] + 50) < 1e-6


def test_points_in_rings_of_all_sizes(spark):
    boxes = [(0, 0, 4, 4), (-500, -500, 500, 500), (1e5, 1e5, 1e5 + 3, 1e5 + 3), (-1e6, -1e6, 1e6, 1e6)]
    rings = spark.createDataFrame([(k, [{"x": float(x), "y": float(y)} for x, y in [(a, b), (c, b), (c, d), (a, d)]]) for k, (a, b, c, d) in enumerate(boxes)], "k int, ring array<struct<x:double,y:double>>")
    points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate([(1, 1), (400, -400), (100001, 100001), (2e6, 0)])], "i int, x double, y double")
    want = {(i, k) for i, (x, y) in enumerate([(1, 1), (400, -400), (100001, 100001), (2e6, 0)]) for k, (a, b, c, d) in enumerate(boxes) if a <= x < c and b <= y < d}
    for overflow in (4, 10_000):
        assert {(r["i"], r["k"]) for r in spatial.points_in_rings(points, rings, "x", "y", "ring", 2.0, overflow).collect()} == want
    assert spatial.points_in_rings(points, rings.limit(0), "x", "y", "ring", 2.0).count() == 0
