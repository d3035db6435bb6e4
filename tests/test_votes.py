"""Grid points of parcels that overlays cover, counted without a row for each point."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sitewright import queries
from sitewright.functions import geometry as G
from sitewright.operators import land, spatial

RING = "array<struct<x:double,y:double>>"


def star(dice, x, y, size, corners):
    """A ring that is not convex; some cross themselves."""
    return [{"x": x + dice.uniform(-size, size), "y": y + dice.uniform(-size, size)} for _ in range(corners)]


@pytest.fixture(scope="module")
def shapes(spark):
    dice = random.Random(4)
    parcels = [(k, star(dice, dice.uniform(0, 90), dice.uniform(0, 90), dice.choice([4, 30, 120]), dice.randint(3, 9))) for k in range(40)]
    parcels += [(90, [{"x": 0.0, "y": 0.0}, {"x": 400.0, "y": 0.0}, {"x": 400.0, "y": 3.0}, {"x": 0.0, "y": 3.0}]), (91, [{"x": 5.0, "y": 5.0}] * 3), (92, []), (93, None)]
    kinds = ["garden", "field", "recreation", "building"]
    covers = [(dice.choice(kinds), star(dice, dice.uniform(0, 90), dice.uniform(0, 90), dice.choice([3, 20, 300]), dice.randint(3, 7))) for _ in range(60)]
    covers += [("field", [{"x": -1e5, "y": 40.0}, {"x": 1e5, "y": 40.0}, {"x": 1e5, "y": 41.5}, {"x": -1e5, "y": 41.5}])]
    return spark.createDataFrame(parcels, f"parcel_id long, ring {RING}"), spark.createDataFrame(covers, f"bucket string, ring {RING}")


def samples(parcels, step):
    dots = parcels.select("parcel_id", "ring", F.posexplode(G.grid(G.bbox("ring"), step)).alias("sample_id", "p")).select("parcel_id", "sample_id", "ring", "p.x", "p.y")
    return dots.where(G.in_ring("x", "y", "ring")).drop("ring")


@pytest.mark.parametrize("step", [0.7, 2.5])
def test_grids_give_what_points_give(shapes, step):
    parcels, covers = shapes
    assert sorted(land.classify_grid(parcels, covers, step, 20.0).collect()) == sorted(land.classify(samples(parcels, step), covers, 20.0).collect())


@pytest.mark.parametrize("overflow", [4, 10_000])
def test_covered_points_count_once(shapes, overflow):
    parcels, covers = shapes
    hits = spatial.points_in_rings(samples(parcels, 1.5), covers, "x", "y", "ring", 20.0).select("parcel_id", "sample_id", "bucket").distinct()
    want = {(r[0], r[1]): r[2] for r in hits.groupBy("parcel_id", "bucket").count().collect()}
    got = {(r[0], r[1]): r[2] for r in spatial.covered_grid_points(parcels, covers, "parcel_id", "bucket", 1.5, 20.0, overflow).collect()}
    assert len(want) > 100 and got == want


def test_pieces_of_a_pair_join_up():
    import numpy as np

    a, b = (np.array([(r["x"], r["y"]) for r in star(random.Random(k), 0, 0, 60, 8)]) for k in (1, 2))
    parts = [[(int(w), int(v)) for _, word, bits in spatial.grid_hits([a], [b], 0.9, most) for w, v in zip(word, bits)] for most in (1, 10**6)]
    joined = {}
    for w, v in parts[0]:
        joined[w] = joined.get(w, 0) | v
    assert len(parts[0]) > len(parts[1]) > 10 and joined == dict(parts[1])


@pytest.mark.parametrize("name", ["parcel_majority", "overlay_votes"])
def test_no_row_for_each_sample(spark, sf, name):
    queries.load()
    assert "posexplode" not in queries.QUERIES[name](spark, sf)._jdf.queryExecution().toString()
