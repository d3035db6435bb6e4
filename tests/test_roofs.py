"""Roofs solved many to a batch, with all trials of a plane at once."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitewright.operators import roofs


def plain_planes(p):
    """One trial after the other."""
    dice, free, found = random.Random(0), np.arange(len(p)), []
    near = lambda fit: free[np.abs(p[free, :2] @ fit[:2] + fit[2] - p[free, 2]) <= roofs.TOLERANCE]
    while len(free) >= roofs.MIN_INLIERS and len(found) < roofs.PLANES:
        best = free[:0]
        for _ in range(roofs.TRIALS):
            three = p[dice.sample(free.tolist(), 3)]
            sides = three[1:, :2] - three[0, :2]
            if abs(np.linalg.det(sides)) < 1e-9:
                continue
            slope = np.linalg.solve(sides, three[1:, 2] - three[0, 2])
            hit = near(np.append(slope, three[0, 2] - slope @ three[0, :2]))
            if len(hit) > len(best):
                best = hit
                if len(best) >= 0.9 * len(free):
                    break
        fit = roofs.trimmed(p[best]) if len(best) >= roofs.MIN_INLIERS else None
        if fit is None or len(own := near(fit)) < roofs.MIN_INLIERS:
            break
        found.append((fit, own))
        free = np.setdiff1d(free, own)
    return found


def roof(kind, w, noise, dice):
    e, n = (v.ravel() for v in np.meshgrid(np.arange(w + 1.0), np.arange(8.0)))
    z = [np.full(len(e), 4.0), 3 + 0.5 * e, 6 - 0.7 * np.abs(e - w / 2), 4 + np.sin(e * n) * 2, 6 - 0.7 * np.abs(e - w / 2) - np.where(n > 3, 0.25 * n, 0)][kind]
    return np.column_stack([e, n, z + dice.normal(0, noise, len(e))])


def test_trials_together_find_what_one_after_the_other_finds():
    dice = np.random.default_rng(1)
    for kind in range(5):
        for w in (4, 9, 12):
            for noise in (0.0, 0.1, 0.25):
                p = roof(kind, w, noise, dice)
                got, want = roofs.planes(p), plain_planes(p)
                assert [own.tolist() for _, own in got] == [own.tolist() for _, own in want]
                assert all(np.array_equal(a, b) for (a, _), (b, _) in zip(got, want))


@pytest.mark.parametrize("rows", [7, 10_000])
def test_buildings_over_several_batches(spark, rows):
    dice = np.random.default_rng(2)
    shapes = {f"b{k}": roof(k % 5, 6 + k % 7, 0.05, dice) for k in range(30)} | {"few": roof(0, 1, 0.0, dice)[:10]}
    cells = [(fid, *map(float, v)) for fid, p in shapes.items() for v in p]
    random.Random(5).shuffle(cells)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    try:
        found = roofs.fit(spark.createDataFrame(cells, "fid string, e double, n double, z double"))
        got = {r["fid"]: {k: v for k, v in r.asDict().items() if k != "fid"} for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = {fid: roofs.form(p - np.array([*p[:, :2].mean(0), 0])) for fid, p in shapes.items()}
    assert got == {fid: f for fid, f in want.items() if f}
    assert len(got) > 15 and "InPandas" not in found._jdf.queryExecution().toString()


def test_no_samples(spark):
    assert roofs.fit(spark.range(0).select(F.col("id").alias("fid"), *[F.lit(1.0).alias(c) for c in ("e", "n", "z")])).count() == 0
