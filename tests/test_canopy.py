"""Heights of canopy at ties of rounding."""

from __future__ import annotations

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from sitewright.operators import raster


def test_heights_at_ties_are_those_of_sql(spark):
    """Differences of decimals lie a bit off the ties they stand for; what comes of them must be what SQL makes of the same bits."""
    dice = random.Random(3)
    rows = [(k * 50 + i, 0, dice.randint(10, 50) / 10 - dice.randint(1, 40) / 10) for k in range(400) for i in range(2 + k % 12)]
    found = raster.canopy(spark.createDataFrame(rows, "col long, row long, height double"), 1_000_000, 1.0, (0.0, 30.0), least_area=2.0)
    got = {r["cluster"]: (r["pixels"], r["height"], r["crown_radius"]) for r in found.collect()}
    c = duckdb.connect()
    c.execute("CREATE TABLE p (k BIGINT, h DOUBLE)")
    c.executemany("INSERT INTO p VALUES (?, ?)", [(col // 50 * 50, h) for col, _, h in rows])
    want = {r[0]: r[1:] for r in c.execute("SELECT k, count(*), round_even(quantile_cont(h, 0.9), 1), round_even(sqrt(count(*) / pi()), 1) FROM p GROUP BY k").fetchall()}
    assert got == want


@pytest.mark.parametrize(("values", "share", "want"), [([4.0], 0.9, 4.0), ([3.4, 3.6], 0.5, 3.5), ([1.0, 2.0, 9.0], 0.5, 2.0), ([], 0.9, None)])
def test_interpolated(spark, values, share, want):
    assert spark.createDataFrame([(values,)], "v array<double>").select(raster.interpolated("v", share).alias("q")).first()["q"] == want


def test_decimetres(spark):
    """The product with ten decides, so a value just beside a tie may count as one."""
    values = [4.05, 3.3499999999999996, 3.6500000000000004, 0.25]
    assert [r["d"] for r in spark.createDataFrame([(v,) for v in values], "v double").select(raster.decimetres(F.col("v")).alias("d")).collect()] == [4.0, 3.4, 3.6, 0.2]
