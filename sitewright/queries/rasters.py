"""Rasters: sampling, heights, canopy, contours, grids and roofs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewright.functions import geometry as G
from sitewright.operators import curves, raster, roofs
from sitewright.queries import query
from sitewright.queries.fixtures import table, view, with_views

#: The view's raster: pixels of one metre, its north-west corner at (0, 30); its width grows with the tables, up to this bound.
ORIGIN = (0.0, 30.0)
WIDTH = 1_000_000


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = view(spark, sf_dir, "fx_raster")
    return v.select("col", F.col("row_no").alias("row"), F.col("dtm").cast("double"), F.col("dsm").cast("double"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Footprints on the raster, one for each supplier."""
    s = table(spark, sf_dir, "supplier")
    e, n = (F.col("s_suppkey") % 31 + 50 * F.floor(F.col("s_suppkey") / 10)).cast("double"), (F.col("s_suppkey") % 23).cast("double")
    return s.select(F.col("s_suppkey").alias("fid"), G.rectangle(e, n, e + 4 + F.col("s_suppkey") % 3, n + 3 + F.col("s_suppkey") % 4).alias("ring"))


_BOXES = "boxes AS (SELECT s_suppkey AS fid, CAST(s_suppkey % 31 + 50 * (s_suppkey // 10) AS DOUBLE) AS e0, CAST(s_suppkey % 23 AS DOUBLE) AS n0, CAST(s_suppkey % 31 + 50 * (s_suppkey // 10) + 4 + s_suppkey % 3 AS DOUBLE) AS e1, CAST(s_suppkey % 23 + 3 + s_suppkey % 4 AS DOUBLE) AS n1 FROM supplier)"
_SAMPLES = f"""WITH {_BOXES},
pts AS (SELECT fid, e0 + c AS x, n0 + r AS y FROM (SELECT *, unnest(range(0, CAST(n1 - n0 AS BIGINT))) AS r FROM (SELECT *, unnest(range(0, CAST(e1 - e0 AS BIGINT))) AS c FROM boxes))),
k AS (SELECT fid, x, y, floor(x - 0.5) AS c0, floor(30 - y - 0.5) AS r0, x - 0.5 - floor(x - 0.5) AS tx, 30 - y - 0.5 - floor(30 - y - 0.5) AS ty FROM pts),
w AS (SELECT fid, x, y, c0 + i AS col, r0 + j AS row_no, (CASE WHEN i = 1 THEN tx ELSE 1 - tx END) * (CASE WHEN j = 1 THEN ty ELSE 1 - ty END) AS w FROM k, (VALUES (0), (1)) a(i), (VALUES (0), (1)) b(j)),
s AS (SELECT fid, x, y, sum(CAST(dtm AS DOUBLE) * w) / sum(w) AS dtm, sum(CAST(dsm AS DOUBLE) * w) / sum(w) AS dsm FROM w JOIN fx_raster USING (col, row_no) WHERE w > 0 GROUP BY fid, x, y)
"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = raster.footprint_points(boxes(spark, sf_dir)).withColumns({"px": F.col("x"), "py": F.col("y")})
    return raster.sample(points, pixels(spark, sf_dir), ["fid", "px", "py"], 1.0, ORIGIN, ["dtm", "dsm"])


@query(with_views(_SAMPLES + "SELECT fid, count(*) AS samples, round(sum(dtm), 3) AS sum_dtm, round(sum(dsm), 3) AS sum_dsm FROM s GROUP BY fid"))
def raster_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).groupBy("fid").agg(F.count("*").alias("samples"), F.round(F.sum("dtm"), 3).alias("sum_dtm"), F.round(F.sum("dsm"), 3).alias("sum_dsm"))


@query(with_views(_SAMPLES + """
SELECT fid, round_even(round(quantile_cont(dsm, 0.9) - quantile_cont(dtm, 0.5), 6), 1) AS height FROM s GROUP BY fid HAVING count(*) >= 3 AND round_even(round(quantile_cont(dsm, 0.9) - quantile_cont(dtm, 0.5), 6), 1) >= 2
"""))  # fmt: skip
def building_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.heights(samples(spark, sf_dir)).select("fid", "height")


@query(with_views("""
WITH p AS (SELECT DISTINCT c_custkey AS id, CAST(c_custkey % 45 AS DOUBLE) + 0.5 AS x, 29.5 - c_custkey % 33 AS y FROM customer), l AS (SELECT col + 0.5 AS x, 29.5 - row_no AS y, CAST(dtm AS DOUBLE) AS z FROM fx_raster),
d AS (SELECT col + 0.5 AS x, 29.5 - row_no AS y, CAST(dsm AS DOUBLE) AS z FROM fx_raster WHERE col % 2 = 0), g AS (SELECT id, p.x, p.y, d.z AS a, l.z AS b FROM p LEFT JOIN d ON d.x = p.x AND d.y = p.y LEFT JOIN l ON l.x = p.x AND l.y = p.y)
SELECT id, coalesce(a, b) AS z, CASE WHEN a IS NOT NULL THEN 0 WHEN b IS NOT NULL THEN 1 END AS layer FROM g
"""))  # fmt: skip
def elevation_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fine raster's value where it has one, else a coarse one's, else nothing."""
    points = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), ((F.col("c_custkey") % 45).cast("double") + 0.5).alias("x"), (F.lit(29.5) - F.col("c_custkey") % 33).alias("y"))
    p = pixels(spark, sf_dir)
    fine = raster.sample(points, p.where("col % 2 = 0").withColumn("z", F.col("dsm")), ["id"], 1.0, ORIGIN)
    coarse = raster.sample(points, p.withColumn("z", F.col("dtm")), ["id"], 1.0, ORIGIN)
    return raster.coalesced(points, [fine, coarse], ["id"]).select("id", "z", "layer")


_HIGH = f"""WITH RECURSIVE {_BOXES},
hi AS (SELECT CAST(col AS BIGINT) AS col, CAST(row_no AS BIGINT) AS row_no, CAST(dsm AS DOUBLE) - CAST(dtm AS DOUBLE) AS h FROM fx_raster r WHERE CAST(dsm AS DOUBLE) - CAST(dtm AS DOUBLE) >= 3
  AND NOT EXISTS (SELECT 1 FROM boxes b WHERE b.fid % 5 = 0 AND r.col + 0.5 >= b.e0 AND r.col + 0.5 < b.e1 AND 29.5 - r.row_no >= b.n0 AND 29.5 - r.row_no < b.n1))
"""


def canopy_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.canopy_pixels(pixels(spark, sf_dir), boxes(spark, sf_dir).where("fid % 5 = 0"), 1.0, ORIGIN)


@query(with_views(_HIGH + "SELECT col, row_no AS \"row\", round(h, 6) AS height FROM hi"))
def canopy_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canopy_frame(spark, sf_dir).select(F.col("col").cast("long"), F.col("row").cast("long"), F.round("height", 6).alias("height"))


@query(with_views(_HIGH + """, t AS (SELECT *, row_no * 1000000 + col AS k FROM hi), e AS (SELECT a.k AS a, b.k AS b FROM t a JOIN t b ON (abs(a.col - b.col) + abs(a.row_no - b.row_no)) = 1),
r AS (SELECT k, k AS to_k FROM t UNION SELECT r.k, e.b FROM r JOIN e ON e.a = r.to_k),
c AS (SELECT k, min(to_k) AS cluster FROM r GROUP BY k),
g AS (SELECT cluster, count(*) AS pixels, round_even(quantile_cont(h, 0.9), 1) AS height, round_even(sqrt(count(*) / pi()), 1) AS crown_radius, avg(col) + 0.5 AS x, 29.5 - avg(row_no) AS y FROM c JOIN t USING (k) GROUP BY cluster)
SELECT cluster, pixels, height, crown_radius, round(x, 6) AS x, round(y, 6) AS y FROM g WHERE pixels >= 2
"""))  # fmt: skip
def canopy_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = raster.canopy(canopy_frame(spark, sf_dir), WIDTH, 1.0, ORIGIN, least_area=2.0)
    return found.select(F.col("cluster").cast("long"), "pixels", "height", "crown_radius", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query(with_views("""
WITH p AS (SELECT col, row_no, CAST(dsm AS DOUBLE) + 0.05 AS z FROM fx_raster),
q AS (SELECT a.col AS c, a.row_no AS r, a.z AS tl, b.z AS tr, d.z AS bl, e.z AS br FROM p a JOIN p b ON b.col = a.col + 1 AND b.row_no = a.row_no JOIN p d ON d.col = a.col AND d.row_no = a.row_no + 1 JOIN p e ON e.col = a.col + 1 AND e.row_no = a.row_no + 1),
l AS (SELECT *, unnest(range(CAST(floor(least(tl, tr, bl, br)) AS BIGINT), CAST(ceil(greatest(tl, tr, bl, br)) AS BIGINT) + 1)) AS k FROM q),
f AS (SELECT *, CAST(k AS DOUBLE) AS level, (CAST(tl > k AS INT) <> CAST(tr > k AS INT))::INT + (CAST(tr > k AS INT) <> CAST(br > k AS INT))::INT + (CAST(br > k AS INT) <> CAST(bl > k AS INT))::INT + (CAST(bl > k AS INT) <> CAST(tl > k AS INT))::INT AS crossings
  FROM l WHERE k >= least(tl, tr, bl, br) AND k < greatest(tl, tr, bl, br))
SELECT level, CAST(sum(crossings // 2) AS BIGINT) AS segments FROM f GROUP BY level
"""))  # fmt: skip
def contour_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments per level; no pixel of the shifted surface lies on one, so none shrinks to a point."""
    p = pixels(spark, sf_dir).select("col", "row", (F.col("dsm") + 0.05).alias("z"))
    return raster.contour_segments(p, 1.0, 1.0, ORIGIN).groupBy("level").agg(F.count("*").alias("segments"))


@query()
def contour_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contours of the surface on a rolling ground, as it is level by itself where the tables are large."""
    p = pixels(spark, sf_dir).select("col", "row", (F.col("dsm") + 2 * F.sin(F.col("col") / 3) + 2 * F.cos(F.col("row") / 4)).alias("z"))
    seg = raster.contour_segments(p, 1.0, 1.0, ORIGIN).withColumn("interval", F.lit(1.0))
    return curves.chain_groups(seg, ["interval", "level"], ["row", "col", "part"]).select("interval", "level", F.size("curve").alias("vertices"), F.to_json("curve").alias("curve"))


@query("""
SELECT o_orderkey AS id, CASE WHEN a <= 1500000 THEN '5,1,0.5,0.25' WHEN a <= 6000000 THEN '5,1' ELSE '5' END AS intervals FROM (SELECT o_orderkey, CAST(o_custkey AS DOUBLE) * 60000 AS a FROM orders)
""")
def contour_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey").cast("double") * 60000).alias("a"))
    say = F.transform(raster.intervals(F.col("a")), lambda v: F.when(v == F.floor(v), v.cast("int").cast("string")).otherwise(v.cast("string")))
    return o.select("id", F.array_join(say, ",").alias("intervals"))


@query("""
WITH s AS (SELECT o_orderkey AS id, CAST(200 + o_custkey * 3 AS DOUBLE) AS w, CAST(150 + o_orderkey % 9000 AS DOUBLE) AS h FROM orders),
t AS (SELECT *, CASE WHEN greatest(w, h) <= 2000 THEN 5.0::DOUBLE WHEN greatest(w, h) <= 10000 THEN 15.0::DOUBLE ELSE 50.0::DOUBLE END AS lo, CASE WHEN greatest(w, h) <= 2000 THEN 15.0::DOUBLE WHEN greatest(w, h) <= 10000 THEN 50.0::DOUBLE ELSE 200.0::DOUBLE END AS hi FROM s),
a AS (SELECT *, greatest(8, least(4000, CAST(round_even(w / sqrt(lo * hi), 0) AS INT))) AS n1, greatest(8, least(4000, CAST(round_even(h / sqrt(lo * hi), 0) AS INT))) AS m1 FROM t),
b AS (SELECT *, CASE WHEN w / n1 < lo THEN greatest(8, least(4000, CAST(floor(w / lo) AS INT))) WHEN w / n1 > hi THEN greatest(8, least(4000, CAST(ceil(w / hi) AS INT))) ELSE n1 END AS nx,
  CASE WHEN h / m1 < lo THEN greatest(8, least(4000, CAST(floor(h / lo) AS INT))) WHEN h / m1 > hi THEN greatest(8, least(4000, CAST(ceil(h / hi) AS INT))) ELSE m1 END AS ny FROM a),
c AS (SELECT *, greatest(8, least(4000, CAST(round_even(h / (w / nx), 0) AS INT))) AS sq FROM b)
SELECT id, nx + 1 AS nx, (CASE WHEN h / sq BETWEEN lo AND hi THEN sq ELSE ny END) + 1 AS ny, round(w / nx, 6) AS dx, round(CASE WHEN h / sq BETWEEN lo AND hi THEN h / sq ELSE h / ny END, 6) AS dy FROM c
""")
def elevation_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (200 + F.col("o_custkey") * 3).cast("double").alias("w"), (150 + F.col("o_orderkey") % 9000).cast("double").alias("h"))
    g = o.select("id", raster.elevation_grid(F.col("w"), F.col("h")).alias("g"))
    return g.select("id", "g.nx", "g.ny", F.round("g.dx", 6).alias("dx"), F.round("g.dy", 6).alias("dy"))


@query(with_views("""
WITH i AS (SELECT col, row_no, row_number() OVER (ORDER BY row_no, col) - 1 AS v FROM fx_raster)
SELECT a.v AS v0, b.v AS v1, c.v AS v2, d.v AS v3 FROM i a JOIN i b ON b.col = a.col + 1 AND b.row_no = a.row_no JOIN i c ON c.col = a.col + 1 AND c.row_no = a.row_no + 1 JOIN i d ON d.col = a.col AND d.row_no = a.row_no + 1
"""))  # fmt: skip
def mesh_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.mesh_faces(pixels(spark, sf_dir))


@query(with_views("SELECT count(*) AS nodes, min(CAST(dsm AS DOUBLE)) AS lowest, max(CAST(dsm AS DOUBLE)) AS highest, (max(col) + 1) * 30 - count(*) AS absent FROM fx_raster"))
def grid_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many nodes of a grid have a height, and its bounds."""
    p = pixels(spark, sf_dir)
    return p.agg(F.count("*").alias("nodes"), F.min("dsm").alias("lowest"), F.max("dsm").alias("highest"), ((F.max("col") + 1) * 30 - F.count("*")).alias("absent"))


@query()
def roof_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roof forms of buildings whose surfaces are made from their keys."""
    s = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("fid"), (F.col("c_custkey") % 4).cast("int").alias("kind"), (8 + F.col("c_nationkey") % 5).cast("int").alias("w"))
    cells = s.withColumn("e", F.explode(F.sequence(F.lit(0), F.col("w")))).withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(7))))
    middle = F.col("w") / 2
    z = F.when(F.col("kind") == 0, F.lit(4.0)).when(F.col("kind") == 1, 3 + 0.5 * F.col("e")).when(F.col("kind") == 2, 6 - 0.7 * F.abs(F.col("e") - middle)).otherwise(4 + F.sin(F.col("e") * F.col("n")) * 2)
    return roofs.fit(cells.select("fid", F.col("e").cast("double"), F.col("n").cast("double"), z.alias("z")))
