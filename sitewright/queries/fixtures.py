"""Views that every query derives from the given tables, in SQL that Spark and DuckDB both run.

The tables hold no geometry, so footprints, roads, rasters and parcels are made
from their keys by arithmetic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sitewright.session import ship

VIEWS: dict[str, str] = {
    # two rectangle datasets; feeds J03-J09, G11, A09, A17.
    "fx_footprints": """
SELECT src, fid, e0 + dx AS e0, n0 + dy AS n0, e0 + dx + w AS e1, n0 + dy + h AS n1
FROM (
  SELECT 'ours' AS src, o_orderkey AS fid,
         CAST((o_orderkey % 61) * 14 AS DOUBLE) AS e0,
         FLOOR(CAST(o_orderkey AS DOUBLE) / 61) * CAST(11 AS DOUBLE) AS n0,
         CAST(6 + o_custkey % 7 AS DOUBLE) AS w, CAST(5 + o_orderkey % 4 AS DOUBLE) AS h,
         CAST(0 AS DOUBLE) AS dx, CAST(0 AS DOUBLE) AS dy
  FROM orders
  UNION ALL
  SELECT 'theirs', o_orderkey,
         CAST((o_orderkey % 61) * 14 AS DOUBLE),
         FLOOR(CAST(o_orderkey AS DOUBLE) / 61) * CAST(11 AS DOUBLE),
         CAST(7 + o_custkey % 7 AS DOUBLE), CAST(5 + o_orderkey % 4 AS DOUBLE),
         CAST(o_custkey % 5 - 2 AS DOUBLE), CAST(o_custkey % 3 - 1 AS DOUBLE)
  FROM orders WHERE o_orderkey % 5 <> 0
) f
""",
    # long-form rings: rectangles (4 vertices) and L-shapes (6, concave) in seq order; feeds F05, G01, G06, D02, D03.
    "fx_ring_vertices": """
SELECT src, fid, k AS seq,
  CASE WHEN k IN (1, 2) THEN e1 WHEN fid % 3 = 0 AND k IN (3, 4) THEN (e0 + e1) / 2 WHEN k = 2 THEN e1 ELSE e0 END AS x,
  CASE WHEN fid % 3 = 0 THEN CASE WHEN k IN (0, 1) THEN n0 WHEN k IN (2, 3) THEN (n0 + n1) / 2 ELSE n1 END
       ELSE CASE WHEN k IN (0, 1) THEN n0 ELSE n1 END END AS y
FROM fx_footprints CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5)) AS v(k)
WHERE fid % 3 = 0 OR k < 4
""",
    # element versions for keyed dedup; feeds D01/A01, T01.
    "fx_osm": """
SELECT CASE l_returnflag WHEN 'N' THEN 'node' WHEN 'A' THEN 'way' ELSE 'relation' END AS type,
       l_orderkey AS id, l_linenumber AS version, l_partkey AS part_ord, l_suppkey AS supp_ord,
       l_quantity AS quantity
FROM lineitem
""",
    # polylines, `theirs` shifted by (0.5,-0.25); feeds W01, W02, J10, A07, A08.
    "fx_roads": """
SELECT side, user_id AS line_id, seq, CAST(user_id * 40 + seq * 7 AS DOUBLE) + de AS e, CAST(event_id % 13 AS DOUBLE) + dn AS n
FROM (SELECT user_id, event_id, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events) r
CROSS JOIN (VALUES ('ours', CAST(0 AS DOUBLE), CAST(0 AS DOUBLE)), ('theirs', CAST(0.5 AS DOUBLE), CAST(-0.25 AS DOUBLE))) AS s(side, de, dn)
""",
    # sparse 40x30 grids side by side, one for each 1500 orders (absent pixel = NaN); dsm-dtm reaches 4.9; feeds J11, A04, R03, R10.
    "fx_raster": """
SELECT col, row_no, MIN(l_quantity) / 10 AS dtm, MAX(l_quantity) / 10 AS dsm
FROM (SELECT l_partkey % 40 + 50 * CAST(FLOOR(CAST(l_orderkey AS DOUBLE) / 1500) AS BIGINT) AS col, l_orderkey % 30 AS row_no, l_quantity FROM lineitem WHERE l_partkey % 7 <> 0) q
GROUP BY col, row_no
""",
    # edge-sharing 20 m squares; feeds A05, D03, R06-R09.
    "fx_parcels": """
SELECT c_custkey AS parcel_id,
       CAST((c_custkey % 40) * 20 AS DOUBLE) AS e0, FLOOR(CAST(c_custkey AS DOUBLE) / 40) * CAST(20 AS DOUBLE) AS n0,
       CAST((c_custkey % 40) * 20 + 20 AS DOUBLE) AS e1, FLOOR(CAST(c_custkey AS DOUBLE) / 40) * CAST(20 AS DOUBLE) + 20 AS n1
FROM customer
""",
    # land-use squares plus `building`; `unmapped` must emit no bucket; feeds J06, A05.
    "fx_overlays": """
SELECT class, e0, n0, e0 + w AS e1, n0 + w AS n1 FROM (
  SELECT CASE p_size % 6 WHEN 0 THEN 'residential' WHEN 1 THEN 'farmland' WHEN 2 THEN 'pitch' WHEN 3 THEN 'retail' WHEN 4 THEN 'grass' ELSE 'unmapped' END AS class,
         CAST((p_partkey % 40) * 20 + p_size % 7 AS DOUBLE) AS e0, FLOOR(CAST(p_partkey AS DOUBLE) / 40) * CAST(20 AS DOUBLE) AS n0, CAST(8 + p_size % 9 AS DOUBLE) AS w
  FROM part
  UNION ALL
  SELECT 'building', CAST((s_suppkey % 40) * 20 + 5 AS DOUBLE), FLOOR(CAST(s_suppkey AS DOUBLE) / 40) * CAST(20 AS DOUBLE) + 5, CAST(6 AS DOUBLE) FROM supplier
) o
""",
    # points on a unit square; site = [0.25,0.75]^2, margin = [0.15,0.85]^2; feeds F20, J17, A11.
    "fx_constraints": """
SELECT n_nationkey AS layer_ord, n_name AS designation, r_name AS grp, c_mktsegment AS grade, c_name AS name,
       CAST(c_custkey % 100 AS DOUBLE) / 100 AS x, CAST(c_custkey % 37 AS DOUBLE) / 37 AS y
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
""",
    # job event log, last seq wins; feeds C02, C05, C08, J18.
    "fx_jobs": """
SELECT CONCAT('r', LPAD(CAST(user_id % 10 AS VARCHAR(10)), 2, '0'), '_c', LPAD(CAST(user_id % 7 AS VARCHAR(10)), 2, '0')) AS tile_id,
       event_type AS source, CASE WHEN event_id % 11 = 0 THEN 'failed' WHEN event_id % 3 = 0 THEN 'ok' ELSE 'pending' END AS status,
       event_id AS seq, ts, value AS seconds
FROM events
""",
}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of VIEWS as a DataFrame."""
    return sql(spark, sf_dir, VIEWS[name])


def sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Spark SQL over the tables and views that it names."""
    for name in VIEWS:
        if name in text and text != VIEWS[name]:
            view(spark, sf_dir, name).createOrReplaceTempView(name)
    for name in TABLES:
        if name in text:
            table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(text)


def with_views(text: str) -> str:
    """The same SQL for an engine without these views: the ones it needs come first, as common table expressions."""
    need: list[str] = []

    def add(body: str) -> None:
        for name in VIEWS:
            if name in body and name not in need and body != VIEWS[name]:
                add(VIEWS[name])
                need.append(name)

    add(text)
    recursive = text.lstrip().upper().startswith("WITH RECURSIVE")
    rest = text.lstrip()
    rest = rest[len("WITH RECURSIVE") if recursive else len("WITH") :] if rest.upper().startswith("WITH") else None
    own = [f"{n} AS ({VIEWS[n]})" for n in need]
    if not own:
        return text
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join(own) + (",\n" + rest if rest is not None else "\n" + text)
