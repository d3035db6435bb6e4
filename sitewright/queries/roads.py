"""Roads: segments, samples along them, and how far two sources lie apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewright.operators import spatial
from sitewright.queries import query
from sitewright.queries.fixtures import table, view, with_views

#: Metres between samples on a road, and how far the other source is searched.
EVERY = 5.0
RADIUS = 15.0


def lines(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    v = view(spark, sf_dir, "fx_roads").where(F.col("side") == side)
    return v.select("line_id", "seq", F.col("e").alias("x"), F.col("n").alias("y"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    dense = spatial.densify(lines(spark, sf_dir, "ours"), "line_id", "seq", EVERY)
    return dense.withColumn("sample_id", F.struct("line_id", "seq", "step"))


def other_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = spatial.segments(lines(spark, sf_dir, "theirs"), "line_id", "seq")
    return seg.select(F.struct(F.col("line_id").alias("l"), F.col("seq").alias("s")).alias("seg_id"), F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("nx").alias("x1"), F.col("ny").alias("y1"))


_OFFSETS = """
WITH seg AS (SELECT side, line_id, seq, e, n, lead(e) OVER w AS ne, lead(n) OVER w AS nn FROM fx_roads WINDOW w AS (PARTITION BY side, line_id ORDER BY seq)),
smp AS (SELECT line_id, seq, k, e + (ne - e) * k * 5.0 / len AS x, n + (nn - n) * k * 5.0 / len AS y FROM (
    SELECT *, sqrt((ne - e) * (ne - e) + (nn - n) * (nn - n)) AS len, unnest(range(0, CAST(floor(sqrt((ne - e) * (ne - e) + (nn - n) * (nn - n)) / 5.0) AS BIGINT) + 1)) AS k
    FROM seg WHERE side = 'ours' AND ne IS NOT NULL) WHERE k = 0 OR k * 5.0 < len
  UNION ALL SELECT line_id, seq, 0, e, n FROM seg WHERE side = 'ours' AND ne IS NULL),
th AS (SELECT line_id, seq, e, n, ne - e AS tx, nn - n AS ty, (ne - e) * (ne - e) + (nn - n) * (nn - n) AS l2, least(e, ne) - 15 AS x0, greatest(e, ne) + 15 AS x1, least(n, nn) - 15 AS y0, greatest(n, nn) + 15 AS y1
  FROM seg WHERE side = 'theirs' AND ne IS NOT NULL),
hit AS (SELECT s.line_id, s.seq, s.k, s.x, s.y, t.tx, t.ty, t.line_id AS tl, t.seq AS ts, t.e, t.n, greatest(0.0, least(1.0, ((s.x - t.e) * t.tx + (s.y - t.n) * t.ty) / t.l2)) AS u
  FROM smp s JOIN th t ON s.x BETWEEN t.x0 AND t.x1 AND s.y BETWEEN t.y0 AND t.y1),
d AS (SELECT *, e + u * tx - x AS de, n + u * ty - y AS dn FROM hit),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY line_id, seq, k ORDER BY sqrt(de * de + dn * dn), tl, ts) AS rn FROM d WHERE sqrt(de * de + dn * dn) <= 15) WHERE rn = 1),
o AS (SELECT s.line_id, s.seq, s.k, b.de, b.dn, b.u, b.tx / sqrt(b.tx * b.tx + b.ty * b.ty) AS te, b.ty / sqrt(b.tx * b.tx + b.ty * b.ty) AS tn, b.tl FROM smp s LEFT JOIN b USING (line_id, seq, k))
"""


def offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.nearest_segments(samples(spark, sf_dir), other_segments(spark, sf_dir), RADIUS)


@query(with_views("""
SELECT line_id, seq, e, n, ne, nn FROM (SELECT *, lead(e) OVER w AS ne, lead(n) OVER w AS nn FROM fx_roads WHERE side = 'ours' WINDOW w AS (PARTITION BY line_id ORDER BY seq)) WHERE ne IS NOT NULL
"""))  # fmt: skip
def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.segments(lines(spark, sf_dir, "ours"), "line_id", "seq").select("line_id", "seq", F.col("x").alias("e"), F.col("y").alias("n"), F.col("nx").alias("ne"), F.col("ny").alias("nn"))


@query(with_views(_OFFSETS + "SELECT line_id, count(*) AS samples, round(sum(x), 4) AS sum_x, round(sum(y), 4) AS sum_y FROM smp GROUP BY line_id"))
def densify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).groupBy("line_id").agg(F.count("*").alias("samples"), F.round(F.sum("x"), 4).alias("sum_x"), F.round(F.sum("y"), 4).alias("sum_y"))


@query(with_views(_OFFSETS + """
SELECT line_id, count(tl) AS "count", count(*) - count(tl) AS unmatched, round(CASE WHEN count(tl) >= 5 THEN avg(de) ELSE 0 END, 5) AS mean_de, round(CASE WHEN count(tl) >= 5 THEN avg(dn) ELSE 0 END, 5) AS mean_dn,
  round(CASE WHEN count(tl) >= 5 THEN stddev_pop(de) ELSE 0 END, 5) AS std_de, round(CASE WHEN count(tl) >= 5 THEN quantile_cont(sqrt(de * de + dn * dn), 0.9) ELSE 0 END, 5) AS p90_abs FROM o GROUP BY line_id
"""))  # fmt: skip
def nearest_segment_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spatial.offset_statistics(offsets(spark, sf_dir), ["line_id"])
    return s.select("line_id", "count", "unmatched", *[F.round(c, 5).alias(c) for c in ("mean_de", "mean_dn", "std_de", "p90_abs")])


@query(with_views(_OFFSETS + """
, m AS (SELECT sum(tn * tn) AS xx, sum(-tn * te) AS xy, sum(te * te) AS yy, sum(de) AS ve, sum(dn) AS vn, count(*) AS n FROM o WHERE tl IS NOT NULL AND u > 0 AND u < 1)
SELECT n AS interior, round((ve * yy - xy * vn) / (xx * yy - xy * xy), 4) AS lsq_de, round((xx * vn - xy * ve) / (xx * yy - xy * xy), 4) AS lsq_dn FROM m
"""))  # fmt: skip
def lsq_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shift between the two sources that explains the perpendicular offsets best."""
    return spatial.offset_statistics(offsets(spark, sf_dir), []).select("interior", F.round("lsq_de", 4).alias("lsq_de"), F.round("lsq_dn", 4).alias("lsq_dn"))


@query(with_views(_OFFSETS + """
, i AS (SELECT *, tl IS NOT NULL AND u > 0 AND u < 1 AS inside FROM o),
m AS (SELECT line_id, count(tl) AS c, count(*) FILTER (inside) AS n, sum(tn * tn) FILTER (inside) AS xx, sum(-tn * te) FILTER (inside) AS xy, sum(te * te) FILTER (inside) AS yy, sum(de) FILTER (inside) AS ve, sum(dn) FILTER (inside) AS vn,
  stddev_pop(de) AS sde, stddev_pop(dn) AS sdn FROM i GROUP BY line_id),
l AS (SELECT *, xx * yy - xy * xy AS det FROM m),
f AS (SELECT *, CASE WHEN c >= 5 AND n >= 8 AND det >= 1e-6 * ((xx + yy) / 2) ** 2 THEN (ve * yy - xy * vn) / det END AS a, CASE WHEN c >= 5 AND n >= 8 AND det >= 1e-6 * ((xx + yy) / 2) ** 2 THEN (xx * vn - xy * ve) / det END AS b FROM l),
s AS (SELECT *, sqrt(a * a + b * b) AS size, (degrees(atan2(a, b)) + 360) % 360 AS bearing FROM f)
SELECT line_id, CASE WHEN c = 0 THEN 'INCONCLUSIVE: no matched road samples to measure an offset from.'
  WHEN size IS NULL THEN 'INCONCLUSIVE: the least-squares offset estimate is undefined; the sampled road population is too close to one orientation to separate the two shift components.'
  WHEN size < 0.3 THEN printf('NOT DETECTED: least-squares offset magnitude %.2f m is under 0.3 m.', size)
  WHEN size BETWEEN 0.5 AND 1.5 AND abs((bearing - 45 + 180 + 360) % 360 - 180) <= 45 AND sqrt(sde * sde + sdn * sdn) < 2 * size THEN printf('CONSISTENT with the epoch-shift hypothesis: least-squares offset %.2f m at bearing %.0f degrees.', size, bearing)
  ELSE printf('INCONCLUSIVE: least-squares offset %.2f m at bearing %.0f degrees does not clear every CONSISTENT band.', size, bearing) END AS verdict FROM s
"""))  # fmt: skip
def epoch_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each road's shift between the two sources says of their epochs."""
    s = spatial.offset_statistics(offsets(spark, sf_dir), ["line_id"])
    return s.select("line_id", spatial.epoch_verdict("count", "lsq_de", "lsq_dn", "std_de", "std_dn").alias("verdict"))


@query("""
WITH v AS (SELECT user_id, CASE user_id % 7 WHEN 0 THEN 'primary' WHEN 1 THEN 'footway' WHEN 2 THEN 'bus_stop' WHEN 3 THEN 'service' WHEN 4 THEN 'steps' WHEN 5 THEN 'unclassified' ELSE 'cycleway' END AS highway,
  CASE event_id % 5 WHEN 0 THEN 'parking_aisle' WHEN 1 THEN 'driveway' ELSE NULL END AS service FROM events)
SELECT CASE WHEN highway = 'service' AND service IS NOT NULL THEN 'dropped_' || service
  WHEN highway IN ('primary', 'service', 'unclassified') THEN 'carriageway' WHEN highway IN ('footway', 'steps', 'cycleway') THEN 'path' ELSE 'neither' END AS population, count(*) AS n FROM v GROUP BY 1
""")
def road_populations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roads by family, parking aisles and driveways counted apart."""
    from sitewright.functions import categories as K

    names = F.array(*[F.lit(h) for h in ("primary", "footway", "bus_stop", "service", "steps", "unclassified", "cycleway")])
    v = table(spark, sf_dir, "events").select(
        F.get(names, (F.col("user_id") % 7).cast("int")).alias("highway"), F.get(F.array(F.lit("parking_aisle"), F.lit("driveway")), (F.col("event_id") % 5).cast("int")).alias("service")
    )
    population = F.when((F.col("highway") == "service") & F.col("service").isin("parking_aisle", "driveway"), F.concat(F.lit("dropped_"), "service")).otherwise(F.coalesce(K.road_family("highway"), F.lit("neither")))
    return v.groupBy(population.alias("population")).agg(F.count("*").alias("n"))
