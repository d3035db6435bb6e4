"""Parcels, constraints, coverage and which source serves which category."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewright.functions import categories as K
from sitewright.functions import geometry as G
from sitewright.functions import text as T
from sitewright.operators import land, spatial
from sitewright.queries import query
from sitewright.queries.fixtures import table, view, with_views

SITE = (0.25, 0.25, 0.75, 0.75)
MARGIN = (0.15, 0.15, 0.85, 0.85)


def rect(values: tuple[float, float, float, float]) -> F.Column:
    return F.struct(*[F.lit(v).alias(n) for v, n in zip(values, ("x0", "y0", "x1", "y1"))])


#: Samples of a parcel lie so many metres apart, from its low corner.
STEP = 2.5


def parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "fx_parcels").select("parcel_id", G.rectangle("e0", "n0", "e1", "n1").alias("ring"))


def overlays(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = view(spark, sf_dir, "fx_overlays").select(F.when(F.col("class") == "building", "building").otherwise(K.bucket_of("class")).alias("bucket"), G.rectangle("e0", "n0", "e1", "n1").alias("ring"))
    return v.where("bucket IS NOT NULL")


_SAMPLES = """WITH smp AS (SELECT parcel_id, e0 + 2.5 * i AS x, n0 + 2.5 * j AS y FROM fx_parcels, range(0, 8) a(i), range(0, 8) b(j)),
ov AS (SELECT CASE class WHEN 'residential' THEN 'garden' WHEN 'farmland' THEN 'field' WHEN 'pitch' THEN 'recreation' WHEN 'retail' THEN 'retail' WHEN 'grass' THEN 'greenspace_landuse' WHEN 'building' THEN 'building' END AS bucket, e0, n0, e1, n1 FROM fx_overlays),
hit AS (SELECT DISTINCT parcel_id, s.x, s.y, bucket FROM smp s JOIN ov o ON bucket IS NOT NULL AND s.x >= o.e0 AND s.x < o.e1 AND s.y >= o.n0 AND s.y < o.n1)"""


@query(with_views(_SAMPLES + """, v AS (SELECT parcel_id, bucket, count(*) AS n, list_position(['garden', 'field', 'recreation', 'retail', 'greenspace_landuse'], bucket) AS pri FROM hit GROUP BY parcel_id, bucket),
w AS (SELECT parcel_id, bucket FROM (SELECT *, row_number() OVER (PARTITION BY parcel_id ORDER BY n DESC, pri) AS rn FROM v WHERE bucket <> 'building') WHERE rn = 1)
SELECT p.parcel_id, CASE WHEN w.bucket IS NULL THEN 'unclassified' WHEN w.bucket = 'garden' AND EXISTS (SELECT 1 FROM v WHERE v.parcel_id = p.parcel_id AND v.bucket = 'building') THEN 'housing' WHEN w.bucket = 'greenspace_landuse' THEN 'greenspace' ELSE w.bucket END AS category,
  CAST(64 AS BIGINT) AS samples FROM fx_parcels p LEFT JOIN w USING (parcel_id)
"""))  # fmt: skip
def parcel_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return land.classify_grid(parcels(spark, sf_dir), overlays(spark, sf_dir), STEP, 20.0)


@query(with_views(_SAMPLES + "SELECT bucket, count(*) AS samples, CAST(count(DISTINCT parcel_id) AS BIGINT) AS parcels FROM hit GROUP BY bucket"))
def overlay_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples and parcels that each bucket of evidence covers; a sample counts once for a bucket."""
    votes = spatial.covered_grid_points(parcels(spark, sf_dir), overlays(spark, sf_dir), "parcel_id", "bucket", STEP, 20.0)
    return votes.groupBy("bucket").agg(F.sum("samples").alias("samples"), F.count("*").alias("parcels"))


@query()
def parcel_samples_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interior samples of parcels in degrees, by the spacing that their area asks for."""
    d = 1 / G.METRES_PER_DEGREE
    v = view(spark, sf_dir, "fx_parcels").select("parcel_id", G.rectangle(F.col("e0") * d, 51 + F.col("n0") * d, F.col("e1") * d, 51 + F.col("n1") * d).alias("ring"))
    return v.select("parcel_id", F.size(G.interior_samples("ring")).alias("samples"))


def constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features by where they lie; layers with names label theirs, every third takes its grade."""
    v = view(spark, sf_dir, "fx_constraints")
    where = land.classify_feature(F.lit("Point"), F.array().cast("array<array<array<struct<x:double,y:double>>>>"), F.array(G.point(F.col("x"), F.col("y"))), rect(SITE), rect(MARGIN))
    label = F.when(F.col("layer_ord") % 3 == 0, F.col("grade"))
    return v.withColumns({"where": where, "label": label})


_FOUND = """WITH f AS (SELECT *, CASE WHEN x BETWEEN 0.25 AND 0.75 AND y BETWEEN 0.25 AND 0.75 THEN 'site' WHEN x BETWEEN 0.15 AND 0.85 AND y BETWEEN 0.15 AND 0.85 THEN 'margin' END AS place, CASE WHEN layer_ord % 3 = 0 THEN grade END AS label FROM fx_constraints)"""


@query(with_views(_FOUND + "SELECT designation, label, place AS \"where\", count(*) AS n FROM f WHERE place IS NOT NULL GROUP BY 1, 2, 3"))
def constraint_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return constraints(spark, sf_dir).where("where IS NOT NULL").groupBy("designation", "label", "where").agg(F.count("*").alias("n"))


@query(with_views(_FOUND + """
SELECT layer_ord, designation, label, count(*) FILTER (place = 'margin') AS n FROM f GROUP BY 1, 2, 3 HAVING count(*) FILTER (place = 'site') = 0 AND count(*) FILTER (place = 'margin') > 0
"""))  # fmt: skip
def constraints_margin_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return land.margin_only(constraints(spark, sf_dir).where("where IS NOT NULL"))


@query(with_views(_FOUND + """
SELECT n.n_name AS designation, CASE WHEN count(f.layer_ord) FILTER (f.place IS NOT NULL) > 0 THEN 'found' ELSE 'none found' END AS status FROM nation n LEFT JOIN f ON f.layer_ord = n.n_nationkey GROUP BY n.n_name
"""))  # fmt: skip
def constraints_none_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every layer that was checked, and whether anything of it lies on the site or near it."""
    layers = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("layer_ord"), F.col("n_name").alias("designation"))
    found = constraints(spark, sf_dir).where("where IS NOT NULL").select("layer_ord").distinct().withColumn("hit", F.lit(True))
    return layers.join(found, "layer_ord", "left").select("designation", F.when(F.col("hit"), "found").otherwise("none found").alias("status"))


@query(with_views(_FOUND + """, g AS (SELECT designation, coalesce(grade, 'ungraded') AS grade, count(*) AS n FROM f WHERE place = 'site' GROUP BY 1, 2)
SELECT designation, string_agg(grade || ' ' || n, ', ' ORDER BY grade) AS grades, CAST(sum(n) AS BIGINT) AS n FROM g GROUP BY designation
"""))  # fmt: skip
def constraints_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades of what lies on the site, as each layer's line shows them."""
    counts = constraints(spark, sf_dir).where("where = 'site'").groupBy("designation", F.coalesce("grade", F.lit("ungraded")).alias("grade")).count()
    lines = counts.groupBy("designation").agg(F.map_from_entries(F.collect_list(F.struct("grade", "count"))).alias("m"), F.sum("count").alias("n"))
    return lines.select("designation", T.grades_text("m").alias("grades"), "n")


_SHARE = """WITH o AS (SELECT class, e0, n0, e1, n1 FROM fx_overlays), c AS (SELECT i, j, 100 + (i + 0.5) * 1.0 AS x, 0 + (j + 0.5) * 1.0 AS y FROM range(0, 200) a(i), range(0, 100) b(j))
SELECT class, round(count(DISTINCT (i, j)) / 20000.0, 6) AS share FROM c JOIN o ON x BETWEEN e0 AND e1 AND y > n0 AND y <= n1 GROUP BY class"""


@query(with_views(_SHARE))
def coverage_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part of a site that each class of land use covers, on a grid of cells; overlaps count once."""
    v = view(spark, sf_dir, "fx_overlays").select("class", F.array(G.rectangle("e0", "n0", "e1", "n1")).alias("rings"))
    shares = land.covered_share(v, ["class"], "rings", (100.0, 0.0, 300.0, 100.0), long_side=200)
    return shares.select("class", F.round("share", 6).alias("share"))


@query(with_views("""
WITH a AS (SELECT least(1, sum(greatest(0, least(e1, 300) - greatest(e0, 100)) * greatest(0, least(n1, 100) - greatest(n0, 0))) / 20000) AS s FROM fx_overlays WHERE class <> 'building')
SELECT round(s, 6) AS share, CASE WHEN s >= 0.98 THEN 'full' WHEN s > 0 THEN 'partial' ELSE 'none' END AS verdict FROM a
"""))  # fmt: skip
def area_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = view(spark, sf_dir, "fx_overlays").where("class <> 'building'").select(F.array(G.rectangle("e0", "n0", "e1", "n1")).alias("rings"))
    return land.coverage_share(v, "rings", rect((100.0, 0.0, 300.0, 100.0)), 20000.0).select(F.round("share", 6).alias("share"), "verdict")


@query("""
WITH t AS (SELECT p_brand AS category, p_partkey AS source_id, p_size % 4 AS tier, p_partkey % 11 = 0 AS reference FROM part)
SELECT category, source_id, tier, CASE WHEN reference THEN 'reference' WHEN tier = min(tier) OVER (PARTITION BY category) THEN 'base' ELSE 'fill' END AS role FROM t
""")
def tier_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    sources = p.select(F.col("p_brand").alias("category"), F.col("p_partkey").alias("source_id"), (F.col("p_size") % 4).alias("tier"), (F.col("p_partkey") % 11 == 0).alias("reference"))
    return land.resolve(sources)


@query("""
SELECT p_partkey AS id, CASE WHEN s >= 0.995 THEN 'the whole site' WHEN s < 0.005 THEN 'under 1% of the site' ELSE CAST(floor(s * 100 + 0.5) AS BIGINT) || '% of the site' END AS share FROM (SELECT p_partkey, (p_partkey % 1009) / 1008.0::DOUBLE AS s FROM part)
""")
def share_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), T.share_text((F.col("p_partkey") % 1009) / F.lit(1008.0)).alias("share"))


@query(with_views("""
SELECT grp, to_json(list(struct_pack(designation := designation, name := name) ORDER BY layer_ord, name)) AS features FROM fx_constraints WHERE x BETWEEN 0.15 AND 0.85 AND y BETWEEN 0.15 AND 0.85 GROUP BY grp
"""))  # fmt: skip
def constraint_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One collection of features for each group of layers."""
    found = constraints(spark, sf_dir).where("where IS NOT NULL")
    ordered = F.sort_array(F.collect_list(F.struct("layer_ord", "name", "designation")))
    return found.groupBy("grp").agg(ordered.alias("f")).select("grp", F.to_json(F.transform("f", lambda v: F.struct(v["designation"].alias("designation"), v["name"].alias("name")))).alias("features"))
