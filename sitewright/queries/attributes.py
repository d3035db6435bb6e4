"""Names, grid references, tags and other attributes of features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewright.functions import categories as K
from sitewright.functions import geometry as G
from sitewright.functions import projection as P
from sitewright.functions import text as T
from sitewright.operators import tiles
from sitewright.queries import query
from sitewright.queries.fixtures import table, view, with_views

_LETTERS = "'ABCDEFGHJKLMNOPQRSTUVWXYZ'"
_GRID = f"""substr({_LETTERS}, CAST((3 - n // 500000) * 5 + e // 500000 + 2 + 1 AS BIGINT), 1) || substr({_LETTERS}, CAST((4 - (n // 100000) % 5) * 5 + (e // 100000) % 5 + 1 AS BIGINT), 1)"""


@query(f"""
WITH p AS (SELECT o_orderkey AS id, (o_orderkey * 7919) % 700000 AS e, (o_orderkey * 104729) % 1300000 AS n FROM orders)
SELECT id, {_GRID} AS square, {_GRID} || (e // 10000) % 10 || (n // 10000) % 10 AS cell FROM p
""")
def cell_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") * 7919 % 700000).alias("e"), (F.col("o_orderkey") * 104729 % 1300000).alias("n"))
    return p.select("id", P.grid_square("e", "n").alias("square"), P.grid_cell("e", "n").alias("cell"))


@query(f"""
WITH b AS (SELECT s_suppkey AS id, (s_suppkey * 7919) % 650000 AS e0, (s_suppkey * 104729) % 1200000 AS n0 FROM supplier),
c AS (SELECT id, i * 10000 AS e, unnest(range(n0 // 10000, (n0 + 25000) // 10000 + 1)) * 10000 AS n FROM (SELECT *, unnest(range(e0 // 10000, (e0 + 15000) // 10000 + 1)) AS i FROM b))
SELECT id, string_agg({_GRID} || (e // 10000) % 10 || (n // 10000) % 10, ',' ORDER BY {_GRID} || (e // 10000) % 10 || (n // 10000) % 10) AS cells FROM c GROUP BY id
""")
def cells_of_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") * 7919 % 650000).alias("e0"), (F.col("s_suppkey") * 104729 % 1200000).alias("n0"))
    box = F.struct(F.col("e0").alias("x0"), F.col("n0").alias("y0"), (F.col("e0") + 15000).alias("x1"), (F.col("n0") + 25000).alias("y1"))
    return s.select("id", F.array_join(P.cells_of(box), ",").alias("cells"))


@query("""
WITH p AS (SELECT o_orderkey AS id, CAST((o_orderkey * 7) % 160 - 80 AS DOUBLE) + 0.5 AS lat, CAST((o_orderkey * 13) % 360 - 180 AS DOUBLE) + 0.25 AS lon FROM orders),
b AS (SELECT *, substr('CDEFGHJKLMNPQRSTUVWX', CAST(floor(lat / 8 + 10) AS BIGINT) + 1, 1) AS band, CAST(floor((lon + 180) / 6 + 1) AS INT) AS z FROM p)
SELECT id, CASE WHEN z = 31 AND band = 'V' AND lon >= 3 THEN 32 WHEN z = 32 AND band = 'X' THEN CASE WHEN lon < 9 THEN 31 ELSE 33 END WHEN z = 34 AND band = 'X' THEN CASE WHEN lon < 21 THEN 33 ELSE 35 END
  WHEN z = 36 AND band = 'X' THEN CASE WHEN lon < 33 THEN 35 ELSE 37 END ELSE z END || band AS zone FROM b
""")
def utm_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), ((F.col("o_orderkey") * 7 % 160 - 80).cast("double") + 0.5).alias("lat"), ((F.col("o_orderkey") * 13 % 360 - 180).cast("double") + 0.25).alias("lon"))
    return p.select("id", P.utm_zone("lat", "lon").alias("zone"))


@query()
def projected_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points on both projections, and back from the grid's."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (50 + F.col("c_custkey") % 90 / 10.0).alias("lat"), (-6 + F.col("c_custkey") % 70 / 10.0).alias("lon"))
    c = c.withColumns({"g": P.tm_forward("lat", "lon"), "u": P.utm_project("lat", "lon", P.utm_zone("lat", "lon"))})
    c = c.withColumn("back", P.tm_inverse("g.e", "g.n"))
    return c.select("id", F.round("g.e", 3).alias("e"), F.round("g.n", 3).alias("n"), F.round("u.e", 3).alias("utm_e"), F.round("u.n", 3).alias("utm_n"), F.round("back.lat", 8).alias("lat"), F.round("back.lon", 8).alias("lon"))


@query("""
SELECT c_custkey AS id, trim(substr(regexp_replace(regexp_replace(regexp_replace(c_name, '\\s+', '-', 'g'), '[^A-Za-z0-9-]', '', 'g'), '-{2,}', '-', 'g'), 1, 40), '-') AS slug FROM customer
""")
def slugify_ascii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), T.slug_ascii("c_name").alias("slug"))


@query()
def slugify_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slugs of names with letters outside ASCII."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("Ø "), F.coalesce("text", F.lit(""))).alias("name"))
    return d.select("id", T.slugify("name").alias("slug"))


@query("""
SELECT s_suppkey AS id, left(sha256(printf('%.7f', s_suppkey / 7.0::DOUBLE) || '|' || printf('%.7f', 51.0::DOUBLE) || '|' || printf('%.7f', s_suppkey / 7.0::DOUBLE + 1) || '|' || printf('%.7f', 52.0::DOUBLE) || '|' || printf('%.7f', 1000.0::DOUBLE) || '|' || printf('%.7f', 50.0::DOUBLE) || '|buildings,water|land,place'), 8) AS fingerprint FROM supplier
""")
def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    west = F.col("s_suppkey") / F.lit(7.0)
    lists = [F.array(*[F.lit(v) for v in values]) for values in (("water", "buildings"), ("place", "land"))]
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), T.fingerprint([west, 51.0, west + 1, 52.0, 1000.0, 50.0], *lists).alias("fingerprint"))


@query("""
SELECT event_id AS id, json_extract_string(props, '$.k') AS k, event_type, value IS NOT NULL AS has_value FROM events
""")
def props_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.get_json_object("props", "$.k").alias("k"), "event_type", F.col("value").isNotNull().alias("has_value"))


@query("""
WITH t AS (SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN 'building' WHEN 1 THEN 'natural' WHEN 2 THEN 'highway' WHEN 3 THEN 'leisure' WHEN 4 THEN 'shop' ELSE 'name' END AS k,
  CASE o_orderkey % 5 WHEN 0 THEN 'wood' WHEN 1 THEN 'water' WHEN 2 THEN 'park' WHEN 3 THEN 'path' ELSE 'steps' END AS v FROM orders)
SELECT k, v, count(*) AS n FROM t WHERE k = 'building' OR (k = 'natural' AND v = 'water') OR (k = 'natural' AND v IN ('wood', 'scrub', 'heath', 'grassland', 'wetland')) OR (k = 'highway' AND v IN ('footway', 'path', 'bridleway', 'steps'))
  OR (k = 'leisure' AND v IN ('park', 'garden', 'nature_reserve', 'golf_course')) GROUP BY k, v
""")
def tag_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda values, n: F.get(F.array(*[F.lit(v) for v in values]), (F.col("o_orderkey") % n).cast("int"))
    o = table(spark, sf_dir, "orders").select(pick(("building", "natural", "highway", "leisure", "shop", "name"), 6).alias("k"), pick(("wood", "water", "park", "path", "steps"), 5).alias("v"))
    return o.where(K.matches(F.create_map("k", "v"), ["buildings", "water", "vegetation_and_landuse", "footpath"])).groupBy("k", "v").agg(F.count("*").alias("n"))


@query("""
WITH e AS (SELECT s_suppkey AS id, 51.0::DOUBLE AS s, 51.0::DOUBLE + (s_suppkey % 5 + 1) * 0.01 AS n, CAST(-3 AS DOUBLE) AS w, CAST(-3 AS DOUBLE) + (s_suppkey % 7 + 1) * 0.01 AS x FROM supplier),
m AS (SELECT id, radians(x - w) * 6378137 * cos(radians((s + n) / 2)) AS width, radians(n - s) * 6378137 AS height FROM e),
c AS (SELECT id, width, height, unnest(range(0, CAST(ceil(width / 500) AS BIGINT))) AS col FROM m), t AS (SELECT id, width, height, col, unnest(range(0, CAST(ceil(height / 500) AS BIGINT))) AS "row" FROM c)
SELECT id, 'r' || lpad(CAST("row" AS VARCHAR), 2, '0') || '_c' || lpad(CAST(col AS VARCHAR), 2, '0') AS tile_id, round(least(500, width - col * 500) * least(500, height - "row" * 500), 2) AS area FROM t
""")
def tile_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of extents: their names, and their cores' areas in square metres."""
    s = table(spark, sf_dir, "supplier")
    box = F.struct(F.lit(-3.0).alias("x0"), F.lit(51.0).alias("y0"), (F.lit(-3.0) + (F.col("s_suppkey") % 7 + 1) * 0.01).alias("x1"), (F.lit(51.0) + (F.col("s_suppkey") % 5 + 1) * 0.01).alias("y1"))
    t = tiles.build(s.select(F.col("s_suppkey").alias("id"), box.alias("box")), 500.0, 50.0)
    ref = (F.col("box.y0") + F.col("box.y1")) / 2
    low, high = G.to_local("core.x0", "core.y0", ref), G.to_local("core.x1", "core.y1", ref)
    return t.select("id", "tile_id", F.round((high["x"] - low["x"]) * (high["y"] - low["y"]), 2).alias("area"))


@query(with_views("""
SELECT src, tag, count(*) AS n FROM (SELECT src, CASE WHEN fid % 3 = 0 THEN 'house' WHEN fid % 3 = 1 THEN 'yes' ELSE 'barn' END AS tag FROM fx_footprints) GROUP BY src, tag
"""))  # fmt: skip
def building_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each value of the building tag occurs; features without one are called yes."""
    v = view(spark, sf_dir, "fx_footprints").withColumn("props", F.when(F.col("fid") % 3 == 0, F.create_map(F.lit("building"), F.lit("house"))).when(F.col("fid") % 3 == 2, F.create_map(F.lit("building"), F.lit("barn"))).otherwise(F.create_map(F.lit("height"), F.lit("3"))))
    return v.groupBy("src", F.coalesce(F.nullif(F.element_at("props", F.lit("building")), F.lit("")), F.lit("yes")).alias("tag")).agg(F.count("*").alias("n"))


@query("""
SELECT event_id AS id, CASE WHEN s = 429 THEN 'rate_limited' WHEN s IN (401, 403) THEN 'not_authorised' WHEN s >= 500 THEN 'service_error' ELSE 'refused' END AS kind, CASE WHEN d < 60 THEN CAST(round_even(d, 0) AS BIGINT) || ' s' ELSE CAST(round_even(d / 60, 0) AS BIGINT) || ' min' END AS duration
FROM (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 429 WHEN 1 THEN 401 WHEN 2 THEN 403 WHEN 3 THEN 500 WHEN 4 THEN 503 ELSE 404 END AS s, CAST(event_id % 700 AS DOUBLE) AS d FROM events)
""")
def failure_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.get(F.array(*[F.lit(v) for v in (429, 401, 403, 500, 503, 404)]), (F.col("event_id") % 6).cast("int"))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), T.status_kind(status).alias("kind"), T.duration_text((F.col("event_id") % 700).cast("double")).alias("duration"))


@query("""
SELECT page_id AS id, regexp_replace(url || '?api_key=abc' || page_id || '&x=1', '(?i)(api_?key|token|secret)=[^&\\s"'']+', '\\1=***', 'g') AS url FROM pages
""")
def redacted_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat("url", F.lit("?api_key=abc"), F.col("page_id").cast("string"), F.lit("&x=1"))
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), T.redact(raw, F.lit("")).alias("url"))


@query(f"""
WITH s AS (SELECT c_custkey AS id, ['buildings', 'water', 'footpath', 'rail', 'vegetation_and_landuse', 'points_of_interest', 'motorway'] AS c FROM customer),
t AS (SELECT id, unnest(list_filter(c, lambda x, i: (id // (1 << (i - 1))) % 2 = 1)) AS category FROM s),
y AS (SELECT id, unnest(CASE category WHEN 'buildings' THEN ['building'] WHEN 'water' THEN ['water'] WHEN 'vegetation_and_landuse' THEN ['land_use', 'land_cover'] WHEN 'points_of_interest' THEN ['place', 'infrastructure']
  WHEN 'footpath' THEN ['segment', 'connector'] WHEN 'motorway' THEN ['segment', 'connector'] ELSE CAST([] AS VARCHAR[]) END) AS type FROM t),
o AS (SELECT unnest([{", ".join(f"'{t}'" for t in K.TYPE_ORDER)}]) AS type, unnest(range({len(K.TYPE_ORDER)})) AS nth)
SELECT id, string_agg(type, ',' ORDER BY nth) AS types FROM (SELECT DISTINCT id, type FROM y) JOIN o USING (type) GROUP BY id
""")
def types_of_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types to read for selections of categories, made from the bits of a key; selections without a type have no row."""
    names = ("buildings", "water", "footpath", "rail", "vegetation_and_landuse", "points_of_interest", "motorway")
    chosen = F.filter(F.array(*[F.lit(n) for n in names]), lambda x, i: F.floor(F.col("id") / F.pow(F.lit(2), i)) % 2 == 1)
    types = K.in_type_order(F.flatten(F.transform(chosen, K.themed_types)))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")).select("id", F.array_join(types, ",").alias("types")).where("types <> ''")
