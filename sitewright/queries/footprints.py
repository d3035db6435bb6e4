"""Footprints: merging, containment, matching, fusion, rings and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewright.functions import geometry as G
from sitewright.operators import curves, dedup, spatial
from sitewright.queries import query
from sitewright.queries.fixtures import table, view, with_views

CELL = 50.0
#: SQL for a rectangle of a view with e0, n0, e1, n1: the middle of its area, which is its representative point.
MIDDLE = "(e0 + e1) / 2 AS px, (n0 + n1) / 2 AS py"


def rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, fid, ring) of fx_ring_vertices."""
    v = view(spark, sf_dir, "fx_ring_vertices")
    ring = F.transform(F.sort_array(F.collect_list(F.struct("seq", "x", "y"))), lambda p: G.point(p["x"], p["y"]))
    return v.groupBy("src", "fid").agg(ring.alias("ring"))


def rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "fx_footprints").withColumn("ring", G.rectangle("e0", "n0", "e1", "n1"))


@query(with_views("""
SELECT type, id, version, part_ord, supp_ord, quantity FROM (
  SELECT *, row_number() OVER (PARTITION BY type, id ORDER BY version DESC, part_ord, supp_ord, quantity) AS rn FROM fx_osm) WHERE rn = 1
"""))  # fmt: skip
def osm_merge_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.latest(view(spark, sf_dir, "fx_osm"), ["type", "id"], "version", ["part_ord", "supp_ord", "quantity"])


@query(with_views("""
SELECT type, id, version, part_ord, supp_ord, quantity FROM (
  SELECT *, row_number() OVER (PARTITION BY type, id ORDER BY version, part_ord, supp_ord, quantity) AS rn FROM fx_osm) WHERE rn = 1
"""))  # fmt: skip
def geojson_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.first_seen(view(spark, sf_dir, "fx_osm"), ["type", "id"], ["version", "part_ord", "supp_ord", "quantity"]).select("type", "id", "version", "part_ord", "supp_ord", "quantity")


@query("""
SELECT p_name, p_brand, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rn FROM part) WHERE rn = 1 OR p_brand = ''
""")
def first_named_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.first_named(table(spark, sf_dir, "part").select("p_name", "p_brand", "p_partkey"), "p_brand", ["p_partkey"])


@query(with_views("""
SELECT type, id, row_number() OVER (ORDER BY CASE type WHEN 'node' THEN 1 WHEN 'way' THEN 2 ELSE 3 END, id) AS place
FROM (SELECT DISTINCT type, id FROM fx_osm)
"""))  # fmt: skip
def osm_output_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup.latest(view(spark, sf_dir, "fx_osm"), ["type", "id"], "version", ["part_ord", "supp_ord", "quantity"]).select("type", "id")
    return dedup.running(found, F.lit(1), [dedup.type_rank(), F.col("id")], "place").select("type", "id", (F.col("place") + 1).alias("place"))


@query(with_views("""
SELECT bucket, CAST(sum(n) AS BIGINT) AS n FROM (
  SELECT CASE WHEN a < 10 THEN 'under_10' WHEN a < 30 THEN '10_to_30' WHEN a < 80 THEN '30_to_80' WHEN a < 200 THEN '80_to_200' WHEN a < 1000 THEN '200_to_1000' ELSE 'over_1000' END AS bucket, 1 AS n
  FROM (SELECT src, fid, abs(sum(x * ny - nx * y)) / 2 AS a FROM (
    SELECT src, fid, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny
    FROM fx_ring_vertices WINDOW w AS (PARTITION BY src, fid ORDER BY seq)) GROUP BY src, fid)
  UNION ALL SELECT unnest(['under_10', '10_to_30', '30_to_80', '80_to_200', '200_to_1000', 'over_1000']), 0) GROUP BY bucket
"""))  # fmt: skip
def ring_area_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.area_histogram(rings(spark, sf_dir).select(G.ring_area("ring").alias("area")), "area")


#: Even-odd test of (px, py) against the long-form rings, for a join that has both sides.
_IN_RING = """
SELECT p.fid AS point_id, r.fid AS ring_id FROM pts p JOIN edges r ON p.px BETWEEN r.x0 AND r.x1 AND p.py BETWEEN r.y0 AND r.y1
GROUP BY p.fid, r.fid HAVING sum(CASE WHEN (r.ay > p.py) <> (r.by > p.py) AND p.px < (r.ax - r.bx) * (p.py - r.by) / nullif(r.ay - r.by, 0) + r.bx THEN 1 ELSE 0 END) % 2 = 1
"""
_EDGES = """edges AS (
  SELECT fid, x AS ax, y AS ay, coalesce(lead(x) OVER w, first_value(x) OVER w) AS bx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS by,
    min(x) OVER g AS x0, max(x) OVER g AS x1, min(y) OVER g AS y0, max(y) OVER g AS y1
  FROM fx_ring_vertices WHERE src = 'ours' WINDOW w AS (PARTITION BY fid ORDER BY seq), g AS (PARTITION BY fid))"""


@query(with_views(f"WITH pts AS (SELECT fid, {MIDDLE} FROM fx_footprints WHERE src = 'theirs'), {_EDGES} {_IN_RING}"))
def point_in_ring_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    theirs = rectangles(spark, sf_dir).where("src = 'theirs'").select(F.col("fid").alias("point_id"), G.representative_point("ring").alias("p"))
    points = theirs.select("point_id", F.col("p.x").alias("px"), F.col("p.y").alias("py"))
    ours = rings(spark, sf_dir).where("src = 'ours'").select(F.col("fid").alias("ring_id"), "ring")
    return spatial.points_in_rings(points, ours, "px", "py", "ring", CELL).select("point_id", "ring_id")


@query(with_views("""
WITH a AS (SELECT fid, (e0 + e1) / 2 AS px, (n0 + n1) / 2 AS py FROM fx_footprints WHERE src = 'ours'), b AS (SELECT * FROM fx_footprints WHERE src = 'theirs')
SELECT b.fid AS candidate, CAST(count(*) AS BIGINT) AS accepted_inside FROM b JOIN a ON a.px >= b.e0 AND a.px < b.e1 AND a.py >= b.n0 AND a.py < b.n1 GROUP BY b.fid
"""))  # fmt: skip
def reverse_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = rectangles(spark, sf_dir)
    points = both.where("src = 'ours'").select("fid", G.representative_point("ring").alias("p")).select("fid", F.col("p.x").alias("px"), F.col("p.y").alias("py"))
    cands = both.where("src = 'theirs'").select(F.col("fid").alias("candidate"), "ring")
    return spatial.points_in_rings(points, cands, "px", "py", "ring", CELL).groupBy("candidate").agg(F.count("*").alias("accepted_inside"))


@query(with_views(f"""
WITH s AS (SELECT fid, (e1 - e0) * (n1 - n0) AS area, {MIDDLE} FROM fx_footprints WHERE src = 'ours'), o AS (SELECT * FROM fx_footprints WHERE src = 'theirs'),
h AS (SELECT s.fid, s.area, min(o.fid) AS container FROM s LEFT JOIN o ON px >= o.e0 AND px < o.e1 AND py >= o.n0 AND py < o.n1 GROUP BY s.fid, s.area)
SELECT CASE WHEN h.area < 10 THEN 'under_10' WHEN h.area < 30 THEN '10_to_30' WHEN h.area < 80 THEN '30_to_80' WHEN h.area < 200 THEN '80_to_200' ELSE '200_to_1000' END AS bucket,
  container IS NOT NULL AS contained, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (h.area > (c.e1 - c.e0) * (c.n1 - c.n0)) AS BIGINT) AS larger_than_container
FROM h LEFT JOIN o c ON c.fid = h.container GROUP BY 1, 2
"""))  # fmt: skip
def containment_cross_tab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area bucket by whether another source's footprint holds the building, and how many are larger than that one."""
    both = rectangles(spark, sf_dir)
    subjects = both.where("src = 'ours'").select(F.col("fid").alias("sid"), "ring")
    others = both.where("src = 'theirs'").select(F.col("fid").alias("oid"), "ring")
    found = spatial.containers(subjects, others, CELL).withColumn("area", G.ring_area("ring"))
    sizes = others.select(F.col("oid").alias("container"), G.ring_area("ring").alias("container_area"))
    found = found.join(sizes, "container", "left")
    return found.groupBy(spatial.area_bucket(F.col("area")).alias("bucket"), F.col("container").isNotNull().alias("contained")).agg(
        F.count("*").alias("n"), F.count_if(F.col("area") > F.col("container_area")).alias("larger_than_container")
    )


@query(with_views("""
SELECT a.fid AS i, b.fid AS j FROM fx_footprints a JOIN fx_footprints b ON a.src = 'ours' AND b.src = 'theirs' AND a.e0 <= b.e1 AND a.e1 >= b.e0 AND a.n0 <= b.n1 AND a.n1 >= b.n0
"""))  # fmt: skip
def bbox_overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = rectangles(spark, sf_dir).withColumn("box", G.bbox("ring"))
    a = v.where("src = 'ours'").select(F.col("fid").alias("i"), F.col("box").alias("ba"))
    b = v.where("src = 'theirs'").select(F.col("fid").alias("j"), F.col("box").alias("bb"))
    return spatial.overlapping_boxes(a, b, "ba", "bb", CELL).select("i", "j")


_SCORED = """
WITH p AS (SELECT a.fid AS i, b.fid AS j, a.e0 AS a0, a.e1 AS a1, a.n0 AS an0, a.n1 AS an1, b.e0 AS b0, b.e1 AS b1, b.n0 AS bn0, b.n1 AS bn1,
    least(a.e0, b.e0) AS x0, least(a.n0, b.n0) AS y0, greatest(a.e1, b.e1) AS x1, greatest(a.n1, b.n1) AS y1
  FROM fx_footprints a JOIN fx_footprints b ON a.src = 'ours' AND b.src = 'theirs' AND a.e0 <= b.e1 AND a.e1 >= b.e0 AND a.n0 <= b.n1 AND a.n1 >= b.n0),
g AS (SELECT *, unnest(range(0, CAST(floor((x1 - x0) / 0.5) AS BIGINT) + 1)) AS c FROM p),
h AS (SELECT *, x0 + c * 0.5 AS px, unnest(range(0, CAST(floor((y1 - y0) / 0.5) AS BIGINT) + 1)) AS r FROM g),
t AS (SELECT i, j, px >= a0 AND px < a1 AND y0 + r * 0.5 >= an0 AND y0 + r * 0.5 < an1 AS ia, px >= b0 AND px < b1 AND y0 + r * 0.5 >= bn0 AND y0 + r * 0.5 < bn1 AS ib FROM h),
s AS (SELECT i, j, CAST(count(*) FILTER (ia AND ib) AS DOUBLE) / nullif(count(*) FILTER (ia OR ib), 0) AS iou FROM t GROUP BY i, j)
"""


def _pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    v = rectangles(spark, sf_dir)
    return v.where("src = 'ours'").select(F.col("fid").alias("i"), "ring"), v.where("src = 'theirs'").select(F.col("fid").alias("j"), "ring")


@query(with_views(_SCORED + "SELECT i, j, round(iou, 6) AS iou FROM s WHERE iou >= 0.1"))
def sampled_iou_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ours, theirs = _pairs(spark, sf_dir)
    a, b = ours.select("i", F.col("ring").alias("ra"), G.bbox("ring").alias("ba")), theirs.select("j", F.col("ring").alias("rb"), G.bbox("ring").alias("bb"))
    pairs = spatial.overlapping_boxes(a, b, "ba", "bb", CELL).select("i", "j", "ra", "rb")
    return spatial.scored(pairs, "ra", "rb").where("iou >= 0.1").select("i", "j", F.round("iou", 6).alias("iou"))


_GREEDY = _SCORED.replace("WITH p AS", "WITH RECURSIVE p AS") + """, m AS (SELECT i, j, iou, FALSE AS taken FROM s WHERE iou >= 0.1
  UNION ALL SELECT i, j, iou, best FROM (SELECT *, bool_or(best) OVER (PARTITION BY i) AS of_i, bool_or(best) OVER (PARTITION BY j) AS of_j FROM (
    SELECT i, j, iou, row_number() OVER (PARTITION BY i ORDER BY iou DESC, j) = 1 AND row_number() OVER (PARTITION BY j ORDER BY iou DESC, i) = 1 AS best FROM m WHERE NOT taken)) WHERE best OR NOT (of_i OR of_j)),
f AS (SELECT i, j, iou FROM m WHERE taken)
"""


@query(with_views(_GREEDY + "SELECT i, j, round(iou, 6) AS iou FROM f"))
def greedy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.match(*_pairs(spark, sf_dir)).select("i", "j", F.round("iou", 6).alias("iou"))


@query(with_views(_GREEDY + """
SELECT count(*) AS matched, round(quantile_cont(iou, 0.1), 6) AS p10, round(quantile_cont(iou, 0.5), 6) AS p50, round(quantile_cont(iou, 0.9), 6) AS p90,
  (SELECT count(*) FROM fx_footprints WHERE src = 'ours' AND fid NOT IN (SELECT i FROM f)) AS unmatched_ours, (SELECT count(*) FROM fx_footprints WHERE src = 'theirs' AND fid NOT IN (SELECT j FROM f)) AS unmatched_theirs FROM f
"""))  # fmt: skip
def match_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of both sides and of matches, and percentiles of their overlap."""
    ours, theirs = _pairs(spark, sf_dir)
    found = spatial.match(ours, theirs)
    p = F.percentile("iou", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    out = found.agg(F.count("*").alias("matched"), p.alias("p")).select("matched", *[F.round(F.get("p", F.lit(i)), 6).alias(n) for i, n in enumerate(("p10", "p50", "p90"))])
    left = ours.join(found, "i", "left_anti").agg(F.count("*").alias("unmatched_ours"))
    right = theirs.join(found, "j", "left_anti").agg(F.count("*").alias("unmatched_theirs"))
    return out.join(left).join(right)  # one row each


@query(with_views(f"""
WITH RECURSIVE v AS (SELECT *, {MIDDLE} FROM fx_footprints), b AS (SELECT * FROM v WHERE src = 'ours' AND fid % 2 = 0),
c AS (SELECT *, 2 * fid + CASE WHEN src = 'theirs' THEN 1000000000000 ELSE 0 END AS o FROM v WHERE (src = 'theirs' OR fid % 2 = 1) AND NOT EXISTS (
  SELECT 1 FROM b WHERE (v.px >= b.e0 AND v.px < b.e1 AND v.py >= b.n0 AND v.py < b.n1) OR (b.px >= v.e0 AND b.px < v.e1 AND b.py >= v.n0 AND b.py < v.n1))),
k AS (SELECT x.o AS u, y.o AS w FROM c x JOIN c y ON (x.px >= y.e0 AND x.px < y.e1 AND x.py >= y.n0 AND x.py < y.n1) OR (y.px >= x.e0 AND y.px < x.e1 AND y.py >= x.n0 AND y.py < x.n1)),
m AS (SELECT DISTINCT u, w, FALSE AS taken FROM k
  UNION ALL SELECT u, w, eu AND u = w FROM (SELECT *, bool_or(ew AND u <> w) OVER (PARTITION BY u) AS gu, bool_or(eu AND u <> w) OVER (PARTITION BY w) AS gw FROM (
    SELECT u, w, min(w) OVER (PARTITION BY u) = u AS eu, min(u) OVER (PARTITION BY w) = w AS ew FROM m WHERE NOT taken)) WHERE (eu AND u = w) OR NOT (eu OR ew OR gu OR gw))
SELECT src = 'theirs' AS late, fid FROM c WHERE o IN (SELECT u FROM m WHERE taken)
"""))  # fmt: skip
def fuse_buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Footprints of the second source that enter beside the first one's."""
    v = rectangles(spark, sf_dir)
    base = v.where("src = 'ours' AND fid % 2 = 0").select("ring")
    cands = v.where("src = 'theirs' OR fid % 2 = 1").select(F.struct((F.col("src") == "theirs").alias("late"), "fid").alias("ord"), "ring")
    return spatial.fuse(base, cands, CELL).select("ord.late", "ord.fid")


_SEGMENTS = """WITH e AS (SELECT src, fid, seq, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny
  FROM fx_ring_vertices WINDOW w AS (PARTITION BY src, fid ORDER BY seq))"""


@query(with_views(_SEGMENTS + """
SELECT count(*) AS edges_in, CAST(count(DISTINCT (least((x, y), (nx, ny)), greatest((x, y), (nx, ny)))) AS BIGINT) AS edges_unique FROM e WHERE (x, y) <> (nx, ny)
"""))  # fmt: skip
def parcel_edges_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = rings(spark, sf_dir).select("src", "fid", F.posexplode(G.edges("ring")).alias("pos", "e")).select("src", "fid", "pos", "e.a", "e.b").where("a <> b")
    unique = dedup.distinct_edges(edges, ["src", "fid", "pos"])
    return edges.agg(F.count("*").alias("edges_in")).join(unique.agg(F.count("*").alias("edges_unique")))


@query(with_views("""
WITH v AS (SELECT DISTINCT e0, n0, e1, n1 FROM (SELECT e0, n0, e1, n1 FROM fx_footprints)) SELECT CAST(count(*) AS BIGINT) AS rings FROM v
"""))  # fmt: skip
def ring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles of both sources and the same ones turned and reversed, each once."""
    v = rectangles(spark, sf_dir).select("src", "fid", "ring")
    turned = v.select("src", F.col("fid") + 10_000_000, F.reverse(F.concat(F.slice("ring", 3, 2), F.slice("ring", 1, 2))).alias("ring"))
    return dedup.distinct_rings(v.union(turned), "ring", ["src", "fid"]).agg(F.count("*").alias("rings"))


@query(with_views("""
WITH w AS (SELECT fid, CAST(count(*) AS BIGINT) AS n FROM fx_ring_vertices WHERE src = 'theirs' GROUP BY fid)
SELECT fid, n, CAST(-6 - coalesce(sum(n + 1) OVER (ORDER BY fid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS way_id FROM w
"""))  # fmt: skip
def synthetic_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = rings(spark, sf_dir).where("src = 'theirs'").select("fid", F.size("ring").cast("long").alias("n"))
    return dedup.synthetic_ids(new, -5, "n", ["fid"])


@query(with_views("""
SELECT src, fid, round(greatest(0, least(e1, (floor(e0 / 50) + 1) * 50 - 10) - greatest(e0, floor(e0 / 50) * 50 + 5)) * greatest(0, least(n1, (floor(n0 / 50) + 1) * 50 - 10) - greatest(n0, floor(n0 / 50) * 50 + 5)), 6) AS area FROM fx_footprints
"""))  # fmt: skip
def clip_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area of each footprint within a window of its cell."""
    v = rectangles(spark, sf_dir)
    low = lambda c: F.floor(F.col(c) / 50) * 50.0
    rect = F.struct((low("e0") + 5).alias("x0"), (low("n0") + 5).alias("y0"), (low("e0") + 40).alias("x1"), (low("n0") + 40).alias("y1"))
    return v.select("src", "fid", F.round(G.area_in_rect(F.array("ring"), rect), 6).alias("area"))


@query(with_views("""
SELECT src, fid, round((min(x) + max(x)) / 2, 6) AS px, round((min(y) + max(y)) / 2, 6) AS py FROM fx_ring_vertices WHERE fid % 3 <> 0 GROUP BY src, fid
UNION ALL
SELECT src, fid, round((min(x) + max(x)) / 2, 6), round(min(y) + (max(y) - min(y)) / 4, 6) FROM fx_ring_vertices WHERE fid % 3 = 0 GROUP BY src, fid
"""))  # fmt: skip
def representative_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = rings(spark, sf_dir).select("src", "fid", G.representative_point("ring").alias("p"))
    return p.select("src", "fid", F.round("p.x", 6).alias("px"), F.round("p.y", 6).alias("py"))


@query(with_views("""
SELECT w.fid, CAST(count(*) AS BIGINT) AS vertices, round(sum(x), 6) AS sum_x FROM (SELECT DISTINCT fid FROM fx_ring_vertices WHERE src = 'ours') w
JOIN fx_ring_vertices v ON v.src = 'ours' AND v.fid = w.fid GROUP BY w.fid HAVING w.fid % 7 <> 0
"""))  # fmt: skip
def way_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ways resolved through their nodes; those with a missing node are refused."""
    v = view(spark, sf_dir, "fx_ring_vertices").where("src = 'ours'").withColumn("node", F.col("fid") * 10 + F.col("seq"))
    nodes = v.where("NOT (fid % 7 = 0 AND seq = 1)").select(F.col("node").alias("id"), "x", "y")
    refs = F.transform(F.sort_array(F.collect_list(F.struct("seq", "node"))), lambda s: s["node"])
    ways = v.groupBy("fid").agg(refs.alias("refs")).select(F.col("fid").alias("id"), F.concat("refs", F.slice("refs", 1, 1)).alias("refs"))
    found = spatial.resolve_ways(ways, nodes, lambda: G.point(F.col("x"), F.col("y")))
    return found.select(F.col("id").alias("fid"), F.size("ring").cast("long").alias("vertices"), F.round(F.aggregate("ring", F.lit(0.0), lambda s, p: s + p["x"]), 6).alias("sum_x"))


@query(with_views(_SEGMENTS.replace("WITH e AS", "WITH RECURSIVE e AS") + """, s AS (SELECT x, y, nx AS x2, ny AS y2 FROM e WHERE src = 'ours' UNION ALL SELECT x, y, x - 0.5, y - 0.5 FROM e WHERE src = 'ours' AND seq = 0),
d AS (SELECT DISTINCT least((x, y), (x2, y2)) AS a, greatest((x, y), (x2, y2)) AS b FROM s WHERE (x, y) <> (x2, y2)), h AS (SELECT a AS p, b AS q FROM d UNION ALL SELECT b, a FROM d),
c AS (SELECT 0 AS k, p, q, CAST(-1 AS BIGINT) AS before FROM h
  UNION ALL SELECT k + 1, p, q, n FROM (SELECT *, count(*) OVER () AS n, count(*) OVER (PARTITION BY p) AS np, count(*) OVER (PARTITION BY q) AS nq FROM c) WHERE n <> before AND np > 1 AND nq > 1)
SELECT p[1] AS x, p[2] AS y, q[1] AS x2, q[2] AS y2 FROM c WHERE p < q AND k = (SELECT max(k) FROM c)
"""))  # fmt: skip
def two_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that are left once every spike is pruned."""
    edges = rings(spark, sf_dir).where("src = 'ours'").select("fid", F.posexplode(G.edges("ring")).alias("pos", "e")).select("fid", "pos", "e.a", "e.b")
    spikes = edges.where("pos = 0").select("fid", F.lit(99).alias("pos"), "a", G.point(F.col("a.x") - 0.5, F.col("a.y") - 0.5).alias("b"))
    every = edges.unionByName(spikes).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return curves.two_core(every).distinct().select("a.x", "a.y", F.col("b.x").alias("x2"), F.col("b.y").alias("y2"))


@query("""
WITH m AS (SELECT l_orderkey AS id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS INT) AS pos, CASE WHEN l_suppkey % 7 = 0 THEN 'node' ELSE 'way' END AS type, l_partkey AS ref,
  CASE l_returnflag WHEN 'R' THEN 'outer' WHEN 'A' THEN 'inner' ELSE '' END AS role FROM lineitem),
w AS (SELECT *, bool_or(role = 'outer') OVER (PARTITION BY id) AS told FROM m WHERE type = 'way')
SELECT id, pos, ref AS way FROM w WHERE role = 'outer' OR NOT told
""")
def relation_outer_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ways of relations' outer rings; members are made from order lines."""
    m = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("id"), "l_linenumber", "l_partkey", "l_suppkey", F.when(F.col("l_suppkey") % 7 == 0, "node").otherwise("way").alias("type"),
        F.when(F.col("l_returnflag") == "R", "outer").when(F.col("l_returnflag") == "A", "inner").otherwise("").alias("role"),
    )
    members = F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "type", "role"))), lambda s: F.struct(s["type"].alias("type"), s["l_partkey"].alias("ref"), s["role"].alias("role")))
    return spatial.relation_ways(m.groupBy("id").agg(members.alias("members")))


@query()
def boundary_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single-line boundaries of parcels: each shared edge once, chained between junctions."""
    v = view(spark, sf_dir, "fx_parcels").select(F.col("parcel_id").alias("ord"), G.rectangle("e0", "n0", "e1", "n1").alias("ring"))
    return curves.boundaries(v).select(F.size("curve").alias("vertices"), F.to_json("curve").alias("curve"))


@query(with_views("""
WITH k AS (SELECT CASE WHEN parcel_id % 3 = 0 THEN 'north' ELSE 'south' END AS kind, e0, n0, e1, n1 FROM fx_parcels),
s AS (SELECT kind, (e0, n0) AS a, (e1, n0) AS b FROM k UNION ALL SELECT kind, (e1, n0), (e1, n1) FROM k UNION ALL SELECT kind, (e0, n1), (e1, n1) FROM k UNION ALL SELECT kind, (e0, n0), (e0, n1) FROM k)
SELECT kind, CAST(sum(len) AS DOUBLE) AS metres FROM (SELECT kind, 20.0 AS len FROM s GROUP BY kind, a, b) GROUP BY kind
"""))  # fmt: skip
def categorised_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metres of single-line boundaries in each category of parcels; a line between two categories belongs to both."""
    v = view(spark, sf_dir, "fx_parcels").select(F.col("parcel_id").alias("ord"), F.when(F.col("parcel_id") % 3 == 0, "north").otherwise("south").alias("kind"), G.rectangle("e0", "n0", "e1", "n1").alias("ring"))
    steps = F.transform(F.sequence(F.lit(1), F.size("curve") - 1), lambda i: F.hypot(F.get("curve", i)["x"] - F.get("curve", i - 1)["x"], F.get("curve", i)["y"] - F.get("curve", i - 1)["y"]))
    return curves.boundaries(v, "kind").select("kind", F.aggregate(steps, F.lit(0.0), lambda a, b: a + b).alias("m")).groupBy("kind").agg(F.round(F.sum("m"), 3).alias("metres"))
