"""Parcels by what covers them, and planning constraints on a site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitewright.functions import categories as K
from sitewright.functions import geometry as G
from sitewright.operators.spatial import covered_grid_points, grid_points, points_in_rings


def classify(samples: DataFrame, overlays: DataFrame, size: float) -> DataFrame:
    """(parcel_id, category, samples) from samples (parcel_id, sample_id, x, y) and overlays (bucket, ring).

    A sample votes once for each bucket that covers it; of equal counts the
    earlier bucket wins; gardens of which a building covers a sample are housing.
    Votes are counted per sample and bucket before parcels meet, so no parcel's
    samples are gathered.
    """
    hits = points_in_rings(samples.select("parcel_id", "sample_id", "x", "y"), overlays.select("bucket", "ring"), "x", "y", "ring", size)
    votes = hits.select("parcel_id", "sample_id", "bucket").distinct().groupBy("parcel_id", "bucket").agg(F.count("*").alias("samples"))
    return _decided(votes, samples.groupBy("parcel_id").agg(F.count("*").alias("samples")))


def classify_grid(parcels: DataFrame, overlays: DataFrame, step: float, size: float) -> DataFrame:
    """What ``classify`` gives for the grid points inside parcels (parcel_id, ring), which are counted without a row for each."""
    return _decided(covered_grid_points(parcels, overlays, "parcel_id", "bucket", step, size), grid_points(parcels, "parcel_id", step))


def _decided(votes: DataFrame, counts: DataFrame) -> DataFrame:
    """(parcel_id, category, samples) from votes (parcel_id, bucket, samples) and counts (parcel_id, samples)."""
    land = F.col("bucket") != "building"
    best = F.max_by(F.when(land, F.col("bucket")), F.when(land, F.struct("samples", -K.bucket_rank("bucket"))))
    won = votes.groupBy("parcel_id").agg(best.alias("bucket"), F.bool_or(~land).alias("building"))
    return counts.join(won, "parcel_id", "left").select("parcel_id", K.final_category("bucket", F.coalesce("building", F.lit(False))).alias("category"), "samples")


def share_grid(rect: Column, long_side: int = 400, x_scale: float = 1.0) -> Column:
    """struct<columns, rows> of the cells on which shares of a rectangle are counted; halves round to even."""
    w, h = (rect["x1"] - rect["x0"]) * x_scale, rect["y1"] - rect["y0"]
    side = lambda a, b: F.greatest(F.lit(1), F.bround(F.lit(float(long_side)) * a / F.nullif(b, F.lit(0.0))).cast("int"))
    return F.struct(F.when(w >= h, F.lit(long_side)).otherwise(side(w, h)).alias("columns"), F.when(w >= h, side(h, w)).otherwise(F.lit(long_side)).alias("rows"))


def covered_share(polygons: DataFrame, by: list[str], rings: str, rect: tuple[float, float, float, float], long_side: int = 400, x_scale: float = 1.0) -> DataFrame:
    """(by, share): part of a rectangle's cells whose centre lies in a polygon; overlaps count once, holes do not.

    Each polygon gives spans of columns for each row of cells: a row's crossings
    pair up, and a centre on either end of a span counts. Only the spans' cells
    are made distinct, so a polygon costs its rows, not the whole grid.
    """
    x0, y0, x1, y1 = rect
    box = F.struct(*[F.lit(float(v)).alias(n) for v, n in zip(rect, ("x0", "y0", "x1", "y1"))])
    shape = polygons.sparkSession.range(1).select(share_grid(box, long_side, x_scale).alias("s")).select("s.*").first()
    dx, dy = (x1 - x0) / shape["columns"], (y1 - y0) / shape["rows"]
    edges = polygons.select(*by, F.monotonically_increasing_id().alias("__p"), G.clip_polygon(rings, box).alias("c"))
    edges = edges.select(*by, "__p", F.flatten(F.transform("c", G.edges)).alias("e")).where(F.size("e") > 0)

    def spans(level: Column) -> Column:
        crossing = F.filter("e", lambda e: (e["a"]["y"] <= level) != (e["b"]["y"] <= level))
        xs = F.array_sort(F.transform(crossing, lambda e: e["a"]["x"] + (level - e["a"]["y"]) * (e["b"]["x"] - e["a"]["x"]) / F.nullif(e["b"]["y"] - e["a"]["y"], F.lit(0.0))))
        first = lambda x: F.greatest(F.lit(0), F.ceil((x - x0) / dx - 0.5).cast("int"))
        last = lambda x: F.least(F.lit(shape["columns"] - 1), F.floor((x - x0) / dx - 0.5).cast("int"))
        columns = lambda a, b: F.when(last(b) >= first(a), F.sequence(first(a), last(b))).otherwise(F.array().cast("array<int>"))
        return G.let(xs, lambda v: F.flatten(F.transform(F.sequence(F.lit(0), F.floor(F.size(v) / 2).cast("int") - 1), lambda i: F.when(F.size(v) >= 2, columns(F.get(v, 2 * i), F.get(v, 2 * i + 1))).otherwise(F.array().cast("array<int>")))))

    rows = edges.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(shape["rows"] - 1))))
    level = y0 + (F.col("row") + 0.5) * dy
    low, high = F.array_min(F.transform("e", lambda e: e["a"]["y"])), F.array_max(F.transform("e", lambda e: e["a"]["y"]))
    cells = rows.where((level >= low) & (level <= high)).select(*by, "row", F.explode(spans(level)).alias("column"))
    return cells.distinct().groupBy(*by).agg((F.count("*") / float(shape["columns"] * shape["rows"])).alias("share"))


def classify_feature(kind: Column, rings: Column, points: Column, site: Column, margin: Column) -> Column:
    """site, margin or null: polygons by clipped area, so that touching is nothing; points by closed rectangles."""
    polygon = F.when(F.exists(rings, lambda p: G.area_in_rect(p, site) > 0), "site").when(F.exists(rings, lambda p: G.area_in_rect(p, margin) > 0), "margin")
    at = F.when(F.exists(points, lambda p: G.in_rect(p["x"], p["y"], site)), "site").when(F.exists(points, lambda p: G.in_rect(p["x"], p["y"], margin)), "margin")
    return F.when(kind.isin("Polygon", "MultiPolygon"), polygon).when(kind.isin("Point", "MultiPoint"), at)


def margin_only(found: DataFrame) -> DataFrame:
    """Groups (layer_ord, designation, label) seen in the margin alone, with counts; labels may be null."""
    groups = found.groupBy("layer_ord", "designation", "label").agg(F.count_if(F.col("where") == "site").alias("on_site"), F.count_if(F.col("where") == "margin").alias("n"))
    return groups.where("on_site = 0 AND n > 0").drop("on_site")


def coverage_share(areas: DataFrame, rings: str, rect: Column, rect_area: float) -> DataFrame:
    """One row: the part of a rectangle that areas cover by their sum, 1 at most, and its verdict."""
    share = F.least(F.coalesce(F.sum(G.area_in_rect(rings, rect)), F.lit(0.0)) / rect_area, F.lit(1.0))
    return areas.agg(share.alias("share")).select("share", verdict("share").alias("verdict"))


def verdict(share: str) -> Column:
    return F.when(F.col(share) >= 0.98, "full").when(F.col(share) > 0, "partial").otherwise("none")


def resolve(sources: DataFrame) -> DataFrame:
    """Role of each source in each category (category, source_id, tier): the best tier is the base, the rest fill or are references.

    Tier none takes no part; a lower number is better.
    """
    live = sources.where(F.col("tier").isNotNull())
    best = F.min("tier").over(Window.partitionBy("category"))
    role = F.when(F.col("reference"), "reference").when(F.col("tier") == best, "base").otherwise("fill")
    return live.select("category", "source_id", "tier", role.alias("role"))
