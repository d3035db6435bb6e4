"""Writers of the survey's outputs; each leaves no file where there is nothing to write."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewright.functions import geometry as G
from sitewright.functions.projection import cells_of


#: Rows of a cell that one task writes.
SHARD_ROWS = 200_000


def is_empty(df: DataFrame) -> bool:
    return df.limit(1).count() == 0


def geometry(df: DataFrame) -> Column:
    """GeoJSON text of a row's geometry, from the first of its columns that is there and has a value.

    ``rings``: a polygon's outline and holes; ``ring``: an outline alone;
    ``polygons``: outline and holes of several; ``line``; ``lines``; ``x`` and ``y``.
    """
    pair = lambda p: F.array(p["x"], p["y"])
    closed = lambda r: F.transform(G.closed_ring(r), pair)
    shapes = {
        "rings": ("Polygon", lambda: F.transform("rings", closed)),
        "ring": ("Polygon", lambda: F.array(closed(F.col("ring")))),
        "polygons": ("MultiPolygon", lambda: F.transform("polygons", lambda p: F.transform(p, closed))),
        "line": ("LineString", lambda: F.transform("line", pair)),
        "lines": ("MultiLineString", lambda: F.transform("lines", lambda v: F.transform(v, pair))),
    }
    found = [F.when(F.col(c).isNotNull(), F.to_json(F.struct(F.lit(kind).alias("type"), of().alias("coordinates")))) for c, (kind, of) in shapes.items() if c in df.columns]
    if {"x", "y"} <= set(df.columns):
        found.append(F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), F.to_json(F.struct(F.lit("Point").alias("type"), F.array("x", "y").alias("coordinates")))))
    return F.coalesce(*found)


def _feature(df: DataFrame, props: list[str]) -> Column:
    known = F.to_json(F.struct(*props)) if props else F.lit("{}")
    return F.concat(F.lit('{"type":"Feature","properties":'), known, F.lit(',"geometry":'), geometry(df), F.lit("}"))


def feature_lines(df: DataFrame, props: list[str]) -> DataFrame:
    """(value): a feature to a row; properties that are null are left out, and rows without a geometry too."""
    return df.select(_feature(df, props).alias("value")).where("value IS NOT NULL")


def write_features(df: DataFrame, path: str, props: list[str], keep_empty: bool = False) -> bool:
    """Line-delimited features: one feature to a line, split over files as the plan is."""
    if not keep_empty and is_empty(df):
        return False
    feature_lines(df, props).write.mode("overwrite").text(path)
    return True


def write_collection(df: DataFrame, path: str, props: list[str], order: list[str], keep_empty: bool = False) -> bool:
    """One FeatureCollection, its features in ``order``, as text files that follow each other; no file where nothing is in it.

    Files are ranges of the order, so a collection of any size is written by
    many tasks; joined by name they are one JSON text.
    """
    if not keep_empty and is_empty(df):
        return False
    value = df.select(F.lit(1).alias("part"), F.struct(*order).alias("at"), _feature(df, props).alias("value")).where("value IS NOT NULL")
    first = value.agg(F.min("at").alias("first"))  # the one that no comma comes before
    value = value.join(F.broadcast(first), F.col("at") == F.col("first"), "left").select("part", "at", F.when(F.col("first").isNull(), F.concat(F.lit(","), "value")).otherwise(F.col("value")).alias("value"))
    spark = df.sparkSession
    edge = lambda part, s: spark.range(1).select(F.lit(part).alias("part"), F.lit(None).cast(value.schema["at"].dataType).alias("at"), F.lit(s).alias("value"))
    whole = edge(0, '{"type":"FeatureCollection","features":[').unionByName(value).unionByName(edge(2, "]}"))
    whole.orderBy("part", "at").select("value").write.mode("overwrite").text(path)
    return True


def write_layers(df: DataFrame, folder: str, layers: dict[str, Column], props: list[str]) -> list[str]:
    """Features of each layer that has any under its name, from one scan that is held while they are written; the names."""
    held = df.persist(StorageLevel.DISK_ONLY)
    try:
        return [name for name, belongs in layers.items() if write_features(held.where(belongs), f"{folder}/{name}", props)]
    finally:
        held.unpersist()


def sweep(spark: SparkSession, folder: str, could_write: list[str], wrote: list[str], complete: bool) -> list[str]:
    """Delete outputs of earlier runs: those that this run could have written and didn't, if it went through; the names.

    Nothing else in the folder is touched, and a run that was cut short deletes nothing.
    """
    if not complete:
        return []
    gone = []
    for name in sorted(set(could_write) - set(wrote)):
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if fs.exists(p) and fs.delete(p, True):
            gone.append(name)
    return gone


def write_osm(elements: DataFrame, path: str) -> bool:
    """Elements as XML lines: nodes, ways, relations, each by id. The order is global, so lines are ranged by it."""
    if is_empty(elements):
        return False
    esc = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    tags = F.array_join(F.transform(F.map_entries("tags"), lambda t: F.concat(F.lit('<tag k="'), esc(t["key"]), F.lit('" v="'), esc(t["value"]), F.lit('"/>'))), "")
    refs = F.array_join(F.transform(F.coalesce("refs", F.array().cast("array<bigint>")), lambda r: F.concat(F.lit('<nd ref="'), r.cast("string"), F.lit('"/>'))), "")
    members = F.array_join(F.transform(F.coalesce("members", F.array().cast("array<struct<type:string,ref:bigint,role:string>>")), lambda m: F.concat(F.lit('<member type="'), m["type"], F.lit('" ref="'), m["ref"].cast("string"), F.lit('" role="'), esc(m["role"]), F.lit('"/>'))), "")
    place = F.when(F.col("type") == "node", F.concat(F.lit(' lat="'), F.col("lat").cast("string"), F.lit('" lon="'), F.col("lon").cast("string"), F.lit('"'))).otherwise("")
    line = F.concat(F.lit("<"), "type", F.lit(' id="'), F.col("id").cast("string"), F.lit('" version="'), F.col("version").cast("string"), F.lit('"'), place, F.lit(">"), refs, members, F.coalesce(tags, F.lit("")), F.lit("</"), "type", F.lit(">"))
    rank = F.array_position(F.array(F.lit("node"), F.lit("way"), F.lit("relation")), F.col("type"))
    elements.withColumn("rank", rank).orderBy("rank", "id").select(line.alias("value")).write.mode("overwrite").text(path)
    return True


def write_shards(features: DataFrame, path: str) -> None:
    """Features (id, box, ...) copied to each 10 km cell that their box meets, a folder for each cell; the committer's mark comes last.

    A cell's rows go to as many tasks as it has SHARD_ROWS, so a city is not one task.
    """
    celled = features.withColumn("cell", F.explode(cells_of(F.col("box"))))
    tiles = celled.groupBy("cell").agg(F.ceil(F.count("*") / SHARD_ROWS).cast("int").alias("__tiles"))
    celled = celled.join(tiles, "cell").withColumn("__tile", F.pmod(F.xxhash64("id"), F.col("__tiles")))
    celled.repartition("cell", "__tile").drop("__tiles", "__tile").write.mode("overwrite").partitionBy("cell").parquet(path)


def write_partitioned(df: DataFrame, path: str, by: str) -> None:
    """A folder for each value (buckets of map features, contour intervals); on a rerun only those that the run makes are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def write_record(df: DataFrame, path: str) -> None:
    """A one-row record (manifest, project setting, report) as JSON."""
    df.coalesce(1).write.mode("overwrite").json(path)


def report_text(sections: DataFrame) -> DataFrame:
    """(ord, title, lines) as one text: a heading and a dash before each line, or ``nothing found``."""
    body = F.when(F.size("lines") > 0, F.array_join(F.transform("lines", lambda v: F.concat(F.lit("- "), v)), "\n")).otherwise("- nothing found")
    one = F.sort_array(F.collect_list(F.struct("ord", F.concat("title", F.lit("\n"), body).alias("text"))))
    return sections.agg(F.array_join(F.transform(one, lambda s: s["text"]), "\n\n").alias("text"))
