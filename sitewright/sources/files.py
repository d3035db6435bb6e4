"""Readers of the survey's file formats as DataFrames with declared schemas.

XML, JSON and CSV go through Spark's own readers: files are split and parsed by
the executors, and columns that a query leaves out are never built.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewright.functions import geometry as G

RING = "array<struct<x:double,y:double>>"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or pattern matches anything, by the path's own file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return bool(found)


def osm(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Elements (type, id, version, lat, lon, refs, members, tags) of element files; those without an id are dropped.

    A version that is missing or no number counts as 0.
    """
    tag = "tag ARRAY<STRUCT<_k STRING, _v STRING>>"
    schemas = {
        "node": f"_id LONG, _version STRING, _lat DOUBLE, _lon DOUBLE, {tag}",
        "way": f"_id LONG, _version STRING, nd ARRAY<STRUCT<_ref LONG>>, {tag}",
        "relation": f"_id LONG, _version STRING, member ARRAY<STRUCT<_type STRING, _ref LONG, _role STRING>>, {tag}",
    }
    parts = []
    for kind, schema in schemas.items():
        df = spark.read.format("xml").option("rowTag", kind).schema(schema).load(path)  # type: ignore[arg-type]
        has = set(df.columns)
        refs = F.transform("nd", lambda n: n["_ref"]) if "nd" in has else F.lit(None).cast("array<bigint>")
        members = F.transform("member", lambda m: F.struct(m["_type"].alias("type"), m["_ref"].alias("ref"), m["_role"].alias("role"))) if "member" in has else F.lit(None).cast("array<struct<type:string,ref:bigint,role:string>>")
        tags = F.map_from_entries(F.filter(F.transform(F.coalesce("tag", F.array().cast("array<struct<_k:string,_v:string>>")), lambda t: F.struct(t["_k"], t["_v"])), lambda t: t["_k"].isNotNull()))
        parts.append(df.where("_id IS NOT NULL").select(
            F.lit(kind).alias("type"), F.col("_id").alias("id"), F.coalesce(F.col("_version").try_cast("int"), F.lit(0)).alias("version"),
            (F.col("_lat") if kind == "node" else F.lit(None).cast("double")).alias("lat"), (F.col("_lon") if kind == "node" else F.lit(None).cast("double")).alias("lon"),
            refs.alias("refs"), members.alias("members"), tags.alias("tags"),
        ))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


FEATURE = "type STRING, features ARRAY<STRUCT<id: STRING, properties: MAP<STRING, STRING>, geometry: STRUCT<type: STRING, coordinates: STRING>>>"


def features(spark: SparkSession, path: str | Sequence[str], optional: bool = False) -> DataFrame:
    """(id, props, geom_type, coordinates) of feature collections; coordinates stay JSON, as they nest to four depths.

    The id is the feature's own, else its properties'; one without either is an
    error. An absent file is an error, or empty where it is optional.
    """
    empty = "id STRING, props MAP<STRING, STRING>, geom_type STRING, coordinates STRING"
    if optional and not exists(spark, path if isinstance(path, str) else path[0]):
        return spark.createDataFrame([], empty)
    raw = spark.read.option("multiLine", True).schema(FEATURE).json(path)  # type: ignore[arg-type]
    shape = F.when(F.col("type") == "FeatureCollection", F.col("features")).otherwise(F.raise_error(F.lit("not a FeatureCollection")).cast("array<struct<id:string,properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"))
    f = raw.select(F.explode(shape).alias("f"))
    named = F.coalesce("f.id", F.element_at("f.properties", F.lit("id")))
    named = F.coalesce(named, F.raise_error(F.lit("a feature has no id")).cast("string"))
    return f.select(named.alias("id"), F.col("f.properties").alias("props"), F.col("f.geometry.type").alias("geom_type"), F.col("f.geometry.coordinates").alias("coordinates"))


def _points(coordinates: Column) -> Column:
    return F.transform(coordinates, lambda p: G.point(F.get(p, F.lit(0)), F.get(p, F.lit(1))))


def polygons(df: DataFrame) -> DataFrame:
    """A row for each polygon of Polygon and MultiPolygon rows, with ``rings``; other geometries have none."""
    one = F.from_json("coordinates", "array<array<array<double>>>")
    many = F.from_json("coordinates", "array<array<array<array<double>>>>")
    all_ = F.when(F.col("geom_type") == "Polygon", F.array(one)).when(F.col("geom_type") == "MultiPolygon", many)
    return df.withColumn("__p", F.explode(all_)).withColumn("rings", F.transform("__p", _points)).drop("__p")


def points(df: DataFrame) -> DataFrame:
    """A row for each point of Point and MultiPoint rows, with x and y."""
    all_ = F.when(F.col("geom_type") == "Point", F.array(F.from_json("coordinates", "array<double>"))).when(F.col("geom_type") == "MultiPoint", F.from_json("coordinates", "array<array<double>>"))
    return df.withColumn("__p", F.explode(all_)).withColumns({"x": F.get("__p", F.lit(0)), "y": F.get("__p", F.lit(1))}).drop("__p")


# Elements and columns of the open mapping products.
MAP_TYPES = (
    "Building", "Woodland", "Foreshore", "SurfaceWater_Area", "SurfaceWater_Line", "TidalWater", "ImportantBuilding", "FunctionalSite", "RailwayTrack", "RailwayTunnel", "RailwayStation", "Glasshouse",
)
_POS = "`gml:posList` STRING"
_LINEAR = f"`gml:LinearRing` STRUCT<{_POS}>"
_PATCH = f"`gml:PolygonPatch` STRUCT<`gml:exterior` STRUCT<{_LINEAR}>, `gml:interior` ARRAY<STRUCT<{_LINEAR}>>>"
_POLYGON = f"`gml:Polygon` STRUCT<`gml:exterior` STRUCT<{_LINEAR}>, `gml:interior` ARRAY<STRUCT<{_LINEAR}>>>"


def map_features(spark: SparkSession, path: str, kinds: Sequence[str] = MAP_TYPES) -> DataFrame:
    """(feature_type, id, code, theme, class, name, outline, holes, line, point) of open map GML; a feature has an outline, a line or a point."""
    schema = f"`_gml:id` STRING, `oml:featureCode` INT, `oml:buildingTheme` STRING, `oml:siteTheme` STRING, `oml:classification` STRING, `oml:distinctiveName` STRING, `oml:geometry` STRUCT<`gml:Surface`: STRUCT<`gml:patches`: STRUCT<{_PATCH.replace('` STRUCT', '`: STRUCT', 1)}>>, {_POLYGON.replace('` STRUCT', '`: STRUCT', 1)}, `gml:LineString`: STRUCT<`gml:posList`: STRING>, `gml:Point`: STRUCT<`gml:pos`: STRING>>"
    parse = lambda c: F.when(c.isNotNull(), G.parse_pos_list(c))
    out = None
    for kind in kinds:
        df = spark.read.format("xml").option("rowTag", f"oml:{kind}").schema(schema).load(path)
        shape = "`oml:geometry`.`gml:Surface`.`gml:patches`.`gml:PolygonPatch`", "`oml:geometry`.`gml:Polygon`"
        outline = F.coalesce(*[F.col(f"{p}.`gml:exterior`.`gml:LinearRing`.`gml:posList`") for p in shape])
        inner = F.coalesce(*[F.col(f"{p}.`gml:interior`") for p in shape], F.array().cast("array<struct<`gml:LinearRing`:struct<`gml:posList`:string>>>"))
        holes = F.transform(F.filter(inner, lambda r: r["gml:LinearRing"]["gml:posList"].isNotNull()), lambda r: G.parse_pos_list(r["gml:LinearRing"]["gml:posList"]))
        df = df.select(
            F.lit(kind).alias("feature_type"), F.col("`_gml:id`").alias("id"), F.col("`oml:featureCode`").alias("code"), F.coalesce("`oml:buildingTheme`", "`oml:siteTheme`").alias("theme"),
            F.col("`oml:classification`").alias("class"), F.col("`oml:distinctiveName`").alias("name"), parse(outline).alias("outline"),
            F.when(outline.isNotNull(), holes).alias("holes"), parse(F.col("`oml:geometry`.`gml:LineString`.`gml:posList`")).alias("line"), F.get(parse(F.col("`oml:geometry`.`gml:Point`.`gml:pos`")), F.lit(0)).alias("point"),
        )
        out = df if out is None else out.unionByName(df)
    return out  # type: ignore[return-value]


def road_links(spark: SparkSession, path: str) -> DataFrame:
    """(id, class, function, form, name, number, trunk, primary, length, line) of open roads GML."""
    columns = {"class": "roadClassification", "function": "roadFunction", "form": "formOfWay", "name": "name1", "number": "roadClassificationNumber", "trunk": "trunkRoad", "primary": "primaryRoute", "length": "length"}
    text = ", ".join(f"`road:{v}` STRUCT<_VALUE: STRING>" for v in columns.values())
    schema = f"`_gml:id` STRING, {text}, `net:centrelineGeometry` STRUCT<`gml:LineString`: STRUCT<`gml:posList`: STRING>>"
    df = spark.read.format("xml").option("rowTag", "road:RoadLink").schema(schema).load(path)
    value = lambda c: F.col(f"`road:{c}`._VALUE")
    kinds = {"trunk": lambda c: c == "true", "primary": lambda c: c == "true", "length": lambda c: c.cast("double")}
    pos = F.col("`net:centrelineGeometry`.`gml:LineString`.`gml:posList`")
    return df.select(F.col("`_gml:id`").alias("id"), *[kinds.get(k, lambda c: c)(value(v)).alias(k) for k, v in columns.items()], F.when(pos.isNotNull(), G.parse_pos_list(pos)).alias("line"))


def greenspace(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Sites (id, function, name) and access points (id, access, site) of open greenspace GML."""
    sites = spark.read.format("xml").option("rowTag", "ogsp:GreenspaceSite").schema("`_gml:id` STRING, `ogsp:function` STRING, `ogsp:distinctiveName1` STRING").load(path)
    access = spark.read.format("xml").option("rowTag", "ogsp:AccessPoint").schema("`_gml:id` STRING, `ogsp:accessType` STRING, `ogsp:refToGreenspaceSite` STRING").load(path)
    return (
        sites.select(F.col("`_gml:id`").alias("id"), F.col("`ogsp:function`").alias("function"), F.col("`ogsp:distinctiveName1`").alias("name")),
        access.select(F.col("`_gml:id`").alias("id"), F.col("`ogsp:accessType`").alias("access"), F.col("`ogsp:refToGreenspaceSite`").alias("site")),
    )


def topography(spark: SparkSession, path: str, kinds: Sequence[str] = ("TopographicArea", "TopographicLine", "TopographicPoint")) -> DataFrame:
    """(feature_type, id, code, themes, groups) of topography GML; repeated children are lists."""
    out = None
    for kind in kinds:
        df = spark.read.format("xml").option("rowTag", kind).option("ignoreNamespace", True).schema("_fid STRING, featureCode INT, theme ARRAY<STRING>, descriptiveGroup ARRAY<STRING>").load(path)
        df = df.select(F.lit(kind).alias("feature_type"), F.col("_fid").alias("id"), F.col("featureCode").alias("code"), F.col("theme").alias("themes"), F.col("descriptiveGroup").alias("groups"))
        out = df if out is None else out.unionByName(df)
    return out  # type: ignore[return-value]


def parcels(spark: SparkSession, path: str, window: tuple[float, float, float, float], srs: str = "urn:ogc:def:crs:EPSG::27700") -> DataFrame:
    """(inspire_id, valid_from, ring) of parcels whose outline's box meets the window; a malformed one is skipped.

    Another reference system is an error: its numbers would be taken for metres.
    """
    ring = "STRUCT<`gml:LinearRing`: STRUCT<`gml:posList`: STRING>>"
    schema = f"`LR:INSPIREID` LONG, `LR:VALIDFROM` STRING, `LR:GEOMETRY` STRUCT<`gml:Polygon`: STRUCT<_srsName: STRING, `gml:exterior`: {ring}, `gml:interior`: ARRAY<{ring}>>>"
    df = spark.read.format("xml").option("rowTag", "LR:PREDEFINED").schema(schema).load(path)
    poly = F.col("`LR:GEOMETRY`.`gml:Polygon`")
    pos = F.regexp_replace(F.trim(poly["gml:exterior"]["gml:LinearRing"]["gml:posList"]), r"\s+", " ")
    numbers = F.transform(F.split(pos, " "), lambda v: v.try_cast("double"))
    good = pos.isNotNull() & (F.size(numbers) % 2 == 0) & (F.size(numbers) >= 6) & F.forall(numbers, lambda v: v.isNotNull())
    named = F.when(poly["_srsName"].isNull() | (poly["_srsName"] == srs), pos).otherwise(F.raise_error(F.lit("parcels are not on the National Grid")).cast("string"))
    ring_of = F.when(good, G.parse_pos_list(named))  # in one expression: Spark may test filters in any order
    out = df.select(F.col("`LR:INSPIREID`").alias("inspire_id"), F.col("`LR:VALIDFROM`").alias("valid_from"), ring_of.alias("ring")).where("ring IS NOT NULL")
    box = F.struct(*[F.lit(float(v)).alias(n) for v, n in zip(window, ("x0", "y0", "x1", "y1"))])
    return out.where(G.overlap_closed(G.bbox("ring"), box))


def addresses(spark: SparkSession, path: str) -> DataFrame:
    """Property reference points: the CSV's five columns, typed."""
    return spark.read.option("header", True).option("enforceSchema", True).schema("uprn LONG, x_coordinate DOUBLE, y_coordinate DOUBLE, latitude DOUBLE, longitude DOUBLE").csv(path)


def authorities(spark: SparkSession, path: str) -> DataFrame:
    """(name, west, south, east, north) of an index of areas by name."""
    raw = spark.read.option("multiLine", True).text(path, wholetext=True)
    rows = raw.select(F.explode(F.from_json("value", "map<string,array<double>>")).alias("name", "b"))
    return rows.select("name", *[F.get("b", F.lit(i)).alias(n) for i, n in enumerate(("west", "south", "east", "north"))])


def downloads(spark: SparkSession, path: str, area: str, format_: str, subformat: str | None = None) -> DataFrame:
    """The entry of a product's listing for an area and format, if there is one; the first by name of several."""
    rows = spark.read.option("multiLine", True).schema("md5 STRING, size LONG, url STRING, format STRING, subformat STRING, area STRING, fileName STRING").json(path)
    want = (F.col("area") == area) & (F.col("format") == format_)
    found = rows.where(want if subformat is None else want & (F.col("subformat") == subformat))
    return found.orderBy(F.col("fileName").asc_nulls_last(), F.col("url").asc_nulls_last()).limit(1)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row of a package's manifest: its box and the sources it used."""
    return spark.read.option("multiLine", True).schema("bbox STRUCT<west: DOUBLE, south: DOUBLE, east: DOUBLE, north: DOUBLE>, sources ARRAY<STRUCT<id: STRING, status: STRING>>, started_at STRING").json(path)


def records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Line-delimited JSON; a line that does not fit is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def shards(spark: SparkSession, path: str, box: tuple[float, float, float, float]) -> DataFrame:
    """Features of a cell-partitioned store that meet a rectangle: only its cells are read, each feature once."""
    from sitewright.functions.projection import cells_of

    rect = F.struct(*[F.lit(float(v)).alias(n) for v, n in zip(box, ("x0", "y0", "x1", "y1"))])
    names = spark.range(1).select(cells_of(rect).alias("c")).first()["c"]  # static, so that partitions are pruned while planning
    found = spark.read.parquet(path).where(F.col("cell").isin(names)).where(G.overlap_closed(F.col("box"), rect))
    named = found.where("coalesce(id, '') <> ''").dropDuplicates(["id"])
    return named.unionByName(found.where("coalesce(id, '') = ''"))


def themed(spark: SparkSession, path: str, box: tuple[float, float, float, float]) -> DataFrame:
    """GeoParquet with a ``bbox`` struct: rows whose box meets a rectangle; row groups away from it are skipped by their statistics."""
    west, south, east, north = box
    df = spark.read.parquet(path)
    return df.where((F.col("bbox.xmin") <= east) & (F.col("bbox.xmax") >= west) & (F.col("bbox.ymin") <= north) & (F.col("bbox.ymax") >= south))


def authorities_for(index: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Names of the areas whose box meets a rectangle, sorted."""
    west, south, east, north = box
    return index.where((F.col("west") <= east) & (F.col("east") >= west) & (F.col("south") <= north) & (F.col("north") >= south)).select("name").orderBy("name")


def newest(spark: SparkSession, path: str, by: str = "month") -> DataFrame:
    """The newest partition of a landing zone; only its files are listed into the scan."""
    df = spark.read.parquet(path)
    last = df.select(F.max(by)).first()[0]  # a partition column: answered from the folders' names
    return df.where(F.col(by) == F.lit(last))


def newest_complete(files_of: DataFrame, wanted: Sequence[str]) -> str | None:
    """The last version, as text, of which every wanted part is there: rows (version, part)."""
    want = sorted(set(wanted))
    full = files_of.where(F.col("part").isin(want)).groupBy("version").agg(F.countDistinct("part").alias("n")).where(F.col("n") == len(want))
    return full.select(F.max("version")).first()[0]


def shift_grid(spark: SparkSession, path: str, columns: int = 701, rows: int = 1251):  # noqa: ANN201
    """A datum's shift grid from its CSV (point, e, n, de, dn, height shift, datum); nodes of datum 16 lie outside.

    The grid's size is fixed by the format, so it fits the driver; executors get it inside the projecting function.
    """
    import numpy as np

    from sitewright.functions.projection import ShiftGrid

    df = spark.read.option("header", True).schema("point LONG, e DOUBLE, n DOUBLE, de DOUBLE, dn DOUBLE, dz DOUBLE, datum INT").csv(path)
    de, dn = np.full((rows, columns), np.nan), np.full((rows, columns), np.nan)
    for r in df.where("datum <> 16").select((F.col("e") / 1000).cast("int").alias("c"), (F.col("n") / 1000).cast("int").alias("r"), "de", "dn").collect():
        de[r["r"], r["c"]], dn[r["r"], r["c"]] = r["de"], r["dn"]
    return ShiftGrid(de, dn)


def missing_inputs(spark: SparkSession, expected: Sequence[str]) -> list[str]:
    """Expected files that are absent or empty."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for name in expected:
        p = jvm.org.apache.hadoop.fs.Path(name)
        fs = p.getFileSystem(conf)
        if not fs.exists(p) or fs.getFileStatus(p).getLen() == 0:
            out.append(name)
    return out
