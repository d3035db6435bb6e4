"""Readers, writers, plug-ins, plans and streams."""

from __future__ import annotations

import datetime
import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitewright.functions import geometry as G
from sitewright.plans.package import Pipeline, Request, check_paths, plan_tiles
from sitewright.sources import files, plugins, rasters, sinks
from sitewright.streaming import events

OSM = """<osm><node id="1" lat="51.5" lon="-3.1" version="2"><tag k="name" v="A &amp; B"/></node><node lat="1" lon="1"/>
<way id="5" version="x"><nd ref="1"/><nd ref="2"/><tag k="building" v="yes"/></way>
<relation id="7" version="1"><member type="way" ref="5" role="outer"/></relation></osm>"""
GML = """<wfs:FeatureCollection xmlns:wfs="w" xmlns:LR="l" xmlns:gml="g">
<wfs:member><LR:PREDEFINED><LR:INSPIREID>11</LR:INSPIREID><LR:VALIDFROM>2020</LR:VALIDFROM><LR:GEOMETRY><gml:Polygon srsName="urn:ogc:def:crs:EPSG::27700"><gml:exterior><gml:LinearRing><gml:posList>0 0 10 0 10 10 0 0</gml:posList></gml:LinearRing></gml:exterior></gml:Polygon></LR:GEOMETRY></LR:PREDEFINED></wfs:member>
<wfs:member><LR:PREDEFINED><LR:INSPIREID>12</LR:INSPIREID><LR:GEOMETRY><gml:Polygon><gml:exterior><gml:LinearRing><gml:posList>0 0 10 zero</gml:posList></gml:LinearRing></gml:exterior></gml:Polygon></LR:GEOMETRY></LR:PREDEFINED></wfs:member>
<wfs:member><LR:PREDEFINED><LR:INSPIREID>13</LR:INSPIREID><LR:GEOMETRY><gml:Polygon><gml:exterior><gml:LinearRing><gml:posList>900 900 910 900 910 910</gml:posList></gml:LinearRing></gml:exterior></gml:Polygon></LR:GEOMETRY></LR:PREDEFINED></wfs:member>
</wfs:FeatureCollection>"""


def test_osm_round_trip(spark, tmp_path):
    (tmp_path / "a.osm").write_text(OSM)
    df = files.osm(spark, str(tmp_path / "a.osm"))
    rows = {(r["type"], r["id"]): r for r in df.collect()}
    assert set(rows) == {("node", 1), ("way", 5), ("relation", 7)}
    assert rows["way", 5]["version"] == 0 and rows["way", 5]["refs"] == [1, 2] and rows["node", 1]["tags"]["name"] == "A & B"
    assert sinks.write_osm(df, str(tmp_path / "out"))
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert len(lines) == 3 and any('v="A &amp; B"' in x for x in lines)
    assert not sinks.write_osm(df.where("id < 0"), str(tmp_path / "none")) and not (tmp_path / "none").exists()


def test_features(spark, tmp_path):
    square = [[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]
    data = {"type": "FeatureCollection", "features": [
        {"id": "a", "properties": {"class": "park"}, "geometry": {"type": "Polygon", "coordinates": [square]}},
        {"properties": {"id": "b"}, "geometry": {"type": "MultiPolygon", "coordinates": [[square], [square]]}},
        {"id": "c", "properties": {}, "geometry": {"type": "MultiPoint", "coordinates": [[1, 2], [3, 4]]}},
    ]}
    (tmp_path / "f.json").write_text(json.dumps(data))
    df = files.features(spark, str(tmp_path / "f.json"))
    assert {r["id"] for r in df.collect()} == {"a", "b", "c"}
    areas = files.polygons(df).select("id", G.ring_area(F.get("rings", F.lit(0))).alias("area")).collect()
    assert sorted((r["id"], r["area"]) for r in areas) == [("a", 4), ("b", 4), ("b", 4)]
    assert sorted((r["x"], r["y"]) for r in files.points(df).collect()) == [(1, 2), (3, 4)]
    assert files.features(spark, str(tmp_path / "absent.json"), optional=True).count() == 0
    ring = files.polygons(df).select("id", G.open_ring(F.get("rings", F.lit(0))).alias("ring"))
    assert sinks.write_features(ring, str(tmp_path / "out"), ["id"])
    assert json.loads(spark.read.text(str(tmp_path / "out")).first()["value"])["geometry"]["coordinates"][0][0] == [0.0, 0.0]


def test_parcels_skip_what_is_malformed_or_away(spark, tmp_path):
    (tmp_path / "p.gml").write_text(GML)
    rows = files.parcels(spark, str(tmp_path / "p.gml"), (0, 0, 100, 100)).collect()
    assert [(r["inspire_id"], len(r["ring"])) for r in rows] == [(11, 4)]
    (tmp_path / "q.gml").write_text(GML.replace("27700", "4326"))
    with pytest.raises(Exception, match="National Grid"):
        files.parcels(spark, str(tmp_path / "q.gml"), (0, 0, 100, 100)).collect()


def test_small_tables(spark, tmp_path):
    (tmp_path / "u.csv").write_text("﻿UPRN,X_COORDINATE,Y_COORDINATE,LATITUDE,LONGITUDE\n1,2,3,4.5,5.5\n")
    assert tuple(files.addresses(spark, str(tmp_path / "u.csv")).first()) == (1, 2, 3, 4.5, 5.5)
    (tmp_path / "i.json").write_text('{"A": [0, 1, 2, 3], "B": [4, 5, 6, 7]}')
    assert sorted(map(tuple, files.authorities(spark, str(tmp_path / "i.json")).collect()))[1] == ("B", 4, 5, 6, 7)
    (tmp_path / "d.json").write_text('[{"area": "GB", "format": "GML", "fileName": "x"}, {"area": "TQ", "format": "GML", "fileName": "y"}]')
    assert files.downloads(spark, str(tmp_path / "d.json"), "TQ", "GML").first()["fileName"] == "y"


def test_shards_read_only_their_cells(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1000.0), ("b", 35000.0), ("", 1500.0), ("", 1600.0)], "id string, x double")
    box = F.struct(F.col("x").alias("x0"), F.lit(500.0).alias("y0"), (F.col("x") + 12000).alias("x1"), F.lit(600.0).alias("y1"))
    sinks.write_shards(rows.withColumn("box", box), str(tmp_path / "s"))
    found = files.shards(spark, str(tmp_path / "s"), (0, 0, 19000, 9000))
    assert sorted(r["id"] for r in found.collect()) == ["", "", "", "", "a"]  # unnamed ones come from each of their cells
    assert "PartitionFilters: [cell" in found._jdf.queryExecution().toString()


def test_ascii_grid(spark, tmp_path):
    (tmp_path / "g.asc").write_text("ncols 3\nnrows 2\nxllcorner 10\nyllcorner 20\ncellsize 2\nNODATA_value -9999\n1 2 3\n4 -9999 6\n")
    r = rasters.parse_asc((tmp_path / "g.asc").read_text())
    assert (r.n_top, r.values.shape) == (24, (2, 3)) and np.isnan(r.values[1, 1])
    assert r.sample(12, 22) == pytest.approx((1 + 2 + 4) / 3) and r.sample(500, 500) is None
    assert rasters.asc_pixels(spark, str(tmp_path / "g.asc")).count() == 5


def test_tiff_round_trip_and_windows(spark, tmp_path):
    values = np.arange(300 * 520, dtype=np.float32).reshape(300, 520)
    values[5, 7] = np.nan
    data = rasters.write_tiff(rasters.Raster(1000.0, 5000.0, 1.0, 1.0, values))
    reads = []
    t = rasters.Tiff(lambda at, n: reads.append(n) or data[at : at + n])
    back = t.raster(1000, 4700, 1520, 5000)
    assert np.array_equal(back.values, values, equal_nan=True) and (back.e0, back.n_top) == (1000, 5000)
    reads.clear()
    part = t.raster(1513, 4890, 1519, 4910)
    assert np.array_equal(part.values, values[90:110, 513:519]) and sum(reads) < len(data) / 2
    assert np.isnan(t.raster(990, 4990, 1010, 5010).values[0, 0])
    (tmp_path / "r.tif").write_bytes(data)
    assert rasters.tiff_pixels(spark, str(tmp_path / "r.tif")).count() == values.size - 1
    with pytest.raises(ValueError, match="TIFF"):
        rasters.Tiff(lambda at, n: b"GIF89a" + b"\0" * 20)


def test_lzw():
    assert rasters.lzw_decode(bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01])) == b"-----A---B"


def test_coalesce():
    got = list(rasters.coalesce([(10, 5, 0), (15, 5, 1), (30, 5, 2)]))
    assert [(s, n, len(m)) for s, n, m in got] == [(10, 10, 2), (30, 5, 1)]


def test_grid_message():
    assert rasters.varint(300) == b"\xac\x02"
    b = rasters.encode_grid(2, 1, 0.0, 0.0, 1.0, 1.0, np.array([1.5, np.nan]))
    assert b[:4] == b"\x08\x02\x10\x01" and b[-8:] == bytes.fromhex("000000000000f8ff")
    with pytest.raises(ValueError):
        rasters.encode_grid(2, 2, 0.0, 0.0, 1.0, 1.0, np.zeros(3))


def test_plugins(spark, tmp_path):
    for t in ("r00_c00", "r00_c01"):
        (tmp_path / f"{t}.json").write_text(json.dumps({"features": [{"id": t, "properties": {"k": 1}, "geometry": None}]}))
    source = plugins.register(plugins.Source("staged", "Staged tiles", reader=plugins.StagedTiles), spark)
    with pytest.raises(ValueError, match="already"):
        plugins.register(source)
    with pytest.raises(ValueError, match="no source"):
        plugins.get("other")
    df = spark.read.format("staged_tiles").option("path", str(tmp_path)).option("tiles", "r00_c00,r00_c01").load()
    assert df.count() == 2 and [r["id"] for r in df.where("tile_id = 'r00_c01'").collect()] == ["r00_c01"]
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("a.gml", "one")
        z.writestr("b.txt", "two")
    spark.dataSource.register(plugins.ZipMembers)
    assert [tuple(r) for r in spark.read.format("zip_members").option("path", str(tmp_path / "z.zip")).option("suffix", ".gml").load().collect()] == [("a.gml", b"one")]
    (tmp_path / "lay").mkdir()
    for k in (0, 1):
        (tmp_path / "lay" / f"{k}.json").write_text(json.dumps({"features": [{"id": k, "properties": {}, "geometry": None}], "next": 1 if k == 0 else None}))
    spark.dataSource.register(plugins.StagedPages)
    pages = lambda most: spark.read.format("staged_pages").option("path", str(tmp_path)).option("layers", "lay").option("max_pages", most).load()
    assert pages(5).count() == 2
    with pytest.raises(Exception, match="more than 1 pages"):
        pages(1).count()


def test_plan(spark):
    r = Request.parse("-3.0,51.02,-3.05,51.0", sources=("osm",), day=datetime.date(2024, 5, 1), site="Old Mill")
    assert (r.west, r.north, r.stem()) == (-3.05, 51.02, "Old-Mill_2024-05-01")
    assert plan_tiles(spark, r).count() == 4
    for bad in ({"sources": ()}, {"sources": ("a",), "categories": ()}, {"sources": ("a",), "categories": ("nothing",)}):
        with pytest.raises(ValueError):
            Request(-3, 51, -2.9, 51.1, **bad)
    with pytest.raises(ValueError):
        check_paths("/x" * 100, ["y" * 80])
    p = Pipeline()
    p.step("elements")(lambda f: f["base"].where("id > 1"))
    p.step("fused")(lambda f: f["absent"])
    p.step("heights")(lambda f: f["elements"].where("id > 2"))
    have = p.run({"base": spark.range(5)})
    assert have["heights"].count() == 2 and p.records["fused"]["ran"] is False
    m = p.manifest(spark, r).first()
    assert [(s["step"], s["ran"]) for s in m["steps"]] == [("elements", True), ("fused", False), ("heights", True)]


def test_streams_agree_with_batch(spark, sf, tmp_path):
    from sitewright.operators import jobs
    from sitewright.queries.fixtures import view

    batch = view(spark, sf, "fx_jobs").select("tile_id", "source", "status", F.col("seq").cast("long"), F.col("ts").cast("timestamp"), F.col("seconds").cast("double"))
    batch.repartition(4).write.parquet(str(tmp_path / "in"))
    q = events.latest(events.read(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("latest").start()
    q.processAllAvailable()
    q.stop()
    want = {tuple(r) for r in jobs.state(batch).select("tile_id", "source", "status", "seq").collect()}
    assert {tuple(r) for r in spark.sql("SELECT tile_id, source, status, seq FROM latest").collect()} == want
    for make in (events.throughput, events.heartbeats):
        q = make(events.read(spark, str(tmp_path / "in"), 10)).writeStream.outputMode("append").format("memory").queryName(make.__name__).start()
        q.processAllAvailable()
        q.stop()
        assert spark.table(make.__name__).columns


def test_lzw_codes_beyond_the_table_are_an_error():
    bits = "".join(f"{c:09b}" for c in (256, 65, 258, 257)).ljust(40, "0")  # 258 is what it makes itself
    assert rasters.lzw_decode(int(bits, 2).to_bytes(5, "big")) == b"AAA"
    bits = "".join(f"{c:09b}" for c in (256, 65, 300, 257)).ljust(40, "0")
    with pytest.raises(ValueError, match="broken"):
        rasters.lzw_decode(int(bits, 2).to_bytes(5, "big"))
