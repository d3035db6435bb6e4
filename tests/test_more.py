"""Landing zones, mosaics, covers, quarters, tags and the command line."""

from __future__ import annotations

import datetime

import numpy as np
from pyspark.sql import functions as F

from sitewright.__main__ import main
from sitewright.functions import text as T
from sitewright.operators import jobs, land, raster, roofs, tiles
from sitewright.sources import files


def test_landing_zone(spark, tmp_path):
    spark.createDataFrame([(1, "2024-01"), (2, "2024-03"), (3, "2024-02")], "id int, month string").write.partitionBy("month").parquet(str(tmp_path / "z"))
    assert [r["id"] for r in files.newest(spark, str(tmp_path / "z")).collect()] == [2]
    have = spark.createDataFrame([("v1", "a"), ("v1", "b"), ("v2", "a"), ("v0", "a"), ("v0", "b")], "version string, part string")
    assert files.newest_complete(have, ["a", "b"]) == "v1" and files.newest_complete(have, ["c"]) is None
    (tmp_path / "empty").write_text("")
    assert files.missing_inputs(spark, [str(tmp_path / "empty"), str(tmp_path / "no"), str(tmp_path / "z" / "_SUCCESS")]) == [str(tmp_path / "empty"), str(tmp_path / "no"), str(tmp_path / "z" / "_SUCCESS")]


def test_themed_pushes_its_box_down(spark, tmp_path):
    spark.range(10).select("id", F.struct(F.col("id").cast("double").alias("xmin"), (F.col("id") + 1.0).alias("xmax"), F.lit(0.0).alias("ymin"), F.lit(1.0).alias("ymax")).alias("bbox")).write.parquet(str(tmp_path / "t"))
    df = files.themed(spark, str(tmp_path / "t"), (2.5, 0, 3.5, 1))
    assert sorted(r["id"] for r in df.collect()) == [2, 3]
    assert "PushedFilters: [IsNotNull(bbox.xmin)" in df._jdf.queryExecution().toString() or "bbox.xmin" in df._jdf.queryExecution().toString().split("PushedFilters")[1]


def test_authority_index(spark, tmp_path):
    (tmp_path / "i.json").write_text('{"B": [0, 0, 1, 1], "A": [0.5, 0.5, 2, 2], "C": [5, 5, 6, 6]}')
    found = files.authorities_for(files.authorities(spark, str(tmp_path / "i.json")), (0.9, 0.9, 1.5, 1.5))
    assert [r["name"] for r in found.collect()] == ["A", "B"]


def test_shift_grid_file(spark, tmp_path):
    lines = ["point,e,n,de,dn,dz,datum"] + [f"{c + r * 3},{c * 1000},{r * 1000},{10 + c},{20 + r},0,{16 if c == r == 2 else 1}" for r in range(3) for c in range(3)]
    (tmp_path / "s.csv").write_text("\n".join(lines))
    g = files.shift_grid(spark, str(tmp_path / "s.csv"), 3, 3)
    de, dn = g.at(np.array([500.0, 1500.0]), np.array([500.0, 1500.0]))
    assert (de[0], dn[0]) == (10.5, 20.5) and np.isnan(de[1])


def test_mosaic_last_member_wins(spark):
    px = spark.createDataFrame([(1, 0.5, 9.5, 1.0), (2, 0.5, 9.5, 2.0), (1, 1.5, 9.5, 3.0), (1, 50.0, 50.0, 9.0)], "ord int, e double, n double, z double")
    assert sorted((r["col"], r["row"], r["z"]) for r in raster.mosaic(px, 1.0, (0, 0, 10, 10)).collect()) == [(0, 0, 2), (1, 0, 3)]


def test_cover(spark):
    held = spark.createDataFrame([(0, 0), (1, 0)], "cx long, cy long")
    say = lambda box: raster.cover(box, held).first()["cover"]
    assert (say((10, 10, 900, 400)), say((10, 10, 1400, 400)), say((5000, 5000, 5100, 5100))) == ("full", "partial", "none")


def test_quarters(spark):
    box = F.struct(F.lit(0.0).alias("x0"), F.lit(51.0).alias("y0"), F.lit(0.02).alias("x1"), F.lit(51.02).alias("y1"))
    four = tiles.quarters(tiles.build(spark.range(1).select(box.alias("box")), 5_000.0, 100.0)).collect()
    assert sorted(t["tile_id"] for t in four) == [f"r00_c00_q{r}{c}" for r in (0, 1) for c in (0, 1)]
    assert max(t["core"]["x1"] for t in four) == max(t["query"]["x1"] for t in four)


def test_roof_tags_keep_what_is_there(spark):
    ways = spark.createDataFrame([(1, {"building": "yes", "roof:shape": "dome"}), (2, {"building": "yes"})], "id long, tags map<string,string>")
    forms = spark.createDataFrame([(1, "flat", None, 3.0, 3.0, 1.0), (2, "gable", 90.0, 3.0, 6.24, 0.9)], "fid long, shape string, direction double, eaves double, ridge double, quality double")
    got = {r["id"]: r["tags"] for r in roofs.tagged(ways, forms).collect()}
    assert got[1]["roof:shape"] == "dome" and "roof:direction" not in got[1]
    assert (got[2]["roof:direction"], got[2]["roof:height:ridge"]) == ("90", "6.2")


def test_texts(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first()["v"]
    assert one(T.clean_text(F.lit(" \tnull "))) is None and one(T.clean_text(F.lit(" a b "))) == "a b"
    assert one(T.slugify(F.lit("Ærø  Caffè -- 9!"))) == "AEro-Caffe-9"
    assert one(T.grades_text(F.create_map(F.lit("b"), F.lit(2), F.lit("II*"), F.lit(1), F.lit("I"), F.lit(3)))) == "Grade I 3, Grade II* 1, b 2"
    assert one(T.retry_seconds(F.lit("soon"))) is None and one(T.retry_seconds(F.lit("-4"))) == 0
    assert one(T.redact(F.lit("x?API_Key=abc&y=SECRETS"), F.lit("SECRETS"))) == "x?API_Key=***&y=***"
    assert tuple(one(T.place_names(F.create_map(F.lit("county"), F.lit(""), F.lit("state"), F.lit("Wales"), F.lit("town"), F.lit("Barry"))))) == ("Wales", "Barry")
    assert one(T.version_year(F.lit("2024-05"))) == 2024 and one(T.attribution(F.lit("{date} [year]"), F.lit("2024-05-01"))) == "2024-05-01 2024"
    assert one(jobs.remaining(F.lit(0.5), F.lit(30.0), F.lit(10.0))) == 30.0 and one(jobs.remaining(F.lit(0.05), F.lit(30.0), F.lit(100.0))) == 70.0


def test_share_of_a_polygon_with_a_hole(spark):
    rows = [("a", [[{"x": 0.0, "y": 0.0}, {"x": 10.0, "y": 0.0}, {"x": 10.0, "y": 10.0}, {"x": 0.0, "y": 10.0}], [{"x": 2.0, "y": 2.0}, {"x": 8.0, "y": 2.0}, {"x": 8.0, "y": 8.0}, {"x": 2.0, "y": 8.0}]])]
    df = spark.createDataFrame(rows, "k string, rings array<array<struct<x:double,y:double>>>")
    assert abs(land.covered_share(df.union(df), ["k"], "rings", (0.0, 0.0, 10.0, 10.0), long_side=100).first()["share"] - 0.64) < 0.02


def test_command_line(capsys):
    assert main(["queries"]) == 0 and "containment_cross_tab" in capsys.readouterr().out
    assert main(["categories"]) == 0 and datetime.date.today()
