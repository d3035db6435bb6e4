"""Long chains in a bounded number of jobs, sinks, and what a run leaves behind."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from sitewright import session
from sitewright.functions import categories as K
from sitewright.operators import curves, dedup, jobs, spatial
from sitewright.operators.graphs import components
from sitewright.sources import sinks


def tables_written(run):
    before = len(session._CUTS)
    out = run()
    return out, len(session._CUTS) - before


def plain_greedy(rows):
    seen_i, seen_j, out = set(), set(), []
    for i, j, s in sorted(rows, key=lambda r: (-r[2], r[0], r[1])):
        if i not in seen_i and j not in seen_j:
            seen_i.add(i)
            seen_j.add(j)
            out.append((i, j))
    return sorted(out)


@pytest.mark.parametrize("most", [500_000, 1])
def test_greedy_matches_of_a_terrace(spark, monkeypatch, most):
    monkeypatch.setattr(spatial, "COMPONENT_ROWS", most)
    n = 2_000 if most > 1 else 6
    rows = [(k // 2 + k % 2, k // 2, 0.9 - k / 10 / n) for k in range(n)] + [(10**6 + k, 10**6 + k % 5, 0.5) for k in range(20)]
    got, written = tables_written(lambda: [(r["i"], r["j"]) for r in spatial.greedy_matches(spark.createDataFrame(rows, "i long, j long, iou double")).collect()])
    assert sorted(got) == plain_greedy(rows)
    assert written < 40


def test_two_core_of_a_long_spike(spark):
    ring = [((0, 0), (1, 0)), ((1, 0), (1, 1)), ((0, 0), (1, 1))]
    spike = [((1, k), (1, k + 1)) for k in range(1, 2_000)] + [((1, 1_000), (5, 5)), ((5, 5), (6, 6))]
    rows = [({"x": float(a[0]), "y": float(a[1])}, {"x": float(b[0]), "y": float(b[1])}) for a, b in ring + spike]
    kind = "struct<x:double,y:double>"
    got, written = tables_written(lambda: curves.two_core(spark.createDataFrame(rows, f"a {kind}, b {kind}")).collect())
    assert {((r["a"]["x"], r["a"]["y"]), (r["b"]["x"], r["b"]["y"])) for r in got} == set(ring)
    assert written < 60


def test_fuse_of_a_chain(spark, monkeypatch):
    rows = [(k, float(k) * 4) for k in range(300)]  # each box holds the next one's middle point
    df = spark.createDataFrame(rows, "ord long, x double").selectExpr("ord", "x", "0.0D AS y")
    from sitewright.functions import geometry as G

    cands = df.select("ord", G.rectangle(F.col("x"), F.col("y"), F.col("x") + 10, F.col("y") + 10).alias("ring"))
    base = cands.where("ord < 0").select("ring")
    want = [k for k in range(300) if k % 2 == 0]
    for most in (500_000, 1):
        monkeypatch.setattr(spatial, "COMPONENT_ROWS", most)
        few = cands if most > 1 else cands.where("ord < 7")
        got, written = tables_written(lambda few=few: sorted(r["ord"] for r in spatial.fuse(base, few, 50.0).collect()))
        assert got == [k for k in want if most > 1 or k < 7]
        assert most == 1 or written < 40


def test_components_of_structs_and_loops(spark):
    rows = [((1, "a"), (2, "b")), ((2, "b"), (3, "c")), ((9, "z"), (9, "z"))]
    kind = "struct<n:int,s:string>"
    got = {tuple(r["id"]): tuple(r["component"]) for r in components(spark.createDataFrame(rows, f"a {kind}, b {kind}")).collect()}
    assert got == {(1, "a"): (1, "a"), (2, "b"): (1, "a"), (3, "c"): (1, "a"), (9, "z"): (9, "z")}


def test_running_sums_over_ranges(spark):
    df = spark.range(500).select((F.col("id") * 7 % 500).alias("k"), (F.col("id") % 3).alias("v"))
    rows = sorted((r["k"], r["v"], r["at"]) for r in dedup.running(df, F.col("v"), ["k"], "at", 16).collect())
    total = 0
    for _, v, at in rows:
        assert at == total
        total += v


def test_relation_ways(spark):
    members = "array<struct<type:string,ref:bigint,role:string>>"
    rows = [(1, [("way", 5, "inner"), ("way", 6, "outer"), ("node", 7, "outer")]), (2, [("way", 8, ""), ("way", 9, None), ("relation", 1, "")]), (3, [])]
    got = [(r["id"], r["pos"], r["way"]) for r in spatial.relation_ways(spark.createDataFrame(rows, f"id long, members {members}")).orderBy("id", "pos").collect()]
    assert got == [(1, 1, 6), (2, 0, 8), (2, 1, 9)]


def test_types_of_categories(spark):
    df = spark.createDataFrame([("water",), ("buildings",), ("track",), ("rail",)], "c string")
    got = df.select(F.flatten(F.collect_list(K.themed_types("c"))).alias("t")).select(K.in_type_order("t").alias("t")).first()["t"]
    assert got == ["building", "segment", "connector", "water"]


def test_ledger(spark):
    rows = [("a", "s", 0, False, "timeout"), ("a", "s", 1, True, None), ("b", "s", 0, False, "refused"), ("c", "s", 0, True, None), ("d", "s", 0, False, "timeout"), ("d", "s", 1, False, "timeout")]
    got = jobs.ledger(spark.createDataFrame(rows, "tile_id string, source string, try int, ok boolean, kind string")).first()
    assert tuple(got) == ("s", 3, 2, 1, 2)


def test_failure_lines_name_two_of_many(spark):
    rows = [(f"t{k}", "s", "down") for k in (3, 1, 2, 9)] + [("x", "s", "late"), ("y", "s", "late"), ("x", "s", "late")] + [(f"q{k}", "s", "odd") for k in range(3)]
    got = {r["reason"]: (r["tiles"], r["line"]) for r in jobs.failure_lines(spark.createDataFrame(rows, "tile_id string, source string, reason string")).collect()}
    assert got == {"down": (4, "s: down (t1, t2 and more)"), "late": (3, "s: late (x, y)"), "odd": (3, "s: odd (q0, q1, q2)")}


@pytest.mark.parametrize(("row", "start"), [
    ((0, None, None, 0.0, 0.0), "INCONCLUSIVE: no matched"), ((9, None, None, 0.1, 0.1), "INCONCLUSIVE: the least-squares"), ((9, 0.1, 0.1, 0.1, 0.1), "NOT DETECTED: least-squares offset magnitude 0.14 m"),
    ((9, 0.6, 0.6, 0.5, 0.5), "CONSISTENT with the epoch-shift hypothesis: least-squares offset 0.85 m at bearing 45"), ((9, -0.6, -0.6, 0.5, 0.5), "INCONCLUSIVE: least-squares offset 0.85 m at bearing 225"),
])
def test_epoch_verdict(spark, row, start):
    df = spark.createDataFrame([row], "count long, de double, dn double, sde double, sdn double")
    assert df.select(spatial.epoch_verdict("count", "de", "dn", "sde", "sdn").alias("v")).first()["v"].startswith(start)


def test_collections_of_all_shapes(spark, tmp_path):
    xy = "struct<x:double,y:double>"
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0)]
    rows = [(1, "p", None, None, 1.5, 2.5), (2, None, [(0.0, 0.0), (1.0, 1.0)], None, None, None), (3, "q", None, [square, [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0)]], None, None), (4, "none", None, None, None, None)]
    df = spark.createDataFrame(rows, f"id long, name string, line array<{xy}>, rings array<array<{xy}>>, x double, y double")
    assert sinks.write_collection(df, f"{tmp_path}/c", ["id", "name"], ["id"])
    text = "".join(p.read_text() for p in sorted((tmp_path / "c").glob("part-*")))
    found = json.loads(text)
    assert found["type"] == "FeatureCollection" and [f["properties"]["id"] for f in found["features"]] == [1, 2, 3]
    kinds = {f["properties"]["id"]: f["geometry"] for f in found["features"]}
    assert kinds[1] == {"type": "Point", "coordinates": [1.5, 2.5]} and kinds[2]["type"] == "LineString"
    assert kinds[3]["type"] == "Polygon" and len(kinds[3]["coordinates"]) == 2 and kinds[3]["coordinates"][0][0] == kinds[3]["coordinates"][0][-1]
    assert not sinks.write_collection(df.limit(0), f"{tmp_path}/none", ["id"], ["id"]) and not (tmp_path / "none").exists()
    assert sinks.write_collection(df.limit(0), f"{tmp_path}/empty", ["id"], ["id"], keep_empty=True)
    assert json.loads("".join(p.read_text() for p in sorted((tmp_path / "empty").glob("part-*"))))["features"] == []


def test_layers_and_sweep(spark, tmp_path):
    df = spark.createDataFrame([(1, "water", 1.0, 2.0), (2, "rail", 1.0, 2.0)], "id long, kind string, x double, y double")
    names = {n: F.col("kind") == n for n in ("water", "rail", "woodland")}
    assert sinks.write_layers(df, str(tmp_path), names, ["id"]) == ["water", "rail"]
    (tmp_path / "woodland").mkdir()
    (tmp_path / "mine").mkdir()
    assert sinks.sweep(spark, str(tmp_path), list(names), ["water", "rail"], False) == []
    assert sinks.sweep(spark, str(tmp_path), list(names), ["water", "rail"], True) == ["woodland"]
    assert (tmp_path / "mine").exists() and (tmp_path / "water").exists() and not (tmp_path / "woodland").exists()


def test_cuts_are_deleted(spark):
    with session.passing(spark) as kept:
        gone, stays = session.cut(spark.range(3), "gone"), session.cut(spark.range(4), "stays")
        kept.append(session.path_of(stays))
    assert stays.count() == 4 and session.path_of(stays) in session._CUTS
    with pytest.raises(Exception, match="(?i)not exist|not found|FILE"):
        gone.count()
