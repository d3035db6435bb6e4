"""Tiling of extents, and splitting of tiles that hold too much."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewright.functions import geometry as G

#: Tiles of one extent at most; more is an error.
MOST = 10_000


def build(extents: DataFrame, size: float, overlap: float, most: int = MOST) -> DataFrame:
    """Extents (..., box) with tile_id, row, col, core and query boxes in degrees.

    Cores meet edge to edge from the south-west corner; a query box overlaps its
    neighbours, within the extent.
    """
    ref = (F.col("box.y0") + F.col("box.y1")) / 2
    m = extents.withColumns({"__low": G.to_local("box.x0", "box.y0", ref), "__high": G.to_local("box.x1", "box.y1", ref)})
    n = lambda axis: F.ceil((F.col(f"__high.{axis}") - F.col(f"__low.{axis}")) / size).cast("int")
    fits = F.when(n("x").cast("long") * n("y") <= most, n("y")).otherwise(F.raise_error(F.lit("too many tiles for this extent")).cast("int"))
    t = m.withColumn("row", F.explode(F.sequence(F.lit(0), fits - 1))).withColumn("col", F.explode(F.sequence(F.lit(0), n("x") - 1)))

    def box(pad: float) -> Column:
        edge = lambda axis, index, by: F.greatest(F.col(f"__low.{axis}"), F.least(F.col(f"__high.{axis}"), F.col(f"__low.{axis}") + F.col(index) * size + by))
        low, high = G.from_local(edge("x", "col", -pad), edge("y", "row", -pad), ref), G.from_local(edge("x", "col", size + pad), edge("y", "row", size + pad), ref)
        return F.struct(low["x"].alias("x0"), low["y"].alias("y0"), high["x"].alias("x1"), high["y"].alias("y1"))

    return t.withColumns({"tile_id": F.format_string("r%02d_c%02d", "row", "col"), "core": box(0.0), "query": box(overlap)}).drop("__low", "__high")


def quarters(tiles: DataFrame) -> DataFrame:
    """Each tile as four: half the core each way, and the overlap that it had on the new sides too."""
    c, q = "core", "query"
    mx, my = (F.col("core.x0") + F.col("core.x1")) / 2, (F.col("core.y0") + F.col("core.y1")) / 2
    ox = F.greatest(F.col("core.x0") - F.col("query.x0"), F.col("query.x1") - F.col("core.x1"), F.lit(0.0))
    oy = F.greatest(F.col("core.y0") - F.col("query.y0"), F.col("query.y1") - F.col("core.y1"), F.lit(0.0))

    def quarter(r: int, k: int) -> Column:
        f = lambda b, s: F.col(f"{b}.{s}")
        core = F.struct((mx if k else f(c, "x0")).alias("x0"), (my if r else f(c, "y0")).alias("y0"), (f(c, "x1") if k else mx).alias("x1"), (f(c, "y1") if r else my).alias("y1"))
        query = F.struct(
            (F.greatest(f(q, "x0"), mx - ox) if k else f(q, "x0")).alias("x0"), (F.greatest(f(q, "y0"), my - oy) if r else f(q, "y0")).alias("y0"),
            (f(q, "x1") if k else F.least(f(q, "x1"), mx + ox)).alias("x1"), (f(q, "y1") if r else F.least(f(q, "y1"), my + oy)).alias("y1"),
        )
        return F.struct(F.concat("tile_id", F.lit(f"_q{r}{k}")).alias("tile_id"), (F.col("row") * 2 + r).alias("row"), (F.col("col") * 2 + k).alias("col"), core.alias("core"), query.alias("query"))

    return tiles.select(F.explode(F.array(*[quarter(r, k) for r in (0, 1) for k in (0, 1)])).alias("t")).select("t.*")
