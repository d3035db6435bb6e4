"""Rasters as pixel frames (raster_id, col, row, z): absent pixels have no row; north is row 0."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewright.functions import geometry as G
from sitewright.operators.graphs import components

#: Lower bounds that make a height: samples, and metres.
MIN_SAMPLES = 3
MIN_HEIGHT = 2.0


def sample(points: DataFrame, pixels: DataFrame, key: Sequence[str], size: float, origin: tuple[float, float], value: str | Sequence[str] = "z") -> DataFrame:
    """(key, values): bilinear values at each point (key, x, y) from the pixel centres around it.

    A point goes to the four cells that can count; absent ones get no weight and
    the others' weights are scaled up, so a point without any has no row, and one
    without any of a value has null there. One equi-join and one partial
    aggregate for all values, whatever the raster's size.
    """
    values = [value] if isinstance(value, str) else list(value)
    e0, n_top = origin
    fx, fy = (F.col("x") - e0) / size - 0.5, (n_top - F.col("y")) / size - 0.5
    c0, r0 = F.floor(fx), F.floor(fy)
    tx, ty = fx - c0, fy - r0
    corner = lambda i, j: F.struct((c0 + i).alias("col"), (r0 + j).alias("row"), ((tx if i else 1 - tx) * (ty if j else 1 - ty)).alias("w"))
    four = points.select(*key, F.explode(F.array(*[corner(i, j) for i in (0, 1) for j in (0, 1)])).alias("k")).select(*key, "k.*").where("w > 0")
    weighed = lambda v: (F.sum(F.col(v) * F.col("w")) / F.sum(F.when(F.col(v).isNotNull(), F.col("w")))).alias(v)
    return four.join(pixels.select("col", "row", *values), ["col", "row"]).groupBy(*key).agg(*[weighed(v) for v in values])


def coalesced(points: DataFrame, layers: Sequence[DataFrame], key: Sequence[str], value: str = "z") -> DataFrame:
    """Each point with the first layer's value that has one, and which it was."""
    out = points
    for i, layer in enumerate(layers):
        out = out.join(layer.select(*key, F.col(value).alias(f"__{i}")), list(key), "left")
    names = [f"__{i}" for i in range(len(layers))]
    used = F.lit(None).cast("int")
    for i in range(len(layers) - 1, -1, -1):
        used = F.when(F.col(names[i]).isNotNull(), F.lit(i)).otherwise(used)
    return out.withColumns({value: F.coalesce(*names), "layer": used}).drop(*names)


def footprint_points(footprints: DataFrame, step: float = 1.0) -> DataFrame:
    """(fid, x, y) of the grid from each footprint's low corner that lies inside it."""
    points = footprints.select("fid", "ring", F.explode(G.grid(G.bbox("ring"), step)).alias("p")).select("fid", "ring", "p.x", "p.y")
    return points.where(G.in_ring("x", "y", "ring")).drop("ring")


def heights(samples: DataFrame, key: str = "fid") -> DataFrame:
    """(key, height) from samples (key, dtm, dsm): the surface's 90th percentile over the ground's median, to a decimetre."""
    rise = F.percentile("dsm", F.lit(0.9)) - F.percentile("dtm", F.lit(0.5))
    h = F.bround(F.round(rise, 6), 1)  # sums of samples come in any order; micrometres decide no tie
    return samples.groupBy(key).agg(F.count("*").alias("n"), h.alias("height")).where((F.col("n") >= MIN_SAMPLES) & (F.col("height") >= MIN_HEIGHT)).select(key, "height")


def canopy_pixels(pixels: DataFrame, footprints: DataFrame, size: float, origin: tuple[float, float], least: float = 3.0) -> DataFrame:
    """Pixels (col, row, dtm, dsm) at least so high above ground, without those whose centre is in a footprint (ring)."""
    from sitewright.operators.spatial import points_in_rings

    high = pixels.select("col", "row", (F.col("dsm") - F.col("dtm")).alias("height")).where(F.col("height") >= least)
    centres = high.select("col", "row", (origin[0] + (F.col("col") + 0.5) * size).alias("x"), (origin[1] - (F.col("row") + 0.5) * size).alias("y"))
    masked = points_in_rings(centres, footprints.select("ring"), "x", "y", "ring", 50.0).select("col", "row").distinct()
    return high.join(masked, ["col", "row"], "left_anti")


def clusters(pixels: DataFrame, width: int) -> DataFrame:
    """Each pixel (col, row, ...) with ``cluster``: the smallest index of those it touches by sides, again and again."""
    p = pixels.withColumn("index", F.col("row") * width + F.col("col"))
    right = p.select(F.col("index").alias("a"), F.explode(F.array(F.struct((F.col("col") + 1).alias("col"), "row"), F.struct("col", (F.col("row") + 1).alias("row")))).alias("to"))
    links = right.select("a", "to.col", "to.row").join(p.select("col", "row", F.col("index").alias("b")), ["col", "row"]).select("a", "b")
    comp = components(links, "a", "b")
    return p.join(comp.withColumnRenamed("id", "index"), "index", "left").withColumn("cluster", F.coalesce("component", "index")).drop("component", "index")


def canopy(pixels: DataFrame, width: int, size: float, origin: tuple[float, float], least_pixels: int = 2, least_area: float = 8.0) -> DataFrame:
    """(cluster, pixels, height, crown_radius, x, y) of the clusters that are large enough."""
    x, y = origin[0] + (F.avg("col") + 0.5) * size, (origin[1] - 0.5 * size) - F.avg("row") * size
    g = clusters(pixels, width).groupBy("cluster").agg(F.count("*").alias("pixels"), F.sort_array(F.collect_list("height")).alias("heights"), x.alias("x"), y.alias("y"))
    area = F.col("pixels") * size * size
    large = g.where((F.col("pixels") >= least_pixels) & (area >= least_area))
    return large.select("cluster", "pixels", decimetres(interpolated("heights", 0.9)).alias("height"), decimetres(F.sqrt(area / F.pi())).alias("crown_radius"), "x", "y")


def interpolated(values: str, share: float) -> Column:
    """A quantile of a sorted array between its two neighbours, bit for bit as ``quantile_cont`` has it.

    The sum of the two weighed neighbours is a fused multiply-add there; rounded
    twice instead, it may fall on the other side of a tie.
    """
    at = (F.size(values) - 1) * F.lit(share)
    below, above = F.get(values, F.floor(at).cast("int")), F.get(values, F.ceil(at).cast("int"))
    part = at - F.floor(at)
    between = F.reflect(F.lit("java.lang.Math"), F.lit("fma"), below, 1 - part, above * part).cast("double")
    return F.when(above.isNotNull() & (part > 0), between).otherwise(below)


def decimetres(value: Column) -> Column:
    """To one decimal, halves of the product to even, as ``round_even`` has it; ``bround`` takes the shortest decimal text for the value."""
    return F.rint(value * 10) / 10


def intervals(area: Column) -> Column:
    """Contour intervals that an area in square metres is granted."""
    five = F.array(F.lit(5.0))
    return F.when(area <= 1.5e6, F.array(*[F.lit(v) for v in (5.0, 1.0, 0.5, 0.25)])).when(area <= 6e6, F.array(F.lit(5.0), F.lit(1.0))).otherwise(five)


def decimation(size: float, interval: float) -> int:
    """Every so many pixels are used: the 5 m interval needs one in 4 m."""
    return max(1, int(4.0 // size)) if interval == 5.0 else 1


def contour_segments(pixels: DataFrame, interval: float, size: float, origin: tuple[float, float]) -> DataFrame:
    """(col, row, level, a, b): marching squares over every two by two pixels that all have a value.

    The four neighbours meet by three shifted equi-joins. A level counts where the
    least corner reaches it and the greatest exceeds it; a corner is above only if
    greater; a saddle is decided by the mean.
    """
    s = decimation(size, interval)
    p = pixels.where((F.col("col") % s == 0) & (F.col("row") % s == 0)).select((F.col("col") / s).cast("long").alias("c"), (F.col("row") / s).cast("long").alias("r"), F.col("z").cast("double"))
    shifted = lambda i, j, name: p.select((F.col("c") - i).alias("c"), (F.col("r") - j).alias("r"), F.col("z").alias(name))
    q = shifted(0, 0, "tl").join(shifted(1, 0, "tr"), ["c", "r"]).join(shifted(0, 1, "bl"), ["c", "r"]).join(shifted(1, 1, "br"), ["c", "r"])
    low, high = F.least("tl", "tr", "bl", "br"), F.greatest("tl", "tr", "bl", "br")
    levels = F.transform(F.sequence(F.floor(low / interval), F.ceil(high / interval)), lambda k: k * interval)
    q = q.withColumn("level", F.explode(F.filter(levels, lambda v: (v >= low) & (v < high))))
    x = lambda i: origin[0] + ((F.col("c") + i) * s + 0.5) * size
    y = lambda j: origin[1] - ((F.col("r") + j) * s + 0.5) * size
    up = {k: F.col(k) > F.col("level") for k in ("tl", "tr", "br", "bl")}
    part = lambda a, b: (F.col("level") - F.col(a)) / F.nullif(F.col(b) - F.col(a), F.lit(0.0))
    on = {
        "n": (up["tl"] != up["tr"], G.point(x(0) + part("tl", "tr") * (x(1) - x(0)), y(0))), "e": (up["tr"] != up["br"], G.point(x(1), y(0) + part("tr", "br") * (y(1) - y(0)))),
        "s": (up["br"] != up["bl"], G.point(x(1) + part("br", "bl") * (x(0) - x(1)), y(1))), "w": (up["bl"] != up["tl"], G.point(x(0), y(1) + part("bl", "tl") * (y(0) - y(1)))),
    }
    q = q.withColumns({k: F.when(test, at) for k, (test, at) in on.items()})
    pair = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
    mean_up = (F.col("tl") + F.col("tr") + F.col("bl") + F.col("br")) / 4 > F.col("level")
    four = F.col("n").isNotNull() & F.col("e").isNotNull() & F.col("s").isNotNull() & F.col("w").isNotNull()
    plain = F.filter(F.array("n", "e", "s", "w"), lambda v: v.isNotNull())
    found = F.when(four & (mean_up == up["tl"]), F.array(pair("n", "e"), pair("s", "w"))).when(four, F.array(pair("n", "w"), pair("e", "s")))
    found = found.otherwise(F.array(F.struct(F.get(plain, F.lit(0)).alias("a"), F.get(plain, F.lit(1)).alias("b"))))
    out = q.select((F.col("c") * s).alias("col"), (F.col("r") * s).alias("row"), "level", F.posexplode(found).alias("part", "seg")).select("col", "row", "level", "part", "seg.a", "seg.b")
    rounded = lambda p: F.struct(F.bround(p["x"], 6), F.bround(p["y"], 6))
    return out.where(rounded(F.col("a")) != rounded(F.col("b")))


def mesh_faces(pixels: DataFrame, step: int = 1) -> DataFrame:
    """Quads (v0, v1, v2, v3) of every ``step``-th pixel's neighbours, by dense vertex numbers in row order."""
    from pyspark.sql import Window

    p = pixels.where((F.col("col") % step == 0) & (F.col("row") % step == 0)).select((F.col("col") / step).cast("long").alias("c"), (F.col("row") / step).cast("long").alias("r"))
    rows = p.groupBy("r").count()
    before = rows.select("r", F.coalesce(F.sum("count").over(Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))  # a row for each row of pixels
    ids = p.join(F.broadcast(before), "r").select("c", "r", (F.col("start") + F.row_number().over(Window.partitionBy("r").orderBy("c")) - 1).alias("v"))
    shifted = lambda i, j, name: ids.select((F.col("c") - i).alias("c"), (F.col("r") - j).alias("r"), F.col("v").alias(name))
    return shifted(0, 0, "v0").join(shifted(1, 0, "v1"), ["c", "r"]).join(shifted(1, 1, "v2"), ["c", "r"]).join(shifted(0, 1, "v3"), ["c", "r"]).select("v0", "v1", "v2", "v3")


def grid_side(length: Column, low: Column, high: Column, least: int = 8, most: int = 4000) -> Column:
    """struct<n, size>: cells of a side of an elevation grid, near the geometric mean of a tier's cell sizes."""
    clamp = lambda n: F.greatest(F.lit(least), F.least(F.lit(most), F.greatest(F.lit(1), n))).cast("int")
    first = clamp(F.rint(length / F.sqrt(low * high)))
    n = F.when(length / first < low, clamp(F.floor(length / low))).when(length / first > high, clamp(F.ceil(length / high))).otherwise(first)
    return G.let(n, lambda v: F.struct(v.alias("n"), (length / v).alias("size")))


def grid_tier(longest: Column) -> Column:
    """struct<low, high>: cell sizes of an elevation grid by its longer side, in metres."""
    tier = lambda a, b: F.struct(F.lit(a).alias("low"), F.lit(b).alias("high"))
    return F.when(longest <= 2_000, tier(5.0, 15.0)).when(longest <= 10_000, tier(15.0, 50.0)).otherwise(tier(50.0, 200.0))


def elevation_grid(width: Column, height: Column) -> Column:
    """struct<nx, ny, dx, dy> of nodes and spacing; square cells where the other side's tier allows them."""

    def of(t: Column) -> Column:
        xs, ys = grid_side(width, t["low"], t["high"]), grid_side(height, t["low"], t["high"])
        n = F.greatest(F.lit(8), F.least(F.lit(4000), F.rint(height / xs["size"]).cast("int")))
        square = (height / n).between(t["low"], t["high"])
        ny, dy = F.when(square, n).otherwise(ys["n"]), F.when(square, height / n).otherwise(ys["size"])
        return F.struct((xs["n"] + 1).alias("nx"), (ny + 1).alias("ny"), xs["size"].alias("dx"), dy.alias("dy"))

    return G.let(grid_tier(F.greatest(width, height)), of)


def mosaic(members: DataFrame, size: float, window: tuple[float, float, float, float]) -> DataFrame:
    """(col, row, z) of a window from members' pixels (ord, e, n, z) at their centres; the last member wins a pixel.

    Members share one lattice, so centres name pixels and nothing is resampled.
    """
    e0, n0, e1, n1 = window
    inside = members.where((F.col("e") > e0) & (F.col("e") < e1) & (F.col("n") > n0) & (F.col("n") < n1))
    px = inside.withColumns({"col": F.floor((F.col("e") - e0) / size), "row": F.floor((F.lit(n1) - F.col("n")) / size)})
    return px.groupBy("col", "row").agg(F.max_by("z", "ord").alias("z"))


def grid_nodes(nx: int, ny: int, x0: float, y0: float, dx: float, dy: float) -> Column:
    """array<struct<ix, iy, x, y>> of an elevation grid's nodes, by rows from the south."""
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(ny - 1)), lambda j: F.transform(F.sequence(F.lit(0), F.lit(nx - 1)), lambda i: F.struct(i.alias("ix"), j.alias("iy"), (x0 + i * dx).alias("x"), (y0 + j * dy).alias("y")))))


def cover(box: tuple[float, float, float, float], tiles: DataFrame, size: float = 500.0) -> DataFrame:
    """One row: full, partial or none, as tiles (cx, cy) hold the lattice cells that a rectangle touches."""
    rect = F.struct(*[F.lit(float(v)).alias(n) for v, n in zip(box, ("x0", "y0", "x1", "y1"))])
    touched = tiles.sparkSession.range(1).select(F.explode(G.cells(rect, size)).alias("c")).select("c.cx", "c.cy")
    held = touched.join(tiles.select("cx", "cy", F.lit(True).alias("held")), ["cx", "cy"], "left")
    share = F.count("held") / F.count("*")
    return held.agg(F.when(share == 1, "full").when(share > 0, "partial").otherwise("none").alias("cover"))
