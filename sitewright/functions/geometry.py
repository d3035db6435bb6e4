"""Planar geometry as Column expressions over rings ``array<struct<x double, y double>>``.

Everything stays in the JVM: rings are folded with higher-order functions, so a
filter on them is pushed next to the scan and no Python worker is started.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metres to a degree of latitude on the plane that parcels and constraints use.
METRES_PER_DEGREE = 111_320.0
#: Radius of the sphere that tiling uses; results depend on which of the two is taken where.
EARTH_RADIUS = 6_378_137.0

C = str | Column


def _c(value: C | float) -> Column:
    return F.col(value) if isinstance(value, str) else value if isinstance(value, Column) else F.lit(float(value))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is written once into the plan, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def rectangle(e0: C, n0: C, e1: C, n1: C) -> Column:
    """The open ring of a rectangle, counter-clockwise from its low corner."""
    a, b, c, d = map(_c, (e0, n0, e1, n1))
    return F.array(point(a, b), point(c, b), point(c, d), point(a, d))


def open_ring(ring: C) -> Column:
    """Without a repeated first vertex at the end."""
    return let(_c(ring), lambda r: F.when((F.size(r) > 1) & (F.get(r, F.lit(0)) == F.element_at(r, -1)), F.slice(r, F.lit(1), F.size(r) - 1)).otherwise(r))


def closed_ring(ring: C) -> Column:
    return let(open_ring(ring), lambda r: F.when(F.size(r) > 0, F.concat(r, F.slice(r, 1, 1))).otherwise(r))


def rotated(array: Column) -> Column:
    """Every element's successor, the last one's being the first."""
    return F.concat(F.slice(array, F.lit(2), F.size(array)), F.slice(array, 1, 1))


def edges(ring: C) -> Column:
    """array<struct<a, b>> of the edges of an open ring, the closing one too."""
    return let(_c(ring), lambda r: F.zip_with(r, rotated(r), lambda a, b: F.struct(a.alias("a"), b.alias("b"))))


def _sum(array: Column, of: Callable[[Column], Column]) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda s, e: s + of(e))


def ring_area(ring: C) -> Column:
    """Shoelace area of an open or closed ring; 0 for fewer than three vertices."""
    twice = lambda r: _sum(edges(r), lambda e: e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])
    return let(open_ring(ring), lambda r: F.when(F.size(r) < 3, F.lit(0.0)).otherwise(F.abs(twice(r)) / 2))


def bbox(ring: C) -> Column:
    """struct<x0, y0, x1, y1>."""

    def of(r: Column) -> Column:
        xs, ys = F.transform(r, lambda p: p["x"]), F.transform(r, lambda p: p["y"])
        return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))

    return let(_c(ring), of)


def overlap_closed(a: Column, b: Column) -> Column:
    """Boxes that meet, touching ones too."""
    return (a["x0"] <= b["x1"]) & (a["x1"] >= b["x0"]) & (a["y0"] <= b["y1"]) & (a["y1"] >= b["y0"])


def overlap_open(a: Column, b: Column) -> Column:
    """Boxes that share more than an edge."""
    return (a["x0"] < b["x1"]) & (a["x1"] > b["x0"]) & (a["y0"] < b["y1"]) & (a["y1"] > b["y0"])


def in_rect(x: C, y: C, rect: Column) -> Column:
    """Inside or on the edge."""
    return _c(x).between(rect["x0"], rect["x1"]) & _c(y).between(rect["y0"], rect["y1"])


def in_ring(x: C, y: C, ring: C) -> Column:
    """Even-odd rule with half-open edges: low edges are inside, high edges outside."""
    px, py = _c(x), _c(y)

    def crossed(e: Column) -> Column:
        a, b = e["a"], e["b"]
        spans = (a["y"] > py) != (b["y"] > py)
        at = (a["x"] - b["x"]) * (py - b["y"]) / F.nullif(a["y"] - b["y"], F.lit(0.0)) + b["x"]
        return F.when(spans & (px < at), 1).otherwise(0)

    return F.aggregate(edges(ring), F.lit(0), lambda n, e: n + crossed(e)) % 2 == 1


def _half_plane(ring: Column, axis: str, limit: Column, low: bool) -> Column:
    """Keep what lies on one side of a line parallel to an axis: each edge gives its kept vertices."""
    other = "y" if axis == "x" else "x"
    keeps = (lambda p: p[axis] >= limit) if low else (lambda p: p[axis] <= limit)

    def cut(a: Column, b: Column) -> Column:
        t = (limit - a[axis]) / F.nullif(b[axis] - a[axis], F.lit(0.0))
        at = a[other] + t * (b[other] - a[other])
        return point(limit, at) if axis == "x" else point(at, limit)

    def kept(e: Column) -> Column:
        a, b = e["a"], e["b"]
        none = F.array().cast("array<struct<x:double,y:double>>")
        return (
            F.when(keeps(b) & keeps(a), F.array(b)).when(keeps(b), F.array(cut(a, b), b))
            .when(keeps(a), F.array(cut(a, b))).otherwise(none)
        )

    return F.flatten(F.transform(edges(ring), kept))


def clip(ring: C, rect: Column) -> Column:
    """The ring within a rectangle (four half-plane cuts); empty below three vertices."""
    none = F.array().cast("array<struct<x:double,y:double>>")

    def cut(box: Column) -> Column:
        r = open_ring(ring)
        for axis, side, low in (("x", "x0", True), ("x", "x1", False), ("y", "y0", True), ("y", "y1", False)):
            r = _half_plane(r, axis, box[side], low)
        return let(r, lambda out: F.when(F.size(out) >= 3, out).otherwise(none))

    return let(rect, cut)


def clip_polygon(rings: C, rect: Column) -> Column:
    """Clipped rings of a polygon, the first being its outline; empty if that is gone."""
    def whole(cut: Column) -> Column:
        some = F.filter(cut, lambda r: F.size(r) > 0)
        return F.when(F.size(F.get(cut, F.lit(0))) > 0, some).otherwise(F.slice(some, 1, 0))

    return let(rect, lambda box: let(F.transform(_c(rings), lambda r: clip(r, box)), whole))


def area_in_rect(rings: C, rect: Column) -> Column:
    """Area of a polygon with holes within a rectangle."""
    areas = let(rect, lambda box: F.transform(_c(rings), lambda r: ring_area(clip(r, box))))
    # the outline counts once and its holes against it
    return let(areas, lambda a: F.coalesce(F.greatest(2 * F.get(a, F.lit(0)) - _sum(a, lambda v: v), F.lit(0.0)), F.lit(0.0)))


def representative_point(ring: C) -> Column:
    """A point inside: the middle of the widest span on a line between two neighbouring heights of vertices.

    The two heights are the lowest neighbouring pair that holds the middle of the
    ring's range; of equally wide spans the leftmost counts.
    """

    def level_of(r: Column) -> Column:
        def between(ys: Column) -> Column:
            middle = (F.get(ys, F.lit(0)) + F.element_at(ys, -1)) / 2
            gaps = F.zip_with(F.slice(ys, F.lit(1), F.size(ys) - 1), F.slice(ys, F.lit(2), F.size(ys)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
            return F.get(F.transform(F.filter(gaps, lambda g: (g["a"] <= middle) & (middle <= g["b"])), lambda g: (g["a"] + g["b"]) / 2), F.lit(0))

        return let(F.array_sort(F.array_distinct(F.transform(r, lambda p: p["y"]))), lambda ys: F.when(F.size(ys) < 2, F.get(ys, F.lit(0))).otherwise(between(ys)))

    def on_level(r: Column, level: Column) -> Column:
        spanning = F.filter(edges(r), lambda e: (e["a"]["y"] > level) != (e["b"]["y"] > level))
        crossings = F.array_sort(F.transform(spanning, lambda e: e["a"]["x"] + (level - e["a"]["y"]) * (e["b"]["x"] - e["a"]["x"]) / F.nullif(e["b"]["y"] - e["a"]["y"], F.lit(0.0))))

        def widest(xs: Column) -> Column:
            pairs = F.transform(F.sequence(F.lit(0), F.size(xs) - 2, F.lit(2)), lambda i: F.struct((F.get(xs, i + 1) - F.get(xs, i)).alias("width"), (-F.get(xs, i)).alias("left"), ((F.get(xs, i) + F.get(xs, i + 1)) / 2).alias("at")))
            return F.when(F.size(xs) >= 2, F.array_max(pairs)["at"])

        box = let(bbox(r), lambda b: (b["x0"] + b["x1"]) / 2)
        return point(F.coalesce(let(crossings, widest), box), level)

    return let(open_ring(ring), lambda r: let(level_of(r), lambda y: on_level(r, y)))


def ring_key(ring: C) -> Column:
    """The least of all rotations of an open ring and of its reverse: the same for any start and winding."""

    def turned(a: Column, least: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(a)), lambda i: F.get(a, i - 1) == least)
        return F.transform(starts, lambda i: F.concat(F.slice(a, i, F.size(a)), F.slice(a, F.lit(1), i - 1)))

    best = lambda r: let(F.array_min(r), lambda least: F.array_min(F.concat(turned(r, least), let(F.reverse(r), lambda back: turned(back, least)))))
    return let(open_ring(ring), lambda r: F.when(F.size(r) > 0, best(r)))


def valid_ring(points: C) -> Column:
    """The open ring if at least three of its vertices differ, else null."""
    return let(open_ring(points), lambda r: F.when(F.size(F.array_distinct(r)) >= 3, r))


def cells(box: Column, size: float | Column) -> Column:
    """array<struct<cx, cy>> of the hash cells that a box touches."""

    def of(b: Column) -> Column:
        xs, ys = (F.sequence(F.floor(b[low] / size), F.floor(b[high] / size)) for low, high in (("x0", "x1"), ("y0", "y1")))
        return F.flatten(F.transform(ys, lambda y: F.transform(xs, lambda x: F.struct(x.alias("cx"), y.alias("cy")))))

    return let(box, of)


def cell_span(box: Column, size: float) -> Column:
    """How many cells a box touches, without listing them."""
    return (F.floor(box["x1"] / size) - F.floor(box["x0"] / size) + 1) * (F.floor(box["y1"] / size) - F.floor(box["y0"] / size) + 1)


def grid(box: Column, step: C | float) -> Column:
    """array<point> from the low corner by rows; the last one may fall short of the high corner."""

    def of(b: Column, s: Column) -> Column:
        xs, ys = (F.sequence(F.lit(0), F.floor((b[high] - b[low]) / s).cast("int")) for low, high in (("x0", "x1"), ("y0", "y1")))
        return F.flatten(F.transform(ys, lambda j: F.transform(xs, lambda i: point(b["x0"] + i * s, b["y0"] + j * s))))

    return let(box, lambda b: let(_c(step), lambda s: of(b, s)))


def widened_step(box: Column, step: float, cap: int) -> Column:
    """The step of a grid of at most ``cap`` points: by area first, then by factors of the square root of two."""

    def of(b: Column) -> Column:
        w, h = F.greatest(b["x1"] - b["x0"], F.lit(0.0)), F.greatest(b["y1"] - b["y0"], F.lit(0.0))
        count = lambda s: (F.floor(w / s) + 1) * (F.floor(h / s) + 1)
        wide = let(F.greatest(F.lit(step), F.sqrt(w * h / cap)), lambda s0: F.aggregate(F.sequence(F.lit(0), F.lit(60)), s0, lambda s, _: F.when(count(s) > cap, s * F.lit(2.0**0.5)).otherwise(s)))
        return F.when(count(F.lit(step)) <= cap, F.lit(step)).otherwise(wide)

    return let(box, of)


def nearest_on_segment(x: C, y: C, ax: C, ay: C, bx: C, by: C) -> Column:
    """struct<x, y, t, distance> of the nearest point of a segment; t is 0 on one without length."""
    px, py, x0, y0, x1, y1 = map(_c, (x, y, ax, ay, bx, by))
    dx, dy = x1 - x0, y1 - y0
    length2 = F.nullif(dx * dx + dy * dy, F.lit(0.0))
    share = ((px - x0) * dx + (py - y0) * dy) / length2
    t_of = F.coalesce(F.when(length2.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))), F.lit(0.0))

    def at(t: Column) -> Column:
        qx, qy = x0 + t * dx, y0 + t * dy
        return F.struct(qx.alias("x"), qy.alias("y"), t.alias("t"), F.hypot(qx - px, qy - py).alias("distance"))

    return let(t_of, at)


def line_distance(p: Column, a: Column, b: Column) -> Column:
    """Distance of a point from the line through two others, or from the one point where they are equal."""
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    length = F.hypot(dx, dy)
    return F.coalesce(F.abs(dx * (a["y"] - p["y"]) - (a["x"] - p["x"]) * dy) / F.nullif(length, F.lit(0.0)), F.hypot(p["x"] - a["x"], p["y"] - a["y"]))


def drop_collinear(line: C, tolerance: float = 0.05) -> Column:
    """Drop vertices that lie on the line from the last kept one to the next; both ends stay."""
    r = _c(line)
    inner = F.sequence(F.lit(1), F.size(r) - 2)
    kept = F.aggregate(
        inner, F.slice(r, 1, 1),
        lambda k, i: F.when(line_distance(F.get(r, i), F.element_at(k, -1), F.get(r, i + 1)) > tolerance, F.concat(k, F.array(F.get(r, i)))).otherwise(k),
    )
    return F.when(F.size(r) < 3, r).otherwise(F.concat(kept, F.slice(r, -1, 1)))


def bearing(east: C, north: C) -> Column:
    """Degrees clockwise from north."""
    return F.pmod(F.degrees(F.atan2(_c(east), _c(north))), F.lit(360.0))


def angle_between(a: C, b: C) -> Column:
    d = F.pmod(F.abs(_c(a) - _c(b)), F.lit(360.0))
    return F.least(d, 360.0 - d)


def padded(rect: Column, metres: C | float) -> Column:
    """A rectangle in degrees, wider by metres on all sides."""
    m = _c(metres)
    lat = m / METRES_PER_DEGREE
    lon = m / (METRES_PER_DEGREE * F.cos(F.radians((rect["y0"] + rect["y1"]) / 2)))
    return F.struct((rect["x0"] - lon).alias("x0"), (rect["y0"] - lat).alias("y0"), (rect["x1"] + lon).alias("x1"), (rect["y1"] + lat).alias("y1"))


def to_local(lon: C, lat: C, ref: C) -> Column:
    """Metres on the sphere's equirectangular plane."""
    return point(F.radians(_c(lon)) * EARTH_RADIUS * F.cos(F.radians(_c(ref))), F.radians(_c(lat)) * EARTH_RADIUS)


def from_local(x: C, y: C, ref: C) -> Column:
    return point(F.degrees(_c(x) / (EARTH_RADIUS * F.cos(F.radians(_c(ref))))), F.degrees(_c(y) / EARTH_RADIUS))


def extent_metres(box: Column) -> Column:
    """Width and height of a box in degrees, in metres, as a point."""
    ref = (box["y0"] + box["y1"]) / 2
    low, high = to_local(box["x0"], box["y0"], ref), to_local(box["x1"], box["y1"], ref)
    return point(high["x"] - low["x"], high["y"] - low["y"])


def local_area(ring: C, lat0: C | float) -> Column:
    """Square metres of a ring in degrees on the plane of METRES_PER_DEGREE."""
    return ring_area(ring) * METRES_PER_DEGREE * METRES_PER_DEGREE * F.cos(F.radians(_c(lat0)))


def parse_pos_list(text: C) -> Column:
    """array<point> of a list of numbers in pairs; an error where it is blank or odd."""
    parts = F.filter(F.split(_c(text), r"\s+"), lambda s: s != "")
    n = F.size(parts)
    good = (n > 0) & (n % 2 == 0)
    pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), (n / 2).cast("int") - 1)), lambda i: point(F.get(parts, 2 * i), F.get(parts, 2 * i + 1)))
    return F.when(good, pairs).otherwise(F.raise_error(F.lit("a position list needs coordinates in pairs")).cast("array<struct<x:double,y:double>>"))


def interior_samples(ring: C, cap: int = 40_000) -> Column:
    """Points by which a parcel in degrees is classified.

    A grid from the box's low corner, spaced an eighth of the square root of the
    area (2 to 20 m) or wider where the box would hold more than ``cap`` points;
    where fewer than four of it are inside, the representative point and those
    middles of the box's sides that are inside.
    """

    def spacing(r: Column, b: Column, lat: Column, per_lon: Column) -> Column:
        own = F.greatest(F.lit(2.0), F.least(F.lit(20.0), F.sqrt(local_area(r, lat)) / 8))
        return F.greatest(own, F.sqrt((b["x1"] - b["x0"]) * per_lon * (b["y1"] - b["y0"]) * METRES_PER_DEGREE / cap))

    def of(r: Column, b: Column) -> Column:
        lat = (b["y0"] + b["y1"]) / 2
        per_lon = METRES_PER_DEGREE * F.cos(F.radians(lat))
        step = lambda s: F.struct((s / per_lon).alias("x"), (s / METRES_PER_DEGREE).alias("y"))

        def inner(d: Column) -> Column:
            columns, rows = (F.sequence(F.lit(0), F.floor((b[high] - b[low]) / v).cast("int")) for low, high, v in (("x0", "x1", d["x"]), ("y0", "y1", d["y"])))
            points = F.flatten(F.transform(rows, lambda j: F.transform(columns, lambda i: point(b["x0"] + i * d["x"], b["y0"] + j * d["y"]))))
            return F.slice(F.filter(points, lambda p: in_ring(p["x"], p["y"], r)), 1, cap)

        mx = (b["x0"] + b["x1"]) / 2
        sides = F.filter(F.array(point(mx, b["y0"]), point(mx, b["y1"]), point(b["x0"], lat), point(b["x1"], lat)), lambda p: in_ring(p["x"], p["y"], r))
        few = F.concat(F.array(representative_point(r)), sides)
        return let(let(let(spacing(r, b, lat, per_lon), step), inner), lambda inside: F.when(F.size(inside) >= 4, inside).otherwise(few))

    return let(open_ring(ring), lambda r: F.when(F.size(r) == 0, r).otherwise(let(bbox(r), lambda b: of(r, b))))
