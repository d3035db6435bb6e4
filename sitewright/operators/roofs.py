"""Roof forms from surface samples: planes by seeded random trials, then a class for each building.

Plane search is random, so each building is solved by itself in Python with
numpy, all trials of a plane at once; a building's samples are bounded by its size.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Results depend on them.
TOLERANCE = 0.25
TRIALS = 120
PLANES = 4
MIN_INLIERS = 12
MIN_SAMPLES = 24
MIN_QUALITY = 0.75
FLAT_SLOPE = 5.0
PITCHED = (10.0, 65.0)
OPPOSITE = 35.0
ALIKE = 15.0
FLAT_SPREAD = 0.5
MIN_RIDGE = 2.0


def least_squares(p: np.ndarray) -> np.ndarray | None:
    """(a, b, c) of z = a e + b n + c; None where the points lie on a line."""
    m = np.column_stack([p[:, :2], np.ones(len(p))])
    normal = m.T @ m
    if abs(np.linalg.det(normal)) < 1e-9:
        return None
    return np.linalg.solve(normal, m.T @ p[:, 2])


def trimmed(p: np.ndarray) -> np.ndarray | None:
    """A second fit without the tenth of the points that lies farthest off the first."""
    fit = least_squares(p)
    if fit is None or len(p) < 5:
        return fit
    order = np.argsort(np.abs(p[:, :2] @ fit[:2] + fit[2] - p[:, 2]), kind="stable")
    return least_squares(p[order[: max(4, len(p) - max(1, len(p) // 10))]])


@lru_cache(4_096)
def _draws(before: tuple[tuple[int, int], ...], n: int) -> np.ndarray:
    """The places of three points of ``n`` for each trial, after searches (points, trials made) that came before.

    Which places are drawn depends on the number of points alone, so buildings share them.
    """
    dice = random.Random(0)
    for m, used in before:
        for _ in range(used):
            dice.sample(range(m), 3)
    return np.array([dice.sample(range(n), 3) for _ in range(TRIALS)])


def _search(q: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, int]:
    """Places of the points near the plane that has most of them, the first of equal ones, and the trials made: the search ends at nine tenths."""
    best, most, start = np.zeros(len(q), bool), 0, 0
    for end in (4, len(draws)):  # a simple roof needs few
        three = q[draws[start:end]]
        sides = three[:, 1:, :2] - three[:, :1, :2]
        trial = np.flatnonzero(np.abs(np.linalg.det(sides)) >= 1e-9)
        three = three[trial]
        slope = np.linalg.solve(sides[trial], (three[:, 1:, 2] - three[:, :1, 2])[:, :, None])[:, :, 0]
        level = three[:, 0, 2] - (slope * three[:, 0, :2]).sum(1)
        near = np.abs(slope @ q[:, :2].T + level[:, None] - q[:, 2]) <= TOLERANCE
        count = near.sum(1)
        enough = np.flatnonzero(count >= 0.9 * len(q))
        if len(enough):
            return np.flatnonzero(near[enough[0]]), start + int(trial[enough[0]]) + 1
        if len(count) and count.max() > most:
            best, most = near[count.argmax()], int(count.max())
        start = end
    return np.flatnonzero(best), len(draws)


def planes(p: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Planes with the places of their points; each takes its points from the later ones. Trials are measured together."""
    free, found, before = np.arange(len(p)), [], ()
    while len(free) >= MIN_INLIERS and len(found) < PLANES:
        hit, used = _search(p[free], _draws(before, len(free)))
        before += ((len(free), used),)
        fit = trimmed(p[free[hit]]) if len(hit) >= MIN_INLIERS else None
        if fit is None:
            break
        own = np.abs(p[free, :2] @ fit[:2] + fit[2] - p[free, 2]) <= TOLERANCE
        if own.sum() < MIN_INLIERS:
            break
        found.append((fit, free[own]))
        free = free[~own]
    return found


def _slope(fit: np.ndarray) -> float:
    return float(np.degrees(np.arctan(np.hypot(fit[0], fit[1]))))


def _downhill(fit: np.ndarray) -> float:
    return float(np.degrees(np.arctan2(-fit[0], -fit[1])) % 360)


def form(p: np.ndarray) -> dict | None:
    """shape, direction, eaves, ridge and quality of one roof; None if it can't be told."""
    found = planes(p) if len(p) >= MIN_SAMPLES else []
    if not found:
        return None
    used = np.unique(np.concatenate([own for _, own in found]))
    quality = round(len(used) / len(p), 2)
    main = sorted((f for f in found if len(f[1]) >= max(MIN_INLIERS, int(np.ceil(0.15 * len(used))))), key=lambda f: -len(f[1]))
    if quality < MIN_QUALITY or not main:
        return None
    z = p[used, 2]
    surface = p[np.unique(np.concatenate([own for _, own in main])), 2]
    slopes = [_slope(fit) for fit, _ in main]
    pitched = all(PITCHED[0] <= s <= PITCHED[1] for s in slopes)
    shape, direction = "complex", None
    if all(s < FLAT_SLOPE for s in slopes):
        if np.percentile(surface, 95) - np.percentile(surface, 10) <= FLAT_SPREAD:
            shape = "flat"
    elif len(main) == 1 and pitched:
        shape, direction = "mono", round(_downhill(main[0][0])) % 360
    elif len(main) == 2 and pitched:
        one, two = main[0][0], main[1][0]
        apart = abs(_downhill(one) - _downhill(two)) % 360
        ridge = (two[1] - one[1], one[0] - two[0])  # along where the planes meet
        if min(apart, 360 - apart) >= 180 - OPPOSITE and abs(slopes[0] - slopes[1]) <= ALIKE and np.hypot(*ridge) >= 1e-9:
            shape, direction = "gable", round(float(np.degrees(np.arctan2(*ridge)) % 180)) % 180
    low, high = (np.percentile(z, 50),) * 2 if shape == "flat" else (np.percentile(z, 10), np.percentile(z, 95))
    eaves, top = round(float(low), 1), round(float(high), 1)
    return None if top < MIN_RIDGE else {"shape": shape, "direction": direction, "eaves": eaves, "ridge": top, "quality": quality}


def fit(samples: DataFrame) -> DataFrame:
    """(fid, shape, direction, eaves, ridge, quality) from samples (fid, e, n, z above ground), taken by rows from the low corner.

    A building's samples lie together after one shuffle and sort, and a batch
    holds many buildings; the last one waits for the next batch.
    """
    kinds = {"shape": pa.string()} | dict.fromkeys(["direction", "eaves", "ridge", "quality"], pa.float64())

    def solved(rows: pa.Table) -> pa.RecordBatch:
        fid, p = rows.column("fid").combine_chunks(), np.column_stack([rows.column(c).to_numpy() for c in ("e", "n", "z")]).astype(float)
        starts = _starts(fid)
        names, forms = [], []
        for start, end in zip(starts, [*starts[1:], len(p)]):
            own = p[start:end]
            own = own[np.lexsort((own[:, 2], own[:, 0], own[:, 1]))]
            own[:, :2] -= own[:, :2].mean(0)
            if got := form(own):
                names.append(start)
                forms.append(got)
        return pa.RecordBatch.from_arrays([fid.take(pa.array(names, pa.int64())), *[pa.array([f[k] for f in forms], t) for k, t in kinds.items()]], ["fid", *kinds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            if held and rows.column("fid")[0].as_py() != held[-1].column("fid")[-1].as_py():
                yield solved(pa.concat_tables(held))
                held = []
            last = int(_starts(rows.column("fid").combine_chunks())[-1])
            if last:
                yield solved(pa.concat_tables([*held, rows.slice(0, last)]))
                held = []
            held.append(rows.slice(last))
        if held:
            yield solved(pa.concat_tables(held))

    kind = dict(samples.dtypes)["fid"]
    together = samples.select("fid", *[F.col(c).cast("double").alias(c) for c in ("e", "n", "z")]).repartition("fid").sortWithinPartitions("fid")
    return together.mapInArrow(run, f"fid {kind}, shape string, direction double, eaves double, ridge double, quality double")


def _starts(fid: pa.Array) -> np.ndarray:
    """Where a value differs from the one before."""
    runs = pc.run_end_encode(fid).run_ends.to_numpy()
    return np.r_[0, runs[:-1]]


def ridge_segment(one: np.ndarray, two: np.ndarray, ring: list[tuple[float, float]]) -> tuple | None:
    """The part of the line where two planes meet that lies within a footprint, with its height."""
    along = np.array([two[1] - one[1], one[0] - two[0]])
    if (size := np.hypot(*along)) < 1e-9:
        return None
    along /= size
    normal = one[:2] - two[:2]
    foot = normal * (two[2] - one[2]) / (normal @ normal)
    at = []
    for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]]):
        side = np.array([x2 - x1, y2 - y1])
        cross = along[0] * side[1] - along[1] * side[0]
        if abs(cross) < 1e-12:
            continue
        u = ((x1 - foot[0]) * along[1] - (y1 - foot[1]) * along[0]) / cross
        if 0 <= u <= 1:
            at.append((np.array([x1, y1]) + u * side - foot) @ along)
    if len(at) < 2:
        return None
    a, b = foot + min(at) * along, foot + max(at) * along
    z = one[0] * a[0] + one[1] * a[1] + one[2]
    return (*a.tolist(), float(z)), (*b.tolist(), float(z))


def tagged(ways: DataFrame, forms: DataFrame) -> DataFrame:
    """Ways (id, tags map) with the tags of their roof forms (fid, ...); tags that are there already stay."""
    own = F.create_map(
        F.lit("roof:shape"), F.col("shape"), F.lit("roof:direction"), F.format_string("%.0f", "direction"),
        F.lit("roof:height:eaves"), F.format_string("%.1f", "eaves"), F.lit("roof:height:ridge"), F.format_string("%.1f", "ridge"),
    )
    own = F.map_filter(own, lambda k, v: v.isNotNull() & ((k != "roof:direction") | F.col("direction").isNotNull()))
    joined = ways.join(forms.withColumnRenamed("fid", "id"), "id", "left")
    tags = F.when(F.col("shape").isNotNull(), F.map_concat(F.map_filter(own, lambda k, _: ~F.map_contains_key("tags", k)), "tags")).otherwise(F.col("tags"))
    return joined.withColumn("tags", tags).select(*ways.columns)
