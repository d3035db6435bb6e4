"""Spatial joins by hash cells: an equi-join of cells, then the exact predicate."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from sitewright.functions import geometry as G
from sitewright.operators.graphs import components
from sitewright.session import cut

#: Boxes over this many cells are joined by blocks of the other side instead, see ``points_in_rings``.
OVERFLOW_CELLS = 10_000
#: Members of a connected component that one task takes, and rows of small ones that share a task.
COMPONENT_ROWS = 500_000
BIN_ROWS = 50_000


def _celled_points(points: DataFrame, x: str, y: str, size: float) -> DataFrame:
    return points.withColumns({"__cx": F.floor(F.col(x) / size), "__cy": F.floor(F.col(y) / size)})


def _celled_boxes(df: DataFrame, box: Column, size: float) -> DataFrame:
    return df.withColumn("__cell", F.explode(G.cells(box, size))).withColumns({"__cx": F.col("__cell.cx"), "__cy": F.col("__cell.cy")}).drop("__cell")


def _dealt_rings(rings: DataFrame, ring: str, size: float, overflow: int) -> tuple[DataFrame, list[float], list[int]]:
    """Rings by the cells (__level, cx, cy) of their boxes, the sizes of cells by level, and the levels that rings use."""
    sizes = [size * 32**k for k in range(4)]
    level = F.lit(len(sizes) - 1)
    for k in range(len(sizes) - 2, -1, -1):
        level = F.when(G.cell_span(F.col("__box"), sizes[k]) <= overflow, F.lit(k)).otherwise(level)
    boxed = rings.withColumn("__box", G.bbox(ring)).withColumn("__level", level)
    wide = F.get(F.array(*[F.lit(float(s)) for s in sizes]), F.col("__level"))
    used = sorted(r["__level"] for r in boxed.select("__level").distinct().collect())  # four rows at most; mostly one
    return boxed.withColumn("__cell", F.explode(G.cells(F.col("__box"), wide))).select("*", "__cell.cx", "__cell.cy").drop("__cell"), sizes, used


def points_in_rings(points: DataFrame, rings: DataFrame, x: str, y: str, ring: str, size: float, overflow: int = OVERFLOW_CELLS) -> DataFrame:
    """Pairs of a point and a ring that holds it.

    A point has one cell and a ring those of its box, so a pair meets once. Each
    ring picks the finest of four cell sizes at which its box covers at most
    ``overflow`` cells, and a point is dealt to its cell of each size that rings
    use: a ring as large as a sea neither explodes into millions of rows nor is
    compared with every point.
    """
    boxed, sizes, used = _dealt_rings(rings, ring, size, overflow)
    deal = lambda k: F.struct(F.lit(k).alias("k"), F.floor(F.col(x) / sizes[k]).alias("cx"), F.floor(F.col(y) / sizes[k]).alias("cy"))
    celled = points.withColumn("__p", deal(used[0]) if len(used) == 1 else F.explode(F.array(*[deal(k) for k in used or [0]])))
    celled = celled.withColumns({"__level": F.col("__p.k"), "cx": F.col("__p.cx"), "cy": F.col("__p.cy")}).drop("__p")
    met = celled.join(boxed, ["__level", "cx", "cy"])
    return met.where(G.in_rect(x, y, F.col("__box")) & G.in_ring(x, y, ring)).drop("__level", "cx", "cy", "__box")


def overlapping_boxes(left: DataFrame, right: DataFrame, left_box: str, right_box: str, size: float, closed: bool = True) -> DataFrame:
    """Pairs of rows whose boxes overlap, each once.

    Both sides are dealt to the cells of their boxes; a pair counts only in the
    cell that holds the low corner of what the two share, so nothing has to be
    made distinct after the join.
    """
    a, b = _celled_boxes(left, F.col(left_box), size), _celled_boxes(right, F.col(right_box), size)
    both = a.join(b, ["__cx", "__cy"])
    test = G.overlap_closed if closed else G.overlap_open
    low = lambda axis: F.floor(F.greatest(F.col(left_box)[axis], F.col(right_box)[axis]) / size)
    return both.where(test(F.col(left_box), F.col(right_box)) & (F.col("__cx") == low("x0")) & (F.col("__cy") == low("y0"))).drop("__cx", "__cy")


def _grids(low: np.ndarray, high: np.ndarray, step: float, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """Step and (columns, rows) of each pair's grid; a step widens until its grid has at most ``cap`` points."""
    steps = np.full(len(low), step)
    shape = lambda: np.floor((high - low) / steps[:, None]).astype(np.int64) + 1
    over = shape().prod(1) > cap
    steps[over] = np.maximum(step, np.sqrt((high - low).prod(1)[over] / cap))
    while (over := shape().prod(1) > cap).any():
        steps[over] *= 2**0.5
    return steps, shape()


def _spans(rings: list[np.ndarray], pair: np.ndarray, y: np.ndarray, x0: np.ndarray, step: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """For each grid row of a pair the columns inside its ring, as bounds of half-open runs, which are empty where there is none.

    A point is inside if an odd number of edges cross its row to the right of
    it, edges being half-open as ``geometry.in_ring`` has them; so runs lie
    between the last crossing and the one before, and so on.
    """
    most = max(len(r) for r in rings)
    ax, ay, bx, by = np.zeros((4, len(rings), most))
    for i, r in enumerate(rings):
        n, after = len(r), np.roll(r, -1, axis=0)
        ax[i, :n], ay[i, :n], bx[i, :n], by[i, :n] = r[:, 0], r[:, 1], after[:, 0], after[:, 1]
    ax, ay, bx, by = ax[pair], ay[pair], bx[pair], by[pair]
    crosses = (ay > y[:, None]) != (by > y[:, None])
    at = (ax - bx) * (y[:, None] - by) / np.where(ay == by, 1.0, ay - by) + bx
    # columns left of a crossing, corrected for what the division rounds away
    left = np.ceil((at - x0[:, None]) / step[:, None])
    left -= x0[:, None] + (left - 1) * step[:, None] >= at
    left += x0[:, None] + left * step[:, None] < at
    left = np.where(crosses, np.clip(left, 0, columns[:, None]), -1).astype(np.int64)
    left = -np.sort(-left, axis=1)
    if left.shape[1] % 2:
        left = np.pad(left, ((0, 0), (0, 1)), constant_values=-1)
    return np.maximum(left[:, ::-1].reshape(len(left), -1, 2), 0)


def ious(a: list[np.ndarray], b: list[np.ndarray], step: float = 0.5, cap: int = 20_000, rows: int = 100_000) -> np.ndarray:
    """For each pair of rings the share of the grid points in either that are in both; ``rows`` grid rows are held at once."""
    box = lambda f: np.array([f(p, q) for p, q in zip(a, b)]).reshape(-1, 2)
    low, high = box(lambda p, q: np.minimum(p.min(0), q.min(0))), box(lambda p, q: np.maximum(p.max(0), q.max(0)))
    steps, shape = _grids(low, high, step, cap)
    out, start = np.zeros(len(a)), 0
    while start < len(a):
        end = max(start + 1, int(np.searchsorted(np.cumsum(shape[start:, 1]), rows, "right")) + start)
        n = shape[start:end, 1]
        pair = np.repeat(np.arange(end - start), n)
        s, x0, columns = steps[start:end][pair], low[start:end, 0][pair], shape[start:end, 0][pair]
        y = low[start:end, 1][pair] + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * s
        p, q = (_spans(r[start:end], pair, y, x0, s, columns) for r in (a, b))
        both = np.maximum(0, np.minimum(p[:, :, None, 1], q[:, None, :, 1]) - np.maximum(p[:, :, None, 0], q[:, None, :, 0])).sum((1, 2))
        each = (p[:, :, 1] - p[:, :, 0]).sum(1) + (q[:, :, 1] - q[:, :, 0]).sum(1)
        shared = np.bincount(pair, both, end - start)
        either = np.bincount(pair, each, end - start) - shared
        out[start:end] = np.where(either > 0, shared / np.maximum(either, 1), 0.0)
        start = end
    return out


def iou(a: np.ndarray, b: np.ndarray, step: float = 0.5, cap: int = 20_000) -> float:
    return float(ious([a], [b], step, cap)[0])


def _rings(column: pa.Array) -> list[np.ndarray]:
    points = column.flatten()
    xy = np.column_stack([np.asarray(points.field("x")), np.asarray(points.field("y"))])
    ends = np.cumsum(np.asarray(pc.list_value_length(column)))
    return np.split(xy, ends[:-1])


def _words(lo: np.ndarray, hi: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, word, bits) of half-open runs of numbers, given by rows and in order: a set of numbers as words of 64 bits."""
    some = hi > lo
    lo, hi, row = lo[some], hi[some], row[some]
    first, last = lo >> 6, (hi - 1) >> 6
    n = last - first + 1
    at = np.repeat(np.arange(len(lo)), n)
    word = first[at] + np.arange(len(at)) - (np.cumsum(n) - n)[at]
    start, end = np.where(word == first[at], lo[at] & 63, 0), np.where(word == last[at], ((hi[at] - 1) & 63) + 1, 64)
    bits = (np.uint64(2**64 - 1) >> (64 - end + start).astype(np.uint64)) << start.astype(np.uint64)
    return _merged(row[at], word, bits)


def _merged(row: np.ndarray, word: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbours with the same row and word as one."""
    if not len(row):
        return row, word, bits
    starts = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (word[1:] != word[:-1])])
    return row[starts], word[starts], np.bitwise_or.reduceat(bits, starts)


def grid_hits(a: list[np.ndarray], b: list[np.ndarray], step: float, most: int = 2_000_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(pair, word, bits): for each pair the grid points of ``a`` that lie in both rings, as words of 64 numbers.

    The grid and its numbers are those of ``geometry.grid`` over the box of
    ``a``. A pair costs the grid rows that the box of ``b`` meets; ``most`` edges
    of rows are held at once, and a word may come in several pieces.
    """
    box = lambda rings, f: np.array([f(r) for r in rings]).reshape(-1, 2)
    low, high = box(a, lambda r: r.min(0)), box(a, lambda r: r.max(0))
    columns, rows = (np.floor((high - low) / step).astype(np.int64) + 1).T
    first = np.floor((box(b, lambda r: r.min(0))[:, 1] - low[:, 1]) / step) - 1  # a row more on either side, for what the division rounds
    last = np.ceil((box(b, lambda r: r.max(0))[:, 1] - low[:, 1]) / step) + 2
    first, last = (np.clip(v, 0, rows).astype(np.int64) for v in (first, last))
    n = np.maximum(last - first, 0)
    pairs = np.repeat(np.arange(len(a)), n)
    js = first[pairs] + np.arange(len(pairs)) - (np.cumsum(n) - n)[pairs]
    chunk = max(1, most // max((len(r) for r in (*a, *b)), default=1))
    for start in range(0, len(pairs), chunk):
        pair, j = pairs[start : start + chunk], js[start : start + chunk]
        p0, y = pair[0], low[pair, 1] + j * step
        row, base = np.arange(len(pair)), j * columns[pair]
        sides = []
        for rings in (a, b):
            runs = _spans(rings[p0 : pair[-1] + 1], pair - p0, y, low[pair, 0], np.full(len(pair), step), columns[pair])
            flat = lambda k, runs=runs: (base[:, None] + runs[:, :, k]).ravel()
            sides.append(_words(flat(0), flat(1), np.repeat(row, runs.shape[1])))
        wide = int(columns[pair].max() >> 6) + 2
        (r, w, bits), (r2, w2, bits2) = sides
        _, i, k = np.intersect1d(r * wide + w - (base >> 6)[r], r2 * wide + w2 - (base >> 6)[r2], assume_unique=True, return_indices=True)
        both = bits[i] & bits2[k]
        yield _merged(pair[r[i][both > 0]], w[i][both > 0], both[both > 0])


def covered_grid_points(areas: DataFrame, rings: DataFrame, key: str, by: str, step: float, size: float, overflow: int = OVERFLOW_CELLS) -> DataFrame:
    """(key, by, samples): how many grid points inside an area (key, ring) lie in rings (by, ring) of each kind; a point counts once.

    Areas meet rings by boxes in hash cells, not point by point, each pair in the
    cell of the low corner of what the boxes share. A pair's points travel as
    words of 64 bits, and the words of one kind are joined before bits are
    counted, so that no area's points are gathered.
    """
    boxed, sizes, used = _dealt_rings(rings.select(by, F.col("ring").alias("__other")), "__other", size, overflow)
    deal = lambda k: F.transform(G.cells(F.col("__area"), sizes[k]), lambda c: F.struct(F.lit(k).alias("k"), c["cx"].alias("cx"), c["cy"].alias("cy"), F.lit(sizes[k]).alias("wide")))
    own = areas.select(key, "ring", G.bbox("ring").alias("__area")).withColumn("__p", F.explode(F.flatten(F.array(*[deal(k) for k in used or [0]]))))
    met = own.select("*", F.col("__p.k").alias("__level"), "__p.cx", "__p.cy", "__p.wide").drop("__p").join(boxed, ["__level", "cx", "cy"])
    low = lambda axis: F.floor(F.greatest(F.col("__area")[axis], F.col("__box")[axis]) / F.col("wide"))
    met = met.where(G.overlap_closed(F.col("__area"), F.col("__box")) & (F.col("cx") == low("x0")) & (F.col("cy") == low("y0"))).select(key, by, "ring", "__other")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pair, word, bits in grid_hits(_rings(batch.column(2)), _rings(batch.column(3)), step):
                at = pa.array(pair)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(word), pa.array(bits.view(np.int64))], [key, by, "word", "bits"])

    kinds = dict(met.dtypes)
    words = met.mapInArrow(run, f"`{key}` {kinds[key]}, `{by}` {kinds[by]}, word bigint, bits bigint")
    return words.groupBy(key, by, "word").agg(F.bit_or("bits").alias("bits")).groupBy(key, by).agg(F.sum(F.bit_count("bits")).alias("samples"))


def grid_points(areas: DataFrame, key: str, step: float) -> DataFrame:
    """(key, samples): how many points of its own grid lie inside each area (key, ring), where any does."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rings, n = _rings(batch.column(1)), np.zeros(batch.num_rows, np.int64)
            for pair, _, bits in grid_hits(rings, rings, step):
                np.add.at(n, pair, np.bitwise_count(bits).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n)], [key, "samples"])

    found = areas.where(F.size("ring") > 0).select(key, "ring").mapInArrow(run, f"`{key}` {dict(areas.dtypes)[key]}, samples bigint")
    return found.groupBy(key).agg(F.sum("samples").alias("samples")).where("samples > 0")


def scored(pairs: DataFrame, a: str, b: str, step: float = 0.5, cap: int = 20_000) -> DataFrame:
    """Pairs with ``iou`` in place of their two rings.

    A grid of up to ``cap`` points for each pair is more than higher-order
    functions do well (they took 50 times as long), so rings go to numpy in
    Arrow batches, which measures the rows of all grids of a batch at once.
    """
    rest = [c for c in pairs.columns if c not in (a, b)]
    rows = pairs.select(*rest, a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            found = ious(_rings(batch.column(batch.num_columns - 2)), _rings(batch.column(batch.num_columns - 1)), step, cap)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(found, pa.float64())], names=[*rest, "iou"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.select(*rest).schema)
    return rows.mapInArrow(run, f"{kinds}, iou double")


def containers(subjects: DataFrame, others: DataFrame, size: float = 50.0) -> DataFrame:
    """Each subject (sid, ring) with ``container``: the first of others (oid, ring) that holds its representative point, or null."""
    points = subjects.select("sid", G.representative_point("ring").alias("p")).select("sid", F.col("p.x").alias("px"), F.col("p.y").alias("py"))
    hits = points_in_rings(points, others.select("oid", F.col("ring").alias("other")), "px", "py", "other", size)
    first = hits.groupBy("sid").agg(F.min("oid").alias("container"))
    return subjects.join(first, "sid", "left")


def _by_component(nodes: DataFrame, links: DataFrame, run: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> tuple[DataFrame, DataFrame]:
    """``run`` over whole components of at most COMPONENT_ROWS rows, many of them to a task, and the rows of larger ones.

    ``nodes``: rows with ``node``; ``links``: (a, b) of such nodes.
    """
    comp = components(links, "a", "b").withColumnRenamed("id", "node")
    sizes = comp.groupBy("component").agg(F.count("*").alias("members"))
    placed = nodes.join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    placed = cut(placed.join(sizes, "component", "left"), "components")
    small = F.coalesce("members", F.lit(1)) <= COMPONENT_ROWS
    bins = max(1, placed.count() // BIN_ROWS)
    done = placed.where(small).withColumn("bin", F.pmod(F.xxhash64(F.to_json(F.struct("component"))), F.lit(bins)))
    return done.drop("node", "component", "members").groupBy("bin").applyInPandas(run, schema), placed.where(~small).drop("node", "component", "members")


def greedy_matches(scored_pairs: DataFrame) -> DataFrame:
    """One-to-one pairs of (i, j, iou), as taken by falling iou, then i, then j.

    A pair that comes first for both of its rows is taken by that order whatever
    happens elsewhere; two rounds take all of those at once and drop their rows.
    Rows of what is left that no chain of pairs connects don't matter to each
    other, so each connected component is matched by itself, in order. Only
    those beyond COMPONENT_ROWS go on in rounds.
    """
    left = cut(scored_pairs.select("i", "j", "iou"), "pairs")
    kinds = dict(left.dtypes)
    key = F.struct((-F.col("iou")).alias("s"), "i", "j")
    taken = left.limit(0)

    def rounds(left: DataFrame, taken: DataFrame, most: int | None) -> tuple[DataFrame, DataFrame]:
        done = 0
        while (most is None or done < most) and left.limit(1).count():
            best_i, best_j = left.groupBy("i").agg(F.min(key).alias("bi")), left.groupBy("j").agg(F.min(key).alias("bj"))
            both = cut(best_i.join(best_j, F.col("bi") == F.col("bj")).select("bi.i", "bi.j", (-F.col("bi.s")).alias("iou")), "taken")
            taken = taken.unionByName(both)
            left = cut(left.join(both.select("i"), "i", "left_anti").join(both.select("j"), "j", "left_anti").select("i", "j", "iou"), "pairs")
            done += 1
        return left, taken

    left, taken = rounds(left, taken, 2)
    if not left.limit(1).count():
        return taken
    name = lambda side, c: F.struct(F.lit(side).alias("side"), F.col(c).cast("string").alias("at"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["iou", "i", "j"], ascending=[False, True, True], kind="stable")
        seen_i, seen_j, keep = set(), set(), []
        for i, j in zip(pdf["i"], pdf["j"]):
            keep.append(i not in seen_i and j not in seen_j)
            if keep[-1]:
                seen_i.add(i)
                seen_j.add(j)
        return pdf.loc[keep, ["i", "j", "iou"]]

    small, large = _by_component(left.withColumn("node", name(0, "i")), left.select(name(0, "i").alias("a"), name(1, "j").alias("b")), run, f"i {kinds['i']}, j {kinds['j']}, iou double")
    return rounds(large, taken.unionByName(small), None)[1]


def match(ours: DataFrame, theirs: DataFrame, floor: float = 0.1, size: float = 50.0, step: float = 0.5) -> DataFrame:
    """Matched footprints (i, j, iou) of ours (i, ring) and theirs (j, ring)."""
    a = ours.select("i", F.col("ring").alias("ra"), G.bbox("ring").alias("ba"))
    b = theirs.select("j", F.col("ring").alias("rb"), G.bbox("ring").alias("bb"))
    pairs = overlapping_boxes(a, b, "ba", "bb", size)
    return greedy_matches(cut(scored(pairs.select("i", "j", "ra", "rb"), "ra", "rb", step).where(F.col("iou") >= floor), "scored"))


def fuse(base: DataFrame, candidates: DataFrame, size: float) -> DataFrame:
    """Candidates (ord, ring) that enter after base (ring), first come first served.

    One is refused if its representative point lies in an accepted ring or an
    accepted one's point lies in it. That relation is symmetric, so after the
    ones that meet the base are gone, what is left is the first maximal set
    without conflicts, in each connected component by itself. A component beyond
    COMPONENT_ROWS goes in rounds: whoever comes before all its neighbours
    enters, and its neighbours go.
    """
    with_point = lambda df: df.withColumn("p", G.representative_point("ring")).withColumns({"px": F.col("p.x"), "py": F.col("p.y")}).drop("p")
    c, b = with_point(candidates.select("ord", "ring")), with_point(base.select("ring"))
    rings_b = b.select(F.col("ring").alias("other"))
    hit = points_in_rings(c.select("ord", "px", "py"), rings_b, "px", "py", "other", size).select("ord")
    hit = hit.unionByName(points_in_rings(b.select("px", "py"), c.select("ord", F.col("ring").alias("other")), "px", "py", "other", size).select("ord"))
    c = cut(c.join(hit.distinct(), "ord", "left_anti"))
    conflicts = points_in_rings(c.select("ord", "px", "py"), c.select(F.col("ord").alias("ord2"), F.col("ring").alias("other")), "px", "py", "other", size).where("ord <> ord2")
    conflicts = conflicts.select("ord", "ord2").unionByName(conflicts.select(F.col("ord2").alias("ord"), F.col("ord").alias("ord2"))).distinct()
    conflicts = cut(conflicts)
    kind = dict(conflicts.dtypes)["ord"]
    alone = c.select("ord").join(conflicts, "ord", "left_anti")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        near = defaultdict(list)
        order = lambda o: tuple(o) if isinstance(o, Row) else tuple(o.values()) if isinstance(o, dict) else o
        named = {}
        for x, y in zip(pdf["ord"], pdf["ord2"]):
            near[order(x)].append(order(y))
            named[order(x)] = x
        taken: set = set()
        for x in sorted(near):
            if not any(y in taken for y in near[x]):
                taken.add(x)
        return pd.DataFrame({"ord": [named[x] for x in sorted(taken)]})

    taken, conflicts = _by_component(conflicts.withColumn("node", F.col("ord")), conflicts.select(F.col("ord").alias("a"), F.col("ord2").alias("b")), run, f"ord {kind}")
    taken = cut(taken.unionByName(alone))
    undecided = conflicts.select("ord").distinct()
    while undecided.limit(1).count():
        near = conflicts.groupBy("ord").agg(F.min("ord2").alias("least"))
        enter = cut(undecided.join(near, "ord", "left").where("least IS NULL OR ord < least").select("ord"))
        taken = taken.unionByName(enter)
        gone = enter.unionByName(conflicts.join(enter.withColumnRenamed("ord", "ord2"), "ord2", "left_semi").select("ord")).distinct()
        undecided = cut(undecided.join(gone, "ord", "left_anti"))
        conflicts = cut(conflicts.join(gone, "ord", "left_anti").join(gone.withColumnRenamed("ord", "ord2"), "ord2", "left_anti").select("ord", "ord2"))
    return candidates.join(taken, "ord", "left_semi")


def resolve_ways(ways: DataFrame, nodes: DataFrame, value: Callable[[], Column], least: int = 3) -> DataFrame:
    """Ways (id, refs) with ``ring``: their nodes' points in order, closing one dropped; a way that misses a node goes."""
    refs = ways.select("id", F.posexplode("refs").alias("pos", "ref"))
    placed = refs.join(nodes.select(F.col("id").alias("ref"), value().alias("p")), "ref", "left")
    rings = placed.groupBy("id").agg(F.count("*").alias("n"), F.count("p").alias("known"), F.sort_array(F.collect_list(F.struct("pos", "p"))).alias("all"))
    ring = G.open_ring(F.transform("all", lambda s: s["p"]))
    return rings.where("n = known").select("id", ring.alias("ring")).where(F.size("ring") >= least)


def relation_ways(relations: DataFrame) -> DataFrame:
    """(id, pos, way) of relations (id, members): the ways of their outer rings, or all their ways where no way is said to be outer."""
    ways = F.filter(F.transform("members", lambda m, i: F.struct(i.alias("pos"), m["type"].alias("type"), m["ref"].alias("ref"), m["role"].alias("role"))), lambda m: (m["type"] == "way") & m["ref"].isNotNull())
    outer = F.filter(ways, lambda m: m["role"] == "outer")
    used = F.when(F.size(outer) > 0, outer).otherwise(ways)
    return relations.select("id", F.explode(used).alias("m")).select("id", F.col("m.pos").alias("pos"), F.col("m.ref").alias("way"))


def relation_rings(relations: DataFrame, rings: DataFrame) -> DataFrame:
    """(id, pos, way, ring): each outer way of a relation that is a ring (id, ring) by itself; other ways have no row."""
    return relation_ways(relations).join(rings.select(F.col("id").alias("way"), "ring"), "way").select("id", "pos", "way", "ring")


def segments(lines: DataFrame, line: str, order: str, closed: bool = False) -> DataFrame:
    """Each vertex row with nx, ny: its successor in the line, for rings the first one after the last."""
    w = Window.partitionBy(line).orderBy(order)
    nx, ny = F.lead("x").over(w), F.lead("y").over(w)
    if closed:
        whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        nx, ny = F.coalesce(nx, F.first("x").over(whole)), F.coalesce(ny, F.first("y").over(whole))
    return lines.withColumns({"nx": nx, "ny": ny}).where("nx IS NOT NULL")


def densify(lines: DataFrame, line: str, order: str, every: float) -> DataFrame:
    """(line, order, step, x, y): every vertex, and points at multiples of ``every`` strictly inside each segment."""
    w = Window.partitionBy(line).orderBy(order)
    seg = lines.withColumns({"nx": F.lead("x").over(w), "ny": F.lead("y").over(w)})
    length = F.hypot(F.col("nx") - F.col("x"), F.col("ny") - F.col("y"))
    steps = F.coalesce(F.filter(F.sequence(F.lit(0), F.floor(length / every).cast("int")), lambda k: (k == 0) | (k * every < length)), F.array(F.lit(0)))
    seg = seg.withColumn("length", length).withColumn("step", F.explode(steps))
    t = F.coalesce(F.col("step") * every / F.nullif("length", F.lit(0.0)), F.lit(0.0))
    moved = lambda a, b: F.when(F.col("step") == 0, F.col(a)).otherwise(F.col(a) + (F.col(b) - F.col(a)) * t)
    return seg.select(line, order, "step", moved("x", "nx").alias("x"), moved("y", "ny").alias("y"))


def nearest_segments(samples: DataFrame, segs: DataFrame, radius: float = 15.0, size: float = 25.0) -> DataFrame:
    """Each sample (sample_id, x, y) with its nearest segment (seg_id, x0, y0, x1, y1) within ``radius``, or nulls; ties to the smaller seg_id."""
    box = F.struct(*[f(F.col(a), F.col(b)).alias(k) for k, f, a, b in (("x0", F.least, "x0", "x1"), ("y0", F.least, "y0", "y1"), ("x1", F.greatest, "x0", "x1"), ("y1", F.greatest, "y0", "y1"))])
    wide = F.struct((box["x0"] - radius).alias("x0"), (box["y0"] - radius).alias("y0"), (box["x1"] + radius).alias("x1"), (box["y1"] + radius).alias("y1"))
    near = _celled_points(samples, "x", "y", size).join(_celled_boxes(segs, wide, size), ["__cx", "__cy"])
    # plain columns, which generated code evaluates; the nested form of geometry.nearest_on_segment would be interpreted
    near = near.withColumns({"tx": F.col("x1") - F.col("x0"), "ty": F.col("y1") - F.col("y0")})
    length2 = F.nullif(F.col("tx") * F.col("tx") + F.col("ty") * F.col("ty"), F.lit(0.0))
    share = ((F.col("x") - F.col("x0")) * F.col("tx") + (F.col("y") - F.col("y0")) * F.col("ty")) / length2
    near = near.withColumn("t", F.when(length2.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))))
    near = near.withColumns({"de": F.col("x0") + F.col("t") * F.col("tx") - F.col("x"), "dn": F.col("y0") + F.col("t") * F.col("ty") - F.col("y")})
    near = near.withColumn("distance", F.hypot("de", "dn")).where(F.col("distance") <= radius)
    best = near.groupBy("sample_id").agg(F.min_by(F.struct("seg_id", "t", "de", "dn", "tx", "ty"), F.struct("distance", "seg_id")).alias("best"))
    return samples.join(best, "sample_id", "left").select(*samples.columns, "best.*")


def offset_statistics(offsets: DataFrame, by: list[str]) -> DataFrame:
    """How far samples lie from their nearest segments, and the shift that explains it best.

    Below five matched samples only counts are given. The least-squares shift
    takes samples strictly inside a segment, eight at least, and needs segments
    in more than one direction.
    """
    hit = F.col("seg_id").isNotNull()
    inner = hit & (F.col("t") > 0) & (F.col("t") < 1)
    length = F.hypot("tx", "ty")
    ne, nn = -F.col("ty") / F.nullif(length, F.lit(0.0)), F.col("tx") / F.nullif(length, F.lit(0.0))
    of = lambda v: F.sum(F.when(inner, v))
    size = F.hypot("de", "dn")
    g = offsets.groupBy(*by).agg(
        F.count_if(hit).alias("count"), F.count_if(~hit).alias("unmatched"), F.avg("de").alias("mean_de"), F.avg("dn").alias("mean_dn"),
        F.stddev_pop("de").alias("std_de"), F.stddev_pop("dn").alias("std_dn"), F.percentile(size, F.lit(0.5)).alias("p50_abs"), F.percentile(size, F.lit(0.9)).alias("p90_abs"),
        F.count_if(inner & (length > 0)).alias("interior"), of(ne * ne).alias("xx"), of(ne * nn).alias("xy"), of(nn * nn).alias("yy"), of(F.col("de")).alias("ve"), of(F.col("dn")).alias("vn"),
    )
    enough = F.col("count") >= 5
    det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    solid = enough & (F.col("interior") >= 8) & (det >= 1e-6 * F.pow((F.col("xx") + F.col("yy")) / 2, 2))
    kept = ["mean_de", "mean_dn", "std_de", "std_dn", "p50_abs", "p90_abs"]
    return g.select(
        *by, "count", "unmatched", *[F.when(enough, F.col(c)).otherwise(0.0).alias(c) for c in kept], "interior",
        F.when(solid, (F.col("ve") * F.col("yy") - F.col("xy") * F.col("vn")) / det).alias("lsq_de"),
        F.when(solid, (F.col("xx") * F.col("vn") - F.col("xy") * F.col("ve")) / det).alias("lsq_dn"),
    )


# Bounds of an offset that tells of an epoch's shift, in metres and degrees.
UNDETECTED, SHIFT_LEAST, SHIFT_MOST, NORTH_EAST, TOLERANCE = 0.3, 0.5, 1.5, 45.0, 45.0


def epoch_verdict(count: str, lsq_de: str, lsq_dn: str, std_de: str, std_dn: str) -> Column:
    """What a road population's least-squares shift says of two epochs, as a sentence."""
    size = F.hypot(lsq_de, lsq_dn)
    bearing = F.pmod(F.degrees(F.atan2(F.col(lsq_de), F.col(lsq_dn))), F.lit(360.0))
    apart = F.abs(F.pmod(bearing - NORTH_EAST + 180.0, F.lit(360.0)) - 180.0)
    steady = size.between(SHIFT_LEAST, SHIFT_MOST) & (apart <= TOLERANCE) & (F.hypot(std_de, std_dn) < 2 * size)
    # The sentences.
    return (
        F.when(F.col(count) == 0, "INCONCLUSIVE: no matched road samples to measure an offset from.")
        .when(size.isNull(), "INCONCLUSIVE: the least-squares offset estimate is undefined; the sampled road population is too close to one orientation to separate the two shift components.")
        .when(size < UNDETECTED, F.format_string("NOT DETECTED: least-squares offset magnitude %.2f m is under 0.3 m.", size))
        .when(steady, F.format_string("CONSISTENT with the epoch-shift hypothesis: least-squares offset %.2f m at bearing %.0f degrees.", size, bearing))
        .otherwise(F.format_string("INCONCLUSIVE: least-squares offset %.2f m at bearing %.0f degrees does not clear every CONSISTENT band.", size, bearing))
    )


# Upper bounds of the buckets of building areas in square metres, and their names.
AREA_BOUNDS = (10.0, 30.0, 80.0, 200.0, 1000.0)
AREA_NAMES = ("under_10", "10_to_30", "30_to_80", "80_to_200", "200_to_1000", "over_1000")


def area_bucket(area: Column) -> Column:
    """Half-open on the right: an area on a bound is in the larger bucket."""
    above = sum((F.when(area >= b, 1).otherwise(0) for b in AREA_BOUNDS), F.lit(0))
    return F.get(F.array(*[F.lit(n) for n in AREA_NAMES]), above)


def area_histogram(areas: DataFrame, area: str) -> DataFrame:
    """(bucket, n) with every bucket present."""
    every = areas.sparkSession.range(len(AREA_NAMES)).select(F.get(F.array(*[F.lit(n) for n in AREA_NAMES]), F.col("id").cast("int")).alias("bucket"))
    counted = areas.groupBy(area_bucket(F.col(area)).alias("bucket")).count()  # six rows at most on either side
    return F.broadcast(every).join(F.broadcast(counted), "bucket", "left").select("bucket", F.coalesce("count", F.lit(0)).alias("n"))
