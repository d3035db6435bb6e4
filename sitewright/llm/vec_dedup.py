"""Embedding near-dedup by cross-polytope hashing.

Equal vectors of one label are first folded into their smallest row. Each
folded vector is rotated by seeded sign flips and fast Hadamard transforms; the
nearest signed axis is its hash, AXES of them make a bucket of a table, and the
axes that were nearly as close give further buckets. Only ids are dealt to find
the buckets that several vectors share; vectors follow to these alone. A bucket
is searched as a whole or, beyond TILE_ROWS, as pairs of tiles of bounded size;
each pair in it is verified in double precision and counted only in the first
bucket that the two share. Tasks return counts and a spanning set of links,
never all pairs.

Results: a vector that is null, empty, zero or has null or non-finite parts, or
whose label is null, links with nothing; vectors of different lengths do not
link; equal rows link with each other; extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewright.llm.common import cut, partitions
from sitewright.operators.graphs import components

TABLES = 6
AXES = 3
#: Buckets of a vector in each table.
PROBES = 3
TILE_ROWS = 2_000
#: Rows to a bin of small buckets, for all labels together.
BIN_ROWS = 20_000
#: Rows of a bucket from which its pairs come from a matrix product.
BLOCK_ROWS = 32
SIMILAR = 0.98


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row; the width is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], 2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def _axes(x: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The two nearest signed axes of each row after a seeded rotation, and how far apart they are."""
    rng = np.random.default_rng(seed)
    for _ in range(3):
        x = hadamard(x * rng.choice([-1.0, 1.0], x.shape[1]))
    size = np.abs(x)
    if x.shape[1] == 1:
        return np.repeat((x > 0).astype(np.int64), 2, 1), np.zeros(len(x))
    two = np.argpartition(-size, 1, axis=1)[:, :2]
    two = np.take_along_axis(two, np.argsort(-np.take_along_axis(size, two, 1), axis=1, kind="stable"), 1)
    both = np.take_along_axis(x, two, 1)
    return two * 2 + (both > 0), np.abs(both[:, 0]) - np.abs(both[:, 1])


def buckets(x: np.ndarray, tables: int = TABLES, probes: int = PROBES) -> np.ndarray:
    """For each row its bucket ids: per table the nearest, then the others by closeness."""
    width = 1 << max(0, int(x.shape[1] - 1).bit_length())
    pad = np.zeros((len(x), width))
    pad[:, : x.shape[1]] = x / np.linalg.norm(x, axis=1, keepdims=True)
    second = np.array(list(product((0, 1), repeat=AXES)))  # which rotations give their second axis
    out = []
    for t in range(tables):
        keys, cost = np.full((len(x), len(second)), t, np.int64), np.zeros((len(x), len(second)))
        for i in range(AXES):
            axes, gap = _axes(pad, AXES * t + i)
            keys = keys * (2 * width) + axes[:, second[:, i]]
            cost += second[:, i] * gap[:, None]
        out.append(np.take_along_axis(keys, np.argsort(cost, axis=1, kind="stable")[:, :probes], 1))
    return np.concatenate(out, 1)


def _fine() -> Column:
    v = F.col("embedding")
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)


def _usable(vectors: DataFrame) -> DataFrame:
    return vectors.where(_fine())


def _matrix(column: pa.Array, kind: type = np.float64) -> np.ndarray:
    flat = column.flatten()
    return np.asarray(flat, kind).reshape(len(column), -1)


def _settled(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest place that each of n places reaches over the given pairs."""
    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, a, root[b])
        np.minimum.at(new, b, root[a])
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _near_in_tile(x: np.ndarray, norm: np.ndarray, rows: np.ndarray, cols: np.ndarray, similar: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a row and a column that may be similar, in blocks of a matrix product."""
    for at in range(0, len(rows), 500):
        r = rows[at : at + 500]
        a, b = np.nonzero((x[r] @ x[cols].T) / (norm[r][:, None] * norm[cols][None, :]) >= similar - 1e-9)
        yield r[a], cols[b]


def _near_in_buckets(x: np.ndarray, norm: np.ndarray, bucket: np.ndarray, similar: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places within each run of equal buckets: all pairs of short runs, one distance after the other, and those of long ones that may be similar."""
    first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    size = np.diff(np.append(first, len(bucket)))
    for a, n in zip(first[size >= BLOCK_ROWS].tolist(), size[size >= BLOCK_ROWS].tolist()):
        for p, q in _near_in_tile(x, norm, np.arange(a, a + n), np.arange(a, a + n), similar):
            yield p[p < q], q[p < q]
    at, step = np.flatnonzero(np.repeat(size < BLOCK_ROWS, size)), 1
    while len(at):
        at = at[at + step < len(bucket)]
        at = at[bucket[at] == bucket[at + step]]
        yield at, at + step
        step += 1


def _links(table: pa.Table, similar: float, tables: int) -> pa.Table:
    """Counts and spanning links of one pair of tiles, or of the small buckets that share a bin."""
    table = table.sort_by([("dim", "ascending"), ("bucket", "ascending"), ("label", "ascending"), ("rep", "ascending")])
    i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
    tiled = table.column("bin")[0].as_py() is None
    parts = []
    for dim in pc.unique(table.column("dim")).to_pylist():
        t = table.filter(pc.equal(table.column("dim"), dim))
        parts.append(_links_of(t, similar, tables, tiled, i, j))
    return pa.concat_tables(parts)


def _links_of(table: pa.Table, similar: float, tables: int, tiled: bool, i: int, j: int) -> pa.Table:
    rep, many, tile, bucket, label = (np.asarray(table.column(c)) for c in ("rep", "many", "tile", "bucket", "label"))
    group = np.cumsum(np.append(True, (bucket[1:] != bucket[:-1]) | (label[1:] != label[:-1])))
    x = _matrix(table.column("embedding").combine_chunks())
    own = _matrix(table.column("buckets").combine_chunks(), np.int64)
    own = own.reshape(len(own), tables, -1)
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    near = _near_in_tile(x, norm, np.flatnonzero(tile == i), np.flatnonzero(tile == j), similar) if tiled else _near_in_buckets(x, norm, group, similar)
    left, right, links = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], np.zeros(len(rep), np.int64)
    for a, b in near:
        if tiled and i == j:
            a, b = a[a < b], b[a < b]
        for at in range(0, len(a), 20_000):
            p, q = a[at : at + 20_000], b[at : at + 20_000]
            good = np.einsum("ij,ij->i", x[p], x[q]) / (norm[p] * norm[q]) >= similar
            p, q = p[good], q[good]
            left.append(p)
            right.append(q)
            both = (own[p][:, :, :, None] == own[q][:, :, None, :]).any(3)  # a bucket's number begins with its table's
            shared = np.where(both, own[p], np.iinfo(np.int64).max).min((1, 2))
            p, q = p[shared == bucket[p]], q[shared == bucket[p]]
            np.add.at(links, p, many[q])
            np.add.at(links, q, many[p])
    names, place = np.unique(rep, return_inverse=True)  # a vector has a row for each of its buckets in the bin
    root = names[_settled(len(names), place[np.concatenate(left)], place[np.concatenate(right)])]
    links = np.bincount(place, links, len(names)).astype(np.int64)
    out = (links > 0) | (root != names)
    return pa.table({"rep": names[out], "links": links[out], "root": root[out]})


def deduplicate(vectors: DataFrame, similar: float = SIMILAR, tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors (vec_id, embedding, label)."""
    rows = vectors.select("vec_id", "embedding", "label")
    hashes = lambda other: {"h1": F.when(other, F.xxhash64("vec_id")).otherwise(F.xxhash64("embedding")), "h2": F.when(~other, F.xxhash64(F.lit("second"), "embedding"))}
    unfit = ~(F.coalesce(_fine(), F.lit(False)) & F.col("label").isNotNull())
    rows = rows.withColumns(hashes(unfit))
    same = ["label", "h1", "h2"]
    reps = rows.where("h2 IS NOT NULL").groupBy(*same).agg(F.min("vec_id").alias("rep"), F.count("*").alias("many"), F.min_by("embedding", "vec_id").alias("embedding")).where("rep IS NOT NULL")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            sizes = np.asarray([len(x) for x in table.column("embedding")])
            for d in np.unique(sizes):
                part = table.filter(pa.array(sizes == d)).combine_chunks()
                x = _matrix(part.column("embedding").combine_chunks())
                keys = pa.array(list(buckets(x, tables, probes)), pa.list_(pa.int64()))
                yield from part.append_column("buckets", keys).append_column("dim", pa.array(np.full(len(x), d, np.int32))).to_batches()

    kinds = "label {}, h1 long, h2 long, rep long, many long, embedding {}, buckets array<long>, dim int".format(*(dict(rows.dtypes)[c] for c in ("label", "embedding")))
    reps = cut(reps.select(*same, "rep", "many", "embedding").mapInArrow(hashed, kinds), "vectors")
    bucket = ["label", "dim", "bucket"]
    ids = reps.select("label", "dim", "rep", F.explode(F.array_distinct("buckets")).alias("bucket"))
    sizes = ids.groupBy(*bucket).agg(F.count("*").alias("n")).where("n > 1")
    met = cut(ids.join(sizes, bucket).withColumn("tiles", F.ceil(F.col("n") / TILE_ROWS).cast("int")), "met")
    bins = max(partitions(vectors), met.count() // BIN_ROWS)
    met = met.withColumn("tile", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    met = met.withColumn("other", other).withColumns({"i": F.least("tile", "other"), "j": F.greatest("tile", "other")}).drop("other")
    hot = F.col("tiles") > 1  # such a bucket has tasks of its own, the others share bins
    met = met.withColumns({"own": F.when(hot, F.xxhash64(*bucket)), "bin": F.when(~hot, F.pmod(F.xxhash64(*bucket), F.lit(bins)))}).drop("tiles", "n")
    met = met.join(reps.select("rep", "many", "embedding", "buckets"), "rep")
    found = met.groupBy("own", "bin", "i", "j").applyInArrow(lambda t: _links(t, similar, tables), "rep long, links long, root long")
    found = cut(found, "vector-links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    comp = components(found.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")))
    reps = reps.select(*same, "rep", "many").join(links, "rep", "left").join(comp.withColumnRenamed("id", "rep"), "rep", "left")
    reps = reps.select(*same, (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = rows.drop("embedding").join(reps, same, "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
