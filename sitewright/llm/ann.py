"""Approximate nearest neighbours by balanced posting lists.

Centroids are fitted on a bounded sample, so many that a list has ROWS_PER_LIST
vectors of it or fewer, with a load term that keeps lists of about one size.
Every vector goes to its nearest list and, near a boundary, to the next ones
too. The lists of a vector or a query come from a best-first search in a graph
that links each centroid with its nearest ones and is held in memory; a query
reads the lists whose distance is within a ratio of the nearest one's, and more
of them while those hold too few vectors. Lists and their queries are dealt out
in parts of PART_ROWS, so a task holds one part of each. Scores are cosines in
double precision of the original vectors.

Results: vectors that are null, empty, zero or hold null or non-finite parts,
or have another length than most of the sample, take no part; rows with a
query's own id are no candidates of it; a repeated id counts once, with its
best score; fewer candidates than asked for are all returned; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitewright.llm.common import cut
from sitewright.llm.vec_dedup import _matrix, _usable

#: Numbers of the sample that the centroids are fitted on, as expected from a draw by id, and its vectors at most.
SAMPLE_NUMBERS = 8_000_000
SAMPLE_ROWS = 20_000
ROWS_PER_LIST = 64
COPIES = 3
#: How much farther than the nearest list a boundary vector's other lists may lie.
COPY_RATIO = 1.10
#: The same for the lists that a query reads.
QUERY_RATIO = 1.35
PART_ROWS = 1_024
DEGREE = 20
FAR_LINKS = 4
#: Centroids that a search opens at least.
OPENED = 24


def _fitted(x: np.ndarray, lists: int, rounds: int) -> np.ndarray:
    """Centroids of unit vectors by balanced k-means, of parts of them where there are many."""
    if lists > 512:  # parts of about equal size first, then lists of each part
        top = _fitted(x, int(lists**0.5), rounds)
        near = np.concatenate([(x[i : i + 2000] @ top.T).argmax(1) for i in range(0, len(x), 2000)])
        parts = [x[near == i] for i in range(len(top))]
        return np.concatenate([_fitted(p, max(1, round(lists * len(p) / len(x))), rounds) for p in parts if len(p)])
    rng = np.random.default_rng(11)
    lists = max(1, min(lists, len(x)))
    c = x[rng.choice(len(x), lists, replace=False)]
    load = np.ones(lists)
    for _ in range(rounds):
        near = np.concatenate([(x[i : i + 2000] @ c.T - 0.02 * np.log(load)).argmax(1) for i in range(0, len(x), 2000)])
        load = np.bincount(near, minlength=lists) * lists / len(x) + 0.1  # full lists count as farther in the next round
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        norm = np.linalg.norm(sums, axis=1)
        c[norm > 0] = sums[norm > 0] / norm[norm > 0][:, None]
    return c


class Centroids:
    def __init__(self, sample: np.ndarray, lists: int, rounds: int = 8):
        c = self.c = _fitted(sample / np.linalg.norm(sample, axis=1, keepdims=True), lists, rounds)
        near = [np.argsort(-(c[i : i + 1000] @ c.T), axis=1, kind="stable")[:, 1 : DEGREE + 1] for i in range(0, len(c), 1000)]
        far = np.random.default_rng(12).integers(0, len(c), (len(c), FAR_LINKS))  # so that no cluster is an island
        self.links = np.concatenate([np.concatenate(near), far], 1)
        entry, far = [0], c @ c[0]
        while len(entry) < min(32, len(c)):  # entries lie far apart
            entry.append(int(far.argmin()))
            far = np.maximum(far, c @ c[entry[-1]])
        self.entry = np.array(entry)
        #: Vectors whose nearest list it is, once they are counted.
        self.held = np.zeros(len(c), np.int64)

    def nearest(self, x: np.ndarray, ratio: float, most: int | None = None, least: int = 0) -> tuple[list[np.ndarray], int]:
        """Each row's lists within ``ratio`` of its nearest one, nearest first, ``most`` at most, going on until they hold ``least`` vectors; and how many centroids were looked at."""
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        out, seen = [], 0
        for at in range(0, len(x), 64):
            found, n = self._search(x[at : at + 64], ratio, most, least)
            out += found
            seen += n
        return out, seen

    def _search(self, x: np.ndarray, ratio: float, most: int | None, least: int) -> tuple[list[np.ndarray], int]:
        n, lists = len(x), len(self.c)
        dist = np.full((n, lists), np.inf)
        opened = np.zeros((n, lists), bool)
        rows = np.arange(n)
        dist[:, self.entry] = 2 - 2 * x @ self.c[self.entry].T
        live = rows
        while len(live):
            d = dist[live]
            nth = np.partition(d, min(OPENED, lists) - 1, axis=1)[:, min(OPENED, lists) - 1]
            bound = nth if most else np.maximum(nth, ratio * ratio * d.min(1) + 1e-9)  # squared distances
            if least:
                held = np.where(np.isfinite(d), self.held[None, :], 0).sum(1)
                bound = np.where(held < least, np.inf, bound)
            front = ~opened[live] & (d <= bound[:, None]) & np.isfinite(d)
            more = front.any(1)
            live, front = live[more], front[more]
            if not len(live):
                break
            opened[live] |= front
            r, c = np.nonzero(front)
            met = np.zeros((len(live), lists), bool)
            met[np.repeat(r, self.links.shape[1]), self.links[c].reshape(-1)] = True
            r, c = np.nonzero(met & np.isinf(dist[live]))
            if len(r) > 0.1 * met.size:
                found = 2 - 2 * x[live] @ self.c.T
                dist[live[r], c] = found[r, c]
            else:
                dist[live[r], c] = 2 - 2 * np.einsum("ij,ij->i", self.c[c], x[live[r]])
        short = np.flatnonzero(np.where(np.isfinite(dist), self.held, 0).sum(1) < least)
        dist[short] = 2 - 2 * x[short] @ self.c.T  # what the graph didn't reach
        out = []
        for d in dist:
            order = np.argsort(d, kind="stable")[: int(np.isfinite(d).sum())]
            far = np.sqrt(np.maximum(0, d[order]))
            take = int((far <= ratio * far[0] + 1e-9).sum())
            if least:
                take = max(take, int(np.searchsorted(np.cumsum(self.held[order]), least)) + 1)
            out.append(order[: min(take, most or lists)])
        return out, int(np.isfinite(dist).sum())


def _lists_of(df: DataFrame, centroids: Centroids, dim: int, kept: str, ratio: float, most: int | None = None, least: int = 0) -> DataFrame:
    """A row for each list of each vector, ``nth`` by distance; ``kept``: the schema of the other columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = pa.Table.from_batches([batch.slice(at, 256)])
                part = part.filter(pa.array([len(v) == dim for v in part.column("embedding")])).combine_chunks()
                if not part.num_rows:
                    continue
                lists, _ = centroids.nearest(_matrix(part.column("embedding").combine_chunks()), ratio, most, least)
                yield from part.append_column("lists", pa.array([x.tolist() for x in lists], pa.list_(pa.int32()))).to_batches()

    return df.mapInArrow(run, f"{kept}, lists array<int>").select("*", F.posexplode("lists").alias("nth", "list")).drop("lists")


def _scored(queries: pa.Table, rows: pa.Table, k: int) -> pa.Table:
    if not queries.num_rows or not rows.num_rows:
        return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
    rows = rows.sort_by("vec_id")
    ids, q_ids = np.asarray(rows.column("vec_id")), np.asarray(queries.column("query_id"))
    once = np.unique(ids, return_index=True)[1]
    x, q = _matrix(rows.column("embedding").combine_chunks()), _matrix(queries.column("embedding").combine_chunks())
    nx, nq = np.sqrt(np.einsum("ij,ij->i", x, x)), np.sqrt(np.einsum("ij,ij->i", q, q))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for at in range(0, len(q), 256):
        cos = (q[at : at + 256] @ x.T) / (nq[at : at + 256][:, None] * nx[None, :])
        cos[q_ids[at : at + 256][:, None] == ids[None, :]] = -np.inf
        each = np.maximum.reduceat(cos, once, axis=1)
        floor = np.partition(each, -min(k, len(once)), axis=1)[:, -min(k, len(once))]
        for i in range(len(cos)):
            near = np.flatnonzero((cos[i] >= floor[i] - 1e-9) & np.isfinite(cos[i]))
            # the same sum for the same two vectors wherever they meet, so that ties are ties
            exact = np.einsum("ij,ij->i", x[near], np.broadcast_to(q[at + i], x[near].shape).copy()) / (nx[near] * nq[at + i])
            best = np.lexsort((ids[near], -exact))
            best = best[np.sort(np.unique(ids[near][best], return_index=True)[1])][:k]
            out.append((np.full(len(best), q_ids[at + i]), ids[near][best], exact[best]))
    cat = [np.concatenate([o[i] for o in out]) if out else np.zeros(0) for i in range(3)]
    return pa.table({"query_id": pa.array(cat[0], pa.int64()), "vec_id": pa.array(cat[1], pa.int64()), "score": pa.array(cat[2], pa.float64())})


def search(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each row that ``is_query`` selects."""
    rows = _usable(vectors.select("vec_id", "embedding")).where("vec_id IS NOT NULL")
    draw = F.pmod(F.xxhash64(F.lit("centroids"), "vec_id"), F.lit(1 << 30)) / float(1 << 30)
    width = rows.select(F.size("embedding").alias("n")).groupBy("n").count().orderBy(F.desc("count"), "n").first()
    if width is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, total = width["n"], width["count"]  # of most vectors
    rows = rows.where(F.size("embedding") == dim)
    wanted = min(SAMPLE_ROWS, max(1, SAMPLE_NUMBERS // dim))
    sample = np.array([r["embedding"] for r in rows.where(draw < min(1.0, wanted / total)).select("embedding").collect()] or [[1.0] * dim], float)
    centroids = Centroids(sample, min(total, wanted) // ROWS_PER_LIST)

    kind = dict(rows.dtypes)["embedding"]
    postings = cut(_lists_of(rows, centroids, dim, f"vec_id long, embedding {kind}", COPY_RATIO, COPIES), "postings")
    sizes = postings.groupBy("list").agg(F.count("*").alias("n"), F.count(F.when(F.col("nth") == 0, 1)).alias("held")).collect()  # a row for each list, which the sample bounds
    for r in sizes:
        centroids.held[r["list"]] = r["held"]
    row_parts = {r["list"]: -(-r["n"] // PART_ROWS) for r in sizes}
    # k lists could each hold the query's own row, and ids may repeat
    asked = cut(_lists_of(rows.where(is_query).withColumnRenamed("vec_id", "query_id"), centroids, dim, f"query_id long, embedding {kind}", QUERY_RATIO, None, 4 * k), "asked")
    query_parts = {r["list"]: -(-r["count"] // PART_ROWS) for r in asked.groupBy("list").count().collect()}
    whole = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    lists = vectors.sparkSession.createDataFrame([(i, row_parts.get(i, 1), query_parts[i]) for i in query_parts] or [(-1, 1, 1)], "list int, row_parts int, query_parts int")
    lists = F.broadcast(lists)  # a row for each list
    postings = postings.join(lists, "list").withColumn("row_part", F.pmod(F.xxhash64("vec_id"), F.col("row_parts")).cast("int")).withColumn("query_part", whole(F.col("query_parts")))
    asked = asked.join(lists, "list").withColumn("query_part", F.pmod(F.xxhash64("query_id"), F.col("query_parts")).cast("int")).withColumn("row_part", whole(F.col("row_parts")))
    task = ["list", "row_part", "query_part"]
    found = asked.select(*task, "query_id", "embedding").groupBy(*task).cogroup(postings.select(*task, "vec_id", "embedding").groupBy(*task)).applyInArrow(
        lambda q, r: _scored(q, r, k),
        "query_id long, vec_id long, score double",
    )
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
