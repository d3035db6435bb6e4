"""N-gram Jaccard join with signature trees, exact.

1. Every document becomes its set of hashed word shingles; equal sets fold into
   their smallest document at once.
2. A set that links with another one lacks at most ``m`` of its shingles there.
   So of its 2m+1 smallest hashes at least m+1 are shared, and each set sends
   so many that those of every possible partner are among them; sets with fewer
   shared ones (counted in bins of the hash range, with a pre-aggregation in
   every slice) are out; hashes that agree by chance only let more sets in.
3. The remaining sets meet in blocks by their m+1 smallest hashes, of which two
   linked sets share one. First each set is verified against the block head
   that it meets most often; that settles large groups of near copies with one
   pair per document.
4. In each block that still holds several components a signature tree is built:
   its leaves hold the bitmap of a document's shingles, inner nodes the OR of
   their children and the range of their sizes. A traversal of the tree with
   itself drops pairs of nodes of one component, of incompatible sizes, or
   whose greatest possible overlap is too small. What reaches the leaves is
   verified on whole sets. A block beyond TILE_ROWS is searched as pairs of
   tiles, so that no task holds more than two of them.

Results: a document without words, or a null text, is a class of its own with no
shingles; one with fewer words than a shingle has its whole sequence as its
only one; repeated rows and equal texts are linked; a null doc_id is never a
class's name; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewright.llm.common import cut, keep, partitions
from sitewright.llm.textkernel import Words, mix, slices, trim
from sitewright.operators.graphs import components

#: Shingles to a bin of the count in step 2, as expected.
BIN_ROWS = 2_000_000
TILE_ROWS = 2_000
#: Pairs of one document that are verified together.
PAIR_ROWS = 250
BITS = 4_096
FANOUT = 8
_NONE = np.zeros(0, np.uint64)


def shingle_sets(texts: list[bytes | None], words: int) -> list[np.ndarray]:
    """For each text its distinct shingles' hashes, ascending."""
    w = Words(texts, lower=True)
    at, h = w.grams(words)
    bounds = np.searchsorted(at, w.first)
    size = np.diff(w.first)
    short = np.flatnonzero((size > 0) & (size < words))
    few = dict(zip(short.tolist(), w.runs(w.first[short], w.first[short] + size[short])))
    out = []
    for i in range(len(texts)):
        if i in few:
            out.append(few[i].reshape(1))
        else:
            s = np.sort(h[bounds[i] : bounds[i + 1]])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else _NONE)
    return out


def _missing(n: np.ndarray, percent: int) -> np.ndarray:
    """How many of a set's n shingles a linked set may lack at most."""
    return (100 - percent) * n // 100


@lru_cache(100_000)
def _sent(n: int, percent: int) -> int:
    """How many of its smallest hashes a set of n shingles sends.

    A linked set of k shingles needs m(k)+1 shared hashes. The first m(k)+1 of
    them have at most n - c others of this set before them, where c is the
    least overlap of linked sets of these sizes.
    """
    m = int(_missing(np.int64(n), percent))
    k = np.arange(-(-percent * n // 100), 100 * n // percent + 1)  # sizes of linked sets
    c = -(-percent * (n + k) // (100 + percent))
    reach = int((_missing(k, percent) + 1 + n - c).max(initial=0))
    return min(n, max(2 * m + 1, reach))


def _sketch(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, n, h1, h2 (the set's name) and its smallest hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch):
                sets = shingle_sets(texts, words)
                n = np.array([len(s) for s in sets])
                h1 = np.array([np.add.reduce(mix(s)) for s in sets], np.uint64) ^ n.astype(np.uint64)
                h2 = np.array([np.add.reduce(mix(s ^ np.uint64(0xA5A5A5A5))) for s in sets], np.uint64)
                low = [s[: _sent(len(s), percent)].tobytes() for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(low, pa.binary())], names=["doc_id", "n", "h1", "h2", "low"]
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, h1 long, h2 long, low binary")


def _shared_counts(sketch: DataFrame, bins: int) -> DataFrame:
    """name, shared: how many of a set's smallest hashes another set has too, or more where hashes of one set agree in their low half."""
    width = np.uint64(((1 << 64) - 1) // bins)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4000):
                part = batch.slice(at, 4000)
                names, first = np.unique(np.asarray(part.column(0)), return_index=True)
                lows = part.column(1).take(pa.array(first)).to_pylist()
                size = [len(x) // 8 for x in lows]
                # a set's smallest hashes are small numbers, which would share few bins
                h, who = mix(np.frombuffer(b"".join(lows), np.uint64)), np.repeat(np.arange(len(names), dtype=np.int32), size)
                order = np.argsort(h, kind="stable")
                h, who = h[order], who[order]
                head = np.ones(len(h), bool)
                head[1:] = h[1:] != h[:-1]
                group = np.cumsum(head) - 1
                many = np.bincount(group) > 1 if len(h) else np.zeros(0, bool)
                known = np.bincount(who[many[group]], minlength=len(names))  # shared within this part
                # a hash that is shared here needs one witness elsewhere, which stands for no set (-1)
                h, who = h[head], np.where(many, -1, who[head])
                to = (h // width).astype(np.int64)
                # hashes of one set with one low half would count once below, so all but the first count here
                order = np.lexsort((h.astype(np.uint32), to, who))
                alike = (np.diff(who[order]) == 0) & (np.diff(to[order]) == 0) & (np.diff(h[order].astype(np.uint32).astype(np.int64)) == 0) & (who[order][1:] >= 0)
                np.add.at(known, who[order][1:][alike], 1)
                some = np.flatnonzero(known)
                cuts = np.flatnonzero(np.diff(to, prepend=-1))
                named = np.where(who < 0, np.int64(0), names[who]) if len(names) else np.zeros(0, np.int64)
                rows = [(int(to[a]), h[a:b].astype(np.uint32).tobytes(), (who[a:b] < 0).tobytes(), named[a:b].tobytes()) for a, b in zip(cuts, [*cuts[1:], len(h)])]
                if len(some):  # nothing gathers bins below 0
                    rows.append((-1 - (int(names[some[0]]) & 0xFFFFFFFF), known[some].astype(np.uint32).tobytes(), b"", names[some].tobytes()))
                cols = list(zip(*rows)) or [(), (), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=["bin", "hashes", "witness", "names"])

    def dealt(names: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
        """Rows (bin, names, shared): counts by bins of names."""
        to = (mix(names.view(np.uint64)) // width).astype(np.int64)
        order = np.argsort(to, kind="stable")
        to, names, times = to[order], names[order], times[order].astype(np.int64)
        cuts = np.flatnonzero(np.diff(to, prepend=-1)).tolist()
        ends = [*cuts[1:], len(to)]
        cols = [pa.array(to[cuts]), *(pa.array([x[a:b].tobytes() for a, b in zip(cuts, ends)], pa.binary()) for x in (names, times))]
        return pa.RecordBatch.from_arrays(cols, names=["bin", "names", "shared"])

    def counted(hashes: list[bytes], witness: list[bytes], names: list[bytes]) -> pa.RecordBatch:
        h, seen, name = np.frombuffer(b"".join(hashes), np.uint32), np.frombuffer(b"".join(witness), bool), np.frombuffer(b"".join(names), np.int64)
        found = []
        for k in range(16):  # a part of the bin's hashes at a time, to sort little at once
            own = np.flatnonzero(h >> np.uint32(28) == k)
            if len(own):
                found.append(shared_names(h[own], seen[own], name[own]))
        out, place = np.unique(np.concatenate([np.zeros(0, np.int64), *(f[0] for f in found)]), return_inverse=True)
        return dealt(out, np.bincount(place, np.concatenate([np.zeros(0), *(f[1] for f in found)]), len(out)))

    def by_bin(batches: Iterator[pa.RecordBatch], past: Callable, whole: Callable) -> Iterator[pa.RecordBatch]:
        """``whole`` of the columns of each bin, whose rows follow each other; rows of bins below 0 go through ``past``."""
        now, held = None, []
        for batch in batches:
            for to, *cols in zip(*(c.to_pylist() for c in batch.columns)):
                if to < 0:
                    yield past(*cols)
                    continue
                if to != now and held:
                    yield whole(*map(list, zip(*held)))
                    held = []
                    trim()
                now = to
                held.append(cols)
        if held:
            yield whole(*map(list, zip(*held)))
            trim()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from by_bin(batches, lambda h, _, n: dealt(np.frombuffer(n, np.int64), np.frombuffer(h, np.uint32)), counted)

    def summed(names: list[bytes], times: list[bytes]) -> pa.RecordBatch:
        out, place = np.unique(np.frombuffer(b"".join(names), np.int64), return_inverse=True)
        total = np.bincount(place, np.frombuffer(b"".join(times), np.int64), len(out)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(out), pa.array(total)], names=["name", "shared"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from by_bin(batches, summed, summed)

    def shared_names(h: np.ndarray, witness: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((name, h))
        h, witness, name = h[order], witness[order], name[order]
        head = np.ones(len(h), bool)
        head[1:] = h[1:] != h[:-1]
        group = np.cumsum(head) - 1
        fresh = np.ones(len(h), bool)  # a set that came in several parts counts once
        fresh[1:] = head[1:] | (name[1:] != name[:-1]) | witness[:-1]
        fresh &= ~witness
        n = np.bincount(group, fresh) + 2 * (np.bincount(group, witness) > 0)
        return np.unique(name[fresh & (n[group] > 1)], return_counts=True)

    # the rows of a bin follow each other, so a task holds one bin
    together = lambda df: df.repartition("bin").sortWithinPartitions("bin")
    hashes = sketch.select("h1", "low").mapInArrow(deal, "bin long, hashes binary, witness binary, names binary")
    counts = together(hashes).mapInArrow(count, "bin long, names binary, shared binary")
    return together(counts).mapInArrow(total, "name long, shared long")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough; the set of ``a`` is sent once for PAIR_ROWS pairs of it."""
    pairs = cut(pairs, "pairs")
    tiles = pairs.groupBy("a").agg(F.ceil(F.count("*") / PAIR_ROWS).cast("int").alias("tiles"))
    left = tiles.select(F.col("a").alias("doc_id"), "a", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"), F.lit(None).cast("long").alias("b"))
    right = pairs.join(tiles, "a").select(F.col("b").alias("doc_id"), "a", F.pmod(F.xxhash64("b"), F.col("tiles")).cast("int").alias("tile"), "b")
    both = left.unionByName(right).join(sets.select("doc_id", "set"), "doc_id")  # sets move once for both ends

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = np.zeros(0, np.uint64)
        for batch in batches:
            good = []
            for b, x in zip(batch.column(1).to_pylist(), batch.column(2)):
                q = np.frombuffer(x.as_buffer(), np.uint64)
                if b is None:
                    p = q
                    good.append(False)
                    continue
                few, lot = (p, q) if len(p) < len(q) else (q, p)
                common = int((lot[np.minimum(np.searchsorted(lot, few), len(lot) - 1)] == few).sum())
                good.append(100 * common >= percent * (len(p) + len(q) - common))
            yield batch.filter(pa.array(good, pa.bool_())).select(["a", "b"])

    both = both.select("a", "tile", "b", "set").repartition("a", "tile").sortWithinPartitions("a", "tile", F.col("b").asc_nulls_first())
    return both.select("a", "b", "set").mapInArrow(run, "a long, b long")


def _bitmap(s: np.ndarray) -> np.ndarray:
    bits = np.zeros(BITS, bool)
    bits[(s & np.uint64(BITS - 1)).astype(np.int64)] = True
    return np.packbits(bits).view(np.uint64)


class SignatureTree:
    """Levels of nodes over documents sorted by size; level 0 are the documents."""

    def __init__(self, bitmap: np.ndarray, size: np.ndarray, component: np.ndarray):
        bits = np.bitwise_count(bitmap).sum(1).astype(np.int64)
        self.levels = [{"bits": bitmap, "low": size, "high": size, "excess": size - bits, "c0": component, "c1": component}]
        while len(self.levels[-1]["low"]) > 1:
            last = self.levels[-1]
            at = np.arange(0, len(last["low"]), FANOUT)
            self.levels.append({
                "bits": np.bitwise_or.reduceat(last["bits"], at), "low": np.minimum.reduceat(last["low"], at), "high": np.maximum.reduceat(last["high"], at),
                "excess": np.maximum.reduceat(last["excess"], at), "c0": np.minimum.reduceat(last["c0"], at), "c1": np.maximum.reduceat(last["c1"], at),
            })

    def pairs(self, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Places x <= y of documents that may be linked, from the root paired with itself downwards."""
        x = y = np.zeros(1, np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            if depth < len(self.levels) - 1:
                below = len(self.levels[depth]["low"])
                step = np.arange(FANOUT)
                x = np.repeat((x[:, None] * FANOUT + step), FANOUT, axis=1).reshape(-1)
                y = np.tile((y[:, None] * FANOUT + step), FANOUT).reshape(-1)
                inside = (x < below) & (y < below) & (x <= y)
                x, y = x[inside], y[inside]
            keep = [self._may_link(depth, x[i : i + 50_000], y[i : i + 50_000], percent) for i in range(0, len(x), 50_000)]
            keep = np.concatenate(keep) if keep else np.zeros(0, bool)
            x, y = x[keep], y[keep]
        return x[x < y], y[x < y]

    def _may_link(self, depth: int, x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
        n = self.levels[depth]
        one = (n["c0"][x] == n["c1"][x]) & (n["c0"][y] == n["c1"][y]) & (n["c0"][x] == n["c0"][y])
        sizes = (100 * n["high"][x] >= percent * n["low"][y]) & (100 * n["high"][y] >= percent * n["low"][x])
        ok = ~one & sizes
        x, y = x[ok], y[ok]
        common = np.bitwise_count(n["bits"][x] & n["bits"][y]).sum(1).astype(np.int64)
        most = common + np.minimum(n["excess"][x], n["excess"][y])  # shingles that can be in both
        # overlap / (a + b - overlap) >= percent / 100, for the smallest sizes in the nodes
        enough = (100 + percent) * most >= percent * (n["low"][x] + n["low"][y])
        ok[ok] = enough
        return ok


def _tree_pairs(blocks: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs from rows (token, i, j, tile, doc, n, component, bits), which come sorted by block."""

    def block(token: tuple, t: pa.Table, found: set) -> None:
        _, i, j = token
        doc, tile = np.asarray(t.column("doc")), np.asarray(t.column("tile"))
        comp = np.asarray(t.column("component"))
        if len(doc) < 2 or (comp == comp[0]).all():
            return
        n = np.asarray(t.column("n"))
        order = np.lexsort((doc, n))
        bits = np.frombuffer(b"".join(t.column("bits").to_pylist()), np.uint64).reshape(len(doc), -1)[order]
        x, y = SignatureTree(bits, n[order], comp[order]).pairs(percent)
        x, y = order[x], order[y]
        here = (np.minimum(tile[x], tile[y]) == i) & (np.maximum(tile[x], tile[y]) == j)
        a, b = doc[x[here]], doc[y[here]]
        found.update(zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist()))

    def flush(found: set) -> pa.RecordBatch:
        pairs = sorted(found)
        found.clear()
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        found: set = set()
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if held is None else pa.concat_tables([held, t])
            key = np.stack([np.asarray(t.column(c)).astype(np.int64) for c in ("token", "i", "j")], 1)
            edge = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
            cuts = [0, *edge.tolist()]
            for a, b in zip(cuts, cuts[1:]):
                block(tuple(key[a]), t.slice(a, b - a), found)
            held = t.slice(cuts[-1])  # the last block may go on
            if len(found) > 200_000:
                yield flush(found)
        if held is not None and held.num_rows:
            block(tuple(int(held.column(c)[0].as_py()) for c in ("token", "i", "j")), held.combine_chunks(), found)
        yield flush(found)

    return blocks.mapInArrow(run, "a long, b long").distinct()


def join(docs: DataFrame, words: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs (doc_id, text)."""
    sketch = keep(_sketch(docs, words, percent))
    named = sketch.where("n > 0 AND doc_id IS NOT NULL")
    reps = named.groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("rep"))
    tokens = named.agg(F.sum(F.octet_length("low")) / 8).first()[0] or 0
    shared = _shared_counts(named, max(partitions(docs), int(tokens // BIN_ROWS)))
    lacks = F.floor(F.col("n") * (100 - percent) / 100)
    able = reps.join(shared, reps["h1"] == shared["name"]).where(F.col("shared") >= F.least(F.col("n"), 2 * lacks + 1) - lacks).select("rep", "n")
    able = cut(able, "able")

    # whole sets and bitmaps of what is left, from the texts
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch):
                sets = shingle_sets(texts, words)
                low = [s[: m + 1].view(np.int64) for s, m in zip(sets, _missing(np.array([len(s) for s in sets]), percent))]
                cols = [pa.array(low, pa.list_(pa.int64())), pa.array([_bitmap(s).tobytes() for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), *cols], names=["doc_id", "n", "low", "bits", "set"])

    # ``able`` grows with the corpus, so texts move to it by one plan at every size
    left = docs.select("doc_id", "text").join(able.select(F.col("rep").alias("doc_id")).hint("merge"), "doc_id", "left_semi")
    sets = keep(left.mapInArrow(whole, "doc_id long, n long, low array<long>, bits binary, set binary"))

    rows = sets.select("doc_id", "n", F.explode("low").alias("token"))
    heads = rows.groupBy("token").agg(F.min("doc_id").alias("head"), F.count("*").alias("many")).where("many > 1")
    blocks = keep(rows.join(heads, "token").select("token", F.col("doc_id").alias("doc"), "n", "head", "many"))
    meets = blocks.where("doc <> head").groupBy("doc", "head").count()
    best = meets.groupBy("doc").agg(F.max_by("head", F.struct("count", -F.col("head"))).alias("head"))
    first = cut(_verified(best.select(F.col("head").alias("a"), F.col("doc").alias("b")), sets, percent), "first-links")

    settled = components(first).withColumnRenamed("id", "doc")
    labelled = blocks.drop("head").join(settled, "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    labelled = cut(labelled, "labelled")
    mixed = labelled.groupBy("token").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 <> c1").select("token")
    open_ = labelled.join(mixed, "token", "left_semi").withColumn("tiles", F.ceil(F.col("many") / TILE_ROWS).cast("int"))
    open_ = open_.withColumn("tile", F.pmod(F.xxhash64("doc"), F.col("tiles")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    open_ = open_.select("token", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "doc", "n", "component")
    open_ = open_.join(sets.select(F.col("doc_id").alias("doc"), "bits"), "doc").repartition("token", "i", "j").sortWithinPartitions("token", "i", "j")
    more = _verified(_tree_pairs(open_, percent), sets, percent)

    comp = components(first.unionByName(cut(more, "more-links"))).withColumnRenamed("id", "rep")
    reps = reps.join(comp, "rep", "left").select("n", "h1", "h2", F.coalesce("component", "rep").alias("component"))
    return sketch.select("doc_id", "n", "h1", "h2").join(reps, ["n", "h1", "h2"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
