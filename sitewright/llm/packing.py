"""Best-fit packing by bin completion over the histogram of piece lengths.

Only lengths decide a packing, so the search runs on their histogram, which has
at most ``capacity`` rows however many documents there are. For the largest
length left, undominated fillings of the rest of its bin are enumerated by
branch and bound: best fit gives the incumbent, a filling that must waste at
least as much is pruned, and the best filling is used as often as the counts
allow, which uses up a length each time. Documents then take the places of
their length by rank; ranks come from counts per (length, part), so a length
that a third of all documents share is split over many tasks.

Results: a null text is the empty text, with the closing id only; a document
over the capacity is cut, its first piece being the shorter one; equal rows are
packed one by one; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitewright.llm.common import keep

CAPACITY = 2048
#: Steps of the search over bins after it first turns back, if its packing isn't known to be the least.
SEARCH_STEPS = 2_000
_LOADED: dict[str, object] = {}


class Encoder:
    """Ids of the tokenizers file; texts without its special strings go through the same vocabulary as ranks."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.special = sorted(self.whole.get_added_tokens_decoder().values(), key=lambda t: t.content)
        self.special = [t.content for t in self.special]
        self.ranked = self._ranked(path)

    def _ranked(self, path: str):
        """The file's vocabulary in the faster library, where it is byte-level BPE with the usual pattern."""
        import json

        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        if model["model"].get("type") != "BPE" or model["pre_tokenizer"].get("type") != "ByteLevel" or model["pre_tokenizer"].get("add_prefix_space") or model.get("normalizer"):
            return None
        printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        letter = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
        ranks = {bytes(letter[c] for c in piece): i for piece, i in model["model"]["vocab"].items() if piece not in self.special}
        return tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self.ranked is not None and not any(s in text for s in self.special):
            try:
                return np.array(self.ranked.encode_ordinary(text), "<u4")
            except BaseException as e:  # the library's panic on a run it can't match is no Exception
                if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                    raise
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4")


def encoder(path: str) -> Encoder:
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]  # type: ignore[return-value]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and with ``keep_ids`` the ids of every piece."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                rows: list[tuple] = []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1)):
                    ids = np.append(enc.ids(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                    first = len(ids) % capacity or capacity
                    cuts = [0, *range(first, len(ids) + 1, capacity)]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        rows.append((doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes()), ids[a:b].astype(np.int32))[: 6 if keep_ids else 5])
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 6 if keep_ids else 5]
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(len(names))], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _reach(room: int, lengths: list[int], counts: dict[int, int]) -> list[int]:
    """For each i, as bits, the sums up to ``room`` that the first i lengths give within their counts."""
    out, mask = [1], (1 << (room + 1)) - 1
    for n in lengths:
        r, left, step = out[-1], min(counts[n], room // n), 1
        while left > 0:
            k = min(step, left)
            r |= (r << (n * k)) & mask
            left, step = left - k, 2 * step
        out.append(r)
    return out


def _sums(total: int, top: int, lengths: list[int], counts: dict[int, int], reach: list[int]) -> Iterator[list[int]]:
    """All choices of the first ``top`` lengths with this sum, those of larger lengths first."""
    if total == 0:
        yield []
        return
    for i in range(min(top, bisect_right(lengths, total)) - 1, -1, -1):
        n = lengths[i]
        for k in range(min(counts[n], total // n), 0, -1):
            if reach[i] >> (total - k * n) & 1:
                for rest in _sums(total - k * n, i, lengths, counts, reach):
                    yield [n] * k + rest


def _filling(room: int, lengths: list[int], counts: dict[int, int]) -> list[int]:
    """Lengths, largest first, that waste least of ``room``, exactly; ``lengths`` ascending."""
    best: list[int] = []
    rest, at = room, bisect_right(lengths, room)
    while at:  # best fit: the largest that fits, again and again
        n = lengths[at - 1]
        k = min(counts[n], rest // n)
        best += [n] * k
        rest -= k * n
        at = min(at - 1, bisect_right(lengths, rest))
    if rest == 0:
        return best
    reach = _reach(room, lengths[: bisect_right(lengths, room)], counts)
    return next(_sums(reach[-1].bit_length() - 1, len(reach) - 1, lengths, counts, reach))


def _fillings(room: int, lengths: list[int], counts: dict[int, int]) -> Iterator[list[int]]:
    """All undominated fillings, those of least waste first."""
    first = _filling(room, lengths, counts)
    yield first
    lengths = lengths[: bisect_right(lengths, room)]
    reach = _reach(room, lengths, counts)
    for total in range(reach[-1].bit_length() - 1, -1, -1):
        if reach[-1] >> total & 1:
            for found in _sums(total, len(lengths), lengths, counts, reach):
                if found != first and all(found.count(n) == counts[n] for n in lengths[: bisect_right(lengths, room - total)]):
                    yield found


def fewest(counts: dict[int, int], capacity: int = CAPACITY) -> int:
    """A lower bound of the number of bins (Martello and Toth's second)."""
    lengths = sorted(n for n, c in counts.items() if c > 0)
    best = 0
    for least in [0, *(n for n in lengths if 2 * n <= capacity)]:
        alone = sum(counts[n] for n in lengths if n > capacity - least)
        halves = [n for n in lengths if 2 * n > capacity and n <= capacity - least]
        held = sum(counts[n] for n in halves)
        spare = held * capacity - sum(n * counts[n] for n in halves)
        small = sum(n * counts[n] for n in lengths if least <= n and 2 * n <= capacity)
        best = max(best, alone + held + max(0, -(-(small - spare) // capacity)))
    return best


def _best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Best fit decreasing, with equal bins as one."""
    bins: dict[tuple[int, ...], int] = {}
    rooms: dict[int, list[tuple[int, ...]]] = {}
    for n in sorted(histogram, reverse=True):
        left = histogram[n]
        while left:
            room = min((r for r in rooms if r >= n), default=None)
            if room is None:
                old, many = (), -(-left // (capacity // n))
            else:
                old = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room]
                many = bins.pop(old)
            room = capacity if room is None else room
            k = min(room // n, left)
            use = min(many, left // k)
            for new, times in ((old + (n,) * k, use), (old, many - use)):
                if times and new:
                    if new not in bins:
                        rooms.setdefault(capacity - sum(new), []).append(new)
                    bins[new] = bins.get(new, 0) + times
            left -= k * use
    return [(list(b), times) for b, times in bins.items()]


def complete_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """(lengths of a bin, how many such bins), in the order in which they were made.

    Depth first over the fillings of the largest length's bin and how often
    each is used, against the best packing so far (best fit at first). It ends
    when that meets the lower bound, when all branches are closed, or
    SEARCH_STEPS steps after the first time that it turned back.
    """
    counts = {n: c for n, c in histogram.items() if c > 0}
    best = _best_fit(counts, capacity)
    most, bound = sum(t for _, t in best), fewest(counts, capacity)
    left, used, steps = sum(n * c for n, c in counts.items()), 0, 0
    plan: list[tuple[list[int], int]] = []

    def moves() -> Iterator[tuple[list[int], int]]:
        lengths = sorted(n for n, c in counts.items() if c)
        large = lengths[-1]
        held = dict(counts)
        held[large] -= 1
        for rest in _fillings(capacity - large, lengths, held):
            bin_ = [large, *rest]
            for times in range(min(counts[n] // bin_.count(n) for n in set(bin_)), 0, -1):
                yield bin_, times

    def put(bin_: list[int], times: int) -> None:
        nonlocal left, used
        for n in bin_:
            counts[n] -= times
        left -= times * sum(bin_)
        used += times

    open_: list[Iterator[tuple[list[int], int]]] = [moves()] if counts else []
    while open_ and steps <= SEARCH_STEPS:
        steps += steps > 0
        move = next(open_[-1], None)
        if move is None:
            open_.pop()
            if plan:
                bin_, times = plan.pop()
                put(bin_, -times)
            continue
        put(*move)
        plan.append(move)
        closed = left == 0
        # a first packing as small as best fit's is taken for it
        if closed and (used < most or (used == most and not steps)):
            best, most = list(plan), used
            if most <= bound:
                break
        if closed or used + -(-left // capacity) >= most + (not steps):
            steps = max(steps, 1)
            bin_, times = plan.pop()
            put(bin_, -times)
        else:
            open_.append(moves())
    return best


def _places(plan: list[tuple[list[int], int]]) -> pd.DataFrame:
    """For each length and rank range: the first sequence, its step and the offset there."""
    rows, taken, first = [], {}, 0
    for bin_, times in plan:
        offset = 0
        for n in bin_:
            at = taken.get(n, 0)
            rows.append((n, at, at + times, first, offset))
            taken[n] = at + times
            offset += n
        first += times
    return pd.DataFrame(rows, columns=["length", "rank_from", "rank_to", "first_sequence", "offset"])


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to pieces (doc_id, piece, length, ...)."""
    spark = found.sparkSession
    found = found.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(64)).cast("int"))
    counts = found.groupBy("length", "part").count()
    counts = counts.withColumn("before", F.sum("count").over(Window.partitionBy("length").orderBy("part")) - F.col("count"))
    histogram = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}  # a row for each length
    places = _places(complete_bins(histogram, capacity))
    schema = "length long, rank_from long, rank_to long, first_sequence long, offset long"
    places = spark.createDataFrame(places, schema) if len(places) else spark.createDataFrame([], schema)
    rank = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "start")) - 1
    ranked = found.withColumn("nth", rank).join(counts.drop("count"), ["length", "part"])  # rows lie by these keys already
    ranked = ranked.withColumn("rank", F.col("before") + F.col("nth")).drop("before", "nth", "part")
    # a length has a few ranges of ranks, which a broadcast bounded by the capacity holds
    placed = ranked.join(F.broadcast(places), (ranked["length"] == places["length"]) & F.col("rank").between(F.col("rank_from"), F.col("rank_to") - 1)).drop(places["length"])
    return placed.withColumn("sequence_id", F.col("first_sequence") + F.col("rank") - F.col("rank_from")).drop("rank", "rank_from", "rank_to", "first_sequence")


def packed(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece."""
    out = pack(keep(pieces(docs, tokenizer, capacity)), capacity)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
