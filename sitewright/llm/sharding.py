"""Sharding by sampled splitters, with DataFrame functions only. Law: ``bytes``.

The key of a record is (hash of its text, hash of its id, id), so equal texts
are neighbours. A size-weighted sample of text hashes gives quantile splitters;
records fall into the ranges between them, RANGES_PER_SHARD to a shard. A range
over WINDOW_BYTES is subdivided by a second hash of the text, and a single text
whose copies pass that by themselves by a hash of the id. Exact sums of ranges
and of their parts then say where each of them begins in the running total of
bytes. A range or part that lies inside of a shard goes there whole; one that a
shard's boundary cuts is divided at the group of equal texts that the boundary
meets, so shard sizes differ by about one document, however uneven the sample
was. A group of equal texts that is small beside a shard goes to the shard that
its middle falls into; larger ones are divided between records.

Results: a null text counts no bytes and has the checksum of the empty text;
equal rows are placed one by one; an empty table gives an empty result; rows
with a null doc_id are kept; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitewright.llm.common import cut

#: Expected rows of the sample for each range.
SAMPLED_PER_RANGE = 24
#: Ranges for each shard before any is subdivided; with SAMPLED_PER_RANGE the bound of what the driver sees.
RANGES_PER_SHARD = 12
#: Bytes of documents to a window of running sums.
WINDOW_BYTES = 64_000_000
#: Rows of three numbers that a broadcast may hold.
BROADCAST_ROWS = 20_000


def _splitters(recs: DataFrame, total: int, ranges: int) -> list[int]:
    step = max(1.0, total / (ranges * SAMPLED_PER_RANGE))
    unit = F.pmod(F.xxhash64(F.lit("draw"), "doc_id", "h"), F.lit(1 << 30)) / float(1 << 30)
    sample = recs.where(unit * step < F.col("size")).select("h", F.greatest(F.col("size").cast("double"), F.lit(step)).alias("weight"))
    upto = F.sum("weight").over(Window.orderBy("h").rowsBetween(Window.unboundedPreceding, 0))
    nth = F.floor(upto * ranges / F.sum("weight").over(Window.partitionBy()))
    found = sample.select("h", nth.alias("nth")).where(F.col("nth") < ranges).groupBy("nth").agg(F.max("h").alias("h"))
    return sorted({r["h"] for r in found.collect()})


def _range_of(h: Column, splitters: list[int]) -> Column:
    """How many splitters lie below ``h``, found among every 16th first."""
    if not splitters:
        return F.lit(0)
    width = max(1, int(len(splitters) ** 0.5))
    parts = [splitters[i : i + width] for i in range(0, len(splitters), width)]
    count = lambda arr, at: F.size(F.filter(arr, lambda s: s < at))
    coarse = count(F.array(*[F.lit(p[-1]) for p in parts]), h)
    fine = F.array(*[F.array(*[F.lit(x) for x in p]) for p in [*parts, []]][: len(parts)], F.array().cast("array<bigint>"))
    return coarse * width + count(F.element_at(fine, coarse + 1), h)


def shard(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row."""
    text = F.coalesce("text", F.lit(""))
    recs = cut(docs.select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("h"),
    ), "sharding")
    sums = recs.agg(F.sum("size").alias("bytes"), F.max("size").alias("most")).first()
    total, most = sums["bytes"] or 0, sums["most"] or 0
    splitters = _splitters(recs, total, shards * RANGES_PER_SHARD) if total else []
    recs = recs.withColumn("range", _range_of(F.col("h"), splitters))

    cap = float(min(WINDOW_BYTES, max(1, total / shards)))
    parts = lambda size: F.greatest(F.lit(1), F.ceil(size / cap))
    # texts whose copies fill a window by themselves are divided by id; of all others, copies stay together
    large = cut(recs.groupBy("h").agg(F.sum("size").alias("b")).where(F.col("b") > cap).select("h", parts(F.col("b")).alias("tiles")), "large")
    small = large.count() <= BROADCAST_ROWS
    recs = recs.join(F.broadcast(large) if small else large, "h", "left")
    by_range = recs.where("tiles IS NULL").groupBy("range").agg(parts(F.sum("size")).alias("n1"))  # a row for each range
    recs = recs.join(F.broadcast(by_range), "range", "left").withColumns({
        "sub": F.when(F.col("tiles").isNull(), F.pmod(F.xxhash64(F.lit("text"), "h"), F.coalesce("n1", F.lit(1)))).otherwise(F.lit(-1)),
        "alone": F.when(F.col("tiles").isNull(), F.lit(0)).otherwise(F.col("h")),
        "own": F.when(F.col("tiles").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(F.lit("id"), "doc_id", "text_crc32"), F.coalesce("tiles", F.lit(1)))),
    })

    cell = ["range", "sub", "alone", "own"]
    cells = cut(recs.groupBy(*cell).agg(F.sum("size").alias("b"), F.count("*").alias("n")), "cells")
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    over = before(Window.orderBy("range"))  # a row for each range
    ranges = cells.groupBy("range").agg(F.sum("b").alias("rb"), F.sum("n").alias("rn")).select("range", F.coalesce(F.sum("rb").over(over), F.lit(0)).alias("r_b"), F.coalesce(F.sum("rn").over(over), F.lit(0)).alias("r_n"))
    over = before(Window.partitionBy("range").orderBy("sub", "alone", "own"))
    cells = cells.join(F.broadcast(ranges), "range").select(
        *cell, (F.col("r_b") + F.coalesce(F.sum("b").over(over), F.lit(0))).alias("b0"), (F.col("r_n") + F.coalesce(F.sum("n").over(over), F.lit(0))).alias("n0"),
    )
    run = Window.partitionBy(*cell).orderBy("h", "doc_id", "text_crc32").rowsBetween(Window.unboundedPreceding, 0)
    group = Window.partitionBy(*cell, "h")
    placed = recs.withColumns({"upto": F.sum("size").over(run), "nth": F.row_number().over(run)})
    placed = placed.withColumns({"g1": F.max("upto").over(group), "g_b": F.sum("size").over(group)}).join(cells, cell)
    whole = F.col("tiles").isNull() & (F.col("g_b") <= max(most, total / shards / 20))
    middle = F.col("b0") + F.when(whole, F.col("g1") - F.col("g_b") / 2).otherwise(F.col("upto") - F.col("size") / 2)
    placed = placed.select(
        "doc_id", "size", "text_crc32", F.least(F.lit(shards - 1), F.floor(middle * shards / float(total or 1))).cast("int").alias("shard"), (F.col("n0") + F.col("nth") - 1).alias("at"),
    )
    starts = placed.groupBy("shard").agg(F.min("at").alias("from"))
    return placed.join(F.broadcast(starts), "shard").select(  # a row for each shard
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("at") - F.col("from")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
