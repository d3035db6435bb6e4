"""Keyed deduplication, ordered output and synthetic ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitewright.functions import geometry as G
from sitewright.session import cut


def latest(parts: DataFrame, key: Sequence[str], version: str, order: Sequence[str]) -> DataFrame:
    """One row for each key: the highest version, of equal ones the first in ``order``.

    An aggregate, so parts are combined before the shuffle; a window would send
    every row and sort it.
    """
    rest = [c for c in parts.columns if c not in key]
    least = F.min_by(F.struct(*rest), F.struct((-F.coalesce(F.col(version), F.lit(0))).alias("v"), *order))
    return parts.groupBy(*key).agg(least.alias("row")).select(*key, "row.*")


def first_seen(parts: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    rest = [c for c in parts.columns if c not in key]
    return parts.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("row")).select(*key, "row.*")


def first_named(parts: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """First row of each key, and every row whose key is null or empty."""
    named = F.nullif(F.col(key), F.lit(""))
    return first_seen(parts.where(named.isNotNull()), [key], order).select(*parts.columns).unionByName(parts.where(named.isNull()))


#: The order of element types in an element file.
TYPES = ("node", "way", "relation")


def type_rank() -> Column:
    return F.array_position(F.array(*[F.lit(t) for t in TYPES]), F.col("type"))


def output_order(elements: DataFrame) -> DataFrame:
    """Nodes, ways, relations; each by id."""
    return elements.orderBy(type_rank(), "id")


def distinct_rings(rings: DataFrame, ring: str, order: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """The first of rings that are equal up to their start and winding, and in the columns ``by``."""
    keyed = rings.withColumn("__key", G.ring_key(ring))
    return first_seen(keyed, ["__key", *by], order).select(*rings.columns)


def distinct_edges(edges: DataFrame, order: Sequence[str]) -> DataFrame:
    """(a, b, first): each undirected edge once, a <= b, loops dropped, with the first place it was seen at."""
    sorted_ = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.struct(*order).alias("seen"))
    return sorted_.groupBy("a", "b").agg(F.min("seen").alias("first"))


def running(rows: DataFrame, amount: Column, order: Sequence[Column | str], name: str, buckets: int = 256) -> DataFrame:
    """Rows with ``name``: the sum of ``amount`` over all rows before each one in ``order``.

    It is taken in two steps, sums of ranges of the order first, so that no task
    sees all rows: ``repartitionByRange`` samples the order, and each range's
    window starts from the sum before it.
    """
    ranged = rows.withColumn("__amount", amount).repartitionByRange(buckets, *order).withColumn("__part", F.spark_partition_id())
    ranged = cut(ranged)  # its partition numbers must be the same for both readings, also after a lost executor
    sums = ranged.groupBy("__part").agg(F.sum("__amount").alias("n"))  # a row for each of ``buckets`` ranges
    before = sums.select("__part", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    run = F.coalesce(F.sum("__amount").over(Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.join(F.broadcast(before), "__part").withColumn(name, (F.col("__before") + run).cast("long")).drop("__part", "__before", "__amount")


def synthetic_ids(new: DataFrame, existing_min: Column | int, size: str, order: Sequence[str], buckets: int = 256) -> DataFrame:
    """way_id of each new way: ids run down from below all existing ones, one for the way and one for each vertex."""
    start = F.least(F.lit(0), existing_min if isinstance(existing_min, Column) else F.lit(existing_min)) - 1
    placed = running(new, F.col(size) + 1, order, "__run", buckets)
    return placed.withColumn("way_id", (start - F.col("__run")).cast("long")).drop("__run")
