"""Job state from append-only events: what is done, what failed, what is tried again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds of failure that a second try may mend.
RETRYABLE = ("rate_limited", "service_error", "timeout", "unreachable")


def state(events: DataFrame) -> DataFrame:
    """Last status of each (tile_id, source) by seq; the order in which events arrive does not matter."""
    return events.groupBy("tile_id", "source").agg(F.max_by("status", "seq").alias("status"), F.max("seq").alias("seq"))


def reconcile(recorded: DataFrame, files: DataFrame, stamped: DataFrame) -> DataFrame:
    """State (tile_id, source, status) against files (tile_id, source) and sources whose files name tiles (source).

    A finished tile without its file becomes failed, a failed one with its file ok;
    a pending one is never lowered; of sources without tile names nothing can be said.
    """
    there = files.select("tile_id", "source").distinct().withColumn("there", F.lit(True))
    named = stamped.select("source").distinct().withColumn("named", F.lit(True))
    j = recorded.join(there, ["tile_id", "source"], "left").join(named, "source", "left")
    seen, known = F.coalesce("there", F.lit(False)), F.coalesce("named", F.lit(False))
    verified = F.when(~known, F.col("status")).when(seen, "ok").when(F.col("status") == "ok", "failed").otherwise(F.col("status"))
    return j.select("tile_id", "source", "status", verified.alias("verified"), F.when(known, seen).alias("present"))


def retries(failures: DataFrame, fetched: DataFrame) -> DataFrame:
    """Failures (tile_id, source, kind) worth a second try, of sources that were fetched (source)."""
    return failures.where(F.col("kind").isin(*RETRYABLE)).join(fetched.select("source").distinct(), "source", "left_semi")


def summary(now: DataFrame, seconds: DataFrame) -> DataFrame:
    """One row: tiles by status and the share of work that is done, weighted by each source's mean seconds."""
    w = now.join(F.broadcast(seconds), "source", "left").withColumn("w", F.coalesce("seconds", F.lit(1.0)))  # a row for each source
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    done = F.sum(F.when(F.col("status") != "pending", F.col("w")).otherwise(0.0)) / F.nullif(F.sum("w"), F.lit(0.0))
    return w.agg(count("pending"), count("ok"), count("failed"), F.coalesce(done, F.lit(0.0)).alias("done"))


def remaining(done: Column, elapsed: Column, estimate: Column) -> Column:
    """Seconds left: the estimate at first, what the pace says after 15 s and a tenth of the work."""
    return F.when((elapsed >= 15) & (done >= 0.1), elapsed / done * (1 - done)).otherwise(F.greatest(estimate - elapsed, F.lit(0.0)))


def failure_lines(failures: DataFrame) -> DataFrame:
    """(source, reason, tiles, line): failures with one reason as one sentence, which names three tiles or two of more."""
    tiles = failures.groupBy("source", "reason", "tile_id").agg(F.count("*").alias("n"))
    least = tiles.groupBy("source", "reason").agg(F.sum("n").alias("tiles"), F.count("tile_id").alias("names"), F.min("tile_id").alias("t0"), F.max("tile_id").alias("tn"))
    # three least ids in three aggregates; a set of all ids of a reason may be as large as the table
    second = tiles.join(least, ["source", "reason"]).where("tile_id > t0").groupBy("source", "reason").agg(F.min("tile_id").alias("t1"))
    g = least.join(second, ["source", "reason"], "left")
    shown = F.when(F.col("names") > 3, F.concat_ws(", ", "t0", F.concat("t1", F.lit(" and more")))).when(F.col("names") == 3, F.concat_ws(", ", "t0", "t1", "tn")).when(F.col("names") == 2, F.concat_ws(", ", "t0", "tn")).otherwise(F.coalesce("t0", F.lit("")))
    return g.select("source", "reason", "tiles", F.concat("source", F.lit(": "), "reason", F.lit(" ("), shown, F.lit(")")).alias("line"))


def ledger(attempts: DataFrame) -> DataFrame:
    """(source, failed, retried, recovered, lost) from attempts (tile_id, source, try, ok, kind): tiles that failed at first, those tried again, and how that ended.

    A second try counts only after a kind of failure that one may mend.
    """
    first, again = F.col("try") == 0, F.col("try") > 0
    tiles = attempts.groupBy("source", "tile_id").agg(
        F.bool_or(first & ~F.col("ok")).alias("failed"), F.bool_or(first & ~F.col("ok") & F.col("kind").isin(*RETRYABLE)).alias("worth"),
        F.bool_or(again).alias("tried"), F.bool_or(again & F.col("ok")).alias("mended"),
    )
    yes = lambda c: F.coalesce(c, F.lit(False))
    failed, retried = yes(F.col("failed")), yes(F.col("failed")) & yes(F.col("worth")) & yes(F.col("tried"))
    recovered = retried & yes(F.col("mended"))
    return tiles.groupBy("source").agg(F.count_if(failed).alias("failed"), F.count_if(retried).alias("retried"), F.count_if(recovered).alias("recovered"), F.count_if(failed & ~recovered).alias("lost"))


def estimate(rows: DataFrame) -> DataFrame:
    """(source, bytes, seconds) for each source and, with a null source, in all."""
    return rows.groupingSets([[F.col("source")], []], F.col("source")).agg(F.sum("bytes").alias("bytes"), F.sum("seconds").alias("seconds"))
