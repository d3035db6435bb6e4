"""Job control: state, verification, retries, progress and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewright.operators import jobs
from sitewright.queries import query
from sitewright.queries.fixtures import table, view, with_views

_STATE = """WITH st AS (SELECT tile_id, source, status, seq FROM (SELECT *, row_number() OVER (PARTITION BY tile_id, source ORDER BY seq DESC) AS rn FROM fx_jobs) WHERE rn = 1)"""


def state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.state(view(spark, sf_dir, "fx_jobs"))


@query(with_views(_STATE + "SELECT tile_id, source, status, seq FROM st"))
def job_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state(spark, sf_dir)


@query(with_views(_STATE + """, w AS (SELECT source, avg(seconds) AS s FROM fx_jobs GROUP BY source)
SELECT count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'failed') AS failed, round(sum(CASE WHEN status <> 'pending' THEN s ELSE 0 END) / sum(s), 6) AS done FROM st JOIN w USING (source)
"""))  # fmt: skip
def job_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = view(spark, sf_dir, "fx_jobs").groupBy("source").agg(F.avg("seconds").alias("seconds"))
    return jobs.summary(state(spark, sf_dir), seconds).withColumn("done", F.round("done", 6))


@query(with_views(_STATE + """, f AS (SELECT DISTINCT tile_id, source FROM fx_jobs WHERE seq % 4 = 0), n AS (SELECT DISTINCT source FROM fx_jobs WHERE source <> 'view')
SELECT st.tile_id, st.source, st.status, CASE WHEN n.source IS NULL THEN st.status WHEN f.tile_id IS NOT NULL THEN 'ok' WHEN st.status = 'ok' THEN 'failed' ELSE st.status END AS verified,
  CASE WHEN n.source IS NULL THEN NULL ELSE f.tile_id IS NOT NULL END AS present FROM st LEFT JOIN f ON f.tile_id = st.tile_id AND f.source = st.source LEFT JOIN n ON n.source = st.source
"""))  # fmt: skip
def verify_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = view(spark, sf_dir, "fx_jobs")
    return jobs.reconcile(state(spark, sf_dir), v.where("seq % 4 = 0"), v.where("source <> 'view'"))


def failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*[F.lit(k) for k in ("rate_limited", "refused", "timeout", "not_authorised", "service_error")])
    return state(spark, sf_dir).where("status = 'failed'").select("tile_id", "source", F.get(kinds, (F.col("seq") % 5).cast("int")).alias("kind"))


_FAILED = _STATE + ", fl AS (SELECT tile_id, source, CASE seq % 5 WHEN 0 THEN 'rate_limited' WHEN 1 THEN 'refused' WHEN 2 THEN 'timeout' WHEN 3 THEN 'not_authorised' ELSE 'service_error' END AS kind FROM st WHERE status = 'failed')"


@query(with_views(_FAILED + "SELECT tile_id, source, kind FROM fl WHERE kind IN ('rate_limited', 'timeout', 'service_error') AND source <> 'view'"))
def retry_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.retries(failures(spark, sf_dir), view(spark, sf_dir, "fx_jobs").where("source <> 'view'")).select("tile_id", "source", "kind")


@query(with_views(_FAILED + """
SELECT source, kind AS reason, count(*) AS tiles, source || ': ' || kind || ' (' || CASE WHEN count(*) > 3 THEN array_to_string(list_slice(list(tile_id ORDER BY tile_id), 1, 2), ', ') || ' and more' ELSE string_agg(tile_id, ', ' ORDER BY tile_id) END || ')' AS line FROM fl GROUP BY source, kind
"""))  # fmt: skip
def failure_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.failure_lines(failures(spark, sf_dir).withColumnRenamed("kind", "reason"))


@query("""
SELECT o_orderpriority AS source, CAST(sum(o_custkey * 1000) AS BIGINT) AS bytes, round(sum(1.5::DOUBLE + o_custkey * 0.25::DOUBLE), 2) AS seconds FROM orders GROUP BY GROUPING SETS ((o_orderpriority), ())
""")
def estimate_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("source"), (F.col("o_custkey") * 1000).alias("bytes"), (1.5 + F.col("o_custkey") * 0.25).alias("seconds"))
    return jobs.estimate(o).withColumn("seconds", F.round("seconds", 2))


@query("""
WITH e AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events), s AS (SELECT user_id, ts, sum(CASE WHEN p IS NULL OR ts - p >= INTERVAL 90 SECOND THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, epoch_us(min(ts)) AS started_us, epoch_us(max(ts) + INTERVAL 90 SECOND) AS ended_us, count(*) AS beats FROM s GROUP BY user_id, k
""")
def session_heartbeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of clients: a gap of 90 seconds ends one."""
    beats = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    s = beats.groupBy("user_id", F.session_window("ts", "90 seconds").alias("w")).agg(F.count("*").alias("beats"))
    return s.select("user_id", F.unix_micros("w.start").alias("started_us"), F.unix_micros("w.end").alias("ended_us"), "beats")


@query(with_views("""
WITH a AS (SELECT tile_id, source, seq % 2 AS try, status = 'ok' AS ok, CASE WHEN seq % 5 = 0 THEN 'timeout' WHEN seq % 7 = 0 THEN 'refused' ELSE 'service_error' END AS kind FROM fx_jobs),
t AS (SELECT source, tile_id, coalesce(bool_or(try = 0 AND NOT ok), FALSE) AS failed, coalesce(bool_or(try = 0 AND NOT ok AND kind IN ('timeout', 'service_error')), FALSE) AS worth, bool_or(try > 0) AS tried, bool_or(try > 0 AND ok) AS mended FROM a GROUP BY source, tile_id)
SELECT source, count(*) FILTER (failed) AS failed, count(*) FILTER (failed AND worth AND tried) AS retried, count(*) FILTER (failed AND worth AND tried AND mended) AS recovered, count(*) FILTER (failed AND NOT (worth AND tried AND mended)) AS lost FROM t GROUP BY source
"""))  # fmt: skip
def failure_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles that failed at first, those tried again, and how that ended."""
    e = view(spark, sf_dir, "fx_jobs")
    kind = F.when(F.col("seq") % 5 == 0, "timeout").when(F.col("seq") % 7 == 0, "refused").otherwise("service_error")
    return jobs.ledger(e.select("tile_id", "source", (F.col("seq") % 2).alias("try"), (F.col("status") == "ok").alias("ok"), kind.alias("kind")))
