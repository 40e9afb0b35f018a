"""Queries: extensions on Structured Streaming."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lattiq.plans.registry import query
from lattiq.session import scratch_root, table
from lattiq.streaming import controller, score


def _events_stream(spark, d):
    schema = table(spark, d, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR GROUP BY 1, 2")
def stream_windowed_counts(spark, d):
    out = score.windowed_counts(_events_stream(spark, d), "ts", "event_type")
    name = f"counts_{uuid.uuid4().hex}"
    return score.run_once(out, name, "append", f"{scratch_root(spark)}/{name}")


@query("SELECT user_id % 4 AS bmu_i, count(*) AS n FROM (SELECT user_id FROM events) GROUP BY 1")
def stream_scored_rows(spark, d):
    import numpy as np

    from lattiq.operators.grid import Grid
    from lattiq.operators.som import Codebook

    cb = Codebook(Grid(4, 1, "square"), ("x",), np.array([[0.0], [1.0], [2.0], [3.0]]))
    rows = _events_stream(spark, d).select("event_id", (F.col("user_id") % 4).cast("double").alias("x"))
    out = score.score_stream(rows, cb, ["event_id"]).groupBy(F.col("bmu_i").cast("long").alias("bmu_i")).agg(F.count(F.lit(1)).alias("n"))
    name = f"scored_{uuid.uuid4().hex}"
    return score.run_once(out, name, "complete", f"{scratch_root(spark)}/{name}")


_STEPS = """e AS (SELECT user_id AS k, event_id AS id, (epoch_us(ts) // 1000) AS ms, value, row_number() OVER w AS n, lag((epoch_us(ts) // 1000)) OVER w AS before, min(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low
 FROM events WHERE (epoch_us(ts) // 1000) < (SELECT epoch_us(max(ts)) // 1000 - 7200000 FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT *, coalesce(max(CASE WHEN value IS NOT NULL AND (low IS NULL OR value < low) THEN n END) OVER (PARTITION BY k ORDER BY n), 0) AS improved FROM e),
s AS (SELECT k, min(n) FILTER (n - improved >= 8) AS stalled, min(n - 1) FILTER (ms - before > 129600000) AS gap, max(n) AS final, max(ms) AS last FROM b GROUP BY 1),
f AS (SELECT k, CASE WHEN stalled <= coalesce(gap, stalled) THEN 'stalled' ELSE 'silent' END AS reason, CASE WHEN stalled <= coalesce(gap, stalled) THEN stalled ELSE coalesce(gap, final) END AS stop
 FROM s WHERE stalled IS NOT NULL OR gap IS NOT NULL OR last + 129600000 < (SELECT epoch_us(max(ts)) // 1000 - 7200000 FROM events))"""


@query(f"""WITH {_STEPS} SELECT f.k AS user_id, reason, max(ms) AS ended_ms, max(n) AS steps, min(value) AS best, arg_min(id, n) FILTER (n = improved_stop) AS best_id
FROM f JOIN (SELECT b.*, max(improved) FILTER (n = stop) OVER (PARTITION BY b.k) AS improved_stop, stop FROM b JOIN f USING (k)) b ON b.k = f.k AND n <= b.stop GROUP BY 1, 2""")
def stream_ended_runs(spark, d):
    """Users as runs: each ends after 8 events without a lower value, or 36 hours of silence."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", controller.ROCKSDB)
    out = controller.ended_runs(_events_stream(spark, d), "user_id", "ts", "event_id", "value", controller.Rule(8, 129_600_000))
    name = f"ended_{uuid.uuid4().hex}"
    return score.run_once(out.withColumnRenamed("key", "user_id"), name, "append", f"{scratch_root(spark)}/{name}")
