"""Queries that run as streams; each processes what is there and stops."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from siftmill.catalog.code import EVENTS
from siftmill.catalog.reducing import WITH_V, first_sql, threshold_sql
from siftmill.catalog.scoring import GATED_SQL
from siftmill.catalog.views import observed, observed_rows, table
from siftmill.operators import reduce as reducers
from siftmill.schemas import OBS9, ORD
from siftmill.session import shared_folder
from siftmill.streaming import batches, replay, stream as streams

_OBS9 = ", ".join(OBS9)


def _events(spark, sf_dir: str) -> DataFrame:
    return streams.read_stream(spark, sf_dir, EVENTS, "events.parquet")


def deduplicated(spark, sf_dir: str) -> DataFrame:
    rows = observed_rows(_events(spark, sf_dir)).select(*OBS9)
    return streams.run_to_end(streams.dedup_stream(rows))


def deduplicated_in_time(spark, sf_dir: str) -> DataFrame:
    """Copies further apart than the delay may come again, so only the distinct rows are compared."""
    rows = _events(spark, sf_dir).select("ts", "user_id", "event_type")
    found = streams.run_to_end(streams.dedup_stream(rows, ["user_id", "event_type"], "ts", "400 days"))
    return found.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


def _timed(spark, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("ts", F.col("event_id").alias(ORD), "user_id", "event_type")


def changed(spark, sf_dir: str) -> DataFrame:
    rows = _timed(spark, sf_dir).withColumn("variable", F.col(ORD) % 3)
    found = replay.changed_values_stream(rows, ["user_id", "variable"], "event_type", ORD, "ts", "0 seconds")
    return streams.run_to_end(found)


def lines(spark, sf_dir: str) -> DataFrame:
    rows = _timed(spark, sf_dir).withColumn("LineNo", F.col(ORD) % 40)
    return streams.run_to_end(replay.attributed_lines_stream(rows, ["user_id"], "LineNo", ORD, "ts", delay="0 seconds"))


def changed_by_batch(spark, sf_dir: str) -> DataFrame:
    rows = _timed(spark, sf_dir).drop("ts").withColumn("variable", F.col(ORD) % 3)
    return batches.changed_values_by_batch(rows, ["user_id", "variable"], "event_type")


def lines_by_batch(spark, sf_dir: str) -> DataFrame:
    rows = _timed(spark, sf_dir).select(ORD, "user_id", (F.col(ORD) % 40).alias("LineNo"))
    return batches.attributed_lines_by_batch(rows, ["user_id"])


def gated(spark, sf_dir: str) -> DataFrame:
    rows = _timed(spark, sf_dir).withColumn("loop", F.col("user_id") % 10)
    rows = rows.withColumn("is_head", F.col("event_type") == "view")
    found = replay.until_stable_loops_stream(
        rows, ["loop"], "is_head", ["user_id", "event_type"], ORD, "ts", delay="0 seconds"
    )
    return streams.run_to_end(found).drop("is_head")


def _summary(spark, sf_dir: str) -> DataFrame:
    folder, state = shared_folder(spark, "summary"), shared_folder(spark, "summary-state")
    streams.compact_into(observed_rows(_events(spark, sf_dir)), folder, state)
    return streams.summary(spark, folder)


def incremental_first(spark, sf_dir: str) -> DataFrame:
    """Filter and reduce on the summary instead of the rows."""
    return reducers.keep_only_first(reducers.drop_min_threshold(_summary(spark, sf_dir), 0.3)).select(*OBS9, ORD)


def _in_batches(spark, rows: DataFrame, parts: int = 4) -> DataFrame:
    """The rows as a stream of several batches, in their order."""
    folder = shared_folder(spark, "batches")
    last = rows.agg(F.max(ORD)).first()[0] or 0
    for part in range(parts):
        own = rows.where((F.col(ORD) * parts >= part * (last + 1)) & (F.col(ORD) * parts < (part + 1) * (last + 1)))
        own.coalesce(1).write.mode("append").parquet(folder)
    return streams.read_stream(spark, folder, rows.schema, files_per_batch=1)


def gated_by_batch(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias(ORD), (F.col("user_id") % 10).alias("loop"), "user_id", "event_type")
    stream = _in_batches(spark, rows.withColumn("is_head", F.col("event_type") == "view"))
    return batches.until_stable_loops_by_batch(stream, ["loop"], "is_head", ["user_id", "event_type"]).drop("is_head")


def folded(spark, sf_dir: str) -> DataFrame:
    folder, state = shared_folder(spark, "summary"), shared_folder(spark, "summary-state")
    streams.fold_into(_in_batches(spark, observed(spark, sf_dir), parts=5), folder, state, every=2)
    return streams.folded_summary(spark, folder)


CHANGED_SQL = """SELECT user_id, variable, _ord, event_type FROM (
          SELECT event_id AS _ord, user_id, event_type, event_id % 3 AS variable,
            row_number() OVER w AS rn, lag(event_type) OVER w AS before FROM events
          WINDOW w AS (PARTITION BY user_id, event_id % 3 ORDER BY event_id))
        WHERE rn = 1 OR before <> event_type"""

LINES_SQL = """SELECT event_id AS _ord, user_id, event_id % 40 AS LineNo,
          coalesce(lag(event_id % 40) OVER (PARTITION BY user_id ORDER BY event_id), event_id % 40) AS AttributedLine
        FROM events"""

QUERIES = {
    "stream_dedup": (deduplicated, f"{WITH_V} SELECT DISTINCT {_OBS9} FROM v"),
    "stream_dedup_within_watermark": (
        deduplicated_in_time,
        "SELECT user_id, event_type, 1::BIGINT AS n FROM events GROUP BY ALL",
    ),
    "stream_changed": (
        changed,
        CHANGED_SQL,
    ),
    "stream_changed_by_batch": (changed_by_batch, CHANGED_SQL),
    "stream_attributed_lines": (
        lines,
        LINES_SQL,
    ),
    "stream_attributed_lines_by_batch": (lines_by_batch, LINES_SQL),
    "stream_until_stable": (gated, GATED_SQL),
    "stream_summary": (
        lambda spark, sf_dir: _summary(spark, sf_dir),
        f"{WITH_V} SELECT {_OBS9}, count(*) AS _n, min(_ord) AS _ord FROM v GROUP BY {_OBS9}",
    ),
    "stream_until_stable_by_batch": (gated_by_batch, GATED_SQL),
    "stream_summary_folded": (folded, f"{WITH_V} SELECT {_OBS9}, count(*) AS _n, min(_ord) AS _ord FROM v GROUP BY {_OBS9}"),
    "stream_summary_unified": (incremental_first, f"{WITH_V}, u AS ({threshold_sql('v', 0.3)}) {first_sql('u')}"),
}
