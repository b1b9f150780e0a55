"""Judging a fetch log by the crawl's retry and politeness rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The statuses worth another attempt, and the default limits.
RETRYABLE = (403, 429, 500, 502, 503, 504)
MAX_RETRIES = 3
THROTTLE_SECONDS = 1.0
MAX_BACKOFF_SECONDS = 60.0


def triage_fetch_log(
    log: DataFrame, max_retries: int = MAX_RETRIES, throttle: float = THROTTLE_SECONDS
) -> DataFrame:
    """Final state per url of a log (url, attempt, status, ts); a null status is a
    network error.

    States are ok, retry (with the wait before the next attempt) and gave_up.
    """
    final = log.groupBy("url").agg(
        F.count("*").alias("requests"),
        F.max(F.struct("attempt", "ts", "status")).alias("last"),
    )
    attempt, status = F.col("last.attempt"), F.col("last.status")
    again = (status.isNull() | status.isin(*RETRYABLE)) & (attempt <= max_retries)
    backoff = F.least(
        F.lit(MAX_BACKOFF_SECONDS), F.lit(throttle or 1.0) * F.pow(F.lit(2.0), attempt - 1)
    )
    return final.select(
        "url",
        "requests",
        attempt.alias("attempt"),
        status.alias("status"),
        F.when(again, "retry")
        .when(F.coalesce(status == 200, F.lit(False)), "ok")
        .otherwise("gave_up")
        .alias("state"),
        F.when(again, backoff).alias("backoff_seconds"),
    )


def politeness_gaps(
    log: DataFrame,
    throttle: float = THROTTLE_SECONDS,
    key: str = "url",
    slice_seconds: int = 3600,
) -> DataFrame:
    """Requests closer to their host's previous one than the throttle allows.

    Input is (host, ts, key). A busy host is split into time slices: the gap inside
    a slice comes from a window over the slice, and the previous slice's last time
    from a window over one row per slice.
    """
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    sliced = log.withColumn("_us", micros).withColumn(
        "_slice", F.floor(F.col("_us") / (slice_seconds * 1_000_000))
    )
    by_slice = Window.partitionBy("host").orderBy("_slice")
    ends = (
        sliced.groupBy("host", "_slice")
        .agg(F.max("_us").alias("_end"))
        .withColumn("_before", F.lag("_end").over(by_slice))
        .select("host", "_slice", "_before")
    )
    inside = Window.partitionBy("host", "_slice").orderBy("ts", key)
    previous = F.coalesce(F.lag("_us").over(inside), F.col("_before"))
    gaps = sliced.join(ends, ["host", "_slice"]).withColumn(
        "gap_seconds", (F.col("_us") - previous) / 1_000_000
    )
    return gaps.where(F.col("gap_seconds") < throttle).select("host", key, "ts", "gap_seconds")
