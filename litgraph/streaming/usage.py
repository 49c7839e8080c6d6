"""Usage events (user_id, api_type, ts, call_count, response_status, id): windows, quotas and limits.

The windowed operators take a batch or a stream; on a stream the watermark bounds the state
and drops what comes later than it.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LATE = "10 minutes"


def error_rate_windows(events: DataFrame, length: str = "5 minutes", slide: str = "1 minute", minutes: float = 5.0) -> DataFrame:
    """(start, total, errors, errors_4xx, errors_5xx, errors_per_minute) of every sliding window with an event."""
    status = F.col("response_status")
    counted = events.withWatermark("ts", LATE).groupBy(F.window("ts", length, slide)).agg(
        F.count("*").alias("total"), F.count_if(status >= 400).alias("errors"), F.count_if((status >= 400) & (status < 500)).alias("errors_4xx"), F.count_if(status >= 500).alias("errors_5xx")
    )
    return counted.select(F.col("window.start").alias("start"), "total", "errors", "errors_4xx", "errors_5xx", (F.col("errors") / minutes).alias("errors_per_minute"))


def usage_hourly(events: DataFrame) -> DataFrame:
    """Calls by user, api and hour."""
    hour = events.withWatermark("ts", LATE).groupBy("user_id", "api_type", F.window("ts", "1 hour"))
    return hour.agg(F.sum("call_count").alias("calls")).select("user_id", "api_type", F.col("window.start").alias("hour"), "calls")


def status_incidents(events: DataFrame, status: int = 503) -> DataFrame:
    """One row: how many events had ``status``, the last one's time, how many users and apis it met."""
    return events.filter(F.col("response_status") == status).agg(
        F.count("*").alias("n"), F.max("ts").alias("last"), F.countDistinct("user_id").alias("users"), F.countDistinct("api_type").alias("apis")
    )


def quota_alerts(events: DataFrame, limit: int) -> DataFrame:
    """Running calls of each user, api and day after each event, and whether they are ok, a warning (over 80 %) or exceeded.

    Calls are summed by minute before the window, so a busy user's day has at most 1,440 rows.
    """
    minute = events.groupBy("user_id", "api_type", F.date_trunc("minute", "ts").alias("minute")).agg(F.sum("call_count").alias("calls"))
    day = Window.partitionBy("user_id", "api_type", F.to_date("minute")).orderBy("minute").rowsBetween(Window.unboundedPreceding, 0)
    used = F.sum("calls").over(day)
    rows = minute.withColumn("used", used)
    alert = F.when(F.col("used") >= limit, "exceeded").when(F.col("used") > 0.8 * limit, "warning").otherwise("ok")
    return rows.select("user_id", "api_type", "minute", "used", alert.alias("alert"))


def latest_progress(events: DataFrame, key: str = "user_id") -> DataFrame:
    """The newest event of each key, ties by id."""
    return events.groupBy(key).agg(F.max_by(F.struct("id", "api_type"), F.struct("ts", "id")).alias("_last")).select(key, "_last.id", "_last.api_type")


def rate_limit_decisions(events: DataFrame, limit: int, seconds: float, client: str = "user_id") -> DataFrame:
    """(id, client, allowed, remaining): an event is allowed if fewer than ``limit`` were allowed in the ``seconds`` before it.

    A rejected event changes no later decision, so this is no window function. Events are
    dealt by client and sorted by time; a task reads them as a flow of batches and keeps at
    most ``limit`` times of one client, however many events the client has.
    """
    kind = events.schema[client].dataType.simpleString()
    rows = events.select("id", F.col(client).alias("client"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t")).repartition("client").sortWithinPartitions("client", "t", "id")
    span = int(seconds * 1_000_000)

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, started, accepted = None, False, deque()
        for batch in batches:
            allowed, remaining = [], []
            for who, t in zip(batch["client"], batch["t"], strict=True):
                if not started or (who != now and not (pd.isna(who) and pd.isna(now))):
                    now, started = who, True
                    accepted.clear()
                while accepted and accepted[0] <= t - span:
                    accepted.popleft()
                fits = len(accepted) < limit
                if fits:
                    accepted.append(t)
                allowed.append(fits)
                remaining.append(limit - len(accepted))
            yield pd.DataFrame({"id": batch["id"], "client": batch["client"], "allowed": allowed, "remaining": remaining})

    decided = rows.mapInPandas(decide, f"id {events.schema['id'].dataType.simpleString()}, client {kind}, allowed boolean, remaining int")
    return decided.withColumnRenamed("client", client)
