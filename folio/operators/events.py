"""Operators over append-only event logs. Keys that are null form one group; an order is a tuple of columns that decides ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def micros(time: Column) -> Column:
    """Microseconds since 1970; times without a zone are taken in the session's."""
    return F.unix_micros(time.cast("timestamp"))


def _seconds(a: Column, b: Column) -> Column:
    return (micros(a) - micros(b)) / 1e6


def latest(events: DataFrame, key: str, order: tuple[str, ...], status: str, value: str, keeps: str) -> DataFrame:
    """The last event of each key; value is the last one of an event whose status is not `keeps`. Aggregates before it shuffles."""
    when = F.struct(*order)
    last = F.max_by(F.struct(status, *order), when)
    known = F.max_by(value, F.when((F.col(status) != keeps) & F.col(value).isNotNull(), when))
    return events.groupBy(key).agg(last.alias("l"), known.alias(value)).select(key, f"l.{status}", value, *(f"l.{c}" for c in order))


def busy(events: DataFrame, lane: str, order: tuple[str, ...], pause_s: float) -> DataFrame:
    """(lane, busy_s, span_s, pauses): gaps shorter than a pause count as work."""
    time = order[0]
    g = events.select(lane, time, _seconds(F.lead(time).over(Window.partitionBy(lane).orderBy(*order)), F.col(time)).alias("gap"))
    return g.groupBy(lane).agg(
        F.round(F.sum(F.when(F.col("gap") < pause_s, F.col("gap")).otherwise(0.0)), 3).alias("busy_s"), F.round(_seconds(F.max(time), F.min(time)), 3).alias("span_s"), F.count_if(F.col("gap") >= pause_s).alias("pauses")
    )


def stalls(events: DataFrame, key: str, order: tuple[str, ...], limit_s: float) -> DataFrame:
    """Events that came more than the limit after the one before of their key, with idle_s."""
    time = order[0]
    idle = _seconds(F.col(time), F.lag(time).over(Window.partitionBy(key).orderBy(*order)))
    return events.withColumn("idle_s", idle).filter(F.col("idle_s") > limit_s).withColumn("idle_s", F.round("idle_s", 3))


def throttle(events: DataFrame, key: str, order: tuple[str, ...], kind: str, interval_s: float) -> DataFrame:
    """Without events that repeat the kind of the one before of their key inside the interval."""
    time, w = order[0], Window.partitionBy(key).orderBy(*order)
    rows = events.withColumn("_k", F.lag(kind).over(w)).withColumn("_t", F.lag(time).over(w))
    return rows.filter(F.col("_k").isNull() | (F.col("_k") != F.col(kind)) | (_seconds(F.col(time), F.col("_t")) >= interval_s)).drop("_k", "_t")


def timeline(events: DataFrame, key: str, order: tuple[str, ...], kind: str, most: int) -> DataFrame:
    """(key, n, path): the first `most` events of each key."""
    rows = events.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("_r") <= most)
    ordered = F.array_sort(F.collect_list(F.struct("_r", kind)))
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.array_join(F.transform(ordered, lambda x: x[kind]), ">").alias("path"))


def windowed(events: DataFrame, width: str) -> DataFrame:
    """(start, event_type, n, total) of tumbling windows; runs on streams too."""
    return events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, key: str, order: tuple[str, ...], gap_s: float) -> DataFrame:
    """(key, session, n, start_us, end_us): a gap longer than gap_s opens a session."""
    time, w = order[0], Window.partitionBy(key).orderBy(*order)
    opens = F.when(F.coalesce(_seconds(F.col(time), F.lag(time).over(w)) > gap_s, F.lit(True)), 1).otherwise(0)
    rows = events.withColumn("_o", opens).withColumn("session", F.sum("_o").over(w))
    return rows.groupBy(key, "session").agg(F.count("*").alias("n"), micros(F.min(time)).alias("start_us"), micros(F.max(time)).alias("end_us"))
