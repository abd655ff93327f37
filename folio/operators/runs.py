"""States, estimates and arrival of conversion runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def last_rows(trace: DataFrame) -> DataFrame:
    """The newest row of each source; rows without a time are no statement."""
    rows = trace.filter(F.col("written_at").isNotNull())
    last = F.max_by(F.struct(*(c for c in rows.columns if c != "source")), F.struct("written_at", "trace_id"))
    return rows.groupBy("source").agg(last.alias("l")).select("source", "l.*")


def last_states(trace: DataFrame) -> DataFrame:
    return last_rows(trace).select("source", F.coalesce("outcome", F.lit("unknown")).alias("status"), F.coalesce("pages", F.lit(0)).cast("long").alias("pages"), "trace_id")


def estimate(trace: DataFrame, meta: DataFrame, enough: int = 20, unknown: float = 0.5) -> DataFrame:
    """(ext, pages, rate, seconds) of what the last runs hold."""
    ext = lambda c: F.lower(F.regexp_extract(c, r"\.([A-Za-z0-9]+)$", 1)).alias("ext")
    pages = last_rows(trace).groupBy(ext("source")).agg(F.sum(F.coalesce("pages", F.lit(0))).cast("long").alias("pages"))
    timed = meta.distinct().filter("convert_s IS NOT NULL AND nodes > 0").groupBy(ext("src_path")).agg((F.sum("convert_s") / F.sum("nodes")).alias("rate"), F.sum("nodes").alias("n"))
    rate = F.when(F.coalesce("n", F.lit(0)) >= enough, F.col("rate")).otherwise(unknown)
    return pages.join(timed, "ext", "left").select("ext", "pages", F.round(rate, 6).alias("rate"), F.round(F.col("pages") * rate, 3).alias("seconds"))


def arrivals(trace: DataFrame) -> DataFrame:
    """(n, out_of_order, latest_s, mean_s). Each day is ordered by itself; the days' maxima, a row each, carry over."""
    rows = trace.distinct().filter("written_at IS NOT NULL AND received_at IS NOT NULL").select("trace_id", "received_at", F.unix_micros("written_at").alias("w"), F.to_date("received_at").alias("day"), ((F.unix_micros("received_at") - F.unix_micros("written_at")) / 1e6).alias("late"))
    days = rows.groupBy("day").agg(F.max("w").alias("m"))
    before = days.withColumn("before", F.max("m").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1))).select("day", "before")
    w = Window.partitionBy("day").orderBy("received_at", "trace_id").rowsBetween(Window.unboundedPreceding, -1)
    seen = rows.withColumn("same", F.max("w").over(w)).join(before, "day")
    late = F.col("w") < F.greatest("same", "before")
    return seen.agg(F.count("*").alias("n"), F.count_if(late).alias("out_of_order"), F.round(F.max("late"), 3).alias("latest_s"), F.round(F.avg("late"), 3).alias("mean_s"))


#: Chunks of a document that one task walks through.
STRETCH = 4_096


def headings(chunks: DataFrame) -> DataFrame:
    """(chunk_id, doc, ord, in_effect) of (chunk_id, doc, ord, heading): the last heading at or before each chunk of its document.

    Documents are walked in stretches of ord; the heading that a stretch begins with comes from the last one before it that has any,
    so that a document of any length is spread over tasks.
    """
    rows = chunks.withColumn("part", F.floor(F.col("ord") / STRETCH))
    own = F.last("heading", ignorenulls=True).over(Window.partitionBy("doc", "part").orderBy("ord", "chunk_id").rowsBetween(Window.unboundedPreceding, 0))
    ends = rows.groupBy("doc", "part").agg(F.max_by("heading", F.when(F.col("heading").isNotNull(), F.struct("ord", "chunk_id"))).alias("end"))
    before = F.last("end", ignorenulls=True).over(Window.partitionBy("doc").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    carried = ends.select("doc", "part", before.alias("carried"))
    key = F.col("r.doc").eqNullSafe(F.col("c.doc")) & (F.col("r.part") == F.col("c.part"))
    both = rows.withColumn("own", own).alias("r").join(carried.alias("c"), key, "left")
    return both.select("r.chunk_id", "r.doc", "r.ord", F.coalesce("r.own", "c.carried").alias("in_effect"))
