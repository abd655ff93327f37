"""Views over runs, pages and caches: run views, settled builds, page kinds, padded routes, grep with pages, cache upkeep, targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: A line that is nothing but the mark of a page. Fixed value.
PAGE_MARK = r"^\s*<!--\s*page\s+(\S+)\s*-->\s*$"


def grep_pages(docs: DataFrame, pattern: str) -> DataFrame:
    """(doc, page, line_no, line) of the lines of (doc, md) that match, whatever the case; page is that of the last mark before the line,
    '1' before the first. Marks are no lines: they never match and are not counted."""
    md = docs.filter(F.col("md").isNotNull() & F.col("md").rlike("(?i)" + pattern))
    lines = md.select("doc", F.posexplode(F.split("md", "\n")).alias("i", "line"))
    w = Window.partitionBy("doc").orderBy("i")
    mark = F.col("line").rlike(PAGE_MARK)
    lines = lines.withColumn("page", F.coalesce(F.last(F.when(mark, F.regexp_extract("line", PAGE_MARK, 1)), ignorenulls=True).over(w), F.lit("1")))
    lines = lines.withColumn("line_no", F.count_if(~mark).over(w))
    return lines.filter(~mark & F.col("line").rlike("(?i)" + pattern)).select("doc", "page", "line_no", F.substring("line", 1, 500).alias("line"))


def unfenced(reply: Column) -> Column:
    """A model's reply without the code fence around all of it; replies with other fences inside stay."""
    body = F.regexp_extract(reply, r"(?s)\A\s*```[A-Za-z]*[ \t]*\n(.*?)\n?```\s*\z", 1)
    return F.when(reply.rlike(r"(?s)\A\s*```[A-Za-z]*[ \t]*\n.*```\s*\z") & ~F.contains(body, F.lit("```")), body).otherwise(reply)


def model_guard(vectors: DataFrame, group: str, wanted: str) -> DataFrame:
    """(group, models, dims, usable): a group can be searched if all its vectors are of the wanted model and of one length."""
    k = vectors.groupBy(group).agg(F.count_distinct("model").alias("models"), F.count_distinct(F.size("embedding")).alias("dims"), F.bool_and(F.coalesce(F.col("model") == wanted, F.lit(False))).alias("same"))
    return k.select(group, "models", "dims", (F.col("same") & (F.col("dims") == 1)).alias("usable"))


def cache_key(*parts: Column) -> Column:
    """Forty hexadecimal digits over content, reader and settings."""
    return F.left(F.sha2(F.concat_ws("\0", *parts), 256), F.lit(40))


def cache_put(cache: DataFrame, new: DataFrame) -> DataFrame:
    """The cache (key, at, bytes) with new entries; of entries of a key the latest stays."""
    both = cache.select("key", "at", "bytes").unionByName(new.select("key", "at", "bytes"))
    return both.groupBy("key").agg(F.max(F.struct("at", "bytes")).alias("m")).select("key", "m.*")


def cache_gc(cache: DataFrame, referenced: DataFrame, before) -> DataFrame:
    """The entries that stay: those that something refers to, and those that are younger than `before`."""
    used = referenced.select("key").distinct().withColumn("used", F.lit(True))
    return cache.join(used, "key", "left").filter(F.col("used") | (F.col("at") >= before)).drop("used")


def padded_routes(pages: DataFrame) -> DataFrame:
    """(doc, page, branch): every page from 1 to the last of a document; pages without a row are 'unknown'."""
    last = pages.groupBy("doc").agg(F.max("page").alias("n")).filter("n >= 1")
    every = last.select("doc", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("page"))
    return every.join(pages.select("doc", "page", "branch"), ["doc", "page"], "left").select("doc", "page", F.coalesce("branch", F.lit("unknown")).alias("branch"))


def page_kinds(trace: DataFrame) -> DataFrame:
    """(trace_id, kind): a conversion without a reader came from the cache and counts as what the file was first read with."""
    rows = trace.select("trace_id", "source", "convert", "written_at").distinct()
    first = rows.filter("convert IS NOT NULL AND written_at IS NOT NULL").groupBy("source").agg(F.min_by("convert", F.struct("written_at", "trace_id")).alias("first"))
    return rows.join(first, "source", "left").select("trace_id", F.coalesce("convert", "first", F.lit("unknown")).alias("kind"))


def run_view(trace: DataFrame, meta: DataFrame) -> DataFrame:
    """(source, tries, timeline, last_us, builds): each document's outcomes in order, with how many builds its file has."""
    rows = trace.filter("written_at IS NOT NULL").select("source", "src_path", "trace_id", "written_at", F.coalesce("outcome", F.lit("open")).alias("outcome")).distinct()
    steps = F.array_sort(F.collect_list(F.struct("written_at", "trace_id", "outcome")))
    docs = rows.groupBy("source").agg(F.count("*").alias("tries"), F.array_join(F.transform(steps, lambda x: x.outcome), ">").alias("timeline"), F.unix_micros(F.max("written_at").cast("timestamp")).alias("last_us"), F.max_by("src_path", F.struct("written_at", "trace_id")).alias("src_path"))
    builds = meta.distinct().filter("built_at IS NOT NULL").groupBy("src_path").agg(F.count("*").alias("builds"))
    return docs.join(builds, "src_path", "left").select("source", "tries", "timeline", "last_us", F.coalesce("builds", F.lit(0)).alias("builds"))


def settled(meta: DataFrame) -> DataFrame:
    """(doc, open, done, state): builds that did not finish are interrupted, and superseded where a finished one of the document exists."""
    k = meta.distinct().groupBy("doc").agg(F.count_if(F.col("built_at").isNull()).alias("open"), F.count("built_at").alias("done"))
    return k.select("doc", "open", "done", F.when(F.col("open") == 0, "finished").when(F.col("done") > 0, "superseded").otherwise("interrupted").alias("state"))


def targets(asked: DataFrame, locations: DataFrame) -> DataFrame:
    """(target, collection): what each target names: a collection exactly, else the only one of that name in another case, else the one
    whose root holds the path, the longest root first; null for none."""
    loc = locations.select("collection", F.regexp_replace("root", "/+$", "").alias("root")).distinct()
    under = F.col("target").startswith(F.concat("root", F.lit("/"))) | (F.col("target") == F.col("root"))
    by_name = asked.join(loc.select("collection"), F.lower("target") == F.lower("collection")).groupBy("target").agg(F.max(F.when(F.col("target") == F.col("collection"), F.col("collection"))).alias("exact"), F.when(F.count_distinct("collection") == 1, F.max("collection")).alias("folded"))
    by_path = asked.filter(F.contains("target", F.lit("/"))).join(F.broadcast(loc), under).groupBy("target").agg(F.max_by("collection", F.struct(F.length("root"), "collection")).alias("path"))
    rows = asked.select("target").distinct().join(by_name, "target", "left").join(by_path, "target", "left")
    return rows.select("target", F.coalesce("exact", "folded", "path").alias("collection"))
