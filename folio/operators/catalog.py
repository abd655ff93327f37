"""Bookkeeping of the index: which builds are fresh, who owns a name, what a collection holds, who may see it."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window, functions as F


def newest_builds(meta: DataFrame) -> DataFrame:
    """The newest finished build of each document; copies count once."""
    w = Window.partitionBy("doc").orderBy(F.desc("built_at"), *(F.asc_nulls_last(c) for c in ("src_sha256", "chunk_size", "chunker", "model", "convert", "chunk_overlap", "index_bytes", "src_bytes")))
    return meta.distinct().filter(F.col("built_at").isNotNull()).withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def freshness(builds: DataFrame, trace: DataFrame, chunker: str = "md-3", dim: int = 64) -> DataFrame:
    """(doc, fresh): the build has nodes, the file's present checksum and the present settings."""
    seen = trace.filter(F.col("src_sha256").isNotNull() & F.col("written_at").isNotNull())
    present = seen.groupBy("src_path").agg(F.lower(F.max_by("src_sha256", F.struct("written_at", "trace_id"))).alias("sha"))
    rows = builds.join(present, "src_path", "left")
    fresh = F.lower("src_sha256").eqNullSafe(F.col("sha")) & (F.col("nodes") > 0) & (F.col("chunker") == chunker) & (F.col("dim") == dim)
    return rows.select("doc", fresh.alias("fresh"))


def name_owners(meta: DataFrame) -> DataFrame:
    """(name, doc, owner, claimants): the document built first owns a name that several would have."""
    d = meta.groupBy("doc", "src_path").agg(F.min("built_at").alias("first_built")).withColumn("name", F.lower(F.regexp_replace("doc", "^.*/", "")))
    w = Window.partitionBy("name")
    return d.select("name", "doc", (F.row_number().over(w.orderBy(F.asc_nulls_last("first_built"), "doc")) == 1).alias("owner"), F.count("*").over(w).alias("claimants"))


def uniform(column: str):
    """The one value of a column over a group, or 'mixed'."""
    return F.when(F.count_distinct(column) == 1, F.min(column).cast("string")).otherwise("mixed").alias(column)


def catalog(builds: DataFrame) -> DataFrame:
    """One row for each collection."""
    return builds.groupBy(F.split_part("doc", F.lit("/"), F.lit(1)).alias("collection")).agg(
        F.count("*").alias("docs"), F.sum("nodes").cast("long").alias("nodes"), F.sum("index_bytes").alias("index_bytes"), F.sum("src_bytes").alias("src_bytes"),
        uniform("model"), uniform("chunk_size"), F.round(F.sum("build_s"), 3).alias("build_s"), F.unix_micros(F.max("built_at")).alias("last_built_us"),
    )


def content_hash(builds: DataFrame) -> DataFrame:
    """(collection, content): a hash over the sorted documents and checksums; equal hashes mean nothing to publish.

    Lines are hashed in 256 parts, by the first digits of their own hash, and the parts' hashes once more, so that no row ever holds
    the list of a collection.
    """
    line = F.concat_ws(" ", "doc", F.lower("src_sha256"))
    rows = builds.filter(F.col("src_sha256").isNotNull()).select(F.split_part("doc", F.lit("/"), F.lit(1)).alias("collection"), F.sha2(line, 256).alias("h"))
    parts = rows.groupBy("collection", F.left("h", F.lit(2)).alias("part")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), "\n"), 256).alias("d"))
    ordered = F.array_sort(F.collect_list(F.struct("part", "d")))
    return parts.groupBy("collection").agg(F.sha2(F.array_join(F.transform(ordered, lambda x: x.d), "\n"), 256).alias("content"))


def mirror(paths: DataFrame, locations: DataFrame) -> DataFrame:
    """(path, collection, mirrored): each path under its longest root.

    Instead of comparing every path with every root, a path is joined on its prefixes of as many parts as roots have.
    """
    roots = locations.select("collection", F.rtrim(F.col("root")).alias("root")).withColumn("parts", F.size(F.split("root", "/")))
    depths = [r.parts for r in roots.select("parts").distinct().collect()]
    prefixes = F.array(*(F.substring_index("path", "/", d) for d in sorted(depths))) if depths else F.array().cast("array<string>")
    long = paths.select("path", F.explode_outer(F.array_distinct(prefixes)).alias("root"))
    hits = long.join(roots, "root").filter(F.length("path") > F.length("root"))
    best = hits.groupBy("path").agg(F.min_by(F.struct("collection", "root"), F.struct(-F.length("root"), "collection")).alias("b")).select("path", "b.*")
    return paths.join(best, "path", "left").select("path", "collection", F.concat("collection", F.substring("path", F.length("root") + 1, F.length("path"))).alias("mirrored"))


def access(collections: DataFrame, rules: DataFrame, clients: DataFrame, admin: str = "cli") -> DataFrame:
    """(client, collection, allowed): no rule is open, an empty rule is closed, the administrator sees all; names fold case.

    Rules and clients are administrators' lists.
    """
    folded = collections.withColumn("f", F.lower("collection")).join(rules.select(F.lower("name").alias("f"), "clients"), "f", "left")
    everyone = folded.withColumn("client", F.explode(F.lit([r.client for r in clients.distinct().collect()])))
    return everyone.select("client", "collection", ((F.col("client") == admin) | F.col("clients").isNull() | F.array_contains("clients", F.col("client"))).alias("allowed"))


def redact(rows: DataFrame, column: str, hidden: list[str]) -> DataFrame:
    """Names of hidden collections replaced wherever they stand as words."""
    if not hidden:
        return rows
    names = "|".join(re.escape(n) for n in sorted(hidden, key=len, reverse=True))
    return rows.withColumn(column, F.regexp_replace(column, rf"(?i)(^|[^A-Za-z0-9_-])({names})([^A-Za-z0-9_-]|$)", "$1[restricted]$3"))
