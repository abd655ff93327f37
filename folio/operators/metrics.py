"""Measures of retrieval and of page reading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def score_queries(hits: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """(qid, hit, reciprocal, ndcg) of each labelled query.

    hit is 1 where one of the first k hits is relevant; the ideal gain counts the labels, at most as many as there are hits, so
    ndcg can exceed 1 where several hits match one label. Queries without hits score 0.
    """
    labels = relevant.select("qid", "key").distinct()
    n = labels.groupBy("qid").agg(F.count("*").alias("n_rel"))
    found = hits.filter(F.col("rank") <= k).join(labels.withColumn("rel", F.lit(1)), ["qid", "key"], "left").groupBy("qid").agg(
        F.count("*").alias("n_hits"), F.max(F.coalesce("rel", F.lit(0))).alias("hit"), F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first"),
        F.sum(F.when(F.col("rel") == 1, 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg"),
    )
    rows = n.join(found, "qid", "left")
    top = F.least("n_rel", F.coalesce("n_hits", F.lit(0)))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(top, F.lit(1)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    return rows.select("qid", F.coalesce("hit", F.lit(0)).alias("hit"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("reciprocal"), F.when(top > 0, F.col("dcg") / ideal).otherwise(0.0).alias("ndcg"))


def summarize_queries(scores: DataFrame) -> DataFrame:
    return scores.agg(F.count("*").alias("queries"), F.round(F.avg("hit"), 6).alias("hit_rate"), F.round(F.avg("reciprocal"), 6).alias("mrr"), F.round(F.avg("ndcg"), 6).alias("ndcg"))


def run_agreement(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """(qid, same_top, overlap) of two runs of (qid, rank, key)."""
    top = lambda d, n: d.filter(F.col("rank") <= k).groupBy("qid").agg(F.min_by("key", "rank").alias(f"{n}_top"), F.collect_set("key").alias(n))
    both = top(a, "a").join(top(b, "b"), "qid", "full_outer")
    shared = F.size(F.array_intersect(F.coalesce("a", F.array().cast("array<bigint>")), F.coalesce("b", F.array().cast("array<bigint>"))))
    return both.select("qid", F.coalesce(F.col("a_top") == F.col("b_top"), F.lit(False)).alias("same_top"), F.round(shared / k, 6).alias("overlap"))


def error_rate(read: Column, truth: Column) -> Column:
    """Edit distance over the truth's length, at most 1; 0 or 1 where the truth is empty."""
    return F.when(F.length(truth) == 0, F.when(F.length(read) == 0, 0.0).otherwise(1.0)).otherwise(F.least(F.lit(1.0), F.levenshtein(read, truth) / F.length(truth)))


def pooled(rows: DataFrame, by: str) -> DataFrame:
    """Per class and over all: means of measures, ratios of sums; null where a denominator is 0."""
    return rows.rollup(by).agg(
        F.count("*").alias("n"), F.round(F.avg("cer"), 6).alias("cer"), F.round(F.try_divide(F.sum("right"), F.sum("asked")), 6).alias("exact"), F.sum("asked").alias("asked")
    )


def order_deltas(a: DataFrame, b: DataFrame, key: str, measure: str, worse: float) -> DataFrame:
    """(key, before, after, delta, verdict) of the rows that either run has."""
    both = a.select(key, F.col(measure).alias("before")).join(b.select(key, F.col(measure).alias("after")), key, "full_outer")
    d = F.round(F.col("after") - F.col("before"), 6)
    verdict = F.when(d.isNull(), "only one").when(d > worse, "worse").when(d < -worse, "better").otherwise("same")
    return both.select(key, "before", "after", d.alias("delta"), verdict.alias("verdict"))


def best_match(truth: DataFrame, read: DataFrame, keys: list[str]) -> DataFrame:
    """For each truth item the read item of the same keys with the most shared tokens; ties to the first, none to no item.

    Both have (keys..., item, token); items of a group meet through the tokens they share.
    """
    t = truth.groupBy(*keys, F.col("item").alias("truth"), "token").agg(F.count("*").alias("n"))
    r = read.groupBy(*keys, F.col("item").alias("read"), "token").agg(F.count("*").alias("m"))
    shared = t.join(r, [*keys, "token"]).groupBy(*keys, "truth", "read").agg(F.sum(F.least("n", "m")).alias("shared"))
    w = Window.partitionBy(*keys, "truth").orderBy(F.desc("shared"), "read")
    return shared.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")
