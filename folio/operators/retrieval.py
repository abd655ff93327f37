"""Keyword and vector retrieval over collections: postings, BM25, dense scores, rank fusion, reranking.

Statistics and ranks belong to a collection. Ties go to the smaller id, so every result is determined. Texts that are null have
no tokens and are no records.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from folio.functions.text import tokens
from folio.session import materialize, spread

K1, B, RRF = 1.5, 0.75, 60
#: Buckets of the hashed bag of words.
BUCKETS = 64


def tokenized(records: DataFrame) -> DataFrame:
    """(collection, id, toks) of (collection, id, text)."""
    return records.filter(F.col("text").isNotNull()).select("collection", "id", tokens(F.col("text")).alias("toks"))


def bucket(token: Column) -> Column:
    return F.conv(F.right(F.md5(token), F.lit(2)), 16, 10).cast("int") % BUCKETS


def prepared(records: DataFrame) -> DataFrame:
    """(collection, id, toks, buckets) of (collection, id, text), tokenised once and kept: every stage of a search reads it."""
    toked = tokenized(spread(records))
    return materialize(toked.select("collection", "id", "toks", F.transform("toks", bucket).alias("buckets")), "tokens")


def postings(toked: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """(collection, term, id, tf, dl), dl the record's length; with terms, only of those, filtered before anything is shuffled."""
    rows = toked.select("collection", "id", F.size("toks").cast("long").alias("dl"), F.explode("toks").alias("term"))
    if terms is not None:
        rows = rows.join(terms.select("term").distinct(), "term", "left_semi")
    return rows.groupBy("collection", "term", "id").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def lengths(toked: DataFrame) -> DataFrame:
    return toked.select("collection", "id", F.size("toks").cast("long").alias("dl"))


def query_terms(queries: DataFrame) -> DataFrame:
    """(qid, term): the distinct terms of each (qid, query)."""
    return queries.select("qid", F.explode(F.array_distinct(tokens(F.col("query")))).alias("term"))


def bm25(toked: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, collection, id, score) of every record that holds a query term."""
    asked = query_terms(queries)
    post = postings(toked, asked)
    stats = lengths(toked).groupBy("collection").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    df = post.groupBy("collection", "term").agg(F.count("*").alias("df"))
    idf = df.join(stats, "collection").select("collection", "term", "avgdl", F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    hits = post.join(idf, ["collection", "term"])
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return hits.join(asked, "term").groupBy("qid", "collection", "id").agg(F.sum(part).alias("score"))


def ranked(scores: DataFrame, pool: int, by: tuple[str, ...] = ("qid", "collection"), name: str = "rank") -> DataFrame:
    """The best `pool` of each group with their rank; scores are compared to nine digits."""
    w = Window.partitionBy(*by).orderBy(F.desc(F.round("score", 9)), "id")
    return scores.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= pool)


def bucket_rows(toked: DataFrame) -> DataFrame:
    """(collection, id, bucket, weight): the hashed bag of words, sparse, from aggregations alone."""
    rows = toked.select("collection", "id", F.explode("toks").alias("t"))
    counts = rows.groupBy("collection", "id", bucket(F.col("t")).alias("bucket")).agg(F.count("*").alias("n"))
    norm = F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy("collection", "id")))
    return counts.select("collection", "id", "bucket", (F.col("n") / norm).alias("weight"))


#: Questions that go to every task as a matrix at most; more of them are joined.
QUESTIONS = 4_096


def dense(toked: DataFrame, queries: DataFrame, pool: int | None = None) -> DataFrame:
    """(qid, collection, id, score): cosines of hashed bags of words, where they are above 0.

    toked comes from prepared(). Questions become a matrix, of at most QUESTIONS rows of BUCKETS numbers, and each batch of records
    one product with it; with a pool, only the best of each batch, question and collection leave the task. More questions than
    that, and records without buckets, meet in a join on the buckets that both have.
    """
    asked = queries.select("qid", tokens(F.col("query")).alias("toks"))
    rows = asked.select("qid", F.transform("toks", bucket).alias("b")).limit(QUESTIONS + 1).collect()
    if len(rows) > QUESTIONS or "buckets" not in toked.columns:
        return _dense_joined(toked, queries)
    rows = [r for r in rows if r.b]
    qids = np.array([r.qid for r in rows], np.int64)
    q = _unit_counts(np.repeat(np.arange(len(rows)), [len(r.b) for r in rows]), np.array([b for r in rows for b in r.b], np.int64), len(rows)).T
    kind = toked.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            if not len(batch) or not len(rows):
                continue
            lists = batch.column(2)
            w = _unit_counts(np.repeat(np.arange(len(batch)), lists.value_lengths().to_numpy()), lists.flatten().to_numpy(), len(batch))
            names, ids = np.array(batch.column(0).to_pylist(), object), np.array(batch.column(1).to_pylist())
            which, asked_by, scores = [], [], []
            for name in dict.fromkeys(names):
                mine = np.flatnonzero(names == name)
                s = w[mine] @ q
                for k in range(len(rows)):
                    at = np.flatnonzero(s[:, k] > 0)
                    if pool is not None and len(at) > pool:
                        at = at[np.lexsort((ids[mine[at]], -np.round(s[at, k], 9)))[:pool]]
                    which.append(mine[at])
                    asked_by.append(np.full(len(at), k))
                    scores.append(s[at, k])
            at = pa.array(np.concatenate(which))
            yield pa.RecordBatch.from_arrays([pa.array(qids[np.concatenate(asked_by)]), batch.column(0).take(at), batch.column(1).take(at), pa.array(np.concatenate(scores))], ["qid", "collection", "id", "score"])

    found = toked.select("collection", "id", "buckets").mapInArrow(run, f"qid long, collection string, id {kind}, score double")
    return found.withColumn("qid", F.col("qid").cast(queries.schema["qid"].dataType))


def _unit_counts(row: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """(n, BUCKETS): how often each row has each bucket, at unit length; rows without any stay zero."""
    counts = np.bincount(row * BUCKETS + at, minlength=n * BUCKETS).reshape(n, BUCKETS).astype(float)
    return counts / np.maximum(np.sqrt((counts * counts).sum(axis=1, keepdims=True)), 1e-300)


def _dense_joined(toked: DataFrame, queries: DataFrame) -> DataFrame:
    q = bucket_rows(queries.select(F.lit("").alias("collection"), F.col("qid").alias("id"), tokens(F.col("query")).alias("toks"))).select(F.col("id").alias("qid"), "bucket", F.col("weight").alias("qw"))
    return bucket_rows(toked).join(q, "bucket").groupBy("qid", "collection", "id").agg(F.sum(F.col("weight") * F.col("qw")).alias("score"))


def fused(keyword: DataFrame, vector: DataFrame, k: int = RRF) -> DataFrame:
    """(qid, collection, id, bm25_rank, bm25_score, dense_rank, dense_score, rrf): both lists merged, reciprocal ranks added."""
    a = keyword.select("qid", "collection", "id", F.col("rank").alias("bm25_rank"), F.col("score").alias("bm25_score"))
    b = vector.select("qid", "collection", "id", F.col("rank").alias("dense_rank"), F.col("score").alias("dense_score"))
    both = a.join(b, ["qid", "collection", "id"], "full_outer")
    rrf = F.coalesce(1 / (F.lit(float(k)) + F.col("bm25_rank")), F.lit(0.0)) + F.coalesce(1 / (F.lit(float(k)) + F.col("dense_rank")), F.lit(0.0))
    return both.withColumn("rrf", rrf)


def overlap_rerank(pool: DataFrame, records: DataFrame, queries: DataFrame) -> DataFrame:
    """Adds rerank: the share of a query's distinct words that the text holds. The texts join the pool, after its limit."""
    q = queries.select("qid", F.array_distinct(tokens(F.col("query"))).alias("q"))
    texts = records.select("collection", "id", "text")
    joined = pool.join(texts, ["collection", "id"]).join(q, "qid")
    return joined.withColumn("rerank", F.size(F.array_intersect("q", tokens(F.col("text")))) / F.greatest(F.size("q"), F.lit(1))).drop("q")


def snippet(text: Column, most: int = 1200) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(" …"))).otherwise(text)


def search(records: DataFrame, queries: DataFrame, top_k: int = 5, stages: tuple[str, ...] = ("bm25", "dense", "rerank"), pool: int | None = None, rerank_pool: int | None = None, k: int = RRF) -> DataFrame:
    """(qid, rank, score, collection, id, bm25_rank, dense_rank, rrf, rerank, snippet): the whole pipeline.

    With one retriever its raw score orders the pool and rrf is null; without 'rerank' the pool's order stays.
    """
    top_k = max(1, min(25, top_k))
    pool = pool or max(4 * top_k, 20)
    rerank_pool = rerank_pool or min(max(3 * top_k, 15), 60)
    toked = prepared(records)
    keyword = ranked(bm25(toked, queries).filter("score > 0"), pool) if "bm25" in stages else None
    vector = ranked(dense(toked, queries, pool), pool) if "dense" in stages else None
    if keyword is not None and vector is not None:
        cand = fused(keyword, vector, k).withColumn("key", F.col("rrf"))
    elif keyword is not None or vector is not None:
        one = keyword if keyword is not None else vector
        name, other = ("bm25", "dense") if keyword is not None else ("dense", "bm25")
        cand = one.select("qid", "collection", "id", F.col("rank").alias(f"{name}_rank"), F.col("score").alias(f"{name}_score"), F.lit(None).cast("int").alias(f"{other}_rank"), F.lit(None).cast("double").alias(f"{other}_score"), F.lit(None).cast("double").alias("rrf"), F.col("score").alias("key"))
    else:
        raise ValueError("a search needs 'bm25' or 'dense'")
    w = Window.partitionBy("qid").orderBy(F.desc(F.round("key", 9)), "collection", "id")
    kept = cand.withColumn("pool_rank", F.row_number().over(w)).filter(F.col("pool_rank") <= rerank_pool)
    if "rerank" in stages:
        done = overlap_rerank(kept, records, queries).withColumn("score", F.col("rerank"))
    else:
        done = kept.join(records.select("collection", "id", "text"), ["collection", "id"]).withColumn("rerank", F.lit(None).cast("double")).withColumn("score", F.col("key"))
    w = Window.partitionBy("qid").orderBy(F.desc(F.round("score", 9)), "pool_rank")
    top = done.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top_k)
    return top.select("qid", "rank", F.round("score", 4).alias("score"), "collection", "id", "bm25_rank", "dense_rank", F.round("rrf", 5).alias("rrf"), F.round("rerank", 4).alias("rerank"), snippet(F.col("text")).alias("snippet"))


def grep(lines_of: DataFrame, pattern: str, context: int = 1, most: int | None = None) -> DataFrame:
    """(collection, id, line_no, line, before, after) of the lines that match, without case; trimmed to 500 and 300 characters."""
    lines = F.split("text", "\n")
    rows = lines_of.filter(F.col("text").isNotNull()).select("collection", "id", lines.alias("ls")).filter(F.exists("ls", lambda x: x.rlike("(?i)" + pattern)))
    flat = rows.select("collection", "id", "ls", F.posexplode("ls").alias("i", "line")).filter(F.col("line").rlike("(?i)" + pattern))
    trim = lambda a: F.transform(a, lambda x: F.substring(x, 1, 300))
    start = F.greatest(F.col("i") - context, F.lit(0))
    before = F.slice("ls", start + 1, F.col("i") - start)
    after = F.slice("ls", F.col("i") + 2, F.lit(context))
    out = flat.select("collection", "id", (F.col("i") + 1).alias("line_no"), F.substring("line", 1, 500).alias("line"), F.array_join(trim(before), "\n").alias("before"), F.array_join(trim(after), "\n").alias("after"))
    return out if most is None else out.orderBy("collection", "id", "line_no").limit(most)
