"""Retrieval queries over documents (a source is a collection) and embeddings."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from folio.functions.text import tokens
from folio.operators import retrieval as R
from folio.plans.registry import Registry
from folio.session import spread

REG = Registry()
QUESTIONS = [(1, "boiler manual annual budget"), (2, "travel policy 2017"), (3, "die Rechnung vom Vormonat"), (4, "fire doors safety review"), (5, "le bilan annuel du service"), (6, "hydraulic pumps"), (7, "quarterly statement credit note opening balance"), (8, "contrato de alquiler")]


def corpus(docs):
    return docs.select(F.coalesce("source", F.lit("none")).alias("collection"), F.col("doc_id").alias("id"), "text")


def questions(df):
    return df.sparkSession.createDataFrame(QUESTIONS, "qid int, query string")


_TOK = r"""flatten(list_transform(regexp_extract_all(lower({t}), '[\p{{L}}\p{{N}}_]+(?:[.\-_/:][\p{{L}}\p{{N}}_]+)*'), lambda m:
  CASE WHEN regexp_matches(m, '[.\-_/:]') THEN list_concat([m], list_filter(string_split_regex(m, '[.\-_/:]'), lambda p: p <> '')) ELSE [m] END))"""
_VALUES = ", ".join(f"({i}, '{q}')" for i, q in QUESTIONS)
BASE = f"""
q AS (SELECT * FROM (VALUES {_VALUES}) v(qid, query)),
qt AS (SELECT DISTINCT qid, unnest({_TOK.format(t='query')}) AS term FROM q),
d AS (SELECT coalesce(source, 'none') AS collection, doc_id AS id, text, {_TOK.format(t='text')} AS toks FROM documents WHERE text IS NOT NULL),
dl AS (SELECT collection, id, len(toks)::BIGINT AS dl FROM d),
st AS (SELECT collection, count(*) AS n, avg(dl) AS avgdl FROM dl GROUP BY 1),
post AS (SELECT collection, term, id, count(*) AS tf FROM (SELECT collection, id, unnest(toks) AS term FROM d) GROUP BY ALL),
"""
BM25 = BASE + """
df AS (SELECT collection, term, count(*) AS df FROM post GROUP BY 1, 2),
b AS (SELECT qid, collection, id, sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS score
  FROM post JOIN qt USING (term) JOIN df USING (collection, term) JOIN st USING (collection) JOIN dl USING (collection, id) GROUP BY 1, 2, 3),
br AS (SELECT *, row_number() OVER (PARTITION BY qid, collection ORDER BY round(score, 9) DESC, id) AS rank FROM b)
"""
DENSE = """
, bk AS (SELECT collection, id, bucket, count(*) AS n FROM (SELECT collection, id, ('0x' || right(md5(t), 2))::INT % 64 AS bucket FROM (SELECT collection, id, unnest(toks) AS t FROM d)) GROUP BY ALL),
bw AS (SELECT collection, id, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY collection, id)) AS w FROM bk),
qb AS (SELECT qid, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY qid)) AS qw FROM (SELECT qid, ('0x' || right(md5(t), 2))::INT % 64 AS bucket, count(*) AS n FROM (SELECT qid, unnest(""" + _TOK.format(t="query") + """) AS t FROM q) GROUP BY ALL)),
v AS (SELECT qid, collection, id, sum(w * qw) AS score FROM bw JOIN qb USING (bucket) GROUP BY 1, 2, 3),
vr AS (SELECT *, row_number() OVER (PARTITION BY qid, collection ORDER BY round(score, 9) DESC, id) AS rank FROM v)
"""
FUSE = """
, f AS (SELECT qid, collection, id, a.rank AS bm25_rank, a.score AS bm25_score, b.rank AS dense_rank, b.score AS dense_score,
  coalesce(1 / (60::DOUBLE + a.rank), 0) + coalesce(1 / (60::DOUBLE + b.rank), 0) AS rrf
  FROM (SELECT * FROM br WHERE rank <= 20) a FULL JOIN (SELECT * FROM vr WHERE rank <= 20) b USING (qid, collection, id))
"""
RERANK = f"""
, p AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(rrf, 9) DESC, collection, id) AS pool_rank FROM f),
rr AS (SELECT p.*, d.text, len(list_intersect(list_distinct({_TOK.format(t='query')}), d.toks)) / len(list_distinct({_TOK.format(t='query')})) AS rerank
  FROM p JOIN d USING (collection, id) JOIN q USING (qid) WHERE pool_rank <= 15),
o AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(rerank, 9) DESC, pool_rank) AS rank FROM rr)
"""


@REG.query("documents", sql="WITH " + BASE.rstrip().rstrip(",") + " SELECT collection, term, count(*)::BIGINT AS df, sum(tf)::BIGINT AS cf FROM post GROUP BY 1, 2")
def term_stats(docs):
    return R.postings(R.tokenized(spread(corpus(docs)))).groupBy("collection", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@REG.query("documents", sql="WITH " + BASE.rstrip().rstrip(",") + " SELECT collection, id, dl FROM dl")
def doc_lengths(docs):
    return R.lengths(R.tokenized(spread(corpus(docs))))


@REG.query("documents", sql="WITH " + BASE.rstrip().rstrip(",") + " SELECT collection, n, round(avgdl, 6) AS avgdl FROM st")
def collection_stats(docs):
    return R.lengths(R.tokenized(spread(corpus(docs)))).groupBy("collection").agg(F.count("*").alias("n"), F.round(F.avg("dl"), 6).alias("avgdl"))


@REG.query("documents", sql="WITH " + BM25 + " SELECT qid, collection, id, round(score, 6) AS score FROM b")
def bm25_scores(docs):
    return R.bm25(R.prepared(corpus(docs)), questions(docs)).withColumn("score", F.round("score", 6))


@REG.query("documents", sql="WITH " + BM25 + " SELECT qid, collection, id, rank, round(score, 6) AS score FROM br WHERE rank <= 20")
def bm25_topk(docs):
    return R.ranked(R.bm25(R.prepared(corpus(docs)), questions(docs)), 20).withColumn("score", F.round("score", 6))


@REG.query("documents", sql="WITH " + BM25 + DENSE + " SELECT collection, id, bucket, round(w, 6) AS weight FROM bw")
def hashed_embedding(docs):
    return R.bucket_rows(R.tokenized(spread(corpus(docs)))).withColumn("weight", F.round("weight", 6))


@REG.query("documents", sql="WITH " + BM25 + DENSE + " SELECT qid, collection, id, rank, round(score, 6) AS score FROM vr WHERE rank <= 20")
def dense_topk(docs):
    return R.ranked(R.dense(R.prepared(corpus(docs)), questions(docs), 20), 20).withColumn("score", F.round("score", 6))


@REG.query("documents", sql="WITH " + BM25 + DENSE + FUSE + " SELECT qid, collection, id, bm25_rank, dense_rank, round(rrf, 6) AS rrf FROM f")
def rrf_fusion(docs):
    toked, q = R.prepared(corpus(docs)), questions(docs)
    return R.fused(R.ranked(R.bm25(toked, q), 20), R.ranked(R.dense(toked, q, 20), 20)).select("qid", "collection", "id", "bm25_rank", "dense_rank", F.round("rrf", 6).alias("rrf"))


@REG.query("documents", sql="WITH " + BM25 + DENSE + FUSE + """
SELECT qid, count(bm25_rank)::BIGINT AS bm25, count(dense_rank)::BIGINT AS dense, count(CASE WHEN bm25_rank IS NOT NULL AND dense_rank IS NOT NULL THEN 1 END)::BIGINT AS both_,
  count(CASE WHEN dense_rank IS NULL THEN 1 END)::BIGINT AS only_bm25, round(max(rrf), 6) AS top1, round(max(rrf) - list_sort(list(rrf), 'DESC')[2], 6) AS gap FROM f GROUP BY qid""")
def candidate_stats(docs):
    toked, q = R.prepared(corpus(docs)), questions(docs)
    f = R.fused(R.ranked(R.bm25(toked, q), 20), R.ranked(R.dense(toked, q, 20), 20))
    second = F.try_element_at(F.sort_array(F.collect_list("rrf"), asc=False), F.lit(2))
    return f.groupBy("qid").agg(
        F.count("bm25_rank").alias("bm25"), F.count("dense_rank").alias("dense"), F.count_if(F.col("bm25_rank").isNotNull() & F.col("dense_rank").isNotNull()).alias("both_"),
        F.count_if(F.col("dense_rank").isNull()).alias("only_bm25"), F.round(F.max("rrf"), 6).alias("top1"), F.round(F.max("rrf") - second, 6).alias("gap"),
    )


@REG.query("documents", sql="WITH " + BM25 + DENSE + FUSE + RERANK + " SELECT qid, pool_rank, collection, id, round(rerank, 6) AS rerank FROM rr")
def rerank_overlap(docs):
    rec = corpus(docs)
    toked, q = R.prepared(rec), questions(docs)
    f = R.fused(R.ranked(R.bm25(toked, q), 20), R.ranked(R.dense(toked, q, 20), 20))
    pool = f.withColumn("pool_rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(F.round("rrf", 9)), "collection", "id"))).filter("pool_rank <= 15")
    return R.overlap_rerank(pool, rec, q).select("qid", "pool_rank", "collection", "id", F.round("rerank", 6).alias("rerank"))


@REG.query("documents", sql="WITH " + BM25 + DENSE + FUSE + RERANK + """
SELECT qid, rank, round(rerank, 4) AS score, collection, id, bm25_rank, dense_rank, round(rrf, 5) AS rrf, round(rerank, 4) AS rerank,
  CASE WHEN length(text) > 1200 THEN text[:1200] || ' …' ELSE text END AS snippet FROM o WHERE rank <= 5""")
def hybrid_search(docs):
    return R.search(corpus(docs), questions(docs))


@REG.query("documents", sql="WITH " + BM25 + """
, p AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, collection, id) AS pool_rank FROM br WHERE rank <= 20)
SELECT qid, pool_rank AS rank, round(score, 4) AS score, collection, p.id, p.rank AS bm25_rank, NULL::INT AS dense_rank, NULL::DOUBLE AS rrf, NULL::DOUBLE AS rerank,
  CASE WHEN length(text) > 1200 THEN text[:1200] || ' …' ELSE text END AS snippet FROM p JOIN d USING (collection, id) WHERE pool_rank <= 5""")
def single_stage_search(docs):
    return R.search(corpus(docs), questions(docs), stages=("bm25",))


@REG.query("documents", sql=r"""
WITH l AS (SELECT coalesce(source, 'none') AS collection, doc_id AS id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
x AS (SELECT collection, id, ls, unnest(range(len(ls))) AS i FROM l)
SELECT collection, id, (i + 1)::INT AS line_no, ls[i + 1][:500] AS line,
  array_to_string(list_transform(ls[greatest(i - 1, 0) + 1 : i], lambda y: y[:300]), chr(10)) AS before, array_to_string(list_transform(ls[i + 2 : i + 2], lambda y: y[:300]), chr(10)) AS after
FROM x WHERE regexp_matches(ls[i + 1], '(?i)boiler manual|budget [0-9]+')""")
def grep_context(docs):
    return R.grep(corpus(docs), r"boiler manual|budget [0-9]+", context=1)


@REG.query("embeddings", sql="""
WITH q AS (SELECT vec_id AS qid, embedding AS qe FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT qid, vec_id AS id, list_sum(list_transform(list_zip(embedding, qe), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)) AS score FROM embeddings, q WHERE vec_id <> qid),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM s)
SELECT qid, id, rank, round(score, 5) AS score FROM r WHERE rank <= 10""")
def vector_topk(vectors):
    """The query set, a twentieth of the vectors, meets all vectors in blocks of matrix products."""
    from folio.operators.vectors import top_vectors

    return top_vectors(vectors.filter("vec_id % 20 = 0"), vectors, 10)


QUERIES, SQL = REG.queries, REG.sql
