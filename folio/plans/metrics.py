"""Retrieval and reading metrics, document reads and listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.operators import metrics as M
from folio.operators import reading as D
from folio.operators import retrieval as R
from folio.plans.registry import Registry
from folio.plans.retrieval import BM25, DENSE, corpus, questions

REG = Registry()
_HITS = "h AS (SELECT qid, id AS key, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM b)"
_VHITS = "vh AS (SELECT qid, id AS key, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM v)"
_REL = "rel AS (SELECT DISTINCT qid, doc_id AS key FROM q, documents WHERE text IS NOT NULL AND contains(lower(text), string_split(query, ' ')[1]) AND contains(lower(text), string_split(query, ' ')[-1]))"


def hits_of(docs):
    return R.ranked(R.bm25(R.prepared(corpus(docs)), questions(docs)), 1 << 30, ("qid",)).select("qid", F.col("id").alias("key"), "rank")


def labels(docs):
    """Labels by rule: every document that holds a question's first and last word. The questions are a list of eight."""
    ends = [(q.qid, q.query.split(" ")) for q in questions(docs).collect()]
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("qid"), F.lit(w[0]).alias("a"), F.lit(w[-1]).alias("b")) for i, w in ends)))
    rows = docs.filter("text IS NOT NULL").select(F.col("doc_id").alias("key"), F.lower("text").alias("t"), each.alias("q"))
    return rows.filter(F.contains("t", F.col("q.a")) & F.contains("t", F.col("q.b"))).select("q.qid", "key").distinct()


_SCORED = """n AS (SELECT qid, count(*) AS n_rel FROM rel GROUP BY 1),
f AS (SELECT h.qid, count(*) AS n_hits, max(CASE WHEN rel.key IS NOT NULL THEN 1 ELSE 0 END) AS hit, min(CASE WHEN rel.key IS NOT NULL THEN rank END) AS first,
  sum(CASE WHEN rel.key IS NOT NULL THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg FROM h LEFT JOIN rel ON rel.qid = h.qid AND rel.key = h.key WHERE rank <= 10 GROUP BY 1),
s AS (SELECT n.qid, coalesce(hit, 0) AS hit, coalesce(1.0::DOUBLE / first, 0) AS reciprocal, CASE WHEN least(n_rel, coalesce(n_hits, 0)) > 0 THEN dcg / list_sum(list_transform(range(1, least(n_rel, n_hits) + 1), lambda i: 1 / log2(i + 1))) ELSE 0 END AS ndcg FROM n LEFT JOIN f USING (qid))"""


@REG.query("documents", sql=f"WITH {BM25}, {_HITS}, {_REL}, {_SCORED} SELECT qid, hit::INT AS hit, round(reciprocal, 6) AS reciprocal, round(ndcg, 6) AS ndcg FROM s")
def query_scores(docs):
    return M.score_queries(hits_of(docs), labels(docs), 10).select("qid", "hit", F.round("reciprocal", 6).alias("reciprocal"), F.round("ndcg", 6).alias("ndcg"))


@REG.query("documents", sql=f"WITH {BM25}, {_HITS}, {_REL}, {_SCORED} SELECT count(*)::BIGINT AS queries, round(avg(hit), 6) AS hit_rate, round(avg(reciprocal), 6) AS mrr, round(avg(ndcg), 6) AS ndcg FROM s")
def retrieval_metrics(docs):
    return M.summarize_queries(M.score_queries(hits_of(docs), labels(docs), 10))


@REG.query("documents", sql=f"""WITH {BM25} {DENSE}, {_HITS}, {_VHITS}, a AS (SELECT qid, arg_min(key, rank) AS t, list(DISTINCT key) AS l FROM h WHERE rank <= 10 GROUP BY 1), c AS (SELECT qid, arg_min(key, rank) AS t, list(DISTINCT key) AS l FROM vh WHERE rank <= 10 GROUP BY 1)
SELECT qid, coalesce(a.t = c.t, false) AS same_top, round(coalesce(len(list_intersect(a.l, c.l)), 0) / 10, 6) AS overlap FROM a FULL JOIN c USING (qid)""")
def run_agreement(docs):
    dense = R.ranked(R.dense(R.prepared(corpus(docs)), questions(docs)), 1 << 30, ("qid",)).select("qid", F.col("id").alias("key"), "rank")
    return M.run_agreement(hits_of(docs), dense, 10)


_TITLES = "t AS (SELECT DISTINCT doc, regexp_replace(doc, '^.*/', '') AS a, regexp_replace(regexp_replace(src_path, '^.*/', ''), '\\.[A-Za-z0-9]+$', '') AS b FROM index_meta WHERE doc IS NOT NULL AND src_path IS NOT NULL)".replace("\\\\", "\\")


@REG.query("index_meta", sql=f"WITH {_TITLES} SELECT doc, levenshtein(a, b)::INT AS distance, round(least(1.0::DOUBLE, levenshtein(a, b) / length(b)), 6) AS cer FROM t WHERE length(b) > 0")
def character_error(meta):
    """A document's name against the name of its file."""
    t = meta.filter("doc IS NOT NULL AND src_path IS NOT NULL").select("doc", F.regexp_replace("doc", "^.*/", "").alias("a"), F.regexp_replace(F.regexp_replace("src_path", "^.*/", ""), r"\.[A-Za-z0-9]+$", "").alias("b")).distinct()
    return t.filter(F.length("b") > 0).select("doc", F.levenshtein("a", "b").alias("distance"), F.round(M.error_rate(F.col("a"), F.col("b")), 6).alias("cer"))


@REG.query("index_meta", sql=f"""WITH {_TITLES}, r AS (SELECT split_part(doc, '/', 1) AS class, least(1.0::DOUBLE, levenshtein(a, b) / length(b)) AS cer, CASE WHEN a = b THEN 1 ELSE 0 END AS right_, 1 AS asked FROM t WHERE length(b) > 0)
SELECT class, count(*)::BIGINT AS n, round(avg(cer), 6) AS cer, round(sum(right_) / sum(asked), 6) AS exact, sum(asked)::BIGINT AS asked FROM r GROUP BY ROLLUP (class)""")
def metric_rollup(meta):
    t = meta.filter("doc IS NOT NULL AND src_path IS NOT NULL").select("doc", F.regexp_replace("doc", "^.*/", "").alias("a"), F.regexp_replace(F.regexp_replace("src_path", "^.*/", ""), r"\.[A-Za-z0-9]+$", "").alias("b")).distinct().filter(F.length("b") > 0)
    rows = t.select(F.split_part("doc", F.lit("/"), F.lit(1)).alias("class"), M.error_rate(F.col("a"), F.col("b")).alias("cer"), (F.col("a") == F.col("b")).cast("int").alias("right"), F.lit(1).alias("asked"))
    return M.pooled(rows, "class")


@REG.query("index_meta", sql="""WITH m AS (SELECT DISTINCT * FROM index_meta WHERE built_at IS NOT NULL), a AS (SELECT doc, min(build_s) AS x FROM m WHERE model = 'mini-64-v1' GROUP BY 1), b AS (SELECT doc, min(build_s) AS x FROM m WHERE model = 'mini-64-v2' GROUP BY 1)
SELECT doc, a.x AS before, b.x AS after, round(b.x - a.x, 6) AS delta, CASE WHEN b.x - a.x IS NULL THEN 'only one' WHEN round(b.x - a.x, 6) > 0.02 THEN 'worse' WHEN round(b.x - a.x, 6) < -0.02 THEN 'better' ELSE 'same' END AS verdict FROM a FULL JOIN b USING (doc)""")
def compare_runs(meta):
    runs = [meta.distinct().filter((F.col("built_at").isNotNull()) & (F.col("model") == m)).groupBy("doc").agg(F.min("build_s").alias("build_s")) for m in ("mini-64-v1", "mini-64-v2")]
    return M.order_deltas(*runs, "doc", "build_s", 0.02)


@REG.query("chunk", "page_table", sql=r"""WITH c AS (SELECT DISTINCT doc, try_cast(page AS INT) AS page, chunk_id, text FROM chunk WHERE text IS NOT NULL AND page <> ''),
t AS (SELECT DISTINCT doc, page, table_no, rows FROM page_table WHERE rows IS NOT NULL),
tk AS (SELECT doc, page, table_no AS truth, token, count(*) AS n FROM (SELECT doc, page, table_no, unnest(regexp_extract_all(lower(array_to_string(list_filter(flatten(list_filter(rows, lambda r: r IS NOT NULL)), lambda x: x IS NOT NULL), ' ')), '[\p{L}\p{N}]+')) AS token FROM t) GROUP BY ALL),
ck AS (SELECT doc, page, chunk_id AS read_, token, count(*) AS m FROM (SELECT doc, page, chunk_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS token FROM c) GROUP BY ALL),
s AS (SELECT doc, page, truth, read_, sum(least(n, m))::BIGINT AS shared FROM tk JOIN ck USING (doc, page, token) GROUP BY ALL)
SELECT doc, page, truth, read_ AS "read", shared FROM s QUALIFY row_number() OVER (PARTITION BY doc, page, truth ORDER BY shared DESC, read_) = 1""")
def table_matches(chunks, tables):
    """Each table's chunk: the one of its page that shares most words with it."""
    token = lambda t: F.explode(F.regexp_extract_all(F.lower(t), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).alias("token")
    flat = F.array_join(F.filter(F.flatten(F.filter("rows", lambda r: r.isNotNull())), lambda c: c.isNotNull()), " ")
    truth = tables.filter("rows IS NOT NULL").dropDuplicates(["doc", "page", "table_no"]).select("doc", "page", F.col("table_no").alias("item"), token(flat))
    read = chunks.filter("text IS NOT NULL AND page <> ''").dropDuplicates(["chunk_id"]).select("doc", F.col("page").try_cast("int").alias("page"), F.col("chunk_id").alias("item"), token(F.col("text")))
    return M.best_match(truth, read, ["doc", "page"]).select("doc", "page", "truth", "read", "shared")


_FULL = "f AS (SELECT doc, string_agg('<!-- page ' || page || ' -->' || chr(10) || chr(10) || md, chr(10) || chr(10) ORDER BY page) AS md FROM (SELECT DISTINCT doc, page, md FROM page WHERE md IS NOT NULL) GROUP BY doc)"


@REG.query("page", sql=f"WITH {_FULL} SELECT doc, md FROM f")
def joined_documents(pages):
    return D.join_pages(pages)


@REG.query("page", sql="SELECT DISTINCT doc, page::VARCHAR AS page, trim(md, ' ' || chr(9) || chr(10) || chr(13)) AS md FROM page WHERE trim(md, ' ' || chr(9) || chr(10) || chr(13)) <> ''")
def split_documents(pages):
    """Joined documents cut at their markers give the pages again."""
    return D.split_pages(D.join_pages(pages), "md")


@REG.query("page", sql=f"WITH {_FULL} SELECT doc, md[101:600] AS part, length(md)::INT AS total, CASE WHEN length(md) > 600 THEN 600 END::INT AS next_offset FROM f")
def read_slices(pages):
    return D.read(D.join_pages(pages), "md", 100, 500)


@REG.query("page", sql="SELECT doc, string_agg(md, chr(10) || chr(10) ORDER BY page) AS md FROM (SELECT DISTINCT doc, page, md FROM page WHERE md IS NOT NULL AND page BETWEEN 2 AND 3) GROUP BY doc")
def read_page_range(pages):
    return D.page_range(pages, "2-3")


@REG.query("index_meta", sql="SELECT DISTINCT doc FROM index_meta WHERE regexp_full_match(doc, '(finance|claims)/.*[0-9]{4}.*')")
def list_documents(meta):
    """Names under two prefixes that match a glob with '*' across slashes."""
    return D.matching(meta.select("doc").distinct(), "doc", ["finance/", "claims/"], "*[0-9][0-9][0-9][0-9]*")


@REG.query("index_meta", sql="""WITH d AS (SELECT DISTINCT doc, regexp_replace(doc, '^.*/', '') AS short FROM index_meta), i AS (SELECT doc AS ident FROM d WHERE doc LIKE 'security/%' UNION SELECT upper(short) FROM d WHERE doc LIKE 'claims/%'),
k AS (SELECT ident, doc, 1 AS tier FROM i JOIN d ON doc = ident UNION ALL SELECT ident, doc, 2 FROM i JOIN d ON lower(doc) = lower(ident) UNION ALL SELECT ident, doc, 3 FROM i JOIN d ON short = ident UNION ALL SELECT ident, doc, 4 FROM i JOIN d ON lower(short) = lower(ident)),
b AS (SELECT ident, min(tier) AS tier FROM k GROUP BY 1), r AS (SELECT ident, tier, count(DISTINCT doc) AS n, min(doc) AS doc FROM k JOIN b USING (ident, tier) GROUP BY 1, 2)
SELECT i.ident, CASE WHEN n = 1 THEN doc END AS doc, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'ambiguous' ELSE 'found' END AS state FROM i LEFT JOIN r USING (ident)""")
def resolved_names(meta):
    d = meta.select("doc").distinct()
    asked = d.filter("doc LIKE 'security/%'").select(F.col("doc").alias("ident")).union(d.filter("doc LIKE 'claims/%'").select(F.upper(F.regexp_replace("doc", "^.*/", "")).alias("ident"))).distinct()
    return D.resolve(asked, d)


@REG.query("documents", sql=r"""WITH d AS (SELECT doc_id, string_split(text, ' ') AS ws FROM documents WHERE text IS NOT NULL), k AS (SELECT doc_id, ws, ('0x' || md5('7|' || doc_id)[1:6])::BIGINT AS h FROM d WHERE len(ws) >= 60)
SELECT doc_id, array_to_string(ws[h % (len(ws) - 30) + 11 : h % (len(ws) - 30) + 10 + 8 + h % 7], ' ') AS query FROM k""")
def generated_queries(docs):
    """A query of 8 to 14 words from inside each document of at least sixty, at a place drawn from a hash."""
    h = F.conv(F.left(F.md5(F.concat(F.lit("7|"), "doc_id")), F.lit(6)), 16, 10).cast("long")
    k = docs.filter("text IS NOT NULL").select("doc_id", F.split("text", " ").alias("ws"), h.alias("h")).filter(F.size("ws") >= 60)
    start = (F.col("h") % (F.size("ws") - 30) + 11).cast("int")
    return k.select("doc_id", F.array_join(F.slice("ws", start, (8 + F.col("h") % 7).cast("int")), " ").alias("query"))


QUERIES, SQL = REG.queries, REG.sql
