"""Text quality, page routing, gates and their aggregation over page, chunk, documents and trace."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.functions.text import dominant_script, implausible_share, plain, script_counts, words
from folio.operators import pages as P
from folio.plans.registry import Registry
from folio.session import est_tokens, spread

REG = Registry()
_PAGE = "SELECT DISTINCT doc, page, md FROM page WHERE md IS NOT NULL"
_DOCS = "SELECT doc_id, text FROM documents WHERE text IS NOT NULL"


def unique_pages(pages):
    """One row for each page with text; copies once."""
    return pages.filter(F.col("md").isNotNull()).dropDuplicates(["doc", "page"]).select("doc", "page", "md")


_SCRIPT = r"""
c AS (SELECT *, len(regexp_extract_all(t, '\p{L}')) AS total, len(regexp_extract_all(regexp_replace(t, '[^\p{L}]', '', 'g'), '[\x{0000}-\x{024F}]')) AS latin,
 len(regexp_extract_all(regexp_replace(t, '[^\p{L}]', '', 'g'), '[\x{0900}-\x{097F}]')) AS a, len(regexp_extract_all(regexp_replace(t, '[^\p{L}]', '', 'g'), '[\x{0400}-\x{04FF}]')) AS b,
 len(regexp_extract_all(regexp_replace(t, '[^\p{L}]', '', 'g'), '[\x{0E00}-\x{0E7F}]')) AS c, len(regexp_extract_all(regexp_replace(t, '[^\p{L}]', '', 'g'), '[\x{3040}-\x{30FF}]')) AS d,
 len(regexp_extract_all(regexp_replace(t, '[^\p{L}]', '', 'g'), '[\x{4E00}-\x{9FFF}]')) AS e FROM src),
script AS (SELECT *, CASE WHEN total < 10 THEN '' WHEN greatest(a, b, c, d, e) * 4 >= total THEN CASE greatest(a, b, c, d, e) WHEN a THEN 'Devanagari' WHEN b THEN 'Cyrillic' WHEN c THEN 'Thai' WHEN d THEN 'Kana' ELSE 'Han' END
  WHEN latin * 10 >= total * 6 THEN 'Latin' ELSE 'Mixed' END AS script FROM c)
"""


@REG.query("documents", sql=f"WITH src AS (SELECT doc_id, text AS t FROM ({_DOCS})), {_SCRIPT} SELECT doc_id, total::BIGINT AS letters, script FROM script")
def script_dominant(docs):
    counted = spread(docs.filter("text IS NOT NULL").select("doc_id", "text")).select("doc_id", script_counts(F.col("text")).alias("counts"))
    return counted.select("doc_id", F.col("counts.letters").alias("letters"), dominant_script(F.col("counts")).alias("script"))


_EST = r"CASE WHEN w > 0 THEN greatest(floor(w * 1.3::DOUBLE)::BIGINT + 1, length(text) // 4) ELSE 0 END"


@REG.query("documents", sql=rf"WITH s AS (SELECT doc_id, text, len(regexp_extract_all(text, '[^ \t\r\n]+')) AS w FROM ({_DOCS})) SELECT doc_id, {_EST}::BIGINT AS tokens FROM s")
def estimated_tokens(docs):
    return spread(docs.filter("text IS NOT NULL").select("doc_id", "text")).select("doc_id", est_tokens(F.col("text")).alias("tokens"))


@REG.query("documents", sql=rf"""WITH w AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[a-z0-9\x{{00C0}}-\x{{024F}}]*[a-z\x{{00C0}}-\x{{024F}}][a-z0-9\x{{00C0}}-\x{{024F}}]*'), lambda x: length(x) >= 4) AS ws FROM ({_DOCS}))
SELECT doc_id, round(len(list_filter(ws, lambda x: regexp_matches(x, '[0-9]') OR NOT regexp_matches(x, '[aeiouy\x{{00C0}}-\x{{024F}}]') OR regexp_matches(x, '[bcdfghjklmnpqrstvwxz]{{5}}'))) / nullif(len(ws), 0), 6) AS share FROM w""")
def plausibility(docs):
    return spread(docs.filter("text IS NOT NULL").select("doc_id", "text")).select("doc_id", F.round(implausible_share(F.col("text")), 6).alias("share"))


@REG.query("page", sql=rf"""WITH p AS ({_PAGE}),
a AS (SELECT doc, page, regexp_replace(regexp_replace(md, '(?s)<!--.*?-->', ' ', 'g'), '<[^<>]{{1,200}}>', ' ', 'g') AS t FROM p)
SELECT doc, page, trim(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '(?m)^[ |:\-]{{3,}}$', ' ', 'g'), '[|*`#]', ' ', 'g'), '[ \t\r\n]+', ' ', 'g')) AS text FROM a""")
def plain_text(pages):
    return unique_pages(pages).select("doc", "page", plain(F.col("md")).alias("text"))


@REG.query("documents", sql=rf"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM ({_DOCS})),
n AS (SELECT doc_id, trim(regexp_replace(line, '[\s|:\-]+', ' ', 'g')) AS line FROM l), s AS (SELECT * FROM n WHERE length(line) >= 10),
k AS (SELECT doc_id, line, count(*) AS times FROM s GROUP BY 1, 2)
SELECT doc_id, sum(times)::BIGINT AS lines, max(times)::BIGINT AS repeats, max(times) >= 8 AND max(times) >= 0.25::DOUBLE * sum(times) AS runaway FROM k GROUP BY 1""")
def line_repeats(docs):
    return P.line_repeats(spread(docs.filter("text IS NOT NULL").select("doc_id", "text")), "doc_id")


@REG.query("documents", sql=rf"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+') AS ws FROM ({_DOCS})),
g AS (SELECT doc_id, unnest(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i : i + 3], ' '))) AS gram FROM w WHERE len(ws) >= 4),
k AS (SELECT doc_id, gram, count(*) AS times FROM g GROUP BY 1, 2)
SELECT doc_id, sum(times)::BIGINT AS grams, max(times)::BIGINT AS repeats, max(times) >= 25 AND max(times) >= 0.1::DOUBLE * sum(times) AS runaway FROM k GROUP BY 1""")
def four_grams(docs):
    return P.phrase_repeats(spread(docs.filter("text IS NOT NULL").select("doc_id", "text")), "doc_id", words)


@REG.query("documents")
def degenerate(docs):
    return P.compression(spread(docs.filter("text IS NOT NULL").select("doc_id", "text")), "doc_id")


@REG.query("page", sql=rf"""WITH p AS ({_PAGE}), l AS (SELECT doc, page, unnest(string_split(md, chr(10))) AS line FROM p),
k AS (SELECT DISTINCT doc, page, regexp_replace(lower(trim(regexp_replace(line, '\s+', ' ', 'g'))), '[0-9]+', '#', 'g') AS band FROM l WHERE trim(line) <> '')
SELECT doc, band, count(*)::BIGINT AS pages FROM k GROUP BY 1, 2 HAVING count(*) >= 3""")
def boilerplate_lines(pages):
    return P.repeated_bands(unique_pages(pages), 3)


_WORDBAG = r"list_filter(regexp_extract_all(lower(replace(regexp_replace({t}, '([\p{{L}}\p{{N}}_])-[ \t]*\n[ \t]*([\p{{L}}\p{{N}}_])', '\1\2', 'g'), chr(92), '')), '\p{{L}}+'), lambda w: length(w) >= 2)"


@REG.query("chunk", "page", sql=rf"""
WITH c AS (SELECT DISTINCT chunk_id, doc, page, text FROM chunk WHERE text IS NOT NULL AND page <> ''), p AS ({_PAGE}),
a AS (SELECT doc, page, word, count(*) AS n FROM (SELECT doc, page, unnest({_WORDBAG.format(t='text')}) AS word FROM c) GROUP BY ALL),
b AS (SELECT doc, page::VARCHAR AS page, word, count(*) AS m FROM (SELECT doc, page, unnest({_WORDBAG.format(t='md')}) AS word FROM p) GROUP BY ALL)
, s AS (SELECT doc, page, sum(n)::BIGINT AS layer_words, sum(least(n, coalesce(m, 0)))::BIGINT AS kept FROM a LEFT JOIN b USING (doc, page, word) GROUP BY 1, 2)
SELECT doc, page, layer_words, kept, round(kept / layer_words, 6) AS recall, CASE WHEN layer_words < 15 THEN 'uncertain' WHEN kept / layer_words < 0.9::DOUBLE THEN 'lost text' WHEN kept / layer_words >= 0.97::DOUBLE THEN 'intact' ELSE 'uncertain' END AS verdict FROM s""")
def layer_verdict(chunks, pages):
    """A page's chunks are its text layer, its Markdown the conversion."""
    layer = chunks.filter("text IS NOT NULL AND page <> ''").dropDuplicates(["chunk_id"]).select("doc", "page", "text")
    return P.layer_recall(layer, unique_pages(pages).select("doc", F.col("page").cast("string").alias("page"), F.col("md").alias("text")))


@REG.query("chunk", "page", sql=rf"""
WITH c AS (SELECT DISTINCT chunk_id, doc, page, text FROM chunk WHERE text IS NOT NULL AND page <> ''), p AS ({_PAGE}),
a AS (SELECT doc, page, word, count(*) AS n FROM (SELECT doc, page, unnest({_WORDBAG.format(t='text')}) AS word FROM c) GROUP BY ALL),
b AS (SELECT doc, page::VARCHAR AS page, word, count(*) AS m FROM (SELECT doc, page, unnest({_WORDBAG.format(t='md')}) AS word FROM p) GROUP BY ALL)
SELECT word, sum(n - coalesce(m, 0))::BIGINT AS missing FROM a LEFT JOIN b USING (doc, page, word) WHERE n > coalesce(m, 0) GROUP BY word""")
def missing_words(chunks, pages):
    layer = chunks.filter("text IS NOT NULL AND page <> ''").dropDuplicates(["chunk_id"]).select("doc", "page", "text")
    return P.missing_words(layer, unique_pages(pages).select("doc", F.col("page").cast("string").alias("page"), F.col("md").alias("text")))


@REG.query("page", sql=rf"""WITH src AS (SELECT doc, page, md, regexp_replace(md, '[^\p{{L}}\p{{N}}\p{{M}}]', '', 'g') AS t FROM ({_PAGE})), {_SCRIPT},
f AS (SELECT doc, page, script, length(t) AS chars, md LIKE '%![%' AS pictures FROM script)
SELECT doc, page, script, chars::BIGINT AS chars, CASE WHEN chars = 0 THEN 'raster' WHEN chars < 40 AND pictures THEN 'raster' WHEN script = 'Mixed' THEN 'raster' ELSE 'digital' END AS branch,
  CASE WHEN chars = 0 THEN 'no text' WHEN chars < 40 AND pictures THEN 'hardly any text beside pictures' WHEN chars < 40 THEN 'short page' WHEN script = 'Mixed' THEN 'no script prevails' ELSE 'good text layer' END AS why FROM f""")
def route_pages(pages):
    return P.route(unique_pages(pages))


@REG.query("page", "page_table", sql=rf"""WITH src AS (SELECT doc, page, md, md AS t FROM ({_PAGE})), {_SCRIPT},
w AS (SELECT doc, page, list_filter(regexp_extract_all(lower(md), '[a-z0-9\x{{00C0}}-\x{{024F}}]*[a-z\x{{00C0}}-\x{{024F}}][a-z0-9\x{{00C0}}-\x{{024F}}]*'), lambda x: length(x) >= 4) AS ws FROM src),
i AS (SELECT doc, page, coalesce(len(list_filter(ws, lambda x: regexp_matches(x, '[0-9]') OR NOT regexp_matches(x, '[aeiouy\x{{00C0}}-\x{{024F}}]') OR regexp_matches(x, '[bcdfghjklmnpqrstvwxz]{{5}}'))) / nullif(len(ws), 0), 0) AS bad FROM w),
tb AS (SELECT doc, page, bool_or(rg) AS ragged FROM (SELECT DISTINCT doc, page, table_no, coalesce(list_max(list_transform(list_filter(rows, lambda r: r IS NOT NULL), lambda r: len(r))) <> list_min(list_transform(list_filter(rows, lambda r: r IS NOT NULL), lambda r: len(r))), false) AS rg FROM page_table) GROUP BY 1, 2),
f AS (SELECT doc, page, list_filter([CASE WHEN total < 10 THEN 'coverage' END, CASE WHEN script = 'Mixed' THEN 'script' END, CASE WHEN bad > 0.25::DOUBLE THEN 'plausibility' END, CASE WHEN coalesce(ragged, false) THEN 'table_shape' END], lambda x: x IS NOT NULL) AS failed
  FROM script JOIN i USING (doc, page) LEFT JOIN tb USING (doc, page))
SELECT doc, page, array_to_string(failed, ',') AS failed, CASE WHEN list_contains(failed, 'coverage') THEN 'empty' WHEN len(failed) > 0 THEN 'suspect' ELSE 'ok' END AS verdict,
  CASE WHEN list_contains(failed, 'coverage') THEN 'no_text' WHEN len(list_filter(failed, lambda x: x <> 'table_shape')) > 0 THEN 'low' ELSE 'pass' END AS outcome FROM f""")
def gate_checks(pages, tables):
    return P.gate(unique_pages(pages), tables)


_BR = r"""route AS (SELECT doc, page, CASE WHEN n = 0 OR n < 40 AND md LIKE '%![%' THEN 'raster' WHEN n < 1200 THEN 'digital' ELSE 'office' END AS branch FROM (SELECT *, length(regexp_replace(md, '[^\p{L}\p{N}\p{M}]', '', 'g')) AS n FROM p))"""


def branches(pages):
    """A branch for each page by how much text it holds."""
    n = P.real_chars(F.col("md"))
    return unique_pages(pages).select("doc", "page", F.when((n == 0) | (n < 40) & F.col("md").contains("!["), "raster").when(n < 1200, "digital").otherwise("office").alias("branch"))


@REG.query("page", sql=f"""WITH p AS ({_PAGE}), {_BR},
g AS (SELECT *, CASE WHEN lag(branch) OVER w = branch THEN 0 ELSE 1 END AS opens FROM route WINDOW w AS (PARTITION BY doc ORDER BY page)),
r AS (SELECT *, sum(opens) OVER (PARTITION BY doc ORDER BY page) AS run FROM g),
k AS (SELECT doc, run, any_value(branch) AS branch, count(*) AS n FROM r GROUP BY 1, 2)
SELECT doc, string_agg(branch[1] || CASE WHEN n > 1 THEN n::VARCHAR ELSE '' END, '' ORDER BY run) AS strip FROM k GROUP BY doc""")
def run_strip(pages):
    return P.strip(branches(pages))


@REG.query("page", sql=f"WITH p AS ({_PAGE}), {_BR} SELECT doc, branch[1] AS letter, count(*)::BIGINT AS pages FROM route GROUP BY 1, 2")
def strip_decode(pages):
    return P.unstrip(P.strip(branches(pages))).groupBy("doc", "letter").agg(F.sum("n").alias("pages"))


@REG.query("page", sql=f"""WITH p AS ({_PAGE}), k AS (SELECT doc, page, page - row_number() OVER (PARTITION BY doc ORDER BY page) AS island FROM p),
r AS (SELECT doc, island, min(page) AS a, max(page) AS b FROM k GROUP BY 1, 2)
SELECT doc, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END, ', ' ORDER BY a) AS ranges FROM r GROUP BY doc""")
def page_ranges(pages):
    return P.ranges(unique_pages(pages))


@REG.query("page", sql=f"""WITH p AS ({_PAGE}), {_BR} SELECT doc, count(*)::BIGINT AS pages, count(CASE WHEN branch = 'digital' THEN 1 END)::BIGINT AS digital, count(CASE WHEN branch = 'raster' THEN 1 END)::BIGINT AS raster,
 count(CASE WHEN branch = 'office' THEN 1 END)::BIGINT AS office, min(page)::INT AS first_page, max(page)::INT AS last_page FROM route GROUP BY doc""")
def page_summary(pages):
    count = lambda b: F.count_if(F.col("branch") == b).alias(b)
    return branches(pages).groupBy("doc").agg(F.count("*").alias("pages"), count("digital"), count("raster"), count("office"), F.min("page").cast("int").alias("first_page"), F.max("page").cast("int").alias("last_page"))


@REG.query("page", sql=f"""WITH p AS ({_PAGE}), {_BR} SELECT split_part(doc, '/', 1) AS collection, branch, count(*)::BIGINT AS pages, count(DISTINCT doc)::BIGINT AS docs FROM route GROUP BY GROUPING SETS ((split_part(doc, '/', 1), branch), (branch), ())""")
def run_totals(pages):
    rows = branches(pages).withColumn("collection", F.split_part("doc", F.lit("/"), F.lit(1)))
    return rows.groupingSets([["collection", "branch"], ["branch"], []], "collection", "branch").agg(F.count("*").alias("pages"), F.count_distinct("doc").alias("docs"))


@REG.query("page", "page_table", sql=rf"""
WITH t AS (SELECT DISTINCT doc, page, table_no, rows FROM page_table WHERE rows IS NOT NULL),
w AS (SELECT doc, page, table_no, len(rows[1]) AS width, list_transform(rows[1], lambda c: lower(trim(coalesce(c, '')))) AS head FROM t),
l AS (SELECT doc, page, arg_max(struct_pack(width := width, head := head), table_no) AS x FROM w GROUP BY 1, 2),
f AS (SELECT doc, page, arg_min(struct_pack(width := width, head := head), table_no) AS y FROM w GROUP BY 1, 2)
SELECT l.doc, l.page, f.page AS next_page, x.width = y.width AS same_width, x.head = y.head AS repeated_header FROM l JOIN f ON l.doc = f.doc AND f.page = l.page + 1""")
def table_continuations(pages, tables):
    return P.continuations(tables)


@REG.query("chunk")
def chunk_nodes(chunks):
    """The packing of blocks into nodes with headings, over the texts of the chunk table."""
    from folio.operators.chunker import nodes

    return nodes(chunks.filter("text IS NOT NULL").dropDuplicates(["chunk_id"]), "chunk_id", "text", 128, 16)


@REG.query("chunk", sql="""WITH c AS (SELECT DISTINCT chunk_id, doc, ord, text FROM chunk WHERE text IS NOT NULL) SELECT chunk_id, left(sha1(doc || ':' || ord || ':' || left(sha256(text), 16)), 20) AS node_id FROM c WHERE doc IS NOT NULL AND ord IS NOT NULL""")
def chunk_ids(chunks):
    rows = chunks.filter("text IS NOT NULL AND doc IS NOT NULL AND ord IS NOT NULL").dropDuplicates(["chunk_id"])
    return rows.select("chunk_id", F.left(F.sha1(F.concat_ws(":", "doc", "ord", F.left(F.sha2("text", 256), F.lit(16)))), F.lit(20)).alias("node_id"))


@REG.query("chunk", "trace", sql="""WITH low AS (SELECT DISTINCT source FROM trace WHERE outcome = 'low'), c AS (SELECT DISTINCT chunk_id, source FROM chunk)
SELECT chunk_id, CASE WHEN low.source IS NOT NULL THEN 'low' END AS confidence FROM c LEFT JOIN low USING (source)""")
def low_confidence(chunks, trace):
    low = trace.filter("outcome = 'low' AND source IS NOT NULL").select("source").distinct().withColumn("confidence", F.lit("low"))
    return chunks.dropDuplicates(["chunk_id"]).select("chunk_id", "source").join(low, "source", "left").select("chunk_id", "confidence")


@REG.query("page")
def found_tables(pages):
    from folio.operators.markdown_tables import tables_of

    return tables_of(unique_pages(pages))


@REG.query("page", "page_table", sql=f"""WITH p AS ({_PAGE}), t AS (SELECT DISTINCT doc, page, table_no, start_at, end_at, lower(kind) AS kind FROM page_table WHERE kind <> '' AND rows IS NOT NULL)
SELECT doc, page, table_no, kind, substring(md, start_at + 1, 6) AS opening, end_at - start_at AS n FROM t JOIN p USING (doc, page)""")
def table_sources(pages, tables):
    """The source of each table, by its place in the page."""
    t = tables.filter("kind <> '' AND rows IS NOT NULL").select("doc", "page", "table_no", "start_at", "end_at", F.lower("kind").alias("kind")).distinct()
    return t.join(unique_pages(pages), ["doc", "page"]).select("doc", "page", "table_no", "kind", F.substring("md", F.col("start_at") + 1, F.lit(6)).alias("opening"), (F.col("end_at") - F.col("start_at")).alias("n"))


@REG.query("page")
def continued_tables(pages):
    from folio.operators.markdown_tables import reconcile

    return reconcile(unique_pages(pages))


@REG.query("chunk", "page")
def lost_lines(chunks, pages):
    from folio.operators.layers import lost_lines as lost

    layer = chunks.filter("text IS NOT NULL AND page <> ''").dropDuplicates(["chunk_id"]).select("doc", "page", "ord", "text")
    return lost(layer, unique_pages(pages).select("doc", F.col("page").cast("string").alias("page"), "md"))


QUERIES, SQL = REG.queries, REG.sql
