"""Freshness with reasons, failures, states, filters, totals, layers without furniture, phrases, completeness, names."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from folio.operators import catalog as C, keeping as K, runs as U
from folio.plans.index import _NEWEST, _RULES, rules
from folio.plans.pages import _PAGE, unique_pages
from folio.plans.registry import Registry
from folio.plans.runs import _LAST
from folio.plans.tables import distinct_tables
from folio.session import spread

REG = Registry()
_T = "t AS (SELECT DISTINCT * FROM trace WHERE src_path IS NOT NULL AND src_sha256 IS NOT NULL AND written_at IS NOT NULL)"
_PRESENT = f"{_T}, cv AS (SELECT src_path, lower(src_sha256) AS sha, convert, outcome FROM t QUALIFY row_number() OVER (PARTITION BY src_path ORDER BY written_at DESC, trace_id DESC) = 1)"
_AREA = "split_part(ltrim(regexp_replace(src_path, '/+', '/', 'g'), '/'), '/', 1)"


def area():
    return F.split_part(F.regexp_replace(F.regexp_replace("src_path", "/+", "/"), "^/", ""), F.lit("/"), F.lit(1))


@REG.query("index_meta", "trace", sql=f"""WITH {_NEWEST}, {_PRESENT}, want AS (SELECT * FROM n WHERE src_sha256 IS NOT NULL ORDER BY built_at DESC, doc LIMIT 1)
SELECT n.doc, why IS NULL AS fresh, why FROM (SELECT n.doc, CASE WHEN coalesce(n.nodes, 0) <= 0 THEN 'nodes' WHEN coalesce(n.dim, 0) <= 0 THEN 'vectors' WHEN lower(n.src_sha256) IS DISTINCT FROM cv.sha THEN 'checksum'
  {" ".join(f"WHEN n.{s} IS DISTINCT FROM w.{s} THEN '{s}'" for s in K.SETTINGS)} END AS why FROM n LEFT JOIN cv USING (src_path), want w) n""")
def freshness_reasons(meta, trace):
    """Every newest build against the present checksum and the settings of the build made last, all seven of them."""
    builds = C.newest_builds(meta)
    last = builds.filter("src_sha256 IS NOT NULL").orderBy(F.desc("built_at"), "doc").limit(1).collect()
    wanted = last[0].asDict() if last else dict.fromkeys(K.SETTINGS)
    return K.fresh_builds(builds, K.conversions(trace).select("src_path", "sha"), wanted)


@REG.query("index_meta", "trace", sql=f"WITH {_NEWEST}, {_PRESENT} SELECT n.doc, lower(n.src_sha256) IS NOT DISTINCT FROM cv.sha AND n.convert IS NOT DISTINCT FROM cv.convert AS is_current FROM n LEFT JOIN cv USING (src_path)")
def markdown_current(meta, trace):
    """Whether the Markdown of each build is that of the present content, converted as it was converted last."""
    rows = C.newest_builds(meta).select("doc", "src_path", "src_sha256", F.col("convert").alias("was")).join(K.conversions(trace), "src_path", "left")
    return rows.select("doc", (F.lower("src_sha256").eqNullSafe(F.col("sha")) & F.col("was").eqNullSafe(F.col("convert"))).alias("is_current"))


@REG.query("trace", sql=f"""WITH {_PRESENT}, y AS (SELECT DISTINCT src_path, lower(src_sha256) AS sha, trace_id, outcome FROM t)
SELECT src_path, sha, count(*)::BIGINT AS tries FROM y JOIN (SELECT src_path, sha FROM cv) USING (src_path, sha) GROUP BY 1, 2 HAVING count(CASE WHEN outcome = 'error' THEN 1 END) = count(*)""")
def remembered_failures(trace):
    return K.remembered(trace)


@REG.query("source_location", "index_meta", "chunk", "trace", sql=f"""WITH s AS (SELECT DISTINCT collection, root FROM source_location), {_T},
m AS (SELECT split_part(doc, '/', 1) AS collection, count(DISTINCT doc) AS docs, count(CASE WHEN built_at IS NULL THEN 1 END) AS open_ FROM index_meta GROUP BY 1),
p AS (SELECT DISTINCT collection, true AS out_ FROM chunk), v AS (SELECT DISTINCT split_part(doc, '/', 1) AS collection, true AS live FROM index_meta JOIN t USING (src_path)), h AS (SELECT DISTINCT collection, true AS here FROM s)
SELECT collection, coalesce(docs, 0)::BIGINT AS docs, CASE WHEN here IS NULL THEN 'imported' WHEN docs IS NULL THEN 'not_indexed' WHEN live IS NULL THEN 'unreachable' WHEN open_ > 0 THEN 'pending' WHEN out_ IS NULL THEN 'unpublished' ELSE 'ok' END AS state
FROM h FULL JOIN m USING (collection) LEFT JOIN p USING (collection) LEFT JOIN v USING (collection)""")
def all_states(locations, meta, chunks, trace):
    """All six states; a collection is reachable if a file of it was converted under its present path."""
    converted = trace.filter("src_path IS NOT NULL AND src_sha256 IS NOT NULL AND written_at IS NOT NULL").select("src_path").distinct()
    seen = meta.select("doc", "src_path").distinct().join(converted, "src_path", "left_semi").select(F.split_part("doc", F.lit("/"), F.lit(1)).alias("collection"))
    return K.states(locations, meta, chunks, seen)


@REG.query("trace", sql=f"""WITH {_LAST}, d AS (SELECT source, {_AREA} AS area, convert, coalesce(outcome, 'unknown') AS outcome, coalesce(pages, 0) AS pages FROM l)
SELECT count(CASE WHEN area IS NULL OR area <> 'tmp' THEN 1 END)::BIGINT AS before, count(CASE WHEN k THEN 1 END)::BIGINT AS after, coalesce(sum(CASE WHEN k THEN pages END), 0)::BIGINT AS pages FROM (SELECT *, (area IS NULL OR area <> 'tmp') AND convert = 'auto-5' AND outcome IN ('low', 'error') AND contains(lower(source), 'e') AS k FROM d)""")
def run_filters(trace):
    """Documents of a run by reader, group of outcomes and text, hidden areas left out."""
    rows = U.last_rows(trace).select("source", area().alias("area"), "convert", F.coalesce("outcome", F.lit("unknown")).alias("outcome"), F.coalesce("pages", F.lit(0)).alias("pages"))
    return K.run_filters(rows, convert="auto-5", group=("low", "error"), text="E", hidden=("tmp",))


@REG.query("trace", sql="""WITH t AS (SELECT DISTINCT * FROM trace), k AS (SELECT coalesce(convert, 'none') AS convert, coalesce(outcome, 'unknown') AS outcome, count(*)::BIGINT AS n, sum(coalesce(pages, 0))::BIGINT AS pages, count(CASE WHEN pages > 0 THEN 1 END)::BIGINT AS read_ FROM t GROUP BY CUBE (coalesce(convert, 'none'), coalesce(outcome, 'unknown')))
SELECT convert, outcome, n, pages, round(read_ / n, 6) AS read_share FROM k""")
def live_totals(trace):
    """Conversions and pages by reader and outcome, by either and in all, with the share that read any page."""
    rows = trace.distinct().select(F.coalesce("convert", F.lit("none")).alias("convert"), F.coalesce("outcome", F.lit("unknown")).alias("outcome"), F.coalesce("pages", F.lit(0)).alias("p"))
    k = rows.cube("convert", "outcome").agg(F.count("*").alias("n"), F.sum("p").cast("long").alias("pages"), F.count_if(F.col("p") > 0).alias("read"))
    return k.select("convert", "outcome", "n", "pages", F.round(F.col("read") / F.col("n"), 6).alias("read_share"))


@REG.query("index_meta", sql="""WITH m AS (SELECT DISTINCT * FROM index_meta), x AS (SELECT split_part(doc, '/', 1) AS collection, sum(convert_s) AS convert_s, sum(chunk_s) AS chunk_s, sum(embed_s) AS embed_s, sum(build_s) AS build_s, sum(nodes) AS nodes, count(*) AS n, count(built_at) AS done FROM m GROUP BY 1)
SELECT collection, round(100.0::DOUBLE * done / n, 2) AS pct, round(convert_s, 3) AS convert_s, round(chunk_s, 3) AS chunk_s, round(embed_s, 3) AS embed_s, round(nodes / nullif(embed_s, 0), 4) AS chunks_per_s FROM x""")
def phases(meta):
    """How far each collection is, the seconds of its phases, and chunks embedded a second."""
    x = meta.distinct().groupBy(F.split_part("doc", F.lit("/"), F.lit(1)).alias("collection")).agg(*(F.sum(c).alias(c) for c in ("convert_s", "chunk_s", "embed_s")), F.sum("nodes").alias("nodes"), F.count("*").alias("n"), F.count("built_at").alias("done"))
    return x.select("collection", F.round(100.0 * F.col("done") / F.col("n"), 2).alias("pct"), *(F.round(c, 3).alias(c) for c in ("convert_s", "chunk_s", "embed_s")), F.round(F.try_divide(F.col("nodes"), F.nullif("embed_s", F.lit(0.0))), 4).alias("chunks_per_s"))


@REG.query("chunk", sql="""WITH c AS (SELECT DISTINCT collection, chunk_id, length(text) AS size FROM chunk WHERE text IS NOT NULL), p AS (SELECT *, count(*) OVER (PARTITION BY collection) AS n, row_number() OVER (PARTITION BY collection ORDER BY chunk_id) - 1 AS place FROM c)
SELECT collection, max(n)::BIGINT AS n, count(*)::BIGINT AS sampled, round(avg(size) * max(n), 3) AS bytes FROM p WHERE place % greatest(1, n // 300) = 0 GROUP BY 1""")
def index_memory(chunks):
    """An estimate by sampling, which is the feature: every n/300-th chunk of a collection is measured."""
    rows = chunks.filter("text IS NOT NULL").select("collection", "chunk_id", F.length("text").alias("size")).distinct()
    return K.memory(rows, "collection", "chunk_id", F.col("size"))


@REG.query("page", "page_table", "chunk", sql=f"""WITH p AS (SELECT doc, page::VARCHAR AS page, length(md) AS chars FROM ({_PAGE})), t AS (SELECT doc, page::VARCHAR AS page, count(DISTINCT table_no) AS tables FROM page_table GROUP BY 1, 2), c AS (SELECT doc, page, count(DISTINCT chunk_id) AS chunks FROM chunk WHERE page <> '' GROUP BY 1, 2)
SELECT doc, page, chars::BIGINT AS chars, tables::BIGINT AS tables, chunks::BIGINT AS chunks FROM p FULL JOIN t USING (doc, page) FULL JOIN c USING (doc, page)""")
def page_facts(pages, tables, chunks):
    return K.page_facts(unique_pages(pages), tables, chunks).withColumn("chars", F.col("chars").cast("long"))


@REG.query("page", sql=rf"""WITH l AS (SELECT doc, page, line, i FROM (SELECT doc, page, unnest(string_split(md, chr(10))) AS line, generate_subscripts(string_split(md, chr(10)), 1) AS i FROM ({_PAGE})) WHERE trim(line) <> ''),
b AS (SELECT *, regexp_replace(lower(trim(regexp_replace(line, '\s+', ' ', 'g'))), '[0-9]+', '#', 'g') AS band, row_number() OVER (PARTITION BY doc, page ORDER BY i) AS up, row_number() OVER (PARTITION BY doc, page ORDER BY i DESC) AS down FROM l),
o AS (SELECT doc, band, true AS often FROM b GROUP BY doc, band HAVING count(DISTINCT page) >= 3),
f AS (SELECT b.*, regexp_matches(line, '{K.PAGE_NUMBER}') AS number, coalesce(often, false) AND (up <= 2 OR down <= 2) AND NOT regexp_matches(line, '{K.PAGE_NUMBER}') AS furniture FROM b LEFT JOIN o USING (doc, band))
SELECT doc, page, count(CASE WHEN NOT number AND NOT furniture THEN 1 END)::BIGINT AS kept, count(CASE WHEN number THEN 1 END)::BIGINT AS numbers, count(CASE WHEN furniture THEN 1 END)::BIGINT AS bands, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT number AND NOT furniture), '') AS text FROM f GROUP BY doc, page""")
def cleaned_layer(pages):
    return K.cleaned_layer(unique_pages(pages))


PHRASES = ["boiler manual", "annual budget", "credit note", "the safety review", "1,200", "of the"]
_TOKENS = r"array_to_string(list_filter(list_transform(string_split_regex(lower({t}), '\s+'), lambda x: regexp_replace(regexp_replace(regexp_replace(x, '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g'), '([0-9]),([0-9])', '\1\2', 'g'), '([0-9]),([0-9])', '\1\2', 'g')), lambda x: x <> ''), ' ')"


@REG.query("documents", sql=f"""WITH d AS (SELECT ' ' || {_TOKENS.format(t='text')} || ' ' AS t FROM documents WHERE text IS NOT NULL), q AS (SELECT phrase, ' ' || {_TOKENS.format(t='phrase')} || ' ' AS run FROM (SELECT unnest({PHRASES}) AS phrase))
SELECT phrase, (SELECT count(*) FROM d WHERE contains(t, run))::BIGINT AS hits FROM q""")
def phrase_hits(docs):
    return K.phrase_hits(spread(docs.filter("text IS NOT NULL").select("doc_id", "text")), "doc_id", "text", PHRASES)


@REG.query("chunk", "page", sql=rf"""WITH c AS (SELECT DISTINCT chunk_id, doc, page, text FROM chunk WHERE text IS NOT NULL AND page <> ''), p AS (SELECT doc, page::VARCHAR AS page, md FROM ({_PAGE})),
s AS (SELECT chunk_id, list_distinct(list_transform(regexp_extract_all(text, '[0-9][0-9.,]*[0-9]|[0-9]'), lambda x: replace(x, ',', ''))) AS a, list_distinct(list_transform(regexp_extract_all(md, '[0-9][0-9.,]*[0-9]|[0-9]'), lambda x: replace(x, ',', ''))) AS b,
  list_distinct(list_filter(regexp_extract_all(lower(text), '\p{{L}}+'), lambda w: length(w) >= 3)) AS u, list_distinct(list_filter(regexp_extract_all(lower(md), '\p{{L}}+'), lambda w: length(w) >= 3)) AS v FROM c JOIN p USING (doc, page))
SELECT chunk_id, len(list_intersect(a, b)) >= 0.9::DOUBLE * len(a) AND len(list_intersect(u, v)) >= 0.8::DOUBLE * len(u) AS complete FROM s""")
def reread_complete(chunks, pages):
    """A page's conversion as a second reading of each of its chunks."""
    c = chunks.filter("text IS NOT NULL AND page <> ''").dropDuplicates(["chunk_id"]).select("chunk_id", "doc", "page", "text")
    p = unique_pages(pages).select("doc", F.col("page").cast("string").alias("page"), "md")
    return c.join(p, ["doc", "page"]).select("chunk_id", K.reread_complete(F.col("text"), F.col("md")).alias("complete"))


_FLAT = r"regexp_replace(array_to_string(list_transform(list_filter(rows, lambda r: r IS NOT NULL), lambda r: array_to_string(list_transform(r, lambda c: trim(coalesce(c, ''))), '|')), chr(10)), '[^\x00-\x7F]', '', 'g')"


@REG.query("page_table", sql=f"""WITH t AS (SELECT DISTINCT doc, page, table_no, rows FROM page_table WHERE rows IS NOT NULL), s AS (SELECT doc, page, table_no, {_FLAT} AS s FROM t),
k AS (SELECT *, lag(s) OVER (PARTITION BY doc ORDER BY page, table_no) AS b FROM s) SELECT doc, page, table_no, round(CASE WHEN greatest(length(s), length(b)) = 0 THEN 1 ELSE 1 - levenshtein(s, b) / greatest(length(s), length(b)) END, 6) AS similarity FROM k WHERE b IS NOT NULL""")
def table_similarity(tables):
    """Each table against the one before it in its document."""
    flat = F.regexp_replace(F.array_join(F.transform(F.filter("rows", lambda r: r.isNotNull()), lambda r: F.array_join(F.transform(r, lambda c: F.trim(F.coalesce(c, F.lit("")))), "|")), "\n"), r"[^\x00-\x7F]", "")
    rows = distinct_tables(tables).select("doc", "page", "table_no", flat.alias("s")).withColumn("b", F.lag("s").over(Window.partitionBy("doc").orderBy("page", "table_no"))).filter("b IS NOT NULL")
    return rows.select("doc", "page", "table_no", F.round(K.table_similarity(F.col("s"), F.col("b")), 6).alias("similarity"))


@REG.query("documents", sql=r"""WITH w AS (SELECT unnest(regexp_extract_all(lower(text), '\p{L}+')) AS word FROM documents WHERE text IS NOT NULL) SELECT word, count(*)::BIGINT AS n FROM w GROUP BY word ORDER BY n DESC, word LIMIT 25""")
def top_words(docs):
    """The 25 most frequent words; the limit is the feature's."""
    words = spread(docs.filter("text IS NOT NULL").select("text")).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(25)


@REG.query("index_meta", sql="SELECT DISTINCT doc, strftime(built_at, '%Y-%m-%dT%H:%M:%SZ') AS written, epoch(date_trunc('second', built_at))::BIGINT AS epoch_s FROM index_meta")
def build_epochs(meta):
    """Times written as UTC text and read back as seconds; what is no time is null."""
    rows = meta.select("doc", F.date_format("built_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("written")).distinct()
    return rows.select("doc", "written", F.unix_seconds(F.try_to_timestamp("written", F.lit("yyyy-MM-dd'T'HH:mm:ssX"))).alias("epoch_s"))


@REG.query("source_location", "index_meta", sql=r"""WITH n AS (SELECT collection AS name FROM source_location UNION SELECT regexp_replace(doc, '^.*/', '') FROM index_meta WHERE doc IS NOT NULL)
SELECT name, coalesce(regexp_matches(name, '^[\p{L}\p{N}_][\p{L}\p{N} ._-]{0,63}$') AND NOT regexp_matches(name, '[ .]$'), false) AS plain FROM n""")
def plain_names(locations, meta):
    names = locations.select(F.col("collection").alias("name")).unionByName(meta.filter("doc IS NOT NULL").select(F.regexp_replace("doc", "^.*/", "").alias("name"))).distinct()
    return names.select("name", K.plain_name(F.col("name")).alias("plain"))


@REG.query("source_location", sql=f"""WITH {_RULES}, g AS (SELECT name, CASE WHEN lower(name) = 'letters' THEN list_sort(list_distinct(list_concat(clients, ['guest']))) ELSE clients END AS clients FROM rules),
r AS (SELECT name, CASE WHEN lower(name) = 'payroll' THEN ['cli'] ELSE clients END AS clients FROM g), o AS (SELECT * FROM r WHERE lower(name) <> 'security'), a AS (SELECT * FROM o UNION ALL SELECT 'archive', ['hr'])
SELECT name, array_to_string(clients, ',') AS clients FROM a""")
def access_changes(locations):
    """A grant, a restriction, an opening and a new rule, one after the other."""
    r = rules(locations)
    for how, name, who in (("grant", "letters", ["guest"]), ("restrict", "PAYROLL", ["cli"]), ("open", "security", []), ("restrict", "archive", ["hr"])):
        r = K.access_change(r, how, name, who)
    return r.select("name", F.array_join("clients", ",").alias("clients"))


@REG.query("source_location", "index_meta", "chunk", sql="""WITH a AS (SELECT DISTINCT collection FROM source_location), b AS (SELECT DISTINCT split_part(doc, '/', 1) AS collection FROM index_meta WHERE doc IS NOT NULL), c AS (SELECT DISTINCT collection FROM chunk WHERE collection IS NOT NULL)
SELECT collection, concat_ws(',', CASE WHEN a.collection IS NOT NULL THEN 'location' END, CASE WHEN b.collection IS NOT NULL THEN 'index' END, CASE WHEN c.collection IS NOT NULL THEN 'published' END) AS kinds FROM a FULL JOIN b USING (collection) FULL JOIN c USING (collection)""")
def known_collections(locations, meta, chunks):
    """Every collection that is known anywhere, and where."""
    named = lambda df, c, k: df.select(c.alias("collection"), F.lit(k).alias("k")).filter("collection IS NOT NULL").distinct()
    every = named(locations, F.col("collection"), "location").unionByName(named(meta, F.split_part("doc", F.lit("/"), F.lit(1)), "index")).unionByName(named(chunks, F.col("collection"), "published"))
    has = lambda k: F.when(F.bool_or(F.col("k") == k), k)
    return every.groupBy("collection").agg(F.concat_ws(",", has("location"), has("index"), has("published")).alias("kinds"))


QUERIES, SQL = REG.queries, REG.sql
