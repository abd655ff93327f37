"""Conversion runs: documents of a run, estimates, states of collections; over trace, index_meta, source_location."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.operators import runs as U
from folio.plans.registry import Registry

REG = Registry()
_T = "t AS (SELECT DISTINCT * FROM trace)"
_LAST = f"{_T}, l AS (SELECT * FROM t WHERE written_at IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source ORDER BY written_at DESC, trace_id DESC) = 1)"


@REG.query("trace", sql=f"""WITH {_LAST}, d AS (SELECT source, coalesce(outcome, 'unknown') AS status, coalesce(pages, 0)::BIGINT AS pages, trace_id FROM l WHERE lower(source) LIKE '%bridge%' OR coalesce(outcome, 'unknown') = 'low')
SELECT source, status, pages, trace_id FROM d""")
def run_documents(trace):
    """The last state of each document whose name holds a text or whose outcome is low."""
    return U.last_states(trace).filter(F.lower("source").contains("bridge") | (F.col("status") == "low"))


@REG.query("trace", sql=f"""WITH {_LAST} SELECT coalesce(outcome, 'unknown') AS status, split_part(ltrim(regexp_replace(src_path, '/+', '/', 'g'), '/'), '/', 1) AS area, count(*)::BIGINT AS docs, sum(coalesce(pages, 0))::BIGINT AS pages FROM l GROUP BY GROUPING SETS ((coalesce(outcome, 'unknown')), (coalesce(outcome, 'unknown'), split_part(ltrim(regexp_replace(src_path, '/+', '/', 'g'), '/'), '/', 1)))""")
def run_counts(trace):
    area = F.split_part(F.regexp_replace(F.regexp_replace("src_path", "/+", "/"), "^/", ""), F.lit("/"), F.lit(1))
    last = U.last_rows(trace).select(F.coalesce("outcome", F.lit("unknown")).alias("status"), area.alias("area"), F.coalesce("pages", F.lit(0)).alias("pages"))
    return last.groupingSets([["status"], ["status", "area"]], "status", "area").agg(F.count("*").alias("docs"), F.sum("pages").cast("long").alias("pages"))


@REG.query("trace", "index_meta", sql=rf"""WITH {_LAST}, m AS (SELECT DISTINCT * FROM index_meta WHERE convert_s IS NOT NULL AND nodes > 0),
e AS (SELECT lower(regexp_extract(source, '\.([A-Za-z0-9]+)$', 1)) AS ext, coalesce(pages, 0) AS pages FROM l),
r AS (SELECT lower(regexp_extract(src_path, '\.([A-Za-z0-9]+)$', 1)) AS ext, sum(convert_s) / sum(nodes) AS rate, sum(nodes) AS n FROM m GROUP BY 1)
SELECT e.ext, sum(pages)::BIGINT AS pages, round(any_value(CASE WHEN n >= 20 THEN rate ELSE 0.5 END), 6) AS rate, round(sum(pages) * any_value(CASE WHEN n >= 20 THEN rate ELSE 0.5 END), 3) AS seconds FROM e LEFT JOIN r USING (ext) GROUP BY e.ext""")
def conversion_estimate(trace, meta):
    """Pages per kind of file times the seconds measured for a unit of it, half a second where too little is measured."""
    return U.estimate(trace, meta)


@REG.query("trace", sql=f"""WITH {_T}, f AS (SELECT source, convert, min(written_at) AS first_used FROM t WHERE convert IS NOT NULL AND written_at IS NOT NULL GROUP BY 1, 2) SELECT source, string_agg(convert, ' ' ORDER BY first_used, convert) AS readers FROM f GROUP BY source""")
def readers_used(trace):
    """Each document's readers in the order of their first use."""
    first = trace.filter("convert IS NOT NULL AND written_at IS NOT NULL").groupBy("source", "convert").agg(F.min("written_at").alias("at"))
    return first.groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "convert"))), lambda x: x.convert), " ").alias("readers"))


@REG.query("trace", sql=f"""WITH {_T} SELECT coalesce(convert, 'none') AS convert, count(CASE WHEN outcome = 'ok' THEN 1 END)::BIGINT AS ok, count(CASE WHEN outcome = 'low' THEN 1 END)::BIGINT AS low, count(CASE WHEN outcome = 'failed' THEN 1 END)::BIGINT AS failed FROM t GROUP BY 1""")
def outcome_pivot(trace):
    t = trace.distinct().select(F.coalesce("convert", F.lit("none")).alias("convert"), "outcome")
    return t.groupBy("convert").pivot("outcome", ["ok", "low", "failed"]).agg(F.count(F.lit(1))).na.fill(0)


@REG.query("source_location", "index_meta", "trace", sql=r"""WITH s AS (SELECT collection FROM source_location), m AS (SELECT split_part(doc, '/', 1) AS collection, count(DISTINCT doc) AS docs, count(CASE WHEN built_at IS NULL THEN 1 END) AS open_ FROM index_meta GROUP BY 1)
SELECT collection, coalesce(docs, 0)::BIGINT AS docs, CASE WHEN docs IS NULL THEN 'not_indexed' WHEN open_ > 0 THEN 'pending' ELSE 'ok' END AS state FROM s LEFT JOIN m USING (collection)""")
def collection_states(locations, meta, trace):
    m = meta.groupBy(F.split_part("doc", F.lit("/"), F.lit(1)).alias("collection")).agg(F.count_distinct("doc").alias("docs"), F.count_if(F.col("built_at").isNull()).alias("open"))
    state = F.when(F.col("docs").isNull(), "not_indexed").when(F.col("open") > 0, "pending").otherwise("ok")
    return locations.select("collection").join(m, "collection", "left").select("collection", F.coalesce("docs", F.lit(0)).alias("docs"), state.alias("state"))


@REG.query("trace", sql=f"""WITH {_T}, g AS (SELECT trace_id, src_path, written_at, received_at, epoch_us(received_at) - epoch_us(written_at) AS late FROM t WHERE written_at IS NOT NULL AND received_at IS NOT NULL),
r AS (SELECT *, max(epoch_us(written_at)) OVER (ORDER BY received_at, trace_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM g)
SELECT count(*)::BIGINT AS n, count(CASE WHEN epoch_us(written_at) < seen THEN 1 END)::BIGINT AS out_of_order, round(max(late) / 1000000, 3) AS latest_s, round(avg(late) / 1000000, 3) AS mean_s FROM r""")
def arrival_order(trace):
    """How many rows arrive after a later one; in blocks of arrival days, so that no task sorts the whole log."""
    return U.arrivals(trace)


@REG.query("chunk", sql="""WITH c AS (SELECT DISTINCT chunk_id, doc, ord, heading FROM chunk WHERE ord IS NOT NULL)
SELECT chunk_id, last_value(heading IGNORE NULLS) OVER (PARTITION BY doc ORDER BY ord, chunk_id ROWS UNBOUNDED PRECEDING) AS in_effect FROM c""")
def headings_in_effect(chunks):
    return U.headings(chunks.filter("ord IS NOT NULL").select("chunk_id", "doc", "ord", "heading").distinct()).select("chunk_id", "in_effect")


QUERIES, SQL = REG.queries, REG.sql
