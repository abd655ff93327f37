"""Run views, settled builds, page kinds, padded routes, grep with pages, cache upkeep and targets."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.operators import validators as N, views as V
from folio.operators.reading import join_pages
from folio.plans.pages import _BR, _PAGE, branches
from folio.plans.registry import Registry
from folio.plans.tables import ROLES
from folio.plans.validators import _BREAKS, _HEAD, parsed

REG = Registry()


@REG.query("page", sql=rf"""WITH l AS (SELECT doc, page, unnest(string_split(md, chr(10))) AS line, generate_subscripts(string_split(md, chr(10)), 1) AS i FROM ({_PAGE}) WHERE md <> ''),
m AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY page, i) AS k FROM l) SELECT doc, page::VARCHAR AS page, line[:500] AS line FROM m WHERE regexp_matches(line, '(?i)invoice|budget [0-9]+')""")
def grep_pages(pages):
    """Over whole documents with page marks, as they are joined."""
    return V.grep_pages(join_pages(pages), "invoice|budget [0-9]+").select("doc", "page", "line")


@REG.query("chunk", sql=r"""WITH c AS (SELECT DISTINCT chunk_id, text, '```markdown' || chr(10) || text || chr(10) || '```' AS r FROM chunk WHERE text IS NOT NULL)
SELECT chunk_id, CASE WHEN contains(text, '```') THEN r ELSE text END AS text FROM c""")
def model_replies(chunks):
    """Each text inside a fence, as models answer, without it again; where the text has fences of its own it stays."""
    rows = chunks.filter("text IS NOT NULL").select("chunk_id", "text").distinct()
    return rows.select("chunk_id", V.unfenced(F.concat(F.lit("```markdown\n"), "text", F.lit("\n```"))).alias("text"))


@REG.query("embedding", sql="SELECT collection, count(DISTINCT model)::BIGINT AS models, count(DISTINCT len(embedding))::BIGINT AS dims, bool_and(coalesce(model = 'mini-64-v2', false)) AND count(DISTINCT len(embedding)) = 1 AS usable FROM embedding GROUP BY 1")
def model_guard(vectors):
    return V.model_guard(vectors, "collection", "mini-64-v2").select("collection", "models", "dims", "usable")


_CACHE = """t AS (SELECT DISTINCT * FROM trace WHERE src_sha256 IS NOT NULL AND written_at IS NOT NULL),
c AS (SELECT left(sha256(concat_ws(chr(0), lower(src_sha256), convert)), 40) AS key, max(struct_pack(at := epoch_us(written_at), bytes := coalesce(pages, 0)::BIGINT)) AS m FROM t GROUP BY 1),
r AS (SELECT DISTINCT left(sha256(concat_ws(chr(0), lower(src_sha256), convert)), 40) AS key FROM index_meta WHERE built_at IS NOT NULL AND src_sha256 IS NOT NULL)"""


def _cache(trace):
    rows = trace.filter("src_sha256 IS NOT NULL AND written_at IS NOT NULL").select(V.cache_key(F.lower("src_sha256"), F.col("convert")).alias("key"), F.unix_micros(F.col("written_at").cast("timestamp")).alias("at"), F.coalesce("pages", F.lit(0)).cast("long").alias("bytes"))
    return V.cache_put(rows.limit(0), rows)


@REG.query("trace", sql=f"WITH {_CACHE.rsplit('r AS', 1)[0].rstrip().rstrip(',')} SELECT count(*)::BIGINT AS entries, sum(m.bytes)::BIGINT AS bytes, min(m.at) AS oldest, max(m.at) AS newest FROM c")
def cache_stats(trace):
    return _cache(trace).agg(F.count("*").alias("entries"), F.sum("bytes").alias("bytes"), F.min("at").alias("oldest"), F.max("at").alias("newest"))


@REG.query("trace", "index_meta", sql=f"WITH {_CACHE} SELECT c.key, m.at AS at FROM c LEFT JOIN r USING (key) WHERE r.key IS NOT NULL OR m.at >= 1700000000000000")
def cache_kept(trace, meta):
    """What a clean-up of the page cache keeps: entries of builds, and young ones."""
    used = meta.filter("built_at IS NOT NULL AND src_sha256 IS NOT NULL").select(V.cache_key(F.lower("src_sha256"), F.col("convert")).alias("key"))
    return V.cache_gc(_cache(trace), used, 1_700_000_000_000_000).select("key", "at")


@REG.query("page", sql=f"""WITH p AS ({_PAGE}), {_BR}, e AS (SELECT doc, unnest(range(1, max(page) + 1))::INT AS page FROM route GROUP BY doc HAVING max(page) >= 1) SELECT doc, page, coalesce(branch, 'unknown') AS branch FROM e LEFT JOIN route USING (doc, page)""")
def padded_routes(pages):
    return V.padded_routes(branches(pages))


@REG.query("trace", sql="""WITH t AS (SELECT DISTINCT trace_id, source, convert, written_at FROM trace), f AS (SELECT source, convert AS first_ FROM t WHERE convert IS NOT NULL AND written_at IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source ORDER BY written_at, trace_id) = 1)
SELECT trace_id, coalesce(convert, first_, 'unknown') AS kind FROM t LEFT JOIN f USING (source)""")
def page_kinds(trace):
    return V.page_kinds(trace)


@REG.query("trace", "index_meta", sql="""WITH t AS (SELECT DISTINCT source, src_path, trace_id, written_at, coalesce(outcome, 'open') AS outcome FROM trace WHERE written_at IS NOT NULL),
d AS (SELECT source, count(*)::BIGINT AS tries, string_agg(outcome, '>' ORDER BY written_at, trace_id) AS timeline, epoch_us(max(written_at)) AS last_us FROM t GROUP BY 1),
l AS (SELECT source, src_path FROM t QUALIFY row_number() OVER (PARTITION BY source ORDER BY written_at DESC, trace_id DESC) = 1), b AS (SELECT src_path, count(*) AS builds FROM (SELECT DISTINCT * FROM index_meta WHERE built_at IS NOT NULL) GROUP BY 1)
SELECT d.source, tries, timeline, last_us, coalesce(builds, 0)::BIGINT AS builds FROM d JOIN l ON d.source IS NOT DISTINCT FROM l.source LEFT JOIN b USING (src_path)""")
def run_view(trace, meta):
    return V.run_view(trace, meta)


@REG.query("index_meta", sql="""WITH k AS (SELECT doc, count(CASE WHEN built_at IS NULL THEN 1 END)::BIGINT AS open, count(built_at)::BIGINT AS done FROM (SELECT DISTINCT * FROM index_meta) GROUP BY 1)
SELECT doc, open, done, CASE WHEN open = 0 THEN 'finished' WHEN done > 0 THEN 'superseded' ELSE 'interrupted' END AS state FROM k""")
def settled_builds(meta):
    return V.settled(meta)


@REG.query("source_location", "index_meta", sql="""WITH n AS (SELECT upper(collection) AS target FROM source_location UNION SELECT src_path FROM index_meta WHERE src_path IS NOT NULL), s AS (SELECT DISTINCT collection, regexp_replace(root, '/+$', '') AS root FROM source_location),
a AS (SELECT target, max(CASE WHEN target = collection THEN collection END) AS exact, CASE WHEN count(DISTINCT collection) = 1 THEN max(collection) END AS folded FROM n JOIN s ON lower(target) = lower(collection) GROUP BY 1),
p AS (SELECT target, collection AS path FROM n JOIN s ON contains(target, '/') AND (starts_with(target, root || '/') OR target = root) QUALIFY row_number() OVER (PARTITION BY target ORDER BY length(root) DESC, collection DESC) = 1)
SELECT target, coalesce(exact, folded, path) AS collection FROM n LEFT JOIN a USING (target) LEFT JOIN p USING (target)""")
def resolved_targets(locations, meta):
    asked = locations.select(F.upper("collection").alias("target")).unionByName(meta.filter("src_path IS NOT NULL").select(F.col("src_path").alias("target"))).distinct()
    return V.targets(asked, locations)


@REG.query("trace", sql="""WITH t AS (SELECT DISTINCT * FROM trace) SELECT version, count(*)::BIGINT AS n, count(CASE WHEN outcome = 'ok' THEN 1 END)::BIGINT AS ok, count(CASE WHEN outcome = 'low' THEN 1 END)::BIGINT AS low, min(CASE WHEN outcome = 'error' THEN pages END)::INT AS least_failed FROM t GROUP BY 1""")
def outcome_frontier(trace):
    """Outcomes at each version, with the smallest file that failed."""
    return trace.distinct().groupBy("version").agg(F.count("*").alias("n"), F.count_if(F.col("outcome") == "ok").alias("ok"), F.count_if(F.col("outcome") == "low").alias("low"), F.min(F.when(F.col("outcome") == "error", F.col("pages"))).alias("least_failed"))


@REG.query("page_table", sql=f"WITH {_HEAD}, {_BREAKS}, w AS (SELECT DISTINCT doc, page, table_no FROM breaks) SELECT split_part(one.doc, '/', 1) AS collection, count(*)::BIGINT AS checked, count(CASE WHEN w.doc IS NULL THEN 1 END)::BIGINT AS passed FROM one LEFT JOIN w USING (doc, page, table_no) GROUP BY 1")
def balance_passes(tables):
    """Of the tables with one balance column, how many have no break."""
    rows = parsed(tables)
    role = N.roles(rows, ROLES)
    many = lambda r: F.count_if(F.col("role") == r)
    one = role.groupBy(*N.TABLE).agg(many("balance").alias("b"), many("debit").alias("d"), many("credit").alias("c")).filter("b = 1 AND d <= 1 AND c <= 1 AND d + c >= 1").select(*N.TABLE)
    broken = N.balance_breaks(rows, ROLES).select(*N.TABLE).distinct().withColumn("broken", F.lit(True))
    return one.join(broken, list(N.TABLE), "left").groupBy(F.split_part("doc", F.lit("/"), F.lit(1)).alias("collection")).agg(F.count("*").alias("checked"), F.count_if(F.col("broken").isNull()).alias("passed"))


QUERIES, SQL = REG.queries, REG.sql
