"""Index bookkeeping: freshness, orphans, catalogues, access, names, estimates; over chunk, embedding, index_meta, trace, source_location."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from folio.functions.numbers import nearest_rank
from folio.operators import catalog as C
from folio.operators.incremental import resolved_path
from folio.plans.registry import Registry

REG = Registry()
_META = "m AS (SELECT DISTINCT * FROM index_meta)"
_NEWEST = f"{_META}, n AS (SELECT * FROM m WHERE built_at IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc ORDER BY built_at DESC, src_sha256, chunk_size, chunker, model, convert, chunk_overlap, index_bytes, src_bytes) = 1)"
RULES = [("security", ["auditor", "admin"]), ("Payroll", ["hr"]), ("claims", []), ("LETTERS", ["hr", "auditor"])]
_RULES = "rules AS (SELECT * FROM (VALUES ('security', ['auditor', 'admin']), ('Payroll', ['hr']), ('claims', []::VARCHAR[]), ('LETTERS', ['hr', 'auditor'])) v(name, clients))"
_CLIENTS = "clients AS (SELECT unnest(['hr', 'auditor', 'guest', 'cli']) AS client)"


def rules(df):
    return df.sparkSession.createDataFrame(RULES, "name string, clients array<string>")


def clients(df):
    return df.sparkSession.createDataFrame([("hr",), ("auditor",), ("guest",), ("cli",)], "client string")


@REG.query("index_meta", "trace", sql=f"""WITH {_NEWEST}, t AS (SELECT DISTINCT src_path, lower(src_sha256) AS sha FROM trace WHERE src_sha256 IS NOT NULL AND written_at IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY src_path ORDER BY written_at DESC, trace_id DESC) = 1)
SELECT n.doc, lower(n.src_sha256) IS NOT DISTINCT FROM t.sha AND n.nodes > 0 AND n.chunker = 'md-3' AND n.dim = 64 AS fresh FROM n LEFT JOIN t USING (src_path)""")
def freshness_split(meta, trace):
    return C.freshness(C.newest_builds(meta), trace)


@REG.query("chunk", "index_meta", sql=f"WITH {_META} SELECT DISTINCT chunk_id, doc FROM chunk c WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.doc = c.doc)")
def orphans_anti(chunks, meta):
    return chunks.select("chunk_id", "doc").distinct().join(meta.select("doc").distinct(), "doc", "left_anti").select("chunk_id", "doc")


@REG.query("trace", "index_meta", sql="""SELECT DISTINCT m.doc FROM index_meta m WHERE m.src_path IN (SELECT src_path FROM trace WHERE outcome = 'ok')""")
def live_semi(trace, meta):
    live = trace.filter("outcome = 'ok'").select("src_path").distinct()
    return meta.select("doc", "src_path").distinct().join(live, "src_path", "left_semi").select("doc").distinct()


@REG.query("chunk", "embedding", sql="""WITH c AS (SELECT DISTINCT collection, doc, chunk_id FROM chunk), e AS (SELECT DISTINCT chunk_id FROM embedding WHERE len(embedding) = 64)
SELECT collection, doc, count(*)::BIGINT AS chunks, count(e.chunk_id)::BIGINT AS vectors, count(*) = count(e.chunk_id) AS complete FROM c LEFT JOIN e USING (chunk_id) GROUP BY 1, 2""")
def incomplete_documents(chunks, vectors):
    e = vectors.filter(F.size("embedding") == 64).select("chunk_id").distinct().withColumn("has", F.lit(1))
    rows = chunks.select("collection", "doc", "chunk_id").distinct().join(e, "chunk_id", "left")
    return rows.groupBy("collection", "doc").agg(F.count("*").alias("chunks"), F.count("has").alias("vectors")).withColumn("complete", F.col("chunks") == F.col("vectors"))


@REG.query("index_meta", sql=f"""WITH {_META}, d AS (SELECT doc, src_path, lower(regexp_replace(doc, '^.*/', '')) AS name, min(built_at) AS first_built FROM m GROUP BY ALL)
SELECT name, doc, row_number() OVER (PARTITION BY name ORDER BY first_built NULLS LAST, doc) = 1 AS owner, count(*) OVER (PARTITION BY name)::BIGINT AS claimants FROM d""")
def name_collisions(meta):
    return C.name_owners(meta)


@REG.query("index_meta", sql=f"""WITH {_NEWEST} SELECT split_part(doc, '/', 1) AS collection, count(*)::BIGINT AS docs, sum(nodes)::BIGINT AS nodes, sum(index_bytes)::BIGINT AS index_bytes, sum(src_bytes)::BIGINT AS src_bytes,
  CASE WHEN count(DISTINCT model) = 1 THEN min(model) ELSE 'mixed' END AS model, CASE WHEN count(DISTINCT chunk_size) = 1 THEN min(chunk_size)::VARCHAR ELSE 'mixed' END AS chunk_size, round(sum(build_s), 3) AS build_s,
  epoch_us(max(built_at)) AS last_built_us FROM n GROUP BY 1""")
def catalog(meta):
    return C.catalog(C.newest_builds(meta))


@REG.query("index_meta", sql=f"""WITH {_NEWEST} SELECT count(*)::BIGINT AS docs, count(DISTINCT split_part(doc, '/', 1))::BIGINT AS collections, sum(nodes)::BIGINT AS nodes, count(DISTINCT model)::BIGINT AS models FROM n""")
def catalog_totals(meta):
    n = C.newest_builds(meta)
    return n.agg(F.count("*").alias("docs"), F.count_distinct(F.split_part("doc", F.lit("/"), F.lit(1))).alias("collections"), F.sum("nodes").cast("long").alias("nodes"), F.count_distinct("model").alias("models"))


@REG.query("index_meta", sql=f"""WITH {_NEWEST}, h AS (SELECT split_part(doc, '/', 1) AS collection, sha256(doc || ' ' || lower(src_sha256)) AS h FROM n WHERE src_sha256 IS NOT NULL),
p AS (SELECT collection, left(h, 2) AS part, sha256(string_agg(h, chr(10) ORDER BY h)) AS d FROM h GROUP BY 1, 2) SELECT collection, sha256(string_agg(d, chr(10) ORDER BY part)) AS content FROM p GROUP BY 1""")
def content_hash(meta):
    return C.content_hash(C.newest_builds(meta))


@REG.query("index_meta", sql=f"""WITH {_NEWEST} SELECT model, count(*)::BIGINT AS docs, sum(nodes)::BIGINT AS nodes, round(sum(embed_s), 3) AS embed_s, round(sum(embed_s) / nullif(sum(CASE WHEN embed_s IS NOT NULL THEN nodes END), 0), 6) AS s_per_node FROM n GROUP BY 1""")
def models_in_use(meta):
    timed = F.sum(F.when(F.col("embed_s").isNotNull(), F.col("nodes")))
    return C.newest_builds(meta).groupBy("model").agg(F.count("*").alias("docs"), F.sum("nodes").cast("long").alias("nodes"), F.round(F.sum("embed_s"), 3).alias("embed_s"), F.round(F.try_divide(F.sum("embed_s"), timed), 6).alias("s_per_node"))


@REG.query("trace", sql="""WITH t AS (SELECT DISTINCT * FROM trace) SELECT lower(regexp_extract(source, '\\.([A-Za-z0-9]+)$', 1)) AS ext, coalesce(convert, 'none') AS convert, count(*)::BIGINT AS runs, sum(pages)::BIGINT AS pages,
  count(CASE WHEN outcome = 'ok' THEN 1 END)::BIGINT AS ok, count(CASE WHEN outcome = 'low' THEN 1 END)::BIGINT AS low FROM t GROUP BY 1, 2""".replace("\\\\", "\\"))
def trace_mining(trace):
    t = trace.distinct()
    return t.groupBy(F.lower(F.regexp_extract("source", r"\.([A-Za-z0-9]+)$", 1)).alias("ext"), F.coalesce("convert", F.lit("none")).alias("convert")).agg(
        F.count("*").alias("runs"), F.sum("pages").cast("long").alias("pages"), F.count_if(F.col("outcome") == "ok").alias("ok"), F.count_if(F.col("outcome") == "low").alias("low")
    )


_Q = ", ".join(f"list_sort(list(x))[round_even({p}::DOUBLE * (count(x) - 1), 0)::INT + 1] AS p{int(p * 100):02d}" for p in (0.05, 0.25, 0.5, 0.75, 0.95))


@REG.query("index_meta", sql=f"""WITH {_META}, v AS (SELECT convert, round(convert_s / nodes, 9) AS x FROM m WHERE nodes > 0 AND convert_s IS NOT NULL) SELECT convert, count(*)::BIGINT AS n, round(avg(x), 6) AS mean, {_Q} FROM v GROUP BY 1""")
def build_quantiles(meta):
    x = F.collect_list("x")
    v = meta.distinct().filter("nodes > 0 AND convert_s IS NOT NULL").select("convert", F.round(F.col("convert_s") / F.col("nodes"), 9).alias("x"))
    return v.groupBy("convert").agg(F.count("*").alias("n"), F.round(F.avg("x"), 6).alias("mean"), *(nearest_rank(x, p).alias(f"p{int(p * 100):02d}") for p in (0.05, 0.25, 0.5, 0.75, 0.95)))


@REG.query("index_meta", sql=f"WITH {_META}, s AS (SELECT doc, built_at, build_s FROM m WHERE build_s IS NOT NULL AND built_at IS NOT NULL) SELECT doc, epoch_us(built_at) AS built_us, build_s FROM s ORDER BY build_s DESC, doc, built_at LIMIT 20")
def slowest_builds(meta):
    rows = meta.distinct().filter("build_s IS NOT NULL AND built_at IS NOT NULL").orderBy(F.desc("build_s"), "doc", "built_at").limit(20)
    return rows.select("doc", F.unix_micros("built_at").alias("built_us"), "build_s")


@REG.query("trace", "source_location", sql=r"""
WITH RECURSIVE raw AS (SELECT DISTINCT src_path FROM trace WHERE src_path IS NOT NULL),
step AS (SELECT src_path, list_filter(string_split(src_path, '/'), lambda x: x <> '' AND x <> '.') AS todo, []::VARCHAR[] AS kept FROM raw
  UNION ALL SELECT src_path, todo[2:], CASE WHEN todo[1] = '..' THEN kept[:greatest(len(kept) - 1, 0)] ELSE list_append(kept, todo[1]) END FROM step WHERE len(todo) > 0),
p AS (SELECT DISTINCT '/' || array_to_string(kept, '/') AS path FROM step WHERE len(todo) = 0),
h AS (SELECT path, collection, root FROM p JOIN source_location ON starts_with(path, root || '/') QUALIFY row_number() OVER (PARTITION BY path ORDER BY length(root) DESC, collection) = 1)
SELECT p.path, h.collection, h.collection || path[length(root) + 1 :] AS mirrored FROM p LEFT JOIN h USING (path)""")
def mirrored_paths(trace, locations):
    return C.mirror(trace.select(resolved_path(F.col("src_path")).alias("path")).filter("path IS NOT NULL").distinct(), locations)


@REG.query("source_location", sql=f"""WITH {_RULES}, {_CLIENTS} SELECT client, collection, client = 'cli' OR clients IS NULL OR list_contains(clients, client) AS allowed FROM source_location, clients LEFT JOIN rules ON lower(name) = lower(collection)""")
def access_scope(locations):
    return C.access(locations.select("collection"), rules(locations), clients(locations))


@REG.query("source_location", sql=f"""WITH {_RULES}, {_CLIENTS}, a AS (SELECT client, collection, client = 'cli' OR clients IS NULL OR list_contains(clients, client) AS ok FROM source_location, clients LEFT JOIN rules ON lower(name) = lower(collection))
SELECT client, string_agg(CASE WHEN ok THEN collection END, ',' ORDER BY collection) AS can_use, string_agg(CASE WHEN NOT ok THEN collection END, ',' ORDER BY collection) AS blocked FROM a GROUP BY 1""")
def access_overview(locations):
    a = C.access(locations.select("collection"), rules(locations), clients(locations))
    names = lambda ok: F.nullif(F.array_join(F.array_sort(F.collect_list(F.when(F.col("allowed") == ok, F.col("collection")))), ","), F.lit(""))
    return a.groupBy("client").agg(names(True).alias("can_use"), names(False).alias("blocked"))


@REG.query("index_meta", sql=rf"""WITH {_META}, d AS (SELECT DISTINCT doc, src_path FROM m) SELECT doc, regexp_replace(src_path, '(?i)(^|[^A-Za-z0-9_-])(security|payroll|claims)([^A-Za-z0-9_-]|$)', '\1[restricted]\3', 'g') AS shown FROM d""")
def redacted_paths(meta):
    return C.redact(meta.select("doc", "src_path").distinct(), "src_path", ["security", "payroll", "claims"]).select("doc", F.col("src_path").alias("shown"))


@REG.query("index_meta", sql=f"""WITH {_META}, s AS (SELECT doc, split_part(doc, '/', 1) AS collection, sha256('42|' || doc) AS h FROM (SELECT DISTINCT doc FROM m))
SELECT collection, doc, row_number() OVER (PARTITION BY collection ORDER BY h, doc)::INT AS place FROM s QUALIFY place <= 5""")
def gold_sample(meta):
    """Five documents of each collection in the order of a seeded hash; the limit is the sample's size."""
    s = meta.select("doc").distinct().withColumn("collection", F.split_part("doc", F.lit("/"), F.lit(1)))
    w = Window.partitionBy("collection").orderBy(F.sha2(F.concat(F.lit("42|"), "doc"), 256), "doc")
    return s.withColumn("place", F.row_number().over(w)).filter("place <= 5").select("collection", "doc", "place")


@REG.query("index_meta", "trace", sql=f"""WITH {_META}, b AS (SELECT src_path, max(built_at) AS built_at FROM m GROUP BY 1), t AS (SELECT src_path, max(written_at) AS written_at FROM trace GROUP BY 1)
SELECT b.src_path, written_at > built_at + INTERVAL 1 SECOND AS changed_since FROM b JOIN t USING (src_path) WHERE built_at IS NOT NULL AND written_at IS NOT NULL""")
def changed_since_built(meta, trace):
    b = meta.groupBy("src_path").agg(F.max("built_at").alias("built_at"))
    t = trace.groupBy("src_path").agg(F.max("written_at").alias("written_at"))
    return b.join(t, "src_path").filter("built_at IS NOT NULL AND written_at IS NOT NULL").select("src_path", (F.col("written_at") > F.col("built_at") + F.expr("INTERVAL 1 SECOND")).alias("changed_since"))


@REG.query("index_meta", sql=f"""WITH {_META}, b AS (SELECT doc, model, chunk_size, chunker, built_at, lag(struct_pack(model := model, chunk_size := chunk_size, chunker := chunker)) OVER (PARTITION BY doc ORDER BY built_at, model, chunk_size) AS o FROM m WHERE built_at IS NOT NULL)
SELECT doc, epoch_us(built_at) AS built_us, array_to_string(list_filter([CASE WHEN o.model <> model THEN 'model' END, CASE WHEN o.chunk_size <> chunk_size THEN 'chunk_size' END, CASE WHEN o.chunker <> chunker THEN 'chunker' END], lambda x: x IS NOT NULL), ',') AS changed FROM b WHERE o IS NOT NULL""")
def settings_changes(meta):
    w = Window.partitionBy("doc").orderBy("built_at", "model", "chunk_size")
    fields = ("model", "chunk_size", "chunker")
    b = meta.distinct().filter("built_at IS NOT NULL").select("doc", "built_at", *fields, *(F.lag(f).over(w).alias(f"old_{f}") for f in fields), F.lag("doc").over(w).alias("before"))
    changed = F.array_compact(F.array(*(F.when(F.col(f) != F.col(f"old_{f}"), f) for f in fields)))
    return b.filter("before IS NOT NULL").select("doc", F.unix_micros("built_at").alias("built_us"), F.array_join(changed, ",").alias("changed"))


QUERIES, SQL = REG.queries, REG.sql
