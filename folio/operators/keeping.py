"""What a run needs to know before it starts and shows while it goes: freshness with reasons, failures, states, filters, totals, names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: The settings that a build depends on, in the order in which a difference is named.
SETTINGS = ("format", "chunk_size", "chunk_overlap", "chunker", "tokenizer", "model", "convert")


def fresh_builds(builds: DataFrame, present: DataFrame, wanted: dict) -> DataFrame:
    """(doc, fresh, why) of each newest build against the present checksums (src_path, sha) and the wanted settings.

    why names the first thing that differs: no nodes, no vectors, the checksum, or a setting; a setting that is null differs from any
    that is wanted.
    """
    rows = builds.join(present, "src_path", "left")
    why = F.when(F.coalesce("nodes", F.lit(0)) <= 0, "nodes").when(F.coalesce("dim", F.lit(0)) <= 0, "vectors").when(~F.lower("src_sha256").eqNullSafe(F.col("sha")), "checksum")
    for name in SETTINGS:
        why = why.when(~F.col(name).eqNullSafe(F.lit(wanted[name])), name)
    return rows.select("doc", why.isNull().alias("fresh"), why.alias("why"))


def conversions(trace: DataFrame) -> DataFrame:
    """(src_path, sha, convert, outcome): the newest conversion of each file that has a checksum and a time."""
    rows = trace.filter("src_path IS NOT NULL AND src_sha256 IS NOT NULL AND written_at IS NOT NULL")
    newest = F.max_by(F.struct(F.lower("src_sha256").alias("sha"), "convert", "outcome"), F.struct("written_at", "trace_id"))
    return rows.groupBy("src_path").agg(newest.alias("m")).select("src_path", "m.*")


def remembered(trace: DataFrame, failure: str = "error") -> DataFrame:
    """(src_path, sha, tries): files whose present content failed with every reader that tried it; a success with any reader clears it."""
    present = conversions(trace).select("src_path", "sha")
    tries = trace.filter("src_path IS NOT NULL AND src_sha256 IS NOT NULL AND written_at IS NOT NULL").select("src_path", F.lower("src_sha256").alias("sha"), "trace_id", "outcome").distinct()
    k = tries.join(present, ["src_path", "sha"]).groupBy("src_path", "sha").agg(F.count("*").alias("tries"), F.count_if(F.col("outcome") == failure).alias("failed"))
    return k.filter("failed = tries").select("src_path", "sha", "tries")


def states(locations: DataFrame, meta: DataFrame, published: DataFrame, seen: DataFrame) -> DataFrame:
    """(collection, docs, state): imported (no location), not_indexed, unreachable (no file of it was seen), pending, unpublished or ok."""
    m = meta.groupBy(F.split_part("doc", F.lit("/"), F.lit(1)).alias("collection")).agg(F.count_distinct("doc").alias("docs"), F.count_if(F.col("built_at").isNull()).alias("open"))
    here = locations.select("collection").distinct().withColumn("here", F.lit(True))
    out = published.select("collection").distinct().withColumn("out", F.lit(True))
    live = seen.select("collection").distinct().withColumn("live", F.lit(True))
    rows = here.join(m, "collection", "full").join(out, "collection", "left").join(live, "collection", "left")
    state = F.when(F.col("here").isNull(), "imported").when(F.col("docs").isNull(), "not_indexed").when(F.col("live").isNull(), "unreachable").when(F.col("open") > 0, "pending").when(F.col("out").isNull(), "unpublished").otherwise("ok")
    return rows.select("collection", F.coalesce("docs", F.lit(0)).alias("docs"), state.alias("state"))


def run_filters(rows: DataFrame, area: str | None = None, convert: str | None = None, outcome: str | None = None, text: str | None = None, group: tuple[str, ...] = (), hidden: tuple[str, ...] = ()) -> DataFrame:
    """(before, after, pages): how many documents (source, area, convert, outcome, pages) there are, and pass all filters that are set.

    Hidden areas count neither before nor after; text is looked for in the name, whatever the case.
    """
    seen = ~F.coalesce("area", F.lit("")).isin(*hidden) if hidden else F.lit(True)
    keep = seen
    for name, value in (("area", area), ("convert", convert), ("outcome", outcome)):
        keep = keep & (F.col(name) == value) if value is not None else keep
    keep = keep & F.lower("source").contains(text.lower()) if text else keep
    keep = keep & F.col("outcome").isin(*group) if group else keep
    return rows.agg(F.count_if(seen).alias("before"), F.count_if(keep).alias("after"), F.coalesce(F.sum(F.when(keep, F.col("pages"))), F.lit(0)).cast("long").alias("pages"))


def plain_name(name: Column) -> Column:
    """Whether a name can be one of a collection or a client: letters, digits, space, dot, dash, underscore, not a dot first, 64 at most."""
    return F.coalesce(name.rlike(r"^[\p{L}\p{N}_][\p{L}\p{N} ._-]{0,63}$") & ~name.rlike(r"[ .]$"), F.lit(False))


def memory(rows: DataFrame, group: str, order: str, size: Column, sample: int = 300) -> DataFrame:
    """(group, n, sampled, bytes): the size of each group, from every n/sample-th of its rows."""
    w = Window.partitionBy(group)
    placed = rows.select(group, order, size.alias("size")).withColumn("n", F.count("*").over(w)).withColumn("at", F.row_number().over(w.orderBy(order)) - 1)
    picked = placed.filter(F.col("at") % F.greatest(F.lit(1), F.floor(F.col("n") / sample)) == 0)
    return picked.groupBy(group).agg(F.max("n").alias("n"), F.count("*").alias("sampled"), F.round(F.avg("size") * F.max("n"), 3).alias("bytes"))


def page_facts(pages: DataFrame, tables: DataFrame, chunks: DataFrame) -> DataFrame:
    """(doc, page, chars, tables, chunks): all that is known of each page, whichever side knows it."""
    p = pages.select("doc", F.col("page").cast("string").alias("page"), F.length("md").alias("chars"))
    t = tables.groupBy("doc", F.col("page").cast("string").alias("page")).agg(F.count_distinct("table_no").alias("tables"))
    c = chunks.filter("page <> ''").groupBy("doc", "page").agg(F.count_distinct("chunk_id").alias("chunks"))
    return p.join(t, ["doc", "page"], "full").join(c, ["doc", "page"], "full").select("doc", "page", "chars", "tables", "chunks")


#: Lines that are nothing but the number of a sheet. Fixed value.
PAGE_NUMBER = r"(?i)^\W*(?:page|seite|p\.|s\.)?\s*[0-9]{1,4}(?:\s*(?:/|of|von)\s*[0-9]{1,4})?\W*$"


def band(line: Column) -> Column:
    """What repeated lines share: lower case, white space and digits written one way."""
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(line, r"\s+", " "))), "[0-9]+", "#")


def cleaned_layer(pages: DataFrame, least: int = 3) -> DataFrame:
    """(doc, page, kept, numbers, bands, text): the page without lines of page numbers and without lines at its edges, the first or last
    two that are not blank, whose band stands on `least` pages of the document or more."""
    lines = pages.select("doc", "page", F.posexplode(F.split("md", "\n")).alias("i", "line")).filter(F.trim("line") != "")
    w = Window.partitionBy("doc", "page")
    lines = lines.withColumn("band", band(F.col("line"))).withColumn("up", F.row_number().over(w.orderBy("i"))).withColumn("down", F.row_number().over(w.orderBy(F.desc("i"))))
    often = lines.groupBy("doc", "band").agg(F.count_distinct("page").alias("sheets")).filter(F.col("sheets") >= least).select("doc", "band", F.lit(True).alias("often"))
    lines = lines.join(often, ["doc", "band"], "left")
    number = F.col("line").rlike(PAGE_NUMBER)
    edge = (F.col("up") <= 2) | (F.col("down") <= 2)
    repeated = F.coalesce("often", F.lit(False)) & edge & ~number
    kept = F.array_sort(F.collect_list(F.when(~number & ~repeated, F.struct("i", "line"))))
    out = lines.groupBy("doc", "page").agg(kept.alias("kept"), F.count_if(number).alias("numbers"), F.count_if(repeated).alias("bands"))
    return out.select("doc", "page", F.size("kept").cast("long").alias("kept"), "numbers", "bands", F.array_join(F.transform("kept", lambda x: x.line), "\n").alias("text"))


def phrase_tokens(text: Column) -> Column:
    """Words in lower case, figures without separators, signs at their ends dropped."""
    parts = F.transform(F.split(F.lower(text), r"\s+"), lambda t: F.regexp_replace(F.regexp_replace(t, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""), r"(?<=[0-9]),(?=[0-9])", ""))
    return F.filter(parts, lambda t: t != "")


def phrase_hits(rows: DataFrame, key: str, text: str, phrases: list[str]) -> DataFrame:
    """(phrase, hits): in how many rows each phrase stands, as a run of whole tokens."""
    spaced = F.concat(F.lit(" "), F.array_join(phrase_tokens(F.col(text)), " "), F.lit(" "))
    asked = rows.sparkSession.createDataFrame([(p,) for p in phrases], "phrase string")
    normal = asked.select("phrase", F.concat(F.lit(" "), F.array_join(phrase_tokens(F.col("phrase")), " "), F.lit(" ")).alias("run"))
    wanted = [(r.phrase, r.run) for r in normal.collect()]
    counted = rows.select(key, spaced.alias("t")).agg(*(F.count_if(F.contains("t", F.lit(run))).alias(f"h{k}") for k, (_, run) in enumerate(wanted)))
    pairs = F.explode(F.array(*(F.struct(F.lit(p).alias("phrase"), F.col(f"h{k}").alias("hits")) for k, (p, _) in enumerate(wanted))))
    return counted.select(pairs.alias("x")).select("x.*")


def reread_complete(before: Column, after: Column) -> Column:
    """Whether a second reading is no smaller: nine tenths of the distinct figures and eight of the distinct words of the first."""
    figures = lambda t: F.array_distinct(F.transform(F.regexp_extract_all(t, F.lit(r"[0-9][0-9.,]*[0-9]|[0-9]"), F.lit(0)), lambda x: F.replace(x, F.lit(","), F.lit(""))))
    words = lambda t: F.array_distinct(F.filter(F.regexp_extract_all(F.lower(t), F.lit(r"\p{L}+"), F.lit(0)), lambda w: F.length(w) >= 3))
    share = lambda f, least: F.size(F.array_intersect(f(before), f(after))) >= least * F.size(f(before))
    return share(figures, 0.9) & share(words, 0.8)


def table_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance of two serialised tables over the length of the longer; 1 for two empty ones."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def access_change(rules: DataFrame, how: str, name: str, clients: list[str]) -> DataFrame:
    """The rules (name, clients) after one change: 'restrict' replaces a collection's clients, 'grant' adds to them, 'open' drops its rule.

    Names are compared whatever their case; the rule keeps its spelling.
    """
    mine = F.lower("name") == name.lower()
    if how == "open":
        return rules.filter(~mine)
    new = F.array_sort(F.array_distinct(F.array(*map(F.lit, clients)))) if clients else F.array().cast("array<string>")
    changed = rules.withColumn("clients", F.when(mine, F.array_sort(F.array_union("clients", new)) if how == "grant" else new).otherwise(F.col("clients")))
    added = rules.sparkSession.createDataFrame([(name,)], "name string").withColumn("clients", new)
    return changed.unionByName(added.join(rules.select(F.lower("name").alias("l")), F.lower("name") == F.col("l"), "left_anti"))
