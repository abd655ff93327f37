"""Operators over pages of Markdown: repetition, text-layer comparison, routing, gates, strips, ranges."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from folio.functions.text import dominant_script, implausible_share, script_counts


def line_repeats(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, lines, repeats, runaway): the lines of ten characters or more and how often the commonest stands."""
    flat = rows.select(key, F.explode(F.split(text, "\n")).alias("line")).select(key, F.trim(F.regexp_replace("line", r"[\s|:\-]+", " ")).alias("line")).filter(F.length("line") >= 10)
    times = flat.groupBy(key, "line").agg(F.count("*").alias("n"))
    out = times.groupBy(key).agg(F.sum("n").alias("lines"), F.max("n").alias("repeats"))
    return out.withColumn("runaway", (F.col("repeats") >= 8) & (F.col("repeats") >= 0.25 * F.col("lines")))


def long_lines(text: Column) -> Column:
    """The lines of line_repeats(), sorted: a column to be bound before runaway() reads it."""
    flat = F.regexp_replace(text, r"[ \t\x0B\f\r|:\-]+", " ")
    return F.sort_array(F.filter(F.transform(F.split(flat, "\n"), lambda x: F.trim(x)), lambda x: F.length(x) >= 10))


def runaway(lines: Column) -> Column:
    """line_repeats()' runaway of long_lines(): equal lines stand side by side, so the first and the last of enough are the same."""
    n = F.size(lines)
    enough = F.greatest(F.lit(8), F.ceil(n / 4).cast("int"))
    return F.when(n >= enough, F.exists(F.zip_with(F.slice(lines, F.lit(1), n - enough + 1), F.slice(lines, enough, n - enough + 1), lambda a, b: a == b), lambda same: same)).otherwise(False)


def phrase_repeats(rows: DataFrame, key: str, words, text: str = "text") -> DataFrame:
    """(key, grams, repeats, runaway) over phrases of four words."""
    ws = rows.select(key, words(F.col(text)).alias("ws")).filter(F.size("ws") >= 4)
    grams = ws.select(key, F.explode(F.transform(F.sequence(F.lit(1), F.size("ws") - 3), lambda i: F.array_join(F.slice("ws", i, 4), " "))).alias("gram"))
    times = grams.groupBy(key, "gram").agg(F.count("*").alias("n"))
    out = times.groupBy(key).agg(F.sum("n").alias("grams"), F.max("n").alias("repeats"))
    return out.withColumn("runaway", (F.col("repeats") >= 25) & (F.col("repeats") >= 0.1 * F.col("grams")))


def _ratio(texts: pd.Series) -> pd.Series:
    raw = texts.map(lambda t: " ".join(t.split()).encode() if t else b"")
    return raw.map(lambda b: len(zlib.compress(b)) / len(b) if b else 1.0)


def compression(rows: DataFrame, key: str, text: str = "text", least_words: int = 150) -> DataFrame:
    """(key, ratio, runaway): compressed over raw size of texts of enough words; 1 for others."""
    enough = F.size(F.split(F.trim(text), r"\s+")) >= least_words
    return rows.select(key, F.when(enough, F.pandas_udf(_ratio, "double")(F.col(text))).otherwise(1.0).alias("ratio")).withColumn("runaway", F.col("ratio") < 0.1)


def repeated_bands(pages: DataFrame, least: int) -> DataFrame:
    """(doc, band, pages): lines, digits as one sign, that stand on at least so many pages of a document."""
    lines = pages.select("doc", "page", F.explode(F.split("md", "\n")).alias("line")).filter(F.trim("line") != "")
    band = F.regexp_replace(F.lower(F.trim(F.regexp_replace("line", r"\s+", " "))), "[0-9]+", "#")
    return lines.select("doc", "page", band.alias("band")).distinct().groupBy("doc", "band").agg(F.count("*").alias("pages")).filter(F.col("pages") >= least)


def _bag(rows: DataFrame, name: str) -> DataFrame:
    joined = F.regexp_replace("text", r"([\p{L}\p{N}_])-[ \t]*\n[ \t]*([\p{L}\p{N}_])", "$1$2")
    found = F.filter(F.regexp_extract_all(F.lower(F.replace(joined, F.lit("\\"), F.lit(""))), F.lit(r"\p{L}+"), F.lit(0)), lambda w: F.length(w) >= 2)
    return rows.select("doc", "page", F.explode(found).alias("word")).groupBy("doc", "page", "word").agg(F.count("*").alias(name))


def layer_recall(layer: DataFrame, out: DataFrame) -> DataFrame:
    """(doc, page, layer_words, kept, recall, verdict): what of the layer's words, as a multiset, the output holds."""
    both = _bag(layer, "n").join(_bag(out, "m"), ["doc", "page", "word"], "left")
    s = both.groupBy("doc", "page").agg(F.sum("n").alias("layer_words"), F.sum(F.least("n", F.coalesce("m", F.lit(0)))).alias("kept"))
    r = F.col("kept") / F.col("layer_words")
    verdict = F.when(F.col("layer_words") < 15, "uncertain").when(r < 0.9, "lost text").when(r >= 0.97, "intact").otherwise("uncertain")
    return s.select("doc", "page", "layer_words", "kept", F.round(r, 6).alias("recall"), verdict.alias("verdict"))


def missing_words(layer: DataFrame, out: DataFrame) -> DataFrame:
    """(word, missing): multiset difference of layer and output, over all pages."""
    both = _bag(layer, "n").join(_bag(out, "m"), ["doc", "page", "word"], "left").withColumn("d", F.col("n") - F.coalesce("m", F.lit(0)))
    return both.filter("d > 0").groupBy("word").agg(F.sum("d").alias("missing"))


def real_chars(md: Column) -> Column:
    return F.length(F.regexp_replace(md, r"[^\p{L}\p{N}\p{M}]", ""))


def route(pages: DataFrame) -> DataFrame:
    """(doc, page, script, chars, branch, why): the first rule that holds decides."""
    rows = pages.select("doc", "page", "md", F.regexp_replace("md", r"[^\p{L}\p{N}\p{M}]", "").alias("t"))
    rows = rows.withColumn("counts", script_counts(F.col("t"))).select("doc", "page", dominant_script(F.col("counts")).alias("script"), F.length("t").cast("long").alias("chars"), F.col("md").contains("![").alias("pictures"))
    few = F.col("chars") < 40
    branch = F.when(F.col("chars") == 0, "raster").when(few & F.col("pictures"), "raster").when(F.col("script") == "Mixed", "raster").otherwise("digital")
    why = F.when(F.col("chars") == 0, "no text").when(few & F.col("pictures"), "hardly any text beside pictures").when(few, "short page").when(F.col("script") == "Mixed", "no script prevails").otherwise("good text layer")
    return rows.select("doc", "page", "script", "chars", branch.alias("branch"), why.alias("why"))


#: Failed checks that alone do not make a page low.
NOTES = ("table_shape",)


def gate(pages: DataFrame, tables: DataFrame) -> DataFrame:
    """(doc, page, failed, verdict, outcome) of the named checks of each page."""
    widths = F.transform(F.filter("rows", lambda r: r.isNotNull()), lambda r: F.size(r))
    shape = tables.groupBy("doc", "page").agg(F.bool_or(F.coalesce(F.array_max(widths) != F.array_min(widths), F.lit(False))).alias("ragged"))
    rows = pages.join(shape, ["doc", "page"], "left").withColumn("counts", script_counts(F.col("md")))
    checks = (("coverage", F.col("counts.letters") < 10), ("script", dominant_script(F.col("counts")) == "Mixed"), ("plausibility", F.coalesce(implausible_share(F.col("md")), F.lit(0.0)) > 0.25), ("table_shape", F.coalesce("ragged", F.lit(False))))
    failed = F.filter(F.array(*(F.when(bad, name) for name, bad in checks)), lambda x: x.isNotNull())
    rows = rows.select("doc", "page", failed.alias("f"))
    grave = F.filter("f", lambda x: ~x.isin(*NOTES))
    verdict = F.when(F.array_contains("f", "coverage"), "empty").when(F.size("f") > 0, "suspect").otherwise("ok")
    outcome = F.when(F.array_contains("f", "coverage"), "no_text").when(F.size(grave) > 0, "low").otherwise("pass")
    return rows.select("doc", "page", F.array_join("f", ",").alias("failed"), verdict.alias("verdict"), outcome.alias("outcome"))


def strip(branches: DataFrame) -> DataFrame:
    """(doc, strip): run lengths of the branches' first letters in page order, as in d3r2."""
    w = Window.partitionBy("doc").orderBy("page")
    opens = F.when(F.lag("branch").over(w) == F.col("branch"), 0).otherwise(1)
    runs = branches.withColumn("opens", opens).withColumn("run", F.sum("opens").over(w)).groupBy("doc", "run").agg(F.first("branch").alias("branch"), F.count("*").alias("n"))
    part = F.concat(F.left("branch", F.lit(1)), F.when(F.col("n") > 1, F.col("n").cast("string")).otherwise(""))
    ordered = F.array_sort(F.collect_list(F.struct("run", part.alias("part"))))
    return runs.groupBy("doc").agg(F.array_join(F.transform(ordered, lambda x: x.part), "").alias("strip"))


def unstrip(strips: DataFrame) -> DataFrame:
    """(doc, run, letter, n) of a strip."""
    parts = F.posexplode(F.regexp_extract_all("strip", F.lit(r"([a-z?])(\d*)"), F.lit(0)))
    rows = strips.select("doc", parts.alias("run", "part"))
    return rows.select("doc", "run", F.left("part", F.lit(1)).alias("letter"), F.coalesce(F.substring("part", 2, 9).try_cast("long"), F.lit(1)).alias("n"))


def ranges(pages: DataFrame) -> DataFrame:
    """(doc, ranges): page numbers as in 1-3, 7."""
    island = F.col("page") - F.row_number().over(Window.partitionBy("doc").orderBy("page"))
    runs = pages.withColumn("island", island).groupBy("doc", "island").agg(F.min("page").alias("a"), F.max("page").alias("b"))
    part = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws("-", "a", "b"))
    ordered = F.array_sort(F.collect_list(F.struct("a", part.alias("part"))))
    return runs.groupBy("doc").agg(F.array_join(F.transform(ordered, lambda x: x.part), ", ").alias("ranges"))


def continuations(tables: DataFrame) -> DataFrame:
    """(doc, page, next_page, same_width, repeated_header): the last table of a page against the first of the next page."""
    rows = tables.filter(F.col("rows").isNotNull()).dropDuplicates(["doc", "page", "table_no"])
    head = F.transform(F.try_element_at("rows", F.lit(1)), lambda c: F.lower(F.trim(F.coalesce(c, F.lit("")))))
    rows = rows.select("doc", "page", "table_no", F.struct(F.size(head).alias("width"), head.alias("head")).alias("x"))
    last = rows.groupBy("doc", "page").agg(F.max_by("x", "table_no").alias("x"))
    first = rows.groupBy("doc", "page").agg(F.min_by("x", "table_no").alias("y")).withColumn("before", F.col("page") - 1)
    both = last.alias("l").join(first.alias("f"), F.expr("l.doc = f.doc AND l.page = f.before"))
    return both.select("l.doc", "l.page", F.col("f.page").alias("next_page"), (F.col("x.width") == F.col("y.width")).alias("same_width"), (F.col("x.head") == F.col("y.head")).alias("repeated_header"))
