"""Reading documents: page markers, slices, page ranges, listings and name resolution."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

MARKER = r"<!--\s*page\s+(\S+)\s*-->"


def join_pages(pages: DataFrame) -> DataFrame:
    """(doc, md): the pages with text in order, each after its marker; copies once."""
    rows = pages.filter(F.col("md").isNotNull()).dropDuplicates(["doc", "page"])
    part = F.concat(F.lit("<!-- page "), F.col("page").cast("string"), F.lit(" -->\n\n"), F.col("md"))
    ordered = F.array_sort(F.collect_list(F.struct("page", part.alias("part"))))
    return rows.groupBy("doc").agg(F.array_join(F.transform(ordered, lambda x: x.part), "\n\n").alias("md"))


def split_pages(docs: DataFrame, text: str) -> DataFrame:
    """(doc, page, md): text before the first marker is page 1; of a page given twice the later text stays; blank pages are left out."""
    parts = F.split(text, MARKER)
    names = F.concat(F.array(F.lit("1")), F.regexp_extract_all(text, F.lit(MARKER), F.lit(1)))
    rows = docs.select("doc", F.posexplode(F.arrays_zip(names.alias("page"), parts.alias("md"))).alias("i", "p")).select("doc", "i", "p.page", F.regexp_replace("p.md", r"^[ \t\r\n]+|[ \t\r\n]+$", "").alias("md")).filter("md <> ''")
    return rows.groupBy("doc", "page").agg(F.max_by("md", "i").alias("md"))


def read(docs: DataFrame, text: str, offset: int, most: int) -> DataFrame:
    """(doc, part, total, next_offset) of a slice; next_offset is null at the end."""
    total = F.length(text)
    return docs.select("doc", F.substring(text, offset + 1, most).alias("part"), total.alias("total"), F.when(total > offset + most, offset + most).alias("next_offset"))


def page_filter(page: Column, asked: str) -> Column:
    """Pages N, N-M or N-; anything else is an error."""
    m = re.fullmatch(r"\s*(\d+)\s*(?:(-)\s*(\d*))?\s*", asked)
    if not m:
        raise ValueError(f"pages are N, N-M or N-, not {asked!r}")
    low = page >= int(m[1])
    return low & (page <= int(m[3])) if m[3] else low if m[2] else page == int(m[1])


def page_range(pages: DataFrame, asked: str) -> DataFrame:
    rows = pages.filter(F.col("md").isNotNull() & page_filter(F.col("page"), asked)).dropDuplicates(["doc", "page"])
    ordered = F.array_sort(F.collect_list(F.struct("page", "md")))
    return rows.groupBy("doc").agg(F.array_join(F.transform(ordered, lambda x: x.md), "\n\n").alias("md"))


def glob_regex(glob: str) -> str:
    """A shell pattern as a regular expression; '*' crosses slashes."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        end = glob.find("]", i + 2) if c == "[" else -1
        if c == "[" and end > 0:
            body = glob[i + 1 : end]
            out += "[" + ("^" + body[1:] if body[0] == "!" else body).replace("\\", "\\\\") + "]"
            i = end
        else:
            out += ".*" if c == "*" else "." if c == "?" else re.escape(c)
        i += 1
    return f"^{out}$"


def matching(docs: DataFrame, name: str, prefixes: list[str] | None = None, glob: str | None = None) -> DataFrame:
    """Documents under any of the prefixes whose name matches; order and pages are the caller's orderBy, offset and limit."""
    rows = docs
    if prefixes:
        cond = F.lit(False)
        for p in prefixes:
            cond = cond | F.col(name).startswith(p)
        rows = rows.filter(cond)
    return rows if glob is None else rows.filter(F.col(name).rlike(glob_regex(glob)))


def resolve(asked: DataFrame, docs: DataFrame) -> DataFrame:
    """(ident, doc, state): whole names before short names, each exact before folded; several of the best kind are ambiguous."""
    d = docs.select("doc", F.regexp_replace("doc", "^.*/", "").alias("short")).distinct()
    keys = F.explode(F.array(*(F.struct(F.lit(t).alias("tier"), k.alias("k"), F.lit(f).alias("fold")) for t, k, f in ((1, F.col("doc"), False), (2, F.lower("doc"), True), (3, F.col("short"), False), (4, F.lower("short"), True)))))
    names = d.select("doc", keys.alias("n")).select("doc", "n.*")
    wanted = asked.select("ident", F.explode(F.array(F.struct(F.col("ident").alias("k"), F.lit(False).alias("fold")), F.struct(F.lower("ident").alias("k"), F.lit(True).alias("fold")))).alias("w")).select("ident", "w.*")
    hits = wanted.join(names, ["k", "fold"]).withColumn("r", F.rank().over(Window.partitionBy("ident").orderBy("tier"))).filter("r = 1")
    best = hits.groupBy("ident").agg(F.count_distinct("doc").alias("n"), F.min("doc").alias("doc"))
    state = F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "ambiguous").otherwise("found")
    return asked.join(best, "ident", "left").select("ident", F.when(F.col("n") == 1, F.col("doc")).alias("doc"), state.alias("state"))
