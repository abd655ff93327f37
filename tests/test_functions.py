from __future__ import annotations

from decimal import Decimal

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from folio.functions.numbers import looks_like_date, nearest_rank, parse_number
from folio.functions.text import tokens
from folio.operators import chunker
from folio.operators.catalog import access, mirror, redact
from folio.operators.ledgers import running_balance
from folio.operators.pages import strip, unstrip
from folio.operators.reading import glob_regex, join_pages, page_filter, read, split_pages
from folio.operators.retrieval import search


def one(spark, value, kind, column):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    ("cell", "want"),
    [("1,23,456.78", "123456.78"), ("(1,234.50)", "-1234.5"), ("500/-", "500"), ("Rs 42", "42"), ("€ 7.5", "7.5"), ("12 Dr", "-12"), ("12 Cr.", "12"), ("5-", "-5"), ("−3", "-3"), ("1,2,3", None), ("abc", None), ("", None), (None, None), (".5", "0.5")],
)
def test_parse_number(spark, cell, want):
    got = one(spark, cell, "string", parse_number)
    assert got == (None if want is None else Decimal(want))


def test_dates_and_tokens(spark):
    assert [one(spark, c, "string", looks_like_date) for c in ("01/02/2023", "2023-1-5", "5 May 2023", "May 5, 2023", "12345", None)] == [True, True, True, True, False, False]
    assert one(spark, "SVM-name 9.16.1 a/b", "string", tokens) == ["svm-name", "svm", "name", "9.16.1", "9", "16", "1", "a/b", "a", "b"]
    assert one(spark, [3.0, 1.0, 2.0, 4.0], "array<double>", lambda x: nearest_rank(x, 0.5)) == 3.0
    assert one(spark, [], "array<double>", lambda x: nearest_rank(x, 0.5)) is None


def test_chunks():
    text = "# A\n\none two three.\n\n" + "word " * 300 + "\n\n| h | i |\n|---|---|\n" + "\n".join(f"| {i} | {i} |" for i in range(60))
    got = chunker.chunks(text, 64, 16)
    assert all(chunker.est(c) <= 64 for _, c in got) and all(c.split()[0] == text[at:].split()[0] or c.startswith("| h") for at, c in got)
    assert sum("| h | i |" in c for _, c in got) > 1
    assert chunker.chunks("", 64, 16) == []
    plain = "\n".join(f"| {i} | {'cell ' * 9} |" for i in range(20))
    assert sum("| 0 |" in c for _, c in chunker.chunks(plain, 64, 0)) == 1  # no rule, no header to repeat
    web = "<table><thead><tr><th>H</th></tr></thead>" + "".join(f"<tr><td>{i} {'x ' * 20}</td></tr>" for i in range(9)) + f"<tr><td>{'long ' * 90}</td></tr></table>"
    got = [c for _, c in chunker.chunks(web, 64, 0)]
    assert all("<th>H</th>" in c for c in got if "<td>" in c) and any("<" not in c and "long" in c for c in got)
    assert [(b, t) for b, t in chunker.blocks("a\n\n```\nx\n\ny\n```\n \n\nb")] == [(0, "a"), (3, "```\nx\n\ny\n```"), (19, "b")]
    assert list(chunker.packs([4, 4, 4, 4], 8, 4)) == [(0, 2), (1, 3), (2, 4)] and list(chunker.packs([9, 1], 8)) == [(0, 1), (1, 2)]
    nodes = chunker.markdown_nodes("intro\n\n<!-- page 2 -->\n\n# B\n\ntext\n\n<!-- page 3 -->\n\nmore", 64, 0)
    assert [(p, h) for p, h, _ in nodes] == [("1", ""), ("2", "B"), ("3", "B")]


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet="ab .\n#|`", max_size=300), st.integers(2, 40), st.integers(0, 20))
def test_chunks_hold_every_word(text, size, overlap):
    got = " ".join(c for _, c in chunker.chunks(text, size, overlap)).split()
    assert set(text.split()) <= set(got) | {"```"} or "|" in text


def test_pages_round_trip(spark):
    pages = spark.createDataFrame([("d", 1, "a\nb"), ("d", 1, "a\nb"), ("d", 2, "c"), ("e", 5, "x"), ("e", 6, None)], "doc string, page int, md string")
    joined = join_pages(pages)
    assert {(r.doc, r.page, r.md) for r in split_pages(joined, "md").collect()} == {("d", "1", "a\nb"), ("d", "2", "c"), ("e", "5", "x")}
    text = {r.doc: r.md for r in joined.collect()}["d"]
    parts = [read(joined.filter("doc = 'd'"), "md", o, 7).first() for o in range(0, len(text), 7)]
    assert "".join(p.part for p in parts) == text and parts[-1].next_offset is None


def test_page_filter_and_glob(spark):
    assert [one(spark, 3, "int", lambda p, a=a: page_filter(p, a)) for a in ("3", "1-2", "2-")] == [True, False, True]
    with pytest.raises(ValueError):
        page_filter(F.lit(1), "x")
    import re

    assert re.match(glob_regex("*/a?[0-9].md"), "x/y/ab7.md") and not re.match(glob_regex("a*"), "ba")


def test_strips(spark):
    rows = spark.createDataFrame([("d", i, b) for i, b in enumerate(["digital"] * 3 + ["raster"] * 2 + ["digital"])], "doc string, page int, branch string")
    s = strip(rows)
    assert s.first().strip == "d3r2d"
    assert [(r.letter, r.n) for r in unstrip(s).orderBy("run").collect()] == [("d", 3), ("r", 2), ("d", 1)]


def test_balance_attribution(spark):
    rows = [("a", 1, None, 10, 10), ("a", 2, None, 5, 16), ("a", 3, 5, None, 10), ("b", 1, None, 1, 1), ("b", 2, None, 1, 2), ("b", 3, None, 9, 3)]
    led = spark.createDataFrame(rows, "k string, i int, debit int, credit int, balance int").select("k", "i", *(F.col(c).cast("decimal(28,2)").alias(c) for c in ("debit", "credit", "balance")))
    assert {(r.k, r.i, r.role) for r in running_balance(led, "k", "i").collect()} == {("a", 2, "balance"), ("b", 3, "amount")}


def test_access_redact_mirror(spark):
    col = spark.createDataFrame([("Open",), ("Secret",), ("Closed",)], "collection string")
    rules = spark.createDataFrame([("secret", ["hr"]), ("CLOSED", [])], "name string, clients array<string>")
    who = spark.createDataFrame([("hr",), ("guest",), ("cli",)], "client string")
    can = {(r.client, r.collection) for r in access(col, rules, who).filter("allowed").collect()}
    assert can == {("hr", "Open"), ("hr", "Secret"), ("guest", "Open"), ("cli", "Open"), ("cli", "Secret"), ("cli", "Closed")}
    shown = redact(spark.createDataFrame([("see Secret/x, secrets",)], "t string"), "t", ["secret"]).first().t
    assert shown == "see [restricted]/x, secrets"
    paths = spark.createDataFrame([("/a/b/c.txt",), ("/a/z",), ("/q",), ("/a/b",)], "path string")
    roots = spark.createDataFrame([("one", "/a"), ("two", "/a/b")], "collection string, root string")
    assert {(r.path, r.mirrored) for r in mirror(paths, roots).collect()} == {("/a/b/c.txt", "two/c.txt"), ("/a/z", "one/z"), ("/q", None), ("/a/b", "one/b")}


def test_search_modes(spark):
    rec = spark.createDataFrame([("c", 1, "red pump"), ("c", 2, "blue pump pump"), ("d", 3, None), ("d", 4, "")], "collection string, id long, text string")
    q = spark.createDataFrame([(1, "pump"), (2, "zebra")], "qid int, query string")
    hits = search(rec, q, top_k=3).collect()
    assert {(r.qid, r.id) for r in hits if r.qid == 1} == {(1, 1), (1, 2)}
    assert all(r.rrf is None for r in search(rec, q, stages=("bm25",)).collect())
    with pytest.raises(ValueError):
        search(rec, q, stages=("rerank",))
    assert search(rec.limit(0), q).count() == 0
