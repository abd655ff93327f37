from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from folio.operators.snapshot import Generations, PublishRefused, cached_reads, export_collection, import_collection
from folio.sources.files import convert, csv_to_markdown, decode, fingerprints, labelled_queries, scan
from folio.sources.html import grid, html_tables, html_to_markdown
from folio.sources.rtf import rtf_to_markdown


def test_scan_and_convert(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / ".hid").mkdir()
    for name, data in {"a/x.txt": b"caf\xe9", "a/t.csv": b"h,i\n1,2|3\n", "p.html": b"<h1>T</h1><p>a &amp; b</p>", "q.pdf": b"%PDF", "z.bin": b"1", ".hid/s.txt": b"no", "~$l.docx": b"no"}.items():
        (tmp_path / name).write_bytes(data)
    files = scan(spark, str(tmp_path))
    assert {r.name: r.kind for r in files.collect()} == {"x.txt": "text", "t.csv": "table", "p.html": "html", "q.pdf": "pdf", "z.bin": None}
    got = {r.path.rsplit("/", 1)[1]: (r.md, r.error) for r in convert(files).collect()}
    assert got["x.txt"] == ("café", None) and got["p.html"][0] == "# T\n\na & b" and got["q.pdf"][0] is None and got["t.csv"][0].startswith("| h | i |")
    assert fingerprints(files).filter(F.length("sha256") == 64).count() == 5


def test_decode_csv():
    assert [decode(b) for b in (b"\xef\xbb\xbfa", "é".encode("utf-16"), "é".encode(), b"\x80")] == ["a", "é", "é", "€"]
    assert csv_to_markdown("a\n1,2\n") == "| a |  |\n|---|---|\n| 1 | 2 |" and csv_to_markdown("") == ""


def test_html():
    rows, heads = grid([[["A", 1, 2, True]], [["x", 2, 1, False], ["y", 1, 1, False]], [["z", 1, 1, False]]])
    assert rows == [["A", ""], ["x", "y"], ["", "z"]] and heads == 1
    nested = "a<table><tr><td>1<table><tr><td>i</td><td>j</td><td>k</td></tr></table></td></tr></table>b"
    assert len(html_tables(nested)) == 1 and html_tables(nested)[0][2] == [["i", "j", "k"]]
    assert html_to_markdown("<ul><li>a</li><li>b</li></ul><ol><li>c</li></ol><script>x</script>") == "- a\n- b\n\n1. c"
    assert html_tables("") == [] and html_to_markdown("") == ""


def test_rtf():
    doc = rb"{\rtf1\ansi\ansicpg1252{\fonttbl{\f0 Arial;}}caf\'e9 \u8364?\par two{\*\x hidden}\par\trowd a\cell b\cell\row\trowd 1\cell 2\cell\row\pard end}"
    got = rtf_to_markdown(doc)
    assert got == "café €\n\ntwo\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\nend"
    assert rtf_to_markdown(b"plain") == "plain" and rtf_to_markdown(b"{\\rtf1}") == ""


def test_labelled_queries(spark, tmp_path):
    p = tmp_path / "q.jsonl"
    p.write_text('# c\n{"query": "a", "relevant": [{"file": "f", "page": "2"}]}\n\n{"query": "b"}\nbroken\n')
    assert [(r.line, r.query, len(r.relevant), r.error) for r in labelled_queries(spark, str(p)).orderBy("line").collect()] == [(2, "a", 1, None), (4, "b", 0, None), (5, None, 0, "not a query")]


def test_generations(spark, tmp_path):
    rows = spark.createDataFrame([("a", "d1", "c1", "m", "/x"), ("a", "d2", "c2", "m", "/y"), ("b", "d3", "c3", "n", "/z")], "collection string, doc string, chunk_id string, model string, src_path string")
    g = Generations(spark, f"file://{tmp_path}/g")
    assert g.publish(rows)["number"] == 1 and g.publish(rows)["number"] == 1
    with pytest.raises(PublishRefused):
        g.publish(rows.filter("collection = 'a'"))
    with pytest.raises(PublishRefused):
        g.publish(rows.withColumn("collection", F.lit("a")))
    assert g.publish(rows.filter("collection = 'a'"), allow_drop=True)["number"] == 2 and g.read().count() == 2
    g.publish(rows)
    assert g.collect_garbage(2) == ["000001"] and g.read().count() == 3
    out = str(tmp_path / "bundle")
    assert export_collection(rows, "a", out).count() == 2
    assert {r.collection for r in import_collection(spark, out, "new", "m").collect()} == {"new"}
    with pytest.raises(PublishRefused):
        import_collection(spark, out, "new", "other")


def test_cache(spark):
    wanted = spark.createDataFrame([("h1",), ("h2",)], "content_hash string")
    key = wanted.filter("content_hash = 'h1'").select(F.left(F.sha2(F.concat_ws("\0", "content_hash", F.lit("s")), 256), F.lit(40)).alias("key")).withColumn("md", F.lit("text"))
    hits, misses = cached_reads(wanted, key, "s")
    assert [r.content_hash for r in hits.collect()] == ["h1"] and [r.content_hash for r in misses.collect()] == ["h2"]
