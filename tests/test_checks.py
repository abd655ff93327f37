"""Validators, gate, bookkeeping and streams on small fixtures: nulls, empty tables, ties, clashing names."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from folio.operators import gates as G, keeping as K, pages as P, runs as U, validators as V
from folio.plans import suite
from folio.plans.tables import ROLES, cells, column_types, table_shape

TABLES = "doc string, page int, table_no int, rows array<array<string>>, n_header int, kind string, number string"


def parsed(spark, *tables):
    rows = [("d", 1, k, t, 1, "pipe", "clash") for k, t in enumerate(tables)]
    return V.numbered(cells(spark.createDataFrame(rows, TABLES)))


LEDGER = [["Date", "Debit", "Credit", "Balance"], ["1 May 2023", "", "", "100.00"], ["2 May 2023", "30.00", None, "70.00"], ["3 May 2023", "", "5.00", "80.00"], ["4 May 2023", "", "5.00", "85.00"]]


def test_balances_run_down_or_up(spark):
    up = [LEDGER[0], *reversed(LEDGER[1:])]
    got = {(r.table_no, r.row_no, r.found, r.expected, r.direction) for r in V.balance_breaks(parsed(spark, LEDGER, up, [["Balance"], ["1"]], None), ROLES).collect()}
    assert got == {(0, 3, 80.0, 75.0, "down"), (1, 2, 80.0, 75.0, "up")}


def test_totals_of_the_last_block(spark):
    t = [["Item", "Amount"], ["a", "1.00"], ["b", "2.00"], ["Sub total", "3.00"], ["c", "4.00"], ["d", "5.00"], ["Total", "9.50"]]
    got = [(r.col_no, r.found, r.expected, r.ok) for r in V.column_totals(parsed(spark, t, [["Item", "n"], ["x", "1"]])).collect()]
    assert got == [(1, 9.5, 9.0, False)]


def test_stacked_headers_and_layout(spark):
    stacked = [["AMOUNT", "AMOUNT"], ["withdrawn", "deposited"], ["1.00", "2.00"]]
    assert {(r.col_no, r.title) for r in V.stacked_headers(parsed(spark, stacked)).collect()} == {(0, "AMOUNT withdrawn"), (1, "AMOUNT deposited")}
    twice = [["No", "Debit", "Balance"], ["1", "5.00", "6.00"], ["2", "5.00", "6.00"], ["3", "1.00", "7.00"], ["4", "1.00", "8.00"]]
    slid = [["No", "Debit", "Balance"], *([str(k), f"{k}.00", ""] for k in range(5))]
    found = {r.table_no: r.problem for r in V.layout_problems(parsed(spark, twice, slid, LEDGER), ROLES).collect()}
    assert found == {0: "repeated_rows", 1: "balance_empty"}
    none = V.numbered(cells(spark.createDataFrame([], TABLES)))
    assert V.findings(none, ROLES).count() == 0


def test_page_flags_are_those_of_the_validators(spark):
    long = "1234567890123456789012345678"
    odd = [
        LEDGER, [LEDGER[0], *reversed(LEDGER[1:])], [*LEDGER[:3], None, [], *LEDGER[3:]], [["No", "Debit", "Balance"], *([str(k), "5.00", "6.00"] for k in range(4))], [["No", "Debit", "Balance"], *([str(k), f"{k}.00", ""] for k in range(5))],
        [["Ref", "Amount"], *(["7.00", f"{k}.00 Dr"] for k in range(5))], [["a", "b", "c"], *([f"{k}.00"] * 3 for k in range(4))], [["Item", "Amount"], ["a", "1.00"], ["b", "2.00"], ["Total", "3.50"]], [["Item", "Amount"], ["a", "1.00"], ["b", "2.00"], ["Total", "3.50"], ["c", "1"], ["d", "1"], ["TOTAL:", "2"]],
        [["n"], ["1"], ["2"], ["3"], ["4"], ["1O"]], [["", None], [" "], ["", "x"], [None, None]], [["Item", "Amount"], ["a", long], ["b", "0.00000000015"], ["c", "0.99999999999"], ["Total", long]], [["AMOUNT", "BAL"], ["withdrawn", "1 May 2023"], ["(1.00)", "₹1,23,456.00-"]], None, [], [None], [[]], [["x"]],
    ]
    tables = spark.createDataFrame([("d", k, 0, t, n, "pipe") for k, (t, n) in enumerate((t, n) for t in odd for n in (1, None, 0, 3))] + [("d", 0, 0, LEDGER, 1, "pipe")], "doc string, page int, table_no int, rows array<array<string>>, n_header int, kind string")
    shape = table_shape(tables).select("page", "ragged", ((F.col("n_rows") >= 4) & (F.col("empty_share") > 0.6)).alias("blank_table"))
    types = column_types(tables).groupBy("page").agg(F.bool_or("suspect").alias("column_types"))
    want = shape.join(types, "page", "left").join(V.findings(V.numbered(cells(tables)), ROLES), "page", "left")
    of = lambda df: {r.page: tuple(bool(r[f]) for f in V.FLAGS) for r in df.select("page", *V.FLAGS).collect()}
    got = of(V.page_flags(tables, ROLES))
    assert got == of(want)
    assert all(any(flags[k] for flags in got.values()) for k in range(len(V.FLAGS)))


def test_runaway_is_that_of_line_repeats(spark):
    texts = [None, "", "short\n" * 50, *("the same line | again\n" * k + "".join(f"another line {i}\n" for i in range(n)) for k in (7, 8, 9) for n in (0, 24, 25, 28, 29))]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    want = {r.id for r in P.line_repeats(rows, "id").filter("runaway").collect()}
    assert {r.id for r in rows.withColumn("lines", P.long_lines(F.col("text"))).filter(P.runaway(F.col("lines"))).collect()} == want != set()


def test_gate_full_has_few_shuffles(spark, sf):
    plan = suite.queries()["gate_full"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    # The driver holds the state of every shuffle of a plan: there were 49.
    assert 0 < plan.count("Exchange hashpartitioning") <= 3


def test_gate_names_each_check(spark):
    good = "The regional manager approved the annual budget review of the building service before the night shift began in May. " * 3
    base = {"kind": "scan", "ocr": True, "hidden_layer": False, "chars": 0, "text_ok": True, "script": "Latin", "ink": 0.03, "dpi": 300, "size_px": [2000, 3000], "grade": "good", "low": 0.9, "layer_words": 0, "layer_verdict": None, "asked": 0, "read": 0, "runaway": False, "layout": False, "ragged": False, "blank_table": False, "has_table": False, "column_types": False, "running_balance": False, "totals": False}
    cases = [
        ({}, good, ""), ({"ink": 0.3}, good, "expected_size"), ({"dpi": 100}, good, "low_resolution"), ({"dpi": 72, "size_px": [500, 400]}, good, "low_resolution"), ({"grade": "Poor"}, good, "docling_grade"), ({"low": 0.2}, good, "docling_grade"),
        ({"runaway": True}, good, "degenerate"), ({"ragged": True}, good, "table_shape"), ({"asked": 2, "read": 1}, good, "residue_read"), ({"script": "Devanagari"}, good, "script"), ({"column_types": True}, good, "column_types"),
        ({"running_balance": True}, good, "running_balance"), ({"totals": True}, good, "totals"), ({"ink": 0.02}, "few words", "coverage,expected_size"), ({"ink": 0.002}, "bcdfgh x1y2 " * 12, "plausibility"), ({"kind": "digital", "ocr": False, "chars": 9000}, good, "coverage"),
    ]
    schema = "doc string, page int, md string, kind string, ocr boolean, hidden_layer boolean, chars int, text_ok boolean, script string, ink double, dpi int, size_px array<int>, grade string, low double, layer_words int, layer_verdict string, asked int, read int, runaway boolean, layout boolean, ragged boolean, blank_table boolean, has_table boolean, column_types boolean, running_balance boolean, totals boolean"
    rows = [("d", k, md, *({**base, **change}.values())) for k, (change, md, _) in enumerate(cases)]
    rows.append(("d", 90, None, "other", *[None] * 22))
    rows.append(("d", 91, good, *({**base, "kind": "digital", "chars": 10, "layer_words": 50, "layer_verdict": "intact", "totals": True, "ragged": True}.values())))
    got = {r.page: r for r in G.check_pages(spark.createDataFrame(rows, schema)).collect()}
    assert [got[k].failed for k in range(len(cases))] == [want for _, _, want in cases]
    assert got[90].verdict == "empty" and got[90].outcome == "no_text"
    assert (got[91].failed, got[91].notes, got[91].verdict, got[91].escalate) == ("", "table_shape,totals", "ok", False)
    assert not got[2].escalate and got[1].escalate and got[0].outcome == "pass"


def test_runs_plan_and_reliability(spark):
    pages = spark.createDataFrame([("d", p) for p in [*range(1, 46), 50, 50]] + [("e", 7)], "doc string, page int")
    assert {tuple(r) for r in G.page_runs(pages).collect()} == {("d", 1, 20), ("d", 21, 40), ("d", 41, 45), ("d", 50, 50), ("e", 7, 7)}
    rows = spark.createDataFrame([("d", p, True, 500) for p in range(30)] + [("e", p, p > 5, 500) for p in range(12)] + [("f", 1, None, None)], "doc string, page int, ok boolean, chars int")
    assert {r.doc: r.reliable for r in G.layer_reliability(rows).collect()} == {"d": True, "e": False, "f": False}
    assert {r.doc: (r.pages, r.sampled) for r in G.layer_reliability(rows).collect()} == {"d": (30, 12), "e": (12, 12), "f": (1, 1)}


def test_freshness_names_the_first_difference(spark):
    wanted = {"format": 2, "chunk_size": 512, "chunk_overlap": 64, "chunker": "c", "tokenizer": "t", "model": "m", "convert": "v"}
    schema = "doc string, src_path string, src_sha256 string, nodes int, dim int, format int, chunk_size int, chunk_overlap int, chunker string, tokenizer string, model string, convert string"
    row = lambda doc, **x: tuple({"doc": doc, "src_path": "/a", "src_sha256": "AA", "nodes": 3, "dim": 64, **wanted, **x}.values())
    builds = spark.createDataFrame([row("ok"), row("model", model="n"), row("overlap", chunk_overlap=None), row("empty", nodes=None), row("moved", src_path="/b")], schema)
    present = spark.createDataFrame([("/a", "aa")], "src_path string, sha string")
    assert {r.doc: r.why for r in K.fresh_builds(builds, present, wanted).collect()} == {"ok": None, "model": "model", "overlap": "chunk_overlap", "empty": "nodes", "moved": "checksum"}


def test_failures_are_remembered_until_a_success(spark):
    t = lambda d: dt.datetime(2024, 1, d)
    rows = [(1, "/a", "AA", t(1), "r1", "error"), (2, "/a", "aa", t(2), "r2", "error"), (2, "/a", "aa", t(2), "r2", "error"), (3, "/b", "bb", t(1), "r1", "error"), (4, "/b", "bb", t(2), "r2", "ok"), (5, "/c", "c1", t(1), "r1", "error"), (6, "/c", "c2", t(2), "r1", "ok"), (7, None, None, None, None, None)]
    trace = spark.createDataFrame(rows, "trace_id long, src_path string, src_sha256 string, written_at timestamp, convert string, outcome string")
    assert [tuple(r) for r in K.remembered(trace).collect()] == [("/a", "aa", 2)]


def test_layer_phrases_and_rules(spark):
    pages = spark.createDataFrame([("d", p, f"Handbook {p}\n\nbody of page {'abc'[p - 1]}\nPage {p} of 3") for p in (1, 2, 3)], "doc string, page int, md string")
    assert {(r.page, r.text, r.numbers, r.bands) for r in K.cleaned_layer(pages).collect()} == {(p, f"body of page {'abc'[p - 1]}", 1, 1) for p in (1, 2, 3)}
    docs = spark.createDataFrame([(1, "Paid 1,200 for the (annual) budget."), (2, "annual"), (3, None)], "k int, t string")
    assert {r.phrase: r.hits for r in K.phrase_hits(docs, "k", "t", ["annual budget", "1200", "nnual"]).collect()} == {"annual budget": 1, "1200": 1, "nnual": 0}
    rules = spark.createDataFrame([("Pay", ["hr"])], "name string, clients array<string>")
    grant = K.access_change(K.access_change(rules, "grant", "pay", ["cli"]), "restrict", "new", [])
    assert {r["name"]: r.clients for r in grant.collect()} == {"Pay": ["cli", "hr"], "new": []}
    assert K.access_change(rules, "open", "PAY", []).count() == 0
    assert [r[0] for r in spark.createDataFrame([("ok name",), (".x",), ("a/b",), (None,), ("end ",)], "n string").select(K.plain_name(F.col("n"))).collect()] == [True, False, False, False, False]


def test_headings_over_stretches(spark, monkeypatch):
    monkeypatch.setattr(U, "STRETCH", 3)
    rows = [(f"c{k:02d}", "d" if k < 18 else None, k % 18, {1: "A", 4: "B"}.get(k)) for k in range(20)]
    got = {r.chunk_id: r.in_effect for r in U.headings(spark.createDataFrame(rows, "chunk_id string, doc string, ord int, heading string")).collect()}
    assert [got[f"c{k:02d}"] for k in range(20)] == [None, *"AAA", *["B"] * 14, None, None]


def test_windowed_stream_keeps_the_last_update(spark, tmp_path):
    from folio.streaming.events import replay_counts

    at = dt.datetime(2024, 1, 1, 5, 10)
    rows = spark.createDataFrame([(k, at, 1, "view", 1.0, "{}") for k in range(6)], "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    rows.repartition(3).write.parquet(str(tmp_path / "e.parquet"))
    got = replay_counts(spark.read.parquet(str(tmp_path / "e.parquet"))).collect()
    assert [(r.n, r.total) for r in got] == [(6, 6.0)]
