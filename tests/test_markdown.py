from __future__ import annotations

from hypothesis import given, settings, strategies as st

from pyspark.sql import functions as F

from folio.operators import layers as L
from folio.operators import markdown_tables as T

MD = "intro\n\n| a | b\\|c |\n|---|---:|\n| 1 | 2 |\n| 3 |\n\ntext\n<table><tr><th>h</th></tr><tr><td>1,5</td></tr></table>\n"


def test_find_and_replace():
    pipe, web = T.find_tables(MD)
    assert pipe.rows == [["a", "b|c"], ["1", "2"], ["3", ""]] and MD[pipe.start : pipe.end].startswith("| a")
    assert web.kind == "html" and web.rows == [["h"], ["1,5"]] and MD[web.start : web.end].endswith("</table>")
    changed = T.replace_cell(MD, 0, 2, 1, "x|y")
    assert T.find_tables(changed)[0].rows[2] == ["3", "x|y"] and T.find_tables(changed)[0].rows[:2] == pipe.rows[:2]
    assert T.find_tables(None) == [] and T.find_tables("") == []
    assert not T.is_separator("|" * 9000) and not T.is_separator("\n" * 200)


def test_html_to_pipes_twice():
    once = T.pipes_for_html(MD)
    assert "<table" not in once and T.pipes_for_html(once) == once
    kept = "<table><tr><td>a<br>b</td></tr></table>"
    assert T.pipes_for_html(kept) == kept
    merged = "<table><tr><td colspan=2>a</td></tr><tr><td>1</td><td>2</td></tr></table>"
    assert T.pipes_for_html(merged) == merged and T.pipes_for_html("<table><tr><td>a</td></tr>") == "<table><tr><td>a</td></tr>"


def test_joined_rows():
    cut = "| a | b |\n|---|---|\n| 1 | 2 |\n\n| 3 | 4 |\n\ntext"
    assert T.join_split_tables(cut) == cut.replace("2 |\n\n|", "2 |\n|") and T.join_split_tables(T.join_split_tables(cut)) == T.join_split_tables(cut)
    short = "| a | b | c |\n|---|---|---|\n\n| 1 | 2 |\n\n\n| 3 | 4 | 5 |\n| 6 | 7 | 8 |"
    assert T.join_split_tables(short) == short.replace("|\n\n|", "|\n|").replace("|\n\n\n|", "|\n|")
    two = "| a | b |\n|---|---|\n| 1 | 2 |\n\n| c | d |\n|---|---|\n| 3 | 4 |"
    assert T.join_split_tables(two) == two and T.join_split_tables("") == ""
    assert T.is_separator("|:--|--:|") and not T.is_separator("|-|-|") and not T.is_separator("| a |--|")


def test_continuations():
    head = "| Item | Amount |\n|---|---|\n"
    pages = {1: "text\n\n" + head + "| a | 1.50 |\n", 2: "| b | 2.50 |\n| c | 3.50 |\n", 3: head + "| d | 4.50 |\n\nend", 4: "| lone | 1 |\n", 9: "| x | 2.00 |\n"}
    out, joined = T.continue_tables(pages)
    assert joined == [(1, 3, "added", 4)] and out[2].startswith("| Item | Amount |")
    assert T.continue_tables({}) == ({}, [])
    years = {1: "| Item | Note |\n|---|---|\n| a | x |\n", 2: "| b | y |\n"}  # the second page holds no data that would tell
    assert T.continue_tables(years) == (years, [])
    data_head = {1: "| a | 1.50 |\n|---|---|\n| b | 2.50 |\n", 2: "| c | 3.50 |\n"}
    assert T.continue_tables(data_head)[1] == []
    assert T.data_like(["x", "01/02/2023"]) and not T.data_like(["Item", "2022", "2023"]) and not T.data_like(["Balance", "1.00"]) and not T.data_like(["1", "2"])


def test_reconcile_runs_of_pages(spark):
    head = "| Item | Amount |\n|---|---|\n"
    rows = [("d", 1, "t\n" + head + "| a | 1.50 |"), ("d", 2, "| b | 2.50 |"), ("d", 3, "| c | 3.50 |\n"), ("d", 4, "text"), ("e", 1, head + "| a | 1.50 |"), ("e", 3, "| b | 2.50 |"), ("d", 2, "| b | 2.50 |"), ("f", 1, None)]
    pages = spark.createDataFrame(rows, "doc string, page int, md string")
    assert [tuple(r) for r in T.reconcile(pages).collect()] == [("d", 1, 3, "added", 3)]
    assert T.reconcile(pages.limit(0)).count() == 0


def test_cells():
    truth = [[["a", "1.00"], ["b", "(2.00)"], ["c", "3"]]]
    assert T.cell_scores(truth, truth) == (3, 3, 3)
    assert T.cell_scores([[["b", "-2"], ["a", "9"]]], truth) == (3, 1, 1)
    assert T.cell_scores([], truth) == (3, 0, 0)


def test_layers():
    assert L.missing_lines("one two\nthree four\none two", "one two three") == ["three four", "one two"]
    assert L.tokens("ﬁnd pay-\nment 1,234") == ["find", "payment", "#1234"] and L.tokens(None) == []
    assert L.filled("md", []) == "md" and L.filled("md", ["x" * 30_000]) == "md" and L.MARK in L.filled("md", ["a"])


def test_looping(spark):
    rows = spark.createDataFrame([("the same words again and over again. " * 200,), ("short",), (None,), ("",)], "t string")
    assert [r[0] for r in rows.select(L.looping(F.col("t"))).collect()] == [True, False, False, False]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=8), st.lists(st.sampled_from("abc"), max_size=8))
def test_distance(a, b):
    d = L.sequence_distance(a, b)
    assert d == L.sequence_distance(b, a) and abs(len(a) - len(b)) <= d <= max(len(a), len(b)) and (d == 0) == (a == b)
