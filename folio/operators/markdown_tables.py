"""Tables inside Markdown: found with their places, rewritten, joined, continued over pages.

A table is (kind, start, end, rows, n_header): kind pipe or html, start and end in code points, rows rectangular. Everything about
pipe tables is read off one table of the text's lines: the cells of lines with bars, which lines are rules, and the runs of rows.
Texts that are null have no tables.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from folio.sources.html import html_tables, to_pipes

#: A cell of a rule. Fixed value.
RULE_CELL = re.compile(r":?-{2,}:?")
#: The longest line that is looked at for a rule.
LONGEST_RULE = 4_000
BAR = re.compile(r"(?<!\\)\|")
SPANS = re.compile(r"\b(?:row|col)span\s*=\s*[\"']?\s*0*(?:[2-9]|1\d)", re.I)
TABLE = "kind string, start_at int, end_at int, rows array<array<string>>, n_header int"


class Table(NamedTuple):
    kind: str
    start: int
    end: int
    rows: list[list[str]]
    n_header: int


class Line(NamedTuple):
    start: int
    text: str
    #: None for a line without a bar.
    cells: list[str] | None
    rule: bool


def pipe_cells(line: str) -> list[str]:
    """Cells of a pipe row; outer bars are dropped, escaped bars are text."""
    parts = BAR.split(line.strip())
    if len(parts) > 1 and not parts[0].strip():
        parts = parts[1:]
    if len(parts) > 1 and not parts[-1].strip():
        parts = parts[:-1]
    return [p.strip().replace("\\|", "|") for p in parts]


def is_separator(line: str) -> bool:
    """Whether a line is a rule: cells of two dashes or more, with colons at their ends."""
    return len(line.strip()) <= LONGEST_RULE and all(map(RULE_CELL.fullmatch, pipe_cells(line)))


def line_table(md: str) -> list[Line]:
    out, at = [], 0
    for text in md.split("\n"):
        bar = "|" in text
        out.append(Line(at, text, pipe_cells(text) if bar else None, bar and is_separator(text)))
        at += len(text) + 1
    return out


def _squared(rows: list[list[str]]) -> list[list[str]]:
    width = max(map(len, rows))
    return [r + [""] * (width - len(r)) for r in rows]


def pipe_tables(md: str) -> list[Table]:
    """A table begins at the line above a rule, if that line has a bar and no table holds it yet, and takes all lines with bars below."""
    lines = line_table(md)
    plain = [i for i, line in enumerate(lines) if line.cells is None] + [len(lines)]
    out, free = [], 0
    for rule in (i for i, line in enumerate(lines) if line.rule):
        if rule - 1 < free or lines[rule - 1].cells is None:
            continue
        free = plain[bisect_left(plain, rule)]
        rows = [lines[i].cells for i in (rule - 1, *range(rule + 1, free))]
        end = lines[free].start if free < len(lines) else len(md)
        out.append(Table("pipe", lines[rule - 1].start, end, _squared(rows), 1))
    return out


def find_tables(md: str | None) -> list[Table]:
    """All tables in reading order; pipe rows inside an HTML table are its text."""
    if not md:
        return []
    web = [Table("html", *t) for t in html_tables(md)] if "<table" in md.lower() else []
    pipes = [t for t in pipe_tables(md) if not any(w.start <= t.start < w.end for w in web)]
    return sorted([*web, *pipes], key=lambda t: t.start)


def replace_cell(md: str, table: int, row: int, col: int, text: str) -> str:
    """The Markdown with one body or header cell of a table replaced; refuses cells that are not there.

    Of HTML tables only those without merged or nested cells can be written back, as pipe tables.
    """
    t = find_tables(md)[table]
    if not (0 <= row < len(t.rows) and 0 <= col < len(t.rows[row])):
        raise ValueError(f"no cell {row}, {col} in table {table}")
    if t.kind == "html":
        changed = pipes_for_html(md[t.start : t.end])
        if changed == md[t.start : t.end]:
            raise ValueError(f"table {table} has merged or nested cells")
        return md[: t.start] + replace_cell(changed, 0, row, col, text) + md[t.end :]
    lines = md[t.start : t.end].split("\n")
    k = row if row == 0 else row + 1
    cells = pipe_cells(lines[k])
    cells += [""] * (col + 1 - len(cells))
    cells[col] = text
    lines[k] = "| " + " | ".join(c.replace("|", "\\|").replace("\n", " ") for c in cells) + " |"
    return md[: t.start] + "\n".join(lines) + md[t.end :]


def pipes_for_html(md: str) -> str:
    """HTML tables as pipe tables where that loses nothing: no merged cells, breaks or nested tables, and an end. Others stay.

    Applying it twice changes nothing.
    """
    for t in reversed(find_tables(md)):
        source = md[t.start : t.end]
        low = source.lower()
        simple = low.count("<table") == 1 and low.rstrip().endswith("</table>") and not SPANS.search(source) and not re.search(r"<(?:br|ul|ol|p|img)\b", low)
        if t.kind == "html" and simple and any(c for r in t.rows for c in r):
            before, after = md[: t.start].rstrip("\n"), md[t.end :].lstrip("\n")
            md = "\n\n".join(x for x in (before, to_pipes(t.rows, 1), after) if x)
    return md


def join_split_tables(md: str) -> str:
    """Rows that blank lines cut from a table are its rows again: they begin with a bar, are no table of their own, and have the
    header's number of cells or up to two fewer, as readers leave out empty cells at the end."""
    lines = line_table(md)
    row = [line.text.lstrip().startswith("|") and line.text.count("|") > 1 for line in lines]
    runs: list[list[int]] = []
    for i in (i for i, r in enumerate(row) if r):
        if runs and runs[-1][1] == i:
            runs[-1][1] = i + 1
        else:
            runs.append([i, i + 1])
    gone: set[int] = set()
    width, last = 0, None
    for a, b in runs:
        gap = range(last, a) if last is not None else range(0)
        own = lines[a].rule or a + 1 < len(lines) and lines[a + 1].rule
        if width and gap and not any(lines[i].text.strip() for i in gap) and not own and max(2, width - 2) <= len(lines[a].cells) <= width:
            gone.update(gap)
        elif gap and any(lines[i].text.strip() for i in gap) or own:
            width = 0
        rules = [i for i in range(a, b) if lines[i].rule]
        if rules:
            width = len(lines[rules[-1] - 1].cells) if rules[-1] > a else 0
        last = b
    return "\n".join(line.text for i, line in enumerate(lines) if i not in gone)


def tables_of(pages: DataFrame) -> DataFrame:
    """(doc, page, table_no, TABLE) of every table of (doc, page, md)."""

    def run(batches):
        for pdf in batches:
            out = [(d, p, n, *t) for d, p, md in zip(pdf["doc"], pdf["page"], pdf["md"]) for n, t in enumerate(find_tables(md))]
            yield pd.DataFrame(out, columns=["doc", "page", "table_no", "kind", "start_at", "end_at", "rows", "n_header"])

    rows = pages.filter(F.col("md").contains("|") | F.lower("md").contains("<table")).select("doc", "page", "md")
    return rows.mapInPandas(run, f"doc string, page int, table_no int, {TABLE}")


# ── tables that go on over pages ─────────────────────────────────────────────────────────

# What figures, amounts, dates, years and titles of statement columns look like.
FIGURE = re.compile(r"[-+($€£₹]*\d[\d,. ]*\)?%?(?: ?[CD]r\.?)?", re.I)
AMOUNT = re.compile(r"\d\.\d|\d,\d{2,3}")
DATE = re.compile(r"\d{1,2}[-/. ]\d{1,2}[-/. ]\d{2,4}|\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[- /]?[A-Za-z]{3,9}[- /,]*\d{2,4}")
YEAR = re.compile(r"(?:19|20)\d\d")
TITLE = re.compile(r"\bbal(?:ance)?\b|\bdebits?\b|withdraw|\bpayments?\b|\bcredits?\b|deposit|\breceipts?\b|\bamount\b", re.I)
#: Share of the titles that a repeated header repeats.
REPEATED = 0.6


def data_like(row: list[str]) -> bool:
    """A row of amounts or dates rather than titles; years and column numbers are titles."""
    cells = [c.strip() for c in row if c.strip()]
    if any(map(TITLE.search, cells)):
        return False
    dates = [c for c in cells if DATE.fullmatch(c)]
    figures = [c for c in cells if FIGURE.fullmatch(c)]
    return bool(dates) or any(AMOUNT.search(c) for c in figures if not YEAR.fullmatch(c))


def titles_agree(a: list[str], b: list[str]) -> bool:
    """Whether most titles of two headers are the same, whatever their case and signs."""
    bare = lambda c: re.sub(r"\W+", "", c.lower())
    pairs = Counter(bare(x) == bare(y) for x, y in zip(a, b) if bare(x) or bare(y))
    return pairs[True] > 0 and pairs[True] >= REPEATED * pairs.total()


class Edges(NamedTuple):
    """The table that a page begins with (n_header 0 for rows without a header) and the one that it ends with."""

    first: Table | None
    last: Table | None


def page_edges(md: str) -> Edges:
    found = find_tables(md)
    last = found[-1] if found and not md[found[-1].end :].strip() else None
    if found and not md[: found[0].start].strip():
        return Edges(found[0], last)
    lines = line_table(md)
    a = next((i for i, line in enumerate(lines) if line.text), len(lines))
    b = next((i for i in range(a, len(lines)) if not lines[i].text.strip()), len(lines))
    top = lines[a:b]
    if not top or not all(line.text.lstrip().startswith("|") and not line.rule for line in top):
        return Edges(None, last)
    end = lines[b].start if b < len(lines) else len(md)
    bare = Table("pipe", lines[a].start, end, _squared([line.cells for line in top]), 0)
    return Edges(bare, bare if last is None and not md[end:].strip() else last)


def continuation(above: Table, below: Table) -> str | None:
    """'repeated' or 'added' where the table below goes on with the one above on the page before, else None.

    Both have the same two or more columns, the one above has a header that is none of data and a row of data; the one below
    repeats that header or begins with data.
    """
    width = len(above.rows[0])
    if width < 2 or width != len(below.rows[0]) or len(above.rows) < 2 or data_like(above.rows[0]):
        return None
    if below.n_header and titles_agree(above.rows[0], below.rows[0]):
        return "repeated" if len(below.rows) > below.n_header else None
    return "added" if data_like(below.rows[0]) else None


def continue_tables(pages: dict[int, str]) -> tuple[dict[int, str], list[tuple[int, int, str, int]]]:
    """The pages, continuations given the header they lack, and (first page, last page, 'repeated' or 'added', rows) of each joined table.

    A table over several pages is one entry, named by how its first continuation came.
    """
    out, joined = dict(pages), []
    for page in sorted(pages):
        if page - 1 not in pages:
            continue
        above, below = page_edges(out[page - 1]).last, page_edges(out[page]).first
        how = continuation(above, below) if above and below and above.n_header else None
        if how is None:
            continue
        rows = len(below.rows) - (below.n_header if how == "repeated" else 0)
        if how == "added":
            md = out[page]
            out[page] = md[: below.start] + to_pipes([above.rows[0], *below.rows], 1) + ("\n" if md[: below.end].endswith("\n") else "") + md[below.end :]
        whole_page = not out[page - 1][: above.start].strip()
        if joined and joined[-1][1] == page - 1 and whole_page:
            first, _, kind, n = joined.pop()
            joined.append((first, page, kind, n + rows))
        else:
            joined.append((page - 1, page, how, len(above.rows) - above.n_header + rows))
    return out, joined


def reconcile(pages: DataFrame) -> DataFrame:
    """(doc, first_page, last_page, header, n_rows) of the tables that go on over pages.

    A page's new header feeds the next page, so pages are worked in order, but only inside a run of pages of which each ends with a
    row or a table and the next begins with one; such runs, not documents, are the groups, and other pages never leave the scan.
    """
    starts = F.col("md").rlike(r"(?i)\A\s*(?:\||<table)")
    ends = F.col("md").rlike(r"(?i)(?:\||</table>)\s*\z")
    rows = pages.filter(F.col("md").isNotNull() & (starts | ends)).dropDuplicates(["doc", "page"]).select("doc", "page", "md", starts.alias("starts"), ends.alias("ends"))
    w = Window.partitionBy("doc").orderBy("page")
    edges = rows.select("doc", "page", "starts", "ends")
    linked = (F.lag("page").over(w) == F.col("page") - 1) & F.lag("ends").over(w) & F.col("starts")
    runs = edges.withColumn("run", F.sum(F.when(F.coalesce(linked, F.lit(False)), 0).otherwise(1)).over(w)).select("doc", "page", "run")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        _, joined = continue_tables(dict(zip(pdf["page"], pdf["md"])))
        return pd.DataFrame([(pdf["doc"].iloc[0], *j) for j in joined], columns=["doc", "first_page", "last_page", "header", "n_rows"])

    grouped = rows.select("doc", "page", "md").join(runs, ["doc", "page"]).groupBy("doc", "run")
    return grouped.applyInPandas(run, "doc string, first_page int, last_page int, header string, n_rows int")


# ── reading scores of tables ─────────────────────────────────────────────────────────────


def _figure(cell: str) -> str | None:
    s = re.sub(r"[\s,$€£₹]", "", cell)
    sign = -1 if re.match(r"^\(.*\)$|^-|.*-$", s) else 1
    s = s.strip("()-+")
    try:
        return f"{sign * float(s):.4f}" if re.fullmatch(r"\d*\.?\d+", s) else None
    except ValueError:
        return None


def cell_scores(read: list[list[list[str]]], truth: list[list[list[str]]]) -> tuple[int, int, int]:
    """(figures, in place, anywhere) of the true tables: each is held against the read table that shares most figures, rows by
    their titles and then by place."""
    total = exact = anywhere = 0
    bags = [Counter(f for r in t for c in r if (f := _figure(c))) for t in read]
    for t in truth:
        want = Counter(f for r in t for c in r if (f := _figure(c)))
        total += sum(want.values())
        if not read or not want:
            continue
        shared = [sum((want & b).values()) for b in bags]
        k = max(range(len(read)), key=lambda i: (shared[i], -abs(len(read[i]) - len(t)), -i))
        anywhere += shared[k]
        key = lambda r: tuple(c.strip().lower() for c in r if c.strip() and _figure(c) is None)
        free: dict[tuple, list[int]] = {}
        for i, r in enumerate(read[k]):
            free.setdefault(key(r), []).append(i)
        for i, r in enumerate(t):
            spot = free[key(r)].pop(0) if key(r) and free.get(key(r)) else i
            if spot < len(read[k]):
                exact += sum(1 for a, b in zip(r, read[k][spot]) if _figure(a) is not None and _figure(a) == _figure(b))
    return total, exact, anywhere
