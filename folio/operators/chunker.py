"""Packing of Markdown into nodes: blocks stay whole, chunks never cross a page, a chunk carries the heading in effect.

Sizes are estimated tokens. A page is a list of pieces (offset, cost, text): its blocks, which end at blank lines outside fences and
HTML tables, or the parts of an oversized block: rows of a table under its header, else sentences, else words. With the running
sums of the costs, every chunk's end and the begin of its overlap with the next are found by bisection: a chunk takes as many pieces
as fit, the next one begins with whole pieces of at most the overlap (never over half the size), as far as they leave room for a
piece that is new. Null and blank texts give no nodes.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame

from folio.operators.markdown_tables import is_separator

# Headings, page marks, and where sentences of an oversized block end.
HEADING = re.compile(r"^#{1,6}[ \t]+(\S.*?)[ \t]*$", re.M)
PAGE = re.compile(r"<!--\s*page\s+(\S+)\s*-->")
SENTENCE = re.compile(r"(?<=[.!?])\s+(?=[A-Z0-9\"'(\[])")

GAP = re.compile(r"\n(?:[ \t\r\f\v]*\n)+")
WHOLE = re.compile(r"^[ \t]*```.*?(?:^[ \t]*```[^\n]*$|\Z)|<table\b.*?(?:</table\s*>|\Z)", re.M | re.S | re.I)
ROW = re.compile(r"<tr\b.*?</tr\s*>", re.S | re.I)
HEAD = re.compile(r"<thead\b.*?</thead\s*>", re.S | re.I)


class Piece(NamedTuple):
    at: int
    cost: int
    text: str


def est(text: str) -> int:
    n = len(text.split())
    return max(int(n * 1.3) + 1, len(text) // 4) if n else 0


def blocks(text: str) -> Iterator[tuple[int, str]]:
    """(offset, block): what stands between runs of blank lines that no fence and no HTML table holds."""
    held = [m.span() for m in WHOLE.finditer(text)]
    starts = [a for a, _ in held]
    cuts = [(0, 0)]
    for m in GAP.finditer(text):
        k = bisect_right(starts, m.start()) - 1
        if k < 0 or held[k][1] <= m.start():
            cuts.append(m.span())
    cuts.append((len(text), len(text)))
    for (_, a), (b, _) in zip(cuts, cuts[1:]):
        block = text[a:b].strip("\n")
        if block.strip():
            yield a + text[a:b].index(block), block


def packs(costs: list[int], size: int, overlap: int = 0) -> Iterator[tuple[int, int]]:
    """Ranges of pieces that fit the size together, one piece at least, each beginning inside the overlap with the one before."""
    total = [0, *accumulate(costs)]
    a = 0
    while a < len(costs):
        b = max(a + 1, bisect_right(total, total[a] + size) - 1)
        yield a, b
        if b == len(costs):
            return
        a = min(b, max(a + 1, bisect_left(total, total[b] - overlap), bisect_left(total, total[b + 1] - size)))


def _by_words(at: int, text: str, size: int) -> Iterator[Piece]:
    found = list(re.finditer(r"\S+", text))
    step = max(1, int((size - 1) / 1.3))
    for k in range(0, len(found), step):
        part = text[found[k].start() : found[min(k + step, len(found)) - 1].end()]
        yield Piece(at + found[k].start(), est(part), part)


def _units(at: int, block: str, size: int) -> tuple[str, str, str, list[Piece]]:
    """(head, foot, glue, units) of an oversized block: a table's header and rows, or sentences."""
    lines = block.split("\n")
    low = block.lstrip()[:6].lower()
    if low.startswith("|") and len(lines) > 2:
        k = 2 if is_separator(lines[1]) else 0
        starts = [0, *accumulate(len(line) + 1 for line in lines)]
        return "\n".join(lines[:k]), "", "\n", [Piece(at + starts[i], est(line), line) for i, line in enumerate(lines) if i >= k]
    rows = list(ROW.finditer(block)) if low == "<table" else []
    if len(rows) > 1:
        head = HEAD.search(block)
        top = head.group() if head else rows[0].group()
        body = [m for m in rows if m.start() >= (head.end() if head else rows[0].end())]
        opening = re.match(r"\s*(<table\b[^>]*>)", block, re.I)[1]
        return f"{opening}\n{top}", "</table>", "\n", [Piece(at + m.start(), est(m.group()), m.group()) for m in body]
    edges = [0, *(m.end() for m in SENTENCE.finditer(block)), len(block)]
    return "", "", " ", [Piece(at + a, est(block[a:b]), block[a:b].strip()) for a, b in zip(edges, edges[1:]) if block[a:b].strip()]


def pieces(at: int, block: str, size: int) -> Iterator[Piece]:
    """The block, or parts of it under the size; a unit that alone is too large is cut between words, without its tags."""
    cost = est(block)
    if cost <= size:
        yield Piece(at, cost, block)
        return
    head, foot, glue, units = _units(at, block, size)
    room = max(1, size - est(f"{head}\n{foot}"))
    small: list[Piece] = []
    for unit in [*units, None]:
        if unit is not None and unit.cost <= room:
            small.append(unit)
            continue
        for a, b in packs([u.cost for u in small], room):
            text = "\n".join(x for x in (head, glue.join(u.text for u in small[a:b]), foot) if x)
            yield Piece(small[a].at, est(text), text)
        small = []
        if unit is not None:
            yield from _by_words(unit.at, re.sub(r"<[^<>]*>", lambda m: " " * len(m[0]), unit.text) if foot else unit.text, size)


def chunks(text: str, size: int, overlap: int, at: int = 0) -> list[tuple[int, str]]:
    """(offset, chunk) of a page that begins at the offset."""
    size = max(1, size)
    parts = [p for a, block in blocks(text) for p in pieces(at + a, block, size)]
    return [(parts[a].at, "\n\n".join(p.text for p in parts[a:b])) for a, b in packs([p.cost for p in parts], size, max(0, min(overlap, size // 2)))]


def markdown_nodes(text: str, size: int, overlap: int) -> list[tuple[str, str, str]]:
    """(page, heading, text) of each node; the heading is the last one at or before the node's begin, else the first inside it."""
    heads = list(HEADING.finditer(text))
    places = [m.start() for m in heads]
    marks = list(PAGE.finditer(text))
    pages = zip(["1", *(m[1] for m in marks)], [0, *(m.end() for m in marks)], [*(m.start() for m in marks), len(text)])
    out = []
    for page, a, b in pages:
        for at, chunk in chunks(text[a:b], size, overlap, a):
            k = bisect_right(places, at) - 1
            inside = HEADING.search(chunk) if k < 0 else None
            out.append((page, heads[k][1] if k >= 0 else inside[1] if inside else "", chunk))
    return out


def nodes(rows: DataFrame, key: str, text: str, size: int = 512, overlap: int = 64) -> DataFrame:
    """(key, node_no, page, heading, text) of each document."""

    def run(batches):
        for pdf in batches:
            out = [(k, i, *n) for k, t in zip(pdf[key], pdf[text]) if t for i, n in enumerate(markdown_nodes(t, size, overlap))]
            yield pd.DataFrame(out, columns=[key, "node_no", "page", "heading", "text"])

    return rows.select(key, text).mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, node_no int, page string, heading string, text string")
