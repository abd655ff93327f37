"""A page's text layer against its conversion: normalised tokens, lines that were lost, loops, edit distances of sequences."""

from __future__ import annotations

import re
import unicodedata
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from folio.functions.text import plain

# Characters that a filled page takes at most, the share of a line's tokens that covers it, and the loop test's
# window, tail, letters in the tail, least text and repetitions.
FILL_CHARS, COVERED = 20_000, 0.6
WINDOW, TAIL, TAIL_LETTERS, LEAST_TEXT, TIMES = 6_000, 100, 40, 600, 15
MARK = "<!-- lines of the text layer that the conversion lacks -->"
_TOKEN = re.compile(r"(?P<figure>\d[\d,]*(?:\.\d+)?)|[^\W\d_]{2,}")
_NOISE = re.compile("(?<=\\w)[-\u00ad\u2010\u2011][ \t]*\r?\n[ \t]*(?=\\w)|[\u00ad\\\\]")


def tokens(text: str | None) -> list[str]:
    """Words of two letters or more, and figures without separators behind '#', after compatibility normalisation; cut words are joined."""
    whole = _NOISE.sub("", unicodedata.normalize("NFKC", text or "")).lower()
    return [f"#{m['figure'].replace(',', '')}" if m["figure"] else m[0] for m in _TOKEN.finditer(whole)]


def coded(lines: list[str], output: str | None) -> tuple[list[np.ndarray], np.ndarray]:
    """The tokens of each line as numbers with their counts, and how often the output has each number."""
    of_lines = [tokens(line) for line in lines]
    number = {t: k for k, t in enumerate(dict.fromkeys(t for line in of_lines for t in line))}
    have = np.bincount([number[t] for t in tokens(output) if t in number], minlength=len(number))
    return [np.stack(np.unique([number[t] for t in line], return_counts=True)) if line else np.empty((2, 0), int) for line in of_lines], have


def missing_lines(layer: str | None, output: str | None) -> list[str]:
    """Lines of the layer, in order, of whose tokens the output has too few left; lines that are covered use their tokens up."""
    lines = (layer or "").splitlines()
    wanted, left = coded(lines, output)
    lost = []
    for line, (which, times) in zip(lines, wanted):
        found = np.minimum(times, left[which])
        if found.sum() >= COVERED * times.sum():
            left[which] -= found
        elif len(which):
            lost.append(line.strip())
    return lost


def filled(md: str, lines: list[str]) -> str:
    """The Markdown with missing lines below a mark, as many whole lines as fit."""
    fits = sum(n <= FILL_CHARS for n in accumulate(len(line) + 1 for line in lines))
    return "\n\n".join((md.rstrip(), MARK, "\n".join(lines[:fits]))) + "\n" if fits else md


def looping(text: Column) -> Column:
    """Whether the end of the text, if it is mostly letters, stands many times in what comes before; false for null."""
    flat = F.trim(F.regexp_replace(F.regexp_replace(F.right(text, F.lit(4 * WINDOW)), "<[^<>]*>", " "), r"\s+", " "))
    tail, window = F.right(flat, F.lit(TAIL)), F.right(flat, F.lit(WINDOW))
    times = (F.length(window) - F.length(F.replace(window, tail, F.lit("")))) / F.length(tail)
    letters = F.regexp_count(tail, F.lit(r"\p{L}"))
    return F.coalesce((F.length(flat) >= LEAST_TEXT) & (letters >= TAIL_LETTERS) & (times >= TIMES), F.lit(False))


def sequence_distance(a: list, b: list) -> int:
    """Edit distance of any two sequences, a row of the table at a time."""
    _, codes = np.unique(np.array([*map(str, a), *map(str, b)], object), return_inverse=True) if a or b else (None, np.empty(0, int))
    x, y = codes[: len(a)], codes[len(a) :]
    steps = np.arange(len(y) + 1)
    row = steps.copy()
    for i, c in enumerate(x, 1):
        up = np.r_[i, np.minimum(row[1:] + 1, row[:-1] + (y != c))]
        # What comes from the left costs one a step: a running minimum along the row.
        row = np.minimum.accumulate(up - steps) + steps
    return int(row[-1])


def lost_lines(layer: DataFrame, output: DataFrame) -> DataFrame:
    """(doc, page, n_missing, first, md): lines of (doc, page, text) whose words the plain text of (doc, page, md) lacks, and the Markdown
    with them."""

    def run(batches):
        for pdf in batches:
            lines = [missing_lines(t, m) for t, m in zip(pdf["text"], pdf["plain"])]
            yield pd.DataFrame({"doc": pdf["doc"], "page": pdf["page"], "n_missing": [len(x) for x in lines], "first": [x[0] if x else None for x in lines], "md": [filled(m, x) for m, x in zip(pdf["md"], lines)]})

    ordered = F.array_sort(F.collect_list(F.struct("ord", "text")))
    whole = layer.groupBy("doc", "page").agg(F.array_join(F.transform(ordered, lambda x: x.text), "\n").alias("text"))
    rows = whole.join(output.select("doc", "page", "md", plain(F.col("md")).alias("plain")), ["doc", "page"])
    return rows.mapInPandas(run, "doc string, page string, n_missing int, first string, md string")
