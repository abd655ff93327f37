"""Facts of page images, as grey matrices from 0 (black) to 255: ink, contrast, sharpness, skew, rules, speckle; regions of ink.

Images come decoded (a reader's business); everything here is numpy inside an Arrow UDF.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

FACTS = "ink double, contrast double, sharp double, skew double, text_lines int, h_rules int, v_rules int, background double, speckle double"
DARK = 128


def _runs(mask: np.ndarray) -> np.ndarray:
    """Lengths of the runs of True."""
    edges = np.flatnonzero(np.diff(np.r_[0, mask.astype(np.int8), 0]))
    return edges[1::2] - edges[::2]


def skew(dark: np.ndarray, limit: float = 8.0, step: float = 0.5) -> float:
    """The angle in degrees at which the rows' ink varies most; 0 for too little ink."""
    y, x = np.nonzero(dark)
    if len(y) < 50:
        return 0.0
    angles = np.arange(-limit, limit + step, step)
    angles = angles[np.argsort(np.abs(angles), kind="stable")]
    spread = [np.bincount(np.rint(y - x * np.tan(np.radians(a)) + dark.shape[1]).astype(int)).var() for a in angles]
    return float(angles[int(np.argmax(spread))])


def components(mask: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(top, left, bottom, right, pixels) of the 4-connected regions, by runs of rows joined where they touch."""
    parent: list[int] = []
    boxes: list[list[int]] = []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    above: list[tuple[int, int, int]] = []
    for y in range(mask.shape[0]):
        edges = np.flatnonzero(np.diff(np.r_[0, mask[y].astype(np.int8), 0]))
        row: list[tuple[int, int, int]] = []
        k = 0
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            me = len(parent)
            parent.append(me)
            boxes.append([y, a, y + 1, b, b - a])
            while k < len(above) and above[k][1] <= a:
                k += 1
            j = k
            while j < len(above) and above[j][0] < b:
                p, q = root(above[j][2]), root(me)
                if p != q:
                    parent[q] = p
                    u, v = boxes[p], boxes[q]
                    boxes[p] = [min(u[0], v[0]), min(u[1], v[1]), max(u[2], v[2]), max(u[3], v[3]), u[4] + v[4]]
                j += 1
            row.append((a, b, me))
        above = row
    return [tuple(boxes[i]) for i in range(len(parent)) if parent[i] == i]


def facts(grey: np.ndarray) -> tuple:
    """FACTS of one page; zeros for an empty image."""
    if grey.size == 0:
        return (0.0, 0.0, 0.0, 0.0, 0, 0, 0, 0.0, 0.0)
    g = grey.astype(float)
    dark = g < DARK
    ink = float(dark.mean())
    low, high = np.percentile(g, [2, 98])
    edge = float((np.abs(np.diff(g, axis=1)) > 96).mean()) if g.shape[1] > 1 else 0.0
    h = sum(int((_runs(row) >= 0.5 * g.shape[1]).any()) for row in dark)
    v = sum(int((_runs(col) >= 0.5 * g.shape[0]).any()) for col in dark.T)
    inked = dark.mean(axis=1)
    lines = int(len(_runs((inked > 0.01) & (inked < 0.5))))
    regions = components(dark)
    alone = sum(1 for r in regions if r[4] == 1)
    light = g[~dark]
    return (ink, float(high - low) / 255, edge / max(ink, 1e-9), skew(dark), lines, h, v, float(light.std()) if light.size else 0.0, alone / max(1, int(dark.sum())))


def image_facts(grey: Column) -> Column:
    """A struct of FACTS for each ARRAY<ARRAY<INT>>; null for null and for ragged matrices."""

    def run(batch: pd.Series) -> pd.DataFrame:
        names = [f.split()[0] for f in FACTS.split(", ")]
        rows = []
        for m in batch:
            rows_ = [] if m is None else [np.asarray(r) for r in m]
            rows.append(facts(np.stack(rows_)) if rows_ and len({len(r) for r in rows_}) == 1 else (None,) * len(names))
        return pd.DataFrame(rows, columns=names)

    return F.pandas_udf(run, FACTS)(grey)


#: Limits of a clean print. Fixed values.
CLEAN = {"dpi": 150, "contrast": 0.6, "sharp": 1.0, "skew": 2.0, "speckle": 0.003, "background": 20.0, "text_lines": 8, "h_rules": 2, "v_rules": 1, "ink_low": 0.004, "ink_high": 0.3}


def scan_reasons() -> Column:
    """Why a page image (columns of FACTS and dpi) is not a clean print; empty for one that a plain OCR can read."""
    c, t = F.col, CLEAN
    tests = (
        ("resolution", c("dpi").isNull() | (c("dpi") < t["dpi"])), ("contrast", c("contrast") < t["contrast"]), ("soft strokes", c("sharp") < t["sharp"]), ("skew", F.abs("skew") > t["skew"]), ("speckle", c("speckle") > t["speckle"]),
        ("texture", c("background") > t["background"]), ("few lines", c("text_lines") < t["text_lines"]), ("ruled", (c("h_rules") > t["h_rules"]) | (c("v_rules") > t["v_rules"])), ("ink", ~c("ink").between(t["ink_low"], t["ink_high"])),
    )
    return F.filter(F.array(*(F.when(bad, name) for name, bad in tests)), lambda x: x.isNotNull())
