"""Splitting of oversized texts by a recursive hierarchy of separators.

A text over its limit is cut into sections, those over it into paragraphs, then sentences, words and at last characters; the
atoms so found are packed greedily up to the limit, and each piece begins with a tail of the piece before, cut at a word, of at
most the overlap. Pieces are spans of the text and together cover it. Size is session.est_tokens.

Null, empty and blank texts have no size and are never split. A limit under 2, which no word satisfies, cuts single characters.
A null limit is no limit; a null or negative overlap is 0.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from folio.session import est_tokens

PIECES = "chunk_id string, doc string, piece_no int, start_pos int, end_pos int, size int, shared int, text string"
WORD = re.compile(r"[^ \t\r\n]+")
#: Where a part may end, coarsest first; the separator stays with the part before it.
LEVELS = (
    re.compile(r"\n(?=#{1,6} |={2,}[^=\n]|\\(?:sub)*section\b|<h[1-6]\b)", re.I),
    re.compile(r"\r?\n[ \t]*\r?\n\s*"),
    re.compile(r"[.!?…][\"'”’»)\]]*\s+|[。！？।](?:[」』”’）])*\s*|\r?\n(?=[-*•] |\d+\. )"),
    re.compile(r"[ \t\r\n]+"),
)


class _Sizer:
    def __init__(self, text: str) -> None:
        spans = [m.span() for m in WORD.finditer(text)]
        self.starts, self.ends = [a for a, _ in spans], [b for _, b in spans]

    def __call__(self, a: int, b: int) -> int:
        n = bisect_left(self.starts, b) - bisect_right(self.ends, a)
        return max(int(n * 1.3) + 1, (b - a) // 4) if n > 0 else 0


def _atoms(text: str, a: int, b: int, limit: int, size: _Sizer, level: int, out: list[int]) -> None:
    """Appends the ends of the atoms of text[a:b]."""
    if size(a, b) <= limit:
        out.append(b)
        return
    if level == len(LEVELS):
        step = max(1, 4 * limit + 3) if limit >= 2 else 1
        out.extend([*range(a + step, b, step), b])
        return
    at = a
    for m in LEVELS[level].finditer(text, a, b):
        if at < m.end() < b:
            _atoms(text, at, m.end(), limit, size, level + 1, out)
            at = m.end()
    _atoms(text, at, b, limit, size, level + 1, out)


def pieces_of(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Spans of the pieces, each of size at most limit; consecutive spans share at most overlap."""
    size = _Sizer(text)
    ends: list[int] = []
    _atoms(text, 0, len(text), limit, size, 0, ends)
    spans, start, upto, k = [], 0, 0, 0
    while k < len(ends):
        if upto == start or size(start, ends[k]) <= limit:
            upto = ends[k]
            k += 1
            continue
        spans.append((start, upto))
        lo, hi = bisect_right(size.starts, start), bisect_left(size.starts, upto)
        while lo < hi:  # the first word from which the tail is small enough and leaves room for the next atom
            mid = (lo + hi) // 2
            s = size.starts[mid]
            if size(s, upto) <= overlap and size(s, ends[k]) <= limit:
                hi = mid
            else:
                lo = mid + 1
        s = size.starts[lo] if lo < len(size.starts) else upto
        start = s if s < upto and overlap > 0 else upto
        if start == upto:
            upto = ends[k]
            k += 1
    spans.append((start, upto))
    return spans


def _split(batches):
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            before = 0
            size = _Sizer(r["text"])
            for no, (a, b) in enumerate(pieces_of(r["text"], r["chunk_size"], max(0, r["chunk_overlap"] or 0))):
                rows.append((r["chunk_id"], r["doc"], no, a, b, size(a, b), size(a, before) if a < before else 0, r["text"][a:b]))
                before = b
        names = ["chunk_id", "doc", "piece_no", "start_pos", "end_pos", "size", "shared", "text"]
        types = [pa.string(), pa.string(), *[pa.int32()] * 5, pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)


def current_limits(meta: DataFrame) -> DataFrame:
    """(doc, chunk_size, chunk_overlap, src_path) of each doc's newest finished build."""
    pick = F.max_by(F.struct("chunk_size", "chunk_overlap", "src_path"), F.struct("built_at", "chunk_size", "chunk_overlap"))
    return meta.filter(F.col("built_at").isNotNull()).groupBy("doc").agg(pick.alias("m")).select("doc", "m.*")


def oversized(chunks: DataFrame, meta: DataFrame) -> DataFrame:
    """(chunk_id, doc, text, chunk_size, chunk_overlap) of each chunk over its doc's limit; repeated chunk_ids once.

    Texts under every limit never leave the scan; the smallest limit is one number.
    """
    limits = current_limits(meta).filter(F.col("chunk_size").isNotNull())
    least = limits.agg(F.min("chunk_size")).first()[0]
    rows = chunks.select("chunk_id", "doc", "text").withColumn("size", est_tokens(F.col("text"))).filter(F.col("size") > F.lit(least if least is not None else 2**31 - 1))
    over = rows.join(limits, "doc").filter(F.col("size") > F.col("chunk_size"))
    return over.dropDuplicates(["chunk_id"]).select("chunk_id", "doc", "text", "chunk_size", "chunk_overlap")


def split_oversized(chunks: DataFrame, meta: DataFrame) -> DataFrame:
    """PIECES: the pieces of every oversized chunk; shared is the size of what a piece repeats of the piece before."""
    return oversized(chunks, meta).mapInArrow(_split, PIECES)


def split_report(chunks: DataFrame, meta: DataFrame) -> DataFrame:
    """(src_path, n_chunks, n_pieces, largest_piece, most_shared) of each file with oversized chunks."""
    paths = current_limits(meta).select("doc", "src_path")
    return (
        split_oversized(chunks, meta).groupBy("doc").agg(F.count_distinct("chunk_id").alias("n_chunks"), F.count("*").alias("n_pieces"), F.max("size").cast("long").alias("largest_piece"), F.max("shared").cast("long").alias("most_shared"))
        .join(paths, "doc").select("src_path", "n_chunks", "n_pieces", "largest_piece", "most_shared")
    )
