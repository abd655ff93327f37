"""Term frequencies by a vertical index: per term, compressed bitmaps of record ids and occurrence counters.

Records get dense ids: every task owns blocks of 65,536 ids, so a (term, block) has one container. A container is big-endian
16-bit words: cardinality - 1, then either the sorted positions (at most 4,096 of them) or a bitmap of 8,192 bytes. The union of
the tasks' indexes is the set of their containers, whose blocks are disjoint, and a term's document frequency is the sum of its
containers' cardinalities, so only counters and cardinalities are shuffled when nobody asks for the bitmaps themselves.

Null texts are no records; empty texts are records without terms; rows that repeat a key are one record.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

BLOCK = 1 << 16
ARRAY_LIMIT = 4096
INDEX = "term string, block long, bitmap binary, occurrences long"
TERM = regex.compile(r"[ぁ-ヿ一-鿿]|[[\p{L}\p{M}\p{N}]--[ぁ-ヿ一-鿿]]+", regex.V1)


def terms_of(text: str) -> list[str]:
    return TERM.findall(text.lower())


def container(positions: np.ndarray) -> bytes:
    """The container of sorted distinct positions below 65,536."""
    head = np.array([len(positions) - 1], ">u2").tobytes()
    if len(positions) <= ARRAY_LIMIT:
        return head + positions.astype(">u2").tobytes()
    bits = np.zeros(BLOCK, np.uint8)
    bits[positions] = 1
    return head + np.packbits(bits).tobytes()


def positions_of(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:2], "big") + 1
    if n <= ARRAY_LIMIT:
        return np.frombuffer(data, ">u2", offset=2).astype(np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, offset=2)))


def union(a: bytes, b: bytes) -> bytes:
    """Union of two containers of the same block."""
    return container(np.union1d(positions_of(a), positions_of(b)))


class _Block:
    def __init__(self) -> None:
        self.ids: defaultdict[str, int] = defaultdict(count().__next__)
        self.term: list[int] = []
        self.times: list[int] = []
        self.widths: list[int] = []

    def add(self, text: str) -> None:
        found = Counter(terms_of(text))
        self.term.extend(map(self.ids.__getitem__, found))
        self.times.extend(found.values())
        self.widths.append(len(found))

    def batches(self, block: int):
        n = len(self.ids)
        if not n:
            return
        term = np.array(self.term, np.int32)
        order = np.argsort(term, kind="stable")
        sizes = np.bincount(term, minlength=n)
        times = np.bincount(term, weights=self.times, minlength=n).astype(np.int64)
        at = np.repeat(np.arange(len(self.widths)), self.widths)[order].astype(">u2")
        ends = np.cumsum(sizes)
        starts = ends - sizes
        small = sizes <= ARRAY_LIMIT
        words = np.empty(len(at) + n, ">u2")
        heads = starts + np.arange(n)
        body = np.ones(len(words), bool)
        body[heads] = False
        words[heads] = (sizes - 1).astype(">u2")
        words[body] = at
        offsets = np.append(heads, len(words)).astype(np.int64) * 2
        data = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(words.tobytes())]).cast(pa.binary())
        names = pa.array(list(self.ids), pa.string())
        if not small.all():
            big = np.flatnonzero(~small)
            packed = [container(at[starts[k] : ends[k]].astype(np.int64)) for k in big]
            keep = pa.array(small)
            yield self._batch(names.take(pa.array(big)), block, pa.array(packed, pa.binary()), times[big])
            names, data, times = names.filter(keep), data.filter(keep), times[small]
        yield self._batch(names, block, data, times)

    @staticmethod
    def _batch(names, block, data, times):
        return pa.RecordBatch.from_arrays([names, pa.array(np.full(len(names), block, np.int64)), data, pa.array(times)], ["term", "block", "bitmap", "occurrences"])


def _index(batches):
    from pyspark import TaskContext

    first, seen, made, block = TaskContext.get().partitionId() << 32, set(), 0, _Block()
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if key in seen:
                continue
            seen.add(key)
            block.add(text)
            if len(block.widths) == BLOCK:
                yield from block.batches(first + made)
                made, block = made + 1, _Block()
    yield from block.batches(first + made)


def term_index(records: DataFrame, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """(term, block, bitmap, occurrences): the vertical index of the records with non-null text. A null key is a key like others."""
    rows = records.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")).filter(F.col("text").isNotNull())
    return rows.repartition("key").mapInArrow(_index, INDEX)


def cardinality(bitmap) -> F.Column:
    return F.conv(F.hex(F.substring(bitmap, 1, 2)), 16, 10).cast("long") + 1


def term_statistics(index: DataFrame) -> DataFrame:
    """(term, occurrences, records): counters summed, document frequency from the cardinality of the union."""
    return index.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum(cardinality(F.col("bitmap"))).alias("records"))


def marked_terms(records: DataFrame, key: str = "chunk_id", text: str = "text", rare: int = 2, common: float = 0.2) -> DataFrame:
    """(term, occurrences, records, mark): mark is 'rare' (at most `rare` records), else 'common' (more than that share), else null."""
    n = records.filter(F.col(text).isNotNull()).agg(F.count_distinct(F.coalesce(F.col(key).cast("string"), F.lit("\0")))).first()[0]
    mark = F.when(F.col("records") <= rare, "rare").when(F.col("records") > F.lit(common) * F.lit(n), "common")
    return term_statistics(term_index(records, key, text)).withColumn("mark", mark)
