"""The most similar vectors of every vector, by NN-descent.

Vectors are kept as 64 signed 16-bit numbers, each scaled to its largest component, and compared at unit length. The graph starts
from cells: each vector goes to the cells of its CELLS nearest pivots, pivots being a bounded sample, and is compared inside them;
a cell that will be too large for a task is cut by hyperplanes through its pivot before it is shuffled, and one larger than LEAF
is halved at random hyperplanes in its task. Cells whose vectors are often the same go to one task, to which a vector travels once
and which sends one list for it. Then rounds of NN-descent run as Spark joins: every node gathers the vectors of its
neighbours and of the vectors it is a neighbour of, and introduces them to each other. Nodes of one neighbourhood are gathered
together, so that a vector travels once to a neighbourhood and not once to each node; it brings its list, from which the task reads
who is a member of which node. A round ends with the K best of what each vector had and was offered. Rounds stop when under DELTA of all entries are offered a change.

Usable vectors have DIM finite numbers, not all zero; a key counts once; all others are ignored. Only vectors of one model meet.
All vectors that have a node as neighbour are introduced there; a node with more than HUB of them is split into blocks, and every
two blocks meet in a task. Ties go to the larger id.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame, Window, functions as F

from folio.session import bounded_sample, materialize, parallelism, release

DIM, K, CELLS, HUB = 64, 5, 3, 1_000
ROUNDS, DELTA = 12, 0.001
#: Vectors per cell on average, pivots at most, the sample that the pivots are drawn from and their cells are measured by, rows of
#: a cell in one task at most, and vectors compared exhaustively at most.
CELL_ROWS, PIVOTS, DRAWN, CELL_MOST, LEAF = 1_000, 2_048, 16_384, 50_000, 4_500
#: Words of the bitmap that tells which nodes have a new edge, one megabyte.
MARKS = 1 << 17
#: Nodes of one neighbourhood that are gathered together, about.
AROUND = 24_000
#: Groups of cells that there are at least if the session has so many tasks, vectors of a group above that, about, and lists of a task
#: that are merged before they leave it, about.
GROUPS, GROUP_ROWS, HELD = 64, 200_000, 200_000
#: Rows at which the whole neighbourhoods among them are solved.
GATHERED = 20_000
SCALE = 32_767
#: A node, its neighbourhood, and its neighbours with theirs.
NODES = "id long, block long, neighbours array<struct<score:double,id:long,block:long>>"
_PLANES = np.random.default_rng(3).standard_normal((DIM, 24)).astype(np.float32)


def usable(vectors: DataFrame, key: str = "chunk_id") -> DataFrame:
    v = F.col("embedding")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.filter(F.col(key).isNotNull() & F.col("model").isNotNull() & (F.size(v) == DIM) & finite & F.exists(v, lambda x: x != 0))
    return rows.select(F.col(key).cast("string").alias("key"), "model", v.cast("array<float>").alias("embedding"))


def _quantize(batches):
    for batch in batches:
        if not len(batch):
            continue
        x = batch.column(2).flatten().to_numpy().astype(np.float64).reshape(-1, DIM)
        x /= np.abs(x).max(axis=1, keepdims=True)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _packed(np.rint(x * SCALE).astype("<i2"))], ["key", "model", "v"])


def _packed(data: np.ndarray) -> pa.Array:
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * DIM), len(data), [None, pa.py_buffer(np.ascontiguousarray(data).tobytes())]).cast(pa.binary())


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i2").reshape(-1, DIM)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


class Pivots:
    """Of one model: unit vectors, their ids, how many hyperplanes cut the cell of each, and the group and the neighbourhood it belongs to.

    Groups and neighbourhoods are numbered from first_group and first_block; without `groups` each pivot is one of its own.
    """

    def __init__(self, drawn: list, n: int, groups: int | None = None, first_group: int = 0, first_block: int = 0) -> None:
        x = _unit(np.frombuffer(b"".join(bytes(r.v) for r in drawn), "<i2").reshape(-1, DIM)).astype(np.float32)
        want = int(min(PIVOTS, max(1, n // CELL_ROWS)))
        self.x = x[:want]
        #: Where a search may enter.
        self.entries, self.ids = x[:PIVOTS], np.array([r.id for r in drawn[:PIVOTS]])
        near = self.nearest(x)[0]
        share = np.bincount(near.ravel(), minlength=len(self.x)) / len(x)
        #: By pivot, where more than AROUND vectors are nearest to it: drawn ones among them as centres of neighbourhoods, and the first
        #: neighbourhood and the number of them of each centre; more than one by chance where one centre has far too many.
        self.centres: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        parts = np.ceil(np.bincount(near[:, 0], minlength=len(self.x)) / len(x) * n / AROUND).astype(np.int64)
        for k in np.flatnonzero(parts > 1):
            mine = x[near[:, 0] == k]
            own = np.bincount(np.argmax(mine @ mine[: parts[k]].T, axis=1), minlength=min(parts[k], len(mine)))
            many = np.maximum(1, np.ceil(own / len(x) * n / (2 * AROUND))).astype(np.int64)
            self.centres[int(k)] = (mine[: parts[k]], np.cumsum(many) - many, many)
        self.bits = np.clip(np.ceil(np.log2(np.maximum(share * n, 1) / CELL_MOST)), 0, _PLANES.shape[1]).astype(np.int64)
        groups = len(self.x) if groups is None else groups
        links = np.zeros((len(self.x), len(self.x)), np.float32)
        for a, b in ((a, b) for a in range(near.shape[1]) for b in range(near.shape[1]) if a != b):
            np.add.at(links, (near[:, a], near[:, b]), 1)
        #: By pivot, -1 where its cell alone has the rows of a group; the parts of such a cell go their own ways.
        self.group = np.full(len(self.x), -1, np.int64)
        small = np.flatnonzero(share * groups <= near.shape[1])
        self.group[small] = first_group + _grouped(links[np.ix_(small, small)], share[small], groups)
        self.groups = groups
        #: By pivot, its (first) neighbourhood.
        self.block = np.zeros(len(self.x), np.int64)
        whole = np.flatnonzero(parts <= 1)
        own = np.bincount(near[:, 0], minlength=len(self.x))[whole] / len(x)
        wanted = int(max(groups, np.ceil(own.sum() * n / AROUND)))
        self.block[whole] = first_block + _grouped(links[np.ix_(whole, whole)], own, wanted)
        self.blocks = int(min(wanted, len(whole)))
        for k, (_, _, many) in self.centres.items():
            self.block[k] = first_block + self.blocks
            self.blocks += int(many.sum())

    def nearest(self, x: np.ndarray, most: int = CELLS, among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The nearest pivots (or others) of each vector, the very nearest first, and their scores."""
        among = self.x if among is None else among
        n = min(most, len(among))
        s = x @ among.T
        near = np.argpartition(s, len(among) - n, axis=1)[:, len(among) - n :]
        score = np.take_along_axis(s, near, axis=1)
        order = np.argsort(-score, axis=1, kind="stable")
        return np.take_along_axis(near, order, axis=1), np.take_along_axis(score, order, axis=1)

    def around(self, x: np.ndarray, first: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Which of its pivot's neighbourhoods the vector lies in: that of the nearest centre, so that similar vectors mostly share one."""
        out = np.zeros(len(x), np.int64)
        order = np.argsort(first, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(first[order])) + 1):
            if len(rows) and (c := self.centres.get(int(first[rows[0]]))):
                near = np.argmax(x[rows] @ c[0].T, axis=1)
                out[rows] = c[1][near] + _chance(ids[rows]) % c[2][near]
        return out

    def parts(self, x: np.ndarray, near: np.ndarray) -> np.ndarray:
        """The part of the cell, by the sides of the hyperplanes on which the vector lies seen from the pivot."""
        out = np.zeros(near.shape, np.int64)
        for k in range(near.shape[1]):
            cut = np.flatnonzero(self.bits[near[:, k]])
            if len(cut):
                side = ((x[cut] - self.x[near[cut, k]]) @ _PLANES > 0).astype(np.int64) << np.arange(_PLANES.shape[1])
                out[cut, k] = side.sum(axis=1) & ((1 << self.bits[near[cut, k]]) - 1)
        return out


def _chance(x: np.ndarray) -> np.ndarray:
    return ((x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64)


def _grouped(links: np.ndarray, weight: np.ndarray, groups: int) -> np.ndarray:
    """The group of each of some things, from 0: groups of about the same weight, each grown along the strongest links for its weight."""
    if groups >= len(weight):
        return np.arange(len(weight))
    out = np.full(len(weight), -1, np.int64)
    free = np.ones(len(weight), bool)
    scale = weight + 1 / (1 + len(weight)) ** 2
    for g in range(groups):
        target, got, pull = weight[free].sum() / (groups - g), 0.0, links[:, ~free].sum(axis=1)
        while free.any():
            k = int(np.argmax(np.where(free, pull / scale, -1)))
            if (out == g).any() and got + weight[k] / 2 > target and g < groups - 1:
                break
            pull = pull + links[k] if (out == g).any() else links[k].copy()
            out[k], free[k], got = g, False, got + weight[k]
    return out


def _cell_ids(model: str, near: np.ndarray, parts: np.ndarray) -> np.ndarray:
    import zlib

    return (np.int64(zlib.crc32(model.encode())) << 36) ^ (near.astype(np.int64) << 24) ^ parts


def _assign(batches, pivots: dict[str, Pivots], cells: bool):
    """Of (key, model, v, id): (id, v, block), block being the vector's neighbourhood; with cells one row (group, id, block, cells, v) for each
    group that cells of its belong to."""
    for batch in batches:
        if not len(batch):
            continue
        models = np.array(batch.column(1).to_pylist(), object)
        x, ids = _unit(_matrix(batch.column(2))).astype(np.float32), batch.column(3).to_numpy()
        block = np.empty(len(ids), np.int64)
        out = []
        for m in np.unique(models):
            p, mine = pivots[m], np.flatnonzero(models == m)
            for at in range(0, len(mine), 4096):
                rows = mine[at : at + 4096]
                near, _ = p.nearest(x[rows], CELLS if cells else 1)
                first = near[:, 0]
                block[rows] = p.block[first] + p.around(x[rows], first, ids[rows])
                if cells:
                    cell = _cell_ids(m, near, p.parts(x[rows], near))
                    out.append((rows, cell, np.where(p.group[near] < 0, _chance(cell), p.group[near])))
        if not cells:
            yield pa.RecordBatch.from_arrays([batch.column(3), batch.column(2), pa.array(block)], ["id", "v", "block"])
        for rows, cell, group in out:
            order = np.argsort(group, axis=1, kind="stable")
            cell, group = np.take_along_axis(cell, order, axis=1), np.take_along_axis(group, order, axis=1)
            starts = np.flatnonzero(np.diff(group, axis=1, prepend=-1))
            which = rows[starts // group.shape[1]]
            mine = pa.ListArray.from_arrays(pa.array(np.r_[starts, cell.size].astype(np.int32)), pa.array(cell.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(group.ravel()[starts]), pa.array(ids[which]), pa.array(block[which]), mine, batch.column(2).take(pa.array(which))], ["group", "id", "block", "cells", "v"])


def _halves(x: np.ndarray, rng) -> list[np.ndarray]:
    """Index sets of at most LEAF vectors: halved at the median along the difference of two of them."""
    done, todo = [], [np.arange(len(x))]
    while todo:
        rows = todo.pop()
        if len(rows) <= LEAF:
            done.append(rows)
            continue
        a, b = rng.choice(rows, 2, replace=False)
        side = np.argsort(x[rows] @ (x[a] - x[b]), kind="stable")
        todo += [rows[side[: len(rows) // 2]], rows[side[len(rows) // 2 :]]]
    return done


def _best(ids: np.ndarray, block: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, ...]:
    """Entries (id, block, score, other, its block): the K nearest of each vector among these; x are unit vectors."""
    n = len(ids)
    k = min(K, n - 1)
    f = x.astype(np.float32)
    lists = np.empty((n, k), np.int64)
    for at in range(0, n, 1024):
        s = f[at : at + 1024] @ f.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -np.inf
        lists[at : at + 1024] = np.argpartition(s, n - k, axis=1)[:, n - k :] if k < n - 1 else np.argsort(s, axis=1)[:, 1:]
    one, flat = np.repeat(np.arange(n), k), lists.ravel()
    return ids[one], block[one], _score(x[one], x[flat]), ids[flat], block[flat]


def _score(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines to nine digits, so that a pair has the same in every task."""
    return np.round(np.einsum("ij,ij->i", a, b), 9)


def _lists(ids, block, sizes, score, other, other_block) -> pa.RecordBatch:
    entries = pa.StructArray.from_arrays([pa.array(score), pa.array(other), pa.array(other_block)], ["score", "id", "block"])
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(block), pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), entries)], ["id", "block", "neighbours"])


def _strongest(ids, block, score, other, other_block) -> pa.RecordBatch:
    """A list for each id: the K best of its entries, which may repeat."""
    by = np.lexsort((-other, -score, ids))
    a, b = ids[by], other[by]
    fresh = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
    by, a = by[fresh], a[fresh]
    first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
    sizes = np.diff(np.r_[first, len(a)])
    best = by[np.arange(len(a)) - np.repeat(first, sizes) < K]
    return _lists(a[first], block[by[first]], np.minimum(sizes, K), score[best], other[best], other_block[best])


def _cells(batches):
    """Neighbour lists inside the cells of a partition sorted by cell; those of a vector are merged, about HELD lists at a time."""
    name, parts = None, []
    held: list[tuple[np.ndarray, ...]] = []

    def solve():
        ids, block, x = (np.concatenate(p) for p in zip(*parts))
        x = _unit(x)
        for rows in _halves(x.astype(np.float32), np.random.default_rng(7)) if len(ids) > LEAF else [np.arange(len(ids))]:
            if len(rows) > 1:
                held.append(_best(ids[rows], block[rows], x[rows]))
        if sum(len(h[0]) for h in held) >= K * HELD:
            yield from merged()

    def merged():
        if held:
            yield _strongest(*(np.concatenate(h) for h in zip(*held)))
            held.clear()

    for batch in batches:
        if not len(batch):
            continue
        names, ids, block, x = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy(), _matrix(batch.column(3))
        starts = np.flatnonzero(np.r_[True, names[1:] != names[:-1]])
        for a, b in zip(starts, np.r_[starts[1:], len(names)]):
            if names[a] != name:
                if parts:
                    yield from solve()
                name, parts = names[a], []
            parts.append((ids[a:b], block[a:b], x[a:b]))
    if parts:
        yield from solve()
    yield from merged()


def _introduce(batches):
    """(id, neighbours) offered by the nodes of a partition sorted by block: what each member's list lacks and takes.

    Rows are the vectors of a block (block, null, id, home, opens, least, known, v), one for each id, and for the nodes that are
    split into blocks edges (block, node, id), which may repeat. Where a vector opens, it is a node there: its members are the
    vectors that it knows and those that know it. Of what a task's part of the nodes offers to an id the K best leave it.
    """
    held: list[pa.RecordBatch] = []

    def solve(table: pa.RecordBatch):
        edge = table.column(1).is_valid()
        vectors, edges = table.filter(pa.compute.invert(edge)), table.filter(edge)
        # A member's vector is the one of its id in its block.
        place = np.lexsort((vectors.column(2).to_numpy(), vectors.column(0).to_numpy()))
        own_block, own, home = (vectors.column(i).to_numpy()[place] for i in (0, 2, 3))
        opens, least = vectors.column(4).to_numpy(zero_copy_only=False)[place], vectors.column(5).to_numpy()[place]
        known = vectors.column(6).flatten().to_numpy().reshape(len(own), K)[place]
        x = _unit(_matrix(vectors.column(7)))[place]
        blocks, ids = np.unique(own_block), np.unique(own)
        span = len(ids) + 1
        at_own = np.searchsorted(blocks, own_block) * span + np.searchsorted(ids, own)

        def places(block, member):
            """Places of (block, member), and which of them are here."""
            code = np.searchsorted(ids, member)
            here = np.flatnonzero(ids[np.minimum(code, len(ids) - 1)] == member)
            want = np.searchsorted(blocks, block[here]) * span + code[here]
            found = np.minimum(np.searchsorted(at_own, want), len(own) - 1)
            good = at_own[found] == want
            return found[good], here[good]

        if not len(own):
            return
        other, which = places(np.repeat(own_block, K), known.ravel())
        which //= K
        e_node, member = np.concatenate([which[opens[which]], other[opens[other]]]), np.concatenate([other[opens[which]], which[opens[other]]])
        if len(edges):
            found, which = places(edges.column(0).to_numpy(), edges.column(2).to_numpy())
            _, split = np.unique(np.stack([edges.column(0).to_numpy()[which], edges.column(1).to_numpy()[which]]), axis=1, return_inverse=True)
            e_node, member = np.concatenate([e_node, len(own) + split]), np.concatenate([member, found])
        if not len(member):
            return
        e_node, member = np.divmod(np.unique(e_node * len(own) + member), len(own))
        starts = np.flatnonzero(np.r_[True, e_node[1:] != e_node[:-1]])
        sizes = np.diff(np.r_[starts, len(member)])
        more = np.repeat(sizes, sizes) - (np.arange(len(member)) - np.repeat(starts, sizes)) - 1
        ends = np.cumsum(more)
        a_all, b_all, s_all, at = [], [], [], 0  # places in own
        while at < len(member):
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 200_000, "right")))
            m = more[at:upto]
            i = np.repeat(np.arange(at, upto), m)
            e = np.cumsum(m)
            j = i + 1 + np.arange(len(i)) - np.repeat(e - m, m)
            i, j = member[i], member[j]
            s = _score(x[i], x[j])
            for p, q in ((i, j), (j, i)):
                good = ((s > least[p]) | (s == least[p]) & (own[q] > known[p, K - 1])) & (own[p] != own[q])
                p, q, t = p[good], q[good], s[good]
                new = ~(known[p] == own[q][:, None]).any(axis=1)
                a_all.append(p[new])
                b_all.append(q[new])
                s_all.append(t[new])
            at = upto
        a, b, s = np.concatenate(a_all), np.concatenate(b_all), np.concatenate(s_all)
        if not len(a):
            return
        yield _strongest(own[a], home[a], s, own[b], home[b])

    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        if sum(map(len, held)) >= GATHERED:
            table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            block = table.column(0).to_numpy()
            border = int(np.flatnonzero(np.r_[True, block[1:] != block[:-1]])[-1])
            if border:
                yield from solve(table.slice(0, border))
                held = [table.slice(border)]
    if held:
        yield from solve(pa.Table.from_batches(held).combine_chunks().to_batches()[0])


def _merged(lists: DataFrame) -> DataFrame:
    """(id, neighbours): the K best of all lists of each id; a task sends at most a list for each part of its rows."""
    ranked = F.sort_array(F.array_distinct(F.flatten(F.collect_list("neighbours"))), asc=False)
    return lists.groupBy("id").agg(F.first("block").alias("block"), F.slice(ranked, 1, K).alias("neighbours"))


def _marks(rows: DataFrame, name: str) -> Callable[[str], Column]:
    """Whether a value of a column may be among those of rows: never false for one that is. Values mark places of a bitmap of MARKS words, whose
    size is fixed; where values are as many as its bits, nearly all pass, which here means more work and nothing else."""

    def place(c: str) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(64 * MARKS))

    words = rows.select(place(name).alias("p")).groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(p & 63))")).alias("bits"))
    found = words.toPandas()
    dense = np.zeros(MARKS, np.int64)
    dense[found.word.to_numpy(np.int64)] = found.bits.to_numpy(np.int64)
    one = pa.table({"bits": pa.ListArray.from_arrays(pa.array([0, MARKS], pa.int32()), pa.array(dense))})
    bits = rows.sparkSession.createDataFrame(one).scalar()

    def marked(asked: str) -> Column:
        word = F.element_at(bits, (F.shiftright(place(asked), 6) + 1).cast("int"))
        return F.getbit(word, place(asked).bitwiseAND(63).cast("int")) == 1

    return marked


def _marked(rows: DataFrame, name: str) -> Column:
    return _marks(rows, name)(name)


def _renewed(graph: DataFrame, offers: DataFrame) -> DataFrame:
    """The graph after a round; lists that are offered nothing stay where they are."""
    offered = _marked(offers.select("id"), "id")
    return _merged(graph.filter(offered).unionByName(offers)).unionByName(graph.filter(~offered))


class NeighbourGraph:
    """The neighbour graph of a table of vectors (key, model, embedding)."""

    def __init__(self, vectors: DataFrame, key: str = "chunk_id", rounds: int = ROUNDS, delta: float = DELTA) -> None:
        spark = vectors.sparkSession
        quantized = usable(vectors, key).mapInArrow(_quantize, "key string, model string, v binary")
        every = materialize(quantized.withColumn("id", F.monotonically_increasing_id()), "vectors")
        # Copies of a key are found by key and id, without moving the vectors.
        repeated = materialize(every.groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1"), "repeated")
        copies = materialize(every.select("key", "id").join(repeated, "key").filter("id > first").select("id"), "copies")
        self.nodes = every.join(copies, "id", "left_anti").select("key", "model", "v", "id")
        self.counts = counts = dict(self.nodes.groupBy("model").count().collect())
        self.pivots = pivots = {}
        total, tasks = sum(counts.values()), parallelism(spark)
        wanted = min(tasks, max(GROUPS, -(-total // GROUP_ROWS)))
        group = block = 0
        for model, n in counts.items():
            drawn = bounded_sample(self.nodes.filter(F.col("model") == model).select("key", "v", "id"), ["key"], DRAWN, n)
            pivots[model] = p = Pivots(drawn, n, max(1, round(wanted * n / total)), group, block)
            group, block = group + p.groups, block + p.blocks
        self.vectors = self.nodes.mapInArrow(lambda it: _assign(it, pivots, False), "id long, v binary, block long")
        grouped = self.nodes.mapInArrow(lambda it: _assign(it, pivots, True), "group long, id long, block long, cells array<long>, v binary")
        # Groups are numbered and of about one size, so that they are dealt out and not hashed.
        cells = grouped.repartitionById(tasks, F.pmod("group", F.lit(tasks)).cast("int")).select("group", F.explode("cells").alias("cell"), "id", "block", "v")
        lists = cells.sortWithinPartitions("group", "cell", "id").select("cell", "id", "block", "v").mapInArrow(_cells, NODES)
        self.graph = materialize(_merged(lists), "graph")
        self.changed: list[int] = []
        offers = None
        for _ in range(rounds):
            before, offers = offers, materialize(self._offers(offers), "offers")
            if before is not None:
                release(before)
            self.changed.append(offers.select(F.size("neighbours").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
            if self.changed[-1] == 0:
                break
            old, self.graph = self.graph, materialize(_renewed(self.graph, offers), "graph")
            release(old)
            if self.changed[-1] < delta * K * total:
                break
        if offers is not None:
            release(offers)

    def _offers(self, last: DataFrame | None) -> DataFrame:
        """One round: neighbours of neighbours that belong into a list. After the first, only nodes at the end of a new edge introduce."""
        edges = self.graph.select("id", "block", F.explode("neighbours").alias("n")).select("id", "block", F.col("n.id").alias("other"), F.col("n.block").alias("there"))
        hubs = materialize(edges.groupBy(F.col("other").alias("node")).agg(F.count("*").alias("n")).filter(F.col("n") > HUB), "hubs")
        none = F.array_repeat(F.lit(-1).cast("long"), K)
        filled = F.slice(F.concat(F.col("neighbours.id"), none), 1, K)
        least = F.when(F.size("neighbours") >= K, F.element_at("neighbours", -1).score).otherwise(F.lit(float("-inf")))
        lists = self.graph.select("id", least.alias("least"), filled.alias("known"), F.col("neighbours.block").alias("near"))
        # Each vector goes to the blocks of the nodes that it is a member of, and to its own as a node.
        if last is None:
            opens = F.lit(True)
            sent = edges.filter("block != there").select(F.col("other").alias("id"), "block")
        else:
            changed = _marks(last.select(F.explode(F.concat(F.array("id"), F.col("neighbours.id"))).alias("node")), "node")
            opens = changed("id")
            introducing = self.graph.filter(opens)
            sent = introducing.select("id", "block").unionByName(introducing.select(F.explode("neighbours").alias("n"), "block").select("n.id", "block"))
            sent = sent.unionByName(edges.filter(changed("other")).select("id", F.col("there").alias("block")))
        split = None
        if not hubs.isEmpty():
            # At most one row for HUB edges is broadcast.
            parts = F.broadcast(hubs.withColumn("n", F.ceil(F.col("n") / HUB)))
            split = edges.select(F.explode(F.array(F.struct(F.col("id").alias("node"), F.col("other").alias("id")), F.struct(F.col("other").alias("node"), "id"))).alias("e")).select("e.*").join(parts, "node")
            split = split if last is None else split.filter(changed("node"))
            mine = F.pmod(F.xxhash64("id"), F.col("n"))
            pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda o: F.xxhash64("node", F.least(mine, o), F.greatest(mine, o)))
            split = split.select(F.explode(pairs).alias("block"), "node", "id")
            sent = sent.unionByName(split.select("id", "block"))
        own = self.vectors.select("id", "v", F.col("block").alias("home"))
        if last is not None:
            own = own.filter(_marked(sent, "id"))
        own = own.join(lists, "id", "left").join(sent.groupBy("id").agg(F.collect_set("block").alias("sent")), "id", "left" if last is None else "inner")
        nowhere = F.array().cast("array<long>")
        targets = F.coalesce("sent", nowhere) if last is not None else F.concat(F.array("home"), F.coalesce("near", nowhere), F.coalesce("sent", nowhere))
        if split is not None:
            own = own.join(parts.select(F.col("node").alias("id"), F.lit(False).alias("whole")), "id", "left")
            opens = opens & F.coalesce("whole", F.lit(True))
        own = own.withColumn("opens", opens).withColumn("block", F.explode(F.array_distinct(targets)))
        known = F.coalesce("known", none).alias("known")
        rows = own.select("block", F.lit(None).cast("long").alias("node"), "id", "home", (F.col("opens") & (F.col("block") == F.col("home"))).alias("opens"), F.coalesce("least", F.lit(float("-inf"))).alias("least"), known, "v")
        rows = rows if split is None else rows.unionByName(split, allowMissingColumns=True)
        tasks = parallelism(rows.sparkSession)
        # All vectors in the first round: neighbourhoods, which are numbered, are dealt out and not hashed.
        met = rows.repartition("block") if last is not None else rows.repartitionById(tasks, F.pmod("block", F.lit(tasks)).cast("int"))
        return met.sortWithinPartitions("block").mapInArrow(_introduce, NODES)

    def nearest(self, k: int = 5) -> DataFrame:
        """(id, other, rank, cosine): the k nearest of each vector."""
        top = self.graph.select("id", F.posexplode(F.slice("neighbours", 1, k)).alias("rank", "n"))
        return top.select("id", F.col("n.id").alias("other"), (F.col("rank") + 1).alias("rank"), F.col("n.score").alias("cosine"))

    def pairs(self, k: int = 5) -> DataFrame:
        """(key_a, key_b): pairs in which at least one is among the k nearest of the other."""
        # Rows meet by a already where they are made distinct, so that they need not move again for the key of a.
        top = self.nearest(k).select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).repartition("a").distinct()
        keys = self.nodes.select("id", "key")
        named = top.join(keys.select(F.col("id").alias("a"), F.col("key").alias("x")), "a").join(keys.select(F.col("id").alias("b"), F.col("key").alias("y")), "b")
        return named.select(F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b"))

    def search(self, queries: DataFrame, k: int = 5, beam: int = 16, hops: int = 4) -> DataFrame:
        """(query, key, rank, cosine): greedy graph search of query vectors (query, model, embedding).

        A query enters at its `beam` nearest of a sample of PIVOTS vectors and moves, `hops` times, to the best `beam` of what it knows and of their
        neighbours. Queries that are not usable, or of a model without vectors, find nothing.
        """
        asked = usable(queries, "query").dropDuplicates(["key"]).mapInArrow(_quantize, "key string, model string, v binary").withColumnRenamed("key", "query").withColumnRenamed("v", "qv")
        asked = materialize(asked, "asked")
        pivots = self.pivots

        def enter(batches):
            for batch in batches:
                models, x = np.array(batch.column(1).to_pylist(), object), _matrix(batch.column(2))
                for m in np.unique(models):
                    mine = np.flatnonzero(models == m)
                    if m not in pivots:
                        continue
                    for at in range(0, len(mine), 4096):
                        rows = mine[at : at + 4096]
                        near, score = pivots[m].nearest(_unit(x[rows]).astype(np.float32), beam, pivots[m].entries)
                        which = pa.array(np.repeat(rows, near.shape[1]))
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(which), pa.array(pivots[m].ids[near.ravel()]), pa.array(score.ravel().astype(np.float64))], ["query", "id", "score"])

        front = materialize(asked.mapInArrow(enter, "query string, id long, score double"), "front")
        for _ in range(hops):
            around = front.join(self.graph, "id").select("query", F.explode("neighbours.id").alias("id")).distinct()
            new = self._scored(around.join(front.select("query", "id"), ["query", "id"], "left_anti"), asked)
            before, front = front, materialize(_first(front.unionByName(new), beam), "front")
            release(before)
        named = front.join(self.nodes.select("id", "key"), "id")
        best = named.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc(F.round("score", 6)), "key"))).filter(F.col("rank") <= k)
        return best.select("query", "key", "rank", F.round("score", 6).alias("cosine"))

    def _scored(self, front: DataFrame, asked: DataFrame) -> DataFrame:
        def score(batches):
            for batch in batches:
                if len(batch):
                    s = _score(_unit(_matrix(batch.column(2))), _unit(_matrix(batch.column(3))))
                    yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(s)], ["query", "id", "score"])

        rows = front.join(self.vectors, "id").join(asked.select("query", "qv"), "query").select("query", "id", "v", "qv")
        return rows.mapInArrow(score, "query string, id long, score double")


def _first(front: DataFrame, beam: int) -> DataFrame:
    w = Window.partitionBy("query").orderBy(F.desc("score"), F.desc("id"))
    return front.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= beam).drop("r")
