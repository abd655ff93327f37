"""Chosen-path similarity join of q-gram sets.

Exact copies are one class first. Every class has a minwise signature; a tree's root holds all classes, and a node chooses
two coordinates at random (the same for all its members, so that similar members stay together) and sends each member to the
child of each coordinate's value; no two roots share a coordinate. What travels is a sketch, four bits of each coordinate. Nodes of at most LEAF members are compared exhaustively, and
so are larger ones in which a sample finds a DENSE share of similar pairs, as their pairs are a result of about that size.
Two children keep the branching process of a pair above the critical point, so its survival hardly falls with the depth; the
number of trees for the target recall is computed for the deepest level there can be, over the numbers of coordinates in which
a pair at the threshold may agree. The first level runs where the texts are, and so do further ones of nodes that a sample of
the classes shows to be too large for a task; the others run in the task that holds the node. A node that is too large all the
same goes back to Spark, is branched there, and is in the end compared block by block, so nothing is dropped.
Surviving pairs are verified on the exact sets.

Null and blank texts are left out; rows that repeat a key are one record; a text shorter than q has itself as its only gram.
Copies of a text are linked with each other and with all copies of a similar text; a class of more than EXPAND copies is linked
through its smallest key alone: its copies to that key, and other classes to that key.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from folio.session import materialize, release

#: Coordinates of a signature; a sketch has four bits of each, in words of 64.
COORDINATES, BITS = 128, 4
WORDS = COORDINATES * BITS // 64
LEAF = 40
#: Rows of one node that a task holds at most, and rows of a block where a node of the last level is larger than that.
NODE_ROWS, BLOCK_ROWS = 60_000, 5_000
DEPTH, SPARK_DEPTH = 14, 8
#: Classes in the sample that tells which nodes will be too large for a task, members of a node in it that say so at least, and
#: levels that such nodes are branched before anything is shuffled.
HOT_SAMPLE, HOT_LEAST, HOT_DEPTH = 20_000, 12, 24
#: Levels of the branching process that the number of trees is computed for: all there can be.
LEVELS = HOT_DEPTH + SPARK_DEPTH + DEPTH
CHILDREN = 2
#: Pairs looked at in a node larger than LEAF, and the share of them at the threshold from which on the node is compared whole.
SAMPLE, DENSE = 32, 0.2
#: Pairs a task holds before it hands them on.
HELD_PAIRS = 1_000_000
#: Deviations below the threshold at which a sample of grams rules a pair out; under one pair in a million at the threshold is.
FAR = 5
EXPAND = 100
ENTRY = "path long, id long, sketch binary"
FOUND = "a long, b long, path long, sketch binary"
_GOLD, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_ONE, _TWO, _LOW, _BYTES = np.uint64(1), np.uint64(2), np.uint64(0x1111111111111111), np.uint64(0x0101010101010101)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def survival(agreement: float, depth: int) -> float:
    """Probability that a pair that agrees in that share of the coordinates meets in a node of that depth of one tree."""
    q = 1.0
    for _ in range(depth):
        q = 1 - (1 - agreement * q) ** CHILDREN
    return q


def _binomial(p: float) -> np.ndarray:
    return np.array([math.comb(COORDINATES, k) * p**k * (1 - p) ** (COORDINATES - k) for k in range(COORDINATES + 1)])


def agreement(similarity: float) -> float:
    """Probability that sketches agree at a coordinate: the minima are one, or their four bits are the same by chance."""
    return similarity + (1 - similarity) / 2**BITS


def least_for(recall: float, threshold: float) -> int:
    """Coordinates in which sketches agree at least: by that filter a fiftieth of the pairs that may be lost is lost at the threshold."""
    lost = np.cumsum(_binomial(agreement(threshold)))
    return int(np.searchsorted(lost, (1 - recall) / 50, "right"))


def recall_of(trees: int, similarity: float, depth: int, least: int = 0) -> float:
    """Probability that a pair of that similarity meets in one of the trees, which all share the coordinates, and passes the filter."""
    missed = np.array([(1 - survival(k / COORDINATES, depth)) ** trees for k in range(COORDINATES + 1)])
    return float(1 - (_binomial(similarity) * missed).sum() - _binomial(agreement(similarity))[:least].sum())


def trees_for(recall: float, threshold: float, depth: int) -> int:
    """Trees for that recall at the threshold; each has coordinates of its own at the root."""
    for n in range(1, COORDINATES // CHILDREN + 1):
        if recall_of(n, threshold, depth, least_for(recall, threshold)) >= recall:
            return n
    raise ValueError(f"{COORDINATES} coordinates don't give a recall of {recall} at {threshold}")


def _grams(texts: list[str], q: int, bits: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all q-grams of all texts, and where each text's begin; a text shorter than q is filled up with zeros."""
    raw = [t.encode("utf-32-le", "surrogatepass") for t in texts]
    raw = [r if len(r) >= 4 * q else r.ljust(4 * q, b"\0") for r in raw]
    points = np.frombuffer(b"".join(raw), np.uint32).astype(np.uint64)
    lengths = np.array([len(r) // 4 for r in raw])
    h = np.zeros(len(points) - q + 1, np.uint64)
    for k in range(q):
        h = h * _GOLD + points[k : len(points) - q + 1 + k] + np.uint64(1)
    starts = np.cumsum(lengths) - lengths
    keep = np.ones(len(h), bool)
    for k in range(1, q):  # grams across a border
        cross = starts[1:] - k
        keep[cross] = False
    counts = lengths - q + 1
    mixed = mix64(h[keep])
    return mixed if bits == 64 else (mixed >> np.uint64(32)).astype(np.uint32), np.cumsum(counts) - counts


def signatures(texts: list[str], q: int) -> np.ndarray:
    """(texts, COORDINATES) minwise values."""
    rng = np.random.default_rng(20_241)
    a = rng.integers(0, 1 << 32, COORDINATES, dtype=np.uint32) | np.uint32(1)
    b = rng.integers(0, 1 << 32, COORDINATES, dtype=np.uint32)
    grams, starts = _grams(texts, q)
    out = np.empty((len(texts), COORDINATES), np.uint32)
    for k in range(COORDINATES):
        out[:, k] = np.minimum.reduceat(grams * a[k] + b[k], starts)
    return out


def _sketch(sig: np.ndarray) -> np.ndarray:
    """(texts, WORDS): BITS of each coordinate."""
    values = (mix64(sig.astype(np.uint64) + _GOLD) >> np.uint64(64 - BITS)).reshape(len(sig), WORDS, 64 // BITS)
    return np.bitwise_or.reduce(values << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS)), axis=2)


def _agreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each pair of sketches, the coordinates in which they agree."""
    x = a ^ b
    x |= x >> _ONE
    x |= x >> _TWO
    x &= _LOW
    differ = np.bitwise_count(x).view(np.uint64).reshape(x.shape[:-1])
    return COORDINATES - ((differ * _BYTES) >> np.uint64(56)).astype(np.int64)


def _branch(path: np.ndarray, row: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The children's paths and rows: each node's CHILDREN chosen coordinates, each member's value at them."""
    draw = mix64(path)
    first, step = draw % np.uint64(COORDINATES), _ONE + (draw >> np.uint64(32)) % np.uint64(COORDINATES - 1)
    paths = []
    for coord in (first, (first + step) % np.uint64(COORDINATES)):
        seed = mix64(path + (coord + _ONE) * _M2)
        bit = coord * np.uint64(BITS)
        value = (sketch[row, (bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(2**BITS - 1)
        paths.append(mix64(seed * _GOLD + value + _ONE))
    return np.concatenate(paths), np.tile(row, CHILDREN)


def _within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... inside each run of the given sizes."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)


def _compare(starts, sizes, rows, ids, sketch, least):
    """The pairs inside the runs of rows whose sketches agree in at least `least` coordinates, in parts."""
    left = np.repeat(starts, sizes) + _within(sizes)
    more = np.repeat(starts + sizes, sizes) - left - 1
    ends = np.cumsum(more)
    at = 0
    while at < len(left):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 200_000, "right")))
        m = more[at:upto]
        i = np.repeat(left[at:upto], m)
        j = i + 1 + _within(m)
        a, b = rows[i], rows[j]
        good = _agreeing(sketch[a], sketch[b]) >= least
        a, b = ids[a[good]], ids[b[good]]
        yield np.stack([np.minimum(a, b), np.maximum(a, b)], 1)[a != b]
        at = upto


def _dense(nodes, starts, sizes, row, sketch, threshold: float) -> np.ndarray:
    """Whether a share of DENSE of the pairs of each node are at the threshold, by a sample drawn from the node's path."""
    share = np.empty(len(nodes))
    for at in range(0, len(nodes), 5_000):
        n = sizes[at : at + 5_000, None].astype(np.uint64)
        u = mix64(nodes[at : at + 5_000, None] + np.arange(1, SAMPLE + 1, dtype=np.uint64) * _M1)
        i = u % n
        j = (i + np.uint64(1) + (u >> np.uint64(32)) % (n - np.uint64(1))) % n
        a, b = (sketch[row[starts[at : at + 5_000, None] + x.astype(np.int64)]] for x in (i, j))
        share[at : at + 5_000] = (_agreeing(a, b) >= math.floor(agreement(threshold) * COORDINATES)).mean(axis=1)
    return share >= DENSE


def _solve(path: np.ndarray, ids: np.ndarray, sketch: np.ndarray, threshold: float, least: int):
    """Pairs of ids that meet in a compared node below these nodes and whose sketches agree enough, in parts."""
    # Members stay in an order of their content, so that the sample of a node doesn't depend on the order of arrival.
    row = np.argsort(mix64((sketch * np.arange(1, 2 * WORDS, 2, dtype=np.uint64) * _M1).sum(axis=1)), kind="stable")
    path = path[row]
    for depth in range(DEPTH + 1):
        if not len(path):
            break
        order = np.argsort(path, kind="stable")
        path, row = path[order], row[order]
        starts = np.flatnonzero(np.r_[True, path[1:] != path[:-1]])
        sizes = np.diff(np.r_[starts, len(path)])
        whole = sizes <= LEAF if depth < DEPTH else np.ones(len(sizes), bool)
        more = np.flatnonzero(~whole)
        whole[more] = _dense(path[starts[more]], starts[more], sizes[more], row, sketch, threshold)
        leaf = whole & (sizes > 1)
        yield from _compare(starts[leaf], sizes[leaf], row, ids, sketch, least)
        rest = np.repeat(~whole, sizes)
        path, row = _branch(path[rest], row[rest], sketch)


def _distinct(parts):
    """The pairs in larger parts, each without repetitions."""
    held, n = [], 0
    for pairs in parts:
        held.append(pairs)
        n += len(pairs)
        if n >= HELD_PAIRS:
            yield np.unique(np.concatenate(held), axis=0)
            held, n = [], 0
    if n:
        yield np.unique(np.concatenate(held), axis=0)


def _roots(sig: np.ndarray, trees: int) -> np.ndarray:
    """(CHILDREN * trees, texts): the paths below the roots; each root has coordinates of its own."""
    coordinate = np.arange(CHILDREN * trees)
    seed = mix64((coordinate + 1).astype(np.uint64) * _GOLD) * _GOLD + _ONE
    return mix64(seed[:, None] + sig.T[coordinate])


def _entries(batches, q: int, trees: int, hot: np.ndarray):
    """The nodes of each text; a node that is known to be too large is branched here, as it would be anywhere."""
    for batch in batches:
        texts = batch.column(1).to_pylist()
        ids = batch.column(0).to_numpy()
        for at in range(0, len(texts), 512):
            sig = signatures(texts[at : at + 512], q)
            sketch = _sketch(sig)
            path, row = _roots(sig, trees).ravel(), np.tile(np.arange(len(sig)), CHILDREN * trees)
            while len(path):
                large = np.isin(path, hot)
                yield _batch(path[~large], ids[at : at + 512][row[~large]], sketch[row[~large]])
                path, row = _branch(path[large], row[large], sketch)


def _sampled(batches, q: int, trees: int):
    for batch in batches:
        texts = batch.column(1).to_pylist()
        for at in range(0, len(texts), 512):
            sig = signatures(texts[at : at + 512], q)
            both = np.concatenate([_roots(sig, trees).T, _sketch(sig)], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(sig)), pa.array([r.tobytes() for r in both], pa.binary())], ["id", "v"])


def hot_nodes(classes: DataFrame, n: int, q: int, trees: int) -> np.ndarray:
    """Paths of the nodes that hold more of n classes than a task should, by a sample of HOT_SAMPLE of them."""
    none = np.empty(0, np.uint64)
    if n <= NODE_ROWS:
        return none
    share = min(1.0, HOT_SAMPLE / n)
    drawn = classes.select("id", "text").filter(F.shiftrightunsigned(F.xxhash64("text"), 11) / float(1 << 53) < share)
    rows = drawn.mapInArrow(lambda it: _sampled(it, q, trees), "id long, v binary").limit(2 * HOT_SAMPLE).collect()
    if not rows:
        return none
    both = np.frombuffer(b"".join(bytes(r.v) for r in sorted(rows)), np.uint64).reshape(len(rows), -1)
    roots, sketch = both[:, : CHILDREN * trees], both[:, CHILDREN * trees :]
    least, hot = max(HOT_LEAST, NODE_ROWS / 2 * len(rows) / n), []
    path, row = roots.T.ravel(), np.tile(np.arange(len(rows)), CHILDREN * trees)
    for _ in range(HOT_DEPTH):
        names, place, sizes = np.unique(path, return_inverse=True, return_counts=True)
        large = sizes >= least
        if not large.any():
            break
        hot.append(names[large])
        path, row = _branch(path[large[place]], row[large[place]], sketch)
    return np.sort(np.concatenate(hot)) if hot else none


def _batch(path: np.ndarray, ids: np.ndarray, sketch: np.ndarray) -> pa.RecordBatch:
    data = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * WORDS), len(ids), [None, pa.py_buffer(np.ascontiguousarray(sketch).tobytes())]).cast(pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), pa.array(ids.astype(np.int64)), data], ["path", "id", "sketch"])


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sketch = batch.column(2)
    size = 8 * WORDS
    data = np.frombuffer(sketch.buffers()[2], np.uint8)[sketch.offset * size :][: len(sketch) * size] if len(sketch) else np.empty(0, np.uint8)
    return batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy(), np.frombuffer(data.tobytes(), np.uint64).reshape(-1, WORDS)


def _pairs_batch(pairs: np.ndarray) -> pa.RecordBatch:
    n = len(pairs)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], ["a", "b", "path", "sketch"])


def _leaves(batches, threshold: float, least: int):
    """Pairs of the nodes of a partition sorted by path; rows of nodes too large for a task come back with their path."""
    kept: list[tuple] = []
    held, large = 0, None

    def spill(p, i, s):
        b = _batch(p, i, s)
        nulls = pa.nulls(len(p), pa.int64())
        return pa.RecordBatch.from_arrays([b.column(1), nulls, b.column(0), b.column(2)], ["a", "b", "path", "sketch"])

    def ready(last: bool):
        """Solves the complete nodes held; keeps the open one."""
        nonlocal kept, held, large
        p, i, s = (np.concatenate(x) for x in zip(*kept))
        cut_at = len(p) if last else int(np.flatnonzero(np.r_[True, p[1:] != p[:-1]])[-1])
        if cut_at:
            starts = np.flatnonzero(np.r_[True, p[1:cut_at] != p[: cut_at - 1]])
            sizes = np.diff(np.r_[starts, cut_at])
            small = np.repeat(sizes <= NODE_ROWS, sizes)
            if not small.all():
                yield spill(p[:cut_at][~small], i[:cut_at][~small], s[:cut_at][~small])
            yield from map(_pairs_batch, _distinct(_solve(p[:cut_at][small], i[:cut_at][small], s[:cut_at][small], threshold, least)))
        p, i, s = p[cut_at:], i[cut_at:], s[cut_at:]
        if len(p) > NODE_ROWS:
            large = p[-1]
            yield spill(p, i, s)
            p, i, s = p[:0], i[:0], s[:0]
        kept, held = ([(p, i, s)], len(p)) if len(p) else ([], 0)

    for batch in batches:
        p, i, s = _arrays(batch)
        if large is not None:
            more = p == large
            if more.any():
                yield spill(p[more], i[more], s[more])
                p, i, s = p[~more], i[~more], s[~more]
            if len(p):
                large = None
        if not len(p):
            continue
        kept.append((p, i, s.copy()))
        held += len(p)
        if held >= 2 * NODE_ROWS:
            yield from ready(False)
    if kept:
        yield from ready(True)


def _whole(batches, least: int):
    """Pairs of the nodes of a partition sorted by path, each compared whole."""

    def solve():
        i, s = (np.concatenate(x) for x in zip(*parts))
        run = np.array([0]), np.array([len(i)])
        yield from map(_pairs_batch, _distinct(_compare(*run, np.arange(len(i)), i, s, least)))

    path, parts = None, []
    for batch in batches:
        p, i, s = _arrays(batch)
        starts = np.flatnonzero(np.r_[True, p[1:] != p[:-1]]) if len(p) else []
        for a, b in zip(starts, [*starts[1:], len(p)]):
            if parts and p[a] != path:
                yield from solve()
                parts = []
            path = p[a]
            parts.append((i[a:b], s[a:b].copy()))
    if parts:
        yield from solve()


def _deepen(batches):
    for batch in batches:
        p, i, s = _arrays(batch)
        path, row = _branch(p, np.arange(len(i)), s)
        yield _batch(path, i[row], s[row])


def _block_pairs(entries: DataFrame) -> DataFrame:
    """Every two blocks of an oversized node of the last level under a path of their own."""
    sizes = entries.groupBy("path").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("n"))
    rows = entries.join(sizes, "path").withColumn("k", F.pmod(F.xxhash64("id"), F.col("n")))
    other = F.explode(F.sequence(F.lit(0), F.col("n") - 1))
    rows = rows.withColumn("o", other)
    return rows.select(F.xxhash64("path", F.least("k", F.col("o").cast("long")), F.greatest("k", F.col("o").cast("long"))).alias("path"), "id", "sketch")


def candidate_pairs(classes: DataFrame, q: int, threshold: float, recall: float) -> tuple[DataFrame, list[DataFrame]]:
    """(a, b) ids of classes (id, text) that met in a leaf and may be similar enough, and the tables to release after use."""
    trees = trees_for(recall, threshold, LEVELS)
    least = least_for(recall, threshold)
    n = classes.count()
    hot = hot_nodes(classes, n, q, trees)
    entries = classes.select("id", "text").mapInArrow(lambda it: _entries(it, q, trees, hot), ENTRY)
    found, used, level = None, [], 1
    while True:
        last = level >= SPARK_DEPTH
        rows = (_block_pairs(entries) if last else entries).repartition("path").sortWithinPartitions("path")
        out = materialize(rows.mapInArrow(lambda it, last=last: _whole(it, least) if last else _leaves(it, threshold, least), FOUND), "leaves")
        used.append(out)
        pairs = out.filter("path IS NULL").select("a", "b")
        found = pairs if found is None else found.unionByName(pairs)
        open_ = out.filter("path IS NOT NULL").select("path", F.col("a").alias("id"), "sketch")
        if last or open_.isEmpty():
            return found.distinct(), used
        entries = open_.mapInArrow(_deepen, ENTRY)
        level += 1


def _sets(h: np.ndarray, text: np.ndarray, n: int) -> list[np.ndarray]:
    """Sorted distinct 52-bit hashes of each of n texts; the chance that two grams of a pair share one is below 1e-8."""
    both = np.sort(text << np.uint64(52) | (h >> np.uint64(12)))
    both = both[np.r_[True, both[1:] != both[:-1]]] if len(both) else both
    edges = np.searchsorted(both, np.arange(1, n, dtype=np.uint64) << np.uint64(52))
    return [x & np.uint64((1 << 52) - 1) for x in np.split(both, edges)]


def _common(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each pair of sets, the members of both and of either."""
    sizes = np.array([len(sets[a]) + len(sets[b]) for a, b in zip(left, right)], np.int64)
    tag = np.repeat(np.arange(len(sizes), dtype=np.uint64) << np.uint64(52), sizes)
    merged = np.sort(tag | np.concatenate([sets[z] for pair in zip(left, right) for z in pair]))
    twice = merged[1:][merged[1:] == merged[:-1]]
    common = np.bincount((twice >> np.uint64(52)).astype(np.int64), minlength=len(sizes))
    return common, sizes - common


def _verify(batches, q: int, threshold: float):
    """The pairs at the threshold. An eighth of the grams, the same for all texts, first tells which pairs are FAR deviations below."""
    for batch in batches:
        for at in range(0, len(batch), 256):
            part = batch.slice(at, 256)
            x, y = part.column(2).to_pylist(), part.column(3).to_pylist()
            place = {t: k for k, t in enumerate(dict.fromkeys(x + y))}
            left, right = np.array([place[t] for t in x]), np.array([place[t] for t in y])
            h, starts = _grams(list(place), q, bits=64)
            text = np.repeat(np.arange(len(place), dtype=np.uint64), np.diff(np.r_[starts, len(h)]))
            few = h >> np.uint64(61) == 0
            common, either = _common(_sets(h[few], text[few], len(place)), left, right)
            open_ = np.flatnonzero(common >= threshold * either - FAR * np.sqrt(threshold * (1 - threshold) * either))
            good = np.zeros(len(part), bool)
            if len(open_):
                used = np.zeros(len(place), bool)
                used[left[open_]] = used[right[open_]] = True
                mine = used[text.astype(np.int64)]
                common, either = _common(_sets(h[mine], text[mine], len(place)), left[open_], right[open_])
                good[open_] = common >= threshold * either - 1e-9
            yield part.select(["a", "b"]).filter(pa.array(good))


GAPS = re.compile(r"[\t\r\n][ \t\r\n]*| [ \t\r\n]+")


def normalized(text: str) -> str:
    """Runs of space, tab, CR and LF as one space, ends trimmed of spaces, lower case."""
    return GAPS.sub(" ", text).strip(" ").lower()


def _hashed(batches, clean):
    for batch in batches:
        texts = [None if t is None else clean(t) for t in batch.column(1).to_pylist()]
        marks = [None if not t else hashlib.md5(t.encode("utf-8", "surrogatepass")).hexdigest() for t in texts]
        out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks, pa.string()), pa.array(texts, pa.string())], ["key", "h", "text"])
        yield out.filter(pa.array([m is not None for m in marks]))


class SimilarSets:
    """Classes of equal texts and the similar pairs of classes of a table of (key, text); clean() gives the text that is compared."""

    def __init__(self, records: DataFrame, q: int, clean=str.lower, threshold: float = 0.7, recall: float = 0.99) -> None:
        rows = records.filter(F.col("key").isNotNull() & F.col("text").isNotNull()).select(F.col("key").cast("string").alias("key"), "text")
        rows = rows.mapInArrow(lambda it: _hashed(it, clean), "key string, h string, text string")
        grouped = rows.groupBy("h").agg(F.min("key").alias("rep"), F.max("key").alias("other"), F.first("text").alias("text"))
        self.classes = materialize(grouped.withColumn("id", F.monotonically_increasing_id()), "classes")
        members = rows.select("key", "h").distinct()
        #: Only classes of several keys need their members; of the others rep is the member.
        several = self.classes.filter("rep <> other").select("id", "h", "rep")
        sized = members.join(several, "h").withColumn("n", F.count("*").over(_by("id")))
        self.copies = materialize(sized.select("id", "key", "rep", "n"), "copies")
        near, used = candidate_pairs(self.classes, q, threshold, recall)
        # Either end may come first, so that no text meets all its partners by one side of the join.
        turn = F.pmod(F.xxhash64("a", "b"), F.lit(2)) == 0
        near = near.select(F.when(turn, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(turn, F.col("a")).otherwise(F.col("b")).alias("b"))
        texts = self.classes.select("id", "text")
        both = near.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
        self.links = materialize(both.mapInArrow(lambda it: _verify(it, q, threshold), "a long, b long"), "links")
        for table in used:
            release(table)

    def pairs(self) -> DataFrame:
        """(key_a, key_b) of similar records, the smaller key first; EXPAND says how large classes are written."""
        small = self.copies.filter(F.col("n") <= EXPAND)
        inside = small.alias("x").join(small.alias("y"), F.expr("x.id = y.id AND x.key < y.key")).select(F.col("x.key").alias("key_a"), F.col("y.key").alias("key_b"))
        star = self.copies.filter((F.col("n") > EXPAND) & (F.col("key") != F.col("rep"))).select(F.col("rep").alias("key_a"), F.col("key").alias("key_b"))
        keys = self.classes.select("id", F.explode(F.array("rep")).alias("key")).unionByName(small.filter(F.col("key") != F.col("rep")).select("id", "key"))
        across = self.links.join(keys.select(F.col("id").alias("a"), F.col("key").alias("x")), "a").join(keys.select(F.col("id").alias("b"), F.col("key").alias("y")), "b")
        across = across.select(F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b"))
        return inside.unionByName(star).unionByName(across)

    def groups(self) -> DataFrame:
        """(key, class_id, links): the connected group of each record that is similar to another, named by its smallest key.

        links counts the similar texts other than the record's own.
        """
        edges = self.links.join(self.classes.select(F.col("id").alias("a"), F.col("rep").alias("x")), "a").join(self.classes.select(F.col("id").alias("b"), F.col("rep").alias("y")), "b").select("x", "y")
        labels = components(edges)
        degree = edges.select("x").unionByName(edges.select(F.col("y").alias("x"))).groupBy(F.col("x").alias("rep")).agg(F.count("*").alias("links"))
        all_copies = self.copies.select("key", "rep")
        single = self.classes.filter("rep = other").select(F.col("rep").alias("key"), "rep").join(degree, "rep", "left_semi").select("key", "rep")
        rows = all_copies.unionByName(single)
        joined = rows.join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left").join(degree, "rep", "left")
        return joined.select("key", F.coalesce("label", "rep").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))


def _by(key: str):
    from pyspark.sql import Window

    return Window.partitionBy(key)


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of the connected component of each node of the edges (x, y).

    Every round gives each node the smallest label around it and then follows labels once, so a chain shrinks by half.
    """
    sym = materialize(edges.select("x", "y").unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y"))).filter("x <> y").distinct(), "edges")
    labels = materialize(sym.groupBy(F.col("x").alias("node")).agg(F.min(F.least("x", "y")).alias("label")), "labels")
    while True:
        near = sym.join(labels.select(F.col("node").alias("y"), "label"), "y").groupBy(F.col("x").alias("node")).agg(F.min("label").alias("near"))
        hooked = labels.join(near, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("was"))
        jump = hooked.select(F.col("node").alias("label"), F.col("label").alias("next"))
        after = materialize(hooked.join(jump, "label", "left").select("node", F.least("label", F.coalesce("next", "label")).alias("label"), "was"), "labels")
        release(labels)
        if after.filter("label <> was").isEmpty():
            release(sym)
            return after.select("node", "label")
        labels = after


def chunk_texts(chunks: DataFrame) -> DataFrame:
    return chunks.select(F.col("chunk_id").alias("key"), "text")


def source_paths(meta: DataFrame) -> DataFrame:
    return meta.select(F.col("doc").alias("key"), F.col("src_path").alias("text")).distinct()
