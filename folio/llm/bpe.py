"""Byte-level BPE by speculation and verification.

A word's tokens are proposed by greedy longest match; the proposal is the exact encoding if and only if every adjacent pair of
tokens is compatible, that is, if no merge across their border would ever have happened. All distinct pairs of a batch are
tested at once with numpy; only words with an incompatible pair are merged exactly. Words are remembered per task, so a word
costs this once.

Null and empty texts have no tokens. Strings that look like special tokens are ordinary text.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

#: Folder with the vocabulary files, and the file used where none is named.
TOKENIZERS = os.environ.get("FOLIO_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.json"
#: The pre-tokenizer of this vocabulary, and for ASCII texts the same in the faster engine. Fixed values.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.A)
#: Characters that the two engines do not both count as white space.
ODD_SPACE = re.compile("[\x1c-\x1f]")
REMEMBER = 1_000_000


def _byte_alphabet() -> list[str]:
    """The printable stand-in of each byte: itself where printable, else the next code point from 256 on."""
    kept = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in kept else chr(next(spare)) for b in range(256)]


class Encoder:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.alphabet = _byte_alphabet()
        self.table = dict(enumerate(self.alphabet))
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.n = max(self.vocab.values()) + 1
        #: The longest token that begins with two characters.
        self.reach: dict[str, int] = {}
        for token in self.vocab:
            if len(token) > self.reach.get(token[:2], 1):
                self.reach[token[:2]] = len(token)
        rank = np.full(self.n, -1, np.int64)
        left, right = np.arange(self.n), np.arange(self.n)
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        keys, ranks = np.empty(len(merges), np.int64), np.arange(len(merges))
        for k, (a, b) in enumerate(merges):
            i, j, t = self.vocab[a], self.vocab[b], self.vocab[a + b]
            self.merge[i, j] = (k, t)
            keys[k] = i * self.n + j
            if rank[t] < 0:
                rank[t], left[t], right[t] = k, i, j
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], ranks[order]
        self.rank, self.left, self.right = rank, left, right
        self.pairs: dict[int, bool] = {}
        self.words: dict[str, tuple[int, ...]] = {}

    def greedy(self, word: str) -> list[int]:
        """Longest tokens from left to right; word in the byte alphabet."""
        out, at, n, vocab, reach = [], 0, len(word), self.vocab, self.reach
        while at < n:
            end = at + reach.get(word[at : at + 2], 1)
            if end > n:
                end = n
            while (t := vocab.get(word[at:end])) is None:
                end -= 1
            out.append(t)
            at = end
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each pair of tokens stays as it is when their bytes are encoded together.

        The border is followed back in time. The side built by the later merge is taken apart (the right one where both are the
        same merge, as merges run from the left); what then meets at the border must not have a merge of its own that comes
        before the merge taken back.
        """
        good = np.ones(len(a), bool)
        at, limit = np.arange(len(a)), np.full(len(a), np.iinfo(np.int64).max)
        while len(at):
            key = a * self.n + b
            pos = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            bad = (self.keys[pos] == key) & (self.ranks[pos] < limit)
            good[at[bad]] = False
            ra, rb = self.rank[a], self.rank[b]
            go = ~bad & (np.maximum(ra, rb) >= 0)
            undo_left = ra > rb
            limit = np.where(undo_left, ra, rb + 1)
            a, b = np.where(undo_left, self.right[a], a), np.where(undo_left, b, self.left[b])
            at, a, b, limit = at[go], a[go], b[go], limit[go]
        return good

    def exact(self, word: str) -> list[int]:
        """The merges in order of rank, leftmost first."""
        merge, never = self.merge, (1 << 60, 0)
        parts = [self.vocab[c] for c in word]
        open_ = [merge.get(p, never) for p in zip(parts, parts[1:])]
        while open_:
            best = min(open_)
            if best is never:
                break
            k = open_.index(best)
            parts[k : k + 2] = [best[1]]
            del open_[k]
            if k < len(open_):
                open_[k] = merge.get((parts[k], parts[k + 1]), never)
            if k:
                open_[k - 1] = merge.get((parts[k - 1], parts[k]), never)
        return parts

    def learn(self, words) -> None:
        """Encode words that are not known yet."""
        if len(self.words) > REMEMBER:
            self.words.clear()
            self.pairs.clear()
        proposed = {}
        for w in words:
            raw = w.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.table)
            proposed[w] = (raw, [self.vocab[raw]] if raw in self.vocab else self.greedy(raw))
        fresh = {x * self.n + y for _, ids in proposed.values() for x, y in zip(ids, ids[1:])} - self.pairs.keys()
        if fresh:
            keys = np.fromiter(fresh, np.int64, len(fresh))
            self.pairs.update(zip(keys.tolist(), self.compatible(keys // self.n, keys % self.n).tolist()))
        for w, (raw, ids) in proposed.items():
            if not all(self.pairs[x * self.n + y] for x, y in zip(ids, ids[1:])):
                ids = self.exact_long(raw)
            self.words[w] = tuple(ids)

    def exact_long(self, raw: str) -> list[int]:
        """exact() for words of any length: a heap instead of repeated scans beyond a few bytes."""
        if len(raw) <= 48:
            return self.exact(raw)
        import heapq

        ids = [self.vocab[c] for c in raw]
        n = len(ids)
        prev, nxt = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(self.merge[p][0], k, p) for k, p in enumerate(zip(ids, ids[1:])) if p in self.merge]
        heapq.heapify(heap)
        while heap:
            _, k, p = heapq.heappop(heap)
            j = nxt[k] if ids[k] >= 0 else n
            if j >= n or (ids[k], ids[j]) != p:
                continue
            ids[k], ids[j] = self.merge[p][1], -1
            nxt[k] = nxt[j]
            if nxt[j] < n:
                prev[nxt[j]] = k
                if (q := (ids[k], ids[nxt[k]])) in self.merge:
                    heapq.heappush(heap, (self.merge[q][0], k, q))
            if prev[k] >= 0 and (q := (ids[prev[k]], ids[k])) in self.merge:
                heapq.heappush(heap, (self.merge[q][0], prev[k], q))
        return [t for t in ids if t >= 0]

    def split(self, text: str) -> list[str]:
        return (ASCII if text.isascii() and not ODD_SPACE.search(text) else PATTERN).findall(text)

    def encode_batch(self, texts: list[str | None]) -> tuple[array, np.ndarray]:
        """All ids one after another, and the offsets of the texts in them."""
        flat, ends, known = array("i"), [0], self.words
        for start in range(0, len(texts), 256):
            split = [self.split(t) if t else () for t in texts[start : start + 256]]
            new = set().union(*split).difference(known)
            if new:
                self.learn(new)
                if len(self.words) <= len(new):
                    self.learn(set().union(*split).difference(known))
            for words in split:
                flat.extend(chain.from_iterable(map(known.__getitem__, words)))
                ends.append(len(flat))
        return flat, np.array(ends, np.int64)

    def encode(self, text: str | None) -> list[int]:
        return self.encode_batch([text])[0].tolist()


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _where(folder: str | None, vocabulary: str) -> str:
    return os.path.join(folder or TOKENIZERS, vocabulary)


def token_ids(docs: DataFrame, key: str = "doc_id", text: str = "text", folder: str | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, ids): the token ids of each row's text; an empty list for null and empty texts."""
    path = _where(folder, vocabulary)

    def run(batches):
        enc = encoder(path)
        for batch in batches:
            flat, ends = enc.encode_batch(batch.column(1).to_pylist())
            ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(flat, np.int32) if flat else np.empty(0, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], [key, "ids"])

    rows = docs.select(key, F.col(text).alias("_text"))
    return rows.mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, ids array<int>")


def token_counts(docs: DataFrame, text: str = "text", folder: str | None = None, vocabulary: str = VOCABULARY, keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep..., n_tokens): the number of tokens of each row's text, 0 for null and empty texts; the text is dropped."""
    path = _where(folder, vocabulary)

    def run(batches):
        enc = encoder(path)
        for batch in batches:
            _, ends = enc.encode_batch(batch.column(batch.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.diff(ends))], [*keep, "n_tokens"])

    rows = docs.select(*keep, F.col(text).alias("_text"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{fields}, n_tokens long")
