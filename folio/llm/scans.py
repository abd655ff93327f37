"""Repair of text from scanned pages: words cut at line ends, misread characters, running lines.

Vocabulary are the words that at least a share FREQUENT of all records hold, so its size is bounded by the words of a record over
that share, whatever the corpus. The unknown words of all records, each once, meet the vocabulary in an inverted join on character
q-grams: an index of the vocabulary's grams and of its skeletons (the word with every confusable shape written one way), bounded
as the vocabulary is, goes to the tasks that hold the unknown words. A gradient-boosted ranker, trained on words of the vocabulary
damaged by the known confusions and on rare words taken as they are, looks at every candidate and says whether the best replaces
the word; the replacements join the records that hold the words. Whether a line end cuts a word is told by a classifier of the
same kind over pairs of line ends and beginnings, trained on words of the vocabulary cut anywhere and on compounds; signs and
digits in words, spaced letters and split words have rules. Lines at the edge of a sheet go to a third classifier: whether a line
is furniture is told from its shape and from the pages of its document, and of all documents, that repeat it.

Null and blank texts have no noise. Rows that repeat a key are one record.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from folio.llm.boost import Boost
from folio.session import bounded_sample, materialize

FREQUENT, LEAST_RECORDS = 0.002, 5
#: Most labelled rows that a classifier is trained on.
SAMPLE = 20_000

# Shapes that scanners confuse, the damaged one after the right one, and the characters that stand for letters.
CONFUSIONS = (("rn", "m"), ("m", "rn"), ("cl", "d"), ("d", "cl"), ("h", "li"), ("w", "vv"), ("e", "c"), ("a", "@"), ("t", "†"), ("o", "0"), ("g", "9"), ("s", "5"), ("l", "1"), ("i", "|"), ("b", "6"), ("b", "8"), ("i", "1"), ("l", "|"), ("c", "e"), ("u", "ii"), ("t", "f"))
HYPHENS = "-‐‑‒–­⁃﹣－¬"

WORD = re.compile(r"(?<![\w@|†‡$\\#&])[^\W\d_]+(?![\w@|†‡])")
ALNUM = re.compile(r"[^\W_]+")
#: Letters with a few signs or digits between or beside them.
MIXED = re.compile(r"(?<![\w@|†‡\\#&$./:{<=-])(?=[^\s]*[^\W\d_])[^\W_]*(?:[@|†‡!$0-9]+[^\W\d_]+)+[@|†‡0-9]?(?![\w@|†‡/=\\-])|(?<![\w@|†‡\\#&$./:{<=-])[^\W\d_]{2,}[@|†‡0-9](?![\w@|†‡/=\\:-])")
SPACED = re.compile(r"(?<![^\s(\"“«„'’])(?:[^\W_]|[@|†‡]) (?:(?:[^\W_]|[@|†‡]) ){2,}(?:[^\W_]|[@|†‡])(?![^\s.,;:!?)\"”»'’])")
LINE_END = re.compile(rf"[{HYPHENS}][ \t]*\r?\n")
CUT = re.compile(rf"([^\W\d_]+)([{HYPHENS}])[ \t]*\r?\n[ \t]*([^\W\d_]+)")
ALPHABETS = re.compile("[\x00-ɏЀ-ӿ'’]+")
RUN = re.compile(r"[^\W\d_]+")
#: Quick tests for texts that MIXED or SPACED could match.
SIGNS = re.compile(r"[@|†‡!$0-9]+")
SPACE = re.compile(r"\s")
#: Runs without white space longer than this are no words.
LONGEST = 200
SINGLES = re.compile(r" [^\W_] [^\W_] ")
PAIR = re.compile(r"(?<![\w@|†‡-])([^\W\d_]+) ([^\W\d_]+)(?![\w@|†‡-])")
ROMAN = re.compile(r"(?i)^[ivxl]{1,7}$")
NUMBERED = re.compile(r"^(?:\W{0,3}#\W{0,3}|(?:\w+\.? )?#(?: (?:of|von|de|sur|из|/) #)?|第 ?# ?[页頁ページ]+|#/#)$")
_WIDE = {"m": "rn", "d": "cl", "h": "li", "w": "vv", "u": "ii"}
_CLASS = str.maketrans({"i": "l", "1": "l", "|": "l", "!": "l", "e": "c", "0": "o", "5": "s", "$": "s", "9": "g", "6": "b", "8": "b", "@": "a", "†": "t", "‡": "t", "f": "t"})
_WIDE_TABLE = str.maketrans(_WIDE)


def skeleton(word: str) -> str:
    """The word with every confusable shape written one way."""
    return word.lower().translate(_WIDE_TABLE).translate(_CLASS)


def is_word(w: str) -> bool:
    """Alphabets whose letters scanners confuse so; scripts without such words are left alone."""
    return len(w) > 1 and (w.isascii() or bool(ALPHABETS.fullmatch(w)))


def line_key(line: str) -> str:
    """What repeated lines share: digits and roman numerals as #, a page number at either end dropped, misreadings as skeletons."""
    t = re.sub(r"\s+", " ", line.strip().lower())
    if ROMAN.match(t) or t.isdigit():
        return "#"
    t = re.sub(r"^(?:\d{1,4}|[ivxl]{1,6}) (?=.*[^\W\d_]{3})|(?<=[^\W\d_]{3}) (?:\d{1,4}|[ivxl]{1,6})$|(?<=[^\W\d_]{3} \S)(\S*) \d{1,4}$", r"\1", t) if not re.match(r"^\W*(?:[^\W\d_]+\.? )?\d+(?: (?:of|von|de|sur|из|/) \d+)?\W*$", t) else t
    if not re.search(r"[^\W\d_]{2}", t):
        return re.sub(r"[\dloisgb|]+", "#", t)
    masked = re.sub(r"(?<![^\W\d_])\d+(?![^\W\d_])", "#", t)
    return skeleton(re.sub(r"\b[^\W\d_]+-#", "@-#", masked))


def edge_lines(text: str) -> list[tuple[str, str, int]]:
    """(line, key, place) of the lines at the edges that could be furniture: at most two at either end."""
    lines = [x.strip() for x in text.splitlines() if x.strip()]
    if len(lines) < 2:
        return []
    out, taken = [], set()
    for order in (range(len(lines)), range(len(lines) - 1, -1, -1)):
        for place, i in enumerate(order):
            line = lines[i]
            if place > 1 or i in taken or not 0 < len(line) <= 80 or line[-1] in ".!?:;,。।！？>}|\\`" and not re.match(r"^\W*\d+\W*$", line) or line[0] in "<|{\\`#=*>•" or line.startswith("- ") and not re.match(r"^- ?[\divxlIVXLOo]+ ?-$", line):
                break
            if len(line.split()) > 9:
                break
            taken.add(i)
            out.append((line, line_key(line), place))
    return out


def records(pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """(origin, record_key, doc, sheet, text)."""
    page = pages.filter(F.col("md").isNotNull() & F.col("doc").isNotNull() & F.col("page").isNotNull()).select(F.lit("page").alias("origin"), F.concat("doc", F.lit("#"), F.col("page").cast("string")).alias("record_key"), "doc", F.col("page").cast("string").alias("sheet"), F.col("md").alias("text"))
    chunk = chunks.filter(F.col("text").isNotNull() & F.col("chunk_id").isNotNull()).select(F.lit("chunk").alias("origin"), F.col("chunk_id").alias("record_key"), F.coalesce("doc", F.lit("")).alias("doc"), F.coalesce(F.nullif("page", F.lit("")), F.concat(F.lit("c"), F.col("ord").cast("string"))).alias("sheet"), "text")
    return page.unionByName(chunk)


EVIDENCE = "kind string, a string, n long, origin string, record_key string, doc string, sheet string, line string"


def _evidence(batches):
    held: Counter = Counter()
    times: Counter = Counter()
    schema = ["kind", "a", "n", "origin", "record_key", "doc", "sheet", "line"]

    def words():
        keys = [*held, *times]
        kinds = ["w"] * len(held) + ["h"] * len(times)
        none = pa.nulls(len(keys), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(keys, pa.string()), pa.array([*held.values(), *times.values()], pa.int64()), *[none] * 5], schema)

    for batch in batches:
        rows = []
        for origin, key, doc, sheet, text in zip(*(c.to_pylist() for c in batch.columns)):
            if not text or text.isspace():
                continue
            if origin == "chunk":
                held.update({w for w in set(ALNUM.findall(text.lower())) if w.isalpha() and (w.isascii() or is_word(w))})
                held["\0"] += 1
                if "-" in text:
                    times.update({m.lower() for m in re.findall(r"[^\W\d_]+-[^\W\d_]+", text)})
            rows += [("l", k, place, origin, key, doc, sheet, line) for line, k, place in edge_lines(text)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64() if i == 2 else pa.string()) for i in range(8)], schema)
        if len(held) > 400_000:
            yield words()
            held.clear()
            times.clear()
    yield words()


class Speller:
    """Candidates and ranker for unknown words, and the classifier of line ends."""

    Q = 3

    def __init__(self, frequency: dict[str, int], compounds: dict[str, int], n: int, rare: list[str] = ()) -> None:
        self.frequency, self.compounds, self.n = frequency, compounds, n
        self.names = sorted(w for w in frequency if len(w) > 2)
        self.skeletons: dict[str, list[str]] = {}
        #: The names of each skeleton, and each skeleton's number.
        self.places: dict[str, list[int]] = {}
        for k, w in enumerate(self.names):
            self.skeletons.setdefault(skeleton(w), []).append(w)
            self.places.setdefault(skeleton(w), []).append(k)
        number = {x: k for k, x in enumerate(self.places)}
        self.number = number
        # The inverted index: the grams in order, where each one's words begin, and the words.
        row, gram = _gram_codes(self.names)
        order = np.lexsort((row, gram))
        self.grams, first = np.unique(gram[order], return_index=True)
        self.starts, self.words = np.r_[first, len(order)], row[order]
        self.sizes = np.array([len(w) for w in self.names] or [0])
        self.logs = np.log(np.array([frequency[w] for w in self.names] or [1]) / n)
        self.shape = np.array([number[skeleton(w)] for w in self.names] or [0])
        self.ends = np.array([[ord(w[0]), ord(w[-1])] for w in self.names] or [[0, 0]])
        self.cache: dict[str, str | None] = {}
        self.cuts: dict[tuple, bool] = {}
        self.ranker, self.joiner = Boost(), Boost(rounds=25)
        self._train(list(rare))
        self._train_cuts(list(rare))

    def candidates(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, name, shared): places of words and of the names that share their skeleton or enough q-grams, and how many."""
        row, gram = _gram_codes(words)
        need = np.maximum(2, (np.bincount(row, minlength=len(words)) + 1) // 2 - 1)
        at = np.minimum(np.searchsorted(self.grams, gram), max(0, len(self.grams) - 1))
        known = self.grams[at] == gram if len(self.grams) else np.zeros(len(gram), bool)
        row, at = row[known], at[known]
        many = self.starts[at + 1] - self.starts[at]
        ends = np.cumsum(many)
        post = np.repeat(self.starts[at], many) + np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - many, many)
        span = max(1, len(self.names))
        key = np.sort(np.repeat(row, many) * span + self.words[post])
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        key, shared = key[first], np.diff(np.r_[first, len(key)])
        w, c = key // span, key % span
        lengths = np.array([len(x) for x in words] or [0])
        enough = (shared >= need[w]) & (abs(self.sizes[c] - lengths[w]) <= 2)
        extra = np.array([k * span + c for k, x in enumerate(words) for c in self.places.get(skeleton(x), ())], np.int64)
        keep = enough | np.isin(key, extra)
        lone = np.setdiff1d(extra, key)
        key, shared = np.r_[key[keep], lone], np.r_[shared[keep], np.zeros(len(lone), np.int64)]
        return key // span, key % span, shared

    def features(self, words: list[str], w: np.ndarray, c: np.ndarray, shared: np.ndarray) -> np.ndarray:
        used, w = np.unique(w, return_inverse=True)
        words = [words[k] for k in used]
        shape = np.array([self.number.get(skeleton(x), -1) for x in words])
        size, ends = np.array([len(x) for x in words]), np.array([[ord(x[0]), ord(x[-1])] for x in words])
        # Every edit takes Q grams at most, so the grams that are not shared bound the edits from below.
        edits = np.ceil((np.maximum(size[w], self.sizes[c]) - shared) / self.Q)
        alpha = np.array([x.isalpha() for x in words], float)
        return np.stack([shape[w] == self.shape[c], edits, edits / self.sizes[c], shared / (size[w] + self.sizes[c]), self.sizes[c], size[w] - self.sizes[c], self.logs[c], ends[w, 0] == self.ends[c, 0], ends[w, 1] == self.ends[c, 1], alpha[w]], 1).astype(float)

    def _train(self, rare: list[str]) -> None:
        rng = np.random.default_rng(11)
        damaged, right = [], []
        for c in (self.names[k] for k in rng.permutation(len(self.names))[: SAMPLE // 4]):
            fits = [(a, b) for a, b in CONFUSIONS if a in c]
            for k in rng.permutation(len(fits))[: 2 if len(c) > 3 else 0]:
                w = c.replace(*fits[k], 1)
                if w not in self.frequency:
                    damaged.append(w)
                    right.append(c)
        # Rare words as they stand are taken for correct, unless they have the very skeleton of a frequent word.
        plain = [w for w in rare if skeleton(w) not in self.skeletons][: SAMPLE // 4]
        words = damaged + plain
        if not words or not self.names:
            return
        w, c, shared = self.candidates(words)
        if not len(w):
            return
        y = np.array([k < len(right) and self.names[j] == right[k] for k, j in zip(w, c)], float)
        pick = rng.permutation(len(w))[:SAMPLE]
        self.ranker.fit(self.features(words, w[pick], c[pick], shared[pick]), y[pick])

    def _train_cuts(self, rare: list[str]) -> None:
        """Words of the vocabulary and rare words cut anywhere are cuts, the latter as if never seen whole; compounds are none, half of
        them as if never seen."""
        rng = np.random.default_rng(13)
        x, y = [], []
        for whole in [*self.names, *rare][: 2 * SAMPLE]:
            if len(whole) >= 5:
                at = int(rng.integers(2, len(whole) - 1))
                x.append(self._cut_features(whole[:at], whole[at:], self.frequency.get(whole, 0), 0))
                y.append(1.0)
        for compound, n in self.compounds.items():
            left, right = compound.split("-", 1)
            x.append(self._cut_features(left, right, self.frequency.get(left + right, 0), n))
            y.append(0.0)
        frequent = [w for w in self.names if len(w) > 3]
        for _ in range(len(y) // 4 if frequent else 0):
            left, right = (frequent[int(k)] for k in rng.integers(0, len(frequent), 2))
            if left + right not in self.frequency:
                x.append(self._cut_features(left, right, 0, int(rng.random() < 0.5)))
                y.append(0.0)
        pick = rng.permutation(len(x))[:SAMPLE]
        if len(x):
            self.joiner.fit(np.array(x)[pick], np.array(y)[pick])

    def _cut_features(self, left: str, right: str, whole: int, compound: int) -> list[float]:
        a, b = self.frequency.get(left.lower(), 0), self.frequency.get(right.lower(), 0)
        return [np.log1p(whole), np.log1p(compound), float(whole > compound), np.log1p(a), np.log1p(b), float(a > 0 and b > 0), len(left), len(right), float(skeleton(left + right) in self.skeletons)]

    def cut(self, left: str, right: str) -> bool:
        """What the classifier says of a line end and the beginning of the next line."""
        key = left.lower(), right.lower()
        if key not in self.cuts:
            if len(self.cuts) > 200_000:
                self.cuts.clear()
            whole, compound = self.frequency.get("".join(key), 0), self.compounds.get("-".join(key), 0)
            self.cuts[key] = bool(self.joiner.predict(np.array([self._cut_features(*key, whole, compound)]))[0] > 0.5)
        return self.cuts[key]

    def known(self, w: str) -> bool:
        return w.lower() in self.frequency

    def corrections(self, words: list[str]) -> list[str | None]:
        """Of each lower-case word the frequent word that it stands for, or None where it may be right as it is."""
        out: list[str | None] = [None] * len(words)
        if not words or not self.names:
            return out
        w, c, shared = self.candidates(words)
        if not len(w):
            return out
        p = self.ranker.predict(self.features(words, w, c, shared))
        order = np.lexsort((p, w))
        last = order[np.r_[w[order][1:] != w[order][:-1], True]]
        for k in last[p[last] > 0.5]:
            if words[w[k]] not in self.frequency:
                out[w[k]] = self.names[c[k]]
        return out

    def correction(self, w: str) -> str | None:
        """corrections() of one word that has the skeleton of a frequent word; None for others."""
        low = w.lower()
        if low in self.frequency or len(low) < 2 or skeleton(low) not in self.skeletons:
            return None
        if low not in self.cache:
            if len(self.cache) > 500_000:
                self.cache.clear()
            self.cache[low] = self.corrections([low])[0]
        return self.cache[low]


def _gram_codes(words: list[str], q: int = Speller.Q) -> tuple[np.ndarray, np.ndarray]:
    """(word, gram): the distinct q-grams of each word with its ends marked, 21 bits for each character."""
    points = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    lengths = np.array([len(w) + 2 for w in words], np.int64)
    row = np.repeat(np.arange(len(words)), lengths)
    n = max(0, len(points) - q + 1)
    code = np.zeros(n, np.int64)
    for k in range(q):
        code = code << 21 | points[k : n + k]
    inside = row[:n] == row[q - 1 : n + q - 1]
    row, code = row[:n][inside], code[inside]
    order = np.lexsort((code, row))
    row, code = row[order], code[order]
    once = np.r_[True, (row[1:] != row[:-1]) | (code[1:] != code[:-1])] if len(row) else np.zeros(0, bool)
    return row[once], code[once]


def is_cut(left: str, mark: str, right: str, speller: Speller) -> bool:
    """Whether the hyphen at a line end cuts a word, rather than joining the parts of a compound that happens to end the line.

    Soft hyphens always cut, dashes before capitals never do; the classifier tells the others.
    """
    if mark == "–" and not right[0].islower():
        return False
    return mark in "­¬" or speller.cut(left, right)


def noise(text: str, speller: Speller) -> tuple[set[str], set[str]]:
    """'hyphen' and 'character' where the text surely has them, and the unknown words that may be misread, lower-case."""
    out, unknown = set(), set()
    t = text
    if "\n" in text and LINE_END.search(text):
        t = CUT.sub(r"\1\3", text)
        for m in CUT.finditer(text):
            if is_word(m[1]) and is_cut(m[1], m[2], m[3], speller):
                out.add("hyphen")
                break
    if odd_signs(t, speller):
        out.add("character")
        return out, unknown
    words = RUN.findall(t)
    frequency = speller.frequency
    new = {w for w in set(words).difference(frequency) if w.lower() not in frequency}
    # A word split in two: at least one part is no word, and both together are.
    odd = [i for i, w in enumerate(words) if w in new] if new else []
    for i in {k for i in odd for k in (i - 1, i) if 0 <= k < len(words) - 1}:
        a, b = words[i], words[i + 1]
        if (a + b).lower() in frequency and len(a) + len(b) > 3 and is_word(a + b):
            if re.search(rf"(?<![\w@|†‡$\\#&-]){re.escape(a)} {re.escape(b)}(?![\w@|†‡-])", t):
                out.add("character")
                return out, unknown
    unknown = {w.lower() for w in new if is_word(w) and _stands(t, w)}
    return out, unknown


def _stands(text: str, word: str) -> bool:
    """Whether the word stands somewhere as WORD finds it."""
    at = text.find(word)
    while at >= 0:
        end = at + len(word)
        before, after = text[at - 1] if at else " ", text[end] if end < len(text) else " "
        if not (before.isalnum() or before in "_@|†‡$\\#&" or after.isalnum() or after in "_@|†‡"):
            return True
        at = text.find(word, end)
    return False


def _letter(c: str) -> bool:
    return c.isalpha() and (c.isascii() or "À" <= c <= "ɏ" or "Ѐ" <= c <= "ӿ")


def odd_signs(t: str, speller: Speller) -> bool:
    """Whether signs or digits stand in words, or letters are spaced."""
    at = 0
    for near in SIGNS.finditer(t):
        a, b = near.span()
        if a < at or not (a and _letter(t[a - 1]) or b < len(t) and _letter(t[b])):
            continue
        while a > at and not t[a - 1].isspace():
            a -= 1
        end = SPACE.search(t, b)
        at = end.start() if end else len(t)
        if at - a <= LONGEST and any(misread_sign(m.group(), speller) and not _in_link(t, m) for m in MIXED.finditer(t, a, at)):
            return True
    if SINGLES.search(t):
        for m in SPACED.finditer(t):
            joined = m.group().replace(" ", "")
            if len(joined) >= 4 and (joined.lower() in speller.frequency or skeleton(joined) in speller.skeletons or joined[1:].islower()):
                return True
    return False


def _in_link(text: str, m: re.Match) -> bool:
    """Whether a bar is that of a link or a template, not a misread letter."""
    return "|" in m.group() and any(text.rfind(a, 0, m.start()) > text.rfind(b, 0, m.start()) for a, b in (("[[", "]]"), ("{{", "}}")))


def misread_sign(token: str, speller: Speller) -> bool:
    """Whether a token of letters and signs is a misread word; codes, amounts and names of files are none."""
    t = token.strip("!$")
    letters = sum(c.isalpha() for c in t)
    if letters < 2 or not any(c.islower() for c in t):
        return letters >= 3 and t.isupper() is False and bool(speller.skeletons.get(skeleton(t)))
    if speller.skeletons.get(skeleton(t)):
        return True
    signs = sum(not c.isalpha() for c in t)
    if signs > max(1, letters // 3):
        return False
    if re.search(r"[^\W\d_][†‡@|][^\W\d_]|^[†‡@|][^\W\d_]{2,}|[^\W\d_]{2,}[†‡]$", t):
        return True
    if re.search(r"[^\W\d_][0159][^\W\d_]", t) and letters >= 4:
        return True
    return speller.correction(t) is not None


MARKS = "origin string, record_key string, noise string, word string"


def _classify(batches, model):
    """MARKS of (origin, record_key, text): a row for each kind that is sure, and one for each unknown word."""
    speller = model.value if hasattr(model, "value") else model
    for batch in batches:
        place, kinds, words = [], [], []
        for i, text in enumerate(batch.column(2).to_pylist()):
            if text and not text.isspace():
                sure, unknown = noise(text, speller)
                n = len(sure) + len(unknown)
                place += [i] * n
                kinds += [*sure, *[None] * len(unknown)]
                words += [*[None] * len(sure), *unknown]
        which = pa.array(place, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(which), batch.column(1).take(which), pa.array(kinds, pa.string()), pa.array(words, pa.string())], ["origin", "record_key", "noise", "word"])


def _corrected(batches, model):
    """(word, right) of the distinct unknown words that are replaced."""
    for batch in batches:
        words = batch.column(0).to_pylist()
        for at in range(0, len(words), 20_000):
            part = words[at : at + 20_000]
            found = [(w, c) for w, c in zip(part, model.value.corrections(part)) if c is not None]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.string()) for i in range(2)], ["word", "right"])


LINE_FEATURES = ("numbered", "sheets", "share", "docs", "rate", "shape_docs", "shape_rate", "length", "words", "upper", "digits", "place")


def _shapes(batches, frequency):
    for batch in batches:
        shapes = [" ".join("#" if any(c.isdigit() for c in w) else w if w in frequency or len(w) < 4 else "N" for w in line.lower().split()) for line in batch.column(6).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shapes, pa.string())], [*batch.schema.names, "shape"])


def line_features(lines: DataFrame, frequency) -> DataFrame:
    """One row per edge line with LINE_FEATURES: its form, and who repeats it. A line's shape is the line with unknown words as N."""
    shaped = lines.mapInArrow(lambda it: _shapes(it, frequency), "a string, n long, origin string, record_key string, doc string, sheet string, line string, shape string")
    # Four aggregates read the lines.
    lines = materialize(shaped, "shapes")
    all_sheets = lines.groupBy("doc").agg(F.count_distinct("sheet").alias("total"))
    per_doc = lines.groupBy("doc", "a").agg(F.count_distinct("sheet").alias("sheets")).join(all_sheets, "doc")
    several = F.col("total") >= 3
    per_key = per_doc.groupBy("a").agg(F.count("*").alias("docs"), F.try_divide(F.count_if(several & (F.col("sheets") >= 2)), F.count_if(several)).alias("rate"))
    shaped = lines.select("doc", "a", "shape").distinct().join(per_doc, ["doc", "a"])
    per_shape = shaped.groupBy("shape").agg(F.count_distinct("doc").alias("shape_docs"), F.try_divide(F.count_if(several & (F.col("sheets") >= 2)), F.count_if(several)).alias("shape_rate"))
    rows = lines.join(per_doc, ["doc", "a"]).join(per_key, "a").join(per_shape, "shape")
    letters = F.length(F.regexp_replace("line", r"[^\p{L}]", ""))
    return rows.select(
        "origin", "record_key", "doc", "a", "line", F.when(F.regexp_replace(F.lower(F.trim("line")), r"[0-9]+|^[ivxl]+$", "#").rlike(r"^[^\w#]*#[^\w#]*$|^(\w+\.? )?#( (of|von|de|sur|из|/) #)?$|^第 ?# ?[页頁]"), 1.0).otherwise(0.0).alias("numbered"), F.col("sheets").cast("double").alias("sheets"),
        (F.col("sheets") / F.col("total")).alias("share"), F.least(F.col("docs"), F.lit(1000)).cast("double").alias("docs"), F.coalesce("rate", F.lit(-1.0)).alias("rate"), F.least("shape_docs", F.lit(1000)).cast("double").alias("shape_docs"), F.coalesce("shape_rate", F.lit(-1.0)).alias("shape_rate"), F.length("line").cast("double").alias("length"),
        F.size(F.split("line", " ")).cast("double").alias("words"), F.coalesce(F.try_divide(F.length(F.regexp_replace("line", r"[^\p{Lu}]", "")), letters), F.lit(0.0)).alias("upper"),
        (F.length(F.regexp_replace("line", r"[^\p{N}]", "")) / F.length("line")).alias("digits"), F.col("n").cast("double").alias("place"), "total",
    )


def running_model(rows: DataFrame) -> Boost:
    """The line classifier, from lines whose repetition leaves no doubt: furniture on at least three sheets and most documents that
    have the line, no furniture on one sheet of at least four."""
    sure = F.when((F.col("rate") >= 0.5) & (F.col("sheets") >= 3), 1.0).when((F.col("total") >= 4) & (F.col("sheets") == 1) & (F.col("numbered") == 0) & (F.col("rate") < 0.5), 0.0)
    labelled = rows.withColumn("y", sure).filter("y IS NOT NULL").select("record_key", "line", *LINE_FEATURES, "y")
    sample = bounded_sample(labelled, ["record_key", "line"], SAMPLE)
    if not sample:
        return Boost()
    data = np.array([tuple(r[c] for c in (*LINE_FEATURES, "y")) for r in sample], float)
    return Boost(rounds=25).fit(data[:, :-1], data[:, -1])


def running_lines(lines: DataFrame, frequency) -> DataFrame:
    """(origin, record_key, doc, a, line) of the edge lines that are furniture: what the classifier takes for it and something repeats, numbers
    of sheets, and lines or shapes that most of several documents repeat."""
    rows = materialize(line_features(lines, frequency), "lines")
    model = running_model(rows)

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            x = np.stack([batch.column(5 + k).to_numpy(zero_copy_only=False) for k in range(len(LINE_FEATURES))], 1)
            p = model.predict(x)
            f = dict(zip(LINE_FEATURES, x.T))
            keep = (p > 0.5) & ((f["sheets"] >= 2) | (f["rate"] >= 0.5)) & (f["digits"] + f["upper"] > 0)
            keep |= (f["rate"] >= 0.5) & (f["docs"] >= 3) | (f["shape_rate"] >= 0.6) & (f["shape_docs"] >= 5)
            # Amounts are wrapped text.
            letters = np.array([any(c.islower() for c in line) or line.isupper() and " " in line and not re.search(r"\d[.,]\d", line) for line in batch.column(4).to_pylist()])
            keep = keep & letters | (f["numbered"] == 1) & (f["rate"] != 0)
            yield batch.select([0, 1, 2, 3, 4]).filter(pa.array(keep))

    return rows.select("origin", "record_key", "doc", "a", "line", *LINE_FEATURES).mapInArrow(run, "origin string, record_key string, doc string, a string, line string")


def misread_lines(running: DataFrame) -> DataFrame:
    """(origin, record_key) of running lines that are written unlike most lines of their document with the same key.

    The key writes confusable shapes one way, so what differs is a misreading, of names too; page numbers do not count.
    """
    surface = F.regexp_replace(F.regexp_replace(F.lower("line"), r"(^|\s)([0-9]+|[ivxl]+)(?=\s|$)", ""), r"\s", "")
    rows = running.select("origin", "record_key", "doc", "a", surface.alias("s")).filter(F.col("s").rlike(r"\p{L}{3}"))
    times = rows.groupBy("doc", "a", "s").agg(F.count("*").alias("n"))
    most = times.groupBy("doc", "a").agg(F.max("n").alias("most"), F.count("*").alias("forms")).filter("forms > 1")
    rare = times.join(most, ["doc", "a"]).filter("n < most").select("doc", "a", "s")
    return rows.join(rare, ["doc", "a", "s"], "left_semi").select("origin", "record_key").distinct()


class ScanModel:
    """What the corpus says about its scanned texts; built once, in two passes over (origin, record_key, doc, sheet, text)."""

    def __init__(self, rows: DataFrame) -> None:
        self.rows = rows
        self.spark = rows.sparkSession
        found = materialize(rows.mapInArrow(_evidence, EVIDENCE), "scans")
        self.lines = found.filter("kind = 'l'").select("a", "n", "origin", "record_key", "doc", "sheet", "line").dropDuplicates(["origin", "record_key", "line", "n"])
        words = materialize(found.filter("kind <> 'l'").groupBy("kind", "a").agg(F.sum("n").alias("n")), "words")
        n = words.filter("kind = 'w' AND a = '\\0'").agg(F.sum("n")).first()[0] or 0
        least = max(LEAST_RECORDS, FREQUENT * n)
        # At most the words of a record over FREQUENT.
        frequency = dict(words.filter((F.col("kind") == "w") & (F.col("a") != "\0") & (F.col("n") >= least)).select("a", "n").collect())
        compounds = dict(words.filter((F.col("kind") == "h") & (F.col("n") >= least / 4)).select("a", "n").collect())
        rare = [r.a for r in bounded_sample(words.filter((F.col("kind") == "w") & (F.col("n") <= 2) & (F.length("a") >= 4)).select("a"), ["a"], SAMPLE // 4)]
        self.frequency = frozenset(frequency)
        self.speller = Speller(frequency, compounds, max(1, n), rare)

    def _marks(self) -> tuple[DataFrame, DataFrame]:
        """MARKS of all records, and (word, right) of the unknown words that are replaced."""
        model = self.spark.sparkContext.broadcast(self.speller)
        marks = materialize(self.rows.select("origin", "record_key", "text").mapInArrow(lambda it: _classify(it, model), MARKS), "marks")
        words = marks.filter("word IS NOT NULL").select("word").distinct()
        return marks, materialize(words.mapInArrow(lambda it: _corrected(it, model), "word string, right string"), "corrections")

    def found(self) -> DataFrame:
        """(origin, record_key, noise) of every record with noise, one row per kind."""
        marks, right = self._marks()
        texts = marks.filter("noise IS NOT NULL").select("origin", "record_key", "noise")
        misread_words = marks.filter("word IS NOT NULL").join(right, "word").select("origin", "record_key", F.lit("character").alias("noise"))
        running = materialize(running_lines(self.lines, self.frequency), "running")
        lines = running.select("origin", "record_key", F.lit("running").alias("noise"))
        misread = misread_lines(running).withColumn("noise", F.lit("character"))
        return texts.unionByName(misread_words).unionByName(lines).unionByName(misread).distinct()

    def repaired(self) -> DataFrame:
        """(origin, record_key, text): continuous paragraphs without furniture, cut words joined, misread words replaced."""
        model = self.spark.sparkContext.broadcast(self.speller)
        gone = running_lines(self.lines, self.frequency).groupBy("origin", "record_key").agg(F.collect_set("line").alias("gone"))
        marks, right = self._marks()
        # A record's words are as many as its text has.
        fixes = marks.filter("word IS NOT NULL").join(right, "word").groupBy("origin", "record_key").agg(F.collect_set(F.struct("word", "right")).alias("fixes"))

        def run(batches):
            speller = model.value
            for batch in batches:
                texts = []
                for t, g, f in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4))):
                    texts.append(repair(t, frozenset(g or ()), speller, {x["word"]: x["right"] for x in f or ()}))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["origin", "record_key", "text"])

        unique = self.rows.select("origin", "record_key", "text").dropDuplicates(["origin", "record_key"])
        key = ["origin", "record_key"]
        return unique.join(gone, key, "left").join(fixes, key, "left").select(*key, "text", "gone", "fixes").mapInArrow(run, "origin string, record_key string, text string")


def _cased(like: str, word: str) -> str:
    return word.upper() if like.isupper() and len(like) > 1 else word[:1].upper() + word[1:] if like[:1].isupper() else word


def repair(text: str | None, gone: frozenset[str], speller: Speller, fixes: dict[str, str] | None = None) -> str | None:
    """The text without the lines `gone`, with cut words joined and with the misread words that `fixes` replaces."""
    fixes = fixes or {}
    if not text or text.isspace():
        return text
    lines = [x for x in text.splitlines() if x.strip() not in gone or not x.strip()]
    t = "\n".join(lines).strip("\n")
    t = CUT.sub(lambda m: m[1] + m[3] if is_cut(m[1], m[2], m[3], speller) else f"{m[1]}{m[2]}{m[3]}", t)
    t = SPACED.sub(lambda m: m[0].replace(" ", "") if len(m[0]) >= 7 else m[0], t)
    t = MIXED.sub(lambda m: _cased(m[0], min(speller.skeletons.get(skeleton(m[0]), [m[0]]), key=lambda c: -speller.frequency.get(c, 0))) if misread_sign(m[0], speller) else m[0], t)
    t = PAIR.sub(lambda m: m[1] + m[2] if (m[1] + m[2]).lower() in speller.frequency and not (speller.known(m[1]) and speller.known(m[2])) else m[0], t)
    t = WORD.sub(lambda m: _cased(m[0], c) if (c := fixes.get(m[0].lower())) else m[0], t)
    out: list[str] = []
    for line in t.split("\n"):
        if out and out[-1] and line.strip() and _joins(out[-1], line):
            out[-1] = f"{out[-1].rstrip()} {line.strip()}"
        else:
            out.append(line.rstrip())
    return re.sub(r"\n{3,}", "\n\n", "\n".join(out))


def _joins(before: str, line: str) -> bool:
    """Whether two lines are one paragraph: a full line that no sentence ends goes on in the next."""
    a, b = before.rstrip(), line.strip()
    if b[0] in "-*•#|<>{\\`" or re.match(r"\d+\. ", b) or a[-1] in "|>}`":
        return False
    return a[-1] not in ".!?:。！？।" or b[0].islower()
