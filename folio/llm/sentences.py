"""Sentence units in any language and script.

Per language, abbreviations, collocations across a period and sentence starters are learned from all documents without labels, by
log-likelihood ratios: a word is an abbreviation if its period depends on it (and on what follows) rather than on the sentence, a
starter if it opens blocks, items and what follows '!' or '?' far more often than chance, a collocate if it follows a number and
its period ('3. Mai') more often than chance. After abbreviations and initials only starters begin a sentence; as a starter is no
collocate, pairs with those would decide nothing and are not sought. Each period is then classified by these statistics; the other
marks, quotations, brackets, list items and Thai spaces have rules. A block's language is guessed from its script and most
frequent words, so mixed documents need no label.

Null, empty and blank texts have no units. Positions count code points.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from folio.session import materialize

UNITS = "start_pos long, end_pos long"
#: Longest word that can be an abbreviation, and how often it must stand with a period.
LETTERS, OFTEN = 7, 3
#: Thresholds of the log-likelihood ratios.
ABBREVIATION, STARTER, COLLOCATION = 0.3, 30.0, 7.88

# The most frequent function words of languages in Latin script.
WORDS = {
    "en": "the of and to in was with for on by after at an as",
    "de": "der die das und den von dem mit des auf ein eine nicht war am zwei",
    "fr": "le la les des et du une pour dans est a que au l d",
    "es": "el la los las y de del que por en una se para lo",
}
# By word, a vote for each of its languages in a field of its own, so that votes are added in one sum.
_FIELD = 40
_VOTES: dict[str, int] = {}
for _place, _list in enumerate(WORDS.values()):
    for _w in _list.split():
        _VOTES[_w] = _VOTES.get(_w, 0) + (1 << _FIELD * _place)

# Patterns begin with the characters that they look for, so that the search skips all others.
BLANK = re.compile(r"(?:\r\n|\n|\r)[ \t　\xa0]*(?:\r\n|\n|\r)\s*")
BLANK_LF = re.compile(r"\n[ \t　\xa0]*\n\s*")  # the same where there is no CR
ITEM = re.compile(r"^[ \t　]*(?:[-*•]|\d+\.)[ \t　]+(?=\S)", re.M)
ITEM_AT = re.compile(ITEM.pattern[1:])
LOWER = re.compile(r"[a-zß-öø-ÿа-яё]")
TOKEN = re.compile(r"[^\W\d_]+(?:[.'’-][^\W\d_]+)*")
CAPITAL = re.compile(r"[A-ZÀ-ÖØ-ÞЀ-Я](?<!\w.)[^\W\d_]*(?:[.'’-][^\W\d_]+)*")
NUMBER = re.compile(r"\d\d*(?:[.,]\d+)*")
LETTERS_RUN = re.compile(r"[^\W\d_]+")
SPACED = {c: chr(c) if chr(c).isalpha() else " " for c in range(128)}
PERIOD = re.compile(r"\.(?<!\.\.)(?![\w.])[\s\"”’»)\]]*([^\W\d_]*)")
OPEN = re.compile(r"[!?][!?]*[\"”’»)]*\s+[\"“„«¿¡(]*")
MARK = re.compile(r"[.!?…。！？｡．।॥](?:(?<=[.!?…])[.!?…]*|[。！？｡．।॥]*[!?！？。]*)")
OPENERS, CLOSERS = "\"“„«‹「『（(［[【《〈‘", "\"”“»›」』）)］]】》〉’"
PAIRS = {"“": "”", "„": "“”", "«": "»", "‹": "›", "「": "」", "『": "』", "（": "）", "(": ")", "［": "］", "[": "]", "【": "】", "《": "》", "〈": "〉"}
CLOSES = frozenset("".join(PAIRS.values()))
MARKED = re.compile("[" + re.escape("".join(PAIRS) + "".join(CLOSES) + '"') + "]")
BRACKETS = frozenset("（(［[【")
THAI = "[ก-๎]"
THAI_GAP = re.compile(f"(?<={THAI})[  　\r\n\t]+(?={THAI})")
ANY_SCRIPT = re.compile("[ก-๎ぁ-ヿ一-鿿ऀ-ॿЀ-ӿ]")
SCRIPTS = tuple((lang, re.compile(f"[{letters}]+")) for lang, letters in (("th", THAI[1:-1]), ("ja", "ぁ-ヿ"), ("zh", "一-鿿"), ("hi", "ऀ-ॿ"), ("ru", "Ѐ-ӿ")))


def letter_runs(text: str) -> list[str]:
    """The runs of letters; where all is ASCII, whatever else becomes a space."""
    return text.translate(SPACED).split() if text.isascii() else LETTERS_RUN.findall(text)


def script(block: str) -> str | None:
    """The language of the script that prevails in the block, where it is another than Latin."""
    if not block.isascii() and ANY_SCRIPT.search(block):
        n = len(block)
        for lang, p in SCRIPTS:
            if p.search(block) and sum(map(len, p.findall(block))) > (0.1 if lang == "ja" else 0.25) * n:
                return lang
    return None


def language(block: str) -> str:
    """The block's language: its script where another than Latin prevails, else by function words; 'en' where nothing tells."""
    return script(block) or _voted(block.lower().split())


def _voted(words: list[str]) -> str:
    votes = sum(map(_VOTES.__getitem__, filter(_VOTES.__contains__, words)))
    if not votes >> _FIELD:
        return "en"
    each = [votes >> _FIELD * k & (1 << _FIELD) - 1 for k in range(len(WORDS))]
    return list(WORDS)[each.index(max(each))]


def _segments(text: str):
    """(start, end, body) of each block and list item; body is where the text after a list marker begins."""
    at = 0
    blocks = []
    for m in (BLANK if "\r" in text else BLANK_LF).finditer(text):
        blocks.append((at, m.start()))
        at = m.end()
    blocks.append((at, len(text)))
    for a, b in blocks:
        first = ITEM_AT.match(text, a, b)
        if text.find("\n", a, b) < 0:
            if b > a:
                yield a, b, first.end() if first else a
            continue
        marks = ([first] if first else []) + [m for m in ITEM.finditer(text, a + 1, b)]
        edges = [a, *(m.start() for m in marks if m.start() > a), b]
        bodies = {m.start(): m.end() for m in marks}
        for s, e in zip(edges, edges[1:]):
            if e > s:
                yield s, e, bodies.get(s, s)


def count_evidence(texts, found: Counter, words: dict[str, Counter]) -> None:
    """Adds what the texts say. To found: ('n', lang, '', '') tokens, ('p', lang, word, next) short words with a period and what
    follows it, ('s', lang, word, '') sure starts, ('t', lang, '', '') their number, ('d', lang, '', '') numbers, ('o', lang, word, '')
    capitals after a number and its period; to words: how often each word stands, in lower case and once more as it is where it
    begins with a capital."""
    for text in texts:
        if not text or text.isspace():
            continue
        for s, e, body in _segments(text):
            part = text[body:e]
            lang = script(part)
            if lang in ("zh", "ja", "th"):
                continue
            every = letter_runs(part.lower())
            if not every:
                continue
            lang = lang or _voted(every)
            words.setdefault(lang, Counter()).update(every)
            words[lang].update(CAPITAL.findall(part))
            found["n", lang, "", ""] += len(every)
            found["d", lang, "", ""] += len(NUMBER.findall(part))
            starts = [TOKEN.match(part, len(part) - len(part.lstrip(" \t\r\n\"“„«¿¡(")))]
            if "!" in part or "?" in part:
                starts += [TOKEN.match(part, k.end()) for k in OPEN.finditer(part)]
            for m in starts:
                if m:
                    if part[m.end() : m.end() + 1] != ".":
                        found["s", lang, m.group(), ""] += 1
                    found["t", lang, "", ""] += 1
            for m in PERIOD.finditer(part):
                i = m.start()
                near = part[i - 40 : i] if i > 40 else part[:i]
                word = near[near.rfind(" ") + 1 :]
                if len(word) > LETTERS + 4 and len(word) < 40 and word.isalpha():
                    continue  # neither a short word nor a number
                if not word.isalpha():
                    for a in (max(0, i - 40), 0):
                        k = max(part.rfind(" ", a, i), part.rfind("\n", a, i), part.rfind("(", a, i), part.rfind("\xa0", a, i))
                        if k >= 0:
                            break
                    word = part[k + 1 : i].lstrip("\"“„«¿¡'’")
                word = word.lower()
                if word and word[-1] != "." and len(word) <= LETTERS + 4 and word.replace(".", "").isalpha():
                    n = m.group(1)
                    if not n:
                        c = part[m.end() : m.end() + 1]
                        n = "0" if c.isdigit() else c
                    elif not n[0].isupper():
                        n = "a"
                    found["p", lang, word, n] += 1
                elif m.group(1)[:1].isupper() and NUMBER.fullmatch(word):
                    found["o", lang, TOKEN.match(part, m.start(1)).group(), ""] += 1


def _evidence(batches):
    found, words = Counter(), {}
    for batch in batches:
        count_evidence(batch.column(0).to_pylist(), found, words)
        if len(found) + sum(map(len, words.values())) > 500_000:
            yield _rows(found, words)
            found, words = Counter(), {}
    yield _rows(found, words)


def _rows(found: Counter, words: dict[str, Counter]) -> pa.RecordBatch:
    for lang, times in words.items():
        found.update({("c" if w[0].isupper() else "w", lang, w, ""): n for w, n in times.items()})
    keys = list(found)
    columns = [pa.array([k[i] for k in keys], pa.string()) for i in range(4)]
    return pa.RecordBatch.from_arrays([*columns, pa.array(list(found.values()), pa.int64())], ["kind", "lang", "word", "next", "n"])


def evidence(docs: DataFrame, text: str = "text") -> DataFrame:
    """(kind, lang, word, next, n) summed over all documents."""
    rows = docs.select(text).filter(F.col(text).isNotNull()).mapInArrow(_evidence, "kind string, lang string, word string, next string, n long")
    return materialize(rows.groupBy("kind", "lang", "word", "next").agg(F.sum("n").alias("n")), "evidence")


class Model:
    """Abbreviations, sentence starters and the words that number and period form a collocation with, per language."""

    def __init__(self, abbreviations: dict[str, set[str]], starters: dict[str, set[str]], collocates: dict[str, set[str]] | None = None) -> None:
        self.abbreviations, self.starters, self.collocates = abbreviations, starters, collocates or {}


def _llr(k, n, p):
    """Log-likelihood of k of n at probability p."""
    p = F.least(F.lit(1 - 1e-9), F.greatest(F.lit(1e-9), p))
    return k * F.ln(p) + (n - k) * F.ln(F.lit(1.0) - p)


def learn(counts: DataFrame) -> Model:
    """The model of the evidence. What comes to the driver are the words that pass: short, frequent words of a few languages."""
    spark = counts.sparkSession
    sums = [F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(name) for k, name in (("n", "tokens"), ("t", "opened"), ("d", "numbers"))]
    total = counts.filter("kind IN ('n', 't', 'd')").groupBy("lang").agg(*sums)
    total = F.broadcast(spark.createDataFrame(total.collect(), total.schema))
    # A word is in lower case or not, so it has one row of its uses.
    uses = counts.filter("kind IN ('w', 'c')").select("lang", "word", F.col("n").alias("uses"))
    s = counts.filter("kind = 's'").select("lang", "word", F.col("n").alias("k")).join(total, "lang")
    s = s.filter((F.col("k") >= 4) & (F.col("k") >= 2e-5 * F.col("opened"))).join(uses, ["lang", "word"], "left")
    # A starter, as it is written, opens far more of its own uses than a word does by chance; of compounds in lower case, whose uses
    # are not counted, the openings alone speak.
    base = F.least(F.lit(0.5), F.col("opened") / F.greatest("tokens", F.lit(1)))
    n = F.greatest(F.col("k"), F.coalesce("uses", "k"))
    rate = F.least(F.lit(0.999999), F.col("k") / n)
    score = F.when(rate > base, 2 * (_llr(F.col("k"), n, rate) - _llr(F.col("k"), n, base)))
    opening = s.filter(score > STARTER).select("lang", "word").collect()
    starters = F.broadcast(spark.createDataFrame(opening, "lang string, word string"))
    with_ = counts.filter("kind = 'p'")
    known = starters.withColumn("starts", F.lit(1)).withColumnRenamed("word", "next")
    with_ = with_.join(known, ["lang", "next"], "left")
    inside = F.when((F.length("next") == 0) | F.col("starts").isNotNull() | F.col("next").isin("\n", "\r"), 0).otherwise(F.col("n"))
    p = with_.groupBy("lang", "word").agg(F.sum("n").alias("p"), F.sum(inside).alias("inside"))
    w = counts.filter("kind = 'w'").filter(F.length("word") <= LETTERS + 4).select("lang", "word", F.col("n").alias("w"))
    periods = with_.groupBy("lang").agg(F.sum("n").alias("periods"))
    joined = p.join(w, ["lang", "word"], "left").na.fill(0, ["w"]).join(periods, "lang").join(total, "lang")
    n = F.greatest("p", "w")
    chance = F.least(F.lit(0.5), F.greatest(F.lit(1e-6), F.col("periods") / F.greatest("tokens", F.lit(1))))
    ratio = 2 * (_llr(F.col("p"), n, F.lit(0.99)) - _llr(F.col("p"), n, chance))
    letters = F.length(F.regexp_replace("word", r"\.", ""))
    dots = F.length("word") - letters
    likely = (ratio * F.exp(-letters) * (dots + 1) > ABBREVIATION) & (F.col("inside") >= 0.4 * F.col("p"))
    # A short word that hardly ever closes a sentence where it has its period, though it may be a word without.
    never = (letters <= 4) & (F.col("inside") >= 0.9 * F.col("p")) & (F.col("p") >= 0.05 * F.col("w"))
    good = (F.col("p") >= OFTEN) & (likely | never)
    # A collocate follows a number and its period in more of its uses than numbers are of all tokens.
    o = counts.filter("kind = 'o'").filter(F.col("n") >= OFTEN).select("lang", "word", F.col("n").alias("k")).join(starters, ["lang", "word"], "left_anti")
    o = o.join(uses, ["lang", "word"], "left").join(total, "lang")
    k, a, b, every = F.col("k"), F.col("numbers"), F.greatest("k", F.coalesce("uses", "k")), F.col("tokens") + F.col("numbers")
    alone = _llr(k, a, b / every) + _llr(b - k, every - a, b / every)
    tied = 2 * (_llr(k, a, k / a) + _llr(b - k, every - a, (b - k) / (every - a)) - alone)
    collocates = o.filter((k / b > a / every) & (tied >= COLLOCATION)).select("lang", "word")
    model = Model({}, {})
    for r in joined.filter(good).select("lang", "word").collect():
        model.abbreviations.setdefault(r.lang, set()).add(r.word)
    for r in opening:
        model.starters.setdefault(r.lang, set()).add(r.word)
    for r in collocates.collect():
        # An abbreviation or an initial is no whole word: a title after a number begins a sentence as any name does.
        if len(r.word) > 1 and r.word.lower() not in model.abbreviations.get(r.lang, ()):
            model.collocates.setdefault(r.lang, set()).add(r.word)
    return model


def _protected(text: str, a: int, b: int) -> list[tuple[int, int]]:
    """Outermost quotations and brackets of a segment, closed ones only."""
    out, stack = [], []
    for m in MARKED.finditer(text, a, b):
        c, i = m.group(), m.start()
        k = next((k for k in range(len(stack) - 1, -1, -1) if c in stack[k][0]), None)
        if k is not None:
            start = stack[k][1]
            del stack[k:]
            out.append((start, i + 1))
        elif c == '"':
            stack.append(('"', i))
        elif c in PAIRS:
            stack.append((PAIRS[c], i))
    out.sort(key=lambda x: (x[0], -x[1]))
    top, last = [], -1
    for s, e in out:
        if s >= last:
            top.append((s, e))
            last = e
    return top


def _split_segment(text: str, a: int, b: int, body: int, model: Model) -> list[int]:
    """Ends of the sentences inside text[a:b], without b itself."""
    part = text[body:b]
    plain = part.isascii()
    if not plain and SCRIPTS[0][1].search(part) and THAI_GAP.search(part):
        gaps = {body + m.start(): body + m.end() for m in THAI_GAP.finditer(part)}
    else:
        gaps = {}
    marks = list(MARK.finditer(text, body, b))
    if not marks and not gaps:
        return []
    spans = _protected(text, body, b) if MARKED.search(text, body, b) else []
    lang = None  # not looked for where the only mark ends the segment
    ends: list[int] = []
    last, k = body, 0
    for g, e in gaps.items():
        if not any(s <= g < t for s, t in spans):
            ends.append(g)
    for m in marks:
        p, q = m.span()
        if p < last:
            continue
        while k < len(spans) and spans[k][1] <= p:
            k += 1
        quoted = None
        if k < len(spans) and spans[k][0] <= p:
            s, e = spans[k]
            if text[q : e - 1].strip(" \t\r\n\xa0 " + CLOSERS):
                continue
            quoted, q = s, e
        else:
            while q < b and text[q] in "”’»)]」』）】" and not (k < len(spans) and spans[k][0] == q):
                q += 1
        n = q
        while n < b and text[n].isspace():
            n += 1
        if n >= b:
            break
        if quoted is None and n > q and text[n].islower():
            continue
        if lang is None:
            lang = language(part)
            abbreviations, starters = model.abbreviations.get(lang, frozenset()), model.starters.get(lang, frozenset())
            collocates = model.collocates.get(lang, frozenset())
            english = model.abbreviations.get("en", frozenset()) if lang in ("zh", "ja", "th", "hi") else frozenset()
        if m.group() == "." and quoted is None and text[n].isalnum():
            good = _dot_ends(text, p, n, b, last, lang, abbreviations, starters, collocates, english, n > q, False)
        else:
            good = _is_end(text, p, m.group(), q, n, b, quoted, last, lang, abbreviations, starters, collocates, english)
        if good:
            ends.append(q)
            last = q
    return sorted(set(ends))


def _is_end(text, p, mark, q, n, b, quoted, last, lang, abbreviations, starters, collocates, english) -> bool:
    """Whether a sentence ends at a mark other than a period before a letter or digit, which is for _dot_ends()."""
    c = text[n]
    gap = n > q
    opening = c in "\"“„«‹「『（([【¿¡‘《"
    inner = c
    if opening:
        k = n
        while k < b and (text[k] in "\"“„«‹「『（([【¿¡‘《" or text[k].isspace()):
            k += 1
        inner = text[k] if k < b else ""
        n = k
    cased = inner.isupper() or inner.islower()
    letter = inner.isalpha()
    final = mark[-1]
    wide = any(x in "。！？｡．।॥" for x in mark)
    if quoted is not None:
        if c in ",;:，、；：—–-…" or c in "とって" and text[quoted] in "「『":
            return False
        if cased and not opening:
            return inner.isupper()
        if opening and c not in BRACKETS:
            return True
        if text[quoted] in BRACKETS:
            return not text[last:quoted].strip() and (letter or inner.isdigit())
        before = text[last:quoted].rstrip()
        return before[-1:] in (":", "：", ",", "，")
    if wide:
        return not (c in ",，、")
    if "…" in mark or mark.count(".") > 1 and final == ".":
        if not cased or inner.islower():
            return False
        word = TOKEN.match(text, n)
        return bool(word) and word.group() in starters
    if final in "!?":
        if inner.islower() and (gap or lang != "und"):
            return False
        return c not in ",;:)]—–"
    return _dot_ends(text, p, n, b, last, lang, abbreviations, starters, collocates, english, gap, opening)


def _dot_ends(text, p, n, b, last, lang, abbreviations, starters, collocates, english, gap, opening) -> bool:
    inner = text[n] if n < b else ""
    if inner.islower() or not inner:
        return False
    k = p
    near = text[max(last, p - 40) : p]
    word = near.rsplit(None, 1)[-1] if near and not near[-1].isspace() else ""
    if word and (len(word) == 40 or not word.isalnum()):
        while k > last and not text[k - 1].isspace() and text[k - 1] not in "\"“„«(（「¿¡’'":
            k -= 1
        word = text[k:p]
    low = word.lower()
    known = low in abbreviations or low in english
    if lang in ("hi", "th") and any("\u0900" <= c <= "\u0e7f" for c in word):
        return False
    initial = len(word) == 1 and word.isupper()
    digits = inner.isdigit()
    if not gap:
        if digits or not word or word[-1] not in ")" and not word[-1].isalnum():
            return False
        if inner.isupper():
            nxt = TOKEN.match(text, n)
            title = bool(nxt) and nxt.group().lower() in abbreviations and text[nxt.end() : nxt.end() + 1] == "."
            follows = bool(nxt) and (nxt.group() in starters or opening or title)
            return follows and not known and not initial and len(word) > 1
        return inner.isalpha() and not known and word.isalpha() and word.islower() and len(word) > 2
    if inner.isupper():
        if not known and not initial and word.isalpha():
            return True
        nxt = TOKEN.match(text, n)
        starts = bool(nxt) and nxt.group() in starters
        if known or initial:
            return starts and not (initial and text[nxt.end() : nxt.end() + 1] == ".") if nxt else False
        if nxt and not opening and nxt.group() in collocates and NUMBER.fullmatch(word):
            return False
        if lang == "de" and word.isdigit() and len(word) <= 2:
            return starts or opening
        return True
    if digits:
        return not known and not initial and not (lang == "de" and word.isdigit() and len(word) <= 2)
    if inner.isalpha():
        return not known and not initial and not (word.replace(".", "").isdigit() and lang in ("hi",))
    return False


def units(text: str | None, model: Model) -> list[tuple[int, int]]:
    """Spans of the sentence units."""
    if not text:
        return []
    out = []
    for a, b, body in _segments(text):
        edges = [a, *_split_segment(text, a, b, body, model), b]
        for s, e in zip(edges, edges[1:]):
            while s < e and text[s].isspace():
                s += 1
            while e > s and text[e - 1].isspace():
                e -= 1
            if s < e:
                out.append((s, e))
    return out


def sentences(docs: DataFrame, key: str = "doc_id", text: str = "text", model: Model | None = None) -> DataFrame:
    """(key, start_pos, end_pos) of every sentence unit of every document."""
    model = learn(evidence(docs, text)) if model is None else model

    def run(batches):
        for batch in batches:
            spans = [units(t, model) for t in batch.column(1).to_pylist()]
            counts = [len(s) for s in spans]
            import numpy as np

            which = pa.array(np.repeat(np.arange(len(spans)), counts))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(which), pa.array([x[0] for s in spans for x in s], pa.int64()), pa.array([x[1] for s in spans for x in s], pa.int64())], [key, "start_pos", "end_pos"])

    rows = docs.select(key, text).filter(F.col(text).isNotNull())
    return rows.mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, {UNITS}")
