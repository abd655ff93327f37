"""Column builders over text: tokens, scripts, plausibility. Null in, null or 0 out as each says."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

TOKEN = r"[\p{L}\p{N}_]+(?:[.\-_/:][\p{L}\p{N}_]+)*"
JOINT = r"[.\-_/:]"
#: Letters of each script beside Latin, in the order in which ties are decided. Fixed values.
SCRIPTS = {"Devanagari": r"[\x{0900}-\x{097F}]", "Cyrillic": r"[\x{0400}-\x{04FF}]", "Thai": r"[\x{0E00}-\x{0E7F}]", "Kana": r"[\x{3040}-\x{30FF}]", "Han": r"[\x{4E00}-\x{9FFF}]"}


def tokens(text: Column) -> Column:
    """Lower-case word tokens; a compound stands whole and then in its parts. Null for null."""
    found = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
    return F.flatten(F.transform(found, lambda t: F.when(t.rlike(JOINT), F.concat(F.array(t), F.filter(F.split(t, JOINT), lambda p: p != ""))).otherwise(F.array(t))))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def letters(text: Column) -> Column:
    """Number of letters, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\p{L}")), F.lit(0)).cast("long")


def script_counts(text: Column) -> Column:
    """How many letters there are, of Latin, and of each of SCRIPTS: a struct to be bound as a column before dominant_script() reads it."""
    count = lambda p: F.coalesce(F.regexp_count(text, F.lit(p)), F.lit(0)).cast("long")
    return F.struct(letters(text).alias("letters"), count(r"(?=\p{L})[\x{0000}-\x{024F}]").alias("Latin"), *(count(f"(?=\\p{{L}}){p}").alias(name) for name, p in SCRIPTS.items()))


def dominant_script(counts: Column) -> Column:
    """Of script_counts(): '' under ten letters; the script that most letters beside Latin have where it has a quarter of all; Latin from
    60 %; else Mixed."""
    total = counts["letters"]
    most = F.greatest(*(counts[name] for name in SCRIPTS))
    name = F.coalesce(*(F.when(counts[n] == most, n) for n in SCRIPTS))
    return F.when(total < 10, "").when(most * 4 >= total, name).when(counts["Latin"] * 10 >= total * 6, "Latin").otherwise("Mixed")


def implausible_share(text: Column, long_word: int = 4) -> Column:
    """Share of Latin words that mix letters and digits, have no vowel in four letters or more, or five consonants in a row; null without words."""
    ws = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9\x{00C0}-\x{024F}]*[a-z\x{00C0}-\x{024F}][a-z0-9\x{00C0}-\x{024F}]*"), F.lit(0))
    ws = F.filter(ws, lambda w: F.length(w) >= long_word)
    bad = F.filter(ws, lambda w: w.rlike(r"[0-9]") | ~w.rlike(r"[aeiouy\x{00C0}-\x{024F}]") | w.rlike(r"[bcdfghjklmnpqrstvwxz]{5}"))
    return F.try_divide(F.size(bad), F.size(ws))


def plain(md: Column) -> Column:
    """Text without comments, tags, the commonest entities, separator rows and table bars; white space collapsed."""
    t = F.regexp_replace(md, r"(?s)<!--.*?-->", " ")
    t = F.regexp_replace(t, r"<[^<>]{1,200}>", " ")
    for entity, c in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(c))
    t = F.regexp_replace(t, r"(?m)^[ |:\-]{3,}$", " ")
    t = F.regexp_replace(t, r"[|*`#]", " ")
    return F.trim(F.regexp_replace(t, r"[ \t\r\n]+", " "))
