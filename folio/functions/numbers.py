"""Number and date cells."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Plain, Western-grouped and Indian-grouped figures, and the four written forms of dates. Fixed values.
FIGURE = r"^([0-9]+(\.[0-9]+)?|\.[0-9]+|[0-9]{1,3}(,[0-9]{3})+(\.[0-9]+)?|[0-9]{1,2}(,[0-9]{2})+,[0-9]{3}(\.[0-9]+)?)$"
DATE = r"^([0-9]{1,2}[-/. ][0-9]{1,2}[-/. ][0-9]{2,4}|[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}[- /]?[A-Za-z]{3,9}[- /,]*[0-9]{2,4}|[A-Za-z]{3,9}[- /.][0-9]{1,2}[, -]+[0-9]{2,4})$"
TOTAL = r"(?i)^\s*((grand\s+|sub[\s-]?|net\s+)?total\b|total\s*[:(])"


def _stripped(cell: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.coalesce(cell, F.lit("")), r"[\s\x{00A0}\x{202F}]", ""), r"/[-=]+$", "")


def parse_number(cell: Column) -> Column:
    """The number of a cell that is nothing else, as DECIMAL(38,10): grouping, currency, parentheses, trailing minus and Dr negative; else null."""
    s = _stripped(cell)
    debit = s.rlike(r"(?i).dr\.?$")
    s = F.regexp_replace(s, r"(?i)(?<=.)[dc]r\.?$", "")
    paren = s.rlike(r"^\(.*\)$")
    s = F.when(paren, F.regexp_replace(s, r"^\(|\)$", "")).otherwise(s)
    trailing = s.rlike(r".-$")
    s = F.regexp_replace(s, r"(?<=.)-$", "")
    leading = s.rlike(r"^[-−–].")
    s = F.regexp_replace(s, r"^[-+−–](?=.)", "")
    s = F.regexp_replace(s, r"(?i)^(rs\.?|inr)(?=[0-9.-])", "")
    s = F.regexp_replace(F.regexp_replace(s, "^[₹$€£¥]+", ""), "/+$", "")
    inner = s.rlike(r"^[-−–].")
    s = F.regexp_replace(s, r"^[-−–](?=.)", "")
    flips = sum(c.cast("int") for c in (debit, paren, trailing, leading, inner))
    value = F.replace(s, F.lit(","), F.lit("")).try_cast("decimal(38,10)")
    return F.when(s.rlike(FIGURE), F.when(flips % 2 == 1, -value).otherwise(value))


def looks_like_date(cell: Column) -> Column:
    return F.coalesce(F.trim(cell).rlike(DATE), F.lit(False))


def canonical_number(cell: Column) -> Column:
    """Canonical text: the number without closing zeros, else the trimmed lower-case text."""
    n = parse_number(cell)
    return F.coalesce(F.regexp_replace(n.cast("string"), r"\.?0+$", ""), F.lower(F.trim(F.regexp_replace(F.coalesce(cell, F.lit("")), r"\s+", " "))))


def nearest_rank(values: Column, p: float) -> Column:
    """The value at the rounded (half-even) rank p of the sorted values; null for none."""
    at = F.rint(F.lit(p) * (F.size(values) - 1)).cast("int") + 1
    return F.when(F.size(values) > 0, F.try_element_at(F.array_sort(values), at))
