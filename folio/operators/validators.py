"""Validators over the cells of parsed tables: stacked headers, repeated rows, layout, running balances, totals.

Input are cells (doc, page, table_no, n_header, row_no, col_no, cell, number), number being the parsed cell. A table's body begins
after its stacked header. Null cells are empty cells; tables without cells have no findings.
"""

from __future__ import annotations

import re
from collections import Counter
from decimal import ROUND_HALF_UP, Context, Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from folio.functions.numbers import DATE, FIGURE, TOTAL, canonical_number, looks_like_date, parse_number
from folio.operators.ledgers import TOLERANCE

TABLE = ("doc", "page", "table_no")
#: An amount as statements print it, and the suffix of balances. Fixed values.
MONEY, SUFFIX = r"[0-9][0-9,]*\.[0-9]{2}\b", r"(?i)\b(dr|cr)\.?\s*$"
#: Rows of titles below the header at most, rows of a body that layout is judged by at least.
STACKED, LEAST_BODY = 3, 4


def numbered(cells: DataFrame) -> DataFrame:
    return cells.withColumn("number", parse_number(F.col("cell")))


def money(cells: DataFrame) -> Column:
    return F.coalesce(F.col("cell").rlike(MONEY), F.lit(False)) & F.col("number").isNotNull()


def header_rows(cells: DataFrame) -> DataFrame:
    """(doc, page, table_no, k): leading rows that are titles: the header and up to STACKED rows of text without numbers and dates below it."""
    blank = F.trim(F.coalesce("cell", F.lit(""))) == ""
    rows = cells.groupBy(*TABLE, "row_no").agg(F.greatest(F.max(F.coalesce("n_header", F.lit(1))), F.lit(1)).alias("n"), (F.bool_or(~blank) & ~F.bool_or(F.col("number").isNotNull() | looks_like_date(F.col("cell")))).alias("titles"))
    stop = F.min(F.when((F.col("row_no") >= F.col("n")) & ~F.col("titles"), F.col("row_no")))
    return rows.groupBy(*TABLE).agg(F.least(F.coalesce(stop, F.max("row_no") + 1), F.max("n") + STACKED, F.max("row_no") + 1).alias("k"))


def stacked_headers(cells: DataFrame) -> DataFrame:
    """(doc, page, table_no, col_no, title): the titles of each column over the stacked rows, blanks left out."""
    rows = cells.join(header_rows(cells), list(TABLE)).filter(F.col("row_no") < F.col("k")).withColumn("t", F.trim(F.coalesce("cell", F.lit("")))).filter("t <> ''")
    ordered = F.array_sort(F.collect_list(F.struct("row_no", "t")))
    return rows.groupBy(*TABLE, "col_no").agg(F.array_join(F.transform(ordered, lambda x: x.t), " ").alias("title"))


def body(cells: DataFrame) -> DataFrame:
    return cells.join(header_rows(cells), list(TABLE)).filter(F.col("row_no") >= F.col("k"))


def repeated_rows(cells: DataFrame) -> DataFrame:
    """(doc, page, table_no, row_no): rows with two numbers or more that repeat the row before but for the first column."""
    tail = F.array_sort(F.collect_list(F.when(F.col("col_no") > 0, F.struct("col_no", F.coalesce("cell", F.lit("")).alias("c")))))
    rows = cells.groupBy(*TABLE, "row_no").agg(F.count("number").alias("numbers"), tail.alias("tail"))
    before = F.lag("tail").over(Window.partitionBy(*TABLE).orderBy("row_no"))
    return rows.withColumn("same", before == F.col("tail")).filter("same AND numbers >= 2").select(*TABLE, "row_no")


def roles(cells: DataFrame, patterns) -> DataFrame:
    """(doc, page, table_no, col_no, role) by the stacked titles; the first pattern that a title matches counts."""
    role = F.coalesce(*(F.when(F.col("title").rlike(p), n) for n, p in patterns))
    return stacked_headers(cells).select(*TABLE, "col_no", role.alias("role")).filter("role IS NOT NULL")


def layout_problems(cells: DataFrame, patterns) -> DataFrame:
    """(doc, page, table_no, problem): the first thing that is wrong with the columns of a table of LEAST_BODY rows or more.

    balance_empty: of rows with two numbers, under half have one in the only balance column. repeated_rows. same_amount: most rows
    with three amounts have the same one three times. ref_amounts, suffix_amounts: amounts in the reference column, balances in
    a column of amounts.
    """
    inside = body(cells).join(roles(cells, patterns), [*TABLE, "col_no"], "left").withColumn("money", money(cells))
    in_row = F.count("number").over(Window.partitionBy(*TABLE, "row_no"))
    inside = inside.withColumn("numbers", in_row)
    is_role = lambda *r: F.col("role").isin(*r)
    sizes = inside.groupBy(*TABLE).agg(
        F.count_distinct("row_no").alias("rows"), F.count_distinct(F.when(is_role("balance"), F.col("col_no"))).alias("balances"), F.coalesce(F.bool_or(is_role("debit", "credit", "amount")), F.lit(False)).alias("amounts"),
        F.count_distinct(F.when(F.col("numbers") >= 2, F.col("row_no"))).alias("used"), F.count_if(is_role("balance") & (F.col("numbers") >= 2) & F.col("number").isNotNull()).alias("with_balance"),
    )
    columns = inside.filter("role IS NOT NULL AND role <> 'balance'").groupBy(*TABLE, "col_no", "role").agg(F.count_if("money").alias("n"), F.count_if(F.col("money") & F.col("cell").rlike(SUFFIX)).alias("suffixed"))
    columns = columns.groupBy(*TABLE).agg(F.max(F.when(is_role("ref"), F.col("n"))).alias("ref"), F.max(F.when(~is_role("ref"), F.col("suffixed"))).alias("suffixed"))
    amounts = inside.filter("money").groupBy(*TABLE, "row_no", canonical_number(F.col("cell")).alias("c")).agg(F.count("*").alias("n"))
    amounts = amounts.groupBy(*TABLE, "row_no").agg(F.sum("n").alias("n"), F.max("n").alias("most")).filter("n >= 3")
    amounts = amounts.groupBy(*TABLE).agg(F.count("*").alias("three"), F.count_if(F.col("most") >= 3).alias("same"))
    again = body(cells).join(repeated_rows(cells), [*TABLE, "row_no"], "left_semi").select(*TABLE).distinct().withColumn("again", F.lit(True))
    all_ = sizes.join(columns, list(TABLE), "left").join(amounts, list(TABLE), "left").join(again, list(TABLE), "left")
    enough = lambda n, share, of: n >= F.greatest(F.lit(3.0), share * of)
    problem = (
        F.when((F.col("balances") == 1) & F.col("amounts") & (F.col("used") >= 4) & (F.col("with_balance") < 0.5 * F.col("used")), "balance_empty")
        .when(F.col("again"), "repeated_rows").when((F.col("three") >= 3) & enough(F.col("same"), 0.5, F.col("three")), "same_amount")
        .when(enough(F.col("ref"), 0.6, F.col("rows")), "ref_amounts").when(enough(F.col("suffixed"), 0.5, F.col("rows")), "suffix_amounts")
    )
    return all_.filter(F.col("rows") >= LEAST_BODY).select(*TABLE, problem.alias("problem")).filter("problem IS NOT NULL")


def balance_breaks(cells: DataFrame, patterns) -> DataFrame:
    """(doc, page, table_no, row_no, found, expected, direction): body rows whose balance does not follow from the neighbour's.

    A statement runs down, or up with the newest row first: the direction with fewer breaks counts, down where both have as many.
    Only tables with one balance column and one debit or credit column at most each; a blank balance breaks the chain.
    """
    role = roles(cells, patterns).filter(F.col("role").isin("balance", "debit", "credit"))
    many = lambda *r: F.count_if(F.col("role").isin(*r))
    one = role.groupBy(*TABLE).agg(many("balance").alias("b"), many("debit").alias("d"), many("credit").alias("c"))
    one = one.filter("b = 1 AND d <= 1 AND c <= 1 AND d + c >= 1").select(*TABLE)
    of = lambda r: F.max(F.when(F.col("role") == r, F.col("number"))).alias(r)
    rows = body(cells).join(one, list(TABLE), "left_semi").join(role, [*TABLE, "col_no"], "left").groupBy(*TABLE, "row_no").agg(of("balance"), of("debit"), of("credit"))
    w = Window.partitionBy(*TABLE).orderBy("row_no")
    zero = F.lit(0).cast("decimal(38,10)")
    moved = F.coalesce("credit", zero) - F.coalesce("debit", zero)
    wrong = lambda e: F.coalesce(F.abs(e - F.col("balance")) > TOLERANCE, F.lit(False))
    rows = rows.withColumn("down", F.lag("balance").over(w) + moved).withColumn("up", F.lead("balance").over(w) + moved)
    rows = rows.withColumn("bad_down", wrong(F.col("down"))).withColumn("bad_up", wrong(F.col("up")))
    whole = Window.partitionBy(*TABLE)
    rows = rows.withColumn("is_down", F.count_if("bad_down").over(whole) <= F.count_if("bad_up").over(whole))
    bad = rows.filter(F.when(F.col("is_down"), F.col("bad_down")).otherwise(F.col("bad_up")))
    return bad.select(*TABLE, "row_no", F.col("balance").cast("double").alias("found"), F.when(F.col("is_down"), F.col("down")).otherwise(F.col("up")).cast("double").alias("expected"), F.when(F.col("is_down"), "down").otherwise("up").alias("direction"))


def column_totals(cells: DataFrame) -> DataFrame:
    """(doc, page, table_no, col_no, found, expected, ok): the last total row against the rows since the total before it.

    Columns count whose filled body cells outside total rows are numbers to 70 %, with two rows or more in the block.
    """
    inside = body(cells)
    total = F.coalesce(F.bool_or(F.col("cell").rlike(TOTAL)).over(Window.partitionBy(*TABLE, "row_no")), F.lit(False))
    inside = inside.withColumn("total", total)
    w = Window.partitionBy(*TABLE, "col_no").orderBy("row_no")
    inside = inside.withColumn("block", F.coalesce(F.sum(F.col("total").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    filled = F.trim(F.coalesce("cell", F.lit(""))) != ""
    share = Window.partitionBy(*TABLE, "col_no")
    numeric = F.count_if(~F.col("total") & F.col("number").isNotNull()).over(share) >= 0.7 * F.count_if(~F.col("total") & filled).over(share)
    inside = inside.withColumn("numeric", numeric).filter("numeric")
    blocks = inside.groupBy(*TABLE, "col_no", "block").agg(F.max(F.when(F.col("total"), F.col("number"))).alias("found"), F.sum(F.when(~F.col("total"), F.col("number"))).alias("expected"), F.count(F.when(~F.col("total"), F.col("number"))).alias("n"))
    last = blocks.filter("found IS NOT NULL").groupBy(*TABLE, "col_no").agg(F.max_by(F.struct("found", "expected", "n"), "block").alias("m")).select(*TABLE, "col_no", "m.*").filter("n >= 2")
    return last.select(*TABLE, "col_no", F.col("found").cast("double").alias("found"), F.col("expected").cast("double").alias("expected"), (F.abs(F.col("found") - F.col("expected")) <= TOLERANCE).alias("ok"))


def findings(cells: DataFrame, patterns) -> DataFrame:
    """(doc, page, layout, running_balance, totals): what the validators find on each page that has tables."""
    a = layout_problems(cells, patterns).select("doc", "page", F.lit("layout").alias("k"))
    b = balance_breaks(cells, patterns).select("doc", "page", F.lit("running_balance").alias("k"))
    c = column_totals(cells).filter("NOT ok").select("doc", "page", F.lit("totals").alias("k"))
    has = lambda k: F.bool_or(F.col("k") == k).alias(k)
    return a.unionByName(b).unionByName(c).groupBy("doc", "page").agg(has("layout"), has("running_balance"), has("totals"))


# ── all findings of a table at once ──────────────────────────────────────────────────────
# The validators above are one query each and may shuffle cells as they need. A gate wants all their answers and nothing else of a
# table, whose rows stand together anyway: read whole, it needs no join of cells, and the plan stays small however many validators there are.

FLAGS = ("ragged", "blank_table", "column_types", "layout", "running_balance", "totals")


def _pattern(regex: str) -> re.Pattern:
    """A pattern of the column builders: signs of ASCII only, and $ is the end, not a line feed before it."""
    return re.compile(re.sub(r"(?<!\\)\$$|(?<!\\)\$(?=\))", r"\\Z", regex), re.A)


_WHITE, _CLOSING, _DR, _DR_CR = re.compile("[\\s\u00a0\u202f]", re.A), re.compile(r"/[-=]+\Z"), re.compile(r"(?i).dr\.?\Z", re.A), re.compile(r"(?i)(?<=.)[dc]r\.?\Z", re.A)
_CURRENCY, _SIGNS, _DIGIT = re.compile(r"(?i)^(?:rs\.?|inr)(?=[0-9.-])", re.A), re.compile(r"^[₹$€£¥]+"), re.compile("[0-9]")
_FIGURE, _DATE, _TOTAL, _MONEY, _SUFFIX = map(_pattern, (FIGURE, DATE, TOTAL, MONEY, SUFFIX))
_NUMERIC, _MIXED = re.compile(r"[-+(]?[0-9,.\s]+\)?%?", re.A), re.compile(r"[0-9,.\s]*[A-Za-z][A-Za-z0-9_,.\s]*", re.A)
_EXACT, _TENTH, _MOST = Context(prec=200, rounding=ROUND_HALF_UP), Decimal("1e-10"), Decimal(10) ** 28


def number(cell: str | None) -> Decimal | None:
    """parse_number() of one cell."""
    if not cell or not _DIGIT.search(cell):
        return None
    s = _CLOSING.sub("", _WHITE.sub("", cell))
    flips = bool(_DR.search(s))
    s = _DR_CR.sub("", s)
    if len(s) > 1 and s[0] == "(" and s[-1] == ")":
        s, flips = s[1:-1], not flips
    if len(s) > 1 and s[-1] == "-":
        s, flips = s[:-1], not flips
    if len(s) > 1 and s[0] in "-+−–":
        s, flips = s[1:], flips ^ (s[0] != "+")
    s = _SIGNS.sub("", _CURRENCY.sub("", s)).rstrip("/")
    if len(s) > 1 and s[0] in "-−–":
        s, flips = s[1:], not flips
    if not _FIGURE.search(s):
        return None
    plain = s.replace(",", "")
    # More digits than the type has: no number. Far more would not fit the context either.
    if len(plain.partition(".")[0].lstrip("0")) > 28:
        return None
    value = Decimal(plain) if len(plain.partition(".")[2]) <= 10 else _EXACT.quantize(Decimal(plain[: plain.index(".") + 60]), _TENTH)
    return None if value >= _MOST else value.copy_negate() if flips else value


def _far(a: Decimal, b: Decimal) -> bool:
    return float(_EXACT.subtract(a, b).copy_abs()) > TOLERANCE


def _header(rows: list, n_header: int | None) -> int:
    n = max(1 if n_header is None else n_header, 1)
    end = rows[-1][0] + 1

    def titles(cells: list, numbers: list) -> bool:
        return any(c and c.strip(" ") for c in cells) and not any(x is not None or c and _DATE.search(c.strip(" ")) for c, x in zip(cells, numbers))

    return min(next((i for i, cells, numbers in rows if i >= n and not titles(cells, numbers)), end), n + STACKED, end)


def _column_roles(rows: list, k: int, patterns: list) -> dict[int, str]:
    titles: dict[int, list[str]] = {}
    for i, cells, _ in rows:
        if i >= k:
            break
        for col, c in enumerate(cells):
            if t := (c or "").strip(" "):
                titles.setdefault(col, []).append(t)
    found = {col: next((name for name, p in patterns if p.search(t)), None) for col, t in ((col, " ".join(ts)) for col, ts in titles.items())}
    return {col: r for col, r in found.items() if r}


def _layout(rows: list, k: int, role: dict[int, str]) -> bool:
    """Whether layout_problems() names one."""
    body_rows = [r for r in rows if r[0] >= k]
    if len(body_rows) < LEAST_BODY:
        return False
    balances, amounts, used, with_balance, three, same = set(), False, 0, 0, 0, 0
    n, suffixed = Counter(), Counter()
    seen: set[int] = set()
    for _, cells, numbers in body_rows:
        many = sum(x is not None for x in numbers) >= 2
        used += many
        values: Counter = Counter()
        for col, (c, x) in enumerate(zip(cells, numbers)):
            r = role.get(col)
            money = x is not None and _MONEY.search(c) is not None
            if money:
                values[x] += 1
            if r == "balance":
                balances.add(col)
                with_balance += many and x is not None
            elif r:
                amounts |= r != "ref"
                seen.add(col)
                if money:
                    n[col] += 1
                    suffixed[col] += _SUFFIX.search(c) is not None
        if values.total() >= 3:
            three += 1
            same += max(values.values()) >= 3
    if len(balances) == 1 and amounts and used >= 4 and with_balance < 0.5 * used:
        return True
    before = None
    for i, cells, numbers in rows:
        tail = [c or "" for c in cells[1:]]
        if i >= k and tail == before and sum(x is not None for x in numbers) >= 2:
            return True
        before = tail
    ref = max((n[col] for col in seen if role[col] == "ref"), default=0)
    suffixes = max((suffixed[col] for col in seen if role[col] != "ref"), default=0)
    enough = lambda count, share, of: count >= max(3.0, share * of)
    return three >= 3 and enough(same, 0.5, three) or enough(ref, 0.6, len(body_rows)) or enough(suffixes, 0.5, len(body_rows))


def _balance_breaks(rows: list, k: int, role: dict[int, str]) -> bool:
    """Whether balance_breaks() has a row: whichever direction counts, it is the one with fewer breaks."""
    of: dict[str, list[int]] = {r: [col for col, x in role.items() if x == r] for r in ("balance", "debit", "credit")}
    if len(of["balance"]) != 1 or len(of["debit"]) > 1 or len(of["credit"]) > 1 or not of["debit"] + of["credit"]:
        return False
    at = lambda r, numbers: next((numbers[col] for col in of[r] if col < len(numbers)), None)
    lines = [(at("balance", x), _EXACT.subtract(at("credit", x) or Decimal(0), at("debit", x) or Decimal(0))) for i, _, x in rows if i >= k]
    broken = lambda before, line: before is not None and line[0] is not None and _far(_EXACT.add(before, line[1]), line[0])
    down = sum(broken(a[0], b) for a, b in zip(lines, lines[1:]))
    up = sum(broken(b[0], a) for a, b in zip(lines, lines[1:]))
    return min(down, up) > 0


def _wrong_totals(rows: list, k: int) -> bool:
    """Whether column_totals() has one that is not ok."""
    # Of each column: filled and numeric cells outside total rows, the sum and count of the block, and its last closed block.
    filled, numeric, block, last = Counter(), Counter(), {}, {}
    for i, cells, numbers in rows:
        if i < k:
            continue
        total = any(c and _TOTAL.search(c) for c in cells)
        for col, (c, x) in enumerate(zip(cells, numbers)):
            if total:
                if x is not None:
                    last[col] = (x, *block.get(col, (Decimal(0), 0)))
                block[col] = (Decimal(0), 0)
            else:
                filled[col] += bool(c and c.strip(" "))
                if x is not None:
                    numeric[col] += 1
                    added, count = block.get(col, (Decimal(0), 0))
                    block[col] = (_EXACT.add(added, x), count + 1)
    return any(count >= 2 and numeric[col] >= 0.7 * filled[col] and _far(found, added) for col, (found, added, count) in last.items())


def _mixed_column(rows: list, n_header: int | None) -> bool:
    """Whether a column of figures has cells that mix letters into them."""
    filled, figures, mixed = Counter(), Counter(), Counter()
    for i, cells, _ in rows:
        if i >= (1 if n_header is None else n_header):
            for col, c in enumerate(cells):
                if t := (c or "").strip(" "):
                    filled[col] += 1
                    figures[col] += _NUMERIC.fullmatch(t) is not None
                    mixed[col] += len(t) <= 12 and _MIXED.fullmatch(t) is not None and _DIGIT.search(t) is not None
    return any(m > 0 and filled[col] >= 3 and figures[col] >= 0.6 * filled[col] for col, m in mixed.items())


def flags(table: list[list[str | None] | None], n_header: int | None, patterns: list) -> tuple[bool, ...]:
    """FLAGS of the rows of one table; patterns are compiled."""
    there = [r for r in table if r is not None]
    widths = {len(r) for r in there}
    blank, size = sum(not (c or "").strip(" ") for r in there for c in r), sum(map(len, there))
    shape = len(widths) > 1, len(there) >= 4 and blank > 0.6 * size
    rows = [(i, r, [number(c) for c in r]) for i, r in enumerate(table) if r]
    if not rows:
        return *shape, False, False, False, False
    k = _header(rows, n_header)
    role = _column_roles(rows, k, patterns)
    return *shape, _mixed_column(rows, n_header), _layout(rows, k, role), _balance_breaks(rows, k, role), _wrong_totals(rows, k)


def page_flags(tables: DataFrame, patterns) -> DataFrame:
    """(doc, page, FLAGS, has_table) of each page that has tables with rows, of (doc, page, rows, n_header); copies change nothing."""
    schema = "doc string, page int, " + ", ".join(f"{f} boolean" for f in FLAGS)

    def run(batches):
        compiled = [(name, _pattern(p)) for name, p in patterns]
        for batch in batches:
            found = [flags(t, n, compiled) for t, n in zip(batch.column("rows").to_pylist(), batch.column("n_header").to_pylist())]
            columns = zip(*found) if found else [[] for _ in FLAGS]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("page"), *(pa.array(list(x), pa.bool_()) for x in columns)], names=["doc", "page", *FLAGS])

    found = tables.filter("rows IS NOT NULL").select("doc", "page", "rows", "n_header").mapInArrow(run, schema)
    return found.groupBy("doc", "page").agg(*(F.bool_or(f).alias(f) for f in FLAGS), F.lit(True).alias("has_table"))
