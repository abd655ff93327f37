"""Table cells, ledgers and their validators."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from folio.functions.numbers import TOTAL, canonical_number, looks_like_date, parse_number
from folio.operators.ledgers import running_balance, totals
from folio.plans.registry import Registry

REG = Registry()
_TABLES = "SELECT DISTINCT doc, page, table_no, rows, n_header, kind FROM page_table WHERE rows IS NOT NULL"
_CELLS = f"""
t AS ({_TABLES}),
r AS (SELECT doc, page, table_no, n_header, rows, unnest(range(len(rows))) AS row_no FROM t),
c AS (SELECT doc, page, table_no, n_header, row_no::INT AS row_no, rows[row_no + 1] AS cells FROM r WHERE rows[row_no + 1] IS NOT NULL),
cell AS (SELECT doc, page, table_no, n_header, row_no, i::INT AS col_no, cells[i + 1] AS cell FROM (SELECT *, unnest(range(len(cells))) AS i FROM c))
"""
_NUMBER = r"""
s1 AS (SELECT *, regexp_replace(regexp_replace(coalesce(cell, ''), '[\s\x{00A0}\x{202F}]', '', 'g'), '/[-=]+$', '') AS a FROM cell),
s2 AS (SELECT *, regexp_matches(a, '(?i).dr\.?$') AS f1, regexp_replace(a, '(?i)(.)[dc]r\.?$', '\1') AS b FROM s1),
s3 AS (SELECT *, regexp_matches(b, '^\(.*\)$') AS f2, CASE WHEN regexp_matches(b, '^\(.*\)$') THEN b[2:-2] ELSE b END AS c FROM s2),
s4 AS (SELECT *, regexp_matches(c, '.-$') AS f3, regexp_replace(c, '(.)-$', '\1') AS d FROM s3),
s5 AS (SELECT *, regexp_matches(d, '^[-−–].') AS f4, regexp_replace(d, '^[-+−–](.)', '\1') AS e FROM s4),
s6 AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(e, '(?i)^(?:rs\.?|inr)([0-9.-])', '\1'), '^[₹$€£¥]+', ''), '/+$', '') AS g FROM s5),
s7 AS (SELECT *, regexp_matches(g, '^[-−–].') AS f5, regexp_replace(g, '^[-−–](.)', '\1') AS h FROM s6),
num AS (SELECT *, CASE WHEN regexp_matches(h, '^([0-9]+(\.[0-9]+)?|\.[0-9]+|[0-9]{1,3}(,[0-9]{3})+(\.[0-9]+)?|[0-9]{1,2}(,[0-9]{2})+,[0-9]{3}(\.[0-9]+)?)$')
  THEN (CASE WHEN (f1::INT + f2::INT + f3::INT + f4::INT + f5::INT) % 2 = 1 THEN -1 ELSE 1 END) * TRY_CAST(replace(h, ',', '') AS DECIMAL(28,10)) END AS number FROM s7)
"""


def distinct_tables(tables):
    """One row for each table; copies once, tables without rows left out."""
    return tables.filter(F.col("rows").isNotNull()).dropDuplicates(["doc", "page", "table_no"]).select("doc", "page", "table_no", "rows", "n_header", "kind")


def cells(tables):
    rows = distinct_tables(tables).select("doc", "page", "table_no", "n_header", F.posexplode("rows").alias("row_no", "cells")).filter(F.col("cells").isNotNull())
    return rows.select("doc", "page", "table_no", "n_header", "row_no", F.posexplode("cells").alias("col_no", "cell"))


@REG.query("page_table", sql=f"WITH {_CELLS}, {_NUMBER} SELECT doc, page, table_no, row_no, col_no, number::DOUBLE AS number FROM num WHERE number IS NOT NULL")
def number_cells(tables):
    return cells(tables).withColumn("number", parse_number(F.col("cell")).cast("double")).filter("number IS NOT NULL").select("doc", "page", "table_no", "row_no", "col_no", "number")


@REG.query("page_table", sql=rf"""WITH {_CELLS}, {_NUMBER} SELECT doc, page, table_no, row_no, col_no,
  coalesce(regexp_replace(number::VARCHAR, '\.?0+$', ''), lower(trim(regexp_replace(coalesce(cell, ''), '\s+', ' ', 'g')))) AS canonical FROM num""")
def canonical_cells(tables):
    return cells(tables).select("doc", "page", "table_no", "row_no", "col_no", canonical_number(F.col("cell")).alias("canonical"))


@REG.query("page_table", sql=rf"""WITH {_CELLS} SELECT doc, page, table_no, row_no, col_no, cell FROM cell WHERE regexp_matches(trim(cell),
 '^([0-9]{{1,2}}[-/. ][0-9]{{1,2}}[-/. ][0-9]{{2,4}}|[0-9]{{4}}[-/.][0-9]{{1,2}}[-/.][0-9]{{1,2}}|[0-9]{{1,2}}[- /]?[A-Za-z]{{3,9}}[- /,]*[0-9]{{2,4}}|[A-Za-z]{{3,9}}[- /.][0-9]{{1,2}}[, -]+[0-9]{{2,4}})$')""")
def date_cells(tables):
    return cells(tables).filter(looks_like_date(F.col("cell"))).select("doc", "page", "table_no", "row_no", "col_no", "cell")


@REG.query("page_table", sql=f"""WITH t AS ({_TABLES}) SELECT doc, page, table_no,
  array_to_string(list_filter(flatten(list_filter(rows, lambda r: r IS NOT NULL)), lambda c: c IS NOT NULL), ' ') AS text FROM t""")
def table_text(tables):
    flat = F.filter(F.flatten(F.filter("rows", lambda r: r.isNotNull())), lambda c: c.isNotNull())
    return distinct_tables(tables).select("doc", "page", "table_no", F.array_join(flat, " ").alias("text"))


@REG.query("page_table", sql=rf"""WITH t AS ({_TABLES}) SELECT doc, page, table_no,
  array_to_string(list_transform(list_filter(rows, lambda r: r IS NOT NULL), lambda r: '| ' || array_to_string(list_transform(r, lambda c: replace(coalesce(c, ''), '|', '\|')), ' | ') || ' |'), chr(10)) AS md FROM t""")
def table_markdown(tables):
    row = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|"))), " | "), F.lit(" |"))
    return distinct_tables(tables).select("doc", "page", "table_no", F.array_join(F.transform(F.filter("rows", lambda r: r.isNotNull()), row), "\n").alias("md"))


#: First role whose pattern a header cell matches. Fixed values.
ROLES = (("balance", r"(?i)\bbal(ance)?\b"), ("debit", r"(?i)\bdebits?\b|withdraw|\bpayments?\b"), ("credit", r"(?i)\bcredits?\b|deposit|\breceipts?\b"), ("amount", r"(?i)\bamount\b"), ("ref", r"(?i)\bche?q|\bref(erence)?\b"))
_ROLE_SQL = "CASE " + " ".join(f"WHEN regexp_matches(cell, '{p}') THEN '{n}'" for n, p in ROLES) + " END"


@REG.query("page_table", sql=f"WITH {_CELLS} SELECT doc, page, table_no, col_no, {_ROLE_SQL} AS role FROM cell WHERE row_no = coalesce(n_header, 1) - 1 AND {_ROLE_SQL} IS NOT NULL")
def column_roles(tables):
    role = F.coalesce(*(F.when(F.col("cell").rlike(p), n) for n, p in ROLES))
    return cells(tables).filter("row_no = coalesce(n_header, 1) - 1").withColumn("role", role).filter("role IS NOT NULL").select("doc", "page", "table_no", "col_no", "role")


@REG.query("page_table", sql=f"""WITH t AS ({_TABLES}), w AS (SELECT doc, page, table_no, n_header, list_filter(rows, lambda r: r IS NOT NULL) AS rs FROM t)
SELECT doc, page, table_no, len(rs)::INT AS n_rows, coalesce(list_max(list_transform(rs, lambda r: len(r))), 0)::INT AS width,
  coalesce(list_max(list_transform(rs, lambda r: len(r))) <> list_min(list_transform(rs, lambda r: len(r))), false) AS ragged,
  round(len(list_filter(flatten(rs), lambda c: c IS NULL OR trim(c) = '')) / nullif(len(flatten(rs)), 0), 6) AS empty_share, coalesce(n_header, 0) = 0 AS headless FROM w""")
def table_shape(tables):
    rs = F.filter("rows", lambda r: r.isNotNull())
    widths = F.transform("rs", lambda r: F.size(r))
    flat = F.flatten("rs")
    return distinct_tables(tables).withColumn("rs", rs).select(
        "doc", "page", "table_no", F.size("rs").alias("n_rows"), F.coalesce(F.array_max(widths), F.lit(0)).alias("width"), F.coalesce(F.array_max(widths) != F.array_min(widths), F.lit(False)).alias("ragged"),
        F.round(F.try_divide(F.size(F.filter(flat, lambda c: c.isNull() | (F.trim(c) == ""))), F.size(flat)), 6).alias("empty_share"), (F.coalesce("n_header", F.lit(0)) == 0).alias("headless"),
    )


@REG.query("page_table", sql=rf"""WITH {_CELLS}, b AS (SELECT doc, page, table_no, col_no, trim(cell) AS cell FROM cell WHERE row_no >= coalesce(n_header, 1) AND trim(cell) <> ''),
 k AS (SELECT doc, page, table_no, col_no, count(*)::BIGINT AS filled, count(CASE WHEN regexp_full_match(cell, '[-+(]?[0-9,.\s]+\)?%?') THEN 1 END)::BIGINT AS numeric_,
  count(CASE WHEN regexp_full_match(cell, '[0-9,.\s]*[A-Za-z][A-Za-z0-9_,.\s]*') AND regexp_matches(cell, '[0-9]') AND length(cell) <= 12 THEN 1 END)::BIGINT AS mixed FROM b GROUP BY ALL)
SELECT doc, page, table_no, col_no, filled, numeric_, mixed, filled >= 3 AND numeric_ >= 0.6::DOUBLE * filled AND mixed > 0 AS suspect FROM k""")
def column_types(tables):
    body = cells(tables).filter("row_no >= coalesce(n_header, 1)").withColumn("cell", F.trim("cell")).filter("cell <> ''")
    numeric = F.col("cell").rlike(r"^[-+(]?[0-9,.\s]+\)?%?$")
    mixed = F.col("cell").rlike(r"^[0-9,.\s]*[A-Za-z][A-Za-z0-9_,.\s]*$") & F.col("cell").rlike("[0-9]") & (F.length("cell") <= 12)
    k = body.groupBy("doc", "page", "table_no", "col_no").agg(F.count("*").alias("filled"), F.count_if(numeric).alias("numeric_"), F.count_if(mixed).alias("mixed"))
    return k.withColumn("suspect", (F.col("filled") >= 3) & (F.col("numeric_") >= 0.6 * F.col("filled")) & (F.col("mixed") > 0))


def order_ledger(orders):
    """A ledger per customer from orders: every price a debit or credit, every seventh balance damaged, every eleventh missing."""
    w = Window.partitionBy("account").orderBy("line")
    rows = orders.select(F.col("o_custkey").alias("account"), F.col("o_orderkey").alias("line"), F.col("o_totalprice").cast("decimal(18,2)").alias("amount"), (F.col("o_orderkey") % 2 == 0).alias("credit"))
    signed = F.when(F.col("credit"), F.col("amount")).otherwise(-F.col("amount"))
    total = F.sum(signed).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("decimal(28,2)")
    damaged = F.when(F.col("line") % 7 == 0, total + F.lit(1)).when(F.col("line") % 11 == 0, F.lit(None)).otherwise(total)
    return rows.select("account", "line", F.when(~F.col("credit"), F.col("amount")).alias("debit"), F.when(F.col("credit"), F.col("amount")).alias("credit"), damaged.cast("decimal(28,2)").alias("balance"))


_LEDGER = """
o AS (SELECT o_custkey AS account, o_orderkey AS line, o_totalprice::DECIMAL(18,2) AS amount, o_orderkey % 2 = 0 AS is_credit FROM orders),
r AS (SELECT *, sum(CASE WHEN is_credit THEN amount ELSE -amount END) OVER (PARTITION BY account ORDER BY line) AS total FROM o),
l AS (SELECT account, line, CASE WHEN NOT is_credit THEN amount END AS debit, CASE WHEN is_credit THEN amount END AS credit,
  CASE WHEN line % 7 = 0 THEN total + 1 WHEN line % 11 = 0 THEN NULL ELSE total END AS balance FROM r)
"""


@REG.query("orders", sql=f"""WITH {_LEDGER},
c AS (SELECT *, lag(balance) OVER (PARTITION BY account ORDER BY line) AS prev FROM l),
k AS (SELECT account, line, balance, prev + coalesce(credit, 0) - coalesce(debit, 0) AS expected, balance IS NOT NULL AND prev IS NOT NULL AS checked,
  coalesce(abs(prev + coalesce(credit, 0) - coalesce(debit, 0) - balance) > 0.011, false) AS fails FROM c),
n AS (SELECT *, coalesce(lag(fails) OVER w, false) AS before, coalesce(lead(fails) OVER w, false) AS after FROM k WINDOW w AS (PARTITION BY account ORDER BY line))
SELECT account, line, balance::DOUBLE AS found, expected::DOUBLE AS expected, CASE WHEN after AND NOT before THEN 'balance' ELSE 'amount' END AS role FROM n WHERE fails AND (NOT before)""")
def balance_violations(orders):
    return running_balance(order_ledger(orders), "account", "line")


@REG.query("lineitem", sql="""
WITH l AS (SELECT l_orderkey AS sheet, l_linenumber AS row_no, 'item' AS label, l_extendedprice::DECIMAL(18,2) AS value FROM lineitem),
t AS (SELECT sheet, max(row_no) + 1 AS row_no, 'Total' AS label, CASE WHEN sheet % 5 = 0 THEN sum(value) + 3 ELSE sum(value) END AS value FROM l GROUP BY sheet),
n AS (SELECT sheet, count(*) AS rows_, sum(value) AS added FROM l GROUP BY sheet)
SELECT sheet, n.rows_::BIGINT AS n_rows, added::DOUBLE AS expected, value::DOUBLE AS found, abs(added - value) <= 0.011 AS ok FROM t JOIN n USING (sheet) WHERE n.rows_ >= 2""")
def totals_check(items):
    """Each order is a sheet whose last row is a total, wrong in every fifth."""
    rows = items.select(F.col("l_orderkey").alias("sheet"), F.col("l_linenumber").cast("long").alias("row_no"), F.lit("item").alias("label"), F.col("l_extendedprice").cast("decimal(18,2)").alias("value"))
    sums = rows.groupBy("sheet").agg((F.max("row_no") + 1).alias("row_no"), F.lit("Total").alias("label"), F.sum("value").alias("v"))
    closing = sums.select("sheet", "row_no", "label", F.when(F.col("sheet") % 5 == 0, F.col("v") + 3).otherwise(F.col("v")).cast("decimal(28,2)").alias("value"))
    return totals(rows.unionByName(closing), "sheet", "row_no", TOTAL)


QUERIES, SQL = REG.queries, REG.sql
