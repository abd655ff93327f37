"""Validators of the parsed tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.operators import validators as V
from folio.plans.registry import Registry
from folio.plans.tables import _CELLS, _NUMBER, ROLES, cells

REG = Registry()
_DATE = r"^([0-9]{1,2}[-/. ][0-9]{1,2}[-/. ][0-9]{2,4}|[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}[- /]?[A-Za-z]{3,9}[- /,]*[0-9]{2,4}|[A-Za-z]{3,9}[- /.][0-9]{1,2}[, -]+[0-9]{2,4})$"
_HEAD = rf"""{_CELLS}, {_NUMBER},
hr AS (SELECT doc, page, table_no, row_no, greatest(max(coalesce(n_header, 1)), 1) AS n, bool_or(trim(coalesce(cell, '')) <> '') AND NOT bool_or(number IS NOT NULL OR coalesce(regexp_matches(trim(cell), '{_DATE}'), false)) AS titles FROM num GROUP BY ALL),
hk AS (SELECT doc, page, table_no, least(coalesce(min(CASE WHEN row_no >= n AND NOT titles THEN row_no END), max(row_no) + 1), max(n) + 3, max(row_no) + 1) AS k FROM hr GROUP BY ALL),
title AS (SELECT doc, page, table_no, col_no, string_agg(trim(cell), ' ' ORDER BY row_no) AS title FROM num JOIN hk USING (doc, page, table_no) WHERE row_no < k AND trim(coalesce(cell, '')) <> '' GROUP BY ALL),
role AS (SELECT * FROM (SELECT doc, page, table_no, col_no, CASE {" ".join(f"WHEN regexp_matches(title, '{p}') THEN '{n}'" for n, p in ROLES)} END AS role FROM title) WHERE role IS NOT NULL),
body AS (SELECT num.*, k FROM num JOIN hk USING (doc, page, table_no) WHERE row_no >= k)
"""
_AGAIN = r"""
rr AS (SELECT doc, page, table_no, row_no, count(number) AS numbers, coalesce(list(coalesce(cell, '') ORDER BY col_no) FILTER (col_no > 0), []) AS tail FROM num GROUP BY ALL),
again AS (SELECT doc, page, table_no, row_no FROM (SELECT *, lag(tail) OVER (PARTITION BY doc, page, table_no ORDER BY row_no) AS b FROM rr) WHERE b = tail AND numbers >= 2)
"""
_LAYOUT = rf"""
i1 AS (SELECT body.*, role, regexp_matches(cell, '[0-9][0-9,]*\.[0-9]{{2}}\b') AND number IS NOT NULL AS money, count(number) OVER (PARTITION BY doc, page, table_no, row_no) AS numbers FROM body LEFT JOIN role USING (doc, page, table_no, col_no)),
sz AS (SELECT doc, page, table_no, count(DISTINCT row_no) AS n_rows, count(DISTINCT CASE WHEN role = 'balance' THEN col_no END) AS balances, coalesce(bool_or(role IN ('debit', 'credit', 'amount')), false) AS amounts,
  count(DISTINCT CASE WHEN numbers >= 2 THEN row_no END) AS used, count(CASE WHEN role = 'balance' AND numbers >= 2 AND number IS NOT NULL THEN 1 END) AS with_balance FROM i1 GROUP BY ALL),
cc AS (SELECT doc, page, table_no, col_no, role, count(CASE WHEN money THEN 1 END) AS n, count(CASE WHEN money AND regexp_matches(cell, '(?i)\b(dr|cr)\.?\s*$') THEN 1 END) AS suffixed FROM i1 WHERE role IS NOT NULL AND role <> 'balance' GROUP BY ALL),
c2 AS (SELECT doc, page, table_no, max(CASE WHEN role = 'ref' THEN n END) AS ref, max(CASE WHEN role <> 'ref' THEN suffixed END) AS suffixed FROM cc GROUP BY ALL),
a1 AS (SELECT doc, page, table_no, row_no, number, count(*) AS n FROM i1 WHERE money GROUP BY ALL),
a2 AS (SELECT doc, page, table_no, row_no, sum(n) AS n, max(n) AS most FROM a1 GROUP BY ALL HAVING sum(n) >= 3),
a3 AS (SELECT doc, page, table_no, count(*) AS three, count(CASE WHEN most >= 3 THEN 1 END) AS same FROM a2 GROUP BY ALL),
ag AS (SELECT DISTINCT doc, page, table_no, true AS again FROM again JOIN hk USING (doc, page, table_no) WHERE row_no >= k),
lay AS (SELECT doc, page, table_no, CASE WHEN balances = 1 AND amounts AND used >= 4 AND with_balance < 0.5::DOUBLE * used THEN 'balance_empty' WHEN again THEN 'repeated_rows'
  WHEN three >= 3 AND same >= greatest(3.0::DOUBLE, 0.5::DOUBLE * three) THEN 'same_amount' WHEN ref >= greatest(3.0::DOUBLE, 0.6::DOUBLE * n_rows) THEN 'ref_amounts' WHEN suffixed >= greatest(3.0::DOUBLE, 0.5::DOUBLE * n_rows) THEN 'suffix_amounts' END AS problem
  FROM sz LEFT JOIN c2 USING (doc, page, table_no) LEFT JOIN a3 USING (doc, page, table_no) LEFT JOIN ag USING (doc, page, table_no) WHERE n_rows >= 4)
"""
_BREAKS = """
one AS (SELECT doc, page, table_no FROM role GROUP BY ALL HAVING count(CASE WHEN role = 'balance' THEN 1 END) = 1 AND count(CASE WHEN role = 'debit' THEN 1 END) <= 1 AND count(CASE WHEN role = 'credit' THEN 1 END) <= 1 AND count(CASE WHEN role IN ('debit', 'credit') THEN 1 END) >= 1),
br AS (SELECT doc, page, table_no, row_no, max(CASE WHEN role = 'balance' THEN number END) AS balance, max(CASE WHEN role = 'debit' THEN number END) AS debit, max(CASE WHEN role = 'credit' THEN number END) AS credit
  FROM body JOIN one USING (doc, page, table_no) LEFT JOIN role USING (doc, page, table_no, col_no) GROUP BY ALL),
bd AS (SELECT *, lag(balance) OVER w + coalesce(credit, 0) - coalesce(debit, 0) AS down, lead(balance) OVER w + coalesce(credit, 0) - coalesce(debit, 0) AS up FROM br WINDOW w AS (PARTITION BY doc, page, table_no ORDER BY row_no)),
bb AS (SELECT *, coalesce(abs(down - balance) > 0.011, false) AS bad_down, coalesce(abs(up - balance) > 0.011, false) AS bad_up FROM bd),
bt AS (SELECT *, sum(bad_down::INT) OVER t <= sum(bad_up::INT) OVER t AS is_down FROM bb WINDOW t AS (PARTITION BY doc, page, table_no)),
breaks AS (SELECT doc, page, table_no, row_no, balance::DOUBLE AS found, (CASE WHEN is_down THEN down ELSE up END)::DOUBLE AS expected, CASE WHEN is_down THEN 'down' ELSE 'up' END AS direction FROM bt WHERE CASE WHEN is_down THEN bad_down ELSE bad_up END)
"""
_TOTALS = r"""
t1 AS (SELECT *, coalesce(bool_or(regexp_matches(cell, '(?i)^\s*((grand\s+|sub[\s-]?|net\s+)?total\b|total\s*[:(])')) OVER (PARTITION BY doc, page, table_no, row_no), false) AS total FROM body),
t2 AS (SELECT *, coalesce(sum(total::INT) OVER (PARTITION BY doc, page, table_no, col_no ORDER BY row_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS block,
  sum((NOT total AND number IS NOT NULL)::INT) OVER s >= 0.7::DOUBLE * sum((NOT total AND trim(coalesce(cell, '')) <> '')::INT) OVER s AS numeric_ FROM t1 WINDOW s AS (PARTITION BY doc, page, table_no, col_no)),
t3 AS (SELECT doc, page, table_no, col_no, block, max(CASE WHEN total THEN number END) AS found, sum(CASE WHEN NOT total THEN number END) AS expected, count(CASE WHEN NOT total THEN number END) AS n FROM t2 WHERE numeric_ GROUP BY ALL),
totals AS (SELECT doc, page, table_no, col_no, found::DOUBLE AS found, expected::DOUBLE AS expected, abs(found - expected) <= 0.011 AS ok FROM (SELECT * FROM t3 WHERE found IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc, page, table_no, col_no ORDER BY block DESC) = 1) WHERE n >= 2)
"""


def parsed(tables):
    return V.numbered(cells(tables))


@REG.query("page_table", sql=f"WITH {_HEAD} SELECT doc, page, table_no, col_no, title FROM title")
def stacked_headers(tables):
    return V.stacked_headers(parsed(tables))


@REG.query("page_table", sql=f"WITH {_HEAD} SELECT doc, page, table_no, k::INT AS header_rows FROM hk")
def header_rows(tables):
    return V.header_rows(parsed(tables)).withColumnRenamed("k", "header_rows")


@REG.query("page_table", sql=rf"WITH {_CELLS}, {_NUMBER} SELECT doc, page, table_no, row_no, col_no, regexp_matches(cell, '(?i)\b(dr|cr)\.?\s*$') AS suffixed FROM num WHERE number IS NOT NULL AND regexp_matches(cell, '[0-9][0-9,]*\.[0-9]{{2}}\b')")
def money_cells(tables):
    rows = parsed(tables)
    return rows.filter(V.money(rows)).select("doc", "page", "table_no", "row_no", "col_no", F.col("cell").rlike(V.SUFFIX).alias("suffixed"))


@REG.query("page_table", sql=f"WITH {_CELLS}, {_NUMBER}, {_AGAIN} SELECT * FROM again")
def repeated_rows(tables):
    return V.repeated_rows(parsed(tables))


@REG.query("page_table", sql=f"WITH {_HEAD}, {_AGAIN}, {_LAYOUT} SELECT doc, page, table_no, problem FROM lay WHERE problem IS NOT NULL")
def layout_problems(tables):
    return V.layout_problems(parsed(tables), ROLES)


@REG.query("page_table", sql=f"WITH {_HEAD}, {_BREAKS} SELECT * FROM breaks")
def table_balances(tables):
    return V.balance_breaks(parsed(tables), ROLES)


@REG.query("page_table", sql=f"WITH {_HEAD}, {_TOTALS} SELECT * FROM totals")
def table_totals(tables):
    return V.column_totals(parsed(tables))


QUERIES, SQL = REG.queries, REG.sql
