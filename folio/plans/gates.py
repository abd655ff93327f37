"""The gate, page plans and layer reliability over pages; what no table holds of a page's profile is derived from its number and length."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.operators import gates as G, pages as P, validators as V
from folio.plans.pages import _PAGE, _SCRIPT, unique_pages
from folio.plans.registry import Registry
from folio.plans.tables import ROLES
from folio.plans.validators import _AGAIN, _BREAKS, _HEAD, _LAYOUT, _TOTALS
from folio.session import spread

REG = Registry()
_COUNTED = _SCRIPT.replace("c AS (SELECT *, len", "counted AS (SELECT *, len").replace("AS script FROM c)", "AS script FROM counted)")
_PLAIN = r"""trim(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_replace(md, '(?s)<!--.*?-->', ' ', 'g'), '<[^<>]{1,200}>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'),
 '(?m)^[ |:\-]{3,}$', ' ', 'g'), '[|*`#]', ' ', 'g'), '[ \t\r\n]+', ' ', 'g'))"""
_PROFILE = f"""
prof AS (SELECT doc, page, md, CASE page % 3 WHEN 0 THEN 'scan' WHEN 1 THEN 'digital' ELSE 'other' END AS kind, page % 2 = 0 AS ocr, page % 8 = 1 AS hidden_layer,
  CASE WHEN page % 3 = 1 THEN length(md) * CASE WHEN page % 5 = 0 THEN 3 ELSE 1 END ELSE 0 END AS chars, page % 13 <> 0 AS text_ok, CASE page % 17 WHEN 0 THEN 'Devanagari' ELSE 'Latin' END AS script,
  CASE WHEN page % 7 <> 0 THEN (length(md) % 97) / 1000::DOUBLE END AS ink, CASE WHEN page % 7 <> 0 THEN (length(md) % 3) / 10000::DOUBLE END AS light, CASE page % 4 WHEN 0 THEN 72 WHEN 1 THEN 100 WHEN 2 THEN 300 END AS dpi,
  CASE WHEN page % 5 <> 0 THEN [(page % 5) * 300, 800] END AS size_px, CASE page % 11 WHEN 0 THEN 'Poor' ELSE 'good' END AS grade, (page % 10) / 10::DOUBLE AS low, page * 5 AS layer_words,
  CASE page % 9 WHEN 1 THEN 'intact' WHEN 4 THEN 'lost text' END AS layer_verdict, CASE WHEN page % 6 = 0 THEN 2 ELSE 0 END AS asked, page % 2 + 1 AS read FROM ({_PAGE}))
"""


def profiled(pages):
    return profile(unique_pages(pages))


def profile(rows):
    page, n = F.col("page"), F.length("md")
    return rows.withColumns({
        "kind": F.when(page % 3 == 0, "scan").when(page % 3 == 1, "digital").otherwise("other"), "ocr": page % 2 == 0, "hidden_layer": page % 8 == 1,
        "chars": F.when(page % 3 == 1, n * F.when(page % 5 == 0, 3).otherwise(1)).otherwise(0), "text_ok": page % 13 != 0, "script": F.when(page % 17 == 0, "Devanagari").otherwise("Latin"),
        "ink": F.when(page % 7 != 0, (n % 97) / 1000.0), "light": F.when(page % 7 != 0, (n % 3) / 10000.0), "dpi": F.when(page % 4 == 0, 72).when(page % 4 == 1, 100).when(page % 4 == 2, 300),
        "size_px": F.when(page % 5 != 0, F.array((page % 5) * 300, F.lit(800))), "grade": F.when(page % 11 == 0, "Poor").otherwise("good"), "low": (page % 10) / 10.0, "layer_words": page * 5,
        "layer_verdict": F.when(page % 9 == 1, "intact").when(page % 9 == 4, "lost text"), "asked": F.when(page % 6 == 0, 2).otherwise(0), "read": page % 2 + 1,
    })


@REG.query("page", "page_table", sql=rf"""WITH {_HEAD}, {_AGAIN}, {_LAYOUT}, {_BREAKS}, {_TOTALS}, {_PROFILE},
src AS (SELECT *, {_PLAIN} AS t FROM (SELECT * RENAME (script AS want) FROM prof)), {_COUNTED},
w AS (SELECT doc, page, length(regexp_replace(t, '\s', '', 'g')) AS n, regexp_replace(t, '[\s\p{{Cf}}]', '', 'g') AS bare, list_filter(string_split_regex(trim(t), '\s+'), lambda x: x <> '') AS ws,
  list_filter(regexp_extract_all(lower(t), '[\p{{L}}\p{{N}}]+'), lambda x: length(x) >= 3 AND regexp_matches(x, '^[0-9a-z\x{{00C0}}-\x{{024F}}]*[a-z\x{{00C0}}-\x{{024F}}][0-9a-z\x{{00C0}}-\x{{024F}}]*$')) AS lw FROM src),
m AS (SELECT doc, page, n, length(bare) > 0 AND len(regexp_extract_all(bare, '[\x{{FFFD}}\x{{E000}}-\x{{F8FF}}\x{{0000}}-\x{{0008}}\x{{000E}}-\x{{001F}}]')) <= 0.01::DOUBLE * length(bare) AND len(regexp_extract_all(bare, '[\p{{L}}\p{{N}}\p{{P}}\p{{S}}\p{{M}}]')) >= 0.9::DOUBLE * length(bare) AS ok_text,
  CASE WHEN len(ws) >= 30 THEN len(list_filter(ws, lambda x: length(x) = 1 AND NOT regexp_matches(x, '^\p{{Nd}}$'))) / len(ws) END AS singles,
  CASE WHEN len(lw) >= 12 THEN len(list_filter(lw, lambda x: regexp_matches(x, '[0-9]') OR regexp_matches(x, '^[^aeiouy\x{{00C0}}-\x{{024F}}]{{4,}}$') OR regexp_matches(x, '[bcdfghjklmnpqrstvwxz]{{5}}'))) / len(lw) END AS odd_words FROM w),
ln AS (SELECT doc, page, trim(regexp_replace(line, '[\s|:\-]+', ' ', 'g')) AS line FROM (SELECT doc, page, unnest(string_split(md, chr(10))) AS line FROM prof)),
lk AS (SELECT doc, page, line, count(*) AS times FROM ln WHERE length(line) >= 10 GROUP BY ALL),
run AS (SELECT doc, page, max(times) >= 8 AND max(times) >= 0.25::DOUBLE * sum(times) AS runaway FROM lk GROUP BY ALL),
ts AS (SELECT DISTINCT doc, page, table_no, rows, n_header, list_filter(rows, lambda r: r IS NOT NULL) AS rs FROM page_table WHERE rows IS NOT NULL),
sh AS (SELECT doc, page, bool_or(coalesce(list_max(list_transform(rs, lambda r: len(r))) <> list_min(list_transform(rs, lambda r: len(r))), false)) AS ragged,
  bool_or(coalesce(len(rs) >= 4 AND len(list_filter(flatten(rs), lambda c: c IS NULL OR trim(c) = '')) > 0.6::DOUBLE * len(flatten(rs)), false)) AS blank_table, true AS has_table FROM ts GROUP BY ALL),
bc AS (SELECT doc, page, table_no, col_no, trim(cell) AS cell FROM cell WHERE row_no >= coalesce(n_header, 1) AND trim(cell) <> ''),
ck AS (SELECT doc, page, table_no, col_no, count(*) AS filled, count(CASE WHEN regexp_full_match(cell, '[-+(]?[0-9,.\s]+\)?%?') THEN 1 END) AS nums,
  count(CASE WHEN regexp_full_match(cell, '[0-9,.\s]*[A-Za-z][A-Za-z0-9_,.\s]*') AND regexp_matches(cell, '[0-9]') AND length(cell) <= 12 THEN 1 END) AS mixed FROM bc GROUP BY ALL),
ct AS (SELECT doc, page, bool_or(filled >= 3 AND nums >= 0.6::DOUBLE * filled AND mixed > 0) AS column_types FROM ck GROUP BY ALL),
vd AS (SELECT doc, page, bool_or(k = 'l') AS layout, bool_or(k = 'b') AS running_balance, bool_or(k = 't') AS totals FROM (SELECT doc, page, 'l' AS k FROM lay WHERE problem IS NOT NULL UNION ALL SELECT doc, page, 'b' FROM breaks UNION ALL SELECT doc, page, 't' FROM totals WHERE NOT ok) GROUP BY ALL),
f AS (SELECT *, kind = 'digital' AS dig, kind = 'scan' AS sc, coalesce(ocr AND kind = 'scan' OR kind = 'digital' AND hidden_layer, false) AS by_ocr,
  CASE WHEN NOT (size_px IS NOT NULL AND dpi IS NOT NULL AND dpi IN (72, 96)) THEN dpi END AS real_dpi
  FROM script JOIN m USING (doc, page) LEFT JOIN run USING (doc, page) LEFT JOIN sh USING (doc, page) LEFT JOIN ct USING (doc, page) LEFT JOIN vd USING (doc, page)),
g AS (SELECT doc, page, n = 0 AND NOT coalesce(has_table, false) AND NOT coalesce(dig AND chars >= 100 OR sc AND ink >= 0.01::DOUBLE, false) AS empty, coalesce(dig AND layer_verdict = 'intact', false) AS intact, ocr AND sc AS reading,
 list_filter([
  CASE WHEN coalesce(CASE WHEN dig AND layer_words >= 15 THEN layer_verdict <> 'intact' WHEN dig THEN chars >= 100 AND n < 0.5::DOUBLE * chars WHEN sc THEN ink >= 0.01::DOUBLE AND n < 20 END, false) THEN 'coverage' END,
  CASE WHEN n >= 20 AND coalesce(NOT ok_text OR sc AND singles > 0.4::DOUBLE OR (CASE WHEN text_ok THEN want END NOT IN ('Latin', 'Mixed', 'none', '') AND script NOT IN ('', 'Mixed') AND script <> want), false) THEN 'script' END,
  CASE WHEN coalesce(lower(grade) = 'poor' OR low < 0.45::DOUBLE, false) THEN 'docling_grade' END,
  CASE WHEN coalesce(ragged OR blank_table OR layout, false) THEN 'table_shape' END,
  CASE WHEN sc AND coalesce(CASE WHEN real_dpi > 0 THEN real_dpi < 150 ELSE list_max(size_px) < 1000 END, false) THEN 'low_resolution' END,
  CASE WHEN NOT dig AND coalesce(runaway, false) THEN 'degenerate' END,
  CASE WHEN ocr AND sc AND ink >= 0.01::DOUBLE AND (n < 0.25::DOUBLE * ink * 15000 OR n > 3 * ink * 15000) THEN 'expected_size' END,
  CASE WHEN by_ocr AND odd_words > 0.25::DOUBLE THEN 'plausibility' END,
  CASE WHEN by_ocr AND column_types THEN 'column_types' END, CASE WHEN read < asked THEN 'residue_read' END, CASE WHEN running_balance THEN 'running_balance' END, CASE WHEN totals THEN 'totals' END], lambda x: x IS NOT NULL) AS alle FROM f),
h AS (SELECT *, CASE WHEN empty THEN [] WHEN intact THEN list_filter(alle, lambda x: x NOT IN ('table_shape', 'totals', 'running_balance', 'docling_grade')) ELSE alle END AS failed_,
  CASE WHEN intact AND NOT empty THEN list_filter(alle, lambda x: x IN ('table_shape', 'totals', 'running_balance', 'docling_grade')) ELSE [] END AS notes_ FROM g)
SELECT doc, page, array_to_string(failed_, ',') AS failed, array_to_string(notes_, ',') AS notes, CASE WHEN empty THEN 'empty' WHEN len(failed_) > 0 THEN 'suspect' ELSE 'ok' END AS verdict,
  reading AND len(list_filter(failed_, lambda x: x NOT IN ('low_resolution', 'docling_grade'))) > 0 AS escalate, CASE WHEN empty THEN 'no_text' WHEN len(failed_) > 0 THEN 'low' ELSE 'pass' END AS outcome FROM h""")
def gate_full(pages, tables):
    """All twelve checks of every page, its verdict, escalation and outcome."""
    # Copies drop out once a page is a few measures and a table a few flags, so no cells are shuffled, and texts only to spread a narrow scan.
    rows = profile(spread(pages.filter("md IS NOT NULL").select("doc", "page", "md")))
    rows = rows.withColumn("lines", F.when(F.col("kind") != "digital", P.long_lines(F.col("md")))).withColumn("runaway", P.runaway(F.col("lines"))).drop("lines")
    rows = G.measured(rows).dropDuplicates(["doc", "page"])
    return G.judged(rows.join(V.page_flags(tables, ROLES), ["doc", "page"], "left"))


@REG.query("documents", sql=r"""WITH b AS (SELECT doc_id, regexp_replace(text, '[\s\p{Cf}]', '', 'g') AS t FROM documents WHERE text IS NOT NULL)
SELECT doc_id, length(t) > 0 AND len(regexp_extract_all(t, '[\x{FFFD}\x{E000}-\x{F8FF}\x{0000}-\x{0008}\x{000E}-\x{001F}]')) <= 0.01::DOUBLE * length(t) AND len(regexp_extract_all(t, '[\p{L}\p{N}\p{P}\p{S}\p{M}]')) >= 0.9::DOUBLE * length(t) AS ok FROM b""")
def text_sanity(docs):
    return docs.filter("text IS NOT NULL").select("doc_id", G.text_ok(F.col("text")).alias("ok"))


@REG.query("page", sql=f"WITH {_PROFILE} SELECT doc, page, CASE WHEN kind = 'digital' THEN 'digital' ELSE 'scan' END AS mode, coalesce(ink, 1) < 0.0003::DOUBLE AND coalesce(light, 1) < 0.0003::DOUBLE AND chars = 0 AS blank FROM prof")
def page_plan(pages):
    return G.page_plan(profiled(pages))


@REG.query("page", "page_table", sql=f"""WITH {_PROFILE}, t AS (SELECT DISTINCT doc, page, true AS has_table FROM page_table)
SELECT doc, page, concat_ws('-', CASE WHEN length(md) = 0 THEN 'empty' ELSE kind END, CASE WHEN has_table THEN 'table' END, CASE WHEN lower(script) NOT IN ('latin', '') THEN 'script' END) AS class FROM prof LEFT JOIN t USING (doc, page)""")
def failure_classes(pages, tables):
    has = tables.select("doc", "page").distinct().withColumn("has_table", F.lit(True))
    rows = profiled(pages).join(has, ["doc", "page"], "left")
    return rows.select("doc", "page", G.failure_class(F.col("kind"), F.col("script"), F.col("has_table"), F.length("md")).alias("class"))


@REG.query("page", sql=f"""WITH p AS (SELECT DISTINCT doc, page FROM ({_PAGE})), i AS (SELECT doc, page, page - row_number() OVER (PARTITION BY doc ORDER BY page) AS island FROM p),
k AS (SELECT *, (row_number() OVER (PARTITION BY doc, island ORDER BY page) - 1) // 20 AS part FROM i) SELECT doc, min(page)::INT AS first_page, max(page)::INT AS last_page FROM k GROUP BY doc, island, part""")
def page_runs(pages):
    return G.page_runs(unique_pages(pages))


@REG.query("page", sql=f"""WITH {_PROFILE}, r AS (SELECT doc, page, text_ok AS ok, length(md) AS chars, count(*) OVER (PARTITION BY doc) AS total, row_number() OVER (PARTITION BY doc ORDER BY page) - 1 AS place FROM prof),
s AS (SELECT *, greatest(1, total // 12) AS step FROM r), k AS (SELECT doc, max(total)::BIGINT AS pages, count(*)::BIGINT AS sampled, count(CASE WHEN chars >= 50 THEN 1 END) AS texty, count(CASE WHEN chars >= 50 AND ok THEN 1 END) AS good FROM s WHERE place % step = 0 AND place / step < 12 GROUP BY doc)
SELECT doc, pages, sampled, texty >= 0.7::DOUBLE * sampled AND good >= 0.9::DOUBLE * texty AND texty > 0 AS reliable FROM k""")
def layer_reliability(pages):
    return G.layer_reliability(profiled(pages).select("doc", "page", F.col("text_ok").alias("ok"), F.length("md").alias("chars")))


QUERIES, SQL = REG.queries, REG.sql
