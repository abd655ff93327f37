"""Problem 5: source files to process."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folio.operators.incremental import replayed
from folio.session import keep_scratch, ship_package, table


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """The log in three committed runs by arrival, one of them lost and repeated; the store is a table of clean()."""
    ship_package(spark)
    return replayed(spark, table(spark, sf, "trace"), table(spark, sf, "index_meta"), keep_scratch(spark, "p5"))


QUERIES = {"p5_found": p5_found}

# A '..' takes the nearest kept part before it away; the recursion removes one such pair at a time.
SQL = {
    "p5_found": r"""
WITH RECURSIVE raw AS (
  SELECT DISTINCT src_path FROM (SELECT src_path FROM trace UNION ALL SELECT src_path FROM index_meta) WHERE src_path IS NOT NULL),
step AS (
  SELECT src_path, list_filter(string_split(src_path, '/'), lambda x: x <> '' AND x <> '.') AS todo, []::VARCHAR[] AS kept FROM raw
  UNION ALL
  SELECT src_path, todo[2:], CASE WHEN todo[1] = '..' THEN kept[:greatest(len(kept) - 1, 0)] ELSE list_append(kept, todo[1]) END
  FROM step WHERE len(todo) > 0),
norm AS (SELECT src_path, '/' || array_to_string(kept, '/') AS path FROM step WHERE len(todo) = 0),
t AS (SELECT path, arg_max(lower(src_sha256), written_at) AS sha FROM trace JOIN norm USING (src_path)
      WHERE src_sha256 IS NOT NULL AND written_at IS NOT NULL GROUP BY path),
i AS (SELECT path, arg_max(lower(src_sha256), built_at) AS sha FROM index_meta JOIN norm USING (src_path) WHERE built_at IS NOT NULL GROUP BY path)
SELECT t.path AS src_path, t.sha AS src_sha256 FROM t LEFT JOIN i USING (path) WHERE i.sha IS DISTINCT FROM t.sha
"""
}
