"""Arithmetic validators over ledgers and tables of figures, in DECIMAL with a tolerance of rounding slack."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

TOLERANCE = 0.011


def running_balance(rows: DataFrame, key: str, order: str) -> DataFrame:
    """(key, order, found, expected, role): rows whose balance is not the one before plus credit minus debit.

    A blank balance breaks the chain. Where two rows in a row fail, the first one's balance is the suspect and the second is
    explained by it; a single failing row's amount is. Null amounts count as none.
    """
    w = Window.partitionBy(key).orderBy(order)
    zero = F.lit(0).cast("decimal(28,2)")
    expected = F.lag("balance").over(w) + F.coalesce("credit", zero) - F.coalesce("debit", zero)
    k = rows.withColumn("expected", expected).withColumn("fails", F.coalesce(F.abs(F.col("expected") - F.col("balance")) > F.lit(TOLERANCE), F.lit(False)))
    k = k.withColumn("before", F.coalesce(F.lag("fails").over(w), F.lit(False))).withColumn("after", F.coalesce(F.lead("fails").over(w), F.lit(False)))
    bad = k.filter(F.col("fails") & ~F.col("before"))
    return bad.select(key, order, F.col("balance").cast("double").alias("found"), F.col("expected").cast("double").alias("expected"), F.when(F.col("after"), "balance").otherwise("amount").alias("role"))


def totals(rows: DataFrame, key: str, order: str, total: str) -> DataFrame:
    """(key, n_rows, expected, found, ok): the last total row of each table against the rows since the total before it, two at least."""
    w = Window.partitionBy(key).orderBy(order)
    marked = rows.withColumn("is_total", F.col("label").rlike(total))
    block = F.coalesce(F.sum(F.col("is_total").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = marked.withColumn("block", block).groupBy(key, "block").agg(
        F.count_if(~F.col("is_total")).alias("n_rows"), F.sum(F.when(~F.col("is_total"), F.col("value"))).alias("expected"), F.max(F.when(F.col("is_total"), F.col("value"))).alias("found"), F.bool_or("is_total").alias("closed")
    )
    last = blocks.filter("closed").groupBy(key).agg(F.max_by(F.struct("n_rows", "expected", "found"), "block").alias("m")).select(key, "m.*").filter("n_rows >= 2")
    return last.select(key, "n_rows", F.col("expected").cast("double").alias("expected"), F.col("found").cast("double").alias("found"), (F.abs(F.col("expected") - F.col("found")) <= F.lit(TOLERANCE)).alias("ok"))
