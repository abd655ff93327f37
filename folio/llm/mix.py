"""Mixing sources to target weights.

Sizes are tokens of the texts, counted by a public tokenizer. A text that several rows of a source repeat is one text, held by
the row with the smallest id, so that its uses are capped together. Of a total of tokens (by default, all tokens of the sources
with a target), each source gets its weight's share, up to max_repeat times its own tokens; what a capped source leaves is
divided among the others by weight. A text is used floor(rate) times, and once more with the probability of the rate's fraction,
drawn from a hash of seed and id.

Sources without a target, without text or with a null or non-positive weight or max_repeat are left out of the mix; null and
empty texts have no tokens and are left out. Of rows of mix_target that repeat a source the one with the largest weight counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from folio.llm.bpe import token_counts


def rates_of(tokens: dict[str, int], targets: dict[str, tuple[float, int]], total: float | None = None) -> dict[str, float]:
    """Uses per token of each source that has tokens and a target."""
    open_ = {s: w for s, (w, r) in targets.items() if tokens.get(s, 0) > 0 and w and w > 0 and r and r > 0}
    left = float(sum(tokens[s] for s in open_) if total is None else total)
    rates: dict[str, float] = {}
    while open_:
        weight = sum(open_.values())
        full = [s for s, w in open_.items() if left * w / weight >= targets[s][1] * tokens[s]]
        if not full:
            return rates | {s: left * w / weight / tokens[s] for s, w in open_.items()}
        for s in sorted(full):
            rates[s] = float(targets[s][1])
            del open_[s]
        left = max(0.0, left - sum(targets[s][1] * tokens[s] for s in full))
    return rates


def unique_texts(docs: DataFrame, targets: DataFrame, **tokenizer) -> DataFrame:
    """(doc_id, source, n_tokens) of each distinct text of each source with a target; the smallest doc_id holds it."""
    named = docs.filter(F.col("text").isNotNull() & (F.col("text") != ""))
    wanted = targets.select("source").filter(F.col("source").isNotNull()).distinct()
    rows = named.select("doc_id", "source", "text").join(wanted, "source", "left_semi").withColumn("_h", F.sha2("text", 256))
    counted = token_counts(rows, keep=("doc_id", "source", "_h"), **tokenizer)
    return counted.groupBy("source", "_h").agg(F.min("doc_id").alias("doc_id"), F.first("n_tokens").alias("n_tokens")).select("doc_id", "source", "n_tokens")


def _plan(units: DataFrame, targets: DataFrame, total: float | None) -> DataFrame:
    """(source, weight, max_repeat, tokens, texts, rate): one row for each row of mix_target at most, a table of fixed size."""
    best = targets.filter(F.col("source").isNotNull()).groupBy("source").agg(F.max_by(F.struct("weight", "max_repeat"), F.struct("weight", "max_repeat")).alias("m")).select("source", "m.*")
    sums = units.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("texts"))
    rows = best.join(sums, "source", "left").collect()
    rates = rates_of({r.source: r.tokens or 0 for r in rows}, {r.source: (r.weight, r.max_repeat) for r in rows}, total)
    data = [(r.source, r.weight, r.max_repeat, r.tokens or 0, r.texts or 0, rates.get(r.source, 0.0)) for r in rows]
    return units.sparkSession.createDataFrame(data, "source string, weight double, max_repeat int, tokens long, texts long, rate double")


def _copies(seed: int):
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id")), 11) / F.lit(float(1 << 53))
    return F.floor("rate").cast("int") + F.when(u < F.col("rate") - F.floor("rate"), 1).otherwise(0)


def mix(docs: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 42, **tokenizer) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, n_tokens, copies) of each text that is used, and the plan. The counted texts are computed once."""
    from folio.session import cut

    units = cut(unique_texts(docs, targets, **tokenizer))
    plan = _plan(units, targets, total)
    # The plan has at most as many rows as mix_target, which lists sources by hand.
    drawn = units.join(F.broadcast(plan.select("source", "rate")), "source").withColumn("copies", _copies(seed))
    return drawn.filter("copies > 0").select("doc_id", "source", "n_tokens", "copies"), plan


def mixture(docs: DataFrame, targets: DataFrame, **options) -> DataFrame:
    """(doc_id, source, copy_no, n_tokens): one row for each use of a text."""
    drawn, _ = mix(docs, targets, **options)
    return drawn.select("doc_id", "source", F.explode(F.sequence(F.lit(1), "copies")).alias("copy_no"), "n_tokens")


def mix_report(docs: DataFrame, targets: DataFrame, **options) -> DataFrame:
    """(source, target_share, actual_share, max_repeat, rate, texts, tokens, uses, mix_tokens) of each row of mix_target."""
    drawn, plan = mix(docs, targets, **options)
    used = drawn.groupBy("source").agg(F.sum("copies").alias("uses"), F.sum(F.col("copies") * F.col("n_tokens")).alias("mix_tokens"))
    rows = plan.join(used, "source", "left").na.fill(0, ["uses", "mix_tokens"])
    weight = F.when((F.col("tokens") > 0) & (F.col("weight") > 0) & (F.col("max_repeat") > 0), F.col("weight")).otherwise(0.0)
    sums = rows.agg(F.sum(weight).alias("w"), F.sum("mix_tokens").alias("m")).first()
    return rows.select(
        "source", F.try_divide(weight, F.lit(sums.w)).alias("target_share"), F.try_divide(F.col("mix_tokens"), F.lit(sums.m)).alias("actual_share"), "max_repeat", "rate", "texts", "tokens", "uses", "mix_tokens"
    )
