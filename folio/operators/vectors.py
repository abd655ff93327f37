"""Exact dense scoring of a stated set of query vectors against all vectors, block by block.

Query blocks of BLOCK rows and vector blocks of BLOCK rows meet under a key each, so a task holds two blocks, whatever the
tables' sizes; every block keeps its best k before anything is shuffled. Vectors that are null, empty or of another length than
the query's have no score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

BLOCK = 4096


def _packed(vectors: DataFrame, key: str, value: str, side: str) -> DataFrame:
    good = vectors.filter(F.col(key).isNotNull() & (F.size(value) > 0)).select(F.col(key).alias("id"), F.col(value).cast("array<float>").alias("v"))
    return good.select("id", "v", F.lit(side).alias("side"))


def top_vectors(queries: DataFrame, vectors: DataFrame, k: int, key: str = "vec_id", value: str = "embedding") -> DataFrame:
    """(qid, id, rank, score): the k vectors with the greatest dot products of each query, the query itself left out."""
    from folio.session import parallelism

    n = max(1, -(-queries.count() // BLOCK))
    parts = max(1, min(parallelism(queries.sparkSession), -(-vectors.count() // BLOCK)))
    q = _packed(queries, key, value, "q").withColumn("qb", F.pmod(F.xxhash64("id"), F.lit(n))).withColumn("vb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    v = _packed(vectors, key, value, "v").withColumn("vb", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(parts))).withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))

    def solve(table: pa.Table) -> pa.Table:
        rows = {s: [(i, x) for i, x, side in zip(table["id"].to_pylist(), table["v"].to_pylist(), table["side"].to_pylist()) if side == s and x is not None and None not in x] for s in "qv"}
        out = ([], [], [])
        for dim in {len(x) for _, x in rows["q"]}:
            qs = [r for r in rows["q"] if len(r[1]) == dim]
            vs = [r for r in rows["v"] if len(r[1]) == dim]
            if not vs:
                continue
            vi = np.array([i for i, _ in vs])
            m = np.array([x for _, x in vs], float)
            for i, x in qs:
                s = m @ np.array(x, float)
                s[vi == i] = -np.inf
                best = np.lexsort((vi, -np.round(s, 9)))[:k]
                best = best[np.isfinite(s[best])]
                out[0].extend([i] * len(best))
                out[1].extend(vi[best].tolist())
                out[2].extend(s[best].tolist())
        return pa.table({"qid": pa.array(out[0], pa.int64()), "id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    best = q.unionByName(v).groupBy("qb", "vb").applyInArrow(solve, "qid long, id long, score double")
    w = Window.partitionBy("qid").orderBy(F.desc(F.round("score", 9)), "id")
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("qid", "id", "rank", F.round("score", 5).alias("score"))
