"""Queries of the training-data problems and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from folio.session import ship_package, table


def _records(spark: SparkSession, sf: str) -> DataFrame:
    from folio.llm.markup import records

    return records(table(spark, sf, "chunk"), table(spark, sf, "page_table"))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    from folio.llm.markup import trees

    return trees(_records(spark, sf)).select("origin", "record_key")


def p1_clean(spark: SparkSession, sf: str) -> DataFrame:
    from folio.llm.markup import cleaned

    return cleaned(_records(spark, sf))


def p1_style_tree(spark: SparkSession, sf: str) -> DataFrame:
    from folio.llm.markup import style_tree, trees

    return style_tree(trees(_records(spark, sf)))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    from folio.llm.terms import marked_terms

    return marked_terms(table(spark, sf, "chunk")).filter("mark IS NOT NULL").select("term", "mark")


def p2_terms(spark: SparkSession, sf: str) -> DataFrame:
    from folio.llm.terms import marked_terms

    return marked_terms(table(spark, sf, "chunk"))


def _similar(spark: SparkSession, sf: str, field: str):
    from folio.llm import setjoin

    if field == "text":
        return setjoin.SimilarSets(setjoin.chunk_texts(table(spark, sf, "chunk")), 5, setjoin.normalized)
    return setjoin.SimilarSets(setjoin.source_paths(table(spark, sf, "index_meta")), 3)


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    both = [_similar(spark, sf, field).pairs().select(F.lit(field).alias("field"), "key_a", "key_b") for field in ("text", "src_path")]
    return both[0].unionByName(both[1])


def p3_groups(spark: SparkSession, sf: str) -> DataFrame:
    both = [_similar(spark, sf, field).groups().select(F.lit(field).alias("field"), "key", "class_id", "links") for field in ("text", "src_path")]
    return both[0].unionByName(both[1])


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    from folio.llm.split import split_oversized

    return split_oversized(table(spark, sf, "chunk"), table(spark, sf, "index_meta")).filter("piece_no = 0").select("chunk_id")


def p4_pieces(spark: SparkSession, sf: str) -> DataFrame:
    from folio.llm.split import split_oversized

    return split_oversized(table(spark, sf, "chunk"), table(spark, sf, "index_meta"))


def p4_report(spark: SparkSession, sf: str) -> DataFrame:
    from folio.llm.split import split_report

    return split_report(table(spark, sf, "chunk"), table(spark, sf, "index_meta"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    from folio.llm.knn import NeighbourGraph

    return NeighbourGraph(table(spark, sf, "embedding")).pairs().select(F.col("key_a").alias("chunk_id_a"), F.col("key_b").alias("chunk_id_b"))


def p6_search(spark: SparkSession, sf: str) -> DataFrame:
    """The vectors of `embeddings` whose vec_id is divisible by 20, searched in the neighbour graph of all of them."""
    from folio.llm.knn import NeighbourGraph

    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("chunk_id"), "vec_id", F.lit("one").alias("model"), "embedding")
    asked = vectors.filter("vec_id % 20 = 0").select(F.col("chunk_id").alias("query"), "model", "embedding")
    found = NeighbourGraph(vectors).search(asked, 10)
    return found.select(F.col("query").cast("long").alias("qid"), F.col("key").cast("long").alias("id"), "rank", F.round("cosine", 5).alias("score"))


def _scans(spark: SparkSession, sf: str):
    from folio.llm import scans

    return scans.ScanModel(scans.records(table(spark, sf, "page"), table(spark, sf, "chunk")))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return _scans(spark, sf).found()


def p7_repaired(spark: SparkSession, sf: str) -> DataFrame:
    return _scans(spark, sf).repaired()


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    from folio.llm.bpe import token_ids

    return token_ids(table(spark, sf, "documents"))


def p8_counts(spark: SparkSession, sf: str) -> DataFrame:
    from folio.llm.bpe import token_counts

    counts = token_counts(table(spark, sf, "documents"), keep=("lang",))
    return counts.groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.max("n_tokens").alias("longest"))


def p9_mix(spark: SparkSession, sf: str) -> DataFrame:
    from folio.llm.mix import mixture

    return mixture(table(spark, sf, "documents"), table(spark, sf, "mix_target"))


def p9_report(spark: SparkSession, sf: str) -> DataFrame:
    from folio.llm.mix import mix_report

    return mix_report(table(spark, sf, "documents"), table(spark, sf, "mix_target"))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    from folio.llm.sentences import sentences

    return sentences(table(spark, sf, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_clean, p1_style_tree, p2_found, p2_terms, p3_found, p3_groups, p4_found, p4_pieces, p4_report, p6_found, p6_search, p7_found, p7_repaired, p8_ids, p8_counts, p9_mix, p9_report, p10_found)}

_TERMS = r"""
WITH rec AS (SELECT DISTINCT chunk_id, lower(text) AS t FROM chunk WHERE text IS NOT NULL),
tok AS (SELECT chunk_id, unnest(regexp_extract_all(regexp_replace(t, '([\x{3041}-\x{30FF}\x{4E00}-\x{9FFF}])', ' \1 ', 'g'),
  '[\x{3041}-\x{30FF}\x{4E00}-\x{9FFF}]|[\p{L}\p{M}\p{N}]+')) AS term FROM rec),
st AS (SELECT term, count(*)::BIGINT AS occurrences, count(DISTINCT chunk_id)::BIGINT AS records FROM tok GROUP BY term),
marked AS (SELECT *, CASE WHEN records <= 2 THEN 'rare' WHEN records > 0.2::DOUBLE * (SELECT count(*) FROM rec) THEN 'common' END AS mark FROM st)
"""
_OVER = r"""
WITH m AS (SELECT doc, arg_max(chunk_size, built_at) AS chunk_size FROM index_meta WHERE built_at IS NOT NULL GROUP BY doc),
s AS (SELECT DISTINCT chunk_id, doc, text, len(regexp_extract_all(text, '[^ \t\r\n]+')) AS w FROM chunk WHERE text IS NOT NULL)
SELECT DISTINCT chunk_id FROM s JOIN m USING (doc)
WHERE w > 0 AND greatest(floor(w * 1.3::DOUBLE) + 1, length(text) // 4) > chunk_size
"""

SQL: dict[str, str] = {
    "p2_found": _TERMS + "SELECT term, mark FROM marked WHERE mark IS NOT NULL",
    "p2_terms": _TERMS + "SELECT term, occurrences, records, mark FROM marked",
    "p4_found": _OVER,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def shipped(f):
        def run(spark: SparkSession, sf: str) -> DataFrame:
            ship_package(spark)
            return f(spark, sf)

        return run

    return {name: shipped(f) for name, f in QUERIES.items()}
