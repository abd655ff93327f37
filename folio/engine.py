"""The engine a user talks to: collections of chunks behind access rules, searched, read, listed, published and measured."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from folio.operators import catalog, metrics, reading, retrieval
from folio.operators.snapshot import Generations, export_collection, import_collection


# The limits and pools below are those that callers know.


@dataclass(frozen=True)
class Settings:
    """Limits are clamped, not refused; stages are a comma list of bm25, dense and rerank."""

    top_k: int = 5
    rrf_k: int = 60
    stages: tuple[str, ...] = ("bm25", "dense", "rerank")
    chunk_size: int = 512
    chunk_overlap: int = 64

    @staticmethod
    def parse_stages(text: str) -> tuple[str, ...]:
        stages = tuple(dict.fromkeys(s.strip().lower() for s in text.split(",") if s.strip()))
        if not stages or set(stages) - {"bm25", "dense", "rerank"} or stages == ("rerank",):
            raise ValueError(f"stages are bm25, dense and rerank, with at least one retriever, not {text!r}")
        return stages

    def clamped(self) -> Settings:
        size = max(16, min(8192, self.chunk_size))
        return replace(self, top_k=max(1, min(25, self.top_k)), rrf_k=max(1, min(1000, self.rrf_k)), chunk_size=size, chunk_overlap=max(0, min(self.chunk_overlap, size // 2)))

    @property
    def pool(self) -> int:
        return max(4 * self.top_k, 20)

    @property
    def rerank_pool(self) -> int:
        return min(max(3 * self.top_k, 15), 60)


class NotAvailable(LookupError):
    """A collection that does not exist or is closed to the client; the message is the same for both."""


class Engine:
    """Reads the current generation under root; rules is a table (name, clients), none of which means open."""

    def __init__(self, spark: SparkSession, root: str, rules: DataFrame | None = None, settings: Settings = Settings()) -> None:
        self.spark, self.store, self.settings = spark, Generations(spark, root), settings.clamped()
        self.rules = rules if rules is not None else spark.createDataFrame([], "name string, clients array<string>")

    # ── what there is ────────────────────────────────────────────────────────────────────

    def collections(self, client: str = "cli") -> DataFrame:
        """(collection, docs, chunks) open to the client."""
        have = self.store.read().groupBy("collection").agg(F.count_distinct("doc").alias("docs"), F.count("*").alias("chunks"))
        who = self.spark.createDataFrame([(client,)], "client string")
        allowed = catalog.access(have.select("collection"), self.rules, who).filter("allowed").select("collection")
        return have.join(allowed, "collection")

    def scope(self, client: str, asked: list[str] | None = None) -> list[str]:
        """The open collections, or those asked for by exact or by only folded name, each once."""
        have = self.collections(client).select("collection")
        if not asked:
            return [r.collection for r in have.orderBy("collection").collect()]
        wanted = self.spark.createDataFrame(list(enumerate(asked)), "place int, name string")
        same = F.col("name") == F.col("collection")
        met = wanted.join(have, F.lower("name") == F.lower("collection"), "left").withColumn("folded", F.count("collection").over(Window.partitionBy("place")))
        best = met.groupBy("place", "name").agg(F.coalesce(F.max(F.when(same, F.col("collection"))), F.max(F.when(F.col("folded") == 1, F.col("collection")))).alias("found"))
        rows = best.orderBy("place").collect()
        for r in rows:
            if r.found is None:
                raise NotAvailable(f"no collection {r.name!r}")
        return list(dict.fromkeys(r.found for r in rows))

    def _chunks(self, client: str, asked: list[str] | None) -> DataFrame:
        return self.store.read().filter(F.col("collection").isin(self.scope(client, asked)))

    def documents(self, client: str = "cli", collections: list[str] | None = None, prefix: str | None = None, glob: str | None = None, offset: int = 0, limit: int = 100) -> DataFrame:
        docs = self._chunks(client, collections).groupBy("collection", "doc").agg(F.count("*").alias("chunks"))
        return reading.matching(docs, "doc", [prefix] if prefix else None, glob).orderBy("collection", "doc").offset(offset).limit(limit)

    # ── answers ──────────────────────────────────────────────────────────────────────────

    def search(self, queries: list[str] | DataFrame, client: str = "cli", collections: list[str] | None = None, top_k: int | None = None, stages: str | None = None) -> DataFrame:
        s = replace(self.settings, top_k=top_k or self.settings.top_k, stages=Settings.parse_stages(stages) if stages else self.settings.stages).clamped()
        if isinstance(queries, list):
            if any(not q.strip() for q in queries):
                raise ValueError("a query is empty")
            queries = self.spark.createDataFrame(list(enumerate(queries, 1)), "qid int, query string")
        chunks = self._chunks(client, collections).select("collection", F.col("chunk_id").alias("id"), "text", "doc", "page", "heading")
        hits = retrieval.search(chunks, queries, s.top_k, s.stages, s.pool, s.rerank_pool, s.rrf_k)
        places = chunks.select("collection", "id", "doc", "page", "heading")
        return hits.join(places, ["collection", "id"]).withColumnRenamed("id", "chunk_id")

    def grep(self, pattern: str, client: str = "cli", collections: list[str] | None = None, context: int = 2, most: int = 200) -> DataFrame:
        rows = self._chunks(client, collections).select("collection", F.col("chunk_id").alias("id"), "text")
        return retrieval.grep(rows, pattern, max(0, min(10, context)), most)

    def read(self, doc: str, client: str = "cli", collections: list[str] | None = None, offset: int = 0, most: int = 20_000) -> DataFrame:
        """A slice of a document, named whole or short; ambiguous and missing names are errors."""
        rows = self._chunks(client, collections)
        found = reading.resolve(self.spark.createDataFrame([(doc,)], "ident string"), rows.select("doc")).first()
        if found.state != "found":
            raise NotAvailable(f"{doc!r} is {found.state}")
        ordered = F.array_sort(F.collect_list(F.struct("ord", "text")))
        whole = rows.filter(F.col("doc") == found.doc).groupBy("doc").agg(F.array_join(F.transform(ordered, lambda x: x.text), "\n\n").alias("md"))
        return reading.read(whole, "md", offset, most)

    # ── upkeep and measurement ───────────────────────────────────────────────────────────

    def publish(self, chunks: DataFrame, allow_drop: bool = False) -> dict:
        return self.store.publish(chunks, allow_drop)

    def export(self, collection: str, path: str) -> DataFrame:
        return export_collection(self.store.read(), collection, path)

    def import_(self, path: str, name: str, model: str) -> dict:
        new = import_collection(self.spark, path, name, model)
        old = self.store.read().filter(F.col("collection") != name) if self.store.current() else None
        return self.store.publish(new if old is None else old.unionByName(new, allowMissingColumns=True))

    def delete(self, collection: str) -> dict:
        return self.store.publish(self.store.read().filter(F.col("collection") != collection), allow_drop=True)

    def bench(self, labelled: DataFrame, k: int = 10, stages: str | None = None) -> DataFrame:
        """hit rate, MRR and nDCG of (qid, query, key), key a chunk_id."""
        hits = self.search(labelled.select("qid", "query").distinct(), top_k=k, stages=stages).select("qid", F.col("chunk_id").alias("key"), "rank")
        return metrics.summarize_queries(metrics.score_queries(hits, labelled.select("qid", "key"), k))
