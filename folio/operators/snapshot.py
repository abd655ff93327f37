"""Immutable generations of an index: published by a pointer written last, collected when old, exported and imported whole."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F


class PublishRefused(RuntimeError):
    """The new content would mix models or lose a collection."""


class Generations:
    """Versioned Parquet folders under one root; readers follow the newest pointer."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.root}/pointers"))

    def _names(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/pointers")))

    def current(self) -> dict | None:
        names = self._names()
        if not names:
            return None
        stream = self._fs.open(self._path(f"{self.root}/pointers/{names[-1]}"))
        try:
            return json.loads(bytes(b & 255 for b in stream.readAllBytes()))
        finally:
            stream.close()

    def read(self) -> DataFrame:
        now = self.current()
        if now is None:
            raise FileNotFoundError("nothing is published")
        return self.spark.read.parquet(now["path"])

    def publish(self, chunks: DataFrame, allow_drop: bool = False) -> dict:
        """Writes (collection, doc, chunk_id, model, ...) as a generation, unless its content is the current one."""
        models = [r.collection for r in chunks.groupBy("collection").agg(F.count_distinct("model").alias("n")).filter("n > 1").limit(5).collect()]
        if models:
            raise PublishRefused(f"several models in {', '.join(models)}")
        now = self.current()
        if now is not None and not allow_drop:
            gone = [r.collection for r in self.read().select("collection").distinct().join(chunks.select("collection").distinct(), "collection", "left_anti").limit(5).collect()]
            if gone:
                raise PublishRefused(f"collections would be lost: {', '.join(gone)}")
        # An order-free digest of all rows, folded where the rows are.
        row = F.xxhash64(*sorted(chunks.columns))
        digest = chunks.agg(F.count("*").alias("n"), F.bit_xor(row).alias("x"), F.sum(F.pmod(row, F.lit(1_000_003))).alias("s")).first()
        content = f"{digest.n}-{digest.x}-{digest.s}"
        if now is not None and now["content"] == content:
            return now
        number = (now["number"] if now else 0) + 1
        new = {"number": number, "path": f"{self.root}/gen-{number:06d}", "content": content}
        chunks.write.mode("overwrite").partitionBy("collection").parquet(new["path"])
        draft, target = self._path(f"{self.root}/draft-{number:06d}"), self._path(f"{self.root}/pointers/{number:06d}")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps(new).encode()))
        out.close()
        if self._fs.exists(target) or not self._fs.rename(draft, target):
            raise PublishRefused(f"generation {number} exists")
        return new

    def collect_garbage(self, keep: int = 2) -> list[str]:
        """Removes all but the newest generations; their names."""
        gone = self._names()[:-keep] if keep > 0 else []
        for name in gone:
            self._fs.delete(self._path(f"{self.root}/gen-{name}"), True)
            self._fs.delete(self._path(f"{self.root}/pointers/{name}"), False)
        return gone


def export_collection(chunks: DataFrame, collection: str, path: str) -> DataFrame:
    """Writes one collection without its absolute paths; the manifest of (doc, rows, sha256) is written beside it and returned."""
    part = chunks.filter(F.col("collection") == collection).drop("src_path")
    part.write.mode("overwrite").parquet(f"{path}/index")
    manifest = _manifest(chunks.sparkSession.read.parquet(f"{path}/index"))
    manifest.write.mode("overwrite").parquet(f"{path}/manifest")
    return chunks.sparkSession.read.parquet(f"{path}/manifest")


def _manifest(rows: DataFrame) -> DataFrame:
    line = F.sha2(F.concat_ws("\0", *(F.coalesce(F.col(c).cast("string"), F.lit("\1")) for c in sorted(rows.columns))), 256)
    return rows.withColumn("_l", line).groupBy("doc").agg(F.count("*").alias("rows"), F.sha2(F.array_join(F.array_sort(F.collect_list("_l")), "\n"), 256).alias("sha256"))


def import_collection(spark: SparkSession, path: str, name: str, model: str) -> DataFrame:
    """The rows of an export under a new name; refused where a document is missing, strange or changed, or of another model."""
    rows = spark.read.parquet(f"{path}/index")
    both = spark.read.parquet(f"{path}/manifest").alias("m").join(_manifest(rows).alias("g"), "doc", "full_outer")
    bad = both.filter(~F.col("m.sha256").eqNullSafe(F.col("g.sha256"))).select("doc").limit(5).collect()
    if bad:
        raise PublishRefused(f"the export is damaged: {', '.join(str(r.doc) for r in bad)}")
    if rows.filter(~F.col("model").eqNullSafe(F.lit(model))).limit(1).collect():
        raise PublishRefused(f"the export was not made by {model}")
    return rows.withColumn("collection", F.lit(name))


def cached_reads(wanted: DataFrame, cache: DataFrame, settings: str) -> tuple[DataFrame, DataFrame]:
    """(hits, misses) of (content_hash, ...) in a cache of (key, md); the key is a digest of content and settings."""
    keyed = wanted.withColumn("key", F.left(F.sha2(F.concat_ws("\0", "content_hash", F.lit(settings)), 256), F.lit(40)))
    return keyed.join(cache, "key"), keyed.join(cache.select("key"), "key", "left_anti")
