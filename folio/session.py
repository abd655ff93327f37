"""Session helpers: table access, the shared folder, lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship_package(spark: SparkSession) -> None:
    """Make this package importable by Python workers of a cluster whose PYTHONPATH lacks it."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if spark.sparkContext.master.startswith("local[") or root in os.environ.get("PYTHONPATH", "").split(":"):
        return
    if getattr(spark.sparkContext, "_folio_shipped", False):
        return
    import shutil

    base = os.path.join(tempfile.mkdtemp(), "folio")
    spark.sparkContext.addPyFile(shutil.make_archive(base, "zip", root, "folio"))
    spark.sparkContext._folio_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: spark.checkpoint.dir, or a folder of our own where it is unset."""
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf
    own = getattr(spark.sparkContext, "_folio_dir", None)
    if own is None:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="folio-shared-")
        spark.sparkContext.setCheckpointDir(own)
        spark.sparkContext._folio_dir = own
    return own


def cut(df: DataFrame) -> DataFrame:
    """Compute once and cut the lineage, into the reliable checkpoint folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def keep_scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder that clean() removes."""
    path = scratch(spark, name)
    spark.sparkContext._folio_kept = [*getattr(spark.sparkContext, "_folio_kept", []), path]
    return path


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame) -> DataFrame:
    """df over as many tasks as the session shuffles with, where its scan has fewer; a table of many splits stays as it is.

    For work that costs far more a row than moving the row does, such as tokenising.
    """
    wanted = parallelism(df.sparkSession)
    return df.repartition(wanted) if df._jdf.queryExecution().toRdd().getNumPartitions() < wanted else df


def drop_scratch(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def num_words(text: Column) -> Column:
    """Runs of characters other than space, tab, CR and LF; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\r\n]+")), F.lit(0))


def est_tokens(text: Column) -> Column:
    """The size estimate max(floor(words * 1.3) + 1, floor(code points / 4)); 0 where there are no words."""
    words = num_words(text)
    return F.when(words > 0, F.greatest(F.floor(words * F.lit(1.3)).cast("long") + 1, F.floor(F.length(text) / 4).cast("long"))).otherwise(F.lit(0).cast("long"))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, computed once and kept as Parquet in the shared folder; clean() removes what a session kept."""
    spark = df.sparkSession
    path = keep_scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept._folio_path = path
    return kept


def release(df: DataFrame) -> None:
    """Removes a table of materialize() that nothing will read again."""
    path = getattr(df, "_folio_path", None)
    if path is not None:
        context = df.sparkSession.sparkContext
        context._folio_kept = [p for p in getattr(context, "_folio_kept", []) if p != path]
        drop_scratch(df.sparkSession, path)


def clean(spark: SparkSession) -> None:
    """Removes the tables that materialize() kept; results that read them are invalid afterwards."""
    for path in getattr(spark.sparkContext, "_folio_kept", []):
        drop_scratch(spark, path)
    spark.sparkContext._folio_kept = []


def bounded_sample(df: DataFrame, keys: list[str], size: int, n: int | None = None) -> list:
    """About `size` rows of df, chosen by a hash of keys, on the driver; all of them where there are no more.

    Only chosen rows leave their tasks, so the driver gets no more from many partitions than from few.
    """
    n = df.count() if n is None else n
    # Four deviations and a few rows more than asked for, so that enough are there.
    share = min(1.0, (size + 4 * size**0.5 + 12) / max(1, n))
    place = F.shiftrightunsigned(F.xxhash64(*keys), 11) / float(1 << 53)
    rows = df.withColumn("_place", place).filter(F.col("_place") < share).limit(2 * size + 64).collect()
    return sorted(rows, key=lambda r: (r._place, tuple(str(r[k]) for k in keys)))[:size]
