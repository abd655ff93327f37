"""Processing only new or changed records.

Every record of a change log has the instant at which it arrived, its commit sequence, which only grows: what arrives later never
carries an earlier one, whatever its other times are. A run reads the watermark of the last commit, fixes an upper limit at its
start, processes exactly the records in between, writes its output to a directory of its own and then publishes both the output
and the new watermark with one commit file, which appears complete and only if no other run created it first. A run that fails
before that file leaves nothing that a reader or a later run would see, so its records are processed again; a run that commits
never processes them a second time. Records may share an instant, and some of them may become visible after a run that saw the
others: each commit keeps the keys at its own limit beside its output, and the next run takes that instant again without them.

Records with a null sequence have no place in the log: they are left out, and each commit says how many it met. Records that
repeat a key are copies and are handed to the process together, in the run that first sees the key.
"""

from __future__ import annotations

import datetime
import json
import os
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


class CommitConflict(RuntimeError):
    """Another run has committed since this one read the watermark."""


class IncrementalStore:
    """Committed outputs and their watermark under one folder, on any Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.root}/_commits"))
        self._fs.mkdirs(self._path(f"{self.root}/_drafts"))

    def commits(self) -> list[dict]:
        """The commits in order; one small file each, written last."""
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/_commits")))
        return [self._read(f"{self.root}/_commits/{n}") for n in names if n.endswith(".json")]

    def _read(self, path: str) -> dict:
        stream = self._fs.open(self._path(path))
        try:
            return json.loads(bytes(b & 255 for b in stream.readAllBytes()))
        finally:
            stream.close()

    def watermark(self):
        done = self.commits()
        return _value(done[-1]["upto"]) if done else None

    def commit(self, number: int, upto, output: str, unnumbered: int = 0) -> None:
        """Publishes output and watermark together: a complete draft gets the final name, and a taken name is a conflict.

        On a local file system the name is a hard link, elsewhere a rename that never overwrites; both fail where the name exists.
        """
        name = f"_commits/{number:012d}.json"
        draft = self._path(f"{self.root}/_drafts/{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps({"number": number, "upto": _plain(upto), "output": output, "unnumbered": unnumbered}).encode()))
        out.close()
        if self._fs.getUri().getScheme() == "file":
            try:
                os.link(draft.toUri().getPath(), self._path(f"{self.root}/{name}").toUri().getPath())
            except FileExistsError:
                raise CommitConflict(f"commit {number} exists") from None
            finally:
                self._fs.delete(draft, False)
            return
        jvm = self.spark._jvm
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(draft, self._path(f"{self.root}/{name}"), options)
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                raise CommitConflict(f"commit {number} exists") from None
            raise

    def run(self, changes: DataFrame, process: Callable[[DataFrame], DataFrame], sequence: str = "seq", key: str | None = None, written: Callable[[], None] | None = None) -> int | None:
        """Processes the records after the watermark, up to the limit fixed now; the commit's number, or None where there are none.

        key names the records that share an instant; without one they count as one commit. written() is called between the output
        and its commit.
        """
        done = self.commits()
        low = _value(done[-1]["upto"]) if done else None
        ends = changes.agg(F.max(sequence).alias("high"), F.count_if(F.col(sequence).isNull()).alias("unnumbered")).first()
        if ends.high is None or low is not None and ends.high < low:
            return None
        part = changes.filter(F.col(sequence) <= F.lit(ends.high))
        if low is not None and key is None:
            part = part.filter(F.col(sequence) > F.lit(low))
        elif low is not None:
            # Only records of the last instant meet its keys; those after it pass the join by their null.
            seen = self.spark.read.parquet(*(f"{c['output']}/edge" for c in done if _value(c["upto"]) == low)).distinct()
            at_edge = F.when(F.col(sequence) == F.lit(low), F.col(key))
            part = part.filter(F.col(sequence) >= F.lit(low)).join(seen, at_edge == seen["_key"], "left_anti")
        if low is not None and part.isEmpty():
            return None
        number = done[-1]["number"] + 1 if done else 0
        output = f"{self.root}/data/{number:012d}-{uuid.uuid4().hex}"
        process(part).write.parquet(f"{output}/rows")
        if key is not None:
            changes.filter(F.col(sequence) == F.lit(ends.high)).select(F.col(key).alias("_key")).distinct().write.parquet(f"{output}/edge")
        if written is not None:
            written()
        self.commit(number, ends.high, output, ends.unnumbered)
        return number

    def read(self, schema=None) -> DataFrame:
        """All committed outputs; what a failed run left is not among them."""
        paths = [f"{c['output']}/rows" for c in self.commits()]
        if not paths:
            if schema is None:
                raise ValueError("nothing is committed yet")
            return self.spark.createDataFrame([], schema)
        return self.spark.read.parquet(*paths)

    def vacuum(self) -> int:
        """Removes outputs of runs that never committed; the number removed."""
        kept, gone = {c["output"].rsplit("/", 1)[1] for c in self.commits()}, 0
        data = self._path(f"{self.root}/data")
        for s in self._fs.listStatus(data) if self._fs.exists(data) else ():
            if s.getPath().getName() not in kept:
                self._fs.delete(s.getPath(), True)
                gone += 1
        return gone


def _plain(value):
    """A sequence as JSON: whole numbers and strings as they are, instants in UTC to the microsecond."""
    return {"instant": value.astimezone(datetime.timezone.utc).isoformat()} if isinstance(value, datetime.datetime) else value


def _value(value):
    return datetime.datetime.fromisoformat(value["instant"]).astimezone().replace(tzinfo=None) if isinstance(value, dict) else value


def resolved_path(path: Column) -> Column:
    """The absolute path: empty and '.' parts dropped, '..' takes the part before it back; null stays null."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    stack = F.aggregate(parts, F.array().cast("array<string>"), lambda s, p: F.when(p == "..", F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0)))).otherwise(F.concat(s, F.array(p))))
    walked = F.concat(F.lit("/"), F.array_join(F.when(F.exists(parts, lambda p: p == ".."), stack).otherwise(parts), "/"))
    return F.when(path.isNotNull(), walked)


def present_checksums(trace: DataFrame) -> DataFrame:
    """(src_path, src_sha256, written_at) of each file's newest conversion that has a checksum.

    Rows without a path, a checksum or a time are no statement; of rows of the same time the greater trace_id counts.
    """
    rows = trace.filter(F.col("src_path").isNotNull() & F.col("src_sha256").isNotNull() & F.col("written_at").isNotNull())
    rows = rows.select(resolved_path(F.col("src_path")).alias("src_path"), F.lower("src_sha256").alias("src_sha256"), "written_at", "trace_id")
    newest = F.max_by(F.struct("src_sha256", "written_at", "trace_id"), F.struct("written_at", "trace_id"))
    return rows.groupBy("src_path").agg(newest.alias("m")).select("src_path", "m.*")


def indexed_checksums(meta: DataFrame) -> DataFrame:
    """(src_path, indexed) of each file's newest finished build."""
    rows = meta.filter(F.col("src_path").isNotNull() & F.col("built_at").isNotNull())
    rows = rows.select(resolved_path(F.col("src_path")).alias("src_path"), F.lower("src_sha256").alias("sha"), "built_at")
    return rows.groupBy("src_path").agg(F.max_by("sha", F.struct("built_at", "sha")).alias("indexed"))


def to_process(trace: DataFrame, meta: DataFrame) -> DataFrame:
    """(src_path, src_sha256) of each file whose present checksum is not the one last indexed for it."""
    both = present_checksums(trace).join(indexed_checksums(meta), "src_path", "left")
    return both.filter(~F.col("src_sha256").eqNullSafe(F.col("indexed"))).select("src_path", "src_sha256")


FOLDED = "src_path string, src_sha256 string, written_at timestamp, trace_id long"


def take_changes(store: IncrementalStore, trace: DataFrame, written: Callable[[], None] | None = None) -> int | None:
    """One run over the trace rows that arrived since the last commit, folded into one row for each file."""
    return store.run(trace, present_checksums, "received_at", "trace_id", written)


def changed_from(store: IncrementalStore, meta: DataFrame) -> DataFrame:
    """to_process() of what the store has committed: whichever run saw a row, the folds together give the present checksums."""
    folded = store.read(FOLDED).groupBy("src_path").agg(F.max_by("src_sha256", F.struct("written_at", "trace_id")).alias("src_sha256"))
    both = folded.join(indexed_checksums(meta), "src_path", "left")
    return both.filter(~F.col("src_sha256").eqNullSafe(F.col("indexed"))).select("src_path", "src_sha256")


def changed_files(spark: SparkSession, trace: DataFrame, meta: DataFrame, root: str) -> DataFrame:
    """to_process() through the store under root: a run over what arrived since the last one, then the committed folds.

    received_at is the commit sequence: trace_id numbers conversions when they begin, and rows may arrive long after.
    """
    store = IncrementalStore(spark, root)
    take_changes(store, trace)
    return changed_from(store, meta)


class _Lost(RuntimeError):
    pass


def replayed(spark: SparkSession, trace: DataFrame, meta: DataFrame, root: str, slices: int = 3) -> DataFrame:
    """changed_files() as a service would have met the log: `slices` runs, each over what had arrived by then, every row in the end.

    The second run is lost after its output and before its commit, and is repeated; its first output stays invisible.
    """
    store = IncrementalStore(spark, root)
    ends = trace.agg(F.min("received_at").alias("a"), F.max("received_at").alias("b")).first()

    def lose() -> None:
        raise _Lost

    for k in range(1, slices + 1):
        arrived = trace
        if k < slices and ends.a is not None:
            arrived = trace.filter(F.col("received_at") <= F.lit(ends.a + (ends.b - ends.a) * k / slices))
        if k == 2:
            try:
                take_changes(store, arrived, lose)
            except _Lost:
                pass
        take_changes(store, arrived)
    return changed_from(store, meta)
