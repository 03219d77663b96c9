"""Stored tables: versions of tasks' rows with tokens, files by owner, and ordered lists that are read at any page.

``Store`` keeps tasks' rows in buckets by hash of the task. A commit writes the buckets that it touches anew, below a folder of its own, and then moves a manifest in
place: the list of each bucket's folder as of this version. Nothing is ever overwritten, so readers see whole versions, a commit that fails leaves the last version as it
was, and going back is a manifest that lists the old folders again. The move refuses to replace a manifest; the writer that comes second starts over on the new version, where tokens of tasks
that the first one changed are stale. Paths are those of any file system that Spark reads; rename must be atomic there (HDFS, local files).
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sparkfolio.operators.canon import content_token, fresh_tokens

BUCKETS = 64


class _Files:
    """The few file operations that Spark's readers and writers don't have."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.gateway = spark._jvm, spark.sparkContext._gateway
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self.path(root).getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def names(self, folder: str) -> list[str]:
        at = self.path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, name: str, body: str) -> bool:
        """Writes a file whole or not at all; False if there is one of that name."""
        draft = self.path(f"{name.rpartition('/')[0]}/.{uuid.uuid4().hex}")
        stream = self.fs.create(draft, True)
        stream.write(bytearray(body.encode()))
        stream.close()
        options = self.gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self.conf).rename(self.fs.makeQualified(draft), self.fs.makeQualified(self.path(name)), options)
        except Exception as e:
            self.fs.delete(draft, False)
            if "FileAlreadyExists" in str(e):
                return False
            raise
        return True


@dataclass
class Version:
    """A manifest: what it is called, the version it was made from, and each bucket's folder."""

    number: int = 0
    kind: str = ""
    schema: dict | None = None
    buckets: dict[str, str] = field(default_factory=dict)


class Store:
    """Rows (task_id, ...) by task, in versions. ``columns``: what a task's token covers (default: all others)."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS, columns: tuple[str, ...] = ()):
        self.spark, self.root, self.buckets, self.columns = spark, root, buckets, columns
        self.files = _Files(spark, root)

    def head(self) -> Version:
        """The last version; number 0 before any commit."""
        numbers = [int(n) for n in self.files.names(f"{self.root}/manifests") if n.isdigit()]
        return self.version(max(numbers)) if numbers else Version()

    def version(self, number: int) -> Version:
        return Version(**json.loads(self.files.read(f"{self.root}/manifests/{number:012d}")))

    def read(self, version: Version | None = None, only: list[int] | None = None) -> DataFrame:
        """All rows of a version (default: the last), or of some of its buckets."""
        version = version or self.head()
        if version.schema is None:
            raise ValueError("nothing was committed yet")
        schema = StructType.fromJson(version.schema)
        paths = [p for b, p in version.buckets.items() if only is None or int(b) in only]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def tokens(self, rows: DataFrame | None = None) -> DataFrame:
        """(task_id, token) of each task."""
        rows = self.read() if rows is None else rows
        return content_token(rows, *(self.columns or [c for c in rows.columns if c != "task_id"]))

    def _bucket(self):
        return F.pmod(F.xxhash64("task_id"), F.lit(self.buckets)).cast("int")

    def commit(self, rows: DataFrame, offered: DataFrame, kind: str = "edit", seen: Version | None = None) -> tuple[Version, DataFrame]:
        """Replaces the rows of the tasks in ``offered`` (task_id, token) by theirs in ``rows``; the new version, and the tasks refused (task_id) because their token is stale.

        The token of a task without rows is null. A task with a fresh token and no new rows goes. ``seen``: the version to start from (default: the last).
        """
        touched = [r[0] for r in offered.select(self._bucket()).distinct().collect()]  # at most as many as there are buckets
        base = seen or self.head()
        while True:
            schema = StructType.fromJson(base.schema) if base.schema else rows.schema
            current = self.read(base, touched) if base.schema else self.spark.createDataFrame([], schema)
            known = offered.select("task_id").join(self.tokens(current), "task_id", "left").withColumn("token", F.coalesce("token", F.lit("")))
            fresh = fresh_tokens(known, offered.select("task_id", F.coalesce("token", F.lit("")).alias("token")))
            accepted = fresh.where("fresh").select("task_id")
            kept = current.join(accepted, "task_id", "left_anti").unionByName(rows.join(accepted, "task_id", "left_semi").select(*schema.names))
            folder = f"{self.root}/data/{uuid.uuid4().hex}"
            kept.withColumn("_bucket", self._bucket()).hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(folder)
            written = {n.partition("=")[2]: f"{folder}/{n}" for n in self.files.names(folder) if n.startswith("_bucket=")}
            buckets = {b: p for b, p in base.buckets.items() if int(b) not in touched} | written
            made = Version(base.number + 1, kind, json.loads(schema.json()), buckets)
            if self.files.publish(f"{self.root}/manifests/{made.number:012d}", json.dumps(asdict(made))):
                return made, fresh.where("not fresh").select("task_id")
            base = self.head()  # another writer came first

    def rollback(self, number: int) -> Version:
        """A new version that is version ``number`` again; no rows are read or written."""
        old = self.version(number)
        while True:
            made = Version(self.head().number + 1, f"rollback:{number}", old.schema, old.buckets)
            if self.files.publish(f"{self.root}/manifests/{made.number:012d}", json.dumps(asdict(made))):
                return made

    def before_last(self, kind: str) -> int:
        """The version that the last commit of a kind was made from."""
        number = self.head().number
        while number and self.version(number).kind != kind:
            number -= 1
        if number < 2:
            raise ValueError(f"no version before one of kind {kind}")
        return number - 1


def write_owned(files: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Files (business_type, business_id, ...) partitioned by type and bucket of id. Large owners are split over files, small ones share them."""
    bucket = F.pmod(F.xxhash64("business_id"), F.lit(buckets)).cast("int")
    files.withColumn("id_bucket", bucket).hint("rebalance", "business_type", "id_bucket").write.partitionBy("business_type", "id_bucket").parquet(path)


def owned_by(spark: SparkSession, path: str, owners: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """The files of the owners (business_type, business_id): partitions without any of them are pruned when the owners are known, at run time."""
    wanted = owners.select("business_type", "business_id").distinct().withColumn("id_bucket", F.pmod(F.xxhash64("business_id"), F.lit(buckets)).cast("int"))
    return spark.read.parquet(path).join(wanted, ["business_type", "id_bucket", "business_id"]).drop("id_bucket")


def write_pages(rows: DataFrame, path: str, keys: list[tuple[str, bool]], ranges: int | None = None) -> None:
    """Rows as an ordered list: ranges of the order of ``keys`` (name, whether downwards), one a folder, with each row's number within its range; and ``_sizes``, the ranges' numbers of rows.

    ``ranges``: how many; by default as many as Spark finds right for the bytes.
    """
    order = [F.desc(n) if down else F.asc(n) for n, down in keys]
    ranged = (rows.repartitionByRange(ranges, *order) if ranges else rows.repartitionByRange(*order)).sortWithinPartitions(*order)
    numbered = ranged.withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    numbered.write.partitionBy("part").parquet(path)
    rows.sparkSession.read.parquet(path).groupBy("part").count().write.parquet(f"{path}/_sizes")


def read_page(spark: SparkSession, path: str, page: int, size: int) -> DataFrame:
    """One page of such a list, however deep, with the total; pages and sizes below 1 are 1, a page behind the last is empty. Of the rows, only the ranges that hold it are read."""
    page, size = max(1, page), max(1, size)
    first, parts, before = (page - 1) * size, {}, 0
    for part, n in sorted(tuple(r) for r in spark.read.parquet(f"{path}/_sizes").collect()):  # a row for each range
        if before < first + size and before + n > first:
            parts[part] = before
        before += n
    base = F.lit(0)
    for part, start in parts.items():
        base = F.when(F.col("part") == part, start).otherwise(base)
    rows = spark.read.parquet(path).where(F.col("part").isin(list(parts))).withColumn("_place", base + F.col("row"))
    rows = rows.where((F.col("_place") >= first) & (F.col("_place") < first + size))
    return rows.orderBy("_place").drop("part", "row", "_place").withColumn("total", F.lit(before).cast("long"))
