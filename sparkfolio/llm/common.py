"""What the corpus operators share: shared folders, lineage cuts and joins with small sides."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side of narrow rows (keys and a few numbers) is broadcast.
BROADCAST_ROWS = 100_000
#: Copies of the small side beyond that, so that a hot key is dealt to as many tasks.
SALTS = 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session, as in tests, gets one of its own where that is unset."""
    sc = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if known is None and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    known = known or f"file://{tempfile.mkdtemp(prefix='spark-shared-', dir='/tmp')}"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(known)
    return known


def cut(df: DataFrame) -> DataFrame:
    """The same rows from the shared folder, without lineage; what reads them survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows as a Parquet table in the shared folder; smaller than a checkpoint where rows are many."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_small(big: DataFrame, small: DataFrame, on: list[str], max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Left join of rows with a narrow side of one row a key: broadcast if it is counted small, else salted.

    Keys must not be null. In the salted form each row of ``big`` draws a salt and ``small`` is copied to
    every salt, so one key that holds a third of all rows still spreads over ``SALTS`` tasks.
    """
    small = cut(small)
    if small.count() <= max_rows:
        return big.join(F.broadcast(small), on, "left")
    dealt = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    drawn = big.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    return drawn.join(dealt, [*on, "_salt"], "left").drop("_salt")
