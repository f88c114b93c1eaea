"""Helpers that the training-data operators share."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.session import reachable


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only where that is unset and Spark is one process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="ledgerline-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def durable(df: DataFrame, parts: int | None = None, codec: str = "snappy") -> DataFrame:
    """Cut the lineage: write to the shared folder and read again, so that a lost executor costs no recomputation.

    `parts` bounds the number of files of a table whose last step is a shuffle; many tiny files cost more than they carry.
    """
    spark = df.sparkSession
    df = df.coalesce(parts) if parts else df
    path = f"{shared_folder(spark)}/ledgerline/{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that `durable` wrote and nothing reads any more."""
    spark = df.sparkSession
    for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/ledgerline/" in name:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes of a batch of rows that a Python worker gets at once; one row may be longer.
BATCH_BYTES = 2 << 20


def small_batches(spark: SparkSession) -> SparkSession:
    """Let rows travel to Python workers in batches of bounded bytes from now on; a smaller bound of the session stays.

    Spark's own bound of 64 MB lets 10,000 texts make a batch.  Both sides hold it several times over, once for each
    core, and what a worker has once used it seldom gives back.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name, "64m"))
    if now > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))
    return spark


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """Column names that `df` does not have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in stems:
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out


def pieces(n: int, per_piece: int) -> int:
    """How many groups of about `per_piece` rows `n` rows make, one at least."""
    return max(1, math.ceil(n / per_piece))


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Deal rows by the hash of columns over the session's shuffle partitions, which adaptive execution does not merge away."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *[F.col(c) for c in columns])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return reachable(spark).read.parquet(f"{sf_dir}/{name}.parquet")
