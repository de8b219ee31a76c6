"""Reading the input tables and cutting lineage with written tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ends the reuse of shuffle files with the query that wrote them; a lost file is computed again.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset, and all run in one process, one made for this session."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = spark.conf.get("latentia.tables.dir", None) or f"file://{tempfile.mkdtemp(prefix='latentia-')}"
        spark.conf.set("latentia.tables.dir", base)
    return base


def keep(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends here and an executor's loss costs nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/latentia-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._latentia_path = path
    return out


def forget(df: DataFrame) -> None:
    """Deletes a table that keep() wrote and nothing reads any more."""
    path = getattr(df, "_latentia_path", None)
    if path:
        jvm = df.sparkSession.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def small_batches(spark: SparkSession, size: int = 8 << 20) -> None:
    """Bounds the bytes of a batch that goes to Python workers; whole texts are long, and a batch is held on both sides."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.sub(r"\D", "", str(spark.conf.get(key)))
    if not now or int(now) > size:
        spark.conf.set(key, str(size))


def id_remainder(key: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % n


def volume(docs: DataFrame, column: str = "text") -> tuple[int, int]:
    """Rows, and bytes of a text column."""
    row = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()
    return int(row[0]), int(row[1])


def parts(spark: SparkSession, size: int, each: int) -> int:
    """Groups of about `each` units, at least as many as the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // each), 1)
