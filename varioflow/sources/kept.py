"""Tables kept in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a session on one machine may go without; there a temporary one is made.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="varioflow-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


#: Writer's options of tables with many rows: at 6 times sf0.1 about a third of the default codec's bytes for log texts, half for profiles.
SMALL = {"compression": "zstd"}


@contextmanager
def exchanges_removed(spark: SparkSession) -> Iterator[None]:
    """Writes in this block leave no shuffle files; else these stay until the driver's garbage is collected."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder, with the writer's ``options``, and read it back: lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of log text that a flight partition, and later a bucket, holds; a flight is bounded by the file limit.
BUCKET_BYTES = 128 << 20


def width_for(texts: DataFrame, column: str, per_bucket: int = BUCKET_BYTES) -> int:
    """How many partitions keep each near ``per_bucket`` bytes of a text column.

    At least the session's shuffle partitions, at most as many buckets as a table may have.
    """
    spark = texts.sparkSession
    total = texts.agg(F.sum(F.octet_length(F.col(column)).cast("long")).alias("b")).first()["b"] or 0
    return min(max(shuffle_width(spark), -(-total // per_bucket)), int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets")))


def dealt(df: DataFrame, key: str, width: int | None = None) -> DataFrame:
    """Rows by ``key`` over ``width`` partitions (the shuffle's unless given), as ``Kept.bucketed`` deals them."""
    return df.repartition(width or shuffle_width(df.sparkSession), key)


class Kept:
    """Tables that one owner keeps in the shared folder until ``close``."""

    def __init__(self, spark: SparkSession):
        self.spark, self.tables = spark, []
        self.folder = f"{shared_dir(spark)}/kept-{uuid.uuid4().hex}"

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it back."""
        path = f"{self.folder}/{name}-{uuid.uuid4().hex}"
        df.write.options(**SMALL).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def bucketed(self, df: DataFrame, name: str, key: str, width: int | None = None) -> DataFrame:
        """``stored``, dealt by ``key`` for good: later joins, groups and windows by it need no exchange of these rows.

        Rows that come ``dealt`` by the key and width make one file a bucket.
        """
        own = f"{name}_{uuid.uuid4().hex}"
        df.write.options(**SMALL).bucketBy(width or shuffle_width(self.spark), key).option("path", f"{self.folder}/{own}").saveAsTable(own)
        self.tables.append(own)
        return self.spark.table(own)

    def close(self) -> None:
        """Drop the tables and their files; what was read from them can no longer be used."""
        for own in self.tables:
            self.spark.sql(f"drop table if exists {own}")
        self.tables.clear()
        removed(self.spark, self.folder)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it lies."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def present(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
