"""Results of a corpus on disk: tables by date, and one folder per flight."""

from __future__ import annotations

import os
import re
import uuid
from collections import Counter
from collections.abc import Callable
from urllib.parse import unquote, urlsplit

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import kept

#: Rows of one file at most, whatever the session's advisory partition size is.
MAX_RECORDS = 5_000_000
#: Of very many small files that Spark writes: tasks move their own into place, not the driver all of them, one after the other.  A failed job may leave some; only ``_SUCCESS`` tells that all are there.
MANY = {"mapreduce.fileoutputcommitter.algorithm.version": "2"}


def write_by_date(rows: DataFrame, dates: DataFrame, path: str, corpus: str = "flights", whole: bool = False, max_records: int = MAX_RECORDS, unpack: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Write rows keyed by ``flight_id`` as Parquet under ``path``, by corpus and the date of their flight.

    ``dates`` has one (flight_id, date) per flight; flights without a date go to a
    partition of their own.  The dates that are written are replaced as wholes, so
    a second run of a corpus leaves one copy; its other dates and other corpora
    stay.  ``whole`` replaces all dates of the corpus.

    A date is split by size: the rows are rebalanced, so a busy date becomes many
    files of about the advisory partition size and quiet ones one file each.
    Within a file rows lie by flight, so that a reader skips to a flight.

    ``rows`` may hold several records each, as arrays; ``unpack`` makes them
    single once they are dealt, so that fewer bytes are exchanged.
    """
    dated = rows.join(dates.select("flight_id", F.col("date").cast("date").alias("date")), "flight_id", "left").hint("rebalance", "date")
    dated = unpack(dated) if unpack else dated
    order = ["date", "flight_id", *[c for c in ("t", "idx") if c in dated.columns]]
    out = dated.sortWithinPartitions(*order).write.option("maxRecordsPerFile", max_records).mode("overwrite").partitionBy("date")
    with kept.exchanges_removed(rows.sparkSession):
        out.options(partitionOverwriteMode="static" if whole else "dynamic", **kept.SMALL).parquet(f"{path}/corpus={corpus}")


def read_by_date(spark: SparkSession, path: str) -> DataFrame:
    """All corpora under ``path``, with ``corpus`` and ``date`` as columns."""
    return spark.read.option("basePath", path).parquet(path)


def named_apart(documents: DataFrame) -> DataFrame:
    """``bundle`` made unique: a name of several flights gets the digest of its flight's id behind it.

    Names are counted, not numbered: a name that a third of all flights share
    (no date, no glider) meets in no one task.
    """
    shared = documents.groupBy("bundle").agg(F.count("*").alias("n")).where("n > 1").select("bundle", F.lit(True).alias("__shared"))
    return documents.join(shared, "bundle", "left").withColumn("bundle", F.when(F.col("__shared"), F.concat_ws("-", "bundle", F.md5("flight_id"))).otherwise(F.col("bundle"))).drop("__shared")


def write_each(rows: DataFrame, path: str, name: str, value: str, end: str = "\n") -> None:
    """A file per row of ``value`` and ``end`` under ``path``, in the folder ``name=<its name>``, laid out as by ``partitionBy``.

    Where ``path`` is a mounted folder its tasks write the files themselves:
    for each file Spark's writer starts three to four programs that set its
    rights (without Hadoop's native library), which takes most of a run.
    Other stores get their files from Spark's writer.  A task that runs again
    writes the same files; ``_SUCCESS`` comes last.
    """
    spark = rows.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    folder = urlsplit(store.makeQualified(place).toUri().toString())
    if folder.scheme != "file":
        rows.select(name, value).write.options(**MANY).partitionBy(name).option("lineSep", end).text(path)
        return
    top = unquote(folder.path)
    text = F.concat(F.coalesce(F.col(value), F.lit("")), F.lit(end)).cast("binary")
    rows.select(F.col(name).cast("string"), text).foreachPartition(lambda own: _write_own(own, f"{top}/{name}="))
    store.create(spark._jvm.org.apache.hadoop.fs.Path(place, "_SUCCESS")).close()


def _write_own(rows, prefix: str) -> None:
    """The files of one task, each moved into place when it is whole."""
    part, seen = TaskContext.get().partitionId(), Counter()
    for name, value in rows:
        folder = prefix + escaped(name)
        os.makedirs(folder, exist_ok=True)
        hidden = f"{folder}/.{uuid.uuid4().hex}"
        with open(hidden, "wb") as f:
            f.write(value)
        os.replace(hidden, f"{folder}/part-{part:05}-c{seen[name]:03}.txt")
        seen[name] += 1


def escaped(name: str | None) -> str:
    """A partition's value as it stands in a folder's name."""
    return re.sub(r"""[\x01-\x1f"#%'*/:=?\\\x7f{[\]^]""", lambda m: f"%{ord(m[0]):02X}", name or "__HIVE_DEFAULT_PARTITION__")


def write_bundles(documents: DataFrame, path: str) -> None:
    """One folder ``bundle=<name>`` per flight under ``path`` with its document; all of ``path`` is replaced.

    ``documents`` has flight_id, bundle and document, as ``flight_documents`` makes them.
    """
    kept.removed(documents.sparkSession, path)
    write_each(named_apart(documents), path, "bundle", "document")


def read_bundles(spark: SparkSession, path: str) -> DataFrame:
    """``bundle, document`` of every folder, each whole."""
    text = spark.read.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").load(path)
    name = F.url_decode(F.regexp_extract(F.col("_metadata.file_path"), "bundle=([^/]+)/", 1))
    return text.select(name.alias("bundle"), F.regexp_replace("value", "\n$", "").alias("document"))
