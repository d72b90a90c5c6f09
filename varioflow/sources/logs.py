"""Log files to lines, and what is no log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import parse

#: A larger file is refused; it also bounds a flight's partition.
MAX_BYTES = 40 * 1024 * 1024


#: Ends of a line.
ENDS = r"\r\n|\n|\r"
#: Names of log files.
LOGS = "*.[iI][gG][cC]"


def _found(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def read_logs(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES, pattern: str = LOGS) -> DataFrame:
    """``flight_id, source, text`` of every log file below ``path``, decoded as Latin-1."""
    files = _found(spark, path, pattern)
    return files.where(F.col("length") <= max_bytes).select(F.sha2("path", 256).alias("flight_id"), F.col("path").alias("source"), F.decode("content", "ISO-8859-1").alias("text"))


def refused(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES, pattern: str = LOGS) -> DataFrame:
    """``source, length`` of the files that are too large."""
    files = _found(spark, path, pattern)
    return files.where(F.col("length") > max_bytes).select(F.col("path").alias("source"), "length")


def split_lines(texts: DataFrame) -> DataFrame:
    """``flight_id, source, line_no, line``; empty lines are skipped but keep their numbers."""
    lines = texts.select("flight_id", "source", F.posexplode(F.split("text", ENDS)).alias("line_no", "line"))
    return lines.where("line <> ''")


def lines_of_kinds(texts: DataFrame, kinds: str) -> DataFrame:
    """``split_lines`` of the records of some ``kinds``, letters in capitals, alone; ``line_no`` counts these.

    The others are not cut out of the text, as most lines are fixes.
    """
    own = rf"[{kinds}{kinds.lower()}](?<![^\r\n].)[^\r\n]*"
    return texts.select("flight_id", "source", F.posexplode(F.regexp_extract_all("text", F.lit(own), F.lit(0))).alias("line_no", "line"))


def heads(texts: DataFrame, kinds: str = "AHCI") -> DataFrame:
    """``flight_id, source, own, longest``, a row per log: its lines of some ``kinds``, letters in capitals, and the length of its longest B line."""
    split = texts.select("flight_id", "source", F.split("text", ENDS).alias("lines"))
    own = F.filter("lines", lambda x: parse.kind(x).isin(*kinds))
    return split.select("flight_id", "source", own.alias("own"), F.array_max(F.transform(F.filter("lines", lambda x: x.startswith("B")), F.length)).alias("longest"))


def looks_like_log(text: Column) -> Column:
    return text.rlike("(?m)^B[0-9]{6}[0-9]{7}[NS]")


def rejects(files: DataFrame, fixes: DataFrame) -> DataFrame:
    """Files without a usable fix; a corpus job reports them and goes on."""
    without = files.select("flight_id", "source").distinct().join(fixes.select("flight_id").distinct(), "flight_id", "left_anti")
    return without.withColumn("reason", F.lit("no usable B records"))


def sorted_out(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES, pattern: str = LOGS) -> DataFrame:
    """``source, reason`` of every file below ``path`` that gives no flight: too large, or without a usable fix.

    The files are listed once and each read once, up to its first usable fix; no line is exchanged.
    """
    files = _found(spark, path, pattern)
    text = F.decode("content", "ISO-8859-1")
    bare = files.where(F.col("length") <= max_bytes).where(~F.exists(F.split(text, ENDS), parse.usable))
    large = files.where(F.col("length") > max_bytes)
    reason = lambda found, why: found.select(F.col("path").alias("source"), F.lit(why).alias("reason"))
    return reason(bare, "no usable B records").unionByName(reason(large, "larger than the limit"))


def read_polars(spark: SparkSession, path: str) -> DataFrame:
    """The polar database ``{gliders, default}`` as rows: name, match, published, points, db_order, is_default."""
    point = "array<array<double>>"
    published = "struct<best_ld:double,best_ld_kmh:double,min_sink_ms:double>"
    entry = f"struct<name:string,match:array<string>,published:{published},points:{point}>"
    raw = spark.read.schema(f"gliders array<{entry}>, `default` {entry}").json(path, multiLine=True)
    gliders = raw.select(F.posexplode("gliders").alias("db_order", "g")).withColumn("is_default", F.lit(False))
    default = raw.select(F.lit(1 << 30).alias("db_order"), F.col("default").alias("g")).withColumn("is_default", F.lit(True))
    return gliders.unionByName(default).select("g.name", "g.match", "g.published", "g.points", "db_order", "is_default")
