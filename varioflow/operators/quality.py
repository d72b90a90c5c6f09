"""Trace extent, fix intervals, landing, and the flags a reader should see."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import KNOTS
from ..functions.units import duration
from .kinematics import by_flight


def trace_summary(kin: DataFrame) -> DataFrame:
    """One row per flight: extent, distance, intervals, gaps, landed."""
    f = kin.withColumn("__n", F.count("*").over(by_flight()))
    inner = F.col("idx") < F.col("__n") - 1
    dt = F.when(inner, F.col("dt"))
    tail = F.when(inner & (F.col("idx") >= F.col("__n") - 6) & F.col("good"), F.col("gs") * 3.6)
    gap = dt > 20
    largest = F.max(F.when(gap, F.struct(F.col("dt").alias("d"), (-F.col("t")).alias("back"))))
    per = f.groupBy("flight_id").agg(
        F.count("*").alias("fixes"), F.min("t").alias("start"), F.max("t").alias("end"), F.max("alt").alias("max_alt_m"), F.max_by("alt", "idx").alias("last_alt"), F.first("altitude_source").alias("altitude_source"),
        F.sum(F.when(F.col("dt") > 0, F.col("step")).otherwise(0.0)).alias("track_distance_m"),
        F.coalesce(F.median(dt), F.lit(0.0)).alias("median_interval_s"), F.coalesce(F.max(dt), F.lit(0)).alias("max_gap_s"),
        F.count_if(gap).alias("gaps_over_20s"), F.coalesce(F.sum(F.when(gap, F.col("dt"))), F.lit(0)).alias("gap_total_s"),
        largest.alias("largest"), F.coalesce(F.avg(tail), F.lit(999.0)).alias("tail_kmh"),
    )
    return (
        per.withColumn("duration_s", F.col("end") - F.col("start"))
        .withColumn("largest_gap_s", F.coalesce(F.col("largest")["d"], F.lit(0)))
        .withColumn("largest_gap_at", F.coalesce(-F.col("largest")["back"], F.lit(0)))
        .withColumn("coarse", F.col("median_interval_s") > 4)
        .withColumn("landed", (F.col("last_alt") < F.col("max_alt_m") - 300) & (F.col("tail_kmh") < 60))
        .drop("largest", "tail_kmh")
    )


def quality_flags(summary: DataFrame, warnings: DataFrame, polars: DataFrame, launch: DataFrame, wind: DataFrame) -> DataFrame:
    """``flight_id, severity, code, detail``: one row per flag."""
    s = summary.join(warnings.select("flight_id", "warning"), "flight_id", "left").join(polars.select("flight_id", F.col("note").alias("polar_note"), "matched"), "flight_id", "left")
    s = s.join(launch.select("flight_id", "type", "confident"), "flight_id", "left").join(wind.select("flight_id", "unreliable", "spread_ms"), "flight_id", "left")
    flag = lambda when, severity, code, detail: F.when(when, F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"), detail.cast("string").alias("detail")))
    share = F.col("gap_total_s") / F.greatest(F.lit(1), F.col("duration_s"))
    flags = F.array(
        flag(F.col("warning").isNotNull(), "warn", "parser", F.col("warning")),
        flag(F.col("coarse"), "warn", "coarse", F.format_string("median interval %.1f s", "median_interval_s")),
        flag(~F.col("coarse") & (F.col("largest_gap_s") >= 60), "warn", "long_gap", duration(F.col("largest_gap_s"))),
        flag((F.col("gaps_over_20s") > 0) & (F.col("largest_gap_s") < 60), "note", "gaps", F.concat_ws(" ", F.col("gaps_over_20s"), duration(F.col("gap_total_s")), F.format_string("%.1f%%", share * 100))),
        flag(F.lit(True), "note", "altitude", F.col("altitude_source")),
        flag(F.col("matched"), "note", "polar", F.col("polar_note")),
        flag(~F.col("matched"), "warn", "polar", F.col("polar_note")),
        flag(~F.col("confident") & ~F.col("type").startswith("no launch"), "warn", "release_estimated", F.col("type")),
        flag(F.col("unreliable"), "warn", "wind_unreliable", F.format_string("%.0f kt", F.col("spread_ms") * KNOTS)),
    )
    return s.select("flight_id", F.explode(F.filter(flags, lambda x: x.isNotNull())).alias("x")).select("flight_id", "x.*")
