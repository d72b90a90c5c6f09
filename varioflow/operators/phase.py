"""How a flight's time and height divide."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def phase_split(runs: DataFrame, launch: DataFrame, climbs: DataFrame, summary: DataFrame) -> DataFrame:
    """Circling counts every circling run after release; the gain only climbs.  Also the working band."""
    after = runs.join(launch.select("flight_id", "release_t"), "flight_id").where(F.col("circ") & (F.col("t_a") >= F.col("release_t")))
    circling = after.groupBy("flight_id").agg(F.sum(F.col("t_b") - F.col("t_a")).alias("circling_s"))
    gain = climbs.groupBy("flight_id").agg(F.sum(F.col("alt_b") - F.col("alt_a")).alias("gain_circling_m"), F.min("alt_a").alias("band_bottom_m"), F.max("alt_b").alias("band_top_m"))
    s = summary.select("flight_id", "end").join(launch.select("flight_id", "release_t"), "flight_id").join(circling, "flight_id", "left").join(gain, "flight_id", "left")
    s = s.withColumn("circling_s", F.coalesce("circling_s", F.lit(0))).withColumn("gain_circling_m", F.coalesce("gain_circling_m", F.lit(0))).withColumn("soaring_s", F.greatest(F.lit(1), F.col("end") - F.col("release_t")))
    return s.select(
        "flight_id", "circling_s", "soaring_s", "gain_circling_m", (F.col("soaring_s") - F.col("circling_s")).alias("straight_s"), (F.col("circling_s") / F.col("soaring_s")).alias("circling_fraction"),
        F.when(F.col("circling_s") > 0, F.col("gain_circling_m") / F.col("circling_s")).alias("mean_circling_rate_ms"), "band_bottom_m", "band_top_m",
    )


def flight_character(fraction: Column) -> Column:
    return F.when(fraction > 0.35, "thermal").when(fraction >= 0.1, "streets or energy lines").otherwise("ridge or wave")
