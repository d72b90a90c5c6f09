"""Declared tasks: scoring points, legs and the task's shape."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geo import bearing, haversine

def by_flight():
    return W.partitionBy("flight_id")


def in_order():
    return by_flight().orderBy("seq")


def scoring_points(points: DataFrame) -> DataFrame:
    """Start, turnpoints and finish; all points if that leaves none."""
    ends = F.coalesce(F.col("role").isin("takeoff", "landing"), F.lit(False))
    return points.withColumn("__own", ~ends).withColumn("__some", F.max("__own").over(by_flight())).where(F.col("__own") | ~F.col("__some")).drop("__own", "__some")


def task_legs(points: DataFrame) -> DataFrame:
    """Consecutive scoring points: names, great-circle distance and initial bearing."""
    label = F.when(F.length("name") > 0, F.col("name")).otherwise(F.format_string("%.3f, %.3f", "lat", "lon"))
    p = scoring_points(points).withColumn("label", label).withColumn("leg", F.row_number().over(in_order()))
    after = F.lead(F.struct("label", "lat", "lon")).over(in_order())
    p = p.withColumn("to", after).where("to is not null")
    a, b = (F.col("lat"), F.col("lon")), (F.col("to")["lat"], F.col("to")["lon"])
    return p.select("flight_id", "leg", F.col("label").alias("from"), F.col("to")["label"].alias("to"), haversine(*a, *b).alias("distance_m"), bearing(*a, *b).alias("bearing_deg"))


def task_summary(points: DataFrame, declared: DataFrame) -> DataFrame:
    """One row per flight with at least two scoring points."""
    own = scoring_points(points).groupBy("flight_id").agg(F.count("*").alias("n"), F.min_by(F.struct("lat", "lon"), "seq").alias("first"), F.max_by(F.struct("lat", "lon"), "seq").alias("last")).where("n >= 2")
    total = task_legs(points).groupBy("flight_id").agg(F.sum("distance_m").alias("distance_m"), F.count("*").alias("legs"))
    end = lambda role: F.min_by(F.when(F.col("role") == role, F.struct("name", "lat", "lon")), F.when(F.col("role") == role, F.col("seq"))).alias(role)
    ends = points.groupBy("flight_id").agg(end("takeoff"), end("landing"))
    t = own.join(total, "flight_id").join(ends, "flight_id").join(declared, "flight_id", "left")
    closed = haversine(F.col("first")["lat"], F.col("first")["lon"], F.col("last")["lat"], F.col("last")["lon"]) < 1000
    legs = F.col("legs")
    # The names of shapes.
    shape = (
        F.when(closed & (legs == 2), "out and return").when(closed & (legs == 3), "triangle").when(closed & (legs == 4), "quadrilateral").when(closed, F.format_string("%d-leg closed course", legs))
        .when(legs == 1, "straight distance").otherwise(F.format_string("%d-leg task", legs))
    )
    return t.select("flight_id", "distance_m", "legs", closed.alias("closed"), shape.alias("shape"), F.greatest(F.lit(0), F.col("n") - 2).alias("task_turnpoints"), "takeoff", "landing", "description", "declared_date", "declared_time_s", "turnpoints")
