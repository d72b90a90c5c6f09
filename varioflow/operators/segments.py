"""Circling and straight runs.

Short runs are absorbed on the run table, one row per original run, which is far
smaller than the fixes; the outcome returns to the fixes as one array per
flight.  Whoever keeps the classified fixes computes the motion once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .kinematics import beside


def classify(kin: DataFrame, min_circle_rate: float = 6.0) -> DataFrame:
    """``circ`` by the smoothed turn rate, and ``raw_run`` counting its changes from 0."""
    order = W.partitionBy("flight_id").orderBy("idx")
    f = kin.withColumn("circ", F.abs("trs") > min_circle_rate)
    change = F.when(F.col("circ") != F.lag("circ").over(order), 1).otherwise(0)
    return f.withColumn("__c", change).withColumn("raw_run", F.sum("__c").over(order.rowsBetween(W.unboundedPreceding, 0)).cast("int")).drop("__c")


ENDS = ("a", "b", "t_a", "t_b", "alt_a", "alt_b")


def absorbed(classified: DataFrame, min_run: int = 25, passes: int = 4) -> DataFrame:
    """Original run, its ends, final run and kind."""
    runs = classified.groupBy("flight_id", "raw_run").agg(
        F.first("circ").alias("circ"), F.min("idx").alias("a"), F.max("idx").alias("b"), F.min("t").alias("t_a"), F.max("t").alias("t_b"), F.min_by("alt", "idx").alias("alt_a"), F.max_by("alt", "idx").alias("alt_b")
    )
    return absorb(runs, min_run, passes)


def absorb(runs: DataFrame, min_run: int = 25, passes: int = 4, keep: list[str] | None = None) -> DataFrame:
    """Original runs with their final one.  A pass flips every short run of its snapshot together."""
    order = W.partitionBy("flight_id").orderBy("raw_run")
    runs = runs.withColumn("run_id", F.col("raw_run")).withColumn("__a", F.col("t_a")).withColumn("__b", F.col("t_b"))
    for _ in range(passes):
        runs = runs.withColumn("circ", F.when(F.col("__b") - F.col("__a") < min_run, ~F.col("circ")).otherwise(F.col("circ")))
        change = F.when(F.col("circ") != F.lag("circ").over(order), 1).otherwise(0)
        runs = runs.withColumn("__c", change).withColumn("run_id", F.sum("__c").over(order.rowsBetween(W.unboundedPreceding, 0)).cast("int"))
        whole = W.partitionBy("flight_id", "run_id")
        runs = runs.withColumn("__a", F.min("t_a").over(whole)).withColumn("__b", F.max("t_b").over(whole))
    return runs.select("flight_id", "raw_run", "run_id", "circ", *ENDS, *(keep or []))


def relabelled(classified: DataFrame, runs: DataFrame) -> DataFrame:
    """The fixes with the final ``run_id`` and ``circ`` of their original run."""
    per_flight = runs.groupBy("flight_id").agg(F.sort_array(F.collect_list(F.struct("raw_run", "run_id", "circ"))).alias("__runs"))
    own = F.element_at("__runs", F.col("raw_run") + 1)
    return beside(classified.drop("circ"), per_flight).withColumn("run_id", own["run_id"]).withColumn("circ", own["circ"]).drop("__runs", "raw_run")


def within(fixes: DataFrame, rows: DataFrame, *columns: str) -> DataFrame:
    """The fixes of each row's run (``flight_id, run_id``) with the row's ``columns``.

    A join by flight and run would exchange and sort all fixes, which are dealt
    by flight, once the rows are too many to be sent to every task; so a
    flight's rows come to its fixes as one map.
    """
    run = rows.groupBy("flight_id", "run_id").agg(F.collect_list(F.struct(*columns)).alias("own"))
    per_flight = run.groupBy("flight_id").agg(F.map_from_entries(F.collect_list(F.struct("run_id", "own"))).alias("__own"))
    met = beside(fixes, per_flight).withColumn("__met", F.try_element_at("__own", F.col("run_id")))
    return met.where("__met is not null").select(*fixes.columns, F.inline("__met"))


def segment(kin: DataFrame, min_circle_rate: float = 6.0, min_run: int = 25, passes: int = 4) -> DataFrame:
    """The fixes with their final ``run_id`` and ``circ``."""
    classified = classify(kin, min_circle_rate)
    return relabelled(classified, absorbed(classified, min_run, passes))


def merged_runs(runs: DataFrame) -> DataFrame:
    """``flight_id, run_id, a, b, t_a, t_b, alt_a, alt_b, circ`` of ``absorbed`` runs; ends inclusive."""
    return runs.groupBy("flight_id", "run_id").agg(
        F.min("a").alias("a"), F.max("b").alias("b"), F.min("t_a").alias("t_a"), F.max("t_b").alias("t_b"), F.min_by("alt_a", "a").alias("alt_a"), F.max_by("alt_b", "b").alias("alt_b"), F.first("circ").alias("circ")
    )


def run_table(fixes: DataFrame) -> DataFrame:
    """The same runs straight from segmented fixes."""
    return fixes.groupBy("flight_id", "run_id").agg(
        F.min("idx").alias("a"), F.max("idx").alias("b"), F.min("t").alias("t_a"), F.max("t").alias("t_b"), F.min_by("alt", "idx").alias("alt_a"), F.max_by("alt", "idx").alias("alt_b"), F.first("circ").alias("circ")
    )
