"""Take-off, the top of the initial climb, launch type and release: one row per flight."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geo import FEET
from .kinematics import beside, by_flight, in_order

# The launch kinds as users know them.
NO_LAUNCH = "no launch in this file - the trace appears to start airborne"
WINCH = "winch or bungee launch"
TOW = "aerotow"
UNCLEAR = "unclear - possibly a self-launch or a partial trace"


def takeoff(kin: DataFrame) -> DataFrame:
    """Per flight ``to_idx, to_t, to_alt`` and its number of fixes ``n``."""
    fast = F.when((F.col("gs") * 3.6 > 25) & F.col("good"), F.col("idx"))
    ends = [f(c, i).alias(f"{c}{k}") for k, i in enumerate((F.col("idx"), fast)) for f, c in ((F.min_by, "t"), (F.min_by, "alt"))]
    per = kin.groupBy("flight_id").agg(F.count("*").alias("n"), F.min(fast).alias("first"), *ends)
    waits = F.col("first").isNull() | (F.col("first") > 0) & (F.col("alt0") < F.col("alt1") - 30)
    at = lambda start, fast: F.when(waits, start).otherwise(fast)
    return per.select("flight_id", "n", at(F.lit(0).cast("long"), F.col("first")).alias("to_idx"), at(F.col("t0"), F.col("t1")).alias("to_t"), at(F.col("alt0"), F.col("alt1")).alias("to_alt"))


def initial_climb(kin: DataFrame, started: DataFrame) -> DataFrame:
    """``started`` with ``top``: the last fix (alt, idx, t) at the running maximum before the first drop of more than 60 m below it."""
    flown = beside(kin.select("flight_id", "idx", "t", "alt"), started.select("flight_id", "to_idx")).where("idx >= to_idx")
    best = F.max(F.struct("alt", "idx", "t")).over(in_order().rowsBetween(W.unboundedPreceding, 0))
    f = flown.select("flight_id", "idx", "alt", best.alias("best"))
    fell = F.when(F.col("alt") < F.col("best.alt") - 60, F.col("idx"))
    return started.join(f.groupBy("flight_id").agg(F.coalesce(F.min_by("best", fell), F.max("best")).alias("top")), "flight_id")


def find_launch(kin: DataFrame) -> DataFrame:
    """``takeoff_idx, release_idx``, their times, type, note, confident; with n, top and the mean speed.

    Take-off and top are a row per flight, so that speeds ahead are worked out
    for the fixes of the initial climb alone.
    """
    climb = initial_climb(kin, takeoff(kin)).select("flight_id", "n", "to_idx", "to_t", "to_alt", F.col("top.idx").alias("top_idx"), F.col("top.t").alias("top_t"), F.col("top.alt").alias("top_alt"))
    # a fix up to 40 past the top may be slow, and that is told from the seven after it
    f = beside(kin.select("flight_id", "idx", "t", "gs", "good"), climb).where((F.col("idx") >= F.col("to_idx")) & (F.col("idx") < F.col("top_idx") + 47))
    kmh = F.col("gs") * 3.6
    ahead = in_order().rowsBetween(0, 7)
    f = f.withColumn("__n", F.count(F.when(F.col("good"), 1)).over(ahead)).withColumn("__v", F.avg(F.when(F.col("good"), kmh)).over(ahead))
    f = f.withColumn("mspd", F.coalesce(F.avg(F.when(F.col("good") & (F.col("idx") < F.col("top_idx")), kmh)).over(by_flight()), F.lit(0.0)))
    slow = F.col("good") & (F.col("idx") >= F.col("to_idx") + 5) & (F.col("idx") < F.least(F.col("top_idx") + 40, F.col("n") - 3)) & (F.col("__n") >= 4) & (F.col("__v") < F.col("mspd") - 15)
    same = [F.first(c).alias(n) for c, n in (("to_idx", "takeoff_idx"), ("to_t", "takeoff_t"), ("to_alt", "to_alt"), ("top_idx", "top_idx"), ("top_t", "top_t"), ("top_alt", "top_alt"), ("mspd", "mspd"))]
    return judged(f.groupBy("flight_id").agg(*same, F.min(F.when(slow, F.struct("idx", "t"))).alias("slow")))


def judged(per: DataFrame) -> DataFrame:
    """Kind, release and note from take-off, top, mean speed and the first slow fix of each flight."""
    per = per.withColumn("dur", F.col("top_t") - F.col("takeoff_t")).withColumn("gain", F.col("top_alt") - F.col("to_alt"))
    kind = F.when(F.col("gain") < 50, NO_LAUNCH).when((F.col("dur") <= 100) & (F.col("gain") > 100), WINCH).when(F.col("mspd").between(90, 155) & (F.col("dur") > 100), TOW).otherwise(UNCLEAR)
    per = per.withColumn("type", kind)
    sure = (F.col("type") == TOW) & F.col("slow").isNotNull()
    # The note's wording, here and for a supplied release below.
    note = F.format_string("initial climb %.0f ft in %dm%02ds at %.0f km/h mean ground speed", F.col("gain") * FEET, F.floor(F.col("dur") / 60), F.pmod("dur", F.lit(60)), F.col("mspd"))
    return per.select(
        "flight_id", "takeoff_idx", F.when(sure, F.col("slow")["idx"]).otherwise(F.col("top_idx")).alias("release_idx"), "takeoff_t", F.when(sure, F.col("slow")["t"]).otherwise(F.col("top_t")).alias("release_t"),
        "type", note.alias("note"), sure.alias("confident"), "top_idx", "mspd", "gain", "dur",
    )


def override_release(launch: DataFrame, fixes: DataFrame, overrides: DataFrame) -> DataFrame:
    """Release at the fix nearest to ``release_time`` (first of ties) for the flights in ``overrides``; a null time leaves the flight as it is."""
    near = fixes.join(overrides.where("release_time is not null"), "flight_id").groupBy("flight_id").agg(F.min(F.struct(F.abs(F.col("t") - F.col("release_time")).alias("far"), "idx", "t")).alias("near"))
    met = launch.join(near, "flight_id", "left")
    given = F.col("near").isNotNull()
    return (
        met.withColumn("release_idx", F.when(given, F.col("near")["idx"]).otherwise(F.col("release_idx")))
        .withColumn("release_t", F.when(given, F.col("near")["t"]).otherwise(F.col("release_t")))
        .withColumn("confident", given | F.col("confident"))
        .withColumn("note", F.when(given, F.concat("note", F.lit("  [release time supplied by the operator]"))).otherwise(F.col("note")))
        .drop("near")
    )
