"""Climbs: circle geometry, wind from drift, single circles and the best half minute."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geo import GRAVITY, KNOTS, compass
from .segments import within


def climb_runs(runs: DataFrame, launch: DataFrame, least_s: int = 30) -> DataFrame:
    """Circling runs after release that gained height over at least ``least_s`` seconds."""
    r = runs.join(launch.select("flight_id", "release_t"), "flight_id")
    return r.where(F.col("circ") & (F.col("t_a") >= F.col("release_t")) & (F.col("alt_b") > F.col("alt_a")) & (F.col("t_b") - F.col("t_a") >= least_s)).drop("release_t")


def circle_stats(fixes: DataFrame, climbs: DataFrame, wind: DataFrame | None = None) -> DataFrame:
    """Geometry of each climb.  Airspeed is held against the flight's wind, or the climb's own drift without one."""
    key = ["flight_id", "run_id"]
    steps = within(fixes, climbs, "a", "b", "t_a", "t_b", "alt_a", "alt_b").where("idx < b")
    good = F.col("good")
    own = W.partitionBy(*key)
    seconds = F.sum(F.when(good, F.col("dt"))).over(own)
    per = lambda c: F.coalesce(F.sum(F.when(good, F.col(c) * F.col("dt"))).over(own), F.lit(0.0)) / F.when(seconds > 0, seconds).otherwise(1)
    steps = steps.withColumn("drift_vx", per("vx")).withColumn("drift_vy", per("vy"))
    if wind is not None:
        steps = steps.join(wind.select("flight_id", "wx", "wy").hint("shuffle_hash"), "flight_id", "left").withColumn("drift_vx", F.coalesce("wx", "drift_vx")).withColumn("drift_vy", F.coalesce("wy", "drift_vy"))
    air = F.hypot(F.col("vx") - F.col("drift_vx"), F.col("vy") - F.col("drift_vy"))
    g = steps.groupBy(*key).agg(
        F.first("a").alias("a"), F.first("b").alias("b"), F.first("t_a").alias("start"), F.first("t_b").alias("end"), F.first("alt_a").alias("alt_bottom_m"), F.first("alt_b").alias("alt_top_m"),
        F.coalesce(F.sum(F.when(good, F.col("dtrk"))), F.lit(0.0)).alias("turned"), F.coalesce(F.median(F.when(good, air)), F.lit(0.0)).alias("va"), F.first("drift_vx").alias("drift_vx"), F.first("drift_vy").alias("drift_vy"),
    )
    return geometry(g)


def geometry(g: DataFrame, *more: str) -> DataFrame:
    """The geometry of climbs from their ends, turns, drift and median airspeed, and the columns ``more``."""
    dur = F.col("end") - F.col("start")
    rate = F.when(dur > 0, F.abs("turned") / dur).otherwise(0.0)
    g = g.withColumn("turn_rate_deg_s", rate)
    turning = lambda v: F.when(F.col("turn_rate_deg_s") > 0.5, v)
    gain = F.col("alt_top_m") - F.col("alt_bottom_m")
    return g.select(
        "flight_id", "run_id", "a", "b", "start", "end", dur.alias("duration_s"), gain.alias("gain_m"), "alt_bottom_m", "alt_top_m", F.when(dur > 0, gain / dur).otherwise(0.0).alias("avg_climb_ms"),
        (F.abs("turned") / 360).alias("circles"), F.when(F.col("turned") > 0, "right").otherwise("left").alias("direction"),
        turning(F.lit(360.0) / F.col("turn_rate_deg_s")).alias("circle_time_s"), turning(F.col("va") / F.radians("turn_rate_deg_s")).alias("radius_m"),
        turning(F.degrees(F.atan(F.col("va") * F.radians("turn_rate_deg_s") / GRAVITY))).alias("bank_deg"), (F.col("va") * 3.6).alias("airspeed_kmh"), "turn_rate_deg_s", "drift_vx", "drift_vy", *more,
    )


def wind_estimates(stats: DataFrame, least_circles: float = 1.5) -> DataFrame:
    """Per climb with enough circles: time, speed and direction of its drift."""
    e = stats.where(F.col("circles") >= least_circles)
    return e.select("flight_id", F.col("start").alias("time"), F.hypot("drift_vx", "drift_vy").alias("speed_ms"), compass(-F.col("drift_vx"), -F.col("drift_vy")).alias("from_deg"), "circles", "drift_vx", "drift_vy")


def estimate_wind(estimates: DataFrame) -> DataFrame:
    """Circle-weighted mean drift per flight; flights without an estimate have no row."""
    mean = lambda c: F.sum(F.col(c) * F.col("circles")) / F.sum("circles")
    w = estimates.groupBy("flight_id").agg(mean("drift_vx").alias("wx"), mean("drift_vy").alias("wy"), (F.max("speed_ms") - F.min("speed_ms")).alias("spread_ms"))
    return w.select("flight_id", "wx", "wy", F.hypot("wx", "wy").alias("speed_ms"), compass(-F.col("wx"), -F.col("wy")).alias("from_deg"), "spread_ms", (F.col("spread_ms") * KNOTS > 8).alias("unreliable"))


CIRCLE = "struct<k:int,start:bigint,duration_s:bigint,gain_m:int,climb_ms:double,cx:double,cy:double,ct:double,alt_m:int>"
#: A full circle in whole billionths of a degree: a sum of many turns is exact, and a full circle is one on every machine.
FULL = 360_000_000_000
WALK = f"struct<turned:bigint,turn:bigint,n:bigint,x:double,y:double,t:double,start:bigint,alt:int,circles:array<{CIRCLE}>>"


def full_circles(fixes: DataFrame, climbs: DataFrame) -> DataFrame:
    """Per climb, its full circles: ``flight_id, run_id, per_circle``.

    The turns add up along the climb until they make a circle; the next one
    starts from the same fix with nothing turned.  Accumulate-with-reset is no
    window frame, so this is a fold over the climb's fixes.

    Logged positions are coarse, so a track often comes back to exactly where it
    was, and turns then add up to exactly 360 degrees.  In floats the last place
    would decide; in billionths such a circle is full (one of n turns may lack
    n / 2 billionths of a degree).
    """
    key = ["flight_id", "run_id"]
    turn = F.floor(F.col("dtrk") * 1e9 + 0.5).cast("long").alias("turn")
    own = within(fixes, climbs.withColumn("__in", F.lit(True)), "__in").select(*key, F.struct("idx", "t", "alt", "x", "y", turn).alias("fix"))
    zero = F.from_json(F.lit('{"turned":0,"n":0,"x":0,"y":0,"t":0,"circles":[]}'), WALK)

    def step(w: Column, f: Column) -> Column:
        turned = w["turned"] + F.coalesce(w["turn"], F.lit(0).cast("long"))
        n, x, y, t = w["n"] + 1, w["x"] + f["x"], w["y"] + f["y"], w["t"] + f["t"]
        start, alt = F.coalesce(w["start"], f["t"]), F.coalesce(w["alt"], f["alt"])
        took, gain = f["t"] - start, f["alt"] - alt
        circle = F.struct(F.size(w["circles"]) + 1, start, took, gain, F.when(took != 0, gain / took).otherwise(0.0), x / n, y / n, t / n, alt).cast(CIRCLE)
        on = F.struct(turned, f["turn"], n, x, y, t, start, alt, w["circles"])
        anew = F.struct(F.lit(0), f["turn"], F.lit(1), f["x"], f["y"], f["t"], f["t"], f["alt"], F.array_append(w["circles"], circle))
        return F.when(F.abs(turned) >= FULL, anew.cast(WALK)).otherwise(on.cast(WALK))

    return own.groupBy(*key).agg(F.sort_array(F.collect_list("fix")).alias("fixes")).select(*key, F.aggregate("fixes", zero, step)["circles"].alias("per_circle"))


def best_rate(fixes: DataFrame, climbs: DataFrame, win: int = 30) -> DataFrame:
    """Per climb, the best mean climb rate from a fix to the first one ``win`` seconds on, or to the climb's end if that is four fifths of it.

    ``flight_id, run_id, best_30s_ms``; null without such a pair.  Every fix asks
    for the time ``win`` later; questions and fixes are read backwards together.
    """
    key = ["flight_id", "run_id"]
    own = within(fixes, climbs.withColumn("__in", F.lit(True)), "__in")
    here = F.struct("t", "alt")
    none = F.lit(None).cast("struct<t:bigint,alt:int>")
    event = lambda t, fix, asks: F.struct(t.alias("at"), fix.alias("fix"), asks.alias("asks"), F.col("idx").cast("long").alias("idx"))
    events = own.select(*key, F.explode(F.array(event(F.col("t"), here, none), event(F.col("t") + win, none, here))).alias("e")).select(*key, "e.*")
    back = W.partitionBy(*key).orderBy(F.desc("at"), F.col("fix").isNull(), F.desc("idx")).rowsBetween(W.unboundedPreceding, 0)
    end = F.max(F.when(F.col("fix").isNotNull(), F.struct("idx", "fix"))).over(W.partitionBy(*key))["fix"]
    met = events.select(*key, "asks", F.coalesce(F.last("fix", ignorenulls=True).over(back), end).alias("fix")).where("asks is not null")
    span = F.col("fix.t") - F.col("asks.t")
    return met.groupBy(*key).agg(F.max(F.when((span > 0) & (span >= 0.8 * win), (F.col("fix.alt") - F.col("asks.alt")) / span)).alias("best_30s_ms"))


def climb_table(fixes: DataFrame, runs: DataFrame, wind: DataFrame) -> DataFrame:
    """All climbs in time order, numbered from 1."""
    key = ["flight_id", "run_id"]
    return numbered(circle_stats(fixes, runs, wind).join(best_rate(fixes, runs), key).join(full_circles(fixes, runs), key))


def measured_table(measured: DataFrame, runs: DataFrame) -> DataFrame:
    """``climb_table`` from what ``outline.measured`` adds up along the climbs."""
    ends = [F.col(c).alias(n) for c, n in (("t_a", "start"), ("t_b", "end"), ("alt_a", "alt_bottom_m"), ("alt_b", "alt_top_m"))]
    own = measured.select("flight_id", F.inline("climbs")).join(runs.select("flight_id", "run_id", "a", "b", *ends), ["flight_id", "run_id"])
    return numbered(geometry(own, "best_30s_ms", "per_circle"))


def numbered(stats: DataFrame) -> DataFrame:
    return stats.withColumn("climb", F.row_number().over(W.partitionBy("flight_id").orderBy("start", "a")))


def climb_circles(climbs: DataFrame) -> DataFrame:
    return climbs.select("flight_id", "climb", F.explode("per_circle").alias("c")).select("flight_id", "climb", "c.*")


def geometry_or_null(circles: Column, value: Column) -> Column:
    """Circle geometry means nothing below one and a half circles."""
    return F.when(circles >= 1.5, value)


def centre_drift(circles: DataFrame) -> DataFrame:
    """Metres and metres per second from each circle's centre to the next; null for the first."""
    order = W.partitionBy("flight_id", "climb").orderBy("k")
    ahead = lambda c: F.col(c) - F.lag(c).over(order)
    c = circles.withColumn("drift_m", F.hypot(ahead("cx"), ahead("cy")))
    return c.withColumn("drift_ms", F.col("drift_m") / F.greatest(F.lit(1.0), ahead("ct"))).withColumn("n", F.count("*").over(W.partitionBy("flight_id", "climb"))).where("n >= 2").drop("n")


def climb_trend(circles: DataFrame) -> DataFrame:
    """Improving, decaying, oscillating or steady, from the halves of a climb's circles."""
    c = circles.withColumn("n", F.count("*").over(W.partitionBy("flight_id", "climb")))
    half = F.floor(F.col("n") / 2)
    g = c.groupBy("flight_id", "climb").agg(F.first("n").alias("n"), F.avg(F.when(F.col("k") <= half, F.col("climb_ms"))).alias("one"), F.avg(F.when(F.col("k") > F.col("n") - half, F.col("climb_ms"))).alias("two"), (F.max("climb_ms") - F.min("climb_ms")).alias("swing"))
    delta = F.col("two") - F.col("one")
    name = F.when(F.col("n") < 3, F.format_string("%d circles", "n")).when((F.abs(delta) < 0.15) & (F.col("swing") > 0.9), "oscillate").when(delta > 0.2, "improve").when(delta < -0.2, "decay").otherwise("steady")
    return g.select("flight_id", "climb", "n", name.alias("trend"))


def thin_climbs(climbs: DataFrame) -> DataFrame:
    return climbs.groupBy("flight_id").agg(F.count_if(F.col("circles") < 1.5).alias("thin"), F.count("*").alias("climbs"))
