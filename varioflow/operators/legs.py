"""Straight legs and their airmass balance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geo import sigma
from .kinematics import beside
from .segments import within

def by_leg():
    return W.partitionBy("flight_id").orderBy("a")


def leg_runs(runs: DataFrame, launch: DataFrame, least_s: int = 60) -> DataFrame:
    r = runs.join(launch.select("flight_id", "release_t"), "flight_id")
    return r.where(~F.col("circ") & (F.col("t_a") >= F.col("release_t")) & (F.col("t_b") - F.col("t_a") >= least_s)).drop("release_t")


def circuit_entry(kin: DataFrame, summary: DataFrame, height: int = 300) -> DataFrame:
    """First fix from which the trace stays below its last altitude + ``height``; null if it did not land."""
    f = beside(kin.select("flight_id", "idx", "t", "alt"), summary.select("flight_id", "last_alt", "landed"))
    above = F.max(F.when(F.col("alt") >= F.col("last_alt") + height, F.col("idx"))).over(W.partitionBy("flight_id"))
    f = f.withColumn("entry", F.when(F.col("landed"), F.coalesce(above, F.lit(-1)) + 1))
    return f.groupBy("flight_id").agg(F.first("entry").alias("entry"), F.max(F.when(F.col("idx") == F.col("entry"), F.col("t"))).alias("entry_t"), F.max(F.when(F.col("idx") == F.col("entry"), F.col("alt"))).alias("entry_alt"))


def split_legs(legs: DataFrame, entry: DataFrame, least_s: int = 60, split_circuit: bool = True) -> DataFrame:
    """Cut a leg at circuit entry if both halves keep ``least_s`` seconds; the halves share the entry fix."""
    f = legs.join(entry, "flight_id", "left")
    if not split_circuit:
        f = f.withColumn("entry", F.lit(None).cast("long"))
    cut = (F.col("entry") > F.col("a")) & (F.col("entry") < F.col("b")) & (F.col("entry_t") - F.col("t_a") >= least_s) & (F.col("t_b") - F.col("entry_t") >= least_s)
    part = lambda a, b: F.struct(*[F.col(c).alias(n) for c, n in ((a[0], "a"), (b[0], "b"), (a[1], "t_a"), (b[1], "t_b"), (a[2], "alt_a"), (b[2], "alt_b"))])
    one, mid, end = ("a", "t_a", "alt_a"), ("entry", "entry_t", "entry_alt"), ("b", "t_b", "alt_b")
    pieces = F.when(cut, F.array(part(one, mid), part(mid, end))).otherwise(F.array(part(one, end)))
    out = f.select("flight_id", "run_id", "entry", F.explode(pieces).alias("p")).select("flight_id", "run_id", "entry", "p.*")
    return out.withColumn("leg", F.row_number().over(by_leg()))


def analyse_legs(kin: DataFrame, legs: DataFrame, polars: DataFrame, wind: DataFrame) -> DataFrame:
    """Distance, speeds and energy balance over the steps [a, b) of each leg.

    ``polars`` has the coefficients c0, c1, c2 of each flight (null: no airmass).
    """
    each = airs(legs, polars, wind)
    return analyse_steps(within(kin, each, *[c for c in each.columns if c not in ("flight_id", "run_id")]).where((F.col("idx") >= F.col("a")) & (F.col("idx") < F.col("b"))))


def airs(legs: DataFrame, polars: DataFrame, wind: DataFrame) -> DataFrame:
    """Each leg with the polar and the wind of its flight."""
    own = legs.select("flight_id", "run_id", "leg", "a", "b", "t_a", "t_b", "alt_a", "alt_b")
    return own.join(polars.select("flight_id", "c0", "c1", "c2"), "flight_id", "left").join(wind.select("flight_id", "wx", "wy"), "flight_id", "left")


def analyse_steps(steps: DataFrame) -> DataFrame:
    """The balance of the legs from their fixes, each with ``airs`` of its leg."""
    key = ["flight_id", "leg"]
    root = F.sqrt(sigma(F.col("alt")))
    steps = steps.withColumn("eas", F.hypot(F.col("vx") - F.coalesce("wx", F.lit(0.0)), F.col("vy") - F.coalesce("wy", F.lit(0.0))) * root)
    steps = steps.withColumn("w", F.col("vz") + (F.col("c0") + F.col("c1") * F.col("eas") + F.col("c2") * F.col("eas") * F.col("eas")) / root)
    good = F.col("good")
    g = steps.groupBy(*key).agg(
        *[F.first(c).alias(c) for c in ("run_id", "a", "b", "t_a", "t_b", "alt_a", "alt_b")],
        F.sum(F.when(F.col("dt") > 0, F.col("step")).otherwise(0.0)).alias("distance_m"), F.avg(F.when(good, F.col("eas") * 3.6)).alias("mean_ias_kmh"), F.stddev_pop(F.when(good, F.col("eas") * 3.6)).alias("sd"), F.count(F.when(good, 1)).alias("n"),
        F.sum(F.when(good & F.col("w").isNotNull(), F.col("dt"))).alias("sampled_s"), F.sum(F.when(good, F.col("w") * F.col("dt"))).alias("wt"), F.coalesce(F.sum(F.when(good & (F.col("w") > 0), F.col("dt"))), F.lit(0)).alias("up"),
    )
    return balance(g)


def balance(g: DataFrame) -> DataFrame:
    """The balance of the legs from what adds up along them."""
    dh = F.col("alt_b") - F.col("alt_a")
    return g.select(
        "flight_id", "leg", "run_id", "a", "b", F.col("t_a").alias("start"), F.col("t_b").alias("end"), (F.col("t_b") - F.col("t_a")).alias("duration_s"), "distance_m", dh.alias("dh_m"), F.when(dh < 0, F.col("distance_m") / -dh).alias("ld_over_ground"),
        "mean_ias_kmh", F.when(F.col("n") > 2, F.col("sd")).alias("sd_ias_kmh"), F.col("alt_a").alias("alt_start_m"), F.col("alt_b").alias("alt_end_m"),
        (F.col("wt") / F.col("sampled_s")).alias("mean_airmass_ms"), F.when(F.col("sampled_s") > 0, F.col("up") / F.col("sampled_s")).alias("frac_rising_air"), "sampled_s",
    )


def leg_kinds(legs: DataFrame, entry: DataFrame, summary: DataFrame, split_circuit: bool = True) -> DataFrame:
    """Cruise, final glide or circuit."""
    f = legs.join(entry.select("flight_id", "entry"), "flight_id", "left").join(summary.select("flight_id", "landed", "last_alt"), "flight_id")
    if not split_circuit:
        f = f.withColumn("entry", F.lit(None).cast("long"))
    after = F.lead("a").over(by_leg())
    last = after.isNull() | (after >= F.col("entry"))
    fall = F.when(F.col("duration_s") > 0, -F.col("dh_m") / F.col("duration_s")).otherwise(0.0)
    kind = (
        F.when(F.col("entry").isNull(), F.when(F.col("landed") & (F.col("alt_end_m") < F.col("last_alt") + 250), "circuit").otherwise("cruise"))
        .when(F.col("a") >= F.col("entry"), "circuit")
        .when(last & (F.col("dh_m") < -300) & (fall >= 0.5), "final glide")
        .otherwise("cruise")
    )
    return f.withColumn("kind", kind).withColumn("circuit", F.col("kind") == "circuit").drop("entry", "landed", "last_alt")


def rising_air(legs: DataFrame) -> DataFrame:
    """Sampled-time-weighted share of rising air over the legs that are no circuit."""
    use = legs.where("not circuit and frac_rising_air is not null")
    return use.groupBy("flight_id").agg((F.sum(F.col("frac_rising_air") * F.col("sampled_s")) / F.sum("sampled_s")).alias("rising_air_fraction"))
