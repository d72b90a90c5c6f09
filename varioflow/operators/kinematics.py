"""Altitude choice, local projection and per-fix motion, windows or groups by flight."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geo import EARTH_M, compass, far_angle, near_angle, nearest_64th, wrap

DAY = 86400


def by_flight():
    return W.partitionBy("flight_id")


def in_order():
    return by_flight().orderBy("idx")


def beside(kin: DataFrame, per: DataFrame) -> DataFrame:
    """Each fix with its flight's row: those rows are few, so they are hashed and the fixes not sorted for it."""
    return kin.join(per.hint("shuffle_hash"), "flight_id")


def choose_altitude(fixes: DataFrame) -> DataFrame:
    """``alt`` and ``altitude_source``: pressure if it moves more than 100 m and starts plausibly."""
    low, high = F.min("palt").over(by_flight()), F.max("palt").over(by_flight())
    alive = (high - low > 100) & (low > -500) & (low < 15000)
    return fixes.withColumn("altitude_source", F.when(alive, "pressure").otherwise("GNSS")).withColumn("alt", F.when(F.col("altitude_source") == "pressure", F.col("palt")).otherwise(F.col("galt")))


def project(fixes: DataFrame) -> DataFrame:
    """Equirectangular metres about the flight's mean position, the mean from exact integer sums."""
    mean = lambda c: F.sum(c).over(by_flight()) / (F.count("*").over(by_flight()) * F.lit(60000.0))
    f = fixes.withColumn("__lat0", mean("lat_mm")).withColumn("__lon0", mean("lon_mm"))
    x = F.radians(F.col("lon") - F.col("__lon0")) * EARTH_M * F.cos(F.radians("__lat0"))
    y = F.radians(F.col("lat") - F.col("__lat0")) * EARTH_M
    return f.withColumn("x", x).withColumn("y", y).drop("__lat0", "__lon0")


def motion(fixes: DataFrame, max_gap: int = 12) -> DataFrame:
    """Step to the next fix, track through the neighbours, turn rate and its smoothed value."""
    beside = {f"__{n}_{c}": f(c).over(in_order()) for f, n, cs in ((F.lead, "next", ("t", "x", "y", "alt")), (F.lag, "last", ("x", "y"))) for c in cs}
    f = fixes.withColumns(beside)
    f = f.withColumn("dt", F.coalesce(F.col("__next_t") - F.col("t"), F.lit(0)))
    moving = F.col("dt") > 0
    step = lambda c: F.when(moving, F.col(f"__next_{c}") - F.col(c)).otherwise(0.0)
    f = f.withColumn("dx", step("x")).withColumn("dy", step("y")).withColumn("__dz", step("alt"))
    east, north, j, near, far = [F.col(c) for c in ("__east", "__north", "__64th", "__near", "__far")]
    f = f.withColumns({"__east": F.col("__next_x") - F.col("__last_x"), "__north": F.col("__next_y") - F.col("__last_y")}).drop(*beside)
    f = f.withColumn("__64th", nearest_64th(east, north)).withColumns({"__near": near_angle(east, north, j), "__far": far_angle(east, north, j)})
    f = f.withColumn("trk", compass(east, north, near, far)).drop("__east", "__north", "__64th", "__near", "__far")
    per = lambda c: F.when(moving, F.col(c) / F.col("dt")).otherwise(0.0)
    f = f.withColumn("step", F.hypot("dx", "dy")).withColumn("vx", per("dx")).withColumn("vy", per("dy")).withColumn("vz", per("__dz"))
    f = f.withColumn("gs", per("step")).withColumn("good", moving & (F.col("dt") <= max_gap)).drop("__dz")
    f = f.withColumn("dtrk", F.when(F.col("good"), wrap(F.lead("trk").over(in_order()) - F.col("trk")))).withColumn("tr", F.col("dtrk") / F.when(moving, F.col("dt")))
    return smooth_turn_rate(f)


def smooth_turn_rate(fixes: DataFrame, rows: int = 5, seconds: int = 10) -> DataFrame:
    """Mean turn rate of up to ``rows`` fixes either side that lie within ``seconds``.

    The frame is by rows and by time at once, so it is eleven lags and leads.
    What is used of them are columns of their own: summed and counted in one
    expression they make a method too long for the JVM to compile (8,000 bytes).
    """
    at = range(-rows, rows + 1)
    f = fixes.withColumns({f"__{c}{k}": F.lead(c, k).over(in_order()) for c in ("tr", "t") for k in at})
    f = f.withColumns({f"__use{k}": F.when(F.abs(F.col(f"__t{k}") - F.col("t")) <= seconds, F.col(f"__tr{k}")) for k in at})
    used = [F.col(f"__use{k}") for k in at]
    f = f.withColumn("__sum", sum((F.coalesce(u, F.lit(0.0)) for u in used), F.lit(0.0))).withColumn("__n", sum((u.isNotNull().cast("int") for u in used), F.lit(0)))
    return f.withColumn("trs", F.when(F.col("__n") > 0, F.col("__sum") / F.col("__n")).otherwise(0.0)).select(*fixes.columns, "trs")


def add_kinematics(fixes: DataFrame, max_gap: int = 12) -> DataFrame:
    return motion(project(choose_altitude(fixes)), max_gap)


#: What ``classified_fixes`` gives of each fix.
CLASSIFIED = "flight_id string, idx bigint, t bigint, lat double, lon double, alt int, altitude_source string, x double, y double, dt bigint, step double, vx double, vy double, vz double, gs double, good boolean, dtrk double, circ boolean, raw_run int"


def classified_fixes(raw: DataFrame, min_circle_rate: float = 6.0, max_gap: int = 12) -> DataFrame:
    """Fixes as ``parse.parse_b`` reads them, ordered, with their motion, ``circ`` and ``raw_run``.

    The same as ``ordered_fixes``, ``add_kinematics`` and ``segments.classify``
    one after the other.  These take a dozen windows, each of which copies every
    row; here Spark groups the fixes by flight and a group's columns are numpy's.
    """

    def one(flight: pa.Table) -> pa.Table:
        c = {name: flight[name].to_numpy() for name in flight.column_names[1:]}
        filed = np.argsort(c["line_no"], kind="stable")
        return classified(flight["flight_id"][0], {name: v[filed] for name, v in c.items()}, min_circle_rate, max_gap)

    return raw.select("flight_id", "line_no", "raw_t", "lat_mm", "lon_mm", "palt", "galt").groupBy("flight_id").applyInArrow(one, CLASSIFIED)


def classified(flight_id: pa.Scalar, c: dict[str, np.ndarray], min_circle_rate: float, max_gap: int, rows: int = 5, seconds: int = 10) -> pa.Table:
    """``CLASSIFIED`` of one flight's fixes, which are in file order."""
    clock = c["raw_t"]
    n = len(clock)
    t = clock + DAY * np.cumsum(np.diff(clock, prepend=clock[:1]) < -3600)
    order = np.argsort(t, kind="stable")
    t = t[order]
    lat_mm, lon_mm, palt, galt = (c[name][order] for name in ("lat_mm", "lon_mm", "palt", "galt"))
    low, high = palt.min(), palt.max()
    source, alt = ("pressure", palt) if high - low > 100 and -500 < low < 15000 else ("GNSS", galt)
    lat, lon = lat_mm / 60000.0, lon_mm / 60000.0
    lat0, lon0 = lat_mm.sum() / (n * 60000.0), lon_mm.sum() / (n * 60000.0)
    x, y = np.radians(lon - lon0) * EARTH_M * math.cos(math.radians(lat0)), np.radians(lat - lat0) * EARTH_M
    dt = np.diff(t, append=t[-1])
    moving = dt > 0
    dx, dy, dz = (np.where(moving, np.diff(v, append=v[-1]), 0.0) for v in (x, y, alt))
    time = np.where(moving, dt, 1)
    step, good = np.sqrt(dx * dx + dy * dy), moving & (dt <= max_gap)
    trk = np.full(n, np.nan)
    # the standard library's angle is that of other engines; numpy's may be some places off
    angle = map(math.atan2, (x[2:] - x[:-2]).tolist(), (y[2:] - y[:-2]).tolist())
    trk[1:-1] = _around(np.degrees(np.fromiter(angle, float, max(n - 2, 0))))
    dtrk = np.full(n, np.nan)
    dtrk[:-1] = np.where(good[:-1], _around(np.diff(trk) + 180.0) - 180.0, np.nan)
    rate = dtrk / time
    known = ~np.isnan(rate)
    rate = np.where(known, rate, 0.0)
    total, used = np.zeros(n), np.zeros(n, int)
    for k in range(-min(rows, n - 1), min(rows, n - 1) + 1):
        here, there = slice(max(-k, 0), n - max(k, 0)), slice(max(k, 0), n - max(-k, 0))
        near = np.abs(t[there] - t[here]) <= seconds
        dense = near.all()
        total[here] += rate[there] if dense else np.where(near, rate[there], 0.0)
        used[here] += known[there] if dense else known[there] & near
    circ = np.abs(total / np.maximum(used, 1)) > min_circle_rate
    run = np.cumsum(np.diff(circ, prepend=circ[0]), dtype=np.int32)
    same = lambda v: pa.repeat(v, n)
    columns = [same(flight_id), np.arange(n), t, lat, lon, alt, same(pa.scalar(source)), x, y, dt, step, dx / time, dy / time, dz / time, step / time, good, pa.array(dtrk, from_pandas=True), circ, run]
    return pa.table([v if isinstance(v, pa.Array) else pa.array(v) for v in columns], names=[v.split()[0] for v in CLASSIFIED.split(", ")])


def _around(degrees: np.ndarray) -> np.ndarray:
    """Into [0, 360), as ``pmod``."""
    rest = np.fmod(degrees, 360.0)
    return np.where(rest < 0, np.fmod(rest + 360.0, 360.0), rest)


#: Vertical speed bands: a step belongs to the number of cuts strictly below it.
CUTS = (-2.5, -1.0, 0.0, 1.0, 2.0, 3.0)
BANDS = ("below -2.5", "-2.5 to -1", "-1 to 0", "0 to 1", "1 to 2", "2 to 3", "above 3")


def smooth_vz(kin: DataFrame) -> DataFrame:
    """``svz`` over the fixes from two before to three after, clamped to the trace, and its band."""
    edge = lambda c: by_flight().orderBy("idx").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before = lambda c: F.coalesce(F.lag(c, 2).over(in_order()), F.first(c).over(edge(c)))
    after = lambda c: F.coalesce(F.lead(c, 3).over(in_order()), F.last(c).over(edge(c)))
    span = after("t") - before("t")
    f = kin.withColumn("svz", F.when(span > 0, (after("alt") - before("alt")) / span).otherwise(0.0))
    return f.withColumn("band", sum((F.when(F.col("svz") > c, 1).otherwise(0) for c in CUTS), F.lit(0)))


def band_times(kin: DataFrame) -> DataFrame:
    """Seconds and metres per band."""
    name = F.element_at(F.array(*[F.lit(b) for b in BANDS]), F.col("band") + 1)
    return smooth_vz(kin).where("dt > 0").groupBy("flight_id", "band").agg(F.sum("dt").alias("seconds"), F.sum("step").alias("metres")).withColumn("label", name)


def bounding_box(fixes: DataFrame, scoring: DataFrame) -> DataFrame:
    """Corners of the fixes and scoring points, and spans with the longitude shrunk by the middle latitude."""
    every = fixes.select("flight_id", "lat", "lon").unionByName(scoring.select("flight_id", "lat", "lon"))
    box = every.groupBy("flight_id").agg(*[f(c).alias(f"{n}_{c}") for c in ("lat", "lon") for n, f in (("min", F.min), ("max", F.max))])
    mid: Column = (F.col("min_lat") + F.col("max_lat")) / 2
    return box.withColumn("mid_lat", mid).withColumn("lat_span", F.col("max_lat") - F.col("min_lat")).withColumn("lon_span", (F.col("max_lon") - F.col("min_lon")) * F.cos(F.radians(mid)))
