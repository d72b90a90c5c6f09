"""One nested JSON document per flight, the profile, and bundle names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.units import instant, to_fixed, zulu
from ..operators import outline
from ..operators.climbs import geometry_or_null
from ..operators.task import scoring_points
from .debrief import Debrief

SCHEMA_VERSION = 1
#: Key and unit of the drawn figures, as the format documents them.
FIGURES = {"trace": "trace.svg", "barogram": "barogram.svg", "renderedUnits": "imperial", "barogramHeightUnit": "ft"}

PROFILE = outline.names(outline.PROFILE)


def _listed(rows: DataFrame, order: list[str], name: str, fields: list[Column]) -> DataFrame:
    """Children of a flight as one array, in order; a flight's children are few."""
    own = rows.select("flight_id", F.struct(*[F.col(c).alias(f"__{k}") for k, c in enumerate(order)], F.struct(*fields).alias("v")).alias("x"))
    return own.groupBy("flight_id").agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["v"]).alias(name))


def _r(c: Column | str, places: int) -> Column:
    return to_fixed(F.col(c) if isinstance(c, str) else c, places)


def empty_as_null(c: Column) -> Column:
    return F.when(F.length(c) > 0, c)


def bundle_name(date: Column, registration: Column, kind: Column) -> Column:
    """``date-registration`` (or type), lower case, other runs as a dash, with the suffix; ``flight`` if neither."""
    base = F.concat_ws("-", empty_as_null(date), F.coalesce(empty_as_null(registration), empty_as_null(kind)))
    slug = F.regexp_replace(F.regexp_replace(F.lower(base), "[^a-z0-9-]+", "-"), "^-|-$", "")
    return F.concat(F.when(slug == "", "flight").otherwise(slug), F.lit("-igc-analysis"))


def flight_documents(d: Debrief, generated_at: str, filename: str | Column | None = None, include_profile: bool = False) -> DataFrame:
    """``flight_id, document``: every documented key is present, absent values are null, SI units.

    ``filename`` is one name, or a column over flight_id; ``include_profile`` adds every fix as ``[t, altM, lat, lon, circling]``.
    """
    if d.texts is not None:
        # legs, climbs and the profile out of one reading of the logs
        told = d.details if include_profile else d.sums
    lit = lambda v: F.lit(v).cast("string")
    circle = lambda p: F.struct(p["k"].alias("index"), zulu(p["start"]).alias("startTime"), p["duration_s"].alias("durationS"), p["gain_m"].alias("gainM"), _r(p["climb_ms"], 3).alias("climbMs"), p["alt_m"].alias("altM"))
    thick = lambda c, k: geometry_or_null(F.col("circles"), _r(c, k))
    climb_list = _listed(
        d.climbs, ["climb"], "climbs",
        [F.col("climb").alias("index"), zulu(F.col("start")).alias("startTime"), zulu(F.col("end")).alias("endTime"), F.col("duration_s").alias("durationS"), F.col("gain_m").alias("gainM"), F.col("alt_bottom_m").alias("altBottomM"), F.col("alt_top_m").alias("altTopM"),
         _r("avg_climb_ms", 3).alias("avgClimbMs"), _r("best_30s_ms", 3).alias("best30sMs"), _r("circles", 2).alias("circles"), F.col("direction"), thick("circle_time_s", 1).alias("circleTimeS"), thick("radius_m", 1).alias("radiusM"), thick("bank_deg", 1).alias("bankDeg"), _r("airspeed_kmh", 1).alias("airspeedKmh"),
         F.transform("per_circle", circle).alias("perCircle")],
    )
    leg_list = _listed(
        d.legs, ["leg"], "legs",
        [zulu(F.col("start")).alias("startTime"), zulu(F.col("end")).alias("endTime"), F.col("duration_s").alias("durationS"), _r("distance_m", 1).alias("distanceM"), F.col("dh_m").alias("heightChangeM"), F.col("alt_start_m").alias("altStartM"), F.col("alt_end_m").alias("altEndM"), _r("ld_over_ground", 1).alias("ldOverGround"),
         _r("mean_ias_kmh", 1).alias("meanIasKmh"), _r("sd_ias_kmh", 1).alias("sdIasKmh"), _r("mean_airmass_ms", 3).alias("meanAirmassMs"), _r("frac_rising_air", 4).alias("fracRisingAir"), F.col("kind"), F.col("circuit")],
    )
    estimates = _listed(d.wind_estimates, ["time"], "perClimb", [zulu(F.col("time")).alias("time"), _r("speed_ms", 3).alias("speedMs"), _r("from_deg", 1).alias("fromDeg"), _r("circles", 2).alias("circles")])
    points = _listed(scoring_points(d.task_points), ["seq"], "points", [empty_as_null(F.col("name")).alias("name"), F.col("lat"), F.col("lon"), F.col("role")])
    task_legs = _listed(d.task_legs, ["leg"], "taskLegs", [F.col("from"), F.col("to"), _r("distance_m", 1).alias("distanceM"), _r("bearing_deg", 1).alias("bearingDeg")])
    t = d.task_summary.join(points, "flight_id").join(task_legs, "flight_id")
    place = lambda c: F.when(F.col(c).isNotNull(), F.struct(empty_as_null(F.col(c)["name"]).alias("name"), F.col(c)["lat"].alias("lat"), F.col(c)["lon"].alias("lon")))
    declaration = F.when(
        F.col("description").isNotNull(),
        F.struct(empty_as_null(F.col("description")).alias("description"), F.col("declared_date").alias("declaredDate"), zulu(F.col("declared_time_s")).alias("declaredTime"), F.col("turnpoints")),
    )
    t = t.select("flight_id", F.struct(F.lit(True).alias("declared"), "shape", "closed", _r("distance_m", 1).alias("distanceM"), F.col("task_turnpoints").alias("turnpoints"), "points", F.col("taskLegs").alias("legs"), place("takeoff").alias("takeoff"), place("landing").alias("landing"), declaration.alias("declaration")).alias("task"))
    wind = d.wind.join(estimates, "flight_id").select("flight_id", F.struct(_r("speed_ms", 3).alias("speedMs"), _r("from_deg", 1).alias("fromDeg"), _r("spread_ms", 3).alias("spreadMs"), "unreliable", "perClimb").alias("wind"))
    f = d.summary
    for part in (d.headers, d.launch.drop("n", "top_idx", "mspd", "gain", "dur"), d.phase, d.rising_air, wind, climb_list, leg_list, d.polars.select("flight_id", F.col("name").alias("polar_name"), F.col("note").alias("polar_note"), "matched", "best_ld", "best_ld_speed_ms"), d.warnings.select("flight_id", "warning"), t):
        f = f.join(part, "flight_id", "left")
    blank = F.from_json(F.lit('{"declared":false,"points":[],"legs":[]}'), t.schema["task"].dataType.simpleString())
    empty = lambda df, c: F.coalesce(F.col(c), F.array().cast(df.schema[c].dataType))
    c = F.col
    document = [
        F.lit(SCHEMA_VERSION).alias("schemaVersion"),
        F.struct(lit("varioflow").alias("name"), lit(None).alias("url"), lit(generated_at).alias("generatedAt")).alias("generator"),
        F.struct((filename if isinstance(filename, Column) else lit(filename)).alias("filename"), c("logger_id").alias("loggerId"), c("logger"), c("gps"), c("altitude_source").alias("altitudeSource")).alias("source"),
        F.struct(
            c("date"), F.struct(c("glider_type").alias("type"), c("glider_id").alias("registration"), empty_as_null(c("competition_id")).alias("competitionId")).alias("glider"), empty_as_null(c("pilot")).alias("pilot"), empty_as_null(c("crew2")).alias("crew2"),
            zulu(c("start")).alias("startTime"), zulu(c("end")).alias("endTime"), instant(c("date"), c("start")).alias("startInstant"), instant(c("date"), c("end")).alias("endInstant"), c("duration_s").alias("durationS"), _r("track_distance_m", 1).alias("trackDistanceM"), c("max_alt_m").alias("maxAltitudeM"), c("landed"),
        ).alias("flight"),
        F.struct(zulu(c("takeoff_t")).alias("takeoffTime"), zulu(c("release_t")).alias("releaseTime"), c("type"), c("note"), c("confident").alias("releaseConfident")).alias("launch"),
        F.coalesce("task", blank).alias("task"),
        F.struct(
            c("circling_s").alias("circlingS"), c("straight_s").alias("straightS"), c("soaring_s").alias("soaringS"), _r("circling_fraction", 4).alias("circlingFraction"), c("gain_circling_m").alias("gainCirclingM"), _r("mean_circling_rate_ms", 3).alias("meanCirclingRateMs"),
            F.when(c("band_top_m").isNotNull(), F.struct(c("band_bottom_m").alias("bottomM"), c("band_top_m").alias("topM"))).alias("workingBand"), _r("rising_air_fraction", 4).alias("risingAirFraction"),
        ).alias("phase"),
        c("wind"), empty(climb_list, "climbs").alias("climbs"), empty(leg_list, "legs").alias("legs"),
        F.struct(c("polar_name").alias("name"), c("polar_note").alias("note"), c("matched"), _r("best_ld", 1).alias("bestLd"), _r("best_ld_speed_ms", 2).alias("bestLdSpeedMs")).alias("polar"),
        F.struct(c("fixes"), c("median_interval_s").alias("medianIntervalS"), c("max_gap_s").alias("maxGapS"), c("gaps_over_20s").alias("gapsOver20s"), c("gap_total_s").alias("gapTotalS"), c("coarse"), F.filter(F.array("warning"), lambda x: x.isNotNull()).alias("warnings")).alias("quality"),
        F.struct(*[lit(v).alias(k) for k, v in FIGURES.items()]).alias("figures"),
    ]
    if include_profile:
        if d.texts is None:
            profile = _listed(d.fixes, ["idx"], "profile", [c("t"), c("alt").alias("alt_m"), F.round("lat", 5).alias("lat"), F.round("lon", 5).alias("lon"), c("circ").alias("circling")])
            f = f.join(profile, "flight_id", "left")
        else:
            # the profiles lie dealt by flight, so the other parts come to them
            f = told.select("flight_id", F.arrays_zip(*PROFILE).alias("profile")).join(f.hint("shuffle_hash"), "flight_id")
        document += [F.transform("profile", lambda p: F.array(*[p[k].cast("double") for k in PROFILE[:-1]], p["circling"].cast("int").cast("double"))).alias("profile"), F.array(*map(lit, ("t", "altM", "lat", "lon", "circling"))).alias("profileColumns")]
    return f.select("flight_id", bundle_name(c("date"), c("glider_id"), c("glider_type")).alias("bundle"), F.to_json(F.struct(*document), {"ignoreNullFields": "false"}).alias("document"))


def write_documents(documents: DataFrame, path: str) -> None:
    """The documents as text, one line each."""
    documents.select(F.col("document").alias("value")).write.text(path)
