"""Flight logs derived from the driver's ``supplier`` table.

Those tables hold no GPS traces, so every supplier flies one flight of half an
hour: ground, tow, release, climb, glide, climb, final glide, circuit.  Its
positions are running integer sums of velocities in mm/s, so two engines agree
on every fix.  The log text made from them is what the parsers read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources import kept, logs

SECONDS = 1800
#: Flights a task writes out; a supplier table may lie in one small file, its fixes may not.
FLIGHTS_A_TASK = 250
#: Tracks, drops and start times go by a flight's number modulo 360, 10, 9, 7, 5, 3 and 2, so flights that many apart follow one track.
TRACKS = 2520
#: Lines before a flight's fixes, empty ones with them.
HEAD = 100
DATE = "2024-01-01"
#: (first second past it, speed mm/s, climb mm/s, turn in 1/100 degree per second) as SQL over k and i.
PHASES = [
    (60, "0", "0", "0"),
    (300, "30000", "2400", "0"),
    (360, "21000", "-1500", "0"),
    (660, "28000", "1800 + 10 * (k % 9)", "(1730 + 41 * (k % 7)) * (1 - 2 * (k % 2))"),
    (900, "33000", "-1200", "case when k % 3 = 1 and i between 760 and 765 then 1500 when k % 3 = 1 and i between 766 and 771 then -1500 else 0 end"),
    (1140, "28000", "1500", "(1690 + 37 * (k % 5)) * (2 * (k % 2) - 1)"),
    (1680, "33000", "-1700", "0"),
    (1770, "26000", "-2000", "0"),
    (SECONDS, "0", "0", "0"),
]
DROPPED = "((k % 5 = 0 and i between 700 and 724) or (k % 10 = 0 and i between 700 and 769))"
START = "case when k % 7 = 3 then 85500 else 43200 end"
GLIDERS = ["ASK-21", "Duo Discus XT", "LS-4a", "Slingsby T21", "Discus 2c"]


def phase_sql(column: int) -> str:
    return "case " + " ".join(f"when i < {p[0]} then {p[column]}" for p in PHASES) + " end"


def flyers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``k, s_name`` of all suppliers, dealt by ``k`` while they are still one row a flight."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("long").alias("k"), "s_name")
    return s.repartition(max(kept.shuffle_width(spark), -(-s.count() // FLIGHTS_A_TASK)), "k")


def track() -> tuple[Column, Column]:
    return (F.col("k") % TRACKS).alias("k"), (F.col("k") % 11 == 4).alias("blank")


def tracks(flights: DataFrame) -> DataFrame:
    """``k, blank`` of the tracks that the flights follow: their numbers modulo ``TRACKS``, and whether no pressure is logged."""
    return flights.select(*track())


def positions(flown: DataFrame) -> DataFrame:
    """``k, blank, i, lat_mm, lon_mm, z``: where each of the ``tracks`` is at each second."""
    f = flown.select("k", "blank", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SECONDS - 1).cast("long"))).alias("i"))
    f = f.selectExpr("k", "blank", "i", *[f"cast({phase_sql(c)} as bigint) as {n}" for c, n in ((1, "s"), (2, "c"), (3, "w"))])
    before = W.partitionBy("k", "blank").orderBy("i").rowsBetween(W.unboundedPreceding, -1)
    so_far = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    f = f.withColumn("h", (F.col("k") % 360) * 100 + so_far("w"))
    air = F.col("i").between(60, 1769)
    angle = F.radians(F.col("h") / F.lit(100.0))
    f = f.withColumn("vx", F.floor(F.col("s") * F.sin(angle) + 0.5) + F.when(air, (F.col("k") % 7) * 500 + 1500).otherwise(0)).withColumn("vy", F.floor(F.col("s") * F.cos(angle) + 0.5) + F.when(air, 1000).otherwise(0))
    f = f.withColumn("x", so_far("vx")).withColumn("y", so_far("vy")).withColumn("z", so_far("c") + 150000)
    return f.select("k", "blank", "i", (F.floor(F.col("y") / F.lit(1852.0)) + 3100000).alias("lat_mm"), (F.floor(F.col("x") / F.lit(1150.0)) + 100000).alias("lon_mm"), "z")


def _place(mm: Column, digits: int) -> Column:
    return F.concat(F.lpad(F.floor(mm / 60000).cast("string"), digits, "0"), F.lpad(F.pmod(mm, F.lit(60000)).cast("string"), 5, "0"))


def _records(flown: DataFrame) -> DataFrame:
    """``k, blank, records``: the fixes of each track as lines of text."""
    p = positions(flown).where(f"not {DROPPED}")
    t = F.pmod(F.expr(START) + F.col("i"), F.lit(86400))
    clock = F.concat(*[F.lpad(x.cast("string"), 2, "0") for x in (F.floor(t / 3600), F.pmod(F.floor(t / 60), F.lit(60)), F.pmod(t, F.lit(60)))])
    height = F.floor(F.col("z") / 1000)
    pressure = F.when(F.col("blank"), 0).otherwise(height)
    line = F.concat(F.lit("B"), clock, _place(F.col("lat_mm"), 2), F.lit("N"), _place(F.col("lon_mm"), 3), F.lit("E"), F.when(F.col("i") % 97 == 0, "V").otherwise("A"), F.lpad(pressure.cast("string"), 5, "0"), F.lpad((height + 40).cast("string"), 5, "0"), F.lit("012"))
    logged = p.select("k", "blank", "i", line.alias("line")).groupBy("k", "blank").agg(F.sort_array(F.collect_list(F.struct("i", "line"))).alias("l"))
    return logged.select("k", "blank", F.array_join("l.line", "\n").alias("records"))


def _head() -> Column:
    """The first ``HEAD`` lines of a flight of ``k, s_name``; what it does not log is an empty line."""
    k = F.col("k")
    turns = k % 4 + 1
    zero = F.lit("0000000N00000000E")

    def at(j: Column) -> Column:
        return F.concat(_place(F.pmod(j * 7919 + k * 37, F.lit(20000)) + 3100000, 2), F.lit("N"), _place(F.pmod(j * 104729 + k * 53, F.lit(40000)) + 100000, 3), F.lit("E"))

    counted = k % 3 == 1
    end = lambda j, name: F.concat(F.lit("C"), F.when(counted, zero).otherwise(F.concat(at(F.lit(j)), F.lit(name))))
    first = F.concat(F.lit("C0101240930000101240001"), F.when(counted, F.lpad(turns.cast("string"), 2, "0")).otherwise("  "), F.lit("TASK "), k.cast("string"))
    legs = F.transform(F.sequence(F.lit(1).cast("long"), turns), lambda j: F.concat(F.lit("C"), at(j), F.lit("TP"), j.cast("string")))
    task = F.concat(F.array(first, end(50, "TAKE OFF"), F.concat(F.lit("C"), at(F.lit(0)), F.lit("ST"))), legs, F.array(F.concat(F.lit("C"), at(F.when(k % 2 == 0, F.lit(0).cast("long")).otherwise(turns + 1)), F.lit("FI")), end(51, "LANDING")))
    kind = F.get(F.array(*map(F.lit, GLIDERS)), (k % 6).cast("int"))
    head = F.array(
        F.concat(F.lit("AXYZ"), k.cast("string")), F.lit("HFDTE010124"), F.concat(F.lit("HFPLTPILOT:"), "s_name"), F.concat(F.lit("HFGTYGLIDERTYPE:"), kind),
        F.concat(F.lit("hfgidGLIDERID: G-C"), k.cast("string")), F.when(k % 2 == 0, F.lit("HFGPS: x")), F.when(k % 2 == 0, F.lit("HFGPSreceiver")),
        F.when(k % 4 == 1, F.lit("I013638FXA")).when(k % 4 == 2, F.lit("I023638FXA3940SIU")).when(k % 4 == 3, F.lit("Ixx")),
    )
    lines = F.when(k % 3 != 0, F.concat(head, task)).otherwise(head)
    return F.array_join(F.concat(lines, F.array_repeat(F.lit(""), F.lit(HEAD) - F.size(lines))), "\n", "")


def log_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``flight_id, source, text`` of all suppliers' flights, as log files are read.

    The records of each track are made once; every flight has those of its track.
    """
    flights = flyers(spark, sf_dir)
    # given, as the sizes that would choose it are those of flights and tracks, not of the texts
    width = flights.rdd.getNumPartitions()
    made = _records(tracks(flights).distinct().repartition(width, "k", "blank"))
    own = flights.select(F.col("k").alias("flight"), _head().alias("head"), *track()).repartition(width, "k", "blank")
    # by statistics the records of a track are as few as the tracks, so they would be sent to the driver
    met = own.join(made.hint("merge"), ["k", "blank"])
    return met.select(F.concat(F.lit("F"), F.col("flight").cast("string")).alias("flight_id"), F.lit("supplier").alias("source"), F.concat_ws("\n", "head", "records", F.lit("")).alias("text"))


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``flight_id, source, line_no, line`` of the texts; fixes from line ``HEAD`` on."""
    return logs.split_lines(log_texts(spark, sf_dir))
