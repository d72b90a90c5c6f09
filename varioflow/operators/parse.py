"""Lines to fixes, headers and declarations.

The record type is a line's first character, in either case.  Numbers are tried,
not cast, so a malformed record is dropped or a field null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .kinematics import DAY

#: Thousandths of a minute (a thousandth of a degree) about zero that stand for no point.
HOLE = 60
#: Header records and the columns they fill.
HEADERS = {"HFGTY": "glider_type", "HFGID": "glider_id", "HFCID": "competition_id", "HFPLT": "pilot", "HFCM2": "crew2", "HFFTY": "logger", "HFGPS": "gps", "HFTZN": "timezone"}


def part(line: Column, a: int, b: int | None = None) -> Column:
    """Characters [a, b) of a line."""
    return F.substring(line, a + 1, (1 << 30) if b is None else b - a)


def stripped(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"^[\s\p{Z}\ufeff]+|[\s\p{Z}\ufeff]+$", "")


def whole(text: Column) -> Column:
    """An integer, or null: a sign and white space at the ends are allowed."""
    return text.try_cast("int")


def digits(text: Column) -> Column:
    return F.when(text.rlike("^[0-9]{1,9}$"), text.try_cast("int"))


def kind(line: Column) -> Column:
    return F.upper(F.substring(line, 1, 1))


def minutes_1000(text: Column, degree_digits: int, hemisphere: Column) -> Column:
    """``DDMMmmm`` (or ``DDDMMmmm``) as signed thousandths of a minute; exact."""
    d, m = whole(part(text, 0, degree_digits)), whole(part(text, degree_digits, degree_digits + 5))
    size = (d * 60000 + m).cast("long")
    # a blank after the decimals would shift them
    closed = part(text, degree_digits + 4, degree_digits + 5).between("0", "9")
    return F.when(closed, F.when(hemisphere.isin("S", "W"), -size).otherwise(size))


def degrees_of(mm: Column) -> Column:
    return mm / F.lit(60000.0)


def usable(line: Column) -> Column:
    """Whether ``parse_b`` makes a fix of the line."""
    numbers = [whole(part(line, a, b)) for a, b in ((1, 3), (3, 5), (5, 7), (25, 30), (30, 35))]
    lat, lon = minutes_1000(part(line, 7, 14), 2, part(line, 14, 15)), minutes_1000(part(line, 15, 23), 3, part(line, 23, 24))
    own = (kind(line) == "B") & (F.length(line) >= 35) & ((F.abs(lat) >= 6) | (F.abs(lon) >= 6))
    for n in (*numbers, lat, lon):
        own = own & n.isNotNull()
    return F.coalesce(own, F.lit(False))


def parse_b(lines: DataFrame) -> DataFrame:
    """Fixes as logged: raw time, position, both altitudes, validity; bad records and null island dropped.

    A record is read into one row of an array, so that the filters on its numbers do not read it again.
    """
    line = F.col("line")
    lat, lon = minutes_1000(part(line, 7, 14), 2, part(line, 14, 15)), minutes_1000(part(line, 15, 23), 3, part(line, 23, 24))
    record = F.struct(
        (whole(part(line, 1, 3)) * 3600 + whole(part(line, 3, 5)) * 60 + whole(part(line, 5, 7))).cast("long").alias("raw_t"),
        lat.alias("lat_mm"),
        lon.alias("lon_mm"),
        whole(part(line, 25, 30)).alias("palt"),
        whole(part(line, 30, 35)).alias("galt"),
        (F.upper(part(line, 24, 25)) == "A").alias("valid"),
    )
    b = lines.where((kind(line) == "B") & (F.length(line) >= 35)).select("flight_id", "line_no", F.inline(F.array(record)))
    known = b.dropna(subset=["raw_t", "lat_mm", "lon_mm", "palt", "galt"])
    return known.where((F.abs("lat_mm") >= 6) | (F.abs("lon_mm") >= 6))


def ordered_fixes(raw: DataFrame) -> DataFrame:
    """Midnight rollovers undone in file order, then a stable order by time: ``idx`` from 0.

    Both windows are by flight, so the fixes are exchanged once.
    """
    filed = W.partitionBy("flight_id").orderBy("line_no")
    jump = F.when(F.col("raw_t") < F.lag("raw_t").over(filed) - 3600, 1).otherwise(0)
    t = raw.withColumn("__jump", jump).withColumn("t", F.col("raw_t") + DAY * F.sum("__jump").over(filed.rowsBetween(W.unboundedPreceding, 0)))
    timed = W.partitionBy("flight_id").orderBy("t", "line_no")
    return t.withColumn("idx", (F.row_number().over(timed) - 1).cast("long")).select("flight_id", "idx", "line_no", "t", "lat_mm", "lon_mm", degrees_of(F.col("lat_mm")).alias("lat"), degrees_of(F.col("lon_mm")).alias("lon"), "palt", "galt", "valid")


def fixes(lines: DataFrame) -> DataFrame:
    return ordered_fixes(parse_b(lines))


def headers(lines: DataFrame) -> DataFrame:
    """One row per flight: the last record of each kind, the last valid date, the first logger id."""
    line = F.col("line")
    rest = part(line, 5)
    value = stripped(F.when(F.instr(rest, ":") > 0, F.regexp_replace(rest, "^[^:]*:", "")).otherwise(rest))
    code = F.upper(part(line, 0, 5))
    number = F.regexp_replace(rest, "[^0-9]", "")
    date = F.when(F.length(number) >= 6, F.concat(F.lit("20"), part(number, 4, 6), F.lit("-"), part(number, 2, 4), F.lit("-"), part(number, 0, 2)))
    own = lines.where(kind(line).isin("A", "H")).withColumn("code", code)
    last = lambda v, when: F.max_by(F.when(when, v), F.when(when & v.isNotNull(), F.col("line_no")))
    columns = [last(value, F.col("code") == k).alias(name) for k, name in HEADERS.items()]
    first = F.min_by(stripped(part(line, 1)), F.when(kind(line) == "A", F.col("line_no")))
    return own.groupBy("flight_id").agg(last(date, F.col("code") == "HFDTE").alias("date"), *columns, first.alias("logger_id"))


def is_point(line: Column) -> Column:
    """Capitals alone mark a hemisphere; with small letters the record is a declaration."""
    return (F.length(line) >= 18) & part(line, 8, 9).isin("N", "S") & part(line, 17, 18).isin("E", "W")


def declarations(lines: DataFrame) -> DataFrame:
    """The first C record that is no point: date, time, turnpoint count and text, each null if unusable."""
    line = F.col("line")
    d, m, y = [digits(part(line, a, a + 2)) for a in (1, 3, 5)]
    hh, mm, ss = [digits(part(line, a, a + 2)) for a in (7, 9, 11)]
    date = F.when(m.between(1, 12) & d.between(1, 31) & y.isNotNull(), F.format_string("20%02d-%02d-%02d", y, m, d))
    time = F.when((hh < 24) & (mm < 60) & (ss < 60), (hh * 3600 + mm * 60 + ss).cast("long"))
    own = F.struct(stripped(part(line, 25)).alias("description"), date.alias("declared_date"), time.alias("declared_time_s"), digits(part(line, 23, 25)).alias("turnpoints"))
    return lines.where((kind(line) == "C") & ~is_point(line)).groupBy("flight_id").agg(F.min_by(own, "line_no").alias("d")).select("flight_id", "d.*")


def task_points(lines: DataFrame, declared: DataFrame) -> DataFrame:
    """Declared points with their roles; those within ``HOLE`` of zero or malformed hold their place, then go."""
    line = F.col("line")
    lat, lon = minutes_1000(part(line, 1, 8), 2, part(line, 8, 9)), minutes_1000(part(line, 9, 17), 3, part(line, 17, 18))
    hole = lat.isNull() | lon.isNull() | ((F.abs(lat) <= HOLE) & (F.abs(lon) <= HOLE))
    points = lines.where((kind(line) == "C") & is_point(line)).select("flight_id", "line_no", F.when(~hole, lat).alias("lat_mm"), F.when(~hole, lon).alias("lon_mm"), stripped(part(line, 18)).alias("name"))
    return assign_roles(points, declared)


def assign_roles(points: DataFrame, declared: DataFrame) -> DataFrame:
    flight = W.partitionBy("flight_id")
    inorder = flight.orderBy("line_no")
    every = inorder.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    p = points.join(declared.select("flight_id", F.col("turnpoints").alias("d")), "flight_id", "left")
    p = p.withColumn("i", F.row_number().over(inorder) - 1).withColumn("n", F.count("*").over(flight)).withColumn("first", F.first("name").over(every)).withColumn("last", F.last("name").over(every))
    named = F.col("first").rlike(r"(?i)^take\s*-?\s*off") & F.col("last").rlike(r"(?i)^land(ing)?\b")
    ends = F.when(F.col("n") == F.col("d") + 4, True).when(F.col("n") == F.col("d") + 2, False).when((F.col("n") >= 4) & named, True).when((F.col("n") >= 2) & F.col("d").isNull(), False)
    k = F.when(ends, F.col("i") - 1).otherwise(F.col("i"))
    size = F.when(ends, F.col("n") - 2).otherwise(F.col("n"))
    role = F.when(ends.isNull(), None).when(ends & (F.col("i") == 0), "takeoff").when(ends & (F.col("i") == F.col("n") - 1), "landing").when(k == 0, "start").when(k == size - 1, "finish").otherwise("turn")
    out = p.withColumn("role", role).where("lat_mm is not null")
    return out.select("flight_id", F.col("i").alias("seq"), degrees_of(F.col("lat_mm")).alias("lat"), degrees_of(F.col("lon_mm")).alias("lon"), "name", "role")


def extension_warnings(lines: DataFrame) -> DataFrame:
    """``flight_id, warning``: the last I record declares another line length than the longest B line has."""
    line = F.col("line")
    return _unlike(lines.where(kind(line).isin("I", "B")).groupBy("flight_id").agg(F.max_by(F.when(kind(line) == "I", stripped(line)), F.when(kind(line) == "I", F.col("line_no"))).alias("i"), F.max(F.when(line.startswith("B"), F.length(line))).alias("actual")))


def warnings_of_heads(heads: DataFrame) -> DataFrame:
    """``extension_warnings`` from the ``logs.heads`` of whole logs."""
    last = F.try_element_at(F.filter("own", lambda x: kind(x) == "I"), F.lit(-1))
    return _unlike(heads.select("flight_id", stripped(last).alias("i"), F.col("longest").alias("actual")))


def _unlike(per: DataFrame) -> DataFrame:
    n = digits(part(F.col("i"), 1, 3))
    end = lambda k: F.substr("i", k * 7 + 6, F.lit(2))
    ends = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.when(end(k).rlike("^[0-9]{1,2}$"), end(k).try_cast("int")))
    declared = F.when(n > 0, F.when(~F.exists(ends, lambda e: e.isNull()), F.array_max(ends)))
    found = per.withColumn("declared", declared).where("declared <> actual")
    # The warning's wording.
    text = F.format_string("I-record declares extensions out to column %d but B records are %d characters - logger extension fields (speed/vario) are unreliable in this file. All figures below are derived from positions and times.", "declared", "actual")
    return found.select("flight_id", "declared", "actual", text.alias("warning"))
