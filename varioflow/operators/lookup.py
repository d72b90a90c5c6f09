"""Questions about spans and instants of a flight."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def overlap_span(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """Climbs or legs (with start, end) that touch a span (span_id, span_start, span_end) of their flight."""
    return rows.join(spans, "flight_id").where((F.col("end") >= F.col("span_start")) & (F.col("start") <= F.col("span_end")))


def span_counts(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """How many climbs or legs touch each span, and its length.

    Rows that start up to the span's end, less those that end before its start:
    two counts that one pass over a flight's merged times keeps, so the cost is
    one sort of both, whatever overlaps.  Rows have start <= end; a span's ends
    may come in either order, a row or span without both touches nothing.
    """
    none = F.lit(None)
    at = lambda t, turn, started, ended, span: F.struct(t.cast("long").alias("t"), F.lit(turn).alias("turn"), F.lit(started).alias("started"), F.lit(ended).alias("ended"), span.cast("long").alias("span_id"))
    # at equal times: spans begin, rows end, rows start, spans end
    r = rows.where("start is not null and end is not null").select("flight_id", F.explode(F.array(at(F.col("start"), 2, 1, 0, none), at(F.col("end"), 1, 0, 1, none))).alias("x"))
    low, high = F.least("span_start", "span_end"), F.greatest("span_start", "span_end")
    s = spans.where("span_start is not null and span_end is not null").select("flight_id", F.explode(F.array(at(low, 0, 0, 0, F.col("span_id")), at(high, 3, 0, 0, F.col("span_id")))).alias("x"))
    so_far = W.partitionBy("flight_id").orderBy("t", "turn").rowsBetween(W.unboundedPreceding, 0)
    merged = r.unionByName(s).select("flight_id", "x.*").withColumn("started", F.sum("started").over(so_far)).withColumn("ended", F.sum("ended").over(so_far))
    n = F.sum(F.when(F.col("turn") == 3, F.col("started")).otherwise(-F.col("ended")))
    hit = merged.where("span_id is not null").groupBy("flight_id", "span_id").agg(n.alias("n"))
    return spans.join(hit, ["flight_id", "span_id"], "left").select("flight_id", "span_id", F.coalesce("n", F.lit(0)).alias("n"), (F.col("span_end") - F.col("span_start")).alias("span_s"))


def fix_at(fixes: DataFrame, queries: DataFrame) -> DataFrame:
    """For each (flight_id, query_id, at): the first fix at or after it, the last fix past the end.

    Queries are merged into the flight's timeline and read backwards, so the
    cost is one sort, not a range join.
    """
    f = fixes.select("flight_id", F.lit(None).cast("long").alias("query_id"), "t", F.lit(1).alias("__fix"), F.struct("idx", "t", "alt").alias("fix"))
    q = queries.select("flight_id", F.col("query_id").cast("long").alias("query_id"), F.col("at").cast("long").alias("t"), F.lit(0).alias("__fix"), F.lit(None).cast(f.schema["fix"].dataType).alias("fix"))
    back = W.partitionBy("flight_id").orderBy(F.desc("t"), F.desc("__fix"), F.desc("fix.idx")).rowsBetween(W.unboundedPreceding, 0)
    every = f.unionByName(q).withColumn("__next", F.last("fix", ignorenulls=True).over(back)).withColumn("__end", F.max("fix").over(W.partitionBy("flight_id")))
    return every.where("__fix = 0").select("flight_id", "query_id", F.col("t").alias("at"), F.coalesce("__next", "__end").alias("fix")).where("fix is not null").select("flight_id", "query_id", "at", F.col("fix.idx").alias("idx"), F.col("fix.t").alias("t"), F.col("fix.alt").alias("alt"))


def highlight_range(fixes: DataFrame, spans: DataFrame) -> DataFrame:
    """The fixes from ``fix_at(span_start)`` to ``fix_at(span_end)`` inclusive, by span.

    The positions between are listed and meet the fixes by flight and position, so only hit fixes are paired.
    """
    ends = spans.select("flight_id", F.explode(F.array(F.struct((F.col("span_id") * 2).alias("query_id"), F.col("span_start").alias("at")), F.struct((F.col("span_id") * 2 + 1).alias("query_id"), F.col("span_end").alias("at")))).alias("x")).select("flight_id", "x.*")
    at = fix_at(fixes, ends).groupBy("flight_id", F.floor(F.col("query_id") / 2).alias("span_id")).agg(F.min("idx").alias("lo"), F.max("idx").alias("hi"))
    return fixes.join(at.select("flight_id", "span_id", F.explode(F.sequence("lo", "hi")).alias("idx")), ["flight_id", "idx"])
