"""What a pasted link or flight number points to; nothing is fetched."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .parse import stripped

# The two services' link forms and the second one's file address.
WEGLIDE = r"(?i)weglide\.org/flight/([0-9]+)"
BGA = r"(?i)bgaladder\.net/(?:.*?[?&]flightid=|(?:FlightInfo|flight)/)([0-9]+)"
BGA_FILE = "https://api.bgaladder.net/API/FLIGHTIGC/"


def classify_links(df: DataFrame, column: str) -> DataFrame:
    """``kind, id, label, urls, file_name`` beside the column; null for what is no link."""
    s = stripped(F.col(column))
    found = lambda p: F.nullif(F.regexp_extract(s, p, 1), F.lit(""))
    weglide, bga = found(WEGLIDE), F.coalesce(found(BGA), found("^([0-9]{4,10})$"))
    host = F.when(s.rlike("(?i)^https?://"), F.lower(F.try_parse_url(s, F.lit("HOST"))))
    kind = F.when(weglide.isNotNull(), "weglide").when(bga.isNotNull(), "bga").when(host.isNotNull(), "direct")
    d = df.withColumn("kind", kind).withColumn("id", F.when(F.col("kind") == "weglide", weglide).when(F.col("kind") == "bga", bga).when(F.col("kind") == "direct", s))
    label = F.when(F.col("kind") == "weglide", F.concat(F.lit("WeGlide flight "), "id")).when(F.col("kind") == "bga", F.concat(F.lit("BGA Ladder flight "), "id")).when(F.col("kind") == "direct", host)
    urls = F.when(F.col("kind") == "bga", F.array(F.concat(F.lit(BGA_FILE), "id"))).when(F.col("kind") == "direct", F.array("id")).when(F.col("kind") == "weglide", F.expr("cast(array() as array<string>)"))
    last = F.substring_index(F.substring_index("id", "?", 1), "/", -1)
    last = F.when(last == "", "trace.igc").when(last.rlike(r"(?i)\.igc$"), last).otherwise(F.concat(last, F.lit(".igc")))
    name = F.when(F.col("kind") == "direct", last).when(F.col("kind").isNotNull(), F.concat("kind", F.lit("-"), "id", F.lit(".igc")))
    return d.withColumn("label", label).withColumn("urls", urls).withColumn("file_name", name)
