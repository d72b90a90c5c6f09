"""Glider polars: the bundled table, matching by type header, fit and best glide.

The polar table is configuration of a bounded size, so its keys enter plans as
literals; no join with it is needed.
"""

from __future__ import annotations

from itertools import accumulate, repeat

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A polar database may not exceed this many entries.
MAX_ENTRIES = 5000
MIN_SINK_RATIO = 0.75

# Name, match keys, published best glide, its speed in km/h, minimum sink in m/s.
GLIDERS = [
    ("ASK 13", ["ask13", "ask 13", "k-13", "k13"], 27, 80, 0.79),
    ("ASK 21", ["ask21", "ask 21", "k-21", "k21"], 34, 95, 0.68),
    ("Grob G103 Twin Astir", ["twin astir", "g103", "g-103", "twin ii", "twin iii", "twin 3"], 38, 100, 0.70),
    ("Grob G102 Astir CS", ["astir cs", "g102", "g-102", "astir"], 36, 95, 0.66),
    ("SZD-50 Puchacz", ["puchacz", "szd-50", "szd50"], 30, 90, 0.80),
    ("SZD-51 Junior", ["junior", "szd-51", "szd51"], 35, 92, 0.62),
    ("Schleicher K8", ["k8", "k-8", "ka8", "ka-8"], 26, 72, 0.72),
    ("Standard Cirrus", ["cirrus"], 36.5, 95, 0.60),
    ("PIK-20D", ["pik-20", "pik20", "pik 20"], 41, 108, 0.57),
    ("LS4", ["ls4", "ls-4"], 40.5, 100, 0.60),
    ("Discus", ["discus 2", "discus2", "discus"], 42.5, 105, 0.59),
    ("Duo Discus", ["duo discus", "duo"], 45, 110, 0.61),
    ("ASW 19", ["asw19", "asw 19"], 38, 95, 0.60),
    ("ASW 20", ["asw20", "asw 20"], 42.5, 110, 0.58),
    ("ASW 24", ["asw24", "asw 24"], 42.5, 105, 0.58),
    ("ASW 27", ["asw27", "asw 27"], 48, 115, 0.55),
    ("ASW 28 (15 m)", ["asw28", "asw 28"], 45, 110, 0.55),
    ("ASG 29 (18 m)", ["asg29", "asg 29"], 52, 120, 0.51),
    ("Ventus (15 m)", ["ventus"], 46, 112, 0.55),
    ("LAK-17 (18 m)", ["lak-17", "lak17"], 50, 118, 0.52),
    ("JS1 (18 m)", ["js1", "js-1"], 52, 120, 0.50),
    ("DG-1000 (20 m)", ["dg-1000", "dg1000"], 46, 115, 0.58),
    ("DG-505 (20 m)", ["dg-505", "dg505"], 43, 108, 0.60),
    ("Nimbus (25 m)", ["nimbus"], 57, 120, 0.45),
    ("ASH 25 (25 m)", ["ash25", "ash 25"], 57, 120, 0.45),
    ("Perkoz", ["perkoz", "szd-54", "szd54"], 36, 100, 0.65),
    ("Grob G109 / motorglider", ["g109", "g-109", "motorglider", "falke", "dimona"], 26, 95, 0.85),
]
DEFAULT = ("generic 38:1 glass single-seater", [], 38, 98, 0.62)

PUBLISHED = "struct<best_ld:double,best_ld_kmh:double,min_sink_ms:double>"


def bundled(spark: SparkSession, gliders: list[tuple] = GLIDERS) -> DataFrame:
    """The bundled table, or one of other gliders: name, match, published, points, db_order, is_default."""
    rows = [(g[0], g[1], tuple(map(float, g[2:])), k, False) for k, g in enumerate(gliders)] + [(DEFAULT[0], [], tuple(map(float, DEFAULT[2:])), 1 << 30, True)]
    table = spark.createDataFrame(rows, f"name string, match array<string>, published {PUBLISHED}, db_order long, is_default boolean")
    return table.withColumn("points", derived_points(F.col("published"))).select("name", "match", "published", "points", "db_order", "is_default")


def derived_points(published: Column) -> Column:
    """Three (km/h, m/s) points at minimum sink, best glide and half again, on the curve with that best glide."""
    v = published["best_ld_kmh"] / 3.6
    a = v / published["best_ld"] / (2 * (1 - MIN_SINK_RATIO))
    b, c = a * (-2 * MIN_SINK_RATIO) / v, a / (v * v)
    speed = lambda k: F.floor(published["best_ld_kmh"] * k + 0.5).cast("double")
    sink = lambda u: F.round(a + b * (u / 3.6) + c * (u / 3.6) * (u / 3.6), 3)
    return F.array(*[F.array(speed(k), sink(speed(k))) for k in (MIN_SINK_RATIO, 1.0, 1.5)])


def fit(points: Column) -> tuple[Column, Column, Column, Column]:
    """c0 + c1 v + c2 v² in m/s through exactly three points, by divided differences; and whether they are fit for it."""
    v, s = ([F.get(F.get(points, F.lit(k)), F.lit(c)) for k in range(3)] for c in range(2))
    v = [x / 3.6 for x in v]
    sound = (F.size(points) == 3) & (v[0] != v[1]) & (v[1] != v[2]) & (v[0] != v[2])
    slope = lambda i, j: F.when(sound, (s[j] - s[i]) / F.nullif(v[j] - v[i], F.lit(0.0)))
    c2 = (slope(1, 2) - slope(0, 1)) / F.nullif(v[2] - v[0], F.lit(0.0))
    c1 = slope(0, 1) - c2 * (v[0] + v[1])
    return F.when(sound, s[0] - c1 * v[0] - c2 * v[0] * v[0]), c1, c2, F.coalesce(sound, F.lit(False))


#: 15 m/s and on in steps of a tenth, added up as the scan does, below 60.
GRID = [v for v in accumulate(repeat(0.1, 460), initial=15.0) if v < 60]


def best_glide(c0: Column, c1: Column, c2: Column) -> Column:
    """``ld, speed`` of the first best v / sink on the grid; (0, null) without a sinking speed, null without a polar."""
    grid = F.array(*map(F.lit, GRID))
    sink = lambda v: c0 + c1 * v + c2 * v * v
    best = F.array_max(F.transform(grid, lambda v: F.when(sink(v) > 0, F.struct((v / sink(v)).alias("ld"), (-v).alias("back")))))
    return F.when(c0.isNotNull(), F.struct(F.coalesce(best["ld"], F.lit(0.0)).alias("ld"), (-best["back"]).alias("speed")))


def fitted(table: DataFrame) -> DataFrame:
    c0, c1, c2, sound = fit(F.col("points"))
    t = table.withColumn("c0", c0).withColumn("c1", c1).withColumn("c2", c2).withColumn("sound", sound)
    return t.withColumn("best", best_glide(F.col("c0"), F.col("c1"), F.col("c2")))


def _entries(table: DataFrame) -> list:
    rows = table.orderBy("db_order").limit(MAX_ENTRIES + 1).collect()
    if len(rows) > MAX_ENTRIES:
        raise ValueError(f"a polar database of more than {MAX_ENTRIES} entries")
    return rows


def squash(text: Column) -> Column:
    return F.translate(F.lower(text), "- ", "")


def substrings(text: Column, longest: Column | int) -> Column:
    """Every substring of up to ``longest`` characters, the empty one included, once each."""
    size = F.length(text)
    every = F.flatten(F.transform(F.sequence(F.lit(1), size), lambda a: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), size - a + 1)), lambda n: F.substr(text, a, n))))
    return F.array_distinct(F.concat(F.array(F.lit("")), F.when(size > 0, every).otherwise(F.array().cast("array<string>"))))


def match_polars(types: DataFrame, table: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """``flight_id, name, note, matched, points, c0, c1, c2, best_ld, best_ld_speed_ms`` of every flight.

    ``types`` has flight_id and glider_type; ``overrides`` may give a flight
    ``custom`` points, or ``force``: a substring of a name or key, or ``none``.
    The longest key found in the type wins, the first of the table on ties.
    Types, not flights, meet the keys, which are found among the substrings of the type; the table is checked to be small.
    """
    spark = types.sparkSession
    rows = _entries(table)
    gliders, default = [r for r in rows if not r.is_default], next(r for r in rows if r.is_default)
    keys = [(m.replace("-", "").replace(" ", ""), r.db_order) for r in gliders for m in r.match]
    names = [(part, r.db_order) for r in gliders for part in (r.name.lower(), *r.match)]
    key_table = F.broadcast(spark.createDataFrame(keys, "key string, g long"))
    name_table = spark.createDataFrame(names, "part string, g long")
    known = F.broadcast(spark.createDataFrame([(r.db_order, r.name, r.points) for r in rows], "g long, name string, points array<array<double>>"))
    t = types.select("flight_id", "glider_type")
    seen = t.select("glider_type").distinct().where("glider_type is not null").withColumn("squashed", squash(F.col("glider_type")))
    longest = max((len(k) for k, _ in keys), default=0)
    parts = seen.select("glider_type", F.explode(substrings(F.col("squashed"), longest)).alias("key"))
    best = parts.join(key_table, "key").groupBy("glider_type").agg(F.min(F.struct(-F.length("key"), "g"))["g"].alias("hit"))
    t = t.join(best, "glider_type", "left")
    if overrides is None:
        t = t.withColumn("custom", F.lit(None).cast("array<array<double>>")).withColumn("force", F.lit(None).cast("string")).withColumn("forced", F.lit(None).cast("long"))
    else:
        t = t.join(overrides.select("flight_id", "custom", F.lower("force").alias("force")), "flight_id", "left")
        asked = t.select("force").distinct().where("length(force) > 0")
        # what is asked for meets the names by its first three characters
        grams = name_table.select("part", "g", F.explode(substrings(F.col("part"), 3)).alias("gram"))
        meet = asked.withColumn("gram", F.substring("force", 1, 3)).join(grams, "gram").where(F.instr("part", F.col("force")) > 0)
        t = t.join(meet.groupBy("force").agg(F.min("g").alias("forced")), "force", "left")
    custom, none, forced, hit = F.col("custom").isNotNull(), F.coalesce(F.col("force") == "none", F.lit(False)), F.col("forced").isNotNull(), F.col("hit").isNotNull()
    how = F.when(custom, "custom").when(none, "none").when(forced, "forced").when(hit, "matched").otherwise("default")
    t = t.withColumn("how", how).withColumn("g", F.when(F.col("how") == "forced", F.col("forced")).when(F.col("how") == "matched", F.col("hit")).when(F.col("how") == "default", F.lit(default.db_order)))
    t = t.join(known, "g", "left")
    own = F.col("how") == "custom"
    # The notes' wording.
    guess = F.concat(F.lit("no polar match for "), F.coalesce(F.concat(F.lit("'"), "glider_type", F.lit("'")), F.lit("None")), F.lit(f"; using a {default.name} - treat airmass figures as indicative only"))
    note = (
        F.when(own, "custom polar supplied").when(F.col("how") == "none", "polar disabled - no airmass analysis").when(F.col("how") == "forced", F.concat(F.lit("polar forced to "), "name"))
        .when(F.col("how") == "matched", F.concat(F.lit("polar matched to "), "name", F.lit(" from the glider-type header"))).otherwise(guess)
    )
    t = t.select("flight_id", F.when(own, "custom").otherwise(F.col("name")).alias("name"), note.alias("note"), F.col("how").isin("custom", "forced", "matched").alias("matched"), F.when(own, F.col("custom")).otherwise(F.col("points")).alias("points"))
    # flights share few curves: each is fitted once
    curves = fitted(t.select("points").distinct().where("points is not null"))
    curves = curves.select("points", "c0", "c1", "c2", F.col("best")["ld"].alias("best_ld"), F.col("best")["speed"].alias("best_ld_speed_ms"))
    return t.join(curves, "points", "left").select("flight_id", "name", "note", "matched", "points", "c0", "c1", "c2", "best_ld", "best_ld_speed_ms")


def violations(table: DataFrame) -> DataFrame:
    """``name, rule`` of the entries whose fit does not reproduce what is published."""
    t = fitted(table)
    lowest = F.col("c0") - F.col("c1") * F.col("c1") / (F.col("c2") * 4)
    want = derived_points(F.col("published"))
    p = F.col("published")
    rules = {
        "degenerate": ~F.col("sound"),
        "best_ld": F.abs(F.col("best")["ld"] - p["best_ld"]) >= 0.3,
        "best_ld_speed": F.abs(F.col("best")["speed"] * 3.6 - p["best_ld_kmh"]) >= 3,
        "min_sink": F.abs(lowest / p["min_sink_ms"] - 1) >= 0.15,
        "points": F.exists(F.sequence(F.lit(0), F.lit(2)), lambda k: (F.abs(F.get(F.get("points", k), F.lit(0)) - want[k][0]) > 1e-9) | (F.abs(F.get(F.get("points", k), F.lit(1)) - want[k][1]) > 1e-9)),
        "published_ld": (p["best_ld"] <= 15) | (p["best_ld"] >= 75),
    }
    return t.select("name", F.explode(F.filter(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(k)) for k, c in rules.items()]), lambda x: x.isNotNull())).alias("rule"))
