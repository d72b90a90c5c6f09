"""Quality rules with thresholds learned per language and source.

Exact counts per document come first.  Ratios of the documents that pass the
base rule go into quantile sketches per (language, source): counts of buckets
whose bounds grow by ``GROWTH``, so a quantile is right to half a percent of its
value.  Sketches merge by adding counts, never rows, into sketches per language
and of the whole corpus, and give the same result on every run.

No cutoff is fixed; fences follow from where a set's values lie, on a log scale
(of the odds, for shares).  A ratio that varies in every document has a fence
``SPREAD`` interquartile ranges beyond its quartiles.  One that is zero in a
quarter of the documents or more is measured by those where it is not: its fence
lies ``TAIL`` of their ranges beyond their upper quartile, and closer where the
sketch has a valley: no value over a factor of ``VALLEY``, zero standing for half
a unit of a text of middle size, with ``MASS`` of the documents or more (and
``LEAST`` / 10) beyond it, but less than half.  What stands beyond a valley is of
another kind, so the fence lies in its middle.  No fence comes closer to its
quartile than ``NOISE`` standard deviations of a count in a text of middle size.
Where hardly any text has a value but zero, too few to measure, the corpus's
fence goes towards the count that ``NOISE`` deviations of its own make.

A group's fence is weighed with its language's, and that with the corpus's, as
if the larger set had ``LEAST`` documents; and it passes its language's by a
quarter of that one's distance from the quartile at most, so that a source full
of junk does not set its own measure.  A join brings the fences back to the
documents: broadcast up to ``FEW_GROUPS`` groups, else salted.

Defined results: null and empty texts count 0 words and fail the base rule;
null language or source is a group of its own; repeated rows are judged alike;
an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common as C
from . import text_stats

SPREAD, TAIL, NOISE = 6.0, 3.0, 3.0
VALLEY, MASS = 8.0, 0.01
LEAST = 200
GROWTH = 1.01
FEW_GROUPS, SALTS = 20_000, 64
#: Ratios that are shares, by the count that they are shares of.
SHARES = {"symbols": "word_chars", "dup_lines": "n_lines", "repeats": "n_words", "upper": "word_chars"}
RATIOS = ("word_length", *SHARES)
#: The bucket of zero.
ZERO = -(1 << 20)


def base_counts(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns and ``text_stats.COUNTS`` of every row, in one scan."""
    rows = docs.select(*keep, F.col(text).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def run(batches):
        for batch in C.chunks(batches, "__text"):
            own = text_stats.counts(batch.column("__text"))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *[pa.array(own[c], pa.int64()) for c in text_stats.COUNTS]], names=[*keep, *text_stats.COUNTS])

    return rows.mapInArrow(run, schema + "".join(f", {c} long" for c in text_stats.COUNTS))


def ratios() -> dict[str, Column]:
    per = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {"word_length": per("word_chars", "n_words"), "symbols": per("n_symbols", "word_chars"), "dup_lines": per("n_dup_lines", "n_lines"), "repeats": per("n_repeat_words", "n_words"), "upper": per("n_upper", "word_chars")}


def sketches(counted: DataFrame) -> DataFrame:
    """``lang, source, ratio, bucket, n`` of the rows that pass the base rule; ``unit_`` ratios are one by each count."""
    units = {f"unit_{c}": 1 / F.greatest(F.col(c), F.lit(1)) for c in sorted(set(SHARES.values()))}
    values = F.explode(F.array(*[F.struct(F.lit(k).alias("ratio"), v.alias("v")) for k, v in (ratios() | units).items()]))
    each = counted.where("not base_failed").select("lang", "source", values.alias("x")).select("lang", "source", "x.*")
    bucket = F.when(F.col("v") > 0, F.ceil(F.log(F.col("v")) / math.log(GROWTH)).cast("int")).otherwise(ZERO)
    return each.groupBy("lang", "source", "ratio", bucket.alias("bucket")).agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, *keys: str) -> DataFrame:
    return sketch.groupBy(*keys, "ratio", "bucket").agg(F.sum("n").alias("n"))


def value_of(bucket: Column) -> Column:
    return F.when(bucket == ZERO, 0.0).otherwise(F.pow(F.lit(GROWTH), bucket) * (2 / (1 + GROWTH)))


def units(sketch: DataFrame) -> dict[str, int]:
    """For each ratio, the bucket of one unit of a text of middle size, over the whole corpus."""
    each = merged(sketch.where(F.col("ratio").startswith("unit_")))
    own = W.partitionBy("ratio")
    upto = each.withColumn("upto", F.sum("n").over(own.orderBy("bucket").rowsBetween(W.unboundedPreceding, 0))).withColumn("all", F.sum("n").over(own))
    found = {r["ratio"]: r["b"] for r in upto.where("2 * upto > all - 1").groupBy("ratio").agg(F.min("bucket").alias("b")).collect()}
    return {k: found[f"unit_{c}"] for k, c in {"word_length": "word_chars", **SHARES}.items() if f"unit_{c}" in found}


def limits(sketch: DataFrame, unit: dict[str, int], *keys: str, spread: float = SPREAD, tail: float = TAIL) -> DataFrame:
    """``keys, ratio, n, a, z, lo, hi, valley, all``: fences from ``n`` measured values, and the valley among ``all``."""
    own = W.partitionBy(*keys, "ratio")
    sofar = own.orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
    s = sketch.where(F.col("ratio").isin(*RATIOS))
    s = s.withColumn("all", F.sum("n").over(own)).withColumn("nil", F.coalesce(F.sum(F.when(F.col("bucket") == ZERO, F.col("n"))).over(own), F.lit(0)))
    s = s.withColumn("skip", F.when(F.col("nil") * 4 >= F.col("all"), F.col("nil")).otherwise(0)).withColumn("upto", F.sum("n").over(sofar))
    rank = lambda q: (F.col("upto") > F.col("skip") + (F.col("all") - F.col("skip") - 1) * q) & (F.col("upto") > F.col("skip"))
    at = lambda q: value_of(F.min(F.when(rank(q), F.col("bucket"))))
    # valleys: from the highest place before to this one
    one = F.create_map(*[F.lit(x) for kv in (unit or {"": 0}).items() for x in kv])[F.col("ratio")]
    place = F.when(F.col("bucket") != ZERO, F.col("bucket")).otherwise(one - math.ceil(math.log(2) / math.log(GROWTH)))
    s = s.withColumn("place", place).withColumn("before", F.max("place").over(own.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)))
    beyond, wide = F.col("all") - F.col("upto") + F.col("n"), F.col("place") - F.col("before")
    other = (F.col("skip") > 0) & (wide >= math.log(VALLEY) / math.log(GROWTH)) & (beyond >= F.greatest(F.col("all") * MASS, F.lit(LEAST / 10))) & (beyond * 2 < F.col("all"))
    middle = (F.pow(F.lit(GROWTH), F.col("place")) + F.pow(F.lit(GROWTH), F.col("before"))) / 2
    q = s.groupBy(*keys, "ratio").agg(F.max("all").alias("all"), F.max("skip").alias("skip"), at(0.25).alias("a"), at(0.75).alias("z"), F.max(F.when(other, F.struct(wide.alias("wide"), middle.alias("valley"))))["valley"].alias("valley"))
    share = F.col("ratio").isin(*SHARES)
    scaled = lambda v: F.when(share, F.log(v / F.greatest(1 - v, F.lit(1e-9)))).otherwise(F.log(v))
    back = lambda x: F.when(share, 1 / (1 + F.exp(-x))).otherwise(F.exp(x))
    varies = F.when(share, F.col("z") * (1 - F.col("z"))).otherwise(1.0)
    noise = F.lit(NOISE) * F.sqrt(value_of(one) / F.greatest(varies, F.lit(1e-9)))
    reach = F.greatest(F.when(F.col("skip") > 0, tail).otherwise(spread) * (scaled(F.col("z")) - scaled(F.col("a"))), noise)
    q = q.withColumn("lo", F.when((F.col("skip") == 0) & ~share, back(scaled(F.col("a")) - reach))).withColumn("hi", back(scaled(F.col("z")) + reach))
    return q.select(*keys, "ratio", (F.col("all") - F.col("skip")).alias("n"), "a", "z", "lo", "hi", "valley", "all")


def of_corpus(limit: DataFrame, unit: dict[str, int], least: int) -> DataFrame:
    """The corpus's limits, weighed with ``NOISE ** 2`` units as if ``least`` / 10 values spoke for those, where zero is common."""
    every = limit.sparkSession.createDataFrame([(k, NOISE**2 * GROWTH**u) for k, u in unit.items()], "ratio string, units double")
    n, some = F.coalesce("n", F.lit(0)), least / 10
    rare = (F.col("ratio") != "word_length") & (F.col("n") < F.col("all"))
    hi = F.when(rare, (n * F.coalesce("hi", F.lit(0.0)) + some * F.least("units", F.lit(1.0))) / (n + some)).otherwise(F.col("hi"))
    return limit.join(F.broadcast(every), "ratio").withColumn("hi", hi).drop("units")


def fences(counted: DataFrame, spread: float = SPREAD, tail: float = TAIL, least: int = LEAST) -> DataFrame:
    """``lang, source`` and each ratio's ``lo_`` and ``hi_`` fence, null for none."""
    sketch = C.stored(sketches(counted), "sketch")
    unit = units(sketch)
    found = lambda *keys: limits(merged(sketch, *keys), unit, *keys, spread=spread, tail=tail)
    named = lambda df, tag: df.select(*[F.col(k).alias(f"{k}_{tag}") for k in df.columns])
    same = lambda k, tag: F.col(k).eqNullSafe(F.col(f"{k}_{tag}"))
    met = counted.groupBy("lang", "source").agg(F.lit(1).alias("__one")).select("lang", "source", F.explode(F.array(*map(F.lit, RATIOS))).alias("ratio"))
    met = met.join(named(found("lang", "source"), "s"), same("lang", "s") & same("source", "s") & (F.col("ratio") == F.col("ratio_s")), "left")
    met = met.join(named(found("lang"), "l"), same("lang", "l") & (F.col("ratio") == F.col("ratio_l")), "left")
    met = met.join(F.broadcast(named(of_corpus(found(), unit, least), "c")), F.col("ratio") == F.col("ratio_c"), "left")

    def weighed(own: Column, n: Column, parent: Column) -> Column:
        n = F.coalesce(n, F.lit(0))
        return F.coalesce((n * own + least * parent) / (n + least), own, parent)

    def by_language(c: str, n: str) -> Column:
        return weighed(F.col(f"{c}_l"), F.col(f"{n}_l"), F.col(f"{c}_c"))

    met = met.select("*", *[by_language(c, n).alias(f"{c}_p") for c, n in (("lo", "n"), ("hi", "n"), ("valley", "all"))])
    own = {c: weighed(F.col(f"{c}_s"), F.col(f"{n}_s"), F.col(f"{c}_p")) for c, n in (("lo", "n"), ("hi", "n"), ("valley", "all"))}
    lo = F.greatest(own["lo"], F.col("lo_p") - F.greatest(F.coalesce("a_l", "a_c") - F.col("lo_p"), F.lit(0.0)) / 4)
    hi = F.least(own["hi"], F.col("hi_p") + F.greatest(F.col("hi_p") - F.coalesce("z_l", "z_c"), F.lit(0.0)) / 4)
    met = met.select("lang", "source", "ratio", lo.alias("lo"), F.least(hi, own["valley"]).alias("hi"))
    one = lambda k, c: F.max(F.when(F.col("ratio") == k, F.col(c))).alias(f"{c}_{k}")
    return met.groupBy("lang", "source").agg(*[one(k, c) for k in RATIOS for c in ("lo", "hi")])


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", spread: float = SPREAD, tail: float = TAIL, least: int = LEAST, few_groups: int = FEW_GROUPS) -> DataFrame:
    """Counts, ``base_failed``, the names of broken adaptive rules, and ``kept`` of every row."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(source).alias("source"), F.col(text).alias("text"))
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    counted = C.stored(base_counts(rows, ["doc_id", "lang", "source"]).withColumn("base_failed", failed), "counts")
    found = C.stored(fences(counted, spread, tail, least), "fences")
    found = found.select(F.col("lang").alias("fl"), F.col("source").alias("fs"), *[c for c in found.columns if c not in ("lang", "source")])
    same = F.col("lang").eqNullSafe(F.col("fl")) & F.col("source").eqNullSafe(F.col("fs"))
    if found.count() <= few_groups:
        met = counted.join(F.broadcast(found), same, "left")
    else:  # a source may hold a third of all rows: each of its documents asks one of several copies of the fences
        salted = counted.withColumn("salt", F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(SALTS)))
        copies = found.withColumn("fsalt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        met = salted.join(copies, same & (F.col("salt") == F.col("fsalt")), "left").drop("salt", "fsalt")
    broken = F.filter(F.array(*[F.when((v > F.col(f"hi_{k}")) | (v < F.col(f"lo_{k}")), F.lit(k)) for k, v in ratios().items()]), lambda x: x.isNotNull())
    return met.withColumn("broken", F.concat_ws(",", broken)).withColumn("kept", ~F.col("base_failed") & (F.col("broken") == ""))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the adaptive verdict of every document."""
    out = judge(C.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "broken")


QUERIES = {"op8_quality_rules": op8_quality_rules}
ORACLES: dict[str, str] = {}
