"""URL filter: rules first, then segmented words scored by naive Bayes.

The distinct hosts and path keys (a path's letters and numbers) are far fewer
than the pages, so words are found and scored per key and joined back.  A piece
of a key is split into words by unigram Viterbi; the unigram counts come from
the text of all pages.  A piece's possible words are looked up by a join, so no
dictionary is collected or broadcast.

Multinomial naive Bayes scores the words of host and path.  No labels are given:
seed words say at first which urls are more likely bad, and that is all they do.
A round counts every word in likely bad and likely good urls, and the model that
follows judges the urls anew.  In that judgement a url's own seed is no evidence:
the strongest odds of a seed word in it are left out, so the verdict is that of
its other words, which may be seeds too.  A url without a seed is blocked for the
company its words keep, and one with a seed passes if its other words are good.

Counts and odds are tables by word, and meet the urls' words by joins; words and
hosts that hold more than a thousandth of a side (so at most a thousand) meet by
broadcast.  Odds are whole millionths and shares whole thousandths, so that a
rerun gives the same model.

Defined results: a null url, or one without ``://``, has an empty host and path;
repeated rows are judged alike; of rules of one length the first in the order
given wins; pages with null html add no words; an empty table gives an empty
one; other columns are ignored.
"""

from __future__ import annotations

import math

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Substrings up to this length are looked up one by one, longer words by what they begin with.
SHORT_WORD = 24
#: Rounds of expectation and maximisation; first share of bad urls; how much more likely bad a url with a seed is at first.
ROUNDS, SHARE, SEED_ODDS = 2, 0.05, 100.0
#: A key with a larger share of a table's rows is met by broadcast.
HEAVY = 1000
MICRO = 1_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Words that speak for an unwanted page, in the languages served.
SEEDS = (
    "adult", "ads", "bet", "bets", "betting", "casino", "cheap", "gambling", "pills", "poker", "porn", "scam", "sex", "slots", "spam", "track", "tracker", "viagra", "warez", "xxx",
    "billig", "erotik", "pillen", "werbung", "wetten",
    "apuestas", "barato", "pastillas", "publicidad",
    "pilules", "publicité",
)


def _rest(url: Column) -> Column:
    """What follows the first ``://``."""
    return F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule (``host/path``, verdict) that fits, as a struct; null if none does."""
    chosen = None
    for rule, verdict in sorted(rules, key=lambda r: -len(r[0])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        value = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        chosen = F.when(fits, value) if chosen is None else chosen.when(fits, value)
    return chosen if chosen is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def word_counts(pages: DataFrame, html: str = "html") -> DataFrame:
    """``word, n``: lower-cased letter strings of the pages' text."""

    def count(batches):
        for batch in C.chunks(batches, "html"):
            text = pc.replace_substring_regex(pc.fill_null(batch.column("html"), ""), r"(?s)<(?:script|style)\b.*?</(?:script|style)>|<[^>]*>|&\w+;", " ")
            letters = pc.replace_substring_regex(pc.utf8_lower(text), r"[^\pL]+", " ")
            flat, _ = C.words(letters)
            each = pc.value_counts(flat)
            yield pa.RecordBatch.from_arrays([each.field("values"), each.field("counts")], names=["word", "n"])

    return pages.select(F.col(html).alias("html")).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def viterbi(piece: str, logs: dict[str, float], unknown: float) -> list[str]:
    """The likeliest split; an unknown word costs ``unknown`` and a tenth for each letter.

    Of equally likely splits the one whose last word is longest.  ``open_`` is the
    best value with an unknown word still running, so words have no greatest length.
    """
    sizes = sorted({len(w) for w in logs}, reverse=True)
    best, back = [0.0], [0]
    open_, since = -math.inf, 0
    for end in range(1, len(piece) + 1):
        if best[end - 1] + unknown > open_:
            open_, since = best[end - 1] + unknown, end - 1
        open_ -= math.log(10)
        value, start = open_, since
        for k in sizes:
            if k <= end and (v := logs.get(piece[end - k : end])) is not None:
                v += best[end - k]
                if (v, -(end - k)) > (value, -start):
                    value, start = v, end - k
        best.append(value)
        back.append(start)
    out, end = [], len(piece)
    while end:
        out.append(piece[back[end] : end])
        end = back[end]
    return out[::-1]


def _possible(pieces: DataFrame, counts: DataFrame) -> DataFrame:
    """``piece, word, n`` of the known words in each piece, of any length."""
    n = F.length("piece")
    ends = F.explode(F.sequence(F.lit(1), n))
    parts = pieces.select("piece", ends.alias("e")).select("piece", F.explode(F.transform(F.sequence(F.greatest(F.lit(1), F.col("e") - SHORT_WORD + 1), F.col("e")), lambda s: F.substr("piece", s, F.col("e") - s + 1))).alias("word")).distinct()
    long = counts.where(F.length("word") > SHORT_WORD).withColumn("head", F.left("word", F.lit(SHORT_WORD)))
    heads = pieces.where(n > SHORT_WORD).select("piece", F.explode(F.sequence(F.lit(1), n - SHORT_WORD)).alias("s")).withColumn("head", F.substr("piece", F.col("s"), F.lit(SHORT_WORD)))
    longer = heads.join(long, "head").where(F.substr("piece", F.col("s"), F.length("word")) == F.col("word")).select("piece", "word", "n").distinct()
    return parts.join(counts, "word").select("piece", "word", "n").unionByName(longer)


def segmented(pieces: DataFrame, counts: DataFrame, seeds: tuple[str, ...] = SEEDS) -> DataFrame:
    """``piece, words`` of the distinct pieces."""
    spark = pieces.sparkSession
    seeded = spark.createDataFrame([(s,) for s in seeds], "word string")
    total = counts.agg(F.sum("n").alias("n")).first()["n"] or 0
    # seeds are words, however rare in the text
    weight = max(total // 1000, 10)
    every = counts.unionByName(seeded.select("word", F.lit(weight).cast("long").alias("n"))).groupBy("word").agg(F.sum("n").alias("n"))
    size = total + weight * len(seeds)
    found = _possible(pieces, every).groupBy("piece").agg(F.map_from_entries(F.collect_list(F.struct("word", F.log(F.col("n") / F.lit(float(size)))))).alias("logs"))
    unknown = math.log(10 / size)

    def split(batches):
        for batch in batches:
            pdf = batch.to_pandas()
            words = [viterbi(p, dict(m) if m is not None else {}, unknown) for p, m in zip(pdf["piece"], pdf["logs"])]
            yield pa.RecordBatch.from_arrays([batch.column("piece"), pa.array(words, pa.list_(pa.string()))], names=["piece", "words"])

    return pieces.join(found, "piece", "left").select("piece", "logs").mapInArrow(split, "piece string, words array<string>")


def tokens(keys: DataFrame, counts: DataFrame, seeds: tuple[str, ...] = SEEDS) -> DataFrame:
    """``key, words`` of the distinct keys: letter pieces segmented, a number as ``0``."""
    pieces = keys.select("key", F.posexplode(F.regexp_extract_all("key", F.lit(r"\p{L}+|[0-9]+"), F.lit(0))).alias("at", "piece"))
    pieces = pieces.withColumn("piece", F.when(F.col("piece").rlike("^[0-9]"), "0").otherwise(F.lower("piece")))
    known = segmented(pieces.select("piece").distinct(), counts, seeds)
    met = pieces.join(known, "piece").groupBy("key").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "words"))), lambda x: x["words"])).alias("words"))
    return keys.join(met, "key", "left").select("key", F.coalesce("words", F.expr("cast(array() as array<string>)")).alias("words"))


def heavy(rows: DataFrame, key: str, weight: Column | None = None) -> DataFrame:
    """The keys with more than one ``HEAVY``th of all rows (or of their weight): fewer than ``HEAVY`` of them."""
    sizes = C.stored(rows.groupBy(key).agg((F.count("*") if weight is None else F.sum(weight)).alias("n")), "sizes")
    total = sizes.agg(F.sum("n").alias("n")).first()["n"] or 0
    found = sizes.where(F.col("n") * HEAVY > total).select(key).collect()
    return rows.sparkSession.createDataFrame([(r[key],) for r in found], f"`{key}` string")


def met(left: DataFrame, right: DataFrame, key: str, large: DataFrame) -> DataFrame:
    """``left`` left-joined with ``right`` (a row a key) where the keys of ``large`` are frequent on the left."""
    large = F.broadcast(large)
    often = left.join(large, key, "left_semi").join(F.broadcast(right.join(large, key, "left_semi")), key, "left")
    return often.unionByName(left.join(large, key, "left_anti").join(right, key, "left"))


def odds_of(scored: Column) -> Column:
    return F.rint(F.lit(1000.0) / (1 + F.exp(-F.greatest(F.least(scored, F.lit(50.0)), F.lit(-50.0))))).cast("long")


class Bayes:
    """The urls' words, and rounds of a multinomial model over them.

    ``pairs`` has host, key and how many pages have both; ``known`` the words of
    every host and key.
    """

    def __init__(self, pairs: DataFrame, known: DataFrame, seeds: tuple[str, ...]):
        self.pairs = pairs
        seeded = F.array(*map(F.lit, seeds)) if seeds else F.array().cast("array<string>")
        self.keys = known.select("key", F.arrays_overlap("words", seeded).alias("seeded"))
        self.words = C.stored(known.select("key", F.explode("words").alias("word")).withColumn("seed", F.array_contains(seeded, F.col("word"))), "key-words")
        self.hosts, self.paths, self.often = heavy(pairs, "host"), heavy(pairs, "key"), heavy(self.words, "word")

    def _of_pairs(self, of_key: DataFrame) -> DataFrame:
        """``pairs`` with what their host (``h_``) and key (``k_``) has."""
        own = [c for c in of_key.columns if c != "key"]
        host = of_key.select(F.col("key").alias("host"), *[F.col(c).alias(f"h_{c}") for c in own])
        path = of_key.select("key", *[F.col(c).alias(f"k_{c}") for c in own])
        return met(met(self.pairs, host, "host", self.hosts), path, "key", self.paths)

    def first(self) -> DataFrame:
        """``host, key, n, bad``: thousandths by the seeds alone."""
        bad = F.log(F.lit(SHARE / (1 - SHARE))) + F.when(F.col("h_seeded") | F.col("k_seeded"), math.log(SEED_ODDS)).otherwise(0.0)
        return self._of_pairs(self.keys).select("host", "key", "n", odds_of(bad).alias("bad"))

    def learned(self, judged: DataFrame) -> tuple[DataFrame, float]:
        """``word, odds`` in millionths from urls with ``bad``, add-one smoothed, and the log odds before any word."""
        judged = C.stored(judged, "judged")
        mass = lambda c: judged.groupBy(F.col(c).alias("key")).agg(F.sum(F.col("n") * F.col("bad")).alias("bad"), F.sum(F.col("n") * (1000 - F.col("bad"))).alias("good"))
        sums = mass("host").unionByName(mass("key")).groupBy("key").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
        counts = C.stored(self.words.join(sums, "key").groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")), "counts")
        total = counts.agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"), F.count("*").alias("words")).first()
        urls = judged.agg(F.sum(F.col("n") * F.col("bad")).alias("bad"), F.sum(F.col("n") * (1000 - F.col("bad"))).alias("good")).first()
        side = lambda c: F.log((F.col(c) / 1000 + 1) / ((total[c] or 0) / 1000 + max(total["words"], 1)))
        odds = counts.select("word", F.rint((side("bad") - side("good")) * MICRO).cast("long").alias("odds"))
        return C.stored(odds, "odds"), math.log(((urls["bad"] or 0) / 1000 + 1) / ((urls["good"] or 0) / 1000 + 1))

    def scored(self, odds: DataFrame) -> DataFrame:
        """``key, odds, seed``: the sum over each key's words, and the strongest of its seeds."""
        found = met(self.words, odds, "word", self.often).groupBy("key").agg(F.sum("odds").alias("odds"), F.max(F.when(F.col("seed"), F.col("odds"))).alias("seed"))
        return C.stored(self.keys.select("key").join(found, "key", "left").select("key", F.coalesce("odds", F.lit(0)).alias("odds"), F.greatest(F.coalesce("seed", F.lit(0)), F.lit(0)).alias("seed")), "scored")

    @staticmethod
    def score(base: float) -> Column:
        """The log odds of a url with what its host and key have; its strongest seed is left out."""
        return F.lit(base) + (F.col("h_odds") + F.col("k_odds") - F.greatest("h_seed", "k_seed")) / MICRO

    def judged(self, odds: DataFrame, base: float) -> DataFrame:
        return self._of_pairs(self.scored(odds)).select("host", "key", "n", odds_of(self.score(base)).alias("bad"))


def judge(pages: DataFrame, rules: list[tuple[str, str]], seeds: tuple[str, ...] = SEEDS, page_id: str = "page_id", url: str = "url", html: str = "html", rounds: int = ROUNDS) -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` of every row; score is the log odds of bad."""
    rows = pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    rows = rows.select("page_id", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"))
    # what of a path can be a word, numbers alike, so that keys are few
    rows = rows.withColumn("key", F.regexp_replace(F.regexp_replace("path", "[0-9]+", "0"), r"[^\p{L}0-9]+", " "))
    pairs = C.stored(rows.groupBy("host", "key").agg(F.count("*").alias("n")), "pairs")
    keys = pairs.select(F.col("host").alias("key")).unionByName(pairs.select("key")).distinct()
    known = C.stored(tokens(keys, C.stored(word_counts(pages, html), "words"), seeds), "tokens")
    model = Bayes(pairs, known, seeds)
    odds, base = model.learned(model.first())
    for _ in range(rounds - 1):
        odds, base = model.learned(model.judged(odds, base))
    scored = model.scored(odds)
    of = lambda name, tag: scored.select(F.col("key").alias(name), F.col("odds").alias(f"{tag}_odds"), F.col("seed").alias(f"{tag}_seed"))
    large = [heavy(pairs, c, F.col("n")) for c in ("host", "key")]
    judged = met(met(rows, of("host", "h"), "host", large[0]), of("key", "k"), "key", large[1])
    chosen = judged.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules)).withColumn("score", F.round(Bayes.score(base), 6))
    own = F.when(F.col("score") > 0, "block").otherwise("allow")
    return chosen.select("page_id", "host", "path", F.col("fit")["rule"].alias("rule"), F.coalesce(F.col("fit")["verdict"], own).alias("verdict"), "score")


RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url."""
    return judge(C.table(spark, sf_dir, "pages"), RULES)


QUERIES = {"op4_url_filter": op4_url_filter}
ORACLES: dict[str, str] = {}
