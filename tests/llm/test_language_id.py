import math
import random
import re
from collections import Counter, defaultdict

from varioflow.llm import language_id as L

from .helpers import ODD, docs, words

EN = "the cat and the dog went over the hill with an old friend"
DE = "der hund und die katze gingen mit einem alten freund über den hügel"


def test_words_then_shorter_grams(spark):
    rows = [(i, t, k) for i, (t, k) in enumerate([(EN, "en"), (DE, "de")] * 20)]
    model = L.fit(docs(spark, rows))
    asked = [(100, "the hill", None), (101, "DER HUGEL!!", None), (102, "freundlich hügelig", None), (103, "ü", None), *ODD]
    got = {r.doc_id: r for r in L.predict(docs(spark, asked), model).collect()}
    assert [got[k].lang_pred for k in (100, 101, 102, 103)] == ["en", "de", "de", "de"]
    assert all(got[k].lang_pred == "und" and got[k].score == 0 for k in (0, 1, 2, 5))
    assert all(0 <= r.score <= 1 for r in got.values())


def test_whole_table_and_nothing_to_learn(spark):
    model = L.fit(docs(spark, [(1, "x", None)]))
    got = L.predict(docs(spark, ODD), model).collect()
    assert len(got) == len(ODD) and {r.lang_pred for r in got} == {"und"}
    assert L.predict(docs(spark, []), model).collect() == []


def test_held_out_accuracy(spark):
    rows = L.op7_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = rows.where("held_out and lang is not null").selectExpr("avg(cast(lang = lang_pred as double)) a", "count(*) n").first()
    assert held.n > 200 and held.a > 0.97


def brute(train, asked):
    """Word-first backoff with plain counters."""
    langs = sorted({k for _, _, k in train})
    clean = lambda w: re.sub(r"[\W\d_]+", "", w.lower())
    grams = lambda w, o: [w] if o == 0 else list(w) if o == 1 else [("." + w + ".")[k : k + o] for k in range(len(w) + 3 - o)]
    counts = {o: defaultdict(Counter) for o in (0, *L.ORDERS)}
    for _, text, lang in train:
        for w in filter(None, map(clean, words(text))):
            for o in counts:
                for g in grams(w, o):
                    counts[o][g][lang] += 1
    total = {o: {k: sum(c[k] for c in t.values()) for k in langs} for o, t in counts.items()}
    out = {}
    for i, text, _ in asked:
        sums, some = dict.fromkeys(langs, 0.0), False
        for w in filter(None, map(clean, words(text))):
            some = True
            for o in (0, *L.ORDERS):
                known = [g for g in grams(w, o) if g in counts[o]]
                if known:
                    for k in langs:
                        sums[k] += sum(math.log((counts[o][g][k] + 0.5) / (total[o][k] + 0.5 * len(counts[o]) + 1)) for g in known) / len(known)
                    break
        best = max(langs, key=lambda k: (sums[k], [-ord(c) for c in k]))
        out[i] = (best, 1 / sum(math.exp(x - sums[best]) for x in sums.values())) if some else ("und", 0.0)
    return out


def test_against_plain_counters(spark):
    rng = random.Random(2)
    syllables = {"en": ["the", "ing", "on", "er"], "de": ["sch", "ung", "er", "ich"], "fr": ["eau", "tion", "le", "er"]}
    text = lambda k, n: " ".join("".join(rng.choice(syllables[k]) for _ in range(rng.randrange(1, 4))) + rng.choice(["", ",", "1"]) for _ in range(n))
    train = [(i, text(k, 30), k) for i, k in enumerate(["en", "de", "fr"] * 15)]
    asked = [(100 + i, text(k, rng.randrange(1, 6)), k) for i, k in enumerate(["en", "de", "fr"] * 20)] + [(200, "éé çà", "fr"), (201, "4 5", None)]
    got = {r.doc_id: r for r in L.predict(docs(spark, asked), L.fit(docs(spark, train))).collect()}
    for i, (lang, score) in brute(train, asked).items():
        assert got[i].lang_pred == lang and abs(got[i].score - score) < 1e-3


def test_no_word_of_the_sample_is_dropped(spark):
    """A language with few documents keeps its rare words beside one with very many."""
    rows = [(i, " ".join(f"{chr(97 + i % 26)}{chr(97 + j % 26)}{chr(97 + j // 26)}x" for j in range(400)), "aa") for i in range(60)] + [(999, "раз два три", "ru")]
    model = L.fit(docs(spark, rows))
    got = L.predict(docs(spark, [(1, "три", None)]), model).first()
    assert got.lang_pred == "ru" and len(model.tables[L.WORD][0]) == 26 * 400 + 3
