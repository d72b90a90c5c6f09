import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from varioflow.llm import quality_classifier as Q

from .helpers import ODD, docs, words

SF = "/root/testdata/sf0.01"


def test_prior_and_non_negative_risk():
    rng = np.random.RandomState(0)
    good = lambda n: rng.normal(1.5, 1, (n, 3))
    bad = lambda n: rng.normal(-2.5, 1, (n, 3))
    net = Q.fit(good(2000), np.concatenate((good(1400), bad(600)))[rng.permutation(2000)])
    assert abs(net.prior - 0.7) < 0.1
    assert (Q.sigmoid(net.logits(good(500))) >= 0.3).mean() > 0.95 and (Q.sigmoid(net.logits(bad(500))) < 0.3).mean() > 0.95


def test_held_out_accuracy(spark):
    out = Q.op6_quality_classifier(spark, SF)
    held = out.where("held_out").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id")
    got = held.groupBy("quality").agg(F.avg((F.col("predicted") == F.col("quality")).cast("double")).alias("a"), F.count("*").alias("n")).collect()
    assert out.count() == 1000 and all(r.a > 0.85 for r in got), got


def test_odd_rows(spark):
    labels = spark.createDataFrame([(3, 1), (3, 0), (6, 1), (None, 1), (9, None)], "doc_id long, quality int")
    for table in (docs(spark, ODD), docs(spark, [])):
        got = Q.classify(table, labels, F.lit(True)).collect()
        assert len(got) == table.count() and all(0 <= r.score <= 1 for r in got)


def plain_score(text, net):
    """Features and forward pass of one text with plain Python."""
    ws = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    windows = Counter(zip(ws, ws[1:], ws[2:]))
    covered = {q for p in range(len(ws) - 2) if windows[tuple(ws[p : p + 3])] > 1 for q in range(p, p + 3)}
    chars = "".join(ws)
    n, c, m = max(len(ws), 1), max(len(chars), 1), max(len(lines), 1)
    count = lambda f: sum(map(f, chars))
    x = [
        math.log1p(len(ws)), len(chars) / n, math.sqrt(count(lambda z: z in "#*$%&|<>") / c), math.sqrt(count(lambda z: z in "!?") / c), math.sqrt(count(str.isupper) / c), math.sqrt(count(lambda z: z in "0123456789") / c),
        (len(lines) - len(set(lines))) / m, len(covered) / n, len(set(ws)) / n, max(Counter(ws).values(), default=0) / n, math.log1p(len(ws) / m),
    ]
    w1, b1, w2, b2 = net.parts
    hidden = [math.tanh(sum(min(8, max(-8, (v - net.mean[i]) / net.scale[i])) * w1[i][j] for i, v in enumerate(x)) + b1[j]) for j in range(len(b1))]
    return 1 / (1 + math.exp(-(sum(h * w for h, w in zip(hidden, w2)) + b2[0])))


def test_scores_of_a_fixed_network(spark, monkeypatch):
    rng = np.random.RandomState(4)
    net = Q.Network(rng.normal(0, 1, 11), rng.uniform(0.5, 2, 11), [rng.normal(0, 1, (11, 4)), rng.normal(0, 1, 4), rng.normal(0, 1, 4), rng.normal(0, 1, 1)])
    monkeypatch.setattr(Q, "fit", lambda p, u: net)
    rows = [*ODD[:2], (20, "A line! Of 12 words?\nA line! Of 12 words?\n<b> & $5 the the the", "en"), (21, "Été À la carte " * 30, "fr"), (22, "x", "en")]
    got = {r.doc_id: r.score for r in Q.classify(docs(spark, rows), spark.createDataFrame([(20, 1)], "doc_id long, quality int"), F.lit(True)).collect()}
    assert all(abs(got[i] - plain_score(t, net)) < 1e-9 for i, t, _ in rows)


def test_sample_is_bounded_and_the_same_on_every_run(spark):
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), *[(F.col("id") % (k + 2)).alias(c) for k, c in enumerate(Q.COUNTS)])
    one, two = Q.sampled(rows, 500), Q.sampled(rows.repartition(17), 500)
    assert len(one) == 500 and one["doc_id"].tolist() == two["doc_id"].tolist()
    exact = rows.orderBy(F.xxhash64("doc_id", *Q.COUNTS), "doc_id").limit(500).toPandas()
    assert one["doc_id"].tolist() == exact["doc_id"].tolist()
    assert len(Q.sampled(rows.limit(30), 500)) == 30 and len(Q.sampled(rows.limit(0), 500)) == 0
