"""Quality classifier by positive-unlabelled learning.

Features are ratios of a text's exact counts.  Training sees trusted positives
(label 1) and unlabelled texts, never a negative label.  The share of positives
among the unlabelled is estimated first (best bin: the least ratio of unlabelled
to positive texts above a score, the scores coming from a model that tells the
two apart); then a small network minimises the non-negative unbiased risk

    pi * R_p(+1) + max(0, R_u(-1) - pi * R_p(-1))

with logistic loss, so its output estimates the probability of label 1.

Defined results: null and empty texts are scored like a text of 0 words;
without positives or unlabelled rows every score is 0.5; repeated rows are
scored alike; of several labels of one document the least counts; other columns
are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .quality_rules import base_counts
from .text_stats import COUNTS

#: Bound of the rows that training collects, of either kind.
TRAIN_ROWS = 20_000
FEATURES = ("log_words", "word_length", "symbols", "marks", "upper", "digits", "dup_lines", "repeats", "distinct", "top", "line_words")


def features(c: dict[str, np.ndarray]) -> np.ndarray:
    """One row of ``FEATURES`` per text."""
    per = lambda a, b: c[a] / np.maximum(c[b], 1)
    return np.stack(
        [
            np.log1p(c["n_words"]),
            per("word_chars", "n_words"),
            np.sqrt(per("n_symbols", "word_chars")),
            np.sqrt(per("n_marks", "word_chars")),
            np.sqrt(per("n_upper", "word_chars")),
            np.sqrt(per("n_digits", "word_chars")),
            per("n_dup_lines", "n_lines"),
            per("n_repeat_words", "n_words"),
            per("n_distinct", "n_words"),
            per("n_top", "n_words"),
            np.log1p(per("n_words", "n_lines")),
        ],
        axis=1,
    ).astype(np.float64)


@dataclass
class Network:
    """Standardised inputs, one hidden tanh layer."""

    mean: np.ndarray
    scale: np.ndarray
    parts: list[np.ndarray]
    prior: float = 0.5

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.parts
        return np.tanh(np.clip((x - self.mean) / self.scale, -8, 8) @ w1 + b1) @ w2 + b2[0]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _trained(p: np.ndarray, u: np.ndarray, prior: float | None, steps: int, hidden: int = 16, rate: float = 0.02, decay: float = 1e-4) -> Network:
    """Adam on all rows.  Without a prior: plain logistic regression of p against u."""
    every = np.concatenate((p, u))
    net = Network(every.mean(axis=0), every.std(axis=0) + 1e-6, [])
    rng = np.random.RandomState(7)
    d = every.shape[1]
    net.parts = [rng.normal(0, d**-0.5, (d, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]
    x = np.clip((every - net.mean) / net.scale, -8, 8)
    k = len(p)
    m, v = [np.zeros_like(w) for w in net.parts], [np.zeros_like(w) for w in net.parts]
    for step in range(1, steps + 1):
        w1, b1, w2, b2 = net.parts
        a = np.tanh(x @ w1 + b1)
        s = sigmoid(a @ w2 + b2[0])
        g = np.zeros(len(x))  # derivative of the risk by each row's logit
        if prior is None:
            g[:k], g[k:] = (s[:k] - 1) / k, s[k:] / len(u)
        else:
            negative = np.mean(softplus(a[k:] @ w2 + b2[0])) - prior * np.mean(softplus(a[:k] @ w2 + b2[0]))
            g[:k] = prior * (s[:k] - 1) / k
            if negative >= 0:
                g[:k] -= prior * s[:k] / k
                g[k:] = s[k:] / len(u)
            else:  # the negative part went below zero: step back from it alone
                g[:k] = prior * s[:k] / k
                g[k:] = -s[k:] / len(u)
        h = np.outer(g, w2) * (1 - a * a)
        grads = [x.T @ h + decay * w1, h.sum(axis=0), a.T @ g + decay * w2, np.array([g.sum()])]
        for j, grad in enumerate(grads):
            m[j] = 0.9 * m[j] + 0.1 * grad
            v[j] = 0.999 * v[j] + 0.001 * grad * grad
            net.parts[j] = net.parts[j] - rate * (m[j] / (1 - 0.9**step)) / (np.sqrt(v[j] / (1 - 0.999**step)) + 1e-8)
    return net


def softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def estimated_prior(sp: np.ndarray, su: np.ndarray, least: float = 0.1, delta: float = 0.1) -> float:
    """Best bin estimate of the share of positives in the unlabelled, from scores of either kind."""
    cuts = np.quantile(sp, np.linspace(0, 1 - least, 200))
    qp = np.array([(sp >= c).mean() for c in cuts])
    qu = np.array([(su >= c).mean() for c in cuts])
    slack = np.sqrt(np.log(4 / delta) / 2 / len(su)) + np.sqrt(np.log(4 / delta) / 2 / len(sp))
    at = int(np.argmin((qu + slack) / qp))
    return float(np.clip(qu[at] / qp[at], 0.01, 0.99))


def fit(positive: np.ndarray, unlabelled: np.ndarray, steps: int = 400) -> Network | None:
    """The network; None where either side is empty.  The prior is fitted on one half, estimated on the other."""
    if not len(positive) or not len(unlabelled):
        return None
    p, u = (positive, unlabelled) if min(len(positive), len(unlabelled)) > 1 else (np.repeat(positive, 2, 0), np.repeat(unlabelled, 2, 0))
    first = _trained(p[::2], u[::2], None, steps // 2)
    prior = estimated_prior(first.logits(p[1::2]), first.logits(u[1::2]))
    net = _trained(p, u, prior, steps)
    net.prior = prior
    return net


def sampled(rows: DataFrame, most: int, spare: float = 1.2):
    """At most ``most`` rows of least hash, collected.

    The share of hashes that holds about ``spare`` times as many is taken first, so
    what the tasks send on is bounded too, whatever their number.
    """
    share = min(1.0, spare * most / max(rows.count(), 1))
    drawn = rows.withColumn("__h", F.xxhash64("doc_id", *COUNTS)).where(F.col("__h") <= int(-(2**63) + share * (2**64 - 1)) if share < 1 else F.lit(True))
    return drawn.orderBy("__h", "doc_id").limit(most).drop("__h").toPandas()


def classify(docs: DataFrame, labels: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text", label_id: str = "doc_id", label: str = "quality", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``doc_id, score`` of every row; rows where ``learn`` (a condition on doc_id) is false teach nothing."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    counted = C.stored(base_counts(rows, ["doc_id"]), "features")
    marks = labels.select(F.col(label_id).alias("doc_id"), F.col(label).alias("label")).where("label is not null").groupBy("doc_id").agg(F.min("label").alias("label"))
    known = counted.where(learn & F.col("doc_id").isNotNull()).join(marks, "doc_id", "left")
    p, u = sampled(known.where("label = 1"), train_rows), sampled(known.where("label is null"), train_rows)
    matrix = lambda pdf: features({c: pdf[c].to_numpy() for c in COUNTS})
    sent = rows.sparkSession.sparkContext.broadcast(fit(matrix(p), matrix(u)))

    def score(batches):
        net = sent.value
        for batch in batches:
            x = features({c: batch.column(c).to_numpy() for c in COUNTS})
            s = sigmoid(net.logits(x)) if net else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s)], names=["doc_id", "score"])

    return counted.mapInArrow(score, f"doc_id {dict(rows.dtypes)['doc_id']}, score double")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    out = classify(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels"), C.crc_mod("doc_id", 5) != 0)
    return out.select("doc_id", F.coalesce(C.crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


QUERIES = {"op6_quality_classifier": op6_quality_classifier}
ORACLES: dict[str, str] = {}
