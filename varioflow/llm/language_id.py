"""Language identification by word-first backoff.

Training counts, per language, the words and the character n-grams of a bounded
sample of labelled documents.  A word of a text that the model knows adds its
log frequency in each language; an unseen word falls back to its character
4-grams, and where none of them is known to 3-grams, 2-grams and single
characters.  The language with the highest sum wins.

Defined results: null, empty and letterless texts give ``und`` with score 0;
without any training row every text is ``und``; repeated rows are scored
alike; the order of rows never matters; columns besides those named are
ignored, so clashing names do no harm.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

UNDETERMINED = "und"
ORDERS = (4, 3, 2, 1)
#: Marks the start and end of a word in its n-grams.
EDGE = 0x2E


@dataclass
class LanguageModel:
    """Log frequencies by hash: of whole words (order 0) and of n-grams.

    All that the sampled documents hold is kept, so ``docs_per_lang`` of ``fit`` bounds its size.
    """

    langs: list[str]
    tables: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)


def clean_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct lower-cased letter strings, the place of each word among them, row offsets."""
    flat, offsets = C.words(texts)
    coded = pc.dictionary_encode(flat)
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    letters = pc.replace_substring_regex(pc.utf8_lower(coded.dictionary), r"[^\pL]+", "")
    again = pc.dictionary_encode(letters)
    place = again.indices.to_numpy(zero_copy_only=False)
    return again.dictionary, place[coded.indices.to_numpy(zero_copy_only=False)], offsets


WORD = 0


def gram_hashes(names: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all character ``order``-grams of the words, and each word's offsets into them.

    A word of k letters, with an edge mark at both ends, has k + 3 - order of
    them for orders above 1; single characters leave the marks out; order 0 is
    the word itself.
    """
    if order == WORD:
        return C.word_hashes(names), np.arange(len(names) + 1)
    text = chr(EDGE) + (chr(EDGE) * 2).join(names.to_pylist()) + chr(EDGE) if len(names) else ""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    lengths = pc.utf8_length(names).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.concatenate(([0], np.cumsum(lengths + 2)))[:-1]
    if order == 1:
        first, count = starts + 1, lengths
    else:
        first, count = starts, np.maximum(lengths + 3 - order, 0)
    offsets = np.concatenate(([0], np.cumsum(count)))
    at = np.repeat(first - offsets[:-1], count) + np.arange(offsets[-1])
    h = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(order):
            h = h * np.uint64(C.BASE) + points[at + k]
    return C.mixed(h + np.uint64(order)), offsets


def _counted(batches, langs):
    """Partial counts of a task: (place of the language, order, hash, count)."""
    at = {k: i for i, k in enumerate(langs)}
    for batch in C.chunks(batches, "text"):
        lang = np.array([at[k] for k in batch.column("lang").to_pylist()])
        names, place, offsets = clean_words(batch.column("text"))
        some = pc.binary_length(names).to_numpy(zero_copy_only=False) > 0
        row = np.repeat(lang, np.diff(offsets))
        for k in np.unique(lang).tolist():
            n = np.bincount(place[row == k], minlength=len(names))
            own = np.flatnonzero((n > 0) & some)
            chosen, weight = names.take(pa.array(own)), n[own]
            for order in (WORD, *ORDERS):
                h, offset = gram_hashes(chosen, order)
                each, back = np.unique(h, return_inverse=True)
                total = np.bincount(back, np.repeat(weight, np.diff(offset)), len(each)).astype(np.int64)
                columns = [np.full(len(each), k, np.int32), np.full(len(each), order, np.int32), each.view(np.int64), total]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["lang", "ord", "code", "n"])


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", docs_per_lang: int = 1500) -> LanguageModel:
    """Count words and n-grams of about ``docs_per_lang`` documents of each language.

    The sample is the rows whose hash falls below the share that gives each
    language ``docs_per_lang`` documents, so it needs no join and is the same on
    every run.  Every word and n-gram of the sample is in the model.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
    per = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(per)
    if not langs:
        return LanguageModel([])
    share = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(min(1.0, docs_per_lang / per[k])))])
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    counted = (
        rows.where(draw < share[F.col("lang")])
        .select("text", "lang")
        .mapInArrow(lambda it: _counted(it, langs), "lang int, ord int, code long, n long")
        .groupBy("lang", "ord", "code")
        .agg(F.sum("n").alias("n"))
    )
    model = _model(langs, counted.toArrow())
    C.release()
    return model


def _model(langs: list[str], counted: pa.Table) -> LanguageModel:
    """The model of the counts ``lang, ord, code, n``."""
    model = LanguageModel(langs)
    lang, order, code, count = (counted.column(c).to_numpy() for c in ("lang", "ord", "code", "n"))
    for k in (WORD, *ORDERS):
        own = np.flatnonzero(order == k)
        if len(own):
            codes, row = np.unique(code[own], return_inverse=True)
            n = np.zeros((len(codes), len(langs)))
            n[row, lang[own]] = count[own]
            model.tables[k] = codes, np.log((n + 0.5) / (n.sum(axis=0) + 0.5 * len(codes) + 1)).astype(np.float32)
    return model


def word_scores(model: LanguageModel, names: pa.Array) -> np.ndarray:
    """Each word's log frequency per language: known words first, then ever shorter n-grams."""
    out = np.zeros((len(names), len(model.langs)), np.float32)
    left = np.flatnonzero(pc.binary_length(names).to_numpy(zero_copy_only=False) > 0)
    for order in (WORD, *ORDERS):
        if not len(left):
            break
        if order not in model.tables:
            continue
        codes, logs = model.tables[order]
        h, offsets = gram_hashes(names.take(pa.array(left)), order)
        signed = h.view(np.int64)
        place = np.minimum(np.searchsorted(codes, signed), len(codes) - 1)
        known = codes[place] == signed
        word = np.repeat(np.arange(len(left)), np.diff(offsets))[known]
        n = np.bincount(word, minlength=len(left))
        for k in range(len(model.langs)):
            sums = np.bincount(word, logs[place[known], k], len(left))
            out[left, k] = np.where(n > 0, sums / np.maximum(n, 1), 0)
        left = left[n == 0]
    return out


def predict_texts(model: LanguageModel, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Place of the best language (-1: undetermined) and its posterior."""
    names, place, offsets = clean_words(texts)
    rows = len(texts)
    if not model.langs or not len(names):
        return np.full(rows, -1), np.zeros(rows)
    scores = word_scores(model, names)
    lettered = (pc.binary_length(names).to_numpy(zero_copy_only=False) > 0)[place].astype(np.float64)
    row = np.repeat(np.arange(rows), np.diff(offsets))
    total = np.stack([np.bincount(row, scores[place, k], rows) for k in range(len(model.langs))], axis=1)
    some = np.bincount(row, lettered, rows) > 0
    best = total.argmax(axis=1)
    relative = np.exp(np.maximum(total - total.max(axis=1, keepdims=True), -700))
    score = 1 / relative.sum(axis=1)
    return np.where(some, best, -1), np.where(some, score, 0.0)


def predict(docs: DataFrame, model: LanguageModel, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns of every row, with ``lang_pred`` and ``score``; one pass, no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*[F.col(c) for c in keep], F.col(text).alias("__text"))
    schema = T.StructType([f for f in rows.schema.fields if f.name != "__text"] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def score(batches):
        own = sent.value
        names = np.array([*own.langs, UNDETERMINED], dtype=object)
        for batch in C.chunks(batches, "__text"):
            best, p = predict_texts(own, batch.column("__text"))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(names[best], pa.string()), pa.array(p)], names=[*keep, "lang_pred", "score"])

    return rows.mapInArrow(score, schema)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; learned from the rows outside the held-out fold."""
    docs = C.table(spark, sf_dir, "documents")
    model = fit(docs.where(C.crc_mod("doc_id", 4) != 2))
    return predict(docs, model).withColumn("held_out", F.coalesce(C.crc_mod("doc_id", 4) == 2, F.lit(False))).select("doc_id", "held_out", "lang_pred", "score")


QUERIES = {"op7_language_id": op7_language_id}
ORACLES: dict[str, str] = {}
