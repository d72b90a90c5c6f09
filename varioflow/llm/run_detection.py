"""Periodic runs of words, by online dyadic square catching.

Reading a text word by word, level ``w = 1, 2, 4, ...`` keeps a catcher on each
completed block of ``w`` words that starts at a multiple of ``w``.  A word that
is appended completes, on each level, one suffix of ``w`` words; the only
catcher that may answer for a period from ``w`` to ``2 w - 1`` is that of the
block before the suffix's own, so each word advances one suffix comparison a
level, a rolling hash against the block's.  No comparison looks beyond the word
it is made for; so those of all words of a level are made in one numpy step.

Equal block and suffix are a square, or part of one, of period suffix start less
block start.  Squares of one period from neighbouring blocks merge, and exact
comparison of the words extends them to a maximal run.  A block that is itself
periodic meets many suffixes.  Those inside a run already known, at a multiple
of its period, are old; of three or more others, which then stand apart by the
block's period, only the one that lets the ends of the block's and the suffix's
repetition fall together can belong to a run of four periods or more.  So a
level takes time in proportion to its words, whatever they are.

Texts are taken apart one by one: no row meets another, and nothing is shuffled.

Defined results: null and empty texts have no words and no runs, and their
collapsed text is empty; repeated rows have equal results, one each; rows with a
null id are kept; other columns are ignored; a run at the text's edge counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Below four periods the choice among a periodic block's suffixes would lose runs.
LEAST_EXPONENT = 4
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


class _Known:
    """Runs found so far, as global word places."""

    def __init__(self):
        self.start = self.end = self.period = np.zeros(0, np.int64)
        self.places: set[tuple[int, int]] = set()

    def add(self, found: list[tuple[int, int, int]]):
        # a smaller period of the same stretch was found on a lower level, or stands before it here
        new = []
        for s, e, q in sorted(found, key=lambda r: r[2]):
            if (s, e) not in self.places:
                self.places.add((s, e))
                new.append((s, e, q))
        if new:
            s, e, q = np.array(new, np.int64).T
            s, e, q = np.append(self.start, s), np.append(self.end, e), np.append(self.period, q)
            order = np.lexsort((q, s))
            self.start, self.end, self.period = s[order], e[order], q[order]

    def explains(self, block: np.ndarray, lag: np.ndarray, w: int) -> np.ndarray:
        """Whether block to suffix lies in a run whose period divides the lag.

        Two runs of period w / 2 or less share less than 2 w words, so at most one holds a block and its suffix.
        """
        fit = (2 * self.period <= w) & (self.end - self.start >= 2 * w)
        s, e, p = self.start[fit], self.end[fit], self.period[fit]
        if not len(s):
            return np.zeros(len(block), bool)
        at = np.searchsorted(s, block, side="right") - 1
        return (at >= 0) & (e[at] >= block + lag + w) & (lag % p[at] == 0)


def _break(code: np.ndarray, at: int, stop: int, p: int) -> int:
    """The first place from ``at`` to ``stop`` whose word is not the one ``p`` before; ``stop`` if there is none."""
    odd = np.flatnonzero(code[at:stop] != code[at - p : stop - p])
    return at + int(odd[0]) if len(odd) else stop


def _aligned(code: np.ndarray, block: int, lags: np.ndarray, w: int, stop: int) -> int | None:
    """The lag, of three or more at one distance, that brings the ends of both repetitions together."""
    p = int(lags[1] - lags[0])
    own = _break(code, block + w, min(stop, block + int(lags[-1]) + 3 * w), p)
    far = _break(code, block + int(lags[-1]) + w, limit := min(stop, own + 2 * w), p) if own + 2 * w > block + int(lags[-1]) + w else stop
    q = far - own
    return q if far < min(limit, stop) and len(np.flatnonzero(lags == q)) else None


def _grown(code: np.ndarray, first: int, last: int, q: int, start: int, stop: int) -> list[tuple[int, int]]:
    """Maximal stretches around ``first`` to ``last`` whose words equal those ``q`` later."""
    step = 64
    while first > start:
        low = max(start, first - step)
        odd = np.flatnonzero(code[low:first] != code[low + q : first + q])
        first = low if not len(odd) else low + int(odd[-1]) + 1
        if len(odd):
            break
        step *= 2
    step = 64
    while last + q < stop:
        high = min(stop - q, last + step)
        odd = np.flatnonzero(code[last:high] != code[last + q : high + q])
        last = high if not len(odd) else last + int(odd[0])
        if len(odd):
            break
        step *= 2
    odd = np.flatnonzero(code[first:last] != code[first + q : last + q])  # none, unless hashes collided
    cuts = [first - 1, *(first + odd).tolist(), last]
    return [(a + 1, b) for a, b in zip(cuts, cuts[1:]) if b > a + 1]


def _candidates(code, block, lag, w, stop_of) -> tuple[np.ndarray, np.ndarray]:
    """Of each block's lags, those that may belong to a run."""
    order = np.lexsort((lag, block))
    block, lag = block[order], lag[order]
    first = C.group_starts(block)
    size = np.diff(np.append(first, len(block)))
    few = np.repeat(size <= 2, size)
    blocks, lags = [block[few]], [lag[few]]
    for a, n in zip(first[size > 2].tolist(), size[size > 2].tolist()):
        q = _aligned(code, b := int(block[a]), lag[a : a + n], w, stop_of(b))
        if q is not None:
            blocks.append(np.array([b]))
            lags.append(np.array([q]))
    return np.concatenate(blocks), np.concatenate(lags)


def runs(code: np.ndarray, bounds: np.ndarray, min_exponent: int = LEAST_EXPONENT, min_length: int = 6) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and periods of all runs of the texts ``code[bounds[i]:bounds[i + 1]]``, as global word places."""
    if min_exponent < LEAST_EXPONENT:
        raise ValueError(f"runs of fewer than {LEAST_EXPONENT} periods are not caught")
    known = _Known()
    text_of = lambda b: int(np.searchsorted(bounds, b, side="right")) - 1
    size = np.diff(bounds)
    h, w = C.mixed(code.astype(np.uint64) + np.uint64(1)), 1
    while len(long := np.flatnonzero(size >= min_exponent * w)):
        n = size[long] - 2 * w + 1  # suffixes of w words that start w or more into the text
        own = np.repeat(np.arange(len(long)), n)
        rel = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n) + w
        at = bounds[long][own] + rel
        block = at - rel + (rel // w - 1) * w
        hit = np.flatnonzero(h[at] == h[block])
        block, lag = block[hit], at[hit] - block[hit]
        fresh = ~known.explains(block, lag, w)
        block, lag = _candidates(code, block[fresh], lag[fresh], w, lambda b: int(bounds[text_of(b) + 1]))
        order = np.lexsort((block, lag))
        block, lag = block[order], lag[order]
        first = np.flatnonzero(np.concatenate(([True], (block[1:] != block[:-1] + w) | (lag[1:] != lag[:-1])))) if len(block) else np.zeros(0, np.int64)
        last = np.append(first[1:], len(block)) - 1 if len(first) else first
        a, z, q = block[first], block[last] + w, lag[first]
        if w <= 2:  # a block has two lags at most, all are here: what grows by less than a block on either side
            enough = z - a + 2 * (w - 1) + q >= np.maximum(min_length, min_exponent * q)
            a, z, q = a[enough], z[enough], q[enough]
        found = []
        for x, y, p in zip(a.tolist(), z.tolist(), q.tolist()):
            t = text_of(x)
            found += [(s, e + p, p) for s, e in _grown(code, x, y, p, int(bounds[t]), int(bounds[t + 1])) if e + p - s >= max(min_length, min_exponent * p)]
        known.add(found)
        with np.errstate(over="ignore"):
            h = C.mixed(h[:-w] * np.uint64(C.BASE) + h[w:]) if len(h) > w else h[:0]
        w *= 2
    return known.start, known.end, known.period


def _scanned(min_exponent: int, min_length: int):
    def run(batches):
        for batch in C.chunks(batches, "text"):
            flat, bounds = C.words(batch.column("text"))
            names, code = C.distinct(flat)
            code = code.astype(np.int64)
            s, e, q = runs(code, bounds, min_exponent, min_length)
            gone = np.zeros(len(code) + 1, np.int64)
            np.add.at(gone, s + q, 1)
            np.add.at(gone, e, -1)
            kept = np.cumsum(gone)[:-1] == 0
            text = np.searchsorted(bounds, s, side="right") - 1
            cut = np.searchsorted(text, np.arange(batch.num_rows + 1))
            each = pa.StructArray.from_arrays([pa.array(s - bounds[text]), pa.array(e - s), pa.array(q)], names=["start", "length", "period"])
            some = np.concatenate(([0], np.cumsum(kept)))[bounds]
            left = pa.ListArray.from_arrays(pa.array(some, pa.int32()), flat.filter(pa.array(kept, pa.bool_())))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(bounds)), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), each), pa.compute.binary_join(left, " ")],
                names=["doc_id", "n_words", "runs", "collapsed"],
            )

    return run


def detect(docs: DataFrame, min_exponent: int = LEAST_EXPONENT, min_length: int = 6, doc_id: str = "doc_id", text: str | Column = "text") -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` of every row.

    ``runs`` lists start (word number), length and smallest period of every maximal
    stretch of ``max(min_length, min_exponent * period)`` words or more, by start and
    period; ``collapsed`` is the text without the words that repeat a run's first
    period, words joined by one space.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), (F.col(text) if isinstance(text, str) else text).cast("string").alias("text"))
    return rows.mapInArrow(_scanned(min_exponent, min_length), f"doc_id {dict(rows.dtypes)['doc_id']}, n_words bigint, runs {RUNS}, collapsed string")


def run_rows(detected: DataFrame) -> DataFrame:
    """One row ``doc_id, start, length, period`` per run."""
    return detected.select("doc_id", F.inline("runs"))


def repeated_tail(doc_id: str, text: str) -> Column:
    """The text of a tenth of the documents repeats some of its own words from a place on to its end.

    That place, the number of words and the documents follow from crc32 of the id;
    other texts stay as they are.
    """
    h = F.crc32(F.col(doc_id).cast("string"))
    g = F.floor(h / 10).cast("int")
    w = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n = F.size(w)
    a = g % n
    p = F.lit(1) + F.floor((n - a) / (3 + g % 8)).cast("int")
    cycle = F.flatten(F.array_repeat(F.slice(w, a + 1, p), F.ceil((n - a) / p).cast("int")))
    made = F.array_join(F.concat(F.slice(w, F.lit(1), a), F.slice(cycle, F.lit(1), n - a)), " ")
    return F.when((h % 10 == 0) & (n > 0), made).otherwise(F.col(text))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of every document, as a digest."""
    docs = C.table(spark, sf_dir, "documents")
    found = detect(docs.select("doc_id", repeated_tail("doc_id", "text").alias("text")))
    higher = lambda r, best: r["length"] * best["period"] > best["length"] * r["period"]
    top = F.aggregate("runs", F.get("runs", F.lit(0)), lambda best, r: F.when(higher(r, best), r).otherwise(best))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    return (
        found.withColumn("top", top)
        .withColumn("lines", F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), ""))
        .select(
            "doc_id",
            F.size("runs").cast("long").alias("n_runs"),
            F.col("top.start").alias("start"),
            F.col("top.length").alias("length"),
            F.col("top.period").alias("period"),
            F.expr("1000 * top.length div top.period").alias("exponent_milli"),
            F.sha2("lines", 256).alias("runs_sha256"),
            F.sha2("collapsed", 256).alias("collapsed_sha256"),
        )
    )


QUERIES = {"op13_periodic_runs": op13_periodic_runs}
#: A word of a run of period q stands in the run's first words, but for the last three, at the head of four words that come again q later.
ORACLES = {
    "op13_periodic_runs": r"""
with bytes as (
  select doc_id, text, list_transform(string_split(doc_id::varchar, ''), lambda c: ord(c)::bigint) as bs from documents
), crc as (
  select doc_id, text, xor(list_reduce(list_prepend(4294967295::bigint, bs), lambda c, b:
    list_reduce(list_prepend(xor(c, b), [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, 3988292384::bigint * (x & 1)))), 4294967295::bigint) as h
  from bytes
), base as (
  select doc_id, h, h // 10 as g, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from crc
), place as (
  select doc_id, ws, len(ws) as n, case when len(ws) > 0 and h % 10 = 0 then g % len(ws) end as a, g from base
), step as (
  select doc_id, ws, n, a, 1 + (n - a) // (3 + g % 8) as p from place
), w as (
  select doc_id, i, ws[1 + case when a is null or i < a then i else a + (i - a) % p end] as x
  from (select doc_id, ws, a, p, unnest(range(0, n)) as i from step)
), f as (
  select doc_id, i, x || ' ' || lead(x, 1) over d || ' ' || lead(x, 2) over d || ' ' || lead(x, 3) over d as four, count(*) over (partition by doc_id) as n
  from w window d as (partition by doc_id order by i)
), m as (
  select u.doc_id, u.i, v.i - u.i as q from f u join f v on u.doc_id = v.doc_id and u.four = v.four and v.i > u.i and 4 * (v.i - u.i) <= u.n
), island as (
  select doc_id, q, i, i - row_number() over (partition by doc_id, q order by i) as part from m
), stretch as (
  select doc_id, q, min(i) as s, max(i) + 4 + q as e from island group by doc_id, q, part
), r as (
  select doc_id, s, e - s as l, min(q) as q from stretch where e - s >= greatest(6, 4 * q) group by doc_id, s, e
), gone as (
  select distinct doc_id, unnest(range(s + q, s + l)) as i from r
), best as (
  select distinct on (r.doc_id) r.doc_id, r.s, r.l, r.q from r
  order by r.doc_id, (1000000000000::hugeint * r.l) // r.q desc, r.s, r.q
), text as (
  select w.doc_id, string_agg(w.x, ' ' order by w.i) as kept from w anti join gone on w.doc_id = gone.doc_id and w.i = gone.i group by 1
), lines as (
  select doc_id, count(*) as n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' order by s, q) as listed from r group by 1
)
select b.doc_id, coalesce(n_runs, 0)::bigint as n_runs, best.s::bigint as start, best.l::bigint as length, best.q::bigint as period,
  (1000 * best.l // best.q)::bigint as exponent_milli, sha256(coalesce(listed, '')) as runs_sha256, sha256(coalesce(kept, '')) as collapsed_sha256
from base b left join lines using (doc_id) left join best using (doc_id) left join text using (doc_id)
"""
}
