"""Exact substring removal: repeated token windows by Rabin-Karp hashing.

Every window of ``window`` words is hashed.  A window is removed where its word
sequence also starts in a document with a smaller id; a document loses all words
that removed windows cover.

Windows travel packed by hash range, seven hash bytes each (the range carries
the rest of 64 bits).  A chunk of documents first settles what repeats inside
it: of each hash it sends only the places in its least document, since the
other documents' places are removed already; a passage that a third of all
documents hold therefore reaches its range's task once per chunk.  The task
finds each hash's least document and returns the places in others.  Places come
together by document shard, merge into maximal intervals and meet the texts in
an equi-join.

Ranges and shards grow with the corpus, and a chunk would fall apart into blobs
of a few windows.  So there are at most ``COARSE`` blobs of a chunk: beyond that
many ranges, blobs go to coarse ranges first, where those of many chunks are
laid together and split anew.

Defined results: null, empty and short texts lose nothing; rows of one id are
one document, so repeated rows do not count against each other and lose alike
(an id is meant to stand for one text); rows with
a null id lose nothing and count against nobody; other columns are ignored.
Should one id stand for unlike texts after all, their windows are pooled and
each text loses the word places that any of them loses, up to its end.
Windows are compared by 64-bit hash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

WINDOW = 13
#: Blobs of a chunk at most; a power of two from 256 on, so that a coarse range tells the highest byte of its hashes.
COARSE = 4096
#: Bytes of blobs that a task lays together before it splits them.
GATHERED = 64 << 20


def window_hashes(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and start of every window that lies in one text."""
    flat, offsets = C.words(texts)
    h = C.rolling(C.word_hashes(flat), k)
    row = np.repeat(np.arange(len(texts)), np.diff(offsets))[: len(h)]
    at = np.arange(len(h))
    whole = at + k <= offsets[1:][row] if len(h) else np.zeros(0, bool)
    return h[whole], row[whole], (at - offsets[:-1][row])[whole] if len(h) else at[whole]


def packed_places(doc: np.ndarray, at: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Places sorted by document and start: the documents, their counts, the starts.

    Documents and starts as steps from the one before (a document's first start as it is), which pack to a byte or two.
    """
    first = C.group_starts(doc)
    step = at.astype(np.int64)
    step[1:] -= at[:-1]
    step[first] = at[first]
    return C.planes(np.diff(doc[first], prepend=0), 8), C.planes(np.diff(np.append(first, len(doc))), 4), C.planes(step, 4)


def unpacked_places(docs: bytes, counts: bytes, at: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = C.unplanes(counts, len(counts) // 4, 4).astype(np.int64)
    step = C.unplanes(at, len(at) // 4, 4).astype(np.int64)
    first, upto = np.cumsum(n) - n, np.cumsum(step)
    return np.repeat(np.cumsum(C.unplanes(docs, len(n), 8).view("<i8")), n), upto - np.repeat(upto[first] - step[first], n)


def shard_of(doc: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each document, by hash: ids may come in steps."""
    return C.range_of(C.mixed(doc.astype(np.uint64)), shards)


def nested(ranges: int) -> tuple[int, int]:
    """Coarse and fine numbers of ranges: one and the same up to ``COARSE``, else a multiple."""
    return (ranges, ranges) if ranges <= COARSE else (COARSE, COARSE * -(-ranges // COARSE))


def _split_places(rows: list[tuple], fine: int):
    """Blobs of places of one coarse shard, by fine shard."""
    places = [unpacked_places(*x) for x in rows]
    doc, at = np.concatenate([x[0] for x in places]), np.concatenate([x[1] for x in places])
    order = np.lexsort((at, doc))
    doc, at = doc[order], at[order]
    return [(part, packed_places(doc[x], at[x])) for part, x in _by(shard_of(doc, fine))]


def _split_windows(coarse: int, part: int, rows: list[tuple], fine: int):
    """Blobs of windows of one coarse range, by fine range."""
    h = np.concatenate([C.unplanes(x[0], len(x[0]) // 7, 7) for x in rows]) | np.uint64((part * 256 // coarse) << 56)
    places = [unpacked_places(*x[1:]) for x in rows]
    doc, at = np.concatenate([x[0] for x in places]), np.concatenate([x[1] for x in places])
    own = C.range_of(h, fine)
    order = np.lexsort((at, doc, own))
    h, doc, at, own = h[order], doc[order], at[order], own[order]
    starts = C.group_starts(own)
    return [(int(own[x]), (C.planes(h[x:y], 7), *packed_places(doc[x:y], at[x:y]))) for x, y in zip(starts, np.append(starts[1:], len(own)))]


def _laid_together(coarse: int, fine: int, gathered: int):
    """Blobs of coarse ranges to fine ones; what is settled passes on."""

    def run(batches):
        held, size = {}, 0

        def flush():
            out = [(own, -1, *blob) for part, rows in held.items() for own, blob in _split_windows(coarse, part, rows, fine)]
            held.clear()
            return _arrow(out)

        for batch in batches:
            settled = []
            for part, shard, *blob in zip(*[c.to_pylist() for c in batch.columns]):
                if shard >= 0:
                    settled.append((part, shard, *blob))
                    continue
                held.setdefault(part, []).append(blob)
                size += sum(map(len, blob))
                if size > gathered:
                    yield from flush()
                    size = 0
            yield from _arrow(settled)
        yield from flush()

    return run


def _shards_laid_together(shards: int, gathered: int):
    def run(batches):
        held, size = {}, 0

        def flush():
            out = [(own, *blob) for rows in held.values() for own, blob in _split_places(rows, shards)]
            held.clear()
            for s in range(0, len(out), 256):
                columns = list(zip(*out[s : s + 256]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int32()] + [pa.binary()] * 3)], names=["shard", "docs", "counts", "starts"])

        for batch in batches:
            for shard, *blob in zip(*[c.to_pylist() for c in batch.columns]):
                held.setdefault(shard, []).append(blob)
                size += sum(map(len, blob))
                if size > gathered:
                    yield from flush()
                    size = 0
        yield from flush()

    return run


def _spread(k: int, ranges: int, shards: int):
    """Chunks to packed windows by hash range, and what the chunk settles itself by shard."""

    def run(batches):
        for batch in C.chunks(batches, "text"):
            batch = batch.filter(pc.is_valid(batch.column("doc_id")))
            ids = batch.column("doc_id").to_numpy()
            h, row, at = window_hashes(batch.column("text"), k)
            doc = ids[row]
            order = np.lexsort((at, doc, h))
            h, doc, at = h[order], doc[order], at[order]
            first = C.group_starts(h)
            size = np.diff(np.append(first, len(h)))
            repeated = doc > np.repeat(doc[first], size)
            out = []
            d, a = doc[repeated], at[repeated]
            order = np.lexsort((a, d))
            d, a = d[order], a[order]
            for part, x in _by(shard_of(d, shards)):
                # what is settled passes through the range of its shard's number
                out.append((part % ranges, part, None, *packed_places(d[x], a[x])))
            h, doc, at = h[~repeated], doc[~repeated], at[~repeated]
            part = C.range_of(h, ranges)
            order = np.lexsort((at, doc, part))
            h, doc, at, part = h[order], doc[order], at[order], part[order]
            starts = C.group_starts(part)
            for x, y in zip(starts, np.append(starts[1:], len(part))):
                out.append((int(part[x]), -1, C.planes(h[x:y], 7), *packed_places(doc[x:y], at[x:y])))
            yield from _arrow(out)

    return run


def _by(key: np.ndarray):
    """Each key with the places that have it, in order."""
    order = np.argsort(key, kind="stable")
    starts = C.group_starts(key[order])
    for x, y in zip(starts, np.append(starts[1:], len(order))):
        yield int(key[order[x]]), order[x:y]


def _arrow(rows: list[tuple]):
    kinds = [pa.int32(), pa.int32()] + [pa.binary()] * 4
    for s in range(0, len(rows), 256):
        columns = list(zip(*rows[s : s + 256]))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["part", "shard", "hashes", "docs", "counts", "starts"])


PACKED = "part int, shard int, hashes binary, docs binary, counts binary, starts binary"
PLACES = "shard int, docs binary, counts binary, starts binary"


def _counted(shards: int):
    """One hash range: the places of hashes that a smaller document has too."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        passed, own = pdf[pdf["shard"] >= 0], pdf[pdf["shard"] < 0]
        out = [passed[["shard", "docs", "counts", "starts"]]]
        if len(own):
            h = np.concatenate([C.unplanes(x, len(x) // 7, 7) for x in own["hashes"]])
            places = [unpacked_places(*x) for x in own[["docs", "counts", "starts"]].itertuples(index=False)]
            doc, at = np.concatenate([x[0] for x in places]), np.concatenate([x[1] for x in places])
            del places
            order = np.argsort(h, kind="stable")
            first = C.group_starts(h[order])
            least = np.minimum.reduceat(doc[order], first)
            repeated = order[doc[order] > np.repeat(least, np.diff(np.append(first, len(h))))]
            doc, at = doc[repeated], at[repeated]
            order = np.lexsort((at, doc))
            doc, at = doc[order], at[order]
            found = [(part, *packed_places(doc[x], at[x])) for part, x in _by(shard_of(doc, shards))]
            out.append(pd.DataFrame(found, columns=["shard", "docs", "counts", "starts"]))
        return pd.concat(out, ignore_index=True)

    return run


def merged(starts: np.ndarray, k: int) -> list[tuple[int, int]]:
    """Maximal intervals [from, to) of words that windows at these sorted starts cover."""
    cut = np.flatnonzero(np.diff(starts) > k)
    return list(zip(starts[np.append(0, cut + 1)].tolist(), (starts[np.append(cut, len(starts) - 1)] + k).tolist()))


def _intervals(k: int):
    """One shard: the removal intervals of each document."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        places = [unpacked_places(*x) for x in pdf[["docs", "counts", "starts"]].itertuples(index=False)]
        doc, at = np.concatenate([x[0] for x in places]), np.concatenate([x[1] for x in places])
        order = np.lexsort((at, doc))
        doc, at = doc[order], at[order]
        first = C.group_starts(doc)
        spans = [merged(np.unique(at[x:y]), k) for x, y in zip(first, np.append(first[1:], len(doc)))]
        return pd.DataFrame({"doc_id": doc[first], "starts": [[a for a, _ in s] for s in spans], "ends": [[b for _, b in s] for s in spans]})

    return run


def removal_intervals(docs: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, starts, ends``: word intervals to remove, for documents that have any."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return _intervals_of(rows, window, C.hash_ranges(rows, "text"))


def _intervals_of(rows: DataFrame, window: int, ranges: int, gathered: int = GATHERED) -> DataFrame:
    # a shard holds the places of about as many windows as a range
    coarse, fine = nested(ranges)
    spread = rows.mapInArrow(_spread(window, coarse, coarse), PACKED)
    if fine > coarse:
        spread = spread.repartition(coarse, "part").mapInArrow(_laid_together(coarse, fine, gathered), PACKED)
    places = spread.groupBy("part").applyInPandas(_counted(coarse), PLACES)
    if fine > coarse:
        places = places.repartition(coarse, "shard").mapInArrow(_shards_laid_together(fine, gathered), PLACES)
    return places.groupBy("shard").applyInPandas(_intervals(window), "doc_id long, starts array<long>, ends array<long>")


def remove_repeats(docs: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_words, n_removed, kept_text`` of every row; kept words joined by one space."""
    return _kept(docs, window, doc_id, text, "kept_text", lambda kept: kept)


def _kept(docs: DataFrame, window: int, doc_id: str, text: str, name: str, of) -> DataFrame:
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    met = rows.join(removal_intervals(docs, window, doc_id, text), "doc_id", "left")

    def cut(batches):
        for batch in C.chunks(batches, "text"):
            flat, offsets = C.words(batch.column("text"))
            removed, out = [], []
            for a, z, starts, ends in zip(offsets[:-1].tolist(), offsets[1:].tolist(), batch.column("starts").to_pylist(), batch.column("ends").to_pylist()):
                own = flat.slice(a, z - a).to_pylist()
                for s, e in zip(reversed(starts or []), reversed(ends or [])):
                    del own[s:e]
                removed.append(z - a - len(own))
                out.append(of(" ".join(own)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offsets), pa.int64()), pa.array(removed, pa.int64()), pa.array(out, pa.string())], names=["doc_id", "n_words", "n_removed", name])

    return met.mapInArrow(cut, f"doc_id long, n_words long, n_removed long, {name} string")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What 13-word substring removal leaves of every document, as a digest."""
    docs = C.table(spark, sf_dir, "documents")
    return _kept(docs, WINDOW, "doc_id", "text", "kept_sha256", lambda kept: hashlib.sha256(kept.encode()).hexdigest())


QUERIES = {"op5_substring_dedup": op5_substring_dedup}
ORACLES = {
    "op5_substring_dedup": r"""
with w as (
  select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents
), t as (
  select doc_id, ws, unnest(case when len(ws) < 13 then []::bigint[] else range(1, len(ws) - 11) end) as i from w
), s as (
  select doc_id, i, array_to_string(ws[i:i + 12], ' ') as g from t
), r as (
  select doc_id, i from (select doc_id, i, min(doc_id) over (partition by g) as m from s) where m < doc_id
), c as (
  select distinct doc_id, i + j as p from r, range(0, 13) x(j)
), k as (
  select doc_id, len(ws) as n_words, unnest(range(1, len(ws) + 1)) as p, unnest(ws) as x from w
)
select w.doc_id, len(w.ws)::bigint as n_words, coalesce(d.n, 0)::bigint as n_removed, sha256(coalesce(q.kept, '')) as kept_sha256
from w
left join (select doc_id, count(*) as n from c group by 1) d using (doc_id)
left join (select k.doc_id, string_agg(x, ' ' order by p) as kept from k anti join c on k.doc_id = c.doc_id and k.p = c.p group by 1) q using (doc_id)
"""
}
