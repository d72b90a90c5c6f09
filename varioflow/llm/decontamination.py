"""Benchmark decontamination by the q-gram lemma and banded alignment.

Texts are normalised to lower-case letters and digits with single spaces.  An
item of m characters that occurs with at most e edits shares at least
m - q + 1 - q*e character q-grams with that place, all on diagonals (text place
minus item place) that span at most e + 1.  So shared q-grams are counted in
bands of 2(e + 1) diagonals that overlap by half; bands that reach the bound
are aligned, within the band, and kept if the edit distance is at most e.  The
bands looked at are those with one of e + 1 rare key grams, see ``Matcher``.

The benchmark is searched in blocks of bounded size, one after the other, each
sent to the executors once; documents stream past and are never shuffled.

Defined results: null and empty texts match nothing; items with fewer than
``q`` normalised characters must stand unedited as words of their own (next to
a script without spaces, anywhere); items without a letter or digit match
nothing; for short items e is lowered until the bound is at least one q-gram;
each row of repeated documents is reported; of several places of one item in a
document the one with the fewest edits, then the first, counts; other columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

Q = 12
#: Edits allowed per item character.
EDIT_RATE = 0.06
#: Benchmark characters searched at once; bounds the broadcast.
BLOCK_CHARS = 4_000_000
CHUNK_BYTES = 1 << 20
SPACE = 32
MATCH = "doc_id bigint, item_id bigint, start bigint, end bigint, edits int, item_chars int"


def _folding() -> np.ndarray:
    """Lower case of each BMP code point; what is neither letter nor digit becomes a space."""
    table = np.full(1 << 16, SPACE, np.uint32)
    for point in range(1 << 16):
        low = chr(point).lower()
        if low[:1].isalnum():
            table[point] = ord(low) if len(low) == 1 else point
    return table


_TABLE: list[np.ndarray] = []


def normalised(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded code points of all texts, row offsets into them, and each one's place in its text."""
    if not _TABLE:
        _TABLE.append(_folding())
    texts = pc.fill_null(texts, "")
    n = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    raw = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.where(raw < 1 << 16, _TABLE[0][np.minimum(raw, 0xFFFF)], raw)
    starts = np.concatenate(([0], np.cumsum(n)))
    space = points == SPACE
    keep = np.ones(len(points), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    first = starts[:-1][n > 0]
    keep[first] = ~space[first]
    before = np.concatenate(([0], np.cumsum(keep)))
    kept = np.flatnonzero(keep)
    place = kept - np.repeat(starts[:-1], np.diff(before[starts]))
    return points[kept], before[starts], place


class Matcher:
    """The q-gram index of one block of items, and the search for them.

    An item with e edits at most is cut into e + 1 pieces of q characters or
    more.  One of them is untouched in any occurrence, so the rarest gram of each
    piece is all that the index holds; grams that many items share are only
    probed, where a rare one was found.
    """

    BITS = 22
    #: Candidate places worked on at once, and item characters compared at once.
    PLACES, CELLS = 1 << 18, 1 << 20

    def __init__(self, items: list[tuple[int | None, str | None]], q: int = Q, rate: float = EDIT_RATE):
        self.q = q
        points, rows, _ = normalised(pa.array([t for _, t in items], pa.string()))
        own = [points[a:b] for a, b in zip(rows[:-1], rows[1:])]
        own = [x[:-1] if len(x) and x[-1] == SPACE else x for x in own]
        chosen = [k for k, x in enumerate(own) if len(x) >= q] + [k for k, x in enumerate(own) if 0 < len(x) < q]
        self.ids = [items[k][0] for k in chosen]
        self.size = np.array([len(own[k]) for k in chosen], np.int64)
        self.start = np.concatenate(([0], np.cumsum(self.size)))[:-1].astype(np.int64)
        self.points = np.concatenate([own[k] for k in chosen]) if chosen else np.zeros(0, np.uint32)
        self.long = int((self.size >= q).sum())
        m = self.size[: self.long]
        self.edits = np.minimum((m * rate).astype(np.int64), (m - q) // q)
        self.bound = m - q + 1 - q * self.edits
        self.grams = C.rolling(self.points[: int(m.sum())].astype(np.uint64), q)
        item, at = self._keys()
        keys = self.grams[self.start[item] + at] if len(item) else np.zeros(0, np.uint64)
        order = np.argsort(keys, kind="stable")
        self.codes, counts = np.unique(keys, return_counts=True)
        self.first = np.concatenate(([0], np.cumsum(counts)))
        self.item, self.at = item[order], at[order]
        self.maybe = np.zeros(1 << self.BITS, bool)
        self.maybe[(self.codes >> np.uint64(64 - self.BITS)).astype(np.int64)] = True
        self.short = {int(n): self._short(int(n)) for n in np.unique(self.size[self.long :])}

    def _keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Item and place of the rarest gram of each piece."""
        if not self.long:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        _, back, counts = np.unique(self.grams, return_inverse=True, return_counts=True)
        df = counts[back]
        item, at = [], []
        for k in range(self.long):
            cuts = np.arange(self.edits[k] + 2) * self.size[k] // (self.edits[k] + 1)
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                item.append(k)
                at.append(a + int(np.argmin(df[self.start[k] + a : self.start[k] + b - self.q + 1])))
        return np.array(item, np.int64), np.array(at, np.int64)

    def _short(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted hashes of the items of n characters, and the items."""
        own = np.flatnonzero(self.size == n)
        h = np.array([C.rolling(self.points[s : s + n].astype(np.uint64), n)[0] for s in self.start[own]], np.uint64)
        order = np.argsort(h, kind="stable")
        return h[order], own[order]

    def find(self, texts: pa.Array) -> list[tuple[int, int, int, int, int]]:
        """(row, item, start, end, edits) of the best place of each item in each text."""
        if not len(self.size):
            return []
        points, rows, place = normalised(texts)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for r, i, s, t in self._words(points, rows):
            best.setdefault((r, i), (0, s, t))
        h = C.rolling(points.astype(np.uint64), self.q)
        for row, item, diagonal in self._places(h, rows):
            self._verify(points, h, rows, row, item, diagonal, best)
        return [(r, i, int(place[s]), int(place[t - 1]) + 1, d) for (r, i), (d, s, t) in sorted(best.items())]

    def _words(self, points: np.ndarray, rows: np.ndarray):
        """Where items of fewer than q characters stand as words of their own."""
        closed = np.append(points, SPACE)
        joins = np.concatenate(([False], _spaced(points), [False]))  # joins[k + 1]: the character at k belongs to a spaced word
        for n, (h, items) in self.short.items():
            found = C.rolling(points.astype(np.uint64), n)
            at = np.minimum(np.searchsorted(h, found), len(h) - 1)
            seen = np.flatnonzero(h[at] == found)
            row = np.searchsorted(rows, seen, side="right") - 1
            ok = seen + n <= rows[row + 1]
            # a character that goes on with the word stands in the same text, and neither side is written without spaces
            ok &= (seen == rows[row]) | ~joins[seen] | ~joins[seen + 1]
            ok &= (seen + n == rows[row + 1]) | ~joins[np.minimum(seen + n + 1, len(joins) - 1)] | ~joins[seen + n]
            for s, r in zip(seen[ok].tolist(), row[ok].tolist()):
                k = int(np.searchsorted(h, found[s]))
                while k < len(h) and h[k] == found[s]:
                    if np.array_equal(closed[s : s + n], self.points[self.start[items[k]] : self.start[items[k]] + n]):
                        yield r, int(items[k]), s, s + n
                    k += 1

    def _places(self, h: np.ndarray, rows: np.ndarray):
        """Distinct (row, item, diagonal) that share a key gram, in bounded numbers."""
        if not len(h) or not self.long:
            return
        seen = np.flatnonzero(self.maybe[(h >> np.uint64(64 - self.BITS)).astype(np.int64)])
        code = np.minimum(np.searchsorted(self.codes, h[seen]), len(self.codes) - 1)
        row = np.searchsorted(rows, seen, side="right") - 1
        use = (self.codes[code] == h[seen]) & (seen + self.q <= rows[row + 1])
        seen, code, row = seen[use], code[use], row[use]
        n = self.first[code + 1] - self.first[code]
        upto = np.cumsum(n)
        a = 0
        while a < len(seen):
            b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + self.PLACES)))
            own = n[a:b]
            each = np.repeat(self.first[code[a:b]] - (np.cumsum(own) - own), own) + np.arange(own.sum())
            item = self.item[each]
            diagonal = np.repeat(seen[a:b], own) - self.at[each]
            order = np.lexsort((diagonal, item, np.repeat(row[a:b], own)))
            r, i, d = np.repeat(row[a:b], own)[order], item[order], diagonal[order]
            new = np.ones(len(r), bool)
            new[1:] = (r[1:] != r[:-1]) | (i[1:] != i[:-1]) | (d[1:] != d[:-1])
            yield r[new], i[new], d[new]
            a = b

    def _verify(self, points, h, rows, row, item, diagonal, best) -> None:
        """Unedited places first; then the bands that reach the bound, aligned."""
        same = self._shared(h, rows, row, item, diagonal, np.zeros(len(row), np.int64)) == self.size[item] - self.q + 1
        whole = {}
        for r, i, d in zip(row[same].tolist(), item[same].tolist(), diagonal[same].tolist()):
            whole.setdefault((r, i), d)  # diagonals ascend: the first place
        for (r, i), d in whole.items():
            mine = (0, d, d + int(self.size[i]))
            best[r, i] = min(best.get((r, i), mine), mine)
        left = np.array([best.get((r, i), (1,))[0] > 0 for r, i in zip(row.tolist(), item.tolist())], bool)
        row, item, diagonal = row[left], item[left], diagonal[left]
        if not len(row):
            return
        shift = int(self.size.max()) + 1
        band = (diagonal + shift) // (self.edits[item] + 1)
        r, i, b = np.tile(row, 2), np.tile(item, 2), np.concatenate((band, band - 1))
        order = np.lexsort((b, i, r))
        r, i, b = r[order], i[order], b[order]
        new = np.ones(len(r), bool)
        new[1:] = (r[1:] != r[:-1]) | (i[1:] != i[:-1]) | (b[1:] != b[:-1])
        r, i, b = r[new], i[new], b[new]
        low = b * (self.edits[i] + 1) - shift
        # what is left of the text must be long enough
        fits = rows[r + 1] - rows[r] >= self.size[i] - self.edits[i]
        r, i, low = r[fits], i[fits], low[fits]
        full = self._shared(h, rows, r, i, low, 2 * self.edits[i] + 1) >= self.bound[i]
        for r, i, s, t, d in self._aligned(points, rows, r[full], i[full], low[full]):
            if (d, s, t) < best.get((r, i), (1 << 60, 0, 0)):
                best[r, i] = (d, s, t)

    def _slices(self, item: np.ndarray):
        """Ranges of candidates with a bounded number of item characters."""
        upto = np.cumsum(self.size[item])
        a = 0
        while a < len(item):
            b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + self.CELLS)))
            yield a, b
            a = b

    def _shared(self, h, rows, row, item, low, more) -> np.ndarray:
        """Grams of each item that its text has on the diagonals ``low`` to ``low + more``."""
        out = np.zeros(len(row), np.int64)
        for a, b in self._slices(item):
            order = np.argsort(-more[a:b], kind="stable") + a
            n = self.size[item[order]] - self.q + 1
            begins = np.cumsum(n) - n
            j = np.arange(int(n.sum())) - np.repeat(begins, n)
            wanted = self.grams[np.repeat(self.start[item[order]], n) + j]
            at = np.repeat(low[order], n) + j
            first, last = np.repeat(rows[row[order]], n), np.repeat(rows[row[order] + 1] - self.q, n)
            for step in range(int(more[order].max(initial=0)) + 1):
                k = int((more[order] >= step).sum())
                e = int(n[:k].sum())
                place = at[:e] + step
                hit = (h[np.clip(place, 0, len(h) - 1)] == wanted[:e]) & (place >= first[:e]) & (place <= last[:e])
                out[order[:k]] += np.add.reduceat(hit, begins[:k])
        return out

    def _aligned(self, points, rows, row, item, low):
        """(row, item, start, end, edits) of candidates within their edits, aligned many at a time."""
        for e in np.unique(self.edits[item]).tolist():
            own = np.flatnonzero(self.edits[item] == e)
            for a, b in self._slices(item[own]):
                some = own[a:b]
                some = some[np.argsort(-self.size[item[some]], kind="stable")]
                r, i, l = row[some], item[some], low[some]
                m, begin, z = self.size[i], rows[r], rows[r + 1]
                width = 4 * e + 3
                base = l - e
                cost = bands(points, self.points, np.zeros(len(i), np.int64), 1, self.start[i], m, base, width, begin, z, e)
                near = np.flatnonzero(cost.min(axis=1) <= e)
                r, i, m, begin = r[near], i[near], m[near], begin[near]
                end = base[near] + m + cost[near].argmin(axis=1)
                # from that end backwards, with the one start on diagonal 0 of the reversed strings
                back = bands(points, self.points, end - 1, -1, self.start[i] + m - 1, m, np.full(len(i), -e), 2 * e + 1, np.zeros(len(i), np.int64), end - begin, e, e)
                length = m - e + back.argmin(axis=1) if len(i) else m
                yield from zip(r.tolist(), i.tolist(), (end - length).tolist(), end.tolist(), back.min(axis=1).tolist() if len(i) else [])


def _spaced(points: np.ndarray) -> np.ndarray:
    """Characters of words that spaces set off: not a space, and not of the scripts written without (fixed ranges)."""
    unspaced = ((points >= 0x0E00) & (points <= 0x0EFF)) | ((points >= 0x1000) & (points <= 0x109F)) | ((points >= 0x1780) & (points <= 0x17FF)) | ((points >= 0x3040) & (points <= 0x30FF)) | ((points >= 0x3400) & (points <= 0x9FFF)) | ((points >= 0xF900) & (points <= 0xFAFF)) | (points >= 0x20000)
    return (points != SPACE) & ~unspaced


def bands(points, items, origin, sign, start, m, base, width, a, z, e, open_at=None) -> np.ndarray:
    """Edit distances of each candidate after its whole item, per diagonal base + 0..width-1.

    Text character k of a candidate is ``points[origin + sign * k]``, limited to
    [a, z); item character k is ``items[start + sign * k]``.  Candidates come
    with ``m`` descending.  Those beyond ``e`` everywhere are given up.
    """
    far, n = 1 << 20, len(m)
    step = np.arange(width)
    out = np.full((n, width), far, np.int64)
    live = np.arange(n)
    at = base[:, None] + step
    cost = np.where((at < a[:, None]) | (at > z[:, None]), far, 0)
    if open_at is not None:
        cost[:, step != open_at] = far
        cost = np.minimum.accumulate(cost - step, axis=1) + step
    for k in range(int(m.max(initial=0))):
        done = m[live] <= k
        if k % 8 == 0:
            done |= cost.min(axis=1) > e
        if done.any():
            ended = live[done & (m[live] <= k)]
            out[ended] = cost[np.searchsorted(live, ended)]
            live, cost = live[~done], cost[~done]
            if not len(live):
                return out
        place = base[live, None] + (k + step)
        first, last = a[live, None], z[live, None]
        outside = (place < first) | (place >= last)
        text = points[np.clip(origin[live, None] + sign * place, 0, len(points) - 1)]
        now = cost + ((text != items[start[live] + sign * k][:, None]) | outside) + far * outside
        np.minimum(now[:, :-1], cost[:, 1:] + 1, out=now[:, :-1])
        standing = far * ((place + 1 < first) | (place + 1 > last))
        now += standing - step
        np.minimum.accumulate(now, axis=1, out=cost)
        cost += step + standing
        np.minimum(cost, far, out=cost)
    out[live] = cost
    return out


def _blocks(bench: DataFrame, item_id: str, text: str, block_chars: int):
    """The items, in blocks of about ``block_chars`` characters, one at a time on the driver, and whether it is the last."""
    items = bench.select(F.col(item_id).cast("long").alias("i"), F.col(text).alias("t")).where("t is not null")
    chars = items.agg(F.sum(F.length("t").cast("long")).alias("n")).first()["n"] or 0
    parts = int(chars // block_chars) + 1
    for k in range(parts):
        rows = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == k).collect()
        yield sorted(((r["i"], r["t"]) for r in rows), key=lambda x: (x[0] is None, x[0] or 0, x[1])), k == parts - 1


def matches(docs: DataFrame, bench: DataFrame, q: int = Q, rate: float = EDIT_RATE, block_chars: int = BLOCK_CHARS, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document and benchmark item it contains."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    out = None
    for items, last in _blocks(bench, item_id, item_text, block_chars):
        sent = docs.sparkSession.sparkContext.broadcast(Matcher(items, q, rate))
        found = rows.mapInArrow(_reporting(sent), MATCH)
        if not last:  # one block's index at a time is held by the executors
            found = C.stored(found, "matches")
            sent.destroy()
        out = found if out is None else out.unionByName(found)
    return out


def _reporting(sent):
    def search(batches):
        own = sent.value
        for batch in C.chunks(batches, "text", CHUNK_BYTES):
            ids = batch.column("doc_id").to_pylist()
            hits = own.find(batch.column("text"))
            columns = [[ids[r] for r, *_ in hits], [own.ids[i] for _, i, *_ in hits], *[[h[k] for h in hits] for k in (2, 3, 4)], [int(own.size[i]) for _, i, *_ in hits]]
            kinds = [pa.int64()] * 4 + [pa.int32()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["doc_id", "item_id", "start", "end", "edits", "item_chars"])

    return search


def clean(docs: DataFrame, bench: DataFrame, q: int = Q, rate: float = EDIT_RATE, block_chars: int = BLOCK_CHARS, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows, with all their columns, that contain no benchmark item.

    What passes one block is written before the next, so that executors hold one index.
    """
    for items, last in _blocks(bench, item_id, item_text, block_chars):
        sent = docs.sparkSession.sparkContext.broadcast(Matcher(items, q, rate))

        def passing(batches, sent=sent):
            for batch in C.chunks(batches, text, CHUNK_BYTES):
                keep = np.ones(batch.num_rows, bool)
                keep[[r for r, *_ in sent.value.find(batch.column(text))]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(passing, T.StructType(docs.schema.fields))
        if not last:
            docs = C.stored(docs, "clean")
            sent.destroy()
    return docs


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain benchmark items, with the place and the edit distance."""
    return matches(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))


QUERIES = {"op1_decontamination": op1_decontamination}
ORACLES: dict[str, str] = {}
