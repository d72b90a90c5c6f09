"""N-gram Jaccard join by T-occurrence search with DivideSkip.

A document is its set of distinct word shingles; two link at a Jaccard
similarity of at least ``PERCENT`` %.  A set of n shingles can only link where at
least T = ceil(0.75 n) of them also occur elsewhere, which gives four steps:

1. Every shingle's hash goes, packed by hash range, to the range's task, which
   marks those that two documents have.  A document with fewer than T marked
   ones is settled; only the rest go on.  Equal sets form one class and are
   represented by their least doc_id.  A chunk of documents has one blob per
   range, and at most ``substring_dedup.COARSE`` of them: of more ranges the
   blobs of many chunks are laid together by coarse range first, and so are
   the replies on their way back to the chunks.
2. The rest count their shingles again, exactly, and keep their rarest
   n - T + 1 as a prefix: documents that link share a prefix shingle.  Documents
   are joined to the least one of each prefix list and fall into candidate
   components, so that a set travels once and not once per pair.
3. Within a component, T-occurrence search: of a query's inverted lists the
   longest L are set aside (DivideSkip), the short ones are merged in order, and
   a document with at least T - L occurrences is looked up in the long lists by
   binary search.  Documents linked through others already are not verified.
4. A component beyond ``BLOCK_DOCS`` documents is compared with three of its
   members first, one of them the most typical.  Prefix shingles whose documents
   all link to one leader are dropped, with the documents that have no other, and
   what is left of a component is searched as in step 3.  Where even that is too
   large, what the leaders did not join meets the rest in blocks, apart by size (sets that link differ by less
   than a third), or, where that makes fewer tasks, only the documents of each
   remaining shingle meet, so that none meets a whole component of loose chains.

The links found span the components; each document gets its least member.

Defined results: null, empty and blank texts have no shingle and link with
nothing (component_id is their own doc_id); repeated rows are returned each;
rows with a null doc_id are returned with a null component_id and link with
nothing; a text of one to four words is one shingle; other columns are ignored.
Shingles are compared by 64-bit hash.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .components import components
from .substring_dedup import nested, packed_places, shard_of, unpacked_places

WORDS = 5
PERCENT = 75
BLOCK_DOCS = 512
BLOCK_SHINGLES = 4_000_000
#: Bytes of blobs that a task lays together before it splits them.
GATHERED = 32 << 20


def needed(n: int) -> int:
    """Least overlap of a set of n with any set it links to."""
    return -(-PERCENT * n // 100)


def needed_pair(x, y):
    """Least overlap of sets of x and y that link: 100 o >= 75 (x + y - o)."""
    return -(-PERCENT * (x + y) // (100 + PERCENT))


def shingle_sets(texts: pa.Array, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after another, and the row offsets."""
    flat, offsets = C.words(pc.ascii_lower(pc.fill_null(texts, "")))
    values = C.word_hashes(flat)
    n = np.diff(offsets)
    row = np.repeat(np.arange(len(n)), np.maximum(n - k + 1, 0))
    h = C.rolling(values, k)
    inside = np.repeat(np.arange(len(n)), n)[: len(h)]
    h = h[np.arange(len(h)) + k <= offsets[1:][inside]] if len(h) else h
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        own = np.array([C.rolling(values[offsets[r] : offsets[r + 1]], int(n[r]))[0] for r in short], np.uint64)
        h, row = np.concatenate((h, C.mixed(own + n[short].astype(np.uint64)))), np.concatenate((row, short))
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[new], row[new]
    return h, np.searchsorted(row, np.arange(len(n) + 1))


def set_keys(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums that stand for each set's content."""
    with np.errstate(over="ignore"):
        one = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h, dtype=np.uint64)))
        two = np.concatenate((np.zeros(1, np.uint64), np.cumsum(C.mixed(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)), dtype=np.uint64)))
        return (one[bounds[1:]] - one[bounds[:-1]]).view(np.int64), (two[bounds[1:]] - two[bounds[:-1]]).view(np.int64)


PACKED = "part int, chunk long, frag binary, rows binary, counts binary, head binary"


def _spread(ranges: int, fine: int | None = None):
    """Chunks of documents to packed shingle hashes, one row per chunk and hash range.

    Where the ranges are to be split into ``fine`` ones later, whole hashes travel.
    """
    fine = fine or ranges
    sent = (lambda h: h.astype("<u8").tobytes()) if fine > ranges else (lambda h: (h & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes())

    def run(batches):
        task = TaskContext.get().partitionId()
        for number, batch in enumerate(C.chunks(batches, "text")):
            chunk = (task << 24) + number
            ids = batch.column("doc_id")
            valid = pc.is_valid(ids).to_numpy(zero_copy_only=False)
            h, bounds = shingle_sets(batch.column("text"))
            n = np.diff(bounds)
            k1, k2 = set_keys(h, bounds)
            head = pd.DataFrame({"id": pc.fill_null(ids, 0).to_numpy(), "valid": valid.astype(np.int64), "n": n, "k1": k1, "k2": k2})
            # of equal sets of a chunk the first with a doc_id stands for all
            first = ~head.duplicated(["valid", "n", "k1", "k2"]).to_numpy() & (n > 0)
            row = np.repeat(np.arange(len(n)), n)
            own = first[row] & valid[row]
            h, row = h[own], row[own]
            part = C.range_of(h, ranges)
            order = np.argsort(part.astype(np.uint16) if ranges < 1 << 16 else part, kind="stable")
            h, row, part = h[order], row[order], part[order]
            starts = C.group_starts(part)
            home = int(shard_of(np.array([chunk]), fine)[0]) if fine > ranges else int(chunk % ranges)
            out = {"part": [home], "frag": [None], "rows": [None], "counts": [None], "head": [np.ascontiguousarray(head.to_numpy(np.int64).T).tobytes()]}
            for a, b in zip(starts, np.append(starts[1:], len(part))):
                at = C.group_starts(row[a:b])
                out["part"].append(int(part[a]))
                out["frag"].append(sent(h[a:b]))
                out["rows"].append(C.planes(np.diff(row[a:b][at], prepend=0), 4))
                out["counts"].append(C.planes(np.diff(np.append(at, b - a)), 3))
                out["head"].append(None)
            for s in range(0, len(out["part"]), 256):
                some = {k: v[s : s + 256] for k, v in out.items()}
                kinds = [pa.int32(), pa.int64()] + [pa.binary()] * 4
                columns = [some["part"], [chunk] * len(some["part"]), some["frag"], some["rows"], some["counts"], some["head"]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["part", "chunk", "frag", "rows", "counts", "head"])

    return run


def _marked(pdf: pd.DataFrame) -> pd.DataFrame:
    """One hash range: how many hashes of each document some other document has too."""
    heads, blobs = pdf[pdf["head"].notna()], pdf[pdf["head"].isna()].sort_values("chunk")
    frags = [np.frombuffer(x, "<u4") for x in blobs["frag"]]
    every = np.concatenate(frags) if frags else np.zeros(0, np.uint32)
    order = np.argsort(every, kind="stable")
    starts = C.group_starts(every[order])
    size = np.diff(np.append(starts, len(every)))
    shared = np.empty(len(every), np.int64)
    shared[order] = np.repeat(size > 1, size)
    totals = np.concatenate(([0], np.cumsum(shared)))
    out, begin = [], 0
    for rows, counts in zip(blobs["rows"], blobs["counts"]):
        n = C.unplanes(counts, len(counts) // 3, 3).astype(np.int64)
        ends = begin + np.cumsum(n)
        out.append(C.planes(totals[ends] - totals[ends - n], 3))
        begin = ends[-1]
    del every, order, shared, totals, frags
    C.release()
    marked = pd.DataFrame({"chunk": blobs["chunk"].to_numpy(), "rows": blobs["rows"].to_numpy(), "counts": out, "head": None})
    return pd.concat([marked, heads[["chunk", "rows", "counts", "head"]]], ignore_index=True)


def _settled(pdf: pd.DataFrame) -> pd.DataFrame:
    """One chunk: its documents, and whether enough of their shingles are shared."""
    own = pdf[pdf["head"].notna()]["head"].iloc[0]
    shared = np.zeros(len(own) // 40, np.int64)
    for rows, counts in zip(pdf["rows"], pdf["counts"]):
        if rows is not None:
            at = np.cumsum(C.unplanes(rows, len(rows) // 4, 4).astype(np.int64))
            shared[at] += C.unplanes(counts, len(counts) // 3, 3).astype(np.int64)
    return _documents(own, shared)


def _documents(head: bytes, shared: np.ndarray) -> pd.DataFrame:
    """The documents of a chunk's head (five numbers each), given how many of their shingles are shared."""
    ids, valid, n, k1, k2 = np.frombuffer(head, np.int64).reshape(5, -1)
    out = pd.DataFrame({"doc_id": pd.array(ids, "Int64"), "n_shingles": n, "k1": k1, "k2": k2})
    out.loc[valid == 0, "doc_id"] = pd.NA
    out["alive"] = (n > 0) & (100 * shared >= PERCENT * n)
    return out


DOCS = "doc_id long, n_shingles long, k1 long, k2 long, alive boolean"


#: Blobs of several chunks: ``chunks, sizes, rows`` are packed places, ``counts`` the shingles of each.
GATHERING = "part int, chunk long, chunks binary, sizes binary, rows binary, counts binary, frag binary, head binary"
REPLY = "part int, chunk long, chunks binary, sizes binary, rows binary, counts binary, head binary"


def _batches(rows: list[tuple], frag: bool):
    """Arrow batches of a bounded number of blobs."""
    names = [x.split()[0] for x in (GATHERING if frag else REPLY).split(", ")]
    kinds = [pa.int32(), pa.int64()] + [pa.binary()] * (len(names) - 2)
    for s in range(0, len(rows), 256):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[s : s + 256]), kinds)], names=names)


def _replies(chunk: np.ndarray, row: np.ndarray, count: np.ndarray, shards: int) -> list[tuple]:
    """Counts of each chunk's rows, added up, in one blob per shard of chunks."""
    order = np.lexsort((row, chunk))
    chunk, row, count = chunk[order], row[order], count[order]
    first = np.flatnonzero(np.concatenate(([True], (chunk[1:] != chunk[:-1]) | (row[1:] != row[:-1])))) if len(chunk) else np.zeros(0, np.int64)
    if len(first):
        chunk, row, count = chunk[first], row[first], np.add.reduceat(count, first)
    own = shard_of(chunk, shards)
    order = np.argsort(own, kind="stable")
    starts = C.group_starts(own[order])
    parts = [order[a:b] for a, b in zip(starts, np.append(starts[1:], len(order)))]
    return [(int(own[x[0]]), None, *packed_places(chunk[x], row[x]), C.planes(count[x], 4), None) for x in parts]


def _split(blobs: list[tuple], fine: int) -> list[tuple]:
    """Blobs of many chunks and one coarse range, laid together by fine range."""
    h = np.concatenate([np.frombuffer(x, "<u8") for _, x, _, _ in blobs])
    n = [C.unplanes(x, len(x) // 3, 3).astype(np.int64) for *_, x in blobs]
    row = np.concatenate([np.repeat(np.cumsum(C.unplanes(x, len(x) // 4, 4).astype(np.int64)), k) for (_, _, x, _), k in zip(blobs, n)])
    chunk = np.repeat([c for c, *_ in blobs], [int(k.sum()) for k in n])
    own = C.range_of(h, fine)
    order = np.lexsort((row, chunk, own))
    h, row, chunk, own = h[order], row[order], chunk[order], own[order]
    starts, out = C.group_starts(own), []
    for a, b in zip(starts, np.append(starts[1:], len(own))):
        c, r = chunk[a:b], row[a:b]
        at = np.flatnonzero(np.concatenate(([True], (c[1:] != c[:-1]) | (r[1:] != r[:-1]))))
        frag = (h[a:b] & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes()
        out.append((int(own[a]), None, *packed_places(c[at], r[at]), C.planes(np.diff(np.append(at, b - a)), 3), frag, None))
    return out


def _laid_together(fine: int, gathered: int):
    """Blobs of coarse ranges to fine ones, a bounded number of bytes at a time; heads pass on."""

    def run(batches):
        held, size = {}, 0
        for batch in batches:
            heads = []
            for part, chunk, frag, rows, counts, head in zip(*[c.to_pylist() for c in batch.columns]):
                if head is not None:
                    heads.append((part, chunk, None, None, None, None, None, head))
                    continue
                held.setdefault(part, []).append((chunk, frag, rows, counts))
                size += len(frag) + len(rows) + len(counts)
                if size > gathered:
                    for own in held.values():
                        yield from _batches(_split(own, fine), True)
                    held, size = {}, 0
            yield from _batches(heads, True)
        for own in held.values():
            yield from _batches(_split(own, fine), True)
        C.release()

    return run


def _marked_together(shards: int):
    """One fine range: how many hashes of each document some other document has too, by shard of chunks."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        heads, blobs = pdf[pdf["head"].notna()], pdf[pdf["head"].isna()]
        out = [(p, c, None, None, None, None, x) for p, c, x in zip(heads["part"], heads["chunk"], heads["head"])]
        if len(blobs):
            places = [unpacked_places(*x) for x in blobs[["chunks", "sizes", "rows"]].itertuples(index=False)]
            chunk, row = np.concatenate([x[0] for x in places]), np.concatenate([x[1] for x in places])
            n = np.concatenate([C.unplanes(x, len(x) // 3, 3).astype(np.int64) for x in blobs["counts"]])
            every = np.concatenate([np.frombuffer(x, "<u4") for x in blobs["frag"]])
            order = np.argsort(every, kind="stable")
            starts = C.group_starts(every[order])
            size = np.diff(np.append(starts, len(every)))
            whose = np.repeat(np.arange(len(n)), n)
            count = np.bincount(whose[order[np.repeat(size > 1, size)]], minlength=len(n))
            some = count > 0
            out += _replies(chunk[some], row[some], count[some], shards)
        return pd.DataFrame(out, columns=[x.split()[0] for x in REPLY.split(", ")]).astype({"chunk": "Int64"})

    return run


def _replies_together(shards: int, gathered: int):
    """Replies to coarse shards of chunks, added up by fine shard; heads pass on."""

    def run(batches):
        held, size = [], 0

        def added():
            if not held:
                return
            places = [unpacked_places(*x[:3]) for x in held]
            count = np.concatenate([C.unplanes(x[3], len(x[3]) // 4, 4).astype(np.int64) for x in held])
            yield from _batches(_replies(np.concatenate([x[0] for x in places]), np.concatenate([x[1] for x in places]), count, shards), False)

        for batch in batches:
            heads = []
            for part, chunk, *blob, head in zip(*[c.to_pylist() for c in batch.columns]):
                if head is not None:
                    heads.append((part, chunk, *blob, head))
                    continue
                held.append(blob)
                size += sum(map(len, blob))
                if size > gathered:
                    yield from added()
                    held, size = [], 0
            yield from _batches(heads, False)
        yield from added()
        C.release()

    return run


def _settled_together(pdf: pd.DataFrame) -> pd.DataFrame:
    """One fine shard of chunks: their documents, and whether enough of their shingles are shared."""
    heads, blobs = pdf[pdf["head"].notna()], pdf[pdf["head"].isna()]
    places = [unpacked_places(*x) for x in blobs[["chunks", "sizes", "rows"]].itertuples(index=False)]
    chunk = np.concatenate([np.zeros(0, np.int64), *[x[0] for x in places]])
    row = np.concatenate([np.zeros(0, np.int64), *[x[1] for x in places]])
    count = np.concatenate([np.zeros(0, np.int64), *[C.unplanes(x, len(x) // 4, 4).astype(np.int64) for x in blobs["counts"]]])
    out = []
    for own, head in zip(heads["chunk"], heads["head"]):
        shared = np.bincount(row[chunk == own], weights=count[chunk == own], minlength=len(head) // 40)
        out.append(_documents(head, shared))
    return pd.concat(out, ignore_index=True)


def settled(docs: DataFrame, ranges: int, gathered: int = GATHERED) -> DataFrame:
    """Step 1: ``doc_id, n_shingles``, the set's keys, and whether it may link at all."""
    coarse, fine = nested(ranges)
    if fine > coarse:
        laid = docs.select("doc_id", "text").mapInArrow(_spread(coarse, fine), PACKED).repartition(coarse, "part").mapInArrow(_laid_together(fine, gathered), GATHERING)
        replies = laid.groupBy("part").applyInPandas(_marked_together(coarse), REPLY)
        return replies.repartition(coarse, "part").mapInArrow(_replies_together(fine, gathered), REPLY).groupBy("part").applyInPandas(_settled_together, DOCS)
    return (
        docs.select("doc_id", "text")
        .mapInArrow(_spread(ranges), PACKED)
        .groupBy("part")
        .applyInPandas(_marked, "chunk long, rows binary, counts binary, head binary")
        .groupBy("chunk")
        .applyInPandas(_settled, DOCS)
    )


def _with_sets(batches):
    for batch in C.chunks(batches, "text"):
        h, bounds = shingle_sets(batch.column("text"))
        k1, k2 = set_keys(h, bounds)
        same = (k1 == batch.column("k1").to_numpy()) & (k2 == batch.column("k2").to_numpy())
        sets = pa.array([h[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(bounds)), sets], names=["doc_id", "n", "set"]).filter(pa.array(same))


def _tokens(batches):
    for batch in batches:
        for i, n, own in zip(batch.column("doc_id").to_pylist(), batch.column("n").to_pylist(), batch.column("set")):
            h = np.frombuffer(own.as_buffer(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), i)), pa.array(np.full(len(h), n)), pa.array(h)], names=["doc_id", "n", "h"])


def prefixes(sets: DataFrame) -> DataFrame:
    """Step 2: ``doc_id, h, df``, the prefix shingles that other documents have too."""
    tokens = sets.mapInArrow(_tokens, "doc_id long, n long, h long")
    shared = tokens.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    # unshared shingles are the rarest of all: they use up the prefix first
    room = F.col("n") - F.ceil(F.col("n") * PERCENT / F.lit(100)) + 1 - (F.col("n") - F.size("own"))
    return (
        tokens.join(shared, "h")
        .groupBy("doc_id", "n")
        .agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("own"))
        .withColumn("room", room.cast("int"))
        .where("room > 0")
        .select("doc_id", F.explode(F.slice("own", F.lit(1), F.col("room"))).alias("x"))
        .select("doc_id", F.col("x")["h"].alias("h"), F.col("x")["df"].alias("df"))
    )


def candidates(prefix: DataFrame) -> DataFrame:
    """``doc_id, root`` of the components of documents that share a prefix shingle."""
    least = prefix.groupBy("h").agg(F.min("doc_id").alias("least"), F.count("*").alias("c")).where("c > 1")
    met = components(prefix.join(least, "h").where("doc_id <> least").select("doc_id", "least"), "doc_id", "least")
    return met.select(F.col("node").alias("doc_id"), "root")


class Joined:
    """Union-find over places 0..n-1."""

    def __init__(self, labels: np.ndarray):
        _, first, back = np.unique(labels, return_index=True, return_inverse=True)
        self.up = first[back].astype(np.int64)
        self.roots = self.up.copy()

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = int(self.up[i])
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i == j:
            return False
        i, j = min(i, j), max(i, j)
        self.roots[self.roots == j] = i
        self.up[j] = i
        return True


def t_occurrence(sets: list[np.ndarray], labels: np.ndarray) -> list[tuple[int, int]]:
    """Links that span the components of these sets; equal labels count as linked already.

    Queries go by size, each against the sets before it, which the inverted
    lists hold in that order; ``have`` says how much of each list is filled.
    """
    order = np.argsort([len(s) for s in sets], kind="stable")
    size = np.array([len(sets[i]) for i in order], np.int64)
    tokens, code = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    rank = np.repeat(np.arange(len(order)), size)
    by = np.argsort(code, kind="stable")
    lists, first = rank[by].astype(np.uint16 if len(order) < 1 << 16 else np.int64), np.searchsorted(code[by], np.arange(len(tokens) + 1))
    ends = np.cumsum(size)
    joined = Joined(np.asarray(labels)[order])
    df, have = np.diff(first), np.zeros(len(tokens), np.int64)
    links = []
    for q in range(len(order)):
        own = code[ends[q] - size[q] : ends[q]]
        low = int(np.searchsorted(size, needed(int(size[q]))))
        if low < q and not (joined.roots[low:q] == joined.roots[q]).all():
            own = own[np.argsort(df[own], kind="stable")]
            for c in _linked(q, low, own, lists, first, have, size, joined):
                links.append((int(order[q]), int(order[c])))
        have[own] += 1
    return links


def _linked(q: int, low: int, own: np.ndarray, lists: np.ndarray, first: np.ndarray, have: np.ndarray, size: np.ndarray, joined: Joined, mu: float = 0.01):
    """The sets from ``low`` that link to set q and were not linked to it through others."""
    t = needed(int(size[q]))
    begin, end = first[own], first[own] + have[own]
    aside = min(t - 1, int(t / (mu * math.log2(int(have[own].max()) + 1) + 1)))
    cut = len(own) - aside
    short = [lists[a:b] for a, b in zip(begin[:cut].tolist(), end[:cut].tolist()) if b > a]
    if not short:
        return
    found, total = merged(short, low)
    use = (total >= t - aside) & (joined.roots[found] != joined.roots[q])
    found, total = found[use], total[use]
    long = [lists[a:b] for a, b in zip(begin[cut:].tolist(), end[cut:].tolist()) if b > a]
    # the first one mostly links, and then few others are left that are not linked through it
    for a, b in ((0, 1), (1, len(found))):
        some = np.arange(a, min(b, len(found)))
        some = some[joined.roots[found[some]] != joined.roots[q]]
        if not len(some):
            continue
        c, count = found[some], total[some]
        for one in long:
            at = np.searchsorted(one, c)
            count = count + (one[np.minimum(at, len(one) - 1)] == c)
        for k in c[count >= needed_pair(size[q], size[c])].tolist():
            if joined.join(q, k):
                yield k


def merged(short: list[np.ndarray], low: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted lists merged by a heap of list heads: the sets from ``low`` on, and in how many lists each is."""
    every = np.fromiter(heapq.merge(*[memoryview(x)[int(np.searchsorted(x, low)) :] for x in short]), np.int64)
    starts = C.group_starts(every)
    return every[starts], np.diff(np.append(starts, len(every)))


def _search(pdf: pd.DataFrame) -> pd.DataFrame:
    """One task: the spanning links of its documents."""
    ids = pdf["doc_id"].to_numpy()
    links = t_occurrence([np.frombuffer(x, np.uint64) for x in pdf["set"]], pdf["label"].to_numpy())
    return pd.DataFrame({"a": [ids[i] for i, _ in links], "b": [ids[j] for _, j in links]}, dtype=np.int64)


def _against_leader(batches):
    for batch in batches:
        out = []
        for i, own, j, other in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "set", "leader", "leader_set")]):
            x, y = np.frombuffer(own, np.uint64), np.frombuffer(other, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            if i != j and 100 * both >= PERCENT * (len(x) + len(y) - both):
                out.append((i, j))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])


def _by_component(sets: DataFrame, roots: DataFrame, block_docs: int, block_shingles: int) -> tuple[DataFrame, DataFrame]:
    """The links within components that one task can hold, and the sets of the larger components."""
    grouped = sets.join(roots, "doc_id")
    sizes = grouped.groupBy("root").agg(F.count("*").alias("c"), F.sum("n").alias("mass")).where("c > 1")
    sizes = C.stored(sizes.withColumn("large", (F.col("c") > block_docs) | (F.col("mass") > block_shingles)), "sizes")
    found = grouped.join(sizes.where("not large").select("root"), "root").groupBy("root").applyInPandas(_search, LINK)
    return found, grouped.join(sizes.where("large").select("root"), "root")


def band_of(n: Column) -> Column:
    """Sets that link lie in one size band or in neighbouring ones."""
    return F.floor(F.log(n) / math.log(100 / PERCENT) + 1e-9)


def _blocks(block_docs: int, block_shingles: int) -> Column:
    return F.ceil(F.greatest(F.count("*") / block_docs, F.sum("n") / block_shingles)).cast("int")


def in_blocks(sets: DataFrame, block_docs: int = BLOCK_DOCS, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """``doc_id, set, label, task``: of each ``root``, the largest label meets the others, and these meet all, in blocks of near sizes.

    The task is one column, so that it gets an exchange of its own.
    """
    labels = sets.groupBy("root", "label").agg(F.count("*").alias("c"))
    main = labels.groupBy("root").agg(F.max_by("label", F.struct("c", "label")).alias("main"))
    placed = sets.join(main, "root").withColumn("rest", F.col("label") != F.col("main")).withColumn("band", band_of(F.col("n")))
    cells = placed.groupBy("root", "band", "rest").agg(_blocks(block_docs, block_shingles).alias("blocks"))
    every = cells.groupBy("root").agg(F.collect_list(F.struct("band", "rest", "blocks")).alias("cells"))  # two of each size band
    own = placed.join(cells, ["root", "band", "rest"]).join(every, "root")
    name = lambda band, rest, k: F.concat_ws("-", band, rest.cast("int"), k)
    mine = name(F.col("band"), F.col("rest"), F.pmod(F.xxhash64("doc_id"), F.col("blocks")))
    met = F.filter("cells", lambda x: (F.abs(x["band"] - F.col("band")) <= 1) & (x["rest"] | F.col("rest")))
    names = F.flatten(F.transform(met, lambda x: F.transform(F.sequence(F.lit(0), x["blocks"] - 1), lambda k: name(x["band"], x["rest"], k))))
    own = own.withColumn("mine", mine).withColumn("name", F.explode(names))
    return own.select("doc_id", "set", "label", F.concat_ws("/", "root", F.least("mine", "name"), F.greatest("mine", "name")).alias("task"))


def by_shingle(sets: DataFrame, prefix: DataFrame, block_docs: int = BLOCK_DOCS, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """``doc_id, set, label, task``: each document once for every prefix shingle and neighbouring size, in blocks.

    Sets that link both lie in the tasks of the smaller one's size band.
    """
    band = band_of(F.col("n"))
    rows = prefix.select("doc_id", "h").join(sets, "doc_id").select("doc_id", "n", "label", "h", F.explode(F.array(band, band - 1)).alias("band"))
    groups = rows.groupBy("h", "band").agg(_blocks(block_docs, block_shingles).alias("blocks"), F.min("label").alias("one"), F.max("label").alias("two")).where("one <> two")
    placed = rows.join(groups.select("h", "band", "blocks"), ["h", "band"]).withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.concat_ws("-", "h", "band", F.least(j, "block"), F.greatest(j, "block")))
    return placed.select("doc_id", F.explode(pairs).alias("task")).join(sets.select("doc_id", "set", "label"), "doc_id")


def _cheaper_by_shingle(still: DataFrame, rest: DataFrame, block_docs: int, block_shingles: int) -> DataFrame:
    """``root, loose``: whether the lists of a component's shingles make fewer block pairs than the component does."""
    whole = still.groupBy("root").agg(_blocks(block_docs, block_shingles).alias("blocks"))
    lists = rest.select("doc_id", "h").join(still.select("doc_id", "root", "n"), "doc_id").groupBy("root", "h").agg(_blocks(block_docs, block_shingles).alias("b"))
    tasks = lists.groupBy("root").agg(F.sum(F.col("b").cast("double") * F.col("b")).alias("tasks"))
    return whole.join(tasks, "root").select("root", (F.col("tasks") < F.col("blocks").cast("double") * F.col("blocks")).alias("loose"))


LINK = "a long, b long"


def links(sets: DataFrame, prefix: DataFrame, block_docs: int = BLOCK_DOCS, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """Steps 3 and 4: ``a, b`` links that span the components of ``doc_id, n, set``."""
    found, large = _by_component(sets.withColumn("label", F.col("doc_id")), candidates(prefix), block_docs, block_shingles)
    large = C.stored(large, "large")
    if not large.limit(1).count():
        return found
    # a text that others were made from has shingles that many have
    typical = prefix.groupBy("doc_id").agg(F.avg("df").alias("df"))
    seeds = [F.max_by(F.struct("doc_id", "set"), F.struct("df", "doc_id")), *[F.min_by(F.struct("doc_id", "set"), F.xxhash64("doc_id", F.lit(k))) for k in range(2)]]
    leaders = C.stored(large.join(typical, "doc_id", "left").groupBy("root").agg(F.array_distinct(F.array(*seeds)).alias("x")).select("root", F.explode("x").alias("x")).select("root", F.col("x")["doc_id"].alias("leader"), F.col("x")["set"].alias("leader_set")), "leaders")
    near = C.stored(large.join(leaders, "root").select("doc_id", "set", "leader", "leader_set").mapInArrow(_against_leader, LINK), "near")
    # a document goes by the least leader that those it links to go by, and a leader by the least it links to or itself
    of_leader = near.join(leaders.select(F.col("leader").alias("a")).distinct(), "a").groupBy(F.col("a").alias("b")).agg(F.min("b").alias("other")).select("b", F.least("b", "other").alias("goes_by"))
    least = near.join(of_leader, "b", "left").groupBy(F.col("a").alias("doc_id")).agg(F.min(F.coalesce("goes_by", "b")).alias("label"))
    own = C.stored(large.drop("label").join(least, "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id")), "labelled")
    # only where a shingle's documents do not all go by one can a link be missing
    named = prefix.select("doc_id", "h").join(own.select("doc_id", "label"), "doc_id")
    apart = named.groupBy("h").agg(F.min("label").alias("one"), F.max("label").alias("two")).where("one <> two").select("h")
    rest = C.stored(named.select("doc_id", "h").join(apart, "h"), "rest")
    again, still = _by_component(own.drop("root"), own.select("doc_id", "root").join(rest.select("doc_id").distinct(), "doc_id"), block_docs, block_shingles)
    still = C.stored(still, "still")
    out = found.unionByName(near).unionByName(again)
    if not still.limit(1).count():
        return out
    loose = C.stored(_cheaper_by_shingle(still, rest, block_docs, block_shingles), "loose")
    dense = in_blocks(still.join(loose.where("not loose").select("root"), "root"), block_docs, block_shingles)
    out = out.unionByName(dense.groupBy("task").applyInPandas(_search, LINK))
    if not loose.where("loose").limit(1).count():
        return out
    chained = still.join(loose.where("loose").select("root"), "root").select("doc_id", "n", "set", "label")
    return out.unionByName(by_shingle(chained, rest, block_docs, block_shingles).groupBy("task").applyInPandas(_search, LINK))


def link(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block_docs: int = BLOCK_DOCS, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    ranges = C.hash_ranges(rows, "text")
    known = C.stored(settled(rows, ranges), "settled")
    keys = ["k1", "k2", "n_shingles"]
    classes = C.stored(known.where("doc_id is not null and n_shingles > 0").groupBy(*keys).agg(F.min("doc_id").alias("rep"), F.max("alive").alias("alive")), "classes")
    wanted = classes.where("alive").select(F.col("rep").alias("doc_id"), "k1", "k2")
    sets = C.stored(rows.join(wanted, "doc_id").mapInArrow(_with_sets, "doc_id long, n long, set binary"), "sets")
    roots = components(links(sets, C.stored(prefixes(sets), "prefix"), block_docs, block_shingles), "a", "b")
    named = classes.join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left").select(*keys, F.coalesce("root", "rep").alias("__root"))
    return known.join(named, keys, "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("__root", "doc_id")).alias("component_id"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return link(C.table(spark, sf_dir, "documents"))


QUERIES = {"op2_jaccard_join": op2_jaccard_join}
ORACLES = {
    "op2_jaccard_join": r"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws
  from documents
), s as (
  select distinct doc_id, unnest(case when len(ws) = 0 then []::varchar[] when len(ws) < 5 then [array_to_string(ws, ' ')]
    else list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) end) as g
  from w
), n as (
  select w.doc_id, count(g) as n from w left join s using (doc_id) group by 1
), shared as (
  select * from s where g in (select g from s group by g having count(*) > 1)
), p as (
  select a.doc_id as a, b.doc_id as b, count(*) as o from shared a join shared b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2
), e as (
  select a, b from p join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * o >= 75 * (na.n + nb.n - o)
), reach as (
  select doc_id as a, doc_id as b from documents
  union
  select reach.a, e.b from reach join e on reach.b = e.a
)
select n.doc_id, n.n as n_shingles, min(reach.b) as component_id
from n join reach on reach.a = n.doc_id group by 1, 2
"""
}
