"""Best-fit packing of token pieces into fixed-length sequences.

Hierarchical residual packing: each input partition tokenises its documents and
packs their pieces best-fit, longest first.  Nearly full bins are final.  The
underfull ones become items of the next round, in which a fourth as many
partitions pack them again; the last round takes what is left apart.  A bin
holds at most ``capacity`` pieces, so an item stays bounded however often it is
merged; what moves between rounds is piece metadata, never tokens.

Defined results: a null text counts as empty and is one end-of-text token; an
empty table gives no rows; repeated rows are packed once each; a text of any
length is cut into pieces of ``capacity`` tokens, only the last shorter; other
columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

CAPACITY = 4096
END_ID = 1
PIECES = "array<struct<doc_id:bigint,piece:int,start:bigint,length:bigint,ids_crc32:bigint>>"


class WordTokens:
    """Token ids by distinct word.

    A vocabulary that drops white space and the case of ASCII letters and never
    merges across words gives a text its words' ids in turn.  Ids of words already
    met are kept in flat arrays, up to ``max_words``; a worker encodes a word once.
    A vocabulary that treats ``PROBE`` otherwise encodes each text whole.
    """

    PROBE = ("Hello", "WORLD,", "don't", "x1!", "ABC/def", "naïve")

    #: Split off the end of a word of letters, as the vocabulary's own rule does; no apostrophe.
    TAIL = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
    #: Letters that stay single letters however they are normalised.
    PLAIN = "^[a-zA-Z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+$"
    #: Never part of a word that goes through the joined path.
    SEPARATOR = "\ue000"

    def __init__(self, path: str, max_words: int = 1_000_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.max_words = max_words
        words = [self.plain(w) for w in self.PROBE]
        self.by_word = (
            self.plain("  " + "\n \t".join(self.PROBE) + " ") == [i for w in words for i in w]
            and words == [self.plain(w.lower()) for w in self.PROBE]
            and words[1] == self.plain("world") + self.plain(",")
        )
        self.clear()

    def clear(self):
        self.known = pa.array([], pa.string())
        self.ids = np.zeros(0, np.uint32)
        self.bounds = np.zeros(1, np.int64)

    def plain(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encoded(self, names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words one after another, and the words' offsets into them."""
        odd = pc.match_substring(names, self.SEPARATOR).to_numpy(zero_copy_only=False)
        if odd.any():
            each = [self.plain(w) for w in names.to_pylist()]
            bounds = np.concatenate(([0], np.cumsum([len(x) for x in each])))
            return np.array([i for x in each for i in x], np.uint32), bounds
        mark = np.array(self.plain(self.SEPARATOR), np.uint32)
        parts, counts, listed = [], [], names.to_pylist()
        for k in range(0, len(listed), 4096):
            some = listed[k : k + 4096]
            got = np.array(self.plain("".join(f"{w} {self.SEPARATOR} " for w in some)), np.uint32)
            n = len(mark)
            hit = np.ones(max(len(got) - n + 1, 0), bool)
            for j, m in enumerate(mark):
                hit &= got[j : len(hit) + j] == m
            ends = np.flatnonzero(hit)
            if len(ends) != len(some):
                raise ValueError("a word's ids can't be told apart")
            counts.append(np.diff(np.concatenate(([-n], ends))) - n)
            gone = np.zeros(len(got), bool)
            for j in range(n):
                gone[ends + j] = True
            parts.append(got[~gone])
        if not parts:
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        return np.concatenate(parts), np.concatenate(([0], np.cumsum(np.concatenate(counts))))

    def pieces(self, names: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Distinct pieces, and each word's core and tail among them; most tails are empty.

        Case goes first, as the vocabulary drops it, but not from words that may hold a special token.
        """
        names = pc.if_else(pc.match_substring(names, "<|"), names, pc.ascii_lower(names))
        core = pc.utf8_rtrim(names, characters=self.TAIL)
        cut = pc.and_(pc.match_substring_regex(core, self.PLAIN), pc.not_equal(pc.binary_length(core), pc.binary_length(names)))
        core = pc.if_else(cut, core, names)
        tails = pc.replace_substring_regex(names.filter(cut), r"^\pL+", "")
        tail = pc.replace_with_mask(pa.array([""] * len(names), pa.string()), cut, tails)
        coded = pc.dictionary_encode(pa.concat_arrays([core, tail]))
        at = coded.indices.to_numpy(zero_copy_only=False)
        return coded.dictionary, at[: len(names)], at[len(names) :]

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the rows' offsets into them."""
        if not self.by_word:
            each = [self.plain(t or "") for t in texts.to_pylist()]
            return np.array([i for x in each for i in x], np.uint32), np.concatenate(([0], np.cumsum([len(x) for x in each], dtype=np.int64)))
        flat, rows = C.words(texts)
        coded = pc.dictionary_encode(flat)
        if isinstance(coded, pa.ChunkedArray):
            coded = coded.combine_chunks()
        names, core, tail = self.pieces(coded.dictionary)
        word = coded.indices.to_numpy(zero_copy_only=False)
        place = np.stack((core[word], tail[word]), axis=1).reshape(-1)
        at = pc.fill_null(pc.index_in(names, value_set=self.known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.flatnonzero(at < 0)
        if len(new):
            if len(self.known) + len(new) > self.max_words and len(self.known):
                self.clear()
                return self.texts(texts)
            fresh = names.take(pa.array(new))
            ids, bounds = self.encoded(fresh)
            at[new] = len(self.known) + np.arange(len(new))
            self.known = pa.concat_arrays([self.known, fresh])
            self.bounds = np.concatenate((self.bounds, self.bounds[-1] + bounds[1:]))
            self.ids = np.concatenate((self.ids, ids))
        word = at[place]
        n = (self.bounds[1:] - self.bounds[:-1])[word]
        ends = np.concatenate(([0], np.cumsum(n)))
        out = self.ids[np.repeat(self.bounds[word] - ends[:-1], n) + np.arange(ends[-1])]
        return out, ends[2 * rows]


_TOKENS: dict[str, WordTokens] = {}


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Best-fit decreasing: each item goes to the fullest bin that still takes it."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []  # (free, bin), sorted
    for i in np.argsort(-sizes, kind="stable"):
        size = int(sizes[i])
        k = bisect_left(room, (size, -1))
        if k < len(room):
            free, b = room.pop(k)
            bins[b].append(int(i))
        else:
            free, b = capacity, len(bins)
            bins.append([int(i)])
        if free > size:
            insort(room, (free - size, b))
    return bins


def tokenised(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, full: float = 0.98, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Round 0: one row per local bin: ``used`` tokens, its ``pieces`` in order, ``round`` 0 or -1 if final."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def pack(batches):
        if tokenizer_path not in _TOKENS:
            _TOKENS[tokenizer_path] = WordTokens(tokenizer_path)
        tokens = _TOKENS[tokenizer_path]
        held = []
        for batch in C.chunks(batches, "text"):
            ids, rows = tokens.texts(batch.column("text"))
            raw = np.ascontiguousarray(ids.astype("<u4")).tobytes()
            end = END_ID.to_bytes(4, "little")
            for doc, a, b in zip(batch.column("doc_id").to_pylist(), rows[:-1].tolist(), rows[1:].tolist()):
                n = b - a + 1
                for k, s in enumerate(range(0, n, capacity)):
                    e = min(s + capacity, n)
                    own = raw[4 * (a + s) : 4 * (a + min(e, n - 1))]
                    held.append((doc, k, s, e - s, zlib.crc32(own + end if e == n else own)))
        yield from binned([[p] for p in held], capacity, full)

    return rows.mapInArrow(pack, f"final boolean, used bigint, pieces {PIECES}")


def binned(items: list[list[tuple]], capacity: int, full: float):
    """Best-fit the items (lists of pieces) and give the bins as Arrow batches."""
    sizes = np.array([sum(p[3] for p in x) for x in items], np.int64)
    bins = best_fit(sizes, capacity)
    for k in range(0, len(bins), 5000):
        some = bins[k : k + 5000]
        used = [int(sizes[b].sum()) for b in some]
        pieces = [[dict(zip(("doc_id", "piece", "start", "length", "ids_crc32"), p)) for i in b for p in items[i]] for b in some]
        kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]))
        yield pa.RecordBatch.from_arrays([pa.array([u >= full * capacity for u in used]), pa.array(used, pa.int64()), pa.array(pieces, kind)], names=["final", "used", "pieces"])


def _repack(capacity: int, full: float, apart: bool):
    """Bins as items; ``apart`` takes their pieces singly instead."""

    def pack(batches):
        items = [[tuple(p.values()) for p in x] for batch in batches for x in batch.column("pieces").to_pylist()]
        yield from binned([[p] for x in items for p in x] if apart else items, capacity, full)

    return pack


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, full: float = 0.98, fan_in: int = 4, items_per_task: int = 20_000, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Each round deals the underfull bins to a ``fan_in``-th of the last round's
    partitions, but never more than about ``items_per_task`` to one, and writes
    its bins to the shared folder.  The last round, which comes when one
    partition is left or whole bins hardly join any more, takes the bins apart.
    """
    bins = C.stored(tokenised(docs, tokenizer_path, capacity, full, doc_id, text), "bins")
    done, rest = bins.where("final"), bins.where("not final")
    left, parts = rest.count(), None
    apart = False
    while left > 1:
        parts = max(left // items_per_task + 1, (parts or bins.rdd.getNumPartitions()) // fan_in)
        apart = apart or parts == 1
        merged = C.stored(rest.repartition(parts).select("pieces").mapInArrow(_repack(capacity, full, apart), bins.schema), "bins")
        done, rest = done.unionByName(merged.where("final")), merged.where("not final")
        now = rest.count()
        if apart:
            break
        apart, left = now > 0.9 * left, now
    return placed(done.unionByName(rest))


def placed(bins: DataFrame) -> DataFrame:
    """Number the bins (they are stored, so the numbers hold) and lay each bin's pieces end to end."""
    numbered = bins.select(F.monotonically_increasing_id().alias("sequence_id"), "pieces")
    offsets = F.aggregate(
        "pieces",
        F.expr("cast(array() as array<bigint>)"),
        lambda acc, p: F.concat(acc, F.array(F.when(F.size(acc) > 0, acc[F.size(acc) - 1]).otherwise(F.lit(0).cast("long")) + p["length"])),
    )
    rows = numbered.select("sequence_id", F.posexplode(F.arrays_zip("pieces", offsets.alias("ends"))).alias("k", "x"))
    p = F.col("x")["pieces"]
    return rows.select(p["doc_id"].alias("doc_id"), p["piece"].alias("piece"), p["start"].alias("start"), p["length"].alias("length"), p["ids_crc32"].alias("ids_crc32"), "sequence_id", (F.col("x")["ends"] - p["length"]).alias("offset"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 tokens."""
    import public_tokenizers

    return pack(C.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op3_best_fit_packing": op3_best_fit_packing}
ORACLES: dict[str, str] = {}
