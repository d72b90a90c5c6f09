import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from varioflow.llm import packing as P

from .helpers import ODD, docs

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(rows, packed, capacity):
    tokenizer = Tokenizer.from_file(PATH)
    want = []
    for i, text, _ in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        for k, s in enumerate(range(0, len(ids), capacity)):
            part = ids[s : s + capacity]
            want.append((i, k, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    got = [(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed]
    assert sorted(got, key=str) == sorted(want, key=str)
    bins = defaultdict(list)
    for r in packed:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        own.sort()
        assert own[0][0] == 0
        assert all(a[0] + a[1] == b[0] for a, b in zip(own, own[1:], strict=False))
        assert own[-1][0] + own[-1][1] <= capacity
    return len(bins), -(-sum(r.length for r in packed) // capacity)


@pytest.mark.parametrize("capacity", [7, 4096])
def test_pieces_and_bins(spark, capacity):
    rows = [*ODD, (8, "it's <|endoftext|> don't café  naïve  x", "en"), (9, "ABC,def!! 3/4 ŒUVRE İx", "fr")]
    check(rows, P.pack(docs(spark, rows).repartition(3), PATH, capacity).collect(), capacity)


def test_rounds_reach_nearly_the_bound(spark):
    rng = np.random.RandomState(1)
    rows = [(i, " ".join(["word"] * int(n)), "en") for i, n in enumerate(rng.randint(0, 300, 800))]
    used, bound = check(rows, P.pack(docs(spark, rows).repartition(16), PATH, 400, items_per_task=30).collect(), 400)
    assert used <= bound * 1.02 + 1


def test_empty_table(spark):
    assert P.pack(docs(spark, []), PATH).collect() == []


def test_word_cache_is_bounded():
    import pyarrow as pa

    tokens = P.WordTokens(PATH, max_words=5)
    for text in ("a b c d", "e f g h", "a b c d e f g h i"):
        ids, _ = tokens.texts(pa.array([text]))
        assert ids.tolist() == tokens.plain(text)


def test_another_vocabulary_encodes_whole_texts(spark):
    """One that keeps case and white space can't be taken word by word."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert P.WordTokens(PATH).by_word and not P.WordTokens(path).by_word
    rows = [(1, "Hello  World,\nhello again", "en"), (2, "", "en"), (3, None, "en")]
    got = {r.doc_id: r.ids_crc32 for r in P.pack(docs(spark, rows), path, 4096).collect()}
    plain = Tokenizer.from_file(path)
    assert got == {i: zlib.crc32(np.array([*plain.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()) for i, t, _ in rows}
