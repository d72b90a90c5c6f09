import random

import numpy as np
import pyarrow as pa
import pytest

from varioflow.llm import substring_dedup as S

from .helpers import ODD, docs, words


def brute(rows, k):
    least = {}
    for i, t, _ in rows:
        ws = words(t)
        for p in range(len(ws) - k + 1):
            if i is not None:
                least[tuple(ws[p : p + k])] = min(i, least.get(tuple(ws[p : p + k]), i))
    out = []
    for i, t, _ in rows:
        ws = words(t)
        gone = {q for p in range(len(ws) - k + 1) if i is not None and least[tuple(ws[p : p + k])] < i for q in range(p, p + k)}
        out.append((i, len(ws), len(gone), " ".join(w for q, w in enumerate(ws) if q not in gone)))
    return sorted(out, key=str)


def table_of(seed):
    rng = random.Random(seed)
    hot = [rng.choice("abcdefgh") for _ in range(20)]
    rows = []
    for i in range(120):
        ws = [rng.choice(["x", "Y", "zé", "w,"]) + str(rng.randrange(5)) for _ in range(rng.randrange(0, 70))]
        if rng.random() < 0.5:
            ws[rng.randrange(len(ws) + 1) : 0] = hot[rng.randrange(5) :]
        if rows and rng.random() < 0.2:
            ws = words(rng.choice(rows)[1])[rng.randrange(4) :]
        rows.append((i * 37 % 120, rng.choice([" ", "\n", "\t "]).join(ws), "en"))
    return rows + [(i if i is None else 1000 + i, t, k) for i, t, k in ODD]


@pytest.mark.parametrize("seed,k", [(1, 3), (2, 13), (3, 13)])
def test_against_brute_force(spark, seed, k):
    rows = table_of(seed)
    got = S.remove_repeats(docs(spark, rows).repartition(5), k)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, k)


def test_empty_table(spark):
    assert S.remove_repeats(docs(spark, [])).collect() == []


def test_more_ranges_than_blobs_of_a_chunk(spark, monkeypatch):
    rows = table_of(4)
    df = docs(spark, rows).select("doc_id", "text").repartition(6)
    as_set = lambda found: {(r.doc_id, tuple(r.starts), tuple(r.ends)) for r in found.collect()}
    plain = as_set(S._intervals_of(df, 3, 64))
    monkeypatch.setattr(S, "COARSE", 256)
    assert S.nested(1000) == (256, 1024) and S.nested(256) == (256, 256)
    assert plain and as_set(S._intervals_of(df, 3, 1000, gathered=2000)) == plain


def test_blobs_of_a_chunk_are_bounded():
    rng = random.Random(1)
    texts = [" ".join(str(rng.randrange(10**9)) for _ in range(2000)) for _ in range(40)]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([1024 * k for k in range(40)], pa.int64()), "text": texts * 1})
    coarse, fine = S.nested(1_000_000)
    assert fine >= 1_000_000
    blobs = sum(b.num_rows for b in S._spread(13, coarse, coarse)([batch]))
    assert blobs <= S.COARSE + 40


def test_ids_in_steps_fill_all_shards():
    assert len(set(S.shard_of(np.arange(20_000, dtype=np.int64) * 1024, 400).tolist())) == 400
    fine = S.shard_of(np.arange(5000, dtype=np.int64), 4096)
    assert (fine // 16 == S.shard_of(np.arange(5000, dtype=np.int64), 256)).all()


def test_packed_places_come_back():
    rng = np.random.RandomState(2)
    for size in (0, 1, 500):
        doc = np.sort(rng.choice([-(2**62), -7, 0, 3, 2**33, 2**62], size)).astype(np.int64)
        at = rng.randint(0, 2**31, size).astype(np.int64)
        order = np.lexsort((at, doc))
        got = S.unpacked_places(*S.packed_places(doc[order], at[order]))
        assert (got[0] == doc[order]).all() and (got[1] == at[order]).all()
