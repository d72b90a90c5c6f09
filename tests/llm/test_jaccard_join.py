import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from varioflow.llm import jaccard_join as J
from varioflow.llm import substring_dedup as S
from varioflow.llm.components import components

from .helpers import ODD, docs, words


def shingles(text):
    ws = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(ws[k : k + 5]) for k in range(max(1, len(ws) - 4))} if ws else set()


def brute(rows):
    sets = [(i, shingles(t)) for i, t, _ in rows]
    comp = {i: i for i, _ in sets if i is not None}
    find = lambda i: i if comp[i] == i else find(comp[i])
    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if i is not None and j is not None and x and y and 100 * len(x & y) >= 75 * len(x | y):
                lo, hi = sorted((find(i), find(j)))
                comp[hi] = lo
    return sorted(((i, len(x), None if i is None else find(i)) for i, x in sets), key=str)


def corpus(seed, n=150):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 5)))
    hot = [word() for _ in range(40)]
    bases = [[word() for _ in range(rng.randrange(3, 120))] for _ in range(8)] + [[word() for _ in range(80)]] * 8
    rows = []
    for i in range(n):
        ws = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 2, 3, 5, 8])):
            ws[rng.randrange(len(ws))] = word()
        if rng.random() < 0.3:
            ws += hot
        rows.append((i * 7 % n + 20, " ".join(ws).title() if rng.random() < 0.5 else " ".join(ws), "en"))
    return rows


@pytest.mark.parametrize("seed,block", [(1, 512), (2, 20), (3, 3)])
def test_against_all_pairs(spark, seed, block):
    rows = corpus(seed) + ODD
    got = J.link(docs(spark, rows).repartition(3), block_docs=block)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def test_boundary_of_the_threshold(spark):
    ws = [f"w{k}" for k in range(400)]
    rows = [(1, " ".join(ws[:32]), "")]
    for i, shared in ((2, 26), (3, 25)):  # 24 of 28+4+4.. shingles in common, just above and below
        rows.append((i, " ".join(ws[:shared] + ws[100 + 40 * i : 100 + 40 * i + 32 - shared]), ""))
    got = {r.doc_id: r.component_id for r in J.link(docs(spark, rows)).collect()}
    assert got == {r[0]: r[2] for r in brute(rows)}


def test_null_id_copy_before_the_valid_one(spark):
    base = " ".join(f"w{k}" for k in range(60))
    rows = [(None, base, "en"), (8, base, "en"), (9, base + " x", "en"), (3, "other words of one more text", "en")]
    table = docs(spark, rows[:2]).coalesce(1).unionByName(docs(spark, rows[2:]).coalesce(1))  # copies in one chunk, the near copy in another partition
    assert sorted((tuple(r) for r in J.link(table).collect()), key=str) == brute(rows)


def test_empty_table(spark):
    assert J.link(docs(spark, [])).collect() == []


def test_components(spark):
    rng = np.random.RandomState(0)
    edges = [(k, k + 1) for k in range(100, 160)] + [tuple(map(int, x)) for x in rng.randint(0, 90, (60, 2))]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    best = {n: n for e in edges for n in e}
    for _ in range(200):
        for a, b in edges:
            best[a] = best[b] = min(best[a], best[b])
    assert got == {n: r for n, r in best.items() if any(n in e and e[0] != e[1] for e in edges)}


def test_a_giant_component_is_split_by_shingle_not_by_component(spark):
    """A chain of texts, each sharing a line with the next: one component of many blocks."""
    rows = [(k, " ".join(f"a{k}w{j}" for j in range(6)) + " " + " ".join(f"a{k + 1}w{j}" for j in range(6)), "en") for k in range(60)]
    rows += [(100 + k, r[1] + f" end{k}", "en") for k, r in enumerate(rows[:30])]
    got = J.link(docs(spark, rows), block_docs=4).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)
    sets = spark.createDataFrame([(k, 40 + k % 5, bytearray(8), k) for k in range(200)], "doc_id long, n long, set binary, label long")
    prefix = spark.createDataFrame([(k, h) for k in range(200) for h in (k // 2, 1000)], "doc_id long, h long")
    tasks = J.by_shingle(sets, prefix, block_docs=16)
    plan = tasks.groupBy("task").applyInPandas(J._search, J.LINK)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(task" in plan
    largest = tasks.groupBy("task").count().agg({"count": "max"}).first()[0]
    assert largest < 64


def test_more_ranges_than_blobs_of_a_chunk(spark, monkeypatch):
    rows = corpus(5) + ODD
    df = docs(spark, rows).repartition(6)
    key = lambda found: sorted((tuple(r) for r in found.collect()), key=str)
    plain = key(J.settled(df, 64))
    monkeypatch.setattr(S, "COARSE", 256)
    assert any(r[4] for r in plain) and not all(r[4] for r in plain)
    assert key(J.settled(df, 1000, gathered=2000)) == plain
    assert J.settled(docs(spark, []), 1000).collect() == []
    monkeypatch.setattr(J.C, "hash_ranges", lambda *_: 1000)
    assert key(J.link(df)) == brute(rows)


def test_blobs_of_a_chunk_are_bounded(monkeypatch):
    class Task:
        get = staticmethod(lambda: Task)
        partitionId = staticmethod(lambda: 3)

    monkeypatch.setattr(J, "TaskContext", Task)
    rng = random.Random(1)
    texts = [" ".join(str(rng.randrange(10**9)) for _ in range(2000)) for _ in range(40)]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(40), pa.int64()), "text": texts})
    coarse, fine = S.nested(1_000_000)
    blobs = sum(b.num_rows for b in J._spread(coarse, fine)([batch]))
    assert fine >= 1_000_000 and 1000 < blobs <= S.COARSE + 1


@pytest.mark.parametrize("kind", [np.uint16, np.int64])
def test_lists_are_merged_in_order(kind):
    rng = np.random.RandomState(4)
    for n in (1, 3, 40):
        short = [np.unique(rng.randint(0, 60, rng.randint(1, 50))).astype(kind) for _ in range(n)]
        found, total = J.merged(short, 7)
        want = Counter(int(k) for x in short for k in x if k >= 7)
        assert found.tolist() == sorted(want) and total.tolist() == [want[k] for k in sorted(want)]
    assert J.merged([np.array([1, 2], kind)], 7)[0].tolist() == []
