import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from varioflow.llm import run_detection as R

from .helpers import DOCS, ODD, docs, words


def brute(ws, least=6, exponent=4):
    """Every maximal stretch, by all periods."""
    found, seen = [], set()
    for q in range(1, len(ws) // exponent + 1):
        i = 0
        while i + q < len(ws):
            j = i
            while j + q < len(ws) and ws[j] == ws[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, exponent * q) and (i, j + q) not in seen:
                seen.add((i, j + q))
                found.append((i, j + q - i, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def caught(texts, **more):
    names = {}
    code = np.array([names.setdefault(w, len(names)) for t in texts for w in t], np.int64)
    bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    s, e, q = R.runs(code, bounds, **more)
    return [[(int(a - bounds[k]), int(b - a), int(p)) for a, b, p in zip(s, e, q) if bounds[k] <= a < bounds[k + 1]] for k in range(len(texts))]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=90), max_size=4))
def test_two_words(texts):
    assert caught(texts) == [brute(t) for t in texts]


@st.composite
def nested(draw):
    """Powers of powers with single faults, so that periodic blocks stand in runs of larger periods."""
    unit = draw(st.lists(st.sampled_from("abc"), min_size=1, max_size=3))
    for _ in range(draw(st.integers(1, 3))):
        unit = unit * draw(st.integers(1, 9)) + draw(st.lists(st.sampled_from("abc"), max_size=2))
    unit = unit[:200]
    text = draw(st.lists(st.sampled_from("ab"), max_size=5)) + unit * draw(st.integers(1, 7))
    if text and draw(st.booleans()):
        text[draw(st.integers(0, len(text) - 1))] = "d"
    return text + unit[: draw(st.integers(0, len(unit)))]


@settings(max_examples=400, deadline=None)
@given(nested())
def test_powers_of_powers(text):
    assert caught([text]) == [brute(text)]


@settings(max_examples=60, deadline=None)
@given(nested(), st.integers(0, 300))
def test_a_prefix_has_the_runs_seen_so_far(text, n):
    assert caught([text[:n]]) == [brute(text[:n])]


def test_options_and_limits():
    text = list("xabcabcabcabcabcy")
    assert caught([text]) == [[(1, 15, 3)]]
    assert caught([text], min_length=16) == [[]]
    assert caught([text], min_exponent=6) == [[]]
    with pytest.raises(ValueError):
        caught([text], min_exponent=3)


def test_long_repetitions_take_linear_time():
    one = ["a"] * 200_000
    assert caught([one]) == [[(0, 200_000, 1)]]
    many = (["a"] * 60 + ["b"]) * 3000
    assert caught([many]) == [sorted([(0, 183_000, 61)] + [(61 * k, 60, 1) for k in range(3000)], key=lambda r: (r[0], r[2]))]


def test_rows(spark):
    rows = ODD + [(20, "x " + "u v w " * 5 + "y y y y y y y z", "en"), (20, "x " + "u v w " * 5 + "y y y y y y y z", "en")]
    got = R.detect(docs(spark, rows).repartition(3))
    expected = []
    for i, t, _ in rows:
        ws = words(t)
        found = brute(ws)
        gone = {k for s, n, q in found for k in range(s + q, s + n)}
        expected.append((i, len(ws), found, " ".join(w for k, w in enumerate(ws) if k not in gone)))
    assert sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got.collect()), key=str) == sorted(expected, key=str)
    assert R.run_rows(got).where("doc_id = 20").count() == 4
    assert R.detect(docs(spark, [])).collect() == []


def digest(i, t):
    ws = words(t)
    n, h = len(ws), zlib.crc32(str(i).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        ws = [ws[k] if k < a else ws[a + (k - a) % p] for k in range(n)]
    found = brute(ws)
    s, m, q = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    gone = {k for a, b, c in found for k in range(a + c, a + b)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (i, len(found), s, m, q, None if q is None else 1000 * m // q, sha("".join(f"{a},{b},{c}\n" for a, b, c in found)), sha(" ".join(w for k, w in enumerate(ws) if k not in gone)))


def test_query_against_brute_force(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, rng.choice(["", " "]) + " ".join(rng.choice(["a", "b", "é,"]) for _ in range(rng.randrange(0, 60))), "en") for i in range(400)]
    rows += [(1000, None, "en"), (1001, "", None)]
    spark.createDataFrame([(i, t, k, "s", 1, 0.5, 1, 2) for i, t, k in rows], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = R.op13_periodic_runs(spark, str(tmp_path))
    assert sorted(tuple(r) for r in got.collect()) == sorted(digest(i, t) for i, t, _ in rows)
