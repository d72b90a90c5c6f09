import random
import re
import time

import pyarrow as pa

from varioflow.llm import decontamination as D

from .helpers import ODD, docs


def fold(text):
    return re.sub(r"[\W_]+", " ", (text or "").lower()).strip()


def distance(item, text):
    """Fewest edits between the item and any part of the text, by the full table."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def edited(text, n, rng):
    out = list(text)
    for _ in range(n):
        k = rng.randrange(len(out))
        how = rng.randrange(3)
        if how == 0:
            out[k] = rng.choice("xyz")
        elif how == 1:
            out.insert(k, rng.choice("xyz"))
        elif len(out) > 1:
            del out[k]
    return "".join(out)


def test_against_full_alignment(spark):
    rng = random.Random(3)
    make = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    items = [(k, make(rng.randrange(6, 40))) for k in range(12)] + [(50, None), (51, "tiny"), (52, "")]
    rows = []
    for k in range(80):
        text = make(30)
        if k % 2:
            text += " " + edited(rng.choice(items[:12])[1], rng.randrange(0, 14), rng).upper() + ", " + make(rng.randrange(0, 9))
        rows.append((k, text, "en"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (10**9, 100):
        got = {(r.doc_id, r.item_id): r.edits for r in D.matches(docs(spark, rows + [(1000 + (i or 0), t, k) for i, t, k in ODD]), bench, block_chars=block).collect()}
        want = {}
        for i, text, _ in rows:
            for k, item in items[:12]:
                m = len(fold(item))
                e = min(int(m * D.EDIT_RATE), (m - D.Q) // D.Q)
                d = distance(fold(item), fold(text))
                if d <= e:
                    want[i, k] = d
        assert len(want) > 10 and got == want


def test_place_in_the_original_text():
    item = "alpha beta gamma delta epsilon zeta eta theta"
    text = "¿Hello?  ALPHA,beta -- gamma delta\nepsilon zeta eta theta! bye"
    [(row, k, start, end, edits)] = D.Matcher([(7, item)]).find(pa.array(["", text]))
    assert (row, k, edits) == (1, 0, 0) and text[start:end] == text[text.index("ALPHA") : text.index("! bye")]


def test_clean_keeps_rows_and_columns(spark):
    table = docs(spark, [*ODD, (77, "x " + "quick brown foxes jump over many lazy dogs today " + "y", "en")])
    bench = spark.createDataFrame([(1, "Quick brown foxes; jump over many lazy dogs today")], "item_id long, text string")
    kept = D.clean(table, bench)
    assert kept.columns == table.columns and kept.count() == len(ODD)
    assert [r.doc_id for r in D.matches(table, bench).collect()] == [77]
    assert D.matches(docs(spark, []), bench).count() == 0
    assert D.clean(table, bench.limit(0)).count() == len(ODD) + 1


STEM = "which of the following is true about topic number "


def test_many_items_with_one_stem_cost_little():
    """Grams that thousands of items share are probed, not expanded into an alignment each."""
    own = D.Matcher([(k, STEM + f"{k * 7919 % 100000:05d} and its neighbour {k:04d}") for k in range(4000)])
    for text in (STEM[:36], "we ask " + STEM + "of this kind, as any student of the subject should know by heart, before the next examination begins"):
        own.find(pa.array([text]))
        began = time.process_time()
        assert own.find(pa.array([text])) == []
        assert time.process_time() - began < 1
    hit = own.find(pa.array(["so: " + STEM + "07919 and its neighbour 0001?"]))
    assert (0, 1, 0) in [(r, i, d) for r, i, _, _, d in hit]


def test_items_shorter_than_a_gram_stand_as_words():
    own = D.Matcher([(1, "Paris!"), (2, "x y"), (3, "東京"), (4, "!!"), (5, "paris")])
    texts = ["in PARIS, then", "parish", "paris", "x  Y z", "xx y", "私は東京都に", None, "", "comparis paris"]
    got = {(r, own.ids[i]): (s, t) for r, i, s, t, d in own.find(pa.array(texts)) if d == 0}
    assert got == {(0, 1): (3, 8), (0, 5): (3, 8), (2, 1): (0, 5), (2, 5): (0, 5), (3, 2): (0, 4), (5, 3): (2, 4), (8, 1): (9, 14), (8, 5): (9, 14)}


def test_index_holds_few_grams():
    """The index has e + 1 grams an item, so its size follows the items and not their grams' spread."""
    own = D.Matcher([(k, STEM + "x" * (k % 50)) for k in range(1000)])
    assert len(own.item) == int((own.edits + 1).sum()) and own.grams.nbytes + own.points.nbytes < 2_000_000
