import math
import random
from collections import Counter

import pyarrow as pa

from varioflow.llm import quality_rules as Q
from varioflow.llm import text_stats

from .helpers import ODD, docs, words


def brute(text):
    ws = words(text)
    windows = Counter(zip(ws, ws[1:], ws[2:]))
    lines = [x for x in (text or "").split("\n") if words(x)]
    covered = {q for p in range(len(ws) - 2) if windows[tuple(ws[p : p + 3])] > 1 for q in range(p, p + 3)}
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def texts(n, seed=0):
    rng = random.Random(seed)
    word = lambda: rng.choice(["ab", "C#", "d|", "é*", "x", "<y>", "12!", "zz"])
    line = lambda: rng.choice([" ", "\t", "\x0b"]).join(word() for _ in range(rng.randrange(0, 5)))
    return ["\n".join(line() for _ in range(rng.randrange(0, 12))) for _ in range(n)]


def test_counts_against_brute_force():
    every = [*texts(300), None, "", " \n", "a a a", "a b c a b c", "one"]
    own = text_stats.counts(pa.array(every))
    got = list(zip(*[own[k].tolist() for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]))
    assert got == [brute(t) for t in every]


def test_adaptive_fences_follow_the_source(spark):
    fill = lambda i: " ".join(f"word{(i * 31 + k * 17) % 997}" for k in range(60))
    rows = [(i, fill(i), "en") for i in range(250)] + [(1000 + i, " ".join(w + "#" for w in fill(i).split()), "de") for i in range(250)]
    rows += [(2000, " ".join(w + "###" for w in fill(1).split()), "en"), (2001, fill(3).upper(), "en"), (2002, " ".join(w + "#" for w in fill(1).split()), "de"), (2003, "too short", "en"), *[(i if i is None else 5000 + i, t, k) for i, t, k in ODD]]
    got = {r.doc_id: r for r in Q.judge(docs(spark, rows)).collect()}
    assert sum(got[i].kept for i in range(250)) == 250 and sum(got[1000 + i].kept for i in range(250)) == 250
    assert not got[2000].kept and "symbols" in got[2000].broken and "upper" in got[2001].broken
    assert got[2002].kept and got[2003].base_failed and not got[2003].kept
    assert not any(got[k].kept for k in (5000, 5001, 5002, 5006))
    assert Q.judge(docs(spark, rows)).count() == len(rows)


def exact_fences(counted):
    """The fences from whole sorted columns."""
    per = lambda a, b: {k: r[a] / max(r[b], 1) for k, r in enumerate(counted)}
    values = {"word_length": per("word_chars", "n_words"), "symbols": per("n_symbols", "word_chars"), "dup_lines": per("n_dup_lines", "n_lines"), "repeats": per("n_repeat_words", "n_words"), "upper": per("n_upper", "word_chars")}
    passing = [k for k, r in enumerate(counted) if not r.base_failed]
    at = lambda x, q: x[int((len(x) - 1) * q)]
    middle = lambda count: sorted(counted[k][count] for k in passing)[len(passing) // 2]

    def limit(name, rows):
        share = name in Q.SHARES
        x = sorted(values[name][k] for k in rows)
        nil = x.count(0)
        skip = nil if 4 * nil >= len(x) else 0
        some = x[skip:]
        out = {"n": len(some), "all": len(x), "lo": None, "hi": None, "valley": None}
        if some:
            scaled = (lambda v: math.log(v / (1 - v))) if share else math.log
            back = (lambda y: 1 / (1 + math.exp(-y))) if share else math.exp
            out["a"], out["z"] = at(some, 0.25), at(some, 0.75)
            size = middle(Q.SHARES.get(name, "word_chars"))
            noise = Q.NOISE / math.sqrt(size * out["z"] * (1 - out["z"]) if share else size)
            reach = max((Q.TAIL if skip else Q.SPREAD) * (scaled(out["z"]) - scaled(out["a"])), noise)
            out["hi"] = back(scaled(out["z"]) + reach)
            out["lo"] = back(scaled(out["a"]) - reach) if not skip and not share else None
        if skip:
            unit = 0.5 / middle(Q.SHARES[name])
            place, widest, before = [unit if v == 0 else v for v in x], 0, None
            for k, v in enumerate(place):
                if before is not None and v / before >= max(Q.VALLEY, widest) and max(0.01 * len(x), Q.LEAST / 10) <= len(x) - k < len(x) / 2:
                    widest, out["valley"] = v / before, (v + before) / 2
                before = v if before is None else max(before, v)
        return out

    def mixed(own, n, parent):
        return parent if own is None else own if parent is None else (n * own + Q.LEAST * parent) / (n + Q.LEAST)

    out = {}
    for lang, source in {(r.lang, r.source) for r in counted}:
        for name in Q.RATIOS:
            whole = limit(name, passing)
            if name in Q.SHARES and whole["n"] < whole["all"]:
                whole["hi"] = (whole["n"] * (whole["hi"] or 0) + Q.LEAST / 10 * min(1, Q.NOISE**2 / middle(Q.SHARES[name]))) / (whole["n"] + Q.LEAST / 10)
            of_lang = limit(name, [k for k in passing if counted[k].lang == lang])
            own = limit(name, [k for k in passing if (counted[k].lang, counted[k].source) == (lang, source)])
            parent = {c: mixed(of_lang[c], of_lang[n], whole[c]) for c, n in (("lo", "n"), ("hi", "n"), ("valley", "all"))}
            best = {c: mixed(own[c], own[n], parent[c]) for c, n in (("lo", "n"), ("hi", "n"), ("valley", "all"))}
            z, a = of_lang.get("z", whole.get("z")), of_lang.get("a", whole.get("a"))
            hi = best["hi"] if None in (best["hi"], z) else min(best["hi"], parent["hi"] + max(parent["hi"] - z, 0) / 4)
            lo = None if best["lo"] is None else max(best["lo"], parent["lo"] - max(a - parent["lo"], 0) / 4)
            out[lang, source, name] = lo, min((x for x in (hi, best["valley"]) if x is not None), default=None)
    return out, values


def test_fences_against_exact_quantiles(spark):
    rng = random.Random(5)
    letters = {"en": "abcdEF", "de": "abcDEFGhij", None: "abcdefgh#"}
    word = lambda lang, p=0.0: "".join(rng.choice(letters[lang]) for _ in range(rng.randrange(1, 9))) + ("#" if rng.random() < p else "")
    lines = lambda lang, n: [" ".join(word(lang, 0.004) for _ in range(12)) for _ in range(n)]
    rows = []
    for k in range(700):
        lang = rng.choice(["en", "de", None])
        text = lines(lang, rng.randrange(5, 9))
        if rng.random() < 0.3:
            text.append(text[0])
        rows.append((k, "\n".join(text), lang, rng.choice(["a", "b", None])))
    rows += [(1000 + k, " ".join(word("en") + "##" for _ in range(60)), "en", "junk") for k in range(120)]
    rows += [(2000 + k, " ".join(word("de") + "###" for _ in range(60)), "de", "a") for k in range(25)]
    table = spark.createDataFrame([(i, t, lang, s, 0) for i, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    counted = Q.judge(table).collect()
    want, values = exact_fences(counted)
    for k, r in enumerate(counted):
        broken = set(filter(None, r.broken.split(",")))
        for name in Q.RATIOS:
            for c, x in zip(("lo", "hi"), want[r.lang, r.source, name]):
                assert (r[f"{c}_{name}"] is None) == (x is None) and (x is None or abs(r[f"{c}_{name}"] / x - 1) < 0.1), (name, c, r[f"{c}_{name}"], x)
            lo, hi = r[f"lo_{name}"], r[f"hi_{name}"]
            assert (name in broken) == ((hi is not None and values[name][k] > hi) or (lo is not None and values[name][k] < lo))
        assert r.kept == (not r.base_failed and not broken)
    # junk stands beyond a valley, in a source of its own too
    assert not any(r.kept for r in counted if r.doc_id >= 1000 and r.lang == "de")
    assert {r.hi_symbols for r in counted if (r.lang, r.source) == ("en", "junk")} == {min(r.hi_symbols for r in counted if (r.lang, r.source) == ("en", "junk"))}
    again = Q.judge(table.repartition(7)).collect()
    assert {r.doc_id: r.kept for r in again} == {r.doc_id: r.kept for r in counted}
    assert {r.doc_id: r.hi_upper for r in again} == {r.doc_id: r.hi_upper for r in counted}
    salted = Q.judge(table, few_groups=0).collect()
    assert {r.doc_id: (r.kept, r.broken) for r in salted} == {r.doc_id: (r.kept, r.broken) for r in counted}


def test_a_source_of_junk_does_not_measure_itself(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9)))
    rows = [(k, " ".join(word().upper() if rng.random() < 0.05 else word() for _ in range(80)), "en", "a") for k in range(400)]
    rows += [(1000 + k, " ".join(word().upper() if rng.random() < 0.5 + k % 50 / 100 else word() for _ in range(80)), "en", "junk") for k in range(150)]
    table = spark.createDataFrame([(i, t, lang, s, 0) for i, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = Q.judge(table).collect()
    own, other = ({r.hi_upper for r in got if r.source == s}.pop() for s in ("junk", "a"))
    assert own <= other * 1.5
    assert all(r.kept for r in got if r.source == "a")


def test_values_down_to_one_unit_leave_no_valley(spark):
    rng = random.Random(8)
    rows = []
    for k in range(600):
        ws = [f"w{rng.randrange(10**6)}" for _ in range(100)]
        for _ in range(rng.choice([0, 0, 0, 0, 0, 0, 0, 1, 2, 4, 7, 12])):
            ws[rng.randrange(100)] += "#"
        rows.append((k, " ".join(ws), "en", "a"))
    table = spark.createDataFrame([(i, t, lang, s, 0) for i, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert all(r.kept for r in Q.judge(table).collect())


def test_empty_table(spark):
    assert Q.judge(docs(spark, [])).collect() == []
