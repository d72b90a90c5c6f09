"""Unit inputs of the flight operators."""

import hashlib
import json
import math
import random
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from varioflow.functions import geo, units
from varioflow.operators import climbs, diff, kinematics, launch, legs, links, lookup, outline, parse, polars, quality, segments, task, whole_logs
from varioflow.bench import queries, trace_binding
from varioflow.plans import debrief, sinks
from varioflow.plans.export import flight_documents
from varioflow.sources import kept, logs

B = "B1508535143108N00250575WA0000000220"


def lines(spark, *texts):
    rows = [("f", "s", k, x) for k, x in enumerate(texts)]
    return spark.createDataFrame(rows, "flight_id string, source string, line_no int, line string")


def test_parse_b(spark):
    good = [B, B.replace("WA", "WV"), B.replace("A0000000220", "A-005000220"), "b" + B[1:]]
    bad = [B[:-1], "B1508530000000N00000000EA0000000220", B.replace("5143108", "51431XX")]
    got = parse.parse_b(lines(spark, *good, *bad)).orderBy("line_no").collect()
    assert [(r.raw_t, r.palt, r.galt, r.valid) for r in got] == [(54533, 0, 220, True), (54533, 0, 220, False), (54533, -50, 220, True), (54533, 0, 220, True)]
    assert got[0].lat_mm == 51 * 60000 + 43108 and got[0].lon_mm == -(2 * 60000 + 50575)


def test_midnight_and_order(spark):
    stamp = lambda t: "B%02d%02d%02d" % (t // 3600 % 24, t // 60 % 60, t % 60) + B[7:]
    t = [r.t for r in parse.fixes(lines(spark, *[stamp(86370 + k) for k in range(60)])).orderBy("idx").collect()]
    assert t == list(range(86370, 86430))


@pytest.mark.parametrize("value,want", [(0, 0), (180, -180), (-180, -180), (270, -90), (-270, 90), (1 - 359, 2)])
def test_wrap(spark, value, want):
    assert spark.range(1).select(geo.wrap(F.lit(float(value))).alias("w")).first().w == want


def test_sigma(spark):
    [r] = spark.range(1).select(*[geo.sigma(F.lit(h)).alias(n) for n, h in (("a", 0.0), ("b", 10000.0), ("c", 1e6))]).collect()
    assert r.a == 1 and 0.3 < r.b < 0.4 and r.c == 0.3


def test_split_lines(spark):
    df = spark.createDataFrame([("f", "s", "a\r\n\nb\rc\n")], "flight_id string, source string, text string")
    assert [(r.line_no, r.line) for r in logs.split_lines(df).orderBy("line_no").collect()] == [(0, "a"), (2, "b"), (3, "c")]


def test_declaration_and_roles(spark):
    point = lambda name, zero=False: ("C0000000N00000000E" if zero else "C5143108N00250575W") + name
    block = lines(spark, "C070623093500070623000102300KM TRIANGLE", point("", True), point("ST"), point("A"), point("B"), point("FI"), point("", True))
    d = parse.declarations(block)
    r = d.first()
    assert (r.declared_date, r.declared_time_s, r.turnpoints, r.description) == ("2023-06-07", 34500, 2, "300KM TRIANGLE")
    got = parse.task_points(block, d).orderBy("seq").collect()
    assert [(p.name, p.role) for p in got] == [("ST", "start"), ("A", "turn"), ("B", "turn"), ("FI", "finish")]
    assert task.task_summary(parse.task_points(block, d), d).first().closed


def test_polars(spark):
    table = polars.bundled(spark)
    assert table.count() == 28 and polars.violations(table).count() == 0
    types = spark.createDataFrame(list(enumerate(["ASK-21", "Schleicher ASK21 Mi", "K-21", "Duo Discus XT", "Discus 2c", "Slingsby T21", None])), "flight_id int, glider_type string")
    got = {r.flight_id: r for r in polars.match_polars(types, table).collect()}
    assert [got[k].name for k in range(6)] == ["ASK 21"] * 3 + ["Duo Discus", "Discus", polars.DEFAULT[0]]
    assert not got[6].matched and "None" in got[6].note


def test_short_runs_flip_together(spark):
    kinds = [0] * 40 + [9] * 10 + [0] * 10 + [9] * 60
    rows = [("f", k, k, float(v), 100) for k, v in enumerate(kinds)]
    df = spark.createDataFrame(rows, "flight_id string, idx long, t long, trs double, alt int")
    runs = segments.run_table(segments.segment(df)).orderBy("run_id").collect()
    # both short runs flip in one pass: the first joins what is before, the second what is after
    assert [(r.a, r.b, r.circ) for r in runs] == [(0, 49, False), (50, 119, True)]


def test_altitude_choice(spark):
    rows = [("a", k, 0, 500 + k) for k in range(20)] + [("b", k, 400 + 10 * k, 0) for k in range(20)]
    df = kinematics.choose_altitude(spark.createDataFrame(rows, "flight_id string, idx long, palt int, galt int"))
    assert {(r.flight_id, r.altitude_source) for r in df.collect()} == {("a", "GNSS"), ("b", "pressure")}


def test_links(spark):
    asked = ["https://www.weglide.org/flight/123", "https://bgaladder.net/FlightInfo/77", "100000", "https://club.example.org/x/a.IGC?d=1", "", "not a link", "ftp://a/b", "12"]
    got = {r.s: r for r in links.classify_links(spark.createDataFrame([(s,) for s in asked], "s string"), "s").collect()}
    assert [got[s].kind for s in asked] == ["weglide", "bga", "bga", "direct", None, None, None, None]
    assert got[asked[3]].file_name == "a.IGC" and got["100000"].label == "BGA Ladder flight 100000"


def test_hemispheres_are_capitals_and_holes_are_wide(spark):
    block = lines(spark, "C0000060N00000060Enear", "C0000061N00000060Efar", "C5143108n00250575WTEXT")
    assert [p.name for p in parse.task_points(block, parse.declarations(block)).collect()] == ["far"]
    assert parse.declarations(block).count() == 1


def test_white_space_of_any_kind_is_stripped(spark):
    block = lines(spark, "HFGIDGLIDERID:\t G-ABCD\u00a0\t", "AXYZ \t")
    r = parse.headers(block).first()
    assert (r.glider_id, r.logger_id) == ("G-ABCD", "XYZ")


def test_to_fixed_goes_by_the_binary_value(spark):
    values = [2.675, 1.005, -2.675, 0.125, 1.45, 8.345, 1234.5675, 0.0, 2.5, -0.5, 1e9 + 0.05, 3.14159, 0.285]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for places in (0, 1, 2, 3):
        step = Decimal(1).scaleb(-places)
        want = [float(Decimal(v).quantize(step, ROUND_HALF_UP)) for v in values]
        assert [r[0] for r in df.select(units.to_fixed(F.col("x"), places)).collect()] == want


def test_files_are_read_by_name_and_size(spark, tmp_path):
    body = "AXYZ\r\n" + B + "\r\n"
    (tmp_path / "sub").mkdir()
    for name in ("a.igc", "sub/b.IGC", "c.txt"):
        (tmp_path / name).write_bytes(body.encode("latin-1"))
    (tmp_path / "big.igc").write_bytes(b"B" * 200)
    got = logs.read_logs(spark, str(tmp_path), max_bytes=100)
    assert sorted(r.source.rsplit("/", 1)[1] for r in got.collect()) == ["a.igc", "b.IGC"]
    assert [r.length for r in logs.refused(spark, str(tmp_path), max_bytes=100).collect()] == [200]
    assert parse.fixes(logs.split_lines(got)).count() == 2
    assert logs.rejects(logs.read_logs(spark, str(tmp_path)), parse.fixes(logs.split_lines(got))).count() == 1
    (tmp_path / "none.igc").write_bytes(b"AXYZ\r\n")
    reasons = {r.source.rsplit("/", 1)[1]: r.reason for r in logs.sorted_out(spark, str(tmp_path), max_bytes=100).collect()}
    assert reasons == {"big.igc": "larger than the limit", "none.igc": "no usable B records"}


def test_polar_file(spark, tmp_path):
    one = {"name": "ASK 21", "match": ["ask21"], "published": {"best_ld": 34.0, "best_ld_kmh": 90.0, "min_sink_ms": 0.65}, "points": [[95, 0.54], [115, 0.6], [170, 1.32]]}
    path = tmp_path / "polars.json"
    path.write_text(json.dumps({"gliders": [one], "default": {**one, "name": "any", "match": []}}))
    got = logs.read_polars(spark, str(path)).orderBy("db_order").collect()
    assert [(r.name, r.is_default) for r in got] == [("ASK 21", False), ("any", True)]


def flown(spark, rows):
    """Kinematics of made-up steps: (alt, km/h) per second."""
    return spark.createDataFrame([("f", k, k, a, v / 3.6, True, 1) for k, (a, v) in enumerate(rows)], "flight_id string, idx long, t long, alt int, gs double, good boolean, dt int")


@pytest.mark.parametrize(
    "rows,kind,confident",
    [
        ([(100 + 2 * k, 110.0) for k in range(200)] + [(500 - k, 70.0) for k in range(100)], launch.TOW, True),
        ([(100, 0.0)] * 5 + [(100 + 8 * k, 100.0) for k in range(40)] + [(410 - k, 80.0) for k in range(200)], launch.WINCH, False),
        ([(1000 - k, 100.0) for k in range(200)], launch.NO_LAUNCH, False),
        ([(100 + k, 60.0) for k in range(300)] + [(400 - k, 60.0) for k in range(200)], launch.UNCLEAR, False),
    ],
)
def test_launch_kinds(spark, rows, kind, confident):
    r = launch.find_launch(flown(spark, rows)).first()
    assert (r.type, r.confident) == (kind, confident)


def test_release_override_takes_the_nearest_fix(spark):
    fixes = flown(spark, [(100 + k, 60.0) for k in range(100)])
    found = launch.find_launch(fixes)
    given = launch.override_release(found, fixes, spark.createDataFrame([("f", 42)], "flight_id string, release_time long")).first()
    none = launch.override_release(found, fixes, spark.createDataFrame([("f", None)], "flight_id string, release_time long")).first()
    assert (given.release_idx, given.confident) == (42, True)
    assert none.release_idx == found.first().release_idx and "supplied" not in none.note


@pytest.mark.parametrize("heights,landed,want", [([1200, 800, 400, 260, 120, 0], True, 3), ([1400, 900, 700, 500, 380], True, 3), ([1200, 200, 150, 900, 1100, 400, 200, 0], True, 6), ([1200, 0], False, None)])
def test_circuit_entry(spark, heights, landed, want):
    kin = spark.createDataFrame([("f", k, k * 10, a) for k, a in enumerate(heights)], "flight_id string, idx long, t long, alt int")
    summary = spark.createDataFrame([("f", heights[-1], landed)], "flight_id string, last_alt int, landed boolean")
    assert legs.circuit_entry(kin, summary).first().entry == want


def _climb(rows):
    """Full circles and best rate of (t, alt, x, y, dtrk) rows, step by step."""
    circles, turned, start = [], 0, 0
    for i, row in enumerate(rows[:-1]):
        turned += 0 if row[4] is None else math.floor(row[4] * 1e9 + 0.5)
        if abs(turned) >= 360_000_000_000:
            own = rows[start : i + 2]
            took, gain = own[-1][0] - own[0][0], own[-1][1] - own[0][1]
            circles.append((len(circles) + 1, own[0][0], took, gain, gain / took if took else 0.0, *[sum(r[c] for r in own) / len(own) for c in (2, 3, 0)], own[0][1]))
            turned, start = 0, i + 1
    rates = []
    for t, alt, *_ in rows:
        end = next((r for r in rows if r[0] >= t + 30), rows[-1])
        if end[0] - t >= 24:
            rates.append((end[1] - alt) / (end[0] - t))
    return circles, max(rates, default=None)


def test_circles_and_best_rate_against_a_plain_walk(spark):
    rng = random.Random(6)
    flights = {"exact": [(k, 100 + k, float(k), 0.0, 10.0 if k % 2 else 9.9999999999) for k in range(80)], "short": [(0, 5, 0.0, 0.0, None), (3, 9, 1.0, 1.0, 400.0)]}
    for n in range(12):
        t, rows = 0, []
        for _ in range(rng.randrange(2, 200)):
            t += rng.choice([0, 1, 1, 2, 4, 29, 31])
            rows.append((t, rng.randrange(100, 200), rng.random(), rng.random(), rng.choice([None, 18.01, -17.3, 90.0, 359.0, 19.35])))
        flights[f"f{n}"] = rows
    rows = [(f, 3, k, t, a, x, y, d) for f, own in flights.items() for k, (t, a, x, y, d) in enumerate(own)]
    fixes = spark.createDataFrame(rows, "flight_id string, run_id int, idx long, t long, alt int, x double, y double, dtrk double").repartition(3)
    asked = spark.createDataFrame([(f, 3) for f in flights], "flight_id string, run_id int")
    found = climbs.full_circles(fixes, asked).join(climbs.best_rate(fixes, asked), ["flight_id", "run_id"])
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
    got = {r.flight_id: r for r in found.collect()}
    assert got.keys() == flights.keys()
    for f, own in flights.items():
        circles, best = _climb(own)
        assert [tuple(c) for c in got[f].per_circle] == [pytest.approx(c) for c in circles]
        assert got[f].best_30s_ms == (None if best is None else pytest.approx(best))


def test_differences_of_all_kinds(spark):
    schema = "k string, a int, b string, c double, d array<int>, e int, g int, h boolean, z double"
    want = spark.createDataFrame([("f", 1, "x", 1.0, [1, 2], 5, 1, True, float("nan")), ("m", 1, None, None, [], None, None, None, None)], schema)
    got = spark.createDataFrame([("f", 2, "y", 1.0 + 1e-12, [1], None, "1", False, float("nan")), ("only", 1, "", 1.0, [], 1, "", True, 0.0)], "k string, a int, b string, c double, d array<int>, e int, g string, h boolean, z double")
    problems = {(r.k, r.path): r.problem for r in diff.diff_results(want, got, "k").collect()}
    assert problems == {("f", "a"): "number", ("f", "b"): "string", ("f", "d.length"): "length", ("f", "e"): "null", ("f", "g"): "type", ("f", "h"): "string", ("m", "<root>"): "missing"}


def _walked(a, b, path=""):
    """The differences of two plain trees, node by node."""
    below = lambda name: f"{path}.{name}" if path else name
    if a is None or b is None:
        return [] if a is b else [(path, "null")]
    kind = lambda v: "boolean" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else type(v).__name__
    if kind(a) != kind(b):
        return [(path, "type")]
    if isinstance(a, list):
        return [(f"{path}.length", "length")] if len(a) != len(b) else [x for i, (p, q) in enumerate(zip(a, b)) for x in _walked(p, q, f"{path}[{i}]")]
    if isinstance(a, dict):
        return [x for n, v in a.items() for x in (_walked(v, b[n], below(n)) if n in b else [(below(n), "missing")])]
    if kind(a) == "number":
        return [(path, "number")] if abs(a - b) / max(1, abs(a), abs(b)) > 1e-9 else []
    return [(path, "string")] if a != b else []


TREE = "w struct<v:double,from:struct<deg:double,note:string>>, legs array<struct<n:int,ends:array<int>,p:struct<x:int>>>, m map<string,array<string>>"


def test_a_mismatch_speaks_for_its_subtree(spark):
    leg = lambda n, ends, x: {"n": n, "ends": ends, "p": None if x is None else {"x": x}}
    whole = {"w": {"v": 1.0, "from": {"deg": 2.0, "note": "a"}}, "legs": [leg(1, [1, 2], 3), leg(2, [], 4)], "m": {"u": ["s", None], "v": []}}
    other = [
        whole,
        whole | {"w": None},
        whole | {"w": {"v": 2.0, "from": None}},
        whole | {"legs": []},
        whole | {"legs": [leg(9, [1], 3), leg(2, None, None)]},
        whole | {"legs": [leg(1, [1, 7], None), None]},
        whole | {"m": {"v": ["extra"]}},
        whole | {"m": {"u": ["t", "s"], "v": [], "more": ["x"]}},
    ]
    kinds = f"k int, {TREE}"
    row = lambda k, t: (k, t["w"], t["legs"], t["m"])
    for way in (1, -1):
        pairs = [(whole, o)[::way] for o in other]
        want = spark.createDataFrame([row(k, a) for k, (a, _) in enumerate(pairs)], kinds)
        got = spark.createDataFrame([row(k, b) for k, (_, b) in enumerate(pairs)], kinds)
        found = {(r.k, r.path, r.problem) for r in diff.diff_results(want, got, "k").collect()}
        assert found == {(k, p, what) for k, (a, b) in enumerate(pairs) for p, what in _walked(a, b)}
    # a field that the actual side's type lacks
    lacking = spark.createDataFrame([(0, {"v": 1.0}, [(1,), (2,)])], "k int, w struct<v:double>, legs array<struct<n:int>>")
    found = {(r.path, r.problem, r.expected) for r in diff.diff_results(spark.createDataFrame([row(0, whole)], kinds), lacking, "k").collect()}
    assert found == {("w.from", "missing", "object"), ("m", "missing", "object")} | {(f"legs[{i}].{n}", "missing", what) for i, size in ((0, "2.0"), (1, "0.0")) for n, what in (("ends", size), ("p", "object"))}


def test_allowed_paths_hold_for_all_beneath(spark):
    want = spark.createDataFrame([(k, [(1, [1]), (2, [2])], 1, 1) for k in range(4)], "k int, legs array<struct<n:int,ends:array<int>>>, leg int, legs2 int")
    got = spark.createDataFrame([(k, [(3, [3]), (4, [4])], 2, 2) for k in range(3)], want.schema)
    allow = spark.createDataFrame([(0, "legs"), (1, "legs[].ends"), (2, "legs[].ends[1]"), (3, "legs")], "k int, path string")
    found = {(r.k, r.path) for r in diff.diff_results(want, got, "k", allow).collect()}
    both = lambda k: {(k, "leg"), (k, "legs2")}
    every = {(2, f"legs[{i}].{x}") for i in range(2) for x in ("n", "ends[0]")}
    assert found == both(0) | both(1) | both(2) | {(1, "legs[0].n"), (1, "legs[1].n")} | every | {(3, "<root>")}


def test_lookups(spark):
    fixes = spark.createDataFrame([("f", k, 10 * k, k) for k in range(5)], "flight_id string, idx long, t long, alt int")
    asked = spark.createDataFrame([("f", 1, -5), ("f", 2, 10), ("f", 3, 11), ("f", 4, 99)], "flight_id string, query_id long, at long")
    assert {r.query_id: r.idx for r in lookup.fix_at(fixes, asked).collect()} == {1: 0, 2: 1, 3: 2, 4: 4}


def test_overlaps_are_counted_without_pairs(spark):
    rng = random.Random(8)
    rows = [(rng.choice("fg"), *sorted((rng.randrange(40), rng.randrange(40)))) for _ in range(200)] + [("f", None, 3), ("g", 3, None)]
    spans = [(rng.choice("fgh"), k, rng.randrange(-2, 42), rng.randrange(-2, 42)) for k in range(120)] + [("f", 200, None, 4)]
    found = lookup.span_counts(spark.createDataFrame(rows, "flight_id string, start long, end long"), spark.createDataFrame(spans, "flight_id string, span_id long, span_start long, span_end long"))
    touch = lambda f, a, b: 0 if a is None else sum(g == f and s is not None and e is not None and e >= min(a, b) and s <= max(a, b) for g, s, e in rows)
    assert sorted((r.flight_id, r.span_id, r.n) for r in found.collect()) == sorted((f, k, touch(f, a, b)) for f, k, a, b in spans)


def test_ranges_pair_only_their_own_fixes(spark):
    fixes = spark.createDataFrame([("f", k, 10 * k, k) for k in range(50)] + [("g", 0, 7, 1)], "flight_id string, idx long, t long, alt int")
    spans = spark.createDataFrame([("f", 1, 95, 131), ("f", 2, 480, 900), ("g", 3, 0, 1), ("f", 4, 20, 10)], "flight_id string, span_id long, span_start long, span_end long")
    found = lookup.highlight_range(fixes, spans)
    assert sorted((r.span_id, r.idx) for r in found.collect()) == sorted([(1, k) for k in range(10, 15)] + [(2, 48), (2, 49), (3, 0), (4, 1), (4, 2)])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "<=" not in plan.split("Join", 1)[0] and "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()


def test_keys_meet_types_by_equality(spark):
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("ab-1 ") for _ in range(n))
    entry = lambda k, keys: (f"G{k}", keys, (30.0, 90.0, 0.7), [[60.0, 0.7], [90.0, 0.8], [135.0, 1.5]], k, False)
    entries = [entry(k, [word(rng.randrange(1, 6)) for _ in range(3)]) for k in range(60)] + [entry(1 << 20, []), ("any", [], (30.0, 90.0, 0.7), [[60.0, 0.7], [90.0, 0.8], [135.0, 1.5]], 1 << 30, True)]
    table = spark.createDataFrame(entries, f"name string, match array<string>, published {polars.PUBLISHED}, points array<array<double>>, db_order long, is_default boolean")
    types = [(k, word(rng.randrange(0, 30))) for k in range(150)] + [(500, None), (501, "")]
    forces = {k: rng.choice([word(rng.randrange(1, 5)).strip() or "a", f"g{k}", "none", None]) for k, _ in types}
    squash = lambda s: s.lower().replace("-", "").replace(" ", "")

    def matched(kind):
        hits = [(-len(squash(m)), e[4], e[0]) for e in entries[:-1] for m in e[1] if kind is not None and squash(m) in squash(kind)]
        return min(hits)[2] if hits else "any"

    def forced(k, kind):
        if forces[k] == "none":
            return None
        hits = [(e[4], e[0]) for e in entries[:-1] if forces[k] and any(forces[k].lower() in part for part in (e[0].lower(), *e[1]))]
        return min(hits)[1] if hits else matched(kind)

    df = spark.createDataFrame(types, "flight_id int, glider_type string")
    found = polars.match_polars(df, table)
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r.flight_id: r.name for r in found.collect()} == {k: matched(t) for k, t in types}
    asked = spark.createDataFrame([(k, None, f) for k, f in forces.items()], "flight_id int, custom array<array<double>>, force string")
    found = polars.match_polars(df, table, asked)
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r.flight_id: r.name for r in found.collect()} == {k: forced(k, t) for k, t in types}


def test_degenerate_points_are_a_violation(spark):
    entry = ("G", ["g"], (30.0, 90.0, 0.7), [[60.0, 0.7], [90.0, 0.8]], 0, False)
    table = spark.createDataFrame([entry], f"name string, match array<string>, published {polars.PUBLISHED}, points array<array<double>>, db_order long, is_default boolean")
    assert "degenerate" in {r.rule for r in polars.violations(table).collect()}


def test_tables_by_date(spark, tmp_path):
    rows = spark.createDataFrame([(f"f{k % 40}", k // 40, k) for k in range(4000)], "flight_id string, t long, v int").repartition(5)
    dates = spark.createDataFrame([(f"f{k}", None if k % 10 == 9 else f"2024-0{1 + k % 4}-01") for k in range(40)], "flight_id string, date string")
    path = str(tmp_path / "out")
    read = lambda: {(r.corpus, str(r.date), r.flight_id, r.n) for r in sinks.read_by_date(spark, path).groupBy("corpus", "date", "flight_id").agg(F.count("*").alias("n")).collect()}
    whole = {("a", str(r.date), r.flight_id, 100) for r in dates.collect()}
    for _ in range(2):
        sinks.write_by_date(rows, dates, path, "a", max_records=300)
        assert read() == whole
    sinks.write_by_date(rows.where("flight_id = 'f0'"), dates, path, "b")
    assert read() == whole | {("b", "2024-01-01", "f0", 100)}
    some = dates.where("date = '2024-02-01' and flight_id <> 'f1'")
    sinks.write_by_date(rows.join(some, "flight_id", "left_semi"), some, path, "a")
    assert read() == {r for r in whole if r[2] != "f1"} | {("b", "2024-01-01", "f0", 100)}
    sinks.write_by_date(rows.join(some, "flight_id", "left_semi"), some, path, "a", whole=True)
    assert {r[1] for r in read() if r[0] == "a"} == {"2024-02-01"}
    sinks.write_by_date(rows, dates, path, "a", max_records=300)
    counts = sinks.read_by_date(spark, path).where("corpus = 'a'").groupBy(F.col("_metadata.file_path")).count().collect()
    assert max(r["count"] for r in counts) <= 300


def test_bundles_of_one_name_both_come_back(spark, tmp_path):
    docs = spark.createDataFrame([("f1", "flight-igc-analysis", "{1}"), ("f2", "flight-igc-analysis", "{2}"), ("f3", "x-igc-analysis", '{"é": 3}')], "flight_id string, bundle string, document string")
    path = str(tmp_path / "bundles")
    for _ in range(2):
        sinks.write_bundles(docs, path)
    got = {r.bundle: r.document for r in sinks.read_bundles(spark, path).collect()}
    shared = lambda f: "flight-igc-analysis-" + hashlib.md5(f.encode()).hexdigest()
    assert got == {shared("f1"): "{1}", shared("f2"): "{2}", "x-igc-analysis": '{"é": 3}'}


def test_width_follows_the_bytes(spark):
    texts = spark.range(1000).select(F.repeat(F.lit("x"), 100).alias("line"))
    assert kept.width_for(texts, "line") == kept.shuffle_width(spark)
    assert kept.width_for(texts, "line", per_bucket=1000) == 100
    assert kept.width_for(texts.limit(0), "line") == kept.shuffle_width(spark)


def test_a_closed_debrief_leaves_nothing(spark):
    with debrief.Debrief(lines(spark, B)) as d:
        assert d.legs.count() == 0 and d.kept.tables
        folder, tables = d.kept.folder, list(d.kept.tables)
        assert kept.present(spark, folder)
    assert not kept.present(spark, folder) and not any(spark.catalog.tableExists(t) for t in tables)


def test_a_replaced_table_gets_its_own_answer(spark, tmp_path):
    table = lambda n: spark.createDataFrame([(k, f"S{k}") for k in range(n)], "s_suppkey long, s_name string")
    headers = lambda: {r.pilot for r in queries.log_headers(spark, str(tmp_path)).collect()}
    table(4).write.parquet(f"{tmp_path}/supplier.parquet")
    assert headers() == {f"S{k}" for k in range(4)}
    text = queries.log_lines(spark, str(tmp_path)).inputFiles()
    assert queries.log_lines(spark, str(tmp_path)).inputFiles() == text
    table(2).write.mode("overwrite").parquet(f"{tmp_path}/supplier.parquet")
    assert headers() == {"S0", "S1"}


def test_turn_rate_keeps_its_sign_round_a_full_circle(spark):
    """A right-hand circle of 100 m, nine degrees a second, across north."""
    texts, metre = [], 1 / 6371000 / math.radians(1)
    for k in range(80):
        bearing = math.radians(350 + 9 * k)
        north, west = 51.5 + 100 * math.cos(bearing) * metre, 1.5 - 100 * math.sin(bearing) * metre / math.cos(math.radians(51.5))
        place = lambda v, w: f"{int(v):0{w}d}{round((v - int(v)) * 60000):05d}"
        texts.append(f"B09{k // 60:02d}{k % 60:02d}{place(north, 2)}N{place(west, 3)}WA00500{500 + k:05d}")
    fixes = kinematics.add_kinematics(parse.fixes(lines(spark, *texts))).orderBy("idx").collect()
    assert len(fixes) == 80
    assert all(abs(f.tr) < 90 for f in fixes if f.tr is not None)
    assert all(5 < f.trs < 13 for f in fixes[6:-6])


def test_legs_by_hand(spark):
    """Twelve steps of 10 s east at 30 m/s in a wind of 10 m/s from the west, half of them rising against the polar."""
    polar = spark.createDataFrame([("f", 0.5, 0.0, 0.001)], "flight_id string, c0 double, c1 double, c2 double")
    steps = [(k, 10, 300.0, 30.0, 0.0, 1.0 if k < 6 else -2.0, True) for k in range(12)] + [(12, 0, 0.0, 0.0, 0.0, 0.0, False)]
    kin = spark.createDataFrame([("f", 5, k, dt, step, vx, vy, vz, good, 0) for k, dt, step, vx, vy, vz, good in steps], "flight_id string, run_id int, idx long, dt long, step double, vx double, vy double, vz double, good boolean, alt int")
    leg = spark.createDataFrame([("f", 5, 1, 0, 12, 100, 220, 500, 440)], "flight_id string, run_id int, leg int, a long, b long, t_a long, t_b long, alt_a int, alt_b int")
    wind = spark.createDataFrame([("f", 10.0, 0.0)], "flight_id string, wx double, wy double")
    r = legs.analyse_legs(kin, leg, polar, wind).first()
    assert (r.distance_m, r.dh_m, r.duration_s, r.sampled_s, r.ld_over_ground) == (3600.0, -60, 120, 120, 60.0)
    assert r.mean_ias_kmh == pytest.approx(72.0) and r.sd_ias_kmh == pytest.approx(0.0)
    assert r.mean_airmass_ms == pytest.approx((1.9 - 1.1) / 2) and r.frac_rising_air == 0.5
    still = legs.analyse_legs(kin, leg, polar, wind.limit(0)).first()
    assert still.mean_ias_kmh == pytest.approx(108.0)
    bare = legs.analyse_legs(kin, leg, polar.limit(0), wind).first()
    assert bare.mean_airmass_ms is None and bare.frac_rising_air is None and bare.distance_m == 3600.0


def test_leg_kinds_by_hand(spark):
    leg = lambda n, a, b, dh, took, end: ("f", n, a, b, dh, took, end)
    rows = [leg(1, 0, 100, -400, 500, 1500), leg(2, 120, 200, -800, 1000, 300), leg(3, 200, 230, -290, 200, 10)]
    df = spark.createDataFrame(rows, "flight_id string, leg int, a long, b long, dh_m int, duration_s long, alt_end_m int")
    ends = spark.createDataFrame([("f", 0, True)], "flight_id string, last_alt int, landed boolean")
    kinds = lambda entry, **more: [r.kind for r in legs.leg_kinds(df, spark.createDataFrame([("f", entry)], "flight_id string, entry long"), ends, **more).orderBy("leg").collect()]
    assert kinds(200) == ["cruise", "final glide", "circuit"]
    assert kinds(None) == ["cruise", "cruise", "circuit"] == kinds(200, split_circuit=False)
    shallow = df.withColumn("duration_s", F.lit(2000).cast("long"))  # soaring down is no glide home
    assert [r.kind for r in legs.leg_kinds(shallow, spark.createDataFrame([("f", 200)], "flight_id string, entry long"), ends).orderBy("leg").collect()] == ["cruise", "cruise", "circuit"]


def test_wind_by_hand(spark):
    stats = spark.createDataFrame([("f", 10, 3.0, 4.0, 3.0), ("f", 20, 0.0, 8.0, 1.5), ("f", 30, 50.0, 50.0, 1.4), ("g", 5, 1.0, 0.0, 1.0)], "flight_id string, start long, drift_vx double, drift_vy double, circles double")
    [w] = climbs.estimate_wind(climbs.wind_estimates(stats)).collect()
    assert (w.flight_id, w.wx, w.wy) == ("f", pytest.approx(2.0), pytest.approx(16 / 3))
    assert w.speed_ms == pytest.approx(math.hypot(2, 16 / 3)) and w.from_deg == pytest.approx(math.degrees(math.atan2(-2, -16 / 3)) % 360)
    assert w.spread_ms == pytest.approx(3.0) and not w.unreliable


def test_flag_texts(spark):
    summary = spark.createDataFrame([("a", 5.0, 75, 2, 100, 1000, "GNSS", True), ("b", 1.0, 75, 1, 75, 1500, "pressure", False), ("c", 1.0, 30, 2, 50, 500, "pressure", False)], "flight_id string, median_interval_s double, largest_gap_s long, gaps_over_20s long, gap_total_s long, duration_s long, altitude_source string, coarse boolean")
    warnings = spark.createDataFrame([("a", "columns")], "flight_id string, warning string")
    matched = spark.createDataFrame([("a", "none for it", False), ("b", "matched it", True), ("c", "matched it", True)], "flight_id string, note string, matched boolean")
    starts = spark.createDataFrame([("a", "winch", False), ("b", "no launch here", False), ("c", "aerotow", True)], "flight_id string, type string, confident boolean")
    wind = spark.createDataFrame([("b", True, 5.2)], "flight_id string, unreliable boolean, spread_ms double")
    got = {}
    for r in quality.quality_flags(summary, warnings, matched, starts, wind).collect():
        got.setdefault(r.flight_id, {})[r.code] = (r.severity, r.detail)
    assert got == {
        "a": {"parser": ("warn", "columns"), "coarse": ("warn", "median interval 5.0 s"), "altitude": ("note", "GNSS"), "polar": ("warn", "none for it"), "release_estimated": ("warn", "winch")},
        "b": {"long_gap": ("warn", "1:15"), "altitude": ("note", "pressure"), "polar": ("note", "matched it"), "wind_unreliable": ("warn", "10 kt")},
        "c": {"gaps": ("note", "2 0:50 10.0%"), "altitude": ("note", "pressure"), "polar": ("note", "matched it")},
    }


def test_motion_is_planned_once(spark):
    d = debrief.Debrief(lines(spark, B))
    assert d.legs.count() == 0
    text = segments.relabelled(d.classified, d._absorbed)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in text
    made = segments.classify(kinematics.add_kinematics(parse.ordered_fixes(kept.dealt(parse.parse_b(d.lines), "flight_id"))))._jdf.queryExecution().executedPlan().toString()
    assert made.count("Exchange hashpartitioning") == 1 and made.count("Window [") <= 12


def test_angles_are_the_nearest_doubles(spark):
    r = random.Random(1)
    at = [(r.uniform(-60, 60), r.uniform(-60, 60)) for _ in range(2000)]
    ends = [(0.0, 1.0), (0.0, -1.0), (1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (-2.0, -2.0), (1e-40, 1e-40)]
    found = spark.createDataFrame(at + ends, "y double, x double").select("y", "x", geo.atan2(F.col("y"), F.col("x")).alias("a")).collect()
    off = [abs(f.a - math.atan2(f.y, f.x)) for f in found]
    assert sum(d > 0 for d in off[:2000]) < 20 and max(off) < 1e-15 and max(off[2000:]) == 0


def test_motion_is_short_enough_to_be_compiled(spark, capfd):
    kin = segments.classify(kinematics.add_kinematics(parse.fixes(lines(spark, B))))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        kin.explain(mode="codegen")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = [int(x.split(";")[0]) for x in capfd.readouterr().out.split("maxMethodCodeSize:")[1:]]
    assert sizes and max(sizes) <= 8000


def test_files_are_written_by_tasks_as_spark_lays_them_out(spark, tmp_path):
    names = ["F1", "a b", "x:y/z%", "[é]^", "q'\"#*=?\\{", None]
    rows = spark.createDataFrame([(n, None if n == "F1" else f"ü{k}\nb") for k, n in enumerate(names)], "name string, value string").repartition(3)
    sinks.write_each(rows, str(tmp_path / "own"), "name", "value", "\r\n")
    rows.write.partitionBy("name").option("lineSep", "\r\n").text(str(tmp_path / "spark"))
    found = {kind: {(f.parent.name, f.read_bytes()) for f in (tmp_path / kind).rglob("name=*/part*.txt")} for kind in ("own", "spark")}
    assert found["own"] == found["spark"] and len(found["own"]) == len(names)
    # a checksum beside a file is what Spark's writer leaves, which starts several programs a file
    assert not list((tmp_path / "own").rglob("name=*/.*")) and (tmp_path / "own/_SUCCESS").exists()
    twice = spark.createDataFrame([("f", "1"), ("f", "2")], "name string, value string").coalesce(1)
    sinks.write_each(twice, f"file://{tmp_path}/twice", "name", "value")
    assert sorted(f.read_bytes() for f in (tmp_path / "twice/name=f").iterdir()) == [b"1\n", b"2\n"]


def test_usable_lines_are_those_that_give_a_fix(spark):
    given = [B, "b" + B[1:], B[:-1], "", "LXXX", B.replace("51431XX", ""), "B1508530000000N00000000EA0000000220", B.replace("5143108", "51431XX"), B.replace("A0000000220", "A-005000220"), B.replace("150853", "15 853")]
    df = lines(spark, *given)
    made = {r.line_no for r in parse.parse_b(df).select("line_no").collect()}
    assert {r.line_no for r in df.where(parse.usable(F.col("line"))).collect()} == made and len(made) >= 3


def test_flights_of_one_track_share_its_records(spark, tmp_path):
    numbers = [1, 1 + trace_binding.TRACKS, 4, 4 + 11 * trace_binding.TRACKS, 4 + trace_binding.TRACKS]
    spark.createDataFrame([(k, "n") for k in numbers], "s_suppkey long, s_name string").write.parquet(f"{tmp_path}/supplier.parquet")
    flights = trace_binding.flyers(spark, str(tmp_path))
    assert trace_binding.tracks(flights).distinct().count() == 3
    made = trace_binding.log_lines(spark, str(tmp_path)).where("line_no >= 100")
    assert "BroadcastHashJoin" not in made._jdf.queryExecution().executedPlan().toString()
    per = {r.flight_id: (r.n, r.h) for r in made.groupBy("flight_id").agg(F.count("*").alias("n"), F.sum(F.crc32("line")).alias("h")).collect()}
    a, b, c, d, e = [per[f"F{k}"] for k in numbers]
    assert a == b and c == d and e[0] == c[0] and e != c and a[0] == c[0] == trace_binding.SECONDS


def test_grouped_motion_is_that_of_the_windows(spark):
    r = random.Random(3)
    texts = []
    t, lat, lon, alt = 86390, 43108.0, 50575.0, 500
    for k in range(400):
        t += r.choice([1, 1, 1, 1, 2, 5, 0, 13, -3]) if k % 40 else 40
        lat, lon, alt = lat + 20 * math.sin(k / 5), lon + 30 * math.cos(k / 5), alt + r.randint(-2, 4)
        texts.append("B%02d%02d%02d51%05dN002%05dWA%05d%05d" % (t // 3600 % 24, t // 60 % 60, t % 60, lat, lon, alt, alt + 30))
    flat = [x[:25] + "0000000220" for x in texts[:3]]
    rows = [(f, "s", k, x) for f, own in (("a", texts), ("b", texts[::-1]), ("one", texts[:1]), ("two", flat[:2]), ("three", flat)) for k, x in enumerate(own)]
    raw = parse.parse_b(spark.createDataFrame(rows, "flight_id string, source string, line_no int, line string"))
    found = kinematics.classified_fixes(raw)
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()
    want = segments.classify(kinematics.add_kinematics(parse.ordered_fixes(raw))).select(found.columns)
    assert found.dtypes == want.dtypes
    pairs = list(zip(*[df.orderBy("flight_id", "idx").collect() for df in (found, want)], strict=True))
    assert len(pairs) == 806
    for a, b in pairs:
        for x, y in zip(a, b, strict=True):
            assert x == y or isinstance(x, float) and x == pytest.approx(y, rel=1e-12, abs=1e-11)


def test_whole_logs_give_the_fixes_of_their_lines(spark):
    r = random.Random(5)
    odd = [B, B[:-1], "b" + B[1:], "B", "LXXX", "", B + "é€\U0001f600", "B15085€5143108N00250575WA0000000220", B.replace("51431", "51 31"), B.replace("5143108", "514310 "), B.replace("5143108", "+1+3108"), B.replace("00250575", "0025057\x7f"), "B1508530000005N00000005EA0000000220", "B1508530000006S00000000EA0000000220"]
    odd += [B.replace("A0000000220", x) for x in ("A-005000220", "A 12  00220", "A+1200\x1f 220", "A1 2 300220", "A--12300220", "A1.500\t\t220", "A     00220", "A٣000000220")] + [B.replace("150853", x) for x in (" 5+8-3", "1508 3", "2 0000")]
    logged = []
    t = 86300
    for k in range(300):
        t += r.choice([1, 1, 1, 2, 13, -2])
        logged.append("B%02d%02d%02d51%05d%s002%05d%sA%05d%05d012" % (t // 3600 % 24, t // 60 % 60, t % 60, 43108 + 20 * math.sin(k / 5), r.choice("NS"), 50575 + 30 * math.cos(k / 5), r.choice("EWew"), k, k + 30))
    texts = [("a", "\r\n".join(logged)), ("b", "\r".join(odd + logged[:40] + odd)), ("c", "\n\n" + "\n".join(odd[::-1])), ("d", "HFDTE010124\n"), ("e", None), ("f", ""), ("g", logged[0])]
    df = spark.createDataFrame([(f, "s", x) for f, x in texts], "flight_id string, source string, text string")
    found = whole_logs.classified_fixes(df)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    want = kinematics.classified_fixes(parse.parse_b(logs.split_lines(df)))
    assert found.dtypes == want.dtypes
    a, b = (x.orderBy("flight_id", "idx").collect() for x in (found, want))
    assert a == b and {x.flight_id for x in a} == {"a", "b", "c", "g"} and len(a) > 360


def test_flights_are_made_and_read_as_whole_logs(spark, tmp_path):
    spark.createDataFrame([(k, f"S{k}") for k in (3, 4, 5)], "s_suppkey long, s_name string").write.parquet(f"{tmp_path}/supplier.parquet")
    assert queries.log_texts(spark, str(tmp_path)).count() == 3
    with queries.debrief(spark, str(tmp_path)) as d:
        assert d.texts is not None and d.classified.groupBy("flight_id").count().count() == 3
        with debrief.Debrief(d.lines) as by_lines:
            assert d.classified.exceptAll(by_lines.classified).count() == 0 and d.classified.count() == by_lines.classified.count()


def test_launch_is_planned_with_few_windows_over_the_fixes(spark):
    with debrief.Debrief(lines(spark, B)) as d:
        plan = launch.find_launch(d.classified)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and plan.count("Window [") <= 4


def test_runs_meet_the_kept_fixes_without_sorting_them(spark):
    """Nor when the runs are too many to be sent to every task."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with debrief.Debrief(lines(spark, *[B.replace("150853", "1508%02d" % k) for k in range(50)])) as d:
            runs = d.runs
            for met in (d.fixes, segments.within(d.fixes, runs, "a", "b")):
                assert "SortMergeJoin" not in met._jdf.queryExecution().executedPlan().toString()
            found = segments.within(d.fixes, runs.where("run_id = 0"), "a", "b").collect()
            assert [(r.a, r.b) for r in found] == [(0, 49)] * 50
            twice = runs.unionByName(runs)
            assert segments.within(d.fixes, twice, "a", "b").count() == 100
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_lines_of_kinds_are_those_of_the_split(spark):
    texts = ["AXY\r\nHFx\rCabc\n\nB1A2H\nhfA:b C", "BA\nCC\n aC\nA", "", None, "h", "\n\u0085A\u2028H\nA\u0085C\r\n\r\nLCA"]
    df = spark.createDataFrame([(str(k), "s", x) for k, x in enumerate(texts)], "flight_id string, source string, text string")
    want = [(r.flight_id, r.line) for r in logs.split_lines(df).where(parse.kind(F.col("line")).isin("A", "H", "C")).orderBy("flight_id", "line_no").collect()]
    got = [(r.flight_id, r.line) for r in logs.lines_of_kinds(df, "AHC").orderBy("flight_id", "line_no").collect()]
    assert got == want and len(got) == 8


def wandering(r, n, t=50000, turning=1.0):
    """A log that waits, climbs out, circles, glides and lands at random."""
    lat, lon, alt, way, out = 43108.0, 50575.0, 500.0, 0.0, []
    for k in range(n):
        t += r.choice([1, 1, 1, 1, 2, 4, 13])
        phase = k * 7 // n
        way += turning * (0, 0, 0.01, 0.35, 0.02, -0.4, 0.01)[phase] * r.uniform(0.7, 1.3)
        flying = phase > 0 and k < n - 20
        lat, lon = lat + flying * 18 * math.cos(way), lon + flying * 26 * math.sin(way)
        alt += (0, 3, -2, 2, -1.5, 2, -3)[phase] + r.uniform(-1, 1)
        out.append("B%02d%02d%02d51%05dN002%05dWA%05d%05d" % (t // 3600 % 24, t // 60 % 60, t % 60, lat, lon, alt, alt + 30))
    return "\n".join(["HFGTYGLIDERTYPE:ASK-21", *out])


def test_outlines_give_what_the_kept_fixes_give(spark):
    """Runs, launch, landing, wind and legs of whole logs, without a row per fix."""
    r = random.Random(11)
    logged = [(f"f{k}", "s", wandering(r, n, turning=turning)) for k, (n, turning) in enumerate([(900, 1), (900, 0), (1400, 1), (700, -1), (60, 1), (9, 0), (2, 0), (1, 0)])]
    df = spark.createDataFrame([*logged, ("none", "s", "HFDTE010124"), ("null", "s", None)], "flight_id string, source string, text string")
    with debrief.Debrief.of_texts(df) as own, debrief.Debrief(logs.split_lines(df)) as other:
        for name, order in (("runs", "run_id"), ("launch", "takeoff_idx"), ("climb_runs", "run_id"), ("wind_estimates", "time"), ("entry", "entry"), ("phase", "soaring_s"), ("legs", "leg"), ("rising_air", "flight_id")):
            columns = [c for c in getattr(other, name).columns]
            a, b = (getattr(d, name).select(columns).orderBy("flight_id", order).collect() for d in (own, other))
            assert len(a) == len(b) > 0, name
            for x, y in zip(a, b):
                for p, q in zip(x, y):
                    assert p == q or isinstance(p, float) and p == pytest.approx(q, rel=1e-9, abs=1e-9), (name, x, y)
        assert "classified" not in vars(own), "a row per fix was kept"
        assert own.launch.where("confident").count() + own.climb_runs.count() > 2 and own.legs.where("kind <> 'cruise'").count() > 0


def three_flights(spark, path, monkeypatch):
    """A folder of three suppliers; a query on it fails if it keeps a row per fix."""

    def refuse(*_):
        raise AssertionError("a row per fix was kept")

    monkeypatch.setattr(kept.Kept, "bucketed", refuse)
    spark.createDataFrame([(k, f"S{k}") for k in (3, 4, 5)], "s_suppkey long, s_name string").write.parquet(f"{path}/supplier.parquet")
    return str(path)


def test_thin_climbs_are_told_from_the_outlines(spark, tmp_path, monkeypatch):
    found = queries.thin_climbs(spark, three_flights(spark, tmp_path, monkeypatch)).orderBy("flight_id").collect()
    assert [tuple(r) for r in found] == [("F3", 0, 2), ("F4", 0, 2), ("F5", 0, 2)]


def test_phases_are_compared_without_kept_fixes_and_by_all_tasks(spark, tmp_path, monkeypatch):
    found = queries.result_differences(spark, three_flights(spark, tmp_path, monkeypatch))
    assert found._jdf.queryExecution().analyzed().toString().count("RepartitionByExpression [flight_id") >= 2
    assert {(r.flight_id, r.path, r.problem) for r in found.collect() if r.problem != "missing"} == {("F3", "character", "string"), ("F3", "band.top", "type"), ("F4", "climbs.length", "length"), ("F5", "band", "null")}


def test_documents_need_no_kept_fixes_and_are_those_of_the_lines(spark, monkeypatch):
    """Summaries, climbs with their circles, warnings, profiles and documents of whole logs."""
    r = random.Random(5)
    logged = [(f"f{k}", "s", wandering(r, n, turning=turning)) for k, (n, turning) in enumerate([(900, 1), (900, 0), (1400, 1), (700, -1), (60, 1), (9, 0), (2, 0), (1, 0)])]
    logged += [("i1", "s", "I013638FXA\nI023638FXA3940SIU\nb" + "9" * 60 + "\n" + logged[4][2]), ("i2", "s", "i013637FXA\r" + logged[4][2]), ("i3", "s", "I013640FXA\nB123"), ("i4", "s", "I\n" + logged[4][2])]
    df = spark.createDataFrame([*logged, ("none", "s", "HFDTE010124"), ("null", "s", None)], "flight_id string, source string, text string")
    with debrief.Debrief.of_texts(df) as own, debrief.Debrief(logs.split_lines(df)) as other:
        want = {c: flight_documents(other, "2024-01-02T00:00:00Z", include_profile=c).orderBy("flight_id").collect() for c in (False, True)}
        tables = {name: (sorted(getattr(other, name).columns), order) for name, order in (("summary", "start"), ("climbs", "climb"), ("warnings", "declared"))}
        far = {name: getattr(other, name).select(columns).orderBy("flight_id", order).collect() for name, (columns, order) in tables.items()}
        profile = other.profile.orderBy("flight_id", "t").collect()

        def refuse(*_):
            raise AssertionError("classified fixes were kept")

        monkeypatch.setattr(whole_logs, "classified_fixes", refuse)

        def same(p, q):
            if isinstance(p, (list, tuple)):
                return isinstance(q, (list, tuple)) and len(p) == len(q) and all(map(same, p, q))
            return p == q or isinstance(p, float) and p == pytest.approx(q, rel=1e-9, abs=1e-9)

        for c in (False, True):
            assert flight_documents(own, "2024-01-02T00:00:00Z", include_profile=c).orderBy("flight_id").collect() == want[c]
        for name, (columns, order) in tables.items():
            found = getattr(own, name).select(columns)
            assert found.dtypes == getattr(other, name).select(columns).dtypes
            assert same(found.orderBy("flight_id", order).collect(), far[name]) and far[name], name
        assert own.profile.orderBy("flight_id", "t").collect() == profile and len(profile) > 3900
        assert len(far["warnings"]) > 1
        assert max(len(x.per_circle) for x in far["climbs"]) > 2


def test_profiles_by_date_are_dealt_packed_and_leave_no_exchange(spark, tmp_path, monkeypatch):
    path = three_flights(spark, tmp_path, monkeypatch)
    packed = queries.debrief(spark, path).profiles
    assert "Exchange" not in packed._jdf.queryExecution().executedPlan().toString()
    dates = spark.createDataFrame([("F3", "2024-01-01"), ("F4", None)], "flight_id string, date string")
    sinks.write_by_date(packed, dates, str(tmp_path / "out"), unpack=outline.unpacked)
    read = sinks.read_by_date(spark, str(tmp_path / "out"))
    assert read.drop("corpus", "date").exceptAll(outline.unpacked(packed)).count() == 0 and read.count() == outline.unpacked(packed).count() > 5000
    assert {(r.flight_id, str(r.date)) for r in read.select("flight_id", "date").distinct().collect()} == {("F3", "2024-01-01"), ("F4", "None"), ("F5", "None")}
    assert all(f.name.endswith(".zstd.parquet") for f in (tmp_path / "out").rglob("part-*"))
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    with kept.exchanges_removed(spark):
        assert spark.conf.get(key) == "true"
    assert spark.conf.get(key, "false") == "false"
    assert {(r.flight_id, r.n) for r in queries.profiles_by_date(spark, path).collect()} == {("F3", 1800), ("F4", 1800), ("F5", 1775)}
