"""The flight queries once more, in SQL for another engine.

One chain of common table expressions from ``supplier`` to every result; a query
takes the chain and its own final select.
"""

from __future__ import annotations

import re
from collections import Counter

from ..operators.polars import DEFAULT, GLIDERS, GRID
from .trace_binding import DROPPED, GLIDERS as TYPES, START, phase_sql

PI_R = "6371000.0e0"
WRAP = "(({0} + 180e0) - 360e0 * floor(({0} + 180e0) / 360e0) - 180e0)"


def compass(east: str, north: str) -> str:
    d = f"degrees(atan2({east}, {north}))"
    return f"({d} - 360e0 * floor({d} / 360e0))"


def haversine(a: str, b: str, c: str, d: str) -> str:
    return f"2e0 * {PI_R} * asin(least(1e0, sqrt(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2))))"


def sigma(h: str) -> str:
    return f"greatest(0.3e0, pow(greatest(0e0, 1e0 - 2.25577e-5 * {h}), 4.256e0))"


def _lags() -> tuple[str, str]:
    use = [f"(lead(tr, {k}) over w is not null and abs(lead(t, {k}) over w - t) <= 10)" for k in range(-5, 6)]
    return " + ".join(f"case when {u} then lead(tr, {k}) over w else 0e0 end" for u, k in zip(use, range(-5, 6))), " + ".join(f"case when {u} then 1 else 0 end" for u in use)


def _absorb(n: int) -> list[tuple[str, str]]:
    """Pass n of the absorption: flip, renumber, measure."""
    p = f"ab{n - 1}" if n > 1 else "ab0"
    return [
        (f"fl{n}", f"select flight_id, raw_run, t_a, t_b, case when bb - aa < 25 then not circ else circ end as circ from {p}"),
        (f"ch{n}", f"select *, case when circ <> lag(circ) over (partition by flight_id order by raw_run) then 1 else 0 end as c from fl{n}"),
        (f"nu{n}", f"select *, (sum(c) over (partition by flight_id order by raw_run))::integer as run_id from ch{n}"),
        (f"ab{n}", f"select flight_id, raw_run, run_id, t_a, t_b, circ, min(t_a) over (partition by flight_id, run_id) as aa, max(t_b) over (partition by flight_id, run_id) as bb from nu{n}"),
    ]


def _keys(gliders) -> str:
    rows = [(m.replace("-", "").replace(" ", ""), k) for k, g in enumerate(gliders) for m in g[1]]
    return ", ".join(f"('{m}', {k})" for m, k in rows)


def _polars(gliders) -> str:
    rows = [(k, *g) for k, g in enumerate(gliders)] + [(-1, *DEFAULT)]
    return ", ".join(f"({k}, '{n}', {ld}e0, {v}e0)" for k, n, _, ld, v, _ in rows)


def polar_steps(gliders) -> dict[str, str]:
    """The steps that hold the polar table."""
    return {
        "keys": f"select * from (values {_keys(gliders)}) v(key, g)",
        "pol0": f"select *, kmh / 3.6e0 as v, (kmh / 3.6e0) / ld / 0.5e0 as ca, floor(kmh * 0.75e0 + 0.5e0) as v0, floor(kmh + 0.5e0) as v1, floor(kmh * 1.5e0 + 0.5e0) as v2 from (values {_polars(gliders)}) p(g, name, ld, kmh)",
    }


_SUM, _COUNT = _lags()
_BEFORE = "over (partition by k order by i rows between unbounded preceding and 1 preceding)"
_AT = "(3100000 + ({0} * 7919 + k * 37) % 20000)", "(100000 + ({0} * 104729 + k * 53) % 40000)"

CHAIN: list[tuple[str, str]] = [
    ("sec", f"select s_suppkey::bigint as k, i, ({phase_sql(1)})::bigint as s, ({phase_sql(2)})::bigint as c, ({phase_sql(3)})::bigint as w from (select s_suppkey, s_suppkey::bigint as k, i from supplier, range(0, 1800) r(i))"),
    ("hd", f"select *, 100 * (k % 360) + coalesce(sum(w) {_BEFORE}, 0)::bigint as h from sec"),
    ("vel", "select *, floor(s * sin(radians(h / 100e0)) + 0.5e0)::bigint + case when i between 60 and 1769 then 1500 + 500 * (k % 7) else 0 end as vx, floor(s * cos(radians(h / 100e0)) + 0.5e0)::bigint + case when i between 60 and 1769 then 1000 else 0 end as vy from hd"),
    ("pos", f"select k, i, 3100000 + floor(coalesce(sum(vy) {_BEFORE}, 0)::bigint / 1852e0)::bigint as lat_mm, 100000 + floor(coalesce(sum(vx) {_BEFORE}, 0)::bigint / 1150e0)::bigint as lon_mm, 150000 + coalesce(sum(c) {_BEFORE}, 0)::bigint as z from vel"),
    ("fx", f"select 'F' || k as flight_id, k, i, row_number() over (partition by k order by i) - 1 as idx, {START} + i as t, lat_mm, lon_mm, lat_mm / 60000e0 as lat, lon_mm / 60000e0 as lon, case when k % 11 = 4 then 0 else (z // 1000)::integer end as palt, (z // 1000)::integer + 40 as galt, i % 97 <> 0 as valid from pos where not {DROPPED}"),
    ("al", "select *, case when max(palt) over f - min(palt) over f > 100 and min(palt) over f > -500 and min(palt) over f < 15000 then 'pressure' else 'GNSS' end as altitude_source, sum(lat_mm) over f / (60000e0 * count(*) over f) as lat0, sum(lon_mm) over f / (60000e0 * count(*) over f) as lon0 from fx window f as (partition by flight_id)"),
    ("pr", f"select *, case when altitude_source = 'pressure' then palt else galt end as alt, radians(lon - lon0) * {PI_R} * cos(radians(lat0)) as x, radians(lat - lat0) * {PI_R} as y from al"),
    ("st", f"select *, coalesce(lead(t) over w - t, 0) as dt, coalesce(lead(x) over w - x, 0e0) as dx, coalesce(lead(y) over w - y, 0e0) as dy, coalesce(lead(alt) over w - alt, 0) as dz, {compass('(lead(x) over w - lag(x) over w)', '(lead(y) over w - lag(y) over w)')} as trk from pr window w as (partition by flight_id order by idx)"),
    ("mo", "select *, sqrt(dx * dx + dy * dy) as step, case when dt > 0 then dx / dt else 0e0 end as vx, case when dt > 0 then dy / dt else 0e0 end as vy, case when dt > 0 then dz * 1e0 / dt else 0e0 end as vz, dt > 0 and dt <= 12 as good from st"),
    ("tu", f"select *, case when dt > 0 then step / dt else 0e0 end as gs, case when good then {WRAP.format('(lead(trk) over w - trk)')} end as dtrk from mo window w as (partition by flight_id order by idx)"),
    ("tr", "select *, dtrk / dt as tr from (select * from tu)"),
    ("kin", f"select * exclude (s_, n_), case when n_ > 0 then s_ / n_ else 0e0 end as trs from (select *, {_SUM} as s_, {_COUNT} as n_ from tr window w as (partition by flight_id order by idx))"),
    ("cl", "select *, abs(trs) > 6 as circ from kin"),
    ("cc", "select *, case when circ <> lag(circ) over (partition by flight_id order by idx) then 1 else 0 end as c from cl"),
    ("rr", "select *, (sum(c) over (partition by flight_id order by idx))::integer as raw_run from cc"),
    ("ab0", "select flight_id, raw_run, bool_and(circ) as circ, min(t) as t_a, max(t) as t_b, min(t) as aa, max(t) as bb from rr group by all"),
    *[x for n in range(1, 5) for x in _absorb(n)],
    ("seg", "select rr.* exclude (circ, c), ab4.run_id, ab4.circ from rr join ab4 using (flight_id, raw_run)"),
    ("runs", "select flight_id, run_id, min(idx) as a, max(idx) as b, min(t) as t_a, max(t) as t_b, arg_min(alt, idx) as alt_a, arg_max(alt, idx) as alt_b, bool_and(circ) as circ from seg group by all"),
    ("to1", "select *, count(*) over f as n, coalesce(min(case when gs * 3.6e0 > 25 and good then idx end) over f, 0) as first_ from kin window f as (partition by flight_id)"),
    ("to2", "select *, max(case when idx = 0 then alt end) over f as alt0, max(case when idx = first_ then alt end) over f as alt1 from to1 window f as (partition by flight_id)"),
    ("to3", "select *, case when first_ > 0 and alt0 < alt1 - 30 then 0 else first_ end as to_idx, case when first_ > 0 and alt0 < alt1 - 30 then alt0 else alt1 end as to_alt from to2"),
    ("tp1", "select *, case when idx >= to_idx then alt end as since, max(case when idx >= to_idx then alt end) over (partition by flight_id order by idx) as rmax from to3"),
    ("tp2", "select *, min(case when since < rmax - 60 then idx end) over (partition by flight_id) as brk from tp1"),
    ("tp3", "select *, max(case when since = rmax and idx < coalesce(brk, 1000000000) then idx end) over (partition by flight_id) as top_idx from tp2"),
    ("ms", "select *, coalesce(avg(case when good and idx >= to_idx and idx < top_idx then gs * 3.6e0 end) over (partition by flight_id), 0e0) as mspd, count(case when good then 1 end) over a as n8, avg(case when good then gs * 3.6e0 end) over a as v8 from tp3 window a as (partition by flight_id order by idx rows between current row and 7 following)"),
    ("la", "select flight_id, any_value(n) as n, any_value(to_idx) as takeoff_idx, any_value(top_idx) as top_idx, any_value(mspd) as mspd, max(case when idx = to_idx then t end) as takeoff_t, max(case when idx = top_idx then t end) as top_t, max(case when idx = top_idx then alt end) as top_alt, any_value(to_alt) as to_alt, min(case when good and idx >= to_idx + 5 and idx < least(top_idx + 40, n - 3) and n8 >= 4 and v8 < mspd - 15 then idx end) as slow from ms group by flight_id"),
    ("lb", "select *, top_t - takeoff_t as dur, top_alt - to_alt as gain, case when top_alt - to_alt < 50 then 'no launch in this file - the trace appears to start airborne' when top_t - takeoff_t <= 100 and top_alt - to_alt > 100 then 'winch or bungee launch' when mspd between 90 and 155 and top_t - takeoff_t > 100 then 'aerotow' else 'unclear - possibly a self-launch or a partial trace' end as type from la"),
    ("launch", "select lb.*, case when type = 'aerotow' and slow is not null then slow else top_idx end as release_idx, case when type = 'aerotow' and slow is not null then kin.t else top_t end as release_t, type = 'aerotow' and slow is not null as confident from lb left join kin on kin.flight_id = lb.flight_id and kin.idx = lb.slow"),
    ("ga", "select *, count(*) over (partition by flight_id) as nf from kin"),
    ("summary", "select flight_id, count(*) as fixes, min(t) as start, max(t) as \"end\", max(alt) as max_alt_m, arg_max(alt, idx) as last_alt, any_value(altitude_source) as altitude_source, sum(case when dt > 0 then step else 0e0 end) as track_distance_m, coalesce(median(case when idx < nf - 1 then dt end), 0)::double as median_interval_s, coalesce(max(case when idx < nf - 1 then dt end), 0) as max_gap_s, count(case when idx < nf - 1 and dt > 20 then 1 end) as gaps_over_20s, coalesce(sum(case when idx < nf - 1 and dt > 20 then dt end), 0)::bigint as gap_total_s, max(t) - min(t) as duration_s, coalesce(max(case when idx < nf - 1 and dt > 20 then dt end), 0) as largest_gap_s, coalesce(arg_max(case when idx < nf - 1 and dt > 20 then t end, case when idx < nf - 1 and dt > 20 then dt * 1000000 - t end), 0) as largest_gap_at, coalesce(avg(case when idx < nf - 1 and idx >= nf - 6 and good then gs * 3.6e0 end), 999e0) as tail from ga group by flight_id"),
    ("sm", "select *, median_interval_s > 4 as coarse, last_alt < max_alt_m - 300 and tail < 60 as landed from summary"),
    ("cr", "select runs.* from runs join launch using (flight_id) where circ and t_a >= release_t and alt_b > alt_a and t_b - t_a >= 30"),
    ("cs", "select seg.flight_id, seg.run_id, seg.dt, seg.vx, seg.vy, seg.good, seg.dtrk, cr.a, cr.b, cr.t_a, cr.t_b, cr.alt_a, cr.alt_b from seg join cr on seg.flight_id = cr.flight_id and seg.run_id = cr.run_id where seg.idx < cr.b"),
    ("dr", "select *, sum(case when good then vx * dt end) over r / sum(case when good then dt end) over r as ox, sum(case when good then vy * dt end) over r / sum(case when good then dt end) over r as oy from cs window r as (partition by flight_id, run_id)"),
    ("wc", "select flight_id, run_id, any_value(t_a) as time, any_value(ox) as dx, any_value(oy) as dy, abs(sum(case when good then dtrk end)) / 360 as circles from dr group by 1, 2"),
    ("we", f"select flight_id, time, sqrt(dx * dx + dy * dy) as speed_ms, {compass('(-dx)', '(-dy)')} as from_deg, circles, dx, dy from wc where circles >= 1.5"),
    ("wi", "select flight_id, sum(dx * circles) / sum(circles) as wx, sum(dy * circles) / sum(circles) as wy, max(speed_ms) - min(speed_ms) as spread_ms from we group by 1"),
    ("wind", f"select *, sqrt(wx * wx + wy * wy) as speed_ms, {compass('(-wx)', '(-wy)')} as from_deg, spread_ms * 1.943844e0 > 8 as unreliable from wi"),
    ("ch", "select dr.*, coalesce(wind.wx, ox) as ux, coalesce(wind.wy, oy) as uy from dr left join wind using (flight_id)"),
    ("cg", "select flight_id, run_id, any_value(a) as a, any_value(b) as b, any_value(t_a) as start, any_value(t_b) as \"end\", any_value(t_b) - any_value(t_a) as duration_s, any_value(alt_b) - any_value(alt_a) as gain_m, any_value(alt_a) as alt_bottom_m, any_value(alt_b) as alt_top_m, sum(case when good then dtrk end) as turned, median(case when good then sqrt((vx - ux) * (vx - ux) + (vy - uy) * (vy - uy)) end) as va from ch group by 1, 2"),
    ("ct", "select *, gain_m * 1e0 / duration_s as avg_climb_ms, abs(turned) / 360 as circles, case when turned > 0 then 'right' else 'left' end as direction, abs(turned) / duration_s as rate, row_number() over (partition by flight_id order by start) as climb from cg"),
    ("circles", "select *, 360e0 / rate as circle_time_s, va / radians(rate) as radius_m, degrees(atan(va * radians(rate) / 9.80665e0)) as bank_deg, va * 3.6e0 as airspeed_kmh from ct"),
    ("bw", "select s.flight_id, s.run_id, s.idx, s.t, s.alt, (select min(n.idx) from seg n where n.flight_id = s.flight_id and n.run_id = s.run_id and n.t >= s.t + 30) as j, max(s.idx) over (partition by s.flight_id, s.run_id) as last_ from seg s join cr on s.flight_id = cr.flight_id and s.run_id = cr.run_id"),
    ("best", "select bw.flight_id, bw.run_id, max(case when e.t - bw.t >= 24 then (e.alt - bw.alt) * 1e0 / (e.t - bw.t) end) as best_30s_ms from bw join seg e on e.flight_id = bw.flight_id and e.idx = coalesce(bw.j, bw.last_) group by 1, 2"),
    ("ph", "select s.flight_id, \"end\", release_t, greatest(1, \"end\" - release_t) as soaring_s, coalesce((select sum(t_b - t_a) from runs r where r.flight_id = s.flight_id and r.circ and r.t_a >= l.release_t), 0)::bigint as circling_s, coalesce((select sum(alt_b - alt_a) from cr where cr.flight_id = s.flight_id), 0)::bigint as gain_circling_m, (select min(alt_a) from cr where cr.flight_id = s.flight_id) as band_bottom_m, (select max(alt_b) from cr where cr.flight_id = s.flight_id) as band_top_m from summary s join launch l using (flight_id)"),
    ("types", "select 'F' || s_suppkey as flight_id, s_suppkey::bigint as k, case s_suppkey % 6 " + " ".join(f"when {n} then '{x}'" for n, x in enumerate(TYPES)) + " end as glider_type from supplier"),
    ("keys", polar_steps(GLIDERS)["keys"]),
    ("hits", "select flight_id, glider_type, (select g from keys where contains(replace(replace(lower(coalesce(glider_type, '')), '-', ''), ' ', ''), key) order by length(key) desc, g limit 1) as g from types"),
    ("pol0", polar_steps(GLIDERS)["pol0"]),
    ("pol1", "select *, round(ca - 1.5e0 * ca / v * (v0 / 3.6e0) + ca / (v * v) * (v0 / 3.6e0) * (v0 / 3.6e0), 3) as s0, round(ca - 1.5e0 * ca / v * (v1 / 3.6e0) + ca / (v * v) * (v1 / 3.6e0) * (v1 / 3.6e0), 3) as s1, round(ca - 1.5e0 * ca / v * (v2 / 3.6e0) + ca / (v * v) * (v2 / 3.6e0) * (v2 / 3.6e0), 3) as s2 from pol0"),
    ("pol2", "select *, ((s2 - s1) / ((v2 - v1) / 3.6e0) - (s1 - s0) / ((v1 - v0) / 3.6e0)) / ((v2 - v0) / 3.6e0) as c2 from pol1"),
    ("pol3", "select *, (s1 - s0) / ((v1 - v0) / 3.6e0) - c2 * (v0 + v1) / 3.6e0 as c1 from pol2"),
    ("pol", "select *, s0 - c1 * v0 / 3.6e0 - c2 * (v0 / 3.6e0) * (v0 / 3.6e0) as c0 from pol3"),
    ("grid", f"select unnest([{', '.join(map(repr, GRID))}])::double as u"),
    ("glide", "select g, max(case when c0 + c1 * u + c2 * u * u > 0 then u / (c0 + c1 * u + c2 * u * u) end) as best_ld, arg_max(u, case when c0 + c1 * u + c2 * u * u > 0 then u / (c0 + c1 * u + c2 * u * u) end) as best_ld_speed_ms from pol, grid group by g"),
    ("pm", "select h.flight_id, h.glider_type, pol.name, h.g is not null as matched, pol.c0, pol.c1, pol.c2, glide.best_ld, glide.best_ld_speed_ms from hits h join pol on pol.g = coalesce(h.g, -1) join glide on glide.g = pol.g"),
    ("en0", "select k.flight_id, case when s.landed then coalesce(max(case when k.alt >= s.last_alt + 300 then idx end), -1) + 1 end as entry from kin k join sm s using (flight_id) group by k.flight_id, s.landed"),
    ("entry", "select en0.flight_id, entry, kin.t as entry_t, kin.alt as entry_alt from en0 left join kin on kin.flight_id = en0.flight_id and kin.idx = en0.entry"),
    ("lr", "select r.*, e.entry, e.entry_t, e.entry_alt, e.entry > r.a and e.entry < r.b and entry_t - t_a >= 60 and t_b - entry_t >= 60 as cut from runs r join launch l using (flight_id) left join entry e using (flight_id) where not circ and t_a >= release_t and t_b - t_a >= 60"),
    ("ls", "select flight_id, run_id, a, case when cut then entry else b end as b, t_a, case when cut then entry_t else t_b end as t_b, alt_a, case when cut then entry_alt else alt_b end as alt_b from lr union all select flight_id, run_id, entry, b, entry_t, t_b, entry_alt, alt_b from lr where cut"),
    ("ln", "select *, row_number() over (partition by flight_id order by a) as leg from ls"),
    ("lx", f"select ln.*, seg.dt, seg.step, seg.good, seg.vz, sqrt(pow(seg.vx - coalesce(wx, 0e0), 2) + pow(seg.vy - coalesce(wy, 0e0), 2)) * sqrt({sigma('seg.alt')}) as eas, sqrt({sigma('seg.alt')}) as root, pm.c0, pm.c1, pm.c2 from ln join seg on seg.flight_id = ln.flight_id and seg.idx >= ln.a and seg.idx < ln.b left join pm on pm.flight_id = ln.flight_id left join wind on wind.flight_id = ln.flight_id"),
    ("ly", "select *, vz + (c0 + c1 * eas + c2 * eas * eas) / root as w from lx"),
    ("lz", "select flight_id, leg, any_value(a) as a, any_value(b) as b, any_value(t_a) as start, any_value(t_b) as \"end\", any_value(t_b) - any_value(t_a) as duration_s, sum(case when dt > 0 then step else 0e0 end) as distance_m, any_value(alt_b) - any_value(alt_a) as dh_m, avg(case when good then eas * 3.6e0 end) as mean_ias_kmh, case when count(case when good then 1 end) > 2 then stddev_pop(case when good then eas * 3.6e0 end) end as sd_ias_kmh, any_value(alt_a) as alt_start_m, any_value(alt_b) as alt_end_m, sum(case when good then w * dt end) / sum(case when good then dt end) as mean_airmass_ms, coalesce(sum(case when good and w > 0 then dt end), 0) * 1e0 / sum(case when good then dt end) as frac_rising_air, sum(case when good then dt end)::bigint as sampled_s from ly group by 1, 2"),
    ("lk", "select lz.*, case when dh_m < 0 then distance_m / -dh_m end as ld_over_ground, entry, landed, last_alt, lead(lz.a) over (partition by lz.flight_id order by lz.a) as after from lz join entry using (flight_id) join sm using (flight_id)"),
    ("legs", "select *, case when entry is null then case when landed and alt_end_m < last_alt + 250 then 'circuit' else 'cruise' end when a >= entry then 'circuit' when (after is null or after >= entry) and dh_m < -300 and -dh_m * 1e0 / duration_s >= 0.5 then 'final glide' else 'cruise' end as kind from lk"),
    ("tk", "select s_suppkey::bigint as k, 'F' || s_suppkey as flight_id, 1 + s_suppkey::bigint % 4 as turns from supplier where s_suppkey % 3 <> 0"),
    ("tq", "select k, flight_id, turns, j, case when j = turns + 1 and k % 2 = 0 then 0 else j end as place, case when j = 0 then 'start' when j = turns + 1 then 'finish' else 'turn' end as role, case when j = 0 then 'ST' when j = turns + 1 then 'FI' else 'TP' || j end as name, j + 1 as seq from tk, range(0, 7) r(j) where j <= turns + 1 union all select k, flight_id, turns, -1, 50, 'takeoff', 'TAKE OFF', 0 from tk where k % 3 = 2 union all select k, flight_id, turns, 99, 51, 'landing', 'LANDING', turns + 3 from tk where k % 3 = 2"),
    ("points", f"select flight_id, seq::integer as seq, {_AT[0].format('place')} / 60000e0 as lat, {_AT[1].format('place')} / 60000e0 as lon, name, role from tq"),
    ("sc", "select *, lead(name) over w as to_, lead(lat) over w as lat2, lead(lon) over w as lon2, row_number() over w as leg from points where role not in ('takeoff', 'landing') window w as (partition by flight_id order by seq)"),
    ("tl", f"select flight_id, leg, name as \"from\", to_ as \"to\", {haversine('lat', 'lon', 'lat2', 'lon2')} as distance_m, {compass('(sin(radians(lon2 - lon)) * cos(radians(lat2)))', '(cos(radians(lat)) * sin(radians(lat2)) - sin(radians(lat)) * cos(radians(lat2)) * cos(radians(lon2 - lon)))')} as bearing_deg from sc where to_ is not null"),
    ("tz", f"select flight_id, count(*) as n, {haversine('arg_min(lat, seq)', 'arg_min(lon, seq)', 'arg_max(lat, seq)', 'arg_max(lon, seq)')} < 1000 as closed from sc group by 1"),
]


def sql(final: str, changed: dict[str, str] | None = None) -> str:
    """The part of the chain that the select needs, and the select; ``changed`` replaces steps."""
    needed, todo = set(), [final]
    bodies = dict(CHAIN) | (changed or {})
    while todo:
        for name in set(re.findall(r"\w+", todo.pop())) & bodies.keys() - needed:
            needed.add(name)
            todo.append(bodies[name])
    if not needed:
        return final
    # a step that several others read is worked out once
    uses = Counter(x for text in [final, *[bodies[n] for n in needed]] for x in set(re.findall(r"\w+", text)) & needed)
    return "with " + ",\n".join(f"{n} as {'materialized ' if uses[n] > 1 else ''}({bodies[n]})" for n, _ in CHAIN if n in needed) + "\n" + final
