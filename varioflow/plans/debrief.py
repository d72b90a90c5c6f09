"""The whole debrief of a corpus of flights: lines in, all result tables out."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import climbs as climb_ops
from ..operators import kinematics, launch, legs, outline, parse, phase, polars, quality, segments, task, whole_logs
from ..sources import kept, logs


@dataclass
class Options:
    """What a user may choose; the defaults are the reference ones."""

    min_circle_rate: float = 6.0
    release_times: DataFrame | None = None  # flight_id, release_time
    polar_overrides: DataFrame | None = None  # flight_id, custom, force
    polar_table: DataFrame | None = None
    split_circuit: bool = True


class Debrief:
    """Result tables of one corpus, each made when first asked for.

    The classified fixes are the one large table.  They come out of a single
    exchange by flight and are kept dealt by flight, so that what is derived
    from them is not exchanged again; tables with a few rows per flight that
    several results share are kept too.  Of whole logs, summaries, runs, launch,
    landing, wind, climbs, legs and profiles come from the flights' outlines and
    from the logs, and need no kept fixes.

    So reading a property may run jobs and write tables to the shared folder;
    ``close`` (or leaving a ``with`` block) drops all of them.
    """

    def __init__(self, lines: DataFrame, options: Options | None = None, texts: DataFrame | None = None):
        self.lines, self.texts, self.options = lines, texts, options or Options()
        self.kept = kept.Kept(lines.sparkSession)
        self._keep = self.kept.stored

    @classmethod
    def of_texts(cls, texts: DataFrame, options: Options | None = None) -> Debrief:
        """Of whole logs, one row a flight: no line of theirs is exchanged, and a flight's records are read together."""
        return cls(logs.split_lines(texts), options, texts)

    def __enter__(self) -> Debrief:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        self.kept.close()

    @cached_property
    def _width(self) -> int:
        return kept.width_for(self.texts, "text")

    @property
    def _dealt(self) -> DataFrame:
        return kept.dealt(self.texts, "flight_id", self._width)

    @cached_property
    def _outlines(self) -> DataFrame:
        return self._keep(outline.outlined(self.texts, self.options.min_circle_rate), "outlines")

    @cached_property
    def classified(self) -> DataFrame:
        if self.texts is not None:
            moving = whole_logs.classified_fixes(self._dealt, self.options.min_circle_rate)
            return self.kept.bucketed(moving, "classified", "flight_id", self._width)
        width = kept.width_for(self.lines, "line")
        moving = kinematics.classified_fixes(kept.dealt(parse.parse_b(self.lines), "flight_id", width), self.options.min_circle_rate)
        return self.kept.bucketed(moving, "classified", "flight_id", width)

    @cached_property
    def _absorbed(self) -> DataFrame:
        return self._keep(segments.absorbed(self.classified) if self.texts is None else outline.absorbed(self._outlines), "absorbed")

    @cached_property
    def fixes(self) -> DataFrame:
        return segments.relabelled(self.classified, self._absorbed)

    @cached_property
    def _heads(self) -> DataFrame:
        return self._keep(logs.heads(self.texts), "heads")

    @cached_property
    def heads(self) -> DataFrame:
        """Lines among which headers and declarations are; of whole logs these few alone, as most lines are fixes."""
        return self.lines if self.texts is None else self._heads.select("flight_id", "source", F.posexplode("own").alias("line_no", "line"))

    @cached_property
    def headers(self) -> DataFrame:
        return self._keep(parse.headers(self.heads), "headers")

    @cached_property
    def warnings(self) -> DataFrame:
        return parse.extension_warnings(self.lines) if self.texts is None else parse.warnings_of_heads(self._heads)

    @cached_property
    def declared(self) -> DataFrame:
        return self._keep(parse.declarations(self.heads), "declared")

    @cached_property
    def task_points(self) -> DataFrame:
        return self._keep(parse.task_points(self.heads, self.declared), "task_points")

    @cached_property
    def task_legs(self) -> DataFrame:
        return task.task_legs(self.task_points)

    @cached_property
    def task_summary(self) -> DataFrame:
        return task.task_summary(self.task_points, self.declared)

    @cached_property
    def runs(self) -> DataFrame:
        return segments.merged_runs(self._absorbed)

    @cached_property
    def launch(self) -> DataFrame:
        found = launch.find_launch(self.classified) if self.texts is None else outline.launches(self._outlines)
        if self.options.release_times is not None:
            found = launch.override_release(found, self.classified, self.options.release_times)
        return self._keep(found, "launch")

    @cached_property
    def summary(self) -> DataFrame:
        return self._keep(quality.trace_summary(self.classified), "summary") if self.texts is None else outline.summaries(self._outlines)

    @cached_property
    def extent(self) -> DataFrame:
        """``flight_id, end, last_alt, landed``."""
        return self.summary if self.texts is None else outline.extents(self._outlines)

    @cached_property
    def climb_runs(self) -> DataFrame:
        return self._keep(climb_ops.climb_runs(self.runs, self.launch), "climb_runs")

    @cached_property
    def wind_estimates(self) -> DataFrame:
        return self._keep(climb_ops.wind_estimates(self.turns), "wind_estimates")

    @cached_property
    def turns(self) -> DataFrame:
        """``flight_id, run_id, start, circles`` and the own drift of each climb."""
        if self.texts is not None:
            return outline.turns(self._absorbed, self.climb_runs)
        return climb_ops.circle_stats(self.fixes, self.climb_runs).select("flight_id", "run_id", "start", "circles", "drift_vx", "drift_vy")

    @cached_property
    def wind(self) -> DataFrame:
        return climb_ops.estimate_wind(self.wind_estimates)

    @cached_property
    def phase(self) -> DataFrame:
        return phase.phase_split(self.runs, self.launch, self.climb_runs, self.extent)

    @cached_property
    def polars(self) -> DataFrame:
        table = self.options.polar_table if self.options.polar_table is not None else polars.bundled(self.lines.sparkSession)
        types = self.extent.select("flight_id").join(self.headers.select("flight_id", "glider_type"), "flight_id", "left")
        return self._keep(polars.match_polars(types, table, self.options.polar_overrides), "polars")

    @cached_property
    def entry(self) -> DataFrame:
        return self._keep(legs.circuit_entry(self.classified, self.summary) if self.texts is None else outline.circuit_entry(self._outlines), "entry")

    @cached_property
    def _split(self) -> DataFrame:
        return legs.split_legs(legs.leg_runs(self.runs, self.launch), self.entry, split_circuit=self.options.split_circuit)

    @cached_property
    def _airs(self) -> DataFrame:
        return legs.airs(self._split, self.polars, self.wind)

    def _measured(self, legs: bool, climbs: bool, with_profile: bool = False) -> DataFrame:
        blown = self.climb_runs.join(self.wind.select("flight_id", "wx", "wy"), "flight_id", "left") if climbs else None
        return outline.measured(self._dealt, self._airs if legs else None, blown, with_profile, self.options.min_circle_rate)

    @cached_property
    def details(self) -> DataFrame:
        """Of whole logs, what ``legs`` and ``climbs`` are made from and each flight's profile, out of one reading; without it each takes its own."""
        return self.kept.bucketed(self._measured(True, True, True), "details", "flight_id", self._width)

    def _own(self, name: str) -> DataFrame:
        return vars(self).get("details") or vars(self).get("sums") or self._measured(name == "legs", name == "climbs")

    @cached_property
    def sums(self) -> DataFrame:
        """``details`` without the profile."""
        return self._keep(self._measured(True, True), "sums")

    @cached_property
    def legs(self) -> DataFrame:
        if self.texts is None:
            analysed = legs.analyse_legs(self.fixes, self._split, self.polars, self.wind)
        else:
            analysed = legs.balance(self._own("legs").select("flight_id", F.inline("legs")).join(self._airs, ["flight_id", "leg"]))
        return self._keep(legs.leg_kinds(analysed, self.entry, self.extent, self.options.split_circuit), "legs")

    @cached_property
    def rising_air(self) -> DataFrame:
        return legs.rising_air(self.legs)

    @cached_property
    def climbs(self) -> DataFrame:
        table = climb_ops.climb_table(self.fixes, self.climb_runs, self.wind) if self.texts is None else climb_ops.measured_table(self._own("climbs"), self.climb_runs)
        return self._keep(table, "climbs")

    @property
    def flags(self) -> DataFrame:
        return quality.quality_flags(self.summary, self.warnings, self.polars, self.launch, self.wind)

    @property
    def profile(self) -> DataFrame:
        """Per-fix time, height, position to five places, and kind."""
        if self.texts is not None:
            return outline.unpacked(self.profiles)
        return self.fixes.select("flight_id", "t", F.col("alt").alias("alt_m"), F.round("lat", 5).alias("lat"), F.round("lon", 5).alias("lon"), F.col("circ").alias("circling"))

    @property
    def profiles(self) -> DataFrame:
        """Of whole logs, the profile as a row per flight."""
        return outline.profiled(self.texts, self.options.min_circle_rate)
