"""Whole logs to classified fixes: Spark groups the texts by flight, a flight's records are read as columns of bytes."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .kinematics import CLASSIFIED, classified

#: Characters of a record that ``parse.parse_b`` reads.
RECORD = 35
#: Where a record holds the parts of its numbers: hour, minute, second, latitude and longitude in degrees and thousandths of a minute, altitudes.
PARTS = ((1, 3), (3, 5), (5, 7), (7, 9), (9, 14), (15, 18), (18, 23), (25, 30), (30, 35))
#: A record of the smallest kind.
ONE = "B0000000000000N00100000E" + "A0000000000"
NUMBER = re.compile(r"[\x00-\x20\x7f]*([+-]?[0-9]+)[\x00-\x20\x7f]*")
DIGITS = np.concatenate([np.arange(*p) for p in PARTS])


def classified_fixes(texts: DataFrame, min_circle_rate: float = 6.0, max_gap: int = 12) -> DataFrame:
    """``kinematics.classified_fixes`` of ``parse.parse_b`` of ``logs.split_lines``: the same fixes, from ``flight_id, text`` at once.

    A flight is bounded by the file limit.
    """

    return texts.select("flight_id", "text").groupBy("flight_id").applyInArrow(lambda flight: read(flight, min_circle_rate, max_gap), CLASSIFIED)


def read(flight: pa.Table, min_circle_rate: float = 6.0, max_gap: int = 12) -> pa.Table:
    """``CLASSIFIED`` of the texts of one flight."""
    return read_text(flight["flight_id"][0], "\n".join(x for x in flight["text"].to_pylist() if x is not None), min_circle_rate, max_gap)


def read_text(flight_id: pa.Scalar | str, text: str, min_circle_rate: float = 6.0, max_gap: int = 12) -> pa.Table:
    found = records(text)
    one = found if len(found["raw_t"]) else records(ONE)
    fixes = classified(pa.scalar(flight_id), one, min_circle_rate, max_gap)
    return fixes if one is found else fixes.slice(0, 0)


def records(text: str) -> dict[str, np.ndarray]:
    """``raw_t, lat_mm, lon_mm, palt, galt`` of the records of a log that ``parse.parse_b`` takes, in file order."""
    lines = text.replace("\r\n", "\n").replace("\r", "\n") + "\n"
    # a byte for each character; those beyond Latin-1 are no digits either way
    coded = np.frombuffer(lines.encode("latin-1", "replace"), np.uint8)
    ends = np.flatnonzero(coded == ord("\n"))
    starts = np.concatenate([[0], ends[:-1] + 1])
    long = ends - starts >= RECORD
    starts, ends = starts[long], ends[long]
    own = (coded[starts] | 32) == ord("b")
    starts, ends = starts[own], ends[own]
    record = np.lib.stride_tricks.sliding_window_view(coded, RECORD)[starts] if len(starts) else np.zeros((0, RECORD), np.uint8)
    digit = np.ascontiguousarray(record.T) - np.uint8(ord("0"))
    numbers = np.stack([sum(digit[k] * np.int64(10 ** (b - 1 - k)) for k in range(a, b)) for a, b in PARTS])
    known = np.ones(len(starts), bool)
    for k in np.flatnonzero((digit[DIGITS] > 9).any(axis=0)):
        at = lines[starts[k] : ends[k]]
        found = [NUMBER.fullmatch(at[a:b]) for a, b in PARTS]
        # a blank after the decimals would shift them
        known[k] = all(found) and "0" <= at[13] <= "9" and "0" <= at[22] <= "9"
        if known[k]:
            numbers[:, k] = [int(m[1]) for m in found]
    hour, minute, second, lat_d, lat_m, lon_d, lon_m, palt, galt = numbers
    south_or_west = lambda k: np.isin(record[:, k], (ord("S"), ord("W")))
    lat, lon = lat_d * 60000 + lat_m, lon_d * 60000 + lon_m
    lat, lon = np.where(south_or_west(14), -lat, lat), np.where(south_or_west(23), -lon, lon)
    known &= (np.abs(lat) >= 6) | (np.abs(lon) >= 6)
    columns = {"raw_t": hour * 3600 + minute * 60 + second, "lat_mm": lat, "lon_mm": lon, "palt": palt.astype(np.int32), "galt": galt.astype(np.int32)}
    return {name: v[known] for name, v in columns.items()}
