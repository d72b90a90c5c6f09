"""Exact counts of a text's words, symbols, lines and repetitions, a chunk at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import common as C

#: The counted symbols.
SYMBOLS = "#*$%&|<>"

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks", "n_distinct", "n_top")


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[bounds[1:]] - total[bounds[:-1]]


def counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """``COUNTS`` of each text; null counts as empty.

    n_marks are ``!`` and ``?``, n_distinct distinct words, n_top the uses of the
    most frequent word; the others are as the quality rules define them.
    """
    texts = pc.fill_null(texts, "")
    rows = len(texts)
    flat, bounds = C.words(texts)
    n = np.diff(bounds)
    coded = pc.dictionary_encode(flat)
    names, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    of_name = lambda a: a.to_numpy(zero_copy_only=False).astype(np.int64)
    per_name = {
        "word_chars": of_name(pc.utf8_length(names)),
        "n_symbols": of_name(pc.count_substring_regex(names, f"[{SYMBOLS}]")),
        "n_upper": of_name(pc.count_substring_regex(names, r"\p{Lu}")),
        "n_digits": of_name(pc.count_substring_regex(names, "[0-9]")),
        "n_marks": of_name(pc.count_substring_regex(names, "[!?]")),
    }
    out = {"n_words": n} | {k: _sums(v[code], bounds) if len(names) else np.zeros(rows, np.int64) for k, v in per_name.items()}
    row = np.repeat(np.arange(rows), n)
    out["n_repeat_words"] = _repeated(code, row, bounds)
    out |= _uses(code, row, rows)
    return out | _lines(texts, rows)


def _repeated(code: np.ndarray, row: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Words of each text in 3-word windows that the text has twice or more.

    Codes are below 2**21 (a chunk has fewer words), so three fit a 64-bit key exactly.
    """
    rows = len(bounds) - 1
    m = len(code) - 2
    if m <= 0:
        return np.zeros(rows, np.int64)
    wide = code if not len(code) or code.max() < 1 << 21 else None
    if wide is None:  # a single text beyond the usual chunk: renumber pairs first
        _, pair = np.unique(code[:-1] * (int(code.max()) + 1) + code[1:], return_inverse=True)
        key = pair[:-1] * (int(code.max()) + 1) + code[2:]
    else:
        key = (code[:-2] << 42) | (code[1:-1] << 21) | code[2:]
    inside = np.flatnonzero(row[:m] == row[2:])
    key, at = key[inside], row[inside]
    order = np.lexsort((key, at))
    new = np.ones(len(order), bool)
    new[1:] = (key[order][1:] != key[order][:-1]) | (at[order][1:] != at[order][:-1])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(order)))
    twice = inside[order[np.repeat(size > 1, size)]]
    change = np.zeros(len(code) + 1, np.int64)
    np.add.at(change, twice, 1)
    np.add.at(change, twice + 3, -1)
    return _sums(np.cumsum(change)[:-1] > 0, bounds)


def _uses(code: np.ndarray, row: np.ndarray, rows: int) -> dict[str, np.ndarray]:
    order = np.lexsort((code, row))
    c, r = code[order], row[order]
    new = np.ones(len(order), bool)
    new[1:] = (c[1:] != c[:-1]) | (r[1:] != r[:-1])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(order)))
    top = np.zeros(rows, np.int64)
    np.maximum.at(top, r[first], size)
    return {"n_distinct": np.bincount(r[first], minlength=rows), "n_top": top}


def _lines(texts: pa.Array, rows: int) -> dict[str, np.ndarray]:
    lists = pc.split_pattern(texts, "\n")
    flat = lists.flatten()
    row = np.repeat(np.arange(rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    some = pc.greater(pc.binary_length(pc.ascii_trim_whitespace(flat)), 0).to_numpy(zero_copy_only=False)
    code = pc.dictionary_encode(flat).indices.to_numpy(zero_copy_only=False).astype(np.int64)
    row, code = row[some], code[some]
    n = np.bincount(row, minlength=rows)
    each = np.unique(row.astype(np.int64) << 32 | code)
    return {"n_lines": n, "n_dup_lines": n - np.bincount(each >> 32, minlength=rows)}
