"""Order statistics of a user's whole past, one user's history at a time.

The lower median of everything before a row is read from the end backwards: the
values are sorted once, a doubly linked list joins their ranks, each step takes the
newest value out of the list and the median moves by one place at most.  So a history
of n rows costs one sort and O(1) a row, whatever its length, and the result is exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F


def prefix_medians(values: np.ndarray) -> np.ndarray:
    """Position of the lower median of the first k values, for k = 0 (-1) to all of them.

    NaN counts as the largest value."""
    n = len(values)
    out = np.full(n + 1, -1, np.int64)
    if n == 0:
        return out
    order = np.argsort(values, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    # list slots are ranks + 1; slot 0 and slot n + 1 are the ends
    before, after = list(range(-1, n + 1)), list(range(1, n + 3))
    at = (n - 1) // 2 + 1
    picked = [0] * (n + 1)
    picked[n] = at
    slots = (rank + 1).tolist()
    for k in range(n - 1, 0, -1):            # k values stay
        gone = slots[k]
        if k % 2:                            # the place stays, the list below may shrink
            if gone <= at:
                at = after[at]
        elif gone >= at:                     # the place moves down by one
            at = before[at]
        lo, hi = before[gone], after[gone]
        after[lo], before[hi] = hi, lo
        picked[k] = at
    out[1:] = order[np.asarray(picked[1:], np.int64) - 1]
    return out


def _past(values: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lower median of the known values before each row, whether there is one)."""
    held = values[known]
    earlier = np.cumsum(known) - known       # known values before each row
    at = prefix_medians(held)[earlier]
    if len(held) == 0:
        return np.zeros_like(values), np.zeros(len(values), bool)
    return held[at], at >= 0


def past_median_and_mad(days: pa.Array, values: pa.Array) -> pa.Array:
    """For each history (lists of days and values, in any order): the lower median of the
    values before each day, and of the past deviations, each from its own row's median."""
    stops = np.asarray(values.offsets)
    day = days.flatten().fill_null(-(1 << 62)).to_numpy(zero_copy_only=False)
    flat = values.flatten()
    known = flat.is_valid().to_numpy(zero_copy_only=False)
    raw = flat.fill_null(0).to_numpy(zero_copy_only=False)
    base, stops = stops[0], stops - stops[0]
    med, mad = np.zeros_like(raw), np.zeros(len(raw))
    has_med, has_mad = np.zeros(len(raw), bool), np.zeros(len(raw), bool)
    for lo, hi in zip(stops[:-1].tolist(), stops[1:].tolist()):
        rows = lo + np.argsort(day[lo:hi], kind="stable")
        v, ok = raw[rows], known[rows]
        m, m_ok = _past(v, ok)
        med[rows], has_med[rows] = m, m_ok
        mad[rows], has_mad[rows] = _past(np.abs(v.astype(np.float64) - m), ok & m_ok)
    offsets = pa.array(stops, pa.int32())
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x, mask=~ok, from_pandas=False))
             for x, ok in ((med, has_med), (mad, has_mad))]
    return pa.StructArray.from_arrays(lists, ["med", "mad"])


def past_medians(value_type: str):
    """The above as a Spark function of (array of days, array of values)."""
    @F.arrow_udf(f"struct<med: array<{value_type}>, mad: array<double>>")
    def medians(days: pa.Array, values: pa.Array) -> pa.Array:
        return past_median_and_mad(days, values)
    return medians
