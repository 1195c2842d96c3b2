"""Frequency-shift keying without a reference carrier: symbol clocks from tone changes, equally spaced levels, soft bits.

A burst is one row with arrays of its samples; bursts are independent and go through the kernel in parallel.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Numbers of tones tried, symbols of a clock block, phases of the clock, the part of a symbol that counts.
ORDERS, BLOCK, PHASES, INNER = (2, 4, 8), 64, 32, 0.5


def level_fit(values: np.ndarray, order: int, rounds: int = 50) -> tuple[float, float, float]:
    """Centre, spacing and residual variance of equally spaced levels: least squares in turn with nearest levels, from the spread of the values, until nothing changes."""
    values = np.asarray(values, float)
    half = (order - 1) / 2
    low, high = np.quantile(values, [0.02, 0.98])
    centre, spacing = (low + high) / 2, max((high - low) / (order - 1), 1e-12)
    place = None
    for _ in range(rounds):
        new = np.clip(np.rint((values - centre) / spacing + half), 0, order - 1) - half
        if place is not None and (new == place).all():
            break
        place = new
        spread = place - place.mean()
        if not (power := float(spread @ spread)):
            break
        slope = float(spread @ values) / power
        if slope <= 0:
            break
        centre, spacing = float(values.mean() - slope * place.mean()), slope
    rest = values - centre - spacing * (np.clip(np.rint((values - centre) / spacing + half), 0, order - 1) - half)
    return centre, spacing, float(np.mean(rest * rest))


def best_order(values: np.ndarray, orders: tuple[int, ...] = ORDERS) -> tuple[int, tuple[float, float, float]]:
    """The number of levels under which the values are likeliest, all levels as likely as each other, and its fit."""
    fits = {m: level_fit(values, m) for m in orders if len(values) > 8 * m} or {orders[0]: level_fit(values, orders[0])}
    # Below a thousandth of the spread, residuals are rounding, not noise.
    floor = 1e-6 * float(np.var(values)) + 1e-18
    score = lambda m: -len(values) * (0.5 * math.log(max(fits[m][2], floor)) + math.log(m))
    best = max(fits, key=score)
    return best, fits[best]


def clock(edges: np.ndarray, period: float) -> tuple[np.ndarray, float]:
    """Where symbols begin, in samples, and the spread of the clock's blocks about its line.

    The energy of tone changes is folded on the symbol for each block of symbols; the phase of a block is the angle of
    the whole burst's peak corrected by its own, and a line through the blocks takes up a clock that drifts.
    """
    n = np.arange(len(edges))
    # An energy at step n belongs to the change between samples n and n + 1 of the frequency.
    phase = ((n + 1) / period) % 1.0
    profile = np.bincount((phase * PHASES).astype(int) % PHASES, edges, PHASES)
    peak = (int(profile.argmax()) + 0.5) / PHASES
    block = np.floor((n + 1) / (period * BLOCK)).astype(int)
    near = (phase - peak + 0.5) % 1.0 - 0.5
    weight = np.where(np.abs(near) < 0.25, edges, 0.0)
    count = block.max() + 1 if len(block) else 0
    total = np.bincount(block, weight, count)
    offset = np.bincount(block, weight * near, count) / np.maximum(total, 1e-300)
    use = np.flatnonzero(total > 0.1 * np.median(total[total > 0])) if (total > 0).any() else np.zeros(0, int)
    if not len(use):
        return np.zeros(0), 0.0
    at = (use + 0.5) * BLOCK
    slope = 0.0
    if len(use) > 2:
        slope = float(np.sum((at - at.mean()) * (offset[use] - offset[use].mean())) / np.sum((at - at.mean()) ** 2))
    base = float(offset[use].mean() - slope * at.mean())
    k = np.arange(-1, int(len(edges) / period) + 2)
    begin = (k + peak + base + slope * k) * period
    return begin, float(np.std(offset[use] - base - slope * at))


def demodulated(x: np.ndarray, rate: float, orders: tuple[int, ...] = ORDERS) -> dict | None:
    """order, centre, shift (cycles a sample), jitter (symbols), symbols (tones from the lowest) and llr of a burst at `rate` symbols a sample; None if it is too short."""
    period = 1.0 / rate
    if len(x) < 16 * period:
        return None
    f = np.angle(x[1:] * np.conj(x[:-1])) / (2 * math.pi)
    begin, jitter = clock(np.diff(f) ** 2, period)
    first = np.rint(begin + period * (1 - INNER) / 2).astype(int)
    width = max(1, round(period * INNER))
    first = first[(first >= 0) & (first + width <= len(f))]
    if len(first) < 8:
        return None
    means = f[first[:, None] + np.arange(width)].mean(axis=1)
    order, (centre, shift, noise) = best_order(means, orders)
    tones = centre + shift * (np.arange(order) - (order - 1) / 2)
    distance = (means[:, None] - tones) ** 2
    symbols = distance.argmin(axis=1)
    label = np.arange(order) ^ np.arange(order) >> 1
    bits = order.bit_length() - 1
    llr = np.stack([distance[:, (label >> (bits - 1 - k) & 1) == 1].min(axis=1) - distance[:, (label >> (bits - 1 - k) & 1) == 0].min(axis=1) for k in range(bits)], axis=1)
    return {"order": order, "centre": centre, "shift": shift, "jitter": jitter, "symbols": symbols.tolist(), "llr": (llr / (2 * max(noise, 1e-12))).ravel().tolist()}


def demodulate(bursts: DataFrame, key: str, rate: str) -> DataFrame:
    """key, order, centre, shift, jitter, symbols, llr: each burst (arrays i and q, symbols a sample in `rate`) demodulated; the labels are Gray's. Short and null bursts are left out."""
    schema = pa.schema([("order", pa.int32()), ("centre", pa.float64()), ("shift", pa.float64()), ("jitter", pa.float64()), ("symbols", pa.list_(pa.int32())), ("llr", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, rows = [], []
            for k in range(batch.num_rows):
                i, q, r = (batch.column(c)[k].as_py() for c in (1, 2, 3))
                if i and q and r and (out := demodulated(np.array(i) + 1j * np.array(q), r)):
                    kept.append(k)
                    rows.append(out)
            made = pa.RecordBatch.from_pylist(rows, schema)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept, pa.int32())), *made.columns], names=[key, *schema.names])

    x = bursts.select(key, F.col("i").cast("array<double>"), F.col("q").cast("array<double>"), F.col(rate).cast("double"))
    kind = bursts.schema[key].dataType.simpleString()
    return x.mapInArrow(run, f"`{key}` {kind}, order int, centre double, shift double, jitter double, symbols array<int>, llr array<double>")


def fitted_levels(values: DataFrame, key: str, value: str) -> DataFrame:
    """key, order, centre, spacing, variance: the equally spaced levels of each row's array of values."""
    kind = values.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(k, *best_order(np.array(v))) for k, v in enumerate(batch.column(1).to_pylist()) if v]
            columns = [pa.array([o for _, o, _ in out], pa.int32()), *(pa.array([fit[j] for _, _, fit in out], pa.float64()) for j in range(3))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([k for k, _, _ in out], pa.int32())), *columns], names=[key, "order", "centre", "spacing", "variance"])

    return values.select(key, F.col(value).cast("array<double>")).mapInArrow(run, f"`{key}` {kind}, order int, centre double, spacing double, variance double")
