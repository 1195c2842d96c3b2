"""Sample streams that arrive in pieces: state between micro-batches is the open run, or the samples that the next frame still needs.

Input rows are (rec_id, n, x), n dense from 0 in each recording. A batch may
bring any part of a recording; samples wait until those before them are there, so
that the result does not depend on how the stream was cut. No more than `most` samples of a recording wait:
beyond that the missing ones are given up and the stream goes on behind the gap. A recording that brings nothing for
`idle` milliseconds is taken to have ended for now.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.spectrum import hann

RUN = "rec_id long, start long, length long, value double"
FRAME = "rec_id long, frame long, bin long, power double"
MOST, IDLE = 1 << 20, 3_600_000


def _in_order(parts: Iterator[pd.DataFrame], at: int, ns: list[int], xs: list[float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The values from position at on that are there without a gap, and positions and values of what has to wait; of a repeated sample the last counts."""
    parts = list(parts)
    n = np.concatenate([np.array(ns, np.int64), *(p["n"].to_numpy(np.int64) for p in parts)])
    x = np.concatenate([np.array(xs, float), *(p["x"].to_numpy(float) for p in parts)])
    n, x = n[n >= at], x[n >= at]
    order = np.argsort(n, kind="stable")
    n, x = n[order], x[order]
    last = np.r_[n[1:] != n[:-1], True] if len(n) else np.zeros(0, bool)
    n, x = n[last], x[last]
    ready = int(np.argmin(np.r_[n == at + np.arange(len(n)), False]))
    return x[:ready], n[ready:], x[ready:]


def runs(stream: DataFrame, least: int = 32, most: int = MOST, idle: int = IDLE) -> DataFrame:
    """Runs of at least so many equal samples, each when it has ended; the run that is still open is state.

    Samples given up are a row too, with no value. A recording that is idle gives its open run.
    """

    def step(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, start, value, ns, xs = state.get if state.exists else (0, 0, float("nan"), [], [])
        out, parts = [], [] if state.hasTimedOut else parts

        def close(end: int) -> None:
            if end - start >= least and not np.isnan(value):
                out.append((key[0], start, end - start, value))

        while True:
            x, ns, xs = _in_order(parts, at, ns, xs)
            if len(x):
                joined = np.concatenate([[value], x])
                edges = np.flatnonzero(joined[1:] != joined[:-1]) + at  # where a new run begins; the first sample always does
                for e in edges.tolist():
                    if e > start:
                        close(e)
                    start, value = e, float(x[e - at])
                at += len(x)
            if not len(ns) or not (state.hasTimedOut or len(ns) > most):
                break
            close(at)
            out.append((key[0], at, int(ns[0]) - at, None))
            at = start = int(ns[0])
            value, parts = float("nan"), []
        if state.hasTimedOut:
            close(at)
            start, value = at, float("nan")
        state.update((at, start, value, [int(n) for n in ns], [float(v) for v in xs]))
        state.setTimeoutDuration(idle)
        yield pd.DataFrame(out, columns=["rec_id", "start", "length", "value"])

    return stream.groupBy("rec_id").applyInPandasWithState(step, RUN, "at long, start long, value double, ns array<long>, xs array<double>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def periodograms(stream: DataFrame, nfft: int, hop: int, most: int = MOST) -> DataFrame:
    """Complete frames of each recording as they fill; the tail that the next frame needs is state, fewer than nfft samples.

    Frames that lack samples given up are left out; the next begins at the first whole hop behind the gap.
    """
    window = hann(nfft)
    scale = float((window**2).sum())

    def step(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, tail, ns, xs = state.get if state.exists else (0, [], [], [])
        while True:
            x, ns, xs = _in_order(parts, first + len(tail), ns, xs)
            x = np.concatenate([tail, x])
            count = max(0, (len(x) - nfft) // hop + 1)
            if count:
                cut = np.lib.stride_tricks.sliding_window_view(x, nfft)[: count * hop : hop]
                power = np.abs(np.fft.rfft(cut * window, axis=1)) ** 2 / scale
                frames, bins = first // hop + np.arange(count), power.shape[1]
                yield pd.DataFrame({"rec_id": key[0], "frame": np.repeat(frames, bins), "bin": np.tile(np.arange(bins), count), "power": power.ravel()})
            first, tail = first + count * hop, x[count * hop :].tolist()
            if len(ns) <= most:
                break
            first, tail, parts = -(-int(ns[0]) // hop) * hop, [], []
        state.update((first, tail, [int(n) for n in ns], [float(v) for v in xs]))

    return stream.groupBy("rec_id").applyInPandasWithState(step, FRAME, "first long, tail array<double>, ns array<long>, xs array<double>", "append", GroupStateTimeout.NoTimeout)
