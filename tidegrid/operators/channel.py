"""Channels of long streams: a band moved to zero, a designed low-pass filter, fewer samples; and rates changed by a ratio.

Filters are Kaiser's, from the edge, the transition and the attenuation wanted. Streams are cut into chunks, and a chunk gets what the
filter needs of the one before as halo, so many streams of any length go through one job.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ordered


def kaiser(edge: float, transition: float, attenuation: float = 60.0) -> np.ndarray:
    """An odd number of taps of a low-pass filter that sum to one; edge (the middle of the transition) and transition in cycles a sample."""
    beta = 0.1102 * (attenuation - 8.7) if attenuation > 50 else 0.5842 * max(attenuation - 21, 0) ** 0.4 + 0.07886 * max(attenuation - 21, 0)
    half = max(1, math.ceil((attenuation - 7.95) / (14.36 * transition) / 2))
    n = np.arange(-half, half + 1)
    taps = 2 * edge * np.sinc(2 * edge * n) * np.i0(beta * np.sqrt(1 - (n / half) ** 2)) / np.i0(beta)
    return taps / taps.sum()


def root_raised_cosine(rolloff: float, samples: int, span: int) -> np.ndarray:
    """Taps of a root-raised-cosine pulse of unit energy, `span` symbols to either side; the two places where its formula has no value get its limit."""
    t = np.arange(-span * samples, span * samples + 1) / samples
    with np.errstate(divide="ignore", invalid="ignore"):
        taps = (np.sin(np.pi * t * (1 - rolloff)) + 4 * rolloff * t * np.cos(np.pi * t * (1 + rolloff))) / (np.pi * t * (1 - (4 * rolloff * t) ** 2))
    taps[np.abs(t) < 1e-12] = 1 - rolloff + 4 * rolloff / np.pi
    if rolloff:
        edge = np.abs(np.abs(4 * rolloff * t) - 1) < 1e-9
        taps[edge] = rolloff / math.sqrt(2) * ((1 + 2 / np.pi) * math.sin(np.pi / (4 * rolloff)) + (1 - 2 / np.pi) * math.cos(np.pi / (4 * rolloff)))
    return taps / math.sqrt(float(taps @ taps))


def channelised(samples: DataFrame, centre: float, taps: np.ndarray, keep: int, chunk: int = ordered.CHUNK) -> DataFrame:
    """rec, n, i, q: each stream (rec, n, i, q), n dense from 0, turned by -centre, filtered, and every keep-th sample of it; what lies before a stream counts as zeros."""
    chunk = -(-max(chunk, len(taps)) // keep) * keep
    kind = samples.schema["rec"].dataType.simpleString()

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        start, before = int(key[1]) * chunk, len(taps) - 1
        n = part["n"].to_numpy()
        x = np.zeros(chunk + before, complex)
        x[n - start + before] = (part["i"].to_numpy(float) + 1j * part["q"].to_numpy(float)) * np.exp(-2j * np.pi * centre * n)
        own = np.arange(0, min(chunk, int(n.max()) - start + 1), keep)
        # Only samples that stay are computed: windows of the stream against the taps.
        y = np.lib.stride_tricks.sliding_window_view(x, len(taps))[own] @ taps[::-1]
        return pd.DataFrame({"rec": [key[0]] * len(own), "n": (start + own) // keep, "i": y.real, "q": y.imag})

    halo = ordered.with_halo(samples.select("rec", "n", "i", "q"), len(taps) - 1, 0, "n", chunk)
    some = halo.groupBy("rec", "chunk").agg(F.max("own").alias("some")).where("some").drop("some")
    return halo.join(some, ["rec", "chunk"]).drop("own").groupBy("rec", "chunk").applyInPandas(run, f"rec {kind}, n long, i double, q double")


def resampled(samples: DataFrame, up: int, down: int, taps: np.ndarray, chunk: int = ordered.CHUNK) -> DataFrame:
    """rec, n, x: each real stream (rec, n, x) at up / down times its rate; taps are for the stream with up - 1 zeros behind each sample, of which only those that meet a sample are used."""
    reach = -(-len(taps) // up)
    chunk = -(-max(chunk, reach) // down) * down
    kind = samples.schema["rec"].dataType.simpleString()
    phases = np.zeros((up, reach))
    for p in range(up):
        phases[p, : len(taps[p::up])] = taps[p::up] * up

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        start = int(key[1]) * chunk
        n = part["n"].to_numpy()
        x = np.zeros(chunk + reach - 1)
        x[n - start + reach - 1] = part["x"].to_numpy(float)
        first, end = start * up // down, min(chunk, int(n.max()) - start + 1) + start
        m = np.arange(first, -(-end * up // down))
        at, phase = m * down // up - start, m * down % up
        y = np.einsum("ij,ij->i", np.lib.stride_tricks.sliding_window_view(x, reach)[at], phases[phase][:, ::-1])
        return pd.DataFrame({"rec": [key[0]] * len(m), "n": m, "x": y})

    halo = ordered.with_halo(samples.select("rec", "n", "x"), reach - 1, 0, "n", chunk)
    some = halo.groupBy("rec", "chunk").agg(F.max("own").alias("some")).where("some").drop("some")
    return halo.join(some, ["rec", "chunk"]).drop("own").groupBy("rec", "chunk").applyInPandas(run, f"rec {kind}, n long, x double")
