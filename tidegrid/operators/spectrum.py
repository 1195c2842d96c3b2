"""Spectra of long streams: frames are cut within chunks that carry a halo, and transformed by a vectorised kernel, chunk by chunk."""

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ordered

#: Variance of a mean of frames that overlap by half, against independent ones.
OVERLAP_VARIANCE = 1 + 2 * 0.0278
MAX_CELLS, MIN_AVERAGE = 1 << 22, 8


def hann(nfft: int) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(nfft) / nfft)


@dataclass(frozen=True)
class Grid:
    """How a stream of some frames is laid out in rows: row r has the frames from floor(r * frames / rows) on."""

    nfft: int
    frames: int
    rows: int

    @property
    def hop(self) -> int:
        return self.nfft // 2

    def row_of(self, frame: Column) -> Column:
        return F.floor(((frame + 1) * self.rows - 1) / self.frames).cast("long")

    def first_frame(self, row: Column) -> Column:
        return F.floor(row * self.frames / self.rows).cast("long")

    def span(self, first: Column, last: Column) -> tuple[Column, Column]:
        """The samples [start, stop) of rows first to last."""
        return self.first_frame(first) * self.hop, (self.first_frame(last + 1) - 1) * self.hop + self.nfft


def plan_grid(samples: int, nfft: int, max_cells: int = MAX_CELLS, min_average: int = MIN_AVERAGE) -> Grid | None:
    """None if the samples don't fill min_average frames."""
    frames = (samples - nfft) // (nfft // 2) + 1 if samples >= nfft else 0
    if frames < min_average:
        return None
    per_row = max(min_average, math.ceil(frames / max(1, max_cells // nfft)))
    return Grid(nfft, frames, max(1, frames // per_row))


def periodograms(samples: DataFrame, nfft: int, hop: int, chunk: int = ordered.CHUNK) -> DataFrame:
    """frame, bin, power of complete frames of a real stream (n, x), n dense; power is density: white noise of variance v reads v.

    A frame belongs to the chunk that holds its first sample; what it needs
    beyond comes as halo, so tasks have chunks, never a stream.
    """
    chunk = max(chunk // hop, -(-nfft // hop)) * hop
    window = hann(nfft)
    scale = float((window**2).sum())

    def transform(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("n")
        n, x = part["n"].to_numpy(), part["x"].to_numpy(float)
        first = int(part["chunk"].iloc[0]) * chunk
        starts = np.arange(first, min(first + chunk, int(n[-1]) - nfft + 2), hop)
        if not len(starts):
            return pd.DataFrame({"frame": [], "bin": [], "power": []}).astype({"frame": "int64", "bin": "int64", "power": float})
        cut = np.lib.stride_tricks.sliding_window_view(x, nfft)[starts - int(n[0])]
        power = np.abs(np.fft.rfft(cut * window, axis=1)) ** 2 / scale
        bins = power.shape[1]
        return pd.DataFrame({"frame": np.repeat(starts // hop, bins), "bin": np.tile(np.arange(bins), len(starts)), "power": power.ravel()})

    halo = ordered.with_halo(samples.select(F.col("n").cast("long").alias("n"), F.col("x").cast("double").alias("x")), 0, nfft - hop, "n", chunk)
    return halo.where("chunk >= 0").select("chunk", "n", "x").groupBy("chunk").applyInPandas(transform, "frame long, bin long, power double")


def spectrogram(samples: DataFrame, nfft: int, hop: int, row_of) -> DataFrame:
    """row, bin: mean power of all, of even and of odd frames, by the frame's number in the stream; k and k_even count them.

    row_of gives a frame's row, or is the number of frames of a row.
    """
    p = periodograms(samples, nfft, hop)
    even = F.col("frame") % 2 == 0
    row = F.floor(F.col("frame") / row_of) if isinstance(row_of, int) else row_of(F.col("frame"))
    return p.groupBy(row.alias("row"), "bin").agg(F.avg("power").alias("power"), F.avg(F.when(even, F.col("power"))).alias("even"), F.avg(F.when(~even, F.col("power"))).alias("odd"), F.count("*").alias("k"), F.count_if(even).alias("k_even"))


def integrate(spectra: DataFrame) -> DataFrame:
    """One row from many, weighted by their frames."""
    return spectra.groupBy("bin").agg((F.sum(F.col("power") * F.col("k")) / F.sum("k")).alias("power"), F.sum("k").alias("k"))


def noise_floor(spectra: DataFrame, value: str = "power") -> DataFrame:
    """bin, level: the median over time."""
    return spectra.groupBy("bin").agg(F.median(value).alias("level"))


def decibel(x: Column) -> Column:
    return 10 * F.log10(x)


def levels(power: Column, low: float, high: float) -> Column:
    """dB on a fixed range as 0 to 255."""
    return F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.rint((decibel(power) - low) / (high - low) * 255))).cast("int")


def tiles(spectra: DataFrame, low: float, high: float, level: int) -> DataFrame:
    """row, bin, byte: the maximum over 2 ** level rows."""
    return spectra.groupBy(F.shiftright("row", level).alias("row"), "bin").agg(F.max(levels(F.col("power"), low, high)).alias("byte"))


def pyramid(spectra: DataFrame, low: float, high: float, rows: int) -> DataFrame:
    """level, row, bin, byte: each level halves the rows by the maximum, down to one row. A cell goes to all levels at once, and partial maxima are shuffled."""
    most = max(0, (max(rows, 1) - 1).bit_length())
    x = spectra.select("row", "bin", levels(F.col("power"), low, high).alias("byte"), F.explode(F.sequence(F.lit(0), F.lit(most))).alias("level"))
    return x.groupBy("level", F.call_function("shiftright", F.col("row"), F.col("level")).alias("row"), "bin").agg(F.max("byte").alias("byte"))


def tile_at(cells: DataFrame, wanted: DataFrame, height: int, width: int) -> DataFrame:
    """wanted (level, tile_row, tile_col) with cells and total: what a tile of the pyramid holds, 0 past the edge."""
    t = cells.groupBy("level", F.floor(F.col("row") / height).alias("tile_row"), F.floor(F.col("bin") / width).alias("tile_col")).agg(F.count("*").alias("cells"), F.sum("byte").alias("total"))
    return wanted.join(t, ["level", "tile_row", "tile_col"], "left").fillna(0, ["cells", "total"])


def zoom(samples: DataFrame, low: float, high: float, points: int) -> DataFrame:
    """point, re, im: the DTFT at so many frequencies from low to high, in cycles a sample; one pass, partial sums by point."""
    f = F.lit(low) + F.col("point") * ((high - low) / max(points - 1, 1))
    x = samples.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("turn", 2 * math.pi * f * F.col("n"))
    return x.groupBy("point").agg(F.sum(F.col("x") * F.cos("turn")).alias("re"), F.sum(-F.col("x") * F.sin("turn")).alias("im"))


def autocorrelation(samples: DataFrame, lags: list[int]) -> DataFrame:
    """lag, r: mean product of samples of (n, x) so far apart, by an equality join on the shifted position."""
    lag = F.explode(F.array(*map(F.lit, lags)))
    a = samples.select("n", F.col("x").alias("a"), lag.alias("lag")).withColumn("m", F.col("n") + F.col("lag"))
    return a.join(samples.select(F.col("n").alias("m"), F.col("x").alias("b")), "m").groupBy("lag").agg(F.avg(F.col("a") * F.col("b")).alias("r"), F.count("*").alias("pairs"))
