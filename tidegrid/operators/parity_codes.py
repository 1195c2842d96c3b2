"""Parity-check codes of published standards: edge tables from their rules, systematic encoding, decoding, and where blocks begin in a stream.

A code is a list of (check, variable) edges, built from turned identity blocks. Streams and code words
are rows; a code's matrices are small and go along with the task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import gf2
from .alignment import coarse_to_fine

#: Information parts of the 648-bit codes by rate; a number is the turn of an identity block of 27, a point a block of zeros.
WLAN_648 = {
    "1/2": (
        "0 . . . 0 0 . . 0 . . 0",
        "22 0 . . 17 . 0 0 12 . . .",
        "6 . 0 . 10 . . . 24 . 0 .",
        "2 . . 0 20 . . . 25 0 . .",
        "23 . . . 3 . . . 0 . 9 11",
        "24 . 23 1 17 . 3 . 10 . . .",
        "25 . . . 8 . . . 7 18 . .",
        "13 24 . . 0 . 8 . 6 . . .",
        "7 20 . 16 22 10 . . 23 . . .",
        "11 . . . 19 . . . 13 . 3 17",
        "25 . 8 . 23 18 . 14 9 . . .",
        "3 . . . 16 . . 2 25 5 . .",
    ),
    "2/3": (
        "25 26 14 . 20 . 2 . 4 . . 8 . 16 . 18",
        "10 9 15 11 . 0 . 1 . . 18 . 8 . 10 .",
        "16 2 20 26 21 . 6 . 1 26 . 7 . . . .",
        "10 13 5 0 . 3 . 7 . . 26 . . 13 . 16",
        "23 14 24 . 12 . 19 . 17 . . . 20 . 21 .",
        "6 22 9 20 . 25 . 17 . 8 . 14 . 18 . .",
        "14 23 21 11 20 . 24 . 18 . 19 . . . . 22",
        "17 11 11 20 . 21 . 26 . 3 . . 18 . 26 .",
    ),
    "3/4": (
        "16 17 22 24 9 3 14 . 4 2 7 . 26 . 2 . 21 .",
        "25 12 12 3 3 26 6 21 . 15 22 . 15 . 4 . . 16",
        "25 18 26 16 22 23 9 . 0 . 4 . 4 . 8 23 11 .",
        "9 7 0 1 17 . . 7 3 . 3 23 . 16 . . 21 .",
        "24 5 26 7 1 . . 15 24 15 . 8 . 13 . 13 . 11",
        "2 2 19 14 24 1 15 19 . 21 . 2 . 24 . 3 . 2",
    ),
    "5/6": (
        "17 13 8 21 9 3 18 12 10 0 4 15 19 2 5 10 26 19 13 13",
        "3 12 11 14 11 25 5 18 0 9 2 26 26 10 24 7 14 20 4 2",
        "22 16 4 3 10 21 12 5 21 14 19 5 . 8 5 18 11 5 5 15",
        "7 7 14 14 4 16 16 24 24 10 1 7 15 6 10 26 8 18 21 14",
    ),
}
#: The telecommand codes by length; a block is the sum of turned identity blocks of an eighth of the length.
TELECOMMAND = {
    128: (
        "0+7 2 14 6 . 0 13 0",
        "6 0+15 0 1 0 . 0 7",
        "4 1 0+15 14 11 0 . 3",
        "0 1 9 0+13 14 1 0 .",
    ),
    256: (
        "0+31 15 25 0 . 20 12 0",
        "28 0+30 29 24 0 . 1 20",
        "8 0 0+28 1 29 0 . 21",
        "18 30 0 0+30 25 26 0 .",
    ),
    512: (
        "0+63 30 50 25 . 43 62 0",
        "56 0+61 50 23 0 . 37 26",
        "16 0 0+55 27 56 0 . 43",
        "35 56 62 0+11 58 3 0 .",
    ),
}
#: Prototypes of the telemetry codes by rate (0 an identity block, k the k-th permutation), and the permutations' numbers for 1024 information bits by block size.
TELEMETRY = {
    "1/2": (
        ". . 0 . 0+1",
        "0 0 . 0 2+3+4",
        "0 5+6 . 7+8 0",
    ),
    "2/3": (
        ". . . . 0 . 0+1",
        "9+10+11 0 0 0 . 0 2+3+4",
        "0 12+13+14 0 5+6 . 7+8 0",
    ),
    "4/5": (
        ". . . . . . . . 0 . 0+1",
        "21+22+23 0 15+16+17 0 9+10+11 0 0 0 . 0 2+3+4",
        "0 24+25+26 0 18+19+20 0 12+13+14 0 5+6 . 7+8 0",
    ),
}
THETA = "3 0 1 2 2 3 0 1 0 1 2 0 2 3 0 1 2 0 1 2 0 1 2 1 2 3"
PHI = {
    512: (
        "16 103 105 0 50 29 115 30",
        "0 53 74 45 47 0 59 102",
        "0 8 119 89 31 122 1 69",
        "0 35 97 112 64 93 99 94",
    ),
    256: (
        "59 18 52 23 11 7 22 25 27 30 43 14 46 62",
        "0 32 21 36 30 29 44 29 39 14 22 15 48 55",
        "0 46 45 27 48 37 41 13 9 49 36 10 11 18",
        "0 44 51 12 15 12 4 7 2 30 53 23 29 37",
    ),
    128: (
        "1 22 0 26 0 10 5 18 3 22 3 8 25 25 2 27 7 7 15 10 4 19 7 9 26 17",
        "0 27 30 28 7 1 8 20 26 24 4 12 23 15 15 22 31 3 29 21 2 5 11 26 9 17",
        "0 12 30 18 10 16 13 9 7 15 16 18 4 23 5 3 29 11 4 8 2 11 11 3 15 13",
        "0 13 19 14 15 20 17 4 4 11 17 20 8 22 19 15 5 21 17 9 20 18 31 13 2 18",
    ),
}


@dataclass(frozen=True)
class Code:
    """n variables of which the last `punctured` are never sent; edges are sorted by check."""

    name: str
    n: int
    k: int
    punctured: int
    edges: tuple[tuple[int, int], ...]

    @property
    def sent(self) -> int:
        return self.n - self.punctured

    @property
    def checks(self) -> int:
        return self.edges[-1][0] + 1


def _code(name: str, k: int, punctured: int, n: int, ones: list[tuple[int, int]]) -> Code:
    """From all ones of the blocks' sums; what stands twice cancels."""
    odd: set = set()
    for e in ones:
        odd ^= {e}
    return Code(name, n, k, punctured, tuple(sorted(odd)))


def _cells(rows: tuple[str, ...]) -> Iterator[tuple[int, int, int]]:
    for i, row in enumerate(rows):
        for j, cell in enumerate(row.split()):
            yield from ((i, j, int(x)) for x in cell.split("+") if x != ".")


def wlan(rate: str) -> Code:
    rows, size = WLAN_648[rate], 27
    height, width = len(rows), len(rows[0].split())
    cells = list(_cells(rows))
    # The parity part: a column with turns 1, 0, 1 at the top, the middle and the bottom, then a double diagonal.
    cells += [(0, width, 1), (height // 2, width, 0), (height - 1, width, 1)]
    cells += [(i, width + c, 0) for c in range(1, height) for i in (c - 1, c)]
    ones = [(i * size + t, j * size + (t + s) % size) for i, j, s in cells for t in range(size)]
    return _code(f"802.11n n=648 r{rate}", width * size, 0, 24 * size, ones)


def telecommand(n: int) -> Code:
    size = n // 8
    ones = [(i * size + t, j * size + (t + s) % size) for i, j, s in _cells(TELECOMMAND[n]) for t in range(size)]
    return _code(f"CCSDS TC n={n}", n // 2, 0, n, ones)


def telemetry(rate: str, k: int = 1024, phi: tuple[str, ...] | None = None) -> Code:
    """The code of a rate for k information bits; for other k than 1024 the permutations' numbers are a parameter."""
    rows = TELEMETRY[rate]
    width = len(rows[0].split())
    size = k // (width - 3)
    theta, shifts = [int(x) for x in THETA.split()], [[int(x) for x in row.split()] for row in phi or PHI[size]]
    quarter = size // 4

    def target(p: int, t: int) -> int:
        if not p:
            return t
        part = 4 * t // size
        return quarter * ((theta[p - 1] + part) % 4) + (shifts[part][p - 1] + t) % quarter

    ones = [(i * size + t, j * size + target(p, t)) for i, j, p in _cells(rows) for t in range(size)]
    return _code(f"CCSDS TM k={k} r{rate}", k, size, width * size, ones)


@lru_cache(1)
def catalogue() -> tuple[Code, ...]:
    return (*map(wlan, WLAN_648), *map(telecommand, TELECOMMAND), *map(telemetry, TELEMETRY))


def edge_table(spark: SparkSession, codes: tuple[Code, ...]) -> DataFrame:
    """code, check, var: a table of the size of the codes, whatever the data."""
    return spark.createDataFrame([(c.name, a, b) for c in codes for a, b in c.edges], "code string, check int, var int")


@lru_cache(8)
def dense(code: Code) -> np.ndarray:
    h = np.zeros((code.checks, code.n), np.uint8)
    h[tuple(np.array(code.edges).T)] = 1
    return h


@lru_cache(8)
def parity_map(code: Code) -> np.ndarray:
    """k x (n - k): the parity bits of each unit message; the message stands in the first k variables."""
    reduced, pivots = gf2.eliminate(gf2.packed(dense(code)[:, ::-1])[None], code.n)
    rank = int(pivots.sum())
    if not pivots[0, : code.n - code.k].all() or rank != code.n - code.k:
        raise ValueError(f"{code.name} is not systematic in its first {code.k} variables")
    bits = gf2.unpacked(reduced[0, :rank], code.n)[:, ::-1]
    return bits[::-1, : code.k].T.copy()


def encoded(words: DataFrame, key: str, bits: str, code: Code) -> DataFrame:
    """key, code: the bits that are sent for each message of k bits; null for messages of another length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = parity_map(code).astype(np.float32)
        for batch in batches:
            rows = batch.column(1).to_pylist()
            fit = [i for i, x in enumerate(rows) if x is not None and len(x) == code.k]
            u = np.array([rows[i] for i in fit], np.float32).reshape(len(fit), code.k)
            parity = (u @ table % 2).astype(np.int32)  # sums of at most k ones are exact
            out: list = [None] * len(rows)
            for i, row in zip(fit, np.concatenate([u.astype(np.int32), parity], axis=1)[:, : code.sent].tolist()):
                out[i] = row
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int32()))], names=[key, "code"])

    return words.select(key, bits).mapInArrow(run, f"`{key}` {words.schema[key].dataType.simpleString()}, code array<int>")


@lru_cache(8)
def layers(code: Code) -> list[tuple[np.ndarray, np.ndarray]]:
    """Checks in layers that share no variable, each as (its checks' variables, which are there); so a layer is one array step."""
    by: dict[int, list[int]] = {}
    for c, v in code.edges:
        by.setdefault(c, []).append(v)
    out: list[tuple[set, list]] = []
    for own in by.values():
        for used, rows in out:
            if used.isdisjoint(own):
                break
        else:
            used, rows = set(), []
            out.append((used, rows))
        used.update(own)
        rows.append(own)
    made = []
    for _, rows in out:
        wide = max(map(len, rows))
        made.append((np.array([r + [0] * (wide - len(r)) for r in rows]), np.array([[True] * len(r) + [False] * (wide - len(r)) for r in rows])))
    return made


def min_sum(llr: np.ndarray, code: Code, alpha: float = 0.8, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Bits (words, n) of rows of soft bits (positive for 0; `sent` or n of them), and whether all checks hold.

    Layered and normalised: a layer's checks replace their messages together and the next layer sees it. Words that are done stop.
    """
    total = np.zeros((len(llr), code.n))
    total[:, : llr.shape[1]] = np.clip(np.nan_to_num(llr, posinf=1e6, neginf=-1e6), -1e6, 1e6)
    plan = layers(code)
    sent = [np.zeros((len(llr), *v.shape)) for v, _ in plan]
    done, live = np.zeros(len(llr), bool), np.arange(len(llr))
    for k in range(rounds + 1):
        hard = total[live] < 0
        holds = np.ones(len(live), bool)
        for v, there in plan:
            holds &= ~((hard[:, v] & there).sum(axis=2) % 2).any(axis=1)
        done[live[holds]] = True
        live = live[~holds]
        if not len(live) or k == rounds:
            break
        for (v, there), messages in zip(plan, sent):
            into = total[live][:, v] - messages[live]
            size = np.where(there, np.abs(into), np.inf)
            sign = np.where((into < 0) & there, -1.0, 1.0)
            two = np.partition(size, 1, axis=2)[:, :, :2] if size.shape[2] > 1 else np.repeat(size, 2, axis=2)
            first = size.argmin(axis=2)
            others = np.where(np.arange(size.shape[2]) == first[:, :, None], two[:, :, 1:2], two[:, :, :1])
            new = np.where(there, alpha * sign.prod(axis=2, keepdims=True) * sign * others, 0.0)
            change = new - messages[live]
            messages[live] = new
            step = total[live]
            step[:, v[there]] += change[:, there]
            total[live] = step
    return (total < 0).astype(np.uint8), done


def decoded(words: DataFrame, key: str, soft: str, code: Code, rounds: int = 50) -> DataFrame:
    """key, bits (the k message bits), holds: words of `sent` soft bits through min_sum(); null bits for words of another length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                rows = part.column(1).to_pylist()
                fit = [i for i, x in enumerate(rows) if x is not None and len(x) == code.sent]
                out, holds = [None] * len(rows), [None] * len(rows)
                if fit:
                    bits, done = min_sum(np.array([rows[i] for i in fit], float), code, rounds=rounds)
                    for i, b, ok in zip(fit, bits[:, : code.k].astype(np.int32).tolist(), done.tolist()):
                        out[i], holds[i] = b, ok
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.list_(pa.int32())), pa.array(holds, pa.bool_())], names=[key, "bits", "holds"])

    x = words.select(key, F.col(soft).cast("array<double>"))
    return x.mapInArrow(run, f"`{key}` {words.schema[key].dataType.simpleString()}, bits array<int>, holds boolean")


# Where blocks begin


@lru_cache(8)
def sent_checks(code: Code) -> list[np.ndarray]:
    """Checks on variables that are sent: the code's own, or sums of two that share a variable that is not."""
    by: dict[int, set[int]] = {}
    for c, v in code.edges:
        by.setdefault(c, set()).add(v)
    rows = list(by.values())
    for v in range(code.sent, code.n):
        have = [r for r in rows if v in r]
        rows = [r for r in rows if v not in r]
        have.sort(key=lambda r: (sum(x >= code.sent for x in r), len(r)))
        rows += [have[0] ^ r for r in have[1:]]
    return [np.array(sorted(r)) for r in rows if r and max(r) < code.sent]


@lru_cache(8)
def _screen(code: Code) -> tuple[np.ndarray, np.ndarray]:
    rows = sorted(sent_checks(code), key=len)
    wide = max(map(len, rows))
    return np.array([[*r, *[-1] * (wide - len(r))] for r in rows]), np.array([len(r) for r in rows])


def soft_syndrome(soft: np.ndarray, code: Code, starts: np.ndarray, blocks: int, every: int = 1) -> np.ndarray:
    """For each start the mean over blocks and checks of the product of tanh(L / 2), as a number of its standard deviations on noise."""
    t = np.tanh(np.nan_to_num(soft, posinf=1e6, neginf=-1e6) / 2)
    checks, weights = (x[::every] for x in _screen(code))
    power = float(np.mean(t * t))
    spread = np.sqrt(np.sum(power**weights.astype(float)) * blocks) or 1.0
    out = np.zeros(len(starts))
    for k, start in enumerate(starts):
        for b in range(blocks):
            block = np.append(t[start + b * code.sent : start + (b + 1) * code.sent], 1.0)  # -1 reads this one
            out[k] += block[checks].prod(axis=1).sum()
    return out / spread


def aligned(streams: DataFrame, key: str, soft: str, code: Code, blocks: int = 4, keep: int = 16, decode: int = 8, alpha: float = 0.1) -> DataFrame:
    """key, start, statistic, blocks: where a code's blocks begin in each stream of soft bits. Streams in which no start decodes are left out.

    All starts are scored by the soft syndrome of two blocks on a third of the checks; the best by rank on all
    blocks and checks; the best of these that reach the level which noise passes with probability alpha over all starts are
    decoded, and each of their blocks must hold. Codes that leave variables out are scored by sums of checks that do
    without them. Constant, short and mostly erased streams have no start.
    """

    def usable(x: np.ndarray) -> int:
        n = min(blocks, (len(x) - code.sent + 1) // code.sent)
        ones = float(np.mean(x < 0)) if len(x) else 0.0
        return n if n > 0 and np.count_nonzero(x) >= len(x) / 2 and min(ones, 1 - ones) >= 0.05 else 0

    starts = lambda x: np.arange(code.sent) if usable(x) else np.arange(0)
    coarse = lambda x, s: -soft_syndrome(x, code, s, min(2, usable(x)), 3)
    fine = lambda x, s: -soft_syndrome(x, code, s, usable(x))
    level = NormalDist().inv_cdf(1 - alpha / code.sent)
    best = coarse_to_fine(streams, key, soft, starts, coarse, fine, keep, decode).where(F.col("score") <= -level)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = []
            for x, start in zip(batch.column("soft"), batch.column("candidate").to_pylist()):
                own = x.values.to_numpy(zero_copy_only=False)
                n = usable(own)
                held.append(n if min_sum(own[start : start + n * code.sent].reshape(n, code.sent), code)[1].all() else 0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (key, "candidate", "score")), pa.array(held, pa.int32())], names=[key, "start", "score", "blocks"])

    kind = streams.schema[key].dataType.simpleString()
    tried = streams.select(key, F.col(soft).cast("array<double>").alias("soft")).join(best, key).mapInArrow(run, f"`{key}` {kind}, start int, score double, blocks int")
    won = tried.where("blocks > 0").groupBy(key).agg(F.min(F.struct("score", "start", "blocks")).alias("x"))
    return won.select(key, F.col("x.start").alias("start"), (-F.col("x.score")).alias("statistic"), F.col("x.blocks").alias("blocks"))
