"""Names the convolutional code of a coded stream of which nothing is known.

Two outputs of one code satisfy a parity check that has each one's taps on the other. So
for each rate, start and output the pair of streams (first output, other output) is cut into
windows; at the width at which the window matrix loses a rank its null vector is that
check. Checks of all outputs are joined over the least common multiple of the first
output's taps. What is named must then hold on the whole stream, at a level corrected for all hypotheses.

Streams are rows and hypotheses of a stream go through the elimination together. Windows
are the most reliable ones, since one wrong bit hides a check.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import log_binomial_tail
from . import gf2

#: Windows beyond the width, so that a matrix of chance bits has full rank but for one in a million.
SPARE = 20
LEDGER = "outputs int, start int, accepted boolean, reason string, constraint int, generators string, inverted boolean, polarity_known boolean, windows long, failed long, log10_p double"


class _Pair:
    """The first and one other output as windows that grow step by step."""

    def __init__(self, soft: np.ndarray, outputs: int, start: int, other: int) -> None:
        a, b = soft[start::outputs], soft[start + other :: outputs]
        n = min(len(a), len(b))
        self.hypothesis, self.other = (outputs, start), other
        self.symbols = (a[:n] < 0).astype(np.uint64) << gf2.ONE | (b[:n] < 0).astype(np.uint64)
        self.sure = np.minimum(np.abs(a[:n]), np.abs(b[:n]))
        self.windows, self.least, self.steps = self.symbols, self.sure, 1

    def widen(self) -> None:
        k = self.steps
        self.windows = self.windows[:-1] << np.uint64(2) | self.symbols[k:]
        self.least = np.minimum(self.least[:-1], self.sure[k:])
        self.steps += 1

    def best(self, count: int) -> np.ndarray | None:
        """The windows whose least sure bit is surest."""
        if len(self.windows) < count:
            return None
        at = np.argsort(-self.least, kind="stable")[:count]
        return self.windows[at] << np.uint64(64 - 2 * self.steps)

    def parity(self, check: int, steps: int) -> np.ndarray:
        """The check's parity on windows side by side over the whole stream."""
        n = len(self.symbols) // steps
        words = np.zeros(n, np.uint64)
        for k in range(steps):
            words = words << np.uint64(2) | self.symbols[: n * steps].reshape(n, steps)[:, k]
        return np.bitwise_count(words & np.uint64(check)) & 1


def _checks(pairs: list[_Pair], most: int) -> dict:
    """For each pair the taps (of the first output, of the other) that its check names, or the reason why there is none."""
    found, open_ = {}, list(pairs)
    for steps in range(2, most + 1):
        ready, rows = [], []
        for p in open_:
            if p.steps < steps and len(p.windows) > 1:
                p.widen()
            best = p.best(2 * steps + SPARE) if p.steps == steps else None
            if best is None:
                found[id(p)] = "too few windows"
            else:
                ready.append(p)
                rows.append(best)
        if not ready:
            return found
        reduced, pivots = gf2.eliminate(np.stack(rows)[:, :, None], 2 * steps)
        lost, open_ = 2 * steps - pivots.sum(axis=1), []
        for k, p in enumerate(ready):
            if not lost[k]:
                open_.append(p)
            elif lost[k] > 1:
                found[id(p)] = "more than one check"
            else:
                v = gf2.null_space(reduced[k], pivots[k])[0].reshape(steps, 2)[::-1]  # newest step first: bit i is a delay of i
                other, first = (sum(int(x) << i for i, x in enumerate(v[:, j])) for j in (0, 1))
                found[id(p)] = (first, other) if first and other else "a check of one output alone"
    return found | {id(p): "no check up to the longest window" for p in open_}


def joined(checks: list[tuple[int, int]]) -> list[int]:
    """Taps of all outputs, of least degree: the first output's are the least common multiple of what the checks name."""
    first = 1
    for own, _ in checks:
        first = gf2.common_multiple(first, own)
    out = [first, *(gf2.product(other, gf2.divided(first, own)[0]) for own, other in checks)]
    shared = 0
    for g in out:
        shared = gf2.common_divisor(shared, g)
    out = [gf2.divided(g, shared)[0] for g in out]
    delay = min((g & -g).bit_length() - 1 for g in out)
    return [g >> delay for g in out]


def octal(taps: int, constraint: int) -> str:
    """As standards write it: the newest bit highest."""
    return f"{int(f'{taps:0{constraint}b}'[::-1], 2):o}"


def search(soft: np.ndarray, outputs: range = range(2, 7), longest: int = 10, alpha: float = 1e-6) -> list[dict]:
    """A row of the ledger for each hypothesis on one stream; positive numbers mean bit 0, their size how sure it is."""
    soft = np.nan_to_num(np.asarray(soft, float), posinf=1e6, neginf=-1e6)
    tried = 2 * sum(outputs) * (longest - 1)
    level, out = np.log10(alpha / tried), []
    groups = {(n, s): [_Pair(soft, n, s, k) for k in range(1, n)] for n in outputs for s in range(n)}
    checks = _checks([p for g in groups.values() for p in g], longest)
    for (n, start), pairs in groups.items():
        row = {"outputs": n, "start": start, "accepted": False, "reason": None}
        out.append(row)
        own = [checks[id(p)] for p in pairs]
        if why := next((x for x in own if isinstance(x, str)), None):
            row["reason"] = why
            continue
        taps = joined(own)
        constraint = max(g.bit_length() for g in taps)
        if constraint > longest:
            row["reason"] = "longer than searched"
            continue
        worst, votes = (-np.inf, 0, 0), set()
        for p, g in zip(pairs, taps[1:]):
            steps = max(taps[0].bit_length(), g.bit_length())
            check = sum(((g >> d & 1) << 1 | taps[0] >> d & 1) << 2 * d for d in range(steps))
            parity = p.parity(check, steps)
            failed = int(parity.sum())
            if check.bit_count() % 2:  # an inverted stream fails such a check everywhere
                votes.add(2 * failed > len(parity))
                failed = min(failed, len(parity) - failed)
            tail = float(log_binomial_tail(np.array([len(parity) - failed]), np.array([len(parity)]), np.array([0.5]))[0] / np.log(10)) if len(parity) else 0.0
            worst = max(worst, (tail, failed, len(parity)))
        row |= {"constraint": constraint, "generators": ",".join(octal(g, constraint) for g in taps), "inverted": True in votes, "polarity_known": bool(votes), "windows": worst[2], "failed": worst[1], "log10_p": worst[0]}
        row["reason"] = "the outputs disagree on the polarity" if len(votes) > 1 else "checks fail as often as by chance" if worst[0] > level else "checks hold"
        row["accepted"] = row["reason"] == "checks hold"
    return out


def ledger(streams: DataFrame, key: str, soft: str, longest: int = 10, most_outputs: int = 6, alpha: float = 1e-6) -> DataFrame:
    """key and the columns of LEDGER: each hypothesis on each stream and what decided it. A stream is one array of numbers; null and short ones are rejected everywhere."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "double": pa.float64()}
    own = pa.schema([(n, kinds[t]) for n, t in (x.split() for x in LEDGER.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0)
            for k, x in enumerate(batch.column(1)):
                rows = search(np.array(x.as_py() or [], float), range(2, most_outputs + 1), longest, alpha)
                made = pa.RecordBatch.from_pylist(rows, own)
                yield pa.RecordBatch.from_arrays([keys.take(pa.array([k] * len(rows))), *made.columns], names=[key, *own.names])

    kind = streams.schema[key].dataType.simpleString()
    return streams.select(key, F.col(soft).cast("array<double>")).mapInArrow(run, f"`{key}` {kind}, {LEDGER}")


def identify(found: DataFrame, key: str) -> DataFrame:
    """The accepted row of each key that explains most: most outputs, then the shortest code, then the earliest start. Keys without one are left out."""
    order = Window.partitionBy(key).orderBy(F.desc("outputs"), "constraint", "start")
    return found.where("accepted").withColumn("__k", F.row_number().over(order)).where("__k = 1").drop("__k", "accepted", "reason")
