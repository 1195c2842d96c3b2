"""Where a structure begins in a stream: all candidates are scored roughly, the best by rank exactly."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shared import settled
from . import codes

Scorer = Callable[[np.ndarray, np.ndarray], np.ndarray]


def coarse_to_fine(streams: DataFrame, key: str, soft: str, candidates: Callable[[np.ndarray], np.ndarray], coarse: Scorer, fine: Scorer, keep: int = 32, out: int = 1) -> DataFrame:
    """key, candidate, score: of each stream (an array of numbers) the `out` candidates of least exact score; earlier ones on ties.

    A candidate is a number whose meaning the scorers know. Both scorers get a stream and many candidates at once;
    between them `keep` candidates of each stream are left. Streams without candidates give no row.
    """
    kind = streams.schema[key].dataType.simpleString()
    x = streams.select(key, F.col(soft).cast("array<double>").alias("soft"))
    x = settled(x.repartition(x.sparkSession.sparkContext.defaultParallelism, key))

    def scored(score: Scorer, given: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    own = np.array(batch.column("soft")[k].as_py() or [], float)
                    which = np.array(batch.column("some")[k].as_py() if given else candidates(own), int)
                    made = [pa.array(which, pa.int32()), pa.array(score(own, which) if len(which) else np.zeros(0), pa.float64())]
                    yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array([k] * len(which), pa.int32())), *made], names=[key, "candidate", "score"])

        return run

    ddl = f"`{key}` {kind}, candidate int, score double"
    order = Window.partitionBy(key).orderBy("score", "candidate")
    ranked = lambda df, most: df.withColumn("__k", F.row_number().over(order)).where(F.col("__k") <= most).drop("__k")
    left = ranked(x.mapInArrow(scored(coarse, False), ddl), keep)
    some = left.groupBy(key).agg(F.sort_array(F.collect_list("candidate")).alias("some"))
    return ranked(x.join(some, key).mapInArrow(scored(fine, True), ddl), out)


# Interleavers under a rate-1/2 convolutional code


def _failed(bits: np.ndarray, code=codes.K7) -> np.ndarray:
    """The share of parity checks that each row of coded bits fails; a row begins with a pair."""
    constraint, (g0, g1) = code
    a, b = bits[:, 0::2], bits[:, 1::2]
    steps = min(a.shape[1], b.shape[1])
    n = steps - constraint + 1
    if n < 1:
        return np.full(len(bits), 0.5)
    check = np.zeros((len(bits), n), np.uint8)
    for stream, other in ((a, g1), (b, g0)):
        for d in codes.taps(other, constraint):
            check ^= stream[:, constraint - 1 - d : steps - d]
    return check.mean(axis=1)


def block_start(streams: DataFrame, key: str, soft: str, source: np.ndarray, bits: int = 2048, rough: int = 768, keep: int = 32) -> DataFrame:
    """key, start, phase, rate: where the blocks of an interleaver begin in coded streams, by the share of failed parity checks.

    source: the position in a block from which each restored bit comes. A candidate is twice the start plus
    the phase, 1 where a block of odd size begins within a pair. All are scored on `rough` bits, half from
    either end of the first blocks, the `keep` best on `bits`. Streams of less than two blocks are left out.
    """
    size, phases = len(source), 2 if len(source) % 2 else 1

    def read(x: np.ndarray) -> np.ndarray:
        blocks = min(max(2, -(-bits // size)), (len(x) - size + 1) // size)
        return (np.arange(blocks)[:, None] * size + source[None, :]).ravel() if blocks > 0 else np.zeros(0, int)

    def score(most: int):
        def run(x: np.ndarray, some: np.ndarray) -> np.ndarray:
            hard, at = (x < 0).astype(np.uint8), read(x)
            if len(at) > most:
                at = np.concatenate([at[: most // 2], at[len(at) - most // 2 - len(at) % 2 :][: most // 2]])
            out = np.empty(len(some))
            for phase in (0, 1):
                own = some % 2 == phase
                out[own] = _failed(hard[some[own, None] // 2 + at[phase:][None, :]]) if own.any() else 0
            return out

        return run

    candidates = lambda x: (2 * np.arange(size)[:, None] + np.arange(phases)).ravel() if len(x) >= 2 * size else np.arange(0)
    best = coarse_to_fine(streams, key, soft, candidates, score(rough), score(1 << 62), keep)
    return best.select(key, F.floor(F.col("candidate") / 2).cast("int").alias("start"), (F.col("candidate") % 2).alias("phase"), F.col("score").alias("rate"))


def lane_start(streams: DataFrame, key: str, soft: str, lanes: int, step: int, bits: int = 2048, rough: int = 768, keep: int = 32) -> DataFrame:
    """key, lane, phase, rate: the lane of a stream's first bit and the start of a pair, for an interleaver whose k-th lane is delayed by k * step bits of its own."""
    lag = (lanes - 1) * lanes * step

    def score(most: int):
        def run(x: np.ndarray, some: np.ndarray) -> np.ndarray:
            hard = (x < 0).astype(np.uint8)
            t = np.arange(lag, len(x))
            rows = []
            for c in some.tolist():
                at = t - (lanes - 1 - (t + c // 2) % lanes) * lanes * step
                rows.append(hard[at[c % 2 :][: min(most, len(t) - 1)]])
            return _failed(np.stack(rows))

        return run

    candidates = lambda x: np.arange(2 * lanes if len(x) > lag + 64 else 0)
    best = coarse_to_fine(streams, key, soft, candidates, score(rough), score(bits), keep)
    return best.select(key, F.floor(F.col("candidate") / 2).cast("int").alias("lane"), (F.col("candidate") % 2).alias("phase"), F.col("score").alias("rate"))


# Reed-Solomon words in a stream of bits

#: Words of streams that a task scores together, about.
_WORDS = 4096


def _octet_streams(streams: DataFrame, key: str, column: str, packed: bool, count: str | None) -> DataFrame:
    """key, octets, count: bits (packed, the first one highest; 1 for a negative number) or bytes of arrays of numbers; binary columns stay."""
    kind = streams.schema[key].dataType.simpleString()
    per = 8 if packed else 1
    if streams.schema[column].dataType.simpleString() == "binary":
        x = streams.select(key, F.col(column).alias("octets"), (F.col(count) if count else F.octet_length(column) * per).cast("long").alias("count"))
    else:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [x.values.to_numpy(zero_copy_only=False) if x.is_valid else np.zeros(0) for x in batch.column(1)]
                octets = [(np.packbits(x < 0) if packed else x.astype(np.int64).astype(np.uint8)).tobytes() for x in rows]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(octets, pa.binary()), pa.array(list(map(len, rows)), pa.int64())], names=[key, "octets", "count"])

        x = streams.select(key, F.col(column).cast("array<double>")).mapInArrow(run, f"`{key}` {kind}, octets binary, count long")
    return x.repartition(key)


def _together(streams: DataFrame, key: str, least: int, ddl: str, size: int, score: Callable[[list[np.ndarray], np.ndarray], tuple]) -> DataFrame:
    """key and what score(streams, counts) finds: (which of them, columns). Streams below `least` are left out, the others go through it some at a time."""
    kind = streams.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            octets, counts = batch.column("octets"), batch.column("count").fill_null(0).to_numpy()
            rows = np.flatnonzero(counts >= least)
            words = np.cumsum([len(octets[k].as_buffer()) // size + 1 for k in rows.tolist()])
            for own in np.split(rows, np.flatnonzero(np.diff(words // _WORDS)) + 1):
                if len(own):
                    which, columns = score([np.frombuffer(octets[k].as_buffer(), np.uint8) for k in own.tolist()], counts[own])
                    yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(own[which])), *(pa.array(c.astype(np.int32)) for c in columns)], names=[key, *(c.split()[0] for c in ddl.split(", "))])

    return streams.mapInArrow(run, f"`{key}` {kind}, {ddl}")


def _decoded(words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For each block of words how many decode, and the wrong bytes of these."""
    sizes = np.array([len(w) for w in words], np.int64)
    errors = codes.rs_errors(np.concatenate(words)) if sizes.sum() else np.zeros(0, np.int64)
    ends = np.cumsum(sizes)
    sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[np.concatenate([[0], ends])])
    return sums(errors >= 0), sums(np.maximum(errors, 0))


@lru_cache(4)
def _terms(points: tuple[int, ...]) -> np.ndarray:
    """[place modulo 255, byte]: what the byte adds to the running sums at up to eight points, a byte each of one number."""
    table = codes._power_table(points, codes.RS_FIELD)[-np.arange(255) % 255]
    wide = np.zeros((255, 256, 8), np.uint8)
    wide[:, :, : len(points)] = table
    return wide.view(np.uint64)[:, :, 0].copy()


def _silent(data: np.ndarray, points: list[int], size: int, words: int) -> np.ndarray:
    """For each start modulo the size, how many of the first words' values at the points are 0."""
    return _screened(data[None, :], np.array([len(data)]), points, size, words)[0][0]


def _screened(rows: np.ndarray, ends: np.ndarray, points: list[int], size: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row of bytes and start modulo the size, how many of the first words' values at the points are 0, and whether all of one word are.

    A value is a difference of running sums over powers of the point, so a start costs one step, not a word.
    """
    n = rows.shape[1]
    out, starts, place = np.zeros((len(rows), size), np.int64), np.arange(size), np.arange(n) % 255
    clean = np.ones((words, len(rows), size), bool)
    for k in range(0, len(points), 8):
        some = tuple(points[k : k + 8])
        sums = np.zeros((len(rows), n + 1), np.uint64)
        np.bitwise_xor.accumulate(_terms(some).ravel()[place * 256 + rows], axis=1, out=sums[:, 1:])
        for w in range(words):
            end = starts + (w + 1) * size
            gap = sums.take(np.minimum(end, n), axis=1) ^ sums.take(np.minimum(starts + w * size, n), axis=1)
            zero, fits = (gap.view(np.uint8).reshape(*gap.shape, 8)[:, :, : len(some)] == 0).sum(axis=2), end <= ends[:, None]
            out += np.where(fits, zero, 0)
            clean[w] &= fits & (gap == 0)
    return out, clean.any(axis=0)


def _shifted(octets: np.ndarray, offset: int) -> np.ndarray:
    """The bytes from a bit on, along the last axis; one less."""
    x = octets.astype(np.uint16)
    return ((x[..., :-1] << offset | x[..., 1:] >> (8 - offset)) & 255).astype(np.uint8)


def word_start(streams: DataFrame, key: str, soft: str, screen: int = 4, points: int = 8, keep: int = 3, size: int = 255, count: str | None = None) -> DataFrame:
    """key, start: the bit at which words of `size` bytes begin in each stream.

    A stream is an array of numbers, or bits packed into a binary value, of which there are `count`. All 8 * size
    starts are screened by the values at a few roots over `screen` words. The `keep` best, and all others at which a screened
    word has no damage, decode their words (where blocks repeat, each turn of a word is one); the start with most decoded words
    stays, if there is one, then fewer wrong bytes, then the one after which the stream ends sooner behind the last word. A start is given up as soon as it can't be the best. Streams of less than two words are left out.
    """
    at = codes.roots()[:points]

    def score(rows: list[np.ndarray], counts: np.ndarray) -> tuple:
        near = (screen + 1) * size
        head = np.zeros((len(rows), near + 1), np.uint8)
        for k, x in enumerate(rows):
            head[k, : min(len(x), near + 1)] = x[: near + 1]
        seen = [_screened(_shifted(head, o), np.minimum((counts - o) // 8, near), at, size, screen) for o in range(8)]
        found, clean = (np.stack([x[k] for x in seen], axis=2).reshape(len(rows), -1) for k in (0, 1))
        rank = -found * found.shape[1] + np.arange(found.shape[1])
        row, start = np.nonzero(clean | (rank <= np.partition(rank, keep - 1, axis=1)[:, keep - 1 : keep]))
        order = np.lexsort((rank[row, start], row))
        row, start = row[order], start[order]
        total = (counts[row] - start) // 8 // size
        lead = np.append(True, np.diff(row) > 0)

        def words(k: int, last: int) -> np.ndarray:
            first, last = int(start[k]), min(last, int(total[k]))
            part = rows[row[k]][first // 8 : first // 8 + last * size + 1]
            part = _shifted(np.append(part, np.uint8(0)) if len(part) <= last * size else part, first % 8)
            return part[: max(0, last) * size].reshape(-1, size)

        def scores(which: np.ndarray) -> np.ndarray:
            out = [np.zeros(0)]
            for some in np.split(which, np.flatnonzero(np.diff(np.cumsum(total[which]) // (2 * _WORDS))) + 1):
                good, wrong = _decoded([words(k, 1 << 62) for k in some.tolist()])
                # Decoded words first, then fewer wrong bytes; a word has at most 16.
                out.append(-good.astype(float) + wrong / (17.0 * np.maximum(1, total[some])))
            return np.concatenate(out)

        of = np.flatnonzero(lead)
        result = np.full(len(row), np.inf)
        result[of] = scores(of)
        rest = np.flatnonzero(~lead)
        good, _ = _decoded([words(k, 1) for k in rest.tolist()])
        bound, best = -(total[rest] - (total[rest] > 0) + good).astype(float), of[row[rest]]
        rest = rest[(bound < result[best]) | ((bound == result[best]) & (start[rest] > start[best]))]
        result[rest] = scores(rest)
        order = np.lexsort((-start, result, row))
        first = order[np.append(True, np.diff(row[order]) > 0)]
        first = first[result[first] < 0]
        return row[first], [start[first]]

    return _together(_octet_streams(streams, key, soft, True, count), key, 16 * size, "start int", size, score)


def interleave_depth(streams: DataFrame, key: str, data: str, most: int = 5, size: int = 255) -> DataFrame:
    """key, depth, words: how many words of `size` bytes take turns in each stream of bytes (binary, or an array of numbers) that begins with a first byte, by how many decode; the smaller depth on ties. Streams in which none does are left out."""

    def words(x: np.ndarray, depth: int, first: int = 0) -> np.ndarray:
        n = len(x) // (size * depth)
        return x[first * size : n * size * depth].reshape(-1, size, depth).transpose(0, 2, 1).reshape(-1, size)

    def score(rows: list[np.ndarray], counts: np.ndarray) -> tuple:
        depths = np.arange(1, most + 1)
        total = counts[:, None] // (size * depths) * depths
        near = np.minimum(2 * most, counts // size)[:, None] // depths * depths
        # The first two words of each turn tell most depths apart; depths that tie there are counted on all words.
        rough = np.stack([_decoded([words(x[: 2 * most * size], d) for x in rows])[0] for d in depths.tolist()], axis=1)
        tried = np.argsort(-rough / np.maximum(1, near), axis=1, kind="stable")[:, :2]

        def whole(which: np.ndarray, c: int) -> np.ndarray:
            at = tried[which, c]
            rest, _ = _decoded([words(rows[k], int(depths[d]), int(near[k, d])) for k, d in zip(which.tolist(), at.tolist())])
            return rest + rough[which, at]

        every = np.arange(len(rows))
        best, pick = whole(every, 0), tried[:, 0].copy()
        for c in range(1, tried.shape[1]):
            at = tried[:, c]
            bound = total[every, at] - near[every, at] + rough[every, at]
            open_ = np.flatnonzero((bound > best) | ((bound == best) & (at < pick)))
            if len(open_):
                own = whole(open_, c)
                better = (own > best[open_]) | ((own == best[open_]) & (at[open_] < pick[open_]))
                best[open_[better]], pick[open_[better]] = own[better], at[open_[better]]
        which = np.flatnonzero(best > 0)
        return which, [depths[pick[which]], best[which]]

    return _together(_octet_streams(streams, key, data, False, None), key, size, "depth int, words int", size, score)
