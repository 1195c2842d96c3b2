"""Error-correcting codes: convolutional, Reed-Solomon, low-density parity checks, and algebra over GF(2).

Encoders, syndromes and algebra are expressions. Decoders are array kernels over
batches of rows; each row is one code word or stream.
"""

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bits import numbers

#: The usual rate-1/2 code of seven bits, the field and roots of the (255, 223) code, puncture patterns by rate.
K7 = (7, (0o171, 0o133))
RS_FIELD, RS_FIRST_ROOT, RS_ROOT_POWER, RS_ROOTS = 0x187, 112, 11, 32
PUNCTURES = {"2/3": ("10", "11"), "3/4": ("101", "110"), "5/6": ("10101", "11010"), "7/8": ("1000101", "1111010")}


def taps(generator: int, constraint: int) -> list[int]:
    """How many bits back each tap reaches; the highest bit is the newest."""
    return [i for i in range(constraint) if generator >> (constraint - 1 - i) & 1]


def encode(bits: Column, code=K7) -> Column:
    """The coded array, all outputs of a step together, from the zero state."""
    constraint, generators = code
    at = lambda i, d: F.when(i > d, F.element_at(bits, (i - d).cast("int"))).otherwise(0)

    def outputs(i):
        out = []
        for g in generators:
            x = F.lit(0)
            for d in taps(g, constraint):
                x = x.bitwiseXOR(at(i, d))
            out.append(x)
        return F.array(*out)

    return F.when(F.size(bits) > 0, F.flatten(F.transform(F.sequence(F.lit(1), F.size(bits)), outputs))).otherwise(bits)


def syndrome(bits: Column, code=K7) -> Column:
    """The parity checks of a rate-1/2 stream, one for each step after the first constraint - 1: zeros on code words."""
    constraint, (g0, g1) = code
    steps = F.floor(F.size(bits) / 2).cast("int")
    at = lambda m, d, k: F.element_at(bits, (2 * (m - d) + 1 + k).cast("int"))

    def check(m):
        x = F.lit(0)
        for d in taps(g1, constraint):
            x = x.bitwiseXOR(at(m, d, 0))
        for d in taps(g0, constraint):
            x = x.bitwiseXOR(at(m, d, 1))
        return x

    return F.when(steps > constraint, F.transform(F.sequence(F.lit(constraint - 1), steps - 1), check)).otherwise(F.slice(bits, 1, 0))


def depunctured(llr: Column, pattern: tuple[str, ...], phase: int = 0) -> Column:
    """The mother code's soft bits with 0 for those that a pattern drops; the input starts so many sent bits into the pattern."""
    branches, period = len(pattern), len(pattern[0])
    sent = [t * branches + b for t in range(period) for b in range(branches) if pattern[b][t] == "1"]
    rank = F.array(*(F.lit(sent.index(p) if p in sent else -1) for p in range(branches * period)))
    places = F.array(*map(F.lit, sent))
    last = phase + F.size(llr) - 1
    end = F.floor(last / len(sent)) * (branches * period) + F.get(places, (last % len(sent)).cast("int")) + 1
    length = (F.ceil(end / branches) * branches).cast("int")

    def value(p):
        k = F.get(rank, (p % (branches * period)).cast("int"))
        i = F.floor(p / (branches * period)).cast("int") * len(sent) + k - phase
        return F.when((k >= 0) & (i >= 0) & (i < F.size(llr)), F.get(llr, i)).otherwise(0.0)

    return F.when(F.size(llr) > 0, F.transform(F.sequence(F.lit(0), length - 1), value)).otherwise(llr)


# Viterbi


@lru_cache(8)
def _trellis(constraint: int, generators: tuple[int, ...]) -> np.ndarray:
    """[register, output]: -1 or 1 as an output's soft value for each register of the newest bit and the state."""
    reg = np.arange(1 << constraint)
    ones = np.array([[bin(r & g).count("1") & 1 for g in generators] for r in reg])
    return 1.0 - 2.0 * ones


def viterbi(llr: np.ndarray, code=K7) -> np.ndarray:
    """The likeliest input bits of rows of soft bits (positive for 0); all states may begin, the best one ends. Ties take the path of the lower register."""
    constraint, generators = code
    sign, n, states = _trellis(constraint, tuple(generators)), len(generators), 1 << (constraint - 1)
    steps = llr.shape[1] // n
    soft = llr[:, : steps * n].reshape(len(llr), steps, n)
    register = np.arange(2 * states).reshape(states, 2)  # into state s come the registers 2 s and 2 s + 1
    before = register & (states - 1)
    metric, took = np.zeros((len(llr), states)), np.zeros((steps, len(llr), states), np.uint8)
    for t in range(steps):
        branch = soft[:, t, :] @ sign.T
        way = metric[:, before] + branch[:, register]
        took[t] = way[:, :, 1] > way[:, :, 0]
        metric = way.max(axis=2)
        metric -= metric.max(axis=1, keepdims=True)
    state, out, rows = metric.argmax(axis=1), np.zeros((len(llr), steps), np.uint8), np.arange(len(llr))
    for t in range(steps - 1, -1, -1):
        out[:, t] = state >> (constraint - 2)
        state = (state << 1 | took[t, rows, state]) & (states - 1)
    return out


def _by_length(column: pd.Series) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of equal length as one matrix, with their places."""
    size = column.map(len).to_numpy()
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        yield at, np.stack([np.asarray(column.iloc[i], float) for i in at]) if n else np.zeros((len(at), 0))


def decoded(streams: DataFrame, key: str, llr: str, code=K7) -> DataFrame:
    """key, bits: each row's soft bits decoded; rows go through the kernel by batches."""

    def run(batches):
        for batch in batches:
            out = [None] * len(batch)
            for at, matrix in _by_length(batch[llr]):
                for i, bits in zip(at, viterbi(matrix, code)):
                    out[i] = bits.tolist()
            yield pd.DataFrame({key: batch[key], "bits": out})

    kind = streams.schema[key].dataType.simpleString()
    return streams.select(key, F.col(llr).cast("array<double>").alias(llr)).mapInPandas(run, f"{key} {kind}, bits array<int>")


# Reed-Solomon over GF(256)


def field_product(a: int, b: int, poly: int = RS_FIELD) -> int:
    out = 0
    for k in range(8):
        if b >> k & 1:
            out ^= a << k
    for k in range(14, 7, -1):
        if out >> k & 1:
            out ^= poly << (k - 8)
    return out


@lru_cache(4)
def field_tables(poly: int = RS_FIELD) -> tuple[np.ndarray, np.ndarray]:
    """Powers of x (doubled) and logarithms; x is a primitive element of the fields used here."""
    exp, log, v = np.zeros(510, np.int64), np.zeros(256, np.int64), 1
    for i in range(255):
        exp[i] = exp[i + 255] = v
        log[v] = i
        v = field_product(v, 2, poly)
    return exp, log


def roots(count: int = RS_ROOTS, first: int = RS_FIRST_ROOT, power: int = RS_ROOT_POWER, poly: int = RS_FIELD) -> list[int]:
    exp, _ = field_tables(poly)
    return [int(exp[power * (first + k) % 255]) for k in range(count)]


def rs_syndromes(word: Column, at: list[int], poly: int = RS_FIELD) -> Column:
    """The values of an array of bytes, highest power first, as a polynomial at some points; all zero on code words."""

    def value(x: int) -> Column:
        times = numbers((field_product(v, x, poly) for v in range(256)), "int")
        return F.aggregate(word, F.lit(0), lambda a, b: F.get(times, a).bitwiseXOR(b.cast("int")))

    return F.array(*map(value, at))


@lru_cache(4)
def _products(poly: int) -> np.ndarray:
    """The product of two bytes at 256 times the first plus the second."""
    return np.array([[field_product(a, b, poly) for b in range(256)] for a in range(256)], np.int64).ravel()


def _times(a: np.ndarray, b: np.ndarray, poly: int) -> np.ndarray:
    return _products(poly)[np.left_shift(a, 8, dtype=np.int64) | b]


def rs_generator(at: list[int], poly: int = RS_FIELD) -> np.ndarray:
    g = np.array([1], np.int64)
    for x in at:
        g = np.append(g, 0) ^ np.append([0], _times(g, np.full(len(g), x), poly))
    return g


#: Words that go through the kernels at once.
_AT_ONCE = 8192


@lru_cache(8)
def _parity_table(size: int, at: tuple[int, ...], poly: int) -> np.ndarray:
    """[place, byte]: the check bytes of a word of `size` data bytes that is 0 but for this byte."""
    g, rest = rs_generator(list(at), poly)[1:], np.zeros(len(at), np.int64)
    units = np.empty((size, len(at)), np.int64)
    for j in range(size - 1, -1, -1):
        lead = rest[0] ^ (1 if j == size - 1 else 0)
        rest = np.append(rest[1:], 0) ^ _times(np.full(len(at), lead), g, poly)
        units[j] = rest
    return _times(np.arange(256)[None, :, None], units[:, None, :], poly).astype(np.uint8)


@lru_cache(8)
def _power_table(points: tuple[int, ...], poly: int) -> np.ndarray:
    """[degree, byte]: the byte times the powers of the points."""
    exp, log = field_tables(poly)
    powers = exp[(np.arange(255)[:, None] * log[list(points)][None, :]) % 255]
    return _times(np.arange(256)[None, :, None], powers[:, None, :], poly).astype(np.uint8)


@lru_cache(8)
def _root_table(exponents: tuple[int, ...], most: int, poly: int) -> np.ndarray:
    """[degree, byte]: the byte times that power of x to the minus exponents."""
    exp, _ = field_tables(poly)
    powers = exp[(-np.arange(most + 1)[:, None] * np.array(exponents)[None, :]) % 255]
    return _times(np.arange(256)[None, :, None], powers[:, None, :], poly).astype(np.uint8)


def _summed(rows: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """Rows of bytes: the sums of the entries that they choose, one from each table."""
    out = np.zeros((len(rows), tables.shape[2]), np.uint8)
    for start in range(0, len(rows), _AT_ONCE):
        part = np.ascontiguousarray(rows[start : start + _AT_ONCE].T)
        for own, table in zip(part, tables):
            out[start : start + _AT_ONCE] ^= table.take(own, axis=0)
    return out


def _octet_rows(rows: np.ndarray) -> np.ndarray:
    rows = np.asarray(rows)
    if rows.dtype != np.uint8 and rows.size and not (0 <= rows.min() and rows.max() <= 255):
        raise ValueError("words are made of bytes, 0 to 255")
    return rows.astype(np.uint8, copy=False)


def rs_parity(data: np.ndarray, at: list[int], poly: int = RS_FIELD) -> np.ndarray:
    """Check bytes of rows of data bytes: sums of those that each byte has by itself."""
    return _summed(_octet_rows(data), _parity_table(data.shape[1], tuple(at), poly)).astype(np.int64)


def _values(words: np.ndarray, points: tuple[int, ...], poly: int) -> np.ndarray:
    n = words.shape[1]
    return _summed(words, _power_table(points, poly)[(n - 1 - np.arange(n)) % 255])


def rs_values(words: np.ndarray, points: np.ndarray, poly: int = RS_FIELD) -> np.ndarray:
    """Rows of bytes, highest power first, as polynomials at some points, none of them 0."""
    return _values(_octet_rows(words), tuple(int(x) for x in points), poly).astype(np.int64)


#: The logarithm that stands for that of 0: powers from there on are 0.
_NONE = 511


@lru_cache(4)
def _logarithms(poly: int) -> tuple[np.ndarray, np.ndarray]:
    """exp and log like field_tables(), in short numbers: sums of two logarithms need no case for 0."""
    exp, log = field_tables(poly)
    wide, short = np.zeros(2 * _NONE + 1, np.uint8), log.astype(np.int16)
    wide[:509] = exp[np.arange(509) % 255]
    short[0] = _NONE
    return wide, short


def _locators(s: np.ndarray, most: int, poly: int) -> tuple[np.ndarray, np.ndarray]:
    """The shortest linear recurrence of each column of syndromes up to degree `most`, and its order (Berlekamp and Massey, all columns at once).

    Recurrences of a higher order are cut off; only that they are is told.
    """
    exp, log = _logarithms(poly)
    count, columns = s.shape
    now = np.zeros((most + 1, columns), np.uint8)
    now[0] = 1
    old, order, last, logs = now.copy(), np.zeros(columns, np.int16), np.zeros(columns, np.int16), log[s]
    for k in range(count):
        w = min(k, most)
        off = np.bitwise_xor.reduce(exp[log[now[: w + 1]] + logs[k - w : k + 1][::-1]], axis=0)
        old[1:] = old[:-1].copy()
        old[0] = 0
        some, size = off != 0, log[off]
        if not some.any():
            continue
        factor = np.where(some, (size - last) % 255, _NONE).astype(np.int16)
        new = now ^ exp[log[old] + factor]
        longer = some & (2 * order <= k)
        old = np.where(longer, now, old)
        last, order = np.where(longer, size, last), np.where(longer, np.int16(k + 1) - order, order)
        now = new
    return now, order


def _mended(words: np.ndarray, count: int, first: int, power: int, poly: int) -> tuple[np.ndarray, np.ndarray]:
    """As rs_mended, for at most _AT_ONCE words of type uint8."""
    n, most = words.shape[1], count // 2
    points = tuple(roots(count, first, power, poly))
    s = _values(words, points, poly)
    out, errors = words.copy(), np.zeros(len(words), np.int64)
    bad = np.flatnonzero(s.any(axis=1))
    if not len(bad):
        return out, errors
    errors[bad] = -1
    s = np.ascontiguousarray(s[bad].T)
    locator, order = _locators(s, most, poly)
    short = np.flatnonzero(order <= most)
    bad, s, locator, order = bad[short], s[:, short], locator[:, short], order[short].astype(np.int64)
    exponent = power * (n - 1 - np.arange(n))
    at = _summed(locator.T, _root_table(tuple(int(x) % 255 for x in exponent), most, poly)) == 0
    fits = np.flatnonzero(at.sum(axis=1) == order)
    if not len(fits):
        return out, errors
    bad, s, locator, order = bad[fits], s[:, fits], locator[:, fits], order[fits]
    row, place = np.nonzero(at[fits])
    exp, log = _logarithms(poly)
    # Above its order the product of locator and syndromes is 0 where the recurrence holds.
    top, logs = np.zeros((most, len(bad)), np.uint8), log[s[:most]]
    for k in range(most):
        top[k:] ^= exp[log[locator[: most - k]] + logs[k]]
    back = (-exponent[place] % 255).astype(np.int16)
    high, low, twice = np.zeros(len(row), np.uint8), np.zeros(len(row), np.uint8), (2 * back.astype(np.int64) % 255).astype(np.int16)
    for k in range(most - 1, -1, -1):
        high = exp[log[high] + back] ^ top[k, row]
    for k in range(most - 1 + most % 2, 0, -2):
        low = exp[log[low] + twice] ^ locator[k, row]
    value = np.where((high == 0) | (low == 0), 0, exp[(log[high].astype(np.int64) - log[low] + exponent[place] * (1 - first)) % 255])
    mended = words[bad]
    mended[row, place] ^= value.astype(np.uint8)
    good = ~_values(mended, points, poly).any(axis=1)
    out[bad[good]], errors[bad[good]] = mended[good], order[good]
    return out, errors


def rs_mended(words: np.ndarray, count: int = RS_ROOTS, first: int = RS_FIRST_ROOT, power: int = RS_ROOT_POWER, poly: int = RS_FIELD) -> tuple[np.ndarray, np.ndarray]:
    """Words (rows of at most 255 bytes) with up to count / 2 wrong bytes put right, and how many; -1 and the word as it came if that can't be.

    Places are the roots of the locator among the positions, values follow from its derivative (Forney).
    """
    words = _octet_rows(words)
    parts = [_mended(words[k : k + _AT_ONCE], count, first, power, poly) for k in range(0, max(1, len(words)), _AT_ONCE)]
    return np.concatenate([x for x, _ in parts]).astype(np.int64), np.concatenate([x for _, x in parts])


def rs_errors(words: np.ndarray) -> np.ndarray:
    """How many bytes of each word are wrong, -1 if they are too many."""
    words = _octet_rows(words)
    return np.concatenate([_mended(words[k : k + _AT_ONCE], RS_ROOTS, RS_FIRST_ROOT, RS_ROOT_POWER, RS_FIELD)[1] for k in range(0, max(1, len(words)), _AT_ONCE)])


def rs_correct(word: np.ndarray, count: int = RS_ROOTS, first: int = RS_FIRST_ROOT, power: int = RS_ROOT_POWER, poly: int = RS_FIELD) -> tuple[np.ndarray, int]:
    out, errors = rs_mended(np.asarray(word)[None, :], count, first, power, poly)
    return out[0], int(errors[0])


def corrected(words: DataFrame, key: str, word: str) -> DataFrame:
    """key, word, errors: each row's code word put right, words of one length together."""

    def run(batches):
        for batch in batches:
            sizes = batch[word].map(len)
            for _, part in batch.groupby(sizes):
                got, errors = rs_mended(np.stack(part[word].to_list()))
                yield pd.DataFrame({key: part[key], "word": got.tolist(), "errors": errors})

    return words.select(key, word).mapInPandas(run, f"{key} {words.schema[key].dataType.simpleString()}, word array<int>, errors int")


# Low-density parity checks


def parity_checks(bits: DataFrame, key: str, pos: str, bit: str, edges: DataFrame) -> DataFrame:
    """key, check, parity: the sum mod 2 of the bits that each check of edges (check, var) joins."""
    met = bits.join(F.broadcast(edges), F.col(pos) == F.col("var"))
    return met.groupBy(key, "check").agg(F.bit_xor(bit).alias("parity"))


def circulant_edges(shifts: list[list[int]], size: int) -> list[tuple[int, int]]:
    """(check, var) of a code made of turned identity blocks; -1 is a block of zeros."""
    return [(i * size + k, j * size + (k + s) % size) for i, row in enumerate(shifts) for j, s in enumerate(row) if s >= 0 for k in range(size)]


def min_sum(llr: np.ndarray, edges: list[tuple[int, int]], alpha: float = 0.8, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Bits of rows of soft bits (positive for 0) by layered, normalised min-sum, and whether all checks hold. Check by check, for all rows at once."""
    layers: dict[int, list[int]] = {}
    for c, v in edges:
        layers.setdefault(c, []).append(v)
    total = llr.astype(float).copy()
    sent = {c: np.zeros((len(llr), len(v))) for c, v in layers.items()}
    hard, done = total < 0, np.zeros(len(llr), bool)
    for _ in range(rounds):
        done = np.all([hard[:, v].sum(axis=1) % 2 == 0 for v in layers.values()], axis=0)
        if done.all():
            break
        for c, v in layers.items():
            into = total[:, v] - sent[c]
            size, sign = np.abs(into), np.where(into < 0, -1.0, 1.0)
            order = np.argsort(size, axis=1)
            least = np.take_along_axis(size, order[:, :1], 1)
            second = np.take_along_axis(size, order[:, 1:2], 1) if len(v) > 1 else least
            others = np.where(np.arange(len(v))[None, :] == order[:, :1], second, least)
            new = alpha * np.prod(sign, axis=1, keepdims=True) * sign * others
            new[done] = sent[c][done]
            total[:, v] = into + new
            sent[c] = new
        hard = total < 0
    return hard.astype(np.uint8), done


# GF(2)


def packed(bits: Column, start: int, count: int) -> Column:
    """A stretch of an array of bits as BIGINT, the first bit highest."""
    return F.aggregate(F.slice(bits, start + 1, count), F.lit(0).cast("long"), lambda a, b: F.shiftleft(a, 1).bitwiseOR(b.cast("long")))


def degree(a: Column) -> Column:
    """The degree of a polynomial over GF(2) held in a BIGINT; that of 0 reads 0."""
    return F.length(F.bin(a)) - 1


def poly_mod(a: Column, divisor: int, most: int = 62) -> Column:
    """The remainder of polynomials over GF(2); a has at most that degree."""
    d = divisor.bit_length() - 1
    ks = F.sequence(F.lit(most), F.lit(d), F.lit(-1))
    return F.aggregate(ks, a, lambda x, k: F.when(F.call_function("shiftright", x, k).bitwiseAND(F.lit(1)) == 1, x.bitwiseXOR(F.call_function("shiftleft", F.lit(divisor).cast("long"), k - d))).otherwise(x))


def poly_product(a: Column, b: Column, bits: int = 31) -> Column:
    """The carry-less product of polynomials of fewer than so many bits."""
    return F.aggregate(F.sequence(F.lit(0), F.lit(bits - 1)), F.lit(0).cast("long"), lambda x, k: F.when(F.call_function("shiftright", b, k).bitwiseAND(F.lit(1)) == 1, x.bitwiseXOR(F.call_function("shiftleft", a, k))).otherwise(x))


def poly_gcd(a: Column, b: Column, bits: int = 31) -> Column:
    """The greatest common divisor: the larger loses a shifted copy of the smaller, until one is 0."""
    pair = F.struct(a.alias("a"), b.alias("b"))

    def step(p, _):
        x, y = p["a"], p["b"]
        d = degree(x) - degree(y)
        less = F.when(d >= 0, x.bitwiseXOR(F.call_function("shiftleft", y, F.greatest(d, F.lit(0))))).otherwise(x)
        more = F.when(d < 0, y.bitwiseXOR(F.call_function("shiftleft", x, F.greatest(-d, F.lit(0))))).otherwise(y)
        over = (x == 0) | (y == 0)
        return F.struct(F.when(over, x).otherwise(less).alias("a"), F.when(over, y).otherwise(more).alias("b"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(2 * bits)), pair, step, lambda p: F.greatest(p["a"], p["b"]))


def gf2_rank(rows: list[int]) -> int:
    """The rank of a matrix over GF(2), its rows as integers."""
    basis: dict[int, int] = {}
    for r in rows:
        while r and (top := r.bit_length()) in basis:
            r ^= basis[top]
        if r:
            basis[r.bit_length()] = r
    return len(basis)


def ranks(matrices: DataFrame, key: str, bits: str) -> DataFrame:
    """key, rows, rank of the matrix whose rows are the bit strings of a key. One group is one window matrix, of bounded width."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({key: [part[key].iloc[0]], "rows": [len(part)], "rank": [gf2_rank([int(b, 2) for b in part[bits] if b])]})

    return matrices.select(key, bits).groupBy(key).applyInPandas(run, f"{key} {matrices.schema[key].dataType.simpleString()}, rows long, rank long")
