"""Permutations, lags and checks on bit and symbol strings, row by row in expressions.

Strings of '0' and '1' hold bits; position 0 comes first.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F


def permuted(items: Column, size: int, source) -> Column:
    """Whole blocks of an array, each with item j taken from position source(j) of the block."""
    blocks = F.floor(F.size(items) / size).cast("int")
    at = F.sequence(F.lit(0), blocks * size - 1)
    take = lambda j: F.element_at(items, (F.floor(j / size) * size + source(j % size) + 1).cast("int"))
    return F.when(blocks > 0, F.transform(at, take)).otherwise(F.slice(items, 1, 0))


def numbers(values, kind: str = "bigint") -> Column:
    """A table of numbers as one literal, however long: an expression for each would take the planner longer than the query."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def block(rows: int, cols: int):
    """De-interleaves what was written by rows and read by columns."""
    return lambda j: (j % cols) * rows + F.floor(j / cols)


def helical(rows: int, cols: int):
    """Like block, with each row turned by its number."""
    return lambda j: ((j + F.floor(j / cols)) % cols) * rows + F.floor(j / cols)


def quadratic(k: int, f1: int, f2: int):
    """The quadratic permutation polynomial (f1 j + f2 j j) mod k."""
    return lambda j: (f1 * j + f2 * j * j) % k


def xor_lags(bits: Column, lags: tuple[int, ...]) -> Column:
    """Each bit of an array xor those so many places before; places before the start are 0."""

    def at(i, d):
        return F.when(i > d, F.element_at(bits, (i - d).cast("int"))).otherwise(0)

    def step(i):
        out = at(i, 0)
        for d in lags:
            out = out.bitwiseXOR(at(i, d))
        return out

    return F.when(F.size(bits) > 0, F.transform(F.sequence(F.lit(1), F.size(bits)), step)).otherwise(bits)


def sanitised(llr: Column, limit: float = 1e6) -> Column:
    """NaN and null to 0, infinities to the limit."""
    return F.greatest(F.lit(-limit), F.least(F.lit(limit), F.nanvl(F.coalesce(llr, F.lit(0.0)), F.lit(0.0))))


def wifi(n: int, per_carrier: int):
    """De-interleaves the coded bits of one symbol of n bits, so many on a carrier."""
    s = max(per_carrier // 2, 1)

    def source(j):
        i = (n // 16) * (j % 16) + F.floor(j / 16)
        return s * F.floor(i / s) + (i + n - F.floor(16 * i / n)) % s

    return source


def delayed_lanes(items: Column, branches: int, step: int, phase: int = 0) -> Column:
    """Undoes a convolutional interleaver: after so many leading items, lane b is delayed by (branches - 1 - b) * step of its own items; zeros come first."""
    x = F.slice(items, phase + 1, F.greatest(F.size(items) - phase, F.lit(0)))
    n = F.greatest(F.size(items) - phase, F.lit(0))
    back = lambda t: (branches - 1 - t % branches) * (step * branches)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda t: F.when(t >= back(t), F.get(x, (t - back(t)).cast("int"))).otherwise(0))).otherwise(x)


def register_bits(taps: tuple[int, ...], seed: int, count: int) -> list[int]:
    """The first bits of an additive scrambler's register; taps are the exponents of its polynomial, highest first."""
    degree, state, out = taps[0], seed, []
    for _ in range(count):
        place = lambda t, state=state: state >> (degree - 1 - t) & 1
        fed = place(0)
        out.append(fed)
        for t in taps[1:]:
            fed ^= place(t)
        state = (state << 1 | fed) & ((1 << degree) - 1)
    return out


def whitened(frame: Column, taps: tuple[int, ...], seed: int, period: int) -> Column:
    """Each bit of a frame xor the register's, which starts anew with the frame; period: bits after which the register repeats."""
    keys = numbers(register_bits(taps, seed, period), "int")
    return F.transform(frame, lambda b, i: b.bitwiseXOR(F.get(keys, (i % period).cast("int"))))


def destuffed(bits: Column) -> Column:
    """A bit string without the zero that follows five ones; null if it holds an abort of six."""
    return F.when(F.instr(bits, "111111") > 0, None).otherwise(F.regexp_replace(bits, "111110", "11111"))
