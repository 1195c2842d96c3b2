"""Linear algebra and polynomials over GF(2): many matrices at a time, rows as packed words.

A matrix is bounded (a window matrix, a block of parity checks); a batch of them goes
through each step of the elimination at once. Column 0 is the highest bit of the first word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

ONE = np.uint64(1)


def packed(bits: np.ndarray) -> np.ndarray:
    """Rows of bits (..., columns) as words (..., words)."""
    columns = bits.shape[-1]
    words = max(1, -(-columns // 64))
    wide = np.zeros((*bits.shape[:-1], 64 * words), np.uint8)
    wide[..., :columns] = bits
    return np.packbits(wide, axis=-1).view(">u8").astype(np.uint64)


def unpacked(words: np.ndarray, columns: int) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(words).astype(">u8").view(np.uint8), axis=-1)[..., :columns]


def column(words: np.ndarray, c: int) -> np.ndarray:
    return (words[..., c // 64] >> np.uint64(63 - c % 64)) & ONE


def eliminate(matrices: np.ndarray, columns: int) -> tuple[np.ndarray, np.ndarray]:
    """The reduced row echelon form of each matrix (matrices, rows, words), and which columns are pivots (matrices, columns)."""
    m = matrices.copy()
    count, rows = m.shape[:2]
    rank, pivots = np.zeros(count, np.int64), np.zeros((count, columns), bool)
    for c in range(columns):
        bit = column(m, c).astype(bool)
        open_ = bit & (np.arange(rows) >= rank[:, None])
        found = np.flatnonzero(open_.any(axis=1))
        if not len(found):
            continue
        at, to = open_[found].argmax(axis=1), rank[found]
        pivot = m[found, at].copy()
        m[found, at] = m[found, to]
        bit[found, at] = bit[found, to]
        m[found, to] = pivot
        bit[found, to] = False
        m[found] ^= np.where(bit[found][:, :, None], pivot[:, None, :], np.uint64(0))
        pivots[found, c] = True
        rank[found] += 1
    return m, pivots


def null_space(reduced: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Bits (vectors, columns): a basis of the vectors that all rows of one reduced matrix are orthogonal to, one for each column without a pivot."""
    columns = len(pivots)
    bits = unpacked(reduced[: int(pivots.sum())], columns)
    free = np.flatnonzero(~pivots)
    out = np.zeros((len(free), columns), np.uint8)
    out[np.arange(len(free)), free] = 1
    out[:, pivots] = bits[:, free].T
    return out


def row_echelon(matrices: DataFrame, rows: str, columns: int) -> DataFrame:
    """Adds rank, reduced (the rows that are not zero) and null_vectors to rows of matrices given as arrays of BIGINT, `columns` <= 63 low bits each.

    An empty matrix has rank 0 and all unit vectors as null vectors; a null one stays null.
    """
    if not 0 < columns < 64:
        raise ValueError("1 to 63 columns")
    schema = pa.schema([("rank", pa.int32()), ("reduced", pa.list_(pa.int64())), ("null_vectors", pa.list_(pa.int64()))])
    kept = [(f.name, f.dataType.simpleString()) for f in matrices.schema]
    shift = np.uint64(64 - columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(rows).to_pylist()
            height = max([1, *(len(x) for x in lists if x)])
            words = np.zeros((len(lists), height, 1), np.uint64)
            for i, x in enumerate(lists):
                if x:
                    words[i, : len(x), 0] = np.array(x, np.int64).view(np.uint64) << shift
            reduced, pivots = eliminate(words, columns)
            ranks = pivots.sum(axis=1)
            some = [x is not None for x in lists]
            own = [(reduced[i, : ranks[i], 0] >> shift).astype(np.int64).tolist() if s else None for i, s in enumerate(some)]
            null = [(packed(null_space(reduced[i], pivots[i]))[:, 0] >> shift).astype(np.int64).tolist() if s else None for i, s in enumerate(some)]
            made = [pa.array([int(k) if s else None for k, s in zip(ranks, some)], pa.int32()), pa.array(own, schema.field(1).type), pa.array(null, schema.field(2).type)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, *schema.names])

    ddl = ", ".join(f"`{n}` {t}" for n, t in kept) + ", rank int, reduced array<bigint>, null_vectors array<bigint>"
    return matrices.mapInArrow(run, ddl)


# Polynomials as integers, bit i for x**i


def divided(a: int, b: int) -> tuple[int, int]:
    """Quotient and remainder; b is not 0."""
    quotient, d = 0, b.bit_length()
    while (shift := a.bit_length() - d) >= 0:
        quotient |= 1 << shift
        a ^= b << shift
    return quotient, a


def common_divisor(a: int, b: int) -> int:
    while b:
        a, b = b, divided(a, b)[1]
    return a


def product(a: int, b: int) -> int:
    out = 0
    while b:
        low = b & -b
        out ^= a * low
        b ^= low
    return out


def common_multiple(a: int, b: int) -> int:
    return product(divided(a, common_divisor(a, b))[0], b) if a and b else 0
