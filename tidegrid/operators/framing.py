"""Framing: check sums of many parameter sets, sync words, periods, frames on a grid, and columns of recurring frames."""

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import log_binomial_tail
from .bits import numbers


@dataclass(frozen=True)
class Crc:
    """Parameters of a check sum in the usual notation; check is its value over the digits 1 to 9."""

    name: str
    width: int
    poly: int
    init: int
    refin: bool
    refout: bool
    xorout: int
    check: int


#: Published parameter sets. Their order decides ties.
CRCS = tuple(
    Crc(*row)
    for row in (
        ("CRC-16/CCITT-FALSE", 16, 0x1021, 0xFFFF, False, False, 0x0000, 0x29B1),
        ("CRC-16/X-25", 16, 0x1021, 0xFFFF, True, True, 0xFFFF, 0x906E),
        ("CRC-16/XMODEM", 16, 0x1021, 0x0000, False, False, 0x0000, 0x31C3),
        ("CRC-16/KERMIT", 16, 0x1021, 0x0000, True, True, 0x0000, 0x2189),
        ("CRC-16/MCRF4XX", 16, 0x1021, 0xFFFF, True, True, 0x0000, 0x6F91),
        ("CRC-16/AUG-CCITT", 16, 0x1021, 0x1D0F, False, False, 0x0000, 0xE5CC),
        ("CRC-16/GENIBUS", 16, 0x1021, 0xFFFF, False, False, 0xFFFF, 0xD64E),
        ("CRC-16/ARC", 16, 0x8005, 0x0000, True, True, 0x0000, 0xBB3D),
        ("CRC-16/MODBUS", 16, 0x8005, 0xFFFF, True, True, 0x0000, 0x4B37),
        ("CRC-16/USB", 16, 0x8005, 0xFFFF, True, True, 0xFFFF, 0xB4C8),
        ("CRC-16/BUYPASS", 16, 0x8005, 0x0000, False, False, 0x0000, 0xFEE8),
        ("CRC-16/DNP", 16, 0x3D65, 0x0000, True, True, 0xFFFF, 0xEA82),
        ("CRC-16/EN-13757", 16, 0x3D65, 0x0000, False, False, 0xFFFF, 0xC2B7),
        ("CRC-16/DECT-X", 16, 0x0589, 0x0000, False, False, 0x0000, 0x007F),
        ("CRC-16/T10-DIF", 16, 0x8BB7, 0x0000, False, False, 0x0000, 0xD0DB),
        ("CRC-16/CDMA2000", 16, 0xC867, 0xFFFF, False, False, 0x0000, 0x4C06),
        ("CRC-8", 8, 0x07, 0x00, False, False, 0x00, 0xF4),
        ("CRC-8/MAXIM", 8, 0x31, 0x00, True, True, 0x00, 0xA1),
        ("CRC-8/ROHC", 8, 0x07, 0xFF, True, True, 0x00, 0xD0),
        ("CRC-8/DARC", 8, 0x39, 0x00, True, True, 0x00, 0x15),
        ("CRC-8/DVB-S2", 8, 0xD5, 0x00, False, False, 0x00, 0xBC),
        ("CRC-8/ITU", 8, 0x07, 0x00, False, False, 0x55, 0xA1),
        ("CRC-8/SAE-J1850", 8, 0x1D, 0xFF, False, False, 0xFF, 0x4B),
        ("CRC-8/WCDMA", 8, 0x9B, 0x00, True, True, 0x00, 0x25),
        ("CRC-32", 32, 0x04C11DB7, 0xFFFFFFFF, True, True, 0xFFFFFFFF, 0xCBF43926),
        ("CRC-32/BZIP2", 32, 0x04C11DB7, 0xFFFFFFFF, False, False, 0xFFFFFFFF, 0xFC891918),
        ("CRC-32/MPEG-2", 32, 0x04C11DB7, 0xFFFFFFFF, False, False, 0x00000000, 0x0376E6E7),
        ("CRC-32/POSIX", 32, 0x04C11DB7, 0x00000000, False, False, 0xFFFFFFFF, 0x765E7680),
        ("CRC-32/JAMCRC", 32, 0x04C11DB7, 0xFFFFFFFF, True, True, 0x00000000, 0x340BC6D9),
        ("CRC-32C", 32, 0x1EDC6F41, 0xFFFFFFFF, True, True, 0xFFFFFFFF, 0xE3069283),
        ("CRC-32/XFER", 32, 0x000000AF, 0x00000000, False, False, 0x00000000, 0xBD0BE338),
    )
)
#: Sync words (name, word, width) and the bit errors that a hit may have.
SYNC_WORDS = (("CCSDS ASM", 0x1ACFFC1D, 32), ("POCSAG", 0x7CD215D8, 32))
SYNC_ERRORS = 3


def octets(data: Column) -> Column:
    """The bytes of a BINARY column as an array of numbers, in time linear in its length."""
    return F.transform(F.filter(F.split(F.decode(data, "ISO-8859-1"), ""), lambda c: F.length(c) > 0), lambda c: F.ascii(c).cast("long"))


def _reflected(x: int, width: int) -> int:
    return int(f"{x:0{width}b}"[::-1], 2)


def crc_table(crc: Crc) -> list[int]:
    """The register after each of the 256 bytes, from a zero register; a reflected sum uses the mirrored register."""
    top, mask, out = 1 << (crc.width - 1), (1 << crc.width) - 1, []
    for byte in range(256):
        r = (_reflected(byte, 8) if crc.refin else byte) << (crc.width - 8)
        for _ in range(8):
            r = ((r << 1) ^ (crc.poly if r & top else 0)) & mask
        out.append(_reflected(r, crc.width) if crc.refin else r)
    return out


def crc_of(data: Column, crc: Crc) -> Column:
    """The check sum of an array of bytes as BIGINT; a step is one look-up. An empty array gives that of no bytes."""
    mask, rows = (1 << crc.width) - 1, numbers(crc_table(crc))
    start = F.lit(_reflected(crc.init, crc.width) if crc.refin else crc.init).cast("long")
    if crc.refin:
        step = lambda a, b: F.get(rows, a.bitwiseXOR(b).bitwiseAND(F.lit(255)).cast("int")).bitwiseXOR(F.shiftright(a, 8))
    else:
        step = lambda a, b: F.get(rows, F.shiftright(a, crc.width - 8).bitwiseXOR(b).bitwiseAND(F.lit(255)).cast("int")).bitwiseXOR(F.shiftleft(a, 8).bitwiseAND(F.lit(mask)))
    end = F.aggregate(data, start, step)
    if crc.refin != crc.refout:
        bits = [F.shiftleft(F.shiftright(end, k).bitwiseAND(F.lit(1)), crc.width - 1 - k) for k in range(crc.width)]
        end = sum(bits[1:], bits[0])
    return end.bitwiseXOR(F.lit(crc.xorout))


def crc_catalogue(frames: DataFrame, data: str, crcs: tuple[Crc, ...] = CRCS) -> DataFrame:
    """A row per frame and parameter set: crc (its name), place in the catalogue, width and sum. Bytes are cut once a frame."""
    held = frames.withColumn("__b", octets(F.col(data)))
    sums = F.array(*(F.struct(F.lit(k).alias("place"), F.lit(c.name).alias("crc"), F.lit(c.width).alias("width"), crc_of(F.col("__b"), c).alias("sum")) for k, c in enumerate(crcs)))
    return held.withColumn("__s", F.explode(sums)).select(*frames.columns, "__s.*")


def best_crc(frames: DataFrame, key: str, data: str, crcs: tuple[Crc, ...] = CRCS) -> DataFrame:
    """key, frames, crc, passes: the set that most frames of a key pass, their last bytes being the sum; the earlier set on ties, null without a pass."""
    f = frames.withColumn("__b", octets(F.col(data)))
    n = F.size("__b")

    def passes(c: Crc) -> Column:
        k = c.width // 8
        sent = F.aggregate(F.slice("__b", n - k + 1, k), F.lit(0).cast("long"), lambda a, b: a * 256 + b)
        return F.when(n > k, crc_of(F.slice("__b", 1, n - k), c) == sent).otherwise(False)

    counted = f.groupBy(key).agg(F.count("*").alias("frames"), *(F.count_if(passes(c)).alias(f"p{k}") for k, c in enumerate(crcs)))
    top = F.greatest(*(F.struct(F.col(f"p{k}").alias("passes"), F.lit(-k).alias("order"), F.lit(c.name).alias("crc")) for k, c in enumerate(crcs)))
    return counted.select(key, "frames", top.alias("x")).select(key, "frames", F.when(F.col("x.passes") > 0, F.col("x.crc")).alias("crc"), F.col("x.passes").alias("passes"))


def word_errors(high: Column, low: Column, offset: Column, word: int) -> Column:
    """Bit errors between a 32-bit word and the 32 bits that start at an offset of 0 to 63 in two 64-bit words."""
    joined = F.expr("0L") if offset is None else F.when(offset == 0, high).otherwise(F.call_function("shiftleft", high, offset.cast("int")).bitwiseOR(F.call_function("shiftrightunsigned", low, (64 - offset).cast("int"))))
    return F.bit_count(F.shiftrightunsigned(joined, 32).bitwiseXOR(F.lit(word)))


def stream_hits(words: DataFrame, word: int, errors: int, width: int = 32) -> DataFrame:
    """pos, errors, inverted: hits of a 32-bit word in a stream of 64-bit words (n, w), n dense from 0.

    The next word comes by an equality join on its number, so no task holds the
    stream. The word after the last one is missing, and so are positions that
    would need it.
    """
    after = words.select((F.col("n") - 1).alias("n"), F.col("w").alias("w2"), F.lit(True).alias("more"))
    x = words.join(after, "n", "left").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(63)))).where(F.col("more") | (F.col("k") <= 64 - width))
    e = word_errors(F.col("w"), F.coalesce("w2", F.lit(0)).cast("long"), F.col("k"), word)
    hit = x.select((F.col("n") * 64 + F.col("k")).alias("pos"), e.alias("errors"))
    return hit.where((F.col("errors") <= errors) | (F.col("errors") >= width - errors)).withColumn("inverted", F.col("errors") > errors)


def gaps(hits: DataFrame, key: str, pos: str) -> DataFrame:
    """key, pos, gap: the distance from the hit before."""
    return hits.withColumn("gap", F.col(pos) - F.lag(pos).over(Window.partitionBy(key).orderBy(pos))).where(F.col("gap").isNotNull())


def modal_gap(hits: DataFrame, key: str, pos: str, first_seen: bool = True) -> DataFrame:
    """key, period, pairs, share: the most common distance of consecutive hits; on ties the one seen first, or the smaller."""
    g = gaps(hits, key, pos).groupBy(key, "gap").agg(F.count("*").alias("pairs"), F.min(pos).alias("seen"))
    tie = F.col("seen") if first_seen else F.col("gap")
    best = g.groupBy(key).agg(F.max(F.struct("pairs", (-tie).alias("order"), "gap")).alias("x"), F.sum("pairs").alias("all"))
    return best.select(key, F.col("x.gap").alias("period"), F.col("x.pairs").alias("pairs"), (F.col("x.pairs") / F.col("all")).alias("share"))


def on_grid(hits: DataFrame, periods: DataFrame, lengths: DataFrame, key: str, pos: str) -> DataFrame:
    """key, index, start, length, status: frames at whole periods from the first hit; the last may be truncated."""
    first = hits.groupBy(key).agg(F.min(pos).alias("first"))
    f = hits.join(first, key).join(periods.select(key, "period"), key).join(lengths, key).where((F.col(pos) - F.col("first")) % F.col("period") == 0)
    f = f.withColumn("index", F.row_number().over(Window.partitionBy(key).orderBy(pos)))
    whole = F.col(pos) + F.col("period") <= F.col("length")
    return f.select(key, "index", F.col(pos).alias("start"), F.when(whole, F.col("period")).otherwise(F.col("length") - F.col(pos)).alias("bits"), F.when(whole, "complete").otherwise("truncated").alias("status"))


def binomial_tails(tests: DataFrame) -> DataFrame:
    """tests (id, n, k, p) with tail = P(X >= k), at least 1e-300, whatever the size of the counts. 0 < p < 1."""

    @F.pandas_udf("double")
    def tail(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
        return pd.Series(np.maximum(1e-300, np.exp(log_binomial_tail(k.to_numpy(float), n.to_numpy(float), p.to_numpy(float)))))

    return tests.select("id", "n", "k", "p", tail("k", "n", "p").alias("tail"))


def column_counts(frames: DataFrame, key: str, bits: str) -> DataFrame:
    """key, col, rows, ones: each column of the frames of a key, laid above each other."""
    x = frames.select(key, F.posexplode(bits).alias("col", "bit"))
    return x.groupBy(key, "col").agg(F.count("*").alias("rows"), F.sum("bit").alias("ones"))


def longest_circular_run(columns: DataFrame, key: str, col: str, flag: str, width: int) -> DataFrame:
    """key, start, length: the longest run of flagged columns when the last column is followed by the first; the smallest start on ties, none without a flag."""
    twice = columns.select(key, flag, F.explode(F.array(F.col(col), F.col(col) + width)).alias("c"))
    w = Window.partitionBy(key).orderBy("c")
    run = twice.where(flag).withColumn("run", F.col("c") - F.row_number().over(w))
    r = run.groupBy(key, "run").agg(F.min("c").alias("start"), F.least(F.count("*"), F.lit(width)).alias("length"))
    best = r.where(F.col("start") < width).groupBy(key).agg(F.max(F.struct("length", (-F.col("start")).alias("order"))).alias("x"))
    return best.select(key, (-F.col("x.order")).alias("start"), F.col("x.length").alias("length"))
