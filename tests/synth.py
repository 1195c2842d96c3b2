"""Test signals as tables: each sample is a function of its number and a seed, so any partitioning gives the same stream.

A scene is rows (id, kind, start, length, rate, centre, level): kind is tone,
BPSK, QPSK, 8PSK, 16QAM, 2FSK, 4FSK or AM, rate in symbols a sample, centre in cycles
a sample, level the amplitude. Noise of unit power is added once for the stream.
"""

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.operators import codes, framing

TURN = 2 * math.pi


def uniform(seed: int, *keys) -> Column:
    """A number in (0, 1) from a seed and some columns."""
    h = F.xxhash64(F.lit(seed), *keys)
    return (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / F.lit(float(1 << 53))


def noise(seed: int, n: Column) -> tuple[Column, Column]:
    """Complex noise of unit power: two independent normals by their polar form."""
    size, turn = F.sqrt(-F.log(uniform(seed, n, F.lit(1)))), TURN * uniform(seed, n, F.lit(2))
    return size * F.cos(turn), size * F.sin(turn)


def bit(seed: int, stream: Column, k: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), stream, k), F.lit(2)).cast("int")


#: The bits of a symbol of each kind.
WIDTHS = {"BPSK": 1, "QPSK": 2, "8PSK": 3, "16QAM": 4, "2FSK": 1, "4FSK": 2}


def label(seed: int, stream: Column, k: Column, width: int) -> Column:
    """The number that the bits of symbol k make, the first highest."""
    out = F.lit(0)
    for j in range(width):
        out = out * 2 + bit(seed, stream, k * width + j)
    return out


def gray_place(x: Column, width: int) -> Column:
    """Where a Gray label stands in the natural order."""
    out = x
    for s in range(1, width):
        out = out.bitwiseXOR(F.shiftright(x, s))
    return out


def symbol(kind: str, x: Column) -> tuple[Column, Column]:
    """The point of a label, of unit mean power."""
    if kind == "16QAM":
        axis = lambda v: (2 * gray_place(v, 2) - 3) / math.sqrt(10)
        return axis(F.shiftright(x, 2)), axis(x.bitwiseAND(F.lit(3)))
    width = WIDTHS[kind]
    turn = TURN * (gray_place(x, width) + (0.5 if width == 2 else 0.0)) / (1 << width)
    return F.cos(turn), F.sin(turn)


def samples(spark: SparkSession, scene: DataFrame, count: int, seed: int, noisy: bool = True) -> DataFrame:
    """n, i, q: the stream of a scene. Each signal names its own samples; they are added by number."""
    s = scene.withColumn("n", F.explode(F.sequence(F.col("start"), F.least(F.col("start") + F.col("length"), F.lit(count)) - 1)))
    t = F.col("n") - F.col("start")
    k = F.floor(t * F.col("rate"))
    turn, sid = TURN * F.col("centre") * F.col("n"), F.col("id")
    i, q = F.lit(1.0), F.lit(0.0)
    for kind, width in WIDTHS.items():
        x = label(seed, sid, k, width)
        if kind.endswith("FSK"):
            # Tones at odd multiples of half the rate, each with a whole number of half turns a symbol about the middle.
            step = (2 * gray_place(x, width) - (1 << width) + 1) / 2
            here = TURN * step * (t * F.col("rate") - k)
            i, q = F.when(F.col("kind") == kind, F.cos(here)).otherwise(i), F.when(F.col("kind") == kind, F.sin(here)).otherwise(q)
        else:
            a, b = symbol(kind, x)
            i, q = F.when(F.col("kind") == kind, a).otherwise(i), F.when(F.col("kind") == kind, b).otherwise(q)
    i = F.when(F.col("kind") == "AM", 1 + 0.5 * F.sin(TURN * t * F.col("rate"))).otherwise(i)
    own = s.select("n", (F.col("level") * (i * F.cos(turn) - q * F.sin(turn))).alias("i"), (F.col("level") * (i * F.sin(turn) + q * F.cos(turn))).alias("q"))
    n = F.col("id")
    a, b = noise(seed, n) if noisy else (F.lit(0.0), F.lit(0.0))
    ground = spark.range(count).select(n.alias("n"), a.alias("i"), b.alias("q"))
    return ground.unionByName(own).groupBy("n").agg(F.sum("i").alias("i"), F.sum("q").alias("q"))


def impaired(stream: DataFrame, offset: float = 0.0, gain: float = 1.0, skew: float = 0.0, dc: tuple[float, float] = (0.0, 0.0), echo: tuple[int, float] | None = None) -> DataFrame:
    """A stream after a receiver's faults: carrier offset (cycles a sample), unequal gain and skewed axes (radians) of i and q, dc, and an echo so many samples later."""
    if echo:
        late = stream.select((F.col("n") + echo[0]).alias("n"), (F.col("i") * echo[1]).alias("i2"), (F.col("q") * echo[1]).alias("q2"))
        stream = stream.join(late, "n", "left").select("n", (F.col("i") + F.coalesce("i2", F.lit(0.0))).alias("i"), (F.col("q") + F.coalesce("q2", F.lit(0.0))).alias("q"))
    turn = TURN * offset * F.col("n")
    i, q = F.col("i") * F.cos(turn) - F.col("q") * F.sin(turn), F.col("i") * F.sin(turn) + F.col("q") * F.cos(turn)
    return stream.select("n", (gain * i + dc[0]).alias("i"), (q * math.cos(skew) + i * math.sin(skew) + dc[1]).alias("q"))


def frames(payloads: DataFrame, data: str, sync: int, crc: framing.Crc) -> DataFrame:
    """The rows with frame: sync word, a counter byte from the column index, the payload and the check sum of counter and payload, as BINARY."""
    body = F.concat(F.unhex(F.lpad(F.hex(F.col("index") % 256), 2, "0")), F.col(data))
    total = framing.crc_of(framing.octets(F.col("__body")), crc)
    made = payloads.withColumn("__body", body)
    return made.withColumn("frame", F.concat(F.unhex(F.lit(f"{sync:08X}")), "__body", F.unhex(F.lpad(F.hex(total), crc.width // 4, "0")))).drop("__body")


def bits_of(data: Column) -> Column:
    """The bits of a BINARY column, the highest of each byte first."""
    return F.flatten(F.transform(framing.octets(data), lambda b: F.transform(F.sequence(F.lit(7), F.lit(0), F.lit(-1)), lambda k: F.call_function("shiftright", b, k).bitwiseAND(F.lit(1)).cast("int"))))


def coded(bits: Column, code=codes.K7) -> Column:
    return codes.encode(bits, code)


def truth_matches(truth: DataFrame, found: DataFrame) -> DataFrame:
    """truth (id, start, stop, low, high) with found: the detection that covers most of it in time and frequency, null if none. Both are few rows a recording."""
    shared = lambda a0, a1, b0, b1: F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))
    f = found.select(F.col("component").alias("found"), *(F.col(c).alias("f_" + c) for c in ("start", "stop", "low", "high")))
    both = shared(F.col("start"), F.col("stop"), F.col("f_start"), F.col("f_stop")) * shared(F.col("low"), F.col("high"), F.col("f_low"), F.col("f_high"))
    met = truth.join(F.broadcast(f), (F.col("start") < F.col("f_stop")) & (F.col("f_start") < F.col("stop")) & (F.col("low") < F.col("f_high")) & (F.col("f_low") < F.col("high")))
    best = met.groupBy("id").agg(F.max_by("found", F.struct(both, -F.col("found"))).alias("found"))
    return truth.join(best, "id", "left")
