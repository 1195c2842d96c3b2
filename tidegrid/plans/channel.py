"""Registered queries of channels; their SQL has the filters' formulas."""

from pyspark.sql import functions as F

from ..operators import channel
from .catalogue import IQ, pairs, query, r, real


def _bessel(x: str) -> str:
    return f"list_sum([pow({x} / 2, 2 * k) / pow(gamma(k + 1), 2) for k in range(40)])"


def _taps(edge: float, transition: float, attenuation: float = 60.0) -> str:
    """CTE h(k, tap), taps from 0 on, and the number of taps."""
    half = len(channel.kaiser(edge, transition, attenuation)) // 2
    beta = f"(0.1102 * ({attenuation} - 8.7))"
    window = _bessel(f"({beta} * sqrt(1 - pow(n / {half}.0, 2)))")
    return f"raw as (select n, 2 * {edge} * case when n = 0 then 1.0 else sin(2 * pi() * {edge} * n) / (2 * pi() * {edge} * n) end * {window} as tap from (select unnest(range(-{half}, {half} + 1)) as n)), h as (select n + {half} as k, tap / sum(tap) over () as tap from raw)"


@query(f"with {IQ}, o as (select row_number() over (order by n) - 1 as n, i, q from iq), z as (select n, i * cos(2 * pi() * 0.11 * n) + q * sin(2 * pi() * 0.11 * n) as i, q * cos(2 * pi() * 0.11 * n) - i * sin(2 * pi() * 0.11 * n) as q from o), {_taps(0.08, 0.05)} select (z.n + k) // 5 as n, round(sum(tap * i), 6) + 0.0 as i, round(sum(tap * q), 6) + 0.0 as q from z join h on (z.n + k) % 5 = 0 and z.n + k <= (select max(n) from o) group by 1")
def channelise(spark, d):
    """A band about 0.11 cycles a sample moved to zero, low-passed and a fifth of its samples kept, in chunks."""
    x = pairs(spark, d).select(F.lit(0).alias("rec"), "n", "i", "q")
    out = channel.channelised(x, 0.11, channel.kaiser(0.08, 0.05), 5, 700)
    return out.select("n", r(F.col("i")).alias("i"), r(F.col("q")).alias("q"))


@query(f"with s as (select event_id as n, value as x from events), {_taps(0.08, 0.04)} select (3 * n + k) // 5 as n, round(sum(3 * tap * x), 5) + 0.0 as x from s join h on (3 * n + k) % 5 = 0 and (3 * n + k) // 5 < -(-3 * (select count(*) from s) // 5) + 1 and (3 * n + k) // 5 <= (3 * (select max(n) from s) + 2) // 5 group by 1")
def resample(spark, d):
    """The events at three fifths of their rate, by the filter's phases."""
    x = real(spark, d).select(F.lit(0).alias("rec"), "n", "x")
    return channel.resampled(x, 3, 5, channel.kaiser(0.08, 0.04), 700).select("n", r(F.col("x"), 5).alias("x"))
