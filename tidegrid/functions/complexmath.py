"""Complex arithmetic on (i, q) column pairs."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def power(i: Column, q: Column) -> Column:
    return i * i + q * q


def product(a: tuple[Column, Column], b: tuple[Column, Column]) -> tuple[Column, Column]:
    return a[0] * b[0] - a[1] * b[1], a[0] * b[1] + a[1] * b[0]


def conjugate(a: tuple[Column, Column]) -> tuple[Column, Column]:
    return a[0], -a[1]


def cycles(a: tuple[Column, Column]) -> Column:
    """The angle in cycles, in (-0.5, 0.5]."""
    return F.atan2(a[1], a[0]) / F.lit(6.283185307179586)
