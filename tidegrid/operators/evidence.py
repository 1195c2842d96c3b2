"""Multiple testing and the ledger of hypotheses."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def holm(tests: DataFrame, family: str, p: str, order: str, alpha: float) -> DataFrame:
    """Adds threshold and passed by Holm's step-down rule: the k-th smallest p against alpha / (m - k); after the first failure thresholds are 0.

    Tests without p get neither and don't count.
    """
    w = Window.partitionBy(family, F.col(p).isNull())
    seq = w.orderBy(p, order)
    m, k = F.count(p).over(w), F.row_number().over(seq) - 1
    t = tests.withColumn("__raw", F.lit(alpha) / (m - k))
    ok = F.min((F.col(p) <= F.col("__raw")).cast("int")).over(seq.rowsBetween(Window.unboundedPreceding, Window.currentRow)) == 1
    before = F.min((F.col(p) <= F.col("__raw")).cast("int")).over(seq.rowsBetween(Window.unboundedPreceding, -1))
    alive = F.coalesce(before, F.lit(1)) == 1
    t = t.withColumn("threshold", F.when(F.col(p).isNotNull(), F.when(alive, F.col("__raw")).otherwise(0.0))).withColumn("passed", F.when(F.col(p).isNotNull(), ok))
    return t.drop("__raw")


def top_per(df: DataFrame, key: str, order: list[Column], count: int) -> DataFrame:
    """The first rows of each key; order should end in a unique column."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= count)


#: Levels of evidence, the weakest first.
LEVELS = ("UNKNOWN", "HYPOTHESIS", "ESTIMATED", "MEASURED", "VERIFIED")


def violations(values: DataFrame) -> DataFrame:
    """The rows of values (level, value, uncertainty, proof, convention) under each rule that they break, in broken."""
    level, value = F.col("level"), F.col("value")
    rules = {
        "unknown with a value": (level == "UNKNOWN") & value.isNotNull(),
        "no value": (level != "UNKNOWN") & value.isNull(),
        "no uncertainty": (level == "ESTIMATED") & value.isNotNull() & F.col("uncertainty").isNull(),
        "proof and level differ": (level == "VERIFIED") != F.coalesce("proof", F.lit(False)),
        "convention beyond hypothesis": F.col("convention").isNotNull() & (level != "HYPOTHESIS"),
    }
    broken = F.array_compact(F.array(*(F.when(rule, name) for name, rule in rules.items())))
    return values.withColumn("broken", F.explode(broken))


def capped(values: DataFrame, which: Column) -> DataFrame:
    """Measured and estimated values among those chosen become hypotheses; capped tells which."""
    low = which & F.col("level").isin("MEASURED", "ESTIMATED")
    return values.withColumn("capped", low).withColumn("level", F.when(low, "HYPOTHESIS").otherwise(F.col("level")))
