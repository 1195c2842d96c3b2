"""Mixing sources to target weights by capped water-filling.

Every source asks for its weight's share of the budget, but no more than a
maximum number of epochs over its own words. What capped sources leave goes to
the others by weight, until none is above its cap: with sources in order of
cap / weight, the level at which all demand is met has a closed form, so running
sums over the sources find it without iteration. Each document is then taken a
whole number of times and once more if its seeded hash is below the source's
threshold. The threshold is placed by two histograms of the hash, so that the
taken words come within one fine bin of the target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, word_count

COARSE = FINE = 4096
#: Sources whose plan is broadcast at most; more are joined by shuffle.
BROADCAST_SOURCES = 200_000


def targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), max_epochs: float = 3.0, budget_share: float = 1.0) -> DataFrame:
    """source, source_size, target from one row (source, source_size) per source; no rows give no rows.

    Weights go round over the sources by code point, null last. The window
    without partition holds one row per source, never documents.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    rank = F.row_number().over(order) - 1
    weight = F.lit(float(weights[0]))
    for i, w in enumerate(weights):
        weight = F.when(F.pmod(rank, F.lit(len(weights))) == i, F.lit(float(w))).otherwise(weight)
    t = sizes.withColumn("weight", weight).withColumn("cap", max_epochs * F.col("source_size"))
    t = t.withColumn("ratio", F.col("cap") / F.col("weight"))
    full = Window.orderBy("ratio", F.col("source").isNull(), "source")
    upto = full.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rest = full.rowsBetween(1, Window.unboundedFollowing)
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = t.withColumn("total", budget_share * F.sum("source_size").over(everything)).withColumn("capped", F.sum("cap").over(upto)).withColumn("open", F.coalesce(F.sum("weight").over(rest), F.lit(0.0)))
    # The first k sources are capped if the level that the others then share is no lower than the k-th ratio.
    t = t.withColumn("level", F.when((F.col("open") > 0) & ((F.col("total") - F.col("capped")) / F.col("open") >= F.col("ratio")), (F.col("total") - F.col("capped")) / F.col("open")))
    first = F.col("total") / F.sum("weight").over(everything)
    t = t.withColumn("level", F.coalesce(F.max(F.when(F.col("level").isNotNull(), F.struct("capped", "level"))).over(everything)["level"], first))
    return t.select("source", "source_size", F.least("cap", F.col("weight") * F.col("level")).alias("target"))


def _draw(seed: str) -> Column:
    """A number of 0 to 2**48 - 1 from a document's id, the same in each run."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))), 1, 12), 16, 10).cast("long")


def mix(documents: DataFrame, seed: str = "mix", **options) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken: how often the mix takes each document.

    Size is the text's words; null texts have none and are taken as often as
    others, for 0 words. All rows with a null source are one source. Rows with
    equal doc_id share one draw. A source without words has target 0 and its
    documents are taken 0 times. An empty table gives an empty result. Other
    columns are not read.
    """
    d, plan = _plan(documents, seed, **options)
    out = d.join(plan, F.col("source").eqNullSafe(F.col("s")))
    copies = F.col("whole") + F.when(F.col("draw") < F.col("cut"), 1).otherwise(0)
    return out.select("doc_id", "source", "size", "source_size", "target", copies.cast("int").alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def _plan(documents: DataFrame, seed: str, **options) -> tuple[DataFrame, DataFrame]:
    """The documents' sizes and draws; and per source s: source_size, target, whole copies of all, and the cut below which a draw is taken once more."""
    d = materialise(documents.select("doc_id", "source", word_count(F.col("text")).alias("size")).withColumn("draw", _draw(seed)), "mix-sizes")
    width = 2**48 // COARSE
    d = d.withColumn("bin", F.floor(F.col("draw") / width).cast("int"))
    by_bin = materialise(d.groupBy("source", "bin").agg(F.sum("size").alias("size")), "mix-bins")
    t = targets(by_bin.groupBy("source").agg(F.sum("size").alias("source_size")), **options)
    t = t.withColumn("epochs", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    t = t.withColumn("whole", F.floor("epochs").cast("int")).withColumn("part", F.col("target") - F.floor("epochs") * F.col("source_size"))
    t = materialise(t, "mix-targets")

    before = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    edge = by_bin.withColumn("low", F.coalesce(F.sum("size").over(before), F.lit(0))).join(t.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    edge = edge.where((F.col("low") <= F.col("part")) & (F.col("part") < F.col("low") + F.col("size"))).select(F.col("source").alias("s"), F.col("bin").alias("b"), "low", "part")
    fine = F.floor((F.col("draw") - F.col("bin").cast("long") * width) / (width // FINE)).cast("int")
    inner = d.join(edge, F.col("source").eqNullSafe(F.col("s")) & (F.col("bin") == F.col("b"))).groupBy("source", "bin", fine.alias("fine"), "low", "part").agg(F.sum("size").alias("size"))
    upto = Window.partitionBy("source").orderBy("fine").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # The cut stands after the fine bin whose running total comes nearest to the wanted part, or before them all.
    inner = inner.withColumn("gap", F.abs(F.col("low") + F.sum("size").over(upto) - F.col("part")))
    best = inner.groupBy("source", "bin").agg(F.min(F.struct("gap", "fine")).alias("x"), F.first(F.col("part") - F.col("low")).alias("none"))
    cut = F.col("bin").cast("long") * F.lit(width) + F.when(F.col("none") <= F.col("x.gap"), F.lit(0)).otherwise((F.col("x.fine").cast("long") + 1) * (width // FINE))
    cuts = best.select(F.col("source").alias("s"), cut.cast("long").alias("cut"))
    plan = t.join(cuts, F.col("source").eqNullSafe(F.col("s")), "left").select(F.col("source").alias("s"), "source_size", "target", "whole", F.coalesce("cut", F.lit(0)).alias("cut"))
    plan = materialise(plan, "mix-plan")
    plan = F.broadcast(plan) if plan.count() <= BROADCAST_SOURCES else plan
    return d, plan


def apply(documents: DataFrame, seed: str = "mix", **options) -> DataFrame:
    """The mix itself: each document as often as mix() takes it, with all its columns.

    Copies depend on doc_id and source only, so no text is shuffled: the plan of
    the sources goes to the documents. Null texts, sources and ids, repeated
    rows and empty tables are as in mix(). Columns with names of the plan's do no harm.
    """
    plan = _plan(documents, seed, **options)[1].select(*(F.col(c).alias(f"__{c}") for c in ("s", "whole", "cut")))
    joined = documents.withColumn("__draw", _draw(seed)).join(plan, F.col("source").eqNullSafe(F.col("__s")))
    joined = joined.withColumn("__copies", (F.col("__whole") + F.when(F.col("__draw") < F.col("__cut"), 1).otherwise(0)).cast("int"))
    return joined.where(F.col("__copies") > 0).withColumn("__k", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*documents.columns)
