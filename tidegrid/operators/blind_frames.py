"""Frames of a bit stream of which nothing is known: period, sync word, header fields.

A constant column shows as correlation at the frame length. Correlations at all lags come from transforms of
chunks with a halo, so no task has a stream; columns, words and fields are aggregations over
positions. What is found on the first half of the frames is tested on the second.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shared import settled
from . import framing, ordered

#: Lags searched, how far a peak stands out, rows of a half, a sync word's bits, levels of columns and fields, candidates of a stream.
LAGS, PEAK, ROWS, WORD = (24, 4096), 5.0, 32, 8
COLUMN_P, EDGE_P, FIELD_P, CANDIDATES = 0.01, 1e-3, 1e-6, 6
WIDTHS = (32, 16, 8)


def lag_sums(signs: DataFrame, most: int, chunk: int = ordered.CHUNK) -> DataFrame:
    """rec, lag, r: the sum of x[n] * x[n + lag] of each stream (rec, n, x) of whole numbers, for all lags up to most; n is dense from 0."""
    chunk = max(chunk, most)
    kind = signs.schema["rec"].dataType.simpleString()

    def transform(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        x = np.zeros(chunk + most)
        x[part["n"].to_numpy() - key[1] * chunk] = part["x"]
        size = 1 << (2 * len(x) - 1).bit_length()
        r = np.fft.irfft(np.conj(np.fft.rfft(x[:chunk], size)) * np.fft.rfft(x, size), size)[: most + 1]
        return pd.DataFrame({"rec": [key[0]] * (most + 1), "lag": np.arange(most + 1), "r": np.rint(r).astype(np.int64)})

    halo = ordered.with_halo(signs, 0, most, "n", chunk).where("chunk >= 0").select("rec", "chunk", "n", "x")
    return halo.groupBy("rec", "chunk").applyInPandas(transform, f"rec {kind}, lag long, r long").groupBy("rec", "lag").agg(F.sum("r").alias("r"))


def periods(signs: DataFrame, lags: tuple[int, int] = LAGS, peak: float = PEAK) -> DataFrame:
    """rec, period, z: lags at which a stream of signs repeats itself, the CANDIDATES strongest and none within two of a stronger one."""
    size = signs.groupBy("rec").agg(F.count("*").alias("length"))
    z = lag_sums(signs, lags[1]).join(size, "rec").where(F.col("lag").between(lags[0], F.least(F.lit(lags[1]), F.floor(F.col("length") / (2 * ROWS)))))
    z = z.withColumn("z", F.col("r") / F.sqrt(F.col("length") - F.col("lag")))
    near = Window.partitionBy("rec").orderBy("lag").rangeBetween(-2, 2)  # at most 4,096 rows a stream
    best = z.withColumn("top", F.max("z").over(near)).where((F.col("z") >= peak) & (F.col("z") == F.col("top")))
    order = Window.partitionBy("rec").orderBy(F.desc("z"), "lag")
    return best.withColumn("k", F.row_number().over(order)).where(F.col("k") <= CANDIDATES).select("rec", F.col("lag").alias("period"), "z", "length")


def _one_sided(alike: Column, rows: Column) -> Column:
    from ..functions.special import log_binomial_tail

    @F.pandas_udf("double")
    def tail(k: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series(np.minimum(0.0, log_binomial_tail(k.to_numpy(float), n.to_numpy(float), np.full(len(k), 0.5))))

    return tail(alike, rows)


def _two_sided(ones: Column, rows: Column) -> Column:
    from ..functions.special import log_binomial_tail

    @F.pandas_udf("double")
    def tail(k: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series(np.minimum(0.0, math.log(2) + log_binomial_tail(k.to_numpy(float), n.to_numpy(float), np.full(len(k), 0.5))))

    return tail(F.greatest(ones, rows - ones), rows)


def sync(signs: DataFrame, alpha: float = 1e-3) -> DataFrame:
    """rec, period, start, word, rows, hits, held, log_p: each stream's frame length and the recurring word found in the first half of its rows.

    signs: rec, n dense from 0, x: 1 for a bit 0, -1 for a bit 1. A column counts if its bits are alike beyond
    COLUMN_P; the longest circular run of such columns is the word, without edges above EDGE_P and without a run of one
    value at its end that a growing counter leaves. An end column that is alike in the first half by chance shows in the
    second, so ends that fail EDGE_P there go too; log_p allows for each word so tried. A word of which less than WORD bits
    would be left stays as it is. hits counts rows of the second half within an eighth of its bits. Streams without a word give no row.
    """
    signs = signs.select("rec", F.col("n").cast("long").alias("n"), "x")
    found = settled(periods(signs))
    cell = signs.join(found, "rec").withColumn("row", F.floor(F.col("n") / F.col("period"))).withColumn("col", F.col("n") % F.col("period"))
    cell = cell.withColumn("rows", F.floor(F.col("length") / F.col("period"))).withColumn("half", F.floor(F.col("rows") / 2)).where("row < rows")
    first, one = F.col("row") < F.col("half"), F.col("x") < 0
    columns = cell.groupBy("rec", "period", "col", "rows").agg(F.count_if(first).alias("seen"), F.count_if(first & one).alias("ones"), F.count_if(~first).alias("later"), F.count_if(~first & one).alias("later_ones"))
    alike = F.when(2 * F.col("ones") > F.col("seen"), F.col("later_ones")).otherwise(F.col("later") - F.col("later_ones"))
    columns = settled(columns.withColumn("log_p", _two_sided(F.col("ones"), F.col("seen"))).withColumn("again", _one_sided(alike, F.col("later")) <= math.log(EDGE_P)))
    flags = columns.withColumn("flag", F.col("log_p") <= math.log(COLUMN_P))
    some = flags.groupBy("rec", "period").agg(F.avg(F.col("flag").cast("double")).alias("share")).where("share <= 0.6").select("rec", "period")
    # The circle is laid out twice; runs that begin in the first turn are all runs.
    twice = flags.join(some, ["rec", "period"]).select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("turn")).withColumn("at", F.col("col") + F.col("turn") * F.col("period"))
    circle = Window.partitionBy("rec", "period").orderBy("at")
    runs = twice.where("flag").withColumn("run", F.col("at") - F.row_number().over(circle))
    firm = F.when(F.col("log_p") <= math.log(EDGE_P), F.col("at"))
    runs = runs.groupBy("rec", "period", "run", "rows").agg(F.min("at").alias("begin"), F.min(firm).alias("start"), F.max(firm).alias("end"))
    size = F.least(F.col("end") - F.col("start") + 1, F.col("period"))
    tried = found.groupBy("rec").agg(F.sum("period").alias("tried"))
    runs = runs.join(tried, "rec").withColumn("size", size)
    need = F.greatest(F.lit(WORD), F.ceil(F.log(alpha / F.col("tried")) / math.log(COLUMN_P)))
    runs = runs.where((F.col("begin") < F.col("period")) & (F.col("size") >= need) & (F.col("size") <= F.col("period") / 2))
    longest = Window.partitionBy("rec", "period").orderBy(F.desc("size"), "start")
    runs = runs.withColumn("k", F.row_number().over(longest)).where("k = 1").select("rec", "period", "rows", "start", "size")
    # The strongest evidence wins, so that parts of a period lose to the period.
    inside = columns.join(runs.drop("rows"), ["rec", "period"]).where((F.col("col") - F.col("start") + 2 * F.col("period")) % F.col("period") < F.col("size"))
    inside = inside.withColumn("place", (F.col("col") - F.col("start") + 2 * F.col("period")) % F.col("period"))
    one = F.struct("place", (2 * F.col("ones") > F.col("seen")).cast("int").alias("bit"), "again")
    words = inside.groupBy("rec", "period", "rows", "start", "size").agg((-F.sum(F.greatest(F.col("log_p"), F.lit(-690.0)))).alias("evidence"), F.sort_array(F.collect_list(one)).alias("cells"))
    words = words.withColumn("word", F.transform("cells", lambda x: x["bit"])).withColumn("again", F.transform("cells", lambda x: x["again"])).drop("cells")
    best = Window.partitionBy("rec").orderBy(F.desc("evidence"), "period")
    words = words.withColumn("k", F.row_number().over(best)).withColumn("found", F.count("*").over(Window.partitionBy("rec"))).where("k = 1")
    tail = F.size("word") - F.coalesce(F.array_max(F.transform("word", lambda b, i: F.when(b != F.element_at("word", -1), i + 1))), F.lit(0))
    cut = F.when((tail >= WORD) & (F.size("word") - tail >= WORD), F.size("word") - tail).otherwise(F.size("word"))
    words = words.withColumn("word", F.slice("word", F.lit(1), cut)).withColumn("again", F.slice("again", F.lit(1), F.size("word")))
    holds = F.transform("again", lambda h, i: F.when(h, i))
    words = words.withColumn("head", F.array_min(holds)).withColumn("end", F.array_max(holds) + 1)
    enough = F.coalesce(F.col("end") - F.col("head") >= WORD, F.lit(False))
    words = words.withColumn("head", F.when(enough, F.col("head")).otherwise(0)).withColumn("end", F.when(enough, F.col("end")).otherwise(F.size("word")))
    words = words.withColumn("tried", F.col("found") * (1 + F.col("head")) * (1 + F.size("word") - F.col("end"))).withColumn("start", (F.col("start") + F.col("head")) % F.col("period"))
    words = words.withColumn("word", F.slice("word", F.col("head") + 1, F.col("end") - F.col("head")))
    # A run of one value can end the word only now, if a column behind it was there by chance.
    words = settled(words.select("rec", "period", "rows", "start", F.slice("word", F.lit(1), cut).alias("word"), F.col("tried").alias("found")))
    held = cell.join(words.select("rec", "period", "start", "word"), ["rec", "period"]).where("row >= half")
    held = held.withColumn("place", (F.col("col") - F.col("start") + F.col("period")) % F.col("period")).where(F.col("place") < F.size("word"))
    wrong = F.element_at("word", (F.col("place") + 1).cast("int")) != (F.col("x") < 0).cast("int")
    rows = held.groupBy("rec", "row").agg(F.count_if(wrong).alias("errors"), F.first(F.size("word")).alias("size"))
    test = rows.groupBy("rec").agg(F.count("*").alias("held"), F.count_if(F.col("errors") <= F.floor(F.col("size") / 8)).alias("hits"))
    return words.join(test, "rec").withColumn("log_p", _recurrence(F.col("hits"), F.col("held"), F.size("word"), F.col("found"))).drop("found")


def _recurrence(hits: Column, held: Column, size: Column, found: Column) -> Column:
    """ln of the chance that random rows are so near the word so often, for all words that were found."""
    from ..functions.special import log_binomial_tail

    @F.pandas_udf("double")
    def tail(k: pd.Series, n: pd.Series, w: pd.Series, f: pd.Series) -> pd.Series:
        near = np.array([sum(math.comb(int(x), i) for i in range(int(x) // 8 + 1)) / 2.0 ** int(x) for x in w])
        return pd.Series(np.minimum(0.0, log_binomial_tail(k.to_numpy(float), n.to_numpy(float), near) + np.log(f.to_numpy(float))))

    return tail(hits, held, size, found)


def frames(signs: DataFrame, found: DataFrame) -> DataFrame:
    """rec, row, bits: the stream's whole frames, each from its sync word on; as arrays of the period's bits."""
    x = signs.join(found.select("rec", "period", "start"), "rec").withColumn("k", F.col("n") - F.col("start")).where("k >= 0")
    cell = F.struct((F.col("k") % F.col("period")).alias("at"), (F.col("x") < 0).cast("int").alias("bit"))
    rows = x.groupBy("rec", F.floor(F.col("k") / F.col("period")).alias("row"), "period").agg(F.transform(F.sort_array(F.collect_list(cell)), lambda c: c["bit"]).alias("bits"))
    return rows.where(F.size("bits") == F.col("period")).select("rec", "row", "bits")


def header_fields(cut: DataFrame, found: DataFrame, most: int = 128) -> DataFrame:
    """rec, fields: what stands after the sync word, byte by byte: constants, counters and the first byte that is neither; (kind, start, width, value, step).

    At each place the widest field counts of which most frames have one value, or most steps one size, at FIELD_P. Steps of 0 do not count.
    """
    x = cut.join(found.select("rec", F.size("word").alias("size")), "rec")
    place = F.explode(F.sequence(F.lit(0), F.lit((most - 8) // 8)))
    x = x.select("*", place.alias("byte")).withColumn("at", F.col("size") + 8 * F.col("byte"))
    x = x.select("rec", "row", "at", "bits", F.explode(F.array(*map(F.lit, WIDTHS))).alias("width")).where(F.col("at") + F.col("width") <= F.least(F.size("bits"), F.lit(most)))
    value = F.aggregate(F.slice("bits", F.col("at") + 1, F.col("width")), F.lit(0).cast("long"), lambda a, b: a * 2 + b)
    x = x.select("rec", "row", "at", "width", value.alias("value"))
    step = F.pmod(F.col("value") - F.lag("value").over(Window.partitionBy("rec", "at", "width").orderBy("row")), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("width")))
    x = settled(x.withColumn("step", step))
    keys = ["rec", "at", "width"]

    def modal(column: str, rows: DataFrame) -> DataFrame:
        counts = rows.groupBy(*keys, column).agg(F.count("*").alias("n"))
        return counts.groupBy(keys).agg(F.max(F.struct("n", (-F.col(column)).alias("order"))).alias("x")).select(*keys, (-F.col("x.order")).alias(column), F.col("x.n").alias(f"n_{column}"))

    total = x.groupBy(keys).agg(F.count("*").alias("rows"))
    t = total.join(modal("value", x), keys).join(modal("step", x.where("step > 0")), keys, "left")
    chance = F.pow(F.lit(2.0), -F.col("width"))
    tests = framing.binomial_tails(t.select(F.struct(*keys, F.lit("value").alias("what")).alias("id"), F.col("rows").alias("n"), F.col("n_value").alias("k"), chance.alias("p")).unionByName(t.where("n_step is not null").select(F.struct(*keys, F.lit("step").alias("what")).alias("id"), (F.col("rows") - 1).alias("n"), F.col("n_step").alias("k"), chance.alias("p"))))
    tails = tests.select("id.*", "tail").groupBy(keys).pivot("what", ["value", "step"]).agg(F.first("tail")).withColumnRenamed("value", "p_value").withColumnRenamed("step", "p_step")
    t = t.join(tails, keys)
    constant = (2 * F.col("n_value") >= F.col("rows")) & (F.col("p_value") <= FIELD_P)
    counter = (2 * F.col("n_step") >= F.col("rows") - 1) & (F.col("p_step") / chance <= FIELD_P)
    kind = F.when(constant, "constant").when(F.coalesce(counter, F.lit(False)), "counter")
    fields = t.select("rec", F.struct(F.col("at").alias("start"), (-F.col("width")).alias("order"), "width", kind.alias("kind"), "value", "step").alias("f"))
    fields = fields.groupBy("rec").agg(F.sort_array(F.collect_list("f")).alias("all"))  # at most 48 a stream
    begin = F.array_min(F.transform("all", lambda f: f["start"]))
    blank = "array<struct<kind:string,start:int,width:int,value:bigint,step:bigint>>"

    def walk(a, f):
        here = (f["start"] == a["pos"]) & ~a["over"]
        known = here & f["kind"].isNotNull()
        last = here & f["kind"].isNull() & (f["width"] == 8)
        made = F.struct(f["kind"].alias("kind"), f["start"].alias("start"), f["width"].alias("width"), F.when(f["kind"] == "constant", f["value"]).alias("value"), F.when(f["kind"] == "counter", f["step"]).alias("step"))
        free = F.struct(F.lit("variable").alias("kind"), f["start"].alias("start"), f["width"].alias("width"), F.lit(None).cast("long").alias("value"), F.lit(None).cast("long").alias("step"))
        out = F.when(known, F.concat(a["out"], F.array(made))).when(last, F.concat(a["out"], F.array(free))).otherwise(a["out"])
        return F.struct(F.when(known, a["pos"] + f["width"]).otherwise(a["pos"]).alias("pos"), (a["over"] | last).alias("over"), out.alias("out"))

    start = F.struct(begin.alias("pos"), F.lit(False).alias("over"), F.array().cast(blank).alias("out"))
    return fields.select("rec", F.aggregate("all", start, walk, lambda a: a["out"]).alias("fields"))
