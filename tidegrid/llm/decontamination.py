"""Benchmark decontamination with DataFrame functions only.

The benchmark's word windows are a small hash set that is broadcast. A
training text is first tested by its aligned half windows: any L consecutive
words contain a block of (L + 1) // 2 words that starts at a multiple of that
length, so one hash per block, looked up in the set of the windows' blocks,
decides without false negatives whether a text can hold a window at all. Only
texts that may, each distinct one once, are cut into all their windows, which
are verified by an equality join on the words themselves.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, let, materialise

#: A word of a text that is not lower-cased yet.
WORD = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
SPANS = "array<struct<start:int,len:int>>"
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: Rows of a table that is broadcast at most; a larger one is joined by shuffle instead, with the same result.
SET_LIMIT = 200_000


def normal_words(text: Column) -> Column:
    """Lower-cased words of ASCII letters, digits and all other scripts; null texts have none."""
    norm = F.trim(F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS, " "))
    return F.filter(F.split(norm, " "), lambda w: w != "")


def benchmark_windows(benchmark: DataFrame, width: int) -> DataFrame:
    """item_id, len, gram: an item's distinct windows; an item of fewer words than width is one window."""
    items = benchmark.select("item_id", normal_words(F.col("text")).alias("w")).where(F.size("w") > 0)
    items = items.withColumn("len", F.least(F.size("w"), F.lit(width)))
    starts = F.sequence(F.lit(0), F.size("w") - F.col("len"))
    grams = F.transform(starts, lambda i: F.concat_ws(" ", F.slice("w", i + 1, F.col("len"))))
    return items.select("item_id", "len", F.explode(grams).alias("gram")).distinct()


def windows_of(words: Column, length: int) -> Column:
    starts = F.when(F.size(words) >= length, F.sequence(F.lit(0), F.size(words) - length)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.struct(i.alias("start"), F.lit(length).alias("len"), F.concat_ws(" ", F.slice(words, i + 1, length)).alias("gram")))


def half_hashes(words: Column, count: int, half: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(count)), lambda i: F.xxhash64(F.slice(words, i, half)))


def aligned_blocks(words: Column, half: int) -> Column:
    """half and hash of each block of so many words that starts at a multiple of half."""
    starts = F.when(F.size(words) >= half, F.sequence(F.lit(0), F.size(words) - half, F.lit(half))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.struct(F.lit(half).alias("half"), F.xxhash64(F.slice(words, i + 1, half)).alias("h")))


def scan(documents: DataFrame, benchmark: DataFrame, width: int = 10, set_limit: int = SET_LIMIT) -> DataFrame:
    """doc_id, text_md5, n_words, spans (word positions, sorted, of verified windows), items.

    One row per input row. Null and empty texts have no words and no hits, as
    have all texts if the benchmark is empty. Repeated rows give equal rows.
    Null item ids hit words but are not listed. Columns other than doc_id and
    text are not read.
    """
    grams = materialise(benchmark_windows(benchmark, width), "benchmark-windows")
    lengths = sorted(r[0] for r in grams.select("len").distinct().collect())  # at most width values
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = documents.select("doc_id", F.md5(text).alias("text_md5"), F.regexp_count("text", F.lit(WORD)).alias("n"))
    rows = rows.select("doc_id", "text_md5", F.coalesce("n", F.lit(0)).cast("long").alias("n_words"))
    if not lengths:
        return rows.withColumn("spans", F.array().cast(SPANS)).withColumn("items", F.array().cast(f"array<{benchmark.schema['item_id'].dataType.simpleString()}>"))

    halves = sorted({(n + 1) // 2 for n in lengths})
    sets = [grams.where(F.col("len") == n).select(F.lit((n + 1) // 2).alias("half"), F.explode(half_hashes(F.split("gram", " "), n - (n + 1) // 2 + 1, (n + 1) // 2)).alias("h")) for n in lengths]
    blocks = materialise(_union(sets).distinct(), "benchmark-blocks")
    cut = documents.where(F.col("text").isNotNull()).select(F.md5(text).alias("text_md5"), F.explode(let(normal_words(F.col("text")), lambda w: F.concat(*(aligned_blocks(w, k) for k in halves)))).alias("b"))
    may = materialise(cut.select("text_md5", "b.half", "b.h").join(_small(blocks, set_limit), ["half", "h"], "left_semi").select("text_md5").distinct(), "benchmark-candidates")

    held = documents.select(F.md5(text).alias("text_md5"), "text").where(F.col("text").isNotNull()).join(_small(may, set_limit), "text_md5", "left_semi").dropDuplicates(["text_md5"])
    held = materialise(held.select("text_md5", normal_words(F.col("text")).alias("w")), "benchmark-candidate-words")
    windows = _union([held.select("text_md5", F.explode(windows_of(F.col("w"), n)).alias("x")).select("text_md5", "x.*") for n in lengths])
    hits = windows.join(_small(grams, set_limit), ["len", "gram"])
    found = hits.groupBy("text_md5").agg(F.array_sort(F.collect_set(F.struct("start", "len"))).alias("spans"), F.collect_set("item_id").alias("items"))
    found = materialise(found, "benchmark-hits")
    size = found.agg(F.coalesce(F.sum(F.size("spans") + F.size("items")), F.lit(0))).first()[0]
    out = rows.join(F.broadcast(found) if size <= set_limit else found, "text_md5", "left")
    return out.select("doc_id", "text_md5", "n_words", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"), F.coalesce("items", F.array().cast(found.schema["items"].dataType)).alias("items"))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _small(df: DataFrame, limit: int) -> DataFrame:
    """The table, to be broadcast if it has no more rows than the limit."""
    return F.broadcast(df) if df.count() <= limit else df


def hit_words(spans: Column) -> Column:
    """How many word positions a sorted array of spans covers."""

    def step(a, s):
        end = s["start"] + s["len"]
        return F.struct(F.greatest(a["end"], end).alias("end"), (a["n"] + F.greatest(F.lit(0), end - F.greatest(a["end"], s["start"]))).cast("long").alias("n"))

    return F.aggregate(spans, F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")), step, lambda a: a["n"])


def remove_documents(documents: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """The documents without any verified window, with all their columns.

    Null and empty texts stay, repeated rows stay repeated, ties and a null
    doc_id make no difference. An empty table gives an empty result.
    """
    bad = scan(documents, benchmark, width).where(F.size("spans") > 0).select("text_md5").distinct()
    keyed = documents.withColumn("__md5", F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    return keyed.join(bad.withColumnRenamed("text_md5", "__md5"), "__md5", "left_anti").select(*documents.columns)


def remove_spans(documents: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """The documents with the words of verified windows cut out; texts without a hit stay as they are.

    A cut text is its remaining normalised words, joined by one space.
    """
    found = scan(documents, benchmark, width).where(F.size("spans") > 0).select(F.col("text_md5").alias("__md5"), F.col("spans").alias("__spans")).dropDuplicates(["__md5"])
    keyed = documents.withColumn("__md5", F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))).join(found, "__md5", "left")
    left = let(normal_words(F.col("text")), lambda w: F.array_join(F.filter(w, lambda x, i: ~F.exists(F.col("__spans"), lambda s: (i >= s["start"]) & (i < s["start"] + s["len"]))), " "))
    return keyed.withColumn("text", F.when(F.col("__spans").isNull(), F.col("text")).otherwise(left)).select(*documents.columns)
