"""Pages in long bit streams: sync words one batch apart, code words on their grid, messages across batches.

Streams are rows of bits (rec, n, bit), n dense from 0, or pieces of packed bits (rec, begin, octets, count), which go
through kernels as they are: a piece has its bits and the first 31 of the next one. Counts and pages go on from
chunk to chunk by one row each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import log_binomial_tail
from . import ordered, systems

#: The sync word, the idle word, bits of a word and of a batch, the function of texts, characters that end one.
SYNC, IDLE, WORD, BATCH, TEXT, ENDS = 0x7CD215D8, 0x7A89C197, 32, 544, 3, (0, 3, 4, 23)
ERRORS = 3


#: Rows of a batch that a kernel gives back, about.
_ROWS = 1 << 16


def cut(bits: np.ndarray, chunk: int) -> Iterator[tuple[int, bytes, int]]:
    """begin, octets, count of the pieces of a stream."""
    for begin in range(0, len(bits), chunk):
        part = bits[begin : begin + chunk + WORD - 1]
        yield begin, np.packbits(part).tobytes(), len(part)


def pieces(bits: DataFrame, chunk: int = ordered.CHUNK) -> DataFrame:
    """rec, begin, octets, count of streams in either form."""
    if "octets" in bits.columns:
        return bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [x.values.to_numpy(zero_copy_only=False).astype(np.uint8) for x in batch.column("bits")]
            yield pa.RecordBatch.from_arrays([batch.column("rec"), batch.column("begin"), pa.array([np.packbits(x).tobytes() for x in rows], pa.binary()), pa.array(list(map(len, rows)), pa.int32())], names=["rec", "begin", "octets", "count"])

    kind = bits.schema["rec"].dataType.simpleString()
    halo = ordered.with_halo(bits.select("rec", F.col("n").cast("long").alias("n"), F.col("bit").cast("tinyint").alias("bit")), 0, WORD - 1, "n", chunk).where("chunk >= 0")
    rows = halo.groupBy("rec", "chunk").agg(F.sort_array(F.collect_list(F.struct("n", "bit"))).alias("rows"))
    rows = rows.select("rec", (F.col("chunk") * chunk).alias("begin"), F.transform("rows", lambda x: x["bit"]).alias("bits"))
    return rows.mapInArrow(run, f"rec {kind}, begin long, octets binary, count int")


def _each(parts: DataFrame, ddl: str, find: Callable[[np.ndarray, dict], dict[str, np.ndarray]]) -> DataFrame:
    """rec and what find(bits, row) says of each piece, as columns of one length; pieces shorter than a word say nothing."""
    kind = parts.schema["rec"].dataType.simpleString()
    fields = [x.split() for x in ddl.split(", ")]
    types = {"long": pa.int64(), "boolean": pa.bool_()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            octets, made, size = batch.column("octets"), [], 0
            rows = batch.select([c for c in batch.schema.names if c not in ("rec", "octets")]).to_pylist()
            for k, row in enumerate(rows):
                if row["count"] >= WORD:
                    one = find(np.unpackbits(np.frombuffer(octets[k].as_buffer(), np.uint8), count=row["count"]), row)
                    made.append((k, one))
                    size += len(one[fields[0][0]])
                if made and (size >= _ROWS or k == len(rows) - 1):
                    which = np.repeat([i for i, _ in made], [len(x[fields[0][0]]) for _, x in made])
                    yield pa.RecordBatch.from_arrays([batch.column("rec").take(pa.array(which, pa.int64())), *(pa.array(np.concatenate([x[c] for _, x in made]), types[t]) for c, t in fields)], names=["rec", *(c for c, _ in fields)])
                    made, size = [], 0

    return parts.mapInArrow(run, f"rec {kind}, {ddl}")


def sync_hits(bits: DataFrame, chunk: int = ordered.CHUNK) -> DataFrame:
    """rec, pos, inverted: where a sync word stands in streams, with up to ERRORS wrong bits."""

    def near(b: np.ndarray, row: dict) -> dict[str, np.ndarray]:
        w = b.astype(np.uint32)
        for k in (1, 2, 4, 8, 16):
            w = w[:-k] << np.uint32(k) | w[k:]
        wrong = np.bitwise_count(w ^ np.uint32(SYNC))
        at = np.flatnonzero((wrong <= ERRORS) | (wrong >= WORD - ERRORS))
        return {"pos": row["begin"] + at, "inverted": wrong[at] > ERRORS}

    return _each(pieces(bits, chunk), "pos long, inverted boolean", near)


def grids(hits: DataFrame) -> DataFrame:
    """rec, inverted, phase, start, hits, recurrences: of each stream and polarity the place modulo a word at which most hits come a batch apart, and its first hit."""
    again = hits.select("rec", "inverted", (F.col("pos") - BATCH).alias("pos"), F.lit(1).alias("next"))
    g = hits.join(again, ["rec", "inverted", "pos"], "left").groupBy("rec", "inverted", (F.col("pos") % WORD).alias("phase"))
    g = g.agg(F.min("pos").alias("start"), F.count("*").alias("hits"), F.count("next").alias("recurrences")).where("recurrences > 0")
    order = Window.partitionBy("rec", "inverted").orderBy(F.desc("recurrences"), "phase")
    return g.withColumn("k", F.row_number().over(order)).where("k = 1").drop("k")


@lru_cache(1)
def _checks() -> np.ndarray:
    """[byte of a word, its value]: the remainder of the code bits and, above it, the parity of all."""
    one = [1 << 10]
    rest = 1
    for _ in range(WORD - 1):
        one.append(1 << 10 | rest)
        rest <<= 1
        rest ^= systems.BCH if rest >> 10 else 0
    values = np.arange(256)
    tables = [np.bitwise_xor.reduce([np.where(values >> k & 1, one[8 * (3 - b) + k], 0) for k in range(8)]) for b in range(4)]
    return np.array(tables, np.uint16)


def code_words(bits: DataFrame, grid: DataFrame, chunk: int = ordered.CHUNK) -> DataFrame:
    """rec, inverted, k, word, valid, hit: the words on each grid, numbered from the first hit; inverted ones turned."""

    def on(b: np.ndarray, row: dict) -> dict[str, np.ndarray]:
        gap = row["start"] - row["begin"]
        first = gap if gap >= 0 else gap % WORD
        count = max(0, (len(b) - first) // WORD)
        octets = np.packbits(b[first : first + WORD * count]).reshape(-1, 4) ^ np.uint8(255 if row["inverted"] else 0)
        word = octets.view(">u4").astype(np.int64).reshape(-1)
        wrong = np.bitwise_xor.reduce([t[o] for t, o in zip(_checks(), octets.T)])
        k = (first - gap) // WORD + np.arange(count)
        return {"k": k, "inverted": np.full(count, row["inverted"]), "word": word, "valid": wrong == 0, "hit": np.bitwise_count(word ^ SYNC) <= ERRORS}

    x = pieces(bits, chunk).join(grid.select("rec", "inverted", "start"), "rec")
    return _each(x, "k long, inverted boolean, word long, valid boolean, hit boolean", on).select("rec", "inverted", "k", "word", "valid", "hit")


def scan(words: DataFrame, grid: DataFrame) -> DataFrame:
    """rec, inverted, hits, recurrences, words, valid, log10_p: of each stream the polarity whose words, sync and idle apart, pass by less chance."""

    @F.pandas_udf("double")
    def tail(valid: pd.Series, total: pd.Series) -> pd.Series:
        return pd.Series(np.minimum(0.0, (log_binomial_tail(valid.to_numpy(float), total.to_numpy(float), np.full(len(valid), 2.0**-11)) + np.log(2)) / np.log(10)))

    body = words.where(~F.col("hit") & (F.col("word") != IDLE) & (F.col("word") != SYNC)).groupBy("rec", "inverted").agg(F.count("*").alias("words"), F.count_if("valid").alias("valid"))
    s = grid.join(body, ["rec", "inverted"]).withColumn("log10_p", tail("valid", "words"))
    order = Window.partitionBy("rec").orderBy("log10_p", "inverted")
    return s.withColumn("k", F.row_number().over(order)).where("k = 1").select("rec", "inverted", "hits", "recurrences", "words", "valid", "log10_p")


def pages(words: DataFrame, best: DataFrame) -> DataFrame:
    """rec, k, address, function, words, text: a page for each address word of the best polarity, with the message words up to the next address or idle word.

    The frame in the batch is part of the address. A page with a damaged word, or of another function than TEXT, has no text.
    """
    w = words.join(best.select("rec", "inverted"), ["rec", "inverted"]).where(~F.col("hit"))
    flag = F.shiftright("word", 31) == 0
    address = F.col("valid") & flag & (F.col("word") != IDLE)
    w = ordered.counted(w, "rec", "k", F.col("valid") & (flag | (F.col("word") == IDLE)), "page", ordered.CHUNK // WORD).withColumn("is_address", address)
    fields = systems.page_fields(F.col("word"), F.col("k") % 17 - 1)
    one = F.struct("k", "valid", F.shiftright("word", 11).bitwiseAND(F.lit(0xFFFFF)).alias("data"))
    g = w.where(F.col("word") != IDLE).groupBy("rec", "page").agg(F.min(F.when(F.col("is_address"), F.struct("k", fields["address"].alias("address"), fields["function"].alias("function")))).alias("a"), F.sort_array(F.collect_list(F.when(~F.col("is_address"), one))).alias("data"))
    g = g.where("a is not null")
    whole = F.forall("data", lambda x: x["valid"])
    return g.select("rec", F.col("a.k").alias("k"), F.col("a.address").alias("address"), F.col("a.function").alias("function"), (F.size("data") + 1).alias("words"), F.when(whole & (F.col("a.function") == TEXT), message(F.transform("data", lambda x: x["data"]))).alias("text"))


def _with(value: Column, made: Callable[[Column], Column]) -> Column:
    """made(value), with the value worked out once: an expression used in a function of array items would be worked out for each."""
    return F.get(F.transform(F.array(value), made), 0)


def message(data: Column) -> Column:
    """Characters of seven bits, lowest first, from 20-bit words, highest first; ends of text go, others that print nothing read as a mark."""
    spread = F.flatten(F.transform(data, lambda d: F.transform(F.sequence(F.lit(19), F.lit(0), F.lit(-1)), lambda k: F.call_function("shiftright", d, k).bitwiseAND(F.lit(1)))))
    shown = lambda c: F.when(((c >= 32) & (c < 127)) | c.isin(9, 10, 13), F.char(c)).otherwise("�")

    def codes(bits: Column) -> Column:
        count = F.floor(F.size(bits) / 7).cast("int")
        one = lambda i: F.aggregate(F.reverse(F.slice(bits, 7 * i + 1, 7)), F.lit(0).cast("long"), lambda a, b: 2 * a + b)
        return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), one)).otherwise(F.array().cast("array<bigint>"))

    def text(codes: Column) -> Column:
        last = F.coalesce(F.array_max(F.transform(codes, lambda c, i: F.when(~c.isin(*ENDS), i + 1))), F.lit(0))
        return F.array_join(F.transform(F.slice(codes, F.lit(1), last), shown), "")

    return _with(_with(spread, codes), text)


def page_words(address: Column, function: Column, text: Column) -> Column:
    """The words of a page: its address, then its text; the frame that the address asks for is the sender's business."""
    head = systems.page_word_of(F.shiftright(address, 3).bitwiseAND(F.lit(0x3FFFF)) * 4 + function)
    chars = F.transform(F.filter(F.split(text, ""), lambda c: F.length(c) > 0), lambda c: F.ascii(c))
    spread = F.flatten(F.transform(chars, lambda c: F.transform(F.sequence(F.lit(0), F.lit(6)), lambda k: F.call_function("shiftright", c, k).bitwiseAND(F.lit(1)))))

    def data(bits: Column) -> Column:
        count = F.ceil(F.size(bits) / 20).cast("int")
        one = lambda i: F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(19)), lambda k: F.coalesce(F.get(bits, 20 * i + k), F.lit(0))), F.lit(1).cast("long"), lambda a, b: 2 * a + b)
        return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), one)).otherwise(F.array().cast("array<bigint>"))

    return F.concat(F.array(head), F.transform(_with(spread, data), systems.page_word_of))
