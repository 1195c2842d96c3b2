"""Quality rules: cross-document line frequency, beside simple per-document rules.

Lines are normalised and hashed; for each host the engine counts in how many
distinct texts a line stands (copies of one text count once). A line above the
host's limit is removed from all texts of the host but the one where it first
occurs (that of the smallest doc_id). A document that loses more than a given
share of its words is depleted and rejected; the others go on without their
removed lines.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

WHITE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
DIGITS = re.compile(rb"[0-9]+")
NO_HOST = "\x00none"
#: Rejected texts, and lines that go from other texts, up to which their table is broadcast.
BROADCAST_TEXTS, BROADCAST_LINES = 200_000, 1_000_000
FACTS = "doc_id bigint, host string, text_md5 string, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, line_hashes array<bigint>, line_words array<bigint>"


class _Ids(dict):
    def __missing__(self, word):
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def repeated_words(words: list[bytes], ids: dict) -> int:
    """Words that lie in a three-word window found twice or more."""
    if len(words) < 4:
        return 0
    h = np.fromiter(map(ids.__getitem__, words), np.uint64, len(words))
    with np.errstate(over="ignore"):
        k = (h[:-2] * np.uint64(0x9E3779B97F4A7C15) + h[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:]
    order = np.argsort(k, kind="stable")
    same = k[order][1:] == k[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(k), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    hit = np.zeros(len(words), bool)
    hit[:-2] |= twice
    hit[1:-1] |= twice
    hit[2:] |= twice
    return int(hit.sum())


def _signed(h: int) -> int:
    return h - (1 << 64) if h >= 1 << 63 else h


def line_key(words: list[bytes]) -> int:
    return _signed(xxhash.xxh3_64_intdigest(DIGITS.sub(b"0", b" ".join(words).lower())))


def line_facts(text: bytes) -> tuple[int, list[int], list[int]]:
    """Duplicate lines; hash and words of each distinct normalised line."""
    seen, dup, lines = set(), 0, {}
    for line in text.split(b"\n"):
        words = line.split()
        if not words:
            continue
        if line in seen:
            dup += 1
        seen.add(line)
        key = line_key(words)
        lines[key] = lines.get(key, 0) + len(words)
    return dup, list(lines), list(lines.values())


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids = _Ids()
    for batch in batches:
        texts = batch.column("text").cast(pa.large_binary()).to_pylist()
        rows = []
        for text in texts:
            b = text or b""
            words = b.split()
            chars = len(b.decode("utf-8", "replace")) if not b.isascii() else len(b)
            dup, keys, counts = line_facts(b)
            rows.append((len(words), chars - (len(b) - len(b.translate(None, WHITE))), len(b) - len(b.translate(None, SYMBOLS)), dup, repeated_words(words, ids), keys, counts))
            if len(ids) > 500_000:
                ids.clear()
        cols = list(zip(*rows)) if rows else [[]] * 7
        kinds = [pa.int64()] * 5 + [pa.list_(pa.int64())] * 2
        out = [batch.column("doc_id"), batch.column("host").cast(pa.string()), batch.column("text_md5").cast(pa.string()), *(pa.array(list(c), k) for c, k in zip(cols, kinds))]
        yield pa.RecordBatch.from_arrays(out, ["doc_id", "host", "text_md5", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "line_hashes", "line_words"])


def text_md5(text: str = "text") -> Column:
    return F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))


def host_key(host: str) -> Column:
    return F.coalesce(F.col(host), F.lit(NO_HOST))


def facts(documents: DataFrame, host: str = "source") -> DataFrame:
    """One row per input row: counts of words, characters, symbols, duplicate lines, repeated words, and the line hashes."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", host_key(host).alias("host"), text_md5().alias("text_md5"))
    return rows.mapInArrow(_facts, FACTS)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(facts: DataFrame, min_texts: int = 20, host_share: float = 0.005, max_texts: int = 1000, max_lost: float = 0.5, count_copies: bool = False) -> DataFrame:
    """The facts with removed_words, removed_lines (their hashes, or null), base_failed, depleted and kept.

    A line is above its host's limit if it stands in more than
    max(min_texts, host_share * texts of the host) distinct texts, and always if
    it stands in more than max_texts; a document is depleted if more than
    max_lost of its words are in removed lines. With count_copies each document
    counts, so that many copies of one text are above the limit too; without,
    copies are left to deduplication and count once.

    Null hosts form one host. Null and empty texts have no lines and fail the
    base rule of 50 words. Repeated rows and rows with equal doc_id each get a
    row; they are one text for the line counts. Ties of doc_id are broken by the
    text's hash. An empty table gives an empty result.
    """
    lines = facts.select("host", "text_md5", F.coalesce("doc_id", F.lit(2**63 - 1)).alias("id"), F.explode(F.arrays_zip(F.col("line_hashes").alias("line"), F.col("line_words").alias("words"))).alias("x"))
    lines = lines.select("host", "text_md5", "id", F.col("x.line").alias("line"), F.col("x.words").alias("words"))
    texts = lines.groupBy("host", "line", "text_md5").agg(F.min("id").alias("id"), F.first("words").alias("words"), F.count("*").alias("copies"))
    per_text = facts.groupBy("host", "text_md5").count().groupBy("host")
    sizes = per_text.agg((F.sum("count") if count_copies else F.count("*")).alias("host_texts"))
    counts = texts.groupBy("host", "line").agg((F.sum("copies") if count_copies else F.count("*")).alias("n"), F.min(F.struct("id", "text_md5"))["text_md5"].alias("first_md5")).where(F.col("n") > min_texts)
    over = counts.join(sizes, "host").where(F.col("n") > F.least(F.lit(float(max_texts)), F.greatest(F.lit(float(min_texts)), host_share * F.col("host_texts")))).select("host", "line", "first_md5")
    removed = texts.join(over, ["host", "line"]).where(F.col("text_md5") != F.col("first_md5")).groupBy("host", "text_md5").agg(F.sum("words").alias("removed_words"), F.collect_list("line").alias("removed_lines"))
    out = facts.drop("line_hashes", "line_words").join(removed, ["host", "text_md5"], "left").withColumn("removed_words", F.coalesce("removed_words", F.lit(0)))
    out = out.withColumn("base_failed", base_failed()).withColumn("depleted", F.col("removed_words") > max_lost * F.col("n_words"))
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("depleted"))


def without_lines(text: bytes, gone: set[int]) -> bytes:
    """The text without the lines whose hashes are given; lines without words stay."""
    return b"\n".join(line for line in text.split(b"\n") if not (words := line.split()) or line_key(words) not in gone)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        gone, batch = batch.column("__lines"), batch.drop_columns(["__lines"])
        if gone.null_count < len(gone):
            texts = batch.column("text").cast(pa.large_binary()).to_pylist()
            chars = batch.column("n_chars").to_pylist() if "n_chars" in batch.schema.names else []
            for i, lines in enumerate(gone.to_pylist()):
                if lines:
                    texts[i] = without_lines(texts[i], set(lines))
                    if chars:
                        chars[i] = len(texts[i].decode("utf-8", "replace"))
            new = {"text": pa.array(texts, pa.large_binary()).view(pa.large_string())} | ({"n_chars": pa.array(chars, pa.int64())} if chars else {})
            batch = pa.RecordBatch.from_arrays([new[f.name].cast(f.type) if f.name in new else batch.column(f.name) for f in batch.schema], schema=batch.schema)
        yield batch


def cleaned(documents: DataFrame, host: str = "source", **limits) -> DataFrame:
    """The documents that the rules keep, with all their columns, each text without its removed lines.

    The rules judge the text as it came, so what is left may have fewer than 50
    words. n_chars, if there, is that of the text returned. Null and empty
    texts fail the rules and go; ties, null hosts and repeated rows are as in
    judge(). An empty table gives an empty result.
    """
    known = materialise(facts(documents, host), "line-facts")
    judged = judge(known, **limits).where(~F.col("kept") | F.col("removed_lines").isNotNull())
    found = judged.groupBy(F.col("host").alias("__host"), F.col("text_md5").alias("__md5")).agg(F.first("kept").alias("__kept"), F.first("removed_lines").alias("__lines"))
    found = materialise(found, "line-verdicts")
    # Most texts are in neither table and stay where they are while these are small; beyond that the joins are shuffled.
    size = found.agg(F.count_if(~F.col("__kept")).alias("texts"), F.coalesce(F.sum(F.when(F.col("__kept"), F.size("__lines") + 1)), F.lit(0)).alias("lines")).first()
    gone, lost = found.where(~F.col("__kept")).select("__host", "__md5"), found.where("__kept").select("__host", "__md5", "__lines")
    gone = F.broadcast(gone) if size["texts"] <= BROADCAST_TEXTS else gone
    lost = F.broadcast(lost) if size["lines"] <= BROADCAST_LINES else lost
    keyed = documents.withColumn("__host", host_key(host)).withColumn("__md5", text_md5())
    kept = keyed.join(gone, ["__host", "__md5"], "left_anti").join(lost, ["__host", "__md5"], "left")
    return kept.select(*documents.columns, "__lines").mapInArrow(_cut, documents.schema)
