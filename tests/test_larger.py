"""What showed on larger tables only, on small ones that are made for it."""

import duckdb
import numpy as np
import pytest

from tidegrid.operators import alignment, codes
from tidegrid.plans import catalogue


def differs(spark, folder, name, tables):
    """Rows of the query that its SQL lacks, and the other way round, over tables given as Arrow."""
    import pyarrow.parquet as pq

    db = duckdb.connect()
    for t, rows in tables.items():
        pq.write_table(rows, f"{folder}/{t}.parquet")
        db.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    got, want = catalogue.QUERIES[name](spark, str(folder)).toPandas(), db.sql(catalogue.ORACLES[name]).df()
    plain = lambda x: {tuple(map(str, row)) for row in x[sorted(want.columns)].itertuples(index=False)}
    assert len(want) and len(got) == len(want)
    return plain(got) ^ plain(want)


@pytest.mark.parametrize("name", ["blind_sync", "blind_fields"])
def test_payload_column_alike_by_chance(spark, tmp_path, name):
    """The last payload bit is nearly always 1 in the first half of the frames: it stands before the sync word, and is no part of it."""
    import pyarrow as pa

    x = np.random.default_rng(5).standard_normal((384, 64))
    x[128:176, 63] = -1.0
    x[256:320, 62:] = 1.0
    tables = {"embeddings": pa.table({"vec_id": np.arange(384), "embedding": list(x)})}
    assert not differs(spark, tmp_path, name, tables)


def test_start_where_blocks_repeat(spark, tmp_path):
    """Equal blocks make each turn of a word a word: more starts than three look alike, and only the count of words and wrong bytes tells them apart."""
    import pyarrow as pa

    part = "".join(map(chr, np.random.default_rng(2).integers(97, 123, 223)))
    texts = [part[:200].upper() + part[200:] + part * 5, part * 6, "".join(map(chr, np.random.default_rng(3).integers(97, 123, 1500)))]
    assert not differs(spark, tmp_path, "rs_stream", {"documents": pa.table({"doc_id": [9365, 33589, 7], "text": texts})})


def test_streams_of_bits_are_small_in_a_worker(spark):
    """A long stream of words, packed: the score of its starts may take a few times its bytes, not eight bytes and more for each bit."""
    import tracemalloc

    data = np.random.default_rng(4).integers(0, 256, (6000, 223))
    words = np.concatenate([data, codes.rs_parity(data, codes.roots())], axis=1).astype(np.uint8).tobytes()
    caught = []
    real = alignment._together
    alignment._together = lambda streams, key, least, ddl, size, score: caught.append(score)
    try:
        alignment.word_start(spark.createDataFrame([(1, bytearray(b"x"), 8)], "id int, bits binary, count long"), "id", "bits", count="count")
    finally:
        alignment._together = real
    tracemalloc.start()
    which, (start,) = caught[0]([np.frombuffer(words, np.uint8)[40:]], np.array([8 * (len(words) - 40)]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert which.tolist() == [0] and start.tolist() == [8 * 215] and peak < 30 * len(words)


def test_depths_of_many_streams(spark):
    """Bytes as a binary value: each depth against counts of all its words, for many streams of any length at once."""
    rng, rows, want = np.random.default_rng(6), [], {}
    for i in range(60):
        n, depth = int(rng.integers(0, 9)), int(rng.integers(1, 6))
        data = rng.integers(0, 256, (n, 223))
        words = np.concatenate([data, codes.rs_parity(data, codes.roots())], axis=1)
        for k in range(n):
            at = rng.choice(255, int(rng.integers(0, 20)), replace=False)
            words[k, at] ^= 0x33
        m = n // depth * depth
        x = words[:m].reshape(-1, depth, 255).transpose(0, 2, 1).ravel().astype(np.uint8)
        rows.append((i, bytearray(x.tobytes())))
        if m and (good := int((codes.rs_mended(words[:m])[1] >= 0).sum())):
            want[i] = (depth, good)
    rows.append((99, None))
    got = alignment.interleave_depth(spark.createDataFrame(rows, "id long, x binary"), "id", "x").collect()
    assert {r["id"]: (r["depth"], r["words"]) for r in got} == want


def test_paging_streams_as_rows_and_as_pieces(spark):
    """Both forms give the same hits, words and pages, at whatever bit a piece is cut; the pages are those that were sent."""
    from pyspark.sql import functions as F

    from tidegrid.operators import paging

    names = ["a page across two batches " * 3, "short"]
    sent = spark.createDataFrame([(i, 8 * i + 2, t) for i, t in enumerate(names)], "i int, address long, text string")
    pages = [r[0] for r in sent.orderBy("i").select(paging.page_words(F.col("address"), F.lit(3), F.col("text"))).collect()]
    rows, parts = [], []
    for rec, page in enumerate(pages):
        slots = [paging.IDLE] * 4 + page + [paging.IDLE] * (44 - len(page))
        words = [w for k in range(0, 48, 16) for w in (paging.SYNC, *slots[k : k + 16])]
        bits = np.concatenate([np.ones(rec + 5, np.uint8), np.unpackbits(np.array(words, ">u4").view(np.uint8))]) ^ rec
        rows += [(rec, n, int(b)) for n, b in enumerate(bits)]
        parts += [(rec, begin, bytearray(octets), count) for begin, octets, count in paging.cut(bits, 77)]
    found = []
    for stream in (spark.createDataFrame(rows, "rec long, n long, bit int"), spark.createDataFrame(parts, "rec long, begin long, octets binary, count int")):
        hits = paging.sync_hits(stream, 77)
        grid = paging.grids(hits)
        words = paging.code_words(stream, grid, 77)
        best = paging.scan(words, grid)
        found.append([sorted(map(tuple, x.collect())) for x in (hits, words, best, paging.pages(words, best))])
    assert found[0] == found[1]
    assert [(p[0], p[2], p[-1]) for p in found[0][3]] == [(i, 8 * i + 2, t) for i, t in enumerate(names)]


def test_long_text_of_a_page(spark):
    """A text of 4,000 characters there and back; worked out anew for each bit, it would take hours."""
    from pyspark.sql import functions as F

    from tidegrid.operators import paging

    text = "".join(map(chr, np.random.default_rng(8).integers(33, 127, 4000)))
    words = paging.page_words(F.lit(8).cast("long"), F.lit(3), F.col("text"))
    data = F.transform(F.slice("w", 2, 9999), lambda w: F.call_function("shiftright", w, F.lit(11)).bitwiseAND(F.lit(0xFFFFF)))
    out = spark.createDataFrame([(text,)], "text string").select(words.alias("w")).select(paging.message(data))
    assert out.first()[0] == text


def test_lines_of_short_and_long_streams(spark, monkeypatch):
    """Streams that a kernel has whole and streams transformed in two rounds have the same lines."""
    from pyspark.sql import functions as F

    from tidegrid.operators import lines

    rng, rows = np.random.default_rng(9), []
    for rec, size in enumerate((15, 16, 40, 150, 700)):
        turn = 2 * np.pi * (0.07 + 0.05 * rec) * np.arange(size)
        x = 0.3 * (rng.standard_normal(size) + 1j * rng.standard_normal(size)) + np.exp(1j * turn) + np.exp(-2j * turn)
        rows += [(rec, n, float(v.real), float(v.imag)) for n, v in enumerate(x)]
    samples, found = spark.createDataFrame(rows, "rec int, n long, i double, q double"), []
    for most in (14, 8, 5):
        monkeypatch.setattr(lines, "SHORT", most)
        found.append(sorted(map(tuple, lines.find(samples, -0.5, 0.499, most=3).select("rec", "place", *(F.round(c, 6) for c in ("frequency", "uncertainty", "ratio"))).collect())))
    assert {r[0] for r in found[0]} == {1, 2, 3, 4} and found[0] == found[1] == found[2]
