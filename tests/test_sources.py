"""Recordings of each container, made here, come back sample by sample; damaged headers give clean errors."""

import io
import json
import struct
import tarfile
import wave
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.sources import containers, formats, recordings, sniffer

ALL = [*formats.DATATYPES, "ci24_le", "ci24_be", "ri24_le", "ri24_be"]


@pytest.fixture(scope="module")
def reader(spark):
    recordings.register(spark)
    return lambda path, **options: [tuple(r) for r in spark.read.format("recording").options(**options).load(str(path)).orderBy("n").collect()]


def some(n, seed=1):
    rng = np.random.default_rng(seed)
    return rng.uniform(-0.9, 0.9, n), rng.uniform(-0.9, 0.9, n)


@pytest.mark.parametrize("name", ALL)
def test_datatypes_round_trip(name):
    kind = formats.parse(name)
    i, q = some(100)
    a, b = kind.decode(kind.encode(i, q))
    step = 2 ** -(min(kind.bits, 24) - 1)
    assert np.abs(a - i).max() <= step and (b is None) != kind.complex and (b is None or np.abs(b - q).max() <= step)
    assert len(kind.encode(i, q)) == 100 * kind.sample_bytes
    if kind.complex:
        assert (kind.decode(kind.encode(i, q), swap_iq=True)[0] == b).all()


@pytest.mark.parametrize("name", ["", "ci12", "ci16", "cu8_le", "xf32_le", "cf16_le", "cu24_le"])
def test_names_that_are_no_datatype(name):
    with pytest.raises(ValueError):
        formats.parse(name)


def test_names_and_integers_in_expressions(spark):
    got = spark.createDataFrame([(n,) for n in [*ALL, "ci12", "ci16", "cu8_le"]], "n string").select("n", formats.parsed(F.col("n")).alias("p")).collect()
    for r in got:
        assert (r["p"] is not None) == (r["n"] in ALL) and (r["p"] is None or (r["p"]["complex"], r["p"]["bits"]) == (formats.parse(r["n"]).complex, formats.parse(r["n"]).bits))
    for name in ("ri16_le", "ri24_be", "ru8", "ri32_be"):
        kind = formats.parse(name)
        data = kind.encode(some(20)[0])
        row = spark.range(1).select(formats.integers(F.array(*(F.lit(b).cast("long") for b in data)), kind).alias("x")).first()
        assert row["x"] == kind.components(data).tolist()


def test_sigmf_captures_archive_and_writer(reader, tmp_path, spark):
    i, q = some(1000)
    kind = formats.parse("ci16_le")
    data = kind.encode(i, q)
    meta = {"global": {"core:datatype": "ci16_le", "core:sample_rate": 1e6}, "captures": [{"core:sample_start": 0, "core:frequency": 1e8}, {"core:sample_start": 600, "core:header_bytes": 8}]}
    (tmp_path / "a.sigmf-meta").write_text(json.dumps(meta))
    (tmp_path / "a.sigmf-data").write_bytes(data[:2400] + b"x" * 8 + data[2400:])
    want = list(zip(range(1000), *kind.decode(data)))
    assert reader(tmp_path / "a.sigmf-meta", chunk=300) == want and reader(tmp_path / "a.sigmf-data") == want
    meta["captures"] = [{"core:sample_start": 0}]
    with tarfile.open(tmp_path / "b.sigmf", "w") as t:
        for name, body in (("x/b.sigmf-meta", json.dumps(meta).encode()), ("x/b.sigmf-data", data)):
            info = tarfile.TarInfo(name)
            info.size = len(body)
            t.addfile(info, io.BytesIO(body))
    assert reader(tmp_path / "b.sigmf") == want
    out = tmp_path / "out"
    spark.createDataFrame([(n, float(a), float(b)) for n, (a, b) in enumerate(zip(i, q))], recordings.SCHEMA).repartitionByRange(2, "n").write.format("recording").option("datatype", "cf64_le").mode("append").save(str(out))
    back = [x for k in sorted(out.glob("*.sigmf-meta")) for x in reader(k)]
    assert [(a, b) for _, a, b in back] == list(zip(i.tolist(), q.tolist()))


def test_wav_family(reader, tmp_path):
    i, q = some(500)
    kind = formats.parse("ci16_le")
    data = kind.encode(i, q)
    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(2), w.setsampwidth(2), w.setframerate(48000), w.writeframes(data)
    want = list(zip(range(500), *kind.decode(data)))
    assert reader(tmp_path / "a.wav") == want
    form = struct.pack("<HHIIHH", 1, 2, 48000, 192000, 4, 16)
    (tmp_path / "b.wav").write_bytes(b"RF64" + b"\xff" * 4 + b"WAVE" + b"ds64" + struct.pack("<IQQQI", 28, 0, len(data), 500, 0) + b"fmt " + struct.pack("<I", 16) + form + b"data" + b"\xff" * 4 + data)
    assert reader(tmp_path / "b.wav") == want
    g = containers.W64
    (tmp_path / "c.w64").write_bytes(g["riff"] + struct.pack("<Q", 0) + g["wave"] + g["fmt "] + struct.pack("<Q", 40) + form + g["data"] + struct.pack("<Q", 24 + len(data)) + data)
    assert reader(tmp_path / "c.w64") == want
    big = formats.parse("rf32_be")
    body = big.encode(i)
    (tmp_path / "d.wav").write_bytes(b"RIFX" + struct.pack(">I", 0) + b"WAVE" + b"fmt " + struct.pack(">I", 16) + struct.pack(">HHIIHH", 3, 1, 8000, 32000, 4, 32) + b"data" + struct.pack(">I", len(body) + 400) + body)
    got = containers.wav(lambda at, n: (tmp_path / "d.wav").read_bytes()[at : at + n], (tmp_path / "d.wav").stat().st_size, "d.wav")
    assert got.datatype == "rf32_be" and got.samples == 500 and got.warnings and [x for _, x, _ in reader(tmp_path / "d.wav")] == i.astype(np.float32).astype(float).tolist()


def test_arrays_and_small_headers(reader, tmp_path):
    i, q = some(300)
    np.save(tmp_path / "a.npy", (i + 1j * q).astype(np.complex64))
    np.save(tmp_path / "b.npy", np.stack([i, q], axis=1))
    assert [x[1] for x in reader(tmp_path / "a.npy")] == i.astype(np.float32).astype(float).tolist() and [x[2] for x in reader(tmp_path / "b.npy")] == q.tolist()
    kind = formats.parse("ci16_le")
    head = struct.pack("<IQQII", 2_000_000, 433_000_000, 0, 16, 0)
    (tmp_path / "c.sdriq").write_bytes(head + struct.pack("<I", zlib.crc32(head)) + kind.encode(i, q))
    (tmp_path / "d.sdriq").write_bytes(head + struct.pack("<I", 1) + kind.encode(i, q))
    blue = bytearray(512)
    blue[:12] = b"BLUEEEEIEEEI"
    struct.pack_into("<dd", blue, 32, 512.0, 1200.0)
    struct.pack_into("<i", blue, 48, 1000)
    blue[52:54] = b"CI"
    struct.pack_into("<d", blue, 264, 1e-6)
    (tmp_path / "e.tmp").write_bytes(bytes(blue) + kind.encode(i, q))
    want = list(zip(range(300), *kind.decode(kind.encode(i, q))))
    assert reader(tmp_path / "c.sdriq") == want == reader(tmp_path / "e.tmp")
    c, d, e = (recordings.opened(str(tmp_path / n))[0] for n in ("c.sdriq", "d.sdriq", "e.tmp"))
    assert c.rate == 2e6 and c.frequency == 433e6 and not c.warnings and d.warnings and e.rate == pytest.approx(1e6)


def test_packets(reader, tmp_path):
    i, q = some(100)
    kind = formats.parse("ci16_be")
    data = kind.encode(i, q)
    context = struct.pack(">IIIqqQ", 4 << 28 | 9, 7, 1 << 27 | 1 << 21 | 1 << 15, 100_000_000 << 20, 2_000_000 << 20, (1 << 29 | 15) << 32)
    packets = context + b"".join(struct.pack(">II", 1 << 28 | 27, 7) + data[k : k + 100] for k in range(0, 400, 100))
    (tmp_path / "a.vrt").write_bytes(packets)
    got = recordings.opened(str(tmp_path / "a.vrt"))[0]
    assert (got.rate, got.frequency, got.datatype, len(got.segments)) == (2e6, 1e8, "ci16_be", 4)
    assert reader(tmp_path / "a.vrt", chunk=30) == list(zip(range(100), *kind.decode(data)))


@pytest.mark.parametrize("name,body", [("a.wav", b"RIFF\0\0\0\0WAVE"), ("b.wav", b"RIFF\0\0\0\0JUNK"), ("c.npy", b"\x93NUMPY\1\0\xff\xff{"), ("d.sdriq", b"short"), ("e.tmp", b"BLUE"), ("f.vrt", b"\0\0\0\1"), ("g.sigmf", b"x" * 600), ("h.iq.gz", b"x"), ("i.sigmf-meta", b"{}")])
def test_damaged_headers(spark, tmp_path, name, body):
    (tmp_path / name).write_bytes(body)
    rows = recordings.described(spark.createDataFrame([(str(tmp_path / name),)], "path string")).collect()
    assert len(rows) == 1 and rows[0]["error"]


def test_folders_sequences_and_hints(spark, tmp_path):
    for n in (1, 2, 5):
        (tmp_path / f"take_{n:03d}.cu8").write_bytes(b"\x80" * 200)
    (tmp_path / "notes.txt").write_text("x")
    listed = recordings.listed(spark, str(tmp_path))
    assert {r["name"] for r in listed.collect()} == {"take_001.cu8", "take_002.cu8", "take_005.cu8"}
    about = recordings.described(listed)
    got = recordings.numbered(about).orderBy("number").collect()
    assert [(r["number"], r["missing"], r["first"], r["samples"]) for r in got] == [(1, 0, 0, 100), (2, 0, 100, 100), (5, 2, 200, 100)]
    names = spark.createDataFrame([("gqrx_20240101_120000_433920000_2400000_fc.raw", "cf32_le"), ("x_fs=2.4M_fc-100MHz.iq", "ci16_le"), ("SDRSharp_20150101_120000Z_102700000Hz_IQ.wav", "ci16_le")], "name string, datatype string")
    hints = {(r["name"][:4], r["kind"], r["value"]) for r in recordings.name_hints(names).collect()}
    assert hints == {("gqrx", "center_frequency", 433920000.0), ("gqrx", "sample_rate", 2.4e6), ("x_fs", "sample_rate", 2.4e6), ("x_fs", "center_frequency", 1e8), ("SDRS", "center_frequency", 102.7e6)}
    first = {r["name"][:4]: (r["rate"], r["from_name"]) for r in recordings.rate_candidates(names).where("place = 1").collect()}
    assert first["gqrx"] == (2.4e6, True) and first["x_fs"] == (2.4e6, True) and first["SDRS"][1] is False


def test_filter_leaves_partitions_out(tmp_path):
    (tmp_path / "a.cu8").write_bytes(b"\x80" * 2000)
    found = recordings.opened(str(tmp_path / "a.cu8"))[0]
    parts = recordings.stretches(found, "a.cu8", 100, low=250, high=420)
    assert [(p.first, sum(n for _, n in p.pieces)) for p in parts] == [(200, 200), (300, 200), (400, 200)]


def test_sniffer_names_no_wrong_datatype(spark, tmp_path):
    """A narrow-band signal in each datatype: the verdict is its datatype, or none, or its components by custom."""
    rng = np.random.default_rng(3)
    n = 16384
    noise = rng.standard_normal(n + 64) + 1j * rng.standard_normal(n + 64)
    z = np.convolve(noise, np.hanning(16), "valid")[:n] * np.exp(0.9j * np.arange(n))
    z = 0.25 * z / np.abs(z).std()
    truth = {}
    for name in formats.DATATYPES:
        kind = formats.parse(name)
        (tmp_path / f"{name}.raw").write_bytes(kind.encode(z.real, z.imag))
        truth[f"{name}.raw"] = name
    (tmp_path / "noise.raw").write_bytes(rng.bytes(100_000))
    files = recordings.listed(spark, str(tmp_path)).select("path", "size")
    got = {r["path"].rsplit("/", 1)[-1]: (r["datatype"], r["why"]) for r in sniffer.decided(sniffer.scored(files)).collect()}
    assert got.pop("noise.raw") == (None, "random")
    named = {k: v for k, v in got.items() if v[0]}
    assert len(got) == 28 and all(v[0][1:] == truth[k][1:] for k, v in named.items())
    assert all(v[0] == truth[k] or v[1] == "convention" for k, v in named.items()) and sum(v[0] == truth[k] for k, v in named.items()) >= 18
