"""Kernels and rules of the signal engine against plain computation."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.functions import special
from tidegrid.operators import codes, detection, framing, spectrum
from tidegrid.plans import catalogue

D = "/root/testdata/sf0.001"


def test_tails_and_quantiles():
    assert special.upper_gamma(1, 2.5) == pytest.approx(math.exp(-2.5))
    assert special.upper_gamma(3, 2.0) == pytest.approx(math.exp(-2) * (1 + 2 + 2))
    assert special.mean_tail(special.mean_exceeded(1e-4, 7.5), 7.5) == pytest.approx(1e-4)
    assert special.mean_quantile(0.5, 1) == pytest.approx(math.log(2))
    assert special.normal_exceeded(0.025) == pytest.approx(1.959964, abs=1e-5)
    assert special.log10_mean_tail(2.0, 50) == pytest.approx(math.log10(special.mean_tail(2.0, 50)))
    assert special.log10_mean_tail(30.0, 400) < -280


@pytest.mark.parametrize("crc", framing.CRCS, ids=lambda c: c.name)
def test_check_sums(spark, crc):
    data = framing.octets(F.encode(F.lit("123456789"), "UTF-8"))
    assert spark.range(1).select(framing.crc_of(data, crc).alias("c")).first()["c"] == crc.check


def test_check_sum_covers_whole_texts(spark, tmp_path):
    import binascii

    texts = ["", "one two", "sixteen letters.", "sixteen letters. and one end", "sixteen letters. and another", "Ünï côdé \U0001f600 " * 9, "x" * 3000]
    spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "conv_id long, turn int, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["turn"]: r["crc"] for r in catalogue.QUERIES["crc_ccitt_false"](spark, str(tmp_path)).collect()}
    assert got == {i: binascii.crc_hqx(t.encode(), 0xFFFF) for i, t in enumerate(texts)} and got[3] != got[4]


def test_viterbi_mends_noise():
    rng = np.random.default_rng(1)
    bits = rng.integers(0, 2, (5, 80))
    sent = np.array([[sum(b[i - d] for d in codes.taps(g, 7) if i >= d) % 2 for i in range(80) for g in codes.K7[1]] for b in bits])
    assert (codes.viterbi(1.0 - 2 * sent + 0.5 * rng.standard_normal(sent.shape)) == bits).all()


def test_reed_solomon_mends_up_to_half_its_checks():
    rng, at = np.random.default_rng(2), codes.roots()
    data = rng.integers(0, 256, (4, 223))
    words = np.concatenate([data, codes.rs_parity(data, at)], axis=1)
    for w in words:
        for n in (0, 1, 7, 16):
            x, p = w.copy(), rng.choice(255, n, False)
            x[p] ^= rng.integers(1, 256, n)
            got, errors = codes.rs_correct(x)
            assert errors == n and (got == w).all()
        x, p = w.copy(), rng.choice(255, 20, False)
        x[p] ^= rng.integers(1, 256, 20)
        assert codes.rs_correct(x)[1] == -1
    # Noise is no code word and is not made one.
    assert all(codes.rs_correct(rng.integers(0, 256, 255))[1] == -1 for _ in range(5))


def test_min_sum_mends_weak_bits():
    edges = codes.circulant_edges([[0, 3, 7, 1], [5, 2, -1, 6]], 16)
    soft = np.ones((4, 64))
    for k in range(4):
        soft[k, 13 * k + 2] = -0.4
    bits, good = codes.min_sum(soft, edges)
    assert good.all() and not bits.any()


def test_rank_over_two(spark):
    rng = np.random.default_rng(3)
    m = rng.integers(0, 2, (12, 20))
    m = np.concatenate([m, m[:4] ^ m[4:8], m[:1]])
    got = codes.ranks(spark.createDataFrame([(1, "".join(map(str, r))) for r in m.tolist()], "k int, b string"), "k", "b").first()
    a, rank = m.copy(), 0
    for c in range(20):
        p = next((i for i in range(rank, len(a)) if a[i, c]), None)
        if p is not None:
            a[[rank, p]] = a[[p, rank]]
            a[[i for i in range(len(a)) if i != rank and a[i, c]]] ^= a[rank]
            rank += 1
    assert (got["rows"], got["rank"]) == (17, rank)


def test_detector_finds_a_tone_and_little_else(spark):
    """A burst in noise is found where it is; noise alone gives nothing."""
    rng = np.random.default_rng(4)
    n = 1 << 15
    x = rng.standard_normal(n)
    y = x.copy()
    y[8192:20480] += 1.0 * np.cos(2 * np.pi * 0.203 * np.arange(12288))
    plan = spectrum.plan_grid(n, 128)
    for data, some in ((x, False), (y, True)):
        s = spark.createDataFrame(list(enumerate(data.tolist())), "n long, x double")
        got = detection.boxes(spectrum.spectrogram(s, 128, plan.hop, plan.row_of), plan, real=True).collect()
        assert bool(got) == some
        if some:
            best = max(got, key=lambda b: b["score"])
            assert best["low"] < 0.203 < best["high"] and best["high"] - best["low"] < 0.06
            assert abs(best["start"] - 8192) < 1200 and abs(best["stop"] - 20480) < 1200


def test_components_match_a_flood(spark):
    rng = np.random.default_rng(5)
    mask = rng.random((30, 20)) < 0.35
    cells = [(int(i), int(j)) for i, j in zip(*np.nonzero(mask))]
    got = {(r["row"], r["bin"]): r["component"] for r in detection.labelled(spark.createDataFrame(cells, "row long, bin long"), 20).collect()}
    want, todo = {}, set(cells)
    while todo:
        stack, part = [todo.pop()], []
        while stack:
            i, j = stack.pop()
            part.append((i, j))
            for near in [(i + a, j + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]:
                if near in todo:
                    todo.remove(near)
                    stack.append(near)
        want |= dict.fromkeys(part, min(i * 20 + j for i, j in part))
    assert got == want


def test_strongest_boxes_greedily(spark):
    rng = np.random.default_rng(6)
    rows = [(k % 3, k, float(a), float(a + rng.uniform(2, 9)), float(b), float(b + rng.uniform(2, 9)), float(rng.random())) for k, (a, b) in enumerate(rng.uniform(0, 20, (60, 2)))]
    frame = spark.createDataFrame(rows, "key int, id long, start double, stop double, low double, high double, snr double")
    got = {(r["key"], r["id"]) for r in detection.strongest(frame, "key", "snr").collect()}

    def share(p, q):
        cut = max(0, min(p[3], q[3]) - max(p[2], q[2])) * max(0, min(p[5], q[5]) - max(p[4], q[4]))
        return cut / min((p[3] - p[2]) * (p[5] - p[4]), (q[3] - q[2]) * (q[5] - q[4]))

    want = set()
    for key in range(3):
        kept = []
        for p in sorted((x for x in rows if x[0] == key), key=lambda x: (-x[6], x[1])):
            if all(share(p, q) <= 0.3 for q in kept):
                kept.append(p)
        want |= {(p[0], p[1]) for p in kept}
    assert got == want


def test_flagship_returns_rows(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())


def test_generated_streams_do_not_depend_on_partitions(spark):
    import synth

    scene = spark.createDataFrame([(1, "QPSK", 1000, 4000, 0.125, 0.1, 1.0), (2, "2FSK", 0, 6000, 0.05, -0.2, 0.8), (3, "tone", 2000, 3000, 0.1, 0.3, 0.5)], "id int, kind string, start long, length long, rate double, centre double, level double")
    a = synth.samples(spark, scene, 6000, 9).orderBy("n").toPandas()
    b = synth.samples(spark, scene.repartition(3), 6000, 9).orderBy("n").toPandas()
    assert np.allclose(a, b) and len(a) == 6000 and (a["n"] == np.arange(6000)).all()
    quiet = synth.samples(spark, scene, 6000, 9, noisy=False).orderBy("n").toPandas()
    z = (quiet["i"] + 1j * quiet["q"]).to_numpy()
    power = np.abs(np.fft.fft(z)) ** 2
    f = np.fft.fftfreq(6000)
    assert all(power[np.abs(f - c) < 0.03].sum() > 20 * power[np.abs(f + 0.45) < 0.03].sum() for c in (0.1, -0.2, 0.3))
    rest = a["i"] - quiet["i"]
    assert abs(rest.std() - math.sqrt(0.5)) < 0.03 and abs(rest.mean()) < 0.04
    late = synth.impaired(synth.samples(spark, scene, 6000, 9, noisy=False), offset=0.01, dc=(0.5, 0.0), echo=(3, 0.5)).orderBy("n").toPandas()
    want = (z + 0.5 * np.concatenate([np.zeros(3), z[:-3]])) * np.exp(2j * np.pi * 0.01 * np.arange(6000)) + 0.5
    assert np.allclose(late["i"] + 1j * late["q"], want)


def test_generated_frames_pass_their_check(spark):
    import synth

    rows = spark.createDataFrame([(1, k, f"payload number {k}") for k in range(6)], "key int, index int, text string").withColumn("data", F.encode("text", "UTF-8"))
    made = synth.frames(rows, "data", framing.SYNC_WORDS[0][1], framing.CRCS[6])
    best = framing.best_crc(made.select("key", F.expr("substring(frame, 5)").alias("body")), "key", "body").first()
    assert (best["crc"], best["passes"], best["frames"]) == (framing.CRCS[6].name, 6, 6)
    bits = made.where("index = 2").select(synth.bits_of(F.col("frame")).alias("b"), "frame").first()
    assert "".join(map(str, bits["b"])) == "".join(f"{x:08b}" for x in bits["frame"])


def test_runs_do_not_depend_on_chunks(spark):
    from tidegrid.operators import ordered

    rng = np.random.default_rng(8)
    data = {k: np.repeat(rng.integers(0, 3, 60), rng.integers(1, 12, 60))[:200].tolist() for k in (1, 2)}
    frame = spark.createDataFrame([(k, n, v) for k, x in data.items() for n, v in enumerate(x)], "key int, n long, x int")
    got = [{tuple(r) for r in ordered.runs(frame, "key", "n", F.col("x"), 3, chunk).select("key", "start", "length", "value").collect()} for chunk in (4, 64, 1 << 16)]
    want = set()
    for k, x in data.items():
        edge = [n for n in range(len(x)) if n == 0 or x[n] != x[n - 1]] + [len(x)]
        want |= {(k, a, b - a, x[a]) for a, b in zip(edge, edge[1:]) if b - a >= 3}
    assert got == [want] * 3
