"""A stream cut into files gives what the whole gives."""

import numpy as np
import pandas as pd

from tidegrid.operators import spectrum
from tidegrid.streaming import stateful


def drain(spark, tmp_path, frame, build, schema, name):
    """Runs a query over files, one a micro-batch, and returns all its rows."""
    src = tmp_path / name
    src.mkdir()
    for k, part in enumerate(frame):
        part.to_parquet(src / f"{k:03d}.parquet")
    stream = spark.readStream.schema("rec_id long, n long, x double").option("maxFilesPerTrigger", 1).parquet(str(src))
    q = build(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / (name + "-state"))).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None
    return spark.table(name).toPandas()


def pieces(seed=1):
    """Two recordings in five files, the third and fourth in the wrong order and a sample sent twice."""
    rng = np.random.default_rng(seed)
    data = {rec: np.repeat(rng.integers(0, 3, 120), rng.integers(1, 9, 120)).astype(float)[:300] for rec in (1, 2)}
    cuts = [0, 50, 90, 180, 181, 300]
    parts = [pd.concat([pd.DataFrame({"rec_id": rec, "n": np.arange(a, min(b + 1, 300)), "x": x[a : b + 1]}) for rec, x in data.items()], ignore_index=True) for a, b in zip(cuts, cuts[1:])]
    parts[2], parts[3] = parts[3], parts[2]
    return data, parts


def test_runs_across_files(spark, tmp_path):
    data, parts = pieces()
    got = {tuple(r) for r in drain(spark, tmp_path, parts, lambda s: stateful.runs(s, 4), stateful.RUN, "runs").itertuples(index=False)}
    want = set()
    for rec, x in data.items():
        edge = [0, *(np.flatnonzero(np.diff(x)) + 1).tolist()]  # the run at the end is still open
        want |= {(rec, a, b - a, x[a]) for a, b in zip(edge, edge[1:]) if b - a >= 4}
    assert got == want


def test_frames_across_files(spark, tmp_path):
    data, parts = pieces(2)
    got = drain(spark, tmp_path, parts, lambda s: stateful.periodograms(s, 32, 16), stateful.FRAME, "frames").sort_values(["rec_id", "frame", "bin"])
    for rec, x in data.items():
        whole = spectrum.periodograms(spark.createDataFrame(list(enumerate(x.tolist())), "n long, x double"), 32, 16).toPandas().sort_values(["frame", "bin"])
        mine = got[got["rec_id"] == rec]
        assert mine["frame"].tolist() == whole["frame"].tolist() and np.allclose(mine["power"], whole["power"])


def test_lost_samples_hold_nothing_up(spark, tmp_path):
    """Samples 20 to 29 never come: with more than the bound waiting, the stream goes on behind them."""
    n = np.array([*range(20), *range(30, 100)])
    x = np.where(n < 60, 1.0, 2.0)
    parts = [pd.DataFrame({"rec_id": 1, "n": n[a:b], "x": x[a:b]}) for a, b in ((0, 15), (15, 40), (40, 90))]
    got = drain(spark, tmp_path, parts, lambda s: stateful.runs(s, 4, most=25), stateful.RUN, "gaps")
    rows = [(r.rec_id, r.start, r.length, None if np.isnan(r.value) else r.value) for r in got.itertuples(index=False)]
    assert rows == [(1, 0, 20, 1.0), (1, 20, 10, None), (1, 30, 30, 1.0)]
    frames = drain(spark, tmp_path, parts, lambda s: stateful.periodograms(s, 8, 4, most=25), stateful.FRAME, "gap_frames")
    assert sorted(set(frames["frame"])) == [0, 1, 2, 3, *range(8, 24)]


def test_waiting_samples_are_sorted_once():
    part = pd.DataFrame({"n": [7, 3, 4, 4, 9], "x": [7.0, 3.0, 0.0, 4.0, 9.0]})
    ready, ns, xs = stateful._in_order(iter([part]), 3, [5], [5.0])
    assert ready.tolist() == [3.0, 4.0, 5.0] and ns.tolist() == [7, 9] and xs.tolist() == [7.0, 9.0]
