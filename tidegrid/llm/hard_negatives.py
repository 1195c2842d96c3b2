"""Hard-negative mining: for each anchor the nearest rows of its label, and for each of these the best rows of other labels in a window below it.

The anchors are a stated query set. Rows and anchors are packed into blocks of vectors, blocks meet
in cells of a grid (an equi-join on the cell), and a pair of blocks is one matrix product of which a
task keeps only what can still be among the first of an anchor. What is kept becomes packed keys
(anchor, falling score, id), which repartitionAndSortWithinPartitions brings into order; an iterator
walks over each partition, opens the windows of an anchor's positives as they come by and hands out
negatives. It holds the open windows of one anchor and nothing else.
"""

from __future__ import annotations

import itertools
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Rows of a block, and blocks of rows and of anchors that meet in one cell.
BLOCK, CELL_ROWS, CELL_ANCHORS = 1024, 64, 16
PACKED = "block long, n int, width int, kind string, ids binary, named binary, labels binary, uids binary, vectors binary"
#: Anchor, falling score, positives before negatives, rows without an id last, id, row.
KEY = np.dtype([("anchor", ">u8"), ("fall", ">u8"), ("negative", "u1"), ("unnamed", "u1"), ("id", ">u8"), ("uid", ">u8")])
TOP = (1 << 63) - 1
#: Below any score times the rows of a block.
BELOW = -(1 << 80)


def levels(vector: Column) -> Column:
    """Each component x becomes floor(256 * x), x as a double, held within the range of long."""
    return F.transform(vector, lambda x: F.floor(F.lit(256.0) * x.cast("double")).cast("long"))


def usable(rows: DataFrame) -> DataFrame:
    """vec_id, label, vector of the rows that take part; every seventh id gets the next label."""
    v = F.col("embedding")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return rows.where(label.isNotNull() & v.isNotNull() & ~bad).select(F.col("vec_id").cast("long").alias("vec_id"), moved.alias("label"), levels(v).alias("vector"))


def _block(number: int, ids, named, labels, uids, vectors: np.ndarray) -> dict:
    """A block's row; its rows are ordered by id, nulls last, so that of equal scores the first column wins."""
    order = np.lexsort((uids, ids, ~named))
    most = int(max(abs(int(vectors.max(initial=0))), abs(int(vectors.min(initial=0)))))
    kind = next(k for k in ("<i2", "<i4", "<i8") if most < 1 << (8 * int(k[2]) - 1) or k == "<i8")
    return {"block": number, "n": len(ids), "width": vectors.shape[1], "kind": kind, "ids": ids[order].astype("<i8").tobytes(), "named": named[order].astype("u1").tobytes(), "labels": labels[order].astype("<i8").tobytes(), "uids": uids[order].astype("<i8").tobytes(), "vectors": vectors[order].astype(kind).tobytes()}


def _read(x) -> dict:
    of = lambda name, kind: np.frombuffer(x[name], kind)
    return {"n": x["n"], "ids": of("ids", "<i8"), "named": of("named", "u1").astype(bool), "labels": of("labels", "<i8"), "uids": of("uids", "<i8"), "vectors": of("vectors", x["kind"]).reshape(x["n"], x["width"])}


def _widen(parts: list[np.ndarray]) -> np.ndarray:
    width = max(p.shape[1] for p in parts)
    return np.concatenate([np.pad(p.astype(np.int64), ((0, 0), (0, width - p.shape[1]))) for p in parts])


def _task() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema, count = _arrow(), itertools.count()
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK):
            part = batch.slice(start, BLOCK)
            lists = part.column("vector")
            sizes = np.diff(lists.offsets.to_numpy()) if isinstance(lists, pa.ListArray) else np.array([len(x) for x in lists])
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            vectors = np.zeros((len(sizes), max(1, sizes.max())), np.int64)
            vectors[np.arange(vectors.shape[1]) < sizes[:, None]] = flat
            named = part.column("vec_id").is_valid().to_numpy(zero_copy_only=False)
            ids = part.column("vec_id").fill_null(0).to_numpy(zero_copy_only=False)
            number = (_task() << 22) + next(count)
            uids = (number * BLOCK) + np.arange(len(ids))
            yield pa.RecordBatch.from_pylist([_block(number, ids, named, part.column("label").to_numpy(zero_copy_only=False), uids, vectors)], schema)


def _arrow() -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(n, kinds[t]) for n, t in (x.split() for x in PACKED.split(", "))])


def _anchors(every: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, count, held, size = _arrow(), itertools.count(), [], 0

        def out():
            whole = [np.concatenate([h[k] for h in held]) for k in ("ids", "named", "labels", "uids")]
            return pa.RecordBatch.from_pylist([_block((_task() << 22) + next(count), *whole, _widen([h["vectors"] for h in held]))], schema)

        for x in (row for batch in batches for row in batch.to_pylist()):
            b = _read(x)
            pick = b["named"] & (b["ids"] % every == 0)
            if pick.any():
                held.append({k: b[k][pick] for k in ("ids", "named", "labels", "uids", "vectors")})
                size += int(pick.sum())
            if size >= BLOCK:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    return run


def products(a: dict, b: dict) -> np.ndarray:
    """Inner products of all anchors with all rows of a block, exact; beyond the range of long they stay at its end."""
    width = max(1, min(a["vectors"].shape[1], b["vectors"].shape[1]))
    x, y = a["vectors"][:, :width], b["vectors"][:, :width]
    bound = int(np.abs(x.astype(float)).max(initial=0) * np.abs(y.astype(float)).max(initial=0) * width * 1.001)
    if bound < 1 << 51:
        return (x.astype(float) @ y.T.astype(float)).astype(np.int64)
    return np.clip(x.astype(object) @ y.T.astype(object), -TOP, TOP)


def ranked(scores: np.ndarray) -> np.ndarray:
    """Scores and columns in one number, all different: higher scores first, then earlier columns."""
    columns = scores.shape[1]
    if scores.dtype != object and np.abs(scores).max(initial=0) >= (1 << 62) // columns:
        scores = scores.astype(object)
    return scores * columns + (columns - 1 - np.arange(columns))


def first(keys: np.ndarray, keep: np.ndarray, most: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows and columns of the highest, second highest ... kept key of each row."""
    below = BELOW if keys.dtype == object else np.iinfo(np.int64).min
    left, rows, out = np.where(keep, keys, below), np.arange(len(keys)), []
    for _ in range(min(most, keys.shape[1])):
        at = left.argmax(axis=1)
        found = left[np.arange(len(left)), at] > below
        rows, at, left = rows[found], at[found], left[found]
        if not len(rows):
            break
        out.append((rows, at))
        left[np.arange(len(rows)), at] = below
    return out


def _keys(a: dict, b: dict, scores: np.ndarray, picks: Iterable[tuple[np.ndarray, np.ndarray]], negative: int) -> np.ndarray:
    parts = []
    for i, j in picks:
        k = np.zeros(len(i), KEY)
        k["anchor"] = a["uids"][i]
        k["fall"] = [TOP - int(s) for s in scores[i, j]]
        k["negative"] = negative
        k["unnamed"] = ~b["named"][j]
        k["id"] = (b["ids"][j].astype(np.int64).view(np.uint64)) ^ np.uint64(1 << 63)
        k["uid"] = b["uids"][j]
        parts.append(k)
    return np.concatenate(parts) if parts else np.zeros(0, KEY)


def _kept(state: dict, block: int, names: np.ndarray, keys: np.ndarray, groups: np.ndarray, most: int) -> None:
    """Adds keys to what the task holds for an anchor block; of each group the first stay, as others come before the rest in any case."""
    old = state.get(block)
    if old is not None:
        keys, groups, names = np.concatenate([old[0], keys]), np.concatenate([old[1], groups]), np.concatenate([old[2], names])
    order = np.lexsort((keys["uid"], keys["id"], keys["unnamed"], keys["fall"], groups, keys["anchor"]))
    keys, groups, names = keys[order], groups[order], names[order]
    new = np.r_[True, (keys["anchor"][1:] != keys["anchor"][:-1]) | (groups[1:] != groups[:-1])] if len(keys) else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0)) if len(keys) else np.zeros(0, int)
    few = np.arange(len(keys)) - start < most
    state[block] = keys[few], groups[few], names[few]


def _flush(state: dict) -> Iterator[tuple[bytes, bytes]]:
    for keys, _, names in state.values():
        size, packed, named = KEY.itemsize, keys.astype(KEY).tobytes(), names.astype("<i8").tobytes()
        for i in range(len(keys)):
            yield packed[i * size : (i + 1) * size], named[8 * i : 8 * i + 8]
    state.clear()


def _nearest(most: int):
    """For each anchor of a pair of blocks the rows of its label with the highest scores, without itself."""

    def run(pairs) -> Iterator[tuple[bytes, bytes]]:
        state: dict = {}
        for p in pairs:
            a, b = _read(p["a"]), _read(p["b"])
            scores = products(a, b)
            same = a["labels"][:, None] == b["labels"][None, :]
            place = {int(u): i for i, u in enumerate(b["uids"])}
            for i, u in enumerate(a["uids"]):
                if (j := place.get(int(u))) is not None:
                    same[i, j] = False
            picks = first(ranked(scores), same, most)
            keys = _keys(a, b, scores, picks, 0)
            names = np.concatenate([a["ids"][i] for i, _ in picks]) if picks else np.zeros(0, np.int64)
            _kept(state, p["a"]["block"], names, keys, np.zeros(len(keys), np.int64), most)
            if len(state) >= CELL_ANCHORS:
                yield from _flush(state)
        yield from _flush(state)

    return run


def _within(most: int):
    """For each window of each anchor of a pair of blocks the rows of other labels with the highest scores in it."""

    def run(pairs) -> Iterator[tuple[bytes, bytes]]:
        state: dict = {}
        for p in pairs:
            a, b = _read(p["a"]), _read(p["b"])
            scores = products(a, b)
            keys, other = ranked(scores), a["labels"][:, None] != b["labels"][None, :]
            columns, slots = keys.shape[1], {}
            place = {int(u): i for i, u in enumerate(a["uids"])}
            for x in p["windows"]:
                slots.setdefault(x["place"], []).append((place[x["anchor"]], x["score"]))
            for slot, found in slots.items():
                rows = np.array([i for i, _ in found])
                low, high = (np.array([f(s) for _, s in found], object) for f in (lowest, highest))
                if keys.dtype != object:
                    low, high = (np.clip(v, -(1 << 62) // columns, (1 << 62) // columns).astype(np.int64) for v in (low, high))
                some = keys[rows]
                keep = other[rows] & (some >= (low * columns)[:, None]) & (some < ((high + 1) * columns)[:, None])
                if not keep.any():
                    continue
                picks = [(rows[i], j) for i, j in first(some, keep, most)]
                made = _keys(a, b, scores, picks, 1)
                _kept(state, p["a"]["block"], np.concatenate([a["ids"][i] for i, _ in picks]), made, np.full(len(made), slot, np.int64), most)
            if len(state) >= CELL_ANCHORS:
                yield from _flush(state)
        yield from _flush(state)

    return run


def lowest(positive: int) -> int:
    """The smallest score n with 50 * positive <= 100 * n."""
    return -(-positive // 2)


def highest(positive: int) -> int:
    """The largest score n with 100 * n <= 95 * positive."""
    return 95 * positive // 100


def _open(key: bytes) -> tuple[int, int, int, int | None, int]:
    anchor, fall, negative, unnamed, number, uid = struct.unpack(">QQBBQQ", key)
    return anchor, TOP - fall, negative, None if unnamed else number - (1 << 63), uid


def _leading(most: int):
    def run(pairs) -> Iterator[tuple]:
        last, k = None, 0
        for key, name in pairs:
            anchor, score, _, number, uid = _open(key)
            last, k = anchor, k + 1 if anchor == last else 0
            if k < most:
                yield anchor, int.from_bytes(name, "little", signed=True), k, number, uid, score

    return run


def _mined(most: int):
    """Walks over sorted keys: a positive opens its window, a negative goes to each open window that it lies in, full and passed windows close."""

    def run(pairs) -> Iterator[tuple]:
        last, before, windows = None, None, []
        for key, name in pairs:
            if key == before:  # two windows of one task asked for the same row
                continue
            before = key
            anchor, score, negative, number, _ = _open(key)
            if anchor != last:
                last, windows = anchor, []
            if not negative:
                windows.append([number, score, lowest(score), highest(score), 0])
                continue
            windows = [w for w in windows if w[2] <= score and w[4] < most]
            for w in windows:
                if score <= w[3]:
                    w[4] += 1
                    yield int.from_bytes(name, "little", signed=True), w[0], w[4], number, w[1], score

    return run


def mine(rows: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Rows with a null label, a null vector or a component that is null or not finite take no part.
    Anchors are the rows whose vec_id is divisible by `every`. Rows without a vec_id are no anchors;
    they can be positives and negatives (a null id, last among ties). Repeated rows are rows of
    their own: a copy of an anchor is one of its positives, and each copy of an anchor has its own
    result. A shorter vector counts as filled up with zeros, an empty one as zeros alone. Scores beyond
    the range of long stay at its end. An anchor without positives, or without rows in the windows,
    gives no row; an empty table gives an empty result. Other columns are not read.
    """
    spark = rows.sparkSession
    blocks = materialise(usable(rows).mapInArrow(_pack, PACKED), "vector-blocks")
    anchors = materialise(blocks.mapInArrow(_anchors(every), PACKED), "anchor-blocks")
    n, m = blocks.count(), anchors.count()
    columns = max(1, -(-m // CELL_ANCHORS))
    lines = max(1, -(-n // CELL_ROWS), min(n, -(-3 * spark.sparkContext.defaultParallelism // columns)))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    deal = lambda pairs: pairs.repartitionAndSortWithinPartitions(parts, lambda key: zlib.crc32(key[:8]))
    place = lambda size: F.pmod(F.xxhash64("block"), F.lit(size)).cast("int")
    whole = F.struct(*(x.split()[0] for x in PACKED.split(", ")))
    left = blocks.select(whole.alias("b"), place(lines).alias("line"), F.explode(F.sequence(F.lit(0), F.lit(columns - 1))).alias("column"))

    def met(right: DataFrame) -> DataFrame:
        right = right.select(whole.alias("a"), *(["windows"] if "windows" in right.columns else []), place(columns).alias("column"), F.explode(F.sequence(F.lit(0), F.lit(lines - 1))).alias("line"))
        return left.join(right, ["line", "column"])

    near = deal(met(anchors).rdd.mapPartitions(_nearest(positives))).mapPartitions(_leading(positives))
    known = materialise(spark.createDataFrame(near, "anchor long, anchor_id long, place int, positive_id long, uid long, score long"), "positives")
    windows = known.join(_owners(anchors), "anchor").groupBy("block").agg(F.collect_list(F.struct("anchor", "place", "score")).alias("windows"))
    below = met(anchors.join(windows, "block")).rdd.mapPartitions(_within(negatives))
    opened = known.rdd.mapPartitions(_again)
    out = deal(below.union(opened)).mapPartitions(_mined(negatives))
    return spark.createDataFrame(out, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")


def _owners(anchors: DataFrame) -> DataFrame:
    """The block of each anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in (row for batch in batches for row in batch.to_pylist()):
            uids = np.frombuffer(x["uids"], "<i8")
            yield pa.RecordBatch.from_pydict({"block": np.full(len(uids), x["block"]), "anchor": uids})

    return anchors.select("block", "uids").mapInArrow(run, "block long, anchor long")


def _again(rows) -> Iterator[tuple[bytes, bytes]]:
    """The keys of positives."""
    for r in rows:
        number = 0 if r["positive_id"] is None else r["positive_id"]
        key = struct.pack(">QQBBQQ", r["anchor"], TOP - r["score"], 0, r["positive_id"] is None, number + (1 << 63), r["uid"])
        yield key, r["anchor_id"].to_bytes(8, "little", signed=True)
