"""Repeated passages: removes each byte that a string of fixed length covers which also starts in a document with a smaller doc_id.

Texts are packed into shards of bounded size. First a filter finds the windows that can repeat at all:
windows with the same least hash of their grams form a stretch, and a stretch whose hash no other
document has is left out; where a hash always comes with the same stretch, its first window stands for
the others. The windows that are left are sorted as suffixes within their shard (Larsson-Sadakane
refinement, which stops at the length), Kasai's common prefixes cut the order into classes of
equal windows, and each class takes along its smallest doc_id. Shards exchange these by ranges of class
digests; in a range the runs of all shards are merged by binary search and each shard
learns of smaller ids elsewhere. Then covered bytes are removed.
"""

from __future__ import annotations

import functools
import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucketed, forget, materialise

#: Bytes of a shard and of a piece of a long text; bytes of text for each range of hashes.
SHARD, PIECE, RANGE = 2 << 20, 1 << 20, 8 << 20
SHARDS = "shard long, docs binary, data binary"
#: One row for each piece: the text's row, its doc_id (the largest number for null), whether that is null, the piece and their number, where it starts, its own bytes and those that it shares with the next.
DOCS = np.dtype([("uid", "<i8"), ("doc", "<i8"), ("null", "u1"), ("piece", "<i4"), ("pieces", "<i4"), ("start", "<i8"), ("own", "<i4"), ("tail", "<i4")])
LAST = (1 << 63) - 1
KINDS = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_(), "array<struct<start:long,end:long>>": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))}
_K = np.uint64(0x9E3779B97F4A7C15)
_R = np.uint64(0xD1342543DE82EF95)


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(n, KINDS[t]) for n, t in (x.split(" ", 1) for x in ddl.split(", "))])


def _batch(rows: list[dict], ddl: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, _schema(ddl))


def _packed(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        shards, rows, docs, data, size = itertools.count(task << 24), itertools.count(task << 40), [], [], 0

        def out():
            return _batch([{"shard": next(shards), "docs": np.array(docs, DOCS).tobytes(), "data": zlib.compress(b"".join(data), 1)}], SHARDS)

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                text, uid = text or b"", next(rows)
                pieces = max(1, -(-len(text) // PIECE))
                for k in range(pieces):
                    part = text[k * PIECE : (k + 1) * PIECE + length - 1]
                    own = min(PIECE, len(text) - k * PIECE)
                    if docs and size + len(part) > SHARD:
                        yield out()
                        docs, data, size = [], [], 0
                    docs.append((uid, LAST if doc is None else doc, doc is None, k, pieces, k * PIECE, own, len(part) - own))
                    data.append(part)
                    size += len(part)
        if docs:
            yield out()

    return run


def words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as a big-endian number; zeros follow the end, and 64 numbers more."""
    out = np.zeros(len(data) + 71, np.uint8)
    out[: len(data)] = data
    for size, kind in ((1, np.uint16), (2, np.uint32), (4, np.uint64)):
        wide = out[:-size].astype(kind)
        wide <<= kind(8 * size)
        wide |= out[size:]
        out = wide
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * _K
    return np.bitwise_xor(x, x >> np.uint64(32), out=x)


@functools.lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, and a random number for each byte."""
    up = np.full(n + 1, _R)
    down = np.full(n + 1, np.uint64(pow(int(_R), -1, 1 << 64)))
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64), _mix(_mix(np.arange(1, 257, dtype=np.uint64)))


class Sums:
    """Digests of any stretch of the data, by sums over powers modulo 2**64."""

    def __init__(self, data: np.ndarray) -> None:
        up, self.down, of = _powers(1 << max(20, int(len(data)).bit_length()))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(of[data] * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix(_mix((self.sums[end] - self.sums[start]) * self.down[start]) + (end - start).astype(np.uint64))


class Packed:
    """A shard's pieces and bytes."""

    def __init__(self, row: dict) -> None:
        self.docs = np.frombuffer(row["docs"], DOCS)
        self.data = np.frombuffer(zlib.decompress(row["data"]), np.uint8)
        self.sizes = self.docs["own"].astype(np.int64) + self.docs["tail"]
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes


class Shard(Packed):
    """A shard and its stretches: windows side by side with the same least hash of a gram."""

    def __init__(self, row: dict, length: int) -> None:
        super().__init__(row)
        self.length, sizes = length, self.sizes
        n, gram = len(self.data), length * 16 // 25
        eight = words(self.data)
        hashes, spare = eight[:n] * _K, np.empty(n, np.uint64)
        for at in [*range(8, gram - 7, 8), *([gram - 8] if gram % 8 else [])]:
            hashes ^= np.right_shift(hashes, np.uint64(32), out=spare)
            hashes ^= eight[at : at + n]
            hashes *= _K
        hashes ^= np.right_shift(hashes, np.uint64(32), out=spare)
        del eight, spare
        reach, span = length - gram + 1, 1
        while span * 2 <= reach:
            np.minimum(hashes[: n - span], hashes[span:], out=hashes[: n - span])
            span *= 2
        if reach > span:
            hashes[: n - reach + span] = np.minimum(hashes[: n - reach + span], hashes[reach - span :])
        new = np.empty(n, bool)
        new[:1] = True
        np.not_equal(hashes[1:], hashes[:-1], out=new[1:])
        new[self.starts[sizes > 0]] = True
        for begin, end in zip(self.starts.tolist(), self.ends.tolist()):
            new[max(begin, end - length + 1) : end] = False
        self.start = np.flatnonzero(new)
        self.piece = np.searchsorted(self.ends, self.start, side="right")
        self.hash = hashes[self.start]
        self.count = np.minimum(np.r_[self.start[1:], n], self.ends[self.piece] - length + 1) - self.start
        content = Sums(self.data).of(self.start, self.start + self.count + length - 1) & ~np.uint64(1)
        self.order = np.argsort(self.hash)
        h = self.hash[self.order]
        tied = np.zeros(len(h), bool)
        tied[1:] = h[1:] == h[:-1]
        tied[:-1] |= tied[1:]
        tied = np.flatnonzero(tied)  # few hashes come twice, so only these are sorted by content too
        own = self.order[tied]
        self.order[tied] = own[np.lexsort((own, content[own], self.hash[own]))]
        h, c = self.hash[self.order], content[self.order]
        first = np.r_[True, (h[1:] != h[:-1]) | (c[1:] != c[:-1])] if len(h) else np.zeros(0, bool)
        self.group = np.empty(len(h), np.int64)
        self.group[self.order] = np.cumsum(first) - 1
        at = np.flatnonzero(first)
        uid = self.docs["uid"][self.piece[self.order]]
        same = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else at
        many = np.minimum.reduceat(uid, same) != np.maximum.reduceat(uid, same) if len(same) else np.zeros(0, bool)
        many = np.repeat(many, np.diff(np.r_[same, len(h)]))[at]
        #: Distinct stretches in order of their hash; the lowest bit of the digest: the hash is in several texts of this shard.
        self.hashes, self.contents = h[at], c[at] | many.astype(np.uint64)


def _slices(hashes: np.ndarray, ranges: int) -> Iterator[tuple[int, int, int]]:
    """Ranges of sorted hashes that have any: number, from, to."""
    number = ((hashes >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
    at = np.flatnonzero(np.r_[True, number[1:] != number[:-1]]) if len(number) else np.zeros(0, int)
    yield from zip(number[at].tolist(), at.tolist(), [*at[1:].tolist(), len(number)])


def _sent(length: int, ranges: int):
    """Distinct stretches of each shard, by ranges of hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for batch in batches for r in batch.to_pylist()):
            s = Shard(row, length)
            for k, a, b in _slices(s.hashes, ranges):
                yield _batch([{"part": k, "shard": row["shard"], "hashes": s.hashes[a:b].tobytes(), "contents": s.contents[a:b].tobytes()}], STRETCHES)

    return run


STRETCHES = "part int, shard long, hashes binary, contents binary"
FLAGS = "shard long, part int, flags binary"
CLASSES = "part int, at int, shard long, keys binary, checks binary, docs binary"
SMALLER = "shard long, at int, windows int, found binary, docs binary"


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """The rows of each part; rows come in order of parts."""
    rows = (r for batch in batches for k in range(batch.num_rows) for r in batch.slice(k, 1).to_pylist())
    for part, group in itertools.groupby(rows, lambda r: r["part"]):
        yield part, list(group)


def _flagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each stretch sent: 0, its hash is in one text only; 1, it is in several and always in this stretch; 2, in several stretches."""
    for part, rows in _together(batches):
        sizes = [len(r["hashes"]) // 8 for r in rows]
        h, c = (np.frombuffer(b"".join(r[n] for r in rows), np.uint64) for n in ("hashes", "contents"))
        order = np.argsort(h, kind="stable")
        h, c, source = h[order], c[order], np.repeat(np.arange(len(rows), dtype=np.int32), sizes)[order]
        at = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        bare = c & ~np.uint64(1)
        alike = np.minimum.reduceat(bare, at) == np.maximum.reduceat(bare, at)
        several = (np.minimum.reduceat(source, at) != np.maximum.reduceat(source, at)) | (np.maximum.reduceat(c & np.uint64(1), at) > 0)
        flags = np.empty(len(h), np.uint8)
        flags[order] = np.repeat(np.where(several, np.where(alike, 1, 2), 0), np.diff(np.r_[at, len(h)]))
        for r, own in zip(rows, np.split(flags, np.cumsum(sizes)[:-1])):
            yield _batch([{"shard": r["shard"], "part": part, "flags": zlib.compress(own.tobytes(), 1)}], FLAGS)


def suffix_order(eight: np.ndarray, n: int, length: int) -> np.ndarray:
    """Positions in order of the next `length` bytes: groups of eight bytes, refined by the groups further on until all bytes count.

    Positions alone in their group are settled and not touched again (Larsson and Sadakane).
    """
    order = np.argsort(eight[:n], kind="stable")
    sorted_words = eight[order]
    new = np.r_[True, sorted_words[1:] != sorted_words[:-1]]
    rank = np.zeros(n + length + 1, np.int64)  # beyond the end: before all others
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0)) + 1
    known = 8
    while known < length:
        step = min(known, length - known)
        single = new & np.r_[new[1:], True]
        slots = np.flatnonzero(~single)
        if not len(slots):
            break
        active = order[slots]
        key = (rank[active].astype(np.uint64) << np.uint64(32)) | rank[active + step].astype(np.uint64)
        by = np.argsort(key, kind="stable")
        key = key[by]
        order[slots] = active[by]
        cut = np.r_[True, key[1:] != key[:-1]]
        new[slots] = cut
        rank[active[by]] = np.maximum.accumulate(np.where(cut, slots, 0)) + 1
        known += step
    return order


def common_prefixes(eight: np.ndarray, order: np.ndarray, length: int, lanes: int = 4096) -> np.ndarray:
    """Bytes, `length` at most, that each suffix has in common with the one before it in the order, by position.

    Kasai's walk in text order, in which the number falls by one at most from a position to the next; so many
    stretches of the text are walked side by side, and bytes are compared eight at a time.
    """
    n = len(order)
    lanes = max(1, min(lanes, n // 32))
    steps = -(-n // lanes)
    before = np.full(lanes * steps, -1, np.int64)
    before[order[1:]] = order[:-1]
    bounds = np.uint64(1) << (np.arange(8, dtype=np.uint64) * np.uint64(8))
    out, start, have = np.zeros(lanes * steps, np.int64), np.arange(lanes) * steps, np.zeros(lanes, np.int64)
    for t in range(steps):
        here = start + t
        there = before[here]
        # Suffixes alike in all `length` bytes are in any order, so the number is carried on from the others only.
        have = np.where((there < 0) | (have >= length), 0, np.maximum(have - 1, 0))
        open_ = np.flatnonzero((there >= 0) & (have < length))
        while len(open_):
            h = have[open_]
            equal = 8 - np.searchsorted(bounds, eight[here[open_] + h] ^ eight[there[open_] + h], side="right")
            have[open_] = h + equal
            open_ = open_[(equal == 8) & (h + 8 < length)]
        have = np.minimum(have, length)
        out[here] = have
    return out[:n]


class Classes:
    """Classes of equal windows of a shard, among those that the filter left."""

    def __init__(self, shard: Shard, flags: np.ndarray) -> None:
        length, of = shard.length, flags[shard.group]
        self.kept = np.flatnonzero(of)
        # A stretch that is the same everywhere is judged by its first window.
        self.windows = np.where(of[self.kept] == 2, shard.count[self.kept], 1)
        span = np.repeat(np.arange(len(self.kept)), self.windows)
        self.span = span
        self.at = np.arange(len(span)) - np.repeat(np.cumsum(self.windows) - self.windows, self.windows) + shard.start[self.kept[span]]
        self.doc = shard.docs["doc"][shard.piece[self.kept[span]]]
        change = np.zeros(len(shard.data) + 1, np.int32)
        np.add.at(change, shard.start[self.kept], 1)
        np.add.at(change, shard.start[self.kept] + self.windows + length - 1, -1)
        use = np.flatnonzero(np.cumsum(change[:-1]))
        text = shard.data[use]
        self.of = np.zeros(0, np.int64)
        self.keys = self.checks = np.zeros(0, np.uint64)
        self.least = np.zeros(0, np.int64)
        if not len(text):
            return
        place = np.searchsorted(use, self.at)
        eight = words(text)
        order = suffix_order(eight, len(text), length)
        same = common_prefixes(eight, order, length)[order] >= length
        number = np.empty(len(text), np.int64)
        number[order] = np.cumsum(~same)
        _, first, self.of = np.unique(number[place], return_index=True, return_inverse=True)
        least = np.full(len(first), LAST)
        np.minimum.at(least, self.of, self.doc)
        at = place[first]
        keys = Sums(text).of(at, at + length)
        checks = _mix(eight[at])
        for k in [*range(8, length - 7, 8), length - 8]:
            checks = _mix(checks ^ eight[at + k])
        by = np.lexsort((checks, keys))
        self.keys, self.checks, self.least = keys[by], checks[by], least[by]
        back = np.empty(len(by), np.int64)
        back[by] = np.arange(len(by))
        self.of = back[self.of]


def _flags(rows) -> np.ndarray:
    return np.frombuffer(b"".join(zlib.decompress(r["flags"]) for r in sorted(rows, key=lambda r: r["part"])), np.uint8)


def _classed(length: int, ranges: int):
    """Each shard's classes with their smallest doc_id, by ranges of keys, and under a part below 0 a note for the shard itself: its windows, their reach, whether an id of the shard is smaller, and their class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _one_by_one(batches):
            shard = Shard(row, length)
            c = Classes(shard, _flags(row["flags"]))
            # A window for each position of a mixed stretch, one for all of a stretch that is the same everywhere.
            wide = np.where(c.windows[c.span] > 1, 1, shard.count[c.kept[c.span]])
            hit = c.least[c.of] < c.doc if len(c.at) else np.zeros(0, bool)
            note = zlib.compress(b"".join((np.diff(c.at, prepend=0).astype("<i4").tobytes(), wide.astype("<i4").tobytes(), hit.tobytes())), 1)
            yield _batch([{"part": -1 - row["shard"] % ranges, "at": 0, "shard": row["shard"], "keys": len(c.at).to_bytes(8, "little"), "checks": note, "docs": _short(c.of, _width(c.of))}], CLASSES)
            for k, a, b in _slices(c.keys, ranges):
                least = c.least[a:b]
                steps = np.diff(c.keys[a:b])
                keys = c.keys[a : a + 1].tobytes() + _short(steps, _width(steps))
                yield _batch([{"part": k, "at": a, "shard": row["shard"], "keys": keys, "checks": _short(c.checks[a:b], 4), "docs": _short(least, _width(least))}], CLASSES)

    return run


def _short(values: np.ndarray, size: int) -> bytes:
    """The low bytes of numbers that are not below 0."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].tobytes()


def _width(values: np.ndarray) -> int:
    """Bytes that the largest of some numbers needs; 8 if one is below 0."""
    return 8 if len(values) and values.min() < 0 else max(1, -(-int(values.max(initial=0)).bit_length() // 8))


def _long(data: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, "<u8")
    out = np.zeros((n, 8), np.uint8)
    out[:, : len(data) // n] = np.frombuffer(data, np.uint8).reshape(n, -1)
    return out.reshape(-1).view("<u8")


def _one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def merged(runs: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """For each run of (sorted keys, checks, numbers) the smallest number that any run has for the same key and check."""
    keys = np.unique(np.concatenate([r[0] for r in runs]))
    at = [np.searchsorted(keys, r[0]) for r in runs]
    least, low, high = np.full(len(keys), LAST), np.full(len(keys), np.uint64(0)) - np.uint64(1), np.zeros(len(keys), np.uint64)
    for place, (_, checks, numbers) in zip(at, runs):
        np.minimum.at(least, place, numbers)
        np.minimum.at(low, place, checks)
        np.maximum.at(high, place, checks)
    out = [least[place] for place in at]
    if (low != high).any():  # one key for two classes: the checks tell them apart
        best: dict = {}
        mixed = [np.flatnonzero((low != high)[place]) for place in at]
        for i, (k, c, v) in zip(mixed, runs):
            for j in i.tolist():
                best[k[j], c[j]] = min(best.get((k[j], c[j]), LAST), int(v[j]))
        for i, (k, c, _), o in zip(mixed, runs, out):
            o[i] = [best[k[j], c[j]] for j in i.tolist()]
    return out


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each shard the classes that have a smaller doc_id elsewhere; a shard's note is passed on, with its number of windows."""
    for part, rows in _together(batches):
        if part < 0:
            for r in rows:
                yield _batch([{"shard": r["shard"], "at": 0, "windows": int.from_bytes(r["keys"], "little"), "found": r["checks"], "docs": r["docs"]}], SMALLER)
            continue
        runs = []
        for r in rows:
            n = len(r["checks"]) // 4
            keys = np.cumsum(np.r_[np.frombuffer(r["keys"], "<u8", 1), _long(r["keys"][8:], n - 1)], dtype=np.uint64)
            runs.append((keys, _long(r["checks"], n), _long(r["docs"], n).view(np.int64)))
        for r, run, least in zip(rows, runs, merged(runs)):
            found = least < run[2]
            if found.any():
                yield _batch([{"shard": r["shard"], "at": r["at"], "windows": None, "found": np.packbits(found).tobytes(), "docs": _short(least[found], _width(least[found]))}], SMALLER)


PIECES = "uid long, doc_id long, piece int, pieces int, at long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"


def _spans(covered: np.ndarray) -> list[dict]:
    edges = np.flatnonzero(np.diff(np.r_[0, covered.astype(np.int8), 0]))
    return [{"start": a, "end": b} for a, b in zip(edges[::2].tolist(), edges[1::2].tolist())]


class Note:
    """What a shard noted of its windows, with the smaller ids that other shards had."""

    def __init__(self, rows) -> None:
        note = next(r for r in rows if r["windows"] is not None)
        n, data = note["windows"], zlib.decompress(note["found"])
        step, self.wide = (np.frombuffer(data, "<i4", n, 4 * n * k) for k in (0, 1))
        self.at, self.hit = np.cumsum(step, dtype=np.int64), np.frombuffer(data, bool, n, 8 * n)
        self.of = _long(note["docs"], n).view(np.int64)
        self.least = np.full(int(self.of.max(initial=-1)) + 1, LAST)
        for r in rows:
            if r["windows"] is None:
                found = np.flatnonzero(np.unpackbits(np.frombuffer(r["found"], np.uint8)))
                self.least[r["at"] + found] = _long(r["docs"], len(found)).view(np.int64)


def _cut(length: int):
    """The texts without what is covered; of a text in pieces each piece with all its bytes and the spans that begin in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _one_by_one(batches):
            s, note = Packed(row), Note(row["notes"])
            covered = np.zeros(len(s.data) + 1, np.int32)
            doc = s.docs["doc"][np.searchsorted(s.ends, note.at, side="right")]
            hit = note.hit | (note.least[note.of] < doc)
            np.add.at(covered, note.at[hit], 1)
            np.add.at(covered, note.at[hit] + note.wide[hit] + length - 1, -1)
            covered, data, out, size = np.cumsum(covered[:-1]) > 0, s.data.tobytes(), [], 0
            for d, a, b in zip(s.docs, s.starts.tolist(), s.ends.tolist()):
                own = a + int(d["own"])
                if d["pieces"] > 1:
                    spans = [{k: v + int(d["start"]) for k, v in x.items()} for x in _spans(covered[a:b])]
                    kept = data[a:own]
                else:
                    spans = _spans(covered[a:b]) if covered[a:b].any() else []
                    kept = data[a:b] if not spans else s.data[a:b][~covered[a:b]].tobytes()
                out.append({"uid": int(d["uid"]), "doc_id": None if d["null"] else int(d["doc"]), "piece": int(d["piece"]), "pieces": int(d["pieces"]), "at": int(d["start"]), "n_bytes": int(d["own"]), "spans": spans, "kept": kept})
                size += len(kept)
                if size > 1 << 20:
                    yield _batch(out, PIECES)
                    out, size = [], 0
            if out:
                yield _batch(out, PIECES)

    return run


DONE = "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts from their pieces, which come in order."""
    rows = _one_by_one(batches)
    for _, pieces in itertools.groupby(rows, lambda r: r["uid"]):
        pieces = list(pieces)
        data = np.frombuffer(b"".join(p["kept"] for p in pieces), np.uint8)
        covered = np.zeros(len(data), bool)
        for x in (x for p in pieces for x in p["spans"]):
            covered[x["start"] : x["end"]] = True
        yield _batch([{"doc_id": pieces[0]["doc_id"], "n_bytes": len(data), "spans": _spans(covered), "kept": data[~covered].tobytes()}], DONE)


def remove_repeats(documents: DataFrame, length: int = 50) -> DataFrame:
    """doc_id, n_bytes, spans (start, end in bytes: what goes, in maximal runs), kept (the bytes that stay): one row per input row.

    Texts are UTF-8 bytes; a null text is empty. All strings are judged on the input. Rows with equal doc_id
    do not count against one another; a null doc_id counts as larger than any other. A text of fewer
    than `length` bytes stays whole. `length` is 25 at least. An empty table gives an empty
    result. Other columns are not read.
    """
    spark = documents.sparkSession
    packed = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Shards stay in their buckets through both joins; only what they are told is shuffled.
    shards = bucketed(packed.mapInArrow(_packed(length), SHARDS), "repeat-shards", "shard", parts)
    total = shards.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    ranges = max(parts, 3 * total // RANGE)  # compressed to about a third

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition(ranges, "part").sortWithinPartitions("part")

    flags = materialise(dealt(shards.mapInArrow(_sent(length, ranges), STRETCHES)).mapInArrow(_flagged, FLAGS), "repeat-flags")
    flags = flags.groupBy("shard").agg(F.collect_list(F.struct("part", "flags")).alias("flags"))
    held = shards.join(flags, "shard", "left").withColumn("flags", F.coalesce("flags", F.array().cast("array<struct<part:int,flags:binary>>")))
    smaller = materialise(dealt(held.mapInArrow(_classed(length, ranges), CLASSES)).mapInArrow(_searched, SMALLER), "repeat-smaller")
    notes = smaller.groupBy("shard").agg(F.collect_list(F.struct("at", "windows", "found", "docs")).alias("notes"))
    done = materialise(shards.join(notes, "shard").mapInArrow(_cut(length), PIECES), "repeat-pieces")
    forget(shards)
    whole = done.where("pieces = 1").select("doc_id", "n_bytes", "spans", "kept")
    long = done.where("pieces > 1").repartition("uid").sortWithinPartitions("uid", "piece").mapInArrow(_joined, DONE)
    return whole.unionByName(long)
