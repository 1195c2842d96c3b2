"""N-gram Jaccard join: size-aware, heavy and light sets, exact.

A text's set is its distinct five-word shingles. Texts with equal sets are one
class; the join runs between classes.

* Light sets (few shingles) enumerate their subsets of the sizes that a link to
  another light set makes necessary; two light sets that link share a subset.
* Heavy sets post the first tokens of their set, in one global order, to
  inverted lists; two sets that link share a posted token if either is heavy.

The boundary between light and heavy is the one with the least estimated cost.
The order puts tokens known to be frequent last. That knowledge is a bounded
list and may be rough: any order gives the same result.

A list of k sets is not expanded into k * k pairs. Rounds compare each list's
members with one pivot and merge what links; lists whose members are by then in
one component are done. What is left is compared in full, only across
components, so no link that could join two components is missed.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, materialise

WIDTH = 5
#: Links when PERCENT_I * intersection >= PERCENT_U * union.
PERCENT = 80
#: Length of the list of frequent tokens, entries a task adds to it, and the texts of a batch that make a token one.
FREQUENT, FREQUENT_TASK, FREQUENT_FROM = 200_000, 100_000, 2
#: Texts that a task holds as Python objects at once.
SLICE = 256
#: Bits of a set's parity sketch: sets differ by at least as many tokens as their sketches by bits.
SKETCH = 1024
#: A frequent token in so many texts is posted as rows, not in blocks, so that no task holds all its sets.
HOT = 100_000
#: Positions from here on are sent as this one: an earlier position rules out fewer pairs, never more.
FAR = (1 << 16) - 1
#: Largest boundary that is considered.
MAX_LIGHT = 12
#: Pairs of one pivot that are verified in one group.
GROUP = 512
#: Bits at most of the filter by which only texts of listed sets are cut again, and of a stretch of it.
MAX_FILTER, BLOCK_BITS = 1 << 30, 1 << 16
STAR_ROUNDS = 2
#: From this size on a component is compared with what it may link to in blocks, not pair by pair; members or others of a block.
BIG, BLOCK = 64, 512

_MULT = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) | 1 for k in range(WIDTH)], np.uint64)


class _Ids(dict):
    def __missing__(self, word):
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
        return h ^ (h >> np.uint64(33))


def shingle_set(text: bytes, ids: dict) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(ids.__getitem__, words), np.uint64, len(words))
    if len(ids) > 200_000:
        ids.clear()
    n = max(1, len(h) - WIDTH + 1)
    k = min(WIDTH, len(h))
    with np.errstate(over="ignore"):
        out = np.full(n, np.uint64(k * 0x632BE59BD9B4E019 & (2**64 - 1)))
        for j in range(k):
            out += mixed(h[j : j + n] ^ _MULT[j]) * _MULT[j]
    return np.unique(mixed(out))


def needed(n: int) -> int:
    """The least overlap of a set of n with any set that it links to."""
    return -(-PERCENT * n // 100)


def prefix_length(n: int) -> int:
    return n - needed(n) + 1


def subset_sizes(n: int, light: int) -> list[int]:
    return sorted({needed(m) for m in range(n, light + 1) if needed(m) <= n})


def boundary(sizes: dict[int, int], mean_list: float = 2.0) -> int:
    """The largest light set: the boundary at which subsets and postings together cost least.

    sizes: how many sets there are of each size up to MAX_LIGHT * 1.25; larger
    ones post in any case. A posting costs mean_list, for the list that is
    scanned, a subset 1.
    """

    def cost(light: int) -> float:
        subsets = sum(c * sum(comb(n, t) for t in subset_sizes(n, light)) for n, c in sizes.items() if n <= light)
        return subsets + sum(c * prefix_length(n) * mean_list for n, c in sizes.items() if n >= needed(light + 1))

    return min(range(MAX_LIGHT + 1), key=lambda b: (cost(b), b))


def _texts(batch: pa.RecordBatch) -> Iterator[bytes | None]:
    """The texts of a batch, few at a time as Python objects."""
    column = batch.column("text").cast(pa.large_binary())
    for k in range(0, len(column), SLICE):
        yield from column.slice(k, SLICE).to_pylist()


def _set_id(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def _counts_of(tokens: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not tokens:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    t = np.concatenate(tokens)
    tokens.clear()
    t.sort()
    t, c = np.unique(t[1:][t[1:] == t[:-1]], return_counts=True)  # most tokens stand alone
    keep = c + 1 >= FREQUENT_FROM
    return t[keep], c[keep] + 1


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per text; rows without doc_id but with a token are counts of frequent tokens."""
    ids, tokens, counts = _Ids(), [], []
    names = ["doc_id", "row", "n", "set_id", "token", "texts"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def rows(*cols):
        size = max(len(c) for c in cols if c is not None)
        return pa.RecordBatch.from_arrays([pa.nulls(size, k) if c is None else pa.array(c, k) for c, k in zip(cols, kinds)], names)

    for batch in batches:
        sets, n, key, seen = [], [], [], set()
        for text in _texts(batch):
            s = shingle_set(text or b"", ids)
            n.append(len(s))
            key.append(_set_id(s))
            if len(s) and key[-1] not in seen:
                seen.add(key[-1])
                sets.append(s)
        yield rows(batch.column("doc_id").to_pylist(), batch.column("row").to_pylist(), n, key, None, None)
        t, c = _counts_of(sets)
        tokens.append(t)
        counts.append(c)
    pa.default_memory_pool().release_unused()
    if tokens:
        t, back = np.unique(np.concatenate(tokens), return_inverse=True)
        c = np.bincount(back, np.concatenate(counts), len(t)).astype(np.int64)
        top = np.argsort(-c, kind="stable")[:FREQUENT_TASK]
        if len(top):
            yield rows(None, None, None, None, t[top].view(np.int64), c[top])


def ordered(s: np.ndarray, frequent: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The set in the global order: rare tokens by hash, then frequent ones, the most frequent last."""
    if not len(frequent):
        return s
    at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
    known = frequent[at] == s
    if not known.any():
        return s
    often = s[known]
    return np.concatenate([s[~known], often[np.argsort(rank[at[known]], kind="stable")]])


def sketch(s: np.ndarray) -> list[int]:
    """For each of SKETCH classes of tokens, whether the set has an odd number of them."""
    odd = np.bincount((s >> np.uint64(64 - (SKETCH.bit_length() - 1))).astype(np.int64), minlength=SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def subset_tokens(s: np.ndarray, light: int) -> list[int]:
    out = []
    for t in subset_sizes(len(s), light):
        for c in combinations(s.tolist(), t):
            out.append(xxhash.xxh3_64_intdigest(np.array(c, np.uint64).tobytes(), seed=t))
    return out


def _signer(shared, light: int):
    """set_id, n, prefix and subset tokens of each set; the prefix is in the global order."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, rank, _ = shared.value
        ids, seen = _Ids(), set()
        for batch in batches:
            rows = []
            for text in _texts(batch):
                s = shingle_set(text or b"", ids)
                key = _set_id(s)
                if not len(s) or key in seen:
                    continue
                seen.add(key)
                subsets = np.array(subset_tokens(s, light), np.uint64) if len(s) <= light else s[:0]
                rows.append((key, len(s), ordered(s, frequent, rank)[: prefix_length(len(s))].tobytes(), subsets.tobytes(), sketch(s)))
            if len(seen) > 1_000_000:
                seen.clear()
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64())))], ["set_id", "n", "prefix", "subsets", "sketch"])

    return sign


def _poster(shared, light: int, buckets: int):
    """Postings of all sets: blocks of (token, set) by bucket, and rows (run, set) for hot tokens."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = shared.value[2]
        for batch in batches:
            tokens, owner, place = [], [], []
            for key, n, prefix, subsets in zip(*(batch.column(c).to_pylist() for c in ("set_id", "n", "prefix", "subsets"))):
                mine = np.frombuffer(subsets + prefix if n >= needed(light + 1) else subsets, np.uint64)
                tokens.append(mine)
                owner.append(np.full(len(mine), key, np.int64))
                place.append(np.clip(np.arange(len(mine)) - len(subsets) // 8, 0, FAR).astype(np.uint16))
            if not tokens:
                continue
            t, o, at = np.concatenate(tokens), np.concatenate(owner), np.concatenate(place)
            direct = np.isin(t, hot) if len(hot) else np.zeros(len(t), bool)
            if direct.any():
                k = int(direct.sum())
                yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary()), pa.array(t[direct].view(np.int64)), pa.array(o[direct]), pa.array(at[direct].astype(np.int32))], ["bucket", "block", "run", "set_id", "pos"])
                t, o, at = t[~direct], o[~direct], at[~direct]
            b = (t % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(b, kind="stable")
            b, t, o, at = b[order], (t[order] >> np.uint64(32)).astype(np.uint32), o[order], at[order]
            cut = np.flatnonzero(np.diff(b, prepend=-1))
            ends = [*cut[1:], len(b)]
            blocks = [t[i:j].tobytes() + at[i:j].tobytes() + o[i:j].tobytes() for i, j in zip(cut, ends)]
            yield pa.RecordBatch.from_arrays([pa.array(b[cut]), pa.array(blocks, pa.binary()), pa.nulls(len(cut), pa.int64()), pa.nulls(len(cut), pa.int64()), pa.nulls(len(cut), pa.int32())], ["bucket", "block", "run", "set_id", "pos"])

    return post


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lists of two sets or more; of equal lists only that of the token which comes first in the sets."""
    keys, places, owners, out = [], [], [], []
    for batch in batches:
        for bucket, block, run, owner, pos in zip(*(c.to_pylist() for c in batch.columns)):
            if block is None:
                out.append((np.array([run]), np.array([owner]), np.array([pos], np.int32)))
                continue
            n = len(block) // 14
            keys.append((np.uint64(bucket) << np.uint64(32)) | np.frombuffer(block, np.uint32, n).astype(np.uint64))
            places.append(np.frombuffer(block, np.uint16, n, 4 * n))
            owners.append(np.frombuffer(block, np.int64, n, 6 * n))
    if keys:
        k, o, at = np.concatenate(keys), np.concatenate(owners), np.concatenate(places)
        del keys, owners, places
        order = np.argsort(k, kind="stable")
        k, o, at = k[order], o[order], at[order]
        same = np.zeros(len(k), bool)
        same[1:] = k[1:] == k[:-1]
        same[:-1] |= same[1:]
        k, o, at = k[same], o[same], at[same]  # most tokens stand alone
        order = np.lexsort((at, o, k))
        k, o, at = k[order], o[order], at[order]
        fresh = np.ones(len(k), bool)
        fresh[1:] = (k[1:] != k[:-1]) | (o[1:] != o[:-1])
        k, o, at = k[fresh], o[fresh], at[fresh]
        if len(k):
            start = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            size = np.diff(np.append(start, len(k)))
            with np.errstate(over="ignore"):
                name = np.add.reduceat(mixed(mixed(o.view(np.uint64)) + np.uint64(0x51)), start)
            first = np.lexsort((np.add.reduceat(at.astype(np.int64), start), name))
            pick = np.zeros(len(start), bool)
            pick[first[np.concatenate([[True], name[first][1:] != name[first][:-1]])]] = True
            member = np.repeat(pick & (size > 1), size)
            out.append((np.repeat(name, size)[member].view(np.int64), o[member], at[member].astype(np.int32)))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["run", "set_id", "pos"])


def overlap(small: np.ndarray, large: np.ndarray) -> int:
    """Common elements of two sorted sets."""
    if len(small) > len(large):
        small, large = large, small
    return int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())


def links_exactly(x: np.ndarray, y: np.ndarray, nx: int, ny: int) -> bool:
    """Do these whole sets link? Empty ones never do."""
    if 100 * min(nx, ny) < PERCENT * max(nx, ny):
        return False
    both = overlap(x, y)
    return both > 0 and 100 * both >= PERCENT * (nx + ny - both)


def may_link(a: np.ndarray, b: np.ndarray, nx: int, ny: int) -> bool:
    """Can sets with these prefixes link? What stands in one prefix only, up to the end of the one that ends first, is in one set only."""
    common, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    i, j = (int(i.max()) + 1, int(j.max()) + 1) if len(common) else (0, 0)
    apart = i + j - 2 * len(common) + min(len(a) - i, len(b) - j)
    return (100 + PERCENT) * apart <= (100 - PERCENT) * (nx + ny)


def _as_prefix():
    return lambda held, n: (np.frombuffer(held, np.uint64), n)


def _as_text():
    """Cuts a text into its whole set. Texts are sent rather than sets since words compress and hashes do not."""
    ids = _Ids()

    def cut(held: bytes, _) -> tuple[np.ndarray, int]:
        s = shingle_set(held, ids)
        return s, len(s)

    return cut


def _tester(test, reader):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by pivot and group, the pivot's own first."""
        pivots, key, read = [], None, reader()  # one row each, as texts() has one for each id
        for batch in batches:
            a, b = [], []
            for k in range(0, batch.num_rows, SLICE):
                part = batch.slice(k, SLICE)
                for row_a, salt, other, row_id, n, held in zip(*(part.column(c).to_pylist() for c in ("a", "salt", "other", "id", "n", "held"))):
                    tokens, size = read(held, n)
                    if not other:
                        pivots = [*pivots, (tokens, size)] if key == (row_a, salt) else [(tokens, size)]
                        key = (row_a, salt)
                        continue
                    assert key == (row_a, salt), "a pivot is missing"
                    if any(test(p, tokens, of_p, size) for p, of_p in pivots):
                        a.append(row_a)
                        b.append(row_id)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def tested(pairs: DataFrame, sets: DataFrame, test, reader, names: DataFrame | None = None) -> DataFrame:
    """The pairs (a, b) that pass a test of both rows (id, n, held), held as the reader reads it. A pivot's pairs are split into groups of about GROUP.

    With names (id, set_id) the sets go by set_id: what is asked is renamed, as it is smaller than what the sets hold.
    """
    groups = pairs.groupBy("a").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("groups"))
    salted = pairs.join(groups, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("groups")).cast("int").alias("salt"))
    ask = salted.select("a", "salt", F.col("b").alias("id"), F.lit(True).alias("other")).unionByName(salted.select("a", "salt").distinct().select("a", "salt", F.col("a").alias("id"), F.lit(False).alias("other")))
    if names is not None:
        ask = ask.join(names, "id")
    rows = ask.join(sets, "id" if names is None else "set_id").select("a", "salt", "other", "id", "n", "held")
    return rows.repartition("a", "salt").sortWithinPartitions("a", "salt", "other").mapInArrow(_tester(test, reader), "a long, b long")


def _grid(batches: Iterator[pa.RecordBatch], every: bool = False) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by cell, a component's members before the others; a link to one member is enough unless every one counts."""
    members, cell, read = [], None, _as_text()
    for batch in batches:
        a, b = [], []
        for k in range(0, batch.num_rows, SLICE):
            part = batch.slice(k, SLICE)
            for *here, other, row_id, held in zip(*(part.column(c).to_pylist() for c in ("comp", "row", "col", "other", "id", "held"))):
                tokens, n = read(held, None)
                if here != cell:
                    members, cell = [], here
                if not other:
                    members.append((row_id, n, tokens))
                    continue
                for m, size, own in members:
                    if (not every or m < row_id) and links_exactly(own, tokens, size, n):
                        a.append(m)
                        b.append(row_id)
                        if not every:
                            break
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def compared(docs: DataFrame, lists: DataFrame, big: DataFrame) -> DataFrame:
    """Links (a, b) of big components' members with all else in their lists. Cells of BLOCK by BLOCK sets, so rows grow with the sets, not the pairs."""
    members = lists.join(big, "comp").select("comp", "id").distinct()
    met = lists.select("run", "comp").distinct().join(big.select("comp"), "comp").select("run", F.col("comp").alias("c"))
    other = lists.select("run", "id", "comp").join(big.select("comp", F.lit(True).alias("big")), "comp", "left").join(met, "run")
    other = other.where(F.when(F.col("big"), F.col("c") < F.col("comp")).otherwise(F.col("c") != F.col("comp"))).select(F.col("c").alias("comp"), "id").distinct()
    shape = members.groupBy("comp").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("rows")).join(other.groupBy("comp").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("cols")), "comp")
    row, col = F.pmod(F.xxhash64("id"), F.col("rows")).cast("int"), F.pmod(F.xxhash64("id"), F.col("cols")).cast("int")
    left = members.join(shape, "comp").select("comp", row.alias("row"), F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("col"), F.lit(False).alias("other"), "id")
    right = other.join(shape, "comp").select("comp", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("row"), col.alias("col"), F.lit(True).alias("other"), "id")
    ask = materialise(left.unionByName(right), "shingle-grid")
    return _in_cells(docs, ask, every=False)


def _in_cells(docs: DataFrame, ask: DataFrame, every: bool) -> DataFrame:
    rows = ask.join(full_texts(docs, ask.select("id")), "id").select("comp", "row", "col", "other", "id", "held")
    return rows.repartition("comp", "row", "col").sortWithinPartitions("comp", "row", "col", "other").mapInArrow(lambda batches: _grid(batches, every), "a long, b long")


def compared_lists(docs: DataFrame, lists: DataFrame) -> DataFrame:
    """Links (a, b) within long lists, in cells of BLOCK by BLOCK sets: a list of k sets gives k * k / BLOCK rows, not k * k."""
    shape = lists.groupBy("run").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("side"))
    at = F.pmod(F.xxhash64("id"), F.col("side")).cast("int")
    own = lists.join(shape, "run").select(F.col("run").alias("comp"), "id", at.alias("at"), F.explode(F.sequence(F.lit(0), F.col("side") - 1)).alias("k"))
    left = own.select("comp", F.col("at").alias("row"), F.col("k").alias("col"), F.lit(False).alias("other"), "id")
    right = own.select("comp", F.col("k").alias("row"), F.col("at").alias("col"), F.lit(True).alias("other"), "id")
    return _in_cells(docs, materialise(left.unionByName(right), "shingle-grid"), every=True)


def sketched(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose sketches do not rule a link out: linked sets differ by few enough tokens."""
    x = sets.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    y = sets.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    apart = F.aggregate(F.zip_with("sa", "sb", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda t, k: t + k)
    return pairs.join(x, "a").join(y, "b").where((100 + PERCENT) * apart <= (100 - PERCENT) * (F.col("na") + F.col("nb"))).select("a", "b").distinct()


def filter_bits(keys: int) -> int:
    """Bits of a filter that lets about one stranger in sixteen through; MAX_FILTER bounds its size, more strangers cost time only."""
    return min(MAX_FILTER, max(1 << 16, 1 << (16 * max(keys, 1) - 1).bit_length()))


def _set_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, bits) of the filter: each block is a stretch of BLOCK_BITS of it."""
    blocks: dict[int, np.ndarray] = {}
    for batch in batches:
        at = batch.column("at").to_numpy()
        for block in np.unique(at // BLOCK_BITS):
            mine = at[at // BLOCK_BITS == block] % BLOCK_BITS
            np.bitwise_or.at(blocks.setdefault(int(block), np.zeros(BLOCK_BITS // 8, np.uint8)), mine >> 3, (1 << (mine & 7)).astype(np.uint8))
    yield pa.RecordBatch.from_arrays([pa.array(list(blocks), pa.int64()), pa.array([x.tobytes() for x in blocks.values()], pa.binary())], ["block", "bits"])


def filter_of(keys: DataFrame, key: str):
    """A broadcast filter that holds every key, and may hold others; and its size in bits, set by the number of keys."""
    size = filter_bits(keys.count())
    at = keys.select(F.pmod(F.xxhash64(key), F.lit(size)).alias("at"))
    rows = at.repartition(max(1, min(size // BLOCK_BITS, 64)), F.floor(F.col("at") / BLOCK_BITS)).mapInArrow(_set_bits, "block long, bits binary").collect()
    filled = np.zeros(size // 8, np.uint8)
    for block, bits in rows:
        k = block * BLOCK_BITS // 8
        filled[k : k + BLOCK_BITS // 8] = np.frombuffer(bits, np.uint8)
    return keys.sparkSession.sparkContext.broadcast(filled), size


def _passing(shared, size: int):
    """Rows whose hash h is in the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            at = batch.column("h").to_numpy(zero_copy_only=False) & (size - 1)
            batch = batch.filter(pa.array((bits[at >> 3] >> (at & 7)) & 1 == 1))
            if batch.num_rows:
                yield batch

    return run


def maybe_in(keys: DataFrame, key: str):
    """A column function: may this number be a key? False is certain; about one stranger in sixteen gets True. Only the number goes to Python, not the rest of the row."""
    shared, size = filter_of(keys, key)

    @F.arrow_udf("boolean")
    def known(h: pa.Array) -> pa.Array:
        bits, at = shared.value, h.to_numpy(zero_copy_only=False) & (size - 1)
        return pa.array((bits[at >> 3] >> (at & 7)) & 1 == 1)

    return lambda of: known(F.xxhash64(of))


def signs_of(signed: DataFrame, inside: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """id, n and one column of what was signed for the ids; other sets are left out before anything is shuffled."""
    wanted = materialise(inside.select("id", "set_id").join(ids.distinct(), "id"), "shingle-wanted")
    return signed_for(signed, wanted, column).join(wanted, "set_id").select("id", "n", column)


def signed_for(signed: DataFrame, wanted: DataFrame, column: str) -> DataFrame:
    """set_id, n and one column of what was signed, once for each set: the sets wanted and some strangers."""
    rows = signed.select("set_id", "n", column, F.xxhash64("set_id").alias("h"))
    return rows.mapInArrow(_passing(*filter_of(wanted, "set_id")), rows.schema).drop("h").dropDuplicates(["set_id"])


def full_texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """id, n (null), held: the texts listed. A filter of fixed size lets texts through before the shuffle, the join drops what it lets through in error."""
    ids = materialise(ids.distinct(), "shingle-ids")
    rows = docs.where(F.col("text").isNotNull()).select(F.col("row").alias("id"), F.lit(None).cast("int").alias("n"), F.col("text").cast("binary").alias("held"), F.xxhash64("row").alias("h"))
    again = rows.mapInArrow(_passing(*filter_of(ids, "id")), rows.schema).drop("h")
    return again.join(ids, "id", "left_semi").dropDuplicates(["id"])


def both_ids(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("id"))


def components(links: DataFrame) -> DataFrame:
    """id, comp: the smallest id that can be reached, for each id in links. Smallest labels spread and are looked up in themselves until nothing changes."""
    both = materialise(links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a")).distinct(), "links")
    label = materialise(both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("comp")).select(F.col("v").alias("id"), "comp"), "labels")
    while True:
        near = both.join(label, F.col("u") == F.col("id")).groupBy("v").agg(F.min("comp").alias("near"))
        step = label.join(near, F.col("id") == F.col("v")).select("id", F.col("comp").alias("old"), F.least("comp", "near").alias("next"))
        jump = label.select(F.col("id").alias("next"), F.col("comp").alias("far"))
        fresh = materialise(step.join(jump, "next", "left").select("id", "old", F.least("next", F.coalesce("far", "next")).alias("comp")), "labels")
        changed = not fresh.where(F.col("comp") != F.col("old")).isEmpty()
        forget(label)
        label = fresh.drop("old")
        label._written_at = fresh._written_at
        if not changed:
            forget(both)
            return label


def _close(a: str, b: str):
    return 100 * F.least(a, b) >= PERCENT * F.greatest(a, b)


def _near_front(na: str, pa: str, nb: str, pb: str):
    """Can this be the first token that two linked sets share? All before it are in one of them only."""
    return (100 + PERCENT) * (F.col(pa) + F.col(pb)) <= (100 - PERCENT) * (F.col(na) + F.col(nb))


def row_key() -> Column:
    """A number for doc_id and text together: the join works on texts, whatever their ids are."""
    return F.xxhash64(F.col("doc_id").cast("long"), "text")


def classes(documents: DataFrame, with_rows: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id: one row per input row.

    With with_rows also row, the row_key() of the text, and class_id, a name of
    the component that does not depend on ids.

    Null texts and texts without words have no shingles and link with nothing.
    Repeated rows and rows with equal doc_id each get a row, with equal results
    for equal texts; a null doc_id is never a component's name unless all of its
    rows have none. An empty table gives an empty result. Only doc_id and text
    are read.
    """
    spark = documents.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", row_key().alias("row"))
    survey = materialise(docs.mapInArrow(_survey, "doc_id long, row long, n int, set_id long, token long, texts long"), "shingle-survey")
    texts = materialise(survey.where(F.col("token").isNull()).select("doc_id", "row", "n", "set_id"), "shingle-texts")

    often = survey.where(F.col("token").isNotNull()).groupBy("token").agg(F.sum("texts").alias("texts"))
    mean_list = often.agg(F.coalesce(F.avg("texts"), F.lit(2.0))).first()[0]
    often = often.orderBy(F.desc("texts"), "token").limit(FREQUENT).toPandas()
    forget(survey)
    token = often["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(token)
    hot = np.sort(token[often["texts"].to_numpy() >= HOT])
    shared = spark.sparkContext.broadcast((token[order], -order, hot))  # the most frequent comes last

    own = texts.where(F.col("n") > 0)
    reps = materialise(own.groupBy("n", "set_id").agg(F.min("row").alias("id"), F.min("doc_id").alias("first")), "shingle-classes")
    small = dict(reps.where(F.col("n") <= MAX_LIGHT * 5 // 4).groupBy("n").count().collect())
    light = boundary(small, mean_list)
    signed = materialise(docs.mapInArrow(_signer(shared, light), "set_id long, n int, prefix binary, subsets binary, sketch array<long>"), "shingle-prefixes")
    posted = signed.select("set_id", "n", "prefix", "subsets").mapInArrow(_poster(shared, light, 4 * partitions), "bucket int, block binary, run long, set_id long, pos int")
    spread = F.coalesce(F.col("bucket"), F.pmod(F.xxhash64("run", "set_id"), F.lit(4 * partitions)).cast("int"))
    runs = posted.repartition(partitions, spread).mapInArrow(_runs, "run long, set_id long, pos int").groupBy("run", "set_id").agg(F.min("pos").alias("pos"))
    # How many lists a set is in is counted where the set's postings meet its class, in one shuffle.
    runs = runs.withColumn("lists", F.count("*").over(Window.partitionBy("set_id"))).join(reps.select("set_id", "id", "n"), "set_id")
    runs = materialise(runs, "shingle-runs")
    inside = materialise(runs.select("id", "set_id").distinct(), "shingle-inside")
    runs = runs.drop("set_id")

    links, tried, comp, open_runs = None, None, None, runs
    for turn in range(STAR_ROUNDS + 1):
        if turn < STAR_ROUNDS:
            # First the set that shares most, as the text from which copies were made does, then any.
            worth = F.col("lists") if turn == 0 else F.lit(0)
            one = open_runs.groupBy("run").agg(F.max(F.struct(worth.alias("worth"), F.xxhash64("id", F.lit(turn)).alias("h"), "id", "n", "pos")).alias("p"))
            met = open_runs.join(one, "run").where((F.col("id") != F.col("p.id")) & _close("n", "p.n") & _near_front("n", "pos", "p.n", "p.pos"))
            pairs = met.select(F.col("p.id").alias("a"), F.col("id").alias("b"))
        else:
            sizes = open_runs.select("id", "comp").distinct().groupBy("comp").count()
            big = materialise(sizes.where(F.col("count") > BIG).select("comp"), "shingle-big")
            if not big.isEmpty():
                links = links.unionByName(materialise(compared(docs, open_runs, big), "shingle-links"))
            rest = materialise(open_runs.join(big, "comp", "left_anti"), "shingle-rest")
            long = rest.groupBy("run").count().where(F.col("count") > BLOCK).select("run")
            if not long.isEmpty():
                links = links.unionByName(materialise(compared_lists(docs, rest.join(long, "run", "left_semi")), "shingle-links"))
                rest = rest.join(long, "run", "left_anti")
            x, y = rest.select("run", F.col("id").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"), F.col("comp").alias("ca")), rest.select("run", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"), F.col("comp").alias("cb"))
            pairs = x.join(y, "run").where((F.col("ca") < F.col("cb")) & _close("na", "nb") & _near_front("na", "pa", "nb", "pb")).select("a", "b")
        pairs = pairs.select("a", "b").distinct()
        if tried is not None:
            told = tried.union(tried.select("b", "a"))
            pairs = pairs.join(told, ["a", "b"], "left_anti")
        pairs = materialise(pairs, "shingle-pairs")
        sketches = materialise(signs_of(signed, inside, both_ids(pairs), "sketch"), "shingle-sketches")
        close = materialise(sketched(pairs, sketches), "shingle-close")
        wanted = materialise(inside.join(both_ids(close).distinct(), "id"), "shingle-wanted")
        prefixes = signed_for(signed, wanted, "prefix").withColumnRenamed("prefix", "held")
        likely = materialise(tested(close, prefixes, may_link, _as_prefix, wanted), "shingle-likely")
        if likely.isEmpty():
            found = likely
        else:
            found = materialise(tested(likely, full_texts(docs, both_ids(likely)), links_exactly, _as_text), "shingle-links")
        links = found if links is None else links.unionByName(found)
        tried = pairs if tried is None else tried.unionByName(pairs)
        comp = components(links)
        if turn == STAR_ROUNDS:
            break
        labelled = open_runs.drop("comp").join(comp, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
        mixed_runs = labelled.groupBy("run").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where(F.col("lo") != F.col("hi")).select("run")
        open_runs = materialise(labelled.join(mixed_runs, "run", "left_semi").select("run", "id", "n", "pos", "lists", "comp"), "shingle-open")
        if open_runs.isEmpty():
            break

    forget(signed)
    named = materialise(reps.join(comp, "id", "left").select("n", "set_id", "first", F.coalesce("comp", "id").alias("class_id")), "shingle-named")
    first = named.groupBy("class_id").agg(F.min("first").alias("component_id"))
    named = named.drop("first").join(first, "class_id")
    more = ["row", "class_id"] if with_rows else []
    some = own.join(named, ["n", "set_id"]).select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id", *more)
    none = texts.where(F.col("n") == 0).withColumn("class_id", F.lit(None).cast("long")).select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"), *more)
    return some.unionByName(none)


def keep_one(documents: DataFrame) -> DataFrame:
    """One row of each component: of the rows of its smallest doc_id, null last, the first by text.

    Decided by row, not by doc_id: of exact copies with equal or null ids one
    stays, and a row goes only for links of its own text. Null texts and texts
    without words link with nothing and all stay. Rows equal in doc_id and text
    are one. An empty table gives an empty result. Columns __row and
    __gone of the input are not allowed.
    """
    named = materialise(classes(documents, with_rows=True), "keep-one").where(F.col("n_shingles") > 0)
    key = F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("id"), "row")
    rows = named.groupBy("class_id", key.alias("x")).agg(F.count("*").alias("times"))
    best = rows.groupBy("class_id").agg(F.min("x").alias("best"))
    rows = rows.join(best, "class_id").select(F.col("x.row").alias("__row"), "times", (F.col("x") != F.col("best")).alias("__gone"))
    # Rows that go, and rows equal in doc_id and text, of which one stays.
    marked = materialise(rows.where(F.col("__gone") | (F.col("times") > 1)).select("__row", "__gone"), "keep-one-rows")
    maybe = maybe_in(marked, "__row")
    keyed = documents.withColumn("__row", row_key())
    # Whole texts are shuffled only if the filter can't tell that they stay.
    met = keyed.where(maybe("__row")).join(marked, "__row", "left").where(~F.coalesce("__gone", F.lit(False)))
    left = keyed.where(~maybe("__row")).unionByName(met.where(F.col("__gone").isNull()).drop("__gone"))
    if not marked.where(~F.col("__gone")).isEmpty():
        left = left.unionByName(met.where(F.col("__gone").isNotNull()).drop("__gone").dropDuplicates(["__row"]))
    return left.drop("__row")
