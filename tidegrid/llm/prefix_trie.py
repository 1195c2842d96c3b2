"""A trie over the turns of conversations: which conversations share their first turns, and what that saves.

Conversations are dealt into range shards by the digests of their turns, so that those with a
common beginning lie side by side, and a shard is cut into blocks of bounded size. In a block turns get
dictionary codes, and a ternary search tree takes the distinct sequences, medians first. An iterative
traversal adds up members, leaves and savings. Only nodes on the first or the last path of a
block can go on in a neighbour; for these a block gives its share, chosen so that shares add up, and an
aggregation merges them. No task holds more than a block, however many conversations begin alike.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, materialise

#: Bytes of a turn's digest; turns and conversations after which a block ends.
DIGEST, TURNS, CONVERSATIONS = 16, 1 << 15, 1 << 13
BLOCKS = pa.schema([("block", pa.int64()), ("ids", pa.binary()), ("lengths", pa.binary()), ("turns", pa.binary()), ("sizes", pa.binary()), ("first", pa.binary()), ("last", pa.binary()), ("before", pa.int32()), ("after", pa.int32())])
NODES = pa.schema([("block", pa.int64()), ("slot", pa.int32()), ("above", pa.int32()), ("key", pa.binary()), ("parent_key", pa.binary()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends", pa.string())])
RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
NOTHING = hashlib.sha256(b"").hexdigest()


def ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary", pa.string(): "string"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def _turn() -> Column:
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * DIGEST)
    return F.struct("turn", digest.alias("digest"), F.octet_length(text).alias("size"))


def sequences(conversations: DataFrame) -> DataFrame:
    """conv_id, path (a digest a turn, end to end), sizes (bytes of each text): one row a conversation.

    Turns are in order of turn, null first, ties by the digest of role and text.
    """
    turns = conversations.where("conv_id is not null").select("conv_id", _turn().alias("t"))
    own = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("own"))
    return own.select("conv_id", *_packed(F.col("own")))


def _packed(seq: Column) -> tuple[Column, Column]:
    return F.unhex(F.array_join(F.transform(seq, lambda t: t["digest"]), "")).alias("path"), F.transform(seq, lambda t: t["size"]).alias("sizes")


def common(a: bytes, b: bytes) -> int:
    """Turns at the start of both paths."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // DIGEST
    differ = np.frombuffer(a[:n], np.uint8) != np.frombuffer(b[:n], np.uint8)
    return int(differ.argmax()) // DIGEST


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of a shard's sorted conversations."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32
    ids, paths, sizes, turns, before = [], [], [], 0, None

    def out(after):
        lengths = np.array([len(p) // DIGEST for p in paths], "<i4")
        row = [number, np.array(ids, "<i8").tobytes(), lengths.tobytes(), b"".join(paths), b"".join(sizes), paths[0], paths[-1], before, after]
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, BLOCKS)], schema=BLOCKS)

    for batch in batches:
        for conv, path, size in zip(*(batch.column(n) for n in ("conv_id", "path", "sizes"))):
            path = path.as_py()
            if ids and (turns >= TURNS or len(ids) >= CONVERSATIONS):
                shared = common(paths[-1], path)
                yield out(shared)
                number, before, ids, paths, sizes, turns = number + 1, shared, [], [], [], 0
            ids.append(conv.as_py())
            paths.append(path)
            sizes.append(size.values.to_numpy(zero_copy_only=False).astype("<i8").tobytes())
            turns += len(path) // DIGEST
    if ids:
        yield out(None)


def _neighbours(frames):
    for f in frames:
        of = lambda own, other: [None if x is None or y is None else common(x, y) for x, y in zip(f[own], f[other])]  # noqa: B023, E731
        made = f[["block"]].assign(edge_before=of("first", "left"), edge_after=of("last", "right"))
        yield made.astype({"edge_before": "Int32", "edge_after": "Int32"})


class Tree:
    """A ternary search tree: each node matches one code after its parent's; `low` and `high` lead to other codes at the same place."""

    def __init__(self) -> None:
        self.code, self.low, self.high, self.down, self.up, self.depth = [-1], [-1], [-1], [-1], [-1], [0]

    def _new(self, code: int, parent: int) -> int:
        for column, value in ((self.code, code), (self.low, -1), (self.high, -1), (self.down, -1), (self.up, parent), (self.depth, self.depth[parent] + 1)):
            column.append(value)
        return len(self.code) - 1

    def insert(self, codes: list[int]) -> int:
        """The node of the last code."""
        at = 0
        for code in codes:
            here = self.down[at]
            if here < 0:
                here = self.down[at] = self._new(code, at)
            while self.code[here] != code:
                way = self.low if code < self.code[here] else self.high
                if way[here] < 0:
                    way[here] = self._new(code, at)
                here = way[here]
            at = here
        return at

    def walk(self) -> list[int]:
        """All nodes, each after the one it continues."""
        order, stack = [], [0]
        while stack:
            here = stack.pop()
            order.append(here)
            stack += [x for x in (self.low[here], self.high[here], self.down[here]) if x >= 0]
        return order

    def path(self, node: int) -> list[int]:
        """The nodes from the root to this one."""
        out = [node]
        while self.up[out[-1]] >= 0:
            out.append(self.up[out[-1]])
        return out[::-1]


def medians(n: int) -> Iterator[int]:
    """0 ... n - 1: the middle, then the middles of the halves and so on."""
    stack = [(0, n)]
    while stack:
        a, b = stack.pop()
        if a < b:
            mid = (a + b) // 2
            yield mid
            stack += [(mid + 1, b), (a, mid)]


def nodes(ids: np.ndarray, lengths: np.ndarray, turns: bytes, sizes: np.ndarray, before: int, after: int) -> list[dict]:
    """The trie nodes of a block of sorted conversations.

    before, after: turns that its first (last) path shares with the neighbour, -1 without one. Nodes that
    lie in a neighbour too have a slot and a key, and their figures are shares: a member, a child, a leaf
    or a node's own text counts in one block only.
    """
    digests = np.frombuffer(turns, f"S{DIGEST}")
    codes = np.unique(digests, return_inverse=True)[1].tolist() if len(digests) else []
    ends = np.cumsum(lengths)
    bounds = list(zip((ends - lengths).tolist(), ends.tolist()))
    raw = [turns[DIGEST * a : DIGEST * b] for a, b in bounds]
    starts = [i for i in range(len(raw)) if not i or raw[i] != raw[i - 1]] + [len(raw)]
    tree, last = Tree(), {}
    for k in medians(len(starts) - 1):
        a, b = bounds[starts[k]]
        last[k] = tree.insert(codes[a:b])
    size = [0] * len(tree.code)
    finish: dict[int, int] = {}
    for k, node in last.items():
        finish[node] = k
        b = bounds[starts[k]][1]
        while node and not size[node]:
            b -= 1
            size[node] = int(sizes[b]) + 1  # 0: not seen yet
            node = tree.up[node]
    first_path, last_path = tree.path(last[0]), tree.path(last[len(starts) - 2])
    shared, key = {}, {}
    old = set(first_path[: before + 1])
    for path, most, a in ((first_path, before, bounds[0][0]), (last_path, after, bounds[-1][0])):
        digest = hashlib.sha256().digest()[:DIGEST]
        for d, node in enumerate(path[: most + 1]):
            if d:
                digest = hashlib.sha256(digest + turns[DIGEST * (a + d - 1) : DIGEST * (a + d)]).digest()[:DIGEST]
            shared.setdefault(node, len(shared))
            key[node] = digest
    n = len(tree.code)
    members, smallest, children, leaves, saved, childless = [0] * n, [1 << 63] * n, [0] * n, [0] * n, [0] * n, [True] * n
    order = tree.walk()
    for v in reversed(order):
        if v in finish:
            k = finish[v]
            members[v] += starts[k + 1] - starts[k]
            smallest[v] = min(smallest[v], int(ids[starts[k]]))
        owned = v not in old
        if childless[v] and not (v == last_path[-1] and after >= tree.depth[v]):
            leaves[v] += 1
        if v:
            saved[v] += (members[v] - owned) * (size[v] - 1)
            u = tree.up[v]
            members[u] += members[v]
            smallest[u] = min(smallest[u], smallest[v])
            children[u] += owned
            leaves[u] += leaves[v]
            saved[u] += saved[v]
            childless[u] = False
    out = []
    for v in order:
        u, k = tree.up[v], finish.get(v)
        text = "" if k is None else ",".join(map(str, ids[starts[k] : starts[k + 1]].tolist()))
        row = {"conv_id": smallest[v], "depth": tree.depth[v], "n_convs": members[v], "n_children": children[v], "n_leaves": leaves[v], "saved_tokens": saved[v]}
        if v in shared:
            row |= {"slot": shared[v], "key": key[v], "parent_key": key[u] if v else None, "ends": text if k is not None else None}
        else:
            row |= {"above": shared.get(u) if v else None, "parent_conv_id": None if not v or u in shared else smallest[u], "ends": hashlib.sha256(text.encode()).hexdigest()}
        out.append(row)
    return out


def _grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for x in (row for batch in batches for row in batch.to_pylist()):
        found = nodes(np.frombuffer(x["ids"], "<i8"), np.frombuffer(x["lengths"], "<i4"), x["turns"], np.frombuffer(x["sizes"], "<i8"), *(-1 if x[c] is None else x[c] for c in ("before", "after")))
        for start in range(0, len(found), 8192):
            yield pa.RecordBatch.from_pylist([{"block": x["block"]} | row for row in found[start : start + 8192]], NODES)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each key's ids, which come in pieces and in order."""
    schema, last, state = pa.schema([("key", pa.binary()), ("ends_sha256", pa.string())]), None, None
    out = lambda: pa.RecordBatch.from_pylist([{"key": last, "ends_sha256": state.hexdigest()}], schema)
    for batch in batches:
        for key, text in zip(batch.column("key"), batch.column("ends")):
            key, text = key.as_py(), text.as_py().encode()
            if key != last:
                if last is not None:
                    yield out()
                last, state = key, hashlib.sha256(text)
            else:
                state.update(b"," + text)
    if last is not None:
        yield out()


def trie(seqs: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: one row for each distinct start of the sequences.

    seqs: conv_id (not null, each once), path and sizes as sequences() gives them; an empty path is a
    member of the root alone. A node's conv_id is its smallest member. An empty table gives an empty
    result. A conversation is one value and so must fit into a task; their number and the size of a group
    of equal ones have no bound. The ids of equal conversations go through one digest, in pieces.
    """
    spark = seqs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Ids are part of the order, so that a large group of equal conversations goes to several shards.
    ordered = seqs.select("conv_id", "path", "sizes").repartitionByRange(parts, "path", "conv_id").sortWithinPartitions("path", "conv_id")
    blocks = materialise(ordered.mapInArrow(_cut, ddl(BLOCKS)), "trie-blocks")
    # The first and the last block of a shard look for their neighbours: two rows a shard.
    edges = blocks.where("before is null or after is null").select("block", "first", "last")
    order = Window.orderBy("block")
    edges = edges.select("block", "first", "last", F.lag("last").over(order).alias("left"), F.lead("first").over(order).alias("right"))
    edges = edges.mapInPandas(_neighbours, "block long, edge_before int, edge_after int")
    known = blocks.join(F.broadcast(edges), "block", "left").withColumns({c: F.coalesce(c, f"edge_{c}") for c in ("before", "after")})
    found = materialise(known.select(*BLOCKS.names).mapInArrow(_grown, ddl(NODES)), "trie-nodes")
    forget(blocks)
    shares = found.where("key is not null")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    merged = shares.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("parent_key").alias("parent_key"), *sums)
    digests = shares.where("ends is not null").select("key", "block", "ends").repartition("key").sortWithinPartitions("key", "block").mapInArrow(_hashed, "key binary, ends_sha256 string")
    merged = materialise(merged.join(digests, "key", "left").fillna(NOTHING, ["ends_sha256"]), "trie-shared")
    parents = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    names = shares.select("block", F.col("slot").alias("above"), "key").join(merged.select("key", F.col("conv_id").alias("from_shared")), "key").drop("key")
    inner = found.where("key is null").withColumnRenamed("ends", "ends_sha256")
    under = inner.where("above is not null").join(names, ["block", "above"]).withColumn("parent_conv_id", F.col("from_shared"))
    rest = inner.where("above is null")
    return merged.join(parents, "parent_key", "left").select(RESULT).unionByName(under.select(RESULT)).unionByName(rest.select(RESULT))


def rebuilt(conversations: DataFrame, fold: int = 5, heads: int = 9) -> DataFrame:
    """As sequences(), but each conversation c begins with the first h turns of conversation c - c % fold, h = crc32(c) % heads, and goes on with its own after its first h.

    Rows with a null conv_id take no part.
    """
    base = F.col("conv_id") - F.col("conv_id") % fold
    turns = conversations.where("conv_id is not null").select(base.alias("base"), "conv_id", _turn().alias("t"))
    # One exchange: what is dealt by base is dealt by base and conv_id too.
    own = turns.repartition("base").groupBy("base", "conv_id").agg(F.sort_array(F.collect_list("t")).alias("own"))
    head = F.first(F.when(F.col("conv_id") == F.col("base"), F.slice("own", 1, heads)), ignorenulls=True).over(Window.partitionBy("base"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(heads)).cast("int")
    own = own.select("conv_id", "own", head.alias("head"), h.alias("h"))
    start = F.slice(F.coalesce("head", F.slice("own", 1, 0)), F.lit(1), F.col("h"))
    seq = F.concat(start, F.slice("own", F.col("h") + 1, F.greatest(F.size("own"), F.lit(1))))
    return own.select("conv_id", seq.alias("seq")).select("conv_id", *_packed(F.col("seq")))
