"""Prefix trie, repeated passages and hard negatives against plain Python, with edge cases."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.llm import hard_negatives, prefix_trie, suffix_dedup

# Prefix trie

TURNS = "conv_id long, turn long, role string, text string, path string, block int, sizes string"


def plain_trie(seqs):
    """(conv_id, depth, parent, n_convs, n_children, n_leaves, saved, ends) of sequences {conv_id: [(role, text)]}."""
    nodes = {}
    for c, seq in seqs.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(tuple(seq[:d]), []).append(c)
    out = []
    for key, members in nodes.items():
        under = [k for k in nodes if k[: len(key)] == key]
        kids = [k for k in under if len(k) == len(key) + 1]
        leaves = [k for k in under if not any(len(o) == len(k) + 1 and o[: len(k)] == k for o in under)]
        saved = sum((len(nodes[k]) - 1) * len(k[-1][1].encode()) for k in under if k)
        ends = ",".join(map(str, sorted(c for c in members if len(seqs[c]) == len(key))))
        out.append((min(members), len(key), min(nodes[key[:-1]]) if key else None, len(members), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def ordered(rows):
    seqs = {}
    for c, t, role, text, *_ in rows:
        if c is not None:
            seqs.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    return {c: [x[2:] for x in sorted(v, key=lambda x: x[:2])] for c, v in seqs.items()}


def conversations():
    rng = random.Random(3)
    rows = []
    for c in range(60):
        for t in range(rng.randint(1, 7)):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "ünï", None, ""])))
    rows += [(c, t, "user", f"same {t}") for c in range(100, 160) for t in range(4)]  # a large group of equal ones
    rows += [(200, None, "user", "first"), (200, 5, "user", "x"), (200, 2, None, None), (None, 1, "user", "no id"), (-4, 0, "user", "a"), (7_000_000_000, 0, "user", "a" * 5000)]
    rows += [(300, t, "user", "deep") for t in range(120)] + [(c, 0, "user", "alone") for c in range(401, 405)]
    return [(*r, "p", 1, "s") for r in rows]


@pytest.mark.parametrize("turns, convs", [(1 << 15, 1 << 13), (9, 3)])
def test_trie_against_plain_python(spark, monkeypatch, turns, convs):
    monkeypatch.setattr(prefix_trie, "TURNS", turns)
    monkeypatch.setattr(prefix_trie, "CONVERSATIONS", convs)
    rows = conversations()
    frame = spark.createDataFrame(rows, TURNS)
    got = sorted((tuple(r) for r in prefix_trie.trie(prefix_trie.sequences(frame)).collect()), key=repr)
    assert got == plain_trie(ordered(rows))


def test_rebuilt_conversations(spark):
    rows = conversations()
    frame = spark.createDataFrame(rows, TURNS)
    own = ordered(rows)
    seqs = {}
    for c, seq in own.items():
        base, h = c - int(math.fmod(c, 5)), zlib.crc32(str(c).encode()) % 9
        seqs[c] = own.get(base, [])[:h] + seq[h:]
    assert any(not s for s in seqs.values())
    got = sorted((tuple(r) for r in prefix_trie.trie(prefix_trie.rebuilt(frame)).collect()), key=repr)
    assert got == plain_trie(seqs)


def test_trie_of_nothing(spark):
    none = spark.createDataFrame([], TURNS)
    assert prefix_trie.trie(prefix_trie.rebuilt(none)).count() == 0
    alone = spark.createDataFrame([(5, 0, None, None, "", 0, "")], TURNS)
    assert prefix_trie.trie(prefix_trie.sequences(alone)).count() == 2


def test_medians_give_each_place_once():
    for n in (0, 1, 2, 7, 100):
        assert sorted(prefix_trie.medians(n)) == list(range(n))
    tree = prefix_trie.Tree()
    ends = [tree.insert([k]) for k in prefix_trie.medians(1023)]
    depth = {}
    for v in tree.walk()[1:]:
        for w in (tree.low[v], tree.high[v]):
            if w >= 0:
                depth[w] = depth.get(v, 0) + 1
    assert len(set(ends)) == 1023 and max(depth.values()) <= 10


# Repeated passages

DOCS = "doc_id long, text string, shard long, data string, part int, at int, uid long"


def plain_repeats(rows, size=50):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for s in range(len(b) - size + 1):
            k = b[s : s + size]
            first[k] = min(first.get(k, math.inf), math.inf if i is None else i)
    out = []
    for i, t in rows:
        b, gone = (t or "").encode(), set()
        for s in range(len(b) - size + 1):
            if first[b[s : s + size]] < (math.inf if i is None else i):
                gone.update(range(s, s + size))
        spans = sum(1 for g in gone if g - 1 not in gone)
        out.append((i, len(b), len(gone), spans, bytes(x for k, x in enumerate(b) if k not in gone)))
    return sorted(out, key=repr)


def passages(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeüß ") for _ in range(rng.randint(3, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(15) for _ in range(4)] + ["x" * 130, "ab" * 60]
    rows = [(None, "n" + shared[0]), (None, "n" + shared[0]), (3, None), (4, ""), (5, "short"), (6, "y" * 49), (7, "y" * 49), (8, "y" * 50), (9, "y" * 300), (10, "y" * 120)]
    for i in range(11, 60):
        parts = [text(rng.randint(0, 12)) for _ in range(3)]
        rows.append((i, "".join(p + (rng.choice(shared) if rng.random() < 0.6 else "") for p in parts)))
    rows += [rows[30], rows[31], (-2, rows[40][1]), (90, rows[41][1] + "!"), (91, "!" + rows[41][1]), (30, rows[50][1])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("shard, piece", [(1 << 21, 1 << 20), (400, 170)])
def test_repeats_against_plain_python(spark, monkeypatch, shard, piece):
    monkeypatch.setattr(suffix_dedup, "SHARD", shard)
    monkeypatch.setattr(suffix_dedup, "PIECE", piece)
    rows = passages(shard)
    frame = spark.createDataFrame([(i, t, 1, "d", 2, 3, 4) for i, t in rows], DOCS).repartition(3)
    out = suffix_dedup.remove_repeats(frame, 50)
    got = sorted(((r["doc_id"], r["n_bytes"], sum(x["end"] - x["start"] for x in r["spans"]), len(r["spans"]), bytes(r["kept"])) for r in out.collect()), key=repr)
    assert got == plain_repeats(rows)


def test_repeats_in_a_very_long_text(spark):
    rng = np.random.default_rng(5)
    long = "".join(map(chr, rng.integers(97, 123, 3_000_000)))
    rows = [(1, long), (2, "head " + long[1_048_500:1_048_700] + " tail"), (3, long[:2_500_000] + "?" + long[2_500_000:])]
    out = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not out[1]["spans"] and bytes(out[2]["kept"]) == b"head  tail" and bytes(out[3]["kept"]) == b"?" and out[3]["n_bytes"] == 3_000_001


def test_repeats_of_nothing(spark):
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], DOCS)).count() == 0
    assert bytes(suffix_dedup.remove_repeats(spark.createDataFrame([(None, None)], "doc_id long, text string")).first()["kept"]) == b""


def test_suffix_order_and_common_prefixes():
    rng = np.random.default_rng(7)
    data = rng.integers(97, 99, 3000).astype(np.uint8)
    data[1000:1300] = data[2000:2300]
    data[500:700] = 97
    eight = suffix_dedup.words(data)
    order = suffix_dedup.suffix_order(eight, len(data), 50)
    raw = data.tobytes() + bytes(60)
    keys = [raw[i : i + 50] for i in order]
    assert keys == sorted(keys) and sorted(order) == list(range(3000))
    common = suffix_dedup.common_prefixes(eight, order, 50)
    for a, b in zip(order[:-1], order[1:]):
        want = next((k for k in range(50) if raw[a + k] != raw[b + k]), 50)
        assert common[b] == want


def test_classes_with_one_key_are_told_apart():
    u = lambda *x: np.array(x, np.uint64)
    runs = [(u(5, 9), u(1, 1), np.array([7, 3])), (u(5, 5), u(1, 2), np.array([4, 9])), (u(9), u(1), np.array([8]))]
    assert [list(x) for x in suffix_dedup.merged(runs)] == [[4, 3], [4, 9], [3]]


# Hard negatives

VECTORS = "vec_id long, embedding array<float>, label int, block long, n int, anchor long"


def plain_negatives(rows, every=50, positives=5, negatives=3):
    use = []
    for r, (i, v, label) in enumerate(rows):
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        use.append((r, i, [math.floor(256 * float(np.float32(x))) for x in v], (label + 1) % 10 if i is not None and i % 7 == 0 else label))
    out = []
    last = lambda i: (i is None, i or 0)
    for r, i, v, label in use:
        if i is None or i % every:
            continue
        scored = [(sum(a * b for a, b in zip(v, w)), j, s, other) for s, j, w, other in use if s != r]
        scored.sort(key=lambda x: (-x[0], last(x[1]), x[2]))
        for p, j, _, _ in [x for x in scored if x[3] == label][:positives]:
            near = [x for x in scored if x[3] != label and 50 * p <= 100 * x[0] <= 95 * p][:negatives]
            out += [(i, j, k + 1, x[1], p, x[0]) for k, x in enumerate(near)]
    return sorted(out, key=repr)


def vectors(scale):
    rng = np.random.default_rng(11)
    rows = [(i, [float(x) for x in np.round(rng.standard_normal(6) * scale, 2).astype(np.float32)], int(rng.integers(0, 4))) for i in range(400)]
    rows += [(500, [0.0] * 6, 1), (501, [0.0] * 6, 1), (502, [0.0] * 6, 2), (503, [], 1), (550, [1.0, 2.0], 2), (None, [1.0] * 6, 3), (None, [1.0] * 6, 2), (600, None, 1), (650, [1.0, None], 1), (700, [float("nan")] * 6, 1), (750, [float("inf")] * 6, 2), (800, [1.0] * 6, None)]
    rows += [rows[50], rows[100], rows[100]] + [(i, [1.0, 1.0, 0.5, 0.0, 0.0, 0.0], i % 3) for i in range(900, 960)]  # repeated rows, ties
    return rows


@pytest.mark.parametrize("scale, block", [(1.0, 1024), (1.0, 37), (3e5, 64)])
def test_negatives_against_plain_python(spark, monkeypatch, scale, block):
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    rows = vectors(scale)
    frame = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], VECTORS).repartition(3)
    got = sorted((tuple(r) for r in hard_negatives.mine(frame).collect()), key=repr)
    assert got == plain_negatives(rows)


def test_scores_beyond_the_range_of_long_stay_at_its_end(spark):
    rows = [(i, [1e9 * (i % 3 + 1), 1e9], i % 2) for i in range(1, 130)]
    got = hard_negatives.mine(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert all(r["positive_score"] <= 2**63 - 1 for r in got)


def test_negatives_of_nothing(spark):
    assert hard_negatives.mine(spark.createDataFrame([], VECTORS)).count() == 0
    assert hard_negatives.mine(spark.createDataFrame([(50, [1.0], 1)], "vec_id long, embedding array<float>, label int")).count() == 0


def test_key_orders_as_the_method_says():
    key = lambda score, negative, number: (hard_negatives.TOP - score, negative, number is None, (number or 0) + (1 << 63))
    packed = lambda *x: np.array([(1, *key(*x), 0)], hard_negatives.KEY).tobytes()
    order = [(9, 1, 4), (0, 0, 5), (0, 1, -3), (0, 1, 2), (0, 1, None), (-7, 0, 1)]
    assert [packed(*x) for x in order] == sorted(packed(*x) for x in order)


def test_levels(spark):
    out = spark.createDataFrame([([0.1, -0.1, 1e30],)], "v array<float>").select(hard_negatives.levels(F.col("v")).alias("v")).first()["v"]
    assert out == [25, -26, 2**63 - 1]


def test_extra_columns_through_the_stages(spark):
    """Input columns that have names of columns which the stages make."""
    from tidegrid.llm import decontamination, jaccard, mixing, quality

    names = ["s", "cut", "whole", "source_size", "target", "draw", "bin", "size", "row", "hash", "spans", "text_md5", "host", "kept", "class_id", "n"]
    words = " ".join(f"w{i} x{i}" for i in range(40))
    rows = [(i, f"{words} own{i} {'z ' * i}", "en", f"s{i % 3}" if i % 5 else None, i, *range(len(names))) for i in range(30)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} int" for n in names))
    bench = spark.createDataFrame([(1, "nothing of the kind stands here at all today or ever")], "item_id long, text string")
    for made in (quality.cleaned(frame), jaccard.keep_one(frame), decontamination.remove_documents(frame, bench), decontamination.remove_spans(frame, bench), mixing.apply(frame)):
        assert made.columns == frame.columns and made.count() > 0
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(frame).collect()}
    got = mixing.apply(frame).groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in got} == {k: v for k, v in copies.items() if v}


@pytest.mark.parametrize("texts, lines", [(200_000, 1_000_000), (0, 0)])
def test_cleaning_is_the_same_by_broadcast_and_shuffle(spark, monkeypatch, texts, lines):
    from tidegrid.llm import quality

    monkeypatch.setattr(quality, "BROADCAST_TEXTS", texts)
    monkeypatch.setattr(quality, "BROADCAST_LINES", lines)
    own = [" ".join(chr(97 + i // 26) + chr(97 + i % 26) + "q" + chr(97 + j // 26) + chr(97 + j % 26) for j in range(60)) for i in range(30)]
    rows = [(i, f"{own[i]}\nshare this page", "a", i, 0) for i in range(30)] + [(50, "too short", "a", 1, 0), (None, None, None, 2, 0), (51, own[3], "b", 3, 0)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, line int")
    got = sorted((r["doc_id"], r["text"]) for r in quality.cleaned(frame).collect())
    assert got == sorted([(i, own[i] + ("\nshare this page" if not i else "")) for i in range(30)] + [(51, own[3])])
