"""The pipeline's stages against plain Python on the smallest tables."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest

D = "/root/testdata/sf0.001"
WHITE = " \t\n\x0b\x0c\r"
WORD = re.compile(f"[^{WHITE}]+")


def rows(frame):
    return Counter((r["doc_id"], r["text"], r["source"]) for r in frame.select("doc_id", "text", "source").collect())


def plain_quality(docs):
    def facts(text):
        words = WORD.findall(text or "")
        grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        twice = {g for g, n in Counter(grams).items() if n > 1}
        hit = {p for i, g in enumerate(grams) if g in twice for p in (i, i + 1, i + 2)}
        return words, hit

    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: re.sub("[0-9]+", "0", " ".join(WORD.findall(line)).translate(lower))
    where, texts = defaultdict(dict), defaultdict(set)
    for i, text, host in docs:
        m = hashlib.md5((text or "").encode()).hexdigest()
        texts[host].add(m)
        for line in (text or "").split("\n"):
            if WORD.search(line):
                at = where[host, key(line)]
                at[m] = min(at.get(m, (1 << 63, "")), (i, m))
    over = {k: min(at.values())[1] for k, at in where.items() if len(at) > min(1000.0, max(20.0, 0.005 * len(texts[k[0]])))}
    out = Counter()
    for i, text, host in docs:
        words, hit = facts(text)
        if len(words) < 50 or 100 * len(hit) > 50 * len(words):
            continue
        m = hashlib.md5((text or "").encode()).hexdigest()
        gone = [line for line in text.split("\n") if WORD.search(line) and over.get((host, key(line)), m) != m]
        if sum(len(WORD.findall(x)) for x in gone) > 0.5 * len(words):
            continue
        out[i, "\n".join(line for line in text.split("\n") if not WORD.search(line) or over.get((host, key(line)), m) == m), host] += 1
    return out


def plain_near(docs):
    def shingles(text):
        w = text.encode().lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    keys = sorted(docs.elements(), key=lambda d: d[0])
    sets, parent = [shingles(d[1]) for d in keys], list(range(len(keys)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(keys)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return Counter(d for k, d in enumerate(keys) if root(k) == k)


def plain_clean(docs, items):
    words = lambda t: re.findall("[0-9a-z\x80-\U0010ffff]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    grams = {tuple(w[k : k + min(10, len(w))]) for w in map(words, items) if w for k in range(len(w) - min(10, len(w)) + 1)}
    sizes = {len(g) for g in grams}
    holds = lambda w: any(tuple(w[k : k + n]) in grams for n in sizes for k in range(len(w) - n + 1))
    return Counter({d: n for d, n in docs.items() if not holds(words(d[1]))})


def check_mix(docs, mixed):
    """Targets by an iterative fill; each document a whole number of times, once more or not; words near the target."""
    size = defaultdict(int)
    for (_, text, host), n in docs.items():
        size[host] += n * len(WORD.findall(text))
    order = sorted(size, key=lambda h: (h is None, h))
    weight = {h: k % 3 + 1 for k, h in enumerate(order)}
    target, left, open_ = {}, float(sum(size.values())), set(order)
    while True:
        share = {h: left * weight[h] / sum(weight[x] for x in open_) for h in open_}
        full = {h for h in open_ if share[h] > 3 * size[h]}
        if not full:
            break
        for h in full:
            target[h] = 3.0 * size[h]
            left -= target[h]
        open_ -= full
    target |= share
    taken = defaultdict(int)
    for d, n in mixed.items():
        assert d in docs and n <= 3
        taken[d[2]] += n * len(WORD.findall(d[1]))
    most = max(len(WORD.findall(d[1])) for d in docs)
    for h in order:
        assert abs(taken[h] - target[h]) <= most
    for d in docs:
        whole = int(target[d[2]] // size[d[2]])
        assert mixed[d] in (whole, whole + 1)


def test_pipeline_against_plain_python(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{D}/documents.parquet")
    now = docs
    plain = list(docs.select("doc_id", "text", "source").toLocalIterator())
    stage = dict(p.STAGES)
    now = stage["quality rules"](spark, now, D).persist()
    want = plain_quality([tuple(r) for r in plain])
    assert rows(now) == want and 0 < now.count() < len(plain)
    now = stage["n-gram jaccard join"](spark, now, D).persist()
    want = plain_near(want)
    assert rows(now) == want
    now = stage["benchmark decontamination"](spark, now, D).persist()
    want = plain_clean(want, [r["text"] for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()])
    assert rows(now) == want
    mixed = stage["mixing sources to target weights"](spark, now, D).persist()
    check_mix(want, rows(mixed))
    assert mixed.columns == docs.columns
    last = stage["sharding"](spark, mixed, D).toPandas()
    assert len(last) == mixed.count() and Counter(last["doc_id"]) == Counter(r["doc_id"] for r in mixed.select("doc_id").collect())
    for _, g in last.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))


@pytest.mark.parametrize("n", [3, 40])
def test_packing_follows_its_rule(n):
    """pack() against the rule written out: falling size, highest dot product among the shards where it fits."""
    import numpy as np

    from tidegrid.llm import sharding

    demand = np.random.default_rng(n).integers(1, 50, (n, 3)).astype(float)
    share = demand / demand.sum(axis=0) * 4
    left, place = [[1.0] * 3 for _ in range(4)], [0] * n
    for i in sorted(range(n), key=lambda i: (-max(share[i]), i)):
        fits = [k for k in range(4) if all(left[k][d] - share[i][d] >= 0 for d in range(3))]
        score = lambda k: sum(left[k][d] * share[i][d] for d in range(3))
        best = max(fits, key=lambda k: (score(k), -k)) if fits else max(range(4), key=lambda k: (min(left[k][d] - share[i][d] for d in range(3)), -k))
        place[i] = best
        left[best] = [left[best][d] - share[i][d] for d in range(3)]
    assert sharding.pack(demand, 4).tolist() == place
