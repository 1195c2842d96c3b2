"""Brute-force comparisons and edge cases of the training-data operators."""

import hashlib
import io
import math
import zipfile
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.llm import chat, decontamination, jaccard, line_spread, mixing, pitman_yor, quality, sharding, toxicity, warc

D = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, line int, id int, group string"
WORDS = " ".join(f"w{i}" for i in range(60))


def rows():
    texts = [None, "", "   \n ", WORDS, WORDS, WORDS + " more", "one two", "one two", "x " * 3000, "Ünï côdé\n\nline", WORDS.upper()]
    out = [(i, t, "en", f"s{i % 3}" if i % 4 else None, None, "a", 1, 2, "g") for i, t in enumerate(texts)]
    return [*out, out[3], (None, "text without an id", None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{D}/documents.parquet")


def test_edges_give_a_row_per_row(spark, docs, none):
    bench = spark.createDataFrame([(1, " ".join(f"W{i}" for i in range(5, 20))), (2, None), (3, "one two"), (None, "")], "item_id long, text string")
    labels = spark.createDataFrame([(3, 1), (6, 0), (None, 1), (8, None)], "doc_id long, toxic int")
    for frame, n in ((docs, len(rows())), (none, 0)):
        assert quality.judge(quality.facts(frame)).count() == n
        assert mixing.mix(frame).count() == n
        assert sharding.shard(frame, 4).count() == n
        assert decontamination.scan(frame, bench).count() == n
        assert line_spread.remove(frame, 2).count() == n
        assert toxicity.scores(frame, labels).count() == n
        assert pitman_yor.score(frame).count() == n
        assert jaccard.classes(frame).count() == n
        assert quality.cleaned(frame).columns == frame.columns
    hit = {r["doc_id"]: r["spans"] for r in decontamination.scan(docs, bench).collect()}
    assert hit[3] and hit[10] and hit[6] and not hit[0] and not hit[8]
    comp = {r["doc_id"]: r["component_id"] for r in jaccard.classes(docs).collect()}
    assert comp[3] == comp[4] == comp[5] == comp[10] == 3 and comp[7] == 6 and comp[0] == 0 and comp[1] == 1
    assert decontamination.remove_documents(docs, bench).where("doc_id in (3, 6)").count() == 0


def test_lines_above_the_limit_leave_the_texts(spark):
    own = [" ".join("é" + chr(97 + i // 26) + chr(97 + i % 26) + chr(97 + j // 26) + chr(97 + j % 26) for j in range(60)) for i in range(30)]
    rows = [(i, f"{own[i]}\n\n Subscribe NOW  {i} times \nend {own[i][:5]}", "a", 0) for i in range(25)]
    rows += [(100 + i, f"{own[25 + i]}\nsubscribe now 3 times", "b", 0) for i in range(5)] + [rows[7], (200, rows[9][1], "a", 0)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int")
    got = [tuple(r) for r in quality.cleaned(frame).collect()]
    left = lambda t: "\n".join(x for x in t.split("\n") if not x.startswith(" Subscribe"))
    want = [(i, t if s == "b" or i == 0 else left(t), s, 0 if s == "b" or i == 0 else len(left(t))) for i, t, s, _ in rows]
    assert sorted(got) == sorted(want) and all("\n\n" in t for i, t, s, _ in got if s == "a")


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_jaccard_against_brute_force(spark, real):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.classes(real).collect()}
    sets = {r["doc_id"]: shingles(r["text"]) for r in real.collect()}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    assert got == {i: (len(sets[i]), root(i)) for i in ids}


def test_boundary_follows_the_length_of_lists(spark):
    """Where lists are long, small sets enumerate subsets instead; the result is the same on both sides."""
    assert jaccard.boundary({n: 100 for n in range(1, 16)}, 1.0) < jaccard.boundary({n: 100 for n in range(1, 16)}, 60.0)
    assert jaccard.boundary({n: 100 for n in range(1, 16)}, 60.0) > 5
    rng = np.random.default_rng(4)
    base = [f"v{i}" for i in range(40)]
    texts = [" ".join(base[a : a + n]) for a in range(0, 20, 5) for n in range(5, 15)] + [" ".join(rng.choice(base, 9)) for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    results = []
    for most in (0, 12):
        old, jaccard.boundary = jaccard.boundary, lambda small, mean, most=most: most
        try:
            results.append({r["doc_id"]: tuple(r) for r in jaccard.classes(docs).collect()})
        finally:
            jaccard.boundary = old
    assert results[0] == results[1] and len({r[2] for r in results[0].values()}) < len(texts)


def test_long_lists_are_compared_in_blocks(spark):
    texts = ["one two three four five six seven eight nine ten " + x for x in ("a", "b", "a c", "z y x w v u t s r q p", "b d")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("row", F.col("doc_id"))
    lists = spark.createDataFrame([(1, i) for i in range(len(texts))], "run long, id long")
    old, jaccard.BLOCK = jaccard.BLOCK, 2
    try:
        got = {tuple(sorted(r)) for r in jaccard.compared_lists(docs, lists).collect()}
    finally:
        jaccard.BLOCK = old
    sets = [shingles(t) for t in texts]
    assert got == {(a, b) for b in range(len(texts)) for a in range(b) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}


def test_keep_one_decides_by_row(spark):
    near = WORDS + " w60 w61"
    rows = [(1, WORDS), (1, "other text of the same id " + "q " * 9), (2, near), (2, near), (None, near), (None, "lone text"), (3, None), (3, None), (4, ""), (5, "lone text")]
    got = sorted((tuple(r) for r in jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(1, WORDS), rows[1], (5, "lone text"), (3, None), (3, None), (4, "")], key=str)


def last_shuffles(plan) -> list[int]:
    """Rows of each shuffle that the last stage of an adaptive plan reads."""
    kind = plan.getClass().getSimpleName()
    if kind == "ShuffleQueryStageExec":
        return [plan.shuffle().metrics().apply("shuffleRecordsWritten").value()]
    below = [plan.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [plan.plan()] if kind == "ResultQueryStageExec" else [*map(plan.children().apply, range(plan.children().size()))]
    return [n for x in below for n in last_shuffles(x)]


def test_keep_one_shuffles_few_of_the_texts_that_stay(spark):
    """However small the broadcast limit is, most texts that stay are not shuffled."""
    near = [WORDS + f" w60 e{i}" for i in range(40)]
    rows = [*enumerate([*(f"t{i} " * 3 + f"u{i} v{i} x{i}" for i in range(2000)), *near]), (2000, near[0]), (7, "t7 t7 t7 u7 v7 x7"), (None, None)]
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
        got = kept.collect()
        moved = last_shuffles(kept._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert sorted((tuple(r) for r in got), key=str) == sorted([*rows[:2001], (None, None)], key=str)
    assert moved and sum(moved) < 1000


def test_light_and_heavy_sets_link(spark):
    base = [f"v{i}" for i in range(18)]
    texts = [" ".join(base[:n]) for n in (3, 4, 5, 8, 9, 12, 13, 14, 17, 18)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    comp = {r["doc_id"]: r["component_id"] for r in jaccard.classes(d).collect()}
    sets = [shingles(t) for t in texts]
    link = lambda a, b: 100 * len(a & b) >= 80 * len(a | b)
    for a in range(len(texts)):
        for b in range(a):
            if link(sets[a], sets[b]):
                assert comp[a] == comp[b]
    assert comp[0] == 0 and comp[1] == 1


def test_big_components_compare_in_blocks(spark):
    """Cells of a few sets find each link between a big component and the rest of its lists; null, empty and doubled rows do no harm."""
    rng = np.random.default_rng(7)
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(base[: 60 - int(k)]) for k in rng.integers(0, 12, 9)] + ["other words that nobody shares", "", None]
    docs = spark.createDataFrame([*enumerate(texts), (0, texts[0])], "doc_id long, text string").withColumn("row", F.col("doc_id"))
    lists = spark.createDataFrame([(1, i, 0 if i < 5 else i) for i in range(len(texts))], "run long, id long, comp long")
    big = spark.createDataFrame([(0,)], "comp long")
    old, jaccard.BLOCK = jaccard.BLOCK, 2
    try:
        got = {r["b"] for r in jaccard.compared(docs, lists, big).collect()}
    finally:
        jaccard.BLOCK = old
    sets = [shingles(t) for t in texts]
    assert got == {b for b in range(5, len(texts)) if any(sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) for a in range(5))}


def test_sketch_and_prefix_never_rule_out_a_link():
    rng = np.random.default_rng(5)
    for n in (3, 10, 60, 700):
        a = np.unique(rng.integers(0, 2**64, n, np.uint64))
        keep = a[: max(1, int(n * 0.9))]
        b = np.unique(np.append(keep, rng.integers(0, 2**64, max(0, n // 20), np.uint64)))
        if jaccard.links_exactly(a, b, len(a), len(b)):
            pa_, pb_ = (x[: jaccard.prefix_length(len(x))] for x in (a, b))
            assert jaccard.may_link(pa_, pb_, len(a), len(b))
            apart = sum(((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(jaccard.sketch(a), jaccard.sketch(b)))
            assert 180 * apart <= 20 * (len(a) + len(b))


def test_sharding(spark, real):
    out = sharding.shard(real, 8).toPandas()
    for _, g in out.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    hot = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same text here").otherwise(F.concat(F.lit("t"), F.col("id"))).alias("text"))
    size = sharding.shard(hot, 8).groupBy("shard").agg(F.sum("size").alias("s")).toPandas()["s"]
    assert len(size) == 8 and size.max() < 1.1 * size.min()


def test_sharding_keeps_copies_together(spark):
    texts = [f"copied text {i // 20}" if i < 200 else "hot text" if i < 800 else f"single text {i}" for i in range(2000)]
    out = sharding.shard(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 8).toPandas()
    places = out.assign(text=[texts[i] for i in out["doc_id"]]).groupby("text")["shard"].nunique()
    assert (places.drop("hot text") == 1).all() and places["hot text"] > 1
    size = out.groupby("shard")["size"].sum()
    assert len(size) == 8 and size.max() < 1.1 * size.min()


def test_mix_comes_near_targets_and_reruns_agree(spark, real):
    a = mixing.mix(real).toPandas().sort_values("doc_id", ignore_index=True)
    assert a.equals(mixing.mix(real).toPandas().sort_values("doc_id", ignore_index=True))
    assert (a["taken"] <= 3 * a["size"]).all()
    for _, g in a.groupby("source"):
        assert abs(g["taken"].sum() - g["target"].iloc[0]) <= g["size"].max()


def test_language_model_counts_and_quality(spark, real):
    got = {r["doc_id"]: r for r in pitman_yor.score(real).collect()}
    texts = {r["doc_id"]: [*(r["text"] or "").encode().lower().split(), b""] for r in real.collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    c = Counter(w for i, t in texts.items() if not held[i] for w in t)
    n, v = sum(c.values()), len(c)
    for i, t in texts.items():
        assert (got[i]["held_out"], got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (held[i], len(t), sum(c[w] > 0 for w in t), n)
        assert got[i]["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t))
    total = lambda k: sum(got[i][k] for i in texts if held[i])
    assert total("score") > total("base_score")


def test_language_model_cuts_texts_into_words_once():
    """A chunk keeps word numbers; its words and pairs are counted from these without the texts."""
    texts, held = [b"a b a b", b"", b"b b zebra", b"a b", b"zebra"], [False, False, True, False, False]
    words, codes, lengths = pitman_yor.tokens_of(texts)
    row = {"words": pitman_yor.packed(words), "codes": pitman_yor.packed_codes(codes), "lengths": lengths.tolist(), "held": held}
    cut = pitman_yor.Cut(row, words[:0], 4)
    name = {pitman_yor.xxhash.xxh3_64_intdigest(w): w for w in (b"", b"a", b"b", b"zebra")}
    tokens = [[*t.split(), b""] for t in texts]
    assert [name[x] for x in cut.words[cut.token_word].tolist()] == [w for t in tokens for w in t]
    assert [name[x] for x in cut.words[cut.token_context].tolist()] == [w for t in tokens for w in (b"", *t[:-1])]
    count = Counter((w, u) for t, h in zip(tokens, held) if not h for w, u in zip(t, (b"", *t[:-1])))
    seen = {(name[w], name[u]): n for w, u, n in zip(cut.words[cut.w].tolist(), cut.words[cut.u].tolist(), cut.n.tolist())}
    assert {k: n for k, n in seen.items() if n} == dict(count) and seen[b"zebra", b"b"] == 0
    big = np.array([0, 255, 256, 2**24 + 5, 2**32 - 1], np.uint32)
    assert (pitman_yor.unpacked_codes(pitman_yor.packed_codes(big)) == big).all() and not len(pitman_yor.unpacked_codes(pitman_yor.packed_codes(big[:0])))


def test_language_model_minds_the_order_of_words(spark):
    """Word contexts: a text scores better than its words in another order, and than under single words."""
    texts = ["the cat sat on the mat", "a dog sat on the rug", "the dog lay on a mat", "a cat lay on the rug"] * 30
    rows = [*enumerate(texts), (1000, "the cat sat on the rug"), (1001, "rug the on sat cat the"), (1002, "the zebra sat"), (1003, None), (None, "")]
    got = {r["doc_id"]: r for r in pitman_yor.score(spark.createDataFrame(rows, "doc_id long, text string"), held=F.col("doc_id") >= 1000).collect()}
    assert got[1000]["score"] > got[1001]["score"] + 2 and got[1000]["base_score"] == pytest.approx(got[1001]["base_score"])
    assert got[1002]["n_known"] == 3 and got[1003]["n_tokens"] == got[None]["n_tokens"] == 1 and len(got) == len(rows)
    assert got[1003]["score"] == pytest.approx(got[None]["score"])


def test_gibbs_moves_keep_the_law_of_tables():
    """For one dish and a fixed parent the number of tables has the weights S(c, t) * strength ** t; many sweeps must show them."""
    c, d, strength = 6, 0.4, 1.3
    stirling = [[0.0] * (c + 2) for _ in range(c + 1)]
    stirling[1][1] = 1.0
    for n in range(2, c + 1):
        for t in range(1, n + 1):
            stirling[n][t] = stirling[n - 1][t - 1] + (n - 1 - d * t) * stirling[n - 1][t]
    want = np.array([stirling[c][t] * strength**t for t in range(1, c + 1)])
    want /= want.sum()
    n = 20_000
    customers, key = np.full(n, c), np.arange(n).astype(np.uint64)
    t = pitman_yor.seat(customers, np.full(n, strength), d, key, 0)
    for sweep in range(1, 8):
        t = pitman_yor.reseat(customers, t, np.full(n, strength), d, key, sweep)
    seen = np.bincount(t, minlength=c + 1)[1 : c + 1] / n
    assert np.abs(seen - want).max() < 0.015


def test_predictive_probabilities_sum_to_one():
    """The parts that a chunk is sent make a law: for each context all known words and the unknown one sum to 1."""
    rng, d, concentration = np.random.default_rng(2), 0.6, 1.0
    counts = rng.integers(0, 5, (4, 7))
    tables = np.where(counts > 0, rng.integers(1, np.maximum(counts, 1) + 1), 0)
    customers = tables.sum(axis=0)
    of_words = np.minimum(np.maximum(customers // 2, 1), np.maximum(customers, 1)) * (customers > 0)
    p = (customers - d * of_words + (concentration + d * of_words.sum()) / 8) / (concentration + customers.sum())
    p = np.append(p, (concentration + d * of_words.sum()) / 8 / (concentration + customers.sum()))
    assert p.sum() == pytest.approx(1)
    for u in range(4):
        own = np.append(counts[u] - d * tables[u], 0)
        assert ((own + (concentration + d * tables[u].sum()) * p) / (concentration + counts[u].sum())).sum() == pytest.approx(1)


def test_noisy_channel():
    text = " ".join(["the idiot is here", "a moron was there", "what trash is that", "the worthless loser", "it is that the was"] * 50)
    model = toxicity.log_model(toxicity.trigram_counts([text.encode()]))
    restore = toxicity.Restorer(model)
    assert "idiot" in restore.words("an 1d10t here") and "loser" in restore.words("you l0s3r!") and "trash" in restore.words("tr@$h")
    assert "moron" in restore.words("a m o r o n there") and "idiot" in restore.words("idiiiiot")
    assert restore.words("plain words stay.") == {"plain", "words", "stay"}
    weight = {toxicity.feature("=" + w): 6.0 for w in ("idiot", "moron", "loser")}
    known = np.sort(np.array([toxicity.feature("=" + w) for w in "the idiot is here a moron was there it that hello".split()], np.int64))
    restore = toxicity.Restorer(model, known, weight)
    assert "idiot" in restore.words("an !diot") and "idiot" in restore.words("(idiot)") and "idiot" in restore.words("iddiot") and "moron" in restore.words("a morron")
    assert "idiot" in restore.words("such an id iot") and "moron" in restore.words("mo ron") and restore.words("hello") == {"hello"}
    assert {"idiot", "moron"} <= restore.words("you i d i o t m o r o n")


def test_toxicity_on_held_out_labels_and_disguises(spark):
    """Held-out labels, as they are and with the toxic words disguised."""
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet").join(labels.select("doc_id"), "doc_id", "left_semi")
    mine = labels.where(toxicity.held_out()).join(docs, "doc_id").select("doc_id", "text", "toxic").collect()
    ways = {"plain": lambda t: t, "leet": lambda t: t.translate(str.maketrans("oieas", "013@$")), "spaced": lambda t: " ".join(" ".join(w) if len(w) > 4 else w for w in t.split(" ")), "long": lambda t: "".join(c * 3 if c in "aeiou" else c for c in t)}
    made = [(10_000_000 + k * 100_000 + r["doc_id"], way(r["text"] or ""), r["toxic"], name) for k, (name, way) in enumerate(ways.items()) for r in mine]
    frame = docs.select("doc_id", "text").unionByName(spark.createDataFrame([m[:2] for m in made], "doc_id long, text string"))
    score = {r["doc_id"]: r["score"] for r in toxicity.scores(frame, labels).collect()}
    for name in ways:
        toxic = [score[i] for i, _, y, n in made if n == name and y == 1]
        clean = [score[i] for i, _, y, n in made if n == name and y == 0]
        assert sum(s >= 0.7 for s in toxic) >= 0.8 * len(toxic), name
        assert sum(s >= 0.7 for s in clean) <= 0.02 * len(clean) + 1, name


def test_chat_edges(spark):
    """Messages with fields aside and lists without messages are known; clashing columns are replaced; unknown layouts are counted."""
    records = ['{"messages": []}', '{"messages": [{"role": "user", "content": "a", "name": "n"}, {"role": "bot", "content": "b"}]}', '{"value": "v", "from": "gpt"}', '{"odd": [1]}', None]
    frame = spark.createDataFrame([(1, i, x, "old", 7) for i, x in enumerate(records)], "conv_id int, turn int, record string, layout string, turns int")
    got = chat.canonical(frame)
    assert [r["layout"] for r in got.orderBy("turn").collect()] == ["no-messages", "messages", "row-from-value", None, None]
    made = chat.conversations(got).first()
    assert made["unknown"] == 3 and [tuple(t) for t in made["turns"]] == [("user", "a"), ("assistant", "b"), ("assistant", "v")]
    assert chat.conversations(chat.canonical(frame.limit(0))).count() == 0


def test_chat_layouts_and_round_trip(spark):
    records = ['{"prompt": "p", "completion": "c"}', '{"conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}]}', '{"instruction": "i", "input": "", "output": "o"}', '{"other": 1}', None, "not json", '{"messages": [{"role": "user", "content": null}]}']
    got = chat.canonical(spark.createDataFrame([(i, x) for i, x in enumerate(records)], "k int, record string")).orderBy("k").collect()
    assert [r["layout"] for r in got] == ["prompt-completion", "from-value", "instruction-input", None, None, None, "messages"]
    assert [tuple(t) for t in got[1]["turns"]] == [("user", "h"), ("assistant", "g")] and [tuple(t) for t in got[2]["turns"]] == [("user", "i"), ("assistant", "o")]
    odd = ["<|im_end|>\n", "\\", "\\|", "<\\|", "<", "", "a\\\\<|im_start|>user\nx<|nl|>", "end\n"]
    turns = spark.createDataFrame([([(r, t) for t in odd for r in ("user", "assi\nst<|ant", "assistant")],)], "turns array<struct<role:string,text:string>>")
    out = turns.select("turns", chat.segments(F.col("turns")).alias("p")).select("turns", "p", chat.formatted(F.col("p")).alias("f")).select("turns", "f", chat.read_turns(F.col("f")).alias("back"), chat.loss_spans(F.col("p")).alias("spans")).first()
    assert out["turns"] == out["back"]
    parts = [p + "<|im_end|>\n" for p in out["f"].split("<|im_end|>\n")[:-1]]
    assert [parts[s["turn"]][s["start"] : s["start"] + s["length"]] for s in out["spans"]] == [t.replace("\\", "\\\\").replace("<|", "<\\|") for t in odd]
    learned = turns.select(chat.segments(F.col("turns")).alias("p")).select(chat.cut(chat.formatted(F.col("p")), chat.loss_spans(F.col("p"))).alias("x")).first()["x"]
    assert learned == "".join(odd)


def test_warc_archives(spark):
    big = "x" * 2000
    pages = spark.createDataFrame([(1, "http://a", big), (2, "http://b", big), (3, None, None), (4, "http://c", "small"), (5, "http://d", "small"), (None, "u v", "é")], "page_id long, url string, html string")
    folder, archives = warc.write_archives(pages, 100)
    got = {r["page_id"]: r for r in warc.read_archives(archives, folder, 300).collect()}
    assert len(got) == 6 and got[1]["record_type"] == "revisit" and got[1]["refers_to"] == 2 and got[2]["record_type"] == "response"
    assert got[1]["payload_bytes"] == 2000 and got[1]["payload_digest"] == hashlib.sha1(big.encode()).hexdigest() == got[2]["payload_digest"]
    assert got[4]["record_type"] == got[5]["record_type"] == "response" and got[3]["payload_bytes"] == 0 and bytes(got[None]["payload"]) == "é".encode()
    assert warc.write_archives(pages.limit(0))[1].count() == 0


def test_zip64_directory():
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for i in range(66_000):  # more than the old directory can count
            z.writestr(zipfile.ZipInfo(f"archive/{i}"), b"%d" % i)
    data = buffer.getvalue()
    read = lambda at, n: data[at : at + n]
    found = warc.directory(read, len(data))
    at = warc.data_start(read, found[65_999])
    assert len(found) == 66_000 and read(at, found[65_999]["size"]) == b"65999"
    with pytest.raises(ValueError):
        warc.directory(lambda at, n: b"no archive"[at : at + n], 10)


def test_pipeline_stages(spark, real):
    import corpus_pipeline as p

    docs = real
    for _, stage in p.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, D).persist()
        assert docs.columns == real.columns and docs.count() > 0
        assert docs.select("doc_id").distinct().join(before.select("doc_id"), "doc_id", "left_anti").count() == 0
    last = p.STAGES[-1][1](spark, docs, D)
    assert last.count() == docs.count()
