"""Toxicity: a noisy channel restores disguised words, then the restored text is scored.

A character model of order three is counted over all texts. A token that may be
disguised (digits or signs among letters, a letter three times or more, letters
set apart by signs or spaces) becomes a lattice of readings with channel costs;
Viterbi decoding under the model picks one. So do words with a doubled letter
and neighbouring short tokens that the training rows lack but a learnt word may
hide in. All other tokens have one reading, themselves, and are not decoded. The
score comes from word and word-beginning features learnt from labelled rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Labelled rows that are learnt from at most, chosen by hash.
TRAIN_ROWS = 20_000
#: Toxic rows that a feature needs, and the least log ratio of its rates.
SUPPORT, LEAST = 3, 2.0

SYMBOLS = 32  # 0 space and signs, 1 to 26 letters, 27 other letters, 28 digits
TRIGRAMS = SYMBOLS**3
#: Letters that a sign or digit may stand for.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "2": "z", "@": "a", "$": "s", "!": "i", "|": "li", "+": "t", "(": "c", "<": "c"}
SEPARATORS = ".-_*~^'/\\ "
#: Channel costs in nats: a sign for a letter, a literal sign, a dropped separator, a kept one, a dropped repeat.
AS_LETTER, LITERAL, DROPPED, KEPT, REPEAT = 1.0, 6.0, 1.0, 4.0, 0.7

EDGE = ".,;:!?\"'()[]{}<>«»…"
SUSPECT = re.compile(r"(?=.*[^\W\d_])(?:.*[^\W\d_][0-9@$!|+(<.\-_*~^/\\]+[^\W\d_]|[0-9@$!|+(<]+[^\W\d_]|.*[^\W\d_][0-9@$|+(<]+$|.*([^\W\d_])\1\1)", re.S)
TRIPLE = re.compile(r"(.)\1\1")
DOUBLE = re.compile(r"([^\W\d_])\1")
#: Letters of a token that may be part of a word cut by a space, and the evidence that makes it worth a look.
FRAGMENT, STRONG = 4, 4.0


def _codes() -> bytes:
    out = bytearray(256)
    for i in range(256):
        c = chr(i).lower()
        out[i] = ord(c) - 96 if "a" <= c <= "z" and i < 128 else 27 if i >= 128 else 28 if c.isdigit() else 0
    return bytes(out)


CODES = _codes()


def trigram_counts(texts: list[bytes]) -> np.ndarray:
    """Counts of symbol trigrams; texts are kept apart by a sign, runs of signs count as they stand."""
    s = np.frombuffer((b"  ".join(texts) + b"  ").translate(CODES), np.uint8).astype(np.int32)
    return np.bincount(s[:-2] * SYMBOLS**2 + s[1:-1] * SYMBOLS + s[2:], minlength=TRIGRAMS)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(TRIGRAMS, np.int64)
    for batch in batches:
        total += trigram_counts([t for t in batch.column("text").cast(pa.large_binary()).to_pylist() if t])
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["code", "n"])


def log_model(counts: np.ndarray) -> np.ndarray:
    """Log probabilities [two symbols before, symbol], interpolated with lower orders."""
    c3 = counts.reshape(SYMBOLS * SYMBOLS, SYMBOLS).astype(float)
    c2 = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).sum(axis=0).astype(float)
    c1 = c2.sum(axis=0)
    p1 = (c1 + 1) / (c1.sum() + SYMBOLS)
    p2 = (c2 + 5 * p1) / (c2.sum(axis=1, keepdims=True) + 5)
    p3 = (c3 + 5 * np.tile(p2, (SYMBOLS, 1))) / (c3.sum(axis=1, keepdims=True) + 5)
    return np.log(p3)


def _symbol(c: str) -> int:
    if "a" <= c <= "z":
        return ord(c) - 96
    return 27 if c.isalpha() else 28 if c.isdigit() else 0


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """For each stretch of the token, its readings with their costs."""
    out, i = [], 0
    while i < len(token):
        c, j = token[i], i + 1
        while j < len(token) and token[j] == c:
            j += 1
        n = j - i
        if c.isalpha():
            out.append([(c * k, REPEAT if k < n else 0.0) for k in sorted({1, min(n, 2)})] + ([(c * n, LITERAL)] if n > 2 else []))
        else:
            ways = [(x * k, AS_LETTER * n) for x in LEET.get(c, "") for k in sorted({1, min(n, 2)})]
            if c in SEPARATORS:
                ways += [("", DROPPED), (" ", KEPT)]
            out.append([*ways, (c * n, LITERAL)])
        i = j
    return out


def decode(token: str, model: np.ndarray) -> str:
    """The likeliest reading of a token between two spaces."""
    beam = {0: (0.0, None)}  # two symbols before, here both spaces
    for ways in [*lattice(token), [(" ", 0.0)]]:
        after: dict[int, tuple] = {}
        for state, (score, path) in beam.items():
            for text, cost in ways:
                s, at = score - cost, state
                for ch in text:
                    k = _symbol(ch)
                    s += model[at, k]
                    at = at % SYMBOLS * SYMBOLS + k
                if at not in after or s > after[at][0]:
                    after[at] = (s, (text, path))
        beam = after  # SYMBOLS ** 2 states at most
    path, out = max(beam.values(), key=lambda x: x[0])[1], []
    while path:
        out.append(path[0])
        path = path[1]
    return "".join(reversed(out)).strip()


class Restorer:
    """Restored words of texts; what a token decodes to is kept.

    known: sorted feature hashes of the training rows; weight: evidence of
    features. Without them, as in training, only tokens that look disguised by
    themselves are decoded.
    """

    def __init__(self, model: np.ndarray, known: np.ndarray | None = None, weight: dict[int, float] | None = None):
        self.model, self.seen, self.known, self.weight = model, {}, known if known is not None else np.empty(0, np.int64), weight or {}

    def unknown(self, word: str) -> bool:
        h = feature("=" + word)
        at = int(np.searchsorted(self.known, h))
        return at == len(self.known) or self.known[at] != h

    def strong(self, word: str) -> bool:
        return self.weight.get(feature("=" + word), 0.0) > STRONG

    def token(self, raw: str) -> tuple[str, ...]:
        found = self.seen.get(raw)
        if found is None:
            if len(self.seen) > 500_000:
                self.seen.clear()
            t, lead = raw.strip(EDGE), raw.rstrip(EDGE).lstrip(EDGE.replace("(", "").replace("<", "").replace("!", ""))
            found = (t,) if t else ()
            if lead.isalpha():
                doubled = TRIPLE.search(lead) or (len(self.known) and DOUBLE.search(lead) and self.unknown(lead))
            else:
                doubled = False
            if doubled or (SUSPECT.match(lead) and not t.isdigit()):
                found = tuple(dict.fromkeys([*filter(None, (w.strip(EDGE) for w in decode(lead, self.model).split())), *found]))
                if doubled:  # each doubled letter once, should the model have kept it
                    found = tuple(dict.fromkeys([*found, DOUBLE.sub(r"\1", t)]))
            self.seen[raw] = found
        return found

    def words(self, text: str) -> set[str]:
        """The distinct words of a text as they stand and, where they may be disguised, as restored."""
        tokens = text.lower().split()
        out = self.spaced(tokens)
        for t in set(tokens):
            out.update(self.token(t))
        return out

    def spaced(self, tokens: list[str]) -> set[str]:
        """The words that runs of three single characters or more spell, half of them letters, and those that two short tokens make."""
        out = set()
        single = [i for i, t in enumerate(tokens) if len(t) == 1]
        k = 0
        while k + 2 < len(single):
            m = k
            while m + 1 < len(single) and single[m + 1] == single[m] + 1:
                m += 1
            run = [tokens[i] for i in single[k : m + 1]]
            if len(run) >= 3 and 2 * sum(x.isalpha() for x in run) >= len(run):
                found = decode(" ".join(run), self.model).split()
                out.update(found)
                if self.weight:
                    # Where words follow each other letter by letter, their borders are found by the words that are known.
                    letters = "".join(found)
                    out.update(w for i in range(len(letters)) for n in range(4, 17) if i + n <= len(letters) and self.strong(w := letters[i : i + n]))
            k = m + 1
        if self.weight:
            short = [i for i, t in enumerate(tokens) if 1 < len(t) <= FRAGMENT and t.isalpha()]
            for i, j in zip(short, short[1:]):
                if j == i + 1 and self.strong(tokens[i] + tokens[j]) and (self.unknown(tokens[i]) or self.unknown(tokens[j])):
                    out.update(decode(tokens[i] + " " + tokens[j], self.model).split())
        return out


def feature(part: str) -> int:
    return xxhash.xxh3_64_intdigest(part.encode()) - (1 << 63)


def features(word: str) -> list[int]:
    """Hashes of the word and of its first 4, 5 and 6 letters."""
    parts = {"=" + word, *("^" + word[:n] for n in (4, 5, 6) if len(word) >= n)}
    return [feature(p) for p in parts]


def _learner(model):
    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restore, total, cut = Restorer(model.value), {}, {}
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                if len(cut) > 500_000:
                    cut.clear()
                found = set()
                for w in restore.words(text or ""):
                    own = cut.get(w)
                    if own is None:
                        own = cut[w] = features(w)
                    found.update(own)
                for f in found:
                    x = total.get(f)
                    if x is None:
                        total[f] = x = [0, 0]
                    x[0 if toxic else 1] += 1
            if len(total) > 2_000_000:
                yield _tally(total)
                total = {}
        yield _tally(total)

    return learn


def _tally(total: dict) -> pa.RecordBatch:
    v = np.array(list(total.values()), np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(v[:, 0]), pa.array(v[:, 1])], ["feature", "toxic", "clean"])


def _evidence(shared, kind: str):
    """Per text: the strongest feature, and how many words have a strong one."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, weight, known_features, fit = shared.value
        restore = Restorer(model, known_features, weight)

        class Weights(dict):
            def __missing__(self, raw):
                self[raw] = w = max((weight.get(f, 0.0) for x in restore.token(raw) for f in features(x)), default=0.0)
                return w

        known = Weights()
        for batch in batches:
            if len(known) > 1_000_000:
                known.clear()
            x = np.zeros((batch.num_rows, 3))
            x[:, 0] = 1
            for i, text in enumerate(batch.column("text").to_pylist()):
                if text:
                    tokens = text.lower().split()
                    found = [w for w in map(known.__getitem__, set(tokens).union(restore.spaced(tokens))) if w > 0]
                    if found:
                        x[i, 1], x[i, 2] = max(found), np.log1p(sum(w > 4 for w in found))
            if kind == "fit":
                yield pa.RecordBatch.from_arrays([pa.array(x[:, 1]), pa.array(x[:, 2]), batch.column("toxic")], ["top", "many", "toxic"])
            else:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-(x @ fit))))], ["doc_id", "score"])

    return score


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights of a ridge logistic regression, by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def char_model(documents: DataFrame) -> np.ndarray:
    rows = documents.select("text").mapInArrow(_count, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()  # TRIGRAMS rows at most
    counts = np.zeros(TRIGRAMS)
    for code, n in rows:
        counts[code] = n
    return log_model(counts)


def scores(documents: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, score: one row per input row.

    Labels come from rows (doc_id, toxic) that are not held out and have no
    nulls, at most train_rows of them, spread by hash. Of these, seven tenths
    choose the features and the rest fit the score. Null and empty texts have no
    evidence and get the score that this has in the fit. Without labels of both
    kinds each score is the share of toxic rows, 0 without any. Repeated rows
    get equal scores. Only doc_id and text are read.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1_000_000))
    n = usable.count()
    chosen = usable.where(draw < int(1_000_000 * min(1.0, train_rows / max(n, 1)))).withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(10)) < 7)
    rows = docs.join(F.broadcast(chosen), "doc_id")  # train_rows rows or a little more
    model = char_model(documents)
    size = {(bool(t), bool(f)): k for t, f, k in rows.groupBy("toxic", "fold").count().collect()}
    toxic, clean = (size.get((t, True), 0) for t in (True, False))
    weights, known, fit = {}, np.empty(0, np.int64), np.zeros(3)
    share = (toxic + size.get((True, False), 0)) / max(1, sum(size.values()))
    if toxic and clean and size.get((True, False)) and size.get((False, False)):
        counts = rows.where("fold").select("text", "toxic").mapInArrow(_learner(spark.sparkContext.broadcast(model)), "feature long, toxic long, clean long")
        counts = materialise(counts.groupBy("feature").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b")), "toxicity-features")
        weight = F.log((F.col("a") + 0.5) / (toxic + 1)) - F.log((F.col("b") + 0.5) / (clean + 1))
        # As many as the features of train_rows rows at most.
        weights = {r["feature"]: r["w"] for r in counts.where(F.col("a") >= SUPPORT).withColumn("w", weight).where(F.col("w") >= LEAST).select("feature", "w").collect()}
        known = np.sort(counts.select("feature").toPandas()["feature"].to_numpy(np.int64))
        shared = spark.sparkContext.broadcast((model, weights, known, fit))
        seen = rows.where("NOT fold").select("text", "toxic").mapInArrow(_evidence(shared, "fit"), "top double, many double, toxic int").toPandas()
        x = np.column_stack([np.ones(len(seen)), seen["top"], seen["many"]])
        fit = logistic(x, seen["toxic"].to_numpy(float))
    else:
        fit[0] = np.log(max(share, 1e-9) / max(1 - share, 1e-9))
    shared = spark.sparkContext.broadcast((model, weights, known, fit))
    return docs.mapInArrow(_evidence(shared, "score"), "doc_id long, score double")
