"""Toxicity by maximum-scoring segments of token log-odds.

Learning: every labelled text counts each of its token features once, and of
near copies (labelled texts with the same smallest hash of five words) only one
counts, so that the odd words of a much copied text don't pass for toxic.  A
feature is a word or one of its prefixes, so that a family of inflected words
counts together.  Log-odds of the two classes have an informative Dirichlet
prior (the features' overall counts, scaled to ``PRIOR`` tokens, plus 1/2).
Kept are features of the toxic class whose signed root of the likelihood ratio is
above sqrt(2 ln V), what the best of V features without meaning would reach,
by ``MARGIN``.

Scoring: a token scores the log-odds of its most significant feature, any other
token the drift, so that ordinary text scores below zero.  One pass (Ruzzo and
Tompa) finds all maximal segments, every toxic passage by itself.  Segment scores
are calibrated by extreme-value theory: in clean text the best of n tokens
exceeds s with probability 1 - exp(-K n exp(-lambda s)), lambda being the root of
E[exp(lambda score)] = 1 and K fitted to clean learning texts.  A document adds up
the excess of its significant segments; a logistic curve over that sum, with a
prior that keeps it finite where the classes separate, gives the score.

``MAX_LEARN`` bounds the labelled documents that are learnt from (a hash of the
id decides), ``MAX_FEATURES`` the features kept, the most significant first; a
feature's log-odds count up to ``MOST``.  All documents are scored over their whole text.

Defined results: null and empty texts score as texts without tokens; with no
labels, or none of one class, every text gets the share of label 1 (0 without
labels); null labels are not learnt from; a doc_id with several labels takes the
largest, and any above 0 counts as 1; repeated rows agree; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written
from .language import remainder
from .tokens import slices

MAX_LEARN = 40_000
MAX_FEATURES = 100_000
PREFIXES = (4, 5, 6)
PRIOR = 1000.0
MARGIN = 0.3
DRIFT = -0.15
MOST = 10.0
_TOKEN = re.compile(r"\w+")


def tokens(text: str | None) -> list[str]:
    return _TOKEN.findall(text.lower()) if text else []


def features(word: str) -> list[str]:
    return [word] + [f"{word[:n]}*" for n in PREFIXES if len(word) > n]


def add_sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for text in b["text"].to_pylist():
            words = tokens(text)
            out.append(min((crc32(" ".join(words[i : i + 5]).encode()) for i in range(max(1, len(words) - 4))), default=0))
        yield pa.RecordBatch.from_arrays([b["text"], b["label"], pa.array(out, pa.int64())], names=["text", "label", "sketch"])


def count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: tuple[Counter, Counter] = (Counter(), Counter())

    def out():
        keys = list(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([counts[0][k] for k in keys], pa.int64()), pa.array([counts[1][k] for k in keys], pa.int64())], names=["feature", "clean", "toxic"])
        counts[0].clear()
        counts[1].clear()

    for b in batches:
        for text, label in zip(b["text"].to_pylist(), b["label"].to_pylist(), strict=True):
            counts[label].update({f for w in set(tokens(text)) for f in features(w)})
        if len(counts[0]) + len(counts[1]) > 1_000_000:
            yield from out()
    yield from out()


@dataclass
class Model:
    share: float = 0.0
    odds: dict[str, tuple[float, float]] = field(default_factory=dict)
    lam: float = 0.5
    k: float = 0.1
    bias: float = 0.0
    slope: float = 0.0

    def token_score(self, word: str) -> float:
        best = max((self.odds[f] for f in features(word) if f in self.odds), default=None)
        return best[1] if best else DRIFT

    def segments(self, text: str | None, cache: dict[str, float] | None = None) -> tuple[list[tuple[float, int, int]], int]:
        """All maximal scoring segments as (score, first token, end), and the number of tokens."""
        words = tokens(text)
        cache = {} if cache is None else cache
        scored: list[tuple[int, float]] = []
        for i, w in enumerate(words):
            s = cache.get(w)
            if s is None:
                if len(cache) > 500_000:
                    cache.clear()
                s = cache[w] = self.token_score(w)
            if s > 0:
                scored.append((i, s))
        # Left and right totals of candidate segments (Ruzzo and Tompa); runs of drift need no step of their own.
        found: list[list[float]] = []
        total, at = 0.0, 0
        for i, s in scored:
            total += DRIFT * (i - at)
            at = i + 1
            left, total = total, total + s
            piece = [left, total, i, i + 1]
            while True:
                j = len(found) - 1
                while j >= 0 and found[j][0] >= piece[0]:
                    j -= 1
                if j < 0 or found[j][1] >= piece[1]:
                    found.append(piece)
                    break
                piece = [found[j][0], piece[1], found[j][2], piece[3]]
                del found[j:]
        return [(r - low, int(a), int(b)) for low, r, a, b in found], len(words)

    def excess(self, segments: list[tuple[float, int, int]], n: int) -> float:
        """Sum of lambda * score - ln(K n) over the segments above that level."""
        level = math.log(max(self.k * max(n, 1), 1.0))
        return sum(max(0.0, self.lam * s - level) for s, _, _ in segments)

    def score(self, text: str | None, cache: dict[str, float] | None = None) -> float:
        if not self.odds:
            return self.share
        x = self.bias + self.slope * math.log1p(self.excess(*self.segments(text, cache)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def learn(docs: DataFrame, labels: DataFrame, max_learn: int = MAX_LEARN) -> Model:
    """A model from the rows of ``docs`` whose doc_id has a label (doc_id, toxic)."""
    marked = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("l_id")).agg(F.max((F.col("toxic") > 0).cast("int")).alias("label"))
    total = marked.count()
    if total > max_learn:
        marked = marked.where(F.pmod(F.xxhash64("l_id"), F.lit(1 << 30)) < int(max_learn / total * (1 << 30)))
    # max_learn ids at about 16 bytes: a bounded broadcast.
    rows = docs.select("doc_id", "text").join(F.broadcast(marked), F.col("doc_id") == F.col("l_id")).select("text", "label")
    rows = rows.mapInArrow(add_sketch, "text string, label int, sketch long").groupBy("sketch", "label").agg(F.min("text").alias("text"))
    rows = written(rows.select("text", "label"), "learn")
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    model = Model(share=sizes.get(1, 0) / max(sum(sizes.values()), 1))
    if not sizes.get(0) or not sizes.get(1):
        return model
    counts = rows.mapInArrow(count_features, "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    counts = written(counts, "features")
    sums = counts.agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t")).first()
    n0, n1 = float(sums["c"]), float(sums["t"])
    prior = 0.5 + (F.col("clean") + F.col("toxic")) * (PRIOR / (n0 + n1))
    odds = counts.where("toxic >= 3").withColumn("prior", prior)
    odds = odds.withColumn("delta", F.log((F.col("toxic") + F.col("prior")) / (n1 - F.col("toxic") + PRIOR)) - F.log((F.col("clean") + F.col("prior")) / (n0 - F.col("clean") + PRIOR)))
    # Signed root of the likelihood ratio of a feature's share of toxic texts against that of all.
    a, b = F.col("toxic").cast("double"), F.col("clean").cast("double")
    share = n1 / (n0 + n1)
    gain = 2 * (a * F.log(a / ((a + b) * share)) + F.when(b > 0, b * F.log(b / ((a + b) * (1 - share)))).otherwise(0.0))
    odds = odds.where(a > (a + b) * share).withColumn("z", F.sqrt(F.greatest(gain, F.lit(0.0)))).where("delta > 0")
    tried = counts.where("toxic >= 3").count()
    least = math.sqrt(2 * math.log(max(tried, 2))) + MARGIN
    kept = odds.where(F.col("z") >= least).orderBy(F.col("z").desc(), "feature").limit(MAX_FEATURES).select("feature", "z", "delta").toArrow()
    model.odds = {f: (z, min(d, MOST)) for f, z, d in zip(*(kept[c].to_pylist() for c in ("feature", "z", "delta")), strict=True)}
    if not model.odds:
        return model
    _calibrate(model, rows)
    return model


def background(texts: list[str | None], model: Model) -> Counter:
    """How often tokens score: all of them (None), and those above the drift by score."""
    seen: Counter = Counter()
    for text in texts:
        seen.update(tokens(text))
    out: Counter = Counter({None: seen.total()})
    for word, n in seen.items():
        if (s := model.token_score(word)) > 0:
            out[s] += n
    return out


def root_of(hits: Counter) -> float:
    """lambda: the positive root of E[exp(lambda score)] = 1 over the background (``background``)."""
    n = max(float(hits[None]), 1.0)
    scores = np.array([s for s in hits if s is not None], dtype=float)
    share = np.array([hits[s] for s in hits if s is not None], dtype=float) / n

    def excess(lam: float) -> float:
        return float((share * np.exp(np.minimum(lam * scores, 500))).sum()) + (1 - share.sum()) * math.exp(lam * DRIFT) - 1

    low, high = 1e-6, 5.0
    if excess(high) > 0:
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if excess(mid) < 0 else (low, mid)
    return max((low + high) / 2, 1e-3)


def _calibrate(model: Model, rows: DataFrame) -> None:
    """Fit lambda, K and the logistic curve to the learning texts.

    To the driver come counts by score (as many as there are features, at most) and
    a few numbers for each of at most ``MAX_LEARN`` texts.
    """
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast(model)
    clean = rows.where("label = 0")

    def count(batches):
        for b in batches:
            hits = background(b["text"].to_pylist(), sent.value)
            yield pa.RecordBatch.from_arrays([pa.array(list(hits), pa.float64()), pa.array(list(hits.values()), pa.int64())], names=["score", "n"])

    got = clean.mapInArrow(count, "score double, n long").groupBy("score").agg(F.sum("n").alias("n")).collect()
    hits = Counter({r["score"]: r["n"] for r in got})
    if len(hits) < 2:  # no clean token above the drift
        hits[max(d for _, d in model.odds.values())] = 1
        hits[None] += 1
    model.lam = root_of(hits)

    def best(batches):
        m, cache = sent.value, {}
        for b in batches:
            out = [m.segments(t, cache) for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([n for _, n in out], pa.int64()), pa.array([max((s for s, _, _ in found), default=0.0) for found, _ in out])], names=["n", "top"])

    tops = clean.mapInArrow(best, "n long, top double").toArrow()
    size, top = np.asarray(tops["n"]), np.asarray(tops["top"])
    some = top > 0
    # P(best < s) = exp(-K n exp(-lambda s)): K is what makes the expected number of segments right.
    spread = float((size * np.exp(-model.lam * np.where(some, top, 0.0))).sum())
    model.k = max(float(some.sum() / max(spread, 1.0)) if some.any() else 1.0 / max(float(hits[None]), 1.0), 1e-9)
    fitted = spark.sparkContext.broadcast(model)

    def sums(batches):
        m, cache = fitted.value, {}
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["label"], pa.array([math.log1p(m.excess(*m.segments(t, cache))) for t in b["text"].to_pylist()], pa.float64())], names=["label", "x"])

    t = rows.mapInArrow(sums, "label int, x double").toArrow()
    model.bias, model.slope = logistic(np.asarray(t["x"]), np.asarray(t["label"]).astype(float))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> tuple[float, float]:
    """Intercept and slope of a logistic curve: Newton steps, halved until they improve the fit."""

    def loss(v: np.ndarray) -> float:
        u = v[0] + v[1] * x
        return float((np.logaddexp(0, u) - y * u).sum() + ridge / 2 * (v**2).sum())

    v = np.array([0.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(v[0] + v[1] * x, -500, 500)))
        w = p * (1 - p)
        g = np.array([(y - p).sum() - ridge * v[0], ((y - p) * x).sum() - ridge * v[1]])
        h = np.array([[w.sum() + ridge, (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + ridge]])
        step = np.linalg.solve(h, g)
        while loss(v + step) > loss(v) and np.abs(step).max() > 1e-9:
            step = step / 2
        v = v + step
        if np.abs(step).max() < 1e-8:
            break
    return float(v[0]), float(max(v[1], 0.0))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    cache: dict[str, float] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array([sent.value.score(t, cache) for t in b["text"].to_pylist()], pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored; labels are learnt where crc32(doc_id) mod 3 is not 1."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = remainder(F.col("doc_id"), 3) == 1
    model = learn(docs.where(~held), labels.where(~held))
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
