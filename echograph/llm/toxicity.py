"""Toxicity categories by a classifier chain.

Categories are predicted in a fixed order by linear (logistic) models over word presence. A later
model also sees the log-odds of the earlier categories; in training these are out-of-fold
predictions, so it learns from probabilities like those that it will be given. The labels tell low
quality and toxic; the third category, severe, is made here as both at once, to give the chain a link
that depends on the two before it.

The models are fitted on at most ``SAMPLE`` labelled rows, taken in the order of a hash of doc_id and
text; scoring covers all rows and whole texts, however long, without a shuffle. Folds come from a hash
of doc_id, so rows of one id share a fold. A null text has no words and gets the models' base rates;
of labels that contradict each other the worse counts, null ones are left out; rows that repeat id and
text count once in training and get equal scores; without any usable label every probability is 0; an
empty table gives no rows. Of ``docs`` only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echograph.llm.bytewords import Words
from echograph.llm.tokens import text_blocks
from echograph.session import materialise

SAMPLE = 8000
WORDS_PER_CATEGORY = 512
FOLDS = 5
STEPS = 400
#: A fit has converged when no weight moves by more than this share of the largest.
TOLERANCE = 1e-3
PENALTY = 0.003
CHAIN = ("low_quality", "toxic", "severe")
_SEED = 3
BLOCK_CHARS = 500_000


@dataclass
class Chain:
    """Per category a bias, a weight per word, and a weight per earlier category."""

    hashes: np.ndarray
    bias: list[float] = field(default_factory=list)
    weights: list[np.ndarray] = field(default_factory=list)
    earlier: list[np.ndarray] = field(default_factory=list)
    threshold: float = 0.5

    def log_odds(self, doc: np.ndarray, word: np.ndarray, n: int) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for bias, weights, earlier in zip(self.bias, self.weights, self.earlier):
            z = np.full(n, bias) + np.bincount(doc, weights[word], n)
            for w, before in zip(earlier, out):
                z += w * squash(before)
            out.append(z)
        return out


def squash(z: np.ndarray) -> np.ndarray:
    """Log-odds as later models see them: bounded."""
    return np.clip(z, -4, 4)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = PENALTY, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and bias by accelerated gradient descent; the bias has no penalty. Columns are scaled
    by their norms, so that rare words learn as fast as common ones."""
    n, k = x.shape
    if not n or y.min() == y.max():
        p = (y.sum() + 0.5) / (n + 1)
        return np.zeros(k), float(np.log(p / (1 - p)))
    norm = np.sqrt(np.maximum((x * x).sum(axis=0), 1)).astype(np.float32)
    x = x / norm
    top = np.ones(k, np.float32)
    for _ in range(15):
        top = x.T @ (x @ top)
        top /= max(float(np.linalg.norm(top)), 1e-9)
    big = float(n) ** 0.5  # the bias's column is scaled like the others
    step = 1 / (0.25 * (float(np.linalg.norm(x @ top)) ** 2 + 1) + penalty)
    w, b = np.zeros(k, np.float32), 0.0
    vw, vb = w, b
    for t in range(1, steps + 1):
        g = (_sigmoid(x @ vw + vb / big) - y).astype(np.float32)
        nw, nb = vw - step * (x.T @ g + penalty * vw), vb - step * float(g.sum()) / big
        m = (t - 1) / (t + 2)
        moved = float(np.abs(nw - w).max(initial=0.0))
        vw, vb = nw + m * (nw - w), nb + m * (nb - b)
        w, b = nw, nb
        if t > 50 and moved < TOLERANCE * float(np.abs(w).max(initial=0.0)):
            break
    return (w / norm).astype(np.float64), b / big


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The cut with the best F1 on out-of-fold predictions, half way to the next lower one."""
    order = np.argsort(-p, kind="stable")
    hit = np.cumsum(y[order])
    if not len(p) or not hit[-1]:
        return 0.5
    f1 = 2 * hit / (np.arange(1, len(p) + 1) + hit[-1])
    at = int(np.argmax(f1))
    p = p[order]
    return float(min(0.5, (p[at] + p[min(at + 1, len(p) - 1)]) / 2))


def fit_chain(x: np.ndarray, labels: np.ndarray, fold: np.ndarray, hashes: np.ndarray, folds: int = FOLDS) -> Chain:
    """x: presence (rows, words); labels: (rows, categories)."""
    chain, seen = Chain(hashes), np.zeros((len(x), 0), np.float32)
    for c in range(labels.shape[1]):
        y = labels[:, c].astype(np.float32)
        full = np.concatenate([x, seen], axis=1)
        w, b = fit_logistic(full, y)
        chain.bias.append(b)
        chain.weights.append(w[: x.shape[1]])
        chain.earlier.append(w[x.shape[1] :])
        if c + 1 < labels.shape[1]:
            out = np.zeros(len(x), np.float32)
            for k in range(folds):
                held = fold == k
                fw, fb = fit_logistic(full[~held], y[~held])
                out[held] = squash(full[held] @ fw + fb)
            seen = np.concatenate([seen, out[:, None]], axis=1)
            if CHAIN[c] == "toxic":
                chain.threshold = best_threshold(_sigmoid(out), y)
    return chain


def presence(texts: list[str], hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, word) of the known words each text has; words are counted once."""
    words = Words([t.lower() for t in texts], "alnum")
    h = words.hashes(_SEED)
    if not len(h) or not len(hashes):
        return (np.zeros(0, np.int64),) * 2
    at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
    known = np.flatnonzero(hashes[at] == h)
    doc = np.searchsorted(words.first, known, side="right") - 1
    pairs = np.unique(doc * len(hashes) + at[known])
    return pairs // len(hashes), pairs % len(hashes)


def _presence_rows(hashes: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, word = presence([t or "" for t in batch.column("text").to_pylist()], hashes)
            split = np.split(word, np.searchsorted(doc, np.arange(1, batch.num_rows)))
            held = pa.array([w.tolist() for w in split][: batch.num_rows], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "hash", "fold", "quality", "toxic")] + [held], ["doc_id", "hash", "fold", "quality", "toxic", "words"])

    return run


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, text, hash, fold, quality, toxic): at most ``sample`` rows, stored. Of the labels at most
    ``sample`` are broadcast; where ids repeat, the labelled rows themselves are cut to as many."""
    usable = labels.filter("doc_id is not null and quality is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    usable = usable.agg(F.min(F.col("quality").cast("int")).alias("quality"), F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("hash")).join(F.broadcast(chosen), "doc_id")
    rows = materialise(rows, "toxicity-labelled")
    keys = rows.select("doc_id", "hash").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "hash").limit(sample)
    rows = rows.join(F.broadcast(keys), ["doc_id", "hash"]).dropDuplicates(["doc_id", "hash"])
    return materialise(rows.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int")), "toxicity-sample")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, words: int = WORDS_PER_CATEGORY) -> Chain:
    """Fit the chain on the driver: at most ``sample`` rows of ``2 * words`` presences."""
    rows = training_rows(docs, labels, sample)
    clean = F.split(F.lower("text"), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    held = rows.select("toxic", (F.col("quality") == 0).cast("int").alias("low"), F.explode(F.array_distinct(clean)).alias("w"))
    sums = held.filter("w <> ''").groupBy("w").agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic"), F.sum("low").alias("low")).filter("n >= 3")
    total = rows.agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic"), F.sum(F.when(F.col("quality") == 0, 1).otherwise(0)).alias("low")).first()
    found: set[str] = set()
    for name in ("toxic", "low"):
        base = (total[name] or 0) / max(1, total["n"])
        if 0 < base < 1:
            z = F.abs(F.col(name) - F.col("n") * base) / F.sqrt(F.col("n") * base * (1 - base))
            found.update(r.w for r in sums.orderBy(z.desc(), "w").limit(words).select("w").collect())
    if not found:
        return Chain(np.zeros(0, np.uint64))
    hashes = np.unique(Words(sorted(found), "alnum").hashes(_SEED))
    got = rows.mapInArrow(_presence_rows(hashes), "doc_id long, hash long, fold int, quality int, toxic int, words array<int>").toArrow().sort_by([("doc_id", "ascending"), ("hash", "ascending")])
    x = np.zeros((got.num_rows, len(hashes)), np.float32)
    held_words = got.column("words").combine_chunks()
    held_words = held_words.chunk(0) if isinstance(held_words, pa.ChunkedArray) else held_words
    sizes = np.diff(held_words.offsets.to_numpy())
    x[np.repeat(np.arange(got.num_rows), sizes), held_words.flatten().to_numpy()] = 1
    low, toxic = got.column("quality").to_numpy() == 0, got.column("toxic").to_numpy() == 1
    return fit_chain(x, np.stack([low, toxic, low & toxic], axis=1), got.column("fold").to_numpy(), hashes)


_SCORED = "doc_id long, p_low_quality double, p_toxic double, p_severe double, toxic boolean"


def _score_rows(chain: Chain):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for a, b in text_blocks(texts, BLOCK_CHARS):
                odds = chain.log_odds(*presence(texts[a:b], chain.hashes), b - a) if chain.bias else [np.full(b - a, -30.0)] * len(CHAIN)
                p = [np.round(_sigmoid(z), 6) for z in odds]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), *map(pa.array, p), pa.array(p[1] >= chain.threshold)], ["doc_id", "p_low_quality", "p_toxic", "p_severe", "toxic"])

    return run


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """Per row: doc_id, the chain's probabilities, and toxic."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_score_rows(chain), _SCORED)


def op3_classifier_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
