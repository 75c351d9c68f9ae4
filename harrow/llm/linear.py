"""Hashed word n-gram logistic regression with follow-the-regularised-leader updates.

``quality_scores`` is the plain classifier; ``toxicity_scores`` adds word stems to the features and a counterfactual
term: identity terms of a training text are swapped for others of their kind, and a change of score is penalised.
A model is fitted on a bounded sample of labelled rows (a parameter) and scores every text as a sparse dot product.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.llm.common import hash_strings, mix, slices

TOKEN = re.compile(r"\w+|[^\w\s]+")

#: Groups of interchangeable identity terms (fixed values, as in published audits of unintended bias).
IDENTITY_TERMS = (
    ("man", "woman", "trans", "nonbinary"),
    ("men", "women"),
    ("male", "female"),
    ("gay", "lesbian", "bisexual", "straight", "heterosexual", "homosexual", "queer"),
    ("christian", "muslim", "jewish", "buddhist", "hindu", "catholic", "protestant", "sikh", "atheist"),
    ("black", "white", "asian", "latino", "latina", "hispanic", "african", "european", "arab"),
    ("american", "mexican", "canadian", "chinese", "japanese", "indian", "german", "french", "spanish"),
    ("blind", "deaf", "paralyzed"),
    ("old", "young", "elderly", "teenage", "millennial"),
)


@dataclass(frozen=True)
class Settings:
    """Feature space, updates and bound of the training sample."""

    bits: int = 20
    ngrams: int = 2
    stems: tuple[int, ...] = ()  # lengths of the word beginnings that are features too
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 1.0
    l2: float = 1.0
    epochs: int = 3
    max_rows: int = 8000  # labelled documents that a fit uses at most: those with the smallest hash of doc_id
    counterfactual: float = 0.0  # weight of the squared change of score under a swap
    identity_terms: tuple[tuple[str, ...], ...] = field(default=IDENTITY_TERMS)


def tokens_of(text: str | None) -> list[str]:
    return TOKEN.findall((text or "").lower())


def _occurrences(docs: list[list[str]], settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of token lists with repeats, and the list of each."""
    counts = np.array([len(d) for d in docs], np.int64)
    coded = pa.array([t for d in docs for t in d], pa.string()).dictionary_encode()
    at = coded.indices.to_numpy(zero_copy_only=False)
    own = hash_strings(coded.dictionary)[at] if len(at) else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(docs)), counts)
    features, owners = [own], [owner]
    gram = own
    for n in range(2, settings.ngrams + 1):
        gram = mix(gram[:-1] * np.uint64(3) + own[n - 1 :]) if len(own) >= n else np.zeros(0, np.uint64)
        inside = owner[: len(gram)] == owner[n - 1 :] if len(gram) else np.zeros(0, bool)
        features.append(gram[inside])
        owners.append(owner[: len(gram)][inside])
    for n in settings.stems if len(at) else ():
        longer = pc.greater(pc.utf8_length(coded.dictionary), n).to_numpy(zero_copy_only=False)
        stems = hash_strings(pc.binary_join_element_wise(str(n), pc.utf8_slice_codeunits(coded.dictionary, 0, n), " "))
        has = longer[at]
        features.append(stems[at[has]])
        owners.append(owner[has])
    return (mix(np.concatenate(features)) >> np.uint64(64 - settings.bits)).astype(np.int64), np.concatenate(owners)


def featurise(docs: list[list[str]], settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed features of each token list, concatenated, and the offsets of the lists."""
    bucket, owner = _occurrences(docs, settings)
    keyed = np.unique((owner << settings.bits) + bucket)
    return keyed & ((1 << settings.bits) - 1), np.searchsorted(keyed >> settings.bits, np.arange(len(docs) + 1))


class Ftrl:
    """Per-coordinate follow-the-regularised-leader; the last coordinate is the bias."""

    def __init__(self, settings: Settings) -> None:
        self.s, self.z, self.n = settings, np.zeros((1 << settings.bits) + 1), np.zeros((1 << settings.bits) + 1)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        s, z = self.s, self.z[at]
        return -np.sign(z) * np.maximum(np.abs(z) - s.l1, 0) / ((s.beta + np.sqrt(self.n[at])) / s.alpha + s.l2)

    def update(self, at: np.ndarray, gradient: np.ndarray | float, w: np.ndarray) -> None:
        n, g2 = self.n[at], np.square(gradient)
        self.z[at] += gradient - (np.sqrt(n + g2) - np.sqrt(n)) / self.s.alpha * w
        self.n[at] = n + g2


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-35.0, min(35.0, x))))


def swapped(tokens: list[str], groups: tuple[tuple[str, ...], ...], rng: random.Random) -> list[str] | None:
    """The tokens with each identity term replaced by another of its group; None if there is none."""
    group_of = {t: g for g in groups for t in g}
    if not any(t in group_of for t in tokens):
        return None
    return [rng.choice([x for x in group_of[t] if x != t]) if t in group_of else t for t in tokens]


def _own_random(text: str | None) -> random.Random:
    """Random numbers that depend on the text alone, wherever and with whatever other texts it is read."""
    return random.Random(xxhash.xxh3_64_intdigest((text or "").encode()))


def fit(rows: list[tuple[np.ndarray, np.ndarray | None, int]], settings: Settings, seed: int = 7) -> np.ndarray:
    """Weights (bias last) from (features, features of the swapped text or None, label). Without rows all are zero."""
    model, rng, bias = Ftrl(settings), random.Random(seed), 1 << settings.bits
    rows = list(rows)
    for _ in range(settings.epochs):
        rng.shuffle(rows)
        for x, y, label in rows:
            x = np.append(x, bias).astype(np.int64)
            w = model.weights(x)
            p = _sigmoid(w.sum())
            model.update(x, p - label, w)
            if y is not None and settings.counterfactual:
                y = np.append(y, bias).astype(np.int64)
                only_x, only_y = np.setdiff1d(x, y), np.setdiff1d(y, x)
                wx, wy = model.weights(only_x), model.weights(only_y)
                pull = settings.counterfactual * (wx.sum() - wy.sum())
                model.update(only_x, pull, wx)
                model.update(only_y, -pull, wy)
    return model.weights().astype(np.float32)


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Rows that a fit never sees: crc32 of doc_id as text is divisible by 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label: str, settings: Settings) -> np.ndarray:
    """Fit on at most max_rows labelled documents outside the held-out fold. The sample's ids are broadcast: their
    number is bounded. Only hashed features of the sample reach the driver, one row an id.

    Labels other than 0 and 1 are ignored, and so are ids that are labelled both; of several texts of one id, the one
    whose features are least in byte order counts. The result depends on neither order nor partitions of the rows."""
    sample = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    sample = sample.agg(F.min(label).cast("int").alias("label"), F.max(label).cast("int").alias("most")).where("label = most").drop("most")
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.max_rows)
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, budget=2 << 20):
            raw = batch.column(1).to_pylist()
            texts = [tokens_of(t) for t in raw]
            other = [swapped(t, settings.identity_terms, _own_random(r)) if settings.counterfactual else None for t, r in zip(texts, raw)]
            x, xo = featurise(texts, settings)
            y, yo = featurise([t or [] for t in other], settings)
            cut = lambda v, o, i: v[o[i] : o[i + 1]].astype(np.uint32).tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array([cut(x, xo, i) for i in range(len(texts))], pa.binary()),
                 pa.array([None if other[i] is None else cut(y, yo, i) for i in range(len(texts))], pa.binary()), batch.column(2).cast(pa.int32())],
                names=["doc_id", "x", "y", "label"],
            )

    features = chosen.mapInArrow(run, "doc_id long, x binary, y binary, label int")
    rows = features.groupBy("doc_id").agg(F.min(F.struct("x", "y", "label")).alias("row")).select("doc_id", "row.*").toArrow().to_pylist()
    rows.sort(key=lambda r: r["doc_id"])
    as_ids = lambda b: None if b is None else np.frombuffer(b, np.uint32)
    return fit([(as_ids(r["x"]), as_ids(r["y"]), r["label"]) for r in rows], settings)


def _probabilities(texts: pa.Array, w: np.ndarray, settings: Settings) -> np.ndarray:
    """Score of each text. Features of weight 0, nearly all of them, are left out before they are made distinct."""
    bucket, owner = _occurrences([tokens_of(t) for t in texts.to_pylist()], settings)
    told = np.flatnonzero(w[bucket])
    keyed = np.unique((owner[told] << settings.bits) + bucket[told])
    logit = float(w[-1]) + np.bincount(keyed >> settings.bits, w[keyed & ((1 << settings.bits) - 1)].astype(np.float64), minlength=len(texts))
    return 1 / (1 + np.exp(-np.clip(logit, -35, 35)))


SCORE_SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def score(docs: DataFrame, weights: np.ndarray, threshold: float, settings: Settings) -> DataFrame:
    """One row per row of docs (doc_id, text): score of the text alone, and 1 where it reaches the threshold.

    Null and empty texts have the bias as their score. Repeated rows give repeated rows, other columns are ignored, and
    a null doc_id counts as not held out. The weights (4 MB at 20 bits) are broadcast. No shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    marked = docs.select("doc_id", "text", held_out().alias("held_out"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in slices(batches, budget=2 << 20):
            probability = _probabilities(batch.column(1), w, settings)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), batch.column(2), pa.array(probability), pa.array((probability >= threshold).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    return marked.mapInArrow(run, SCORE_SCHEMA)


def accepted(docs: DataFrame, weights: np.ndarray, threshold: float, settings: Settings) -> DataFrame:
    """The rows of docs, with all their columns, whose text scores at least the threshold. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, f"c{at}", 2 << 20):
            yield batch.filter(pa.array(_probabilities(batch.column(at), shared.value, settings) >= threshold))

    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # mapInArrow takes no names with dots
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


QUALITY = Settings()
TOXICITY = replace(Settings(), ngrams=1, stems=(3, 4, 5, 6, 7, 8), l1=3.0, counterfactual=0.5)


def quality_scores(docs: DataFrame, labels: DataFrame, settings: Settings = QUALITY, threshold: float = 0.3) -> DataFrame:
    """Quality of every text, learned from labels (doc_id, quality)."""
    return score(docs, train(docs, labels, "quality", settings), threshold, settings)


def toxicity_scores(docs: DataFrame, labels: DataFrame, settings: Settings = TOXICITY, threshold: float = 0.5) -> DataFrame:
    """Toxicity of every text, learned from labels (doc_id, toxic) with the counterfactual term."""
    return score(docs, train(docs, labels, "toxic", settings), threshold, settings)
