"""Toxicity categories by a classifier chain: each linear model also sees the probabilities of the categories before it."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanlake.llm import features, text
from scanlake.llm.pairwise_quality import held_out

SLOTS = features.SLOTS
#: A term is evidence of a category if it is in so many of its rows, and its log-odds are so high.
LEAST_ROWS, LEAST_ODDS = 4, 1.5
#: Categories in the order of the chain: those that the labels hold.
CHAIN = ("low_quality", "toxic")
FOLDS = 5


class Rows:
    """Sparse rows (log counts of terms over the root of their number) and a few dense columns."""

    def __init__(self, terms: list[tuple[np.ndarray, np.ndarray]], dense: np.ndarray):
        self.size = np.array([len(s) for s, _ in terms], np.int64)
        self.slot = np.concatenate([np.asarray(s, np.int32) for s, _ in terms]) if terms else np.zeros(0, np.int32)
        self.value = np.concatenate([(np.log1p(c) / np.sqrt(max(len(c), 1))).astype(np.float32) for _, c in terms]) if terms else np.zeros(0, np.float32)
        self.row = np.repeat(np.arange(len(terms), dtype=np.int32), self.size)
        self.dense = dense

    def take(self, keep: np.ndarray) -> Rows:
        out = object.__new__(Rows)
        inside = keep[self.row]
        out.size, out.slot, out.value, out.dense = self.size[keep], self.slot[inside], self.value[inside], self.dense[keep]
        out.row = np.repeat(np.arange(len(out.size), dtype=np.int32), out.size)
        return out

    def dot(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * weights[self.slot], len(self.size))


@dataclass
class Logistic:
    """A linear model of term evidence, of single terms, and of dense columns."""

    odds: np.ndarray
    terms: np.ndarray
    dense: np.ndarray
    bias: float

    def probability(self, rows: Rows, earlier: np.ndarray) -> np.ndarray:
        x = np.concatenate((rows.dot(self.odds)[:, None], rows.dense, earlier), axis=1)
        return 1 / (1 + np.exp(-np.clip(rows.dot(self.terms) + x @ self.dense + self.bias, -40, 40)))


def fit_logistic(rows: Rows, earlier: np.ndarray, y: np.ndarray, steps: int = 300, rate: float = 0.3, ridge: float = 1e-4) -> Logistic:
    """Logistic regression by Adagrad over all rows, on the terms that are evidence by their log-odds in these rows."""
    n = np.bincount(rows.slot, minlength=SLOTS)
    inside = np.bincount(rows.slot, y[rows.row], SLOTS)
    odds = np.log((inside + 0.5) / (y.sum() + 1)) - np.log((n - inside + 0.5) / (len(y) - y.sum() + 1))
    odds[(inside < LEAST_ROWS) | (odds < LEAST_ODDS)] = 0.0
    x = np.concatenate((rows.dot(odds)[:, None], rows.dense, earlier), axis=1)
    model = Logistic(odds, np.zeros(SLOTS), np.zeros(x.shape[1]), 0.0)
    if not len(y) or y.min() == y.max():
        model.bias = 6.0 if len(y) and y[0] else -6.0
        return model
    used = odds[rows.slot] > 0
    names, slot = np.unique(rows.slot[used], return_inverse=True)
    row, value, k = rows.row[used], rows.value[used], len(names)
    w, square = np.zeros(k + x.shape[1] + 1), np.full(k + x.shape[1] + 1, 1e-8)
    for _ in range(steps):
        z = np.bincount(row, value * w[slot], len(y)) + x @ w[k:-1] + w[-1]
        g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / len(y)
        gradient = np.concatenate((np.bincount(slot, value * g[row], k), x.T @ g, [g.sum()])) + ridge * w
        square += gradient * gradient
        w -= rate * gradient / np.sqrt(square)
    model.terms[names], model.dense, model.bias = w[:k], w[k:-1], float(w[-1])
    return model


@dataclass
class Chain:
    """The models of ``CHAIN`` with the scaling of their dense columns and the decision threshold of ``toxic``."""

    mean: np.ndarray
    scale: np.ndarray
    models: list[Logistic] = field(default_factory=list)
    threshold: float = 0.5

    def rows(self, terms: list, numbers: np.ndarray) -> Rows:
        return Rows(terms, np.clip((numbers - self.mean) / self.scale, -4, 4) * 0.25)

    def probabilities(self, rows: Rows) -> np.ndarray:
        out = np.zeros((len(rows.size), 0))
        for model in self.models:
            out = np.concatenate((out, model.probability(rows, out)[:, None]), axis=1)
        return out


def fit_chain(terms: list, numbers: np.ndarray, quality: np.ndarray, toxic: np.ndarray, fold: np.ndarray) -> Chain:
    """Fit the chain. Later models learn from out-of-fold probabilities of the earlier ones, as they meet them in use.

    The threshold of ``toxic`` is where its out-of-fold F1 is best, the middle of equally good ones.
    """
    mean, scale = (numbers.mean(axis=0), numbers.std(axis=0) + 1e-9) if len(numbers) else (np.zeros(len(features.NUMBERS)), np.ones(len(features.NUMBERS)))
    chain = Chain(mean, scale)
    rows = chain.rows(terms, numbers)
    earlier = np.zeros((len(terms), 0))
    for name, y in zip(CHAIN, (~quality, toxic)):
        y = y.astype(np.float64)
        outside = np.full(len(y), 0.5)
        for f in range(FOLDS):
            learn, apply = fold != f, fold == f
            if learn.any() and apply.any():
                outside[apply] = fit_logistic(rows.take(learn), earlier[learn], y[learn]).probability(rows.take(apply), earlier[apply])
        chain.models.append(fit_logistic(rows, earlier, y))
        if name == "toxic" and y.any():
            cuts = np.linspace(0.2, 0.8, 61)
            hits = np.array([((outside >= c) & toxic).sum() for c in cuts])
            f1 = 2 * hits / (np.array([(outside >= c).sum() for c in cuts]) + toxic.sum())
            best = np.flatnonzero(f1 >= f1.max() - 1e-12)
            chain.threshold = float(cuts[best[len(best) // 2]])
        earlier = np.concatenate((earlier, outside[:, None]), axis=1)
    return chain


def classify_documents(docs: DataFrame, labels: DataFrame, most: int = 6_000) -> DataFrame:
    """doc_id, held_out, p_low_quality, p_toxic and toxic (0 or 1) of every document, from its whole text.

    Learned from labels (doc_id, quality, toxic) of rows that are not held out, at most ``most`` of them (the stated bound of the
    sample: those whose ids hash lowest; all where there are fewer). Empty and null texts have no terms and are scored like any
    other. Null doc_ids or labels are not learned from; repeated rows score alike. Only doc_id and text are read; an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    labels = labels.where(~held_out() & F.col("toxic").isNotNull() & F.col("quality").isNotNull())
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "quality", "toxic").limit(most)
    learned = docs.join(F.broadcast(chosen), "doc_id")

    def vectors(batches):
        for pdf in batches:
            terms = [features.term_counts(t) for t in pdf["text"]]
            yield pd.DataFrame({
                "doc_id": pdf["doc_id"], "quality": pdf["quality"], "toxic": pdf["toxic"], "x": [features.numbers(t) for t in pdf["text"]],
                "slots": [s.astype("<i4").tobytes() for s, _ in terms], "counts": [c.astype("<i4").tobytes() for _, c in terms],
            })

    kind = "doc_id long, quality int, toxic int, x array<double>, slots binary, counts binary"
    got = learned.mapInPandas(vectors, kind).toPandas().sort_values(["doc_id", "quality", "toxic"], kind="stable")
    numbers = np.array(got["x"].tolist(), np.float64).reshape(len(got), len(features.NUMBERS))
    terms = [(np.frombuffer(s, "<i4"), np.frombuffer(c, "<i4")) for s, c in zip(got["slots"], got["counts"])]
    fold = (got["doc_id"].to_numpy(np.int64) * 2654435761 >> 8) % FOLDS
    chain = fit_chain(terms, numbers, got["quality"].to_numpy() == 1, got["toxic"].to_numpy() == 1, fold)
    shipped = docs.sparkSession.sparkContext.broadcast(chain)  # SLOTS numbers for each model

    def scored(batches):
        chain = shipped.value
        for pdf in batches:
            for at in text.chunks(pdf["text"].str.len().fillna(0).to_numpy(np.int64), 2_000_000):
                texts = pdf["text"].iloc[at]
                rows = chain.rows([features.term_counts(t) for t in texts], np.array([features.numbers(t) for t in texts]))
                p = chain.probabilities(rows)
                yield pd.DataFrame({
                    "doc_id": pdf["doc_id"].iloc[at], "held_out": pdf["held_out"].iloc[at], "p_low_quality": p[:, 0], "p_toxic": p[:, 1],
                    "toxic": (p[:, 1] >= chain.threshold).astype(np.int32),
                })

    rows = docs.withColumn("held_out", F.coalesce(held_out(), F.lit(False)))
    return rows.mapInPandas(scored, "doc_id long, held_out boolean, p_low_quality double, p_toxic double, toxic int")


def op5_classifier_chain(spark, sf_dir: str) -> DataFrame:
    return classify_documents(text.load(spark, sf_dir, "documents"), text.load(spark, sf_dir, "labels"))
