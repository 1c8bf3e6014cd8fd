"""Quality scores by Bradley-Terry ranking: preference pairs, logistic loss on feature differences, a quantile as threshold."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanlake.llm import features, text


def held_out() -> Column:
    """Rows whose labels are never learned from."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


#: Folds of the sample: the term evidence of a learned row comes from the rows of the other folds.
FOLDS = 5
#: Inputs of a score: the numbers of a text, the mean log-odds of its terms, and the shares of its terms that speak for and against.
EVIDENCE = ("evidence", "for", "against")
INPUTS = len(features.NUMBERS) + len(EVIDENCE)
#: A term speaks for or against a text if its log-odds are so far from 0, and has any if it is in so many rows.
CLEAR_ODDS, LEAST_ROWS = 1.0, 3


def term_odds(slots: np.ndarray, row: np.ndarray, better: np.ndarray) -> np.ndarray:
    """Log-odds of each term slot to be in a better row, 0 for slots of few rows; ``slots`` and ``row`` list the distinct terms of rows."""
    n = np.bincount(slots, minlength=features.SLOTS)
    inside = np.bincount(slots, better[row].astype(float), features.SLOTS)
    every = np.bincount(row, minlength=len(better)) > 0
    good = (better & every).sum()
    odds = np.log((inside + 0.5) / (good + 1)) - np.log((n - inside + 0.5) / (every.sum() - good + 1))
    odds[n < LEAST_ROWS] = 0.0
    return odds


def evidence(slots: list[np.ndarray], odds: np.ndarray) -> np.ndarray:
    """The term inputs of each text; all 0 without terms."""
    out = np.zeros((len(slots), len(EVIDENCE)))
    for k, s in enumerate(slots):
        if len(s):
            own = odds[s]
            out[k] = own.mean(), (own > CLEAR_ODDS).mean(), (own < -CLEAR_ODDS).mean()
    return out


@dataclass
class Sample:
    """Labelled rows: numbers, distinct term slots, whether better, and fold."""

    numbers: np.ndarray
    slots: list[np.ndarray]
    better: np.ndarray
    fold: np.ndarray

    def inputs(self) -> tuple[np.ndarray, np.ndarray]:
        """(inputs, log-odds of terms): the rows' own evidence is out of fold, the log-odds returned are those of all rows."""
        row = np.repeat(np.arange(len(self.slots)), [len(s) for s in self.slots])
        flat = np.concatenate([np.zeros(0, np.int64), *self.slots]).astype(np.int64)
        terms = np.zeros((len(self.slots), len(EVIDENCE)))
        for f in range(FOLDS):
            here, learn = np.flatnonzero(self.fold == f), self.fold[row] != f
            if len(here):
                others = self.fold != f
                odds = term_odds(flat[learn], (np.cumsum(others) - 1)[row[learn]], self.better[others])
                terms[here] = evidence([self.slots[k] for k in here], odds)
        return np.concatenate((self.numbers, terms), axis=1), term_odds(flat, row, self.better)


@dataclass
class Ranking:
    """Linear scores of standardised features; ``score`` maps them to 0..1 with ``predict_at`` at the threshold."""

    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    threshold: float
    predict_at: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.concatenate((z, z * z), axis=1) @ self.weight

    def score(self, x: np.ndarray) -> np.ndarray:
        shift = np.log(self.predict_at / (1 - self.predict_at))
        return 1 / (1 + np.exp(-np.clip(self.raw(x) - self.threshold + shift, -40, 40)))


def fit(x: np.ndarray, better: np.ndarray, pairs: int = 60_000, ridge: float = 1e-2, predict_at: float = 0.7, seed: int = 11) -> Ranking:
    """Bradley-Terry scores: a row marked ``better`` beats each other row with probability sigmoid(s - s').

    Pairs of a better and another row are drawn with a seed; the logistic loss of their feature differences is minimised by
    Newton steps. The threshold is the quantile of the rows' scores at the share of rows that are not better. Without both kinds
    of rows all weights are 0 and everything scores ``predict_at``.
    """
    mean, scale = (x.mean(axis=0), x.std(axis=0) + 1e-9) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    model = Ranking(mean, scale, np.zeros(2 * len(mean)), 0.0, predict_at)
    good, bad = np.flatnonzero(better), np.flatnonzero(~better)
    if not len(good) or not len(bad):
        return model
    z = np.clip((x - mean) / scale, -8, 8)
    z = np.concatenate((z, z * z), axis=1)
    d, w = pair_differences(z, better, pairs, seed), model.weight
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -40, 40)))
        gradient = d.T @ (p - 1) / pairs + ridge * w
        hessian = (d * (p * (1 - p))[:, None]).T @ d / pairs + (ridge + 1e-6) * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    model.weight = w
    model.threshold = float(np.quantile(model.raw(x), (~better).mean()))
    return model


def pair_differences(z: np.ndarray, better: np.ndarray, pairs: int, seed: int) -> np.ndarray:
    """Differences between the inputs of a better row and another, for pairs drawn with a seed."""
    good, bad = np.flatnonzero(better), np.flatnonzero(~better)
    rng = np.random.default_rng(seed)
    return z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]


def sample_rows(docs: DataFrame, labelled: DataFrame, label: str, most: int) -> Sample:
    """At most ``most`` labelled rows, those whose ids hash lowest; equal hashes go by id, then label.

    Only ids and labels are sorted; the chosen ids, at most ``most``, are sent to the scan of the texts. Terms come to the driver as
    four bytes for each distinct term of a row.
    """
    chosen = labelled.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).alias("_label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "_label").limit(most)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def vectors(batches):
        for pdf in batches:
            slots = [features.term_counts(t)[0].astype("<i4").tobytes() for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "label": pdf["_label"], "x": [features.numbers(t) for t in pdf["text"]], "slots": slots})

    got = rows.mapInPandas(vectors, "doc_id long, label int, x array<double>, slots binary").toPandas().sort_values(["doc_id", "label"], kind="stable")
    x = np.array(got["x"].tolist(), np.float64).reshape(len(got), len(features.NUMBERS))
    fold = (got["doc_id"].to_numpy(np.int64) * 2654435761 >> 8) % FOLDS
    return Sample(x, [np.frombuffer(s, "<i4") for s in got["slots"]], got["label"].to_numpy() == 1, fold)


def score_documents(docs: DataFrame, labels: DataFrame, most: int = 20_000, predict_at: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted of every document.

    Learned from ``labels`` (doc_id, quality) of rows that are not held out, at most ``most`` of them (a stated bound of the
    sample; with fewer labels all are used). Inputs are numbers of the text and what its terms say, by their log-odds in the sample. Empty
    and null texts have all inputs 0 and are scored like any other. Texts of any length are read whole. A null doc_id is not held out and not learned from; repeated rows score alike; without
    labels all score ``predict_at``. Only doc_id and text are read; an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(~held_out())
    sample = sample_rows(docs, labels, "quality", most)
    inputs, odds = sample.inputs()
    model = fit(inputs, sample.better, predict_at=predict_at)
    shipped = docs.sparkSession.sparkContext.broadcast(odds)  # SLOTS numbers

    def scored(batches):
        for pdf in batches:
            x = np.array([features.numbers(t) for t in pdf["text"]]).reshape(len(pdf), len(features.NUMBERS))
            x = np.concatenate((x, evidence([features.term_counts(t)[0] for t in pdf["text"]], shipped.value)), axis=1)
            score = model.score(x)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "held_out": pdf["held_out"], "score": score, "predicted": (score >= predict_at).astype(np.int32)})

    rows = docs.withColumn("held_out", F.coalesce(held_out(), F.lit(False)))
    return rows.mapInPandas(scored, "doc_id long, held_out boolean, score double, predicted int")


def op1_bradley_terry(spark, sf_dir: str) -> DataFrame:
    return score_documents(text.load(spark, sf_dir, "documents"), text.load(spark, sf_dir, "labels"))
