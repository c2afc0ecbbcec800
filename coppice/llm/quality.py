"""Quality by positive-unlabelled learning.

A linear model over the form of whole texts is fitted in numpy on trusted positives (labelled 1) and
unlabelled web text, without any negative label. It minimises the non-negative unbiased risk

    pi * R_p(+) + max(0, R_u(-) - pi * R_p(-))

with the logistic loss and an estimated class prior ``pi``: where the second term turns negative,
the step goes back up it. The prior comes from the two samples alone: among unlabelled texts, the
share above a score falls at most as fast as among positives, and the smallest ratio of the two
shares (with a margin for chance) bounds the share of positives from above.

The model is fitted on bounded samples (``sample`` rows of each kind, the first in hash order); every
text of the table is scored.

Defined cases: null and empty texts get the score of a text without words; repeated rows get the
same score; a null id counts as held out by its empty text; without any trusted positive or any
unlabelled text the score is 0.5 everywhere; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coppice.llm.common import fold, keyed, one_text_an_id, ready, slices
from coppice.llm.text_features import NAMES, SHAPES, text_features

#: Rows of each kind that the model is fitted on, at most.
SAMPLE = 12_000
ROUNDS = 600
RATE = 0.05
DECAY = 1e-4


@dataclass
class QualityModel:
    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    prior: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = ((x - self.mean) / self.scale) @ self.weights
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _adam(x: list[np.ndarray], grad, rounds: int) -> np.ndarray:
    w = np.zeros(x[0].shape[1])
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        g = grad(w) + DECAY * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among the unlabelled, from scores that rank positives higher."""
    cuts = np.quantile(positive, np.linspace(0.02, 0.9, 89))
    up = 1 - np.searchsorted(np.sort(unlabelled), cuts, side="left") / len(unlabelled)
    pp = 1 - np.searchsorted(np.sort(positive), cuts, side="left") / len(positive)
    margin = np.sqrt(np.log(40) / 2) * (1 / np.sqrt(len(unlabelled)) + 1 / np.sqrt(len(positive)))
    best = np.argmin((up + margin) / pp)
    return float(np.clip(up[best] / pp[best], 0.05, 0.98))


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None, rounds: int = ROUNDS) -> QualityModel:
    both = np.concatenate([positive, unlabelled])
    mean, scale = both.mean(axis=0), both.std(axis=0) + 1e-3
    mean[0], scale[0] = 0, 1  # the constant
    p, u = (positive - mean) / scale, (unlabelled - mean) / scale
    if prior is None:  # positives against unlabelled, only to rank; then the ratio of shares on the rows left out
        half_p, half_u = len(p) // 2, len(u) // 2
        rank = _adam([p], lambda w: -(p[:half_p].T @ _sigmoid(-(p[:half_p] @ w))) / max(1, half_p) + u[:half_u].T @ _sigmoid(u[:half_u] @ w) / max(1, half_u), rounds // 2)
        prior = estimate_prior(p[half_p:] @ rank, u[half_u:] @ rank)

    def grad(w: np.ndarray) -> np.ndarray:
        zp, zu = p @ w, u @ w
        gp_plus = -(p.T @ _sigmoid(-zp)) / len(p)
        gp_minus, gu_minus = p.T @ _sigmoid(zp) / len(p), u.T @ _sigmoid(zu) / len(u)
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        rest = gu_minus - prior * gp_minus
        return prior * gp_plus + rest if negative >= 0 else -rest

    return QualityModel(_adam([p], grad, rounds), mean, scale, prior)


def _featured(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            x = [text_features(t).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.binary())], names=["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, x binary")


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", sample: int = SAMPLE, folds: int = 5, id_col: str = "doc_id", text_col: str = "text") -> QualityModel | None:
    """Learn from rows outside fold 0: positives as labelled, and a sample of all texts.

    Only ids are sorted and sent (at most ``sample`` of each kind); the texts are read where they
    lie, of each id the text with the least hash, and only their feature rows reach the driver.
    """
    rows, spark = keyed(docs, id_col, text_col), docs.sparkSession
    ready(spark)
    train = F.col("doc_id").isNotNull() & (fold("doc_id", folds) != 0)
    marked = labels.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{label_col}`").alias("y")).filter(train & (F.col("y") == 1))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    sets = []
    for chosen in (marked.select("doc_id").distinct(), rows.filter(train).select("doc_id").distinct()):
        ids = chosen.orderBy(*order).limit(sample)  # bounded by ``sample``
        got = _featured(one_text_an_id(rows.join(F.broadcast(ids), "doc_id", "left_semi"))).select("doc_id", "x").toPandas()
        got = got.sort_values(["doc_id", "x"], kind="stable")
        sets.append(np.frombuffer(b"".join(got["x"]), np.float32).reshape(len(got), len(NAMES) + SHAPES * SHAPES).astype(np.float64))
    if not len(sets[0]) or not len(sets[1]):
        return None
    return fit_nnpu(*sets)


def score(docs: DataFrame, model: QualityModel | None, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """doc_id, the columns named in ``keep``, and quality_score double for every row."""
    ready(docs.sparkSession)
    kept = [F.col(f"`{c}`").alias(f"_keep_{i}") for i, c in enumerate(keep or [])]
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), *kept)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in slices(batches):
            if m is None:
                s = np.full(b.num_rows, 0.5)
            else:
                s = m.scores(np.array([text_features(t) for t in b.column(1).to_pylist()], np.float64))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], names=[*b.schema.names, "quality_score"])

    if not keep:
        rows_out = rows.mapInArrow(lambda it: (pa.RecordBatch.from_arrays([b.column(0), b.column(2)], names=["doc_id", "quality_score"]) for b in run(it)), "doc_id long, quality_score double")
        return rows_out
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    out = rows.mapInArrow(run, f"{kinds}, quality_score double")
    return out.select("doc_id", *[F.col(f"_keep_{i}").alias(c) for i, c in enumerate(keep)], "quality_score")
