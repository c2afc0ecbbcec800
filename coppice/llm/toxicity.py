"""Toxicity by classifier chains.

The categories are label columns, in order. Each gets a logistic model over the words of whole texts
and their beginnings of PREFIXES letters (so that words of one stem count together), and each model after the first also gets the probabilities of the categories before it. For fitting,
those probabilities are out-of-fold predictions: the sample is cut into FOLDS parts by hash, and each
part is scored by a model fitted on the others, so that later models learn from predictions as good
as the ones they will get. Words and beginnings are chosen per category: the WORDS whose share of documents differs
most, by its z value, between rows with and without the category.

The models are fitted on a bounded sample of labelled rows (``sample``, the first in hash order) with
numpy; every text of the table is scored by the whole chain.

Defined cases: null and empty texts are scored as texts without words; a null label leaves the row
out of that category's fit; a category without both values has its share as the probability of every
row (0.5 without any label); repeated rows get equal scores; an empty table gives no row.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coppice.llm.common import keyed, one_text_an_id, ready, slices
from coppice.llm.text_features import NAMES, text_features

SAMPLE = 12_000
WORDS = 400
PREFIXES = (4, 5, 6, 7)
FOLDS = 5
ROUNDS = 300
RATE = 0.1
DECAY = 3e-4
_WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def features(word: str) -> list[str]:
    """The word and its beginnings, which end in a star; a word as long as a beginning is one of its kind."""
    return [word, *[word[:k] + "*" for k in PREFIXES if len(word) >= k]]


def feature_counts(text: str | None) -> Counter[str]:
    out: Counter[str] = Counter()
    for w, n in Counter(words(text)).items():
        for f in features(w):
            out[f] += n
    return out


@dataclass
class Link:
    """One category: its words and beginnings, its weights (these, form of the text, earlier categories) or a fixed probability."""

    vocabulary: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray | None = None
    fixed: float = 0.5

    def inputs(self, counts: list[Counter], form: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        x = np.zeros((len(counts), len(self.vocabulary)))
        for i, c in enumerate(counts):
            for w in c.keys() & self.vocabulary.keys():
                x[i, self.vocabulary[w]] = np.log1p(c[w])
        return np.hstack([x, form, earlier])

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.fixed) if self.weights is None else _sigmoid(x @ self.weights)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    w, m, v = np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for t in range(1, ROUNDS + 1):
        g = x.T @ (_sigmoid(x @ w) - y) / len(y) + DECAY * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


class Occurrences:
    """What the rows of a sample hold: row number, feature number and count for each distinct word or beginning of a text."""

    def __init__(self, texts: list[str | None]):
        number: dict[str, int] = {}
        word, count, sizes = array("i"), array("i"), []
        for t in texts:
            c = feature_counts(t)
            word.extend([number.setdefault(f, len(number)) for f in c])
            count.extend(c.values())
            sizes.append(len(c))
        self.names = sorted(number)
        place = np.empty(len(number), np.int32)
        place[np.fromiter((number[f] for f in self.names), np.int64, len(number))] = np.arange(len(number), dtype=np.int32)
        self.word = place[np.frombuffer(word, np.int32)] if len(word) else np.zeros(0, np.int32)
        self.count = np.frombuffer(count, np.int32) if len(count) else np.zeros(0, np.int32)
        self.row = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)

    def inputs(self, vocabulary: dict[str, int], rows: np.ndarray, form: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        """What ``Link.inputs`` gives for these rows of the sample."""
        column, place = np.full(len(self.names), -1, np.int32), np.full(len(form), -1, np.int32)
        column[[bisect_left(self.names, f) for f in vocabulary]] = list(vocabulary.values())
        place[rows] = np.arange(len(rows))
        use = np.flatnonzero(column[self.word] >= 0)
        use = use[place[self.row[use]] >= 0]
        x = np.zeros((len(rows), len(vocabulary)))
        x[place[self.row[use]], column[self.word[use]]] = np.log1p(self.count[use])
        return np.hstack([x, form[rows], earlier[rows]])

    def choose(self, y: np.ndarray, rows: np.ndarray, k: int = WORDS) -> dict[str, int]:
        """The ``k`` words and beginnings whose share of documents differs most between the labels of ``rows``; ties in order of the names."""
        mark = np.full(len(y), -1, np.int8)
        mark[rows] = y[rows] != 0
        n1, n0 = max(1, int((mark == 1).sum())), max(1, int((mark == 0).sum()))
        a, b = (np.bincount(self.word[mark[self.row] == v], minlength=len(self.names)) for v in (1, 0))
        share = (a + b + 1) / (n1 + n0 + 2)
        z = np.abs(a / n1 - b / n0) / np.sqrt(share * (1 - share) * (1 / n1 + 1 / n0))
        best = np.argsort(-z, kind="stable")
        best = best[(a + b)[best] > 0][:k]
        return {self.names[j]: i for i, j in enumerate(best.tolist())}


def fit_chain(texts: list[str], labels: np.ndarray, parts: np.ndarray) -> list[Link]:
    """``labels``: a column per category, NaN where unknown; ``parts``: the fold of each row."""
    held = Occurrences(texts)
    form = np.array([text_features(t)[: len(NAMES)] for t in texts]).reshape(len(texts), len(NAMES))
    earlier, chain = np.zeros((len(texts), 0)), []
    for j in range(labels.shape[1]):
        y, known = labels[:, j], ~np.isnan(labels[:, j])
        if not known.any() or y[known].min() == y[known].max():
            chain.append(Link(fixed=float(y[known].mean()) if known.any() else 0.5))
            earlier = np.hstack([earlier, np.full((len(texts), 1), chain[-1].fixed)])
            continue
        whole = np.flatnonzero(known)
        out = np.zeros(len(texts))
        for f in range(FOLDS):
            fit, rest = whole[parts[whole] != f], np.flatnonzero(parts == f)
            if not len(rest):
                continue
            if not len(fit) or y[fit].min() == y[fit].max():
                out[rest] = y[whole].mean()
                continue
            link = _fit_link(held, form, earlier, y, fit)
            out[rest] = link.predict(held.inputs(link.vocabulary, rest, form, earlier))
        chain.append(_fit_link(held, form, earlier, y, whole))
        earlier = np.hstack([earlier, out[:, None]])
    return chain


def _fit_link(held: Occurrences, form: np.ndarray, earlier: np.ndarray, y: np.ndarray, rows: np.ndarray) -> Link:
    link = Link(held.choose(y, rows))
    link.weights = _logistic(held.inputs(link.vocabulary, rows, form, earlier), y[rows])
    return link


def predict_chain(chain: list[Link], texts: list[str | None]) -> np.ndarray:
    known = set().union(*(link.vocabulary for link in chain))
    seen: dict[str, list[str]] = {}  # the chosen features of each word of these texts
    counts = []
    for t in texts:
        c: Counter[str] = Counter()
        for w, n in Counter(words(t)).items():
            own = seen.get(w)
            if own is None:
                own = seen[w] = [f for f in features(w) if f in known]
            for f in own:
                c[f] += n
        counts.append(c)
    form = np.array([text_features(t)[: len(NAMES)] for t in texts]).reshape(len(texts), len(NAMES))
    got = np.zeros((len(texts), 0))
    for link in chain:
        p = link.predict(link.inputs(counts, form, got)) if link.weights is not None else np.full(len(texts), link.fixed)
        got = np.hstack([got, p[:, None]])
    return got


def fit(docs: DataFrame, labels: DataFrame, categories: list[str], sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> list[Link]:
    """Fit the chain on at most ``sample`` labelled rows; only their texts reach the driver."""
    ready(docs.sparkSession)
    marks = [F.col(f"`{c}`").cast("double").alias(f"_y{i}") for i, c in enumerate(categories)]
    chosen = labels.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), *marks).filter("doc_id is not null")
    chosen = chosen.groupBy("doc_id").agg(F.min(F.struct(*[f"_y{i}" for i in range(len(categories))])).alias("y")).select("doc_id", "y.*")
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # bounded by ``sample``
    texts = keyed(docs, id_col, text_col).join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi")
    rows = one_text_an_id(texts).join(F.broadcast(chosen), "doc_id").toPandas().sort_values("doc_id", kind="stable")
    y = rows[[f"_y{i}" for i in range(len(categories))]].to_numpy(np.float64)
    parts = (rows["doc_id"].to_numpy(np.int64) * 2654435761 % 2**32 * FOLDS // 2**32) if len(rows) else np.zeros(0, np.int64)
    return fit_chain(rows["text"].tolist(), y, parts)


def predict(docs: DataFrame, chain: list[Link], categories: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and p_<category> double for every row."""
    sent = docs.sparkSession.sparkContext.broadcast(chain)
    names = ["doc_id", *[f"p_{c}" for c in categories]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            p = predict_chain(sent.value, b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(p[:, j], pa.float64()) for j in range(len(categories))]], names=names)

    return keyed(docs, id_col, text_col).mapInArrow(run, "doc_id long, " + ", ".join(f"`p_{c}` double" for c in categories))
