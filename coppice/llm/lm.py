"""Language-model scoring with a log-bilinear model trained by noise-contrastive estimation.

Counts come from every training document: c, N and V. The VOCABULARY most frequent tokens are the
model's own words; all others share one class. The model predicts a class from the two tokens before
it: s(w | u, v) = b_w + (A_u + B_v) . T_w. It is trained in numpy by noise-contrastive estimation
with the unigram distribution as noise, in rounds: each partition starts from the same parameters,
runs over all its training tokens and returns its parameters, which are averaged by tokens seen. So
what training reads and sends grows with the corpus, and no task holds more than its own part.

Scoring is normalised: with exp(A T) and exp(B T) as matrices, one matrix product gives the
normaliser of every pair of context words at once. A word outside the vocabulary has the class's
probability times its smoothed share of the class, so the probabilities of all words add up to one
(with one share for all unseen words).

Words outside the vocabulary need their counts. The FREQUENT commonest are sent to the tasks, the
others meet their counts in a join on the word; nothing grows on the driver.

Defined cases: a null or empty text is its end token alone; without training documents N and V are 0
and every token has the same probability; repeated rows get equal scores; an empty table gives no
row.
"""

from __future__ import annotations

import io
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coppice.llm.common import fold, keyed, lower_words, ready, settle, slices, utf8

#: Classes of the model: the words, one for the end of a text, one for all other words.
VOCABULARY = 2046
#: Commonest words whose counts are sent to the tasks.
FREQUENT = 200_000
DIM = 24
NOISE = 64
BATCH = 4096
RATE = 0.02
ROUNDS = 1
SMOOTH = 0.1
#: Distinct words that a task gathers before it hands them on.
FLUSH = 400_000
END = b"\n"  # white space: no word equals it
OTHER_ID, END_ID = 0, 1


@dataclass
class Model:
    a: np.ndarray  # nearest context word
    b: np.ndarray  # the one before
    t: np.ndarray
    bias: np.ndarray

    def pack(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, a=self.a, b=self.b, t=self.t, bias=self.bias)
        return out.getvalue()

    @staticmethod
    def unpack(raw: bytes) -> Model:
        with np.load(io.BytesIO(raw)) as z:
            return Model(z["a"], z["b"], z["t"], z["bias"])


def start_model(unigram: np.ndarray, dim: int = DIM) -> Model:
    r = np.random.default_rng(0)
    n = len(unigram)
    make = lambda: r.normal(0, 0.1, (n, dim)).astype(np.float32)
    return Model(make(), make(), make(), np.log(unigram).astype(np.float32))


def contexts(ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The token before and the one before that; a text starts after end marks."""
    one = np.concatenate([[END_ID], ids[:-1]])
    one[ends[:-1]] = END_ID
    two = np.concatenate([[END_ID], one[:-1]])
    two[ends[:-1]] = END_ID
    return one, two


class _Steps:
    """AdaGrad: each parameter's step shrinks with the gradients it has had."""

    def __init__(self, model: Model):
        self.parts = {"a": model.a, "b": model.b, "t": model.t, "bias": model.bias[:, None]}
        self.had = {k: np.full(x.shape, 1e-6, np.float32) for k, x in self.parts.items()}

    def add(self, part: str, ids: np.ndarray, grads: np.ndarray, rate: float) -> None:
        order = np.argsort(ids, kind="stable")
        s = ids[order]
        first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        total, at = np.add.reduceat(grads[order], first, axis=0), s[first]
        had = self.had[part][at] + total * total
        self.had[part][at] = had
        self.parts[part][at] += rate * total / np.sqrt(had)


def train(model: Model, ids: np.ndarray, ends: np.ndarray, unigram: np.ndarray, seed: int, rate: float = RATE, steps: _Steps | None = None) -> Model:
    """One pass of noise-contrastive estimation over a run of texts (``ends``: where each ends)."""
    r, steps = np.random.default_rng(seed), steps or _Steps(model)
    one, two = contexts(ids, ends)
    cdf, log_noise = np.cumsum(unigram), np.log(NOISE * unigram).astype(np.float32)
    order = r.permutation(len(ids))
    for lo in range(0, len(ids), BATCH):
        at = order[lo : lo + BATCH]
        u, v, w = one[at], two[at], ids[at]
        noise = np.minimum(np.searchsorted(cdf, r.random(NOISE)), len(unigram) - 1)
        q, tw, tn = model.a[u] + model.b[v], model.t[w], model.t[noise]
        up = np.einsum("ij,ij->i", q, tw) + model.bias[w] - log_noise[w]
        down = q @ tn.T + (model.bias[noise] - log_noise[noise])
        gu = (1 / (1 + np.exp(np.clip(up, -30, 30)))).astype(np.float32)  # the data: towards 1
        gd = (-1 / (1 + np.exp(-np.clip(down, -30, 30)))).astype(np.float32)  # the noise: towards 0
        gq = gu[:, None] * tw + gd @ tn
        both, gt = np.concatenate([w, noise]), np.concatenate([gu[:, None] * q, gd.T @ q])
        steps.add("t", both, gt, rate)
        steps.add("a", u, gq, rate)
        steps.add("b", v, gq, rate)
        steps.add("bias", both, np.concatenate([gu, gd.sum(axis=0)])[:, None], rate)
    return model


class Scorer:
    """Normalised log10 probabilities from table look-ups."""

    def __init__(self, model: Model):
        self.first = (model.a @ model.t.T).astype(np.float32)
        self.second = (model.b @ model.t.T).astype(np.float32)
        shift = model.bias.max()
        bias = np.exp(model.bias - shift)
        m1, m2 = self.first.max(axis=1, keepdims=True), self.second.max(axis=1, keepdims=True)
        z = (np.exp(self.first - m1) * bias) @ np.exp(self.second - m2).T
        self.log_z = np.log(z) + m1 + m2.T + shift
        self.bias = model.bias

    def log10(self, ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
        u, v = contexts(ids, ends)
        return (self.bias[ids] + self.first[u, ids] + self.second[v, ids] - self.log_z[u, v]).astype(np.float64) / np.log(10)


_SCORERS: dict[int, Scorer] = {}


def _ids(texts: list[bytes | None], vocabulary: dict[bytes, int]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    words = [[*lower_words(t), END] for t in texts]
    ends = np.cumsum([len(w) for w in words])
    get = vocabulary.get
    ids = np.fromiter((get(x, OTHER_ID) for w in words for x in w), np.int64, int(ends[-1]) if len(ends) else 0)
    return words, ids, ends


def word_counts(docs: DataFrame) -> DataFrame:
    """word binary, n long over the whole table; the end of a text counts as a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        give = lambda: pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
        for b in slices(batches):
            for t in utf8(b.column(1)):
                seen.update(lower_words(t))
            seen[END] += b.num_rows
            if len(seen) >= FLUSH:
                yield give()
                seen.clear()
        yield give()

    return docs.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def score(docs: DataFrame, folds: int = 10, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT, vocabulary: int = VOCABULARY) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row; fold 0 is held out of all counts and training."""
    spark = docs.sparkSession
    ready(spark)
    rows = keyed(docs, id_col, text_col)
    train_rows = rows.filter(fold("doc_id", folds) != 0)
    counts = settle(word_counts(train_rows))
    total, distinct = counts.agg(F.sum("n"), F.count("n")).first()
    total = total or 0
    top = counts.orderBy(F.desc("n"), "word").limit(frequent).toPandas()  # bounded by ``frequent``
    top_words, top_n = [bytes(w) for w in top["word"]], top["n"].to_numpy(np.int64)
    own = [i for i, w in enumerate(top_words) if w != END][:vocabulary]
    end_n = int(top_n[top_words.index(END)]) if END in top_words else 0
    if not end_n and total:
        end_n = int(counts.filter(F.col("word") == F.lit(bytearray(END))).agg(F.sum("n")).first()[0] or 0)
    model_words = {top_words[i]: k + 2 for k, i in enumerate(own)}
    model_words[END] = END_ID
    class_n = np.array([0, end_n, *[int(top_n[i]) for i in own]], np.float64)
    other_n, other_v = total - class_n.sum(), distinct - len(own) - bool(end_n)
    class_n[OTHER_ID] = other_n
    unigram = (class_n + SMOOTH) / (class_n + SMOOTH).sum()
    base_den, other_den = np.log10(total + SMOOTH * (distinct + 1)), np.log10(other_n + SMOOTH * (other_v + 1))

    sent_words = spark.sparkContext.broadcast((model_words, dict(zip(top_words, top_n.tolist()))))
    model = start_model(unigram)
    for k in range(ROUNDS if total else 0):
        model = _train_round(train_rows, model, sent_words, unigram, k)
    sent_model = spark.sparkContext.broadcast(model.pack())
    name = hash(sent_model.value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[name] = Scorer(Model.unpack(sent_model.value))
        scorer, (ours, common) = _SCORERS[name], sent_words.value
        for b in slices(batches):
            words, ids, ends = _ids(utf8(b.column(1)), ours)
            cuts = np.concatenate([[0], ends])
            p = np.concatenate([[0], np.cumsum(scorer.log10(ids, ends))])
            c = np.fromiter((common.get(x, 0) for w in words for x in w), np.int64, len(ids))
            known = c > 0
            logs = np.where(known, np.log10(c + SMOOTH), 0.0)
            a, n, o = np.concatenate([[0], np.cumsum(logs)]), np.concatenate([[0], np.cumsum(known)]), np.concatenate([[0], np.cumsum(ids == OTHER_ID)])
            oa = np.concatenate([[0], np.cumsum(np.where(ids == OTHER_ID, logs, 0.0))])
            part = lambda s: s[ends] - s[cuts[:-1]]
            rare = [list(Counter(x for x in w if x not in common).items()) for w in words]
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array(np.diff(cuts)), pa.array(part(n)), pa.array(part(a)), pa.array(part(p)), pa.array(part(o)), pa.array(part(oa)),
                pa.array(rare, pa.list_(pa.struct([("word", pa.binary()), ("m", pa.int64())]))),
            ], names=["doc_id", "n_tokens", "n_known", "logs", "p", "n_other", "other_logs", "rare"])

    half = rows.mapInArrow(run, "doc_id long, n_tokens long, n_known long, logs double, p double, n_other long, other_logs double, rare array<struct<word:binary,m:long>>")
    half = settle(half.withColumn("_row", F.monotonically_increasing_id()))  # written: the row numbers hold from here on
    rare = half.select("_row", F.explode("rare").alias("r")).select("_row", "r.word", "r.m")
    common_n = int(top_n.min()) if len(top_n) == frequent else 1
    found = rare.join(counts.filter(F.col("n") <= common_n), "word", "left")
    rare_sums = found.groupBy("_row").agg(F.sum(F.col("m") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(SMOOTH))).alias("rare_logs"), F.sum(F.when(F.col("n").isNotNull(), F.col("m")).otherwise(0)).alias("rare_known"))
    out = half.drop("rare").join(rare_sums, "_row", "left").na.fill(0, ["rare_logs", "rare_known"])
    return out.select(
        "doc_id", (fold("doc_id", folds) == 0).alias("held_out"), "n_tokens", (F.col("n_known") + F.col("rare_known")).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("logs") + F.col("rare_logs") - F.col("n_tokens") * F.lit(float(base_den))).alias("base_score"),
        (F.col("p") + F.col("other_logs") + F.col("rare_logs") - F.col("n_other") * F.lit(float(other_den))).alias("score"),
    )


def _train_round(docs: DataFrame, model: Model, sent_words, unigram: np.ndarray, k: int) -> Model:
    """Every partition trains on all its tokens from the same start; parameters are averaged by tokens."""
    sent = docs.sparkSession.sparkContext.broadcast(model.pack())
    rate = RATE / (1 + k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = Model.unpack(sent.value), 0
        steps = _Steps(own)
        for b in slices(batches):
            _, ids, ends = _ids(utf8(b.column(1)), sent_words.value[0])
            own = train(own, ids, ends, unigram, seen + 1 + 7919 * k, rate, steps)
            seen += len(ids)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([seen], pa.int64()), pa.array([own.pack()], pa.binary())], names=["n", "params"])

    got = settle(docs.mapInArrow(run, "n long, params binary"))  # all partitions train at once; the results are read one by one
    mean, n = None, 0
    for r in got.toLocalIterator():  # one set of parameters at a time
        x, w = Model.unpack(bytes(r["params"])), r["n"]
        n += w
        if mean is None:
            mean = x
        else:
            for name in ("a", "b", "t", "bias"):
                setattr(mean, name, getattr(mean, name) + (getattr(x, name) - getattr(mean, name)) * (w / n))
    return mean or model
