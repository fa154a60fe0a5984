"""Toxicity by a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text's features are the different 4- and 5-grams of its lower-cased UTF-8 bytes, hashed. On a
bounded sample of labelled texts each gets the log of the ratio of its smoothed shares among
toxic and other texts; the n-grams that separate best, scaled by that ratio, feed a logistic
regression. A text is scored by all of it, in one pass over the documents.

Defined results: null and empty texts have no n-grams and get the score of the intercept; without
labelled texts every score is 0; with one label only, every score is that label; repeated rows
get the same score; a null id is never held out; other columns are ignored.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genopair.llm.common import Scratch, id_and_text, restored, small
from genopair.llm.labelled import held_out, sample

PER_CLASS = 5000  # labelled texts of either label that the model is fitted on, at most
BITS = 20
FEATURES = 8192
SURETY = 3.0  # standard deviations between the shares of a chosen n-gram
LEAST_RATIO = 0.7
THRESHOLD = 0.3
ORDERS = (4, 5)
SALTS = {n: np.uint64(n * 0xD1B54A32D192ED03 & (1 << 64) - 1) for n in ORDERS}


def ngrams(text: str) -> np.ndarray:
    """Buckets of all n-grams of a text, with repetitions."""
    b = np.frombuffer(text.lower().encode("utf-8"), np.uint8).astype(np.uint64)
    out = []
    for n in ORDERS:
        if len(b) >= n:
            v = b[: len(b) - n + 1].copy()
            for j in range(1, n):
                v |= b[j : len(b) - n + 1 + j] << np.uint64(8 * j)
            out.append((v * np.uint64(0x9E3779B97F4A7C15) + SALTS[n]) >> np.uint64(64 - BITS))
    return np.concatenate(out).astype(np.int32) if out else np.zeros(0, np.int32)


class _Distinct:
    """Different values of small arrays, by a table of last positions instead of sorting."""

    def __init__(self):
        self.last = np.zeros(1 << BITS, np.int32)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        at = np.arange(len(x), dtype=np.int32)
        self.last[x] = at
        return x[self.last[x] == at]


class Model:
    """Intercept and one weight for each of the chosen buckets."""

    def __init__(self, intercept: float, buckets: np.ndarray, weights: np.ndarray):
        self.intercept = intercept
        self.table = np.zeros(1 << BITS, np.float32)
        self.table[buckets] = weights

    def scorer(self):
        used, distinct = self.table != 0, _Distinct()

        def score(text: str) -> float:
            x = ngrams(text)
            z = self.intercept + float(self.table[distinct(x[used[x]])].sum(dtype=np.float64))
            return 0.0 if z == -np.inf else float(1.0 / (1.0 + np.exp(-max(-60.0, min(60.0, z)))))

        return score


def _logistic(rows, values, y, weight, n_features, penalty=1e-3, steps=400):
    """Weighted, penalised logistic regression on sparse binary rows, by accelerated gradient steps.

    ``values`` scales each feature; ``rows`` is a list of arrays of feature numbers.
    """
    n = len(rows)
    col = np.concatenate(rows) if n else np.zeros(0, np.int32)
    row = np.repeat(np.arange(n), [len(r) for r in rows])
    x = values[col]
    w, b = np.zeros(n_features), 0.0
    weight = weight / weight.sum()
    lipschitz = 0.25 * float((weight * (1 + np.bincount(row, x * x, n))).sum()) + penalty
    w_look, b_look, t = w.copy(), b, 1.0
    for _ in range(steps):
        z = np.bincount(row, x * w_look[col], n) + b_look
        g = weight * (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y)
        new_w = w_look - (np.bincount(col, x * g[row], n_features) + penalty * w_look) / lipschitz
        new_b = b_look - g.sum() / lipschitz
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        k = (t - 1) / t_next
        w_look, b_look = new_w + k * (new_w - w), new_b + k * (new_b - b)
        w, b, t = new_w, new_b, t_next
    return w * values, b


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", per_class: int = PER_CLASS, folds: int = 4, fold: int = 2) -> Model:
    """Train on the ids outside the held-out fold. The driver gets one count pair for each bucket and, of the
    sample's texts, the numbers of chosen features."""
    texts, totals = sample(docs, labels, label_col, per_class, folds, fold)
    none = np.zeros(0, np.int64)
    if not totals[0] or not totals[1]:
        return Model(60.0 if totals[1] else -np.inf, none, none)
    texts = Scratch(docs.sparkSession, "toxicity").write(texts, "sample")

    def count(batches):
        seen, distinct = np.zeros((2, 1 << BITS), np.int64), _Distinct()
        for batch in small(batches):
            for text, y in zip(batch["text"].to_pylist(), batch["label"].to_pylist()):
                seen[y, distinct(ngrams(text))] += 1
        found = np.flatnonzero(seen.any(axis=0))
        for at in range(0, len(found), 1 << 16):
            f = found[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(f), pa.array(seen[0, f]), pa.array(seen[1, f])], names=["bucket", "n0", "n1"])

    counts = texts.mapInArrow(count, "bucket bigint, n0 bigint, n1 bigint").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    counts = counts.where("n0 + n1 >= 3").toArrow().sort_by("bucket")
    bucket, n0, n1 = (counts[c].to_numpy() for c in ("bucket", "n0", "n1"))
    p, q = (n1 + 1.0), (n0 + 1.0)
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    have = min(totals[0], per_class), min(totals[1], per_class)
    # Of the n-grams whose shares differ by more than chance and by a sizeable ratio, the surest.
    share = (n0 + n1) / sum(have)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / have[0] + 1 / have[1]))
    surety = np.abs(n1 / have[1] - n0 / have[0]) / spread
    good = np.flatnonzero((surety >= SURETY) & (np.abs(ratio) >= LEAST_RATIO))
    chosen = np.sort(good[np.argsort(-surety[good], kind="stable")[:FEATURES]])
    buckets, ratio = bucket[chosen], ratio[chosen]

    def features(batches):
        number, distinct = np.full(1 << BITS, -1, np.int32), _Distinct()
        number[buckets] = np.arange(len(buckets))
        for batch in small(batches):
            rows = []
            for text in batch["text"].to_pylist():
                x = ngrams(text)
                rows.append(np.sort(number[distinct(x[number[x] >= 0])]).tolist())
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.int32())), batch["label"]], names=["features", "label"])

    got = texts.mapInArrow(features, "features array<int>, label int").toArrow()
    rows = [np.array(r, np.int64) for r in got["features"].to_pylist()]
    y = got["label"].to_numpy().astype(np.float64)
    order = sorted(range(len(rows)), key=lambda i: (y[i], rows[i].tolist()))
    rows, y = [rows[i] for i in order], y[order]
    weight = np.where(y == 1, totals[1] / max(1, (y == 1).sum()), totals[0] / max(1, (y == 0).sum()))
    w, b = _logistic(rows, ratio, y, weight, len(buckets))
    return Model(float(b), buckets, w)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id and score of every whole text, and the columns named in ``keep``, text among them as it was."""
    rest = tuple(c for c in keep if c not in (id_col, text_col))
    frame = id_and_text(docs, id_col, text_col, rest, empty_for_null=False)

    def run(batches):
        of = model.scorer()
        for batch in small(batches):
            s = pa.array([of(t or "") for t in batch["text"].to_pylist()], pa.float64())
            names = [c for c in batch.schema.names if c != "text" or text_col in keep]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), s], names=[*names, "score"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in frame.schema if f.name != "text" or text_col in keep)
    out = frame.mapInArrow(run, f"{schema}, score double")
    return out.select("doc_id", "score", *([F.col("text").alias(text_col)] if text_col in keep else []), *restored(rest, results=("doc_id", "score")))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
