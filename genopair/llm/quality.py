"""Quality by a vote of the nearest labelled documents in a latent-semantic space.

A text becomes counts of byte pairs and of triples of character shapes, weighted by their rarity
in a bounded sample of labelled texts and projected on the sample's leading singular vectors. The
sample's vectors are broadcast; each block of documents is multiplied with all of them, and the
labels of the most similar ones, weighted by similarity, are averaged.

Defined results: a text without features (null or empty) gets the share of label 1 among labelled
ids; without labelled texts every score is 0; repeated rows get the same score; ties between
neighbours go by their order in the sample; a null id is never held out; other columns are ignored.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genopair.llm.common import Scratch, id_and_text, small
from genopair.llm.labelled import held_out, sample

PER_CLASS = 2000  # labelled texts of either label that vote, at most
BUCKETS = 1024
RANK = 40
NEIGHBOURS = 15
SHARPNESS = 4
THRESHOLD = 0.3
BLOCK = 256

_SHAPE = np.arange(256, dtype=np.uint64)
_SHAPE[[*range(ord("a"), ord("z") + 1), *range(128, 256)]] = ord("a")
_SHAPE[ord("A") : ord("Z") + 1] = ord("A")
_SHAPE[ord("0") : ord("9") + 1] = ord("0")


def _buckets(v: np.ndarray) -> np.ndarray:
    return ((v * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(54)).astype(np.int64)


def features(text: str) -> np.ndarray:
    """Logarithms of one plus the counts of byte pairs and shape triples."""
    raw = np.frombuffer(text.encode("utf-8"), np.uint8)
    s, b = _SHAPE[raw], raw.astype(np.uint64)
    pairs = _buckets(b[:-1] | b[1:] << np.uint64(8))
    triples = _buckets(s[:-2] | s[1:-1] << np.uint64(8) | s[2:] << np.uint64(16)) + BUCKETS
    return np.log1p(np.bincount(np.concatenate([pairs, triples]), minlength=2 * BUCKETS)).astype(np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


class Model:
    """Projection, the sample's vectors and their labels."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, prior: float):
        self.prior = prior
        self.y, self.weight = y, weight
        self.rarity = (np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))) + 0.2).astype(np.float32) if len(x) else np.ones(2 * BUCKETS, np.float32)
        if len(x):
            x = _unit(x * self.rarity)
            basis = np.random.default_rng(0).normal(size=(x.shape[1], min(RANK + 16, len(x)))).astype(np.float32)
            for _ in range(4):
                basis, _ = np.linalg.qr(x.T @ (x @ basis))
            _, _, v = np.linalg.svd(x @ basis, full_matrices=False)
            self.project = (basis @ v.T)[:, :RANK].astype(np.float32)
            self.vectors = _unit(x @ self.project).astype(np.float32)

    def score(self, texts: list[str]) -> np.ndarray:
        x = np.stack([features(t) for t in texts])
        out = np.full(len(texts), self.prior)
        some = np.flatnonzero(x.any(axis=1))
        if not len(self.y) or not len(some):
            return out
        near = _unit((x[some] * self.rarity) @ self.project) @ self.vectors.T
        k = min(NEIGHBOURS, len(self.y))
        top = np.argpartition(-near, k - 1, axis=1)[:, :k]
        vote = np.maximum(np.take_along_axis(near, top, 1), 1e-6).astype(np.float64) ** SHARPNESS * self.weight[top]
        out[some] = (vote * self.y[top]).sum(axis=1) / vote.sum(axis=1)
        return np.clip(out, 0.0, 1.0)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", per_class: int = PER_CLASS, folds: int = 5, fold: int = 0) -> Model:
    """Vectors of the ids outside the held-out fold; the driver gets the sample's features, four kilobytes a text."""
    texts, totals = sample(docs, labels, label_col, per_class, folds, fold)
    texts = Scratch(docs.sparkSession, "quality").write(texts, "sample")

    def run(batches):
        for batch in small(batches):
            rows = [features(t).astype(np.float16).tobytes() for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(rows, pa.binary()), batch["label"]], names=["doc_id", "x", "label"])

    key = texts.schema["doc_id"].dataType.simpleString()
    got = sorted(map(tuple, texts.mapInArrow(run, f"doc_id {key}, x binary, label int").collect()))
    x = np.frombuffer(b"".join(r[1] for r in got), np.float16).astype(np.float32).reshape(-1, 2 * BUCKETS)
    y = np.array([r[2] for r in got], np.float64)
    some = x.any(axis=1)
    x, y = x[some], y[some]
    weight = np.where(y == 1, totals[1] / max(1, (y == 1).sum()), totals[0] / max(1, (y == 0).sum()))
    return Model(x, y, weight, totals[1] / max(1, totals[0] + totals[1]))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    model = fit(docs, labels)

    def run(batches):
        for batch in small(batches):
            texts = batch["text"].to_pylist()
            s = [model.score(texts[k : k + BLOCK]) for k in range(0, len(texts), BLOCK)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(np.concatenate(s) if s else np.zeros(0))], names=["doc_id", "score"])

    docs = id_and_text(docs, id_col, text_col)
    scored = docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
