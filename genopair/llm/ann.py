"""Nearest neighbours by inner product over robust-pruned directed graphs, some for each shard.

Every row is indexed. A shard's points are cut into bands of nearly equal length, and each band has a
graph of directions: built by greedy searches from its centre, with distance pruning by a relaxed
factor, which keeps edges that lead different ways. Within a band the largest inner products are
nearly the nearest directions, so a beam search finds them; bands are asked from the longest on, and
one whose longest point cannot reach what a query has found is left out. Finds are scored in double
precision on the original vectors, and the shards' best are ranked together.

Every meeting of queries and a shard is audited: some of the queries are answered by exact products as
well, and the beam is doubled until ``RECALL`` of what these found is found. Where a beam would be a
sizeable part of a band, exact products, which cost no more, take its place.

Defined results: rows that ``vectors.valid`` leaves out neither ask nor are found; equal vectors
are one point with its smallest ids; of rows that share an id and a vector one counts; ties go to
the smaller id; with fewer candidates than asked for all are returned; an empty table gives an
empty table; other columns are ignored.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from genopair.llm.common import Scratch, mix64
from genopair.llm.graph import vamana
from genopair.llm.vectors import build_indexes, matrix, search_indexes, shards_for, valid

NEIGHBOURS = 20
BEAM = 96
ASK = 512
BAND = 1.25  # between the lengths of a band
LEAST_BAND = 512  # points; fewer are compared one by one
EXACT = 8  # a beam of more than one in so many points is given up for exact products
AUDITED = 32
RECALL = 0.97
CELLS = 4 << 20


def _top(scores: np.ndarray, k: int) -> np.ndarray:
    """Columns of each row's k greatest scores, by falling score and then rising column; all if there are fewer."""
    k = min(k, scores.shape[1])
    if k == scores.shape[1]:
        return np.argsort(-scores, axis=1, kind="stable")
    least = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k, None]
    more, tied = scores > least, scores == least
    chosen = more | (tied & (np.cumsum(tied, axis=1) <= k - more.sum(axis=1, keepdims=True)))
    at = np.nonzero(chosen)[1].reshape(len(scores), k)
    return np.take_along_axis(at, np.argsort(-np.take_along_axis(scores, at, 1), axis=1, kind="stable"), 1)


def _lengths(x: np.ndarray) -> np.ndarray:
    greatest = np.abs(x).max(axis=1, initial=0.0)
    return greatest * np.sqrt(((x / greatest[:, None]) ** 2).sum(axis=1))


class Bands:
    """A shard's points, in the order of their ids, by length."""

    def __init__(self, x: np.ndarray, ids: list):
        self.x, self.ids = x, ids
        self.bands = []
        if not len(x):
            return
        length = _lengths(x)
        band = np.floor(np.log(length.max() / length) / np.log(BAND)).astype(np.int64)
        for b in np.unique(band):
            members = np.flatnonzero(band == b)
            graph = vamana((x[members] / length[members, None]).astype(np.float32)) if len(members) > LEAST_BAND else None
            self.bands.append((members, float(length[members].max()), graph))

    def find(self, q: np.ndarray, k: int, beam: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Scores and points of each query's k best, by falling score and then rising point; -inf and -1 where there are fewer.

        Without a beam all products are taken.
        """
        best_s, best_p = np.full((len(q), k), -np.inf), np.full((len(q), k), -1)
        length = _lengths(q)
        for members, longest, graph in self.bands:
            exact = beam is None or graph is None or beam * EXACT > len(members)
            step = max(1, CELLS // len(members)) if exact else ASK
            # the bound is a product of rounded lengths
            asking = np.flatnonzero(longest * length * (1 + 1e-12) >= best_s[:, -1])
            for at in range(0, len(asking), step):
                who = asking[at : at + step]
                if exact:
                    scores = q[who] @ self.x[members].T
                    near = _top(scores, k)
                    points = members[near]
                    found = np.einsum("qnd,qd->qn", self.x[points], q[who])
                else:
                    (index, entry), unit = graph, (q[who] / length[who, None]).astype(np.float32)
                    near, _ = index.search(unit, np.full((len(who), 1), entry), beam)
                    points = np.where(near >= 0, members[np.maximum(near, 0)], -1)
                    found = np.where(near >= 0, np.einsum("qnd,qd->qn", self.x[np.maximum(points, 0)], q[who]), -np.inf)
                both_s, both_p = np.concatenate([best_s[who], found], axis=1), np.concatenate([best_p[who], points], axis=1)
                # equal scores in the order of points, none of which comes twice
                by_point = np.argsort(np.where(both_p < 0, len(self.x), both_p), axis=1, kind="stable")
                both_s, both_p = (np.take_along_axis(x, by_point, 1) for x in (both_s, both_p))
                top = np.argsort(-both_s, axis=1, kind="stable")[:, :k]
                best_s[who], best_p[who] = np.take_along_axis(both_s, top, 1), np.take_along_axis(both_p, top, 1)
        return best_s, best_p

    def audited_beam(self, q: np.ndarray, k: int, beam: int) -> int | None:
        """The beam, doubled until it finds ``RECALL`` of what exact products find; None where only those do."""
        truth, _ = self.find(q, k, None)
        wanted = np.isfinite(truth)
        least = np.where(wanted, truth, np.inf).min(axis=1, keepdims=True, initial=np.inf)
        while beam * EXACT <= max((len(m) for m, _, g in self.bands if g is not None), default=0):
            found, _ = self.find(q, k, beam)
            # equal scores serve alike; products of one pair may differ in the last digit
            hits = (found >= least - 1e-9 * np.abs(least)) & np.isfinite(found)
            if np.minimum(hits.sum(axis=1), wanted.sum(axis=1)).sum() >= RECALL * wanted.sum():
                return beam
            beam *= 2
        return None


def nearest(vectors: DataFrame, asks: Column, k: int = NEIGHBOURS, beam: int = BEAM, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of all rows for each row where ``asks``, a condition on vec_id, holds."""
    scratch = Scratch(vectors.sparkSession, "ann")
    rows = scratch.write(valid(vectors, id_col, vector_col).distinct(), "vectors")
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    shards = shards_for(size["n"], size["d"] or 1)

    # Of equal vectors, the ids that can be among k besides the query's own.
    least = Window.partitionBy("v").orderBy("vec_id")
    ids = rows.withColumn("at", F.row_number().over(least)).where(F.col("at") <= k + 1)
    points = ids.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    points = points.withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int"))

    def build(table: pa.Table):
        order = np.argsort([i[0] for i in table["ids"].to_pylist()], kind="stable")
        table = table.take(pa.array(order))
        return Bands(matrix(table["v"]), table["ids"].to_pylist())

    def search(index: Bands, asked: pa.Table):
        q, q_ids = matrix(asked["v"]), asked["vec_id"].to_numpy()
        sample = np.argsort(mix64(q_ids.view(np.uint64)), kind="stable")[:AUDITED]
        # one point more than asked for: a query's own may be among them
        width = index.audited_beam(q[sample], k + 1, max(beam, 2 * k + 2))
        out = ([], [], [])
        for at in range(0, len(q), ASK):
            scores, points = index.find(q[at : at + ASK], k + 1, width)
            for row, s, own in zip(points, scores, q_ids[at : at + ASK].tolist()):
                found = sorted((-float(sc), i) for p, sc in zip(row.tolist(), s) if p >= 0 for i in index.ids[p] if i != own)[:k]
                out[0].extend([own] * len(found))
                out[1].extend(i for _, i in found)
                out[2].extend(-sc for sc, _ in found)
        return out

    indexes = build_indexes(points, build, shards, scratch)
    queries = rows.where(asks)
    found = search_indexes(indexes, queries, queries.count(), search, "query_id bigint, vec_id bigint, score double", scratch, size["d"] or 1)
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
