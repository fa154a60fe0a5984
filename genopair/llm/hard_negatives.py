"""Hard negatives by exact integer inner products in a residue number system.

Components become integers, floor(scale * x). A score is the integer inner product of two rows. Their
residues modulo a few small primes are multiplied as single-precision matrices, in blocks of
components short enough for every sum to be exact; the Chinese remainder theorem gives the signed
score back. As many primes are taken as the longest row needs. Every block of anchors meets every
block of rows, first for the anchors' positives, then, with their scores as windows, for the
negatives; a meeting sends on a few rows for each of its anchors, and these are ranked together.

Defined results: rows without an id or a label, and rows whose vector is null, empty or holds a null
or non-finite component, take no part, neither do vectors of another length than most (the smaller
length of equally frequent ones); zero vectors do take part; of rows that share an id the one with
the smallest label, then vector, counts; ties go to the smaller id; an anchor without positives, or
a positive without negatives, has no rows; an empty table gives an empty table; other columns are
ignored. Scores are longs: a table whose vectors' products can pass 2^62 is refused.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from genopair.llm.common import Scratch
from genopair.llm.vectors import matrix

SCALE = 256
POSITIVES = 5
NEGATIVES = 5
LOW, HIGH = 80, 100  # a negative's score in per cent of the positive's
BLOCK_BYTES = 32 << 20
LEAST_BLOCKS = 32
STEP_CELLS = 1 << 22
LARGEST = 1 << 62
COMPONENTS = 256  # multiplied at a time, so that residues of eight bits add up below 2^24


def primes(product: int, components: int = COMPONENTS) -> list[int]:
    """The largest odd primes, in falling order, whose symmetric residues sum exactly in single precision, until their product passes ``product``."""
    half = math.isqrt(((1 << 24) - 1) // max(1, components))
    found, total, p = [], 1, 2 * half + 1
    while total <= product:
        if p < 3:
            raise ValueError("no set of primes is large enough")
        if all(p % d for d in range(3, math.isqrt(p) + 1, 2)):
            found.append(p)
            total *= p
        p -= 2
    return found


class Residues:
    """Rows of integers modulo each prime, as single-precision matrices of symmetric residues."""

    def __init__(self, rows: np.ndarray, moduli: list[int]):
        self.moduli = moduli
        self.parts = []
        for p in moduli:
            r = rows % p
            self.parts.append(np.where(r > p // 2, r - p, r).astype(np.float32))

    def __getitem__(self, at) -> "Residues":
        out = object.__new__(Residues)
        out.moduli, out.parts = self.moduli, [x[at] for x in self.parts]
        return out


def products(a: Residues, b: Residues) -> np.ndarray:
    """Exact inner products of the rows of ``a`` and ``b``: residues by prime, then mixed-radix digits of the signed whole."""
    width = a.parts[0].shape[1]
    digits: list[np.ndarray] = []
    for k, (p, x, y) in enumerate(zip(a.moduli, a.parts, b.parts)):
        r = np.zeros((len(x), len(y)), np.int64)
        for at in range(0, width, COMPONENTS):
            r += (x[:, at : at + COMPONENTS] @ y[:, at : at + COMPONENTS].T).astype(np.int64)
        for q, d in zip(a.moduli[:k], digits):
            r = (r - d) % p * pow(q, -1, p)
        r %= p
        # Symmetric digits make the whole symmetric around zero, which is what signed scores need.
        digits.append(np.where(r > p // 2, r - p, r))
    out = digits[-1]
    for p, d in zip(a.moduli[-2::-1], digits[-2::-1]):
        out = out * p + d
    return out


def rounded(vectors: DataFrame, label: Column, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, label and v (array of bigint) of the rows that take part, one for each id."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{id_col}`").cast("bigint").alias("vec_id"), label.cast("bigint").alias("label"), v.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0) & finite)
    common = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    rows = rows.where(F.size("v") == (common["d"] if common else 0))
    least = F.min(F.struct("label", "v")).alias("r")
    rows = rows.groupBy("vec_id").agg(least).select("vec_id", "r.label", "r.v")
    return rows.select("vec_id", "label", F.transform("v", lambda x: F.floor(x * F.lit(float(scale)))).alias("v"))


def _blocks(n: int, width: int, least: int) -> int:
    return max(least, -(-n * width * 8 // BLOCK_BYTES))


def _meet(anchors: DataFrame, rows: DataFrame, n_a: int, n_r: int, width: int, run, schema: str) -> DataFrame:
    """``run(anchors, rows)`` for every block of anchors and every block of rows."""
    blocks_a, blocks_r = _blocks(n_a, width, 1), _blocks(n_r, width, LEAST_BLOCKS)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    left = anchors.withColumn("a_block", block(blocks_a)).withColumn("r_block", every(blocks_r))
    right = rows.withColumn("r_block", block(blocks_r)).withColumn("a_block", every(blocks_a))
    key = ["a_block", "r_block"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(run, schema)


def _ints(column: pa.ChunkedArray) -> np.ndarray:
    return matrix(column).astype(np.int64)


def _in_steps(anchors: pa.Table, rows: pa.Table, moduli: list[int]):
    """Sorted ids and labels of the rows, and, for some anchors at a time, their numbers and scores with all rows."""
    rows = rows.sort_by("vec_id")
    right, left = Residues(_ints(rows["v"]), moduli), Residues(_ints(anchors["v"]), moduli)
    step = max(1, STEP_CELLS // max(1, len(rows)))
    parts = ((np.arange(at, min(at + step, len(anchors))), products(left[at : at + step], right)) for at in range(0, len(anchors), step))
    return rows["vec_id"].to_numpy(), rows["label"].to_numpy(), parts


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the k greatest scores, by falling score and then rising number."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((at, -scores[at]))][:k]


def mine(
    vectors: DataFrame,
    anchors: Column,
    label: Column,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    scale: int = SCALE,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    ``anchors`` is a condition on vec_id. An anchor's positives are the ``positives`` best other rows
    of its label; of the rows of other labels with a score from ``low`` to ``high`` per cent of the
    positive's, the best ``negatives`` are returned.
    """
    scratch = Scratch(vectors.sparkSession, "negatives")
    rows = scratch.write(rounded(vectors, label, scale, id_col, vector_col), "rows")
    squares = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d"), F.max(squares).alias("longest")).first()
    # No product of two rows is greater than the longest row's with itself.
    longest = int((size["longest"] or 0.0) * (1 + 2.0**-20)) + 1
    if longest >= LARGEST:
        raise ValueError("products of these vectors do not fit a long")
    moduli, width, n = primes(2 * longest + 1), max(1, size["d"] or 0), size["n"]
    asking = scratch.write(rows.where(anchors), "anchors")
    n_asking = asking.count()

    def near(left: pa.Table, right: pa.Table) -> pa.Table:
        out = ([], [], [])
        if len(left) and len(right):
            ids, labels, parts = _in_steps(left, right, moduli)
            own, own_label = left["vec_id"].to_numpy(), left["label"].to_numpy()
            for who, scores in parts:
                for k, s in zip(who, scores):
                    mates = np.flatnonzero((labels == own_label[k]) & (ids != own[k]))
                    best = mates[_best(s[mates], positives)]
                    out[0].extend([own[k]] * len(best))
                    out[1].extend(ids[best])
                    out[2].extend(s[best])
        return pa.table([pa.array(c, pa.int64()) for c in out], names=["anchor_id", "positive_id", "positive_score"])

    found = _meet(asking, rows, n_asking, n, width, near, "anchor_id bigint, positive_id bigint, positive_score bigint")
    rank = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id"))
    found = scratch.write(found.withColumn("at", rank).where(F.col("at") <= positives), "positives")

    # The positives of one anchor are few, so they go with it as an array.
    windows = found.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("at", "positive_id", "positive_score"))).alias("p"))
    windows = windows.select(F.col("anchor_id").alias("vec_id"), F.col("p.positive_id").alias("p_ids"), F.col("p.positive_score").alias("p_scores"))
    asking = scratch.write(asking.join(windows, "vec_id"), "windows")

    def hard(left: pa.Table, right: pa.Table) -> pa.Table:
        out = ([], [], [], [], [])
        if len(left) and len(right):
            ids, labels, parts = _in_steps(left, right, moduli)
            own, own_label = left["vec_id"].to_numpy(), left["label"].to_numpy()
            p_ids, p_scores = left["p_ids"].to_pylist(), left["p_scores"].to_pylist()
            for who, scores in parts:
                for k, s in zip(who, scores):
                    # Bounds as integers, so that the per cent are exact.
                    bounds = [(-(-low * p // 100), high * p // 100) for p in p_scores[k]]
                    others = np.flatnonzero((labels != own_label[k]) & (s >= min(b[0] for b in bounds)) & (s <= max(b[1] for b in bounds)))
                    for positive, score, (least, most) in zip(p_ids[k], p_scores[k], bounds):
                        inside = others[(s[others] >= least) & (s[others] <= most)]
                        best = inside[_best(s[inside], negatives)]
                        out[0].extend([own[k]] * len(best))
                        out[1].extend([positive] * len(best))
                        out[2].extend([score] * len(best))
                        out[3].extend(ids[best])
                        out[4].extend(s[best])
        return pa.table([pa.array(c, pa.int64()) for c in out], names=["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

    schema = "anchor_id bigint, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint"
    found = _meet(asking, rows, n_asking, n, width, hard, schema)
    rank = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id"))
    found = found.withColumn("rank", rank).where(F.col("rank") <= negatives)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


# The same rows in DuckDB, for the query's anchors and labels.
SQL = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM rows a JOIN rows b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scores USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other)
QUALIFY row_number() OVER w <= 5
"""
