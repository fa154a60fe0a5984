"""Best-fit packing of token sequences by exact-complement hashing.

A piece is decided by its length alone, so the plan is made on the histogram of lengths, whose
size is bounded by the capacity, and never sees the pieces. For each length, longest first, the
gap it leaves is looked up among single lengths, sums of two and sums of three; combinations
that fill it exactly are consumed as often as all of them are available. What is left is placed
best-fit. Each row of the plan says which ranks of a length go where; pieces are ranked within
their length in buckets, so a length that a third of all pieces share is no single group.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from genopair.llm.bpe import encoder
from genopair.llm.common import Scratch, id_and_text, small

CAPACITY = 2048
PIECES_PER_BUCKET = 1 << 20
LEAST_BUCKETS = 128


def cut(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of every whole text's ids with one id 0 after them: doc_id, piece, start, length, ids_crc32.

    Only a text of more than ``capacity`` ids is cut; a null or empty text is one piece of length 1.
    """

    def run(batches):
        enc = encoder(tokenizer)
        for batch in small(batches):
            rows = []
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                ids = enc.encode(text) + b"\0\0\0\0"
                n = len(ids) // 4
                for piece, start in enumerate(range(0, n, capacity)):
                    length = min(capacity, n - start)
                    rows.append((doc, piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
            cols = list(zip(*rows)) or [()] * 5
            types = (batch.schema.field("doc_id").type, pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    docs = id_and_text(docs, id_col, text_col)
    key = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {key}, piece int, start bigint, length bigint, ids_crc32 bigint")


class _Plan:
    """Patterns of lengths with the number of sequences that follow each."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        self.left = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            self.left[length] = n
        self.patterns: list[tuple[list[tuple[int, int]], int]] = []
        self._exact()
        self._best_fit()

    def _use(self, lengths: list[int]) -> bool:
        """Consume a combination as often as it is available."""
        need: dict[int, int] = {}
        for x in lengths:
            need[x] = need.get(x, 0) + 1
        times = min(int(self.left[x]) // n for x, n in need.items())
        if times:
            for x, n in need.items():
                self.left[x] -= n * times
            self.patterns.append((sorted(need.items(), reverse=True), times))
        return times > 0

    def _pair(self, total: int) -> list[int] | None:
        """Two available lengths of this sum, the longest first."""
        half = self.left[1:total]
        both = (half > 0) & (half[::-1] > 0)
        if total % 2 == 0 and half.size and half[total // 2 - 1] < 2:
            both[total // 2 - 1] = False
        found = np.flatnonzero(both)
        return [int(found[-1]) + 1, total - int(found[-1]) - 1] if found.size else None

    def _exact(self) -> None:
        left = self.left
        if left[self.capacity]:
            self._use([self.capacity])
        for a in range(self.capacity - 1, 0, -1):
            gap = self.capacity - a
            if left[a] and left[gap]:
                self._use([a, gap])
            while left[a] and (pair := self._pair(gap)):
                if not self._use([a, *pair]):
                    break
            sums, stale = None, True
            while left[a] and gap >= 3:
                if stale:
                    there = (left > 0).astype(np.int64)
                    sums, stale = np.convolve(there, there)[: gap + 1], False
                thirds = np.flatnonzero((left[1 : gap - 1] > 0) & (sums[gap - 1 : 1 : -1] > 0)) + 1
                done = False
                for x in thirds[::-1]:
                    if (pair := self._pair(gap - int(x))) and self._use([a, int(x), *pair]):
                        done = stale = True
                        break
                if not done:
                    break

    def _best_fit(self) -> None:
        """Longest first into the smallest gap that takes it; equal bins are handled together."""
        open_bins: dict[int, list[tuple[list[tuple[int, int]], int]]] = {}
        for a in range(self.capacity, 0, -1):
            n = int(self.left[a])
            while n:
                gap = min((g for g, bins in open_bins.items() if g >= a and bins), default=None)
                if gap is None:
                    each = min(self.capacity // a, n)
                    content, bins = [], n // each
                    n -= each * bins
                    gap = self.capacity
                else:
                    content, bins = open_bins[gap].pop()
                    each = min(gap // a, max(1, n // bins))
                    use = min(bins, n // each)
                    if use < bins:
                        open_bins[gap].append((content, bins - use))
                    bins, n = use, n - each * use
                open_bins.setdefault(gap - each * a, []).append(([*content, (a, each)], bins))
        self.left[:] = 0
        self.patterns += [p for bins in open_bins.values() for p in bins]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> dict[str, np.ndarray]:
    """Rows of the plan, by length and first rank.

    Ranks lo.. of ``length`` go to sequences first.., ``each`` to a sequence, from ``offset`` on.
    """
    rows, first, used = [], 0, np.zeros(capacity + 1, np.int64)
    for content, times in _Plan(counts, capacity).patterns:
        offset = 0
        for length, each in content:
            rows.append((length, int(used[length]), each, first, offset))
            used[length] += each * times
            offset += each * length
        first += times
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 5).T
    return dict(zip(("length", "lo", "each", "first", "offset"), cols))


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all texts with their places: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Repeated rows are packed as often as they occur, ties in length go by id, an empty table gives
    an empty table. The driver sees one count for each length, ``capacity`` at most.
    """
    spark = docs.sparkSession
    pieces = Scratch(spark, "packing").write(cut(docs, tokenizer, capacity, id_col, text_col), "pieces")
    counts = dict(pieces.groupBy("length").count().collect())
    buckets = max(LEAST_BUCKETS, sum(counts.values()) // PIECES_PER_BUCKET)
    p = plan(counts, capacity)

    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    starts = starts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = dealt.withColumn("within", F.row_number().over(within) - 1).join(starts, ["length", "bucket"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("within")).alias("rank"))

    def place(batches):
        keys = p["length"] << 48 | p["lo"]
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
            row = np.searchsorted(keys, length << 48 | rank, side="right") - 1
            k = rank - p["lo"][row]
            sequence, offset = p["first"][row] + k // p["each"][row], p["offset"][row] + k % p["each"][row] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    key = pieces.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(place, f"doc_id {key}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
