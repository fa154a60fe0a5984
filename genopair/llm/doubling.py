"""Repeated byte strings by distributed prefix doubling over all positions.

Every byte position of every text gets a rank: equal ranks stand for equal strings of so many bytes
from there on. The rank of twice the length is that of the pair of ranks here and one length further,
which Spark brings together by position and groups; the name of a group is its earliest position.
Positions whose rank is unique leave, and so do those before the string that no longer fits. The last
offset is cut so that the length comes out. What is left is repeated, and the earliest of each group is its
first occurrence.

The rows are positions, so a round shuffles some twenty bytes for every byte of text that is not yet
unique. ``suffix`` gives the same spans from positions that it samples; README has figures of both.

Defined results: a null text is empty; texts shorter than ``length`` have no spans; ``uid`` orders texts and
must be unique; an empty table gives an empty table.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genopair.llm.common import Scratch, small

FIRST = 8  # bytes whose rank is their own value
STEP = 1 << 16


def _first_ranks(length: int):
    def run(batches):
        for batch in small(batches, 16):
            for uid, text in zip(batch["uid"].to_pylist(), batch["text"].to_pylist()):
                data = np.frombuffer((text or "").encode("utf-8"), np.uint8)
                for at in range(0, len(data) - length + 1 if len(data) >= length else 0, STEP):
                    # positions up to the last that a string of ``length`` bytes can reach back from
                    here = np.arange(at, min(at + STEP, len(data) - length + 1))
                    yield _ranks(data, uid, here)
                if len(data) >= length:
                    yield _ranks(data, uid, np.arange(len(data) - length + 1, len(data) - FIRST + 1))

    return run


def _ranks(data: np.ndarray, uid: int, at: np.ndarray) -> pa.RecordBatch:
    rank = np.zeros(len(at), np.uint64)
    for k in range(FIRST):
        rank = rank << np.uint64(8) | data[at + k].astype(np.uint64)
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), uid, np.int64)), pa.array(at.astype(np.int64)), pa.array(rank.view(np.int64))], names=["uid", "pos", "rank"])


def repeated_positions(docs: DataFrame, scratch: Scratch, length: int = 100) -> DataFrame:
    """uid, pos and the earliest (uid, pos) with the same ``length`` bytes, for all positions whose string occurs twice.

    ``docs`` has uid and text; ``length`` is ``FIRST`` or more.
    """
    ranks = scratch.write(docs.select("uid", "text").mapInArrow(_first_ranks(length), "uid bigint, pos bigint, rank bigint"), "ranks")
    size, named = FIRST, F.struct("rank")
    ranks = ranks.select("uid", "pos", named.alias("rank"))
    while True:
        groups = ranks.groupBy("rank").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("uid", "pos")).alias("first"))
        # A table of its own, so that Spark can split the join on a string that many positions share.
        groups = scratch.write(groups.where("n > 1").select("rank", "first"), f"groups-{size}")
        kept = scratch.write(ranks.join(groups, "rank").select("uid", "pos", F.col("first").alias("rank")), f"ranks-{size}")
        if size == length:
            return kept.select("uid", "pos", F.col("rank.uid").alias("first_uid"), F.col("rank.pos").alias("first_pos"))
        step = min(size, length - size)
        further = kept.select("uid", (F.col("pos") - step).alias("pos"), F.col("rank").alias("next"))
        ranks = kept.join(further, ["uid", "pos"]).select("uid", "pos", F.struct("rank", "next").alias("rank"))
        size += step


def repeated_spans(docs: DataFrame, scratch: Scratch, length: int = 100) -> DataFrame:
    """uid, start and end of every string of ``length`` bytes that also begins earlier."""
    found = repeated_positions(docs, scratch, length).where("first_uid <> uid OR first_pos <> pos")
    return found.select("uid", F.col("pos").alias("start"), (F.col("pos") + length).alias("end"))
