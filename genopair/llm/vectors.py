"""Vector tables: valid rows, shards, and shard indexes as files that tasks map."""

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genopair.llm.common import Scratch
from genopair.storage import read_arrow, read_pickled, write_arrow, write_pickled

ROWS_PER_SHARD = 100_000
SHARD_BYTES = 512 << 20  # of a shard's vectors as doubles; an index holds half as much again
LEAST_SHARDS = 8
BLOCK_BYTES = 8 << 20  # of a block of queries
MOST_TASKS = 8192  # of a search


def valid(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and v (array of double) of the rows that take part.

    Null and zero vectors, those with null or non-finite components, rows without an id, and vectors
    of another length than most (the smaller length of equally frequent ones) are left out.
    """
    v = vectors.select(F.col(f"`{id_col}`").cast("bigint").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    v = v.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))
    common = v.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    return v.where(F.size("v") == (common["d"] if common else 0))


def shards_for(n: int, dimensions: int = 1) -> int:
    """At most ``ROWS_PER_SHARD`` rows and ``SHARD_BYTES`` of vectors to a shard."""
    rows = max(1, min(ROWS_PER_SHARD, SHARD_BYTES // (8 * max(1, dimensions))))
    return max(LEAST_SHARDS, -(-n // rows))


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _files(rows: DataFrame, parts: int, of: str, folder: str, write) -> DataFrame:
    """One row (``of``, path) for each value of the column ``of`` below ``parts``; ``write(path, table)`` makes the file of its rows.

    Every value is a task of its own, and every attempt of a task has a path of its own: the row names the one that is read.
    """

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if held:
            table = pa.Table.from_batches(held)
            held.clear()
            number, path = table[of][0].as_py(), f"{folder}/{uuid.uuid4().hex}"
            write(path, table)
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([path])], names=[of, "path"])

    return rows.repartitionById(parts, F.col(of)).mapInArrow(run, f"{of} int, path string")


def build_indexes(points: DataFrame, build, shards: int, scratch: Scratch) -> DataFrame:
    """One row (shard, path) for each shard that has points; ``build`` makes the index of a shard's table.

    Building takes a processor, not bytes, so every shard is a task of its own, however small. An index goes to a file
    of the shared folder and never through Spark's rows, where an index of a hundred megabytes would be copied for
    each block of queries.
    """
    files = _files(points, shards, "shard", scratch.path("index"), lambda path, table: write_pickled(path, build(table)))
    return scratch.write(files, "indexes")


def search_indexes(indexes: DataFrame, queries: DataFrame, n_queries: int, search, schema: str, scratch: Scratch, dimensions: int = 64) -> DataFrame:
    """Each block of queries meets each shard's index; ``search(index, queries)`` gives the rows of one of these meetings.

    Blocks are files as indexes are, and what Spark sends are their paths: a task maps both.
    """
    blocks = max(1, -(-n_queries * 8 * max(1, dimensions) // BLOCK_BYTES))
    cut = queries.withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int"))
    asked = scratch.write(_files(cut, blocks, "block", scratch.path("queries"), write_arrow), "blocks")
    meetings = indexes.withColumnRenamed("path", "index").crossJoin(F.broadcast(asked))
    shards = (indexes.agg(F.max("shard")).first()[0] or 0) + 1
    tasks = min(MOST_TASKS, shards * blocks)
    # tasks by shard, so that those that run together share what they map
    place = F.floor((F.col("shard").cast("bigint") * blocks + F.col("block")) * tasks / (shards * blocks)).cast("int")
    names, types = zip(*(c.split() for c in schema.split(",")))
    kinds = {"bigint": pa.int64(), "double": pa.float64()}

    def run(batches):
        path, index = None, None
        for batch in batches:
            for own, block in zip(batch.column("index").to_pylist(), batch.column("path").to_pylist()):
                if own != path:
                    path, index = own, None
                    index = read_pickled(own)
                found = search(index, read_arrow(block)[0])
                yield pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(found, types)], names=list(names))

    return meetings.repartitionById(tasks, place).select("index", "path").mapInArrow(run, schema)
