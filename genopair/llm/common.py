"""Helpers shared by the operators: inputs, scratch tables, byte arithmetic."""

import gc
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genopair.session import shared_folder, ship_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), empty_for_null: bool = True) -> DataFrame:
    """Only the two columns an operator needs and, as ``kept_0`` and so on, those to be carried along, so no names clash.

    A null text is empty, unless it is to stay.
    """
    ship_package(docs.sparkSession)
    rest = [F.col(f"`{c}`").alias(f"kept_{k}") for k, c in enumerate(keep)]
    text = F.col(f"`{text_col}`")
    text = F.coalesce(text, F.lit("")) if empty_for_null else text
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"), *rest)


def restored(keep: tuple[str, ...], prefix: str = "", results: tuple[str, ...] = ()) -> list:
    """The columns that ``id_and_text`` carried, under their own names; one named like a result has ``kept_`` before its name."""
    return [F.col(f"{prefix}kept_{k}").alias(f"kept_{c}" if c in results else c) for k, c in enumerate(keep)]


class Scratch:
    """Tables of one run in the cluster's shared folder; they cut lineage and outlive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        ship_package(spark)
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.n = 0

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    def write(self, df: DataFrame, name: str, *partition_by: str) -> DataFrame:
        path = self.path(name)
        writer = df.write
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(path)
        return self.read(path, df.schema)

    def read(self, path: str, schema=None) -> DataFrame:
        return (self.spark.read.schema(schema) if schema is not None else self.spark.read).parquet(path)

    def release(self) -> None:
        """Let Spark's cleaner remove the shuffle files of finished steps; they would add up over the rounds."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, df: DataFrame) -> None:
        """Remove a table of this run that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for f in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if self.root.rsplit("/", 1)[1] in f:
                path = jvm.org.apache.hadoop.fs.Path(f)
                path.getFileSystem(conf).delete(path, True)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on unsigned 64-bit integers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def small(batches, rows: int = 512):
    """Batches of at most ``rows`` rows, so that a task holds Python copies of a few texts only."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def buffers(ids: list, texts: list, limit: int = 1 << 20):
    """Lists of rows whose texts together stay near ``limit`` bytes: (ids, list of UTF-8 bytes)."""
    part_ids, part, size = [], [], 0
    for i, t in zip(ids, texts):
        b = t.encode("utf-8")
        if part and size + len(b) > limit:
            yield part_ids, part
            part_ids, part, size = [], [], 0
        part_ids.append(i)
        part.append(b)
        size += len(b)
    if part:
        yield part_ids, part
