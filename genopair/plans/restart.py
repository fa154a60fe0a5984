"""Runs over chromosomes that can be taken up where they stopped.

A run's key is a digest of its settings and of the size and time of every input file. Each unit of
chromosomes is computed, written to its own folder and then committed by a small file that names the
key; a later run with the same key computes only units that have none. Other inputs or settings are
another key, so nothing computed from them counts.
"""

import hashlib
import json
import time
from collections.abc import Callable, Iterable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from genopair.storage import file_size, files_in, read_range, write_file


def fingerprint(spark: SparkSession, paths: Iterable[str]) -> str:
    """Number, bytes and a digest of names, sizes and times of the files under the paths; Spark lists them, nothing is read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths))
    sizes = listed.select("path", "length", "modificationTime").agg(
        F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.expr("bit_xor(xxhash64(path, length, modificationTime))").alias("digest")
    )
    return "-".join(map(str, sizes.first()))


class Run:
    """Units of work with their results in ``folder``."""

    def __init__(self, spark: SparkSession, folder: str, inputs: Iterable[str], settings: dict):
        self.spark, self.folder = spark, folder.rstrip("/")
        text = json.dumps([settings, fingerprint(spark, inputs)], sort_keys=True)
        self.key = hashlib.sha256(text.encode()).hexdigest()[:16]

    def _committed(self) -> dict[str, dict]:
        entries = (json.loads(read_range(f, 0, file_size(f))) for f in files_in(f"{self.folder}/manifest") if f.endswith(".json"))
        return {e["unit"]: e for e in entries if e["key"] == self.key}

    def _place(self, unit: str) -> str:
        return f"{self.folder}/results/key={self.key}/unit={unit}"

    def open(self, units: Iterable[str]) -> list[str]:
        """The units that are yet to be computed."""
        done = self._committed()
        return [u for u in units if u not in done]

    def execute(self, units: dict[str, list[int]], work: Callable[[list[int]], DataFrame]) -> list[str]:
        """Compute and commit every open unit; ``work`` gives the rows of some chromosomes. Returns the units computed.

        A unit is committed after all its files are in place. One that was cut off left no commit; its folder is written over.
        """
        computed = []
        for unit in self.open(units):
            started, seen = time.time(), Observation(f"unit {unit}")
            rows = work(units[unit]).observe(seen, F.count(F.lit(1)).alias("rows"))
            rows.write.mode("overwrite").parquet(self._place(unit))
            entry = {"unit": unit, "key": self.key, "chroms": list(units[unit]), "rows": seen.get["rows"], "seconds": round(time.time() - started, 3)}
            entry["at"] = datetime.now(timezone.utc).isoformat()
            write_file(f"{self.folder}/manifest/{self.key}-{unit}.json", json.dumps(entry).encode())
            computed.append(unit)
        return computed

    def manifest(self) -> DataFrame:
        """A row for each committed unit: unit, chroms, rows, seconds."""
        entries = self._committed().values()
        rows = [(e["unit"], e["chroms"], e["rows"], e["seconds"]) for e in entries]
        return self.spark.createDataFrame(rows, "unit string, chroms array<int>, rows bigint, seconds double")

    def results(self) -> DataFrame:
        """The rows of all committed units."""
        done = sorted(self._committed())
        if not done:
            raise ValueError("no unit is committed")
        return self.spark.read.parquet(*[self._place(u) for u in done])


def by_chromosome(chroms: Iterable[int]) -> dict[str, list[int]]:
    """One unit for each chromosome."""
    return {str(c): [c] for c in chroms}
