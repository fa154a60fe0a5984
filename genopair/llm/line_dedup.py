"""Line deduplication over levelled sorted runs of line hashes, in DataFrame operations alone.

A run is a table (line_hash, n_docs): how many documents of the batches it stands for hold a line. It is
bucketed and sorted by the hash, so runs meet by merging, without another shuffle or sort. Each batch
is merge-anti-joined with the runs of lines that are known to be common, and adds a run of its own;
``fanout`` runs of one level are merged into one of the next, so a line is rewritten once per level,
and what has become common moves to the runs of common lines. After the last batch the levels are
merged, and lines found in enough documents leave every document by a join on position.

Defined results: a null or empty text is one empty line; lines whose key is shorter than
``min_chars`` are kept; each row counts as one document, also repeated rows and rows without an
id; an empty table gives an empty table; other columns are ignored; a column of ``keep`` that is named like a
result comes out as ``kept_`` and its name.
"""

import contextlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from genopair.llm.common import Scratch, id_and_text, restored

# Fixed value: what is stripped from both ends of a line.
EDGE = " \t\n\x0b\x0c\r"

LINES_PER_BATCH = 200_000_000
LEAST_BATCHES = 2
SORTED_BUCKETS = "spark.sql.legacy.bucketedTableScan.outputOrdering"


def folded(line: Column) -> Column:
    """A stripped line such that two are equal if their lines differ in the case of A to Z alone.

    The bytes are read as Latin-1 and lower-cased. That changes A to Z and bytes from C0 to DE, which in
    UTF-8 begin a character of two bytes; they become bytes that begin longer characters, but as many
    bytes as before follow, so no two different lines meet.
    """
    return F.lower(F.decode(line.cast("binary"), "ISO-8859-1"))


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


class LineRuns:
    """The runs of one collection, in a folder all executors share."""

    def __init__(self, spark: SparkSession, fanout: int = 4, name: str = "line-runs"):
        self.spark, self.scratch, self.fanout = spark, Scratch(spark, name), fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[DataFrame]] = [[]]
        self.common: list[DataFrame] = []
        self.tables: list[str] = []

    def _written(self, run: DataFrame, name: str) -> DataFrame:
        table = f"line_run_{uuid.uuid4().hex}"
        run.write.bucketBy(self.buckets, "line_hash").sortBy("line_hash").option("path", self.scratch.path(name)).format("parquet").saveAsTable(table)
        self.tables.append(table)
        return self.spark.table(table)

    @contextlib.contextmanager
    def merging(self):
        """While it lasts Spark takes a run for sorted, which it is: one file for each bucket."""
        before = self.spark.conf.get(SORTED_BUCKETS, None)
        self.spark.conf.set(SORTED_BUCKETS, "true")
        try:
            yield self
        finally:
            self.spark.conf.set(SORTED_BUCKETS, before) if before is not None else self.spark.conf.unset(SORTED_BUCKETS)

    def forget(self) -> None:
        """Take the runs out of the session's catalog."""
        for table in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        self.tables = []

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        """The sum of sorted runs, one merge after another."""
        out = runs[0]
        for run in runs[1:]:
            other = run.withColumnRenamed("n_docs", "_more").hint("merge")
            both = F.coalesce("n_docs", F.lit(0)) + F.coalesce("_more", F.lit(0))
            out = out.join(other, "line_hash", "full").select("line_hash", both.cast("bigint").alias("n_docs"))
        return out

    def add(self, counts: DataFrame, settled_at: int | None = None) -> None:
        """A batch's (line_hash, n_docs) as a run of level 0; full levels are merged.

        Lines known to be in ``settled_at`` documents need no further count: the batch leaves them out,
        and a merge moves them to the common ones.
        """
        for known in self.common:
            counts = counts.join(known.hint("merge"), "line_hash", "left_anti")
        self.levels[0].append(self._written(counts.groupBy("line_hash").agg(F.sum("n_docs").alias("n_docs")), "level-0"))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            merged = self._written(self._merged(self.levels[level]), f"level-{level + 1}")
            for run in self.levels[level]:
                self.scratch.drop(run)
            self.levels[level] = []
            if level + 1 == len(self.levels):
                self.levels.append([])
            if settled_at is not None:
                self.common.append(self._written(merged.where(F.col("n_docs") >= settled_at).select("line_hash"), "common"))
                merged = merged.where(F.col("n_docs") < settled_at)
            self.levels[level + 1].append(merged)
            level += 1

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def found_in(self, min_docs: int) -> DataFrame:
        """Hashes of the lines found in at least ``min_docs`` documents of all batches, those settled before included."""
        out = self._merged(self.runs()).where(F.col("n_docs") >= min_docs).select("line_hash")
        for known in self.common:
            out = out.unionByName(known)
        return out

    def unseen(self, lines: DataFrame) -> DataFrame:
        """Rows of ``lines`` whose line_hash is in no run: the merge anti-join of a new batch."""
        for run in self.runs():
            lines = lines.join(run.select("line_hash").hint("merge"), "line_hash", "left_anti")
        return lines


def hashed_lines(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """doc_id, text_hash and the hashes of the text's lines, null where a key is too short."""
    stripped = F.transform(lines_of(F.col("text")), lambda x: F.btrim(x, F.lit(EDGE)))
    long_enough = (lambda x: x != "") if min_chars == 1 else (lambda x: F.char_length(x) >= min_chars)
    hashes = F.transform(stripped, lambda x: F.when(long_enough(x), F.unhex(F.md5(folded(x)))))
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), hashes.alias("hashes"))


def drop_common_lines(
    docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int | None = None, fanout: int = 2, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()
) -> DataFrame:
    """doc_id, text without the lines found in ``min_docs`` documents or more, n_lines, n_dropped, and the columns named in ``keep``.

    ``batches`` follows from the number of lines unless it is given.
    """
    spark = docs.sparkSession
    docs = id_and_text(docs, id_col, text_col, keep)
    scratch = Scratch(spark, "line-dedup")
    # Every line is hashed once: 16 bytes each, for the counts as for the places.
    hashed = scratch.write(hashed_lines(docs, min_chars), "hashes")
    if batches is None:
        lines = hashed.agg(F.sum(F.size("hashes"))).first()[0] or 0
        batches = max(LEAST_BATCHES, -(-lines // LINES_PER_BATCH))

    # One row for each document and different line, dealt to the batches in one pass.
    batch = F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(batches)).cast("int")
    single = hashed.select(batch.alias("batch"), F.explode(F.array_distinct(F.array_compact("hashes"))).alias("line_hash"))
    counted = scratch.write(single.groupBy("batch", "line_hash").agg(F.count("*").alias("n_docs")), "batches", "batch")
    runs = LineRuns(spark, fanout)
    with runs.merging():
        for k in range(batches):
            runs.add(counted.where(F.col("batch") == k).drop("batch"), min_docs)
        common = scratch.write(runs.found_in(min_docs), "common")
    runs.forget()

    placed = hashed.select("doc_id", "text_hash", F.posexplode("hashes").alias("pos", "line_hash")).where(F.col("line_hash").isNotNull())
    gone = placed.join(common, "line_hash", "left_semi").groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("gone"))

    kept = docs.withColumn("text_hash", F.xxhash64("text")).alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("d.text_hash") == F.col("g.text_hash"))
    kept = kept.join(gone.alias("g"), same, "left").select("d.doc_id", lines_of(F.col("d.text")).alias("lines"), "d.text", "g.gone", *(F.col(f"d.kept_{k}") for k in range(len(keep))))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda k: F.get("lines", k)), "\n"))
    n_dropped = F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.size("gone"))
    names = ("doc_id", "text", "n_lines", "n_dropped")
    return kept.select("doc_id", text.alias("text"), F.size("lines").cast("long").alias("n_lines"), n_dropped.cast("long").alias("n_dropped"), *restored(keep, results=names))


# The same rows in DuckDB, for documents of given ids.
SQL = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(parts, 1) AS pos, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), common AS (
  SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE c.key IS NOT NULL) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
FROM keyed k LEFT JOIN common c USING (key)
GROUP BY doc_id
"""
