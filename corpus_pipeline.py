"""A corpus pipeline: toxicity, line deduplication, near-duplicates, repeated strings, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but the last
return the columns of ``documents``; where a text changes, n_chars is its new length.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genopair.llm import line_dedup, minhash, packing, suffix, toxicity
from genopair.llm.common import Scratch, table
from genopair.llm.queries import WORD_BPE

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold; the model learns from the labels of the others' ids."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, keep=COLUMNS)
    return scored.where(F.col("score") < toxicity.THRESHOLD).select(*COLUMNS)


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten or more of them share."""
    return line_dedup.drop_common_lines(docs, keep=("lang", "source")).select("doc_id", "text", "lang", "source", F.char_length("text").cast("bigint").alias("n_chars"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class of near-duplicates; rows without an id stay."""
    found = minhash.classes(docs).where("doc_id <> class_id").select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*COLUMNS)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes of strings that occur earlier; what is left of a split character goes, too."""
    return suffix.remove_repeats(docs, keep=("lang", "source")).select("doc_id", "text", "lang", "source", F.char_length("text").cast("bigint").alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens: one row for each piece of a document."""
    return packing.pack(docs, WORD_BPE)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_common_lines),
    ("near_dedup", drop_near_duplicates),
    ("repeat_dedup", drop_repeats),
    ("packing", pack),
]

#: Classification, signatures and byte strings have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each one's result is written and read again."""
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
