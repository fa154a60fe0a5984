"""Bounded samples of labelled texts for fitting, and the held-out rule."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genopair.llm.common import id_and_text


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves ``fold``; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label_col: str, per_class: int, folds: int, fold: int) -> tuple[DataFrame, dict[int, int]]:
    """One text with its label of at most ``per_class`` ids of either label, and how many ids either label has.

    Ids are taken by smallest hash, so the sample is the same wherever rows lie, and so is the text of
    an id that several rows share. Held-out ids, null ids and null labels are left out; an id labelled
    both ways counts as 1. The ids of the sample, two times ``per_class`` at most, are broadcast to the
    scan of the texts.
    """
    known = labels.select(F.col("doc_id"), F.col(f"`{label_col}`").cast("int").alias("label"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("doc_id"), folds, fold))
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    totals = {0: 0, 1: 0} | {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = [known.where(F.col("label") == y).orderBy(*order).limit(per_class) for y in (0, 1)]
    ids = F.broadcast(chosen[0].unionByName(chosen[1]))
    texts = id_and_text(docs).join(ids, "doc_id").groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    return texts.select("doc_id", "text", "label"), totals
