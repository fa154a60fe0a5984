"""Numbers for contigs, kept by name.

Human chromosomes have fixed numbers whatever the spelling of their names. Every other name, as it is
spelt, gets a number of its own from a dictionary table; a dictionary is stored with its call set and
extended when files bring new names, so a number never stands for two names.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genopair.operators.cohort import dense_rank_by_digest
from genopair.operators.lookup import lookup_join

# Numbers of the named chromosomes; other contigs are numbered from CONTIG_BASE on.
CHROM_CODES = {"X": 23, "Y": 24, "XY": 25, "MT": 26, "M": 26}
CONTIG_BASE = 1_000_000
# Digits that a name may have to be a number itself.
NUMBER_DIGITS = 6

SCHEMA = "contig string, chrom int"


def chromosome_number(name: str) -> int | None:
    """The fixed number of a chromosome's name; None for any other contig."""
    bare = (name[3:] if name.lower().startswith("chr") else name).upper()
    if bare.isascii() and bare.isdigit() and len(bare) <= NUMBER_DIGITS:
        return int(bare)
    return CHROM_CODES.get(bare)


def chromosome_code(name: Column) -> Column:
    """The same of a column."""
    bare = F.upper(F.regexp_replace(name, "^(?i)chr", ""))
    code = F.when(bare.rlike(rf"^[0-9]{{1,{NUMBER_DIGITS}}}$"), bare.try_cast("int"))
    for text, number in CHROM_CODES.items():
        code = F.when(bare == text, F.lit(number)).otherwise(code)
    return code


def contig_dictionary(names: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """contig, chrom: one row for each name of ``names`` (a column ``contig``), added to those of ``known``.

    New names are numbered in the order of their digests behind the greatest number there is, so the
    numbers depend on the names alone.
    """
    distinct = names.select("contig").where(F.length("contig") > 0).distinct()
    first = F.lit(CONTIG_BASE)
    if known is not None:
        known = known.select("contig", F.col("chrom").cast("int").alias("chrom"))
        distinct = lookup_join(distinct, known.select("contig"), ["contig"], "left_anti", salts=1)
        greatest = known.agg(F.max("chrom")).first()[0]  # one number
        first = F.lit(max(CONTIG_BASE, (greatest or 0) + 1))
    fixed = distinct.select("contig", chromosome_code(F.col("contig")).alias("chrom"))
    others = dense_rank_by_digest(fixed.where("chrom IS NULL").select("contig"), ["contig"], "_i")
    out = fixed.where("chrom IS NOT NULL").unionByName(others.select("contig", (first + F.col("_i")).cast("int").alias("chrom")))
    return out if known is None else known.unionByName(out)


def with_chrom(df: DataFrame, contigs: DataFrame, name: Column) -> DataFrame:
    """``df`` with ``chrom``, the number of the contig that ``name`` gives; null for a name the dictionary lacks."""
    others = contigs.where(F.col("chrom") >= CONTIG_BASE).select(F.col("contig").alias("_name"), F.col("chrom").alias("_other"))
    if others.limit(1).count() == 0:
        return df.withColumn("chrom", chromosome_code(name))
    joined = lookup_join(df.withColumn("_name", name), others, ["_name"], "left", salts=1)
    return joined.withColumn("chrom", F.coalesce(chromosome_code(name), F.col("_other"))).drop("_name", "_other")


def with_contig(df: DataFrame, contigs: DataFrame) -> DataFrame:
    """``df`` with ``contig``, the name of its ``chrom``; of several spellings of a chromosome the least."""
    names = contigs.groupBy("chrom").agg(F.min("contig").alias("contig"))
    return lookup_join(df, names, ["chrom"], "left")
