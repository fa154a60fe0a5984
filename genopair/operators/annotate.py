"""Looking up variants, genes and allele sequences."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genopair.operators.lookup import lookup_join

BIN_WIDTH = 100_000

# The text that stands around and between exons 2 and 3 of a class I allele
# when its genomic sequence is unknown.
CLASS_I_PREFIX = "ATGCGTATA"
CLASS_I_SUFFIX = "TTTACGG"
CLASS_I_INTRON2 = (
    "GTGAGTGACCCCGGCCCGGGGCGCAGGTCACGACCTCTCATCCCCCACGGACGGGCCAGGTCGCCCACAGTCTCCGGGTCCGAGATCCACCCCGAAGCCGCGGGACCCCGAGACCCTTGCCCCGGGAGAGGCCCAGGCGCCTTTACCCGGTTTCATTTTCAGTTTAGGCCAAAAATCCCCCCGGGTTGGTCGGGGCCGGACGGGGCTCGGGGGACTGGGCTGACCGTGGGGTCGGGGCCAG"
)


def gene_variants(genes: DataFrame, variants: DataFrame, symbol: str | None = None, bin_width: int = BIN_WIDTH) -> DataFrame:
    """Variants overlapping each gene, both ends included.

    ``genes`` has ``gene, chrom, start, end``; ``variants`` has ``chrom, start, end`` and
    more. Both sides are cut into fixed bins, which turns the overlap into an equi-join; a
    pair that meets in several bins is kept only in the first one both reach.
    """
    if symbol is not None:
        genes = genes.filter(F.col("gene") == symbol)

    def binned(start: Column, end: Column) -> Column:
        return F.explode(F.sequence(F.floor(start / bin_width), F.floor(end / bin_width))).alias("_bin")

    g = genes.select("gene", "chrom", F.col("start").alias("gene_start"), F.col("end").alias("gene_end"))
    g = g.select("*", binned(F.col("gene_start"), F.col("gene_end")))
    v = variants.select("*", binned(F.col("start"), F.col("end")))
    met = lookup_join(v, g, ["chrom", "_bin"])
    overlap = (F.col("start") <= F.col("gene_end")) & (F.col("end") >= F.col("gene_start"))
    first_common = F.floor(F.greatest("start", "gene_start") / bin_width)
    return met.filter(overlap & (F.col("_bin") == first_common)).drop("_bin")


def lookup_variants(ids: DataFrame, variants: DataFrame) -> DataFrame:
    """Annotations of the asked ids; unknown ids stay with NULLs.

    One join, so either table is read once; Spark broadcasts a small side and splits an id that
    many rows ask for.
    """
    return ids.join(variants, ["snp"], "left")


def allele_sequence(alleles: DataFrame, sequences: DataFrame, klass: str) -> DataFrame:
    """Sequence text per allele row.

    ``sequences`` has ``allele, unaligned, exon2, exon3``. Class 'I' adds ``sequence``: the
    genomic sequence without ``|`` and ``*``, or, when that is empty, the exons in fixed
    surroundings. Class 'II' adds ``exon2`` and ``exon3``; ``exon3`` loses its ``*`` and is
    NULL when nothing is left.
    """
    # common alleles repeat a great deal, so the join spreads them when it has to shuffle
    joined = lookup_join(alleles, sequences.select("allele", "unaligned", "exon2", "exon3"), ["allele"], "left")
    if klass == "I":
        rebuilt = F.concat(
            F.lit(CLASS_I_PREFIX), F.col("exon2"), F.lit(CLASS_I_INTRON2), F.col("exon3"), F.lit(CLASS_I_SUFFIX)
        )
        text = F.when(F.length("unaligned") == 0, rebuilt).otherwise(F.translate("unaligned", "|*", ""))
        return joined.withColumn("sequence", text).drop("unaligned", "exon2", "exon3")
    if klass == "II":
        tail = F.translate("exon3", "*", "")
        return joined.withColumn("exon3", F.when(F.length(tail) > 0, tail)).drop("unaligned")
    raise ValueError("klass is 'I' or 'II'")
