"""Whole analyses on diploid call sets."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genopair.functions.encode import ALLELE_CODES, gt_type_diff, mismatch_types
from genopair.operators.association import chi_square, code_counts, logistic_factor, variant_levels, with_neg_log_p
from genopair.operators.lookup import lookup_join
from genopair.operators.packed import packed_allele_counts, packed_pairs, packed_type_counts
from genopair.operators.pairs import VARIANT, case_control, complete_pairs, pair_calls
from genopair.operators.quality import MIN_ALLELE_NUMBER, filter_allele_number, repeated_positions
from genopair.operators.tables import contingency, mismatch_type_frequency, packed_contingency

ALLELES = ("a1", "a2")
FOUR = ("d_a1", "d_a2", "r_a1", "r_a2")


def passing_calls(calls: DataFrame, variants: DataFrame, min_an: int = MIN_ALLELE_NUMBER) -> DataFrame:
    """Calls of the variants with enough alleles, dropped before any genotype is paired."""
    keys = ["chrom", "variant_idx"]
    return lookup_join(calls, filter_allele_number(variants, min_an).select(*keys), keys, "left_semi", salts=1)


def encode_alleles(paired: DataFrame, mode: str, keys: list = VARIANT) -> DataFrame:
    """``mode`` is 'count' (0,1,2) or 'presence' (0,1)."""
    return paired.select(*keys, "case_id", ALLELE_CODES[mode](*FOUR).alias("code"))


def encode_mismatch_types(paired: DataFrame, keys: list = VARIANT) -> DataFrame:
    slot1, slot2 = mismatch_types(*FOUR)
    return paired.select(*keys, "case_id", slot1.alias("slot1"), slot2.alias("slot2"))


def genotype_differences(paired: DataFrame, keys: list = VARIANT) -> DataFrame:
    """|gt_type difference| of the pair; variants where either is missing are left out."""
    diff = gt_type_diff(*FOUR)
    return paired.select(*keys, "case_id", diff.alias("diff")).filter(F.col("diff").isNotNull())


def paired_alleles(calls: DataFrame, variants: DataFrame, samples: DataFrame, min_an: int = MIN_ALLELE_NUMBER) -> DataFrame:
    pairs = complete_pairs(samples)
    return pair_calls(passing_calls(calls, variants, min_an), pairs, ALLELES)


def packed_paired_alleles(packed: DataFrame, slots: DataFrame, samples: DataFrame, min_an: int = MIN_ALLELE_NUMBER) -> DataFrame:
    """The same from packed rows: the allele number reaches the scan and genotypes are not shuffled."""
    return packed_pairs(filter_allele_number(packed, min_an), slots, complete_pairs(samples), ALLELES, VARIANT)


def association_of_pairs(paired: DataFrame, variants: DataFrame, samples: DataFrame, mode: str = "count", floor: int = 0) -> DataFrame:
    """Contingency table and chi-square test of every position; ``variants`` are those that ``paired`` holds."""
    status = case_control(complete_pairs(samples).withColumnRenamed("case_id", "group_id"))
    table = contingency(encode_alleles(paired, mode), status, mode, repeated=repeated_positions(variants), floor=floor)
    return chi_square(table, mode)


def association_table(
    calls: DataFrame,
    variants: DataFrame,
    samples: DataFrame,
    mode: str = "count",
    floor: int = 0,
    min_an: int = MIN_ALLELE_NUMBER,
) -> DataFrame:
    """Contingency table and chi-square test of every position that passes."""
    paired = paired_alleles(calls, variants, samples, min_an)
    return association_of_pairs(paired, filter_allele_number(variants, min_an), samples, mode, floor)


def packed_association_table(
    packed: DataFrame,
    slots: DataFrame,
    samples: DataFrame,
    mode: str = "count",
    floor: int = 0,
    min_an: int = MIN_ALLELE_NUMBER,
) -> DataFrame:
    """As ``association_table`` from packed rows; ``slots`` tells each sample's place in the arrays."""
    pairs = complete_pairs(samples)
    status = case_control(pairs.withColumnRenamed("case_id", "group_id"))
    table = packed_contingency(filter_allele_number(packed, min_an), slots, pairs, status, mode, floor)
    return chi_square(table, mode)


def packed_association_log_p(packed: DataFrame, slots: DataFrame, samples: DataFrame, mode: str = "count", **kw) -> DataFrame:
    """The testable positions with -ln p, from packed rows."""
    return with_neg_log_p(packed_association_table(packed, slots, samples, mode, **kw))


def packed_group_logistic(
    packed: DataFrame, slots: DataFrame, samples: DataFrame, mode: str = "count", min_an: int = MIN_ALLELE_NUMBER
) -> DataFrame:
    """Pair codes against the case/control label (1 for control), from packed rows."""
    pairs = complete_pairs(samples)
    status = case_control(pairs.withColumnRenamed("case_id", "group_id"))
    counts = packed_allele_counts(filter_allele_number(packed, min_an), slots, pairs, status, mode)
    n = F.col("n_case") + F.col("n_control") + F.col("n_other")
    counts = counts.select(*VARIANT, "code", n.alias("n"), F.col("n_case").alias("n0_group_label"), F.col("n_control").alias("n1_group_label"))
    return logistic_factor(variant_levels(counts, ["group_label"]))


def association_log_p(calls: DataFrame, variants: DataFrame, samples: DataFrame, mode: str = "count", **kw) -> DataFrame:
    """The testable positions with -ln p."""
    return with_neg_log_p(association_table(calls, variants, samples, mode, **kw))


def group_logistic(encoded: DataFrame, samples: DataFrame) -> DataFrame:
    """Saved codes against the case/control label."""
    label = case_control(samples).select("case_id", F.when(F.col("status") == "control", 1).otherwise(0).alias("group_label"))
    return logistic_factor(variant_levels(code_counts(encoded, label, ["group_label"]), ["group_label"]))


def mismatch_type_table(calls: DataFrame, variants: DataFrame, samples: DataFrame, min_an: int = MIN_ALLELE_NUMBER) -> DataFrame:
    return mismatch_type_frequency(encode_mismatch_types(paired_alleles(calls, variants, samples, min_an)))


def packed_mismatch_type_table(packed: DataFrame, slots: DataFrame, samples: DataFrame, min_an: int = MIN_ALLELE_NUMBER) -> DataFrame:
    return packed_type_counts(filter_allele_number(packed, min_an), slots, complete_pairs(samples))
