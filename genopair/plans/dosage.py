"""Whole analyses on PLINK dosages."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genopair.operators.association import as_sentinel, logistic_additive, logistic_factor, variant_levels
from genopair.operators.packed import VARIANT_KEY, packed_mode_counts
from genopair.operators.pairs import outcome_of_case
from genopair.operators.quality import MIN_CALL_RATE, call_rate, drop_duplicate_snps

# Disease codes of the outcome table.
DISEASES = {"AML": 10, "ALL": 20, "CML": 40, "MDS": 50}
OUTCOMES = ["agvhi24", "agvhi34"]


def filter_disease(outcomes: DataFrame, disease: str) -> DataFrame:
    return outcomes.filter(F.col("disease") == DISEASES[disease])


def logistic_from_counts(
    counts: DataFrame,
    variants: DataFrame,
    n_cases,
    outcomes: list = OUTCOMES,
    model: str = "factor",
    scope: tuple = ("chrom",),
    min_rate: float = MIN_CALL_RATE,
    sentinel_minus_one: bool = False,
    by: tuple = (),
) -> DataFrame:
    """From counts per variant, code and outcome to p-values, within each value of the columns ``by``.

    The duplicate-id and call-rate filters run on the variant table and on the counts, one
    small row per variant, and never on the genotypes.
    """
    levels = variant_levels(counts, outcomes, [*VARIANT_KEY, *by])
    levels = levels.filter(call_rate("n_called", n_cases) >= min_rate)
    if sentinel_minus_one:
        levels = as_sentinel(levels)
    single = drop_duplicate_snps(variants.select("chrom", "pos", "snp", "variant_idx"), scope)
    tested = {"factor": logistic_factor, "additive": logistic_additive}[model](levels)
    return tested.join(single, VARIANT_KEY).select(
        "chrom", "pos", "snp", "variant_idx", "outcome", "n_called", "ref_code", "test_code", "beta", "se", "p_value", "status", "model", *by
    )


def mismatch_logistic(
    packed: DataFrame,
    samples: DataFrame,
    pairs: DataFrame,
    outcome_table: DataFrame,
    mode: str,
    outcomes: list = OUTCOMES,
    variants: DataFrame | None = None,
    **kw,
) -> DataFrame:
    """Pair code of every variant against every outcome.

    ``mode`` is one of the dosage modes. Genotypes are read once, in file order, and leave
    their task only as counts. ``variants`` is the variant table where the source keeps one
    apart (PLINK); otherwise the packed table's own columns serve, without its genotypes.
    """
    return mismatch_logistics(packed, samples, pairs, outcome_table, (mode,), outcomes, variants, **kw).drop("mode")


def mismatch_logistics(
    packed: DataFrame,
    samples: DataFrame,
    pairs: DataFrame,
    outcome_table: DataFrame,
    modes: tuple,
    outcomes: list = OUTCOMES,
    variants: DataFrame | None = None,
    **kw,
) -> DataFrame:
    """Several modes from one scan of the genotypes; the results carry ``mode``."""
    counts = packed_mode_counts(packed, samples, pairs, outcome_table, outcomes, modes).drop("grp")
    return logistic_from_counts(counts, packed if variants is None else variants, pairs.count(), outcomes, by=("mode",), **kw)


def recipient_disease_logistics(
    packed: DataFrame,
    samples: DataFrame,
    pairs: DataFrame,
    outcome_table: DataFrame,
    diseases: tuple = tuple(DISEASES),
    outcomes: list = OUTCOMES,
    variants: DataFrame | None = None,
    **kw,
) -> DataFrame:
    """Recipient dosage against every outcome among the cases of each disease, from one scan; the results carry ``disease``."""
    codes = tuple(DISEASES[d] for d in diseases)
    counts = packed_mode_counts(packed, samples, pairs, outcome_table, outcomes, ("recipient",), groups=codes).drop("mode")
    of_case = outcome_of_case(outcome_table, ["disease"])
    sizes = dict(pairs.join(of_case.where(F.col("disease").isin(*codes)), "case_id").groupBy("disease").count().collect())
    name, size = F.lit(None).cast("string"), F.lit(0)
    for d, code in zip(diseases, codes):
        name, size = F.when(F.col("grp") == code, d).otherwise(name), F.when(F.col("grp") == code, sizes.get(code, 0)).otherwise(size)
    found = logistic_from_counts(counts, packed if variants is None else variants, size, outcomes, by=("grp",), **kw)
    return found.withColumn("disease", name).drop("grp")


def recipient_disease_logistic(packed: DataFrame, samples: DataFrame, pairs: DataFrame, outcome_table: DataFrame, disease: str, **kw) -> DataFrame:
    """The same for one disease."""
    return recipient_disease_logistics(packed, samples, pairs, outcome_table, (disease,), **kw).drop("disease")
