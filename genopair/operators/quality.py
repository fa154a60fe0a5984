"""Variant quality filters and their reports."""

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from genopair.operators.lookup import lookup_join
from genopair.operators.pairs import VARIANT

MIN_CALL_RATE = 0.95
MIN_ALLELE_NUMBER = 800


def filter_allele_number(variants: DataFrame, min_an: int = MIN_ALLELE_NUMBER) -> DataFrame:
    """Variants with enough called alleles; a plain predicate, so Parquet can skip by it."""
    return variants.filter(F.col("an") >= min_an)


def allele_number_report(variants: DataFrame, min_an: int = MIN_ALLELE_NUMBER) -> DataFrame:
    keep = F.coalesce(F.col("an") >= min_an, F.lit(False))
    return variants.groupBy("chrom").agg(F.count_if(keep).alias("kept"), F.count_if(~keep).alias("removed"))


def filter_region(df: DataFrame, chrom: int, start: int, end: int) -> DataFrame:
    """Positions start..end of one chromosome, both ends included."""
    return df.filter((F.col("chrom") == chrom) & F.col("pos").between(start, end))


def filter_chroms(df: DataFrame, first: int = 1, last: int = 22) -> DataFrame:
    """A chromosome range; partition pruning on tables laid out by chromosome."""
    return df.filter(F.col("chrom").between(first, last))


def call_rate(called, n_cases) -> Column:
    """1 - missing / cases. The denominator is every case, so an absent row is a missing one."""
    called = F.col(called) if isinstance(called, str) else called
    n = n_cases if isinstance(n_cases, Column) else F.lit(n_cases)
    return F.lit(1.0) - (n - called) / n


def variant_call_rate(encoded: DataFrame, n_cases, keys: list = VARIANT) -> DataFrame:
    """Called cases and call rate per variant."""
    return (
        encoded.groupBy(*keys)
        .agg(F.count("code").alias("n_called"))
        .withColumn("call_rate", call_rate("n_called", n_cases))
    )


def filter_call_rate(
    encoded: DataFrame, n_cases, min_rate: float = MIN_CALL_RATE, keys: list = VARIANT, variants: DataFrame | None = None, bucketed: bool = False
) -> DataFrame:
    """The encoded rows of variants called in at least ``min_rate`` of all cases.

    ``encoded`` is read twice, once for the rates and once for the rows, so a saved matrix
    serves best. With the variant table given, the size of the kept list is bounded by it;
    without, the list is measured, which takes a further pass. A matrix in buckets by ``keys``, or
    some of them (``bucketed=True``), is read once and not shuffled: a variant's rows lie together.
    """
    if bucketed:
        called = F.count("code").over(Window.partitionBy(*keys))
        return encoded.withColumn("_called", called).where(call_rate("_called", n_cases) >= min_rate).drop("_called")
    rates = variant_call_rate(encoded, n_cases, keys).filter(F.col("call_rate") >= min_rate)
    bound = None if variants is None else variants.select(*keys)
    return lookup_join(encoded, rates.select(*keys), keys, "left_semi", salts=1, bound=bound)


def call_rate_report(rates: DataFrame, min_rate: float = MIN_CALL_RATE) -> DataFrame:
    """Removed, percent removed and total per chromosome."""
    keep = F.col("call_rate") >= min_rate
    return (
        rates.groupBy("chrom")
        .agg(F.count_if(~keep).alias("removed"), F.count(F.lit(1)).alias("total"))
        .withColumn("percent_removed", F.col("removed") / F.col("total") * 100)
    )


def observed_filter(rows: DataFrame, keep: Column, name: str, chroms=range(1, 27)) -> tuple[DataFrame, Observation]:
    """``rows`` where ``keep`` holds, and an observation of how many there are and were, by chromosome.

    The counts come from the same pass that filters: they are known once an action has run on the
    result. Chromosomes other than ``chroms`` are counted together, under null.
    """
    seen = Observation(name)
    kept = F.coalesce(keep, F.lit(False))
    chrom, known = F.col("chrom"), F.col("chrom").isin(*chroms)
    places = [(str(c), chrom == c) for c in chroms] + [("other", ~F.coalesce(known, F.lit(False)))]
    counts = [F.count_if(here & wanted).alias(f"{what}_{c}") for c, here in places for what, wanted in (("kept", kept), ("total", F.lit(True)))]
    return rows.observe(seen, *counts).where(kept), seen


def observed_report(spark: SparkSession, seen: Observation, chroms=range(1, 27)) -> DataFrame:
    """``chrom, removed, total, percent_removed`` of an observed filter; chromosomes without rows are left out."""
    found = seen.get
    rows = [(None if c == "other" else int(c), found[f"total_{c}"] - found[f"kept_{c}"], found[f"total_{c}"]) for c in [*map(str, chroms), "other"]]
    report = spark.createDataFrame([r for r in rows if r[2]], "chrom int, removed bigint, total bigint")
    return report.withColumn("percent_removed", F.col("removed") / F.col("total") * 100)


def drop_duplicate_snps(variants: DataFrame, scope: tuple = ("chrom",)) -> DataFrame:
    """Remove every copy of an id that occurs more than once in its scope.

    ``scope=("chrom",)`` for one file per chromosome, ``()`` for a whole-genome file. A
    group of one hands its own values back, so no join follows, and an id shared by a third
    of the variants is combined on the map side.
    """
    keys = [*scope, "snp"]
    nested = (T.ArrayType, T.MapType, T.StructType)
    # of a single row min is the value itself, and it keeps fixed-width columns in the hash aggregate
    rest = [
        (F.any_value(f.name) if isinstance(f.dataType, nested) else F.min(f.name)).alias(f.name)
        for f in variants.schema.fields
        if f.name not in keys
    ]
    single = variants.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *rest).filter(F.col("_n") == 1)
    return single.select(*variants.columns)


def duplicate_snps(variants: DataFrame, scope: tuple = ("chrom",)) -> DataFrame:
    """The repeated ids with their number of copies."""
    return variants.groupBy(*scope, "snp").agg(F.count(F.lit(1)).alias("copies")).filter(F.col("copies") > 1)


def repeated_positions(variants: DataFrame) -> DataFrame:
    """Positions that hold more than one variant: ``chrom, pos``."""
    return (
        variants.groupBy("chrom", "pos").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1).select("chrom", "pos")
    )


def keep_variants(encoded: DataFrame, kept: DataFrame) -> DataFrame:
    """Encoded rows of the variants in ``kept``."""
    keys = ["chrom", "variant_idx"]
    return lookup_join(encoded, kept.select(*keys), keys, "left_semi", salts=1)
