"""Cohort tables: de-identification, running numbers, file renaming."""

from math import gcd

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Range of the random numbers: seven digits, lowest and number of values.
FIRST_NUMBER = 1_000_000
NUMBERS = 9_000_000
# hexadecimal digits of the digest that name a bucket
DIGEST_DIGITS = 3


def digest_bucket(keys: list):
    """First digits of the md5 of the joined keys: spreads any ids evenly, and so that other engines can repeat it."""
    return F.substring(F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys])), 1, DIGEST_DIGITS)


def running_total(df: DataFrame, keys: list, order: list, value: str, name: str) -> DataFrame:
    """Running sum of ``value`` over all rows, itself included.

    The order is: bucket of the digest of ``keys``, then ``order`` inside the bucket. Sums
    run inside a bucket; what earlier buckets hold is added from a table of at most 4096
    rows. No task sees all rows, and the order does not depend on partitioning.
    """
    marked = df.withColumn("_bucket", digest_bucket(keys))
    per_bucket = marked.groupBy("_bucket").agg(F.sum(value).alias("_sum"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select("_bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        marked.withColumn("_inside", F.sum(value).over(inside))
        .join(F.broadcast(offsets), "_bucket")
        .withColumn(name, F.col("_offset") + F.col("_inside"))
        .drop("_bucket", "_inside", "_offset")
    )


def dense_rank_by_digest(df: DataFrame, keys: list, name: str) -> DataFrame:
    """Dense 0-based number of rows with unique keys, in digest order."""
    numbered = running_total(df.withColumn("_one", F.lit(1).cast("bigint")), keys, keys, "_one", name)
    return numbered.withColumn(name, F.col(name) - 1).drop("_one")


def randomise_ids(fam: DataFrame, seed: int = 1) -> DataFrame:
    """``old_fid, old_iid, fid, iid`` with ``iid`` = RAND and a unique seven-digit number.

    Row ``i`` gets ``1000000 + (a*i + b) mod 9000000`` with ``a`` prime to 9000000, so
    numbers are unique for up to nine million samples without any shared state. ``a`` and
    ``b`` follow from the seed. This relabels; it is not encryption.
    """
    a, b = affine_key(seed)
    number = F.lit(FIRST_NUMBER) + (F.col("i").cast("bigint") * a + b) % NUMBERS
    checked = F.when(F.col("i") < NUMBERS, number).otherwise(
        F.raise_error(F.lit("more samples than seven-digit numbers")).cast("bigint")
    )
    return fam.select(
        F.col("fid").alias("old_fid"),
        F.col("iid").alias("old_iid"),
        F.col("fid"),
        F.concat(F.lit("RAND"), checked.cast("string")).alias("iid"),
    )


def affine_key(seed: int) -> tuple[int, int]:
    a = (seed * 2_654_435_761 + 1_299_709) % NUMBERS
    while gcd(a, NUMBERS) != 1:
        a += 1
    return a % NUMBERS, (seed * 40_503 + 7_919) % NUMBERS


def rename_manifest(samples: DataFrame) -> DataFrame:
    """Old and new file name of each sample's VCF and index."""
    old = F.concat_ws("_", "group", F.col("group_id").cast("string"), "subject_type", F.col("r_d_id").cast("string"))
    new = F.concat(F.lit("SEQ"), F.col("seq_id").cast("string"))
    suffixes = F.array(F.lit(".vcf.gz"), F.lit(".vcf.gz.tbi"))
    return samples.select(old.alias("old"), new.alias("new"), F.explode(suffixes).alias("suffix")).select(
        F.concat("old", "suffix").alias("old_name"), F.concat("new", "suffix").alias("new_name")
    )
