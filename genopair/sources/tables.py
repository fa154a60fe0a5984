"""Tables read by the pipelines: call sets, cases, outcomes, samples, HLA typings."""

import re
from collections import namedtuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from genopair.functions.ids import format_id
from genopair.operators.contigs import SCHEMA as CONTIGS
from genopair.operators.hla import CASE_LOCI, case_column
from genopair.operators.lookup import first_by, lookup_join
from genopair.session import stored

# Column names of the input files below are fixed values: they are what such files carry.

CallSet = namedtuple("CallSet", "variants calls samples")
Checked = namedtuple("Checked", "rows broken")
PackedCallSet = namedtuple("PackedCallSet", "packed samples contigs")


def read_delimited(spark: SparkSession, path, sep: str = "\t", header: bool = True) -> DataFrame:
    """Tab-, space- or comma-separated text; every column a string."""
    return spark.read.option("header", header).option("sep", sep).csv(path)


CORRUPT = "_corrupt_record"


def read_checked(spark: SparkSession, path, schema: str, sep: str = ",", header: bool = True, most_broken: float = 0.01, quarantine: str | None = None) -> Checked:
    """``Checked(rows, broken)`` of delimited text with the columns of ``schema``, a DDL string.

    A row with too few or too many fields, or with a field that is no value of its column's type, is
    broken: it is left out of ``rows`` and stands in ``broken`` as ``file, block, line, reason, text``; ``line`` counts
    from 0 behind the block of the file that begins at byte ``block``. ``broken`` is written to ``quarantine``, or
    to the shared folder. The read stops if more than ``most_broken`` of all rows are broken.
    """
    names = StructType.fromDDL(schema).names
    raw = spark.read.schema(f"{schema}, {CORRUPT} string").option("header", header).option("sep", sep).option("mode", "PERMISSIVE")
    raw = raw.option("columnNameOfCorruptRecord", CORRUPT).csv(path)
    place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id")]
    # Spark judges a row by the columns that a query asks for, so all are read, once, and kept.
    read = stored(raw.select("*", *place), "checked")
    blocks = read.groupBy("_file", "_block").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("n"), F.count(CORRUPT).alias("n_broken"))
    total, bad = blocks.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("n_broken"), F.lit(0))).first()
    if bad > most_broken * total:
        raise ValueError(f"{bad} of {total} rows are broken")
    fields = F.size(F.split("text", re.escape(sep), -1))
    reason = F.when(fields < len(names), "short").when(fields > len(names), "long").otherwise("unparsable")
    broken = lookup_join(read.where(F.col(CORRUPT).isNotNull()), blocks.select("_file", "_block", "_first"), ["_file", "_block"])
    broken = broken.select(F.col("_file").alias("file"), F.col("_block").alias("block"), (F.col("_id") - F.col("_first")).alias("line"), F.col(CORRUPT).alias("text"))
    broken = broken.select("file", "block", "line", reason.alias("reason"), "text")
    if quarantine is None:
        broken = stored(broken, "quarantine")
    else:
        broken.write.parquet(quarantine)
        broken = spark.read.schema(broken.schema).parquet(quarantine)
    return Checked(read.where(F.col(CORRUPT).isNull()).select(*names), broken)


def _in_file_order(raw: DataFrame) -> DataFrame:
    """Adds ``file_order``: file name, place of the block in it, and row in the block.

    Spark packs blocks into partitions by size; row numbers only grow within a block.
    """
    at = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("row"))
    return raw.withColumn("file_order", at)


def read_outcomes(spark: SparkSession, path, key: str | None = None, integers: tuple = ("agvhi24", "agvhi34", "disease")) -> DataFrame:
    """Outcome table keyed by ``case_id``, a string taken from the third column unless named; ``file_order`` tells which row is first."""
    raw = read_delimited(spark, path, ",")
    key = key or raw.columns[2]
    rest = [F.col(c).try_cast("int").alias(c) if c in integers else F.col(c) for c in raw.columns if c != key]
    return _in_file_order(raw).select(F.col(key).cast("string").alias("case_id"), *rest, "file_order")


def read_cases(spark: SparkSession, path) -> DataFrame:
    """``case_id, did, rid``: the first row of each case in file order, ids formatted."""
    rows = _in_file_order(read_delimited(spark, path, ",")).select("bmt_case_num", "nmdp_rid", "nmdp_did", "file_order")
    return first_by(rows, ["bmt_case_num"], "file_order").select(
        F.col("bmt_case_num").alias("case_id"),
        format_id("nmdp_did", "donor").alias("did"),
        format_id("nmdp_rid", "recipient").alias("rid"),
    )


def read_samples(spark: SparkSession, path) -> DataFrame:
    """Sample table: ``group_id, group, subject_type, seq_id, r_d_id``."""
    raw = read_delimited(spark, path, ",")
    names = {"GroupID": "group_id", "Group": "group", "subjectType": "subject_type", "SeqID": "seq_id", "R_D_ID": "r_d_id"}
    return raw.select(*[F.col(old).alias(new) for old, new in names.items() if old in raw.columns])


def read_hla(spark: SparkSession, path) -> DataFrame:
    """HLA case table input: first row per case, ids formatted, typings and descriptive columns."""
    typings = [case_column(side, locus, n) for locus in CASE_LOCI for side in ("r", "d") for n in (1, 2)]
    described = {
        "transplant_date": "transplant_date",
        "ridbroadrace": "recipient_broad_race",
        "ridrolluprace": "recipient_rollup_race",
        "didbroadrace": "donor_broad_race",
        "didrolluprace": "donor_rollup_race",
    }
    raw = _in_file_order(read_delimited(spark, path, ",")).select("bmt_case_num", "nmdp_rid", "nmdp_did", *described, *typings, "file_order")
    return first_by(raw, ["bmt_case_num"], "file_order").select(
        F.col("bmt_case_num").alias("case_id"),
        format_id("nmdp_did", "donor").alias("did"),
        format_id("nmdp_rid", "recipient").alias("rid"),
        *[F.col(old).alias(new) for old, new in described.items()],
        *typings,
    )


def read_callset(spark: SparkSession, path: str, chroms=None, min_an: int | None = None) -> CallSet:
    """Parquet call set: ``variants`` and ``calls`` laid out by chromosome, and ``samples``.

    ``chroms=(first, last)`` prunes partitions; ``min_an`` reaches the scan of the variants
    as a Parquet filter. Columns are pruned by whatever is selected later.
    """
    variants, calls = spark.read.parquet(f"{path}/variants"), spark.read.parquet(f"{path}/calls")
    if chroms is not None:
        inside = F.col("chrom").between(*chroms)
        variants, calls = variants.filter(inside), calls.filter(inside)
    if min_an is not None:
        variants = variants.filter(F.col("an") >= min_an)
    return CallSet(variants, calls, spark.read.parquet(f"{path}/samples"))


def read_packed(spark: SparkSession, path: str, chroms=None) -> PackedCallSet:
    """Packed call set as written from PLINK or VCF; ``chroms=(first, last)`` prunes partitions.

    ``contigs`` are the names behind the numbers, empty for a call set saved without them.
    """
    packed = spark.read.parquet(f"{path}/variants")
    if chroms is not None:
        packed = packed.filter(F.col("chrom").between(*chroms))
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/contigs")
    saved = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
    contigs = spark.read.parquet(f"{path}/contigs") if saved else spark.createDataFrame([], CONTIGS)
    return PackedCallSet(packed, spark.read.parquet(f"{path}/samples"), contigs)


def read_encoded(spark: SparkSession, path, chroms=None) -> DataFrame:
    """Saved encoded matrices of several chromosomes as one table.

    The chromosome comes from the ``chrom=`` folder, or else from file names of the form
    ``chr<id>_...``.
    """
    df = spark.read.parquet(*([path] if isinstance(path, str) else path))
    if "chrom" not in df.columns:
        name = F.regexp_extract(F.col("_metadata.file_name"), r"^chr([^_]+)", 1)
        df = df.select("*", name.try_cast("int").alias("chrom"))
    return df if chroms is None else df.filter(F.col("chrom").between(*chroms))
