"""Writers. Every table is written by its tasks; nothing is gathered first."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genopair.operators.contigs import with_contig
from genopair.operators.packed import CHUNK, packed_codes
from genopair.sources.bgzf import MOST_IN_BLOCK
from genopair.sources.plink import read_plink
from genopair.sources.tables import read_packed
from genopair.sources.vcf import read_vcf
from genopair.sources.vcf_blocks import in_blocks, write_blocks

CODEC = "zstd"
# A reader decodes up to a row group at a time, and a packed genotype takes two bits in the
# file but some nine bytes while decoded. Small groups keep that near 150 MB per task.
PACKED_ROW_GROUP = 4 << 20


def write_table(df: DataFrame, path: str, partition_by: tuple = ("chrom",), mode: str = "errorifexists") -> None:
    """Contingency, frequency and other per-variant tables."""
    df.write.mode(mode).option("compression", CODEC).partitionBy(*partition_by).parquet(path)


def write_packed_calls(packed: DataFrame, samples: DataFrame, out: str, mode: str = "errorifexists", contigs: DataFrame | None = None) -> None:
    """Packed call set: ``variants`` by chromosome, in the order they come, ``samples``, and ``contigs``, the dictionary of names."""
    writer = packed.write.mode(mode).option("compression", CODEC).option("parquet.block.size", PACKED_ROW_GROUP)
    writer.partitionBy("chrom").parquet(f"{out}/variants")
    samples.write.mode(mode).option("compression", CODEC).parquet(f"{out}/samples")
    if contigs is not None:
        contigs.write.mode(mode).option("compression", CODEC).parquet(f"{out}/contigs")


def add_packed_calls(packed: DataFrame, samples: DataFrame, contigs: DataFrame, out: str) -> None:
    """More variants of the same samples for a call set: numbered behind those it has, with the names it lacks.

    ``contigs`` is the call set's own dictionary with what the new files brought; numbers that were given stay.
    """
    saved = read_packed(packed.sparkSession, out)
    both = samples.select("sample_idx", "sample_id").exceptAll(saved.samples.select("sample_idx", "sample_id"))
    if samples.count() != saved.samples.count() or both.limit(1).count():
        raise ValueError("the call set holds other samples")
    (greatest,) = saved.packed.agg(F.max("variant_idx")).first()
    packed = packed.withColumn("variant_idx", F.col("variant_idx") + F.lit(-1 if greatest is None else greatest) + 1)
    new = contigs.join(saved.contigs, "contig", "left_anti")
    write_packed_calls(packed, samples.limit(0), out, "append", new)


def write_encoded(df: DataFrame, path: str, arrange: bool = True, mode: str = "errorifexists") -> None:
    """Encoded matrix by mode and chromosome, sorted by position.

    ``arrange`` range-partitions by mode, chromosome and position first, so that a large
    chromosome is cut into several tasks and row groups cover short position ranges. Leave
    it out for packed rows that come in file order already: they need no shuffle.
    """
    order = [c for c in ("mode", "chrom", "pos", "variant_idx") if c in df.columns]
    layout = [c for c in ("mode", "chrom") if c in df.columns]
    if arrange:
        df = df.repartitionByRange(*order, *[c for c in ("case_id",) if c in df.columns])
    df.sortWithinPartitions(*order).write.mode(mode).option("compression", CODEC).partitionBy(*layout).parquet(path)


def write_pvalues(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """p-value table as Parquet by chromosome or as CSV with a header."""
    if fmt == "parquet":
        write_table(df, path, ("chrom",), mode)
    elif fmt == "csv":
        df.write.mode(mode).option("header", True).csv(path)
    else:
        raise ValueError("fmt is 'parquet' or 'csv'")


def write_packed(packed: DataFrame, samples: DataFrame, pairs: DataFrame, code: str, path: str, chunk: int = CHUNK, mode: str = "errorifexists") -> None:
    """Dense codes in blocks of ``chunk`` cases; no shuffle of genotypes."""
    codes = packed_codes(packed, samples, pairs, code, chunk).withColumn("mode", F.lit(code))
    write_encoded(codes, path, arrange=False, mode=mode)


def write_tsv(df: DataFrame, path: str, header: bool = False, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("sep", "\t").option("header", header).csv(path)


def plink_to_parquet(spark: SparkSession, prefixes, out: str, missing_ok: bool = True, **kw) -> None:
    """File trios to a packed call set."""
    data = read_plink(spark, prefixes, missing_ok, **kw)
    write_packed_calls(data.packed, data.samples, out, contigs=data.contigs)


def vcf_to_parquet(spark: SparkSession, path, out: str, **kw) -> None:
    """VCF records to a packed call set.

    Text and block-gzip files give their records in file order. Any other gzip file is read as one split and spread out, so its
    records are laid out by chromosome and position again: a task writes a stretch, and statistics prune.
    """
    data = read_vcf(spark, path, **kw)
    paths = [path] if isinstance(path, str) else list(path)
    packed = data.packed
    zipped = kw.get("compressed") or (kw.get("compressed") is None and all(p.endswith((".gz", ".bgz")) for p in paths))
    if zipped and not in_blocks(paths):
        packed = packed.repartitionByRange("chrom", "pos", "variant_idx").sortWithinPartitions("chrom", "pos", "variant_idx")
    write_packed_calls(packed, data.samples, out, contigs=data.contigs)


def vcf_lines(packed: DataFrame, contigs: DataFrame) -> DataFrame:
    """``contig, pos, value``: a VCF line for each row of packed alleles; columns it lacks are missing values."""
    has = set(packed.columns)
    text = lambda c, other=".": F.coalesce(F.col(c).cast("string"), F.lit(other)) if c in has else F.lit(other)
    alt = F.when(F.size("alt") > 0, F.array_join("alt", ",")).otherwise(".") if "alt" in has else F.lit(".")
    info = [F.concat(F.lit(f"{k.upper()}="), v) for k, v in (("an", F.col("an").cast("string")), ("ac", F.array_join("ac", ","))) if k in has]
    allele = lambda x: F.coalesce(x.cast("string"), F.lit("."))
    calls = F.transform(F.arrays_zip("a1", "a2"), lambda g: F.concat(allele(g["a1"]), F.lit("/"), allele(g["a2"])))
    named = packed if "contig" in has else with_contig(packed, contigs)
    line = F.concat_ws("\t", F.col("contig"), F.col("pos").cast("string"), text("snp"), text("ref", "N"), alt, F.lit("."), F.lit("PASS"), F.concat_ws(";", *info) if info else F.lit("."), F.lit("GT"), calls)
    return named.select("contig", "pos", line.alias("value"))


def write_vcf(packed: DataFrame, samples: DataFrame, path: str, contigs: DataFrame | None = None, parts: int | None = None, block_bytes: int = MOST_IN_BLOCK, mode: str = "append") -> None:
    """Packed alleles as a folder of block-gzip VCF files, each with its header and its index, contigs and positions in order."""
    header = samples.agg(F.transform(F.array_sort(F.collect_list(F.struct("sample_idx", "sample_id"))), lambda s: s["sample_id"].cast("string")).alias("s")).first()["s"]
    fixed = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT"
    lines = vcf_lines(packed, contigs)
    ranged = lines.repartitionByRange(parts, "contig", "pos") if parts else lines.repartitionByRange("contig", "pos")
    write_blocks(ranged.sortWithinPartitions("contig", "pos", "value"), "\t".join([fixed, *header]) + "\n", path, block_bytes, mode)


def write_hml(report: DataFrame, path: str, project: str, version: str = "1.0.1", mode: str = "errorifexists") -> None:
    """Typing report as XML, one ``sample`` element per row."""
    root = f'hml project-name="{project}" version="{version}"'
    (
        report.write.mode(mode)
        .format("xml")
        .option("rootTag", root)
        .option("rowTag", "sample")
        .option("attributePrefix", "_")
        .option("declaration", "version='1.0' encoding='UTF-8'")
        .save(path)
    )
