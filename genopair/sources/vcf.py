"""VCF text as packed genotypes, one row per record."""

from collections import namedtuple
from functools import reduce
from urllib.parse import unquote, urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from genopair.operators.contigs import chromosome_code, chromosome_number, contig_dictionary, with_chrom
from genopair.operators.lookup import union_all, with_offsets
from genopair.session import stored
from genopair.sources import vcf_blocks
from genopair.storage import file_size

VcfData = namedtuple("VcfData", "packed samples contigs")

# columns before the first sample: CHROM POS ID REF ALT QUAL FILTER INFO FORMAT
FIXED_COLUMNS = 9


def read_vcf(
    spark: SparkSession, path, partitions: int | None = None, compressed: bool | None = None, chroms=None, region=None, contigs: DataFrame | None = None, range_bytes: int | None = None
) -> VcfData:
    """``VcfData(packed, samples, contigs)`` of one or more files over the same samples.

    ``packed`` holds ``chrom, contig, pos, snp, variant_idx, ref, alt, an, ac, numalt`` and the
    allele numbers of every sample in ``a1`` and ``a2`` (NULL when missing; a haploid call
    has no ``a2``). Samples are matched by name: a path whose ``#CHROM`` line lists them in
    another order than the first one's is put in that order, one with other samples is refused,
    and one without such a line, like the parts of a split file, follows the first. Records are
    numbered without gaps, whatever is filtered.

    ``contigs`` numbers the names that are no chromosomes (``contig_dictionary``); given a known
    dictionary, the files' new names are added to it. ``chroms`` and ``region=(chrom, start, end)``
    name chromosomes by number, or any contig by name; they drop records by their first two
    fields, before any other is looked at.

    Block-gzip files are read in ranges of ``range_bytes``, a task each. Where every file has its
    ``.tbi`` index, a region reads only the blocks that hold it; its records, and the dictionary, are then
    numbered by what is read. Any other gzip file is one split, so its records are spread out after reading.
    """
    paths = [path] if isinstance(path, str) else list(path)
    blocks = compressed is not False and vcf_blocks.in_blocks(paths)
    if compressed is None:
        compressed = all(p.endswith((".gz", ".bgz")) for p in paths)
    groups, names = _groups(spark, vcf_blocks.data_files(paths), True) if blocks else _groups(spark, paths, False)
    samples = spark.createDataFrame(list(enumerate(names)), "sample_idx bigint, sample_id string")
    if blocks:
        lines = _block_records(spark, groups, region, range_bytes or vcf_blocks.RANGE_BYTES)
    else:
        lines = union_all([_records(spark, group, header, k) for k, (header, group) in enumerate(groups.items())])

    # One pass tells how many records, and which contigs, each partition has.
    name, position = F.substring_index("value", "\t", 1), F.substring_index(F.substring_index("value", "\t", 2), "\t", -1)
    numbered = lines.withColumn("_mid", F.monotonically_increasing_id())
    part = F.shiftright("_mid", 33)
    seen = stored(numbered.groupBy(part.alias("_part"), name.alias("contig")).agg(F.count(F.lit(1)).alias("_n")), "contigs")
    numbered = with_offsets(numbered, seen.groupBy("_part").agg(F.sum("_n").alias("_n")), "variant_idx")
    contigs = stored(contig_dictionary(seen.select("contig"), contigs), "contigs")

    kept = numbered.select("value", "variant_idx", "_order", name.alias("contig"), position.cast("bigint").alias("pos"))
    if chroms is not None:
        kept = kept.filter(reduce(lambda a, b: a | b, [_is_contig(c) for c in chroms], F.lit(False)))
    if region is not None:
        kept = kept.filter(_is_contig(region[0]) & F.col("pos").between(region[1], region[2]))
    lines = with_chrom(kept, contigs, F.col("contig")).drop("contig")
    if compressed and not blocks:
        lines = lines.repartition(partitions) if partitions else lines.repartition("variant_idx")

    orders = [_order_of(names, h.split("\t")[FIXED_COLUMNS:], groups[h][0]) for h in groups]
    f = F.col("f")
    complete = F.size(f) == FIXED_COLUMNS + len(names)
    info, alt = F.get(f, 7), F.split(F.get(f, 4), ",")
    no_alt = F.get(f, 4) == "."
    slot = F.array_position(F.split(F.get(f, 8), ":"), "GT").cast("int")
    in_order = F.slice(f, FIXED_COLUMNS + 1, F.lit(max(len(names), 1)))
    if any(order is not None for order in orders):
        # a row for each other order, since a plan with a literal for each sample, at every record, grows with their square
        other = [(k, order) for k, order in enumerate(orders) if order is not None]
        lines = lines.join(F.broadcast(spark.createDataFrame(other, "_order int, _places array<int>")), "_order", "left")
        in_other = F.transform("_places", lambda i: F.get(f, i + FIXED_COLUMNS))
        in_order = F.when(F.col("_places").isNotNull(), in_other).otherwise(in_order)
    calls = F.when(complete, in_order).otherwise(
        F.raise_error(F.concat(F.lit("record with a wrong number of fields at "), F.get(f, 0), F.lit(":"), F.get(f, 1)))
    )
    parsed = lines.withColumn("f", F.split("value", "\t")).select(
        "chrom",
        F.get(f, 0).alias("contig"),
        "pos",
        F.get(f, 2).alias("snp"),
        "variant_idx",
        F.get(f, 3).alias("ref"),
        F.when(no_alt, F.array().cast("array<string>")).otherwise(alt).alias("alt"),
        _info_number(info, "AN").cast("int").alias("an"),
        F.transform(F.split(F.nullif(_info_text(info, "AC"), F.lit("")), ","), lambda x: x.try_cast("int")).alias("ac"),
        F.when(no_alt, 0).otherwise(F.size(alt)).alias("numalt"),
        F.transform(calls, lambda s: _genotype(s, slot)).alias("_gt"),
    )
    packed = parsed.select(
        *[c for c in parsed.columns if c != "_gt"],
        F.transform("_gt", lambda g: F.substring_index(g, "/", 1).try_cast("tinyint")).alias("a1"),
        F.transform(
            "_gt", lambda g: F.when(F.instr(g, "/") > 0, F.substring_index(g, "/", -1).try_cast("tinyint"))
        ).alias("a2"),
    )
    return VcfData(packed, samples, contigs)


def _records(spark: SparkSession, paths: list, header: str, number: int) -> DataFrame:
    """Record lines of paths that share one sample line; another one among them, in a folder of files, stops the read."""
    lines = spark.read.text(paths)
    stray = F.col("value").startswith("#CHROM") & (F.col("value") != header)
    message = F.concat(F.lit("another #CHROM line than its path's first one in "), F.col("_metadata.file_path"))
    lines = lines.select(F.when(stray, F.raise_error(message)).otherwise(F.col("value")).alias("value"))
    return lines.filter(~F.col("value").startswith("#")).withColumn("_order", F.lit(number))


def _order_of(names: list, own: list, path: str) -> list | None:
    """Where each of ``names`` stands in a file's own line; None when the lines are equal."""
    if own == names:
        return None
    at = {n: i for i, n in enumerate(own)}
    if len(at) != len(own) or set(at) != set(names):
        raise ValueError(f"{path} lists other samples than the first file")
    return [at[n] for n in names]


def _is_contig(wanted) -> Column:
    """Whether the column ``contig`` is the chromosome of a number, or a contig of that very name."""
    number = wanted if isinstance(wanted, int) else chromosome_number(wanted)
    return F.coalesce(chromosome_code(F.col("contig")) == number, F.lit(False)) if number is not None else F.col("contig") == wanted


def _groups(spark: SparkSession, paths: list, blocks: bool) -> tuple[dict, list]:
    """Paths by their ``#CHROM`` line, in the order they are given, and the sample names of the first.

    Lines come from one job over all paths, which hands equal ones over once. Those of a folder's
    files are that folder's.
    """
    if blocks:
        found = vcf_blocks.headers(spark, paths).where("header IS NOT NULL")
        of_path = {p: p for p in paths}
    else:
        lines = spark.read.text(paths).filter(F.col("value").startswith("#CHROM"))
        found = lines.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("header"))
        of_path = {urlsplit(p).path.rstrip("/"): p for p in paths}
    header_of = {}
    for row in found.groupBy("header").agg(F.sort_array(F.collect_set("file")).alias("files")).collect():
        for file in row["files"]:
            place = file if blocks else unquote(urlsplit(file).path)
            while place and place not in of_path:
                place = place.rpartition("/")[0]
            # a pattern, or a path that reads otherwise than it is written, can only be one of one
            given = of_path.get(place) or (paths[0] if len(paths) == 1 else None)
            if given is None:
                raise ValueError(f"{file} is in none of the given paths")
            header_of[given] = min(header_of.get(given, row["header"]), row["header"])
    if paths and paths[0] not in header_of:
        raise ValueError(f"{paths[0]} has no #CHROM line")
    first = header_of[paths[0]]
    groups: dict[str, list] = {}
    for p in paths:
        groups.setdefault(header_of.get(p, first), []).append(p)
    return groups, first.split("\t")[FIXED_COLUMNS:]


def _block_records(spark: SparkSession, groups: dict, region, range_bytes: int) -> DataFrame:
    """Record lines of block-gzip files, and which sample order each has."""
    files = [f for group in groups.values() for f in group]
    order = [k for k, group in enumerate(groups.values()) for _ in group]
    if region is not None and all(file_size(f + ".tbi") is not None for f in files):
        number = region[0] if isinstance(region[0], int) else chromosome_number(region[0])
        wanted = lambda name: chromosome_number(name) == number if number is not None else name == region[0]
        ranges = vcf_blocks.region_ranges(files, wanted, region[1], region[2], range_bytes)
    else:
        ranges = vcf_blocks.whole_ranges(files, range_bytes)
    lines = vcf_blocks.read_lines(spark, files, ranges)
    if len(groups) == 1:
        return lines.select("value", F.lit(0).alias("_order"))
    return lines.select("value", F.element_at(F.array(*[F.lit(k) for k in order]), F.col("file") + 1).alias("_order"))


def _genotype(sample: Column, slot: Column) -> Column:
    """The genotype part of a sample field with one kind of separator; nearly always the first part."""
    part = F.when(slot == 1, F.substring_index(sample, ":", 1)).otherwise(F.get(F.split(sample, ":"), slot - 1))
    return F.translate(part, "|", "/")


def _info_text(info: Column, key: str) -> Column:
    return F.regexp_extract(info, rf"(?:^|;){key}=([^;]*)", 1)


def _info_number(info: Column, key: str) -> Column:
    return _info_text(info, key).try_cast("bigint")


def read_gene_files(spark: SparkSession, folder: str, gene: str) -> DataFrame:
    """Lines of every ``*_<gene>.vcf`` of a folder: file name, text, comma-separated fields."""
    return (
        spark.read.option("pathGlobFilter", f"*_{gene}.vcf")
        .text(folder)
        .select(F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("line"), F.split("value", ",").alias("fields"))
    )
