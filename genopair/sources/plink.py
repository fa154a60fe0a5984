"""PLINK 1 binary genotypes (.bed, .bim, .fam) as a Spark data source.

The .bed file has a fixed number of bytes per variant, the .bim file has one line of free
length per variant. A first distributed pass over the .bim cuts it into blocks of whole
lines and counts them; each block then becomes one read task, which knows its lines in the
.bim and so its byte range in the .bed. Nothing reads a whole file.
"""

import json
import logging
import uuid
from collections import defaultdict, namedtuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
)

from genopair.operators.contigs import CONTIG_BASE, chromosome_number, contig_dictionary
from genopair.operators.lookup import union_all, with_row_index
from genopair.session import shared_folder, ship_package, stored
from genopair.storage import file_size as _size
from genopair.storage import filesystem_of, write_file
from genopair.storage import read_range as _bytes

log = logging.getLogger(__name__)

PlinkData = namedtuple("PlinkData", "variants samples packed contigs")

# Public PLINK 1 format: magic bytes for variant-major files, then two bits per sample,
# lowest first: 00 two copies of a1, 01 missing, 10 one copy, 11 none.
MAGIC = b"\x6c\x1b\x01"
MISSING = -1
A1_COPIES = {0b00: 2, 0b01: MISSING, 0b10: 1, 0b11: 0}

TARGET_BYTES = 32 << 20  # genotype bytes per task, four genotypes each
LEAST_BYTES = 1 << 20
MOST_TASKS = 100_000
TYPICAL_BIM_LINE = 32
BATCH_CELLS = 8 << 20  # decoded genotypes per Arrow batch

INDEX_SCHEMA = "file int, start bigint, lines bigint, contigs array<string>, pos_lo bigint, pos_hi bigint"
VARIANT_SCHEMA = "chrom int, variant_idx bigint, snp string, cm double, pos bigint, a1 string, a2 string"
PACKED_SCHEMA = VARIANT_SCHEMA + ", dosage array<tinyint>"


class _Range(InputPartition):
    def __init__(self, file, start, end):
        self.file, self.start, self.end = file, start, end


class BimIndexSource(DataSource):
    """Counts the .bim lines that begin in each byte range."""

    @classmethod
    def name(cls):
        return "plink_bim_index"

    def schema(self):
        return INDEX_SCHEMA

    def reader(self, schema):
        return BimIndexReader(json.loads(self.options["files"]), int(self.options["blockBytes"]))


class BimIndexReader(DataSourceReader):
    def __init__(self, files, block):
        self.files, self.block = files, block

    def partitions(self):
        out = []
        for i, path in enumerate(self.files):
            size = _size(path)
            out += [_Range(i, s, min(s + self.block, size)) for s in range(0, size, self.block)]
        return out or [_Range(-1, 0, 0)]

    def read(self, part):
        if part.file < 0:
            return
        start, text = whole_lines(self.files[part.file], part.start, part.end)
        fields = [line.split() for line in text.splitlines() if line.strip()]
        if fields:
            pos = [int(f[3]) for f in fields]
            yield (part.file, start, len(fields), sorted({f[0].decode() for f in fields}), min(pos), max(pos))


def whole_lines(path, start, end, step=1 << 16):
    """Offset and text of the lines that begin in [start, end)."""
    size = _size(path)
    # one byte before the range tells whether a line begins right at its start
    head = max(start - 1, 0)
    text = _bytes(path, head, end - head)
    if start > 0:
        cut = text.find(b"\n")
        if cut < 0:
            return start, b""
        begin, text = head + cut + 1, text[cut + 1 :]
    else:
        begin = 0
    reach = end
    while text and not text.endswith(b"\n") and reach < size:
        more = _bytes(path, reach, min(step, size - reach))
        cut = more.find(b"\n")
        text += more if cut < 0 else more[: cut + 1]
        reach += len(more)
        if cut >= 0:
            break
    return begin, text


class _Block(InputPartition):
    """Some lines of a trio. ``numbers`` are those of the contigs it holds, by name."""

    def __init__(self, prefix="", samples=0, start=0, lines=0, row=0, offset=0, numbers=None, pos_lo=0, pos_hi=0):
        self.prefix, self.samples, self.start, self.lines, self.row, self.offset = prefix, samples, start, lines, row, offset
        self.numbers, self.pos_lo, self.pos_hi = numbers or {}, pos_lo, pos_hi
        self.chroms = sorted(set(self.numbers.values()))


class BedSource(DataSource):
    """Variants with their dosages, one task per block of the index."""

    @classmethod
    def name(cls):
        return "plink_bed"

    def schema(self):
        return PACKED_SCHEMA if self.options.get("genotypes", "true") == "true" else VARIANT_SCHEMA

    def reader(self, schema):
        pushdown = self.options.get("pushdown", "false") == "true"
        return (FilteringBedReader if pushdown else BedReader)(self.options)


class BedReader(DataSourceReader):
    def __init__(self, options):
        index = json.loads(_bytes(options["index"], 0, _size(options["index"])))
        self.blocks = [_Block(index["prefixes"][b[0]], *b[1:]) for b in index["blocks"]]
        self.genotypes = options.get("genotypes", "true") == "true"
        self.count_a2 = options.get("countAllele", "a1") == "a2"
        self.chroms = json.loads(options.get("chroms", "null"))
        self.region = json.loads(options.get("region", "null"))

    def __getstate__(self):
        """What every task gets: all but the blocks, of which a task's own comes as its partition."""
        return {k: v for k, v in self.__dict__.items() if k != "blocks"}

    def partitions(self):
        return self.blocks or [_Block()]

    def read(self, block):
        import numpy as np
        import pyarrow as pa

        if not block.lines:
            return
        names = _bim_lines(block)
        wanted = [k for k, f in enumerate(names) if self._wanted(block.numbers[f[0]], int(f[3]))]
        width = -(-block.samples // 4)
        step = max(1, BATCH_CELLS // max(1, block.samples))
        table = decode_table(self.count_a2)
        for at in range(0, len(wanted), step):
            rows = wanted[at : at + step]
            part = [names[k] for k in rows]
            columns = [
                pa.array([block.numbers[f[0]] for f in part], pa.int32()),
                pa.array([block.offset + block.row + k for k in rows], pa.int64()),
                pa.array([f[1] for f in part], pa.string()),
                pa.array([float(f[2]) for f in part], pa.float64()),
                pa.array([int(f[3]) for f in part], pa.int64()),
                pa.array([f[4] for f in part], pa.string()),
                pa.array([f[5] for f in part], pa.string()),
            ]
            labels = ["chrom", "variant_idx", "snp", "cm", "pos", "a1", "a2"]
            if self.genotypes:
                first, last = rows[0], rows[-1]
                raw = _bytes(block.prefix + ".bed", 3 + (block.row + first) * width, (last - first + 1) * width)
                packed = np.frombuffer(raw, np.uint8).reshape(-1, width)[[k - first for k in rows]]
                cells = table[packed].reshape(len(rows), width * 4)[:, : block.samples].ravel()
                values = pa.array(cells, mask=cells == MISSING)
                offsets = np.arange(len(rows) + 1, dtype=np.int32) * block.samples
                columns.append(pa.ListArray.from_arrays(offsets, values))
                labels.append("dosage")
            yield pa.RecordBatch.from_arrays(columns, names=labels)

    def _wanted(self, chrom, pos):
        if self.chroms is not None and chrom not in self.chroms:
            return False
        return self.region is None or (chrom == self.region[0] and self.region[1] <= pos <= self.region[2])


class FilteringBedReader(BedReader):
    """Also leaves out blocks that filters on chromosome or position rule out.

    Spark still applies every filter to the rows. A reader may only have ``pushFilters`` in
    sessions that allow it (``spark.sql.python.filterPushdown.enabled``).
    """

    def pushFilters(self, filters):
        for f in filters:
            if getattr(f, "attribute", None) in (("chrom",), ("pos",)):
                self.blocks = [b for b in self.blocks if _may_hold(b, f)]
            yield f


def _may_hold(block, f) -> bool:
    """False when no row of the block can pass the filter."""
    if f.attribute == ("chrom",):
        lo, hi, values = min(block.chroms, default=0), max(block.chroms, default=-1), block.chroms
    else:
        lo, hi, values = block.pos_lo, block.pos_hi, None
    if isinstance(f, (EqualTo, In)):
        wanted = [f.value] if isinstance(f, EqualTo) else f.value
        return any(v in values if values is not None else lo <= v <= hi for v in wanted if v is not None)
    if isinstance(f, (GreaterThan, GreaterThanOrEqual)):
        return hi > f.value or (isinstance(f, GreaterThanOrEqual) and hi == f.value)
    if isinstance(f, (LessThan, LessThanOrEqual)):
        return lo < f.value or (isinstance(f, LessThanOrEqual) and lo == f.value)
    return True


def _bim_lines(block):
    """The split lines of one block, which begins at a line start."""
    path, text, at = block.prefix + ".bim", b"", block.start
    size = _size(path)
    while text.count(b"\n") < block.lines and at < size:
        more = _bytes(path, at, min(max(block.lines * TYPICAL_BIM_LINE, 1 << 16), size - at))
        text += more
        at += len(more)
    return [line.decode().split() for line in text.split(b"\n") if line.strip()][: block.lines]


def decode_table(count_a2: bool):
    """Byte to four dosages."""
    import numpy as np

    table = np.empty((256, 4), np.int8)
    for byte in range(256):
        for k in range(4):
            copies = A1_COPIES[(byte >> (2 * k)) & 0b11]
            table[byte, k] = 2 - copies if count_a2 and copies != MISSING else copies
    return table


def read_fam(spark: SparkSession, path: str) -> DataFrame:
    """Sample table with row number ``i``."""
    parts = F.split(F.trim("value"), r"\s+")
    named = [parts[k].alias(n) for k, n in enumerate(("fid", "iid", "father", "mother", "sex", "pheno"))]
    lines = with_row_index(spark.read.text(path).filter(F.length(F.trim("value")) > 0))
    return lines.select(*named, F.col("i").cast("bigint").alias("i"))


def read_plink(
    spark: SparkSession,
    prefixes,
    missing_ok: bool = True,
    chroms=None,
    region=None,
    count_allele: str = "a1",
    target_bytes: int | None = None,
    contigs: DataFrame | None = None,
) -> PlinkData:
    """``PlinkData(variants, samples, packed, contigs)`` of one or more file trios over the same samples.

    ``packed`` has one row per variant with ``dosage array<tinyint>``; ``variants`` is the
    same without touching the genotypes. ``chroms`` and ``region=(chrom, start, end)`` skip
    whole blocks before any genotype is read. A missing trio is reported and skipped. ``contigs``
    numbers the names that are no chromosomes (``contig_dictionary``); given a known dictionary, the
    files' new names are added to it.
    """
    if count_allele not in ("a1", "a2"):
        raise ValueError("count_allele is 'a1' or 'a2'")
    prefixes = [prefixes] if isinstance(prefixes, str) else list(prefixes)
    present = []
    for p in prefixes:
        absent = [p + e for e in (".bed", ".bim", ".fam") if _size(p + e) is None]
        if absent and not missing_ok:
            raise FileNotFoundError(absent[0])
        if absent:
            log.warning("skipping %s: no such file", ", ".join(absent))
        else:
            present.append(p)
    if not present:
        raise FileNotFoundError("none of the given file trios exists")

    ship_package(spark)
    spark.dataSource.register(BimIndexSource)
    spark.dataSource.register(BedSource)

    samples = read_fam(spark, present[0] + ".fam").withColumns({"sample_id": F.col("iid"), "sample_idx": F.col("i")})
    n = samples.count()
    if len(present) > 1:
        _same_samples(spark, present, n)

    width = -(-n // 4)
    if target_bytes is None:
        # small inputs still give every core a task
        total = sum(_size(p + ".bed") for p in present)
        share = total // (2 * spark.sparkContext.defaultParallelism)
        target_bytes = max(min(TARGET_BYTES, max(LEAST_BYTES, share)), total // MOST_TASKS)
    block_bytes = max(4096, TYPICAL_BIM_LINE * target_bytes // max(1, width))
    found = (
        spark.read.format("plink_bim_index")
        .option("files", json.dumps([p + ".bim" for p in present]))
        .option("blockBytes", str(block_bytes))
        .load()
    )
    found = stored(found, "plink-blocks")
    contigs = stored(contig_dictionary(found.select(F.explode("contigs").alias("contig")), contigs), "contigs")
    index = found.orderBy("file", "start").collect()  # one row per read task
    numbers = {r["contig"]: r["chrom"] for r in contigs.where(F.col("chrom") >= CONTIG_BASE).collect()}  # names that are no chromosomes
    of_file = defaultdict(list)
    for b in index:
        of_file[b["file"]].append(b)
    blocks, offset = [], 0
    for i, prefix in enumerate(present):
        row = 0
        for b in of_file[i]:
            own = {name: numbers.get(name) or chromosome_number(name) for name in b["contigs"]}
            if _touches(set(own.values()), b, chroms, region):
                blocks.append((i, n, b["start"], b["lines"], row, offset, own, b["pos_lo"], b["pos_hi"]))
            row += b["lines"]
        expected = 3 + row * width
        if _size(prefix + ".bed") != expected or _bytes(prefix + ".bed", 0, 3) != MAGIC:
            raise ValueError(f"{prefix}.bed is not a variant-major file of {row} variants and {n} samples")
        offset += row

    # the list of blocks goes to the shared folder; plans and tasks only name it
    place = f"{shared_folder(spark)}/plink-index-{uuid.uuid4().hex[:12]}.json"
    write_file(place, json.dumps({"prefixes": present, "blocks": blocks}).encode())

    def load(genotypes):
        reader = spark.read.format("plink_bed").option("index", place).option("genotypes", genotypes)
        reader = reader.option("countAllele", count_allele)
        reader = reader.option("pushdown", spark.conf.get("spark.sql.python.filterPushdown.enabled", "false"))
        if chroms is not None:
            reader = reader.option("chroms", json.dumps(sorted(chroms)))
        if region is not None:
            reader = reader.option("region", json.dumps(list(region)))
        return reader.load()

    return PlinkData(load("false"), samples, load("true"), contigs)


def _touches(numbers, block, chroms, region) -> bool:
    if chroms is not None and not set(chroms) & numbers:
        return False
    if region is not None:
        chrom, start, end = region
        return chrom in numbers and block["pos_lo"] <= end and block["pos_hi"] >= start
    return True


def _same_samples(spark, prefixes, n):
    fams = union_all([read_fam(spark, p + ".fam").select("i", "fid", "iid") for p in prefixes])
    bad = (
        fams.groupBy("i")
        .agg(F.count_distinct("fid", "iid").alias("k"), F.count(F.lit(1)).alias("c"))
        .filter((F.col("k") != 1) | (F.col("c") != len(prefixes)))
    )
    if bad.limit(1).count():
        raise ValueError("the .fam files do not list the same samples in the same order")
