"""Block-gzip VCF as a Spark data source: ranges of blocks are read, and parts written, by tasks of their own."""

import json
import uuid
from bisect import bisect_right
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from genopair.session import shared_folder, ship_package
from genopair.sources.bgzf import END_OF_FILE, MOST_IN_BLOCK, Blocks, Index, IndexBuilder, compress, is_block_gzip, lines
from genopair.storage import file_size, files_in, filesystem_of, make_folder, read_range, remove_folder, write_file

RANGE_BYTES = 16 << 20  # compressed bytes of a read task
BATCH_BYTES = 8 << 20  # text of an Arrow batch


def in_blocks(paths: list[str]) -> bool:
    """Whether all files of the paths are block-gzip ones. Patterns, and places that only Spark reads, count as others."""
    if any(c in p for p in paths for c in "*?[{"):
        return False
    try:
        for p in paths:
            filesystem_of(p)
    except pa.ArrowInvalid:
        return False
    files = [f for p in paths for f in files_in(p) if not f.endswith(".tbi")]
    return bool(files) and all(f.endswith((".gz", ".bgz")) and is_block_gzip(read_range(f, 0, min(512, file_size(f) or 0))) for f in files)


def data_files(paths: list[str]) -> list[str]:
    return [f for p in paths for f in files_in(p) if not f.endswith(".tbi")]


def headers(spark: SparkSession, files: list[str]) -> DataFrame:
    """file and header of every file: its ``#CHROM`` line, null where it has none. Tasks read the first blocks alone."""
    ship_package(spark)
    listed = spark.createDataFrame(list(enumerate(files)), "number bigint, file string")
    spread = listed.repartition(max(1, min(len(files), 4 * spark.sparkContext.defaultParallelism)), "number")

    def run(batches):
        for batch in batches:
            found = [_header(f) for f in batch["file"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["file"], pa.array(found, pa.string())], names=["file", "header"])

    return spread.mapInArrow(run, "file string, header string")


def _header(file: str) -> str | None:
    blocks = Blocks(file)
    for group in lines(blocks, 0, blocks.size):
        for line in group:
            if line.startswith(b"#CHROM"):
                return line.decode()
            if line and not line.startswith(b"#"):
                return None
    return None


def whole_ranges(files: list[str], range_bytes: int) -> list[tuple]:
    """(file number, start, end, skip, stop) over all files."""
    out = []
    for k, f in enumerate(files):
        size = file_size(f) or 0
        out += [(k, at, min(at + range_bytes, size), None, None) for at in range(0, size, range_bytes)]
    return out


def region_ranges(files: list[str], names, start: int, end: int, range_bytes: int) -> list[tuple]:
    """The ranges that hold positions ``start`` to ``end`` of the contigs that ``names`` accepts, by each file's index."""
    out = []
    for k, f in enumerate(files):
        index = Index(read_range(f + ".tbi", 0, file_size(f + ".tbi")))
        for name in filter(names, index.names):
            for a, b in index.chunks(name, max(start - 1, 0), end):
                first, last = a >> 16, b >> 16
                # cuts are places of blocks, so that every range but the last ends before the chunk does
                between = (Blocks(f).first_from(at) for at in range(first + range_bytes, last, range_bytes))
                cuts = [first, *sorted({c for c in between if first < c < last}), last]
                for lo, hi in zip(cuts, cuts[1:]):
                    out.append((k, lo, hi, a & 0xFFFF if lo == first else None, b & 0xFFFF if hi == last else None))
    return out


class _Range(InputPartition):
    def __init__(self, file="", number=0, start=0, end=0, skip=None, stop=None):
        self.file, self.number, self.start, self.end, self.skip, self.stop = file, number, start, end, skip, stop


class BlockTextSource(DataSource):
    """Lines of ranges of blocks, without those that begin with ``#``: file (its number) and value."""

    @classmethod
    def name(cls):
        return "block_gzip_lines"

    def schema(self):
        return "file int, value string"

    def reader(self, schema):
        return BlockTextReader(self.options["plan"])


class BlockTextReader(DataSourceReader):
    def __init__(self, plan: str):
        self.plan = plan

    def partitions(self):
        plan = json.loads(read_range(self.plan, 0, file_size(self.plan)))
        return [_Range(plan["files"][r[0]], *r) for r in plan["ranges"]] or [_Range()]

    def read(self, part):
        if not part.file:
            return
        values, size = [], 0
        for group in lines(Blocks(part.file), part.start, part.end, part.skip, part.stop):
            for line in group:
                if line and not line.startswith(b"#"):
                    values.append(line[:-1] if line.endswith(b"\r") else line)
                    size += len(line)
            if size > BATCH_BYTES:
                yield self._batch(part.number, values)
                values, size = [], 0
        if values:
            yield self._batch(part.number, values)

    @staticmethod
    def _batch(number, values):
        return pa.RecordBatch.from_arrays([pa.array([number] * len(values), pa.int32()), pa.array(values, pa.binary()).cast(pa.string())], names=["file", "value"])


def read_lines(spark: SparkSession, files: list[str], ranges: list[tuple]) -> DataFrame:
    """Record lines of the given ranges, a task for each."""
    ship_package(spark)
    spark.dataSource.register(BlockTextSource)
    plan = f"{shared_folder(spark)}/vcf-ranges-{uuid.uuid4().hex[:12]}.json"
    write_file(plan, json.dumps({"files": files, "ranges": ranges}).encode())
    return spark.read.format("block_gzip_lines").option("plan", plan).load()


# --- writing ---------------------------------------------------------------------------------------


class _Part(WriterCommitMessage):
    def __init__(self, names):
        self.names = names


class BlockVcfSource(DataSource):
    """Records as parts of a VCF folder, each with its header and its index."""

    @classmethod
    def name(cls):
        return "block_gzip_vcf"

    def writer(self, schema, overwrite):
        return BlockVcfWriter(self.options, overwrite)


class BlockVcfWriter(DataSourceArrowWriter):
    """Each task writes to a folder of its job's own; what the tasks named is moved into place when all are done."""

    def __init__(self, options, overwrite):
        self.path, self.header = options["path"].rstrip("/"), options["header"]
        self.block = int(options.get("blockBytes", MOST_IN_BLOCK))
        self.waiting = f"{self.path}/_temporary-{uuid.uuid4().hex[:12]}"
        self.overwrite = overwrite
        # made here and by no task, so that one that is still stopping does not make it anew once it is cleared
        make_folder(self.waiting)

    def write(self, iterator):
        from pyspark import TaskContext

        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex[:8]}.vcf.gz"
        index, text, out, file = IndexBuilder(), bytearray(), None, None
        # where blocks begin, in the text and in the file; the last one is yet to be written
        in_text, in_file, pending = [0], [0], deque()

        def virtual(at):
            k = bisect_right(in_text, at) - 1
            return in_file[k] << 16 | at - in_text[k]

        def flush(size):
            block = compress(bytes(text[:size]))
            file.write(block)
            del text[:size]
            in_text.append(in_text[-1] + size)
            in_file.append(in_file[-1] + len(block))
            while pending and pending[0][-1] <= in_text[-1]:
                *record, first, last = pending.popleft()
                index.add(*record, virtual(first), virtual(last))
            keep = bisect_right(in_text, pending[0][-2] if pending else in_text[-1]) - 1
            del in_text[:keep], in_file[:keep]

        for batch in iterator:
            contigs, positions, values = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("contig", "pos", "value"))
            if file is None and values:
                out = f"{self.waiting}/{name}"
                filesystem, p = filesystem_of(out)
                file = filesystem.open_output_stream(p, compression=None)  # the blocks are compressed already
                text += read_range(self.header, 0, file_size(self.header))
            for contig, pos, value in zip(contigs, positions, values):
                first = in_text[-1] + len(text)
                text += value.encode() + b"\n"
                length = max(1, len(value.split("\t", 4)[3]))  # of the reference allele
                pending.append((contig, pos - 1, pos - 1 + length, first, in_text[-1] + len(text)))
                while len(text) >= self.block:
                    flush(self.block)
        if file is None:
            return _Part([])
        while text:
            flush(min(self.block, len(text)))
        file.write(END_OF_FILE)
        file.close()
        with filesystem.open_output_stream(p + ".tbi", compression=None) as f:
            f.write(index.content())
        return _Part([name, name + ".tbi"])

    def commit(self, messages):
        filesystem, path = filesystem_of(self.path)
        if self.overwrite:
            for f in files_in(self.path):
                filesystem.delete_file(filesystem_of(f)[1])
        for m in messages:
            for name in m.names if m else []:
                filesystem.move(f"{filesystem_of(self.waiting)[1]}/{name}", f"{path}/{name}")
        remove_folder(self.waiting)

    def abort(self, messages):
        remove_folder(self.waiting)


def write_blocks(records: DataFrame, header: str, path: str, block_bytes: int = MOST_IN_BLOCK, mode: str = "append") -> None:
    """``contig, pos, value`` (a VCF line) as a folder of block-gzip files with indexes; ``header`` is their text before the records.

    Rows must come with each contig's positions rising in a partition: every partition is a file.
    """
    spark = records.sparkSession
    ship_package(spark)
    spark.dataSource.register(BlockVcfSource)
    place = f"{shared_folder(spark)}/vcf-header-{uuid.uuid4().hex[:12]}.txt"
    write_file(place, header.encode())
    rows = records.select("contig", "pos", "value")
    rows.write.format("block_gzip_vcf").mode(mode).option("path", path).option("header", place).option("blockBytes", str(block_bytes)).save()
