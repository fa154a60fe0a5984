"""Typing reports as one XML document: a header that counts its samples, and the samples."""

import uuid
from collections import namedtuple
from collections.abc import Iterator
from xml.sax.saxutils import quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from genopair.session import ship_package
from genopair.sources.bgzf import END_OF_FILE, MOST_IN_BLOCK, Blocks, compress, is_block_gzip, pieces
from genopair.storage import file_size, files_in, filesystem_of, make_folder, read_range, remove_folder, write_file

# Fixed values of the format.
DECLARATION = '<?xml version="1.0" encoding="UTF-8"?>\n'
SCHEMA_PLACE = "http://schemas.nmdp.org/spec/hml/1.0.1 http://schemas.nmdp.org/spec/hml/1.0.1/hml-1.0.1.xsd"
INSTANCE = "http://www.w3.org/2001/XMLSchema-instance"
SAMPLE_COUNT = "SampleCount"

COPY_BYTES = 8 << 20
RANGE_BYTES = 2 << 20  # of a compressed document that a task reads
BATCH_BYTES = 4 << 20
ROWS_AT_ONCE = 512  # samples of which a task holds copies

HmlData = namedtuple("HmlData", "properties samples")


def _blocks(texts) -> Iterator[bytes]:
    """Texts as blocks of gzip."""
    held = bytearray()
    for text in texts:
        held += text
        while len(held) >= MOST_IN_BLOCK:
            yield compress(bytes(held[:MOST_IN_BLOCK]))
            del held[:MOST_IN_BLOCK]
    if held:
        yield compress(bytes(held))


class _Part(WriterCommitMessage):
    def __init__(self, name, samples):
        self.name, self.samples = name, samples


class HmlSource(DataSource):
    """Elements as parts of a document; the header is written when all are counted."""

    @classmethod
    def name(cls):
        return "hml_document"

    def writer(self, schema, overwrite):
        return HmlWriter(self.options)


class HmlWriter(DataSourceArrowWriter):
    """Tasks stream their samples to a folder of the job's own and tell how many there are.

    The commit writes the header with the sum, moves the parts between it and the end of the document, and
    leaves a folder whose files, in the order of their names, are the document. An aborted job leaves nothing.
    """

    def __init__(self, options):
        self.path = options["path"].rstrip("/")
        self.head = options["head"]
        self.compressed = options.get("compressed") == "true"
        self.waiting = f"{self.path}/_temporary-{uuid.uuid4().hex[:12]}"
        # made here and by no task, so that one that is still stopping does not make it anew once it is cleared
        make_folder(self.waiting)

    def _in_file(self, texts) -> Iterator[bytes]:
        return _blocks(texts) if self.compressed else iter(texts)

    def write(self, iterator):
        from pyspark import TaskContext

        name = f"part-1-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:8]}.xml{'.gz' if self.compressed else ''}"
        filesystem, p = filesystem_of(f"{self.waiting}/{name}")
        samples = 0

        def elements():
            nonlocal samples
            for batch in iterator:
                for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                    for element in batch.column(0).slice(at, ROWS_AT_ONCE).to_pylist():
                        samples += 1
                        yield element.encode() + b"\n"

        with filesystem.open_output_stream(p, compression=None) as f:
            for content in self._in_file(elements()):
                f.write(content)
        return _Part(name, samples)

    def commit(self, messages):
        filesystem, path = filesystem_of(self.path)
        parts = [m for m in messages if m and m.samples]
        count = f"  <property name={quoteattr(SAMPLE_COUNT)} value={quoteattr(str(sum(m.samples for m in parts)))}></property>\n"
        kind = ".xml.gz" if self.compressed else ".xml"
        write_file(f"{self.path}/part-0-header{kind}", b"".join(self._in_file([(self.head + count).encode()])))
        for m in parts:
            filesystem.move(f"{filesystem_of(self.waiting)[1]}/{m.name}", f"{path}/{m.name}")
        write_file(f"{self.path}/part-2-end{kind}", b"".join(self._in_file([b"</hml>\n"])) + (END_OF_FILE if self.compressed else b""))
        remove_folder(self.waiting)

    def abort(self, messages):
        remove_folder(self.waiting)


def write_hml_document(report: DataFrame, path: str, project: str, properties: dict | None = None, hml_id: tuple | None = None, center: str | None = None, version: str = "1.0.1", compressed: bool = False) -> None:
    """``report`` (one ``sample`` element per row) as a document in a new folder.

    ``properties`` stand in its header by name and value, then the number of samples, which the tasks count;
    ``hml_id`` is (root, extension) and ``center`` the reporting center. ``compressed`` writes block-gzip, whose files
    are one such file, too, in the order of their names: markup repeats, and takes a twentieth of the space so.
    """
    spark = report.sparkSession
    if files_in(path):
        raise ValueError(f"{path} holds files already")
    ship_package(spark)
    spark.dataSource.register(HmlSource)
    root = f"<hml xmlns:xsi={quoteattr(INSTANCE)} project-name={quoteattr(project)} version={quoteattr(version)} xsi:schemaLocation={quoteattr(SCHEMA_PLACE)}>\n"
    lines = [DECLARATION, root]
    if hml_id is not None:
        lines.append(f"  <hmlid root={quoteattr(hml_id[0])} extension={quoteattr(hml_id[1])}></hmlid>\n")
    if center is not None:
        lines.append(f"  <reporting-center reporting-center-id={quoteattr(center)}></reporting-center>\n")
    lines += [f"  <property name={quoteattr(k)} value={quoteattr(v)}></property>\n" for k, v in (properties or {}).items()]
    element = F.to_xml(F.struct(*[F.col(f"`{c}`") for c in report.columns]), {"rowTag": "sample", "attributePrefix": "_"})
    report.select(element.alias("element")).write.format("hml_document").mode("append").option("path", path).option("head", "".join(lines)).option("compressed", compressed).save()


def join_document(path: str, to: str) -> int:
    """The document in one file, copied part by part a few megabytes at a time; returns its size.

    It is block-gzip where the name ends in ``.gz``, as compressed parts are already, and plain text otherwise.
    """
    filesystem, p = filesystem_of(to)
    size, parts = 0, files_in(path)
    as_they_are = all(part.endswith(".gz") == to.endswith(".gz") for part in parts)
    with filesystem.open_output_stream(p, compression=None) as out:
        if as_they_are:
            contents = (read_range(part, at, COPY_BYTES) for part in parts for at in range(0, file_size(part), COPY_BYTES))
        elif to.endswith(".gz"):
            contents = (c for texts in (_texts(parts), None) for c in (_blocks(texts) if texts else [END_OF_FILE]))
        else:
            contents = _texts(parts)
        for content in contents:
            size += out.write(content)
    return size


def _texts(parts: list) -> Iterator[bytes]:
    for part in parts:
        if part.endswith(".gz"):
            yield from (text for _, text in Blocks(part).from_(0))
        else:
            yield from (read_range(part, at, COPY_BYTES) for at in range(0, file_size(part), COPY_BYTES))


def _cut(spark: SparkSession, path, separator: str) -> DataFrame:
    """A file's text cut at a separator, read in ranges of plain text or of blocks: ``value``."""
    size = file_size(path) if isinstance(path, str) else None
    if not size or not is_block_gzip(read_range(path, 0, 512)):
        return spark.read.option("lineSep", separator).text(path)
    ship_package(spark)
    ranges = -(-size // RANGE_BYTES)

    def read(batches):
        for batch in batches:
            for k in batch.column("id").to_pylist():
                held, waiting = [], 0
                for found in pieces(Blocks(path), k * RANGE_BYTES, (k + 1) * RANGE_BYTES, separator.encode()):
                    held += found
                    waiting += sum(map(len, found))
                    if waiting > BATCH_BYTES:
                        yield _values(held)
                        held, waiting = [], 0
                if held:
                    yield _values(held)

    return spark.range(0, ranges, 1, ranges).mapInArrow(read, "value string")


def _values(texts: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()).cast(pa.string())], names=["value"])


def read_hml_document(spark: SparkSession, path, schema) -> HmlData:
    """``HmlData(properties, samples)``: name and value of the document's properties, and its ``sample`` elements as rows of ``schema``.

    Spark's XML reader gives a whole file to one task. Here a line ends where a sample does, so tasks read ranges
    of the file, compressed in blocks or not; what stands before a line's sample, as the header does, is looked through for properties. Documents
    are as ``write_hml_document`` writes them: elements with end tags, no markup quoted in comments or CDATA.
    """
    lines = _cut(spark, path, "</sample>")
    value = F.col("value")
    start = F.regexp_instr(value, F.lit(r"<sample[\s>]"))
    # the last line is the document's end, or what a sample cut off leaves, which is refused
    before = F.when(start > 0, F.substring(value, F.lit(1), start - 1)).otherwise(value)
    found = lines.select(F.explode(F.regexp_extract_all(before, F.lit(r"(<property\s[^>]*>)"), 1)).alias("p"))
    parsed = F.from_xml(F.concat(F.regexp_replace("p", r"/?>$", ">"), F.lit("</property>")), "_name string, _value string", {"rowTag": "property"})
    properties = found.select(parsed.alias("p")).select(F.col("p._name").alias("name"), F.col("p._value").alias("value"))
    element = F.concat(F.substring(value, start, F.length(value)), F.lit("</sample>"))
    whole = F.when(F.contains(value, F.lit("</hml>")), F.raise_error(F.lit("a sample without its end"))).otherwise(element)
    # columns of a generator, so that each sample is parsed once whatever is read of it
    samples = lines.where(start > 0).select(F.inline_outer(F.array(F.from_xml(whole, schema, {"rowTag": "sample", "mode": "FAILFAST"}))))
    return HmlData(properties, samples)
