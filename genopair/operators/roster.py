"""Pairs as small integers that every task of a scan can look up.

A pair is two array slots and a class number. Spark writes them to the shared folder as tiles, Arrow
files of bounded size whatever the number of pairs; a task maps them into memory, so genotypes are
paired, coded and counted where they are read. Every batch of genotypes meets every tile in the
task, and counts are added there: one pass over the genotypes, the same rows for any number of
tiles, and nothing of the pairs on the driver but the tiles' names.
"""

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genopair.session import shared_folder, ship_package
from genopair.storage import read_arrow, write_arrow

TILE_BYTES = 64 << 20
CELLS_PER_STEP = 1 << 18  # pairs by rows at a time: what is made of them stays in a processor's cache
TALLY_BYTES = 32 << 20  # counts that wait for the rest of their batch
WORD_BITS = 64  # pairs whose bits one machine word holds
BYTE_ROWS = 4  # rows whose numbers below 4 one byte holds
BYTE_BITS = 8
PAIRS_PER_STEP = 1 << 17  # pairs whose bits are made at a time, whole words; these stay in a processor's cache too
SLOTS_PER_STEP = 1 << 18  # the same for numbers of samples
PACKED_BYTES = 8 << 20  # of rows that meet a tile together

ABSENT = -1


def pair_slots(pairs: DataFrame, samples: DataFrame) -> DataFrame:
    """Array slots of both samples of every pair: ``case_id, d, r`` (NULL when absent).

    Pairs of which neither sample is known have no row; a case with two pairs has two.
    """
    slots = samples.select("sample_id", F.col("sample_idx").cast("int").alias("_slot"))
    donors = slots.select(F.col("sample_id").alias("did"), F.col("_slot").alias("d"))
    recipients = slots.select(F.col("sample_id").alias("rid"), F.col("_slot").alias("r"))
    both = pairs.join(donors, "did", "left").join(recipients, "rid", "left")
    return both.where("d IS NOT NULL OR r IS NOT NULL").select("case_id", "d", "r")


@dataclass(frozen=True)
class Tiles:
    """The pairs of a scan: paths of Arrow files, and the most pairs one of them holds."""

    paths: tuple
    most: int

    def tables(self) -> Iterator[tuple[int, pa.Table]]:
        """Each tile with its number. A mapped one costs nothing to look at again; any other is read anew, and one is held at a time."""
        kept = self.__dict__.setdefault("_kept", {})
        for k, path in enumerate(self.paths):
            if k not in kept:
                table, mapped = read_arrow(path)
                if not mapped and len(self.paths) > 1:
                    yield k, table
                    continue
                kept[k] = table
            yield k, kept[k]

    def __getstate__(self):
        return {"paths": self.paths, "most": self.most}

    def __setstate__(self, state):
        self.__dict__.update(state)


def write_tiles(roster: DataFrame, order: Column, by_case: bool = False, in_classes: bool = False) -> Tiles:
    """The rows of a roster as tiles of about ``TILE_BYTES``, cut by the hash of ``order``.

    Slots and class numbers become plain integers, ``ABSENT`` where there is none. ``by_case`` adds
    ``case_no``, a number for each case of a tile; ``order`` must then keep a case in one tile.
    ``in_classes`` lays the pairs out for ``scan_joint_counts``: by class, each filled up to whole words.
    """
    spark = roster.sparkSession
    ship_package(spark)
    plain = [F.coalesce(F.col(f.name).cast("int"), F.lit(ABSENT)).alias(f.name) if f.name in ("d", "r", "cls") else F.col(f.name) for f in roster.schema.fields]
    roster = roster.select(*plain)
    wide = [f.name for f in roster.schema.fields if f.dataType.typeName() in ("string", "binary")]
    size = F.lit(8 * len(roster.columns)) + sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in wide), F.lit(0))
    total = roster.agg(F.sum(size.cast("bigint"))).first()[0] or 0
    n = max(1, -(-total // TILE_BYTES))
    folder = f"{shared_folder(spark)}/roster-{uuid.uuid4().hex[:12]}"

    def write(table: pa.Table) -> pa.Table:
        # A path of its own for each attempt: the one that Spark takes names the file that is read.
        path = f"{folder}/{table['_tile'][0].as_py():06d}-{uuid.uuid4().hex[:8]}.arrow"
        table = table.drop_columns(["_tile"])
        if by_case:
            codes = pc.dictionary_encode(table["case_id"].combine_chunks(), null_encoding="encode").indices
            table = table.append_column("case_no", codes.cast(pa.int32()))
        if in_classes:
            table = _in_classes(table)
        write_arrow(path, table)
        return pa.table({"path": [path], "pairs": pa.array([len(table)], pa.int64())})

    cut = roster.withColumn("_tile", F.pmod(F.xxhash64(order), F.lit(n)).cast("int"))
    written = cut.groupBy("_tile").applyInArrow(write, "path string, pairs bigint").collect()  # one row per tile
    if not written:
        empty = roster.limit(0).toArrow()
        if by_case:
            empty = empty.append_column("case_no", pa.array([], pa.int32()))
        write_arrow(f"{folder}/empty.arrow", empty)
        return Tiles((f"{folder}/empty.arrow",), 0)
    written.sort(key=lambda w: w["path"])
    return Tiles(tuple(w["path"] for w in written), max(w["pairs"] for w in written))


def _in_classes(table: pa.Table) -> pa.Table:
    """``d, r, cls`` by class and slot; every class is filled up to whole words with pairs of two absent samples."""
    cls, d = column(table, "cls"), column(table, "d")
    order = np.lexsort((d, cls))
    found, sizes = np.unique(cls, return_counts=True)
    ends = np.cumsum(-(-sizes // WORD_BITS) * WORD_BITS)
    starts = np.append(0, ends[:-1])
    at = np.arange(len(cls)) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    sides = {name: np.full(ends[-1], ABSENT, np.int32) for name in ("d", "r")}
    for name, side in sides.items():
        side[at] = column(table, name)[order]
    return pa.table({**sides, "cls": np.repeat(found, np.diff(ends, prepend=0)).astype(np.int32)})


def column(table: pa.Table, name: str) -> np.ndarray:
    """A column of plain integers of a tile, as it lies in the file."""
    chunks = table[name].chunks
    return chunks[0].to_numpy() if len(chunks) == 1 else table[name].to_numpy()


def matrix(column: pa.Array, absent: int = ABSENT) -> np.ndarray:
    """Lists of small integers as rows of a matrix with one more column, which reads as absent at slot -1.

    Shorter and missing lists are absent in the rest of their row.
    """
    lengths = np.diff(column.offsets.to_numpy())
    if column.null_count:
        lengths = np.where(column.is_valid().to_numpy(zero_copy_only=False), lengths, 0)
    flat = column.flatten().fill_null(absent).to_numpy(zero_copy_only=False)
    width = int(lengths.max(initial=0))
    out = np.full((len(column), width + 1), absent, np.int16)
    if len(flat) == len(column) * width:
        out[:, :width] = flat.reshape(len(column), width)
    else:
        out[:, :width][np.arange(width) < lengths[:, None]] = flat
    return out


def paired_steps(batch: pa.RecordBatch, values: tuple, tiles: Tiles, per_sample: Callable | None = None) -> Iterator[tuple[slice, Iterator]]:
    """Rows of a batch, a few at a time, each with an iterator over the tiles.

    That gives a tile's number, its table, and the donors' and then the recipients' values of its
    pairs. ``per_sample`` makes one number of a sample's values first, so that one is looked up.
    """
    step = max(1, CELLS_PER_STEP // max(1, tiles.most))
    for at in range(0, batch.num_rows, step):
        part = batch.slice(at, step)
        rows = [matrix(part.column(part.schema.get_field_index(v))) for v in values]
        if per_sample is not None:
            rows = [per_sample(*_same_width(rows))]

        def meetings(rows=rows):
            for k, table in tiles.tables():
                # a slot beyond a row's list is absent as well
                sides = [m[:, np.where(s < m.shape[1] - 1, s, ABSENT)] for s in (column(table, "d"), column(table, "r")) for m in rows]
                yield k, table, sides

        yield slice(at, at + part.num_rows), meetings()


def _same_width(rows: list) -> list:
    width = max(m.shape[1] for m in rows)
    # the absent column stays the last one
    return [m if m.shape[1] == width else np.concatenate([m, np.full((len(m), width - m.shape[1]), ABSENT, m.dtype)], axis=1) for m in rows]


def histograms(cells: np.ndarray, classes: np.ndarray, n_cells: int, n_classes: int) -> np.ndarray:
    """Counts by row, cell and class; rows of ``cells`` have one cell number for each pair."""
    rows = np.arange(len(cells), dtype=np.int64)[:, None] * (n_cells * n_classes)
    flat = np.bincount((rows + cells * np.int64(n_classes) + classes).ravel(), minlength=len(cells) * n_cells * n_classes)
    return flat.reshape(len(cells), n_cells, n_classes)


def _output(df: DataFrame, keys: list, extra: str) -> tuple[str, list]:
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return f"{kinds}, {extra}", [*keys, *(c.strip().split(" ")[0] for c in extra.split(","))]


def _rows(batch: pa.RecordBatch, keys: list, where: slice, row: np.ndarray, columns: list, types: list, names: list) -> pa.RecordBatch:
    key_rows = pa.array(row + where.start)
    return pa.RecordBatch.from_arrays(
        [*(batch.column(k).take(key_rows) for k in range(len(keys))), *(c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types))], names=names
    )


def scan_counts(
    df: DataFrame, keys: list, values: tuple, tiles: Tiles, tally: Callable, rows_of: Callable, extra: str, types: list, per_sample: Callable | None = None
) -> DataFrame:
    """One pass: ``tally(sides, tile)`` counts the pairs of a tile for some rows, in an array whose first axis is the row.

    Counts of all tiles are added, and ``rows_of(sum)`` gives the number of each output row's input
    row and the columns named in ``extra``.
    """
    ship_package(df.sparkSession)
    schema, names = _output(df, keys, extra)

    def run(batches):
        for batch in batches:
            waiting, first, size = [], 0, 0
            for where, meetings in paired_steps(batch, values, tiles, per_sample):
                total = None
                for _, table, sides in meetings:
                    part = tally(sides, table)
                    total = part if total is None else total + part
                waiting.append(total)
                size += total.nbytes
                if size > TALLY_BYTES or where.stop == batch.num_rows:
                    yield _rows(batch, keys, slice(first, where.stop), *rows_of(np.concatenate(waiting)), types, names)
                    waiting, first, size = [], where.stop, 0

    return df.select(*keys, *values).mapInArrow(run, schema)


def scan_rows(df: DataFrame, keys: list, values: tuple, tiles: Tiles, rows_of: Callable, extra: str, types: list) -> DataFrame:
    """One pass: ``rows_of(sides, tile)`` gives, for some rows and a tile, the number of each output row's
    input row and the columns named in ``extra``."""
    ship_package(df.sparkSession)
    schema, names = _output(df, keys, extra)

    def run(batches):
        for batch in batches:
            for where, meetings in paired_steps(batch, values, tiles):
                for _, table, sides in meetings:
                    yield _rows(batch, keys, where, *rows_of(sides, table), types, names)

    return df.select(*keys, *values).mapInArrow(run, schema)


def scan_joint_counts(
    df: DataFrame, keys: list, value: str, tiles: Tiles, n_classes: int, number: Callable, rows_of: Callable, extra: str, types: list, sides: tuple = ("d", "r")
) -> DataFrame:
    """One pass: pairs by row, joint cell of the ``sides``' numbers below 4, and class; ``tiles`` are ``in_classes``.

    ``rows_of(counts)`` gives the number of each output row's input row and the columns named in ``extra``. The
    count is a column of the row, so a source that is such a column too hands its lists over inside the task.
    """
    ship_package(df.sparkSession)
    parts = [c.split() for c in extra.split(",")]
    names = [name for name, _ in parts]

    @F.arrow_udf(f"array<struct<{', '.join(f'{name}: {kind}' for name, kind in parts)}>>")
    def count(lists: pa.Array) -> pa.Array:
        row, columns = rows_of(joint_counts(lists, tiles, n_classes, number, sides))
        fields = pa.StructArray.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types)], names=names)
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(lists) + 1)), pa.int32()), fields)

    # outer, so that no filter on the list's size has it made twice; a row without pairs is then dropped
    counted = df.select(*keys, count(value).alias("_found")).select(*keys, F.explode_outer("_found").alias("_f"))
    return counted.where("_f IS NOT NULL").select(*keys, "_f.*")


def joint_counts(lists: pa.Array, tiles: Tiles, n_classes: int, number: Callable, sides: tuple = ("d", "r")) -> np.ndarray:
    """Pairs by row, joint cell ``4 d + r`` and class, where ``number`` makes a sample's value a number below 4, 3 when absent.

    Of one side only, ``("r",)``, the cell is its number. The numbers of ``BYTE_ROWS`` rows lie in one byte, so a pair's
    samples are looked up once for them all. These bytes' bits are transposed: a row's numbers are then two bits of
    either side, ``WORD_BITS`` pairs to a word, and the pairs with a set of bits are counted by word; what has these
    bits and no other follows from that.
    """
    out = np.zeros((len(lists), 4 ** len(sides), n_classes), np.int64)
    packed, size = [], 0
    for at in range(0, len(lists), BYTE_ROWS):
        packed.append(_packed_rows(lists.slice(at, BYTE_ROWS), number))
        size += packed[-1].nbytes
        if size > PACKED_BYTES or at + BYTE_ROWS >= len(lists):
            _add_counts(out[at + BYTE_ROWS - len(packed) * BYTE_ROWS : at + BYTE_ROWS], packed, tiles, sides)
            packed, size = [], 0
    return out


def _add_counts(out: np.ndarray, packed: list, tiles: Tiles, sides: tuple) -> None:
    for _, table in tiles.tables():
        every_cls, slots = column(table, "cls"), {side: column(table, side) for side in ("d", "r")}
        for at in range(0, len(every_cls), PAIRS_PER_STEP):
            here = slice(at, at + PAIRS_PER_STEP)
            cls = every_cls[here]
            first = np.flatnonzero(np.diff(cls, prepend=-1))
            total = np.diff(np.append(first, len(cls)))
            filled = np.add.reduceat((slots["d"][here] == ABSENT) & (slots["r"][here] == ABSENT), first, dtype=np.int64)
            places, width = None, None
            for k, numbers in enumerate(packed):
                if width != len(numbers) - 1:
                    width = len(numbers) - 1
                    places = [_places(slots[side][here], width) for side in sides]
                found = _cells([_bit_planes(numbers, p) for p in places], total, first // WORD_BITS)
                found[-1] -= filled
                rows = out[k * BYTE_ROWS : (k + 1) * BYTE_ROWS]
                rows[:, :, cls[first]] += found.transpose(1, 0, 2)[: len(rows)]


def _places(slots: np.ndarray, width: int) -> np.ndarray:
    """Where the pairs' samples lie in packed rows, a column for each ``BYTE_BITS`` pairs; a slot beyond the rows' lists is absent as well."""
    place = np.minimum(np.asarray(slots, np.int32).view(np.uint32), np.uint32(width))  # a negative one is large as an unsigned one
    return place.reshape(-1, BYTE_BITS).T.astype(np.intp, order="C")


def _bit_planes(numbers: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Bits of the pairs' numbers as words: by row, low and high bit, and word of pairs."""
    bits = numbers.take(places, mode="clip")
    for s, mask in ((4, 0x0F), (2, 0x33), (1, 0x55)):
        both = bits.reshape(BYTE_BITS // (2 * s), 2, -1)
        a, b = both[:, 0], both[:, 1]
        moved = a >> np.uint8(s)
        moved ^= b
        moved &= np.uint8(mask)
        b ^= moved
        moved <<= np.uint8(s)
        a ^= moved
    return bits.view(np.uint64).reshape(BYTE_ROWS, 2, -1)


def _cells(planes: list, total: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Pairs by cell, row and class of those that begin at the words ``first`` and have ``total`` pairs."""
    # bits of the cell's number, lowest first
    bits = [side[:, b] for side in reversed(planes) for b in (0, 1)]
    n_cells = 1 << len(bits)
    found = np.empty((n_cells, BYTE_ROWS, len(first)), np.int64)
    found[0], having = total, [None] * n_cells
    for x in range(1, n_cells):
        low = (x & -x).bit_length() - 1
        having[x] = bits[low] if x & (x - 1) == 0 else having[x & (x - 1)] & bits[low]
        np.add.reduceat(np.bitwise_count(having[x]), first, axis=1, dtype=np.int64, out=found[x])
    for b in range(len(bits)):
        pair = found.reshape(-1, 2, 1 << b, *found.shape[1:])
        pair[:, 0] -= pair[:, 1]
    return found


def _packed_rows(lists: pa.Array, number: Callable) -> np.ndarray:
    """Up to ``BYTE_ROWS`` lists as one byte for each slot, two bits a list, and one more slot that is absent in all."""
    offsets = lists.offsets.to_numpy()
    lengths = np.diff(offsets)
    if lists.null_count:
        lengths = np.where(lists.is_valid().to_numpy(zero_copy_only=False), lengths, 0)
    absent = np.uint8(3)
    out = np.zeros(int(lengths.max(initial=0)) + 1, np.uint8)
    for k, (start, n) in enumerate(zip(offsets.tolist(), lengths.tolist())):
        for at in range(0, n, SLOTS_PER_STEP):
            numbers = _numbers(lists.values.slice(start + at, min(SLOTS_PER_STEP, n - at)), number)
            numbers *= np.uint8(1 << 2 * k)
            out[at : at + len(numbers)] |= numbers
        out[n:] |= absent << np.uint8(2 * k)
    return out


def _numbers(values: pa.Array, number: Callable) -> np.ndarray:
    """Numbers below 4 of plain integers, 3 where they are null."""
    known, content = values.buffers()
    start, n = values.offset, len(values)
    plain = np.frombuffer(content, values.type.to_pandas_dtype())[start : start + n] if n else np.zeros(0, np.int8)
    numbers = number(plain)
    if values.null_count:
        bits = np.unpackbits(np.frombuffer(known, np.uint8)[start // 8 : -(-(start + n) // 8)], bitorder="little")[start % 8 : start % 8 + n]
        bits -= np.uint8(1)  # all bits of a null, none of a value
        numbers |= bits
        numbers &= np.uint8(3)
    return numbers
