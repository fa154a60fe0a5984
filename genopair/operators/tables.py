"""Contingency and frequency tables."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from genopair.functions.encode import MATCH_TYPES
from genopair.functions.encode_arrays import allele_cells, by_genotypes, genotype_number
from genopair.operators.lookup import fits_broadcast, lookup_join
from genopair.operators.packed import status_roster
from genopair.operators.pairs import VARIANT
from genopair.operators.quality import MIN_CALL_RATE, call_rate, repeated_positions
from genopair.operators.roster import column, histograms, paired_steps, write_tiles
from genopair.session import ship_package

LEVELS = {"count": (0, 1, 2), "presence": (0, 1)}
HELD_CELLS = 16 << 20  # sums by case that a task holds at once


def contingency(
    encoded: DataFrame,
    status: DataFrame,
    mode: str = "count",
    on_repeat: str = "sum",
    repeated: DataFrame | None = None,
    floor: int = 0,
    outside: bool = False,
) -> DataFrame:
    """Case/control counts of every code per position: ``case_0.., control_0..``.

    ``mode`` picks the levels: 'count' 0,1,2 and 'presence' 0,1. Missing codes and cases
    without a status are left out, but every position stays, with zeros. Where a position
    holds several variants, a case's codes are summed over them before counting and sums
    outside the levels are dropped (``on_repeat='drop'`` removes such positions instead);
    ``outside=True`` adds their number.

    Given the ``repeated`` positions (from the variant table), only their rows are grouped
    by case; all others collapse on the map side to one row per position, status and code.
    ``floor=1`` lifts empty cells to one, leaving observed counts as they are.
    """
    levels = LEVELS[mode]
    if on_repeat not in ("sum", "drop"):
        raise ValueError("on_repeat is 'sum' or 'drop'")
    if on_repeat == "sum" and repeated is not None and not fits_broadcast(repeated):
        # marking the rows would shuffle them all; grouping every row by case costs the same
        repeated = None
    if on_repeat == "drop":
        if repeated is None:
            repeated = _repeated_in(encoded)
        encoded = lookup_join(encoded, repeated.select("chrom", "pos"), ["chrom", "pos"], "left_anti", salts=1)
    labelled = lookup_join(encoded.select("chrom", "pos", "case_id", "code"), status, ["case_id"], "left")

    if on_repeat == "drop":
        tallied = labelled.groupBy("chrom", "pos", "status", "code").agg(F.count(F.lit(1)).alias("n"))
    elif repeated is None:
        tallied = labelled.groupBy("chrom", "pos", "status", "case_id").agg(F.sum("code").alias("code"))
        tallied = tallied.withColumn("n", F.lit(1))
    else:
        marked = lookup_join(
            labelled, repeated.select("chrom", "pos").withColumn("_rep", F.lit(True)), ["chrom", "pos"], "left", salts=1
        )
        rep = F.col("_rep").isNotNull()
        tallied = (
            marked.groupBy(
                "chrom",
                "pos",
                "status",
                F.when(rep, F.col("case_id")).alias("_case"),
                F.when(~rep, F.col("code")).alias("_code"),
            )
            .agg(F.count(F.lit(1)).alias("_n"), F.sum(F.when(rep, F.col("code"))).alias("_sum"))
            .select(
                "chrom",
                "pos",
                "status",
                F.coalesce(F.col("_code").cast("bigint"), F.col("_sum")).alias("code"),
                F.when(F.col("_case").isNotNull(), F.lit(1)).otherwise(F.col("_n")).alias("n"),
            )
        )

    out = [F.sum(F.when(F.col("status").isin("case", "control") & ~F.col("code").isin(*levels), F.col("n")).otherwise(0)).alias("outside")]
    return tallied.groupBy("chrom", "pos").agg(*_cells(levels, floor), *(out if outside else []))


# A case's sum over the variants of a position before any of them is called.
NO_CODE = np.int32(-1 << 31)


def packed_contingency(
    packed: DataFrame, slots: DataFrame, pairs: DataFrame, status: DataFrame, mode: str = "count", floor: int = 0, outside: bool = False
) -> DataFrame:
    """``contingency`` from packed alleles, in one scan of the genotypes.

    Positions that hold several rows need a case's codes summed over them; those positions are known
    from a look at the positions alone. A task counts every other row where it reads it, and adds up
    the codes of a repeated position's rows by case in arrays, one for each tile of pairs. Only counts
    and these arrays are shuffled, by position; their rows are then streamed in order, sums of several
    tasks are added and counted.
    """
    levels = len(LEVELS[mode])
    ship_package(packed.sparkSession)
    tiles = write_tiles(status_roster(slots, pairs, status), F.col("case_id"), by_case=True)
    cells = by_genotypes(lambda *alleles: allele_cells(mode, *alleles))
    several = repeated_positions(packed.select("chrom", "pos")).withColumn("_rep", F.lit(True))
    rows = lookup_join(packed.select("chrom", "pos", "a1", "a2"), several, ["chrom", "pos"], "left", salts=1)
    rows = rows.select("chrom", "pos", "a1", "a2", F.coalesce("_rep", F.lit(False)).alias("rep"))
    places = ["chrom", "pos"]
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in places)
    counted = [f"{s}_{c}" for s in ("case", "control") for c in LEVELS[mode]] + ["outside"]

    def tabulate(codes: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """Rows of codes, where ``levels`` is one outside the levels and ``levels + 1`` a missing one, as rows of ``counted``."""
        found = histograms(codes, classes, levels + 2, 3)
        return np.concatenate([found[:, :levels, 0], found[:, :levels, 1], found[:, levels : levels + 1, :2].sum(axis=2)], axis=1)

    def sums(codes: np.ndarray, cases: np.ndarray) -> np.ndarray:
        """A row's codes by case; a case with two pairs has the sum of both."""
        out = np.full(int(cases.max(initial=-1)) + 1, NO_CODE, np.int32)
        known = codes < levels
        out[cases[known]] = 0
        np.add.at(out, cases[known], codes[known].astype(np.int32))
        return out

    def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(a == NO_CODE, b, np.where(b == NO_CODE, a, a + b))

    def scan(batches):
        held = {}
        for batch in batches:
            chrom, pos = (batch[c].to_pylist() for c in places)
            rep = batch["rep"].to_numpy(zero_copy_only=False)
            for where, meetings in paired_steps(batch, ("a1", "a2"), tiles, genotype_number):
                total, several_here = None, np.flatnonzero(rep[where])
                for k, table, sides in meetings:
                    # a missing code is the last of its cells, behind the one for sums outside the levels
                    codes = cells(*sides)
                    part = tabulate(np.where(codes == levels, levels + 1, codes), column(table, "cls"))
                    total = part if total is None else total + part
                    if not len(several_here):
                        continue
                    cases = column(table, "case_no")
                    for i in several_here:
                        here = chrom[where][i], pos[where][i], k
                        held[here] = merged(held[here], sums(codes[i], cases)) if here in held else sums(codes[i], cases)
                        if len(held) * max(1, tiles.most) > HELD_CELLS:
                            yield from release(held)
                yield from release(held, keep=(chrom[where][-1], pos[where][-1]) if len(several_here) else None)
                single = np.flatnonzero(~rep[where])
                if len(single):
                    yield _position_rows(types, counted, [chrom[where][i] for i in single], [pos[where][i] for i in single], [-1] * len(single), total[single], [None] * len(single))
        yield from release(held)

    def release(held, keep=None):
        """The sums of finished positions; rows of one position mostly lie side by side, so the last one may go on."""
        for here in [h for h in held if h[:2] != keep]:
            yield _position_rows(types, counted, [here[0]], [here[1]], [here[2]], np.zeros((1, len(counted)), np.int64), [held.pop(here).tobytes()])

    def fold(batches):
        """One row for each position, from rows in the order of position and tile."""
        here, codes, total = None, None, None

        def classes_of(k):
            table = dict(tiles.tables())[k] if len(tiles.paths) > 1 else next(tiles.tables())[1]
            cases = column(table, "case_no")
            out = np.full(int(cases.max(initial=-1)) + 1, 2, np.int64)
            out[cases] = column(table, "cls")
            return out

        def closed():
            found = np.where(codes == NO_CODE, levels + 1, np.where((codes < 0) | (codes >= levels), levels, codes))
            return tabulate(found[None, :], classes_of(here[2]))[0]

        for batch in batches:
            tile = batch["tile"].to_numpy()
            counts = np.stack([batch[c].to_numpy() for c in counted], axis=1)
            chrom, pos = (batch[c].to_pylist() for c in places)
            single = np.flatnonzero(tile < 0)
            if len(single):
                yield _table_rows(types, counted, [chrom[i] for i in single], [pos[i] for i in single], counts[single])
            for i in np.flatnonzero(tile >= 0):
                now, more = (chrom[i], pos[i], int(tile[i])), np.frombuffer(batch["codes"][int(i)].as_py(), np.int32)
                if now == here:
                    codes = merged(codes, more)
                    continue
                if here is not None:
                    total = closed() if total is None else total + closed()
                    if now[:2] != here[:2]:
                        yield _table_rows(types, counted, [here[0]], [here[1]], total[None, :])
                        total = None
                here, codes = now, more
        if here is not None:
            total = closed() if total is None else total + closed()
            yield _table_rows(types, counted, [here[0]], [here[1]], total[None, :])

    types = [pa.int32() if rows.schema[k].dataType.simpleString() == "int" else pa.int64() for k in places]
    numbers = ", ".join(f"{c} bigint" for c in counted)
    found = rows.mapInArrow(scan, f"{kinds}, tile int, {numbers}, codes binary")
    found = found.repartition("chrom", "pos").sortWithinPartitions("chrom", "pos", "tile").mapInArrow(fold, f"{kinds}, {numbers}")
    lifted = [F.greatest(F.col(c), F.lit(floor)).cast("bigint").alias(c) for c in counted[:-1]]
    return found.select(*places, *lifted, *(["outside"] if outside else []))


def _position_rows(types: list, counted: list, chrom: list, pos: list, tile: list, counts: np.ndarray, codes: list) -> pa.RecordBatch:
    columns = [pa.array(chrom, types[0]), pa.array(pos, types[1]), pa.array(tile, pa.int32()), *map(pa.array, counts.T.astype(np.int64)), pa.array(codes, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["chrom", "pos", "tile", *counted, "codes"])


def _table_rows(types: list, counted: list, chrom: list, pos: list, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(chrom, types[0]), pa.array(pos, types[1]), *map(pa.array, counts.T.astype(np.int64))], names=["chrom", "pos", *counted])


def _cells(levels: tuple, floor: int) -> list:
    """Aggregates over rows of ``status, code, n``."""
    return [
        F.greatest(
            F.coalesce(F.sum(F.when((F.col("status") == s) & (F.col("code") == c), F.col("n"))), F.lit(0)),
            F.lit(floor),
        )
        .cast("bigint")
        .alias(f"{s}_{c}")
        for s in ("case", "control")
        for c in levels
    ]


def contingency_at_call_rate(
    encoded: DataFrame,
    status: DataFrame,
    n_cases,
    repeated: DataFrame,
    mode: str = "count",
    min_rate: float = MIN_CALL_RATE,
    floor: int = 0,
    variants: DataFrame | None = None,
) -> DataFrame:
    """Contingency of the variants called in at least ``min_rate`` of all cases.

    The matrix is read and paired once: its rows are counted by variant, status and code where no
    other variant shares the position, and by case besides where one does. Rates come out of the
    same counts, and what passes is added up by position.
    """
    levels = LEVELS[mode]
    labelled = lookup_join(encoded.select(*VARIANT, "case_id", "code"), status, ["case_id"], "left")
    places = repeated.select("chrom", "pos").distinct().withColumn("_rep", F.lit(True))
    marked = lookup_join(labelled, places, ["chrom", "pos"], "left", salts=1)
    own_case = F.when(F.col("_rep"), F.col("case_id")).alias("_case")
    tallied = marked.groupBy(*VARIANT, "status", own_case, "code").agg(F.count(F.lit(1)).alias("n"))
    # a repeated position is a handful of variants, so a variant's counts meet in a window of its own rows
    called = F.sum(F.when(F.col("code").isNotNull(), F.col("n")).otherwise(0)).over(Window.partitionBy(*VARIANT))
    passing = tallied.withColumn("_called", called).filter(call_rate("_called", n_cases) >= min_rate)
    by_case = passing.groupBy("chrom", "pos", "status", "_case", F.when(F.col("_case").isNull(), F.col("code")).alias("_code")).agg(
        F.sum("n").alias("_n"), F.sum("code").alias("_sum")
    )
    cells = by_case.select(
        "chrom", "pos", "status",
        F.when(F.col("_case").isNull(), F.col("_code").cast("bigint")).otherwise(F.col("_sum")).alias("code"),
        F.when(F.col("_case").isNull(), F.col("_n")).otherwise(F.lit(1)).alias("n"),
    )
    return cells.groupBy("chrom", "pos").agg(*_cells(levels, floor))


def floored_contingency(encoded: DataFrame, status: DataFrame, mode: str = "count", **kw) -> DataFrame:
    """Contingency with cells of at least one: ``max(count, 1)``, not ``count + 1``."""
    return contingency(encoded, status, mode, floor=1, **kw)


def contingency_rows(table: DataFrame, mode: str = "count") -> DataFrame:
    """Two rows per position, ``status, n0, n1[, n2]``."""
    levels = LEVELS[mode]
    sides = F.array(
        *[F.struct(F.lit(s).alias("status"), *[F.col(f"{s}_{c}").alias(f"n{c}") for c in levels]) for s in ("case", "control")]
    )
    return table.select("chrom", "pos", F.explode(sides).alias("r")).select("chrom", "pos", "r.*")


def _repeated_in(encoded: DataFrame) -> DataFrame:
    variants = encoded.groupBy(*VARIANT).agg(F.lit(1).alias("_one"))
    return variants.groupBy("chrom", "pos").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1).select("chrom", "pos")


def mismatch_type_frequency(slots: DataFrame, n_cases=None, keys: list = VARIANT) -> DataFrame:
    """Eight counts per variant over both slots: seven kinds and missing.

    With ``n_cases`` every case owes two slots, so absent rows count as missing as well.
    """
    counts = [
        (F.count_if(F.col("slot1") == c) + F.count_if(F.col("slot2") == c)).alias(name)
        for c, name in enumerate(MATCH_TYPES)
    ]
    if n_cases is None:
        missing = F.count_if(F.col("slot1").isNull()) + F.count_if(F.col("slot2").isNull())
    else:
        missing = F.lit(n_cases) * 2 - F.count("slot1") - F.count("slot2")
    return slots.groupBy(*keys).agg(*counts, missing.cast("bigint").alias("missing"))


def slot_rows(slots: DataFrame, keys: list = VARIANT) -> DataFrame:
    """One row per slot, ``slot`` 1 or 2."""
    both = F.array(
        F.struct(F.lit(1).alias("slot"), F.col("slot1").alias("code")),
        F.struct(F.lit(2).alias("slot"), F.col("slot2").alias("code")),
    )
    return slots.select(*keys, "case_id", F.explode(both).alias("s")).select(*keys, "case_id", "s.slot", "s.code")


def variant_density(variants: DataFrame, width: int) -> DataFrame:
    """Variants per base in fixed windows from 0, per chromosome.

    Windows end at the last multiple of ``width`` below the greatest position, and the last
    full window includes its right edge. What lies beyond is kept as one more window,
    flagged ``partial``. Empty windows appear with zero.
    """
    top = variants.groupBy("chrom").agg(F.max("pos").alias("_max"))
    # number of full windows: multiples of the width strictly below the maximum, less one edge
    full = F.when(F.col("_max") > 0, F.floor((F.col("_max") - 1) / width)).otherwise(F.lit(0)).cast("bigint")
    bounds = top.select("chrom", full.alias("_full"))
    windows = bounds.select("chrom", "_full", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_full"))).alias("bin"))
    # chromosomes are few and named by the data, so this side is one row each
    placed = lookup_join(variants.select("chrom", "pos"), bounds, ["chrom"])
    edge = (F.col("pos") == F.col("_full") * width) & (F.col("_full") > 0)
    placed = placed.withColumn(
        "bin", F.when(edge, F.col("_full") - 1).otherwise(F.least(F.floor(F.col("pos") / width), F.col("_full"))).cast("bigint")
    )
    counts = placed.groupBy("chrom", "bin").agg(F.count(F.lit(1)).alias("_n"))
    n = F.coalesce(F.col("_n"), F.lit(0))
    return windows.join(counts, ["chrom", "bin"], "left").select(
        "chrom",
        (F.col("bin") * width).alias("start"),
        ((F.col("bin") + 1) * width).alias("end"),
        n.alias("n_variants"),
        (n / F.lit(width)).alias("density"),
        (F.col("bin") == F.col("_full")).alias("partial"),
    )


def alternate_allele_histogram(variants: DataFrame) -> DataFrame:
    return variants.groupBy("chrom", "numalt").agg(F.count(F.lit(1)).alias("n_variants"))


def encoded_summary(encoded: DataFrame) -> DataFrame:
    """Rows per mode and code."""
    return encoded.groupBy("mode", "code").agg(F.count(F.lit(1)).alias("n"))
