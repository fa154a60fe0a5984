"""Variant-major genotypes: one row per variant, one array slot per sample.

Genotype files store variants this way. Since a row holds every sample, both halves of a
pair are in the same row, so pairing, encoding and counting need no shuffle of genotypes:
tasks look the pairs up as arrays of slots and count a variant's joint genotypes at once. Only
the counts travel. Each row of the input is counted for itself, also where rows share a key.
"""

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genopair.functions.encode import MATCH_TYPES
from genopair.functions.encode_arrays import allele_cells, by_genotypes, code_of_cell, dosage_cells, dosage_number, genotype_number, mismatch_type_cells
from genopair.operators.lookup import lookup_join
from genopair.operators.pairs import VARIANT, outcome_of_case
from genopair.operators.roster import column, histograms, pair_slots, paired_steps, scan_counts, scan_joint_counts, scan_rows, write_tiles

VARIANT_KEY = ["chrom", "variant_idx"]
CHUNK = 1000
WAITING_CELLS = 128 << 20  # codes that a task of a transposition holds at once


def unpack(packed: DataFrame, samples: DataFrame, values: tuple = ("dosage",), keys: list = VARIANT_KEY) -> DataFrame:
    """Long calls: one row per variant and sample."""
    zipped = F.arrays_zip(*values) if len(values) > 1 else F.col(values[0])
    # outer, so that no filter on the lists' size, before a shuffle too, has them made twice; a row without any has no sample
    rows = packed.select(*keys, F.posexplode_outer(zipped).alias("sample_idx", "_v"))
    fields = [F.col(f"_v.{v}").alias(v) for v in values] if len(values) > 1 else [F.col("_v").alias(values[0])]
    rows = rows.select(*keys, F.col("sample_idx").cast("bigint").alias("sample_idx"), *fields)
    named = samples.select(F.col("sample_idx").cast("bigint").alias("sample_idx"), "sample_id")
    return lookup_join(rows, named, ["sample_idx"]).select(*keys, "sample_id", *values)


def packed_pairs(packed: DataFrame, samples: DataFrame, pairs: DataFrame, values: tuple = ("dosage",), keys: list = VARIANT_KEY) -> DataFrame:
    """What ``pair_calls`` gives on the long form, without shuffling the genotypes: one row per variant and pair."""
    roster = pair_slots(pairs, samples)
    kinds = [packed.schema[v].dataType.elementType.simpleString() for v in values]
    columns = [f"{s}_{v} {kind}" for s in ("d", "r") for v, kind in zip(values, kinds)]
    case = roster.schema["case_id"].dataType.simpleString()

    def rows_of(sides, table):
        n, m = sides[0].shape
        cases = table["case_id"].combine_chunks()
        cells = [pa.array(x.ravel(), mask=(x < 0).ravel()) for x in sides]
        return np.repeat(np.arange(n), m), [cases.take(pa.array(np.tile(np.arange(m), n))), *(c.cast(t) for c, t in zip(cells, arrow * 2))]

    arrow = [{"tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64()}[k] for k in kinds]
    tiles = write_tiles(roster, F.col("case_id"))
    return scan_rows(packed, keys, values, tiles, rows_of, ", ".join([f"case_id {case}", *columns]), [None] * (1 + 2 * len(values)))


def _classes(outcomes: list) -> int:
    """Classes of a case: a digit 0, 1 or 2 (another value) for each outcome, and one class for cases that miss any."""
    return 3 ** len(outcomes) + 1


def _class_number(outcomes: list) -> Column:
    digits = [F.when(F.col(o).isin(0, 1), F.col(o).cast("int")).when(F.col(o).isNotNull(), 2) for o in outcomes]
    number = sum((d * 3**k for k, d in enumerate(digits[1:], 1)), digits[0])
    return F.coalesce(number, F.lit(_classes(outcomes) - 1))


def packed_mode_counts(
    packed: DataFrame,
    samples: DataFrame,
    pairs: DataFrame,
    outcome_table: DataFrame,
    outcomes: list,
    modes: tuple,
    keys: list = VARIANT_KEY,
    groups: tuple = (),
    group: str = "disease",
) -> DataFrame:
    """Counts of every mode, outcome and group of cases from one scan: ``mode, grp, code, n, n0_<o>, n1_<o>`` per variant.

    A task counts the joint cells of both dosages, or of the recipient's where no mode asks for more, by class of
    case; every mode's codes are sums of cells, so only the last step knows modes. ``groups`` are values of the outcome column
    ``group``: their cases are counted apart, under ``grp``; without groups all cases count and
    ``grp`` is null.
    """
    columns = [*outcomes, group] if groups else list(outcomes)
    single = outcome_of_case(outcome_table, columns)
    number = _class_number(outcomes)
    n_classes = _classes(outcomes)
    part = F.lit(0)
    if groups:
        part = F.lit(len(groups))
        for k, value in enumerate(groups):
            part = F.when(F.col(group) == value, k).otherwise(part)
    joined = pair_slots(pairs, samples).join(single, "case_id", "left")
    roster = joined.select("case_id", "d", "r", (part * n_classes + number).cast("int").alias("cls"))
    n_parts = len(groups) + 1 if groups else 1
    # which cells are in which output row, and which classes in which of its columns
    sides = ("r",) if set(modes) == {"recipient"} else ("d", "r")
    n_cells = 4 ** len(sides)
    labels = [(m, c) for m in modes for c in dict.fromkeys(code_of_cell(m))]
    # a recipient's code is the same whatever the donor's
    in_row = np.array([[c == x for x in code_of_cell(m)[:n_cells]] for m, c in labels], np.int64)
    digit = lambda k: np.arange(n_classes) // 3**k % 3
    complete = np.arange(n_classes) < n_classes - 1
    in_column = np.array([np.ones(n_classes, bool), *(complete & (digit(k) == v) for k in range(len(outcomes)) for v in (0, 1))], np.int64)
    names = ["n", *(f"n{v}_{o}" for o in outcomes for v in (0, 1))]
    counted = n_parts - 1 if groups else 1

    def rows_of(found):
        found = found.reshape(len(found), n_cells, n_parts, n_classes)[:, :, :counted]
        # variant, part, row, column
        sums = np.einsum("vcpk,rc,jk->vprj", found, in_row, in_column, optimize=True)
        v, p, r = np.nonzero(sums[..., 0])
        picked = sums[v, p, r]
        group_values = pa.array([groups[k] if groups else None for k in p.tolist()], pa.int64())
        mode, code = pa.array([labels[k][0] for k in r.tolist()], pa.string()), pa.array([labels[k][1] for k in r.tolist()], pa.int32())
        return v, [mode, group_values, code, *picked.T]

    extra = ", ".join(["mode string", "grp bigint", "code int", *(f"{n} bigint" for n in names)])
    types = [pa.string(), pa.int64(), pa.int32(), *[pa.int64()] * len(names)]
    tiles = write_tiles(roster.select("d", "r", "cls"), F.struct("d", "r"), in_classes=True)
    return scan_joint_counts(packed, keys, "dosage", tiles, n_classes * n_parts, dosage_number, rows_of, extra, types, sides)


def packed_code_counts(
    packed: DataFrame,
    samples: DataFrame,
    pairs: DataFrame,
    outcome_table: DataFrame,
    outcomes: list,
    mode: str,
    keys: list = VARIANT_KEY,
) -> DataFrame:
    """What ``code_counts`` gives on the long form, from packed rows."""
    return packed_mode_counts(packed, samples, pairs, outcome_table, outcomes, (mode,), keys).drop("mode", "grp")


def status_roster(slots: DataFrame, pairs: DataFrame, status: DataFrame) -> DataFrame:
    """``case_id, d, r, cls``: class 0 for a case, 1 for a control, 2 for any other."""
    number = F.when(F.col("status") == "case", 0).when(F.col("status") == "control", 1).otherwise(2)
    return pair_slots(pairs, slots).join(status.select("case_id", "status"), "case_id", "left").select("case_id", "d", "r", number.alias("cls"))


def packed_allele_counts(packed: DataFrame, slots: DataFrame, pairs: DataFrame, status: DataFrame, mode: str, keys: list = VARIANT) -> DataFrame:
    """Cases per code and status from packed alleles: ``code, n_case, n_control, n_other`` per variant; missing codes are left out."""
    n_codes = {"count": 3, "presence": 2}[mode]
    cells = by_genotypes(lambda *alleles: allele_cells(mode, *alleles))

    def tally(sides, table):
        return histograms(cells(*sides), column(table, "cls"), n_codes + 1, 3)[:, :n_codes]

    def rows_of(found):
        # every code of every variant, so that a variant nobody carries keeps its row
        v, c = np.divmod(np.arange(len(found) * n_codes), n_codes)
        return v, [c, *found[v, c].T]

    extra = "code int, n_case bigint, n_control bigint, n_other bigint"
    types = [pa.int32(), *[pa.int64()] * 3]
    tiles = write_tiles(status_roster(slots, pairs, status).drop("case_id"), F.struct("d", "r"))
    return scan_counts(packed, keys, ("a1", "a2"), tiles, tally, rows_of, extra, types, genotype_number)


def packed_type_counts(packed: DataFrame, slots: DataFrame, pairs: DataFrame, keys: list = VARIANT) -> DataFrame:
    """Eight counts per variant over both slots of every pair: seven kinds of change and missing."""
    names = [*MATCH_TYPES, "missing"]
    # both slots' kinds in one look-up: 8 times the first's and the second's
    cells = by_genotypes(lambda *alleles: (lambda one, two: 8 * one + two)(*mismatch_type_cells(*alleles)))

    def tally(sides, table):
        found = histograms(cells(*sides), np.zeros(len(table), np.int64), 64, 1).reshape(-1, 8, 8)
        return found.sum(axis=1) + found.sum(axis=2)

    extra = ", ".join(f"{n} bigint" for n in names)
    tiles = write_tiles(pair_slots(pairs, slots).select("d", "r"), F.struct("d", "r"))
    return scan_counts(packed, keys, ("a1", "a2"), tiles, tally, lambda found: (np.arange(len(found)), list(found.T)), extra, [pa.int64()] * 8, genotype_number)


def _first_slots(samples: DataFrame, pairs: DataFrame) -> DataFrame:
    """``case_id, d, r``: a case's first pair by slots."""
    return pair_slots(pairs, samples).groupBy("case_id").agg(F.min(F.struct("d", "r")).alias("s")).select("case_id", "s.*")


def _in_blocks(case: np.ndarray, chunk: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the cases of a tile, and where each block of ``chunk`` case numbers begins in it, with the end."""
    order = np.argsort(case, kind="stable")
    first = np.flatnonzero(np.diff(case[order] // chunk, prepend=-1))
    return order, np.append(first, len(case))


def packed_codes(packed: DataFrame, samples: DataFrame, pairs: DataFrame, mode: str, chunk: int = CHUNK) -> DataFrame:
    """Encoded matrix, one row per variant and block of ``chunk`` cases, case order fixed by ``case_id``.

    A row never grows beyond ``chunk`` codes, whatever the number of cases. A case with two
    pairs has the code of its first pair by slots.
    """
    keys = [c for c in packed.columns if c != "dosage"]
    slots = case_order(pairs).join(_first_slots(samples, pairs), "case_id", "left").select("case_idx", "d", "r")
    codes = np.array([-128 if c is None else c for c in code_of_cell(mode)], np.int8)

    def rows_of(sides, table):
        case = column(table, "case_idx")
        order, first = _in_blocks(case, chunk)
        found = codes[dosage_cells(*sides)[:, order]]
        n, m = len(found), len(first) - 1
        offsets = np.concatenate([[0], np.cumsum(np.tile(np.diff(first), n))]).astype(np.int32)
        flat = found.ravel()
        lists = pa.ListArray.from_arrays(offsets, pa.array(flat, mask=flat == -128))
        return np.repeat(np.arange(n), m), [np.tile(case[order][first[:-1]] // chunk, n), lists]

    # whole blocks to a tile
    tiles = write_tiles(slots, F.floor(F.col("case_idx") / chunk))
    return scan_rows(packed, keys, ("dosage",), tiles, rows_of, "block int, codes array<tinyint>", [pa.int32(), None])


def packed_by_case(packed: DataFrame, samples: DataFrame, pairs: DataFrame, mode: str, chunk: int = CHUNK) -> DataFrame:
    """The transposed matrix from packed rows: per case and run of ``chunk`` variant numbers, codes in variant order.

    A task cuts its rows into tiles, the codes of up to ``chunk`` variants by those of ``chunk`` cases, so what
    is shuffled are tiles of a megabyte, not cells; those of one place are merged in variant order. A
    case has the codes of its first pair by slots.
    """
    kind, number = packed.schema["chrom"].dataType.simpleString(), packed.schema["variant_idx"].dataType.simpleString()
    slots = case_order(pairs).join(_first_slots(samples, pairs), "case_id").select("case_id", "case_idx", "d", "r")
    id_type = slots.schema["case_id"].dataType.simpleString()
    codes = np.array([-128 if c is None else c for c in code_of_cell(mode)], np.int8)
    tiles = write_tiles(slots, F.floor(F.col("case_idx") / chunk))
    names = ["chrom", "block", "case_block", "variants", "cases", "codes"]

    def cut(batches):
        """Tiles of this task's rows. What is waiting for the rest of its run of variants is bounded."""
        waiting, size = {}, 0
        for batch in batches:
            chrom, at = batch["chrom"].to_numpy(zero_copy_only=False), batch["variant_idx"].to_numpy(zero_copy_only=False)
            for where, meetings in paired_steps(batch, ("dosage",), tiles):
                of = defaultdict(list)
                for i, place in enumerate(zip(chrom[where].tolist(), (at[where] // chunk).tolist())):
                    of[place].append(i)
                for k, _, sides in meetings:
                    found = codes[dosage_cells(*sides)]
                    for place, rows in of.items():
                        waiting.setdefault((*place, k), []).append((at[where][rows], found[rows]))
                    size += found.size
                if size > WAITING_CELLS:
                    yield from release(waiting)
                    waiting, size = {}, 0
        yield from release(waiting)

    def release(waiting):
        for k, table in tiles.tables():
            case, ids = column(table, "case_idx"), table["case_id"].combine_chunks()
            order, first = _in_blocks(case, chunk)
            for (chrom, block), parts in ((place[:2], parts) for place, parts in waiting.items() if place[2] == k):
                variants, found = np.concatenate([v for v, _ in parts]), np.concatenate([c for _, c in parts])
                for lo, hi in zip(first[:-1], first[1:]):
                    own = ids.take(pa.array(order[lo:hi]))
                    columns = [
                        pa.array([chrom], types[0]), pa.array([block], pa.int64()), pa.array([int(case[order[lo]] // chunk)], pa.int64()),
                        pa.array([variants], pa.list_(types[1])), pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own),
                        pa.array([found[:, order[lo:hi]].tobytes()], pa.binary()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    def merge(table: pa.Table) -> pa.Table:
        variants = np.concatenate([v.values.to_numpy() for v in table["variants"]])
        cases = table["cases"][0].values
        found = np.concatenate([np.frombuffer(c.as_py(), np.int8).reshape(-1, len(cases)) for c in table["codes"]])
        order = np.argsort(variants, kind="stable")
        flat, m = found[order].T.ravel(), len(cases)
        entries = pa.StructArray.from_arrays([pa.array(np.tile(variants[order], m)), pa.array(flat, mask=flat == -128)], names=["variant_idx", "code"])
        lists = pa.ListArray.from_arrays(pa.array(np.arange(m + 1, dtype=np.int32) * len(variants)), entries)
        of = lambda c: pa.array([table[c][0].as_py()] * m, table.schema.field(c).type)
        return pa.Table.from_arrays([cases, of("chrom"), of("block"), lists], names=["case_id", "chrom", "block", "codes"])

    types = [pa.int32() if kind == "int" else pa.int64(), pa.int32() if number == "int" else pa.int64()]
    cells = packed.select("chrom", "variant_idx", "dosage").mapInArrow(
        cut, f"chrom {kind}, block bigint, case_block bigint, variants array<{number}>, cases array<{id_type}>, codes binary"
    )
    return cells.groupBy("chrom", "block", "case_block").applyInArrow(
        merge, f"case_id {id_type}, chrom {kind}, block bigint, codes array<struct<variant_idx:{number},code:tinyint>>"
    )


def case_order(pairs: DataFrame) -> DataFrame:
    """``case_id, case_idx``: the fixed column order of packed codes, by case id.

    Row numbers are taken inside buckets of the id's digest and shifted by the bucket
    sizes, so no task sees the whole list.
    """
    from genopair.operators.cohort import dense_rank_by_digest

    return dense_rank_by_digest(pairs.select("case_id").distinct(), ["case_id"], "case_idx")


def pack(encoded: DataFrame, cases: DataFrame, chunk: int = CHUNK, keys: list = VARIANT_KEY) -> DataFrame:
    """Long codes to rows of up to ``chunk`` codes in case order; cases without a row are NULL, of several codes the lowest counts."""
    placed = lookup_join(encoded.select(*keys, "case_id", "code"), cases.select("case_id", "case_idx"), ["case_id"])
    block = F.floor(F.col("case_idx") / chunk).cast("int")
    sizes = cases.groupBy(block.alias("block")).agg(F.count(F.lit(1)).cast("int").alias("_size"))
    # one entry per pair of the block's cases
    entries = F.sort_array(F.collect_list(F.struct((F.col("case_idx") % chunk).cast("int").alias("slot"), F.col("code").alias("code"))))
    grouped = placed.groupBy(*keys, block.alias("block")).agg(entries.alias("_e"))
    first = F.filter("_e", lambda e, k: (k == 0) | (F.get("_e", k - 1)["slot"] != e["slot"]))
    grouped = grouped.withColumn("_by_slot", F.map_from_entries(first)).drop("_e")
    return lookup_join(grouped, sizes, ["block"]).select(
        *keys,
        "block",
        F.transform(F.sequence(F.lit(0), F.col("_size") - 1), lambda s: F.element_at("_by_slot", s)).alias("codes"),
    )


def unpack_codes(codes: DataFrame, cases: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Rows of codes back to one row per variant and case."""
    keys = [c for c in codes.columns if c not in ("block", "codes")]
    rows = codes.select(*keys, "block", F.posexplode("codes").alias("_slot", "code"))
    rows = rows.withColumn("case_idx", F.col("block").cast("bigint") * chunk + F.col("_slot"))
    named = cases.select(F.col("case_idx").cast("bigint").alias("case_idx"), "case_id")
    return lookup_join(rows, named, ["case_idx"]).select(*keys, "case_id", "code")


def by_case(encoded: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The transposed matrix: per case and run of ``chunk`` variant numbers, codes in variant order."""
    block = F.floor(F.col("variant_idx") / chunk).cast("bigint")
    return encoded.groupBy("case_id", "chrom", block.alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("variant_idx", "code"))).alias("codes")
    )

