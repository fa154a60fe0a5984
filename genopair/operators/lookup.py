"""Joins against a smaller table, planned from its measured size."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_BROADCAST_ROWS = 2_000_000
MAX_BROADCAST_BYTES = 64 << 20
SALTS = 16

_VARIABLE_WIDTH = (T.StringType, T.BinaryType)


def measured_size(df: DataFrame) -> tuple[int, int]:
    """Rows and payload bytes, from one distributed aggregate."""
    fixed = 0
    variable = F.lit(0).cast("bigint")
    for f in df.schema.fields:
        if isinstance(f.dataType, _VARIABLE_WIDTH):
            variable = variable + F.coalesce(F.octet_length(f.name), F.lit(0))
        elif isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)):
            variable = variable + F.octet_length(F.to_json(F.struct(f.name)))
        else:
            fixed += 8
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(variable).alias("b")).first()
    return row["n"], row["n"] * fixed + (row["b"] or 0)


def fits_broadcast(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS, max_bytes: int = MAX_BROADCAST_BYTES) -> bool:
    rows, size = measured_size(df)
    return rows <= max_rows and size <= max_bytes


def lookup_join(
    big: DataFrame, small: DataFrame, keys: list, how: str = "inner", salts: int = SALTS, bound: DataFrame | None = None
) -> DataFrame:
    """Join ``big`` with a lookup table; ``how`` is inner, left, left_semi or left_anti.

    The lookup side is broadcast when its measured size is within the bounds. Beyond them
    both sides shuffle; the lookup rows are then repeated once per salt and each row of
    ``big`` takes the salt of its own content, so that the rows of one hot key spread over
    several tasks. Salts come from content, not from row order: a recomputed task gives
    every row the same salt again. ``salts=1`` is for lookup tables that are long themselves
    and keys that repeat about equally often; adaptive execution still splits skewed ones.
    ``bound`` is a table cheap to measure that ``small`` cannot outgrow, for a ``small`` that
    takes a pass over the genotypes to compute.
    """
    if fits_broadcast(small if bound is None else bound):
        return big.join(F.broadcast(small), keys, how)
    others = [c for c in big.columns if c not in keys and not isinstance(big.schema[c].dataType, T.MapType)]
    if not others or salts <= 1:
        return big.join(small, keys, how)
    salted_big = big.withColumn("_salt", F.pmod(F.xxhash64(*others), F.lit(salts)).cast("int"))
    salted_small = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted_big.join(salted_small, [*keys, "_salt"], how).drop("_salt")


def first_by(df: DataFrame, keys: list, order: str) -> DataFrame:
    """First row per key in the given order.

    ``min_by`` combines on the map side, so a key repeated in a third of the rows costs
    one row per task in the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_row"))
    return picked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns)


def with_row_index(df: DataFrame, name: str = "i") -> DataFrame:
    """Dense 0-based row number in scan order of a file read.

    Rows are numbered inside their partition; the partition offsets come from a table of
    one row per partition, which is small by construction.
    """
    marked = df.withColumn("_mid", F.monotonically_increasing_id())
    counts = marked.groupBy(F.shiftright("_mid", 33).alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    return with_offsets(marked, counts, name)


def with_offsets(marked: DataFrame, counts: DataFrame, name: str) -> DataFrame:
    """``name`` in place of ``_mid``, given how many rows (``_n``) each partition (``_part``) holds."""
    part, row = F.shiftright("_mid", 33), F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    offset, pairs = 0, []
    for c in counts.orderBy("_part").collect():
        pairs.append((c["_part"], offset))
        offset += c["_n"]
    if len(pairs) <= 1:
        return marked.withColumn(name, row).drop("_mid")
    offsets = marked.sparkSession.createDataFrame(pairs, "_part bigint, _offset bigint")
    return (
        marked.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + row)
        .drop("_mid", "_part", "_offset")
    )


def union_all(frames: list) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
