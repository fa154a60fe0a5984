"""HLA typing comparisons as Column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def _allele_two_field(a: Column) -> Column:
    return F.substring_index(a, ":", 2)


def two_field(alleles) -> Column:
    """First two fields of each allele, sorted."""
    return F.array_sort(F.transform(_col(alleles), _allele_two_field))


def _sorted_pair(a, b):
    return F.least(a, b), F.greatest(a, b)


def compare_locus(r1, r2, d1, d2) -> Column:
    """``struct(code, level)`` for one locus of a pair.

    Equal typings give ``r1_r2``; typings equal at two fields ``r1_r2_d1_d2``; others the
    same with ``MM_`` in front. Pairs are unordered; NULL when any of the four is NULL.
    """
    r1, r2, d1, d2 = map(_col, (r1, r2, d1, d2))
    known = r1.isNotNull() & r2.isNotNull() & d1.isNotNull() & d2.isNotNull()
    ra, rb = _sorted_pair(r1, r2)
    da, db = _sorted_pair(d1, d2)
    ra2, rb2 = _sorted_pair(_allele_two_field(r1), _allele_two_field(r2))
    da2, db2 = _sorted_pair(_allele_two_field(d1), _allele_two_field(d2))
    level = (
        F.when((ra == da) & (rb == db), F.lit("identical"))
        .when((ra2 == da2) & (rb2 == db2), F.lit("two_field"))
        .otherwise(F.lit("mismatch"))
    )
    four = F.concat_ws("_", ra, rb, da, db)
    code = (
        F.when(level == "identical", F.concat_ws("_", ra, rb))
        .when(level == "two_field", four)
        .otherwise(F.concat(F.lit("MM_"), four))
    )
    return F.when(known, F.struct(code.alias("code"), level.alias("level")))


def gl_string(a1, a2) -> Column:
    return F.concat_ws("+", _col(a1), _col(a2))


def variant_label(chrom="chrom", start="start", end="end", strand="strand", id="id", consequence="consequence") -> Column:
    """``chrom:start-end:strand ==> id (consequence)``"""
    return F.format_string(
        "%s:%s-%s:%s ==> %s (%s)",
        *[_col(c).cast("string") for c in (chrom, start, end, strand, id, consequence)],
    )
