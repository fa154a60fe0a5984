"""Pair codes: how a donor's genotype differs from the recipient's at one variant.

Missing is NULL throughout, in and out. -1 is a legitimate directed code and never
stands for missing.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

MATCH_TYPES = ("match", "ref_alt1", "ref_alt2", "alt1_ref", "alt1_alt2", "alt2_ref", "alt2_alt1")


def _col(c):
    return F.col(c) if isinstance(c, str) else c


# --- dosage codes -------------------------------------------------------------------


def count_code(d, r) -> Column:
    """|d - r|: 0, 1 or 2 mismatched alleles."""
    return F.abs(_col(d) - _col(r)).cast("tinyint")


def directed_code(d, r) -> Column:
    """d - r: -2..2, donor minus recipient."""
    return (_col(d) - _col(r)).cast("tinyint")


def presence_code(d, r) -> Column:
    """1 when any allele differs, else 0."""
    return F.least(F.abs(_col(d) - _col(r)), F.lit(1)).cast("tinyint") * _known(d, r)


def joint_code(d, r) -> Column:
    """3d + r: 0..8, one code per joint genotype."""
    return (_col(d) * 3 + _col(r)).cast("tinyint")


def recipient_code(d, r) -> Column:
    """The recipient's own dosage."""
    return _col(r).cast("tinyint")


def _known(*cols) -> Column:
    """1 when every input is known, else NULL (least/greatest skip NULLs)."""
    known = _col(cols[0]).isNotNull()
    for c in cols[1:]:
        known = known & _col(c).isNotNull()
    return F.when(known, F.lit(1).cast("tinyint"))


DOSAGE_CODES = {
    "count": count_code,
    "count_directed": directed_code,
    "pres_abs": presence_code,
    "dr_genotype": joint_code,
    "recipient": recipient_code,
}

# codes each mode can take, lowest first
DOSAGE_LEVELS = {
    "count": (0, 1, 2),
    "count_directed": (-2, -1, 0, 1, 2),
    "pres_abs": (0, 1),
    "dr_genotype": (0, 1, 2, 3, 4, 5, 6, 7, 8),
    "recipient": (0, 1, 2),
}


def dosage_code(mode: str, d="d_dosage", r="r_dosage") -> Column:
    if mode not in DOSAGE_CODES:
        raise ValueError(f"unknown mode {mode!r}; expected one of {sorted(DOSAGE_CODES)}")
    return DOSAGE_CODES[mode](d, r)


# --- allele-pair codes ---------------------------------------------------------------
#
# Each genotype is an unordered pair of allele numbers given as two scalar columns, which
# keeps the set logic in generated code (array functions would leave it for some steps).


def _shared(d1, d2, r1, r2) -> Column:
    """Number of distinct alleles the two genotypes have in common."""
    first = ((d1 == r1) | (d1 == r2)).cast("int")
    second = ((d2 == r1) | (d2 == r2)).cast("int")
    return F.when(d1 == d2, first).otherwise(first + second)


def _all_known(*cols) -> Column:
    known = cols[0].isNotNull()
    for c in cols[1:]:
        known = known & c.isNotNull()
    return known


def allele_count(d1, d2, r1, r2) -> Column:
    """0, 1 or 2 mismatches between two allele pairs, ignoring phase.

    Two homozygous pairs of the same allele match; a homozygous and a heterozygous pair
    that share an allele differ by one.
    """
    d1, d2, r1, r2 = map(_col, (d1, d2, r1, r2))
    shared = _shared(d1, d2, r1, r2)
    both_hom = (d1 == d2) & (r1 == r2)
    return F.when(
        _all_known(d1, d2, r1, r2),
        F.when((shared == 2) | ((shared == 1) & both_hom), F.lit(0))
        .when(shared == 1, F.lit(1))
        .otherwise(F.lit(2)),
    ).cast("tinyint")


def allele_presence(d1, d2, r1, r2) -> Column:
    """1 when the two allele pairs differ at all, else 0."""
    return F.when(allele_count(d1, d2, r1, r2) > 0, F.lit(1)).when(
        _all_known(*map(_col, (d1, d2, r1, r2))), F.lit(0)
    ).cast("tinyint")


def _change_type(donor, recipient) -> Column:
    """Code 1..6 of a donor allele against a differing recipient allele.

    Reading order ref (0), first alternate (1), any later alternate:
    0>1 is 1, 0>other 2, 1>0 is 3, 1>other 4, later>0 is 5, later>other 6.
    """
    return (
        F.when(donor == 0, F.when(recipient == 1, 1).otherwise(2))
        .when(donor == 1, F.when(recipient == 0, 3).otherwise(4))
        .otherwise(F.when(recipient == 0, 5).otherwise(6))
    )


def _unshared(a1, a2, b1, b2) -> Column:
    """The allele of (a1, a2) that (b1, b2) lacks; the common one when none is left."""
    return F.when(a1 == a2, a1).when((a1 == b1) | (a1 == b2), a2).otherwise(a1)


def mismatch_types(d1, d2, r1, r2) -> tuple[Column, Column]:
    """The two slot codes of a pair: 0 match, 1..6 kind of change, NULL missing."""
    d1, d2, r1, r2 = map(_col, (d1, d2, r1, r2))
    shared = _shared(d1, d2, r1, r2)
    both_hom = (d1 == d2) & (r1 == r2)
    known = _all_known(d1, d2, r1, r2)
    slot1 = F.when(known, F.when(shared >= 1, F.lit(0)).otherwise(_change_type(d1, r1)))
    slot2 = F.when(
        known,
        F.when((shared == 2) | ((shared == 1) & both_hom), F.lit(0))
        .when(shared == 1, _change_type(_unshared(d1, d2, r1, r2), _unshared(r1, r2, d1, d2)))
        .otherwise(_change_type(d2, r2)),
    )
    return slot1.cast("tinyint"), slot2.cast("tinyint")


def gt_type(a1, a2) -> Column:
    """0 homozygous reference, 1 heterozygous (1/2 too), 2 homozygous alternate."""
    a1, a2 = _col(a1), _col(a2)
    return F.when(
        _all_known(a1, a2),
        F.when(a1 != a2, F.lit(1)).when(a1 == 0, F.lit(0)).otherwise(F.lit(2)),
    ).cast("tinyint")


def gt_type_diff(d1, d2, r1, r2) -> Column:
    """|gt_type - gt_type| of two samples; NULL when either is missing."""
    return F.abs(gt_type(d1, d2) - gt_type(r1, r2)).cast("tinyint")


ALLELE_CODES = {"count": allele_count, "presence": allele_presence}
