"""Donor and recipient identifiers as Column expressions.

Donor ids read ``dddd-dddd-d`` and recipient ids ``ddd-ddd-d``.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

DONOR_PAD = 9
RECIPIENT_PAD = 7


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def is_donor(c) -> Column:
    """'D' when the first dash follows four characters, else 'R'; NULL without a dash."""
    dash = F.instr(_col(c), "-")
    return F.when(dash == 5, F.lit("D")).when(dash > 0, F.lit("R"))


def format_id(c, role: str) -> Column:
    """Zero-pad a numeric id and put in the dashes of its role.

    An id longer than the pad is kept whole: its surplus digits stay in the tail.
    """
    donor = role.upper().startswith("D")
    pad, head = (DONOR_PAD, 4) if donor else (RECIPIENT_PAD, 3)
    text = _col(c).cast("string")
    # lpad cuts what is longer than its target, so the target is never below the length
    padded = F.lpad(text, F.greatest(F.length(text), F.lit(pad)), F.lit("0"))
    return F.concat_ws(
        "-",
        F.substring(padded, 1, head),
        F.substring(padded, head + 1, head),
        F.substring(padded, F.lit(2 * head + 1), F.length(padded)),
    )


def parse_id(c) -> Column:
    """``struct(number bigint, role string)`` of a dashed id."""
    c = _col(c)
    return F.struct(
        F.regexp_replace(c, "-", "").cast("bigint").alias("number"),
        is_donor(c).alias("role"),
    )
