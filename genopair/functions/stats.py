"""Test statistics as Column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# The coefficients, constant term first, of the published rational
# Chebyshev fit of the complementary error function (relative error below 1.2e-7).
ERFC_COEFFICIENTS = (
    -1.26551223,
    1.00002368,
    0.37409196,
    0.09678418,
    -0.18628806,
    0.27886807,
    -1.13520398,
    1.48851587,
    -0.82215223,
    0.17087277,
)


def _bind(value: Column, body) -> Column:
    """``body(value)`` with the value computed once; columns alone would repeat its whole text."""
    return F.get(F.transform(F.array(value), body), 0)


def erfc(z: Column) -> Column:
    """Complementary error function for z >= 0; accurate in relative terms far into the tail."""

    def fit(t, z):
        poly = F.lit(ERFC_COEFFICIENTS[-1])
        for c in reversed(ERFC_COEFFICIENTS[:-1]):
            poly = F.lit(c) + t * poly
        return t * F.exp(-z * z + poly)

    return _bind(z, lambda z: _bind(F.lit(1.0) / (F.lit(1.0) + z * 0.5), lambda t: fit(t, z)))


def two_sided_normal_p(z: Column) -> Column:
    return erfc(F.abs(z) / F.sqrt(F.lit(2.0)))


def chi_square_p(stat: Column, dof: int) -> Column:
    """Upper tail of the chi-square distribution for one or two degrees of freedom."""
    if dof == 1:
        return erfc(F.sqrt(stat * 0.5))
    if dof == 2:
        return F.exp(-stat * 0.5)
    raise ValueError("contingency tables here are 2x2 or 2x3")


def independence_test(case_cols: list, control_cols: list) -> tuple[Column, Column, Column]:
    """Chi-square test of a two-row table: ``(stat, p_value, status)``.

    A 2x2 table gets the continuity correction. A table with an empty row or column has
    no expected count there and is not testable: NULL, ``zero_expected``.
    """
    case = [F.col(c).cast("double") for c in case_cols]
    control = [F.col(c).cast("double") for c in control_cols]
    n_case, n_control = sum(case[1:], case[0]), sum(control[1:], control[0])
    total = n_case + n_control
    columns = [a + b for a, b in zip(case, control)]
    testable = (n_case > 0) & (n_control > 0)
    for c in columns:
        testable = testable & (c > 0)
    dof = len(case) - 1
    stat = None
    for row, n_row in ((case, n_case), (control, n_control)):
        for observed, n_column in zip(row, columns):
            expected = n_row * n_column / total
            gap = F.abs(observed - expected)
            if dof == 1:
                gap = gap - F.least(F.lit(0.5), gap)
            term = gap * gap / expected
            stat = term if stat is None else stat + term
    stat = F.when(testable, stat)
    return stat, chi_square_p(stat, dof), F.when(testable, F.lit("ok")).otherwise(F.lit("zero_expected"))


def neg_log_p(p="p_value") -> Column:
    """Natural -ln p."""
    p = F.col(p) if isinstance(p, str) else p
    return -F.log(p)
