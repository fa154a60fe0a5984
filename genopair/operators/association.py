"""Association tests per variant.

Every test works from counts: how many cases carry each code in each outcome class. Those
counts are at most nine rows per variant, whatever the number of samples, and are summed
on the map side before anything is shuffled.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from genopair.functions.stats import independence_test, neg_log_p, two_sided_normal_p
from genopair.operators.pairs import VARIANT, with_outcome
from genopair.operators.tables import LEVELS
from genopair.session import ship_package

NEWTON_STEPS = 25
GRADIENT = 1e-8  # of a converged fit, for each case
RESTING = 1e-13  # of a coefficient, below which a step changes nothing
FITTED = ("_slope", "_information", "_determinant", "_gradient")


# --- chi-square on contingency tables --------------------------------------------------


def chi_square(table: DataFrame, mode: str = "count") -> DataFrame:
    """Add ``stat, p_value, status`` to a contingency table."""
    levels = LEVELS[mode]
    stat, p, status = independence_test([f"case_{c}" for c in levels], [f"control_{c}" for c in levels])
    return table.withColumns({"stat": stat, "p_value": p, "status": status})


def testable(p_values: DataFrame, strict: bool = False) -> DataFrame:
    """Rows with a p-value; ``strict`` also drops p = 0, which has no logarithm."""
    return p_values.filter(F.col("p_value") > 0) if strict else p_values.filter(F.col("p_value").isNotNull())


def with_neg_log_p(p_values: DataFrame) -> DataFrame:
    return testable(p_values, strict=True).withColumn("neg_log_p", neg_log_p())


# --- counts per code and outcome ---------------------------------------------------------


def complete_outcomes(labelled: DataFrame, outcomes: list) -> DataFrame:
    """Rows whose code and outcomes are all known (a case missing any is out of every test)."""
    known = F.col("code").isNotNull()
    for o in outcomes:
        known = known & F.col(o).isNotNull()
    return labelled.filter(known)


def code_counts(encoded: DataFrame, outcome_table: DataFrame, outcomes: list, keys: list = VARIANT) -> DataFrame:
    """Rows per variant and code: ``n`` cases, and ``n0_<o>, n1_<o>`` among complete cases.

    ``n`` counts every case (for the call rate); the outcome counts leave out any case that
    misses one of the outcomes. All outcomes are counted in the one pass.
    """
    labelled = with_outcome(encoded, outcome_table, outcomes)
    complete = F.lit(True)
    for o in outcomes:
        complete = complete & F.col(o).isNotNull()
    sides = [
        F.count_if(complete & (F.col(o) == value)).alias(f"n{value}_{o}") for o in outcomes for value in (0, 1)
    ]
    return labelled.groupBy(*keys, "code").agg(F.count(F.lit(1)).alias("n"), *sides)


def variant_levels(counts: DataFrame, outcomes: list, keys: list = VARIANT) -> DataFrame:
    """One row per variant and outcome with its levels, lowest code first.

    ``n_called`` and ``levels array<struct<code, n0, n1>>``; the array holds at most one
    entry per possible code.
    """
    entry = F.struct("code", *[f"n{v}_{o}" for o in outcomes for v in (0, 1)])
    folded = counts.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(F.col("code").isNotNull(), F.col("n"))), F.lit(0)).cast("bigint").alias("n_called"),
        F.sort_array(F.collect_list(F.when(F.col("code").isNotNull(), entry))).alias("_all"),
    )
    return _by_outcome(folded, outcomes, keys)


def _by_outcome(folded: DataFrame, outcomes: list, keys: list) -> DataFrame:
    def seen(o):
        entries = F.transform(
            "_all",
            lambda e: F.struct(
                e["code"].cast("int").alias("code"), e[f"n0_{o}"].alias("n0"), e[f"n1_{o}"].alias("n1")
            ),
        )
        return F.filter(entries, lambda e: (e["n0"] + e["n1"]) > 0)

    per_outcome = F.array(*[F.struct(F.lit(o).alias("outcome"), seen(o).alias("levels")) for o in outcomes])
    return folded.select(*keys, "n_called", F.explode(per_outcome).alias("o")).select(
        *keys, "n_called", "o.outcome", "o.levels"
    )


def as_sentinel(levels: DataFrame) -> DataFrame:
    """Reference-compatible reading of directed codes: -1 is taken for missing."""
    return levels.withColumn("levels", F.filter("levels", lambda e: e["code"] != -1))


# --- logistic regression -----------------------------------------------------------------


def logistic_factor(levels: DataFrame) -> DataFrame:
    """Wald test of the second genotype level against the lowest, genotype as a factor.

    With one factor the model is saturated, so coefficient and standard error have closed
    forms in the four cell counts. ``status``: ok, single_level, or separation (a zero cell).
    """
    low, high = F.get("levels", 0), F.get("levels", 1)
    cells = [c.cast("double") for c in (low["n0"], low["n1"], high["n0"], high["n1"])]
    filled = (cells[0] > 0) & (cells[1] > 0) & (cells[2] > 0) & (cells[3] > 0)
    many = F.size("levels") >= 2
    a, b, c, d = cells
    beta = F.when(filled, F.log(d * a / (c * b)))
    se = F.when(filled, F.sqrt(1 / a + 1 / b + 1 / c + 1 / d))
    return _wald(
        levels.withColumns({"ref_code": low["code"], "test_code": F.when(many, high["code"]), "_many": many}),
        beta,
        se,
        filled,
        "factor",
    )


def logistic_additive(levels: DataFrame) -> DataFrame:
    """Wald test of the slope of outcome on the numeric code, fitted by Newton steps on counts.

    Fits run in batches of rows, each until it settles. ``status`` is also not_converged, without
    estimates, where the gradient at the last step is not small beside the number of cases.
    """
    ship_package(levels.sparkSession)
    steps = NEWTON_STEPS

    def fit(batches):
        for batch in batches:
            slope, information, determinant, gradient = additive_fits(batch["levels"], steps)
            added = [pa.array(x, mask=~np.isfinite(x)) for x in (slope, information, determinant, gradient)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, *FITTED])

    schema = T.StructType([*levels.schema.fields, *(T.StructField(c, T.DoubleType()) for c in FITTED)])
    fitted = levels.mapInArrow(fit, schema)

    def codes_with(side):
        return F.transform(F.filter("levels", lambda e: e[side] > 0), lambda e: e["code"])

    zero, one = codes_with("n0"), codes_with("n1")
    # the classes overlap when neither lies wholly at or beyond the other's edge
    overlap = (F.array_max(zero) > F.array_min(one)) & (F.array_max(one) > F.array_min(zero))
    overlap = F.coalesce(overlap, F.lit(False))
    many = F.size("levels") >= 2
    low, high = F.get("levels", 0), F.get("levels", F.size("levels") - 1)
    out = fitted.withColumns({"ref_code": low["code"], "test_code": F.when(many, high["code"]), "_many": many})
    cases = F.aggregate("levels", F.lit(0.0), lambda n, e: n + e["n0"] + e["n1"])
    settled = F.coalesce(F.col("_gradient") <= GRADIENT * cases, F.lit(False))
    beta = F.when(overlap, F.col("_slope"))
    se = F.when(overlap & (F.col("_determinant") > 0), F.sqrt(F.col("_information") / F.col("_determinant")))
    return _wald(out, beta, se, overlap, "additive", settled).drop(*FITTED)


def additive_fits(levels: pa.Array, steps: int) -> tuple[np.ndarray, ...]:
    """Slope, information on the intercept, determinant of the information, and sum of the absolute gradient of each row's fit.

    ``levels`` are lists of (code, n0, n1). A row rests once a step leaves its coefficients as they are.
    """
    width = np.diff(levels.offsets.to_numpy())
    flat = levels.flatten()
    row = np.repeat(np.arange(len(levels)), width)
    place = np.arange(len(row)) - np.repeat(np.cumsum(width) - width, width)
    code, n, n1 = (np.zeros((len(levels), int(width.max(initial=1)))) for _ in range(3))
    zeros, ones = (flat.field(f).to_numpy(zero_copy_only=False).astype(float) for f in ("n0", "n1"))
    code[row, place], n[row, place], n1[row, place] = flat.field("code").to_numpy(zero_copy_only=False), zeros + ones, ones
    beta = np.zeros((len(levels), 2))

    def sums(at):
        x, p = code[at], 1 / (1 + np.exp(-(beta[at, :1] + beta[at, 1:] * code[at])))
        rest, w = n1[at] - n[at] * p, n[at] * p * (1 - p)
        return rest.sum(axis=1), (x * rest).sum(axis=1), w.sum(axis=1), (w * x).sum(axis=1), (w * x * x).sum(axis=1)

    moving = np.arange(len(levels))
    with np.errstate(all="ignore"):
        for _ in range(steps):
            if not len(moving):
                break
            g0, g1, h00, h01, h11 = sums(moving)
            det = h00 * h11 - h01 * h01
            step = np.where((det > 1e-12)[:, None], np.stack([h11 * g0 - h01 * g1, h00 * g1 - h01 * g0], axis=1) / det[:, None], 0.0)
            after = beta[moving] + step
            still = (after != beta[moving]).any(axis=1) & (np.abs(step) > RESTING * (1 + np.abs(after))).any(axis=1)
            beta[moving] = after
            moving = moving[still]
        g0, g1, h00, h01, h11 = sums(np.arange(len(levels)))
    return beta[:, 1], h00, h00 * h11 - h01 * h01, np.abs(g0) + np.abs(g1)


def _wald(df: DataFrame, beta: Column, se: Column, fits: Column, model: str, settled: Column | None = None) -> DataFrame:
    settled = F.lit(True) if settled is None else settled
    ok = F.col("_many") & fits & settled
    return (
        df.withColumns({"beta": F.when(ok, beta), "se": F.when(ok, se)})
        .withColumns(
            {
                "p_value": two_sided_normal_p(F.when(F.col("se") > 0, F.col("beta") / F.col("se"))),
                "status": F.when(~F.col("_many"), "single_level").when(ok, "ok").when(fits, "not_converged").otherwise("separation"),
                "model": F.lit(model),
            }
        )
        .drop("_many", "levels")
    )
