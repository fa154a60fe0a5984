"""Pieces of SQL text shared by the checks in ``registered.py``."""

from genopair.functions.stats import ERFC_COEFFICIENTS


def sql(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n" + select.strip()


def r6(expr: str) -> str:
    """Six decimals; adding zero turns -0.0 into 0.0."""
    return f"round({expr}, 6) + 0.0"


def erfc(z: str) -> str:
    t = f"(1.0 / (1.0 + 0.5 * ({z})))"
    poly = repr(ERFC_COEFFICIENTS[-1])
    for c in reversed(ERFC_COEFFICIENTS[:-1]):
        poly = f"({c!r} + {t} * {poly})"
    return f"({t} * exp(-({z}) * ({z}) + {poly}))"


def paired(name: str, calls: str, pairs: str, values=("dosage",), keys="chrom, pos, snp, variant_idx") -> str:
    sides = ", ".join(
        f"max(CASE WHEN c.sample_id = p.{sample} THEN c.{v} END) AS {side}_{v}" for side, sample in (("d", "did"), ("r", "rid")) for v in values
    )
    k = ", ".join(f"c.{x.strip()}" for x in keys.split(","))
    return f"""
{name} AS (
  SELECT {k}, p.case_id, {sides}
  FROM {calls} c JOIN {pairs} p ON c.sample_id = p.did OR c.sample_id = p.rid
  GROUP BY {k}, p.case_id)"""


def paired_by_role(name: str, calls: str, pairs: str, values=("dosage",)) -> str:
    """As ``paired`` with two equi-joins, which DuckDB runs faster on large tables."""
    cols = ", ".join(f"d.{v} AS d_{v}, r.{v} AS r_{v}" for v in values)
    return f"""
{name} AS (
  SELECT d.chrom, d.pos, d.snp, d.variant_idx, p.case_id, {cols}
  FROM {pairs} p JOIN {calls} d ON d.sample_id = p.did
  JOIN {calls} r ON r.sample_id = p.rid AND r.variant_idx = d.variant_idx)"""


DOSAGE = {
    "count": "abs(d_dosage - r_dosage)",
    "count_directed": "d_dosage - r_dosage",
    "pres_abs": "CASE WHEN d_dosage IS NULL OR r_dosage IS NULL THEN NULL WHEN d_dosage = r_dosage THEN 0 ELSE 1 END",
    "dr_genotype": "3 * d_dosage + r_dosage",
    "recipient": "r_dosage",
}

# Sets as lists: how many distinct alleles both genotypes hold.
SHARED = "len(list_intersect([d_a1, d_a2], [r_a1, r_a2]))"
KNOWN = "d_a1 IS NOT NULL AND d_a2 IS NOT NULL AND r_a1 IS NOT NULL AND r_a2 IS NOT NULL"
BOTH_HOM = "d_a1 = d_a2 AND r_a1 = r_a2"

ALLELE = {
    "count": f"""CASE WHEN NOT ({KNOWN}) THEN NULL WHEN {SHARED} = 2 THEN 0
      WHEN {SHARED} = 1 THEN CASE WHEN {BOTH_HOM} THEN 0 ELSE 1 END ELSE 2 END""",
    "presence": f"""CASE WHEN NOT ({KNOWN}) THEN NULL
      WHEN {SHARED} = 2 OR ({SHARED} = 1 AND {BOTH_HOM}) THEN 0 ELSE 1 END""",
}


def change(d: str, r: str) -> str:
    return (
        f"CASE WHEN {d} = 0 THEN CASE WHEN {r} = 1 THEN 1 ELSE 2 END "
        f"WHEN {d} = 1 THEN CASE WHEN {r} = 0 THEN 3 ELSE 4 END "
        f"ELSE CASE WHEN {r} = 0 THEN 5 ELSE 6 END END"
    )


def unshared(a: str, b: str) -> str:
    """The allele of genotype ``a`` outside genotype ``b``, or the common one."""
    pair = lambda g: f"[{g}_a1, {g}_a2]"
    left = f"list_filter({pair(a)}, lambda x: NOT list_contains({pair(b)}, x))"
    return f"coalesce({left}[1], {a}_a1)"


SLOT1 = f"CASE WHEN {KNOWN} THEN CASE WHEN {SHARED} >= 1 THEN 0 ELSE {change('d_a1', 'r_a1')} END END"
SLOT2 = f"""CASE WHEN {KNOWN} THEN CASE WHEN {SHARED} = 2 OR ({SHARED} = 1 AND {BOTH_HOM}) THEN 0
      WHEN {SHARED} = 1 THEN {change(unshared('d', 'r'), unshared('r', 'd'))}
      ELSE {change('d_a2', 'r_a2')} END END"""

GT_TYPE = "CASE WHEN {a}_a1 IS NULL OR {a}_a2 IS NULL THEN NULL WHEN {a}_a1 <> {a}_a2 THEN 1 WHEN {a}_a1 = 0 THEN 0 ELSE 2 END"


def contingency(name: str, encoded: str, status: str, levels, floor=0) -> str:
    """Case/control counts per position; a case's codes are summed over the variants of the position."""
    cells = ", ".join(
        f"greatest(count(CASE WHEN status = '{s}' AND code = {c} THEN 1 END), {floor}) AS {s}_{c}" for s in ("case", "control") for c in levels
    )
    return f"""
{name} AS (
  SELECT chrom, pos, {cells}
  FROM (SELECT e.chrom, e.pos, e.case_id, any_value(s.status) AS status, sum(e.code) AS code
        FROM {encoded} e LEFT JOIN {status} s USING (case_id) GROUP BY e.chrom, e.pos, e.case_id)
  GROUP BY chrom, pos)"""


def chi_square(name: str, table: str, levels) -> str:
    cells = [[f"{s}_{c}" for c in levels] for s in ("case", "control")]
    rows = ["(" + " + ".join(r) + ")" for r in cells]
    columns = [f"({a} + {b})" for a, b in zip(*cells)]
    total = f"({rows[0]} + {rows[1]})"
    terms = []
    for k, row in enumerate(cells):
        for j, cell in enumerate(row):
            e = f"(CAST({rows[k]} AS DOUBLE) * {columns[j]} / {total})"
            gap = f"abs({cell} - {e})"
            if len(levels) == 2:
                gap = f"({gap} - least(0.5, {gap}))"
            terms.append(f"{gap} * {gap} / {e}")
    ok = " AND ".join(f"{x} > 0" for x in rows + columns)
    p = "exp(-stat / 2)" if len(levels) == 3 else erfc("sqrt(stat / 2)")
    return f"""
{name} AS (
  SELECT *, {p} AS p_value, CASE WHEN stat IS NULL THEN 'zero_expected' ELSE 'ok' END AS status
  FROM (SELECT *, CASE WHEN {ok} THEN {' + '.join(terms)} END AS stat FROM {table}))"""


def levels(name: str, encoded: str, outcomes_cte: str, outcomes=("agvhi24", "agvhi34")) -> str:
    """Rows per variant, outcome and code: n0, n1 over cases with code and every outcome known."""
    complete = " AND ".join(f"o.{x} IS NOT NULL" for x in outcomes)
    parts = [
        f"""SELECT e.variant_idx, '{x}' AS outcome, e.code, count(CASE WHEN o.{x} = 0 THEN 1 END) AS n0,
         count(CASE WHEN o.{x} = 1 THEN 1 END) AS n1
  FROM {encoded} e JOIN {outcomes_cte} o USING (case_id) WHERE e.code IS NOT NULL AND {complete}
  GROUP BY e.variant_idx, e.code HAVING count(*) > 0"""
        for x in outcomes
    ]
    return f"{name} AS (\n  " + "\n  UNION ALL\n  ".join(parts) + ")"


def called(name: str, encoded: str) -> str:
    return f"""
{name} AS (
  SELECT chrom, pos, snp, variant_idx, count(code) AS n_called FROM {encoded} GROUP BY ALL)"""


def logistic_factor(name: str, levels_cte: str, called_cte: str, outcomes=("agvhi24", "agvhi34")) -> str:
    """Closed-form Wald test of the second level against the lowest."""
    names = ", ".join(f"('{o}')" for o in outcomes)
    p = erfc("abs(beta / se) / sqrt(2.0)")
    return f"""
{name}_ranked AS (
  SELECT *, row_number() OVER (PARTITION BY variant_idx, outcome ORDER BY code) AS k FROM {levels_cte}),
{name}_two AS (
  SELECT v.*, o.outcome, a.code AS ref_code, b.code AS test_code,
         a.n0 AS a0, a.n1 AS a1, b.n0 AS b0, b.n1 AS b1
  FROM {called_cte} v CROSS JOIN (VALUES {names}) AS o(outcome)
  LEFT JOIN {name}_ranked a ON a.variant_idx = v.variant_idx AND a.outcome = o.outcome AND a.k = 1
  LEFT JOIN {name}_ranked b ON b.variant_idx = v.variant_idx AND b.outcome = o.outcome AND b.k = 2),
{name}_fit AS (
  SELECT *, CASE WHEN a0 > 0 AND a1 > 0 AND b0 > 0 AND b1 > 0 THEN ln(CAST(b1 AS DOUBLE) * a0 / (CAST(b0 AS DOUBLE) * a1)) END AS beta,
         CASE WHEN a0 > 0 AND a1 > 0 AND b0 > 0 AND b1 > 0 THEN sqrt(1.0 / a0 + 1.0 / a1 + 1.0 / b0 + 1.0 / b1) END AS se
  FROM {name}_two),
{name} AS (
  SELECT chrom, pos, snp, variant_idx, outcome, n_called, ref_code, test_code, beta, se, {p} AS p_value,
         CASE WHEN test_code IS NULL THEN 'single_level' WHEN beta IS NULL THEN 'separation' ELSE 'ok' END AS status,
         'factor' AS model
  FROM {name}_fit)"""


def logistic_additive(name: str, levels_cte: str, called_cte: str, outcomes=("agvhi24", "agvhi34"), steps=14) -> str:
    """Newton steps on the level counts, one table per step."""
    names = ", ".join(f"('{o}')" for o in outcomes)
    out = [
        f"""
{name}_b0 AS MATERIALIZED (
  SELECT variant_idx, outcome, CAST(0 AS DOUBLE) AS b0, CAST(0 AS DOUBLE) AS b1,
         min(code) AS ref_code, max(code) AS test_code, count(*) AS n_levels,
         coalesce(max(CASE WHEN n0 > 0 THEN code END) > min(CASE WHEN n1 > 0 THEN code END)
                  AND max(CASE WHEN n1 > 0 THEN code END) > min(CASE WHEN n0 > 0 THEN code END), false) AS overlap
  FROM {levels_cte} GROUP BY variant_idx, outcome)"""
    ]
    sums = f"""sum(n1 - (n0 + n1) * p) AS g0, sum(code * (n1 - (n0 + n1) * p)) AS g1,
         sum((n0 + n1) * p * (1 - p)) AS h00, sum(code * (n0 + n1) * p * (1 - p)) AS h01,
         sum(code * code * (n0 + n1) * p * (1 - p)) AS h11"""

    def summed(k):
        return f"""
  SELECT variant_idx, outcome, any_value(b0) AS b0, any_value(b1) AS b1, any_value(ref_code) AS ref_code,
         any_value(test_code) AS test_code, any_value(n_levels) AS n_levels, any_value(overlap) AS overlap, {sums}
  FROM (SELECT l.*, s.b0, s.b1, s.ref_code, s.test_code, s.n_levels, s.overlap, 1 / (1 + exp(-(s.b0 + s.b1 * l.code))) AS p
        FROM {levels_cte} l JOIN {name}_b{k} s USING (variant_idx, outcome))
  GROUP BY variant_idx, outcome"""

    det = "(h00 * h11 - h01 * h01)"
    for k in range(steps):
        out.append(
            f"""
{name}_b{k + 1} AS MATERIALIZED (
  SELECT variant_idx, outcome,
         b0 + CASE WHEN {det} > 1e-12 THEN (h11 * g0 - h01 * g1) / {det} ELSE 0 END AS b0,
         b1 + CASE WHEN {det} > 1e-12 THEN (h00 * g1 - h01 * g0) / {det} ELSE 0 END AS b1,
         ref_code, test_code, n_levels, overlap
  FROM ({summed(k)}))"""
        )
    p = erfc("abs(beta / se) / sqrt(2.0)")
    out.append(
        f"""
{name} AS (
  SELECT chrom, pos, snp, variant_idx, outcome, n_called, ref_code,
         CASE WHEN n_levels >= 2 THEN test_code END AS test_code, beta, se, {p} AS p_value,
         CASE WHEN coalesce(n_levels, 0) < 2 THEN 'single_level' WHEN overlap THEN 'ok' ELSE 'separation' END AS status,
         'additive' AS model
  FROM (SELECT v.*, o.outcome, s.ref_code, s.test_code, s.n_levels, s.overlap,
               CASE WHEN s.overlap AND s.n_levels >= 2 THEN s.b1 END AS beta,
               CASE WHEN s.overlap AND s.n_levels >= 2 AND {det} > 0 THEN sqrt(h00 / {det}) END AS se
        FROM {called_cte} v CROSS JOIN (VALUES {names}) AS o(outcome)
        LEFT JOIN ({summed(steps)}) s ON s.variant_idx = v.variant_idx AND s.outcome = o.outcome))"""
    )
    return ",\n".join(x.strip() for x in out)
