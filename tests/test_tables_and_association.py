import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import fixture_views as fx
from genopair.functions import encode_arrays
from genopair.operators import association, packed, pairs, quality, roster, tables
from genopair.plans import callset, dosage
from tests.conftest import rows

ENCODED = "chrom int, pos bigint, snp string, variant_idx bigint, case_id string, code tinyint"


@pytest.fixture(scope="module")
def matrix(spark):
    """Six variants at four positions, 40 cases; one position holds three variants, one variant is all missing."""
    rng = np.random.default_rng(3)
    place = {0: 10, 1: 20, 2: 20, 3: 20, 4: 30, 5: 40}
    data = []
    for v, pos in place.items():
        for c in range(40):
            code = None if v == 4 or rng.random() < 0.1 else int(rng.integers(0, 3))
            data.append((1, pos, f"rs{v}", v, f"c{c}", code))
    return data


def status_of(case):
    k = int(case[1:])
    return "case" if k % 3 == 0 else "control" if k % 3 == 1 else None


@pytest.fixture(scope="module")
def status(spark):
    return spark.createDataFrame([(f"c{k}", status_of(f"c{k}")) for k in range(40) if status_of(f"c{k}")], "case_id string, status string")


def counted(data, levels, floor=0):
    sums = defaultdict(dict)
    for _, pos, _, _, case, code in data:
        old = sums[pos].get(case)
        sums[pos][case] = old if code is None else code + (old or 0)
    out = {}
    for pos, by_case in sums.items():
        n = Counter((status_of(c), x) for c, x in by_case.items())
        out[pos] = [max(floor, n[(s, c)]) for s in ("case", "control") for c in levels]
    return out


@pytest.mark.parametrize("mode, floor, known", [("count", 0, True), ("count", 1, False), ("presence", 0, False), ("presence", 1, True)])
def test_contingency_sums_repeated_positions(spark, matrix, status, mode, floor, known):
    enc = spark.createDataFrame(matrix, ENCODED)
    repeated = quality.repeated_positions(enc.select(*pairs.VARIANT).distinct()) if known else None
    got = tables.contingency(enc, status, mode, repeated=repeated, floor=floor)
    levels = tables.LEVELS[mode]
    cols = [f"{s}_{c}" for s in ("case", "control") for c in levels]
    assert {r.pos: [r[c] for c in cols] for r in got.collect()} == counted(matrix, levels, floor)
    assert tables.contingency_rows(got, mode).count() == 8


def test_contingency_can_drop_repeated_positions(spark, matrix, status):
    enc = spark.createDataFrame(matrix, ENCODED)
    got = tables.contingency(enc, status, on_repeat="drop")
    assert sorted(r.pos for r in got.collect()) == [10, 30, 40]
    with pytest.raises(ValueError):
        tables.contingency(enc, status, on_repeat="mean")


def test_empty_input(spark, status):
    enc = spark.createDataFrame([], ENCODED)
    assert tables.contingency(enc, status).count() == 0
    assert association.variant_levels(association.code_counts(enc, status.withColumn("y", F.lit(1)), ["y"]), ["y"]).count() == 0


def test_untestable_positions(spark, matrix, status):
    enc = spark.createDataFrame(matrix, ENCODED)
    tested = association.chi_square(tables.contingency(enc, status))
    missing = tested.filter("pos = 30").first()
    assert missing.status == "zero_expected" and missing.p_value is None
    floored = association.chi_square(tables.floored_contingency(enc, status)).filter("pos = 30").first()
    assert floored.status == "ok" and floored.p_value == pytest.approx(1.0)
    full = {pos for pos, n in counted(matrix, (0, 1, 2)).items() if all(a + b for a, b in zip(n[:3], n[3:]))}
    assert {r.pos for r in association.testable(tested).collect()} == full and {10, 40} <= full
    logs = association.with_neg_log_p(tested).collect()
    assert all(r.neg_log_p == pytest.approx(-math.log(r.p_value)) for r in logs)


def test_mismatch_type_frequency(spark):
    slots = [(1, 5, "a", 0, "c1", 0, 0), (1, 5, "a", 0, "c2", 0, 3), (1, 5, "a", 0, "c3", None, None), (1, 5, "a", 0, "c4", 6, 3)]
    df = spark.createDataFrame(slots, "chrom int, pos bigint, snp string, variant_idx bigint, case_id string, slot1 tinyint, slot2 tinyint")
    r = tables.mismatch_type_frequency(df).first()
    assert (r.match, r.alt1_ref, r.alt2_alt1, r.missing) == (3, 2, 1, 2)
    assert sum(r[c] for c in r.asDict() if c not in pairs.VARIANT) == 8
    assert tables.mismatch_type_frequency(df, 6).first().missing == 6
    assert tables.slot_rows(df).count() == 8


def test_density_windows(spark):
    pos = [0, 5, 10, 19, 20, 30, 31, 34]
    df = spark.createDataFrame([(1, p) for p in pos] + [(2, 4)], "chrom int, pos bigint")
    got = {(r.chrom, r.start): (r.n_variants, r.partial) for r in tables.variant_density(df, 10).collect()}
    edges = np.arange(0, max(pos), 10)
    full, _ = np.histogram(pos, bins=edges)
    assert [got[(1, int(e))] for e in edges[:-1]] == [(int(n), False) for n in full]
    assert got[(1, 30)] == (2, True) and got[(2, 0)] == (1, True)
    # the greatest position is itself a multiple of the width
    got = tables.variant_density(spark.createDataFrame([(1, p) for p in (1, 20, 30)], "chrom int, pos bigint"), 10)
    assert {r.start: r.n_variants for r in got.collect()} == {0: 1, 10: 1, 20: 1}


def test_small_counts(spark):
    v = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (2, 3)], "chrom int, numalt int")
    assert rows(tables.alternate_allele_histogram(v)) == [(1, 1, 2), (1, 2, 1), (2, 3, 1)]
    e = spark.createDataFrame([("count", 0), ("count", 0), ("count", None)], "mode string, code int")
    assert rows(tables.encoded_summary(e)) == [("count", None, 1), ("count", 0, 2)]


# --- logistic regression against iteratively reweighted least squares -----------------------------


def irls(x, y, n_iter=40):
    beta = np.zeros(x.shape[1])
    for _ in range(n_iter):
        p = 1 / (1 + np.exp(-x @ beta))
        h = x.T @ (x * (p * (1 - p))[:, None])
        beta = beta + np.linalg.solve(h, x.T @ (y - p))
    se = np.sqrt(np.diag(np.linalg.inv(h)))
    return beta, se, [math.erfc(abs(b / s) / math.sqrt(2)) for b, s in zip(beta, se)]


def levels_frame(spark, tests):
    data = [(1, 1, f"rs{k}", k, 0, "y", [(c, a, b) for c, (a, b) in sorted(t.items())]) for k, t in enumerate(tests)]
    return spark.createDataFrame(
        data, "chrom int, pos bigint, snp string, variant_idx bigint, n_called bigint, outcome string, levels array<struct<code:int,n0:bigint,n1:bigint>>"
    )


def test_logistic_models(spark):
    rng = np.random.default_rng(11)
    tests = [{int(c): tuple(int(z) for z in rng.integers(2, 40, 2)) for c in rng.choice(np.arange(-2, 9), rng.integers(2, 7), replace=False)} for _ in range(25)]
    df = levels_frame(spark, tests)
    factor = {r.variant_idx: r for r in association.logistic_factor(df).collect()}
    additive = {r.variant_idx: r for r in association.logistic_additive(df).collect()}
    for k, t in enumerate(tests):
        codes = sorted(t)
        x = np.concatenate([np.full(a + b, c) for c, (a, b) in sorted(t.items())])
        y = np.concatenate([np.r_[np.zeros(a), np.ones(b)] for c, (a, b) in sorted(t.items())])
        dummies = np.stack([np.ones(len(x))] + [(x == c).astype(float) for c in codes[1:]], 1)
        b, s, p = irls(dummies, y)
        r = factor[k]
        assert (r.ref_code, r.test_code, r.status) == (codes[0], codes[1], "ok")
        assert (r.beta, r.se, r.p_value) == (pytest.approx(b[1], abs=1e-8), pytest.approx(s[1], rel=1e-8), pytest.approx(p[1], rel=1e-6))
        b, s, p = irls(np.stack([np.ones(len(x)), x], 1).astype(float), y)
        r = additive[k]
        assert (r.beta, r.se, r.p_value) == (pytest.approx(b[1], abs=1e-8), pytest.approx(s[1], rel=1e-7), pytest.approx(p[1], rel=1e-6))


def test_logistic_edges(spark):
    tests = [{}, {0: (5, 5)}, {0: (5, 0), 1: (3, 3)}, {0: (5, 0), 1: (0, 4)}, {0: (3, 0), 1: (2, 0)}, {0: (0, 6), 1: (1, 2), 2: (4, 0)}, {-1: (3, 4), 0: (2, 5), 1: (6, 1)}]
    df = levels_frame(spark, tests)
    factor = [r.status for r in association.logistic_factor(df).orderBy("variant_idx").collect()]
    assert factor == ["single_level", "single_level", "separation", "separation", "separation", "separation", "ok"]
    additive = association.logistic_additive(df).orderBy("variant_idx").collect()
    assert [r.status for r in additive] == ["single_level", "single_level", "separation", "separation", "separation", "separation", "ok"]
    assert all((r.p_value is None) == (r.status != "ok") for r in additive)
    compat = association.logistic_factor(association.as_sentinel(df)).filter("variant_idx = 6").first()
    assert (compat.ref_code, compat.test_code) == (0, 1)


def test_counts_leave_out_incomplete_cases(spark):
    enc = spark.createDataFrame([(1, 1, "a", 0, f"c{k}", k % 2 if k < 5 else None) for k in range(7)], ENCODED)
    o = spark.createDataFrame([("c0", 0, 1), ("c1", 1, None), ("c2", 1, 0), ("c3", 0, 0), ("c6", 1, 1)], "case_id string, a int, b int")
    counts = {r.code: r for r in association.code_counts(enc, o, ["a", "b"]).collect()}
    assert (counts[0].n, counts[0].n0_a, counts[0].n1_a, counts[0].n0_b, counts[0].n1_b) == (3, 1, 1, 1, 1)
    assert (counts[1].n, counts[1].n0_a, counts[1].n1_a) == (2, 1, 0)
    assert counts[None].n == 2
    lv = {r.outcome: r for r in association.variant_levels(association.code_counts(enc, o, ["a", "b"]), ["a", "b"]).collect()}
    assert lv["a"].n_called == 5 and [tuple(x) for x in lv["a"].levels] == [(0, 1, 1), (1, 1, 0)]
    kept = association.complete_outcomes(pairs.with_outcome(enc, o, ["a", "b"]), ["a", "b"])
    assert sorted(r.case_id for r in kept.collect()) == ["c0", "c2", "c3"]


# --- packed rows ----------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def cohort_data(spark):
    rng = np.random.default_rng(9)
    n = 37
    data = []
    for v in range(30):
        calls = [None if rng.random() < (0.5 if v == 7 else 0.01) else int(x) for x in rng.integers(0, 3, n)]
        data.append((v % 3 + 1, 100 + v, "rs4" if v == 5 else f"rs{v}", v, calls))
    rows_ = spark.createDataFrame(data, "chrom int, pos bigint, snp string, variant_idx bigint, dosage array<tinyint>")
    samples = spark.createDataFrame([(f"s{k}", k) for k in range(n)], "sample_id string, sample_idx bigint")
    # s0 is in two cases, one donor is unknown, one case has two pairs, and of one case nobody is known
    pr = [(f"c{k}", f"s{k}", f"s{k + 17}") for k in range(17)] + [("c98", "s0", "s36"), ("c99", "gone", "s35")]
    pr += [("c3", "s20", "s4"), ("c97", "lost", "away")]
    cases = spark.createDataFrame(pr, "case_id string, did string, rid string")
    o = spark.createDataFrame(
        [(c, 2 if k == 8 else int(k % 2), None if k % 7 == 3 else int(k % 3 == 0), (10, 20, 40, 50)[k % 4]) for k, (c, _, _) in enumerate(pr) if c != "c16"],
        "case_id string, agvhi24 int, agvhi34 int, disease int",
    )
    return rows_, samples, cases, o


def test_packed_pairs_equal_long_pairs(cohort_data, monkeypatch):
    rows_, samples, cases, _ = cohort_data
    want = rows(pairs.pair_calls(packed.unpack(rows_, samples), cases, keys=packed.VARIANT_KEY))
    assert len(want) == 30 * 20
    assert rows(packed.packed_pairs(rows_, samples, cases)) == want
    monkeypatch.setattr(roster, "TILE_BYTES", 200)
    assert rows(packed.packed_pairs(rows_, samples, cases)) == want


@pytest.mark.parametrize("mode", ["count", "count_directed", "pres_abs", "dr_genotype", "recipient"])
def test_packed_counts_equal_long_counts(cohort_data, monkeypatch, mode):
    rows_, samples, cases, o = cohort_data
    paired = pairs.pair_calls(packed.unpack(rows_, samples), cases, keys=packed.VARIANT_KEY)
    want = rows(association.code_counts(pairs.encode_pairs(paired, mode, packed.VARIANT_KEY), o, dosage.OUTCOMES, packed.VARIANT_KEY))
    got = packed.packed_code_counts(rows_, samples, cases, o, dosage.OUTCOMES, mode)
    assert rows(got) == want
    monkeypatch.setattr(roster, "TILE_BYTES", 200)
    assert rows(packed.packed_code_counts(rows_, samples, cases, o, dosage.OUTCOMES, mode)) == want


def test_all_modes_and_groups_from_one_scan(cohort_data):
    rows_, samples, cases, o = cohort_data
    modes = ("count", "dr_genotype")
    got = packed.packed_mode_counts(rows_, samples, cases, o, dosage.OUTCOMES, modes, groups=(10, 40))
    for mode in modes:
        for value in (10, 40):
            chosen = o.filter(F.col("disease") == value)
            some = cases.join(chosen.select("case_id"), "case_id", "left_semi")
            want = packed.packed_code_counts(rows_, samples, some, chosen, dosage.OUTCOMES, mode)
            mine = got.filter((F.col("mode") == mode) & (F.col("grp") == value)).select(*want.columns)
            assert rows(mine) == rows(want)


def test_packed_alleles_equal_long_alleles(spark, monkeypatch):
    rng = np.random.default_rng(4)
    n, m = 24, 18
    allele = lambda: [None if x < 0 else int(x) for x in rng.integers(-1, 4, n)]
    data = [(1, 100 + v // 2 if v < 8 else 100 + v, f"rs{v}", v, allele(), allele()) for v in range(m)]
    rows_ = spark.createDataFrame(data, "chrom int, pos bigint, snp string, variant_idx bigint, a1 array<tinyint>, a2 array<tinyint>")
    slots = spark.createDataFrame([(f"s{k}", k) for k in range(n)], "sample_id string, sample_idx bigint")
    pr = spark.createDataFrame([(f"c{k}", f"s{k}", f"s{k + 12}") for k in range(12)] + [("c3", "s1", "s2"), ("c97", "x", "y")], "case_id string, did string, rid string")
    status = spark.createDataFrame([(f"c{k}", ("case", "control")[k % 2]) for k in range(11)], "case_id string, status string")
    paired = pairs.pair_calls(packed.unpack(rows_, slots, ("a1", "a2"), pairs.VARIANT), pr, ("a1", "a2"))
    for mode in ("count", "presence"):
        want = rows(tables.contingency(callset.encode_alleles(paired, mode), status, mode, repeated=quality.repeated_positions(rows_)))
        for size in (1 << 20, 150):
            monkeypatch.setattr(roster, "TILE_BYTES", size)
            assert rows(tables.packed_contingency(rows_, slots, pr, status, mode)) == want
    want = rows(tables.mismatch_type_frequency(callset.encode_mismatch_types(paired)))
    assert rows(packed.packed_type_counts(rows_, slots, pr)) == want


def test_an_outcome_row_is_taken_whole(spark):
    o = spark.createDataFrame([("a", 1, 0, 2), ("a", 0, 1, 1), ("b", 0, 0, 1)], "case_id string, x int, y int, file_order int")
    assert rows(pairs.outcome_of_case(o, ["x", "y"])) == [("a", 0, 1), ("b", 0, 0)]
    assert rows(pairs.outcome_of_case(o.drop("file_order"), ["y", "x"])) == [("a", 0, 1), ("b", 0, 0)]


@pytest.mark.parametrize("chunk", [4, 1000])
def test_packed_codes_and_back(cohort_data, monkeypatch, chunk):
    rows_, samples, cases, _ = cohort_data
    order = packed.case_order(cases)
    enc = pairs.encode_pairs(packed.packed_pairs(rows_, samples, cases), "count_directed", packed.VARIANT_KEY)
    packed_keys = ["chrom", "variant_idx", "case_id", "code"]
    # every case has a place, also one of which nobody is known; c3 has two pairs and one code
    once = enc.filter("case_id <> 'c3'").unionByName(rows_.select("chrom", "variant_idx", F.lit("c97").alias("case_id"), F.lit(None).cast("tinyint").alias("code")))
    want = rows(once.select(*packed_keys))

    def without(df):
        return rows(packed.unpack_codes(df, order, chunk).select(*packed_keys).filter("case_id <> 'c3'"))

    codes = packed.packed_codes(rows_, samples, cases, "count_directed", chunk)
    assert without(codes) == want
    assert without(packed.pack(enc, order, chunk)) == want
    assert codes.agg(F.max(F.size("codes"))).first()[0] == min(chunk, 20)
    monkeypatch.setattr(roster, "TILE_BYTES", 100)
    assert without(packed.packed_codes(rows_, samples, cases, "count_directed", chunk)) == want


def test_matrix_by_case(cohort_data):
    rows_, samples, cases, _ = cohort_data
    enc = pairs.encode_pairs(packed.packed_pairs(rows_, samples, cases), "count", packed.VARIANT_KEY)
    by = packed.by_case(enc, 8)
    assert by.agg(F.sum(F.size("codes"))).first()[0] == 30 * 20
    assert by.agg(F.max(F.size("codes"))).first()[0] <= 8


def test_logistic_plan_filters(cohort_data):
    rows_, samples, cases, o = cohort_data
    got = dosage.mismatch_logistic(rows_, samples, cases, o, "count", scope=(), min_rate=0.8)
    seen = {r.variant_idx for r in got.collect()}
    # variants 4 and 5 share an id, variant 7 is poorly called
    assert not seen & {4, 5, 7} and len(seen) >= 20
    assert got.groupBy("variant_idx").count().filter("count <> 2").count() == 0


def test_disease_plan_uses_only_its_cases(cohort_data):
    rows_, samples, cases, o = cohort_data
    got = dosage.recipient_disease_logistic(rows_, samples, cases, o, "AML", scope=(), min_rate=0.5)
    assert got.agg(F.max("n_called")).first()[0] <= o.filter("disease = 10").count()


def test_group_logistic_runs_on_labels(spark):
    enc = spark.createDataFrame([(1, 1, "a", 0, f"c{k}", k % 2) for k in range(30)], ENCODED)
    s = spark.createDataFrame([(f"c{k}", "a" if k % 3 else "n", "D") for k in range(30)], "group_id string, group string, subject_type string")
    assert callset.group_logistic(enc, s).first().status == "ok"


def test_contingency_at_call_rate_equals_filter_then_table(spark, matrix, status):
    enc = spark.createDataFrame(matrix, ENCODED)
    repeated = quality.repeated_positions(enc.select(*pairs.VARIANT).distinct())
    for rate in (0.88, 0.92):
        want = tables.contingency(quality.filter_call_rate(enc, 40, rate), status)
        assert rows(tables.contingency_at_call_rate(enc, status, 40, repeated, min_rate=rate)) == rows(want)


def test_an_unsettled_fit_is_told(cohort_data, monkeypatch):
    rows_, samples, cases, o = cohort_data
    counts = packed.packed_code_counts(rows_, samples, cases, o, dosage.OUTCOMES, "count")
    levels = association.variant_levels(counts, dosage.OUTCOMES, packed.VARIANT_KEY)
    assert association.logistic_additive(levels).filter("status = 'not_converged'").count() == 0
    monkeypatch.setattr(association, "NEWTON_STEPS", 1)
    early = association.logistic_additive(levels).filter("status = 'not_converged'").collect()
    assert early and all(r.beta is None and r.p_value is None for r in early)


def test_counts_are_of_rows_whatever_the_number_of_tiles(spark, monkeypatch):
    """Two rows with one whole key: the same rows from one tile of pairs and from many."""
    data = [(1, 10, "rs1", 1, [0, 1], [1, 1]), (1, 10, "rs1", 1, [0, 0], [0, 1]), (1, 20, "rs2", 2, [1, 0], [None, 0])]
    rows_ = spark.createDataFrame(data, "chrom int, pos bigint, snp string, variant_idx bigint, a1 array<tinyint>, a2 array<tinyint>")
    slots = spark.createDataFrame([("s0", 0), ("s1", 1)], "sample_id string, sample_idx bigint")
    pr = spark.createDataFrame([("c1", "s0", "s1"), ("c2", "s1", "s0"), ("c3", "s0", "s0")], "case_id string, did string, rid string")
    status = spark.createDataFrame([("c1", "case"), ("c2", "control"), ("c3", "case")], "case_id string, status string")
    found = []
    for size in (64 << 20, 8):
        monkeypatch.setattr(roster, "TILE_BYTES", size)
        found.append(
            [
                rows(tables.packed_contingency(rows_, slots, pr, status, "count")),
                rows(packed.packed_allele_counts(rows_, slots, pr, status, "count")),
                rows(packed.packed_type_counts(rows_, slots, pr)),
            ]
        )
    assert found[0] == found[1]
    table, counts, types = found[0]
    assert [(r[1]) for r in table] == [10, 20] and len(counts) == 9 and len(types) == 3
    # position 10: c1 and c2 differ by 1 and 1, that is 2 together; c3 by nothing
    assert table[0] == (1, 10, 1, 0, 1, 0, 0, 1)


def test_tiles_stay_in_the_shared_folder(spark, monkeypatch):
    """The driver gets a path and a count for each tile, however many pairs there are."""
    monkeypatch.setattr(roster, "TILE_BYTES", 4096)
    sizes = []
    for n in (1000, 4000):
        pr = spark.range(n).select(F.col("id").alias("case_id"), F.col("id").cast("int").alias("d"), F.lit(None).cast("int").alias("r"))
        tiles = roster.write_tiles(pr, F.col("case_id"), by_case=True)
        found = [t for _, t in tiles.tables()]
        assert sorted(x for t in found for x in t["case_id"].to_pylist()) == list(range(n))
        assert max(t.nbytes for t in found) < 4 * 4096 and all(roster.column(t, "r").max() == roster.ABSENT for t in found)
        sizes.append(len(tiles.paths))
    assert sizes[1] > 3 * sizes[0]


def test_many_alleles_are_coded_as_few_ones_are():
    from genopair.functions import encode_arrays as ea

    rng = np.random.default_rng(8)
    for high in (3, 9, 100):
        d1, d2, r1, r2 = (rng.integers(-1, high + 1, (40, 30)).astype(np.int16) for _ in range(4))
        for mode in ("count", "presence"):
            cells = ea.by_genotypes(lambda *a, m=mode: ea.allele_cells(m, *a))
            got = cells(ea.genotype_number(d1, d2), ea.genotype_number(r1, r2))
            assert (got == ea.allele_cells(mode, d1, d2, r1, r2)).all()


@pytest.mark.parametrize("mode", ["count", "presence"])
@pytest.mark.parametrize("size", [1 << 20, 120])
def test_repeated_positions_from_packed_rows_in_one_scan(spark, monkeypatch, mode, size):
    """Rows of one position all over the table, missing calls, sums outside the levels, a case with two pairs."""
    rng = np.random.default_rng(5)
    n, m = 20, 40
    allele = lambda: [None if x < 0 else int(x) for x in rng.integers(-1, 6, n)]
    # a third of all rows at one position, several at others
    data = [(1 + v % 2, 100 if v % 3 == 0 else 200 + v // 4, f"rs{v}", v, allele(), allele()) for v in rng.permutation(m).tolist()]
    data.append((3, 7, "none", 99, [None] * n, [None] * n))
    rows_ = spark.createDataFrame(data, "chrom int, pos bigint, snp string, variant_idx bigint, a1 array<tinyint>, a2 array<tinyint>").repartition(5)
    slots = spark.createDataFrame([(f"s{k}", k) for k in range(n)], "sample_id string, sample_idx bigint")
    pr = spark.createDataFrame([(f"c{k}", f"s{k}", f"s{k + 10}") for k in range(10)] + [("c3", "s1", "s2"), ("c97", "x", "s5")], "case_id string, did string, rid string")
    status = spark.createDataFrame([(f"c{k}", ("case", "control")[k % 2]) for k in range(9)], "case_id string, status string")
    paired = pairs.pair_calls(packed.unpack(rows_, slots, ("a1", "a2"), pairs.VARIANT), pr, ("a1", "a2"))
    want = tables.contingency(callset.encode_alleles(paired, mode), status, mode, repeated=quality.repeated_positions(rows_), outside=True)
    monkeypatch.setattr(roster, "TILE_BYTES", size)
    got = tables.packed_contingency(rows_, slots, pr, status, mode, outside=True)
    assert rows(got, *want.columns) == rows(want) and want.agg(F.sum("outside")).first()[0] > 0
    monkeypatch.setattr(tables, "HELD_CELLS", 1)
    assert rows(tables.packed_contingency(rows_, slots, pr, status, mode, outside=True), *want.columns) == rows(want)


def test_repeated_positions_read_genotypes_once(spark, folder):
    from genopair.sources import sinks, tables as saved_tables

    rows_ = spark.createDataFrame([(1, 10 + v // 2, f"rs{v}", v, [0, 1], [1, 1]) for v in range(8)], "chrom int, pos bigint, snp string, variant_idx bigint, a1 array<tinyint>, a2 array<tinyint>")
    slots = spark.createDataFrame([("s0", 0), ("s1", 1)], "sample_id string, sample_idx bigint")
    sinks.write_packed_calls(rows_, slots, f"{folder}/c")
    calls = saved_tables.read_packed(spark, f"{folder}/c").packed
    pr = spark.createDataFrame([("c1", "s0", "s1")], "case_id string, did string, rid string")
    status = spark.createDataFrame([("c1", "case")], "case_id string, status string")
    physical = tables.packed_contingency(calls, slots, pr, status)._jdf.queryExecution().executedPlan().toString()
    assert sum("a1:array" in line for line in physical.splitlines() if "FileScan" in line) == 1


@pytest.mark.parametrize("chunk,size", [(8, 1 << 20), (7, 100), (1000, 1 << 20)])
def test_matrix_by_case_from_packed_rows(cohort_data, monkeypatch, chunk, size):
    rows_, samples, cases, _ = cohort_data
    enc = pairs.encode_pairs(packed.packed_pairs(rows_, samples, cases), "count", packed.VARIANT_KEY)
    once = enc.filter("case_id <> 'c3'")
    want = rows(packed.by_case(once, chunk))
    monkeypatch.setattr(roster, "TILE_BYTES", size)
    got = packed.packed_by_case(rows_.repartition(3), samples, cases, "count", chunk)
    assert rows(got.filter("case_id <> 'c3'")) == want
    assert got.filter("case_id = 'c3'").agg(F.sum(F.size("codes"))).first()[0] == 30
    monkeypatch.setattr(packed, "WAITING_CELLS", 1)
    assert rows(packed.packed_by_case(rows_, samples, cases, "count", chunk).filter("case_id <> 'c3'")) == want


def test_joint_counts_of_uneven_rows():
    """Pairs by joint cell and class: rows of several lengths, missing lists and values, slots beyond a list, pairs in many tiles."""
    rng = np.random.default_rng(5)
    lists = [None if k == 3 else [None if x == 3 else int(x) for x in rng.integers(0, 4, 200 - 30 * (k % 4))] for k in range(11)]
    d, r = (rng.integers(-1, 230, 700).astype(np.int32) for _ in range(2))
    r[d < 0] = 5
    cls = rng.choice([0, 2, 3, 6], 700).astype(np.int32)

    class Some:
        def tables(self):
            for k in range(3):
                yield k, roster._in_classes(pa.table({"d": d[k::3], "r": r[k::3], "cls": cls[k::3]}))

    want = np.zeros((11, 16, 7), np.int64)
    for row, values in enumerate(lists):
        number = lambda s: 3 if values is None or s < 0 or s >= len(values) or values[s] is None else values[s]
        for a, b, c in zip(d.tolist(), r.tolist(), cls.tolist()):
            want[row, 4 * number(a) + number(b), c] += 1
    for kind in (pa.int8(), pa.int32()):
        found = roster.joint_counts(pa.array(lists, pa.list_(kind)), Some(), 7, encode_arrays.dosage_number)
        assert (found == want).all()


@pytest.mark.parametrize("kind", [pa.int8(), pa.int32()])
def test_joint_counts_of_one_side_and_in_steps(monkeypatch, kind):
    """The recipients' numbers alone are what the joint cells add up to, for any steps of pairs, slots and rows."""
    rng = np.random.default_rng(9)
    content, valid = rng.integers(-2, 5, 3 + 9 * 300), rng.random(3 + 9 * 300) < 0.9
    # a slice of lists whose nulls lie on values that would count
    lists = pa.ListArray.from_arrays(pa.array([0, 3, *range(303, 304 + 8 * 300, 300)], pa.int32()), pa.array(content, kind, mask=~valid)).slice(1)
    d, r = (rng.integers(-1, 310, 900).astype(np.int32) for _ in range(2))
    r[d < 0] = 5
    table = roster._in_classes(pa.table({"d": d, "r": r, "cls": rng.choice([0, 1, 4], 900).astype(np.int32)}))

    class One:
        def tables(self):
            yield 0, table

    both = roster.joint_counts(lists, One(), 5, encode_arrays.dosage_number)
    assert both.sum() == 9 * 900
    for x in range(3):
        assert (both.reshape(9, 4, 4, 5)[:, :, x].sum(axis=(1, 2)) == [sum(0 <= s < len(v) and v[s] == x for s in r.tolist()) for v in lists.to_pylist()]).all()
    monkeypatch.setattr(roster, "PAIRS_PER_STEP", 128)
    monkeypatch.setattr(roster, "SLOTS_PER_STEP", 64)
    monkeypatch.setattr(roster, "PACKED_BYTES", 1)
    assert (roster.joint_counts(lists, One(), 5, encode_arrays.dosage_number) == both).all()
    one = roster.joint_counts(lists, One(), 5, encode_arrays.dosage_number, ("r",))
    assert (one == both.reshape(9, 4, 4, 5).sum(axis=1)).all()


def test_dosages_are_counted_where_they_are_made(spark, folder):
    """The grid's lists never leave the task that counts them: one step of Python, and the rows are those of the plain formula."""
    spark.range(60).select(F.col("id").alias("c_custkey"), (F.col("id") % 25).alias("c_nationkey"), F.lit("BUILDING").alias("c_mktsegment")).write.parquet(f"{folder}/customer.parquet")
    spark.range(40).select((F.col("id") * 31 + 1).alias("p_partkey")).write.parquet(f"{folder}/part.parquet")
    grid = fx.grid_packed(spark, folder, cells=300)
    assert grid.rdd.getNumPartitions() >= 8
    plain = fx.grid_variants(spark, folder).withColumn("dosage", F.transform(F.sequence(F.lit(0), F.lit(59)), lambda c: fx.grid_dosage(c, F.col("variant_idx"))))
    assert grid.count() == 40 and grid.exceptAll(plain).isEmpty() and plain.exceptAll(grid).isEmpty()
    counts = packed.packed_mode_counts(grid, fx.grid_samples(spark, folder), fx.grid_pairs(spark, folder), fx.grid_outcomes(spark, folder), dosage.OUTCOMES, ("count",))
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "MapInArrow" not in plan
    listed = packed.packed_mode_counts(plain, fx.grid_samples(spark, folder), fx.grid_pairs(spark, folder), fx.grid_outcomes(spark, folder), dosage.OUTCOMES, ("count",))
    assert rows(counts) == rows(listed)


def test_lists_are_made_once_for_the_long_form(spark, folder):
    """No filter on the lists' size has them made again, before they are spread; pairs of known partitions meet without a shuffle."""
    spark.range(60).select(F.col("id").alias("c_custkey")).write.parquet(f"{folder}/customer.parquet")
    spark.range(40).select((F.col("id") * 31 + 1).alias("p_partkey")).write.parquet(f"{folder}/part.parquet")
    grid = fx.grid_packed_plain(spark, folder, cells=300)
    assert grid.exceptAll(fx.grid_packed(spark, folder)).isEmpty() and grid.count() == 40
    calls = packed.unpack(grid, fx.grid_samples(spark, folder))
    plan = calls._jdf.queryExecution().executedPlan().toString()
    assert calls.count() == 40 * 60 and "size(" not in plan
    paired = pairs.pair_calls(calls, fx.grid_pairs(spark, folder), ("dosage",), packed.VARIANT_KEY)
    plan = paired._jdf.queryExecution().executedPlan().toString()
    assert paired.count() == 40 * 30 and plan.count("Exchange hashpartitioning") == 1


def test_unpack_drops_rows_without_calls(spark):
    rows_ = spark.createDataFrame([(1, 1, [0, None]), (1, 2, []), (1, 3, None)], "chrom int, variant_idx bigint, dosage array<tinyint>")
    slots = spark.createDataFrame([("a", 0), ("b", 1)], "sample_id string, sample_idx bigint")
    assert rows(packed.unpack(rows_, slots)) == [(1, 1, "a", 0), (1, 1, "b", None)]
