import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from genopair.functions import encode, hla, ids, stats
from tests.conftest import rows


def test_dosage_codes_and_their_relations(spark):
    values = [None, 0, 1, 2]
    df = spark.createDataFrame(list(itertools.product(values, values)), "d_dosage tinyint, r_dosage tinyint")
    got = df.select("d_dosage", "r_dosage", *[encode.dosage_code(m).alias(m) for m in encode.DOSAGE_CODES]).collect()
    assert len(got) == 16
    for r in got:
        d, q = r.d_dosage, r.r_dosage
        assert r.recipient == q
        if d is None or q is None:
            assert (r["count"], r.count_directed, r.pres_abs, r.dr_genotype) == (None,) * 4
            continue
        assert r["count"] == abs(d - q) == abs(r.count_directed)
        assert r.count_directed == d - q
        assert r.pres_abs == min(r["count"], 1)
        assert divmod(r.dr_genotype, 3) == (d, q)
        for m, levels in encode.DOSAGE_LEVELS.items():
            assert r[m] in levels


def test_unknown_mode():
    with pytest.raises(ValueError):
        encode.dosage_code("other")


# The rules once more over Python sets, worked from their description.
def expected_codes(d, r):
    if None in d or None in r:
        return None, None, (None, None)
    both = set(d) & set(r)
    same = len(both) == 2 or (len(both) == 1 and len(set(d)) == 1 and len(set(r)) == 1)
    count = 0 if same else 2 - len(both)

    def change(a, b):
        return {0: {1: 1}, 1: {0: 3}}.get(a, {0: 5}).get(b, {0: 2, 1: 4}.get(a, 6))

    if same:
        slots = (0, 0)
    elif both:
        (common,) = both
        left = [next(iter(set(g) - both), common) for g in (d, r)]
        slots = (0, change(*left))
    else:
        slots = (change(d[0], r[0]), change(d[1], r[1]))
    return count, min(count, 1), slots


def test_allele_codes_on_all_genotype_pairs(spark):
    values = [None, 0, 1, 2, 3]
    grid = list(itertools.product(values, repeat=4))
    df = spark.createDataFrame(grid, "d_a1 tinyint, d_a2 tinyint, r_a1 tinyint, r_a2 tinyint")
    four = ("d_a1", "d_a2", "r_a1", "r_a2")
    s1, s2 = encode.mismatch_types(*four)
    got = df.select(
        *four,
        encode.allele_count(*four).alias("count"),
        encode.allele_presence(*four).alias("presence"),
        s1.alias("slot1"),
        s2.alias("slot2"),
        encode.gt_type("d_a1", "d_a2").alias("dt"),
        encode.gt_type_diff(*four).alias("diff"),
    ).collect()
    assert len(got) == len(grid)
    for r in got:
        d, q = (r.d_a1, r.d_a2), (r.r_a1, r.r_a2)
        assert (r["count"], r.presence, (r.slot1, r.slot2)) == expected_codes(d, q), (d, q)
        kind = lambda g: None if None in g else (1 if g[0] != g[1] else (0 if g[0] == 0 else 2))
        assert r.dt == kind(d)
        assert r["diff"] == (None if None in (kind(d), kind(q)) else abs(kind(d) - kind(q)))


def test_ids(spark):
    df = spark.createDataFrame([("7",), ("123456789",), ("12345678901",), ("1234567",), (None,)], "n string")
    got = df.select("n", ids.format_id("n", "donor").alias("d"), ids.format_id("n", "R").alias("r")).collect()
    by = {x.n: (x.d, x.r) for x in got}
    assert by["7"] == ("0000-0000-7", "000-000-7")
    assert by["123456789"] == ("1234-5678-9", "123-456-789")
    assert by["12345678901"] == ("1234-5678-901", "123-456-78901")
    assert by["1234567"] == ("0012-3456-7", "123-456-7")
    back = spark.createDataFrame([("0012-3456-7",), ("123-456-7",), ("1234567",)], "i string")
    got = back.select(ids.is_donor("i").alias("role"), ids.parse_id("i").alias("p")).collect()
    assert [g.role for g in got] == ["D", "R", None]
    assert [g.p.number for g in got] == [1234567] * 3


def test_erfc_in_relative_terms(spark):
    z = [0.0, 1e-6, 0.1, 0.5, 1, 2, 4, 8, 15, 20]
    df = spark.createDataFrame([(float(x),) for x in z], "z double").select("z", stats.erfc(F.col("z")).alias("e"))
    for r in df.collect():
        assert r.e == pytest.approx(math.erfc(r.z), rel=2e-7)


def chi_by_hand(table):
    t = np.array(table, float)
    if (t.sum(0) == 0).any() or (t.sum(1) == 0).any():
        return None
    e = np.outer(t.sum(1), t.sum(0)) / t.sum()
    gap = np.abs(t - e)
    if t.shape[1] == 2:
        gap = gap - np.minimum(0.5, gap)
    return float((gap**2 / e).sum())


def test_chi_square_tables(spark):
    rng = np.random.default_rng(5)
    wide = [tuple(int(x) for x in rng.integers(0, 40, 6)) for _ in range(60)] + [(0, 3, 4, 0, 5, 6), (0, 0, 0, 1, 2, 3), (5, 5, 5, 5, 5, 5)]
    df = spark.createDataFrame(wide, "case_0 int, case_1 int, case_2 int, control_0 int, control_1 int, control_2 int")
    for levels in ((0, 1, 2), (0, 1)):
        case, control = [f"case_{c}" for c in levels], [f"control_{c}" for c in levels]
        stat, p, status = stats.independence_test(case, control)
        swapped, _, _ = stats.independence_test(control, case)
        for r in df.withColumns({"stat": stat, "p": p, "status": status, "swapped": swapped}).collect():
            want = chi_by_hand([[r[c] for c in case], [r[c] for c in control]])
            if want is None:
                assert r.stat is None and r.p is None and r.status == "zero_expected"
                continue
            assert r.stat == pytest.approx(want, abs=1e-9)
            assert r.swapped == pytest.approx(want, abs=1e-9)
            tail = math.exp(-want / 2) if len(levels) == 3 else math.erfc(math.sqrt(want / 2))
            assert r.p == pytest.approx(tail, rel=3e-7)
    with pytest.raises(ValueError):
        stats.chi_square_p(F.lit(1.0), 3)


def test_locus_comparison(spark):
    data = [
        ("A*01:01:01", "A*02:01:01", "A*02:01:01", "A*01:01:01"),
        ("A*01:01:01", "A*02:01:01", "A*01:01:02", "A*02:01"),
        ("A*01:01:01", "A*02:01:01", "A*03:01:01", "A*02:01:01"),
        ("A*01:01", None, "A*01:01", "A*01:01"),
    ]
    df = spark.createDataFrame(data, "r1 string, r2 string, d1 string, d2 string")
    got = [(x.c.code, x.c.level) if x.c else None for x in df.select(hla.compare_locus("r1", "r2", "d1", "d2").alias("c")).collect()]
    assert got == [
        ("A*01:01:01_A*02:01:01", "identical"),
        ("A*01:01:01_A*02:01:01_A*01:01:02_A*02:01", "two_field"),
        ("MM_A*01:01:01_A*02:01:01_A*02:01:01_A*03:01:01", "mismatch"),
        None,
    ]
    two = spark.createDataFrame([(["B*08:01:01:02", "A*01"],)], "a array<string>").select(hla.two_field("a").alias("t")).first().t
    assert two == ["A*01", "B*08:01"]


def test_variant_label(spark):
    df = spark.createDataFrame([(7, 100, 101, -1, "rs1", "intron_variant")], "chrom int, start int, end int, strand int, id string, consequence string")
    assert rows(df.select(hla.variant_label().alias("l"))) == [("7:100-101:-1 ==> rs1 (intron_variant)",)]
