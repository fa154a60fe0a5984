import pytest
from pyspark.sql import functions as F

from genopair.operators import lookup, pairs, quality
from tests.conftest import rows

CALLS = "chrom int, pos bigint, snp string, variant_idx bigint, sample_id string, dosage tinyint"


@pytest.fixture()
def calls(spark):
    data = []
    for v in range(4):
        for k, s in enumerate(("d1", "r1", "d2", "r2", "r3")):
            data.append((1, 100 + v, f"rs{v}", v, s, None if v == 3 else (v + k) % 3))
    return spark.createDataFrame(data, CALLS)


@pytest.fixture()
def pair_table(spark):
    # d1 gives to two recipients; the donor of case c4 has no calls
    return spark.createDataFrame([("c1", "d1", "r1"), ("c2", "d2", "r2"), ("c3", "d1", "r3"), ("c4", "absent", "r3")], "case_id string, did string, rid string")


def test_pairing_by_role(calls, pair_table):
    got = {(r.variant_idx, r.case_id): (r.d_dosage, r.r_dosage) for r in pairs.pair_calls(calls, pair_table).collect()}
    assert len(got) == 16
    assert got[(0, "c1")] == (0, 1) and got[(0, "c3")] == (0, 1) and got[(1, "c2")] == (0, 1)
    assert got[(0, "c4")] == (None, 1)
    assert got[(3, "c1")] == (None, None)


def test_pairing_without_broadcast_gives_the_same(calls, pair_table, monkeypatch):
    want = rows(pairs.pair_calls(calls, pair_table))
    monkeypatch.setattr(lookup, "fits_broadcast", lambda *a, **k: False)
    far = pairs.pair_calls(calls, pair_table)
    assert rows(far) == want


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("salts", [1, 16])
def test_lookup_join_paths_agree_on_a_hot_key(spark, monkeypatch, how, salts):
    # one key holds most rows, some keys are unknown to the lookup table
    big = spark.range(3000).select(F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id") % 11).alias("k"), F.col("id").alias("x"))
    small = spark.createDataFrame([(7, "a"), (3, "b"), (3, "c"), (99, "z")], "k bigint, name string")
    want = rows(big.join(small, "k", how))
    assert rows(lookup.lookup_join(big, small, ["k"], how, salts)) == want
    monkeypatch.setattr(lookup, "fits_broadcast", lambda *a, **k: False)
    assert rows(lookup.lookup_join(big, small, ["k"], how, salts)) == want


def test_measured_size_bounds_broadcast(spark):
    df = spark.range(1000).select("id", F.lit("x" * 100).alias("t"), F.array(F.lit(1), F.lit(2)).alias("a"))
    n, size = lookup.measured_size(df)
    assert n == 1000 and size > 100 * 1000
    assert lookup.fits_broadcast(df) and not lookup.fits_broadcast(df, max_rows=999)
    assert not lookup.fits_broadcast(df, max_bytes=100_000)
    assert lookup.measured_size(df.limit(0)) == (0, 0)


def test_recipients_and_modes(calls, pair_table):
    got = {(r.variant_idx, r.case_id): r.code for r in pairs.recipient_calls(calls, pair_table).collect()}
    assert got[(0, "c1")] == 1 and got[(0, "c3")] == got[(0, "c4")] == 1
    modes = pairs.encode_modes(pairs.pair_calls(calls, pair_table), ("count", "count_directed"))
    one = {r.mode: r.code for r in modes.filter("variant_idx = 2 AND case_id = 'c1'").collect()}
    assert one == {"count": 2, "count_directed": 2}


def test_complete_pairs(spark):
    data = [(1, "D", "s1", "a"), (1, "R", "s2", "a"), (2, "D", "s3", "n"), (3, "D", "s4", "n"), (3, "D", "s5", "n"),
            (4, "D", "s6", "x"), (4, "R", "s7", "x"), (4, "R", "s8", "x")]
    s = spark.createDataFrame(data, "group_id int, subject_type string, seq_id string, group string")
    assert rows(pairs.complete_pairs(s)) == [(1, "s1", "s2", "a")]
    assert rows(pairs.samples_in_complete_pairs(s), "seq_id") == [("s1",), ("s2",), ("s4",), ("s5",)]
    assert rows(pairs.case_control(s)) == [(1, "case"), (2, "control"), (3, "control")]
    assert rows(pairs.group_sizes(s)) == [(1, 2), (2, 1), (3, 2), (4, 3)]


def test_outcomes_are_single_rows(spark, calls, pair_table):
    enc = pairs.encode_pairs(pairs.pair_calls(calls, pair_table), "count")
    o = spark.createDataFrame([("c1", 1), ("c1", 1), ("c2", None)], "case_id string, y int")
    got = pairs.with_outcome(enc, o, ["y"])
    assert got.count() == enc.count()
    assert {r.case_id: r.y for r in got.collect()} == {"c1": 1, "c2": None, "c3": None, "c4": None}


def test_pair_check(spark):
    p = spark.createDataFrame([("c1", "a", "b"), ("c2", "a", "c"), ("c3", "d", "d")], "case_id string, did string, rid string")
    roster = spark.createDataFrame([("a",), ("b",), ("b",), ("z",), ("d",), ("d",)], "sample_id string")
    assert rows(pairs.check_pairs(p, roster), "sample_id", "finding", "n") == [
        ("a", "extra_in_pairs", 1),
        ("b", "extra_in_roster", 1),
        ("c", "extra_in_pairs", 1),
        ("c", "not_in_roster", 1),
        ("d", "self_pair", 1),
        ("z", "extra_in_roster", 1),
        ("z", "not_in_pairs", 1),
    ]


def test_call_rate_counts_absent_rows_as_missing(spark):
    data = [(1, 10, "a", 0, f"c{k}", 1) for k in range(19)] + [(1, 11, "b", 1, f"c{k}", 0) for k in range(18)] + [(1, 12, "c", 2, "c0", None)]
    enc = spark.createDataFrame(data, "chrom int, pos bigint, snp string, variant_idx bigint, case_id string, code int")
    rates = {r.variant_idx: r.call_rate for r in quality.variant_call_rate(enc, 20).collect()}
    assert rates == {0: pytest.approx(0.95), 1: pytest.approx(0.9), 2: 0.0}
    assert quality.filter_call_rate(enc, 20).select("variant_idx").distinct().collect()[0][0] == 0
    report = quality.call_rate_report(quality.variant_call_rate(enc, 20)).first()
    assert (report.removed, report.total, report.percent_removed) == (2, 3, pytest.approx(200 / 3))


def test_duplicate_ids_lose_every_copy(spark):
    # "." stands for a nameless variant and fills most of the table
    data = [(1, "." if k % 3 else f"rs{k}", k) for k in range(60)] + [(2, "rs0", 60), (2, "rs61", 61)]
    v = spark.createDataFrame(data, "chrom int, snp string, variant_idx int")
    assert quality.drop_duplicate_snps(v).count() == 22
    assert quality.drop_duplicate_snps(v, ()).count() == 20
    assert rows(quality.duplicate_snps(v, ())) == [(".", 40), ("rs0", 2)]
    assert quality.drop_duplicate_snps(v).columns == v.columns
    assert quality.keep_variants(v, quality.drop_duplicate_snps(v, ())).count() == 20


def test_regions_and_allele_numbers(spark):
    v = spark.createDataFrame([(22, 20_000_000, 800), (22, 20_100_000, 799), (22, 20_100_001, 900), (21, 20_050_000, None)], "chrom int, pos bigint, an int")
    assert rows(quality.filter_region(v, 22, 20_000_000, 20_100_000), "pos") == [(20_000_000,), (20_100_000,)]
    assert rows(quality.filter_allele_number(v), "pos") == [(20_000_000,), (20_100_001,)]
    assert rows(quality.allele_number_report(v)) == [(21, 0, 1), (22, 2, 1)]
    assert quality.filter_chroms(v, 22, 22).count() == 3


def test_first_row_per_key(spark):
    df = spark.createDataFrame([("a", 3, "x"), ("a", 1, "y"), ("b", 2, None), ("a", 2, "z")], "k string, i int, v string")
    assert rows(lookup.first_by(df, ["k"], "i")) == [("a", 1, "y"), ("b", 2, None)]


def test_row_index_over_several_partitions(spark, folder):
    path = f"{folder}/lines"
    spark.range(0, 500, 1, 1).selectExpr("CAST(id AS STRING) AS value").write.text(path)
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        df = spark.read.text(path)
        assert df.rdd.getNumPartitions() > 3
        assert all(int(r.value) == r.i for r in lookup.with_row_index(df).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert lookup.with_row_index(spark.read.text(path).filter("value < '2'")).agg(F.max("i"), F.count("i")).first() == (111, 112)
