import hashlib

import pytest
from pyspark.sql import functions as F

from genopair.operators import annotate, cohort, hla, lookup
from tests.conftest import rows


@pytest.mark.parametrize("broadcast", [True, False])
def test_gene_overlaps_against_brute_force(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(lookup, "fits_broadcast", lambda *a, **k: False)
    genes = [(f"g{k}", k % 2 + 1, 95 * k, 95 * k + 10 + 60 * (k % 5)) for k in range(20)] + [("whole", 1, 0, 5000)]
    variants = [(f"v{k}", k % 2 + 1, 37 * k, 37 * k + (k % 4) * 55) for k in range(50)] + [("edge", 1, 100, 100)] * 2
    g = spark.createDataFrame(genes, "gene string, chrom int, start bigint, end bigint")
    v = spark.createDataFrame(variants, "snp string, chrom int, start bigint, end bigint")
    want = sorted((a[0], b[0]) for a in genes for b in variants if a[1] == b[1] and b[2] <= a[3] and b[3] >= a[2])
    assert rows(annotate.gene_variants(g, v, bin_width=100), "gene", "snp") == want
    only = annotate.gene_variants(g, v, "whole", bin_width=100)
    assert {r.gene for r in only.collect()} == {"whole"}


def test_variant_lookup_keeps_unknown_ids(spark):
    v = spark.createDataFrame([("rs1", 1), ("rs1", 2), ("rs2", 3)], "snp string, pos int")
    ids = spark.createDataFrame([("rs1",), ("rs9",)], "snp string")
    assert rows(annotate.lookup_variants(ids, v)) == [("rs1", 1), ("rs1", 2), ("rs9", None)]


def test_allele_sequences(spark):
    seqs = spark.createDataFrame(
        [("A*01", "AC|G*T", "x", "y"), ("A*02", "", "EX2", "EX3"), ("D*01", "", "E2", "*A*"), ("D*02", "", "E2", "**")],
        "allele string, unaligned string, exon2 string, exon3 string",
    )
    one = spark.createDataFrame([("A*01",), ("A*02",), ("A*99",)], "allele string")
    got = {r.allele: r.sequence for r in annotate.allele_sequence(one, seqs, "I").collect()}
    assert got["A*01"] == "ACGT" and got["A*99"] is None
    assert got["A*02"] == "ATGCGTATA" + "EX2" + annotate.CLASS_I_INTRON2 + "EX3" + "TTTACGG"
    two = spark.createDataFrame([("D*01",), ("D*02",)], "allele string")
    assert rows(annotate.allele_sequence(two, seqs, "II")) == [("D*01", "E2", "A"), ("D*02", "E2", None)]
    with pytest.raises(ValueError):
        annotate.allele_sequence(two, seqs, "III")


def test_running_total_is_a_running_total(spark):
    df = spark.range(3000).select(F.col("id"), (F.col("id") % 5).alias("v"))
    got = cohort.running_total(df, ["id"], ["id"], "v", "t").collect()
    order = sorted(got, key=lambda r: (hashlib.md5(str(r.id).encode()).hexdigest()[: cohort.DIGEST_DIGITS], r.id))
    total = 0
    for r in order:
        total += r.v
        assert r.t == total
    ranks = cohort.dense_rank_by_digest(df.select("id"), ["id"], "k")
    assert sorted(r.k for r in ranks.collect()) == list(range(3000))


def test_randomised_ids_are_unique_and_in_range(spark):
    fam = spark.range(20000).select(F.lit("f").alias("fid"), F.col("id").cast("string").alias("iid"), F.col("id").alias("i"))
    got = cohort.randomise_ids(fam, 7)
    assert got.columns == ["old_fid", "old_iid", "fid", "iid"]
    n = got.select(F.substring("iid", 5, 7).cast("int").alias("n"), F.length("iid").alias("w"))
    r = n.agg(F.count_distinct("n").alias("d"), F.min("n").alias("lo"), F.max("n").alias("hi"), F.max("w").alias("w")).first()
    assert r.d == 20000 and r.lo >= 1_000_000 and r.hi <= 9_999_999 and r.w == 11
    other = cohort.randomise_ids(fam, 8).filter("old_iid = '5'").first().iid
    assert other != got.filter("old_iid = '5'").first().iid
    with pytest.raises(Exception, match="seven-digit"):
        cohort.randomise_ids(spark.range(9_000_000, 9_000_001).selectExpr("'f' AS fid", "'x' AS iid", "id AS i")).collect()


def test_hla_case_table_and_melt(spark):
    names = ["case_id"] + [hla.case_column(s, locus, n) for locus in hla.CASE_LOCI for s in ("r", "d") for n in (1, 2)]
    values = ["c1"] + [f"{locus}*0{n}:01:0{1 if s == 'r' else 2}" for locus in hla.CASE_LOCI for s in ("r", "d") for n in (1, 2)]
    df = spark.createDataFrame([tuple(values)], names)
    r = hla.hla_case_table(df).first()
    assert r.hla_drb1 == "DRB1*01:01:01_DRB1*02:01:01_DRB1*01:01:02_DRB1*02:01:02" and r.level_drb1 == "two_field"
    melted = hla.melt_hla(df, ["case_id"], hla.CASE_LOCI, hla.case_column)
    assert melted.count() == 6
    assert {x.level for x in hla.compare_loci(melted, ["case_id"]).collect()} == {"two_field"}
