import os

import pytest
from pyspark.sql import functions as F

from genopair.operators import pairs, quality
from genopair.plans import restart
from genopair.sources import buckets, hml
from tests.conftest import rows


class Killed(Exception):
    pass


def table(spark, folder, n=60):
    data = spark.range(n).select((F.col("id") % 4 + 1).cast("int").alias("chrom"), F.col("id").alias("pos"))
    data.write.mode("overwrite").parquet(f"{folder}/in")
    return spark.read.parquet(f"{folder}/in")


def test_a_killed_run_is_taken_up(spark, folder):
    data = table(spark, folder)
    units, calls = restart.by_chromosome(range(1, 6)), []

    def work(chroms, dies=False):
        calls.append(chroms)
        if dies and len(calls) == 3:
            # dies while it writes: some files are there, no commit
            return data.where(F.col("chrom").isin(*chroms)).withColumn("x", F.when(F.col("pos") < 30, F.lit(1)).otherwise(F.raise_error(F.lit("killed")).cast("int")))
        return data.where(F.col("chrom").isin(*chroms)).withColumn("x", F.lit(1))

    def new(settings=None, at="run"):
        return restart.Run(spark, f"{folder}/{at}", [f"{folder}/in"], settings or {"mode": "count"})

    with pytest.raises(ValueError, match="no unit"):
        new().results()
    with pytest.raises(Exception, match="killed"):
        new().execute(units, lambda c: work(c, True))
    assert new().open(units) == ["3", "4", "5"] and new().results().count() == 30
    calls.clear()
    assert new().execute(units, work) == ["3", "4", "5"] and calls == [[3], [4], [5]]
    assert new().execute(units, work) == []
    assert new(at="other").execute(units, work) == ["1", "2", "3", "4", "5"]
    assert rows(new().results()) == rows(new(at="other").results()) == rows(data.withColumn("x", F.lit(1)))
    # chromosome 5 has no rows, and is finished all the same
    assert rows(new().manifest(), "unit", "rows") == [("1", 15), ("2", 15), ("3", 15), ("4", 15), ("5", 0)]
    # other settings, other inputs: everything is open again
    assert len(new({"mode": "presence"}).open(units)) == 5
    table(spark, folder, 64)
    assert len(new().open(units)) == 5


def matrix(spark):
    return spark.range(40 * 30).select(
        (F.col("id") % 3 + 1).cast("int").alias("chrom"), (F.col("id") % 40).alias("pos"), F.lit("rs").alias("snp"), (F.col("id") % 40).alias("variant_idx"),
        F.col("id").alias("case_id"), F.when(F.col("id") % 7 > F.col("id") % 40 % 5, 1).alias("code"),
    )


def test_a_bucketed_matrix_is_filtered_without_a_shuffle(spark, folder):
    enc = matrix(spark)
    path = f"{folder}/m"
    buckets.write_bucketed(enc, path, buckets=4, sort_by=("pos", "snp"))
    want = rows(quality.filter_call_rate(enc, 10, 0.6))
    assert 0 < len(want) < enc.count()
    for _ in range(2):
        saved = buckets.read_bucketed(spark, path)
        found = quality.filter_call_rate(saved, 10, 0.6, bucketed=True)
        assert rows(found, *enc.columns) == want
        plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert "Exchange" not in plan and plan.count("FileScan") == 1
        # another session, or one that has forgotten the table, learns it from the folder
        spark.sql(f"DROP TABLE {buckets._name(path)}")
    assert len([f for f in os.listdir(path) if f.endswith(".parquet")]) <= 4


def test_an_observed_filter_counts_what_it_drops(spark):
    rates = quality.variant_call_rate(matrix(spark).withColumn("chrom", F.when(F.col("chrom") < 3, F.col("chrom")).when(F.col("pos") > 20, F.lit(5000))), 10)
    kept, seen = quality.observed_filter(rates, F.col("call_rate") >= 0.6, "t")
    found = rows(kept)
    assert found == rows(rates.where("call_rate >= 0.6"))
    by_chrom = quality.call_rate_report(rates.withColumn("chrom", F.when(F.col("chrom") < 27, F.col("chrom"))), 0.6)
    assert rows(quality.observed_report(spark, seen), "chrom", "removed", "total", "percent_removed") == rows(by_chrom, "chrom", "removed", "total", "percent_removed")
    assert pairs.VARIANT == ["chrom", "pos", "snp", "variant_idx"]


def test_a_document_counts_its_samples(spark, folder):
    import xml.etree.ElementTree as ET

    report = spark.range(50, numPartitions=5).select(F.col("id").alias("_id"), F.concat(F.lit("a & <b> "), F.col("id").cast("string")).alias("note"))
    hml.write_hml_document(report, f"{folder}/d", 'a "project"', {"GeneratedBy": "x & y"}, ("9", "8"), "7")
    assert hml.join_document(f"{folder}/d", f"{folder}/one.xml") == os.path.getsize(f"{folder}/one.xml")
    root = ET.parse(f"{folder}/one.xml").getroot()
    assert root.tag == "hml" and root.get("project-name") == 'a "project"'
    assert {p.get("name"): p.get("value") for p in root.iter("property")} == {"GeneratedBy": "x & y", "SampleCount": "50"}
    assert root.find("hmlid").attrib == {"root": "9", "extension": "8"} and root.find("reporting-center").get("reporting-center-id") == "7"
    assert sorted((int(s.get("id")), s.find("note").text) for s in root.iter("sample")) == [(k, f"a & <b> {k}") for k in range(50)]
    with pytest.raises(ValueError, match="holds files"):
        hml.write_hml_document(report, f"{folder}/d", "x")
    bad = report.withColumn("note", F.when(F.col("_id") < 40, F.col("note")).otherwise(F.raise_error(F.lit("stopped"))))
    with pytest.raises(Exception, match="stopped"):
        hml.write_hml_document(bad, f"{folder}/bad", "x")
    assert not os.path.exists(f"{folder}/bad") or os.listdir(f"{folder}/bad") == []
    hml.write_hml_document(report.limit(0), f"{folder}/none", "x")
    hml.join_document(f"{folder}/none", f"{folder}/none.xml")
    assert ET.parse(f"{folder}/none.xml").getroot().find("property").get("value") == "0"
