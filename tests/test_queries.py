"""Registered queries against DuckDB on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
import registered
from check_oracle import TABLES, compare

NAMES = [
    "plink_scan",
    "vcf_scan",
    "callset_scan",
    "case_csv_scan",
    "filtered_matrix_sink",
    "packed_matrix_sink",
    "callset_association_presence",
    "contingency_at_call_rate",
    "contingency_repeated_positions",
    "vcf_callset_association",
    "mismatch_type_frequency_packed",
    "mismatch_type_frequency",
    "logistic_additive",
    "mismatch_logistic_count_directed",
    "mismatch_logistic_long",
    "recipient_disease_logistic",
    "typing_report_class_two",
    "consensus_blocks",
    "gene_variants",
    "vcf_sample_orders",
    "contigs_apart",
    "strong_associations",
    "vcf_block_gzip",
    "vcf_block_region",
    "contig_dictionary",
    "contingency_repeated_positions_packed",
    "contingency_repeated_rows",
    "matrix_by_case_packed",
    "call_rate_filter_bucketed",
    "call_rate_report_observed",
    "association_restarted",
    "broken_rows",
    "typing_report_document",
]


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, sf_dir, name):
    state, _, _, _, note = compare(spark, con, name, sf_dir)
    assert state == "ok", note


def test_every_query_has_sql():
    assert set(registered.ORACLE) == set(registered.QUERIES) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "neg_log_p" in df.columns
