"""HLA tables of pairs and typing reports."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genopair.functions.hla import compare_locus, gl_string
from genopair.operators.annotate import allele_sequence
from genopair.operators.cohort import running_total

# The loci of the case table, of the typing table and of each report class.
CASE_LOCI = ("A", "B", "C", "DRB1", "DQB1", "DPB1")
TYPED_LOCI = ("A", "B", "C", "DRB1", "DRB3", "DRB4", "DRB5", "DQB1", "DQA1", "DPB1", "DPA1")
CLASS_LOCI = {"I": ("A", "B", "C"), "II": ("DRB1", "DQB1")}


def case_column(side: str, locus: str, n: int) -> str:
    """Column of the case table: ``r_a_typ1``."""
    return f"{side}_{locus.lower()}_typ{n}"


def typing_column(side: str, locus: str, n: int) -> str:
    """Column of the wide typing table: ``r_A_type1_gl``."""
    return f"{side}_{locus}_type{n}_gl"


def hla_case_table(cases: DataFrame, keep: list | None = None) -> DataFrame:
    """One row per case with the comparison code and level of every locus; a narrow step."""
    keep = keep or [c for c in ("case_id", "did", "rid") if c in cases.columns]
    compared = {
        locus: compare_locus(*[case_column(side, locus, n) for side in ("r", "d") for n in (1, 2)]) for locus in CASE_LOCI
    }
    columns = []
    for locus, c in compared.items():
        columns += [c["code"].alias(f"hla_{locus.lower()}"), c["level"].alias(f"level_{locus.lower()}")]
    return cases.select(*keep, *columns)


def melt_hla(wide: DataFrame, ids: list, loci: tuple = TYPED_LOCI, column=typing_column) -> DataFrame:
    """Wide typings to one row per case and locus: ``locus, r1, r2, d1, d2``."""
    rows = F.array(
        *[
            F.struct(
                F.lit(locus).alias("locus"),
                *[F.col(column(side, locus, n)).alias(f"{side}{n}") for side in ("r", "d") for n in (1, 2)],
            )
            for locus in loci
        ]
    )
    return wide.select(*ids, F.explode(rows).alias("l")).select(*ids, "l.*")


def compare_loci(melted: DataFrame, ids: list) -> DataFrame:
    """Comparison code and level per case and locus."""
    c = compare_locus("r1", "r2", "d1", "d2")
    return melted.select(*ids, "locus", c["code"].alias("code"), c["level"].alias("level"))


def typing_rows(melted: DataFrame, klass: str) -> DataFrame:
    """Two samples per case, one row per sample and locus of the class.

    ``ref1, ref2`` are running numbers over the whole report: one per homozygous locus (and
    ``ref2`` NULL), two per heterozygous one. Samples come in the order of their digest,
    loci in the order of the class.
    """
    loci = CLASS_LOCI[klass]
    order = F.array_position(F.array(*[F.lit(x) for x in loci]), F.col("locus")).cast("int")
    sides = F.array(
        *[
            F.struct(F.lit(role).alias("role"), F.col(sample).alias("sample_id"), F.col(a).alias("type1"), F.col(b).alias("type2"))
            for role, sample, a, b in (("D", "did", "d1", "d2"), ("R", "rid", "r1", "r2"))
        ]
    )
    rows = (
        melted.filter(F.col("locus").isin(*loci))
        .select("case_id", "locus", order.alias("locus_no"), F.explode(sides).alias("s"))
        .select("case_id", "s.role", "s.sample_id", "locus", "locus_no", "s.type1", "s.type2")
        .withColumn("blocks", F.when(F.col("type1") == F.col("type2"), 1).otherwise(2).cast("bigint"))
    )
    numbered = running_total(rows, ["case_id", "role"], ["case_id", "role", "locus_no"], "blocks", "_run")
    out = numbered.select(
        "case_id",
        "role",
        "sample_id",
        "locus",
        "locus_no",
        "type1",
        "type2",
        gl_string("type1", "type2").alias("glstring"),
        (F.col("_run") - F.col("blocks") + 1).alias("ref1"),
        F.when(F.col("blocks") == 2, F.col("_run")).alias("ref2"),
    )
    if klass == "II":
        prefix = F.concat("locus", F.lit("*"))
        out = out.withColumns(
            {f"haploid{n}": F.replace(F.col(f"type{n}"), prefix, F.lit("")) for n in (1, 2)}
        )
    return out


def sequence_blocks(rows: DataFrame, sequences: DataFrame, klass: str) -> DataFrame:
    """One row per consensus block of a typing report.

    Class I has one block per distinct allele; class II an exon 2 block and, when it has
    any sequence, an exon 3 block.
    """
    phases = F.filter(
        F.array(
            F.struct(F.lit(1).alias("phase_set"), F.col("ref1").alias("ref"), F.col("type1").alias("allele")),
            F.when(
                F.col("ref2").isNotNull(),
                F.struct(F.lit(2).alias("phase_set"), F.col("ref2").alias("ref"), F.col("type2").alias("allele")),
            ),
        ),
        lambda p: p.isNotNull(),
    )
    base = ["case_id", "role", "sample_id", "locus", "locus_no"]
    alleles = rows.select(*base, F.explode(phases).alias("p")).select(
        *base, "p.phase_set", F.concat(F.lit("ref"), F.col("p.ref").cast("string")).alias("ref_id"), "p.allele"
    )
    found = allele_sequence(alleles, sequences, klass)
    if klass == "I":
        return found.withColumns({"continuity": F.lit("true"), "description": F.lit(None).cast("string")})
    exons = F.filter(
        F.array(
            F.struct(F.lit("Exon2").alias("exon"), F.col("exon2").alias("sequence")),
            F.when(F.col("exon3").isNotNull(), F.struct(F.lit("Exon3").alias("exon"), F.col("exon3").alias("sequence"))),
        ),
        lambda e: e.isNotNull(),
    )
    fields = [*base, "phase_set", "ref_id", "allele"]
    return found.select(*fields, F.explode(exons).alias("e")).select(
        *fields,
        "e.sequence",
        F.lit("false").alias("continuity"),
        F.concat(F.lit("HLA-"), F.col("locus"), F.lit(" "), F.col("e.exon")).alias("description"),
    )


# Fixed values of a typing report.
REPORT = {
    "date": "2018-04-01",
    "gene_family": "HLA",
    "allele_db": "IMGT/HLA",
    "allele_version": "3.31.0",
    "center_code": "888",
    "collection_method": "Whole Blood",
    "test_source": "Histogenetics",
    "test_id": {"I": "PACBIOSequel", "II": "RSII"},
}


def typing_report(rows: DataFrame, blocks: DataFrame, klass: str) -> DataFrame:
    """Nested sample rows ready for the XML sink; leading ``_`` marks attributes.

    A sample has at most three loci and a locus at most four blocks, so the lists gathered
    here are short whatever the cohort size.
    """
    lit, r = F.lit, REPORT
    per_locus = blocks.groupBy("case_id", "role", "locus_no").agg(
        F.sort_array(
            F.collect_list(F.struct("phase_set", "description", "ref_id", "allele", "continuity", "sequence"))
        ).alias("blocks")
    )
    joined = rows.join(per_locus, ["case_id", "role", "locus_no"], "left")
    references = F.array_distinct(
        F.transform(
            "blocks",
            lambda b: F.struct(
                lit("public").alias("_availability"),
                lit(r["allele_db"]).alias("_name"),
                lit(r["allele_version"]).alias("_version"),
                F.struct(b["ref_id"].alias("_id"), b["allele"].alias("_name")).alias("reference-sequence"),
            ),
        )
    )
    consensus = F.transform(
        "blocks",
        lambda b: F.struct(
            b["continuity"].alias("_continuity"),
            b["description"].alias("_description"),
            b["phase_set"].cast("string").alias("_phase-set"),
            b["ref_id"].alias("_reference-sequence-id"),
            b["sequence"].alias("sequence"),
        ),
    )
    locus = F.concat(lit("HLA-"), F.col("locus"))
    assignment = [
        lit(r["allele_db"]).alias("_allele-db"),
        lit(r["allele_version"]).alias("_allele-version"),
        lit(r["date"]).alias("_date"),
    ]
    if klass == "II":
        assignment.append(
            F.array(
                *[
                    F.struct(locus.alias("_locus"), lit("DNA").alias("_method"), F.col(f"haploid{n}").alias("_type"))
                    for n in (1, 2)
                ]
            ).alias("haploid")
        )
    assignment.append(F.col("glstring"))
    typing = F.struct(
        F.col("locus_no"),
        F.struct(
            lit(r["date"]).alias("_date"),
            lit(r["gene_family"]).alias("_gene-family"),
            F.struct(*assignment).alias("allele-assignment"),
            F.struct(
                F.struct(
                    locus.alias("_locus"),
                    lit(r["test_id"][klass]).alias("_test-id"),
                    lit(r["test_source"]).alias("_test-id-source"),
                ).alias("sbt-ngs")
            ).alias("typing-method"),
            F.struct(
                lit(r["date"]).alias("_date"),
                references.alias("reference-database"),
                consensus.alias("consensus-sequence-block"),
            ).alias("consensus-sequence"),
        ).alias("typing"),
    )
    return (
        joined.groupBy("case_id", "role", "sample_id")
        .agg(F.sort_array(F.collect_list(typing)).alias("_typings"))
        .select(
            lit(r["center_code"]).alias("_center-code"),
            F.col("sample_id").alias("_id"),
            lit(r["collection_method"]).alias("collection-method"),
            F.transform("_typings", lambda t: t["typing"]).alias("typing"),
        )
    )
