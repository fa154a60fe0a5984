"""Every query with its DuckDB text. Keys name the operator they exercise."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

import fixture_views as fx
import oracle_text as ot
from genopair.functions import encode, hla as hla_f, ids, stats
from genopair.operators import annotate, association, cohort, contigs, hla, lookup, packed, pairs, quality, tables
from genopair.plans import callset, dosage, restart
from genopair.session import stored
from genopair.sources import buckets, hml, plink, sinks, tables as sources, vcf

QUERIES, ORACLE = {}, {}


def query(text: str | None = None):
    def register(f):
        def run(spark, sf_dir):
            return settled(f(spark, sf_dir))

        QUERIES[f.__name__] = run
        if text is not None:
            ORACLE[f.__name__] = text
        return f

    return register


def settled(df: DataFrame) -> DataFrame:
    """Small integers as int and doubles at six decimals, as in the SQL."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ByteType, T.ShortType)):
            c = c.cast("int")
        elif isinstance(f.dataType, T.DoubleType):
            c = F.round(c, 6) + F.lit(0.0)
        out.append(c.alias(f.name))
    return df.select(*out)


# --- common inputs --------------------------------------------------------------------------


def paired_dosages(spark, sf_dir):
    return pairs.pair_calls(fx.calls(spark, sf_dir), fx.pairs(spark, sf_dir))


def paired_alleles(spark, sf_dir):
    return pairs.pair_calls(fx.calls(spark, sf_dir), fx.pairs(spark, sf_dir), callset.ALLELES)


def n_pairs(spark, sf_dir):
    return fx.pairs(spark, sf_dir).count()


def outcome_status(spark, sf_dir):
    return fx.outcomes(spark, sf_dir).select("case_id", F.when(F.col("agvhi24") == 1, "case").otherwise("control").alias("status"))


CALLS, PAIRS, OUTCOMES, SAMPLES, VARIANTS = fx.CALLS_SQL, fx.PAIRS_SQL, fx.OUTCOMES_SQL, fx.SAMPLES_SQL, fx.VARIANTS_SQL
PAIRED = ot.paired("paired", "calls", "pairs")
PAIRED_ALLELES = ot.paired("paired", "calls", "pairs", ("a1", "a2"))
STATUS = "status AS (SELECT case_id, CASE WHEN agvhi24 = 1 THEN 'case' ELSE 'control' END AS status FROM outcomes)"
KEYS = "chrom, pos, snp, variant_idx"
N_PAIRS = "(SELECT count(*) FROM pairs)"


def encoded_sql(mode, name="encoded", source="paired"):
    return f"{name} AS (SELECT {KEYS}, case_id, {ot.DOSAGE[mode]} AS code FROM {source})"


def allele_sql(mode, name="encoded", source="paired"):
    return f"{name} AS (SELECT {KEYS}, case_id, {ot.ALLELE[mode]} AS code FROM {source})"


RATES = f"""
rates AS (
  SELECT {KEYS}, count(code) AS n_called, 1.0::DOUBLE - ({N_PAIRS} - count(code)) / CAST({N_PAIRS} AS DOUBLE) AS call_rate
  FROM encoded GROUP BY ALL)"""

# samples in complete pairs, as pairs
COMPLETE = """
complete AS (
  SELECT group_id AS case_id, max(CASE WHEN subject_type = 'D' THEN seq_id END) AS did,
         max(CASE WHEN subject_type = 'R' THEN seq_id END) AS rid, min("group") AS "group"
  FROM samples GROUP BY group_id HAVING count(*) = 2)"""
COMPLETE_STATUS = "complete_status AS (SELECT case_id, CASE \"group\" WHEN 'a' THEN 'case' ELSE 'control' END AS status FROM complete)"
PASSING = "passing AS (SELECT c.* FROM calls c JOIN variants v USING (variant_idx) WHERE v.an >= 800)"
COMPLETE_PAIRED = ot.paired("paired", "passing", "complete", ("a1", "a2"))

# --- sources ----------------------------------------------------------------------------------


def _plink_folder(spark, sf_dir):
    calls = fx.calls(spark, sf_dir)
    ids_ = calls.select("sample_id").distinct()
    return fx.write_trios(spark, fx.pack_calls(calls), ids_, fx.new_folder(spark, "plink"))


@query(ot.sql(CALLS, select="SELECT chrom, pos, snp, variant_idx, CAST(sample_id AS VARCHAR) AS sample_id, CAST(dosage AS INTEGER) AS dosage FROM calls"))
def plink_scan(spark, sf_dir):
    """File trios written from the calls, read back as packed rows and laid out long."""
    data = plink.read_plink(spark, [*_plink_folder(spark, sf_dir), fx.new_folder(spark, "absent") + "/chr99"])
    return packed.unpack(data.packed, data.samples, keys=pairs.VARIANT)


@query(ot.sql(CALLS, select="SELECT DISTINCT chrom, pos, snp, variant_idx FROM calls WHERE chrom BETWEEN 3 AND 9"))
def plink_variants_by_chromosome(spark, sf_dir):
    """The variant table alone, restricted to a chromosome range before any genotype is read."""
    data = plink.read_plink(spark, _plink_folder(spark, sf_dir), chroms=list(range(3, 10)))
    return data.variants.select(*pairs.VARIANT)


@query(ot.sql(CALLS, select="SELECT chrom, pos, snp, variant_idx, CAST(sample_id AS VARCHAR) AS sample_id, CAST(dosage AS INTEGER) AS dosage FROM calls"))
def plink_to_parquet(spark, sf_dir):
    """File trios converted to a columnar call set by chromosome, then read."""
    out = fx.new_folder(spark, "converted")
    sinks.plink_to_parquet(spark, _plink_folder(spark, sf_dir), out)
    saved = sources.read_packed(spark, out)
    return packed.unpack(saved.packed, saved.samples, keys=pairs.VARIANT)


@query(
    ot.sql(
        CALLS, VARIANTS,
        select="""SELECT c.chrom, c.pos, c.snp, CAST(c.sample_id AS VARCHAR) AS sample_id, CAST(c.a1 AS INTEGER) AS a1,
        CAST(c.a2 AS INTEGER) AS a2, v.an, 2 AS numalt FROM calls c JOIN variants v USING (variant_idx)""",
    )
)
def vcf_scan(spark, sf_dir):
    """VCF records written from the calls, parsed to packed alleles and laid out long."""
    calls = fx.calls(spark, sf_dir)
    paths = fx.write_vcf(spark, fx.pack_calls(calls, ("a1", "a2")), calls.select("sample_id").distinct(), fx.new_folder(spark, "vcf"))
    data = vcf.read_vcf(spark, paths)
    keys = ["chrom", "pos", "snp", "an", "numalt"]
    return packed.unpack(data.packed, data.samples, ("a1", "a2"), keys)


VCF_CELLS = "c.chrom, c.pos, c.snp, CAST(c.sample_id AS VARCHAR) AS sample_id, CAST(c.a1 AS INTEGER) AS a1, CAST(c.a2 AS INTEGER) AS a2"


@query(ot.sql(CALLS, select=f"SELECT {VCF_CELLS}, c.variant_idx FROM calls c"))
def vcf_sample_orders(spark, sf_dir):
    """Two files that list the same samples in opposite orders; calls follow the names."""
    calls = fx.calls(spark, sf_dir)
    rows, ids, folder = fx.pack_calls(calls, ("a1", "a2")), calls.select("sample_id").distinct(), fx.new_folder(spark, "vcf")
    first = fx.write_vcf(spark, rows.filter("variant_idx < 30"), ids, f"{folder}/a")
    other = fx.write_vcf(spark, rows.filter("variant_idx >= 30"), ids, f"{folder}/b", backwards=True)
    # the records of the second file lie beside its own header
    spark.read.text(other[0]).write.text(f"{folder}/whole")
    spark.read.text(other[1]).write.mode("append").text(f"{folder}/whole")
    data = vcf.read_vcf(spark, [*first, f"{folder}/whole"])
    index = ((F.col("pos") - 16000000) / 7919).cast("bigint")
    numbers = data.packed.agg(F.min("variant_idx"), F.max("variant_idx"), F.count_distinct("variant_idx")).first()
    if tuple(numbers) != (0, 63, 64):
        raise ValueError(f"record numbers have gaps: {numbers}")
    return packed.unpack(data.packed, data.samples, ("a1", "a2"), ["chrom", "pos", "snp"]).withColumn("variant_idx", index)


@query(ot.sql(CALLS, select=f"SELECT {VCF_CELLS} FROM calls c WHERE c.chrom = 5 AND c.pos BETWEEN 16031676 AND 16300000"))
def vcf_region(spark, sf_dir):
    """A region of a VCF file, chosen before the sample fields are parsed."""
    calls = fx.calls(spark, sf_dir)
    paths = fx.write_vcf(spark, fx.pack_calls(calls, ("a1", "a2")), calls.select("sample_id").distinct(), fx.new_folder(spark, "vcf"))
    data = vcf.read_vcf(spark, paths, region=(5, 16031676, 16300000))
    return packed.unpack(data.packed, data.samples, ("a1", "a2"), ["chrom", "pos", "snp"])


CONTIGS = ("GL000192.1", "GL000193.1")


@query(
    ot.sql(
        CALLS, PAIRS, OUTCOMES, STATUS,
        f"""renamed AS (SELECT CASE variant_idx % 2 WHEN 0 THEN '{CONTIGS[0]}' ELSE '{CONTIGS[1]}' END AS chrom, 100 + variant_idx // 2 AS pos,
        snp, variant_idx, sample_id, a1, a2 FROM calls)""",
        ot.paired("paired", "renamed", "pairs", ("a1", "a2")), allele_sql("count"), ot.contingency("cont", "encoded", "status", (0, 1, 2)),
        select="SELECT chrom AS contig, pos, case_0, case_1, case_2, control_0, control_1, control_2 FROM cont",
    )
)
def contigs_apart(spark, sf_dir):
    """Contigs without a number, two at every position, from VCF to packed contingency tables."""
    calls = fx.calls(spark, sf_dir)
    v = F.col("variant_idx")
    rows = fx.pack_calls(calls, ("a1", "a2")).withColumn("pos", F.lit(100) + F.floor(v / 2))
    name = F.when(v % 2 == 0, CONTIGS[0]).otherwise(CONTIGS[1])
    paths = fx.write_vcf(spark, rows, calls.select("sample_id").distinct(), fx.new_folder(spark, "vcf"), contig=name)
    data = vcf.read_vcf(spark, paths)
    pr = fx.pairs(spark, sf_dir).select("case_id", *[F.col(c).cast("string").alias(c) for c in ("did", "rid")])
    table = tables.packed_contingency(data.packed, data.samples, pr, outcome_status(spark, sf_dir), "count")
    return contigs.with_contig(table, data.contigs).drop("chrom")


def _block_vcf(spark, sf_dir, contig=None):
    """The calls as a folder of block-gzip VCF files with indexes; small blocks, so that there are many."""
    calls = fx.calls(spark, sf_dir)
    name = F.concat(F.lit("chr"), F.col("chrom").cast("string")) if contig is None else contig
    rows = fx.pack_calls(calls, ("a1", "a2")).withColumn("contig", name)
    samples = calls.select("sample_id").distinct().withColumn("sample_idx", F.col("sample_id"))
    path = fx.new_folder(spark, "vcf-blocks")
    sinks.write_vcf(rows, samples, path, parts=3, block_bytes=1 << 12)
    return path


VCF_RANGE = 1 << 12  # compressed bytes of a read task


@query(ot.sql(CALLS, select=f"SELECT {VCF_CELLS}, c.variant_idx FROM calls c"))
def vcf_block_gzip(spark, sf_dir):
    """Block-gzip VCF, written and read in parallel: ranges of blocks, lines put together across them."""
    data = vcf.read_vcf(spark, _block_vcf(spark, sf_dir), range_bytes=VCF_RANGE)
    numbers = data.packed.agg(F.min("variant_idx"), F.max("variant_idx"), F.count_distinct("variant_idx")).first()
    if tuple(numbers) != (0, 63, 64):
        raise ValueError(f"record numbers have gaps: {numbers}")
    index = ((F.col("pos") - 16000000) / 7919).cast("bigint")
    return packed.unpack(data.packed, data.samples, ("a1", "a2"), ["chrom", "pos", "snp"]).withColumn("variant_idx", index)


@query(ot.sql(CALLS, select=f"SELECT {VCF_CELLS} FROM calls c WHERE c.chrom = 5 AND c.pos BETWEEN 16031676 AND 16300000"))
def vcf_block_region(spark, sf_dir):
    """A region through the files' indexes: only the blocks that hold it are read."""
    data = vcf.read_vcf(spark, _block_vcf(spark, sf_dir), region=(5, 16031676, 16300000), range_bytes=VCF_RANGE)
    return packed.unpack(data.packed, data.samples, ("a1", "a2"), ["chrom", "pos", "snp"])


# Names that differ in case alone, and names with one checksum.
SCAFFOLDS = ("scaffold_x", "Scaffold_X", "scvd54tb", "scod7vcb")
SCAFFOLD_SQL = f"['{SCAFFOLDS[0]}', '{SCAFFOLDS[1]}', '{SCAFFOLDS[2]}', '{SCAFFOLDS[3]}'][variant_idx % 4 + 1]"


@query(
    ot.sql(
        CALLS, PAIRS, OUTCOMES, STATUS,
        f"renamed AS (SELECT {SCAFFOLD_SQL} AS chrom, 100 + variant_idx // 4 AS pos, snp, variant_idx, sample_id, a1, a2 FROM calls)",
        ot.paired("paired", "renamed", "pairs", ("a1", "a2")), allele_sql("count"), ot.contingency("cont", "encoded", "status", (0, 1, 2)),
        select="SELECT chrom AS contig, pos, case_0, case_1, case_2, control_0, control_1, control_2 FROM cont",
    )
)
def contig_dictionary(spark, sf_dir):
    """Scaffolds at the same positions, from two files, the second of which brings new names to the saved call set."""
    calls = fx.calls(spark, sf_dir)
    v = F.col("variant_idx")
    rows = fx.pack_calls(calls, ("a1", "a2")).withColumn("pos", F.lit(100) + F.floor(v / 4))
    name = F.element_at(F.array(*map(F.lit, SCAFFOLDS)), (v % 4).cast("int") + 1)
    names, folder = calls.select("sample_id").distinct(), fx.new_folder(spark, "scaffolds")
    first = fx.write_vcf(spark, rows.where(v % 4 < 2), names, f"{folder}/a", contig=name)
    more = fx.write_vcf(spark, rows.where(v % 4 >= 2), names, f"{folder}/b", contig=name)
    sinks.vcf_to_parquet(spark, first, f"{folder}/callset")
    added = vcf.read_vcf(spark, more, contigs=sources.read_packed(spark, f"{folder}/callset").contigs)
    sinks.add_packed_calls(added.packed, added.samples, added.contigs, f"{folder}/callset")
    saved = sources.read_packed(spark, f"{folder}/callset")
    pr = fx.pairs(spark, sf_dir).select("case_id", *[F.col(c).cast("string").alias(c) for c in ("did", "rid")])
    table = tables.packed_contingency(saved.packed, saved.samples, pr, outcome_status(spark, sf_dir), "count")
    return contigs.with_contig(table, saved.contigs).drop("chrom")


@query(
    ot.sql(
        CALLS,
        VARIANTS,
        select="""SELECT c.chrom, c.pos, c.snp, v.an, v.numalt, count(c.a1) AS n_called, count(DISTINCT c.sample_id) AS n_samples
        FROM calls c JOIN variants v USING (variant_idx) WHERE v.an >= 800 AND c.chrom BETWEEN 1 AND 15 GROUP BY ALL""",
    )
)
def callset_scan(spark, sf_dir):
    """A Parquet call set by chromosome; chromosome range and allele number reach the scan."""
    path = fx.new_folder(spark, "callset")
    calls = fx.calls(spark, sf_dir)
    sinks.write_table(fx.annotated_variants(calls), f"{path}/variants")
    sinks.write_table(calls.repartition("chrom"), f"{path}/calls")
    fx.samples(spark, sf_dir).write.parquet(f"{path}/samples")
    cs = sources.read_callset(spark, path, chroms=(1, 15), min_an=quality.MIN_ALLELE_NUMBER)
    wanted = cs.variants.select("chrom", "variant_idx", "an", "numalt")
    rows = lookup.lookup_join(cs.calls, wanted, ["chrom", "variant_idx"], salts=1)
    return rows.groupBy("chrom", "pos", "snp", "an", "numalt").agg(
        F.count("a1").alias("n_called"), F.count_distinct("sample_id").alias("n_samples")
    )


@query(ot.sql(OUTCOMES, select="SELECT CAST(case_id AS VARCHAR) AS case_id, agvhi24, agvhi34, disease FROM outcomes"))
def outcome_csv_scan(spark, sf_dir):
    path = fx.new_folder(spark, "outcomes")
    fx.outcomes(spark, sf_dir).select("agvhi24", "agvhi34", "case_id", "disease").write.option("header", True).csv(path)
    return sources.read_outcomes(spark, path).drop("file_order")


BROKEN = """
listed AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 17 = 0 THEN 'short' WHEN o_orderkey % 19 = 0 THEN 'long'
  WHEN o_orderkey % 23 = 0 THEN 'unparsable' ELSE 'row' END AS reason FROM orders)"""


@query(ot.sql(BROKEN, select="SELECT reason, count(*) AS n, CAST(sum(k) AS BIGINT) AS keys FROM listed GROUP BY reason"))
def broken_rows(spark, sf_dir):
    """A CSV with short, long and unparsable rows: what is left out stands in quarantine, with its place in the file."""
    k = F.col("o_orderkey")
    good = F.concat_ws(",", k.cast("string"), (k * 2).cast("string"), F.lit("x"))
    line = F.when(k % 17 == 0, F.concat_ws(",", k.cast("string"), F.lit("1"))).when(k % 19 == 0, F.concat(good, F.lit(",more")))
    line = line.when(k % 23 == 0, F.concat_ws(",", k.cast("string"), F.lit("no number"), F.lit("x"))).otherwise(good)
    path = fx.new_folder(spark, "broken")
    fx.table(spark, sf_dir, "orders").repartition(4, "o_orderkey").select(line.alias("value")).write.text(path)
    read = sources.read_checked(spark, path, "k bigint, twice int, name string", header=False, most_broken=0.5, quarantine=fx.new_folder(spark, "quarantine"))
    if read.broken.select("file", "block", "line").distinct().count() != read.broken.count():
        raise ValueError("two broken rows at one place")
    broken = read.broken.select("reason", F.substring_index("text", ",", 1).cast("bigint").alias("k"))
    both = broken.unionByName(read.rows.where("twice = 2 * k AND name = 'x'").select(F.lit("row").alias("reason"), "k"))
    return both.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("keys"))


@query(ot.sql(SAMPLES, select='SELECT CAST(group_id AS VARCHAR) AS group_id, "group", subject_type, CAST(seq_id AS VARCHAR) AS seq_id FROM samples'))
def sample_csv_scan(spark, sf_dir):
    path = fx.new_folder(spark, "samples")
    named = {"group_id": "GroupID", "group": "Group", "subject_type": "subjectType", "seq_id": "SeqID"}
    fx.samples(spark, sf_dir).select(*[F.col(c).alias(n) for c, n in named.items()]).write.option("header", True).csv(path)
    return sources.read_samples(spark, path)


def _case_rows(spark, sf_dir):
    """Orders as case records: the customer is the case and comes up in many rows."""
    o = F.col("o_orderkey")
    return fx.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("bmt_case_num"), (o * 7 + 11).alias("nmdp_rid"), (o * 13 + 5).alias("nmdp_did"), o.alias("line")
    )


def _format_sql(expr, role):
    pad, head = (9, 4) if role == "donor" else (7, 3)
    text = f"CAST({expr} AS VARCHAR)"
    p = f"CASE WHEN length({text}) < {pad} THEN lpad({text}, {pad}, '0') ELSE {text} END"
    return f"substr({p}, 1, {head}) || '-' || substr({p}, {head + 1}, {head}) || '-' || substr({p}, {2 * head + 1})"


@query(
    f"""SELECT CAST(o_custkey AS VARCHAR) AS case_id, {_format_sql('o_orderkey * 13 + 5', 'donor')} AS did,
        {_format_sql('o_orderkey * 7 + 11', 'recipient')} AS rid
    FROM (SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey)"""
)
def case_csv_scan(spark, sf_dir):
    """First row per case in file order, ids formatted. All rows of a case are in one file."""
    path = fx.new_folder(spark, "cases")
    rows = _case_rows(spark, sf_dir).repartitionByRange("bmt_case_num").sortWithinPartitions("bmt_case_num", "line")
    rows.drop("line").write.option("header", True).csv(path)
    return sources.read_cases(spark, path)


@query(
    """SELECT o_custkey, min(o_orderkey) AS o_orderkey, arg_min(o_orderstatus, o_orderkey) AS o_orderstatus
    FROM orders GROUP BY o_custkey"""
)
def first_row_per_key(spark, sf_dir):
    orders = fx.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return lookup.first_by(orders.withColumn("line", F.col("o_orderkey")), ["o_custkey"], "line").drop("line")


def _hla_columns():
    return {
        locus: f"""CASE WHEN least(r1, r2) = least(d1, d2) AND greatest(r1, r2) = greatest(d1, d2) THEN 'identical'
            WHEN least(t(r1), t(r2)) = least(t(d1), t(d2)) AND greatest(t(r1), t(r2)) = greatest(t(d1), t(d2)) THEN 'two_field'
            ELSE 'mismatch' END"""
        for locus in fx.CASE_LOCI
    }


def _two(a):
    return f"array_to_string(string_split({a}, ':')[1:2], ':')"


HLA_COMPARED = f"""
compared AS (
  SELECT case_id, did, rid, locus, level,
         CASE level WHEN 'identical' THEN least(r1, r2) || '_' || greatest(r1, r2)
              WHEN 'two_field' THEN least(r1, r2) || '_' || greatest(r1, r2) || '_' || least(d1, d2) || '_' || greatest(d1, d2)
              ELSE 'MM_' || least(r1, r2) || '_' || greatest(r1, r2) || '_' || least(d1, d2) || '_' || greatest(d1, d2) END AS code
  FROM (SELECT *, CASE WHEN list_sort([r1, r2]) = list_sort([d1, d2]) THEN 'identical'
                       WHEN list_sort([{_two('r1')}, {_two('r2')}]) = list_sort([{_two('d1')}, {_two('d2')}]) THEN 'two_field'
                       ELSE 'mismatch' END AS level FROM typed))"""

HLA_WIDE_SELECT = ", ".join(
    f"max(CASE WHEN locus = '{x}' THEN code END) AS hla_{x.lower()}, max(CASE WHEN locus = '{x}' THEN level END) AS level_{x.lower()}"
    for x in fx.CASE_LOCI
)


@query(
    ot.sql(
        fx.typed_sql(fx.CASE_LOCI),
        HLA_COMPARED,
        select=f"""SELECT CAST(case_id AS VARCHAR) AS case_id, {_format_sql('did', 'donor')} AS did, {_format_sql('rid', 'recipient')} AS rid,
        '2018-0' || CAST(case_id % 9 + 1 AS VARCHAR) AS transplant_date, {HLA_WIDE_SELECT} FROM compared GROUP BY case_id, did, rid""",
    )
)
def hla_csv_scan(spark, sf_dir):
    """HLA case file to the comparison table."""
    path = fx.new_folder(spark, "hla")
    wide = fx.typed_cases(spark, sf_dir, hla.CASE_LOCI, hla.case_column).withColumnsRenamed(
        {"case_id": "bmt_case_num", "rid": "nmdp_rid", "did": "nmdp_did"}
    )
    races = {c: F.lit("X") for c in ("ridbroadrace", "ridrolluprace", "didbroadrace", "didrolluprace")}
    date = F.concat(F.lit("2018-0"), (F.col("bmt_case_num") % 9 + 1).cast("string"))
    wide.withColumns({"transplant_date": date, **races}).write.option("header", True).csv(path)
    return hla.hla_case_table(sources.read_hla(spark, path), ["case_id", "did", "rid", "transplant_date"])


@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_mktsegment FROM customer")
def tsv_scan(spark, sf_dir):
    """Headed TSV written and read."""
    path = fx.new_folder(spark, "tsv")
    sinks.write_tsv(fx.table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), path, header=True)
    return sources.read_delimited(spark, path)


@query("SELECT CAST(p_partkey AS VARCHAR) AS _c0, p_brand AS _c1, p_type AS _c2 FROM part")
def space_separated_scan(spark, sf_dir):
    """Space-separated text without a header."""
    path = fx.new_folder(spark, "spaced")
    fx.table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type").write.option("sep", " ").csv(path)
    return sources.read_delimited(spark, path, " ", header=False)


@query(
    ot.sql(
        CALLS,
        select="""SELECT CAST(variant_idx AS VARCHAR) || '_GENE' || CAST(chrom AS VARCHAR) || '.vcf' AS file_name,
        snp || ',' || CAST(sample_id AS VARCHAR) || ',' || coalesce(CAST(dosage AS VARCHAR), '.') AS line, CAST(3 AS INTEGER) AS n_fields FROM calls""",
    )
)
def gene_file_scan(spark, sf_dir):
    """Per-gene text files found by their name; here one file per variant and chromosome."""
    folder = fx.new_folder(spark, "genes")
    calls = fx.pack_calls(fx.calls(spark, sf_dir).withColumn("line", F.concat_ws(",", "snp", "sample_id", F.coalesce(F.col("dosage").cast("string"), F.lit(".")))), ("line",))
    named = calls.select(F.format_string("%d_GENE%d.vcf", "variant_idx", "chrom").alias("name"), "line")

    def write(batches):
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                with fx._open_output(f"{folder}/{row['name']}") as f:
                    f.write("\n".join(row["line"]).encode())
            yield pa.RecordBatch.from_pydict({"n": [len(batch)]})

    fx.ship(spark)
    named.mapInArrow(write, "n bigint").agg(F.sum("n")).collect()
    return vcf.read_gene_files(spark, folder, "GENE*").select("file_name", "line", F.size("fields").alias("n_fields"))


def _saved_matrix(spark, sf_dir):
    path = fx.new_folder(spark, "encoded")
    sinks.write_encoded(pairs.encode_modes(paired_dosages(spark, sf_dir), ("count", "pres_abs")), path)
    return path


SUMMARY = """summed AS (
  SELECT 'count' AS mode, chrom, code FROM counted UNION ALL SELECT 'pres_abs' AS mode, chrom, code FROM presence)"""


@query(
    ot.sql(
        CALLS, PAIRS, PAIRED, encoded_sql("count", "counted"), encoded_sql("pres_abs", "presence"), SUMMARY,
        select="SELECT mode, CAST(code AS INTEGER) AS code, count(*) AS n FROM summed GROUP BY ALL",
    )
)
def encoded_summary(spark, sf_dir):
    """Saved matrices loaded and inspected: rows per mode and code."""
    return tables.encoded_summary(sources.read_encoded(spark, _saved_matrix(spark, sf_dir)))


@query(
    ot.sql(
        CALLS, PAIRS, PAIRED, encoded_sql("count", "counted"), encoded_sql("pres_abs", "presence"), SUMMARY,
        select="SELECT mode, chrom, CAST(code AS INTEGER) AS code, count(*) AS n FROM summed WHERE chrom BETWEEN 2 AND 12 GROUP BY ALL",
    )
)
def encoded_scan_by_chromosome(spark, sf_dir):
    """A chromosome range of saved matrices; other chromosomes' folders are not listed in the scan."""
    saved = sources.read_encoded(spark, _saved_matrix(spark, sf_dir), chroms=(2, 12))
    return saved.groupBy("mode", "chrom", "code").agg(F.count(F.lit(1)).alias("n"))


@query(
    ot.sql(
        CALLS, PAIRS, PAIRED, encoded_sql("count"), RATES,
        select=f"SELECT {KEYS}, case_id, CAST(code AS INTEGER) AS code, 'count' AS mode FROM encoded JOIN rates USING ({KEYS}) WHERE call_rate >= 0.95",
    )
)
def filtered_matrix_sink(spark, sf_dir):
    """The matrix at 95 % call rate, saved and loaded."""
    path = fx.new_folder(spark, "filtered")
    enc = pairs.encode_pairs(paired_dosages(spark, sf_dir), "count")
    kept = quality.filter_call_rate(enc, n_pairs(spark, sf_dir), variants=_variants_of(spark, sf_dir))
    sinks.write_encoded(kept.withColumn("mode", F.lit("count")), path)
    return sources.read_encoded(spark, path).select(*pairs.VARIANT, "case_id", "code", "mode")


def _chi_inputs(spark, sf_dir):
    enc = pairs.encode_pairs(paired_dosages(spark, sf_dir), "count")
    return enc, outcome_status(spark, sf_dir), quality.repeated_positions(_variants_of(spark, sf_dir))


def _variants_of(spark, sf_dir, placed=lambda df: df):
    """The variant table of the fixture, which has no variant file of its own."""
    return placed(fx.calls(spark, sf_dir).select(*pairs.VARIANT)).distinct()


CHI_COUNT = [CALLS, PAIRS, OUTCOMES, STATUS, PAIRED, encoded_sql("count"), ot.contingency("cont", "encoded", "status", (0, 1, 2)), ot.chi_square("tested", "cont", (0, 1, 2))]


@query(ot.sql(*CHI_COUNT, select=f"SELECT chrom, pos, {ot.r6('stat')} AS stat, {ot.r6('p_value')} AS p_value, status FROM tested"))
def pvalue_sink(spark, sf_dir):
    """p-values written as Parquet by chromosome and as CSV; the CSV is read back and checked against Parquet."""
    enc, status, repeated = _chi_inputs(spark, sf_dir)
    result = association.chi_square(tables.contingency(enc, status, repeated=repeated)).select("chrom", "pos", "stat", "p_value", "status")
    a, b = fx.new_folder(spark, "p-parquet"), fx.new_folder(spark, "p-csv")
    sinks.write_pvalues(result, a)
    saved = spark.read.parquet(a)
    sinks.write_pvalues(saved, b, "csv")
    listed = spark.read.schema(saved.schema).option("header", True).csv(b)
    return listed.join(saved.select("chrom", "pos"), ["chrom", "pos"]).select("chrom", "pos", "stat", "p_value", "status")


@query(ot.sql(*CHI_COUNT[:-1], select="SELECT chrom, pos, case_0, case_1, case_2, control_0, control_1, control_2 FROM cont"))
def contingency_sink(spark, sf_dir):
    enc, status, repeated = _chi_inputs(spark, sf_dir)
    path = fx.new_folder(spark, "contingency")
    sinks.write_table(tables.contingency(enc, status, repeated=repeated), path)
    return spark.read.parquet(path)


@query(ot.sql(CALLS, PAIRS, PAIRED, encoded_sql("count_directed"), select="SELECT chrom, variant_idx, case_id, CAST(code AS INTEGER) AS code FROM encoded"))
def packed_matrix_sink(spark, sf_dir):
    """Dense codes in blocks of cases, saved, loaded and laid out long."""
    calls, pr = fx.calls(spark, sf_dir), fx.pairs(spark, sf_dir)
    rows, samples = _packed_calls(calls)
    path = fx.new_folder(spark, "dense")
    sinks.write_packed(rows, samples, pr, "count_directed", path, chunk=100)
    saved = spark.read.parquet(path).select("chrom", "variant_idx", "block", "codes")
    return packed.unpack_codes(saved, packed.case_order(pr), 100)


def _packed_calls(calls, values=("dosage",)):
    samples = cohort_slots(calls)
    return fx.pack_calls(calls, values), samples


def cohort_slots(calls):
    """Array slots of the packed fixture: samples in id order, which are dense from 0."""
    return calls.select("sample_id").distinct().withColumn("sample_idx", F.col("sample_id"))


@query(
    """SELECT 'F' || CAST(c_custkey AS VARCHAR) AS _c0, 'I' || CAST(c_custkey AS VARCHAR) AS _c1, 'F' || CAST(c_custkey AS VARCHAR) AS _c2,
    'RAND' || CAST(1000000 + (c_custkey * {a} + {b}) % 9000000 AS VARCHAR) AS _c3 FROM customer""".format(
        **dict(zip("ab", cohort.affine_key(1)))
    )
)
def recode_list_sink(spark, sf_dir):
    """The id recode list as headerless TSV."""
    path = fx.new_folder(spark, "recode")
    sinks.write_tsv(cohort.randomise_ids(_fam(spark, sf_dir)), path)
    return sources.read_delimited(spark, path, header=False)


def _fam(spark, sf_dir):
    c = F.col("c_custkey")
    return fx.table(spark, sf_dir, "customer").select(
        F.concat(F.lit("F"), c.cast("string")).alias("fid"), F.concat(F.lit("I"), c.cast("string")).alias("iid"), c.alias("i")
    )


# --- ids ---------------------------------------------------------------------------------------------


@query(
    f"""SELECT c_custkey, {_format_sql('c_custkey', 'donor')} AS donor_id, {_format_sql('c_custkey', 'recipient')} AS recipient_id,
        {_format_sql('c_custkey * 791900000 + 1000000', 'donor')} AS long_donor_id,
        {_format_sql('c_custkey * 7919 + 1000000', 'recipient')} AS long_recipient_id FROM customer"""
)
def format_ids(spark, sf_dir):
    c = F.col("c_custkey")
    return fx.table(spark, sf_dir, "customer").select(
        "c_custkey",
        ids.format_id(c, "donor").alias("donor_id"),
        ids.format_id(c, "recipient").alias("recipient_id"),
        ids.format_id(c * 791900000 + 1000000, "donor").alias("long_donor_id"),
        ids.format_id(c * 7919 + 1000000, "recipient").alias("long_recipient_id"),
    )


BOTH_IDS = f"""
two_roles AS (
  SELECT c_custkey, {_format_sql('c_custkey', 'donor')} AS id FROM customer UNION ALL
  SELECT c_custkey, {_format_sql('c_custkey', 'recipient')} AS id FROM customer UNION ALL
  SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS id FROM customer)"""


def _both_ids(spark, sf_dir):
    c = F.col("c_custkey")
    return fx.table(spark, sf_dir, "customer").select(
        "c_custkey", F.explode(F.array(ids.format_id(c, "donor"), ids.format_id(c, "recipient"), c.cast("string"))).alias("id")
    )


@query(ot.sql(BOTH_IDS, select="SELECT c_custkey, id, CASE WHEN instr(id, '-') = 5 THEN 'D' WHEN instr(id, '-') > 0 THEN 'R' END AS role FROM two_roles"))
def donor_or_recipient(spark, sf_dir):
    return _both_ids(spark, sf_dir).select("c_custkey", "id", ids.is_donor("id").alias("role"))


@query(
    ot.sql(
        BOTH_IDS,
        select="""SELECT c_custkey, id, CAST(replace(id, '-', '') AS BIGINT) AS number,
        CASE WHEN instr(id, '-') = 5 THEN 'D' WHEN instr(id, '-') > 0 THEN 'R' END AS role FROM two_roles""",
    )
)
def parse_ids(spark, sf_dir):
    return _both_ids(spark, sf_dir).select("c_custkey", "id", ids.parse_id("id").alias("p")).select("c_custkey", "id", "p.number", "p.role")


@query(
    ot.sql(
        fx.typed_sql(fx.CASE_LOCI),
        select=f"SELECT case_id, locus, array_to_string(list_sort([{_two('r1')}, {_two('r2')}]), ',') AS two_field FROM typed",
    )
)
def two_field_typings(spark, sf_dir):
    melted = hla.melt_hla(fx.typed_cases(spark, sf_dir, hla.CASE_LOCI, hla.typing_column), ["case_id"], hla.CASE_LOCI)
    return melted.select("case_id", "locus", F.array_join(hla_f.two_field(F.array("r1", "r2")), ",").alias("two_field"))


# --- filters ---------------------------------------------------------------------------------------


@query(
    ot.sql(
        OUTCOMES,
        select="""SELECT case_id, disease, CASE disease WHEN 10 THEN 'AML' WHEN 20 THEN 'ALL' WHEN 40 THEN 'CML' WHEN 50 THEN 'MDS' END AS name
        FROM outcomes""",
    )
)
def disease_filter(spark, sf_dir):
    rows = fx.outcomes(spark, sf_dir).select("case_id", "disease")
    return lookup.union_all([dosage.filter_disease(rows, d).withColumn("name", F.lit(d)) for d in dosage.DISEASES])


@query(ot.sql(CALLS, VARIANTS, select="SELECT * FROM variants WHERE an >= 800"))
def allele_number_filter(spark, sf_dir):
    return quality.filter_allele_number(fx.annotated_variants(fx.calls(spark, sf_dir)))


@query(
    ot.sql(
        CALLS, VARIANTS,
        select="""SELECT chrom, count(CASE WHEN an >= 800 THEN 1 END) AS kept, count(CASE WHEN an < 800 THEN 1 END) AS removed
        FROM variants GROUP BY chrom""",
    )
)
def allele_number_report(spark, sf_dir):
    return quality.allele_number_report(fx.annotated_variants(fx.calls(spark, sf_dir)))


@query(ot.sql(fx.GRID_VARIANTS_SQL, select=f"SELECT {KEYS} FROM grid_variants WHERE chrom = 9 AND pos BETWEEN 1100000 AND 2000000"))
def region_filter(spark, sf_dir):
    return quality.filter_region(fx.grid_variants(spark, sf_dir), 9, 1100000, 2000000)


@query(ot.sql(fx.GRID_VARIANTS_SQL, select=f"SELECT {KEYS} FROM grid_variants WHERE chrom BETWEEN 5 AND 22"))
def chromosome_range(spark, sf_dir):
    return quality.filter_chroms(fx.grid_variants(spark, sf_dir), 5, 22)


@query(ot.sql(CALLS, PAIRS, PAIRED, encoded_sql("count"), RATES, select=f"SELECT {KEYS}, n_called, {ot.r6('call_rate')} AS call_rate FROM rates"))
def call_rate(spark, sf_dir):
    return quality.variant_call_rate(pairs.encode_pairs(paired_dosages(spark, sf_dir), "count"), n_pairs(spark, sf_dir))


@query(
    ot.sql(
        CALLS, PAIRS, PAIRED, encoded_sql("count"), RATES,
        select=f"SELECT {KEYS}, case_id, CAST(code AS INTEGER) AS code FROM encoded JOIN rates USING ({KEYS}) WHERE call_rate >= 0.95",
    )
)
def call_rate_filter(spark, sf_dir):
    enc = pairs.encode_pairs(paired_dosages(spark, sf_dir), "count")
    kept = quality.filter_call_rate(enc, n_pairs(spark, sf_dir), variants=_variants_of(spark, sf_dir))
    return kept.select(*pairs.VARIANT, "case_id", "code")


@query(
    ot.sql(
        CALLS, PAIRS, PAIRED, encoded_sql("count"), RATES,
        select=f"SELECT {KEYS}, case_id, CAST(code AS INTEGER) AS code FROM encoded JOIN rates USING ({KEYS}) WHERE call_rate >= 0.95",
    )
)
def call_rate_filter_bucketed(spark, sf_dir):
    """The same on a matrix saved in buckets of variants: read once, without a shuffle of its rows."""
    enc = pairs.encode_pairs(paired_dosages(spark, sf_dir), "count").select(*pairs.VARIANT, "case_id", "code")
    path = fx.new_folder(spark, "bucketed")
    buckets.write_bucketed(enc, path, sort_by=("pos", "snp"))
    return quality.filter_call_rate(buckets.read_bucketed(spark, path), n_pairs(spark, sf_dir), bucketed=True)


@query(
    ot.sql(
        CALLS, PAIRS, PAIRED, encoded_sql("count"), RATES,
        select=f"""SELECT chrom, count(CASE WHEN call_rate < 0.95 THEN 1 END) AS removed, count(*) AS total,
        {ot.r6("count(CASE WHEN call_rate < 0.95 THEN 1 END) / CAST(count(*) AS DOUBLE) * 100")} AS percent_removed FROM rates GROUP BY chrom""",
    )
)
def call_rate_report_observed(spark, sf_dir):
    """Kept and removed variants per chromosome, counted by the pass that filters and saves them."""
    rates = quality.variant_call_rate(pairs.encode_pairs(paired_dosages(spark, sf_dir), "count"), n_pairs(spark, sf_dir))
    kept, seen = quality.observed_filter(rates, F.col("call_rate") >= quality.MIN_CALL_RATE, "call rate")
    sinks.write_table(kept, fx.new_folder(spark, "kept"))
    return quality.observed_report(spark, seen)


@query(
    ot.sql(
        CALLS, PAIRS, PAIRED, encoded_sql("count"), RATES,
        select=f"""SELECT chrom, count(CASE WHEN call_rate < 0.95 THEN 1 END) AS removed, count(*) AS total,
        {ot.r6("count(CASE WHEN call_rate < 0.95 THEN 1 END) / CAST(count(*) AS DOUBLE) * 100")} AS percent_removed FROM rates GROUP BY chrom""",
    )
)
def call_rate_report(spark, sf_dir):
    rates = quality.variant_call_rate(pairs.encode_pairs(paired_dosages(spark, sf_dir), "count"), n_pairs(spark, sf_dir))
    return quality.call_rate_report(rates)


@query(
    ot.sql(
        fx.GRID_VARIANTS_SQL,
        select=f"SELECT {KEYS} FROM (SELECT *, count(*) OVER (PARTITION BY snp) AS copies FROM grid_variants) WHERE copies = 1",
    )
)
def duplicate_id_drop(spark, sf_dir):
    """Whole-genome scope: every copy of a repeated id goes."""
    return quality.drop_duplicate_snps(fx.grid_variants(spark, sf_dir), scope=())


@query(
    ot.sql(
        fx.GRID_VARIANTS_SQL,
        select=f"""SELECT {KEYS} FROM (SELECT *, count(*) OVER (PARTITION BY chrom, snp) AS copies FROM
        (SELECT CAST(variant_idx // 50 % 22 + 1 AS INTEGER) AS chrom, pos, snp, variant_idx FROM grid_variants)) WHERE copies = 1""",
    )
)
def duplicate_id_drop_by_chromosome(spark, sf_dir):
    chrom = (F.floor(F.col("variant_idx") / 50) % 22 + 1).cast("int")
    return quality.drop_duplicate_snps(fx.grid_variants(spark, sf_dir).withColumn("chrom", chrom))


@query(ot.sql(fx.GRID_VARIANTS_SQL, select="SELECT snp, count(*) AS copies FROM grid_variants GROUP BY snp HAVING count(*) > 1"))
def duplicate_id_report(spark, sf_dir):
    return quality.duplicate_snps(fx.grid_variants(spark, sf_dir), scope=())


@query(ot.sql(SAMPLES, COMPLETE, select='SELECT case_id, did, rid, "group" FROM complete'))
def complete_pairs(spark, sf_dir):
    return pairs.complete_pairs(fx.samples(spark, sf_dir))


@query(
    ot.sql(
        SAMPLES, COMPLETE,
        select='SELECT group_id, subject_type, seq_id, r_d_id, "group" FROM samples WHERE group_id IN (SELECT case_id FROM complete)',
    )
)
def samples_in_complete_pairs(spark, sf_dir):
    return pairs.samples_in_complete_pairs(fx.samples(spark, sf_dir))


@query(ot.sql(SAMPLES, select="SELECT group_id, count(*) AS n_samples FROM samples GROUP BY group_id"))
def group_sizes(spark, sf_dir):
    return pairs.group_sizes(fx.samples(spark, sf_dir))


CHI_PRESENCE = [CALLS, VARIANTS, SAMPLES, COMPLETE, COMPLETE_STATUS, PASSING, COMPLETE_PAIRED, allele_sql("presence"), ot.contingency("cont", "encoded", "complete_status", (0, 1)), ot.chi_square("tested", "cont", (0, 1))]
CHI_ALLELE = [CALLS, VARIANTS, SAMPLES, COMPLETE, COMPLETE_STATUS, PASSING, COMPLETE_PAIRED, allele_sql("count"), ot.contingency("cont", "encoded", "complete_status", (0, 1, 2)), ot.chi_square("tested", "cont", (0, 1, 2))]


def _callset(spark, sf_dir):
    calls = fx.calls(spark, sf_dir)
    return calls, fx.annotated_variants(calls), fx.samples(spark, sf_dir)


def _packed_callset(spark, sf_dir):
    """Packed alleles with their allele numbers, the samples' slots, and the samples."""
    rows, slots = _packed_calls(fx.calls(spark, sf_dir), ("a1", "a2"))
    return rows.withColumn("an", F.size(F.array_compact("a1")) * 2), slots, fx.samples(spark, sf_dir)


@query(
    ot.sql(
        *CHI_ALLELE,
        select=f"""SELECT chrom, pos, case_0, case_1, case_2, control_0, control_1, control_2, {ot.r6('stat')} AS stat,
        {ot.r6('p_value')} AS p_value, status, {ot.r6('-ln(p_value)')} AS neg_log_p FROM tested WHERE p_value > 0""",
    )
)
def callset_association_count(spark, sf_dir):
    """Allele number filter, complete pairs, allele count code, contingency, chi-square, -ln p."""
    return callset.packed_association_log_p(*_packed_callset(spark, sf_dir), "count")


@query(
    ot.sql(
        *CHI_PRESENCE,
        select=f"""SELECT chrom, pos, case_0, case_1, control_0, control_1, {ot.r6('stat')} AS stat,
        {ot.r6('p_value')} AS p_value, status, {ot.r6('-ln(p_value)')} AS neg_log_p FROM tested WHERE p_value > 0""",
    )
)
def callset_association_presence(spark, sf_dir):
    return callset.packed_association_log_p(*_packed_callset(spark, sf_dir), "presence")


@query(
    ot.sql(
        *CHI_ALLELE,
        select=f"""SELECT chrom, pos, case_0, case_1, case_2, control_0, control_1, control_2, {ot.r6('stat')} AS stat,
        {ot.r6('p_value')} AS p_value, status, {ot.r6('-ln(p_value)')} AS neg_log_p FROM tested WHERE p_value > 0""",
    )
)
def association_restarted(spark, sf_dir):
    """The association by chromosomes, stopped after two units and taken up: finished units are not computed again."""
    rows, slots, samples = _packed_callset(spark, sf_dir)
    folder = fx.new_folder(spark, "restart")
    sinks.write_packed_calls(rows, slots, f"{folder}/callset")
    saved = sources.read_packed(spark, f"{folder}/callset")
    units = {"1-6": [*range(1, 7)], "7-14": [*range(7, 15)], "15-22": [*range(15, 23)]}
    stopping = []

    def work(chroms):
        if stopping and chroms == units["15-22"]:
            raise InterruptedError(stopping.pop())
        return callset.packed_association_log_p(saved.packed.where(F.col("chrom").isin(*chroms)), saved.samples, samples, "count")

    run = restart.Run(spark, f"{folder}/run", [f"{folder}/callset"], {"mode": "count"})
    stopping.append("two units are done")
    try:
        run.execute(units, work)
    except InterruptedError:
        pass
    again = restart.Run(spark, f"{folder}/run", [f"{folder}/callset"], {"mode": "count"})
    if again.execute(units, work) != ["15-22"]:
        raise ValueError("finished units were computed again")
    return again.results()


@query(ot.sql(*CHI_ALLELE, select=f"SELECT chrom, pos, case_0, case_1, case_2, control_0, control_1, control_2, {ot.r6('stat')} AS stat, {ot.r6('p_value')} AS p_value, status FROM tested"))
def vcf_callset_association(spark, sf_dir):
    """VCF text converted to a packed call set, then tested without shuffling genotypes."""
    calls = fx.calls(spark, sf_dir)
    folder = fx.new_folder(spark, "vcf")
    paths = fx.write_vcf(spark, fx.pack_calls(calls, ("a1", "a2")), calls.select("sample_id").distinct(), folder)
    sinks.vcf_to_parquet(spark, paths, f"{folder}/callset")
    saved = sources.read_packed(spark, f"{folder}/callset")
    samples = fx.samples(spark, sf_dir).withColumn("seq_id", F.col("seq_id").cast("string"))
    return callset.packed_association_table(saved.packed, saved.samples, samples)


@query(ot.sql(*CHI_PRESENCE, select=f"SELECT chrom, pos, {ot.r6('p_value')} AS p_value, status FROM tested WHERE p_value IS NOT NULL"))
def testable_filter(spark, sf_dir):
    table = callset.association_table(*_callset(spark, sf_dir), "presence")
    return association.testable(table).select("chrom", "pos", "p_value", "status")


@query(ot.sql(*CHI_COUNT, select=f"SELECT chrom, pos, {ot.r6('-ln(p_value)')} AS neg_log_p FROM tested WHERE p_value > 0"))
def neg_log_p(spark, sf_dir):
    enc, status, repeated = _chi_inputs(spark, sf_dir)
    tested = association.chi_square(tables.contingency(enc, status, repeated=repeated))
    return association.testable(tested, strict=True).select("chrom", "pos", stats.neg_log_p().alias("neg_log_p"))


@query(
    ot.sql(
        SAMPLES,
        select="""SELECT "group" || '_' || CAST(group_id AS VARCHAR) || '_' || subject_type || '_' || CAST(r_d_id AS VARCHAR) || suffix AS old_name,
        'SEQ' || CAST(seq_id AS VARCHAR) || suffix AS new_name FROM samples, (VALUES ('.vcf.gz'), ('.vcf.gz.tbi')) AS s(suffix)""",
    )
)
def rename_manifest(spark, sf_dir):
    return cohort.rename_manifest(fx.samples(spark, sf_dir))


@query(
    ot.sql(
        CALLS,
        select="""SELECT variant_idx, sample_id, CASE WHEN a1 IS NULL OR a2 IS NULL THEN NULL WHEN a1 <> a2 THEN 1 WHEN a1 = 0 THEN 0 ELSE 2 END AS gt_type
        FROM calls""",
    )
)
def genotype_type(spark, sf_dir):
    return fx.calls(spark, sf_dir).select("variant_idx", "sample_id", encode.gt_type("a1", "a2").alias("gt_type"))


@query(
    ot.sql(
        fx.GRID_VARIANTS_SQL,
        select="""SELECT variant_idx, CAST(chrom AS VARCHAR) || ':' || CAST(pos AS VARCHAR) || '-' || CAST(pos + 1 AS VARCHAR) || ':1 ==> ' || snp
        || ' (missense_variant)' AS label FROM grid_variants""",
    )
)
def variant_label(spark, sf_dir):
    v = fx.grid_variants(spark, sf_dir)
    label = hla_f.variant_label("chrom", "pos", F.col("pos") + 1, F.lit(1), "snp", F.lit("missense_variant"))
    return v.select("variant_idx", label.alias("label"))


# --- joins and reshaping ----------------------------------------------------------------------------------


@query(ot.sql(CALLS, PAIRS, PAIRED, select=f"SELECT {KEYS}, case_id, CAST(d_dosage AS INTEGER) AS d_dosage, CAST(r_dosage AS INTEGER) AS r_dosage FROM paired"))
def pair_calls(spark, sf_dir):
    return paired_dosages(spark, sf_dir)


@query(ot.sql(CALLS, PAIRS, PAIRED, select="SELECT chrom, variant_idx, case_id, CAST(d_dosage AS INTEGER) AS d_dosage, CAST(r_dosage AS INTEGER) AS r_dosage FROM paired"))
def pair_calls_packed(spark, sf_dir):
    """The same pairs from packed rows, without shuffling genotypes."""
    rows, samples = _packed_calls(fx.calls(spark, sf_dir))
    return packed.packed_pairs(rows, samples, fx.pairs(spark, sf_dir))


@query(
    ot.sql(
        CALLS, PAIRS,
        select="SELECT c.chrom, c.pos, c.snp, c.variant_idx, p.case_id, CAST(c.dosage AS INTEGER) AS code FROM calls c JOIN pairs p ON c.sample_id = p.rid",
    )
)
def recipient_calls(spark, sf_dir):
    """Recipient-only lookup: the recipient's dosage is the code."""
    return pairs.recipient_calls(fx.calls(spark, sf_dir), fx.pairs(spark, sf_dir))


@query(
    ot.sql(
        CALLS, PAIRS, OUTCOMES, PAIRED, encoded_sql("count"),
        select=f"SELECT {KEYS}, case_id, CAST(code AS INTEGER) AS code, agvhi24, agvhi34 FROM encoded LEFT JOIN outcomes USING (case_id)",
    )
)
def outcome_labels(spark, sf_dir):
    enc = pairs.encode_pairs(paired_dosages(spark, sf_dir), "count")
    return pairs.with_outcome(enc, fx.outcomes(spark, sf_dir), ["agvhi24", "agvhi34"]).select(*pairs.VARIANT, "case_id", "code", "agvhi24", "agvhi34")


@query(ot.sql(SAMPLES, select="SELECT DISTINCT group_id AS case_id, CASE \"group\" WHEN 'a' THEN 'case' ELSE 'control' END AS status FROM samples"))
def case_control_split(spark, sf_dir):
    return pairs.case_control(fx.samples(spark, sf_dir))


ROSTER = """
roster AS (
  SELECT seq_id AS sample_id FROM samples UNION ALL SELECT seq_id FROM samples WHERE seq_id % 40 = 0 UNION ALL SELECT -seq_id - 1 FROM samples WHERE seq_id % 60 = 3),
tested_pairs AS (SELECT case_id, did, CASE WHEN case_id % 30 = 0 THEN did ELSE rid END AS rid FROM pairs)"""


@query(
    ot.sql(
        SAMPLES, PAIRS, ROSTER,
        """listed AS (SELECT did AS sample_id FROM tested_pairs UNION ALL SELECT rid FROM tested_pairs),
        counts AS (
          SELECT sample_id, coalesce(p.n, 0) AS n_pairs, coalesce(r.n, 0) AS n_roster
          FROM (SELECT sample_id, count(*) AS n FROM listed GROUP BY 1) p
          FULL JOIN (SELECT sample_id, count(*) AS n FROM roster GROUP BY 1) r USING (sample_id))""",
        select="""SELECT sample_id, 'not_in_roster' AS finding, n_pairs AS n FROM counts WHERE n_roster = 0
        UNION ALL SELECT sample_id, 'not_in_pairs', n_roster FROM counts WHERE n_pairs = 0
        UNION ALL SELECT sample_id, 'extra_in_pairs', n_pairs - n_roster FROM counts WHERE n_pairs > n_roster
        UNION ALL SELECT sample_id, 'extra_in_roster', n_roster - n_pairs FROM counts WHERE n_roster > n_pairs
        UNION ALL SELECT did, 'self_pair', count(*) FROM tested_pairs WHERE did = rid GROUP BY did""",
    )
)
def pair_integrity(spark, sf_dir):
    s = fx.samples(spark, sf_dir).select(F.col("seq_id").alias("sample_id"))
    sid = F.col("sample_id")
    roster = s.unionByName(s.filter(sid % 40 == 0)).unionByName(s.filter(sid % 60 == 3).select((-sid - 1).alias("sample_id")))
    tested = fx.pairs(spark, sf_dir).withColumn("rid", F.when(F.col("case_id") % 30 == 0, F.col("did")).otherwise(F.col("rid")))
    return pairs.check_pairs(tested, roster)


@query(
    ot.sql(
        fx.GENES_SQL, fx.GRID_VARIANTS_SQL,
        select="""SELECT g.gene, v.chrom, v.snp, v.pos AS start, v.pos AS "end", g.gene_start, g.gene_end
        FROM grid_variants v JOIN genes g ON v.chrom = g.chrom AND v.pos <= g.gene_end AND v.pos >= g.gene_start""",
    )
)
def gene_variants(spark, sf_dir):
    v = fx.grid_variants(spark, sf_dir).select("chrom", "snp", F.col("pos").alias("start"), F.col("pos").alias("end"))
    return annotate.gene_variants(fx.genes(spark, sf_dir), v)


@query(
    ot.sql(
        fx.GRID_VARIANTS_SQL,
        """asked AS (SELECT DISTINCT 'rs' || CAST(l_partkey + 7 AS VARCHAR) AS snp FROM lineitem)""",
        select="SELECT a.snp, v.chrom, v.pos, v.variant_idx FROM asked a LEFT JOIN grid_variants v USING (snp)",
    )
)
def variant_lookup(spark, sf_dir):
    asked = fx.table(spark, sf_dir, "lineitem").select(F.concat(F.lit("rs"), (F.col("l_partkey") + 7).cast("string")).alias("snp")).distinct()
    return annotate.lookup_variants(asked, fx.grid_variants(spark, sf_dir))


ALLELE_ROWS = "alleles AS (SELECT case_id, locus, unnest([r1, r2, d1, d2]) AS allele FROM typed)"


def _allele_rows(spark, sf_dir, loci):
    melted = hla.melt_hla(fx.typed_cases(spark, sf_dir, hla.TYPED_LOCI, hla.typing_column), ["case_id"], loci)
    return melted.select("case_id", "locus", F.explode(F.array("r1", "r2", "d1", "d2")).alias("allele"))


@query(
    ot.sql(
        fx.typed_sql(fx.TYPED_LOCI), fx.SEQUENCES_SQL, ALLELE_ROWS,
        select=f"""SELECT case_id, locus, allele, CASE WHEN unaligned = '' THEN '{annotate.CLASS_I_PREFIX}' || exon2 || '{annotate.CLASS_I_INTRON2}' || exon3
        || '{annotate.CLASS_I_SUFFIX}' ELSE replace(replace(unaligned, '|', ''), '*', '') END AS sequence
        FROM alleles JOIN seqs USING (allele) WHERE locus IN ('A', 'B', 'C')""",
    )
)
def class_one_sequences(spark, sf_dir):
    rows = _allele_rows(spark, sf_dir, hla.CLASS_LOCI["I"])
    return annotate.allele_sequence(rows, fx.allele_sequences(rows), "I").select("case_id", "locus", "allele", "sequence")


@query(
    ot.sql(
        fx.typed_sql(fx.TYPED_LOCI), fx.SEQUENCES_SQL, ALLELE_ROWS,
        select="""SELECT case_id, locus, allele, exon2, nullif(replace(exon3, '*', ''), '') AS exon3
        FROM alleles JOIN seqs USING (allele) WHERE locus IN ('DRB1', 'DQB1')""",
    )
)
def class_two_sequences(spark, sf_dir):
    rows = _allele_rows(spark, sf_dir, hla.CLASS_LOCI["II"])
    return annotate.allele_sequence(rows, fx.allele_sequences(rows), "II").select("case_id", "locus", "allele", "exon2", "exon3")


@query(ot.sql(*CHI_PRESENCE[:-2], ot.contingency("cont", "encoded", "complete_status", (0, 1), floor=1), ot.chi_square("tested", "cont", (0, 1)),
              select=f"SELECT 'chr' || CAST(chrom AS VARCHAR) AS chromosome, pos, {ot.r6('p_value')} AS p_value FROM tested WHERE p_value >= 0"))
def chromosome_union(spark, sf_dir):
    """p-values of two separately held halves of the genome as one table with a chromosome name."""
    table = callset.association_table(*_callset(spark, sf_dir), "presence", floor=1)
    halves = [quality.filter_chroms(table, 1, 11), quality.filter_chroms(table, 12, 22)]
    return association.testable(
        lookup.union_all([h.select(F.concat(F.lit("chr"), F.col("chrom").cast("string")).alias("chromosome"), "pos", "p_value") for h in halves])
    )


@query(ot.sql(CALLS, PAIRS, PAIRED, encoded_sql("count"), select="SELECT DISTINCT chrom, pos FROM encoded"))
def distinct_positions(spark, sf_dir):
    """The positions a contingency table holds."""
    enc, status, repeated = _chi_inputs(spark, sf_dir)
    return tables.contingency(enc, status, repeated=repeated).select("chrom", "pos")


@query(
    ot.sql(
        CALLS, PAIRS, PAIRED, encoded_sql("count"),
        select="""SELECT case_id, chrom, CAST(variant_idx // 10 AS BIGINT) AS block,
        string_agg(CAST(variant_idx AS VARCHAR) || '=' || coalesce(CAST(code AS VARCHAR), '.'), ',' ORDER BY variant_idx) AS codes FROM encoded GROUP BY ALL""",
    )
)
def matrix_by_case(spark, sf_dir):
    """Transposed matrix: per case, runs of variants."""
    rows = packed.by_case(pairs.encode_pairs(paired_dosages(spark, sf_dir), "count"), 10)
    text = F.transform("codes", lambda c: F.concat_ws("=", c["variant_idx"].cast("string"), F.coalesce(c["code"].cast("string"), F.lit("."))))
    return rows.select("case_id", "chrom", "block", F.array_join(text, ",").alias("codes"))


@query(
    ot.sql(
        CALLS, PAIRS, PAIRED, encoded_sql("count"),
        select="""SELECT case_id, chrom, CAST(variant_idx // 10 AS BIGINT) AS block,
        string_agg(CAST(variant_idx AS VARCHAR) || '=' || coalesce(CAST(code AS VARCHAR), '.'), ',' ORDER BY variant_idx) AS codes FROM encoded GROUP BY ALL""",
    )
)
def matrix_by_case_packed(spark, sf_dir):
    """The transposed matrix from packed rows: tiles are shuffled, not cells."""
    rows, slots = _packed_calls(fx.calls(spark, sf_dir))
    blocks = packed.packed_by_case(rows, slots, fx.pairs(spark, sf_dir), "count", 10)
    text = F.transform("codes", lambda c: F.concat_ws("=", c["variant_idx"].cast("string"), F.coalesce(c["code"].cast("string"), F.lit("."))))
    return blocks.select("case_id", "chrom", "block", F.array_join(text, ",").alias("codes"))


@query(
    ot.sql(
        CALLS, PAIRS, PAIRED_ALLELES,
        f"slots AS (SELECT {KEYS}, case_id, {ot.SLOT1} AS slot1, {ot.SLOT2} AS slot2 FROM paired)",
        select=f"SELECT {KEYS}, case_id, 1 AS slot, slot1 AS code FROM slots UNION ALL SELECT {KEYS}, case_id, 2, slot2 FROM slots",
    )
)
def slot_rows(spark, sf_dir):
    """Two columns per pair, one row each."""
    return tables.slot_rows(callset.encode_mismatch_types(paired_alleles(spark, sf_dir)))


@query(ot.sql(fx.typed_sql(fx.TYPED_LOCI), select="SELECT case_id, did, rid, locus, r1, r2, d1, d2 FROM typed"))
def melt_typings(spark, sf_dir):
    return hla.melt_hla(fx.typed_cases(spark, sf_dir, hla.TYPED_LOCI, hla.typing_column), ["case_id", "did", "rid"])


ORDERED_CASES = """
ordered AS (
  SELECT case_id, row_number() OVER (ORDER BY substr(md5(CAST(case_id AS VARCHAR)), 1, 3), case_id) - 1 AS case_idx FROM pairs)"""


@query(
    ot.sql(
        CALLS, PAIRS, PAIRED, encoded_sql("count"), ORDERED_CASES,
        select="""SELECT chrom, variant_idx, CAST(case_idx // 100 AS INTEGER) AS block,
        string_agg(coalesce(CAST(code AS VARCHAR), '.'), ',' ORDER BY case_idx) AS codes FROM encoded JOIN ordered USING (case_id) GROUP BY ALL""",
    )
)
def pack_matrix(spark, sf_dir):
    """Long codes to blocks of cases in a fixed order."""
    enc = pairs.encode_pairs(paired_dosages(spark, sf_dir), "count")
    blocks = packed.pack(enc, packed.case_order(fx.pairs(spark, sf_dir)), 100)
    text = F.transform("codes", lambda c: F.coalesce(c.cast("string"), F.lit(".")))
    return blocks.select("chrom", "variant_idx", "block", F.array_join(text, ",").alias("codes"))


# --- encoders -------------------------------------------------------------------------------------------


def _register_dosage_encoders():
    for mode in encode.DOSAGE_CODES:

        def run(spark, sf_dir, mode=mode):
            return pairs.encode_pairs(paired_dosages(spark, sf_dir), mode)

        run.__name__ = f"encode_{mode}"
        query(ot.sql(CALLS, PAIRS, PAIRED, encoded_sql(mode), select=f"SELECT {KEYS}, case_id, CAST(code AS INTEGER) AS code FROM encoded"))(run)
    for mode in encode.ALLELE_CODES:

        def run(spark, sf_dir, mode=mode):
            return callset.encode_alleles(paired_alleles(spark, sf_dir), mode)

        run.__name__ = f"encode_allele_{mode}"
        query(ot.sql(CALLS, PAIRS, PAIRED_ALLELES, allele_sql(mode), select=f"SELECT {KEYS}, case_id, CAST(code AS INTEGER) AS code FROM encoded"))(run)


_register_dosage_encoders()


@query(ot.sql(CALLS, PAIRS, PAIRED_ALLELES, select=f"SELECT {KEYS}, case_id, {ot.SLOT1} AS slot1, {ot.SLOT2} AS slot2 FROM paired"))
def encode_mismatch_type(spark, sf_dir):
    return callset.encode_mismatch_types(paired_alleles(spark, sf_dir))


@query(
    ot.sql(
        CALLS, PAIRS, PAIRED_ALLELES,
        f"types AS (SELECT {KEYS}, case_id, {ot.GT_TYPE.format(a='d')} AS d, {ot.GT_TYPE.format(a='r')} AS r FROM paired)",
        select=f"SELECT {KEYS}, case_id, abs(d - r) AS diff FROM types WHERE d IS NOT NULL AND r IS NOT NULL",
    )
)
def vcf_pair_difference(spark, sf_dir):
    return callset.genotype_differences(paired_alleles(spark, sf_dir))


# --- tables --------------------------------------------------------------------------------------------


@query(
    ot.sql(
        *CHI_ALLELE[:-1],
        select="""SELECT chrom, pos, 'case' AS status, case_0 AS n0, case_1 AS n1, case_2 AS n2 FROM cont
        UNION ALL SELECT chrom, pos, 'control', control_0, control_1, control_2 FROM cont""",
    )
)
def contingency_count(spark, sf_dir):
    calls, variants, samples = _callset(spark, sf_dir)
    enc = callset.encode_alleles(callset.paired_alleles(calls, variants, samples), "count")
    status = pairs.case_control(samples)
    repeated = quality.repeated_positions(quality.filter_allele_number(variants))
    return tables.contingency_rows(tables.contingency(enc, status, "count", repeated=repeated), "count")


@query(
    ot.sql(
        *CHI_PRESENCE[:-1],
        select="""SELECT chrom, pos, 'case' AS status, case_0 AS n0, case_1 AS n1 FROM cont
        UNION ALL SELECT chrom, pos, 'control', control_0, control_1 FROM cont""",
    )
)
def contingency_presence(spark, sf_dir):
    calls, variants, samples = _callset(spark, sf_dir)
    enc = callset.encode_alleles(callset.paired_alleles(calls, variants, samples), "presence")
    return tables.contingency_rows(tables.contingency(enc, pairs.case_control(samples), "presence", repeated=quality.repeated_positions(variants)), "presence")


CROWDED = [CALLS, fx.CROWDED_SQL, PAIRS, OUTCOMES, STATUS, ot.paired("paired", "crowded", "pairs", ("a1", "a2")), allele_sql("count")]


@query(ot.sql(*CROWDED, ot.contingency("cont", "encoded", "status", (0, 1, 2)), select="SELECT * FROM cont"))
def contingency_repeated_positions(spark, sf_dir):
    """Positions with two variants: a case's codes are summed before counting."""
    calls = fx.crowd_positions(fx.calls(spark, sf_dir))
    enc = callset.encode_alleles(pairs.pair_calls(calls, fx.pairs(spark, sf_dir), callset.ALLELES), "count")
    repeated = quality.repeated_positions(_variants_of(spark, sf_dir, fx.crowd_positions))
    return tables.contingency(enc, outcome_status(spark, sf_dir), repeated=repeated)


@query(
    ot.sql(
        *CROWDED,
        "single AS (SELECT e.* FROM encoded e WHERE pos IN (SELECT pos FROM encoded GROUP BY pos HAVING count(DISTINCT variant_idx) = 1))",
        ot.contingency("cont", "single", "status", (0, 1, 2)),
        select="SELECT * FROM cont",
    )
)
def contingency_repeats_dropped(spark, sf_dir):
    calls = fx.crowd_positions(fx.calls(spark, sf_dir))
    enc = callset.encode_alleles(pairs.pair_calls(calls, fx.pairs(spark, sf_dir), callset.ALLELES), "count")
    repeated = quality.repeated_positions(_variants_of(spark, sf_dir, fx.crowd_positions))
    return tables.contingency(enc, outcome_status(spark, sf_dir), on_repeat="drop", repeated=repeated)


OUTSIDE = """
outside AS (
  SELECT chrom, pos, count(CASE WHEN status IS NOT NULL AND code NOT IN (0, 1, 2) THEN 1 END) AS outside
  FROM (SELECT e.chrom, e.pos, e.case_id, any_value(s.status) AS status, sum(e.code) AS code
        FROM encoded e LEFT JOIN status s USING (case_id) GROUP BY e.chrom, e.pos, e.case_id)
  GROUP BY chrom, pos)"""


@query(ot.sql(*CROWDED, ot.contingency("cont", "encoded", "status", (0, 1, 2)), OUTSIDE, select="SELECT * FROM cont JOIN outside USING (chrom, pos)"))
def contingency_repeated_positions_packed(spark, sf_dir):
    """The same from packed rows in one scan of the genotypes, with the number of sums that no level holds."""
    rows, slots = _packed_calls(fx.calls(spark, sf_dir), ("a1", "a2"))
    return tables.packed_contingency(fx.crowd_positions(rows), slots, fx.pairs(spark, sf_dir), outcome_status(spark, sf_dir), "count", outside=True)


@query(
    ot.sql(
        CALLS, "twice AS (SELECT *, 0 AS copy FROM calls UNION ALL SELECT *, 1 FROM calls WHERE variant_idx % 3 = 0)", PAIRS, OUTCOMES, STATUS,
        ot.paired("paired", "twice", "pairs", ("a1", "a2"), f"{KEYS}, copy"), allele_sql("count"), ot.contingency("cont", "encoded", "status", (0, 1, 2)),
        select="SELECT * FROM cont",
    )
)
def contingency_repeated_rows(spark, sf_dir):
    """Rows that repeat a whole variant key: each counts, as rows of other variants at the position do."""
    rows, slots = _packed_calls(fx.calls(spark, sf_dir), ("a1", "a2"))
    twice = rows.unionByName(rows.where(F.col("variant_idx") % 3 == 0))
    return tables.packed_contingency(twice, slots, fx.pairs(spark, sf_dir), outcome_status(spark, sf_dir), "count")


FLOORED = [*CHI_ALLELE[:-2], ot.contingency("cont", "encoded", "complete_status", (0, 1, 2), floor=1)]


@query(ot.sql(*FLOORED, select="SELECT * FROM cont"))
def floored_contingency(spark, sf_dir):
    calls, variants, samples = _callset(spark, sf_dir)
    enc = callset.encode_alleles(callset.paired_alleles(calls, variants, samples), "count")
    return tables.floored_contingency(enc, pairs.case_control(samples), "count", repeated=quality.repeated_positions(variants))


FREQUENCY = f"""
slots AS (SELECT {KEYS}, {ot.SLOT1} AS slot1, {ot.SLOT2} AS slot2 FROM paired),
freq AS (
  SELECT {KEYS}, {", ".join(f"count(CASE WHEN slot1 = {c} THEN 1 END) + count(CASE WHEN slot2 = {c} THEN 1 END) AS {name}" for c, name in enumerate(encode.MATCH_TYPES))},
         count(CASE WHEN slot1 IS NULL THEN 1 END) + count(CASE WHEN slot2 IS NULL THEN 1 END) AS missing
  FROM slots GROUP BY ALL)"""


@query(ot.sql(CALLS, VARIANTS, SAMPLES, COMPLETE, PASSING, COMPLETE_PAIRED, FREQUENCY, select="SELECT * FROM freq"))
def mismatch_type_frequency(spark, sf_dir):
    """Allele number filter, complete pairs, mismatch types, eight counts per variant."""
    return callset.mismatch_type_table(*_callset(spark, sf_dir))


@query(ot.sql(CALLS, VARIANTS, SAMPLES, COMPLETE, PASSING, COMPLETE_PAIRED, FREQUENCY, select="SELECT * FROM freq"))
def mismatch_type_frequency_packed(spark, sf_dir):
    """The same counts from packed rows."""
    return callset.packed_mismatch_type_table(*_packed_callset(spark, sf_dir))


@query(
    ot.sql(
        fx.GRID_VARIANTS_SQL,
        """bounds AS (SELECT chrom, CASE WHEN max(pos) > 0 THEN (max(pos) - 1) // 20000 ELSE 0 END AS last FROM grid_variants GROUP BY chrom),
        windows AS (SELECT chrom, last, unnest(range(0, last + 1)) AS bin FROM bounds),
        placed AS (SELECT v.chrom, CASE WHEN v.pos = b.last * 20000 AND b.last > 0 THEN b.last - 1 ELSE least(v.pos // 20000, b.last) END AS bin
                   FROM grid_variants v JOIN bounds b USING (chrom))""",
        select="""SELECT w.chrom, w.bin * 20000 AS start, (w.bin + 1) * 20000 AS "end", count(p.bin) AS n_variants,
        round(count(p.bin) / CAST(20000 AS DOUBLE), 6) AS density, w.bin = w.last AS partial
        FROM windows w LEFT JOIN placed p ON p.chrom = w.chrom AND p.bin = w.bin GROUP BY w.chrom, w.bin, w.last""",
    )
)
def variant_density(spark, sf_dir):
    return tables.variant_density(fx.grid_variants(spark, sf_dir), 20000)


@query(ot.sql(CALLS, VARIANTS, select="SELECT chrom, numalt, count(*) AS n_variants FROM variants GROUP BY ALL"))
def alternate_allele_histogram(spark, sf_dir):
    return tables.alternate_allele_histogram(fx.annotated_variants(fx.calls(spark, sf_dir)))


# --- tests -----------------------------------------------------------------------------------------------


@query(ot.sql(*CHI_COUNT, select=f"SELECT chrom, pos, {ot.r6('stat')} AS stat, {ot.r6('p_value')} AS p_value, status FROM tested"))
def chi_square(spark, sf_dir):
    enc, status, repeated = _chi_inputs(spark, sf_dir)
    return association.chi_square(tables.contingency(enc, status, repeated=repeated)).select("chrom", "pos", "stat", "p_value", "status")


@query(ot.sql(*FLOORED, ot.chi_square("tested", "cont", (0, 1, 2)), select=f"SELECT chrom, pos, {ot.r6('stat')} AS stat, {ot.r6('p_value')} AS p_value, status FROM tested"))
def chi_square_floored(spark, sf_dir):
    return callset.association_table(*_callset(spark, sf_dir), "count", floor=1).select("chrom", "pos", "stat", "p_value", "status")


P_COLUMNS = f"{KEYS}, outcome, n_called, ref_code, test_code, {ot.r6('beta')} AS beta, {ot.r6('se')} AS se, {ot.r6('p_value')} AS p_value, status, model"


def _levels(spark, sf_dir, mode):
    enc = pairs.encode_pairs(paired_dosages(spark, sf_dir), mode)
    counts = association.code_counts(enc, fx.outcomes(spark, sf_dir), dosage.OUTCOMES)
    return association.variant_levels(counts, dosage.OUTCOMES)


@query(
    ot.sql(
        CALLS, PAIRS, OUTCOMES, PAIRED, encoded_sql("count"),
        select=f"""SELECT {KEYS}, case_id, CAST(code AS INTEGER) AS code, agvhi24, agvhi34 FROM encoded JOIN outcomes USING (case_id)
        WHERE code IS NOT NULL AND agvhi24 IS NOT NULL AND agvhi34 IS NOT NULL""",
    )
)
def listwise_deletion(spark, sf_dir):
    """A case that misses the code or either outcome is out of both tests."""
    enc = pairs.encode_pairs(paired_dosages(spark, sf_dir), "count")
    labelled = pairs.with_outcome(enc, fx.outcomes(spark, sf_dir), dosage.OUTCOMES)
    return association.complete_outcomes(labelled, dosage.OUTCOMES).select(*pairs.VARIANT, "case_id", "code", *dosage.OUTCOMES)


@query(
    ot.sql(
        CALLS, PAIRS, OUTCOMES, PAIRED, encoded_sql("dr_genotype"), ot.levels("lv", "encoded", "outcomes"),
        select="SELECT variant_idx, outcome, CAST(code AS INTEGER) AS code, n0, n1 FROM lv",
    )
)
def counts_of_both_outcomes(spark, sf_dir):
    """Sufficient counts of two outcomes from one pass."""
    lv = _levels(spark, sf_dir, "dr_genotype")
    return lv.select("variant_idx", "outcome", F.explode("levels").alias("l")).select("variant_idx", "outcome", "l.code", "l.n0", "l.n1")


@query(
    ot.sql(
        CALLS, PAIRS, OUTCOMES, PAIRED, encoded_sql("count_directed"), ot.called("called", "encoded"), ot.levels("lv", "encoded", "outcomes"),
        ot.logistic_factor("fit", "lv", "called"), select=f"SELECT {P_COLUMNS} FROM fit",
    )
)
def logistic_factor(spark, sf_dir):
    return association.logistic_factor(_levels(spark, sf_dir, "count_directed"))


@query(
    ot.sql(
        CALLS, PAIRS, OUTCOMES, PAIRED, encoded_sql("count_directed"), ot.called("called", "encoded"), ot.levels("every", "encoded", "outcomes"),
        "lv AS (SELECT * FROM every WHERE code <> -1)",
        ot.logistic_factor("fit", "lv", "called"), select=f"SELECT {P_COLUMNS} FROM fit",
    )
)
def logistic_factor_sentinel(spark, sf_dir):
    """-1 read as missing, as a switch."""
    return association.logistic_factor(association.as_sentinel(_levels(spark, sf_dir, "count_directed")))


@query(
    ot.sql(
        CALLS, PAIRS, OUTCOMES, PAIRED, encoded_sql("count"), ot.called("called", "encoded"), ot.levels("lv", "encoded", "outcomes"),
        ot.logistic_additive("fit", "lv", "called"), select=f"SELECT {P_COLUMNS} FROM fit",
    )
)
def logistic_additive(spark, sf_dir):
    return association.logistic_additive(_levels(spark, sf_dir, "count"))


@query(
    ot.sql(
        CALLS, VARIANTS, SAMPLES, COMPLETE, PASSING, COMPLETE_PAIRED, allele_sql("count"),
        "labels_ AS (SELECT case_id, CASE \"group\" WHEN 'n' THEN 1 ELSE 0 END AS group_label FROM complete)",
        ot.called("called", "encoded"), ot.levels("lv", "encoded", "labels_", ("group_label",)),
        ot.logistic_factor("fit", "lv", "called", ("group_label",)), select=f"SELECT {P_COLUMNS} FROM fit",
    )
)
def group_logistic(spark, sf_dir):
    """Allele codes against the case/control label."""
    return callset.packed_group_logistic(*_packed_callset(spark, sf_dir), "count")


# --- whole analyses on the customer x part matrix --------------------------------------------------------------


GRID_PAIRED = ot.paired_by_role("paired", "grid", "grid_pairs")
SINGLE_IDS = "singles AS (SELECT variant_idx FROM grid_variants WHERE snp IN (SELECT snp FROM grid_variants GROUP BY snp HAVING count(*) = 1))"


def _grid_sql(mode, model=ot.logistic_factor, sentinel=False):
    lv = ot.levels("lv", "encoded", "grid_outcomes")
    chosen = "lv"
    extra = []
    if sentinel:
        extra, chosen = ["kept_lv AS (SELECT * FROM lv WHERE code <> -1)"], "kept_lv"
    return ot.sql(
        fx.GRID_SQL, fx.GRID_VARIANTS_SQL, GRID_PAIRED, encoded_sql(mode), ot.called("every_called", "encoded"), SINGLE_IDS,
        """called AS (SELECT c.* FROM every_called c JOIN singles USING (variant_idx)
        WHERE 1.0::DOUBLE - ((SELECT count(*) FROM grid_pairs) - n_called) / CAST((SELECT count(*) FROM grid_pairs) AS DOUBLE) >= 0.95)""",
        lv, *extra, model("fit", chosen, "called"), select=f"SELECT {P_COLUMNS} FROM fit",
    )


def _grid(spark, sf_dir):
    return fx.grid_packed(spark, sf_dir), fx.grid_samples(spark, sf_dir), fx.grid_pairs(spark, sf_dir), fx.grid_outcomes(spark, sf_dir)


def _register_grid_analyses():
    for mode in ("count", "count_directed", "pres_abs", "dr_genotype"):

        def run(spark, sf_dir, mode=mode):
            return dosage.mismatch_logistic(*_grid(spark, sf_dir), mode, scope=())

        run.__name__ = f"mismatch_logistic_{mode}"
        query(_grid_sql(mode))(run)


_register_grid_analyses()


@query(_grid_sql("count", ot.logistic_additive))
def mismatch_logistic_additive(spark, sf_dir):
    return dosage.mismatch_logistic(*_grid(spark, sf_dir), "count", model="additive", scope=())


@query(_grid_sql("count"))
def mismatch_logistic_long(spark, sf_dir):
    """The same analysis from one row per sample and variant."""
    _, samples, pr, outcomes = _grid(spark, sf_dir)
    calls = packed.unpack(fx.grid_packed_plain(spark, sf_dir), samples)
    paired = pairs.pair_calls(calls, pr, ("dosage",), packed.VARIANT_KEY)
    counts = association.code_counts(pairs.encode_pairs(paired, "count", packed.VARIANT_KEY), outcomes, dosage.OUTCOMES, packed.VARIANT_KEY)
    return dosage.logistic_from_counts(counts, fx.grid_variants(spark, sf_dir), pr.count(), scope=())


def _disease_sql():
    parts, ctes = [], [fx.GRID_SQL, fx.GRID_VARIANTS_SQL, SINGLE_IDS]
    for name, code in dosage.DISEASES.items():
        n = name.lower()
        ctes += [
            f"o_{n} AS (SELECT * FROM grid_outcomes WHERE disease = {code})",
            f"""e_{n} AS (SELECT g.chrom, g.pos, g.snp, g.variant_idx, p.case_id, g.dosage AS code
            FROM grid g JOIN grid_pairs p ON g.sample_id = p.rid JOIN o_{n} USING (case_id))""",
            ot.called(f"every_{n}", f"e_{n}"),
            f"""c_{n} AS (SELECT c.* FROM every_{n} c JOIN singles USING (variant_idx)
            WHERE 1.0::DOUBLE - ((SELECT count(*) FROM o_{n}) - n_called) / CAST((SELECT count(*) FROM o_{n}) AS DOUBLE) >= 0.95)""",
            ot.levels(f"l_{n}", f"e_{n}", f"o_{n}"),
            ot.logistic_factor(f"f_{n}", f"l_{n}", f"c_{n}"),
        ]
        parts.append(f"SELECT {P_COLUMNS}, '{name}' AS disease FROM f_{n}")
    return ot.sql(*ctes, select=" UNION ALL ".join(parts))


@query(_disease_sql())
def recipient_disease_logistic(spark, sf_dir):
    """Recipient dosage against both outcomes within each disease."""
    rows, samples, pr, outcomes = _grid(spark, sf_dir)
    return dosage.recipient_disease_logistics(rows, samples, pr, outcomes, scope=())


# --- HLA and cohort -------------------------------------------------------------------------------------------


@query(ot.sql(fx.typed_sql(fx.TYPED_LOCI), HLA_COMPARED, select="SELECT case_id, locus, code, level FROM compared"))
def locus_comparison(spark, sf_dir):
    melted = hla.melt_hla(fx.typed_cases(spark, sf_dir, hla.TYPED_LOCI, hla.typing_column), ["case_id"])
    return hla.compare_loci(melted, ["case_id"])


@query(ot.sql(fx.typed_sql(fx.CASE_LOCI), HLA_COMPARED, select=f"SELECT case_id, did, rid, {HLA_WIDE_SELECT} FROM compared GROUP BY case_id, did, rid"))
def hla_case_table(spark, sf_dir):
    return hla.hla_case_table(fx.typed_cases(spark, sf_dir, hla.CASE_LOCI, hla.case_column))


def _report_sql(klass):
    loci = hla.CLASS_LOCI[klass]
    order = "CASE locus " + " ".join(f"WHEN '{x}' THEN {k}" for k, x in enumerate(loci, 1)) + " END"
    listed = ", ".join(f"'{x}'" for x in loci)
    bucket = "substr(md5(CAST(case_id AS VARCHAR) || '|' || role), 1, 3)"
    return [
        fx.typed_sql(fx.TYPED_LOCI),
        f"""sided AS (
          SELECT case_id, 'D' AS role, did AS sample_id, locus, CAST({order} AS INTEGER) AS locus_no, d1 AS type1, d2 AS type2 FROM typed WHERE locus IN ({listed})
          UNION ALL SELECT case_id, 'R', rid, locus, CAST({order} AS INTEGER), r1, r2 FROM typed WHERE locus IN ({listed}))""",
        f"""numbered AS (
          SELECT *, CAST(sum(CASE WHEN type1 = type2 THEN 1 ELSE 2 END) OVER (
                   ORDER BY {bucket}, case_id, role, locus_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS run
          FROM sided)""",
        """report AS (
          SELECT case_id, role, sample_id, locus, locus_no, type1, type2, type1 || '+' || type2 AS glstring,
                 CASE WHEN type1 = type2 THEN run ELSE run - 1 END AS ref1, CASE WHEN type1 <> type2 THEN run END AS ref2
          FROM numbered)""",
    ]


def _report_rows(spark, sf_dir, klass):
    melted = hla.melt_hla(fx.typed_cases(spark, sf_dir, hla.TYPED_LOCI, hla.typing_column), ["case_id", "did", "rid"])
    return hla.typing_rows(melted, klass)


@query(ot.sql(*_report_sql("I"), select="SELECT * FROM report"))
def typing_report_class_one(spark, sf_dir):
    return _report_rows(spark, sf_dir, "I")


@query(
    ot.sql(
        *_report_sql("II"),
        select="SELECT *, replace(type1, locus || '*', '') AS haploid1, replace(type2, locus || '*', '') AS haploid2 FROM report",
    )
)
def typing_report_class_two(spark, sf_dir):
    return _report_rows(spark, sf_dir, "II")


def _sequences_for(rows):
    return fx.allele_sequences(rows.select(F.explode(F.array("type1", "type2")).alias("allele")))


@query(
    ot.sql(
        *_report_sql("II"), fx.SEQUENCES_SQL,
        """phases AS (
          SELECT case_id, role, sample_id, locus, locus_no, CAST(1 AS INTEGER) AS phase_set, 'ref' || CAST(ref1 AS VARCHAR) AS ref_id, type1 AS allele FROM report
          UNION ALL SELECT case_id, role, sample_id, locus, locus_no, 2, 'ref' || CAST(ref2 AS VARCHAR), type2 FROM report WHERE ref2 IS NOT NULL),
        found AS (SELECT * FROM phases JOIN seqs USING (allele))""",
        select="""SELECT case_id, role, sample_id, locus, locus_no, phase_set, ref_id, allele, exon2 AS sequence, 'false' AS continuity,
        'HLA-' || locus || ' Exon2' AS description FROM found
        UNION ALL SELECT case_id, role, sample_id, locus, locus_no, phase_set, ref_id, allele, replace(exon3, '*', ''), 'false',
        'HLA-' || locus || ' Exon3' FROM found WHERE replace(exon3, '*', '') <> ''""",
    )
)
def consensus_blocks(spark, sf_dir):
    rows = _report_rows(spark, sf_dir, "II")
    return hla.sequence_blocks(rows, _sequences_for(rows), "II")


@query(
    ot.sql(
        *_report_sql("I"),
        select="""SELECT CAST(sample_id AS BIGINT) AS sample_id, CAST(3 AS INTEGER) AS n_typings,
        string_agg(glstring, ' ' ORDER BY locus_no) AS glstrings, CAST(sum(CASE WHEN ref2 IS NULL THEN 1 ELSE 2 END) AS BIGINT) AS n_blocks
        FROM report GROUP BY case_id, role, sample_id""",
    )
)
def typing_report_xml(spark, sf_dir):
    """Nested report written as XML and read back."""
    rows = stored(_report_rows(spark, sf_dir, "I"), "typings")
    report = hla.typing_report(rows, hla.sequence_blocks(rows, _sequences_for(rows), "I"), "I")
    path = fx.new_folder(spark, "hml")
    sinks.write_hml(report, path, project="typings")
    back = spark.read.format("xml").schema(report.schema).option("rowTag", "sample").load(path)
    blocks = F.transform("typing", lambda t: F.size(t["consensus-sequence"]["consensus-sequence-block"]).cast("bigint"))
    return back.select(
        F.col("_id").alias("sample_id"),
        F.size("typing").alias("n_typings"),
        F.array_join(F.transform("typing", lambda t: t["allele-assignment"]["glstring"]), " ").alias("glstrings"),
        F.aggregate(blocks, F.lit(0).cast("bigint"), lambda a, b: a + b).alias("n_blocks"),
    )


HEADER = {"GeneratedBy": "typing service", "MessageReceived": "2018-04-01 00:00:12.345"}


@query(
    ot.sql(
        *_report_sql("II"), fx.SEQUENCES_SQL,
        """phases AS (
          SELECT sample_id, locus, 'ref' || CAST(ref1 AS VARCHAR) AS ref_id, type1 AS allele FROM report
          UNION ALL SELECT sample_id, locus, 'ref' || CAST(ref2 AS VARCHAR), type2 FROM report WHERE ref2 IS NOT NULL),
        found AS (SELECT * FROM phases JOIN seqs USING (allele))""",
        select=f"""SELECT 'property' AS kind, unnest(['{"', '".join(HEADER)}']) AS name, unnest(['{"', '".join(HEADER.values())}']) AS value
        UNION ALL SELECT 'property', 'SampleCount', CAST(count(*) AS VARCHAR) FROM (SELECT DISTINCT case_id, role, sample_id FROM report)
        UNION ALL SELECT 'HLA-' || locus || ' Exon2', CAST(sample_id AS VARCHAR) || ' ' || ref_id, exon2 FROM found
        UNION ALL SELECT 'HLA-' || locus || ' Exon3', CAST(sample_id AS VARCHAR) || ' ' || ref_id, replace(exon3, '*', '') FROM found WHERE replace(exon3, '*', '') <> ''""",
    )
)
def typing_report_document(spark, sf_dir):
    """The report as one document, parsed again: its header with the counted samples, and every sequence."""
    rows = stored(_report_rows(spark, sf_dir, "II"), "typings")
    report = hla.typing_report(rows, hla.sequence_blocks(rows, _sequences_for(rows), "II"), "II")
    path = fx.new_folder(spark, "hml-document")
    hml.write_hml_document(report, path, "typings", HEADER, ("999", "999999-2018-4-1"), "999", compressed=True)
    whole = fx.new_folder(spark, "hml-whole") + ".xml.gz"
    hml.join_document(path, whole)
    read = hml.read_hml_document(spark, whole, report.schema)
    header = read.properties.select(F.lit("property").alias("kind"), "name", "value")
    samples = read.samples
    blocks = samples.select("_id", F.explode("typing").alias("t")).select("_id", F.explode("t.consensus-sequence.consensus-sequence-block").alias("b"))
    name = F.concat_ws(" ", F.col("_id").cast("string"), F.col("b._reference-sequence-id"))
    return header.unionByName(blocks.select(F.col("b._description").alias("kind"), name.alias("name"), F.col("b.sequence").alias("value")))


@query(
    """SELECT 'F' || CAST(c_custkey AS VARCHAR) AS old_fid, 'I' || CAST(c_custkey AS VARCHAR) AS old_iid, 'F' || CAST(c_custkey AS VARCHAR) AS fid,
    'RAND' || CAST(1000000 + (c_custkey * {a} + {b}) % 9000000 AS VARCHAR) AS iid FROM customer""".format(**dict(zip("ab", cohort.affine_key(1))))
)
def randomise_ids(spark, sf_dir):
    return cohort.randomise_ids(_fam(spark, sf_dir))


# --- the flagship ------------------------------------------------------------------------------------------------


FLAGSHIP = [CALLS, PAIRS, OUTCOMES, STATUS, PAIRED, encoded_sql("count", "every"), RATES.replace("FROM encoded", "FROM every"),
            f"encoded AS (SELECT e.* FROM every e JOIN rates r USING ({KEYS}) WHERE r.call_rate >= 0.95)",
            ot.contingency("cont", "encoded", "status", (0, 1, 2)), ot.chi_square("tested", "cont", (0, 1, 2))]


@query(
    ot.sql(
        *FLAGSHIP,
        select=f"""SELECT chrom, pos, case_0, case_1, case_2, control_0, control_1, control_2, {ot.r6('stat')} AS stat, {ot.r6('p_value')} AS p_value,
        status, {ot.r6('-ln(p_value)')} AS neg_log_p FROM tested WHERE p_value > 0""",
    )
)
def mismatch_association(spark, sf_dir):
    """Pair, encode, filter by call rate, label, tabulate, test, take -ln p."""
    enc, status, repeated = _chi_inputs(spark, sf_dir)
    variants = _variants_of(spark, sf_dir)
    table = tables.contingency_at_call_rate(enc, status, n_pairs(spark, sf_dir), repeated, variants=variants)
    return association.with_neg_log_p(association.chi_square(table))


@query(
    ot.sql(
        *CROWDED, RATES,
        f"kept AS (SELECT e.* FROM encoded e JOIN rates r USING ({KEYS}) WHERE r.call_rate >= 0.8)",
        ot.contingency("cont", "kept", "status", (0, 1, 2)),
        select="SELECT * FROM cont",
    )
)
def contingency_at_call_rate(spark, sf_dir):
    """Call-rate filter and table in one pass, repeated positions variant by variant."""
    calls = fx.crowd_positions(fx.calls(spark, sf_dir))
    enc = callset.encode_alleles(pairs.pair_calls(calls, fx.pairs(spark, sf_dir), callset.ALLELES), "count")
    repeated = quality.repeated_positions(_variants_of(spark, sf_dir, fx.crowd_positions))
    return tables.contingency_at_call_rate(enc, outcome_status(spark, sf_dir), n_pairs(spark, sf_dir), repeated, min_rate=0.8)


# --- strong associations ------------------------------------------------------------------------------------------


@query(
    ot.sql(
        """items AS (SELECT l_orderkey, l_linenumber, min(l_suppkey) AS l_suppkey, min(l_returnflag) AS l_returnflag, min(l_linestatus) AS l_linestatus
        FROM lineitem GROUP BY ALL)""",
        """encoded AS (SELECT 1 AS chrom, l_suppkey AS pos, 'x' AS snp, l_suppkey AS variant_idx, l_orderkey * 10 + l_linenumber AS case_id,
        CASE WHEN l_linenumber % 5 < 2 THEN CASE l_linestatus WHEN 'F' THEN 0 ELSE 1 END WHEN l_returnflag = 'N' THEN 0 WHEN l_returnflag = 'A' THEN 1 ELSE 2 END AS code FROM items)""",
        "status AS (SELECT l_orderkey * 10 + l_linenumber AS case_id, CASE l_linestatus WHEN 'F' THEN 'case' ELSE 'control' END AS status FROM items)",
        ot.contingency("cont", "encoded", "status", (0, 1, 2)), ot.chi_square("tested", "cont", (0, 1, 2)),
        select="""SELECT pos, round(-ln(p_value), 6) + 0.0 AS neg_log_p, round(p_value * pow(10.0, floor(-log10(p_value))), 6) + 0.0 AS p_digits,
        CAST(floor(-log10(p_value)) AS INTEGER) AS p_exponent FROM tested WHERE p_value > 0 AND p_value < 1e-8""",
    )
)
def strong_associations(spark, sf_dir):
    """Far tails of the p-values, by their leading digits: a code that partly tells the line status, within each supplier."""
    names = ("l_suppkey", "l_returnflag", "l_linestatus")
    lines = fx.table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*[F.min(c).alias(c) for c in names])
    case = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("case_id")
    told = F.col("l_linenumber") % 5 < 2
    code = F.when(told, F.when(F.col("l_linestatus") == "F", 0).otherwise(1)).when(F.col("l_returnflag") == "N", 0).when(F.col("l_returnflag") == "A", 1)
    code = code.otherwise(2).cast("tinyint").alias("code")
    supplier = F.col("l_suppkey")
    enc = lines.select(F.lit(1).alias("chrom"), supplier.alias("pos"), F.lit("x").alias("snp"), supplier.alias("variant_idx"), case, code)
    status = lines.select(case, F.when(F.col("l_linestatus") == "F", "case").otherwise("control").alias("status"))
    tested = association.with_neg_log_p(association.chi_square(tables.contingency(enc, status)))
    exponent = F.floor(-F.log10("p_value"))
    found = tested.filter("p_value < 1e-8")
    return found.select("pos", "neg_log_p", (F.col("p_value") * F.pow(F.lit(10.0), exponent)).alias("p_digits"), exponent.cast("int").alias("p_exponent"))
