"""Genotype tables derived from the supplied parquet tables, for queries, tests and bench.

Each view is given twice: as a DataFrame and as SQL text for DuckDB. Integer arithmetic
only, so both engines produce the same rows.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DIMENSIONS = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- embeddings as a genotype matrix -----------------------------------------------------


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per vector (sample) and dimension (variant): dosage and two alleles."""
    cells = table(spark, sf_dir, "embeddings").selectExpr("vec_id AS sample_id", "embedding", "posexplode(embedding) AS (d, xf)")
    cells = cells.selectExpr(
        "sample_id",
        "CAST(d AS BIGINT) AS d",
        "CAST(xf AS DOUBLE) AS x",
        f"CAST(embedding[(d + 1) % {DIMENSIONS}] AS DOUBLE) AS y",
        "(sample_id * 31 + d * 17) % 97 AS noise",
    )
    return cells.selectExpr(
        "CAST(d % 22 + 1 AS INT) AS chrom",
        "16000000 + d * 7919 AS pos",
        "'rs' || CAST(1000 + CASE WHEN d >= 60 THEN d - d % 2 ELSE d END AS STRING) AS snp",
        "d AS variant_idx",
        "sample_id",
        "CAST(CASE WHEN noise >= d % 8 THEN CASE WHEN x < -0.085D THEN 0 WHEN x < 0.085D THEN 1 ELSE 2 END END AS TINYINT) AS dosage",
        "CAST(CASE WHEN noise >= d % 8 * 4 THEN CASE WHEN x < -0.10D THEN 2 WHEN x < 0.05D THEN 0 ELSE 1 END END AS TINYINT) AS a1",
        "CAST(CASE WHEN noise >= d % 8 * 4 THEN CASE WHEN y < -0.15D THEN 2 WHEN y < 0.05D THEN 0 ELSE 1 END END AS TINYINT) AS a2",
    )


CALLS_SQL = """
calls AS (
  SELECT CAST(d % 22 + 1 AS INTEGER) AS chrom, 16000000 + d * 7919 AS pos,
         'rs' || CAST(1000 + CASE WHEN d >= 60 THEN d - d % 2 ELSE d END AS VARCHAR) AS snp,
         d AS variant_idx, vec_id AS sample_id,
         CASE WHEN noise >= d % 8 THEN CASE WHEN x < -0.085 THEN 0 WHEN x < 0.085 THEN 1 ELSE 2 END END AS dosage,
         CASE WHEN noise >= d % 8 * 4 THEN CASE WHEN x < -0.10 THEN 2 WHEN x < 0.05 THEN 0 ELSE 1 END END AS a1,
         CASE WHEN noise >= d % 8 * 4 THEN CASE WHEN y < -0.15 THEN 2 WHEN y < 0.05 THEN 0 ELSE 1 END END AS a2
  FROM (SELECT vec_id, d, (vec_id * 31 + d * 17) % 97 AS noise,
               CAST(embedding[d + 1] AS DOUBLE) AS x, CAST(embedding[(d + 1) % 64 + 1] AS DOUBLE) AS y
        FROM embeddings, range(64) AS dims(d)))"""


def crowd_positions(df: DataFrame) -> DataFrame:
    """The same variants on one chromosome, every second one of the first 32 moved onto its neighbour's position."""
    v = F.col("variant_idx")
    shared = F.when(v < 32, v - v % 2).otherwise(v)
    return df.withColumns({"chrom": F.lit(22), "pos": F.lit(16000000) + shared * 7919})


CROWDED_SQL = """
crowded AS (
  SELECT CAST(22 AS INTEGER) AS chrom,
         16000000 + (CASE WHEN variant_idx < 32 THEN variant_idx - variant_idx % 2 ELSE variant_idx END) * 7919 AS pos,
         snp, variant_idx, sample_id, dosage, a1, a2
  FROM calls)"""


def annotated_variants(calls_df: DataFrame) -> DataFrame:
    """Variant table of the call set: allele number, allele counts, number of alternates seen."""
    seen = F.max(F.when(F.col("a1") == 1, 1).when(F.col("a2") == 1, 1).otherwise(0)) + F.max(
        F.when(F.col("a1") == 2, 1).when(F.col("a2") == 2, 1).otherwise(0)
    )
    return calls_df.groupBy("chrom", "pos", "snp", "variant_idx").agg(
        (F.count("a1") * 2).cast("int").alias("an"),
        (F.count_if(F.col("a1") == 1) + F.count_if(F.col("a2") == 1)).alias("ac1"),
        (F.count_if(F.col("a1") == 2) + F.count_if(F.col("a2") == 2)).alias("ac2"),
        seen.cast("int").alias("numalt"),
    )


VARIANTS_SQL = """
variants AS (
  SELECT chrom, pos, snp, variant_idx, CAST(2 * count(a1) AS INTEGER) AS an,
         count(CASE WHEN a1 = 1 THEN 1 END) + count(CASE WHEN a2 = 1 THEN 1 END) AS ac1,
         count(CASE WHEN a1 = 2 THEN 1 END) + count(CASE WHEN a2 = 2 THEN 1 END) AS ac2,
         CAST(max(CASE WHEN a1 = 1 OR a2 = 1 THEN 1 ELSE 0 END)
              + max(CASE WHEN a1 = 2 OR a2 = 2 THEN 1 ELSE 0 END) AS INTEGER) AS numalt
  FROM calls GROUP BY ALL)"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even vectors are donors, the next odd one is the recipient."""
    v = F.col("vec_id")
    return (
        table(spark, sf_dir, "embeddings")
        .filter(v % 2 == 1)
        .select((v - 1).alias("case_id"), (v - 1).alias("did"), v.alias("rid"))
    )


PAIRS_SQL = """
pairs AS (SELECT vec_id - 1 AS case_id, vec_id - 1 AS did, vec_id AS rid FROM embeddings WHERE vec_id % 2 = 1)"""


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, label = F.col("vec_id"), F.col("label")
    return (
        table(spark, sf_dir, "embeddings")
        .filter(v % 2 == 1)
        .select(
            (v - 1).alias("case_id"),
            F.when(label >= 5, 1).otherwise(0).alias("agvhi24"),
            F.when(v % 37 != 1, F.when(label >= 8, 1).otherwise(0)).alias("agvhi34"),
            F.when(v % 8 == 1, 10).when(v % 8 == 3, 20).when(v % 8 == 5, 40).otherwise(50).alias("disease"),
        )
    )


OUTCOMES_SQL = """
outcomes AS (
  SELECT vec_id - 1 AS case_id, CASE WHEN label >= 5 THEN 1 ELSE 0 END AS agvhi24,
         CASE WHEN vec_id % 37 <> 1 THEN CASE WHEN label >= 8 THEN 1 ELSE 0 END END AS agvhi34,
         CASE vec_id % 8 WHEN 1 THEN 10 WHEN 3 THEN 20 WHEN 5 THEN 40 ELSE 50 END AS disease
  FROM embeddings WHERE vec_id % 2 = 1)"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample table; the recipients with ``vec_id % 50 = 1`` are absent, so some groups are incomplete.

    The group label follows the recipient's outcome.
    """
    emb = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    v = F.col("vec_id")
    label = emb.filter(v % 2 == 1).select((v - 1).alias("group_id"), F.when(F.col("label") >= 5, "a").otherwise("n").alias("group"))
    rows = emb.filter(v % 50 != 1).select(
        (v - v % 2).alias("group_id"),
        F.when(v % 2 == 0, "D").otherwise("R").alias("subject_type"),
        v.alias("seq_id"),
        (v * 7 + 3).alias("r_d_id"),
    )
    return rows.join(label, "group_id")


SAMPLES_SQL = """
samples AS (
  SELECT s.group_id, s.subject_type, s.seq_id, s.r_d_id, g."group"
  FROM (SELECT vec_id - vec_id % 2 AS group_id, CASE WHEN vec_id % 2 = 0 THEN 'D' ELSE 'R' END AS subject_type,
               vec_id AS seq_id, vec_id * 7 + 3 AS r_d_id
        FROM embeddings WHERE vec_id % 50 <> 1) s
  JOIN (SELECT vec_id - 1 AS group_id, CASE WHEN label >= 5 THEN 'a' ELSE 'n' END AS "group"
        FROM embeddings WHERE vec_id % 2 = 1) g USING (group_id))"""


# --- customer x part as a larger matrix ----------------------------------------------------


def grid_dosage(customer: Column, part: Column) -> Column:
    h = (customer * 7919 + part * 104729 + customer * part * 31) % 1009
    return (
        F.when(h % 97 >= part % 8, F.when(h < 505, 0).when(h < 858, 1).otherwise(2)).cast("tinyint")
    )


def grid_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        (p % 22 + 1).cast("int").alias("chrom"),
        (F.lit(1000000) + p * 1013).alias("pos"),
        F.concat(F.lit("rs"), (p - F.when(p % 50 == 1, 1).otherwise(0)).cast("string")).alias("snp"),
        p.alias("variant_idx"),
    )


GRID_CELLS = 128 << 20  # dosages that a partition of the grid holds


def _grid_row(part: int | None, out) -> None:
    """Dosages of customers 0 and on for a part into ``out``, -1 where missing: ``grid_dosage`` on an array."""
    import numpy as np

    n = len(out)
    if part is None:
        out[:] = -1
        return
    # the hash is a remainder by 1009, so customers that far apart have one dosage; not so where it may be negative
    done = n if part < 0 else min(n, 1009)
    c = np.arange(done, dtype=np.int64)
    h = np.fmod(c * 7919 + part * 104729 + c * part * 31, 1009)
    out[:done] = np.where(np.fmod(h, 97) >= np.fmod(part, 8), np.where(h < 505, 0, np.where(h < 858, 1, 2)), -1)
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more]
        done += more


def grid_packed(spark: SparkSession, sf_dir: str, cells: int = GRID_CELLS) -> DataFrame:
    """One row per part (variant) with the dosages of all customers (samples) in key order.

    The part file is small and the arrays made from it are not: partitions hold about ``cells`` dosages
    each, and a task makes them where it counts them.
    """
    ship(spark)
    n, parts = table(spark, sf_dir, "customer").count(), table(spark, sf_dir, "part").count()

    @F.arrow_udf("array<tinyint>")
    def dosages(numbers):
        import numpy as np
        import pyarrow as pa

        flat = np.empty(len(numbers) * n, np.int8)
        for k, part in enumerate(numbers.to_pylist()):
            _grid_row(part, flat[k * n : (k + 1) * n])
        # some at a time, whole bytes of bits
        pieces = [np.packbits(flat[at : at + (1 << 18)] >= 0, bitorder="little") for at in range(0, len(flat), 1 << 18)]
        known = pa.py_buffer(np.concatenate([np.zeros(0, np.uint8), *pieces]))
        values = pa.Array.from_buffers(pa.int8(), len(flat), [known, pa.py_buffer(flat)])
        return pa.ListArray.from_arrays(pa.array(np.arange(len(numbers) + 1) * n, pa.int32()), values)

    tasks = max(4 * spark.sparkContext.defaultParallelism, -(-n * parts // cells))
    return grid_variants(spark, sf_dir).repartition(tasks, "variant_idx").withColumn("dosage", dosages("variant_idx"))


GRID_CELLS_LONG = 1 << 20  # the same for a reader that makes a row of each dosage


def grid_packed_plain(spark: SparkSession, sf_dir: str, cells: int = GRID_CELLS_LONG) -> DataFrame:
    """The rows of ``grid_packed`` without Python, for readers in Spark's own code: partitions by variant stay known as such.

    The hash is a remainder by 1009, so the formula runs for that many customers and its list is repeated.
    """
    n, parts = table(spark, sf_dir, "customer").count(), table(spark, sf_dir, "part").count()
    tasks = max(4 * spark.sparkContext.defaultParallelism, -(-n * parts // cells))
    first = F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(1008).cast("bigint")), lambda c: grid_dosage(c, F.col("variant_idx")))
    spread = grid_variants(spark, sf_dir).repartition(tasks, "variant_idx").withColumn("_first", first)
    return spread.withColumn("dosage", F.slice(F.flatten(F.array_repeat("_first", -(-n // 1009))), 1, n)).drop("_first")


def grid_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(c.alias("sample_id"), c.alias("sample_idx"))


def grid_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey")
    return table(spark, sf_dir, "customer").filter(c % 2 == 1).select((c - 1).alias("case_id"), (c - 1).alias("did"), c.alias("rid"))


def grid_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey")
    return (
        table(spark, sf_dir, "customer")
        .filter(c % 2 == 1)
        .select(
            (c - 1).alias("case_id"),
            F.when(F.col("c_nationkey") >= 12, 1).otherwise(0).alias("agvhi24"),
            F.when(c % 37 != 1, F.when(F.col("c_mktsegment") == "BUILDING", 1).otherwise(0)).alias("agvhi34"),
            F.when(c % 8 == 1, 10).when(c % 8 == 3, 20).when(c % 8 == 5, 40).otherwise(50).alias("disease"),
        )
    )


GRID_SQL = """
grid AS (
  SELECT CAST(p_partkey % 22 + 1 AS INTEGER) AS chrom, 1000000 + p_partkey * 1013 AS pos,
         'rs' || CAST(p_partkey - CASE WHEN p_partkey % 50 = 1 THEN 1 ELSE 0 END AS VARCHAR) AS snp,
         p_partkey AS variant_idx, c_custkey AS sample_id,
         CASE WHEN h % 97 >= p_partkey % 8 THEN CASE WHEN h < 505 THEN 0 WHEN h < 858 THEN 1 ELSE 2 END END AS dosage
  FROM (SELECT p_partkey, c_custkey,
               (c_custkey * 7919 + p_partkey * 104729 + c_custkey * p_partkey * 31) % 1009 AS h FROM part, customer)),
grid_pairs AS (
  SELECT c_custkey - 1 AS case_id, c_custkey - 1 AS did, c_custkey AS rid FROM customer WHERE c_custkey % 2 = 1),
grid_outcomes AS (
  SELECT c_custkey - 1 AS case_id, CASE WHEN c_nationkey >= 12 THEN 1 ELSE 0 END AS agvhi24,
         CASE WHEN c_custkey % 37 <> 1 THEN CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END END AS agvhi34,
         CASE c_custkey % 8 WHEN 1 THEN 10 WHEN 3 THEN 20 WHEN 5 THEN 40 ELSE 50 END AS disease
  FROM customer WHERE c_custkey % 2 = 1)"""


# --- customers as typed cases ---------------------------------------------------------------

CASE_LOCI = ("A", "B", "C", "DRB1", "DQB1", "DPB1")
TYPED_LOCI = ("A", "B", "C", "DRB1", "DRB3", "DRB4", "DRB5", "DQB1", "DQA1", "DPB1", "DPA1")


TYPED_CASES = 20_000  # customers of a partition of typed cases


def _allele(locus: str, k: int, key: str, last: str = "01") -> str:
    first, second = f"({key} * 31 + {k * 17}) % 3 + 1", f"({key} + {k}) % 5 + 1"
    return f"'{locus}*0' || CAST({first} AS STRING) || ':0' || CAST({second} AS STRING) || ':{last}'"


def _typings(locus: str, k: int) -> dict:
    """Recipient and donor alleles of one locus; every third case matches, nearly matches, differs."""
    c, own1, own2 = "c_custkey", _allele(locus, k, "c_custkey"), _allele(locus, k, "(c_custkey + 7)")
    kind = f"({c} + {k}) % 3"
    return {
        "r1": own1,
        "r2": own2,
        "d1": f"CASE WHEN {kind} < 2 THEN {own1} ELSE {_allele(locus, k, '(c_custkey + 1)')} END",
        "d2": f"CASE {kind} WHEN 0 THEN {own2} WHEN 1 THEN {_allele(locus, k, '(c_custkey + 7)', '02')} "
        f"ELSE {_allele(locus, k, '(c_custkey + 8)')} END",
    }


def typed_cases(spark: SparkSession, sf_dir: str, loci: tuple, column) -> DataFrame:
    """Wide typings, one row per customer; ``column(side, locus, n)`` names the columns."""
    columns = ["c_custkey AS case_id", "c_custkey * 2 AS did", "c_custkey * 2 + 1 AS rid"]
    for k, locus in enumerate(loci):
        columns += [f"{text} AS {column(key[0], locus, int(key[1]))}" for key, text in _typings(locus, k).items()]
    customers = table(spark, sf_dir, "customer").select("c_custkey")
    # the file is small and read in few tasks; the typings made from it are not small
    tasks = max(2 * spark.sparkContext.defaultParallelism, -(-customers.count() // TYPED_CASES))
    return customers.repartition(tasks, "c_custkey").selectExpr(*columns)


def typed_sql(loci: tuple) -> str:
    """The same typings in long form: ``case_id, did, rid, locus, r1, r2, d1, d2``."""
    listed = ", ".join(f"({k}, '{locus}')" for k, locus in enumerate(loci))

    def allele(key, last="01"):
        return (
            f"locus || '*0' || CAST(({key} * 31 + k * 17) % 3 + 1 AS VARCHAR) || ':0' || "
            f"CAST(({key} + k) % 5 + 1 AS VARCHAR) || ':{last}'"
        )

    c = "c_custkey"
    return f"""
typed AS (
  SELECT c_custkey AS case_id, c_custkey * 2 AS did, c_custkey * 2 + 1 AS rid, k, locus,
         {allele(c)} AS r1, {allele("(c_custkey + 7)")} AS r2,
         CASE WHEN (c_custkey + k) % 3 < 2 THEN {allele(c)} ELSE {allele("(c_custkey + 1)")} END AS d1,
         CASE (c_custkey + k) % 3 WHEN 0 THEN {allele("(c_custkey + 7)")} WHEN 1 THEN {allele("(c_custkey + 7)", "02")}
              ELSE {allele("(c_custkey + 8)")} END AS d2
  FROM customer, (VALUES {listed}) AS l(k, locus))"""


def allele_sequences(alleles: DataFrame) -> DataFrame:
    """A sequence table for the given alleles, made from their digests; some parts are empty."""
    digest = F.md5("allele")
    one = alleles.select("allele").distinct()
    return one.select(
        "allele",
        F.when(F.substring(digest, 1, 1) < "8", F.lit(""))
        .otherwise(F.concat(F.lit("AC|GT*"), F.substring(digest, 2, 10)))
        .alias("unaligned"),
        F.substring(digest, 5, 12).alias("exon2"),
        F.when(F.substring(digest, 3, 1) < "4", F.lit("***"))
        .otherwise(F.concat(F.lit("*"), F.substring(digest, 17, 8), F.lit("*")))
        .alias("exon3"),
    )


SEQUENCES_SQL = """
seqs AS (
  SELECT allele, CASE WHEN substr(md5(allele), 1, 1) < '8' THEN '' ELSE 'AC|GT*' || substr(md5(allele), 2, 10) END AS unaligned,
         substr(md5(allele), 5, 12) AS exon2,
         CASE WHEN substr(md5(allele), 3, 1) < '4' THEN '***' ELSE '*' || substr(md5(allele), 17, 8) || '*' END AS exon3
  FROM (SELECT DISTINCT unnest([r1, r2, d1, d2]) AS allele FROM typed))"""


# --- genes ------------------------------------------------------------------------------------


def genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s_suppkey")
    start = F.lit(1000000) + s * 15000
    return table(spark, sf_dir, "supplier").select(
        F.col("s_name").alias("gene"), (s % 22 + 1).cast("int").alias("chrom"), start.alias("start"), (start + 200000).alias("end")
    )


GENES_SQL = """
genes AS (
  SELECT s_name AS gene, CAST(s_suppkey % 22 + 1 AS INTEGER) AS chrom, 1000000 + s_suppkey * 15000 AS gene_start,
         1000000 + s_suppkey * 15000 + 200000 AS gene_end
  FROM supplier)"""

GRID_VARIANTS_SQL = """
grid_variants AS (
  SELECT CAST(p_partkey % 22 + 1 AS INTEGER) AS chrom, 1000000 + p_partkey * 1013 AS pos,
         'rs' || CAST(p_partkey - CASE WHEN p_partkey % 50 = 1 THEN 1 ELSE 0 END AS VARCHAR) AS snp,
         p_partkey AS variant_idx
  FROM part)"""


# --- files ---------------------------------------------------------------------------------------


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    from uuid import uuid4

    from genopair.session import shared_folder

    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid4().hex}"


def ship(spark: SparkSession) -> None:
    """Send this module and the package to the executors, whose tasks write the files below."""
    from genopair.session import ship_package

    if not getattr(spark.sparkContext, "_fixtures_shipped", False):
        spark.sparkContext.addPyFile(__file__)
        spark.sparkContext._fixtures_shipped = True
    ship_package(spark)


def _open_output(path: str):
    from pyarrow import fs

    filesystem, p = fs.FileSystem.from_uri(path)
    filesystem.create_dir(p.rsplit("/", 1)[0], recursive=True)
    return filesystem.open_output_stream(p)


def pack_calls(long_calls: DataFrame, values: tuple = ("dosage",)) -> DataFrame:
    """Long fixture calls to one row per variant, samples in id order."""
    fields = F.struct("sample_id", *values)
    packed = long_calls.groupBy("chrom", "pos", "snp", "variant_idx").agg(F.sort_array(F.collect_list(fields)).alias("_s"))
    return packed.select("chrom", "pos", "snp", "variant_idx", *[F.col(f"_s.{v}").alias(v) for v in values])


def write_trios(spark: SparkSession, packed: DataFrame, sample_ids: DataFrame, folder: str, parts: int = 4) -> list:
    """PLINK trios from packed dosages, one per task; returns their prefixes in variant order."""
    ship(spark)
    names = [str(r[0]) for r in sample_ids.orderBy("sample_id").select("sample_id").collect()]

    def write(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        prefix = f"{folder}/part-{TaskContext.get().partitionId():05d}"
        fam = "".join(f"F{n} {n} 0 0 0 -9\n" for n in names).encode()
        codes = {2: 0b00, None: 0b01, 1: 0b10, 0: 0b11}
        bim, bed = [], [b"\x6c\x1b\x01"]
        for batch in batches:
            for row in batch.to_pylist():
                bim.append(f"{row['chrom']}\t{row['snp']}\t0\t{row['pos']}\tA\tG\n")
                bits = np.array([codes[x] for x in row["dosage"]] + [0] * (-len(names) % 4), np.uint8).reshape(-1, 4)
                bed.append((bits << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1).astype(np.uint8).tobytes())
        if bim:
            for suffix, content in ((".fam", fam), (".bim", "".join(bim).encode()), (".bed", b"".join(bed))):
                with _open_output(prefix + suffix) as f:
                    f.write(content)
            yield pa.RecordBatch.from_pydict({"prefix": [prefix]})

    ordered = packed.repartitionByRange(parts, "variant_idx").sortWithinPartitions("variant_idx")
    return sorted(r[0] for r in ordered.mapInArrow(write, "prefix string").collect())


def write_vcf(
    spark: SparkSession, packed: DataFrame, sample_ids: DataFrame, folder: str, gzip: bool = False, backwards: bool = False, contig=None
) -> list:
    """VCF text from packed alleles: a header file and record files; returns the paths, header first.

    ``backwards`` lists the samples, and their calls, in falling order; ``contig`` names a record's contig.
    """
    if backwards:
        packed = packed.withColumns({"a1": F.reverse("a1"), "a2": F.reverse("a2")})
    header = sample_ids.agg(F.sort_array(F.collect_list("sample_id"), asc=not backwards).alias("s")).select(
        F.concat_ws("\t", F.lit("#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT"), F.col("s").cast("array<string>")).alias("value")
    )
    header.coalesce(1).write.text(f"{folder}/header")
    calls_text = F.transform(
        F.arrays_zip("a1", "a2"),
        lambda g: F.concat(
            F.coalesce(g["a1"].cast("string"), F.lit(".")), F.lit("/"), F.coalesce(g["a2"].cast("string"), F.lit(".")), F.lit(":9")
        ),
    )
    text = F.concat_ws(
        "\t",
        F.concat(F.lit("chr"), F.col("chrom").cast("string")) if contig is None else contig,
        F.col("pos").cast("string"),
        F.col("snp"),
        F.lit("A"),
        F.lit("C,G"),
        F.lit("."),
        F.lit("PASS"),
        F.concat(F.lit("AC=1,2;AN="), (F.size(F.array_compact("a1")) * 2).cast("string")),
        F.lit("GT:DP"),
        calls_text,
    )
    packed.select(text.alias("value")).write.option("compression", "gzip" if gzip else "none").text(f"{folder}/records")
    return [f"{folder}/header", f"{folder}/records"]
