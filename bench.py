"""Timings of the headline analyses; prints one JSON line.

    BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8)

The inputs that stand for genotype files (a packed Parquet call set and a PLINK trio set,
every customer as a sample and every part as a variant) are written first and not timed.
Each analysis runs twice and the better time counts, so compilation of the first run does not.
"""

import json
import os
import sys
import tempfile
import time

from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import fixture_views as fx  # noqa: E402
import registered  # noqa: E402
from genopair.plans import callset, dosage  # noqa: E402
from genopair.session import build_session  # noqa: E402
from genopair.sources import plink, sinks, tables  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def write_inputs(spark, folder):
    """Packed Parquet and PLINK trios of the customer x part matrix."""
    n = fx.table(spark, SF_DIR, "customer").count()

    def dosages(batches):
        import numpy as np
        import pyarrow as pa

        c = np.arange(n, dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                p = part.column("variant_idx").to_numpy()[:, None]
                h = (c * 7919 + p * 104729 + c * p * 31) % 1009
                cells = np.where(h < 505, 0, np.where(h < 858, 1, 2)).astype(np.int8).ravel()
                missing = (h % 97 < p % 8).ravel()
                offsets = np.arange(part.num_rows + 1, dtype=np.int32) * n
                lists = pa.ListArray.from_arrays(offsets, pa.array(cells, mask=missing))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], names=[*part.schema.names, "dosage"])

    variants = fx.grid_variants(spark, SF_DIR).repartitionByRange(4 * spark.sparkContext.defaultParallelism, "variant_idx")
    schema = "chrom int, pos bigint, snp string, variant_idx bigint, dosage array<tinyint>"
    sinks.write_packed_calls(variants.mapInArrow(dosages, schema), fx.grid_samples(spark, SF_DIR), folder)

    saved = spark.read.parquet(f"{folder}/variants")
    allele = lambda least: F.transform("dosage", lambda d: (d >= least).cast("tinyint"))
    called = F.size(F.array_compact("dosage")) * 2
    sinks.write_packed_calls(saved.select("chrom", "pos", "snp", "variant_idx", allele(2).alias("a1"), allele(1).alias("a2"), called.alias("an")), fx.grid_samples(spark, SF_DIR), f"{folder}/callset")

    names = "".join(f"F{k} {k} 0 0 0 -9\n" for k in range(n)).encode()

    def trios(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        prefix = f"{folder}/trios/part-{TaskContext.get().partitionId():05d}"
        bits = np.array([0b11, 0b10, 0b00, 0b01], np.uint8)  # by dosage, missing last
        bim, bed = [], [b"\x6c\x1b\x01"]
        for batch in batches:
            for row in range(batch.num_rows):
                bim.append("\t".join([str(batch["chrom"][row]), str(batch["snp"][row]), "0", str(batch["pos"][row]), "A", "G"]))
            cells = pc.fill_null(batch["dosage"].flatten(), 3).to_numpy(zero_copy_only=False).reshape(batch.num_rows, n)
            two = np.zeros((batch.num_rows, -(-n // 4) * 4), np.uint8)
            two[:, :n] = bits[cells]
            two = two.reshape(batch.num_rows, -1, 4)
            bed.append((two[:, :, 0] | two[:, :, 1] << 2 | two[:, :, 2] << 4 | two[:, :, 3] << 6).tobytes())
        for suffix, content in ((".fam", names), (".bim", ("\n".join(bim) + "\n").encode()), (".bed", b"".join(bed))):
            with fx._open_output(prefix + suffix) as f:
                f.write(content)
        yield pa.RecordBatch.from_pydict({"prefix": [prefix]})

    fx.ship(spark)
    packed = spark.read.parquet(f"{folder}/variants").repartitionByRange(4, "variant_idx").sortWithinPartitions("variant_idx")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "256")
    return sorted(r[0] for r in packed.mapInArrow(trios, "prefix string").collect())


def cohort_of(pairs, outcomes):
    """The pairs as a sample table, labelled by their first outcome."""
    both = F.explode(F.array(*[F.struct(F.lit(role).alias("subject_type"), F.col(c).alias("seq_id")) for role, c in (("D", "did"), ("R", "rid"))])).alias("s")
    rows = pairs.join(outcomes.select("case_id", "agvhi24"), "case_id").select(F.col("case_id").alias("group_id"), F.when(F.col("agvhi24") == 1, "a").otherwise("n").alias("group"), both)
    return rows.select("group_id", "group", "s.*")


def main():
    spark = build_session(f"local[{CPUS}]", spark__driver__memory="16g", spark__ui__showConsoleProgress="false")
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    started = time.time()
    prefixes = write_inputs(spark, folder)
    print(f"inputs written in {time.time() - started:.1f} s", file=sys.stderr)

    rest = (fx.grid_samples(spark, SF_DIR), fx.grid_pairs(spark, SF_DIR), fx.grid_outcomes(spark, SF_DIR))
    packed = tables.read_packed(spark, folder).packed
    alleles, cohort = tables.read_packed(spark, f"{folder}/callset").packed, cohort_of(rest[1], rest[2])

    def callset_association(mode):
        return lambda: callset.packed_association_log_p(alleles, rest[0], cohort, mode)

    def every_mode():
        return dosage.mismatch_logistics(packed, *rest, ("count", "count_directed", "pres_abs", "dr_genotype", "recipient"), scope=())

    def packed_logistic(mode, **kw):
        return lambda: dosage.mismatch_logistic(packed, *rest, mode, scope=(), **kw)

    def disease():
        return dosage.recipient_disease_logistic(packed, *rest, "AML", scope=())

    def from_bed():
        data = plink.read_plink(spark, prefixes)
        samples = data.samples.withColumn("sample_id", data.samples.iid.cast("bigint"))
        return dosage.mismatch_logistic(data.packed, samples, rest[1], rest[2], "count", variants=data.variants, scope=())

    def registered_query(name):
        return lambda: registered.QUERIES[name](spark, SF_DIR)

    runs = {
        "packed_logistic_count": packed_logistic("count"),
        "packed_logistic_directed": packed_logistic("count_directed"),
        "packed_logistic_dr_genotype": packed_logistic("dr_genotype"),
        "packed_logistic_additive": packed_logistic("count", model="additive"),
        "packed_recipient_disease": disease,
        "packed_logistic_every_mode": every_mode,
        "packed_callset_count": callset_association("count"),
        "packed_callset_presence": callset_association("presence"),
        "packed_callset_types": lambda: callset.packed_mismatch_type_table(alleles, rest[0], cohort),
        "bed_logistic_count": from_bed,
        **{
            name: registered_query(name)
            for name in (
                "mismatch_association",
                "callset_association_count",
                "callset_association_presence",
                "mismatch_type_frequency",
                "duplicate_id_drop",
                "gene_variants",
                "variant_lookup",
                "hla_case_table",
                "typing_report_class_one",
            )
        },
    }
    timings = {}
    for name, run in runs.items():
        best = None
        for _ in range(2):
            t = time.time()
            run().write.format("noop").mode("overwrite").save()
            best = min(time.time() - t, best or float("inf"))
        timings[name] = round(best, 3)
        print(f"{name}: {timings[name]} s", file=sys.stderr)
    print(json.dumps({"metric": "total_query_time", "value": round(sum(timings.values()), 3), "unit": "sec", "queries": timings, "sf": SF_DIR}))


if __name__ == "__main__":
    main()
