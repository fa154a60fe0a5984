import gzip
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import fixture_views as fx
from genopair.operators import cohort, contigs, hla, packed
from genopair.sources import bgzf, hml, plink, sinks, tables, vcf, vcf_blocks
from tests.conftest import rows

CODES = {2: 0b00, None: 0b01, 1: 0b10, 0: 0b11}


def write_trio(prefix, dosages, samples, chroms=None, first=0, final_newline=True):
    """PLINK trio from a list of variants; two bits per sample, lowest first."""
    lines = []
    for k in range(len(dosages)):
        chrom = chroms[k] if chroms else "1"
        lines.append(f"{chrom}\trs{first + k}{'x' * (k % 5)}\t0.5\t{1000 + 10 * k}\tA\tG")
    with open(prefix + ".bim", "w") as f:
        f.write("\n".join(lines) + ("\n" if final_newline and lines else ""))
    with open(prefix + ".fam", "w") as f:
        f.writelines(f"F{s} {s}  0 0 1 -9\n" for s in samples)
    with open(prefix + ".bed", "wb") as f:
        f.write(b"\x6c\x1b\x01")
        for row in dosages:
            out = bytearray(-(-len(row) // 4))
            for i, d in enumerate(row):
                out[i // 4] |= CODES[d] << (2 * (i % 4))
            f.write(bytes(out))


@pytest.fixture(scope="module")
def dosages():
    rng = np.random.default_rng(2)
    return [[None if x == 3 else int(x) for x in rng.integers(0, 4, 13)] for _ in range(700)]


@pytest.mark.parametrize("newline", [True, False])
def test_bed_round_trip_in_many_tasks(spark, folder, dosages, newline):
    prefix = f"{folder}/g"
    write_trio(prefix, dosages, [f"s{k}" for k in range(13)], [str(1 + k // 100) for k in range(700)], final_newline=newline)
    data = plink.read_plink(spark, prefix, target_bytes=1)
    assert data.packed.rdd.getNumPartitions() > 3
    got = data.packed.orderBy("variant_idx").collect()
    assert [r.dosage for r in got] == dosages
    assert [r.variant_idx for r in got] == list(range(700))
    assert [r.pos for r in got] == [1000 + 10 * k for k in range(700)]
    assert got[3].snp == "rs3xxx" and got[3].a1 == "A" and got[3].cm == 0.5
    assert [r.sample_id for r in data.samples.orderBy("i").collect()] == [f"s{k}" for k in range(13)]
    other = plink.read_plink(spark, prefix, count_allele="a2").packed.orderBy("variant_idx").first().dosage
    assert other == [None if d is None else 2 - d for d in dosages[0]]


def test_bed_block_and_row_skipping(spark, folder, dosages):
    prefix = f"{folder}/g"
    write_trio(prefix, dosages, [f"s{k}" for k in range(13)], [str(1 + k // 100) for k in range(700)])
    some = plink.read_plink(spark, prefix, chroms=[2, 3], target_bytes=1)
    assert [r.variant_idx for r in some.packed.orderBy("variant_idx").collect()] == list(range(100, 300))
    assert some.packed.rdd.getNumPartitions() < plink.read_plink(spark, prefix, target_bytes=1).packed.rdd.getNumPartitions()
    region = plink.read_plink(spark, prefix, region=(3, 3100, 3200)).packed.orderBy("variant_idx").collect()
    assert [r.variant_idx for r in region] == list(range(210, 221)) and region[0].dosage == dosages[210]
    assert plink.read_plink(spark, prefix, chroms=[21]).packed.count() == 0
    assert plink.read_plink(spark, prefix).variants.count() == 700


def test_bed_filters_reach_the_reader(spark, folder, dosages):
    prefix = f"{folder}/g"
    write_trio(prefix, dosages, [f"s{k}" for k in range(13)], [str(1 + k // 100) for k in range(700)])
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        packed_ = plink.read_plink(spark, prefix, target_bytes=1).packed
        whole = packed_.rdd.getNumPartitions()
        for condition, want in (
            ("chrom = 3", range(200, 300)),
            ("chrom IN (2, 7)", [*range(100, 200), *range(600, 700)]),
            ("chrom > 6", range(600, 700)),
            ("chrom >= 6 AND chrom < 7", range(500, 600)),
            ("chrom <= 1", range(0, 100)),
            ("chrom = 3 AND pos BETWEEN 3100 AND 3200", range(210, 221)),
            ("pos = 1010", [1]),
            ("chrom = 40", []),
        ):
            some = packed_.filter(condition)
            assert some.rdd.getNumPartitions() < whole, condition
            assert sorted(r.variant_idx for r in some.collect()) == list(want), condition
        assert packed_.filter("snp = 'rs5'").count() == 1
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_several_trios(spark, folder, dosages, caplog):
    names = [f"s{k}" for k in range(13)]
    write_trio(f"{folder}/1", dosages[:300], names, ["1"] * 300)
    write_trio(f"{folder}/X", dosages[300:], names, ["X"] * 400, first=300)
    data = plink.read_plink(spark, [f"{folder}/1", f"{folder}/2", f"{folder}/X"])
    assert f"{folder}/2.bed" in caplog.text
    got = data.packed.orderBy("variant_idx").collect()
    assert [r.dosage for r in got] == dosages and {r.chrom for r in got} == {1, 23}
    with pytest.raises(FileNotFoundError):
        plink.read_plink(spark, [f"{folder}/1", f"{folder}/2"], missing_ok=False)
    with pytest.raises(FileNotFoundError):
        plink.read_plink(spark, f"{folder}/2")
    write_trio(f"{folder}/3", dosages[:5], names[::-1])
    with pytest.raises(ValueError, match="same samples"):
        plink.read_plink(spark, [f"{folder}/1", f"{folder}/3"])
    with open(f"{folder}/3.bed", "ab") as f:
        f.write(b"x")
    with pytest.raises(ValueError, match="variant-major"):
        plink.read_plink(spark, f"{folder}/3")
    with pytest.raises(ValueError):
        plink.read_plink(spark, f"{folder}/1", count_allele="b")


def test_lines_are_split_without_loss(folder):
    path = f"{folder}/t"
    text = b"".join(b"%d" % (10**k) + b"\n" for k in range(0, 12)) + b"end"
    open(path, "wb").write(text)
    for block in (1, 2, 3, 7, 1000):
        parts = [plink.whole_lines(path, s, min(s + block, len(text)), step=3) for s in range(0, len(text), block)]
        assert b"".join(t for _, t in parts) == text
        assert all(text[at : at + len(t)] == t for at, t in parts if t)


def test_plink_to_parquet(spark, folder, dosages):
    write_trio(f"{folder}/g", dosages[:50], [f"s{k}" for k in range(13)], [str(k % 3) for k in range(50)])
    sinks.plink_to_parquet(spark, f"{folder}/g", f"{folder}/out")
    saved = spark.read.parquet(f"{folder}/out/variants")
    assert [r.dosage for r in saved.orderBy("variant_idx").collect()] == dosages[:50]
    assert spark.read.parquet(f"{folder}/out/samples").count() == 13


def test_packed_row_groups_stay_small(spark, folder):
    import glob

    import pyarrow.parquet as pq

    n, m = 20000, 1200
    rows_ = spark.range(0, m, 1, 1).select(
        F.lit(1).alias("chrom"),
        F.col("id").alias("variant_idx"),
        F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: F.pmod(F.hash(k, F.col("id")), F.lit(3)).cast("tinyint")).alias("dosage"),
    )
    samples = spark.range(n).select(F.col("id").cast("string").alias("sample_id"), F.col("id").alias("sample_idx"))
    sinks.write_packed_calls(rows_, samples, f"{folder}/c")
    (path,) = glob.glob(f"{folder}/c/variants/chrom=1/*.parquet")
    meta = pq.ParquetFile(path).metadata
    assert max(meta.row_group(k).num_rows for k in range(meta.num_row_groups)) * n <= 32_000_000
    saved = tables.read_packed(spark, f"{folder}/c", chroms=(1, 1))
    assert saved.packed.count() == m and saved.samples.count() == n


VCF = """##fileformat=VCFv4.2
##contig=<ID=chr1>
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tA\tB\tC
chr1\t100\trs1\tA\tC\t.\tPASS\tDP=3;AC=2;AN=6\tGT:DP\t0/1:4\t1|1:5\t./.:0
X\t200\t.\tA\tC,G\t.\tPASS\tAN=4;AC=1,1\tDP:GT\t3:0/2\t2:1\t1:2|1
chrUn_1\t300\trs3\tA\t.\t.\tPASS\t.\tGT\t0/0\t.\t0|.
"""


@pytest.mark.parametrize("suffix", [".vcf", ".vcf.gz"])
def test_vcf(spark, folder, suffix):
    path = f"{folder}/a{suffix}"
    with (gzip.open(path, "wt") if suffix.endswith("gz") else open(path, "w")) as f:
        f.write(VCF)
    data = vcf.read_vcf(spark, path)
    got = {r.pos: r for r in data.packed.collect()}
    assert [r.sample_id for r in data.samples.orderBy("sample_idx").collect()] == ["A", "B", "C"]
    assert (got[100].a1, got[100].a2) == ([0, 1, None], [1, 1, None])
    assert (got[200].a1, got[200].a2) == ([0, 1, 2], [2, None, 1])
    assert (got[300].a1, got[300].a2) == ([0, None, 0], [0, None, None])
    assert [got[p].chrom for p in (100, 200, 300)] == [1, 23, contigs.CONTIG_BASE]
    assert rows(data.contigs) == [("X", 23), ("chr1", 1), ("chrUn_1", contigs.CONTIG_BASE)]
    assert [got[p].variant_idx for p in (100, 200, 300)] == [0, 1, 2] and got[300].contig == "chrUn_1"
    assert (got[100].an, got[100].ac, got[100].numalt) == (6, [2], 1)
    assert (got[200].alt, got[200].ac, got[200].numalt) == (["C", "G"], [1, 1], 2)
    assert (got[300].alt, got[300].an, got[300].ac, got[300].numalt) == ([], None, None, 0)
    long = packed.unpack(data.packed, data.samples, ("a1", "a2"), ["pos"])
    assert rows(long.filter("pos = 200"), "sample_id", "a1", "a2") == [("A", 0, 2), ("B", 1, None), ("C", 2, 1)]


def test_vcf_samples_are_matched_by_name(spark, folder):
    lines = VCF.splitlines(keepends=True)
    turned = lines[2].replace("A\tB\tC", "C\tA\tB")
    for name, header in (("a", lines[2]), ("b", turned), ("c", lines[2].replace("\tC", "\tD"))):
        with open(f"{folder}/{name}.vcf", "w") as f:
            f.write("".join([*lines[:2], header, *lines[3:]]))
    with open(f"{folder}/d.vcf", "w") as f:
        f.write("".join(lines[3:]))
    data = vcf.read_vcf(spark, [f"{folder}/{n}.vcf" for n in "abd"])
    got = sorted((r.variant_idx, r.pos, tuple(r.a1)) for r in data.packed.collect())
    assert [g[0] for g in got] == list(range(9))
    assert sorted(g[2] for g in got if g[1] == 200) == sorted([(0, 1, 2), (0, 1, 2), (1, 2, 0)])
    with pytest.raises(ValueError, match="other samples"):
        vcf.read_vcf(spark, [f"{folder}/a.vcf", f"{folder}/c.vcf"])
    with pytest.raises(Exception, match="another #CHROM line"):
        vcf.read_vcf(spark, f"{folder}/[ab].vcf").packed.collect()


def test_vcf_region_leaves_other_records_alone(spark, folder):
    with open(f"{folder}/a.vcf", "w") as f:
        f.write(VCF + "chr9\tx\n" + "chr1\t5000\tshort\n")
    assert [r.pos for r in vcf.read_vcf(spark, f"{folder}/a.vcf", region=(1, 50, 400)).packed.collect()] == [100]
    assert [r.pos for r in vcf.read_vcf(spark, f"{folder}/a.vcf", chroms=[23]).packed.collect()] == [200]


NAMES = ["1", "chrX", "MT", "GL000192.1", "chrUn_1", "HLA-A*01:01", "scaffold_x", "Scaffold_X", "SCAF_HASH_A", "SCAF_HASH_B", "", "12345678"]


def test_other_contigs_have_numbers_of_their_own(spark):
    df = spark.createDataFrame([(n,) for n in NAMES + NAMES], "contig string")
    found = contigs.contig_dictionary(df)
    of = dict(rows(found))
    assert len(of) == found.count() == len(NAMES) - 1 and (of["1"], of["chrX"], of["MT"]) == (1, 23, 26)
    others = [of[n] for n in NAMES if n in of and contigs.chromosome_number(n) is None]
    assert sorted(others) == list(range(contigs.CONTIG_BASE, contigs.CONTIG_BASE + len(others)))
    # more names leave the numbers alone
    more = contigs.contig_dictionary(df.unionByName(spark.createDataFrame([("new",), ("X",)], "contig string")), found)
    assert dict(rows(more)) == of | {"new": max(others) + 1, "X": 23}
    back = contigs.with_contig(contigs.with_chrom(df.withColumnRenamed("contig", "c"), more, F.col("c")).where("c <> 'X'"), more)
    assert all(r.contig == r.c or r.c == "chrX" for r in back.collect() if r.c)
    assert [r.chrom for r in contigs.with_chrom(df, found.where("contig = '1'"), F.col("contig")).where("contig = 'MT'").collect()] == [26, 26]


def test_plink_contigs_by_name(spark, folder):
    names = ["scaffold_x", "Scaffold_X", "1", "chr1", "chrUn"]
    write_trio(f"{folder}/g", [[k % 3] * 4 for k in range(10)], "abcd", [names[k % 5] for k in range(10)])
    data = plink.read_plink(spark, f"{folder}/g")
    of = dict(rows(data.contigs))
    assert of["1"] == of["chr1"] == 1 and len(set(of.values())) == 4
    assert [r.chrom for r in data.packed.orderBy("variant_idx").collect()] == [of[names[k % 5]] for k in range(10)]
    only = plink.read_plink(spark, f"{folder}/g", chroms=[of["Scaffold_X"]], contigs=data.contigs)
    assert [r.variant_idx for r in only.variants.orderBy("variant_idx").collect()] == [1, 6] and dict(rows(only.contigs)) == of


def test_a_call_set_grows_by_files_with_new_contigs(spark, folder):
    def file(name, contigs_):
        with open(f"{folder}/{name}.vcf", "w") as f:
            f.write("#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tA\tB\n")
            f.writelines(f"{c}\t{10 + k}\trs\tA\tC\t.\t.\t.\tGT\t0/1\t1/1\n" for k, c in enumerate(contigs_))
        return f"{folder}/{name}.vcf"

    sinks.vcf_to_parquet(spark, file("a", ["one", "two", "1"]), f"{folder}/c")
    saved = tables.read_packed(spark, f"{folder}/c")
    more = vcf.read_vcf(spark, file("b", ["ONE", "two", "three"]), contigs=saved.contigs)
    sinks.add_packed_calls(more.packed, more.samples, more.contigs, f"{folder}/c")
    whole = tables.read_packed(spark, f"{folder}/c")
    of = dict(rows(whole.contigs))
    assert len(set(of.values())) == 5 and rows(saved.contigs) == rows(whole.contigs.where("contig IN ('one', 'two', '1')"))
    got = [(r.variant_idx, r.chrom) for r in whole.packed.orderBy("variant_idx").collect()]
    assert got == list(enumerate(of[n] for n in ("one", "two", "1", "ONE", "two", "three")))
    with pytest.raises(ValueError, match="other samples"):
        sinks.add_packed_calls(more.packed, more.samples.limit(1), more.contigs, f"{folder}/c")
    sinks.write_packed_calls(saved.packed, saved.samples, f"{folder}/bare")
    assert tables.read_packed(spark, f"{folder}/bare").contigs.count() == 0


def block_file(path, text, size, level=6):
    with open(path, "wb") as f:
        f.write(b"".join(bgzf.compress(text[at : at + size], level) for at in range(0, len(text), size)) + bgzf.END_OF_FILE)


@pytest.mark.parametrize("size", [5, 23, 1000])
@pytest.mark.parametrize("end", [b"", b"\n"])
def test_ranges_of_blocks_give_each_line_once(folder, size, end):
    text = b"\n".join(b"%d" % (k * 7919 ** (k % 5)) for k in range(120)) + b"\n\n" + b"x" * 300 + b"\nlast" + end
    path = f"{folder}/a.gz"
    block_file(path, text, size)
    with gzip.open(path) as f:
        assert f.read() == text
    whole = text.split(b"\n")[: -1 if end else None]
    total = bgzf.file_size(path)
    for step in (1, 17, 64, 500, total):
        got = [x for at in range(0, total, step) for group in bgzf.lines(bgzf.Blocks(path), at, min(at + step, total)) for x in group]
        assert got == whole


def test_bytes_that_look_like_a_block_are_none(folder):
    fake = bgzf.compress(b"inner")[:18]
    path = f"{folder}/a.gz"
    block_file(path, fake * 40 + b"\n", 100, level=0)
    starts = [at for at, _ in bgzf.Blocks(path).from_(0)]
    size = bgzf.file_size(path)
    assert [bgzf.Blocks(path).first_from(at) for at in range(size)] == [min([s for s in starts if s >= at], default=size) for at in range(size)]
    assert not bgzf.is_block_gzip(gzip.compress(b"plain")) and bgzf.is_block_gzip(bgzf.END_OF_FILE)


def test_the_index_finds_all_records_of_a_region(folder):
    """A random table against brute force, through the written index."""
    rng = np.random.default_rng(1)
    records = sorted((f"c{rng.integers(3)}", int(rng.integers(1, 3_000_000)), int(rng.integers(1, 90_000))) for _ in range(3000))
    text, places = b"#CHROM\n", []
    for name, pos, length in records:
        places.append(len(text))
        text += b"%s\t%d\t%d\n" % (name.encode(), pos, length)
    path = f"{folder}/a.gz"
    block_file(path, text, 700)
    starts = [(at, k * 700) for k, (at, _) in enumerate(bgzf.Blocks(path).from_(0))]
    virtual = lambda at: starts[at // 700][0] << 16 | at % 700
    builder = bgzf.IndexBuilder()
    for (name, pos, length), at, after in zip(records, places, [*places[1:], len(text)]):
        builder.add(name, pos - 1, pos - 1 + length, virtual(at), virtual(after) if after < len(text) else starts[-1][0] << 16)
    index = bgzf.Index(builder.content())
    assert index.names == ["c0", "c1", "c2"] and index.chunks("none", 0, 10) == []
    for name, start, length in [("c0", 0, 10), ("c1", 1_000_000, 5), ("c2", 1_500_000, 60_000), ("c0", 0, 1 << 29), ("c1", 2_999_999, 1), ("c2", 5_000_000, 10)]:
        want = {r for r in records if r[0] == name and r[1] - 1 < start + length and r[1] - 1 + r[2] > start}
        got, read = [], 0
        for a, b in index.chunks(name, start, start + length):
            blocks = bgzf.Blocks(path)
            got += [tuple(x.decode().split("\t")) for group in bgzf.lines(blocks, a >> 16, b >> 16, a & 0xFFFF, b & 0xFFFF) for x in group]
            read += blocks.read
        assert len(got) == len(set(got)) and want <= {(n, int(p), int(k)) for n, p, k in got}
        assert length > 100_000 or read < len(starts) / 4


def blocks_folder(spark, folder, n=400):
    data = [(f"chr{1 + k % 3}", 100 + 37 * k, f"rs{k}", ["C"], [k % 2, 1, None], [1, k % 3, None]) for k in range(n)]
    rows_ = spark.createDataFrame(data, "contig string, pos bigint, snp string, alt array<string>, a1 array<tinyint>, a2 array<tinyint>")
    samples = spark.createDataFrame([(0, "A"), (1, "B"), (2, "C")], "sample_idx bigint, sample_id string")
    sinks.write_vcf(rows_, samples, f"{folder}/v", parts=2, block_bytes=256)
    return {d[2]: d for d in data}


def test_block_gzip_vcf_in_many_tasks(spark, folder):
    import glob
    import os

    want = blocks_folder(spark, folder)
    assert sorted(os.listdir(f"{folder}/v")) == sorted(os.path.basename(f) for f in glob.glob(f"{folder}/v/part-*.vcf.gz*")) and len(glob.glob(f"{folder}/v/*.tbi")) == 2
    one = sorted(glob.glob(f"{folder}/v/*.gz"))
    for path, share in ((f"{folder}/v", 1.0), (one[0], None), (one, 1.0)):
        data = vcf.read_vcf(spark, path, range_bytes=1000)
        assert data.packed.rdd.getNumPartitions() > 4
        got = data.packed.collect()
        assert sorted(r.variant_idx for r in got) == list(range(len(got))) and (share is None or len(got) == len(want))
        assert all((r.contig, r.pos, r.alt, r.a1, r.a2) == (want[r.snp][0], want[r.snp][1], ["C"], *want[r.snp][4:]) for r in got)
        assert {r.chrom for r in got} <= {1, 2, 3} and [r.sample_id for r in data.samples.orderBy("sample_idx").collect()] == ["A", "B", "C"]
    with pytest.raises(Exception, match="no task"):
        spark.dataSource.register(vcf_blocks.BlockVcfSource)
        bad = spark.range(10, numPartitions=2).select(F.lit("1").alias("contig"), F.col("id").alias("pos"), F.when(F.col("id") < 8, "1\t2\t3\t4\t5").otherwise(F.raise_error(F.lit("no task"))).alias("value"))
        vcf_blocks.write_blocks(bad, "#h\n", f"{folder}/bad")
    assert not os.path.exists(f"{folder}/bad") or os.listdir(f"{folder}/bad") == []


def test_a_region_reads_few_blocks(spark, folder):
    want = blocks_folder(spark, folder, 2000)
    files = vcf_blocks.data_files([f"{folder}/v"])
    total = sum(len(list(bgzf.Blocks(f).from_(0))) for f in files)
    for region in ((2, 20_000, 21_000), ("chr3", 100, 400), (1, 70_000, 90_000), (9, 1, 100), (1, 1, 1 << 40)):
        number = region[0] if isinstance(region[0], int) else 3
        data = vcf.read_vcf(spark, f"{folder}/v", region=region, range_bytes=2000)
        expected = sorted(d[1] for d in want.values() if d[0] == f"chr{number}" and region[1] <= d[1] <= region[2])
        assert sorted(r.pos for r in data.packed.collect()) == expected
        ranges = vcf_blocks.region_ranges(files, lambda n: contigs.chromosome_number(n) == number, region[1], region[2], 2000)
        read = 0
        for k, lo, hi, skip, stop in ranges:
            blocks = bgzf.Blocks(files[k])
            list(bgzf.lines(blocks, lo, hi, skip, stop))
            read += blocks.read
        assert region[2] > 50_000 or read <= total / 8
    # without an index everything is read, and the same rows come out
    one = sorted(files)[0]
    import shutil

    shutil.copy(one, f"{folder}/bare.vcf.gz")
    bare = vcf.read_vcf(spark, f"{folder}/bare.vcf.gz", region=(1, 100, 30_000)).packed
    assert rows(bare, "pos", "snp") == rows(vcf.read_vcf(spark, one, region=(1, 100, 30_000)).packed, "pos", "snp")


def test_headers_of_many_files_in_one_job(spark, folder):
    for k in range(30):
        with open(f"{folder}/{k:02d}.vcf", "w") as f:
            f.write(VCF)
    tracker, sc = spark.sparkContext.statusTracker(), spark.sparkContext
    sc.setJobGroup("headers", "headers")
    groups, names = vcf._groups(spark, [f"{folder}/{k:02d}.vcf" for k in range(30)], False)
    jobs = len(tracker.getJobIdsForGroup("headers"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert names == ["A", "B", "C"] and [len(g) for g in groups.values()] == [30] and jobs <= 3


def test_tasks_of_the_bed_reader_do_not_carry_the_blocks(folder):
    import json
    import pickle

    sizes = []
    for n in (10, 10_000):
        path = f"{folder}/index-{n}.json"
        with open(path, "w") as f:
            f.write(json.dumps({"prefixes": ["p"], "blocks": [[0, 4, k, 1, k, 0, {"1": 1}, 1, 2] for k in range(n)]}))
        reader = plink.BedReader({"index": path})
        assert len(reader.partitions()) == n
        sizes.append(len(pickle.dumps(reader)))
    assert sizes[0] == sizes[1]


def test_shared_folder_must_be_named_on_a_cluster():
    from types import SimpleNamespace

    from genopair.session import shared_folder

    for master, ok in (("local[8]", True), ("local", True), ("spark://host:7077", False), ("local-cluster[3,2,1000]", False), ("yarn", False)):
        held = {}
        session = SimpleNamespace(conf=SimpleNamespace(get=held.get, set=held.__setitem__), sparkContext=SimpleNamespace(master=master))
        if ok:
            assert shared_folder(session) == held["spark.checkpoint.dir"]
        else:
            with pytest.raises(ValueError):
                shared_folder(session)


def test_first_row_is_that_of_the_first_file(spark, folder):
    head = "bmt_case_num,nmdp_rid,nmdp_did\n"
    with open(f"{folder}/a.csv", "w") as f:
        f.write(head + "7,111111111,222222222\n")
    with open(f"{folder}/b.csv", "w") as f:
        f.write(head + "".join(f"{k},333333333,444444444\n" for k in range(5000)))
    got = {r.case_id: r.rid for r in tables.read_cases(spark, [f"{folder}/a.csv", f"{folder}/b.csv"]).collect()}
    assert len(got) == 5000 and got["7"] != got["8"]


def test_vcf_refuses_short_records(spark, folder):
    with open(f"{folder}/a.vcf", "w") as f:
        f.write(VCF + "chr1\t400\trs4\tA\tC\t.\tPASS\t.\tGT\t0/0\n")
    with pytest.raises(Exception, match="wrong number of fields"):
        vcf.read_vcf(spark, f"{folder}/a.vcf").packed.collect()
    with open(f"{folder}/b.vcf", "w") as f:
        f.write("##nothing\n")
    with pytest.raises(ValueError):
        vcf.read_vcf(spark, f"{folder}/b.vcf")


def test_gene_files(spark, folder):
    for name, text in (("1_IL10.vcf", "a,b\nc"), ("2_IL10.vcf", "d"), ("1_IL2.vcf", "no")):
        open(f"{folder}/{name}", "w").write(text)
    got = vcf.read_gene_files(spark, folder, "IL10")
    assert rows(got, "file_name", "line") == [("1_IL10.vcf", "a,b"), ("1_IL10.vcf", "c"), ("2_IL10.vcf", "d")]
    assert got.filter("line = 'a,b'").first().fields == ["a", "b"]


def test_case_and_outcome_files(spark, folder):
    open(f"{folder}/c.csv", "w").write(
        "nmdp_rid,nmdp_did,bmt_case_num,agvhi24,agvhi34,disease\n1,2,100,1,0,10\n3,4,100,0,,20\n55555555,6,007,NA,1,30\n"
    )
    assert rows(tables.read_cases(spark, f"{folder}/c.csv")) == [
        ("007", "0000-0000-6", "555-555-55"),
        ("100", "0000-0000-2", "000-000-1"),
    ]
    got = tables.read_outcomes(spark, f"{folder}/c.csv")
    assert rows(got, "case_id", "agvhi24", "agvhi34", "disease") == [("007", None, 1, 30), ("100", 0, None, 20), ("100", 1, 0, 10)]
    open(f"{folder}/s.csv", "w").write("GroupID,Group,subjectType,SeqID,R_D_ID,extra\n1,a,D,9,77,z\n")
    s = tables.read_samples(spark, f"{folder}/s.csv")
    assert s.columns == ["group_id", "group", "subject_type", "seq_id", "r_d_id"]
    assert rows(cohort.rename_manifest(s)) == [("a_1_D_77.vcf.gz", "SEQ9.vcf.gz"), ("a_1_D_77.vcf.gz.tbi", "SEQ9.vcf.gz.tbi")]


def test_encoded_files_by_name_and_by_folder(spark, folder):
    import os

    import pyarrow as pa
    import pyarrow.parquet as pq

    for chrom in ("1", "22"):
        pq.write_table(pa.table({"pos": pa.array([5], pa.int64()), "code": pa.array([1], pa.int8())}), f"{folder}/chr{chrom}_EncodedMatrix.parquet")
    assert rows(tables.read_encoded(spark, folder), "chrom", "pos") == [(1, 5), (22, 5)]
    assert tables.read_encoded(spark, folder, chroms=(20, 22)).count() == 1
    data = [("count", c, p, 0, f"c{k}", 1) for c in (1, 2) for p in (3, 1, 2) for k in range(3)]
    enc = spark.createDataFrame(data, "mode string, chrom int, pos bigint, variant_idx bigint, case_id string, code tinyint")
    sinks.write_encoded(enc, f"{folder}/m")
    back = tables.read_encoded(spark, f"{folder}/m", chroms=(2, 2))
    assert back.count() == 9 and os.path.isdir(f"{folder}/m/mode=count/chrom=2")
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "chrom" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_pvalue_formats(spark, folder):
    df = spark.createDataFrame([(1, 5, 0.25), (2, 6, None)], "chrom int, pos bigint, p_value double")
    sinks.write_pvalues(df, f"{folder}/p")
    sinks.write_pvalues(df, f"{folder}/c", "csv")
    assert rows(spark.read.parquet(f"{folder}/p"), "chrom", "pos", "p_value") == rows(df)
    assert rows(spark.read.schema(df.schema).csv(f"{folder}/c", header=True)) == rows(df)
    with pytest.raises(ValueError):
        sinks.write_pvalues(df, f"{folder}/x", "h5")


def test_typing_report_xml(spark, folder):
    loci = hla.CLASS_LOCI["II"]
    data = [("c1", "d1", "r1") + ("DRB1*01:01", "DRB1*01:01", "DRB1*01:01", "DRB1*03:01", "DQB1*02:01", "DQB1*02:02", "DQB1*02:02", "DQB1*02:02")]
    names = ["case_id", "did", "rid"] + [hla.typing_column(s, locus, n) for locus in loci for s in ("r", "d") for n in (1, 2)]
    wide = spark.createDataFrame(data, names)
    melted = hla.melt_hla(wide, ["case_id", "did", "rid"], loci)
    report = hla.typing_rows(melted, "II").orderBy("ref1").collect()
    refs = [x for r in report for x in (r.ref1, r.ref2) if x is not None]
    assert refs == list(range(1, 7))
    assert {(r.sample_id, r.locus): r.glstring for r in report}[("d1", "DRB1")] == "DRB1*01:01+DRB1*03:01"
    assert {(r.sample_id, r.locus): r.haploid2 for r in report}[("d1", "DRB1")] == "03:01"
    seqs = spark.createDataFrame(
        [("DRB1*01:01", "", "AAA", "*CC*"), ("DRB1*03:01", "", "GGG", "***"), ("DQB1*02:01", "", "T", ""), ("DQB1*02:02", "", "TT", "C")],
        "allele string, unaligned string, exon2 string, exon3 string",
    )
    rows_ = hla.typing_rows(melted, "II")
    nested = hla.typing_report(rows_, hla.sequence_blocks(rows_, seqs, "II"), "II")
    sinks.write_hml(nested, f"{folder}/hml", project="p", version="0.0.1")
    text = "".join(open(f"{folder}/hml/{f}").read() for f in __import__("os").listdir(f"{folder}/hml") if f.startswith("part"))
    assert '<hml project-name="p" version="0.0.1">' in text and '<sample center-code="888" id="d1">' in text
    back = spark.read.format("xml").schema(nested.schema).option("rowTag", "sample").load(f"{folder}/hml")
    assert rows(back.select("_id", F.size("typing").alias("n"))) == [("d1", 2), ("r1", 2)]
    d1 = back.filter("_id = 'd1'").first().typing[0]["consensus-sequence"]
    assert [b["sequence"] for b in d1["consensus-sequence-block"]] == ["AAA", "CC", "GGG"]
    assert len(d1["reference-database"]) == 2


def test_fixture_files_equal_fixture_calls(spark, folder, sf_dir):
    calls = fx.calls(spark, sf_dir)
    want = rows(calls.select("variant_idx", F.col("sample_id").cast("string").alias("sample_id"), "a1", "a2"))
    paths = fx.write_vcf(spark, fx.pack_calls(calls, ("a1", "a2")), calls.select("sample_id").distinct(), folder, gzip=True)
    data = vcf.read_vcf(spark, paths, compressed=True)
    got = packed.unpack(data.packed.withColumn("variant_idx", ((F.col("pos") - 16000000) / 7919).cast("bigint")), data.samples, ("a1", "a2"), ["variant_idx"])
    assert rows(got) == want


def test_broken_rows_are_told_with_their_place(spark, folder):
    with open(f"{folder}/a.csv", "w") as f:
        f.write("a,b,c\n1,2,x\n3,4\n5,6,y,z\n7,seven,w\n8,9,\n")
    with open(f"{folder}/b.csv", "w") as f:
        f.write("a,b,c\n10,11,\"q,r\"\n")
    read = tables.read_checked(spark, f"{folder}/*.csv", "a int, b int, c string", most_broken=0.5)
    assert rows(read.rows) == [(1, 2, "x"), (8, 9, None), (10, 11, "q,r")]
    assert sorted(r.a for r in read.rows.select("a").collect()) == [1, 8, 10] and read.rows.count() == 3
    got = [(r.file.rsplit("/", 1)[1], r.block, r.line, r.reason, r.text) for r in read.broken.orderBy("line").collect()]
    assert got == [("a.csv", 0, 1, "short", "3,4"), ("a.csv", 0, 2, "long", "5,6,y,z"), ("a.csv", 0, 3, "unparsable", "7,seven,w")]
    with pytest.raises(ValueError, match="3 of 6"):
        tables.read_checked(spark, f"{folder}/*.csv", "a int, b int, c string", most_broken=0.4)
    clean = tables.read_checked(spark, f"{folder}/b.csv", "a int, b int, c string", quarantine=f"{folder}/q")
    assert clean.broken.count() == 0 and clean.rows.count() == 1 and spark.read.parquet(f"{folder}/q").count() == 0


def test_other_sample_orders_stay_out_of_the_plan(spark, folder):
    """Files that list their samples in other orders: places are data, so the plan has one size for any number of samples."""
    sizes = []
    for n in (3, 300):
        names = [f"s{i}" for i in range(n)]
        fixed = "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t"
        paths = []
        for k, own in enumerate((names, names[::-1], names[1:] + names[:1])):
            paths.append(f"{folder}/{n}-{k}.vcf")
            calls = "\t".join(f"{int(s[1:]) % 3}/{(int(s[1:]) + k) % 3}" for s in own)
            with open(paths[-1], "w") as f:
                f.write(fixed + "\t".join(own) + f"\nchr1\t{10 + k}\trs{k}\tA\tC,G\t.\tPASS\tAN=4\tGT\t{calls}\n")
        data = vcf.read_vcf(spark, paths)
        for r in data.packed.collect():
            k = r.pos - 10
            assert r.a1 == [i % 3 for i in range(n)] and r.a2 == [(i + k) % 3 for i in range(n)]
        plan = data.packed._jdf.queryExecution().analyzed().toString()
        sizes.append(len(re.sub(r"\bs\d+\b\s?", "", plan)))  # the names themselves, in the lines that are looked for
    assert max(sizes) < 1.2 * min(sizes)


def test_document_is_read_in_ranges(spark, folder):
    """A document of one file by many tasks, each sample and property once; a document that is cut off is refused."""
    report = spark.range(500).select(
        F.lit("888").alias("_center-code"), F.col("id").alias("_id"), F.concat(F.lit("a <b> & </c> \n é "), F.col("id")).alias("collection-method")
    )
    properties = {"GeneratedBy": 'x > "y" & <z>', "Empty": ""}
    hml.write_hml_document(report, f"{folder}/parts", "p", properties, ("1", "2"), "3")
    hml.join_document(f"{folder}/parts", f"{folder}/whole.xml")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
        read = hml.read_hml_document(spark, f"{folder}/whole.xml", report.schema)
        assert read.samples.rdd.getNumPartitions() > 4
        assert rows(read.samples) == rows(report)
        assert sorted((r.name, r.value or "") for r in read.properties.collect()) == sorted([*properties.items(), ("SampleCount", "500")])
        text = open(f"{folder}/whole.xml").read()
        with open(f"{folder}/cut.xml", "w") as f:
            f.write(text[: text.rindex("</sample>")] + "\n</hml>\n")
        with pytest.raises(Exception, match="a sample without its end"):
            hml.read_hml_document(spark, f"{folder}/cut.xml", report.schema).samples.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_a_compressed_document_is_read_in_ranges(spark, folder, monkeypatch):
    """Its parts and the whole are block-gzip, the same text in less space, and many tasks give each sample and property once."""
    import gzip
    import os

    report = spark.range(9000).select(
        F.lit("888").alias("_center-code"), F.col("id").alias("_id"), F.concat(F.lit("a <b> & </c> \n é "), F.sha2(F.col("id").cast("string"), 512)).alias("collection-method")
    )
    properties = {"GeneratedBy": 'x > "y" & <z>', "Empty": ""}
    for name, compressed in (("plain", False), ("packed", True)):
        hml.write_hml_document(report, f"{folder}/{name}", "p", properties, ("1", "2"), "3", compressed=compressed)
    assert hml.join_document(f"{folder}/packed", f"{folder}/whole.xml.gz") == os.path.getsize(f"{folder}/whole.xml.gz")
    for parts in ("plain", "packed"):
        hml.join_document(f"{folder}/{parts}", f"{folder}/{parts}.xml")
    hml.join_document(f"{folder}/plain", f"{folder}/other.xml.gz")
    text = open(f"{folder}/plain.xml", "rb").read()
    assert [gzip.open(f"{folder}/{f}").read() for f in ("whole.xml.gz", "other.xml.gz")] == [text] * 2 and open(f"{folder}/packed.xml", "rb").read() == text
    assert sum(os.path.getsize(f"{folder}/packed/{f}") for f in os.listdir(f"{folder}/packed")) == os.path.getsize(f"{folder}/whole.xml.gz") < 0.6 * len(text)
    monkeypatch.setattr(hml, "RANGE_BYTES", 100_000)
    read = hml.read_hml_document(spark, f"{folder}/whole.xml.gz", report.schema)
    assert read.samples.rdd.getNumPartitions() > 4
    assert rows(read.samples) == rows(report)
    assert sorted((r.name, r.value or "") for r in read.properties.collect()) == sorted([*properties.items(), ("SampleCount", "9000")])
    with open(f"{folder}/cut.xml.gz", "wb") as f:
        f.writelines(hml._blocks([text[: text.rindex(b"</sample>")], b"\n</hml>\n"]))
    with pytest.raises(Exception, match="a sample without its end"):
        hml.read_hml_document(spark, f"{folder}/cut.xml.gz", report.schema).samples.collect()


def test_pieces_of_ranges_cut_anywhere(folder):
    """Separators on the borders of blocks and of ranges, empty pieces and empty blocks: each piece once."""
    import random

    draw = random.Random(3)
    for n in range(150):
        text = b"".join(draw.choice([b"<>", b"<>", b"<", b">", b"a" * draw.randrange(9)]) for _ in range(draw.randrange(1, 60)))
        path, at = f"{folder}/{n}.gz", 0
        with open(path, "wb") as f:
            while at < len(text):
                size = draw.randrange(0, 12)
                f.write(bgzf.compress(text[at : at + size]))
                at += size
            f.write(bgzf.END_OF_FILE)
        want = text.split(b"<>")
        want = want if want[-1] else want[:-1]
        size = bgzf.Blocks(path).size
        cuts = [0, *sorted(draw.randrange(size) for _ in range(draw.randrange(6))), size]
        got = [p for lo, hi in zip(cuts, cuts[1:]) for group in bgzf.pieces(bgzf.Blocks(path), lo, hi, b"<>") for p in group]
        assert got == want, (n, cuts)


def test_typed_cases_are_spread(spark, folder):
    """One small file of customers: the typings made from it come from several tasks."""
    spark.range(50).select(F.col("id").alias("c_custkey")).coalesce(1).write.parquet(f"{folder}/customer.parquet")
    cases = fx.typed_cases(spark, folder, hla.TYPED_LOCI, hla.typing_column)
    assert cases.count() == 50 and cases.rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism
