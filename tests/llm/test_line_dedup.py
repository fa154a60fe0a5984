import hashlib
import random
from collections import Counter

from pyspark.sql import functions as F

from genopair.llm import line_dedup
from tests.llm import cases

EDGE = " \t\n\x0b\x0c\r"


def brute(rows, min_docs):
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(EDGE))
    split = [(i, (t or "").split("\n")) for i, t in rows]
    seen = Counter(k for _, lines in split for k in {key(x) for x in lines})
    out = []
    for i, lines in split:
        stay = [x for x in lines if not key(x) or seen[key(x)] < min_docs]
        out.append((i, "\n".join(stay), len(lines), len(lines) - len(stay)))
    return sorted(out, key=str)


def run(df, **kw):
    return sorted(map(tuple, line_dedup.drop_common_lines(df, **kw).collect()), key=str)


def test_against_brute_force(spark):
    r = random.Random(2)
    lines = ["Same", " same\t", "SAME\r", "other", "", "  ", "é É", "É é", "\x0bvt\x0c", "\xa0nbsp", *(f"own {k}" for k in range(60))]
    rows = [(k, "\n".join(r.choice(lines) for _ in range(r.randrange(12)))) for k in range(150)]
    for batches, fanout in ((1, 2), (5, 2), (7, 3)):
        assert run(cases.docs(spark, rows), min_docs=10, batches=batches, fanout=fanout) == brute(rows, 10)


def test_awkward_rows(spark):
    for least in (2, 10):
        assert run(cases.awkward(spark), min_docs=least) == brute(cases.awkward_rows(), least)
    assert run(cases.empty(spark)) == []


def test_a_line_in_a_third_of_all_documents(spark):
    rows = [(k, ("common\n" if k % 3 == 0 else "") + f"text {k}") for k in range(600)]
    assert run(cases.docs(spark, rows)) == brute(rows, 10)


def test_columns_carried_along(spark):
    got = line_dedup.drop_common_lines(cases.awkward(spark), keep=("lang", "score")).select("doc_id", "lang", "score").collect()
    assert len(got) == len(cases.awkward_rows()) and {r.lang for r in got} == {"en"}


def test_runs_are_compacted_and_new_lines_found(spark):
    runs = line_dedup.LineRuns(spark, fanout=2)
    batch = lambda words: spark.createDataFrame([(hashlib.md5(w.encode()).digest(), 1) for w in words], "line_hash binary, n_docs bigint")
    for words in ("ab", "bc", "cd", "de", "ea"):
        runs.add(batch(words))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    unseen = runs.unseen(batch("axez").select("line_hash")).collect()
    assert {bytes(r.line_hash) for r in unseen} == {hashlib.md5(w.encode()).digest() for w in "xz"}
    assert runs.found_in(2).count() == 5 and runs.found_in(3).count() == 0


def test_folding_keeps_different_lines_apart():
    """The fold of bytes: A to Z and nothing else, over all characters in pairs of places."""
    fold = lambda t: t.encode().decode("latin-1").lower()
    key = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    r, seen = random.Random(4), {}
    letters = [chr(c) for c in [*range(0x20, 0x250), 0x130, 0x212A, 0x212B, 0x1E9E, 0x3A3, 0x3C3, 0x3C2, *range(0xE000, 0xE100), *range(0x3000, 0x3100), *range(0x10400, 0x10450)]]
    texts = letters + [a + b for a in r.sample(letters, 300) for b in r.sample(letters, 300)]
    texts += ["".join(r.choice(letters) for _ in range(r.randrange(1, 6))) for _ in range(50000)]
    for t in texts:
        assert seen.setdefault(fold(t), key(t)) == key(t)
    assert len(set(map(key, texts))) == len(seen)


def test_lines_that_only_differ_in_case_of_other_letters(spark):
    rows = [(k, "École\nÀ\nK\nstraße\n" + ("ÉCOLE\nécole\nà\nk\nSTRASSE" if k % 2 else "Ecole")) for k in range(24)]
    assert run(cases.docs(spark, rows), min_docs=13) == brute(rows, 13)
    assert run(cases.docs(spark, rows), min_docs=13, min_chars=2, batches=3) == [r for r in brute_least(rows, 13, 2)]


def brute_least(rows, min_docs, least):
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(EDGE))
    seen = Counter(k for _, t in rows for k in {key(x) for x in t.split("\n")})
    out = []
    for i, t in rows:
        stay = [x for x in t.split("\n") if len(key(x)) < least or seen[key(x)] < min_docs]
        out.append((i, "\n".join(stay), t.count("\n") + 1, t.count("\n") + 1 - len(stay)))
    return sorted(out, key=str)


def test_runs_merge_without_a_shuffle_or_a_sort(spark):
    """Two runs meet by a merge join alone; what a batch brings is all that is shuffled."""
    runs = line_dedup.LineRuns(spark, fanout=2)
    counts = spark.range(5000).select(F.unhex(F.md5(F.col("id").cast("string"))).alias("line_hash"), F.lit(1).cast("bigint").alias("n_docs"))
    counts = counts.groupBy("line_hash").agg(F.sum("n_docs").alias("n_docs"))
    with runs.merging():
        runs.levels = [[runs._written(counts, "a"), runs._written(counts.where("n_docs > 0"), "b")]]
        merged = runs._merged(runs.levels[0])
        plan = merged._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan
        assert merged.agg(F.sum("n_docs"), F.count("*")).first()[:] == (10000, 5000)
    runs.forget()


def test_settled_lines_leave_later_batches(spark):
    runs = line_dedup.LineRuns(spark, fanout=2)
    batch = lambda words: spark.createDataFrame([(hashlib.md5(w.encode()).digest(), 2) for w in words], "line_hash binary, n_docs bigint")
    with runs.merging():
        for words in ("ab", "ac", "ad", "ae"):
            runs.add(batch(words), settled_at=4)
        assert sum(r.count() for r in runs.common) == 1
        assert {bytes(r.line_hash) for r in runs.found_in(4).collect()} == {hashlib.md5(b"a").digest()}
    runs.forget()


def test_a_kept_column_named_like_a_result(spark):
    df = cases.docs(spark, [(1, "a")]).withColumnRenamed("score", "n_lines")
    got = line_dedup.drop_common_lines(df, keep=("n_lines",))
    assert got.columns == ["doc_id", "text", "n_lines", "n_dropped", "kept_n_lines"] and tuple(got.first()) == (1, "a", 1, 0, "c0")
