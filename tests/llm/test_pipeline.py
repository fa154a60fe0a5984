from collections import Counter

import corpus_pipeline as cp
import pytest

from genopair.llm import queries
from tests.llm import cases, test_line_dedup, test_minhash, test_packing, test_suffix

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    """Input and output rows of each stage on the smallest tables."""
    out, docs = [], spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in cp.STAGES:
        df = stage(spark, docs, SF)
        rows = df.collect()
        out.append((name, docs.collect(), rows, df.columns))
        docs = spark.createDataFrame(rows, df.schema)
    return out


def texts(rows):
    return [(r.doc_id, r.text) for r in rows]


def test_stages_and_columns(steps):
    assert [s[0] for s in steps] == ["toxicity", "line_dedup", "near_dedup", "repeat_dedup", "packing"]
    for _, before, after, columns in steps[:-1]:
        assert columns == ["doc_id", "text", "lang", "source", "n_chars"]
        source = {r.doc_id: (r.lang, r.source) for r in before}
        assert all(source[r.doc_id] == (r.lang, r.source) and r.n_chars == len(r.text) for r in after)


def test_toxic_documents_go_and_others_stay(spark, steps):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in steps[0][2]}
    clean = [i for i, y in labels.items() if y == 0]
    toxic = [i for i, y in labels.items() if y == 1]
    assert sum(i in kept for i in clean) >= 0.97 * len(clean)
    assert sum(i not in kept for i in toxic) >= 0.7 * len(toxic)
    assert {(r.doc_id, r.text) for r in steps[0][2]} <= set(texts(steps[0][1]))


def test_line_stage(steps):
    want = [(i, t) for i, t, _, _ in test_line_dedup.brute(texts(steps[1][1]), 10)]
    assert Counter(texts(steps[1][2])) == Counter(want)


def test_near_duplicate_stage(steps):
    classes = test_minhash.brute(texts(steps[2][1]))
    assert {r.doc_id for r in steps[2][2]} == {i for i, c in classes if i == c}


def test_repeat_stage(steps):
    want = {i: gone for i, _, gone, _, _ in test_suffix.brute(texts(steps[3][1]))}
    before = dict(texts(steps[3][1]))
    assert len(steps[3][2]) == len(before)
    for r in steps[3][2]:
        assert 0 <= len(before[r.doc_id].encode()) - want[r.doc_id] - len(r.text.encode()) < 8 + want[r.doc_id]


def test_packing_stage(steps):
    n, least = test_packing.check(texts(steps[4][1]), steps[4][2], 2048)
    assert n <= least + 2


def test_run_is_all_stages(spark, steps):
    got = cp.run(spark, SF)
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, steps[4][2]))


def test_stages_take_awkward_rows(spark):
    docs = cases.awkward(spark).select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in cp.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
        assert stage(spark, docs, SF).count() > 0


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
