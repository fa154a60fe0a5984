import random
import zlib
from collections import Counter

import numpy as np
import pytest

from genopair.llm import quality, toxicity
from genopair.llm.labelled import held_out, sample
from pyspark.sql import functions as F
from tests.llm import cases

SF = "/root/testdata/sf0.1"


@pytest.mark.parametrize("module,label,folds,fold", [(quality, "quality", 5, 0), (toxicity, "toxic", 4, 2)])
def test_held_out_accuracy(spark, module, label, folds, fold):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = {r.doc_id: r for r in module.classify(docs, labels).collect()}
    assert len(got) == docs.count()
    right = []
    for r in labels.collect():
        out = got[r.doc_id]
        assert out.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == fold)
        assert 0 <= out.score <= 1 and out.predicted == (out.score >= 0.3)
        if out.held_out:
            right.append(out.predicted == r[label])
    assert len(right) > 500 and np.mean(right) > 0.94


def labels_for(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


@pytest.mark.parametrize("module", [quality, toxicity])
def test_awkward_rows(spark, module):
    labels = labels_for(spark, [(i, k % 2, k % 2) for k, i in enumerate((1, 2, 3, 4, 5, 6, 7, 7, 8, 9, 12, None))] + [(4, None, None), (99, 1, 1)])
    got = module.classify(cases.awkward(spark), labels).collect()
    assert len(got) == len(cases.awkward_rows())
    assert all(r.score is not None and 0 <= r.score <= 1 for r in got)
    assert all(not r.held_out for r in got if r.doc_id is None)
    assert len({(r.doc_id, r.score) for r in got if r.doc_id == 7}) == 1
    assert len({r.score for r in got if r.doc_id in (1, 2)}) == 1
    assert module.classify(cases.empty(spark), labels).count() == 0


@pytest.mark.parametrize("module", [quality, toxicity])
def test_one_label_or_none(spark, module):
    score = lambda rows: {r.score for r in module.classify(cases.awkward(spark), labels_for(spark, rows)).collect()}
    assert score([]) == {0.0}
    one = score([(i, 1, 1) for i in range(1, 13)])
    assert min(one) > 0.99
    zero = score([(i, 0, 0) for i in range(1, 13)])
    assert max(zero) < 0.01


def test_sample_is_bounded_and_fixed(spark):
    docs = cases.docs(spark, [(k, f"text {k}") for k in range(200)])
    labels = labels_for(spark, [(k, int(k % 4 > 0), 0) for k in range(200)])
    take = lambda n: sample(docs.repartition(n), labels.repartition(n + 1), "quality", 20, 5, 0)
    (a, totals), (b, _) = take(2), take(5)
    ids = sorted(r.doc_id for r in a.collect())
    assert ids == sorted(r.doc_id for r in b.collect()) and len(ids) == 40
    assert not any(zlib.crc32(str(i).encode()) % 5 == 0 for i in ids)
    assert sum(totals.values()) == sum(zlib.crc32(str(k).encode()) % 5 != 0 for k in range(200))


def test_held_out_rule(spark):
    ids = [0, 1, 17, -5, 123456789012]
    got = spark.createDataFrame([(i,) for i in ids], "i bigint").select("i", held_out(F.col("i"), 4, 2).alias("h")).collect()
    assert {r.i: r.h for r in got} == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in ids}


def test_ngrams_are_the_texts_own():
    x = toxicity.ngrams("Abcdé")
    assert len(x) == (6 - 3) + (6 - 4) and (toxicity.ngrams("aBCDÉ") == x).all()
    assert sorted(toxicity._Distinct()(np.array([3, 1, 3, 3, 2, 1], np.int32))) == [1, 2, 3]
    assert len(toxicity.ngrams("abc")) == 0


def test_an_id_of_many_rows_is_one_text(spark):
    docs = cases.docs(spark, [(1, f"copy {k}") for k in range(300)] + [(k, f"text {k}") for k in range(2, 40)])
    labels = labels_for(spark, [(k, int(k % 2), 0) for k in range(1, 40)])
    found = [sample(docs.repartition(n), labels, "quality", 50, 5, 0)[0].orderBy("doc_id").collect() for n in (1, 7)]
    assert [tuple(r) for r in found[0]] == [tuple(r) for r in found[1]] and len({r.doc_id for r in found[0]}) == len(found[0])


def toy(spark, n=150, seed=3):
    """Texts of two kinds that both labels separate, a few of them mixed, and their labels."""
    r = random.Random(seed)
    one, other = "alpha beta gamma delta".split(), "KAPPA 123 lambda 77 XI".split()
    rows = [(k, " ".join(r.choice(one if (k % 2 == 0) != (r.random() < 0.2) else other) for _ in range(r.randrange(3, 40)))) for k in range(n)]
    rows += [(n, None), (n + 1, ""), (n + 2, "z")]
    return rows, [(k, int(k % 2 == 0), int(k % 2)) for k in range(n)]


def brute_quality(rows, labels, folds=5, fold=0):
    """Features by dictionaries, singular vectors of the whole matrix in double precision, every cosine, the vote."""
    kind = lambda c: "a" if chr(c).islower() or c > 127 else "A" if chr(c).isupper() else "0" if chr(c).isdigit() else chr(c)
    bucket = lambda v: (v * 0x9E3779B97F4A7C15 % 2**64) >> 54

    def features(text):
        b = (text or "").encode()
        shape = [ord(kind(c)) for c in b]
        n = Counter(bucket(x | y << 8) for x, y in zip(b, b[1:]))
        n.update(1024 + bucket(x | y << 8 | z << 16) for x, y, z in zip(shape, shape[1:], shape[2:]))
        return np.array([np.log1p(n[k]) for k in range(2048)])

    known = {i: y for i, y, _ in labels if zlib.crc32(str(i).encode()) % folds != fold}
    x = {i: features(t) for i, t in rows}
    train = sorted(i for i in known if x[i].any())
    m, y = np.stack([x[i] for i in train]), np.array([known[i] for i in train])
    rarity = np.log((1 + len(m)) / (1 + (m > 0).sum(axis=0))) + 0.2
    unit = lambda v: v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-12)
    m = unit(m * rarity)
    basis = np.linalg.svd(m, full_matrices=False)[2][: quality.RANK].T
    m = unit(m @ basis)
    totals = Counter(known.values())
    weight = np.where(y == 1, totals[1] / (y == 1).sum(), totals[0] / (y == 0).sum())
    out = {}
    for i, v in x.items():
        if not v.any():
            out[i] = totals[1] / len(known)
            continue
        near = m @ unit((v * rarity) @ basis)
        top = np.argsort(-near, kind="stable")[: quality.NEIGHBOURS]
        vote = np.maximum(near[top], 1e-6) ** quality.SHARPNESS * weight[top]
        out[i] = (vote * y[top]).sum() / vote.sum()
    return out


def test_quality_against_brute_force(spark):
    rows, labels = toy(spark)
    want = brute_quality(rows, labels)
    got = {r.doc_id: r for r in quality.classify(cases.docs(spark, rows), labels_for(spark, labels)).collect()}
    gap = np.array([abs(got[i].score - want[i]) for i in want])
    # the sample's features travel in half precision, and equally near neighbours may change places
    assert np.median(gap) < 0.005 and np.mean(gap > 0.1) < 0.05
    assert np.mean([got[i].predicted == (want[i] >= 0.3) for i in want]) > 0.97
    assert 0.1 < np.std(list(want.values()))


def brute_toxicity(rows, labels, folds=4, fold=2):
    """N-grams in dictionaries, ratios one by one, and Newton's method on the penalised likelihood."""

    def grams(text):
        b = (text or "").lower().encode()
        salted = lambda n, g: (int.from_bytes(g, "little") * 0x9E3779B97F4A7C15 + n * 0xD1B54A32D192ED03) % 2**64 >> 44
        return {salted(n, b[k : k + n]) for n in (4, 5) for k in range(len(b) - n + 1)}

    known = {i: y for i, _, y in labels if zlib.crc32(str(i).encode()) % folds != fold}
    texts = {i: grams(t) for i, t in rows}
    seen = [Counter(g for i, y in known.items() if y == c for g in texts[i]) for c in (0, 1)]
    size = [sum(y == c for y in known.values()) for c in (0, 1)]
    often = sorted(g for g in seen[0] | seen[1] if seen[0][g] + seen[1][g] >= 3)
    total = [sum(s[g] + 1 for g in often) for s in seen]
    ratio = {g: np.log((seen[1][g] + 1) / total[1]) - np.log((seen[0][g] + 1) / total[0]) for g in often}

    def surety(g):
        share = (seen[0][g] + seen[1][g]) / sum(size)
        return abs(seen[1][g] / size[1] - seen[0][g] / size[0]) / np.sqrt(max(share * (1 - share), 1e-12) * (1 / size[0] + 1 / size[1]))

    chosen = [g for g in often if surety(g) >= toxicity.SURETY and abs(ratio[g]) >= toxicity.LEAST_RATIO]
    assert 10 < len(chosen) <= toxicity.FEATURES
    x = np.array([[ratio[g] * (g in texts[i]) for g in chosen] + [1.0] for i in known])
    y, w, penalty = np.array(list(known.values()), float), np.zeros(len(chosen) + 1), np.diag([1e-3] * len(chosen) + [0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-x @ w))
        h = (x.T * (p * (1 - p) / len(y))) @ x + penalty + 1e-12 * np.eye(len(w))
        w = w - np.linalg.solve(h, x.T @ (p - y) / len(y) + penalty @ w)
    of = dict(zip(chosen, w))
    return {i: 1 / (1 + np.exp(-(w[-1] + sum(of[g] * ratio[g] for g in t if g in of)))) for i, t in texts.items()}


def test_toxicity_against_brute_force(spark):
    rows, labels = toy(spark, 200, 5)
    want = brute_toxicity(rows, labels)
    got = {r.doc_id: r for r in toxicity.classify(cases.docs(spark, rows), labels_for(spark, labels)).collect()}
    # a fixed number of gradient steps ends near the optimum; the intercept, which alone scores texts without n-grams, is the last to settle
    bare = [i for i, t in rows if len(t or "") < 4]
    texts = [i for i in want if i not in bare]
    gap = np.array([abs(got[i].score - want[i]) for i in texts])
    assert np.median(gap) < 0.005 and gap.max() < 0.1 and len({got[i].score for i in bare}) == 1
    assert all(got[i].predicted == (want[i] >= 0.3) for i in texts if abs(want[i] - 0.3) > 0.1)
    assert min(want.values()) < 0.1 and max(want.values()) > 0.9


def test_a_kept_column_named_like_a_result(spark):
    df = cases.awkward(spark)
    got = toxicity.score(df, toxicity.Model(0.0, np.zeros(0, int), np.zeros(0)), keep=("score", "lang"))
    assert got.columns == ["doc_id", "score", "kept_score", "lang"] and {r.kept_score for r in got.collect()} == {f"c{k}" for k in range(got.count())}
