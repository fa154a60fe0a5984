import numpy as np
import pytest
from pyspark.sql import functions as F

from genopair.llm import hard_negatives as hn

SCHEMA = "vec_id bigint, embedding array<float>, label int, v string, r_block string, at string, anchor_id string"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], y, "a", "b", "c", "d") for i, v, y in rows], SCHEMA)


def brute(rows, is_anchor, d, scale=256):
    """Every anchor's windows with Python's own integers."""
    ok = [(i, y, tuple(float(np.float32(x)) for x in v)) for i, v, y in rows if i is not None and y is not None and v is not None and len(v) == d and all(x is not None and np.isfinite(x) for x in v)]
    one = {}
    for i, y, v in sorted(ok):
        one.setdefault(i, (y, [int(np.floor(scale * x)) for x in v]))
    out = []
    for a in filter(is_anchor, one):
        score = {i: sum(x * z for x, z in zip(one[a][1], v)) for i, (_, v) in one.items() if i != a}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if one[i][0] == one[a][0]][:5]:
            inside = [n for n in order if one[n][0] != one[a][0] and 80 * score[p] <= 100 * score[n] <= 100 * score[p]][:5]
            out += [(a, p, k, n, score[p], score[n]) for k, n in enumerate(inside, 1)]
    return sorted(out)


def mined(df, modulo):
    return sorted(tuple(r) for r in hn.mine(df, F.col("vec_id") % modulo == 0, F.col("label")).collect())


def test_awkward_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(k, rng.normal(size=3), int(k % 3)) for k in range(60)]
    rows += [(70, None, 0), (80, [1, None, 0], 0), (90, [float("nan"), 1, 0], 1), (100, [float("inf"), 0, 0], 1), (110, [0, 0, 0], 2), (None, [1, 0, 0], 0)]
    rows += [(120, [1, 0, 0], None), (130, [1, 0], 1), (140, [], 1), (5, [9, 9, 9], 2), rows[10], rows[10]]
    got = mined(frame(spark, rows), 10)
    assert got == brute(rows, lambda i: i % 10 == 0, 3) and len(got) > 50
    assert mined(frame(spark, []), 10) == []
    assert mined(frame(spark, [(10, [1, 2, 3], 1)]), 10) == []
    assert mined(frame(spark, [(10, [], 1), (20, [], 2)]), 10) == []


def test_ties_and_a_vector_that_a_third_of_all_rows_share(spark):
    rng = np.random.default_rng(4)
    rows = [(k, [0.5, 0.5, 0.5] if k % 3 else rng.uniform(-1, 1, 3), int(k % 4)) for k in range(400)]
    assert mined(frame(spark, rows), 50) == brute(rows, lambda i: i % 50 == 0, 3)


def test_many_components_and_great_values(spark):
    rng = np.random.default_rng(5)
    rows = [(k, rng.normal(size=300) * 4000, int(k % 2)) for k in range(40)]
    got = mined(frame(spark, rows), 10)
    assert got == brute(rows, lambda i: i % 10 == 0, 300) and max(abs(r[4]) for r in got) > 2**40
    with pytest.raises(ValueError, match="do not fit"):
        hn.mine(frame(spark, [(10, [1e30], 1)]), F.col("vec_id") % 10 == 0, F.col("label"))


@pytest.mark.parametrize("components,size", [(1, 1 << 30), (64, 256), (257, 1000), (5000, 77)])
def test_products_are_exact(components, size):
    rng = np.random.default_rng(components)
    x, y = rng.integers(-size, size + 1, (7, components)), rng.integers(-size, size + 1, (5, components))
    x[0], y[0], y[1] = size, size, -size
    moduli = hn.primes(2 * components * size * size + 1)
    assert all(all(p % q for q in range(2, p)) for p in moduli) and len(set(moduli)) == len(moduli)
    want = [[sum(int(a) * int(b) for a, b in zip(r, s)) for s in y] for r in x]
    assert hn.products(hn.Residues(x, moduli), hn.Residues(y, moduli)).tolist() == want


def test_blocks_do_not_matter(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(k, rng.normal(size=8), int(k % 3)) for k in range(500)]
    whole = mined(frame(spark, rows), 20)
    monkeypatch.setattr(hn, "BLOCK_BYTES", 512)
    monkeypatch.setattr(hn, "STEP_CELLS", 16)
    assert mined(frame(spark, rows), 20) == whole == brute(rows, lambda i: i % 20 == 0, 8)
