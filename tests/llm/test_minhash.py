import random
from collections import Counter

import numpy as np

from genopair.llm import minhash
from genopair.llm.common import Scratch
from genopair.llm.components import components
from tests.llm import cases


def bag(text):
    w = (text or "").split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def similarity(a, b):
    both = sum((a & b).values())
    union = sum(a.values()) + sum(b.values()) - both
    return both / union if union else 0.0


def brute(rows, least=0.8):
    """Class of each id: smallest id reachable over pairs of rows that are similar enough."""
    bags, parent = [(i, bag(t)) for i, t in rows if i is not None], {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(bags):
        for j, b in bags[:k]:
            if similarity(a, b) >= least:
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return Counter((i, find(i) if i is not None else None) for i, _ in rows)


def check(spark, rows):
    got = Counter(map(tuple, minhash.classes(cases.docs(spark, rows)).collect()))
    assert got == brute(rows)


def test_components_agree_with_the_weighted_similarity():
    """Unbiased: the mean over independent pairs is the mean similarity; counts of one to nine."""
    r = random.Random(5)
    seen, want = [], []
    for k in range(150):
        words = [f"w{k}x{j}" for j in range(40)]
        a = " ".join(" ".join(words[j : j + 7]) for j in r.choices(range(0, 40, 7), k=9))
        b = a + " " + " ".join(" ".join(words[j : j + 7]) for j in r.choices(range(0, 40, 7), k=r.randrange(6)))
        texts = [a.encode(), b.encode()]
        s = minhash.signatures(2, *minhash.shingles(texts), 128)
        seen.append((s[0] == s[1]).mean())
        want.append(similarity(bag(a), bag(b)))
    error = np.array(seen) - np.array(want)
    assert abs(error.mean()) < 4 * error.std() / np.sqrt(len(error)) + 1e-9 and error.std() < 0.06


def test_counts_are_weights():
    a, b = "p q r s t " * 12, "p q r s t " * 8
    hits = []
    for k in range(60):
        texts = [x.replace("q", f"q{k}").encode() for x in (a, b)]
        s = minhash.signatures(2, *minhash.shingles(texts), 64)
        hits.append((s[0] == s[1]).mean())
    assert abs(np.mean(hits) - similarity(bag(a), bag(b))) < 0.04


def test_shingles_are_those_of_the_words():
    texts = ["a b c d e f a b c d e", "", " \n ", "x", "one two three four", "a  b\tc\nd e", "a b c d e"]
    text, h, count = minhash.shingles([t.encode() for t in texts])
    assert np.bincount(text, weights=count, minlength=len(texts)).tolist() == [7, 0, 0, 1, 1, 1, 1]
    of = lambda k: set(h[text == k].tolist())
    assert of(5) == of(6) and of(6) <= of(0) and not of(4) & of(3)
    assert all(len(x) == 0 for x in minhash.shingles([b"", b" "]))


def test_against_brute_force(spark):
    r = random.Random(8)
    rows = []
    for k in range(160):
        if k and r.random() < 0.6:
            w = r.choice(rows)[1].split()
            for _ in range(r.randrange(4)):
                w[r.randrange(len(w))] = f"edit{r.randrange(99)}"
            rows.append((k, " ".join(w)))
        else:
            rows.append((k, cases.prose(r.randrange(3, 90), k)))
    check(spark, rows)


def test_a_large_group_of_near_copies(spark):
    r = random.Random(3)
    base, rows = cases.prose(120, 77).split(), []
    for k in range(250):
        w = list(base)
        for _ in range(2):
            w[r.randrange(len(w))] = f"n{k}"
        rows.append((k, " ".join(w)))
    check(spark, rows + [(1000 + k, cases.prose(60, 1000 + k)) for k in range(60)])


def test_texts_that_share_a_passage_are_no_copies(spark):
    passage = cases.prose(60, 5)
    check(spark, [(k, passage + " " + cases.prose(30, 500 + k)) for k in range(60)])


def test_awkward_rows(spark):
    check(spark, cases.awkward_rows())
    assert minhash.classes(cases.empty(spark)).count() == 0


def test_rows_that_share_an_id_share_a_class(spark):
    rows = [(1, cases.prose(50, 1)), (5, cases.prose(50, 1)), (5, cases.prose(50, 2)), (9, cases.prose(50, 2))]
    got = dict(map(tuple, minhash.classes(cases.docs(spark, rows)).distinct().collect()))
    assert got == {1: 1, 5: 1, 9: 1}


def test_components_of_random_graphs(spark):
    r = random.Random(6)
    for n, m in ((50, 30), (200, 190), (300, 299)):
        edges = [(r.randrange(n), r.randrange(n)) for _ in range(m)] if m < 299 else [(k, k + 1) for k in range(m)]
        parent = list(range(n))

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in edges:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
        want = {v: find(v) for a, b in edges if a != b for v in (a, b)}
        df = spark.createDataFrame([*edges, (None, 1), (2, None), (3, 3)], "x bigint, y bigint")
        assert dict(map(tuple, components(df, Scratch(spark, "test")).collect())) == want
    assert components(spark.createDataFrame([], "x bigint, y bigint"), Scratch(spark, "test")).count() == 0
