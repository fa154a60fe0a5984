import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from genopair.llm import doubling, suffix
from genopair.llm.common import Scratch
from tests.llm import cases


def brute(rows, length=100):
    """Rows in order of id and text; a window that a set of earlier ones holds covers its bytes."""
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        b = (t or "").encode()
        edge = np.zeros(len(b) + 1, int)
        for p in range(len(b) - length + 1):
            if (w := b[p : p + length]) in seen:
                edge[p] += 1
                edge[p + length] -= 1
            else:
                seen.add(w)
        gone = np.concatenate([[False], np.cumsum(edge)[:-1] > 0]) if len(b) else np.zeros(1, bool)
        kept = bytes(x for x, g in zip(b, gone[1:]) if not g)
        out.append((i, len(b), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(df, **kw):
    out = suffix.remove_repeats(df, **kw).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    return sorted(map(tuple, out.collect()), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    r = random.Random(seed)
    words = ["alpha", "be", "gamma ray", "d", "é", "ÿ漢", "the", "of"]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    base, rows = [text(60) for _ in range(5)], []
    for k in range(200):
        parts = []
        for _ in range(r.randrange(4)):
            b = r.choice(base) if r.random() < 0.6 else text(r.randrange(80))
            i = r.randrange(len(b) + 1)
            parts.append(b[i : r.randrange(i, len(b) + 1)] if r.random() < 0.5 else b)
        rows.append((k, "".join(parts)))
    rows += [(900, "a" * 1500), (901, "ab" * 700), (902, "xyz" * 333 + "q" + "xyz" * 100)]
    assert run(cases.docs(spark, rows)) == brute(rows)


def test_awkward_rows(spark):
    assert run(cases.awkward(spark)) == brute(cases.awkward_rows())
    assert run(cases.empty(spark)) == []


def test_rows_that_share_an_id(spark):
    a, b = cases.prose(40, 1), cases.prose(40, 2)
    rows = [(3, a), (3, a), (3, b + a), (2, b), (None, a)]
    assert run(cases.docs(spark, rows)) == brute(rows)


def test_a_passage_in_a_third_of_all_texts(spark):
    passage = cases.prose(30, 9)
    rows = [(k, cases.prose(5, k) + (passage if k % 3 == 0 else "") + cases.prose(20, 500 + k)) for k in range(240)]
    assert run(cases.docs(spark, rows)) == brute(rows)


def test_texts_longer_than_a_buffer():
    """Parts of a long text give the runs of the whole, but for where a part ends."""
    r = random.Random(1)
    data = bytes(r.choices(range(97, 123), k=3 * suffix.BUFFER // 2))
    windows = 0
    for ids, offsets, parts in suffix._slices([7], [data], 100):
        own, _, seed, first, last = suffix._suffixes(parts, 100)
        assert ids[0] == 7 and all(data[o : o + len(p)] == p for o, p in zip(offsets, parts))
        assert ((seed >= last) & (seed + suffix.SEED <= first + 100)).all()
        s, f, l = suffix._decode(suffix._code(seed + 5, first + 5, last + 5))
        assert (s == seed + 5).all() and (f == first + 5).all() and (l == last + 5).all()
        windows += int((last - first + 1).sum())
    assert windows == len(data) - 99


def test_stretches_hold_their_runs():
    """Runs that a part's border has split lie in their stretch as others do, also where one ends there."""
    r = random.Random(2)
    for n in (1_100_000, 1_700_000, 1_700_000, 2_500_000, 2_500_000):
        data = bytes(r.choices(range(97, 123), k=n))
        codes = []
        for _, offsets, parts in suffix._slices([7], [data], 100):
            own, _, seed, first, last = suffix._suffixes(parts, 100)
            codes.append(suffix._code(*(x + np.array(offsets)[own] for x in (seed, first, last))))
        columns = [pa.array([7]), pa.array([data.decode()]), pa.array([r.sample(list(np.concatenate(codes)), sum(map(len, codes)))])]
        batch = pa.RecordBatch.from_arrays(columns, names=["uid", "text", "codes"])
        found = 0
        for out in suffix._cut_strings(100)([batch]):
            _, first, last = suffix._decode(out["code"].to_numpy())
            assert out["string"].to_pylist() == [data[a : b + 100] for a, b in zip(first.tolist(), last.tolist())]
            found += len(first)
        assert found == sum(map(len, codes))


def test_copies_of_texts_longer_than_a_buffer(spark):
    r = random.Random(3)
    text = lambda n: "".join(r.choices("abcdefghijklmnopqrstuvwxyz ", k=n))
    long = [text(n) for n in (1_100_000, 1_700_000, 2_500_000)]
    near = "a start of its own " + "".join(long[1][at : at + 5000] + "!" for at in range(0, len(long[1]), 5000))
    rows = list(enumerate([*long, *long, near]))
    assert run(cases.docs(spark, rows)) == brute(rows)


def test_what_is_left_of_split_characters_goes_from_the_text(spark):
    rows = [(1, "é" * 120), (2, "x" + "é" * 60)]
    got = {r.doc_id: r for r in suffix.remove_repeats(cases.docs(spark, rows), keep=("lang",)).collect()}
    assert got[2].text == bytes(got[2].kept).decode("utf-8", "ignore") == "x" and got[1].lang == "en"


def covered(spans):
    out = {}
    for r in spans.collect():
        out.setdefault(r.uid, set()).update(range(r.start, r.end))
    return out


def test_prefix_doubling_finds_the_same_bytes(spark):
    """Doubling over all positions, and the sampled positions of the query, against brute force."""
    r = random.Random(7)
    base = [cases.prose(30, k) for k in range(4)]
    rows = [(k, cases.prose(r.randrange(8), 50 + k) + (r.choice(base)[r.randrange(40) :] if k % 3 else "") + cases.prose(9, 90 + k)) for k in range(60)]
    rows += [(900, "a" * 400), (901, "ab" * 170), (902, None), (903, ""), (904, "x" * 99), (905, "y" * 100), (906, "y" * 100)]
    docs = spark.createDataFrame(rows, "uid bigint, text string")
    got = covered(doubling.repeated_spans(docs, Scratch(spark, "t")))
    assert got == covered(suffix.repeated_spans(docs.na.fill({"text": ""}), Scratch(spark, "t")))
    want = {i: n for i, _, n, _, _ in brute(rows) if n}
    assert {i: len(s) for i, s in got.items()} == want
    first = doubling.repeated_positions(docs.where("uid >= 905"), Scratch(spark, "t")).collect()
    assert sorted((r.uid, r.pos, r.first_uid, r.first_pos) for r in first) == [(905, 0, 905, 0), (906, 0, 905, 0)]
    assert doubling.repeated_spans(docs.limit(0), Scratch(spark, "t")).collect() == []
