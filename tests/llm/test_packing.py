import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from genopair.llm import packing
from tests.llm import cases

FILE = "word_bpe_49k.json"


def sequences(counts, capacity):
    """Contents of all sequences of a plan, checking that they fit and use every piece once."""
    patterns = packing._Plan(dict(counts), capacity).patterns
    used = Counter()
    for content, times in patterns:
        assert times > 0 and sum(a * b for a, b in content) <= capacity
        for length, each in content:
            used[length] += each * times
    assert used == Counter({k: v for k, v in counts.items() if v})
    return sum(times for _, times in patterns)


@pytest.mark.parametrize("lengths,most", [
    ([2048] * 3, 3), ([1] * 5, 1), ([1500] * 10 + [600] * 7, 13), ([1000, 1048] * 9, 9), ([1000, 500, 548] * 9, 9), ([1000, 500, 300, 248] * 9, 9), ([], 0), ([683] * 3, 2), ([1024] * 3, 2),
])
def test_exact_complements(lengths, most):
    assert sequences(Counter(lengths), 2048) == most


@pytest.mark.parametrize("seed", range(6))
def test_close_to_the_least_number(seed):
    r = random.Random(seed)
    lengths = [min(64, max(1, int(r.lognormvariate(2.5, 1)))) for _ in range(3000)]
    assert sequences(Counter(lengths), 64) <= -(-sum(lengths) // 64) * 1.01 + 1


def test_plan_rows_cover_every_rank():
    counts = Counter(random.Random(1).choices(range(1, 65), k=5000))
    p = packing.plan(dict(counts), 64)
    for length, n in counts.items():
        lo = p["lo"][p["length"] == length]
        assert lo[0] == 0 and (np.diff(lo) > 0).all() and lo[-1] < n


def check(rows, got, capacity):
    ref = Tokenizer.from_file(public_tokenizers.path(FILE))
    want = Counter()
    for i, t in rows:
        x = [*ref.encode(t or "", add_special_tokens=False).ids, 0]
        for piece, start in enumerate(range(0, len(x), capacity)):
            part = x[start : start + capacity]
            want[i, piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for place in places.values():
        at = 0
        for offset, length in sorted(place):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places), -(-sum(r.length for r in got) // capacity)


def test_awkward_rows(spark):
    got = packing.pack(cases.awkward(spark), FILE).collect()
    n, least = check(cases.awkward_rows(), got, 2048)
    assert n <= least + 1
    assert packing.pack(cases.empty(spark), FILE).count() == 0


def test_one_length_for_a_third_of_all(spark):
    rows = [(k, "word " * 9 if k % 3 else cases.prose(k % 60, k)) for k in range(900)]
    n, least = check(rows, packing.pack(cases.docs(spark, rows), FILE, 64).collect(), 64)
    assert n <= least * 1.1 + 1


def test_same_places_whatever_the_partitions(spark):
    rows = [(k, cases.prose(k % 40, k)) for k in range(300)]
    a, b = (sorted(map(tuple, packing.pack(cases.docs(spark, x).repartition(n), FILE, 128).collect())) for x, n in ((rows, 3), (rows[::-1], 7)))
    assert a == b
