import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from genopair.llm import alignment
from genopair.llm.queries import BYTE_BPE, PIECE_BPE
from tests.llm import cases


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(public_tokenizers.path(BYTE_BPE))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(PIECE_BPE))
    return a, b


def letters():
    """Byte of each letter of the byte-level alphabet, by the rule that unprintable bytes follow from U+0100."""
    plain = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xAD)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def brute(texts, libraries):
    """Every document's row by loops over tokens: spans, overlaps, components by search."""
    a, b = libraries
    of = letters()
    docs = []
    for t in texts:
        whole = (" " + (t or "")).encode()
        x = a.encode(whole.decode(), add_special_tokens=False).ids if t else []
        y = b.encode(t) if t else []
        xb = [bytes(of[c] for c in a.id_to_token(i)) for i in x]
        yb = [bytes([int(p[3:5], 16)]) if len(p := b.id_to_piece(i)) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode() for i in y]
        if not t or b"".join(xb) != whole or b"".join(yb) != whole:
            docs.append(([], [], [], []))
            continue
        spans = []
        for tokens in (xb, yb):
            at, out = 0, []
            for token in tokens:
                out.append((at, at + len(token)))
                at += len(token)
            spans.append(out)
        links = [(i, j) for i, (s, e) in enumerate(spans[0]) for j, (u, v) in enumerate(spans[1]) if s < v and u < e]
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, low = [], 0
        for c in cuts:
            groups.append(tuple([ids[k] for k, (s, e) in enumerate(sp) if low <= s and e <= c] for ids, sp in zip((x, y), spans)))
            low = c
        docs.append((x, y, groups, [(x[i], y[j]) for i, j in links]))
    n = Counter(p for d in docs for p in set(d[3]))
    best = defaultdict(int)
    for (i, _), c in n.items():
        best[i] = max(best[i], c)
    out = []
    for x, y, groups, links in docs:
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        sha = hashlib.sha256(text.encode()).hexdigest() if groups else ""
        out.append((len(x), len(y), len(groups), len(links), sum(n[p] == best[p[0]] for p in links), sum(n[p] for p in links), sha))
    return out


COLUMNS = "n_a n_b n_groups n_links n_best count_sum groups_sha256".split()
STRANGE = ["<|endoftext|> </s> <s> <0x41> [INST]", "▁", "a\x00b", "\r\n\t tab", "﻿­", "\U0001f600 é ﬁ ½", "x" * 700, " " * 300, "<unk>", "don't 're 'S"]


@pytest.mark.parametrize("known", [0, 5, 1 << 20])
def test_rows_equal_loops_whatever_is_known_to_all_tasks(spark, libraries, known, monkeypatch):
    rows = [(i, t if t is None or len(t) < 900 else t[:900]) for i, t in cases.awkward_rows()] + [(100 + k, t) for k, t in enumerate(STRANGE)]
    monkeypatch.setattr(alignment, "KEYS_PER_ROW", 16)
    got = alignment.align(cases.docs(spark, rows), BYTE_BPE, PIECE_BPE, known_pairs=known).collect()
    want = brute([t for _, t in rows], libraries)
    assert sorted((str(r.doc_id), *(r[c] for c in COLUMNS)) for r in got) == sorted((str(i), *w) for (i, _), w in zip(rows, want))
    assert sum(r.n_a == 0 for r in got) == 4  # two nulls, an empty text, and one that has the mark for a space


def test_an_empty_table(spark):
    assert alignment.align(cases.empty(spark), BYTE_BPE, PIECE_BPE).collect() == []


def test_long_texts(spark, libraries):
    long = cases.prose(30000, 5)
    got = alignment.align(cases.docs(spark, [(1, long), (2, long), (3, "x" * 100000)]), BYTE_BPE, PIECE_BPE).collect()
    a, b = libraries
    for r in got:
        t = long if r.doc_id < 3 else "x" * 100000
        assert (r.n_a, r.n_b) == (len(a.encode(" " + t, add_special_tokens=False).ids), len(b.encode(t)))
        assert r.n_links == r.n_a + r.n_b - r.n_groups


def test_fast_and_slow_ids_agree(libraries):
    r, kind = random.Random(2), alignment.vocabulary(BYTE_BPE, ",", "|")
    ranges = [(0, 0x52F), (0x2000, 0x2063), (0x3041, 0x3096), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3), (0, 0xD7FF), (0xE000, 0x10FFFF), (0x20, 0x7E)]
    texts = ["".join(chr(r.randint(*r.choice(ranges))) for _ in range(r.randrange(1, 40))) for _ in range(4000)]
    assert kind.encode(texts) == [libraries[0].encode(" " + t, add_special_tokens=False).ids for t in texts]


def test_doubling_reaches_the_last_token_of_long_chains():
    end_a, end_b = np.append(np.arange(2, 20001, 2), 20001), np.append(np.arange(1, 20000, 2), 20001)
    succ = alignment.successors(end_a, end_b)
    assert set(succ.tolist()) == {len(end_a) + len(end_b) - 1}
