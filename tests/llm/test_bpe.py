import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from genopair.llm import bpe
from tests.llm import cases

FILES = ("byte_bpe_50k.json", "word_bpe_49k.json")


@pytest.fixture(scope="module", params=FILES)
def both(request):
    return bpe.encoder(request.param), Tokenizer.from_file(public_tokenizers.path(request.param))


def ids(enc, text):
    return np.frombuffer(enc.encode(text), "<u4").tolist()


def test_random_texts_of_all_scripts(both):
    enc, ref = both
    r = random.Random(3)

    def char():
        k = r.random()
        if k < 0.4:
            return chr(r.randrange(32, 127))
        if k < 0.6:
            return r.choice(" \n\t\r\x0b\x0c\x1c\x85\xa0 ​　'ΣİǺ")
        c = r.randrange(0x80, 0x3000) if k < 0.9 else r.randrange(0x3000, 0x110000)
        return chr(c) if not 0xD800 <= c < 0xE000 else "x"

    for k in range(4000):
        s = "".join(char() for _ in range(r.randrange(40)))
        if k % 40 == 0:
            s += "<|endoftext|>" + s
        assert ids(enc, s) == ref.encode(s, add_special_tokens=False).ids, s


def test_every_code_point(both):
    enc, ref = both
    for at in range(0, 0x110000, 64):
        s = "".join(f"a{chr(c)}1 " for c in range(at, at + 64) if not 0xD800 <= c < 0xE000)
        assert ids(enc, s) == ref.encode(s, add_special_tokens=False).ids, hex(at)


@pytest.mark.parametrize("text", ["a" * 9000, "ab" * 5000, "Aa" * 3000 + "é" * 3000, "=" * 9000 + "-" * 7001, " " * 10000 + "x", "\n" * 8191, "the" * 4000])
def test_pieces_longer_than_the_window(both, text):
    enc, ref = both
    assert ids(enc, text) == ref.encode(text, add_special_tokens=False).ids


def test_long_random_pieces_are_streamed(both):
    enc, ref = both
    r = random.Random(1)
    for letters in ("abcdeghinorst", "aeiou", "01", "eEtThH"):
        text = "".join(r.choice(letters) for _ in range(20000))
        assert ids(enc, text) == ref.encode(text, add_special_tokens=False).ids
        runs = list(enc.merges.piece(text.encode()))
        assert len(runs) > 3 and max(len(x) for x in runs) < enc.merges.window


def test_decoder_waits_for_whole_characters():
    enc = bpe.encoder(FILES[0])
    dec, text = bpe.Decoder(enc.merges), "naïve 漢字 🙂 ÿ"
    data = enc.encode(text)
    parts = [dec.feed(data[k : k + 4]) for k in range(0, len(data), 4)]
    assert "".join(parts) + dec.finish() == text
    assert dec.feed(data[:0]) + dec.finish() == ""
    broken = np.array([enc.merges.first[0xE6], enc.merges.first[0x41], enc.merges.first[0xF0]], "<u4").tobytes()
    assert dec.feed(broken) + dec.finish() == b"\xe6\x41\xf0".decode("utf-8", "replace")


def test_round_trip_over_awkward_rows(spark):
    got = sorted(map(tuple, bpe.round_trip(cases.awkward(spark), FILES[0]).drop("decoded_chars").collect()), key=str)
    ref = Tokenizer.from_file(public_tokenizers.path(FILES[0]))
    want = []
    for i, t in cases.awkward_rows():
        x = ref.encode(t or "", add_special_tokens=False).ids
        sha = lambda b: hashlib.sha256(b).hexdigest()
        want.append((i, len(x), sha(np.array(x, "<u4").tobytes()), sha(ref.decode(x, skip_special_tokens=False).encode())))
    assert got == sorted(want, key=str)
    assert bpe.round_trip(cases.empty(spark), FILES[0]).count() == 0


def test_encode_then_decode(spark):
    encoded = bpe.encode(cases.awkward(spark), FILES[0])
    got = sorted(map(tuple, bpe.decode(encoded, FILES[0]).collect()), key=str)
    assert got == sorted(((i, t or "") for i, t in cases.awkward_rows()), key=str)
    assert bpe.decode(bpe.encode(cases.empty(spark), FILES[0]), FILES[0]).count() == 0
