"""BPE encoding and decoding as streaming transducers.

A merge list decides how far to the right a text can still change a token. That distance, the
sufficient lookahead, is computed from the list; the encoder keeps one window of a piece, emits
the tokens that end further than the lookahead from the window's end, and goes on from there.
The decoder turns ids into bytes and bytes into text with an incremental UTF-8 state machine.

Defined results: a null text is empty and has no tokens; rows are independent, so repeated rows
give repeated results; an empty table gives an empty table; other columns are ignored.
"""

import codecs
import gc
import hashlib
import heapq
import json
import re
import struct
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from genopair.llm.common import id_and_text, small

NO_MERGE = 1 << 60
CACHED_PIECES = 500_000
CACHED_BYTES = 64
BLOCK_CHARS = 1 << 16

# Fixed value: the split of the byte-level vocabulary's own pre-tokenizer.
BYTE_LEVEL_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# Fixed value: the split of the vocabulary of words, on lower-cased text.
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"

# Fixed value: scripts whose character classes are the same in all recent versions of Unicode. A text
# with other characters is split, and changed, by the tokenizer file's own rules in its library.
SETTLED = r"\x00-\u052f\u2000-\u2063\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3"


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in plain}
    for b in range(256):
        letters.setdefault(b, chr(0x100 + len(letters) - len(plain)))
    return [letters[b] for b in range(256)]


class Merges:
    """A merge list over bytes, with an optional suffix that marks the last byte of a piece."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], byte_letters()
        vocab = model["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        self.first = [vocab[c] for c in letters]
        self.last = [vocab[c + suffix] for c in letters]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pairs = {}
        for rank, (a, b) in enumerate(model["merges"]):
            whole = a + b
            self.pairs[vocab[a], vocab[b]] = (rank, vocab[whole])
        self.ranks = {a << 20 | b: rank for (a, b), (rank, _) in self.pairs.items()}
        self.whole = [whole for _, whole in sorted(self.pairs.values())]
        of_letter = {c: b for b, c in enumerate(letters)}
        size = max(max(vocab.values()), max(self.special.values(), default=0)) + 1
        self.bytes = [b""] * size
        for t, i in vocab.items():
            core = t[: -len(suffix)] if suffix and t.endswith(suffix) and t != suffix else t
            if all(c in of_letter for c in core):
                self.bytes[i] = bytes(of_letter[c] for c in core)
        for t, i in self.special.items():
            self.bytes[i] = t.encode("utf-8")
        self.lookahead = self._lookahead()
        self.window = 4 * (self.lookahead + max(map(len, self.bytes))) + 1024

    def _lookahead(self) -> int:
        """Bytes right of a token that suffice to fix it.

        Text beyond a window changes a token inside only by a chain of merges: the first takes
        a token that ends at the window's end, each later one, of a higher rank, takes the
        token left of the front because what follows it, a token that begins with the one
        before, has changed. ``reach[t]`` is the longest such chain so far whose leftmost token is t.
        """
        reach: dict[int, int] = {}
        left_of: dict[int, int] = {}
        for (a, b), (_, whole) in sorted(self.pairs.items(), key=lambda x: x[1][0]):
            best, t = 0, b
            while t is not None:
                best = max(best, reach.get(t, 0))
                t = left_of.get(t)
            reach[a] = max(reach.get(a, 0), len(self.bytes[a]) + best)
            left_of[whole] = a
        return max(reach.values(), default=0)

    def merge(self, ids: list[int]) -> list[int]:
        """Apply the merges to one run of symbols: lowest rank first, then leftmost."""
        pairs = self.pairs
        if len(ids) < 96:
            return self.merge_short(ids)
        n = len(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(pairs[p][0], i, p) for i, p in enumerate(zip(ids, ids[1:])) if p in pairs]
        heapq.heapify(heap)
        while heap:
            _, i, p = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or (ids[i], ids[j]) != p:
                continue
            ids[i], alive[j], after[i] = pairs[p][1], False, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (q := (ids[i], ids[after[i]])) in pairs:
                    heapq.heappush(heap, (pairs[q][0], i, q))
            if (h := before[i]) >= 0 and (q := (ids[h], ids[i])) in pairs:
                heapq.heappush(heap, (pairs[q][0], h, q))
        return [t for t, a in zip(ids, alive) if a]

    def merge_short(self, ids: list[int]) -> list[int]:
        get, whole = self.ranks.get, self.whole
        ranks = [get(a << 20 | b, NO_MERGE) for a, b in zip(ids, ids[1:])]
        while ranks and (rank := min(ranks)) != NO_MERGE:
            i = ranks.index(rank)
            ids[i] = whole[rank]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] << 20 | ids[i], NO_MERGE)
            if i < len(ranks):
                ranks[i] = get(ids[i] << 20 | ids[i + 1], NO_MERGE)
        return ids

    def piece(self, data: bytes):
        """Ids of one piece, run by run. Only a window of the piece is held."""
        at, n = 0, len(data)
        while at < n:
            end = min(at + self.window, n)
            ids = [self.first[b] for b in data[at:end]]
            if end == n:
                ids[-1] = self.last[data[n - 1]]
                yield self.merge(ids)
                return
            stable, size = [], 0
            for t in self.merge(ids):
                if size + len(self.bytes[t]) > end - at - self.lookahead:
                    break
                stable.append(t)
                size += len(self.bytes[t])
            yield stable
            at += size


class _Pieces(dict):
    """Little-endian ids by piece, for short pieces; emptied when it is full."""

    def __init__(self, merges: Merges):
        super().__init__()
        self.merges = merges

    def __missing__(self, piece: str) -> bytes:
        data, merges = piece.encode("utf-8"), self.merges
        if len(data) > CACHED_BYTES:
            return b"".join(array("I", run).tobytes() for run in merges.piece(data))
        ids = list(map(merges.first.__getitem__, data))
        ids[-1] = merges.last[data[-1]]
        out = array("I", merges.merge_short(ids)).tobytes()
        if len(self) >= CACHED_PIECES:
            self.clear()
        self[piece] = out
        return out


class _Chunks(dict):
    """The same for what stands between two single spaces, of one or more pieces."""

    def __init__(self, pieces: _Pieces, find, lead: str):
        super().__init__()
        self.pieces, self.find, self.lead = pieces, find, lead

    def __missing__(self, chunk: str) -> bytes:
        out = b"".join(map(self.pieces.__getitem__, self.find(self.lead + chunk)))
        if len(chunk) <= CACHED_BYTES:
            if len(self) >= CACHED_PIECES:
                self.clear()
            self[chunk] = out
        return out


class Encoder:
    """Text to ids, block by block."""

    def __init__(self, path: str):
        self.merges = Merges(path)
        self.rules = Tokenizer.from_file(path)
        words = self.rules.normalizer is not None
        self.find = regex.compile(WORD_SPLIT if words else BYTE_LEVEL_SPLIT).findall
        self.pieces = _Pieces(self.merges)
        self.prepare = self._lower if words else None
        # A space of the word vocabulary is dropped; one of the byte-level vocabulary leads the next piece.
        self.chunks = _Chunks(self.pieces, self.find, "" if words else " ")
        self.uneven = (lambda block: None) if words else re.compile(r"\s | \s|^ | $").search
        self.unsettled = regex.compile(f"[^{SETTLED}]").search
        self.cut = regex.compile(r"(?<=[^\s])(?=\s)").search
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.merges.special)) + ")")

    def blocks(self, text: str):
        """Parts of a text; each cut is before white space that follows something else, where a piece always ends."""
        at = 0
        while len(text) - at > BLOCK_CHARS:
            m = self.cut(text, at + BLOCK_CHARS)
            end = m.start() if m else len(text)
            yield text[at:end]
            at = end
        yield text[at:] if at else text

    def _lower(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        if self.unsettled(text):
            return self.rules.normalizer.normalize_str(text)
        return unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3").lower()

    def _plain(self, text: str):
        if self.prepare:
            text = self.prepare(text)
        for block in self.blocks(text):
            if not block.isascii() and self.unsettled(block):
                found = [block[a:b] for _, (a, b) in self.rules.pre_tokenizer.pre_tokenize_str(block)]
            elif self.uneven(block):
                found = self.find(block)
            else:
                first, *rest = block.split(" ")
                yield b"".join(map(self.pieces.__getitem__, self.find(first)))
                yield b"".join(map(self.chunks.__getitem__, rest))
                continue
            yield b"".join(map(self.pieces.__getitem__, found))

    def runs(self, text: str):
        """Runs of little-endian 32-bit ids of the whole text; special strings are tokens of their own."""
        if "<|" not in text:
            yield from self._plain(text)
            return
        for part in self.specials.split(text):
            if part in self.merges.special:
                yield struct.pack("<I", self.merges.special[part])
            elif part:
                yield from self._plain(part)

    def encode(self, text: str) -> bytes:
        return b"".join(self.runs(text))


class Decoder:
    """Ids to text. Bytes of an unfinished character wait; malformed ones become U+FFFD."""

    def __init__(self, merges: Merges):
        self.bytes = merges.bytes
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: bytes) -> str:
        return self.state.decode(b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())))

    def finish(self) -> str:
        out = self.state.decode(b"", True)
        self.state.reset()
        return out


_encoders: dict[str, Encoder] = {}


def tokenizer_path(name_or_path: str) -> str:
    """A path as it is; a bare name is a file of the installed public tokenizers, on each worker."""
    if "/" in name_or_path:
        return name_or_path
    import public_tokenizers

    return public_tokenizers.path(name_or_path)


def encoder(name_or_path: str) -> Encoder:
    """One encoder per worker process and file."""
    if name_or_path not in _encoders:
        _encoders[name_or_path] = Encoder(tokenizer_path(name_or_path))
        gc.freeze()  # the tables of a merge list stay; collections need not walk them
    return _encoders[name_or_path]


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of every whole text."""

    def run(batches):
        enc = encoder(tokenizer)
        for part in small(batches, 256):
            flat = [enc.encode(t) for t in part["text"].to_pylist()]
            offsets = np.cumsum([0, *(len(b) // 4 for b in flat)]).astype(np.int32)
            ids = pa.array(np.frombuffer(b"".join(flat), "<i4"))
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.ListArray.from_arrays(offsets, ids)], names=["doc_id", "ids"])

    docs = id_and_text(docs, id_col, text_col)
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text; null ids are an empty text."""

    def run(batches):
        dec = Decoder(encoder(tokenizer).merges)
        for batch in small(batches):
            texts = [dec.feed(np.array(ids or [], "<u4").tobytes()) + dec.finish() for ids in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.string())], names=["doc_id", "text"])

    frame = encoded.selectExpr(f"`{id_col}` AS doc_id", f"`{ids_col}` AS ids")
    return frame.mapInArrow(run, f"doc_id {frame.schema['doc_id'].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode run by run without holding either: doc_id, n_tokens, digests of ids and of the decoded text, n_chars."""

    def run(batches):
        enc = encoder(tokenizer)
        dec = Decoder(enc.merges)
        for batch in small(batches):
            rows = []
            for text in batch["text"].to_pylist():
                ids_sha, text_sha, n, chars = hashlib.sha256(), hashlib.sha256(), 0, 0
                for ids in enc.runs(text):
                    ids_sha.update(ids)
                    n += len(ids) // 4
                    part = dec.feed(ids)
                    chars += len(part)
                    text_sha.update(part.encode("utf-8"))
                rest = dec.finish()
                text_sha.update(rest.encode("utf-8"))
                rows.append((n, ids_sha.hexdigest(), text_sha.hexdigest(), chars + len(rest)))
            n, a, b, c = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(c, pa.int64())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "decoded_chars"],
            )

    docs = id_and_text(docs, id_col, text_col)
    key = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {key}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, decoded_chars bigint")
