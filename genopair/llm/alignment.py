"""Alignment of two tokenizers' tokens over the bytes of each text.

Tokens of both kinds are intervals of bytes. Every token points to the token that overlaps it and
reaches farthest to the right; doubling these successors, for all texts of a slice at once, takes
each token to the last one of its connected component, which names the component: the bytes
between two offsets where tokens of both kinds end. How many documents link a pair of ids is
counted over all of them. The most frequent pairs, ``KNOWN_PAIRS`` at most, go to all tasks as
sorted arrays; every other pair is joined by key, and none of those is in many documents.

Defined results: a text that is null or empty, or that either kind of tokens does not spell byte by
byte with one space before it, has no tokens, counts of zero and an empty digest; each row is a
document, also repeated rows and rows without an id; an empty table gives an empty table; other
columns are ignored.
"""

import gc
import hashlib
import re

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from genopair.llm.bpe import BYTE_LEVEL_SPLIT, SETTLED, Merges, tokenizer_path
from genopair.llm.common import Scratch, buffers, id_and_text

KNOWN_PAIRS = 1 << 20
SLICE_BYTES = 1 << 20
KEYS_PER_ROW = 1 << 13
ROWS_PER_SLICE = 512


class ByteLevel:
    """A byte-level vocabulary of merges, with special strings as plain text."""

    def __init__(self, path: str):
        merges = Merges(path)
        special = set(merges.special.values())
        self.bytes = merges.bytes
        ranks = {b: i for i, b in enumerate(merges.bytes) if b and i not in special}
        self.fast = tiktoken.Encoding(path, pat_str=BYTE_LEVEL_SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.rules = Tokenizer.from_file(path)
        self.rules.encode_special_tokens = True
        self.rules.no_truncation()
        self.rules.no_padding()
        self.unsettled = regex.compile(f"[^{SETTLED}]").search

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text behind one space. Characters whose class depends on the version of Unicode go by the file's own rules."""
        return [self.rules.encode(" " + t, add_special_tokens=False).ids if self.unsettled(t) else self.fast.encode_ordinary(" " + t) for t in texts]


class Pieces:
    """A vocabulary of pieces, which sets a space before the text itself."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode("utf-8") for p in names]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


class Vocabulary:
    """Either kind of file, with what the alignment needs of its tokens: lengths, and their numbers as text before a separator."""

    def __init__(self, name_or_path: str, inside: str, after: str):
        path = tokenizer_path(name_or_path)
        self.kind = ByteLevel(path) if path.endswith(".json") else Pieces(path)
        self.encode, self.bytes = self.kind.encode, self.kind.bytes
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)
        # entry 2 i: id i within a group; entry 2 i + 1: id i as the last one of its kind there
        self.names = [f"{i}{s}" for i in range(len(self.bytes)) for s in (inside, after)]


_vocabularies: dict[tuple, Vocabulary] = {}


def vocabulary(name_or_path: str, inside: str, after: str) -> Vocabulary:
    key = name_or_path, inside, after
    if key not in _vocabularies:
        _vocabularies[key] = Vocabulary(*key)
        gc.freeze()
    return _vocabularies[key]


def successors(end_a: np.ndarray, end_b: np.ndarray) -> np.ndarray:
    """For each token, first those of A and then those of B, the last token of its component, always one of B.

    ``end_a`` and ``end_b`` are rising offsets where tokens end, the last one of both the same.
    """
    n_a, n_b = len(end_a), len(end_b)
    # The B token with A's last byte ends there or later; the A token with B's last byte may end later.
    to_b, to_a = np.searchsorted(end_b, end_a), np.searchsorted(end_a, end_b)
    farther = end_a[np.minimum(to_a, max(n_a - 1, 0))] > end_b
    succ = np.concatenate([n_a + to_b, np.where(farther, to_a, n_a + np.arange(n_b))])
    while True:
        twice = succ[succ]
        if np.array_equal(twice, succ):
            return succ
        succ = twice


class Slice:
    """The tokens of some texts, text after text, and their alignment."""

    def __init__(self, a: Vocabulary, b: Vocabulary, texts: list[str]):
        none = np.zeros(0, np.int64)
        filled = [k for k, t in enumerate(texts) if t]
        ids_a, ids_b = [none] * len(texts), [none] * len(texts)
        for k, x, y in zip(filled, a.encode([texts[k] for k in filled]), b.encode([texts[k] for k in filled])):
            whole = b" " + texts[k].encode("utf-8")
            x, spelt = np.array(x, np.int64), b"".join(map(b.bytes.__getitem__, y))
            # merges of a text's own bytes spell it if they are as long
            if spelt == whole and a.lengths[x].sum() == len(whole):
                ids_a[k], ids_b[k] = x, np.array(y, np.int64)
        self.n_a, self.n_b = (np.array([len(x) for x in ids], np.int64) for ids in (ids_a, ids_b))
        self.a, self.b = (np.concatenate([none, *ids], dtype=np.int64) for ids in (ids_a, ids_b))
        doc = np.arange(len(texts))
        self.doc_a, self.doc_b = np.repeat(doc, self.n_a), np.repeat(doc, self.n_b)
        # Offsets in the texts that have tokens, one behind the other.
        self.end_a, self.end_b = np.cumsum(a.lengths[self.a]), np.cumsum(b.lengths[self.b])
        succ = successors(self.end_a, self.end_b)
        last = succ[len(self.a) :] == len(self.a) + np.arange(len(self.b))
        number = np.cumsum(last) - 1
        self.group_a, self.group_b = (number[s - len(self.a)] for s in np.split(succ, [len(self.a)]))
        self.n_groups = np.bincount(self.doc_b[last], minlength=len(texts))
        self.vocabularies = a, b

    def digests(self) -> list[str]:
        """Of each text, the digest of its groups ``a1,a2|b1;...``, empty without tokens."""
        a, b = self.vocabularies
        n = int(self.group_b[-1]) + 1 if len(self.b) else 0
        sizes_a, sizes_b = (np.bincount(g, minlength=n) for g in (self.group_a, self.group_b))
        before_a, before_b = (np.cumsum(s) - s for s in (sizes_a, sizes_b))
        # A group's tokens of A stand before those of B, all after those of earlier groups.
        order = np.empty(len(self.a) + len(self.b), np.int64)
        at_a, at_b = np.arange(len(self.a)), np.arange(len(self.b))
        final_a, final_b = (np.append(g[1:] != g[:-1], True) if len(g) else np.zeros(0, bool) for g in (self.group_a, self.group_b))
        order[at_a + before_b[self.group_a]] = 2 * self.a + final_a
        order[at_b + (before_a + sizes_a)[self.group_b]] = 2 * len(a.bytes) + 2 * self.b + final_b
        names, edge, out = self._names(), np.cumsum(self.n_a + self.n_b), []
        for at, end in zip(edge - self.n_a - self.n_b, edge):
            text = "".join(map(names, order[at:end].tolist()))
            out.append(hashlib.sha256(text[:-1].encode("ascii")).hexdigest() if text else "")
        return out

    def _names(self):
        a, b = self.vocabularies
        if not hasattr(a, "with_other"):
            a.with_other = a.names + b.names
        return a.with_other.__getitem__

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Text and pair key of each link. Two tokens that overlap share one stretch between neighbouring ends of either kind."""
        _, b = self.vocabularies
        n = len(self.a)
        both = np.isin(self.end_a, self.end_b, assume_unique=True) if n else np.zeros(0, bool)
        # Ends of A, and those of B alone, merged; an end's tokens are the first ones that reach it.
        alone = np.ones(len(self.b), bool)
        alone[np.searchsorted(self.end_b, self.end_a[both])] = False
        order = np.argsort(np.concatenate([self.end_a, self.end_b[alone]]), kind="stable")
        of_a = order < n
        of_b = ~of_a
        of_b[of_a] = both
        at_a, at_b = np.cumsum(of_a) - of_a, np.cumsum(of_b) - of_b
        return self.doc_a[at_a], self.a[at_a] * len(b.bytes) + self.b[at_b]


DOCUMENT = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"


def aligned(docs: DataFrame, tokenizer_a: str, tokenizer_b: str) -> DataFrame:
    """A row per document with a number, its counts and digest, and its different pairs with how often each is linked.

    A document with more than ``KEYS_PER_ROW`` pairs has further rows for them, with its number and nothing else.
    """
    key_type = docs.schema["doc_id"].dataType
    ids_type = pa.int64() if key_type.simpleString() == "bigint" else None

    def run(batches):
        a, b = vocabulary(tokenizer_a, ",", "|"), vocabulary(tokenizer_b, ",", ";")
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_PER_SLICE):
                part = batch.slice(at, ROWS_PER_SLICE)
                for ids, texts in buffers(part["doc_id"].to_pylist(), part["text"].to_pylist(), SLICE_BYTES):
                    found = Slice(a, b, [t.decode("utf-8") for t in texts])
                    yield from rows_of(found, ids, number)
                    number += len(ids)

    def rows_of(found: Slice, ids: list, number: int):
        doc, key = found.links()
        n_links = np.bincount(doc, minlength=len(ids))
        pairs = np.lexsort((key, doc))
        doc, key = doc[pairs], key[pairs]
        first = np.append(True, (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])) if len(doc) else np.zeros(0, bool)
        times = np.diff(np.append(np.flatnonzero(first), len(doc)))
        doc, key = doc[first], key[first]
        # Cut each document's pairs into rows; one row at least for each document.
        start = np.searchsorted(doc, np.arange(len(ids) + 1))
        cuts = [(k, at, at == start[k]) for k in range(len(ids)) for at in range(start[k], max(start[k + 1], start[k] + 1), KEYS_PER_ROW)]
        of, offsets, main = (np.array(x) for x in zip(*cuts))
        offsets = np.append(np.minimum(offsets, len(key)), len(key)).astype(np.int32)
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x, t)) for x, t in ((key, pa.int64()), (times, pa.int32()))]
        only = lambda x, t=pa.int64(): pa.array([x[k] if m else None for k, m in zip(of.tolist(), main.tolist())], t)
        counts = [only(x.tolist()) for x in (found.n_a, found.n_b, found.n_groups, n_links)]
        yield pa.RecordBatch.from_arrays(
            [only(ids, ids_type), pa.array(number + of), pa.array(main), *counts, only(found.digests(), pa.string()), *lists],
            names=["doc_id", "number", "main", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"],
        )

    schema = f"doc_id {key_type.simpleString()}, number bigint, main boolean, {DOCUMENT}, pairs array<bigint>, times array<int>"
    return docs.mapInArrow(run, schema)


def pair_counts(pairs: DataFrame, n_b_ids: int, scratch: Scratch) -> DataFrame:
    """pair, n: how many documents link it; best: whether no pair of the same A id is in more."""
    counts = scratch.write(pairs.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")), "counts")
    id_a = F.expr(f"pair div {n_b_ids}")
    most = counts.groupBy(id_a.alias("id_a")).agg(F.max("n").alias("most"))
    return scratch.write(counts.join(most, id_a == F.col("id_a")).select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pair-counts")


def most_frequent(counts: DataFrame, limit: int) -> pa.Table:
    """The pairs whose counts reach the lowest power of two that not more than ``limit`` pairs reach, by pair."""
    level = F.floor(F.log2("n")).cast("int")
    sizes = {r["level"]: r["size"] for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("size")).collect()}
    least, total = max(sizes, default=0) + 1, 0
    while least and total + sizes.get(least - 1, 0) <= limit:
        least, total = least - 1, total + sizes.get(least - 1, 0)
    return counts.where(level >= least).toArrow().sort_by("pair")


def align(docs: DataFrame, tokenizer_a: str, tokenizer_b: str, id_col: str = "doc_id", text_col: str = "text", known_pairs: int = KNOWN_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every document."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "alignment")
    n_b_ids = len(vocabulary(tokenizer_b, ",", ";").bytes)
    rows = scratch.write(aligned(id_and_text(docs, id_col, text_col), tokenizer_a, tokenizer_b), "aligned")
    counts = pair_counts(rows, n_b_ids, scratch)
    known = most_frequent(counts, known_pairs)
    held = spark.sparkContext.broadcast(tuple(known[c].to_numpy() for c in ("pair", "n", "best")))

    def run(batches):
        pair, n, best = held.value
        for batch in batches:
            lists = batch["pairs"]
            row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            key, times = lists.flatten().to_numpy(), batch["times"].flatten().to_numpy().astype(np.int64)
            at = np.minimum(np.searchsorted(pair, key), max(len(pair) - 1, 0))
            here = pair[at] == key if len(pair) else np.zeros(len(key), bool)
            sums = [np.bincount(row[here], weights=w, minlength=batch.num_rows).astype(np.int64) for w in (times[here] * best[at[here]], times[here] * n[at[here]])]
            number = batch["number"].to_numpy()
            none = pa.nulls(batch.num_rows, pa.int64())
            names = ["number", "n_best", "count_sum", "pair", "times"]
            yield pa.RecordBatch.from_arrays([pa.array(number), *map(pa.array, sums), none, none], names=names)
            rest = ~here
            empty = pa.nulls(int(rest.sum()), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(number[row[rest]]), empty, empty, pa.array(key[rest]), pa.array(times[rest])], names=names)

    met = rows.select("number", "pairs", "times").mapInArrow(run, "number bigint, n_best bigint, count_sum bigint, pair bigint, times bigint")
    met = scratch.write(met, "met")
    rare = met.where("pair IS NOT NULL").join(counts, "pair")
    rare = rare.select("number", F.when(F.col("best"), F.col("times")).otherwise(0).alias("n_best"), (F.col("times") * F.col("n")).alias("count_sum"))
    sums = met.where("pair IS NULL").select("number", "n_best", "count_sum").unionByName(rare)
    sums = sums.groupBy("number").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    out = rows.where("main").join(sums, "number")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
