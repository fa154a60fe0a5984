"""Repeated byte strings by fingerprints at sampled positions.

A string of ``length`` bytes that occurs twice contains, both times at the same place, the smallest
hash of its ``SEED``-byte substrings; only positions that are smallest in some window are looked
at, one for each run of windows that they speak for. Spark groups (rank, position) rows: first by
the seed's rank, then by those of whole runs, of their parts and of single windows around it, made
of differences of prefix hashes. Nothing is doubled. Positions whose rank is unique leave. A run of windows whose whole string has an
earlier copy is settled as repeated, and so is not split; the others are ranked once more in
parts of ``PART`` windows, and what is left of these window by window. Equal rows
are combined before they are shuffled, so a passage in a third of all texts is no hot group, and a
text meets its positions by joins on its own number.

Ranks are hashes of the strings: 64 bits where a rank only keeps a position, 128 where it decides.

Defined results: a null text is empty; nothing is removed from texts shorter than ``length``; rows
that share an id, or have none, follow each other by text, and rows without an id come first; an
empty table gives an empty table; other columns are ignored.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genopair.llm.common import Scratch, id_and_text, mix64, restored, small

LENGTH = 100
SEED = 37
PART = 8
BUFFER = 1 << 20

_BASE = 0x5851F42D4C957F2D
_LETTERS = [mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(k)) for k in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)]
_powers: list[np.ndarray] = []


def _power_tables() -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, up to a buffer's length."""
    if not _powers:
        size = 2 * BUFFER + 4096
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            _powers.append(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, base, np.uint64)])))
    return _powers


class _Hashes:
    """Hashes of all substrings of a buffer."""

    def __init__(self, data: np.ndarray, kinds: int = 2):
        power, self.inverse = _power_tables()
        self.sums = []
        for letters in _LETTERS[:kinds]:
            s = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(letters[data] * power[: len(data)], out=s[1:])
            self.sums.append(s)

    def of(self, start: np.ndarray, end: np.ndarray, kind: int = 0, salt: np.ndarray | None = None) -> np.ndarray:
        s = self.sums[kind]
        h = (s[end] - s[start]) * self.inverse[start] + (end - start).astype(np.uint64)
        return mix64(h if salt is None else h ^ mix64(salt.astype(np.uint64) + np.uint64(1)))


def _slices(ids: list, texts: list[bytes], length: int):
    """Buffers of whole texts, and of parts of very long ones that overlap by all but one byte of a window.

    Yields (ids, offsets of the parts in their texts, parts).
    """
    held: tuple[list, list, list] = ([], [], [])
    size = 0
    for i, t in zip(ids, texts):
        for at in range(0, max(1, len(t) - length + 1), BUFFER):
            part = t[at : at + BUFFER + length - 1]
            if len(part) < length:
                continue
            if size and size + len(part) > BUFFER + length:
                yield held
                held, size = ([], [], []), 0
            for column, value in zip(held, (i, at, part)):
                column.append(value)
            size += len(part)
    if size:
        yield held


def _running_min(v: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while done * 2 <= width:
        v = np.minimum(v[:-done], v[done:])
        done *= 2
    return np.minimum(v[: len(v) - (width - done)], v[width - done :]) if done < width else v


def _suffixes(parts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """For each run of windows with one smallest seed: number of the part, the seed's hash, its place and the first and last window."""
    data = np.frombuffer(b"".join(parts), np.uint8)
    starts = np.cumsum([0, *map(len, parts)])
    h = _Hashes(data, 1)
    at = np.arange(len(data) - SEED + 1)
    rank = h.of(at, at + SEED)
    low = np.uint64((1 << 24) - 1)
    least = _running_min((rank & ~low) | at.astype(np.uint64), length - SEED + 1)
    seed = (least & low).astype(np.int64)
    part = np.repeat(np.arange(len(parts)), np.diff(starts))
    inside = part[: len(seed)] == part[length - 1 :]
    changes = (seed[1:] != seed[:-1]) | (inside[1:] != inside[:-1]) | (part[1 : len(seed)] != part[: len(seed) - 1])
    first = np.concatenate([[0], np.flatnonzero(changes) + 1])
    last = np.append(first[1:], len(seed)) - 1
    first, last = first[inside[first]], last[inside[first]]
    own = part[first]
    return own, rank[seed[first]], seed[first] - starts[own], first - starts[own], last - starts[own]


# A run of windows as one number: place of the seed, bytes before it in the first window, and further windows.
_BITS = 7


def _code(seed, first, last):
    return seed << (2 * _BITS) | (seed - first) << _BITS | (last - first)


def _decode(code):
    mask = (1 << _BITS) - 1
    seed = code >> (2 * _BITS)
    first = seed - (code >> _BITS & mask)
    return seed, first, first + (code & mask)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _find_suffixes(length: int):
    def run(batches):
        for batch in small(batches):
            texts = [t.encode("utf-8") for t in batch["text"].to_pylist()]
            for ids, offsets, parts in _slices(batch["uid"].to_pylist(), texts, length):
                own, rank, seed, first, last = _suffixes(parts, length)
                off = np.array(offsets)[own]
                code = _code(seed + off, first + off, last + off)
                yield pa.RecordBatch.from_arrays([_signed(rank), pa.array(np.array(ids, np.int64)[own]), pa.array(code)], names=["seed", "uid", "code"])

    return run


def _texts_with_codes(batches):
    """uid, bytes and codes of each text, by first window; the codes' own order turns the two halves of a run at a part's border around."""
    for batch in small(batches, 128):
        uids, texts, codes = batch["uid"].to_pylist(), batch["text"].to_pylist(), batch["codes"]
        for k in range(batch.num_rows):
            c = codes[k].values.to_numpy()
            yield uids[k], texts[k].encode("utf-8"), c[np.argsort(_decode(c)[1])]


def _stretches(batches, length: int):
    """Buffers of parts of texts that hold runs: bytes, and for each run its text's uid, its code and where its text begins."""
    held, size = [], 0
    for uid, text, codes in _texts_with_codes(batches):
        _, first, last = _decode(codes)
        k = 0
        while k < len(codes):
            end = int(np.searchsorted(first, first[k] + BUFFER // 2))
            part = text[first[k] : last[end - 1] + length]
            if size and size + len(part) > BUFFER:
                yield _joined(held)
                held, size = [], 0
            held.append((part, np.full(end - k, uid, np.int64), codes[k:end], np.full(end - k, size - first[k])))
            size += len(part)
            k = end
    if held:
        yield _joined(held)


def _joined(held: list) -> tuple:
    parts, *columns = zip(*held)
    return b"".join(parts), *map(np.concatenate, columns)


def _rank_runs(length: int):
    """Ranks of the whole strings of runs, and of their seeds."""

    def run(batches):
        for data, uid, code, base in _stretches(batches, length):
            h = _Hashes(np.frombuffer(data, np.uint8))
            seed, first, last = _decode(code)
            ends = first + base, last + base + length
            shape = (seed - first) << _BITS | (last - first)
            rank = h.of(seed + base, seed + base + SEED)
            yield pa.RecordBatch.from_arrays(
                [_signed(h.of(*ends, 0, shape)), _signed(h.of(*ends, 1, shape)), _signed(rank), pa.array(uid), pa.array(first), pa.array(code)],
                names=["r1", "r2", "seed", "uid", "first", "code"],
            )

    return run


def _cut_strings(length: int):
    """The strings of runs, to be split further without their texts."""

    def run(batches):
        for data, uid, code, base in _stretches(batches, length):
            _, first, last = _decode(code)
            ends = zip((first + base).tolist(), (last + base + length).tolist())
            strings = pa.array([data[a:b] for a, b in ends], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(uid), pa.array(code), strings], names=["uid", "code", "string"])

    return run


def _buffered(batch: pa.RecordBatch):
    """Slices of a table of strings, with their bytes as one buffer and where each begins."""
    for at in range(0, batch.num_rows, 8192):
        part = batch.slice(at, 8192)
        strings = part["string"].to_pylist()
        data = np.frombuffer(b"".join(strings), np.uint8)
        yield part, _Hashes(data), np.cumsum([0, *map(len, strings)])[:-1]


def _rank_parts(length: int):
    """Ranks of parts of runs: of a part's own string, and of what all windows of a full part would share."""

    def run(batches):
        for batch in batches:
            for part, h, base in _buffered(batch):
                seed, first, last = _decode(part["code"].to_numpy())
                low, high = seed - last, seed - first  # the seed's place in the last window and in the first
                n = high // PART - low // PART + 1
                row = np.repeat(np.arange(len(n)), n)
                k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + (low // PART)[row]
                d1, d2 = np.maximum(low[row], k * PART), np.minimum(high[row], k * PART + PART - 1)
                zero = base[row] + high[row]  # where the seed is
                own = zero - d2, zero - d1 + length
                shape = d1 << _BITS | d2
                shared = h.of(zero - k * PART, zero - k * PART - PART + 1 + length, 0, k)
                yield pa.RecordBatch.from_arrays(
                    [
                        _signed(h.of(*own, 0, shape)),
                        _signed(h.of(*own, 1, shape)),
                        _signed(shared),
                        pa.array(part["uid"].to_numpy()[row]),
                        pa.array(seed[row] - d2),
                        pa.array(part["code"].to_numpy()[row]),
                        pa.array(d2 - d1),
                    ],
                    names=["r1", "r2", "seed", "uid", "first", "code", "more"],
                )

    return run


def _rank_windows(length: int):
    """Ranks of single windows of the parts named by their first window and how many follow."""

    def run(batches):
        for batch in batches:
            for part, h, base in _buffered(batch):
                _, first, _ = _decode(part["code"].to_numpy())
                lists = part["parts"].to_pylist()
                n = np.array([len(x) for x in lists])
                row = np.repeat(np.arange(len(n)), n)
                start = np.array([p["first"] for x in lists for p in x], np.int64)
                more = np.array([p["more"] for x in lists for p in x], np.int64) + 1
                each = np.repeat(np.arange(len(row)), more)
                window = start[each] + np.arange(len(each)) - np.repeat(np.cumsum(more) - more, more)
                at = base[row[each]] + window - first[row[each]]
                yield pa.RecordBatch.from_arrays(
                    [_signed(h.of(at, at + length)), _signed(h.of(at, at + length, 1)), pa.array(part["uid"].to_numpy()[row[each]]), pa.array(window)],
                    names=["r1", "r2", "uid", "first"],
                )

    return run


def _merged(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["start"], s["end"]) for s in spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _remove(batches):
    for batch in small(batches):
        rows = []
        for text, spans in zip(batch["text"].to_pylist(), batch["spans"].to_pylist()):
            data, kept, at = text.encode("utf-8"), [], 0
            spans = _merged(spans or [])
            for a, b in spans:
                kept.append(data[at:a])
                at = b
            kept = b"".join([*kept, data[at:]])
            rows.append((len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept, kept.decode("utf-8", "ignore")))
        cols = list(zip(*rows)) or [()] * 6
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string())
        rest = [c for c in batch.schema.names if c not in ("text", "spans")]
        names = [*rest, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "text"]
        yield pa.RecordBatch.from_arrays([*(batch[c] for c in rest), *(pa.array(c, t) for c, t in zip(cols, types))], names=names)


def _numbered(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """uid, doc_id, text, where uid orders texts as ids do. Ids serve as they are unless some repeat or are missing."""
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"))
    unclear = ids.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 OR doc_id IS NULL")
    if unclear.isEmpty():
        return docs.select(F.col("doc_id").cast("bigint").alias("uid"), "*")
    order = [F.col("doc_id").cast("bigint"), F.col("text")]
    placed = docs.repartitionByRange(*order, F.xxhash64("text")).sortWithinPartitions(*order)
    return scratch.write(placed.select(F.monotonically_increasing_id().alias("uid"), "*"), "numbered")


def _first_and_later(ranked: DataFrame, scratch: Scratch, name: str, more: list[str]) -> tuple[DataFrame, DataFrame]:
    """Of rows with equal (r1, r2) the earliest, and all the others."""
    firsts = ranked.groupBy("r1", "r2").agg(F.min(F.struct("uid", "first", *more)).alias("m")).select("m.*")
    firsts = scratch.write(firsts, f"{name}-first")
    key = ["uid", "first", *(c for c in more if c == "code")]
    return firsts, ranked.join(firsts.select(*key), key, "left_anti")


def _not_alone(firsts: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Those whose seed rank another one shares. The shared ranks are a table, so that Spark can split a join on a frequent one."""
    shared = scratch.write(firsts.groupBy("seed").agg(F.count("*").alias("n")).where("n > 1").select("seed"), name)
    return firsts.join(shared, "seed", "left_semi")


def repeated_spans(docs: DataFrame, scratch: Scratch, length: int = LENGTH) -> DataFrame:
    """uid, start and end of strings, ``length`` bytes or longer, all of whose windows occur earlier. ``docs`` has uid and text."""
    found = scratch.write(docs.select("uid", "text").mapInArrow(_find_suffixes(length), "seed bigint, uid bigint, code bigint"), "suffixes")
    again = scratch.write(found.groupBy("seed").agg(F.count("*").alias("n")).where("n > 1").select("seed"), "again")
    codes = found.join(again, "seed", "left_semi").groupBy("uid").agg(F.collect_list("code").alias("codes"))
    codes = scratch.write(codes, "repeated-seeds")
    scratch.drop(found)
    scratch.release()

    texts = docs.select("uid", "text")
    with_codes = texts.join(codes.hint("shuffle_hash"), "uid")
    schema = "r1 bigint, r2 bigint, seed bigint, uid bigint, first bigint, code bigint"
    runs = scratch.write(with_codes.mapInArrow(_rank_runs(length), schema), "runs")
    scratch.drop(codes)
    scratch.release()
    firsts, later = _first_and_later(runs, scratch, "runs", ["code", "seed"])
    more = F.col("code").bitwiseAND((1 << _BITS) - 1)
    span = lambda df, n: df.select("uid", F.col("first").alias("start"), (F.col("first") + n + length).alias("end"))
    spans = [scratch.write(span(later, more), "repeated-runs")]
    codes = scratch.write(_not_alone(firsts, scratch, "shared-by-runs").groupBy("uid").agg(F.collect_list("code").alias("codes")), "open-runs")
    scratch.drop(runs)
    scratch.drop(firsts)
    scratch.release()

    with_codes = texts.join(codes.hint("shuffle_hash"), "uid")
    strings = scratch.write(with_codes.mapInArrow(_cut_strings(length), "uid bigint, code bigint, string binary"), "strings")
    scratch.release()
    parts = scratch.write(strings.mapInArrow(_rank_parts(length), f"{schema}, more bigint"), "parts")
    firsts, later = _first_and_later(parts, scratch, "parts", ["code", "seed", "more"])
    spans.append(scratch.write(span(later, F.col("more")), "repeated-parts"))
    open_parts = _not_alone(firsts, scratch, "shared-by-parts").groupBy("uid", "code").agg(F.collect_list(F.struct("first", "more")).alias("parts"))
    windows = strings.join(open_parts, ["uid", "code"]).mapInArrow(_rank_windows(length), "r1 bigint, r2 bigint, uid bigint, first bigint")
    windows = scratch.write(windows, "windows")
    scratch.drop(parts)
    scratch.drop(strings)
    _, later = _first_and_later(windows, scratch, "windows", [])
    spans.append(scratch.write(span(later, F.lit(0)), "repeated-windows"))
    scratch.release()
    return spans[0].unionByName(spans[1]).unionByName(spans[2])


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Every row's doc_id, the columns named in ``keep``, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes that stay)
    and text (kept, without what is left of a character that a string's end has split)."""
    scratch = Scratch(docs.sparkSession, "suffix")
    numbered = _numbered(id_and_text(docs, id_col, text_col, keep), scratch)
    spans = repeated_spans(numbered, scratch, length)
    spans = spans.groupBy("uid").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    joined = numbered.join(spans.hint("shuffle_hash"), "uid", "left").drop("uid")
    carried = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in joined.schema if f.name not in ("text", "spans"))
    out = joined.mapInArrow(_remove, f"{carried}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary, text string")
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "text", *restored(keep))
