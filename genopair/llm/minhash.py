"""Near-duplicates by BagMinHash on multisets of five-word shingles.

The weight axis of a shingle is cut into the intervals (0, 1], (1, 2], (2, 4], (4, 8] and so on.
Each interval of each shingle carries a Poisson process whose rate is the interval's width; a
point has a time, a component of the signature and, inside an interval that the shingle's count
covers in part, a place on the weight axis by which it is kept or not. A component is the
earliest point that falls on it, so two components agree with the probability of the weighted
Jaccard similarity. Points are drawn in order of time and a process ends once it is behind every
component, so long texts cost little more than one point for each shingle.

Texts with equal multisets are one class from the start. Bands of the signature propose
candidates, which are verified exactly, on the multisets. First each member of a bucket meets the
bucket's most central one, which unites a group of copies at the cost of its size. Pairs of a
bucket that are still in different components are compared, too, but for those that can't be
similar: because what a text shares with any other undecided one weighs too little, alone or
beside the other's weight. So no link between different texts that share a band is lost.

Defined results: a text of one to four words is one shingle; a null or empty text, or one of white
space, is alone in its class; a row without an id is alone, with a null class; rows that share an
id share a class; an empty table gives an empty table; other columns are ignored.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from genopair.llm.common import Scratch, buffers, id_and_text, mix64, small
from genopair.llm.components import components

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 4
ROUNDING = 1e-9
GOLDEN = np.uint64(0x9E3779B97F4A7C15)

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * GOLDEN)


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different shingles of each text, as (text number, 64-bit hash, count), by text and hash.

    Words are what stands between ASCII white space.
    """
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    starts_of_text = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
    gap = _SPACE[data]
    first = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]]))
    last = np.flatnonzero(~gap & np.concatenate([gap[1:], [True]])) + 1
    none = np.zeros(0, np.uint64)
    if not len(first):
        return np.zeros(0, np.int64), none, np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        # A word's hash is a polynomial in its bytes, from sums of powers up to its ends.
        powers = np.cumprod(np.full(int((last - first).max()), 0x2545F4914F6CDD1D | 1, np.uint64))
        word_of = np.repeat(np.arange(len(first)), last - first)
        at = np.flatnonzero(~gap)
        sums = np.add.reduceat(_BYTE[data[at]] * powers[at - first[word_of]], np.concatenate([[0], np.cumsum(last - first)[:-1]]))
        word = mix64(sums + (last - first).astype(np.uint64) * GOLDEN)
        text = np.searchsorted(starts_of_text, first, side="right") - 1
        n_words = np.bincount(text, minlength=len(texts))
        begin = np.concatenate([[0], np.cumsum(n_words)[:-1]])
        k = np.arange(len(word)) - begin[text]
        h = np.zeros(len(word), np.uint64)
        for j in range(WORDS):
            there = np.minimum(np.arange(len(word)) + j, len(word) - 1)
            inside = k + j < n_words[text]
            h = mix64(h * GOLDEN + np.where(inside, word[there], np.uint64(j + 1)))
        whole = (k + WORDS <= n_words[text]) | ((k == 0) & (n_words[text] < WORDS))
    text, h = text[whole], h[whole]
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    new = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (h[1:] != h[:-1])]))
    return text[new], h[new], np.diff(np.append(new, len(h)))


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(n_texts: int, text: np.ndarray, h: np.ndarray, count: np.ndarray, size: int) -> np.ndarray:
    """Times of the first points on each of ``size`` components, one row for each text; infinite without shingles."""
    out = np.full((n_texts, size), np.inf)
    flat = out.ravel()
    level = np.zeros(len(count), np.int64)
    who = [np.arange(len(count))]
    levels = [level]
    reach = 1
    while (more := np.flatnonzero(count > reach)).size:
        who.append(more)
        levels.append(np.full(len(more), len(who) - 1))
        reach *= 2
    who, level = np.concatenate(who), np.concatenate(levels)
    with np.errstate(over="ignore"):
        state = mix64(h[who] + (level.astype(np.uint64) + np.uint64(1)) * GOLDEN)
    low = np.where(level == 0, 0.0, 2.0 ** (level - 1))
    width = np.where(level == 0, 1.0, low)
    covered = np.minimum(count[who] - low, width)
    text_of, time = text[who], np.zeros(len(who))
    while len(state):
        with np.errstate(over="ignore"):
            state = state + GOLDEN
            draw = mix64(state)
            place = mix64(draw ^ np.uint64(0xD6E8FEB86659FD93))
            component = (mix64(place ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)
        time = time - np.log(_uniform(draw)) / width
        keep = _uniform(place) * width <= covered
        slot = text_of[keep] * size + component[keep].astype(np.int64)
        np.minimum.at(flat, slot, time[keep])
        some, where = np.unique(text_of, return_inverse=True)
        go = time <= out[some].max(axis=1)[where]
        state, time, text_of, width, covered = state[go], time[go], text_of[go], width[go], covered[go]
    return out


def _sketch(batches, bands: int, rows: int):
    """Two 64-bit sums that tell multisets apart, the number of shingles, and a hash for each band."""
    for batch in small(batches):
        for ids, texts in buffers(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
            text, h, count = shingles(texts)
            sig = signatures(len(texts), text, h, count, bands * rows)
            with np.errstate(over="ignore"):
                c = count.astype(np.uint64)
                sums = []
                for salt in (1, 2):
                    total = np.zeros(len(texts), np.uint64)
                    np.add.at(total, text, mix64(h + np.uint64(salt) * GOLDEN) * c)
                    sums.append(total.view(np.int64))
                band = np.zeros((len(texts), bands), np.uint64)
                for j in range(rows):
                    band = mix64(band * GOLDEN + np.ascontiguousarray(sig[:, j::rows]).view(np.uint64))
            n = np.bincount(text, weights=count, minlength=len(texts)).astype(np.int64)
            flat = pa.ListArray.from_arrays(np.arange(len(texts) + 1, dtype=np.int32) * bands, pa.array(band.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, batch.schema.field("doc_id").type), pa.array(sums[0]), pa.array(sums[1]), pa.array(n), flat],
                names=["doc_id", "k1", "k2", "n", "bands"],
            )


def _bags(batches):
    """The multiset of each text: sorted hashes and their counts, as bytes."""
    for batch in small(batches):
        for ids, texts in buffers(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
            text, h, count = shingles(texts)
            at = np.searchsorted(text, np.arange(len(texts) + 1))
            spans = list(zip(at[:-1], at[1:]))
            count = count.astype(np.uint32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, batch.schema.field("doc_id").type),
                    pa.array([int(count[a:b].sum()) for a, b in spans], pa.int64()),
                    pa.array([h[a:b].tobytes() for a, b in spans], pa.binary()),
                    pa.array([count[a:b].tobytes() for a, b in spans], pa.binary()),
                ],
                names=["doc_id", "total", "hashes", "counts"],
            )


def _shingle_rows(batches):
    """Multisets as rows of hash and count."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            hashes, counts = (part[c].to_pylist() for c in ("hashes", "counts"))
            doc = np.repeat(part["doc_id"].to_numpy(), [len(x) // 8 for x in hashes])
            c = np.frombuffer(b"".join(counts), np.uint32).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(np.frombuffer(b"".join(hashes), np.int64)), pa.array(c)], names=["doc_id", "h", "c"])


def overlap(a: bytes, ca: bytes, b: bytes, cb: bytes) -> float:
    """Weighted Jaccard similarity of two multisets."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    nx, ny = np.frombuffer(ca, np.uint32).astype(np.int64), np.frombuffer(cb, np.uint32).astype(np.int64)
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    same = y[at] == x if len(y) else np.zeros(len(x), bool)
    both = int(np.minimum(nx[same], ny[at[same]]).sum())
    union = int(nx.sum() + ny.sum()) - both
    return both / union if union else 0.0


def _verify(similarity: float):
    def run(batches):
        for batch in small(batches):
            cols = [batch[c].to_pylist() for c in ("hashes", "counts", "hub_hashes", "hub_counts")]
            ok = [overlap(*r) >= similarity for r in zip(*cols)]
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def classes(
    docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, class_id (the smallest id of its near-duplicates, itself included) of every row."""
    scratch = Scratch(docs.sparkSession, "minhash")
    docs = id_and_text(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    schema = "doc_id bigint, k1 bigint, k2 bigint, n bigint, bands array<bigint>"
    sketch = scratch.write(docs.mapInArrow(lambda b: _sketch(b, bands, rows), schema), "sketches")

    # Equal multisets are one class; its smallest id stands for it. The bands are a function of the multiset.
    some = sketch.where("n > 0 AND doc_id IS NOT NULL")
    # A table of its own, so that Spark can split the join on a multiset that many texts share.
    reps = scratch.write(some.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep")), "reps")
    member = scratch.write(some.select("doc_id", "k1", "k2").join(reps, ["k1", "k2"]).select("doc_id", "rep"), "members")
    own = member.where("doc_id = rep").select("doc_id").distinct()
    banded = some.join(own, "doc_id", "left_semi").select("doc_id", F.posexplode("bands").alias("band", "h"))
    bucket = banded.select("doc_id", "band", F.xxhash64("band", "h").alias("bucket"))
    shared = bucket.groupBy("bucket").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("size")).where("lo < hi")
    shared = scratch.write(shared, "shared")
    buckets = scratch.write(bucket.join(shared.select("bucket", "size"), "bucket").distinct(), "buckets")
    asked = buckets.select("doc_id").distinct()
    bags = docs.join(asked, "doc_id", "left_semi").mapInArrow(_bags, "doc_id bigint, total bigint, hashes binary, counts binary")
    bags = scratch.write(bags, "bags")
    scratch.release()

    def verified(pairs):
        sides = pairs.join(bags.drop("total").withColumnRenamed("doc_id", "a"), "a")
        sides = sides.join(bags.select(F.col("doc_id").alias("b"), F.col("hashes").alias("hub_hashes"), F.col("counts").alias("hub_counts")), "b")
        return sides.select("a", "b", "hashes", "counts", "hub_hashes", "hub_counts").mapInArrow(_verify(similarity), "a bigint, b bigint")

    # Every member meets the one of its bucket that shares most buckets with others, as what the others are copies of does.
    centre = buckets.groupBy("doc_id").agg(F.sum("size").alias("weight"))
    weighed = buckets.select("bucket", "doc_id").join(centre, "doc_id")
    hubs = weighed.groupBy("bucket").agg(F.max(F.struct("weight", (-F.col("doc_id")).alias("minus"))).alias("m")).select("bucket", (-F.col("m.minus")).alias("hub"))
    pairs = buckets.select("bucket", "doc_id").join(hubs, "bucket").where("doc_id <> hub")
    pairs = scratch.write(pairs.select(F.least("doc_id", "hub").alias("a"), F.greatest("doc_id", "hub").alias("b")).distinct(), "first-pairs")
    # Rows that share an id link its multisets.
    links = member.where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).join(asked.select(F.col("doc_id").alias("a")), "a", "left_semi")
    links = scratch.write(links.unionByName(verified(pairs)), "first-links")
    scratch.release()
    labels = scratch.write(components(links, scratch).withColumnRenamed("vertex", "doc_id"), "first-labels")

    rest = _undecided(buckets, labels, bags, similarity, scratch)
    more = _pairs_left(rest, similarity).join(pairs, ["a", "b"], "left_anti")
    links = labels.select(F.col("doc_id").alias("a"), F.col("component").alias("b"))
    links = scratch.write(links.unionByName(verified(more)), "links")
    scratch.release()
    labels = scratch.write(components(links, scratch).withColumnRenamed("vertex", "rep"), "labels")

    of_id = member.groupBy("doc_id").agg(F.min("rep").alias("rep"))
    of_id = of_id.join(labels, "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("class_id"))
    return sketch.select("doc_id").join(of_id, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))


def _undecided(buckets: DataFrame, labels: DataFrame, bags: DataFrame, similarity: float, scratch: Scratch) -> DataFrame:
    """Members of buckets that lie in several components, without those that can have no link: bucket, band, doc_id, label, n, common.

    ``common`` is the weight of a text's shingles that another undecided text holds as well. Two texts
    have no more in common than either's, so one whose share of it is below the similarity is alone, and
    so is one whose share does not suffice for the shortest member of its bucket.
    """
    labelled = buckets.join(labels, "doc_id", "left").select("bucket", "band", "doc_id", F.coalesce("component", "doc_id").alias("label"))
    rest, n = scratch.write(labelled, "labelled"), None
    for k in range(3):
        split = rest.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("bucket")
        rest = rest.join(split, "bucket", "left_semi").drop("n", "common")
        members = rest.select("doc_id").distinct()
        held = bags.join(members, "doc_id", "left_semi")
        apart = held.mapInArrow(_shingle_rows, "doc_id bigint, h bigint, c bigint").groupBy("h")
        apart = apart.agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("other"), F.sum("c").alias("c")).where("doc_id = other")
        apart = apart.groupBy("doc_id").agg(F.sum("c").alias("apart"))
        n = held.select("doc_id", F.col("total").alias("n")).distinct().join(apart, "doc_id", "left")
        n = n.select("doc_id", "n", (F.col("n") - F.coalesce("apart", F.lit(0))).alias("common")).where(F.col("common") >= (similarity - ROUNDING) * F.col("n"))
        weighed = scratch.write(rest.join(n, "doc_id"), f"weighed-{k}")
        shortest = weighed.groupBy("bucket").agg(F.min("n").alias("shortest"))
        suffices = F.col("common") * (1 + similarity) >= (similarity - ROUNDING) * (F.col("n") + F.col("shortest"))
        rest = scratch.write(weighed.join(shortest, "bucket").where(suffices).drop("shortest"), f"undecided-{k}")
    return rest


def _pairs_left(rest: DataFrame, similarity: float) -> DataFrame:
    """Pairs of one bucket and two components whose weights allow the similarity, each in the first bucket it shares.

    A similarity s needs an overlap of s / (1 + s) of both weights together.
    """
    before = Window.partitionBy("doc_id").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    rest = rest.withColumn("earlier", F.collect_list("bucket").over(before))
    x, y = rest.alias("x"), rest.alias("y")
    near = (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.doc_id") < F.col("y.doc_id")) & (F.col("x.label") != F.col("y.label"))
    enough = F.least("x.common", "y.common") * (1 + similarity) >= (similarity - ROUNDING) * (F.col("x.n") + F.col("y.n"))
    return x.join(y, near & enough & ~F.arrays_overlap("x.earlier", "y.earlier")).select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b"))
