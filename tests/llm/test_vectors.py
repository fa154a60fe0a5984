import numpy as np
import pytest
from pyspark.sql import functions as F

from genopair.llm import ann, embedding_dedup, graph, vectors
from genopair.llm.common import Scratch, mix64
from genopair.storage import read_pickled

SF = "/root/testdata/sf0.1"
SCHEMA = "vec_id bigint, embedding array<float>, label int, v string, shard string, rank string, score string"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, "a", "b", "c", "d") for i, v in rows], SCHEMA)


def usable(rows):
    ok = lambda v: v is not None and len(v) == 3 and all(x is not None and np.isfinite(x) for x in v) and any(v)
    return [(i, np.float32(v).astype(float)) for i, v in rows if i is not None and ok(v)]


def links(rows, cosine=0.95):
    """n_links and component of each row with an id, by brute force."""
    good = usable(rows)
    u = np.array([v / np.linalg.norm(v) for _, v in good]).reshape(-1, 3)
    near, ids = u @ u.T >= cosine, [i for i, _ in good]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in zip(*np.nonzero(near)):
        x, y = sorted((find(ids[a]), find(ids[b])))
        parent[y] = x
    n = {i: 0 for i, _ in rows}
    for k, i in enumerate(ids):
        n[i] = max(n[i], int(near[k].sum()) - 1)
    return sorted(((i, n[i], find(i) if i is not None else None) for i, _ in rows), key=str)


AWKWARD = [
    (1, [1, 0, 0]), (2, [1, 0, 0]), (3, [2, 0, 0]), (4, [0, 0, 0]), (5, None), (6, [1, None, 0]), (7, [float("nan"), 1, 0]), (8, [float("inf"), 0, 0]),
    (9, [0, 1, 0]), (9, [0, 1, 0]), (None, [1, 0, 0]), (11, [1, 0]), (12, []), (13, [1, 0.2, 0]), (14, [1, 0.45, 0]), (20, [0.9, 0.1, 0]), (40, [-1, 0, 0]),
]


def test_links_of_awkward_rows(spark):
    got = embedding_dedup.near_duplicates(frame(spark, AWKWARD)).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == links(AWKWARD)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None)
    assert embedding_dedup.near_duplicates(frame(spark, [])).count() == 0


def test_links_with_a_third_of_all_in_one_group(spark):
    rng = np.random.default_rng(1)
    rows = [(k, [1, 0.01 * rng.normal(), 0.01 * rng.normal()] if k % 3 == 0 else rng.normal(size=3)) for k in range(700)]
    rows += [(1000 + k, [0, 0, 1]) for k in range(50)]
    got = embedding_dedup.near_duplicates(frame(spark, rows)).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == links(rows)


def test_links_of_the_table(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = sorted((r.vec_id, r.embedding) for r in df.collect())
    x = np.array([v for _, v in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = (x @ x.T >= 0.95).sum(axis=1) - 1
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(df).collect()}
    assert [got[i] for i, _ in rows] == want.tolist()


class Narrow:
    """The nearest points by brute force, but a beam below 128 finds a point itself only."""

    def __init__(self, x):
        self.x = x.astype(np.float32)

    def search(self, queries, beam):
        d = 2 - 2 * queries @ self.x.T
        near = np.argsort(d, axis=1, kind="stable")[:, :beam]
        dist = np.take_along_axis(d, near, 1)
        lost = (np.arange(beam) > 0) & (beam < 128) | (dist > 0.2)
        return np.where(lost, -1, near), np.where(lost, np.inf, dist)


def test_an_audit_sees_rare_links():
    """One pair of near vectors among 600: the audit is of them, not of points that only match themselves."""
    x = np.random.default_rng(4).normal(size=(600, 32))
    x[500] = x[77] + 0.01
    x = embedding_dedup._unit(x)
    keys = np.random.default_rng(5).permutation(600) - 300
    index = x, np.arange(600), np.ones(600, int), Narrow(x), keys
    row, point = embedding_dedup._Search(index, 0.95)(x, keys)
    assert sorted(zip(row.tolist(), point.tolist())) == [(77, 500), (500, 77)]
    row, point = embedding_dedup._Search(index, 0.95)(x[[77, 3]], np.array([1000, 1001]))
    assert sorted(zip(row.tolist(), point.tolist())) == [(0, 77), (0, 500), (1, 3)]


def test_links_of_a_dense_group_are_found_some_at_a_time(monkeypatch):
    """The places of all beams together, and the links held at once, stay bounded where everything is linked with everything."""
    x = embedding_dedup._unit(np.r_[1, np.zeros(7)] + 0.01 * np.random.default_rng(6).normal(size=(900, 8)))
    asked = []

    class Seen(Narrow):
        def search(self, queries, beam):
            asked.append(len(queries) * beam)
            return super().search(queries, beam)

    monkeypatch.setattr(embedding_dedup, "BEAM_CELLS", 20_000)
    of = embedding_dedup._Search((x, np.arange(900), np.ones(900, int), Seen(x), np.arange(900)), 0.95)
    parts = list(of.parts(x, np.arange(900)))
    assert max(asked) <= 20_000 and max(len(row) for row, _ in parts) <= 20_000
    assert sorted(zip(*(np.concatenate(c).tolist() for c in zip(*parts)))) == [(a, b) for a in range(900) for b in range(900) if a != b]


def test_indexes_are_files_that_tasks_map(spark):
    """An index of any size is a path in Spark's rows, and its arrays are the file's own bytes."""
    scratch = Scratch(spark, "mapped")
    points = spark.createDataFrame([(k, [float(k), 1.0], k % 3) for k in range(30)], "vec_id bigint, v array<double>, shard int")
    indexes = vectors.build_indexes(points, lambda t: (t["vec_id"].to_numpy(), vectors.matrix(t["v"]), "named"), 4, scratch)
    assert sorted(r.shard for r in indexes.collect()) == [0, 1, 2] and dict(indexes.dtypes) == {"shard": "int", "path": "string"}
    ids, x, name = read_pickled(indexes.first().path)
    assert name == "named" and not x.flags.owndata and not x.flags.writeable and (x[:, 0] == ids).all()

    def search(index, asked):
        q = asked["vec_id"].to_numpy()
        return np.repeat(q, len(index[0])), np.tile(index[0], len(q)), (vectors.matrix(asked["v"]) @ index[1].T).ravel()

    # thirty blocks
    found = vectors.search_indexes(indexes, points.select("vec_id", "v"), 30 << 20, search, "a bigint, b bigint, s double", scratch, 1)
    assert sorted(map(tuple, found.collect())) == [(a, b, a * b + 1.0) for a in range(30) for b in range(30)]


def exact(rows, query, k):
    good = sorted({(i, tuple(v)) for i, v in usable(rows)})
    q = dict(good)[query]
    best = {}
    for i, v in good:
        if i != query:
            best[i] = max(best.get(i, -1e300), float(np.dot(v, q)))
    return sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]


def test_neighbours_of_awkward_rows(spark):
    got = ann.nearest(frame(spark, AWKWARD), F.col("vec_id") % 20 == 0).collect()
    for query in (20, 40):
        mine = sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == query)
        want = exact(AWKWARD, query, 20)
        assert [i for _, i, _ in mine] == [i for i, _ in want] and [k for k, _, _ in mine] == list(range(1, len(want) + 1))
        assert np.allclose([s for _, _, s in mine], [s for _, s in want], rtol=1e-12)
    assert len(got) == 2 * len(want)
    assert ann.nearest(frame(spark, []), F.col("vec_id") % 20 == 0).count() == 0


def test_ties_and_copies(spark):
    rows = [(k, [1, 0, 0]) for k in range(100)] + [(200 + k, [0, 1, 0.001 * k]) for k in range(100)]
    got = ann.nearest(frame(spark, rows), F.col("vec_id") == 20).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [*range(20)]


def test_recall_of_the_table(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    rows = sorted((r.vec_id, r.embedding) for r in df.collect())
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    recall = []
    for k in np.flatnonzero(ids % 20 == 0):
        s = x @ x[k]
        s[k] = -np.inf
        recall.append(len(got[ids[k]] & set(ids[np.lexsort((ids, -s))[:20]])) / 20)
    assert len(recall) == len(got) and np.mean(recall) >= 0.95


@pytest.mark.parametrize("n", [0, 1, 2, 5, 700])
def test_graphs_of_any_size(n):
    x = np.random.default_rng(0).normal(size=(n, 8)).astype(np.float32)
    if not n:
        return
    g, entry = graph.vamana(x)
    h = graph.HNSW(x, mix64(np.arange(1, n + 1, dtype=np.uint64)))
    truth = ((x[:, None] - x[None]) ** 2).sum(axis=2).argsort(axis=1)[:, : min(5, n)]
    for ids, _ in (g.search(x, np.full((n, 1), entry), 40), h.search(x, 40)):
        hit = np.mean([len(set(a[: min(5, n)]) & set(b)) / len(b) for a, b in zip(ids, truth)])
        assert hit > 0.95
        assert all(len({i for i in row if i >= 0}) == (row >= 0).sum() for row in ids)


def test_number_of_shards_follows_the_rows():
    assert vectors.shards_for(0) == vectors.shards_for(800_000) == 8 and vectors.shards_for(10**9) == 10_000


def test_a_shard_is_bounded_in_bytes():
    assert vectors.shards_for(10**6, 64) == 10 and vectors.shards_for(10**6, 4096) == -(-(10**6) // (vectors.SHARD_BYTES // (8 * 4096)))


def recall_of(x, got, queries, k=20):
    hits = 0
    for q in queries:
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(got[q] & set(np.lexsort((np.arange(len(x)), -s))[:k].tolist()))
    return hits / (k * len(queries))


@pytest.mark.parametrize("kind", ["gaussian", "lengths", "clusters"])
def test_recall_where_lengths_differ(spark, kind):
    """20,000 vectors, 2,500 a shard: without structure, of lengths over two decades, and in groups."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(20_000, 32))
    if kind == "lengths":
        x *= 10 ** rng.uniform(-1, 1, (len(x), 1))
    if kind == "clusters":
        x = rng.normal(size=(300, 32))[rng.integers(0, 300, len(x))] + 0.1 * x
    x = np.float32(x).astype(float)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    got, score = {}, {}
    for r in ann.nearest(df, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
        score[r.query_id, r.vec_id] = r.score
    assert all(len(v) == 20 for v in got.values()) and len(got) == 200
    assert recall_of(x, got, sorted(got)) >= 0.95
    assert all(abs(s - x[a] @ x[b]) <= 1e-9 * abs(s) + 1e-12 for (a, b), s in score.items())


def test_an_audit_widens_the_beam():
    x = np.random.default_rng(12).normal(size=(6000, 48))
    bands = ann.Bands(x, [[k] for k in range(len(x))])
    q = x[:200]
    truth, points = bands.find(q, 21, None)
    s = q @ x.T
    assert (points == np.argsort(-s, axis=1, kind="stable")[:, :21]).all() and np.allclose(truth, np.take_along_axis(s, points, 1))
    hit = lambda found: np.mean([len(set(a) & set(b)) / 21 for a, b in zip(found, points)])
    beam = bands.audited_beam(q[:32], 21, 21)
    assert hit(bands.find(q, 21, beam)[1]) >= 0.93

    class Lossy(ann.Bands):
        """Finds every second one unless its beam is 150 or wider."""

        def find(self, q, k, beam):
            s, p = super().find(q, k, None)
            return (s, p) if beam is None or beam >= 150 else (np.where(np.arange(k) % 2, -np.inf, s), p)

    assert Lossy(x, bands.ids).audited_beam(q[:32], 21, 21) == 168
    # a beam of more than an eighth of the points is given up
    assert Lossy(x[:1000], bands.ids[:1000]).audited_beam(q[:32], 21, 21) is None
    assert ann.Bands(x[:10], bands.ids[:10]).audited_beam(q[:3], 21, 96) is None


def test_the_greatest_scores_in_order():
    rng = np.random.default_rng(13)
    for _ in range(200):
        s = rng.integers(0, 4, (3, rng.integers(1, 30))).astype(float)
        k = int(rng.integers(1, 12))
        assert ann._top(s, k).tolist() == np.argsort(-s, axis=1, kind="stable")[:, :k].tolist()
