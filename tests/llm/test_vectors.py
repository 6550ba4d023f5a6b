import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from textstrata.llm import vectors


def brute(ids, m):
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    links = m @ m.T >= vectors.COSINE
    np.fill_diagonal(links, False)
    root = np.array(ids)
    while not np.array_equal(new := np.array([min([root[i], *root[links[i]]]) for i in range(len(ids))]), root):
        root = new
    return {i: (int(n), int(r)) for i, n, r in zip(ids, links.sum(1), root)}


def data(seed=0, n=600, d=64):
    rng = np.random.default_rng(seed)
    m = rng.standard_normal((n, d))
    m[1:40] = m[0]
    m[40:150] = m[0] + 0.25 * rng.standard_normal((110, d))
    for i in range(200, 300):
        m[i] = m[i - 1] + 0.3 * rng.standard_normal(d)
    return m.astype(np.float32).astype(np.float64)


def test_recall_and_precision(spark, folder):
    m = data()
    ids = list(range(1000, 1600))
    odd = [(1, None), (2, []), (3, [0.0] * 64), (4, [float("nan")] * 64), (5, [None] * 64), (6, [1.0, float("inf")]), (None, [1.0] * 64), (7, [1.0, 2.0]), (8, [1.0, 2.0])]
    rows = [(i, [float(x) for x in v], 0) for i, v in zip(ids, m)] + [(*o, 0) for o in odd]
    d = folder(embeddings=(rows, "vec_id long, embedding array<float>, v int"))
    got = {r.vec_id: r for r in vectors.op10_vectors(spark, d).collect()}
    want = brute(ids, m)
    assert all(got[i].n_links <= want[i][0] for i in ids)
    assert sum(got[i].n_links for i in ids) >= 0.97 * sum(n for n, _ in want.values())
    assert sum(got[i].component_id == want[i][1] for i in ids) >= 0.97 * len(ids)
    assert all(got[i].kept == (got[i].component_id == i) for i in ids)
    assert [(got[i].n_links, got[i].component_id, got[i].kept) for i in range(1, 7)] == [(0, i, True) for i in range(1, 7)]
    assert (got[None].n_links, got[None].component_id, got[None].kept) == (0, None, False)
    assert (got[7].n_links, got[8].n_links, got[8].component_id) == (1, 1, 7)


def test_recall_at_the_threshold():
    """The hardest links: cosine just 0.9, for few and for many reference points."""
    rng = np.random.default_rng(1)
    x = rng.standard_normal((3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    u = rng.standard_normal(x.shape)
    u -= (u * x).sum(1, keepdims=True) * x
    y = 0.9 * x + np.sqrt(1 - 0.81) * u / np.linalg.norm(u, axis=1, keepdims=True)
    for points in (32, 100, 1024):
        a, b = (vectors.nearest_points(v, x[:points]) for v in (x, y))
        assert ((a[:, :, None] == b[:, None, :]).any(2).sum(1) >= 2).mean() >= 0.9


def test_recall_does_not_fall_with_more_points():
    """Links at cosine just 0.9, each number of points with the nearest ones it takes: the description grows with the points."""
    rng = np.random.default_rng(2)
    x = rng.standard_normal((3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    u = rng.standard_normal(x.shape)
    u -= (u * x).sum(1, keepdims=True) * x
    y = 0.9 * x + np.sqrt(1 - 0.81) * u / np.linalg.norm(u, axis=1, keepdims=True)
    other = rng.standard_normal((1024, 64))
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    for points in (32, 100, 316, 512, 1024):
        a, b = (vectors.nearest_points(v, other[:points]) for v in (x, y))
        assert ((a[:, :, None] == b[:, None, :]).any(2).sum(1) >= 2).mean() >= 0.985, points


def test_empty_and_single(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in vectors.near_vectors(df).collect()] == [(1, 0, 1, True)]
    assert vectors.near_vectors(df.limit(0)).count() == 0


def test_an_id_may_have_several_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.05]), (3, [-1.0, 0.0])], "vec_id long, embedding array<double>")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(df).collect())
    assert got == [(1, 0, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]


def test_long_lists_are_dealt_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_LEAST", 8)
    m = data(3, 300)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "vec_id long, embedding array<float>")
    got = {r.vec_id: r.n_links for r in vectors.near_vectors(df).collect()}
    want = brute(list(range(300)), m)
    assert all(got[i] <= want[i][0] for i in got) and sum(got.values()) >= 0.97 * sum(n for n, _ in want.values())


def crowded(n, noise, share=3, base=0.0, seed=4, d=64):
    """A group of near copies of one centre among others, and for every tenth vector one at cosine just 0.9."""
    rng = np.random.default_rng(seed)
    m = rng.standard_normal((n, d)) + base * rng.standard_normal(d)
    m[: n // share] = m[0] + noise * rng.standard_normal((n // share, d))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    for i in range(0, n - 1, 10):
        u = rng.standard_normal(d)
        u -= (u @ m[i]) * m[i]
        m[i + 1] = 0.901 * m[i] + np.sqrt(1 - 0.901**2) * u / np.linalg.norm(u)
    return m[rng.permutation(n)].astype(np.float32)


def test_dense_groups_lose_no_link(spark, tmp_path):
    for noise in (0.2, 0.35, 0.6):
        m = crowded(6000, noise)
        table = pa.table({"vec_id": np.arange(len(m)), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(m.ravel()), 64).cast(pa.list_(pa.float32()))})
        pq.write_table(table, f"{tmp_path}/{noise}.parquet")
        got = vectors.near_vectors(spark.read.parquet(f"{tmp_path}/{noise}.parquet")).toPandas().set_index("vec_id").sort_index()
        u = m.astype(np.float64) / np.linalg.norm(m.astype(np.float64), axis=1, keepdims=True)
        want = (u @ u.T >= vectors.COSINE).sum(axis=1) - 1
        assert (got.n_links.to_numpy() <= want).all()
        assert got.n_links.sum() >= 0.995 * want.sum(), (noise, got.n_links.sum() / want.sum())


def test_crowds_find_all_links_of_their_members():
    """Both ends of each link of a member are in its crowd, or in the lesser one of two."""
    for noise in (0.2, 0.45, 0.65):
        m = crowded(4000, noise).astype(np.float64)
        m /= np.linalg.norm(m, axis=1, keepdims=True)
        points = vectors.spread_points(m[:200])
        home, row, crowd = vectors.crowd_places(m, points)
        held = set(zip(row.tolist(), crowd.tolist()))
        assert points.crowd.any() and (home >= 0).any()
        for x, y in zip(*np.nonzero(np.triu(m @ m.T >= vectors.COSINE, 1))):
            own = [h for h in (home[x], home[y]) if h >= 0]
            assert not own or {(x, min(own)), (y, min(own))} <= held
