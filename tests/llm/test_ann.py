import numpy as np

from weftline.llm import ann

SMALL = "/root/testdata/sf0.01"


def brute(ids, x, k=20):
    out = {}
    for i in np.flatnonzero(ids % 20 == 0):
        s = x @ x[i]
        s[i] = -np.inf
        best = np.lexsort((ids, -s))[:k]
        out[int(ids[i])] = [(int(ids[j]), float(s[j])) for j in best]
    return out


def test_recall_and_scores(spark):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").toPandas()
    ids, x = rows["vec_id"].to_numpy(), np.stack(rows["embedding"]).astype(float)
    want = brute(ids, x)
    got: dict = {}
    for r in ann.op1_one_bit_codes(spark, SMALL).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    recall = np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want])
    assert recall >= 0.9
    exact = {int(i): v for i, v in zip(ids, x, strict=True)}
    assert all(abs(s - exact[q] @ exact[i]) < 1e-12 for q, v in got.items() for i, s in v)


def test_blocks_ties_and_copies(spark, monkeypatch):
    monkeypatch.setattr(ann, "QUERY_ROWS", 7)
    monkeypatch.setattr(ann, "INDEX_ROWS", 16)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((90, 8)).round(1)
    x[30:70] = x[5]  # a hot vector
    ids = np.arange(90)
    got: dict = {}
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id bigint, embedding array<double>")
    for r in ann.search(df, lambda i: i % 20 == 0, 25).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    for q in got:
        s = x @ x[q]
        s[q] = -np.inf
        best = np.lexsort((ids, -s.round(9)))[:25]
        assert got[q] == best.tolist()


def test_more_dimensions_than_are_broadcast(spark, sf, monkeypatch):
    want = [tuple(r) for r in ann.op1_one_bit_codes(spark, sf[0]).orderBy("query_id", "rank").collect()]
    monkeypatch.setattr(ann, "DIMS", 1)
    got = [tuple(r) for r in ann.op1_one_bit_codes(spark, sf[0]).orderBy("query_id", "rank").collect()]
    assert got == want and len({q for q, *_ in got}) == 3  # of two and of three dimensions


def test_bounds_hold():
    rng = np.random.default_rng(1)
    x, q = rng.standard_normal((2000, 64)), rng.standard_normal((50, 64))
    bits, norm, f = ann.encode(x)
    assert bits.shape == (2000, 8) and np.allclose(norm, np.linalg.norm(x, axis=1))
    size = np.linalg.norm(q, axis=1)[:, None] * norm
    est, err = ann.estimates(bits, f, ann.Queries(q), np.arange(50), 64)
    assert np.mean(np.abs(est - q @ x.T / size) <= err) > 0.93
    assert np.abs(np.mean(est * size - q @ x.T)) < 0.05  # unbiased
    # the popcounts give the product of signs and quantised components
    turned = ann.units(q)[0] @ ann.rotation(64)
    low, step = turned.min(axis=1)[:, None], (turned.max(axis=1) - turned.min(axis=1))[:, None] / 15
    plain = (np.rint((turned - low) / step) * step + low) @ np.where(np.unpackbits(bits, axis=1), 1.0, -1.0).T
    assert np.allclose(est, plain / (f * 8), atol=1e-4)


def test_blocks_are_read_by_rows(spark):
    from weftline.llm.common import work_dir

    rng, folder = np.random.default_rng(4), work_dir(spark, "test-blocks")
    v = rng.standard_normal((100, 12))
    far = ann.Block.write(folder, "x", 12, 3, 1, np.zeros(12), np.arange(100) * 2, np.arange(100), v)
    block = ann.Block(folder, "x", 12, 3)
    assert (block.n, block.cluster) == (100, 1) and (block.radius, block.least, block.most) == far
    assert abs(far[0] - 1) < 1e-6 and np.isclose(far[1], np.linalg.norm(v, axis=1).min())
    block.read()
    assert (block.vectors() == v).all() and (block.vectors(np.array([1, 5, 99])) == v[[1, 5, 99]]).all() and (block.vectors(np.arange(50)) == v[:50]).all()
    assert (block.bits == ann.encode(v)[0]).all() and block.cls[-1] == 198


def test_few_vectors(spark, sf):
    got = [tuple(r) for r in ann.op1_one_bit_codes(spark, sf[0]).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 20, 1.0), (0, 3, 2, 0.5), (20, 1, 0, 1.0), (20, 2, 1, 1.0), (20, 3, 2, 0.5), (40, 1, 7, 6.0)]


def searched(spark, ids, x, k):
    got: dict = {}
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id bigint, embedding array<double>")
    for r in ann.search(df, lambda i: i % 20 == 0, k).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return got


def test_norms_of_all_sizes(spark, monkeypatch):
    """Norms from 1e-140 to 1e140, in several blocks, against brute force."""
    monkeypatch.setattr(ann, "QUERY_ROWS", 5)
    monkeypatch.setattr(ann, "INDEX_ROWS", 16)
    rng = np.random.default_rng(8)
    x = rng.standard_normal((160, 6)) * 10.0 ** rng.integers(-140, 141, (160, 1))
    ids = np.arange(160)
    got, want = searched(spark, ids, x, 10), brute(ids, x, 10)
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 10 for q in want]) >= 0.95
    assert all(np.isclose(s, x[q] @ x[i], rtol=1e-9, atol=0) for q, v in got.items() for i, s in v)


def test_blocks_of_other_directions_are_not_read(spark, monkeypatch):
    """Forty narrow clusters: a block of queries meets few of them, in jobs of few blocks, and finds what brute force does."""
    from weftline.llm.common import work_dir

    monkeypatch.setattr(ann, "INDEX_ROWS", 32)
    rng, folder, dim, k = np.random.default_rng(9), work_dir(spark, "test-clusters"), 16, 10
    middle = rng.standard_normal((40, dim))
    x = (middle[:, None, :] + 0.05 * rng.standard_normal((40, 100, dim))).reshape(-1, dim)
    ids = np.arange(len(x))
    unit = ann.units(x)[0]
    centres = ann.fitted(unit, 60)
    ann.write_shared(f"{folder}/centres-{dim}", centres.tobytes())
    at, number, rows = ann.nearest(unit, centres), 0, []
    for c in np.unique(at):
        mine, first = np.flatnonzero(at == c), number
        far = []
        for a in range(0, len(mine), 32):
            b = mine[a : a + 32]
            far.append(ann.Block.write(folder, "x", dim, number, c, centres[c], b, b, x[b]))
            number += 1
        far = np.array(far)
        rows.append((c, first, number - first, far[:, 0].max(), far[:, 1].min(), far[:, 2].max()))
    ann.write_shared(f"{folder}/clusters-{dim}", np.array(rows, float).tobytes())
    asked = ids[:100:20]
    ann.Block.write(folder, "q", dim, 0, 0, centres[0], asked, asked, x[asked])
    monkeypatch.setattr(ann, "TASK_BYTES", 2 * 32 * 34)
    ranges = ann.plan(folder, dim, 0, k)
    assert all(0 <= a <= b < number and b - a < 2 for a, b in ranges) and len(ranges) > 1
    planned = sum(b - a + 1 for a, b in ranges)
    found, read = {int(q): [] for q in asked}, 0
    for a, b in ranges:
        q, cls, score, n = ann.met(folder, dim, 0, a, b, k)
        read += n
        for i, j, s in zip(q, cls, score, strict=True):
            found[int(i)].append((-s, int(j)))
    assert read <= planned < number / 4
    for q, v in brute(ids, x, k).items():
        if q in found:
            assert len({i for _, i in sorted(found[q])[:k]} & {i for i, _ in v}) >= k - 1


def test_clusters_and_whole_search(spark, monkeypatch):
    """Directions in clusters, one with a third of all rows: what brute force finds, whatever the sizes of clusters and blocks."""
    monkeypatch.setattr(ann, "QUERY_ROWS", 8)
    monkeypatch.setattr(ann, "INDEX_ROWS", 24)
    rng = np.random.default_rng(10)
    of = np.where(np.arange(600) < 200, 0, rng.integers(0, 20, 600))
    x = rng.standard_normal((20, 12))[of] + 0.1 * rng.standard_normal((600, 12))
    ids = rng.permutation(600)
    got, want = searched(spark, ids, x, 20), brute(ids, x)
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.97
