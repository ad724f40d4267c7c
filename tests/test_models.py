import itertools

import numpy as np
import pytest

from tessera.functions import distances
from tessera.operators import binary, evaluation, graphs, ivf, knn, models, quantizers, transforms
from tessera.plans import factory


def frame(spark, x):
    return spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "id long, vec array<double>")


@pytest.fixture(scope="module")
def x():
    return np.random.default_rng(7).normal(size=(300, 16))


def test_kmeans_objective_falls_and_errors(spark, x):
    v = frame(spark, x)
    c, stats = models.kmeans(v, 10, 8)
    costs = [s["objective"] for s in stats]
    assert all(b <= a * (1 + 1e-9) for a, b in zip(costs, costs[1:])) and c.shape == (10, 16)
    assert models.kmeans(v, 20, 5)[1][-1]["objective"] < costs[-1]
    with pytest.raises(ValueError):
        models.kmeans(v.limit(3), 10)
    with pytest.raises(ValueError):
        models.kmeans(spark.createDataFrame([(0, [float("nan")]), (1, [1.0])], v.schema), 2)
    c, _ = models.kmeans(v, 5, 3, whole=True)
    assert np.array_equal(c, np.rint(c))
    start = x[:4]
    assert np.array_equal(models.kmeans(v, 4, 5, frozen=True, start=start)[0], start)


def test_weighted_kmeans_follows_weights(spark):
    v = spark.createDataFrame([(0, [0.0], 1.0), (1, [1.0], 3.0), (2, [10.0], 1.0)], "id long, vec array<double>, weight double")
    c, _ = models.kmeans(v, 2, 5, weight="weight", start=np.array([[0.0], [10.0]]))
    assert np.allclose(np.sort(c.ravel()), [0.75, 10.0])


def test_empty_clusters_are_split(spark):
    v = frame(spark, [[1.0, 2.0]] * 20 + [[5.0, 5.0]] * 20)
    _, stats = models.kmeans(v, 4, 3, start=np.array([[1.0, 2.0], [5.0, 5.0], [90.0, 90.0], [99.0, 99.0]]))
    assert stats[0]["splits"] == 2


def test_exact_one_dimension():
    rng = np.random.default_rng(2)
    for k in (1, 2, 3):
        v = rng.integers(0, 30, 9).astype(float)
        s = np.sort(v)
        best = min(sum(((p - p.mean()) ** 2).sum() for p in np.split(s, list(cut))) for cut in itertools.combinations(range(1, len(s)), k - 1))
        assert abs(models.exact_kmeans_1d(v, k)[1] - best) < 1e-9


def test_ivf_with_all_lists_is_exact_and_recall_grows(spark, x):
    v = frame(spark, x)
    c = models.pinned_centroids(v, 12)
    lists = ivf.build(v, c)
    q, truth = v.where("id < 20"), knn.exact_knn(v.where("id < 20"), v, 5)
    key = lambda df: sorted((r.qid, r.rank, r.id) for r in df.collect())
    assert key(ivf.search(q, lists, c, 5, 12)) == key(truth)
    recalls = [evaluation.recall_at(ivf.search(q, lists, c, 5, n, zone=0), knn.exact_knn(q, v, 1, exclude_self=True), 5).first().recall for n in (1, 6, 12)]
    assert recalls[0] <= recalls[1] <= recalls[2] == 1.0
    assert key(knn.blocked_knn(q, v, 5, block=7, shards=3)) == key(truth)


def test_product_quantizer(spark, x):
    v = frame(spark, x)
    b = quantizers.train_pq(v, 4, 16, 5)
    codes = quantizers.encode_pq(v, b)
    found = {(r.qid, r.id): r.dis for r in quantizers.search_pq(v.where("id < 3"), codes, b, 300).collect()}
    decoded = {r.id: np.array(r.y) for r in codes.select("id", quantizers.decode_pq(codes.code, b).alias("y")).collect()}
    for (q, i), d in found.items():
        assert abs(((x[q] - decoded[i]) ** 2).sum() - d) < 1e-9
    all_ = codes.count()
    for r in quantizers.rounded_tables(quantizers.tables(v.where("id < 3"), b)).collect():
        for i in range(all_):
            c = [int(np.argmin(((x[i].reshape(4, 4)[m] - b[m]) ** 2).sum(1))) for m in range(4)]
            assert abs(sum(r.qlut[m][c[m]] for m in range(4)) / r.a + r.b - found[(r.qid, i)]) < 4 / r.a


def test_additive_quantizers_and_lattice(x):
    err = lambda b, c: ((x - b[np.arange(len(b)), c].sum(axis=1)) ** 2).sum()
    rq = quantizers.train_rq(x, 3, 16)
    one, five = (err(rq, quantizers.beam_encode(x, rq, n)[0]) for n in (1, 5))
    assert five <= one < (x**2).sum()
    refit = quantizers.train_rq(x, 3, 16, refits=2)
    assert err(refit, quantizers.beam_encode(x, refit, 5)[0]) <= five * 1.05
    lsq = quantizers.train_lsq(x, 3, 16)
    start = np.zeros((len(x), 3), int)
    assert err(lsq, quantizers.icm_encode(x, lsq, start)) < err(lsq, start)
    s = quantizers.Sphere(4, 6)
    assert np.array_equal(s.encode(s.points.astype(float)), np.arange(len(s.points)))
    assert all(s.rank[tuple(p)] == i for i, p in enumerate(s.points))


def test_transforms(spark, x):
    v = frame(spark, x)
    a, b = transforms.pca(v, 6, eigen_power=-0.5)
    y = np.stack([r.vec for r in transforms.apply_linear(v, a, b).orderBy("id").collect()])
    assert np.allclose(np.cov(y.T, bias=True), np.eye(6), atol=1e-6) and np.allclose(y.mean(axis=0), 0, atol=1e-9)
    r = transforms.random_rotation(16, 16)
    assert np.allclose(r @ r.T, np.eye(16))
    back = transforms.reverse_linear(transforms.apply_linear(v, r), r)
    assert np.allclose(np.stack([t.vec for t in back.orderBy("id").collect()]), x)
    q = transforms.itq(x)
    assert np.allclose(q @ q.T, np.eye(16)) and ((np.sign(x @ q.T) - x @ q.T) ** 2).sum() <= ((np.sign(x) - x) ** 2).sum()
    _, errors = transforms.opq(x, 4, 8, 6)
    assert errors[-1] < errors[0]
    assert transforms.remap_places(4, 6) == [0, 1, 2, 3, -1, -1] and transforms.remap_places(8, 4, True) == [0, 2, 4, 6]


def test_binary_hash_recall_grows(spark, x):
    v = frame(spark, x)
    c = v.select("id", binary.pack(binary.bits_of(v.vec), 16).alias("code"))
    n = [binary.hash_candidates(c.where("id < 10"), c, 6, f, t).count() for f, t in ((0, 1), (1, 1), (1, 2))]
    assert n[0] <= n[1] <= n[2]
    key = lambda df: sorted((r.qid, r.rank, r.id, r.dis) for r in df.collect())
    assert key(binary.hash_search(c.where("id < 10"), c, 3, 6, 6)) == key(binary.search(c.where("id < 10"), c, 3))


def test_graph_recall(spark, x):
    v = frame(spark, x)
    truth = {(r.qid, r.id) for r in knn.exact_knn(v, v, 5, exclude_self=True).collect()}
    graph = {(r.src, r.dst) for r in graphs.nn_descent(v, 5, rounds=4).collect()}
    assert len(truth & graph) > 0.8 * len(truth)
    near = {(r.qid, r.id) for r in graphs.sharded_graph_search(v.where("id < 30"), v, 5, shards=3).collect()}
    best = {(r.qid, r.id) for r in knn.exact_knn(v.where("id < 30"), v, 5).collect()}
    assert len(near & best) > 0.9 * len(best)


def test_nan_never_ranks(spark):
    v = frame(spark, [[0.0], [float("nan")], [1.0], [float("inf")]])
    assert [r.id for r in knn.exact_knn(v.where("id = 0"), v, 4).orderBy("rank").collect()] == [0, 2, 3]
    assert "l2" in distances.METRICS


def test_descriptions():
    for text in ("Flat", "PCA32,IVF100,PQ8x8", "IVF256_HNSW32,SQ8", "HNSW32", "IDMap,Flat", "IVF16,PQ8x8,RFlat", "BHash8x12", "BFlat", "RR32,RQ4x8", "IVF64,LSQ4x8"):
        assert factory.parse(64, text).describe() == text
    assert factory.parse(64, "IVF16,PQ8").code_size() == 8 and factory.parse(64, "SQ6").code_size() == 48 and factory.parse(64, "PCA32,Flat").code_size() == 128
    for bad in ("", "IVF10", "Nonsense", "Bogus"):
        with pytest.raises(ValueError):
            factory.parse(64, bad)
    s = factory.ParameterSpace.of(factory.parse(64, "IVF64,PQ8"))
    assert s.values(s.text({"nprobe": 8, "ht": 20})) == {"nprobe": 8.0, "ht": 20.0}
    tried = [({"nprobe": 4}, 0.9, 1.0), ({"nprobe": 8}, 0.9, 2.0)]
    assert not s.worth_trying({"nprobe": 6}, tried) and s.worth_trying({"nprobe": 2}, tried)


def test_two_level(spark, x):
    assert models.two_level_kmeans(frame(spark, x), 3, 9, 3).shape == (9, 16)


def test_many_queries_meet_every_row_shard_by_shard(spark, monkeypatch):
    x = spark.createDataFrame([(i, [float(i % 7), float(i * i % 11)]) for i in range(40)], "id long, vec array<double>")
    key = lambda df: sorted(map(tuple, df.collect()))
    few = {m: key(knn.exact_knn(x, x, 4, m)) for m in ("l1", "l2")}, key(knn.range_search(x, x, 3.0))
    book = models.pinned_centroids(x, 3).reshape(1, 3, 2)
    codes = quantizers.encode_pq(x, book)
    near = key(quantizers.search_pq(x, codes, book, 4))
    monkeypatch.setattr(knn, "BROADCAST_ROWS", 5)
    monkeypatch.setattr(knn, "SHARD_ROWS", 7)
    assert ({m: key(knn.exact_knn(x, x, 4, m)) for m in ("l1", "l2")}, key(knn.range_search(x, x, 3.0))) == few
    assert key(quantizers.search_pq(x, codes, book, 4)) == near


def test_nearest_codes_equal_a_join_of_tables(spark, monkeypatch):
    monkeypatch.setattr(knn, "SHARD_ROWS", 9)  # a list in several parts
    rng = np.random.default_rng(4)
    x = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(90, 4)))], "id long, vec array<double>")
    c, book = models.pinned_centroids(x, 3), models.pinned_centroids(x, 5).reshape(5, 2, 2).transpose(1, 0, 2)
    lists = quantizers.encode_pq(ivf.build(x, c), book, "list_no", "o2c")
    p = ivf.probes(x, c, 2)
    got = sorted((r.qid, r.id, r.dis) for r in quantizers.nearest_codes(p, lists, book, 4, 2).collect())
    joined = p.drop("qvec").join(lists.select("list_no", "id", "code"), "list_no").where("abs(id - qid) > 2").join(quantizers.tables(x, book), "qid")
    want = knn.top_k(joined.select("qid", "id", quantizers.adc(joined.lut, joined.code).alias("dis")), 4)
    assert got == sorted((r.qid, r.id, r.dis) for r in want.collect())


def test_kmeans_is_the_same_on_the_driver_and_distributed(spark, monkeypatch):
    x = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.random.default_rng(5).normal(size=(80, 3)))], "id long, vec array<double>")
    c, stats = models.kmeans(x, 6, 4)
    monkeypatch.setattr(models, "LOCAL_VALUES", 0)
    far, more = models.kmeans(x, 6, 4)
    assert np.allclose(c, far) and np.allclose([s["objective"] for s in stats], [s["objective"] for s in more])
    assert models.two_level_kmeans(x, 3, 8, 3).shape == (8, 3)
