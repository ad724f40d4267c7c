import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import ivf, knn, models, quantizers, series
from tessera.streaming import detector


@pytest.fixture(scope="module")
def windows(spark, tmp_path_factory):
    value = np.random.default_rng(4).normal(0, 9, 267)
    points = spark.createDataFrame([("s", t, float(v)) for t, v in enumerate(value)], "series_id string, t long, value double")
    where = str(tmp_path_factory.mktemp("windows") / "w")
    series.windows(points, 8).select("id", "vec").write.parquet(where)
    return spark.read.parquet(where)


def _detector(path, horizon=160, batch=50, score_first=True):
    return detector.StreamingDetector(str(path), 8, nlist=6, nprobe=3, k=3, m=4, codes=8, horizon=horizon, batch=batch, nlist_batch=3, n_iter=2, score_first=score_first)


def test_a_batch_on_the_driver_scores_as_a_distributed_one(windows, tmp_path, monkeypatch):
    near, far = _detector(tmp_path / "a"), _detector(tmp_path / "b")
    for d in (near, far):
        d.initial(windows.where("id < 160"))
    got = {r.id: r.score for r in near.step(windows.where("id between 160 and 209")).collect()}
    monkeypatch.setattr(models, "LOCAL_VALUES", 0)
    want = {r.id: r.score for r in far.step(windows.where("id between 160 and 209")).collect()}
    assert set(got) == set(want) == set(range(160, 210))
    assert all((got[i] is None) == (want[i] is None) and (got[i] is None or np.isclose(got[i], want[i], rtol=1e-9)) for i in got)
    for a in ("centroids", "radius", "size", "numbers", "codebook", "counts"):
        assert np.allclose(getattr(near.state, a), getattr(far.state, a)), a
    rows = lambda d: sorted((r.id, r.list_no, tuple(r.code)) for r in d.state.lists.collect())
    assert rows(near) == rows(far) and len(rows(near)) == 160


def test_a_batch_is_clustered_and_coded_without_python_jobs(windows, tmp_path, monkeypatch):
    calls, plain = [], type(windows).mapInPandas
    monkeypatch.setattr(type(windows), "mapInPandas", lambda self, *a, **k: calls.append(1) or plain(self, *a, **k))
    d = _detector(tmp_path)
    d.initial(windows.where("id < 160"))
    n = len(calls)
    assert d.step(windows.where("id between 160 and 209")).count() == 50 and len(calls) == n


def test_lists_are_written_once_a_batch_and_taken_up_again(spark, windows, tmp_path):
    d = _detector(tmp_path, 80, 100)  # a batch longer than the horizon
    assert d.run(windows).count() == 260
    assert {f.name for f in tmp_path.iterdir()} == {"scores", "model=2", "version=2"}
    again = _detector(tmp_path, 80, 100)
    assert again.restore(spark) == 2
    lists = again.state.lists
    assert sorted(r.id for r in lists.collect()) == list(range(180, 260))
    assert {r.list_no: r["count"] for r in lists.groupBy("list_no").count().collect()} == dict(zip(again.state.numbers.tolist(), again.state.size.tolist()))
    assert np.array_equal(again.state.counts, detector.code_counts(lists, 4, 8))


def test_held_queries_find_what_joined_ones_do(spark, monkeypatch):
    monkeypatch.setattr(knn, "SHARD_ROWS", 20)  # several lots a task
    x = np.random.default_rng(3).integers(0, 3, (130, 4)).astype(float)  # many ties
    v = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "id long, vec array<double>")
    c, book = x[:5] + 0.1, x[:6].reshape(6, 2, 2).transpose(1, 0, 2)
    lists = quantizers.encode_pq(ivf.build(v.where("id % 3 > 0"), c), book, "list_no", "o2c").where("list_no <> 2")
    want = quantizers.nearest_codes(ivf.probes(v, c, 3), lists, book, 4, 2)
    probed, q2c = models.nearest(x, c, 3)
    got = quantizers.nearest_codes_of(np.arange(130), x, probed, q2c, lists, book, 4, 2)
    rows = lambda t: sorted(map(tuple, t.select("qid", "id", "q2c", "o2c", "dis").collect()))
    assert len(rows(want)) and rows(got) == rows(want)
    assert quantizers.nearest_codes_of(np.arange(130), x, probed, q2c, lists.where(F.lit(False)), book, 4).count() == 0
