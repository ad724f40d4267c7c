import struct

import numpy as np
import pytest

from tessera.operators import evaluation, ivf, models, series
from tessera.sources import vectors
from tessera.streaming.detector import StreamingDetector, merge_centroids


def test_windows_equal_whole_and_chunked(spark):
    p = spark.createDataFrame([(s, t, float(t * t % 17)) for s in "ab" for t in range(40)], "series_id string, t long, value double")
    key = lambda df: sorted(map(tuple, df.collect()))
    got = key(series.windows(p, 6))
    assert got == key(series.windows(p, 6, chunk=7)) == sorted((s, i, [float(t * t % 17) for t in range(i, i + 6)]) for s in "ab" for i in range(35))


def test_text_series(spark, tmp_path):
    f = tmp_path / "s.out"
    f.write_text("3\r\n1.5,0\r\n-1,1\n2,0\n\n")
    assert [tuple(r)[1:] for r in series.read_text(spark, str(f)).orderBy("t").collect()] == [(0, 1.5, 0), (1, -1.0, 1), (2, 2.0, 0)]
    f.write_text("200\n" + "".join(f"{i},0\n" for i in range(200)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100b")  # many blocks
    got = series.read_text(spark, str(f))
    assert got.rdd.getNumPartitions() > 1 and [(r.t, r.value) for r in got.orderBy("t").collect()] == [(i, float(i)) for i in range(200)]
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    f.write_text("4\n1,0\n")
    with pytest.raises(ValueError):
        series.read_text(spark, str(f))


def test_merge_formulas():
    c, r, n, home = merge_centroids(np.array([[0.0], [10.0]]), np.array([2.0, 1.0]), np.array([4.0, 2.0]), np.array([[1.0], [20.0], [-1.0]]), np.array([1.0, 3.0, 1.0]), np.array([2.0, 5.0, 4.0]))
    assert home.tolist() == [0, 2, 0]
    assert np.allclose(c.ravel(), [(0 + 0.5 * 1 + 1 * -1) / 2.5, 10, 20]) and np.allclose(r, [(2 + 0.5 + 1) / 2.5, 1, 3]) and n.tolist() == [10, 2, 5]


def _windows(spark):
    t = np.arange(520)
    x = np.sin(t / 5) + np.random.default_rng(1).normal(0, 0.05, len(t))
    x[400:420] += 3
    p = spark.createDataFrame([("s", int(i), float(v)) for i, v in zip(t, x)], "series_id string, t long, value double")
    return series.windows(p, 16).select("id", "vec")


def _detector(path, **more):
    return StreamingDetector(str(path), 16, nlist=8, nprobe=4, k=5, m=4, codes=16, horizon=300, batch=100, nlist_batch=4, n_iter=3, **more)


def test_batches_find_the_anomaly_and_keep_the_horizon(spark, tmp_path):
    w = _windows(spark)
    for first in (False, True):
        d = _detector(tmp_path / str(first), score_first=first)
        out = d.run(w).toPandas().set_index("id").score
        assert len(out) == w.count() and out.notna().mean() > 0.9
        ids = [r.id for r in d.state.lists.select("id").collect()]
        assert len(ids) == len(set(ids)) == 300 and min(ids) == max(ids) - 299
        assert d.state.counts.sum() == 4 * 300 and len(set(d.state.numbers)) == len(d.state.numbers)
        assert out[395:415].max() > 3 * out[100:280].median()


def test_stream_equals_batches(spark, tmp_path):
    w = _windows(spark)
    want = {r.id: r.score for r in _detector(tmp_path / "loop").run(w).where("batch < 3").collect()}
    src = tmp_path / "in"
    for lo, hi in ((0, 250), (250, 430), (430, 600)):
        w.where(f"id >= {lo} and id < {hi}").coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema(w.schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    q = _detector(tmp_path / "stream").start(stream, str(tmp_path / "checkpoint"))
    q.processAllAvailable()
    q.stop()
    got = {r.id: r.score for r in spark.read.parquet(str(tmp_path / "stream" / "scores")).collect()}
    assert set(got) == set(want)
    assert all((got[i] is None) == (want[i] is None) and (got[i] is None or abs(got[i] - want[i]) < 1e-9) for i in got)


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    w = _windows(spark)
    src, where, marks = tmp_path / "in", tmp_path / "stream", str(tmp_path / "checkpoint")
    src.mkdir()
    stream = spark.readStream.schema(w.schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    want = {r.id: r.score for r in _detector(tmp_path / "loop").run(w).where("batch < 3").collect()}
    for lo, hi in ((0, 420), (420, 600)):
        w.where(f"id >= {lo} and id < {hi}").coalesce(1).write.mode("append").parquet(str(src))
        q = _detector(where).start(stream, marks)  # a new object: nothing held from before
        q.processAllAvailable()
        q.stop()
    got = {r.id: r.score for r in spark.read.parquet(str(where / "scores")).collect()}
    assert set(got) == set(want) == set(range(500))
    assert all((got[i] is None) == (want[i] is None) and (got[i] is None or abs(got[i] - want[i]) < 1e-9) for i in got)
    assert {f.name for f in where.iterdir()} == {"scores", "buffer", "model=2", "version=2"}
    assert [f.name for f in (where / "buffer").iterdir()] == ["micro=1"]  # ids from 500 on wait for their batch


def test_event_precision(spark):
    labels = spark.createDataFrame([("s", t, int(t in (10, 11, 30))) for t in range(50)], "series_id string, t long, label int")
    e = evaluation.events(labels, 4)
    assert sorted((r.begin, r.end) for r in e.collect()) == [(7, 11), (27, 30)]
    s = spark.createDataFrame([("s", t, float({9: 5, 12: 4, 29: 3}.get(t, 0))) for t in range(50)], "series_id string, id long, score double")
    r = evaluation.event_precision(s, e, 4).first()
    assert (r.n_events, r.n_hits, r.precision) == (2, 2, 1.0)


def test_vector_files_and_saved_index(spark, tmp_path):
    x = np.arange(12, dtype=np.float32).reshape(4, 3)
    raw = b"".join(struct.pack("<i3f", 3, *row) for row in x)
    (tmp_path / "a.fvecs").write_bytes(raw)
    v = vectors.read(spark, str(tmp_path / "a.fvecs"))
    assert np.array_equal(np.stack([r.vec for r in v.orderBy("id").collect()]), x)
    assert b"".join(bytes(r.record) for r in vectors.to_records(v).orderBy("id").collect()) == raw
    assert np.array_equal(vectors.parse(vectors.record(np.array([1, 2, 250]), "bvecs"), "bvecs")[0], [1, 2, 250])
    with pytest.raises(ValueError):
        vectors.parse(raw[:16] + struct.pack("<i3f", 2, 0, 0, 0), "fvecs")
    s = vectors.synthetic(spark, 8, 50).persist()
    c = models.pinned_centroids(s, 4)
    lists = ivf.build(s, c)
    vectors.save_index(str(tmp_path / "i"), {"nlist": 4}, lists, centroids=c)
    spec, back, model = vectors.load_index(spark, str(tmp_path / "i"))
    key = lambda df: sorted((r.list_no, r.id, tuple(r.vec)) for r in df.collect())
    assert spec == {"nlist": 4} and np.array_equal(model["centroids"], c) and key(back) == key(lists)
    assert vectors.merge_shards([s, s]).count() == 100 and vectors.merge_shards([s, s]).select("id").distinct().count() == 100
