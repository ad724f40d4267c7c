import numpy as np
import pytest

from tessera.operators import models, series
from tessera.streaming import detector


@pytest.fixture
def windows(spark):
    """Windows of a series, and how often a task made one from its points."""
    made = spark.sparkContext.accumulator(0)
    value = np.random.default_rng(4).integers(0, 40, 260)
    points = spark.createDataFrame([("s", t, float(v)) for t, v in enumerate(value)], "series_id string, t long, value double")

    def seen(batches):
        for pdf in batches:
            made.add(len(pdf))
            yield pdf

    w = series.windows(points, 8).select("id", "vec")
    return w.mapInPandas(seen, "id long, vec array<double>"), made


def test_a_run_makes_its_windows_once(windows, tmp_path):
    w, made = windows
    d = detector.StreamingDetector(str(tmp_path / "a"), 8, nlist=6, nprobe=3, k=3, m=4, codes=8, horizon=120, batch=60, nlist_batch=3, n_iter=2)
    assert d.run(w).count() == 253 and made.value == 253
    assert not (tmp_path / "a" / "windows").exists()


def test_scores_first_makes_its_windows_once(windows, tmp_path):
    w, made = windows
    d = detector.StreamingDetector(str(tmp_path / "a"), 8, nlist=6, nprobe=3, k=3, m=4, codes=8, horizon=120, batch=60, nlist_batch=3, n_iter=2, score_first=True)
    assert d.run(w).count() == 253 and made.value == 253


def test_rebuilding_makes_its_windows_once(windows):
    w, made = windows
    assert detector.rebuild_scores(w, 8, 6, 3, 3, 4, 8, 120, 100, 2).count() == 253
    assert made.value <= 2 * 253  # a checkpoint computes a frame and writes it


def test_nearest_centroids_are_those_of_the_differences():
    rng = np.random.default_rng(6)
    x, c = rng.integers(0, 4, (300, 5)).astype(float), rng.integers(0, 4, (40, 5)).astype(float)
    x[3, 0], c[7] = np.nan, c[2]
    d = models.squared_distances(x, c)
    for k in (1, 4, 40, 60):
        near, dis = models.nearest(x, c, k)
        want = np.argsort(d, axis=1, kind="stable")[:, :k]
        assert (near == want).all() and np.array_equal(dis, np.take_along_axis(d, want, 1), equal_nan=True)
