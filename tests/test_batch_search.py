from tessera.operators import ivf, models
from tessera.plans import catalogue


def test_batch_search_in_parts(spark, sf_dir):
    """Lists and their queries in parts: the tables a task holds are small, the results those of a plain search."""
    v = catalogue.vectors(spark, sf_dir)
    c = models.pinned_centroids(v, 4)
    probed, lists = ivf.probes(v.where("id % 5 = 0"), c, 2), ivf.build(v, c)
    held = ivf.knn._nearest
    sizes = spark.sparkContext.accumulator(0)

    def seen(xs, ids, qs, *more):
        sizes.add(len(xs) > 60 or len(qs) > 60)
        return held(xs, ids, qs, *more)

    ivf.knn._nearest = seen
    try:
        got = ivf.batch_search(probed, lists, 5, part=20).collect()
    finally:
        ivf.knn._nearest = held
    want = ivf.search(v.where("id % 5 = 0"), lists, c, 5, 2).collect()
    plain = lambda t: sorted((r.qid, r["rank"], r.id, round(r.dis, 9)) for r in t)
    assert plain(got) == plain(want) and sizes.value == 0
