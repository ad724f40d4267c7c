import collections
import math

from fixtures import frame, texts

from tessera.llm import lm_scoring


def brute(rows, target, vocabulary, pairs):
    """Scores from plain counts."""
    docs = [(i, (t or "").lower().split()) for i, t in rows]
    total = sum(len(w) for _, w in docs)
    own = [w for i, w in docs if i in target]
    total_t = sum(map(len, own))
    count = collections.Counter(x for _, w in docs for x in w)
    vocab = {x for x, n in count.items() if n * vocabulary >= total}
    rare = lambda w: [x if x in vocab else None for x in w]
    models = []
    both = [[rare(w) for w in own], [rare(w) for _, w in docs]]
    bi = [collections.Counter(p for w in ws for p in zip(["<s>", *w], w)) for ws in both]
    keep = {p for p in bi[1] if bi[1][p] * pairs >= total or (bi[0][p] and bi[0][p] * pairs >= total_t)}
    for ws, b, n in zip(both, bi, (total_t, total)):
        uni = collections.Counter(x for w in ws for x in w)
        hist = collections.Counter()
        for p in keep:
            hist[p[0]] += b[p]
        models.append((uni, b, hist, n))

    def loss(m, w):
        uni, b, hist, n = m
        w = rare(w)
        out = 0.0
        for p in zip(["<s>", *w], w):
            u = (uni[p[1]] + 1) / (n + len(vocab) + 1)
            out -= math.log(((b[p] if p in keep else 0) + lm_scoring.MU * u) / (hist[p[0]] + lm_scoring.MU))
        return out / len(w)

    return {i: (len(w), *((loss(models[0], w), loss(models[1], w)) if w else (None, None))) for i, w in docs}


def test_equals_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(texts())]
    docs = frame(spark, [(i, t, "s") for i, t in rows])
    target = docs.where("doc_id % 2 = 0 and doc_id > 10").select("doc_id")
    for vocabulary, pairs in ((100_000, 500_000), (200, 500)):
        want = brute(rows, {i for i, _ in rows if i % 2 == 0 and i > 10}, vocabulary, pairs)
        for r in lm_scoring.cross_entropy_difference(docs, target, vocabulary, pairs).collect():
            n, t, b = want[r.doc_id]
            assert r.n_tokens == n
            if n:
                assert abs(r.target_loss - t) < 1e-9 and abs(r.background_loss - b) < 1e-9 and abs(r.score - (t - b)) < 1e-9
            else:
                assert r.target_loss is r.background_loss is r.score is None


def test_no_word_or_pair_is_dropped(spark, monkeypatch):
    """Seldom words and pairs keep their counts, in whatever blocks; null ids and repeated rows too."""
    rows = [(i, t) for i, t in enumerate(texts())]
    docs = frame(spark, [(i, t, "s") for i, t in [*rows, (None, "two words"), rows[12], rows[12]]])
    target = docs.where("doc_id % 2 = 0 and doc_id > 10").select("doc_id")
    want = brute([*rows, (-1, "two words"), rows[12], rows[12]], {i for i, _ in rows if i % 2 == 0 and i > 10}, 10**9, 10**9)
    for size in (1 << 24, 40_000, 2_000):
        monkeypatch.setattr(lm_scoring, "SMALLEST", size)
        monkeypatch.setattr(lm_scoring, "LARGEST", size)
        got = lm_scoring.cross_entropy_difference(docs, target).collect()
        assert len(got) == len(rows) + 3 and sum(r.doc_id == 12 for r in got) == 3
        for r in got:
            n, t, b = want[-1 if r.doc_id is None else r.doc_id]
            assert r.n_tokens == n
            if n:
                assert abs(r.target_loss - t) < 1e-9 and abs(r.background_loss - b) < 1e-9 and abs(r.score - (t - b)) < 1e-9
            else:
                assert r.target_loss is r.background_loss is r.score is None


def test_seldom_words_of_a_larger_table(spark):
    """One word in over 300,000: under any share that a bounded model would keep."""
    rows = [(0, "a b " * 300_000), (1, "seldom words"), (2, "seldom a"), (3, "other words")]
    want = brute(rows, {1}, 10**9, 10**9)
    got = lm_scoring.cross_entropy_difference(frame(spark, [(i, t, "s") for i, t in rows]), spark.createDataFrame([(1,)], "doc_id long")).collect()
    assert len(got) == 4
    for r in got:
        n, t, b = want[r.doc_id]
        assert r.n_tokens == n and abs(r.target_loss - t) < 1e-9 and abs(r.background_loss - b) < 1e-9


def test_joined_targets_no_target_and_empty(spark, monkeypatch):
    docs = frame(spark)
    ids = docs.where("doc_id < 20").select("doc_id")
    first = sorted(map(str, lm_scoring.cross_entropy_difference(docs, ids).collect()))
    monkeypatch.setattr(lm_scoring, "MOST_IDS", 1)
    assert sorted(map(str, lm_scoring.cross_entropy_difference(docs, ids).collect())) == first
    assert lm_scoring.cross_entropy_difference(docs, ids.limit(0)).count() == docs.count()
    assert lm_scoring.cross_entropy_difference(docs.limit(0), ids).collect() == []


def test_separates_held_out_quality(spark):
    """Held-out: documents of good quality score lower than bad ones, with labels of the other half as target."""
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = lm_scoring.cross_entropy_difference(docs, labels.where("quality = 1 and toxic = 0 and doc_id % 2 = 0").select("doc_id"))
    held = got.join(labels.where("doc_id % 2 = 1 and toxic = 0"), "doc_id").where("n_tokens >= 20").select("score", "quality").collect()
    good, bad = ([r.score for r in held if r.quality == q] for q in (1, 0))
    wins = sum((g < b) + 0.5 * (g == b) for g in good for b in bad) / max(1, len(good) * len(bad))
    assert len(good) > 20 and len(bad) > 3 and wins > 0.75, (len(good), len(bad), wins)
