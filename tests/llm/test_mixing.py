import collections

import numpy as np
from fixtures import frame, texts, words

from tessera.llm import mixing


def brute_targets(sizes, most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    target, left, free = dict.fromkeys(names, 0.0), float(sum(sizes.values())), set(names)
    while free:
        share = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * share >= most * sizes[s]}
        if not over:
            for s in free:
                target[s] = weight[s] * share
            break
        for s in over:
            target[s] = float(most * sizes[s])
            left -= target[s]
        free -= over
    return target


def test_targets_and_totals(spark):
    import random

    rng = random.Random(4)
    rows = [(i, " ".join(words(rng, rng.randint(0, 80))), None if i % 11 == 0 else f"s{(i * i) % 7 if i % 3 else 0}") for i in range(1500)]
    rows += [(9000 + i, t, "tiny") for i, t in enumerate(texts()[:4])] + [(5, "same row here", "dup")] * 3 + [(None, "x y z", "dup"), (1, None, "nothing")]
    docs = frame(spark, rows)
    got = mixing.mix(docs, bucket=64).collect()
    assert collections.Counter((r.doc_id, r.size) for r in got) == collections.Counter((i, len((t or "").split())) for i, t, _ in rows)
    sizes, taken, docs_taken, n = (collections.Counter() for _ in range(4))
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        docs_taken[r.source] += r.copies
        n[r.source] += 1
        assert 0 <= r.copies <= 3 and r.taken == r.copies * r.size
    want = brute_targets(sizes)
    for r in got:
        assert abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source]) and r.source_size == sizes[r.source]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 170, (s, taken[s], want[s])
        if sizes[s] > 1000:
            assert abs(docs_taken[s] - n[s] * want[s] / sizes[s]) <= 3
    again = mixing.mix(docs.repartition(5, "text"), bucket=64).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(map(tuple, again))


def test_flight_is_unbiased_and_balanced():
    rng = np.random.default_rng(0)
    size, p = rng.integers(1, 500, 60).astype(float), np.full(60, 0.3)
    sums, each = [], np.zeros(60)
    for seed in range(800):
        out = mixing.fly(p, np.ones(60), size, seed, land=True)
        assert set(np.unique(out)) <= {0.0, 1.0}
        each += out
        sums.append((out * size).sum())
    assert abs(each / 800 - 0.3).max() < 0.08
    assert abs(np.mean(sums) - 0.3 * size.sum()) < 20 and np.std(sums) < 500
    assert len(mixing.fly(np.zeros(0), np.zeros(0), np.zeros(0), 1, True)) == 0


def test_stage_and_empty(spark):
    docs = frame(spark)
    assert mixing.mix(docs.limit(0)).collect() == []
    kept = mixing.mixed_stage(spark, docs, "")
    assert kept.columns == docs.columns
    times = {(r.doc_id): r.copies for r in mixing.mix(docs).collect()}
    assert collections.Counter(r.doc_id for r in kept.collect()) == collections.Counter({i: n for i, n in times.items() if n})
