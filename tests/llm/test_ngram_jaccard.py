import re

import numpy as np
import pyarrow as pa
from fixtures import frame, texts

from tessera.llm import ngram_jaccard
from tessera.llm.ngram_jaccard import jaccard_join, one_of_each


def brute(rows, k=3, num=90, den=100):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    up, n = {i: i for i in sets}, dict.fromkeys(sets, 0)

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                up[b] = a
                n[i] += 1
                n[j] += 1
    return {(i, len(sets[i]), find(i), n[i]) for i in sets}


def test_equals_brute_force(spark):
    rows = list(enumerate(texts()))
    docs = frame(spark, [(i, t, "s") for i, t in rows])
    for block in (200_000, 300):
        got = {tuple(r) for r in jaccard_join(docs, block=block).collect()}
        assert got == brute(rows)
    assert sum(1 for r in got if r[2] != r[0]) > 5
    looser = {tuple(r) for r in jaccard_join(docs, 2, 60, 100, block=300).collect()}
    assert looser == brute(rows, 2, 60)


def test_null_ids_repeats_and_empty(spark):
    docs = frame(spark, [(None, "a b c d", "s"), (3, "a b c d", "s"), (3, "a b c d", "s"), (9, "A B C D", None)])
    got = sorted((tuple(r) for r in jaccard_join(docs).collect()), key=str)
    assert got == [(3, 2, 3, 2), (3, 2, 3, 2), (9, 2, 3, 2), (None, 2, None, 0)]
    assert jaccard_join(docs.limit(0)).collect() == []
    kept = one_of_each(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [3, None]


def test_tokens_of_more_sets_than_a_group_holds(spark, monkeypatch):
    """Of one token's sets, those on both sides of the border reach each other wherever their sizes allow it."""
    monkeypatch.setattr(ngram_jaccard, "GROUP", 3)
    # Sets 0 and 4 have like parts, those between fall in other parts: can_link joins none of the first three.
    vectors = [np.roll([50] + [0] * 15, i % 4).astype(np.uint8).tobytes() for i in range(6)]
    cols = [pa.array([7] * 6, pa.int64()), pa.array([50] * 6, pa.int64()), pa.array(range(6), pa.int64()), pa.array(vectors, pa.binary())]
    batch = pa.RecordBatch.from_arrays(cols, ["token", "n", "sid", "part"])
    found = {frozenset(p) for b in ngram_jaccard._near(90, 100)(iter([batch])) for p in zip(*(c.to_pylist() for c in b.columns))}
    assert found >= {frozenset((i, i + 1)) for i in range(5)}
    rows = list(enumerate(texts()))
    docs = frame(spark, [(i, t, "s") for i, t in rows])
    assert {tuple(r) for r in jaccard_join(docs, 2, 60, 100).collect()} == brute(rows, 2, 60)


def test_stage_drops_copies_at_five_words_and_four_fifths(spark):
    """Two words of 100 replaced: 86 / 106 of the 5-word shingles stay, and 92 / 104 of the 3-word ones."""
    words = [f"w{i}" for i in range(100)]
    near = [{30: "x", 60: "y"}.get(i, w) for i, w in enumerate(words)]
    far = [{20: "x", 45: "y", 70: "z"}.get(i, w) for i, w in enumerate(words)]  # 81 / 111
    docs = frame(spark, [(1, " ".join(words), "s"), (2, " ".join(near), "s"), (3, " ".join(far), "s")])
    assert sorted(r.doc_id for r in one_of_each(spark, docs, "").collect()) == [1, 3]
