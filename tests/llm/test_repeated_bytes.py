import collections
import hashlib
import random

from fixtures import frame, texts, words

from tessera.llm.repeated_bytes import remove_repeats


def brute(rows, length):
    seen = collections.Counter()
    data = [(i, (t or "").encode()) for i, t in rows]
    for _, b in data:
        seen.update(b[p : p + length] for p in range(len(b) - length + 1))
    out = collections.Counter()
    for i, b in data:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = b"\x01" * length
        left = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for p in range(len(b)) if gone[p] and (p == 0 or not gone[p - 1]))
        out[(i, len(b), sum(gone), spans, hashlib.sha256(left).hexdigest())] += 1
    return out


def rows_with_passages(seed):
    rng = random.Random(seed)
    passages = [" ".join(words(rng, 90)) for _ in range(6)] + ["é" * 300, "ab" * 400, "z" * 900]
    out = [*texts(seed, 10)]
    for _ in range(25):
        parts = [" ".join(words(rng, rng.randint(0, 60)))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, 60)
            parts += [p[a : len(p) - rng.randint(0, 60)], " ".join(words(rng, rng.randint(0, 20)))]
        out.append(" ".join(parts))
    return out + [passages[0] + passages[0], "".join(rng.choice("ab") for _ in range(3000))] * 2


def test_equals_brute_force(spark):
    for seed in (1, 2):
        rows = [*enumerate(rows_with_passages(seed)), (3, "repeat " * 200), (3, "repeat " * 200), (None, None)]
        rows = [(i, t if t is None or len(t) < 20000 else t[:9000]) for i, t in rows]
        got = collections.Counter(tuple(r) for r in remove_repeats(frame(spark, [(i, t, "s") for i, t in rows])).collect())
        assert got == brute(rows, 400)
        assert sum(r[2] > 0 and r[2] < r[1] for r in got) > 8


def test_empty(spark):
    assert remove_repeats(frame(spark, [])).collect() == []


def test_long_texts_in_spans(spark, monkeypatch):
    """A text longer than one span, with repeats across the cut."""
    rng = random.Random(9)
    base = " ".join(words(rng, 180_000))
    assert len(base.encode()) > 1 << 20
    rows = [(0, base), (1, base[1_047_900:1_048_900] + " end"), (2, base[500:1000])]
    got = {r.doc_id: r for r in remove_repeats(frame(spark, [(i, t, "s") for i, t in rows])).collect()}
    cut = base.encode()
    for i in (1, 2):
        assert got[i].n_spans == 1 and got[i].n_removed >= len(rows[i][1].encode()) - 8
    assert got[0].n_spans == 2 and got[0].n_bytes == len(cut)
