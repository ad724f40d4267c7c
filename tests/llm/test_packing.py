import collections
import zlib

import numpy as np
from fixtures import frame, texts

from tessera.llm import packing
from tessera.llm._tokens import Encoder, tokenizer_path


def brute(rows, seq_len, end_id=2):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    out = []
    for i, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, end_id], dtype="<u4")
        cuts = [0, *range((len(ids) - 1) % seq_len + 1, len(ids), seq_len), len(ids)]
        out += [(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:]))]
    return out


def test_pieces_and_places(spark):
    rows = [*enumerate(texts()), (3, "one"), (3, "one"), (None, "no id"), (None, None)]
    for seq_len in (1024, 16):
        got = packing.pack(frame(spark, [(i, t, "s") for i, t in rows]), tokenizer_path(), seq_len, digest=True).collect()
        assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == collections.Counter(brute(rows, seq_len))
        by = collections.defaultdict(list)
        for r in got:
            by[r.sequence_id].append((r.offset, r.length))
        for parts in by.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= seq_len
        assert len(by) <= -(-sum(r.length for r in got) // seq_len) * 1.15 + 1
    assert packing.pack(frame(spark, []), tokenizer_path()).collect() == []


def test_sequences_hold_the_ids(spark):
    packed = packing.pack(frame(spark, [(i, t, "s") for i, t in enumerate(texts()[:20])]), tokenizer_path(), 64)
    ids = {r.sequence_id: np.frombuffer(r.ids, dtype="<u4") for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        assert np.array_equal(ids[r.sequence_id][r.offset : r.offset + r.length], np.frombuffer(r.ids, dtype="<u4"))


def test_plan_is_near_the_bound():
    rng = np.random.default_rng(5)
    for counts in (rng.integers(0, 300, 1025), rng.geometric(0.004, 50000), np.array([700] * 100), np.array([], int)):
        hist = counts.astype(np.int64) if len(counts) == 1025 else np.bincount(np.clip(counts, 1, 1024), minlength=1025)
        hist[0] = 0
        made = packing.plan(hist, 1024)
        used = np.zeros(1025, np.int64)
        for lengths, n in made:
            assert sum(lengths) <= 1024
            for v in lengths:
                used[v] += n
        assert np.array_equal(used, hist)
        total = int((hist * np.arange(1025)).sum())
        if len(counts) > 1000:
            assert sum(n for _, n in made) <= max(-(-total // 1024), int(hist[513:].sum())) * 1.003 + 1


def test_cached_segments_equal_the_library():
    e = Encoder(tokenizer_path())
    odd = ["", " ", "a  b", "a\n\n b ", "\ta", "it's we'll", "a\x1cb !\x1d!", "x<|endoftext|>y", " x y z", "é́ a​b", "日本語 テキスト", "a" * 500 + " b", "1 2 3  4", "\r\n\r\nq", "x\x85 y"]
    assert e.encode(odd + odd) == e._whole(odd + odd)
    rng = np.random.default_rng(3)
    many = ["".join(rng.choice(list("ab 1.'\n\t é!"), 30)) for _ in range(300)]
    assert e.encode(many) == e._whole(many)
