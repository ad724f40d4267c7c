import io
import zlib

import numpy as np
import pytest
from fixtures import frame, texts

from tessera.llm import sorted_tables
from tessera.llm._session import Kept, new_path
from tessera.llm._tokens import tokenizer_path


class _File(io.BytesIO):
    def size(self):
        return len(self.getvalue())


def test_lookups_and_damage():
    out = io.BytesIO()
    w = sorted_tables.Writer(out, block=200)
    want = {i: np.arange(i % 50, dtype="<u4") + (70000 if i % 9 == 0 else 0) for i in range(-300, 3000, 3)}
    for i, ids in want.items():
        w.add(i, ids.tobytes())
        if i == 300:
            for _ in range(40):
                w.add(i, b"\x07\0\0\0")
    w.close()
    t = sorted_tables.Table(_File(out.getvalue()))
    for i in range(-310, 3010):
        found = t.get(i)
        assert len(found) == (i in want) + 40 * (i == 300)
        if found:
            assert np.array_equal(found[0], want[i])
    assert [i for i, _ in t.scan()] == sorted([*want, *[300] * 40])
    broken = bytearray(out.getvalue())
    broken[20] ^= 1
    with pytest.raises(ValueError):
        list(sorted_tables.Table(_File(bytes(broken))).scan())


def test_round_trip(spark):
    from tokenizers import Tokenizer

    rows = [*enumerate(texts()), (-5, "negative"), (3, "again"), (None, "left out")]
    docs = frame(spark, [(i, t, "s") for i, t in rows])
    shards = Kept(spark).table(sorted_tables.write_tables(docs, new_path(spark, "t"), tokenizer_path(), shard=2000), "shards")
    assert shards.count() > 4
    t = Tokenizer.from_file(tokenizer_path())
    want = sorted((i, zlib.crc32(np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], dtype="<u4").tobytes())) for i, x in rows if i is not None)
    got = sorted_tables.read_tables(shards).collect()
    assert sorted((r.doc_id, zlib.crc32(r.ids)) for r in got) == want
    assert sorted_tables.read_tables(sorted_tables.write_tables(docs.limit(0), new_path(spark, "t"), tokenizer_path())).collect() == []


def test_query(spark, sf_dir):
    got = sorted(sorted_tables.op6_sorted_tables(spark, sf_dir).collect())
    at = 0
    for doc_id, start, n, _ in got:
        assert start == at
        at += n
    assert len(got) == 200
