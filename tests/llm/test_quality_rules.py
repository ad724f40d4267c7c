import collections
import re

import duckdb
from fixtures import frame, texts

from tessera.llm import quality_rules


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count = collections.Counter(grams)
    again = {i + k for i, g in enumerate(grams) if count[g] > 1 for k in range(5)}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again), n < 10 or 100 * len(again) > 20 * n


def test_equals_brute_force(spark):
    extra = ["a b c d e " * 4, "a b c d e x a b c d e", "q w e r t y " * 3000, "l1 x\nl1 x\n \n \nl1 x", "\x0b\x0c a b \x1c c", "# * $ <a>| % &", "a b c d e f g h i", "Ünïcode 語 " * 7]
    rows = list(enumerate([*texts(), *extra]))
    got = {r.doc_id: r for r in quality_rules.quality(frame(spark, [(i, t, "s") for i, t in rows])).collect()}
    for i, t in rows:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(t), t
        assert not (r.kept and r.base_failed) and r.kept == (not r.failed)


def test_no_python_in_the_plan(spark, sf_dir, capsys):
    quality_rules.op2_quality_rules(spark, sf_dir).explain("formatted")
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_oracle(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = sorted(con.execute(quality_rules.ORACLE).fetchall())
    q = quality_rules.op2_quality_rules(spark, sf)
    assert sorted(tuple(r) for r in q.collect()) == want


def test_stage_keeps_rows_whole(spark):
    docs = frame(spark)
    kept = quality_rules.kept_stage(spark, docs, "")
    assert kept.columns == docs.columns and kept.schema.simpleString() == docs.schema.simpleString()
    assert {tuple(r) for r in kept.collect()} <= {tuple(r) for r in docs.collect()}
    assert quality_rules.quality(docs.limit(0)).collect() == []
