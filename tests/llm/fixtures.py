"""Awkward documents, and rows of words to build copies from."""

import random

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("n", T.LongType()), T.StructField("sid", T.StringType()), T.StructField("count", T.LongType()),
])


def words(rng, n):
    return ["".join(rng.choice(["ka", "lo", "mi", "té", "ru", "sa", "no"]) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def texts(seed=1, n=60):
    """Nulls, empty, blank and very long texts, ties, exact and near copies, shared lines."""
    rng = random.Random(seed)
    out = [None, "", " \n\t ", "one", "two words", "Two Words", "one", "x" * 5000, " ".join(words(rng, 30000))]
    base = words(rng, 120)
    line = " ".join(words(rng, 14))
    for _ in range(12):
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = rng.choice(words(rng, 3))
        out.append(" ".join(w))
    for i in range(n):
        t = "\n".join(" ".join(words(rng, rng.randint(3, 20))) for _ in range(rng.randint(1, 6)))
        out.append(t + "\n" + line if i % 3 == 0 else t)
    return out + out[20:26]


def frame(spark, rows=None):
    """Rows (doc_id, text, source) with extra columns whose names clash with those used inside."""
    if rows is None:
        rows = [(i, t, f"s{i % 4}" if i % 7 else None) for i, t in enumerate(texts())]
    return spark.createDataFrame([(i, t, None, s, None, 7, "x", 1) for i, t, s in rows], SCHEMA)
