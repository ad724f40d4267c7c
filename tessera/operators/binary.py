"""Binary vectors: packed bytes, Hamming distances, bit hashes and threshold codes.

A code is an array<long> of 64-bit words (bit i of the vector is bit i % 64 of word i / 64), so
distances are ``bit_count(a ^ b)`` in generated code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import knn


def bits_of(vec: Column, thresholds: list[float] | None = None) -> Column:
    """array<int> of 0 / 1: component >= threshold (0 by default)."""
    if thresholds is None:
        return F.transform(vec, lambda x: (x.cast("double") >= 0.0).cast("int"))
    t = F.array(*[F.lit(float(v)) for v in thresholds])
    return F.transform(vec, lambda x, i: (x.cast("double") >= F.get(t, i)).cast("int"))


def pack(bits: Column, n_bits: int, word: int = 32) -> Column:
    """0 / 1 array -> words of ``word`` bits each, the lowest bit first."""
    one = lambda w: F.aggregate(F.transform(F.slice(bits, w * word + 1, word), lambda b, i: b.cast("long") * F.pow(F.lit(2.0), i).cast("long")), F.lit(0).cast("long"), lambda s, v: s + v)
    return F.array(*[one(w) for w in range(-(-n_bits // word))])


def unpack(words: Column, n_bits: int, word: int = 32) -> Column:
    bit = lambda i: F.call_function("shiftright", F.get(words, F.floor(i / word).cast("int")), F.pmod(i, F.lit(word))).bitwiseAND(F.lit(1).cast("long")).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(n_bits - 1)), bit)


def to_signs(bits: Column) -> Column:
    """0 / 1 -> -1.0 / 1.0."""
    return F.transform(bits, lambda b: (2 * b - 1).cast("double"))


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, v: s + v)


def differing_bytes(a: Column, b: Column) -> Column:
    """Generalised Hamming distance: bytes in which 32-bit words differ."""
    byte = lambda v, k: F.shiftright(v, 8 * k).bitwiseAND(F.lit(255))
    per = lambda x, y: sum((byte(x.bitwiseXOR(y), k) != 0).cast("int") for k in range(4))
    return F.aggregate(F.zip_with(a, b, per), F.lit(0), lambda s, v: s + v)


def pairs(queries: DataFrame, base: DataFrame, distance=hamming) -> DataFrame:
    """(qid, id, dis) over all pairs of queries and rows (id, code)."""
    q = queries.select(F.col("id").alias("qid"), F.col("code").alias("qcode"))
    return knn.beside(base.select("id", "code"), q).select("qid", "id", distance(F.col("qcode"), F.col("code")).cast("double").alias("dis"))


def search(queries: DataFrame, base: DataFrame, k: int) -> DataFrame:
    return knn.top_k(pairs(queries, base), k).select("qid", "rank", "id", F.col("dis").cast("int").alias("dis"))


def flips(b: int, n: int) -> list[int]:
    """All masks of b bits with at most n set."""
    return [m for m in range(1 << b) if bin(m).count("1") <= n]


def hash_candidates(queries: DataFrame, base: DataFrame, b: int, nflip: int = 0, n_hash: int = 1) -> DataFrame:
    """(qid, qcode, id, code) of vectors in a bucket within ``nflip`` flips of the query's.

    Table t's bucket: bits t*b .. t*b+b-1 of the first word. Found more than once, a vector counts once.
    """
    bucket = lambda t: F.shiftright(F.get("code", 0), t * b).bitwiseAND(F.lit((1 << b) - 1))
    tables = lambda df, masks: df.withColumn("slot", F.explode(F.array(*[F.struct(F.lit(t).alias("t"), bucket(t).bitwiseXOR(F.lit(m).cast("long")).alias("h")) for t in range(n_hash) for m in masks])))
    q = tables(queries.select("id", "code"), flips(b, nflip)).select(F.col("id").alias("qid"), F.col("code").alias("qcode"), "slot")
    return q.join(tables(base.select("id", "code"), [0]), "slot").select("qid", "qcode", "id", "code").dropDuplicates(["qid", "id"])


def hash_search(queries: DataFrame, base: DataFrame, k: int, b: int, nflip: int = 0, n_hash: int = 1) -> DataFrame:
    c = hash_candidates(queries, base, b, nflip, n_hash)
    return knn.top_k(c.select("qid", "id", hamming(F.col("qcode"), F.col("code")).cast("double").alias("dis")), k).select("qid", "rank", "id", F.col("dis").cast("int").alias("dis"))


def lsh_thresholds(vectors: DataFrame, n_bits: int) -> list[float]:
    """The exact median of each of the first n_bits components."""
    parts = vectors.select(F.posexplode(F.slice(F.col("vec").cast("array<double>"), 1, n_bits)).alias("pos", "x"))
    return [r.m for r in parts.groupBy("pos").agg(F.median("x").alias("m")).orderBy("pos").collect()]


def spectral_bits(vec: Column, period: float, centre: Column | None = None) -> Column:
    """floor((x - c) * 2 / period) & 1 of each component."""
    value = lambda x, c: F.pmod(F.floor((x.cast("double") - c) * 2.0 / period), F.lit(2)).cast("int")
    return F.transform(vec, lambda x: value(x, F.lit(0.0))) if centre is None else F.zip_with(vec, centre, value)
