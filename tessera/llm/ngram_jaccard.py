"""Operator 10: exact n-gram Jaccard join by T-occurrence search.

1. Texts become sets of shingle fingerprints; equal sets are one set with copies.
2. A fixed-size counting sketch over all shingles orders them from rare to frequent.
   Any order is exact, so the sketch's error costs no link.
3. Prefix filter: sets that can link share one of their n - ceil(t n) + 1 rarest
   shingles. Among sets that share one, a sound bound on their overlap (differences of
   how many shingles fall in each part of the hash range) tells which can link at all;
   a spanning forest of those, never all pairs, forms the candidate groups.
4. Inside a group, blocks of sets are searched by T-occurrence (``_overlap``).
5. Distributed union-find over the links gives the classes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import _overlap
from tessera.llm._graph import components
from tessera.llm._overlap import Forest
from tessera.llm._session import Kept, documents, partitions, prepare, trimmed
from tessera.llm._text import mix, pieces, shingle_sets

#: Counters of the sketch: its size is fixed, whatever the input.
COUNTERS, CHUNK = 1 << 21, 1 << 14
#: A set of which more than one in so many rows is a copy is announced to all tasks (so at most this many are).
HOT_SHARE = 4096
#: Sets of one token that are compared with each other in memory.
GROUP = 2000


def set_id(elements: np.ndarray) -> int:
    """64-bit name of a set: equal for equal sets."""
    return int((mix(elements).sum(dtype=np.uint64) + np.uint64(len(elements))).astype(np.uint64).view(np.int64))


def parts(elements: np.ndarray) -> bytes:
    """How many elements fall in each of 2**j equal parts of the hash range (255: that many or more)."""
    j = max(4, (len(elements) // 32).bit_length())
    return np.minimum(np.bincount((elements >> np.uint64(64 - j)).astype(np.int64), minlength=1 << j), 255).astype(np.uint8).tobytes()


def _fold(part: np.ndarray, n: int) -> np.ndarray:
    return part.reshape(n, -1).sum(axis=1)


def can_link(ns: np.ndarray, vectors: list[np.ndarray], num: int, den: int) -> Iterator[tuple[int, int]]:
    """A spanning forest of the pairs whose part counts allow a similarity of num / den.

    The parts' differences sum to |x - y| + |y - x| at most, which a link bounds by
    (den - num) / (den + num) * (|x| + |y|). ``ns`` ascend.
    """
    forest = Forest(len(ns))
    folded: dict[int, np.ndarray] = {}
    for i in range(len(ns)):
        to = int(np.searchsorted(ns, ns[i] * den // num, side="right"))
        if to <= i + 1:
            continue
        width = len(vectors[i])
        if width not in folded:
            folded[width] = np.stack([_fold(v, width) if len(v) >= width else np.zeros(width, np.int64) for v in vectors])
        far = np.abs(folded[width][i + 1 : to] - folded[width][i]).sum(axis=1)
        for j in np.flatnonzero(far * (den + num) <= (den - num) * (ns[i + 1 : to] + ns[i])):
            if forest.join(i, i + 1 + int(j)):
                yield i, i + 1 + int(j)


def _slots(elements: np.ndarray) -> np.ndarray:
    return (mix(elements) >> np.uint64(64 - COUNTERS.bit_length() + 1)).astype(np.int64)


def _scan(k: int):
    """Per row (kind 0): id, set, size, part counts; per task (kind 1): its part of the sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, dtype=np.uint32)

        def out(kind, ids, sids, ns, parts):
            m = len(sids)
            return pa.RecordBatch.from_arrays([pa.array([kind] * m, pa.int32()), pa.array(ids, pa.int64()), pa.array(sids, pa.int64()), pa.array(ns, pa.int64()), pa.array(parts, pa.binary())], ["kind", "doc_id", "sid", "n", "part"])

        for whole in batches:
            for batch in pieces(whole):
                sids, ns, seen, vectors = [], [], [], []
                for s in shingle_sets(batch.column("text"), k):
                    sids.append(set_id(s))
                    ns.append(len(s))
                    seen.append(s)
                    vectors.append(parts(s))
                counts += np.bincount(_slots(np.concatenate(seen)), minlength=COUNTERS).astype(np.uint32)
                yield out(0, batch.column("doc_id"), sids, ns, vectors)
        chunks = [i for i in range(COUNTERS // CHUNK) if counts[i * CHUNK : (i + 1) * CHUNK].any()]
        yield out(1, [None] * len(chunks), chunks, [0] * len(chunks), [counts[i * CHUNK : (i + 1) * CHUNK].tobytes() for i in chunks])

    return run


def _add_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, part in zip(batch.column("sid").to_pylist(), batch.column("part").to_pylist()):
            part = np.frombuffer(part, dtype=np.uint32).astype(np.uint64)
            sums[i] = sums[i] + part if i in sums else part
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([np.minimum(x, 2**32 - 1).astype(np.uint32).tobytes() for x in sums.values()], pa.binary())], ["sid", "part"])


def _prefixes(k: int, num: int, den: int, sketch, hot):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, skip = np.frombuffer(sketch.value, dtype=np.uint32), hot.value
        for whole in batches:
            for batch in pieces(whole):
                tokens, sids, done = [], [], set()
                for doc_id, s in zip(batch.column("doc_id").to_pylist(), shingle_sets(batch.column("text"), k)):
                    n = len(s)
                    sid = set_id(s)
                    if doc_id is None or not n or sid in done or skip.get(sid, doc_id) != doc_id:
                        continue
                    done.add(sid)
                    take = n - -(-num * n // den) + 1
                    rare = s[np.lexsort((s, counts[_slots(s)]))[:take]]
                    tokens.append(rare.view(np.int64))
                    sids.append(np.full(take, sid, dtype=np.int64))
                if tokens:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens)), pa.array(np.concatenate(sids))], ["token", "sid"])

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (token, sid): those whose token another set has too, without repeats."""
    last = None  # the row held back, and whether the one before has its token
    for batch in batches:
        t, s = (np.asarray(batch.column(c)) for c in ("token", "sid"))
        if not len(t):
            continue
        was = False
        if last:
            t, s, was = np.append(last[0], t), np.append(last[1], s), last[2]
        new = np.ones(len(t), dtype=bool)
        new[1:] = (t[1:] != t[:-1]) | (s[1:] != s[:-1])
        t, s = t[new], s[new]
        before = np.zeros(len(t), dtype=bool)
        before[1:] = t[1:] == t[:-1]
        before[0] = was
        keep = before[:-1] | before[1:]
        last = (t[-1], s[-1], before[-1])
        yield pa.RecordBatch.from_arrays([pa.array(t[:-1][keep]), pa.array(s[:-1][keep])], ["token", "sid"])
    if last and last[2]:
        yield pa.RecordBatch.from_arrays([pa.array([last[0]]), pa.array([last[1]])], ["token", "sid"])


def _near(num: int, den: int):
    """From rows sorted by (token, n, sid): forest links of the sets of a token that can link.

    A token of more than GROUP sets links all neighbours in size, the first GROUP too, which is
    sound as well: between two sets that can link, every step in size allows a link.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, ns, sids, vectors, out = None, [], [], [], set()

        def close():
            for i, j in can_link(np.array(ns, dtype=np.int64), vectors, num, den):
                out.add((sids[j], sids[i]))
            for x in (ns, sids, vectors):
                x.clear()

        for batch in batches:
            for t, n, sid, v in zip(*(batch.column(c).to_pylist() for c in ("token", "n", "sid", "part"))):
                if t != token:
                    close()
                    token, loose = t, False
                if not loose and len(ns) >= GROUP:
                    loose = True
                    out.update((sids[i + 1], sids[i]) for i in range(len(ns) - 1) if den * ns[i] >= num * ns[i + 1])
                    for x in (ns, sids, vectors):
                        del x[:-1]
                if loose and ns and den * ns[-1] >= num * n:
                    out.add((sid, sids[-1]))
                if loose and len(ns) > 1:
                    close()
                ns.append(n)
                sids.append(sid)
                vectors.append(np.frombuffer(v, dtype=np.uint8).astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], ["u", "v"])
            out.clear()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], ["u", "v"])

    return run


def _common(shared: DataFrame) -> DataFrame:
    """Tokens of more than GROUP sets and more than one in HOT_SHARE rows, at most HOT_SHARE of them."""
    total = shared.count()
    return shared.groupBy("token").count().where(F.col("count") > max(GROUP, total // HOT_SHARE))


def _through_hubs(shared: DataFrame, common: DataFrame, sizes: DataFrame, num: int, den: int) -> DataFrame:
    """Links the sets of common tokens to one set of their size class each; no token meets in one task.

    Size classes are twice as wide as two sets that can link may differ, and come in two kinds, half a class
    apart, so that any two such sets are in one class of either kind. Hubs are broadcast: as many as tokens and classes.
    """
    wide = 2 * math.log(den / num) * 1.000001 or 1.0
    at = F.log(F.greatest(F.col("n"), F.lit(1))) / wide
    both = F.explode(F.array(*[F.struct(F.lit(i).alias("kind"), F.floor(at + i / 2).alias("class")) for i in range(2)]))
    rows = shared.join(F.broadcast(common.select("token")), "token").join(sizes.select("sid", "n"), "sid")
    rows = rows.select("token", "sid", both.alias("c")).select("token", "sid", "c.kind", "c.class")
    hubs = rows.groupBy("token", "kind", "class").agg(F.min("sid").alias("hub"))
    return rows.join(F.broadcast(hubs), ["token", "kind", "class"]).where("sid <> hub").select(F.col("sid").alias("u"), F.col("hub").alias("v")).distinct()


def _elements(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole):
                sets = list(shingle_sets(batch.column("text"), k))
                right = [set_id(s) == sid for s, sid in zip(sets, batch.column("sid").to_pylist())]
                sids = batch.column("sid").filter(pa.array(right))
                yield pa.RecordBatch.from_arrays([sids, pa.array([s.tobytes() for s, r in zip(sets, right) if r], pa.binary())], ["sid", "elements"])

    return run


def jaccard_join(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100, block: int = _overlap.BLOCK) -> DataFrame:
    """Links rows whose sets of k-word shingles have a Jaccard similarity of num / den or more.

    Words are runs of other than white space, A-Z lower-cased. Returns one row per input row:
    doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included) and
    n_links (other rows linked to it directly).

    Null text or text without words: empty set, no links, its own component. Fewer than k words:
    all of them as one shingle. Null doc_id: the row comes back without links, component_id null.
    Repeated rows count as copies of each other. Other columns are ignored. An empty table gives
    an empty result.
    """
    spark = prepare(docs.sparkSession)
    kept, inner = Kept(spark), Kept(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scan = inner.table(docs.mapInArrow(trimmed(_scan(k)), "kind int, doc_id long, sid long, n long, part binary"), "scan")
    rows = kept.table(scan.where("kind = 0").select("doc_id", "sid", "n", "part"), "rows")
    parts = scan.where("kind = 1").select("sid", "part").repartition(min(partitions(spark), COUNTERS // CHUNK), "sid").mapInArrow(_add_parts, "sid long, part binary")
    sketch = np.zeros(COUNTERS, dtype=np.uint32)
    for i, part in parts.collect():  # at most COUNTERS / CHUNK rows
        sketch[i * CHUNK : (i + 1) * CHUNK] = np.frombuffer(part, dtype=np.uint32)
    inner.drop()
    usable = rows.where("doc_id is not null and n > 0")
    sizes = kept.table(usable.groupBy("sid").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"), F.count("*").alias("copies"), F.max("part").alias("part")), "sets")
    total = rows.count()
    hot = {r.sid: r.doc_id for r in sizes.where(F.col("copies") > max(16, total // HOT_SHARE)).collect()}  # at most HOT_SHARE rows
    sc = spark.sparkContext
    tokens = docs.mapInArrow(trimmed(_prefixes(k, num, den, sc.broadcast(sketch.tobytes()), sc.broadcast(hot))), "token long, sid long")
    n_parts = partitions(spark)
    shared = tokens.repartition(n_parts, "token").sortWithinPartitions("token", "sid").mapInArrow(_shared, "token long, sid long")
    shared = inner.table(shared, "shared")
    common = _common(shared)
    rest = shared.join(F.broadcast(common.select("token")), "token", "left_anti").join(sizes.select("sid", "n", "part"), "sid")
    near = rest.repartition(n_parts, "token").sortWithinPartitions("token", "n", "sid").mapInArrow(trimmed(_near(num, den)), "u long, v long")
    groups = components(near.union(_through_hubs(shared, common, sizes, num, den)), inner)
    members = kept.table(sizes.join(groups.select(F.col("node").alias("sid"), F.col("root").alias("grp")), "sid").drop("part"), "members")
    inner.drop()
    sets = docs.join(members.select("doc_id", "sid"), "doc_id").select("sid", "text").mapInArrow(trimmed(_elements(k)), "sid long, elements binary")
    found = kept.table(_overlap.links(sets, members.select("sid", "grp", "n", "copies"), num, den, block), "found")
    roots = kept.table(components(found.where("w = 0").select(F.col("a").alias("u"), F.col("b").alias("v")), inner), "roots")
    inner.drop()
    reach = found.where("w > 0").groupBy(F.col("a").alias("sid")).agg(F.sum("w").alias("reach"))
    named = sizes.join(roots.select(F.col("node").alias("sid"), "root"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = named.join(least, "root").join(reach, "sid", "left").select("sid", "component_id", (F.coalesce("reach", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    linked = rows.drop("part").join(named, "sid", "left")
    alone = F.col("doc_id").isNull() | (F.col("n") == 0)
    return linked.select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(alone, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"),
    )


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(documents(spark, sf_dir), 3, 90, 100)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, at 5 words and 0.8: of each component only the rows with the smallest doc_id stay.

    Rows that share a doc_id stand or fall together, and of wholly repeated rows one stays.
    Rows with null doc_id and rows without words have no links and stay. Ties go to the smaller doc_id;
    other columns come along; an empty table gives no rows.
    """
    found = jaccard_join(docs, 5, 80, 100).where("component_id <> doc_id").select("doc_id").distinct()
    left = docs.join(found, "doc_id", "left_anti").select(docs.columns)
    repeated = docs.groupBy(F.xxhash64("doc_id", "text").alias("h")).count().where("count > 1").limit(1).count()
    return left.distinct() if repeated else left  # whole rows move only where some may be the same
