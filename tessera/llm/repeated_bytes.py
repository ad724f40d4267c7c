"""Operator 7: exact removal of repeated strings by distributed prefix doubling.

Ranks are names: two positions have one rank at a length when the strings of that length
that start there are equal. Names are fingerprints of the strings themselves, which a prefix sum
over the text gives at every offset and length, in place of pairs of ranks; Spark groups positions by
them. As in prefix doubling, lengths grow, positions whose rank is unique drop out, and the rest is
ranked anew until the threshold; unlike it, no position's rank is sorted beside another's.

To do this without a row for each byte, positions are kept in runs:

1. Each window of ``length`` bytes has one anchor: the least of its grams of GRAM bytes. All windows
   with one anchor are one run. Equal windows have equal anchors, so a run whose anchor's rank is
   unique (length GRAM) holds nothing repeated.
2. A run whose whole stretch of text, from its first window to its last, occurs elsewhere is repeated
   throughout. Of each such class one member stays as a partner for others.
3. The rest is cut into shorter runs. What all windows of a run have in common grows towards
   ``length`` as runs get shorter: if it is unique, the run drops out; if the whole stretch is
   repeated, all of it is; else it is cut again, down to single windows, whose test is exact.

Equal texts are one text that is repeated throughout. Texts lie in a table bucketed by their key, so
no round moves them again.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._session import Kept, documents, new_path, partitions, prepare
from tessera.llm._text import BYTE_SYMBOLS, mix, prefix_sums
from tessera.llm._text import pieces as runs

LENGTH, GRAM = 400, 64
_U = np.uint64
#: Bytes looked at together; positions inside fit in 20 bits.
SPAN = 1 << 20
_PLACE = _U(SPAN - 1)


def least_in_windows(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of x[p : p + w] for each p, by doubling."""
    m, have = x, 1
    while 2 * have <= w:
        m = np.minimum(m[: len(m) - have], m[have:])
        have *= 2
    return np.minimum(m[: len(m) - (w - have)], m[w - have :]) if w > have else m


def stretch_hashes(data: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Fingerprints of data[low : high] for many overlapping stretches."""
    sums, inverse = prefix_sums(BYTE_SYMBOLS[data])
    return mix((sums[high] - sums[low]) * inverse[low] + (high - low).astype(np.uint64) * _U(0xD6E8FEB86659FD93))


def anchor_runs(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: (row, anchor, least offset, greatest offset, gram's rank).

    A window that starts at p has offset anchor - p. At most SPAN bytes.
    """
    w = length - gram + 1
    sizes = np.diff(offsets)
    if len(data) < length or not (sizes >= length).any():
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),)
    at = np.arange(len(data) - gram + 1)
    ranks = stretch_hashes(data, at, at + gram)
    anchor = (least_in_windows(ranks & ~_PLACE | at.astype(np.uint64), w) & _PLACE).astype(np.int64)
    p = np.arange(len(anchor))
    row = np.searchsorted(offsets, p, side="right") - 1
    good = np.flatnonzero(p + length <= offsets[row + 1])
    anchor, row = anchor[good], row[good]
    new = np.ones(len(good), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(good)) - 1
    a, r = anchor[first], row[first]
    return r, a - offsets[r], a - good[last], a - good[first], ranks[a]


def _bytes_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    from tessera.llm._text import buffers

    return buffers(batch.column("text"))


def _anchors(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(tid, n, a, o1, o2, rank):
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (tid, n, a, o1.astype(np.int32), o2.astype(np.int32), rank.view(np.int64))], ["tid", "n", "a", "o1", "o2", "rank"])

        for whole in batches:
            for batch in runs(whole, SPAN):
                data, offsets = _bytes_of(batch)
                tid, n = np.asarray(batch.column("tid")), np.asarray(batch.column("n"))
                if len(data) <= SPAN:
                    r, *rest = anchor_runs(data, offsets, length, gram)
                    yield out(tid[r], n[r], *rest)
                else:  # one long text, in spans that overlap by a window less one byte
                    for i in range(0, max(1, len(data) - length + 1), SPAN - length + 1):
                        part = data[i : i + SPAN]
                        r, a, *rest = anchor_runs(part, np.array([0, len(part)]), length, gram)
                        yield out(tid[r], n[r], a + i, *rest)

    return run


def _ranks(length: int, width: int):
    """For each text and its runs: cuts the runs to ``width`` offsets (0: as they are) and ranks both stretches.

    inner: what all windows of the (whole) cut have in common; outer: all that the windows there are cover.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in runs(whole, SPAN):
                data, offsets = _bytes_of(batch)
                found: list[list[np.ndarray]] = []
                at = batch.column("runs")
                ends = np.asarray(at.offsets) if len(at) else np.zeros(1, np.int64)
                fields = {c: np.asarray(at.values.field(c)) for c in ("a", "o1", "o2", "partner")}
                for k, (tid, n) in enumerate(zip(batch.column("tid").to_pylist(), batch.column("n").to_pylist())):
                    a, o1, o2, partner = (fields[c][ends[k] : ends[k + 1]].astype(np.int64) for c in ("a", "o1", "o2", "partner"))
                    text = data[offsets[k] : offsets[k + 1]]
                    if width:
                        cut = o2 // width - o1 // width + 1
                        which = np.repeat(np.arange(len(a)), cut)
                        b = (o1 // width)[which] + np.arange(len(which)) - np.repeat(np.cumsum(cut) - cut, cut)
                        a, partner = a[which], partner[which]
                        low, high = b * width, b * width + width - 1
                        o1, o2 = np.maximum(low, o1[which]), np.minimum(high, o2[which])
                        high = np.minimum(high, length - GRAM)
                        inner = stretch_hashes(text, a - low, a - high + length) ^ mix(b.astype(np.uint64))
                    else:
                        inner = np.zeros(len(a), np.uint64)
                    outer = stretch_hashes(text, a - o2, a - o1 + length) ^ mix((o1 * 65536 + o2).astype(np.uint64))
                    m = len(a)
                    found.append([np.full(m, tid), np.full(m, n), a, o1.astype(np.int32), o2.astype(np.int32), partner.astype(bool), inner.view(np.int64), outer.view(np.int64)])
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], ["tid", "n", "a", "o1", "o2", "partner", "inner", "outer"])

    return run


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Removes each text's stretches (low, high, any order, overlapping)."""
    for whole in batches:
        for batch in runs(whole, SPAN):
            rows: tuple[list, ...] = ([], [], [], [], [])
            data, offsets = _bytes_of(batch)
            for k, (tid, n, stretches) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("tid", "n", "stretches")))):
                text = data[offsets[k] : offsets[k + 1]].tobytes()
                left, spans, upto, begin = [], 0, 0, None
                for s in sorted((s["low"], s["high"]) for s in stretches):
                    if begin is None or s[0] > upto:
                        spans += 1
                        left.append(text[upto : s[0]])
                        begin, upto = s
                    else:
                        upto = max(upto, s[1])
                left = b"".join([*left, text[upto:]])
                for c, v in zip(rows, (tid, n, len(text) - len(left), spans, left)):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["tid", "n", "n_removed", "n_spans", "left"])


class Repeats:
    """Finds and removes the repeated strings of some documents' texts."""

    def __init__(self, docs: DataFrame, length: int = LENGTH, gram: int = GRAM):
        self.spark = prepare(docs.sparkSession)
        self.length, self.gram = length, gram
        self.kept, self.rounds = Kept(self.spark), Kept(self.spark)
        text = F.coalesce(F.col("text").cast("string"), F.lit(""))
        keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).select("doc_id", "text", F.xxhash64("text").alias("tid"), F.octet_length("text").cast("long").alias("n"))
        self.rows = self.kept.table(keyed.select("doc_id", "tid", "n", F.sha2("text", 256).alias("sha"), F.xxhash64("doc_id", "text").alias("rid")), "rows")
        long = self.rows.where(F.col("n") >= length).groupBy("tid", "n").agg(F.count("*").alias("copies"), F.min("rid").alias("rid"))
        self.classes = self.kept.table(long, "classes")
        one = keyed.withColumn("rid", F.xxhash64("doc_id", "text")).join(self.classes.select("tid", "n", "rid"), ["tid", "n", "rid"], "left_semi")
        if self.rows.groupBy("rid").count().where("count > 1").limit(1).count():  # wholly repeated rows
            one = one.dropDuplicates(["tid", "n"])
        self.buckets = partitions(self.spark)
        self.table = f"texts_{uuid.uuid4().hex}"
        path = new_path(self.spark, "texts")
        (one.select("tid", "n", "text").repartition(self.buckets, "tid", "n").write.bucketBy(self.buckets, "tid", "n").sortBy("tid", "n").option("compression", "zstd").option("path", path).saveAsTable(self.table))

    def texts(self) -> DataFrame:
        return self.spark.table(self.table)

    def _with_texts(self, per_text: DataFrame) -> DataFrame:
        return self.texts().join(per_text.hint("shuffle_hash"), ["tid", "n"])

    def stretches(self) -> DataFrame:
        """(tid, n, low, high): stretches whose windows are all repeated; together they cover all that is."""
        anchors = self.rounds.table(self.texts().mapInArrow(_anchors(self.length, self.gram), "tid long, n long, a long, o1 int, o2 int, rank long"), "anchors")
        twice = self.rounds.table(anchors.groupBy("rank").count().where("count > 1").select("rank"), "twice")  # a table, so that a join may split its hot ranks
        copied = self.classes.select("tid", "n", (F.col("copies") > 1).alias("partner"))
        live = anchors.join(twice, "rank", "left_semi").join(copied, ["tid", "n"]).select("tid", "n", "a", "o1", "o2", "partner")
        live = self.rounds.table(live, "runs")
        done, width = [], 0
        for width in (0, 48, 6, 1):
            per_text = live.groupBy("tid", "n").agg(F.collect_list(F.struct("a", "o1", "o2", "partner")).alias("runs"))
            ranked = self._with_texts(per_text).select("tid", "n", "text", "runs").mapInArrow(_ranks(self.length, width), "tid long, n long, a long, o1 int, o2 int, partner boolean, inner long, outer long")
            ranked = self.rounds.table(ranked, "ranked")
            if width:  # nothing repeated where what all windows share is unique
                twice = self.rounds.table(ranked.groupBy("inner").count().where("count > 1").select("inner"), "twice")
                ranked = ranked.join(twice, "inner", "left_semi") if width > 1 else ranked
            outer = self.rounds.table(ranked.groupBy("outer").agg(F.count("*").alias("members"), F.min(F.struct("tid", "n", "a")).alias("first")), "outer")
            named = ranked.join(outer, "outer")
            repeated = F.col("members") > 1
            done.append(self.kept.table(named.where(repeated & ~F.col("partner")).select("tid", "n", (F.col("a") - F.col("o2")).alias("low"), (F.col("a") - F.col("o1") + self.length).alias("high")), "stretches"))
            if width == 1:
                break
            is_first = (F.col("first.tid") == F.col("tid")) & (F.col("first.n") == F.col("n")) & (F.col("first.a") == F.col("a"))
            live = self.rounds.table(named.where(~repeated | is_first).select("tid", "n", "a", "o1", "o2", (repeated | F.col("partner")).alias("partner")), "runs")
            self.rounds.drop(keep=1)
        self.rounds.drop()
        out = done[0]
        for d in done[1:]:
            out = out.union(d)
        return out

    def cleaned(self) -> DataFrame:
        """(tid, n, n_removed, n_spans, left): distinct texts of which something is removed, and the bytes left."""
        per_text = self.stretches().groupBy("tid", "n").agg(F.collect_list(F.struct("low", "high")).alias("stretches"))
        return self._with_texts(per_text).select("tid", "n", "text", "stretches").mapInArrow(_cut_out, "tid long, n long, n_removed long, n_spans long, left binary")

    def close(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Removes every byte that a ``length``-byte string covers which also starts anywhere else.

    One row per input row: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 (of
    the bytes left). Strings lie within one text, are judged on the input, and may overlap. Null
    text counts as empty. Texts shorter than ``length`` stay whole; equal texts at least as long are removed wholly,
    repeated rows included. Null doc_id stays; other columns are ignored; an empty table gives no
    rows. Distinct texts are told apart by a 64-bit fingerprint and their size, strings by 64 bits.
    """
    r = Repeats(docs, length, gram)
    digests = r.kept.table(r.cleaned().select("tid", "n", "n_removed", "n_spans", F.sha2("left", 256).alias("left_sha")), "digests")
    r.close()
    nothing = hashlib.sha256(b"").hexdigest()
    copied = r.classes.where("copies > 1").select("tid", "n", F.col("n").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(nothing).alias("left_sha"))
    rows = r.rows.join(digests.union(copied), ["tid", "n"], "left")
    return rows.select(
        "doc_id", F.col("n").alias("n_bytes"), F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans"), F.coalesce("left_sha", "sha").alias("kept_sha256"),
    )


def op7_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir))
