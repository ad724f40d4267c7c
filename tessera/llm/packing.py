"""Operator 1: best-fit packing by non-negative least squares over length patterns.

1. Texts become token ids and pieces; only the histogram of piece lengths (at most
   ``seq_len`` numbers) reaches the driver.
2. Patterns of two or three lengths that fill a sequence exactly, or of two that nearly do, are
   enumerated; repeat counts are fitted to the histogram by non-negative least squares and rounded.
3. What the rounded patterns leave over is packed best-fit decreasing, histogram-wise.
4. Pieces get their rank within their length from two-level counts (no length, however
   common, meets in one task) and take their place in the plan by that rank.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm._session import Kept, documents, prepare, trimmed
from tessera.llm._text import pieces as runs
from tessera.llm._tokens import CACHE, SMALL_CACHE, encoder, tokenizer_path

SEQ_LEN, END_ID = 1024, 2
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids binary"


#: Pattern sets that are fitted: most room a pattern of two may leave, and whether each must hold a piece over half a sequence.
FITS = ((0, False), (0, True), (6, True))


def patterns(present: np.ndarray, seq_len: int, room: int = 0) -> np.ndarray:
    """All a <= b <= c (a may be 0) of lengths present with a + b + c = seq_len, and b + c from seq_len - room."""
    there = np.zeros(seq_len + 1, dtype=bool)
    there[present] = True
    there[0] = True
    out = []
    for a in np.flatnonzero(there[: seq_len // 3 + 1]):
        b = np.arange(max(a, 1), (seq_len - a) // 2 + 1)
        b = b[there[b] & there[seq_len - a - b]]
        out.append(np.stack([np.full(len(b), a), b, seq_len - a - b], axis=1))
    for total in range(max(2, seq_len - room), seq_len):
        b = np.arange(1, total // 2 + 1)
        b = b[there[b] & there[total - b]]
        out.append(np.stack([np.zeros(len(b), np.int64), b, total - b], axis=1))
    return np.concatenate(out) if out else np.zeros((0, 3), np.int64)


def fit_repeats(columns: np.ndarray, counts: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative x with sum of x over patterns near counts of lengths: accelerated projected gradient.

    ``columns`` holds the lengths of each pattern (0: none). Lengths are weighted by their
    size, as a long piece left over costs more than a short one.
    """
    n = len(counts)
    weight = np.sqrt(np.arange(n) / n + 0.05)
    weight[0] = 0
    w = weight[columns]

    def forward(x):
        return np.bincount(columns.ravel(), (w * x[:, None]).ravel(), minlength=n)

    def back(r):
        return (w * r[columns]).sum(axis=1)

    v = np.ones(len(columns))
    for _ in range(12):
        v = back(forward(v))
        size = np.linalg.norm(v)
        v /= size
    target = weight * counts
    x = y = np.zeros(len(columns))
    t = 1.0
    for _ in range(rounds):
        nxt = np.maximum(0, y - back(forward(y) - target) / (1.05 * size))
        s = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = nxt + (t - 1) / s * (nxt - x)
        x, t = nxt, s
    return x


def best_fit(counts: np.ndarray, seq_len: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over a histogram: (lengths, repeats) of what it makes."""
    spaces: list[int] = []  # free room of open sequences, ascending
    open_: dict[int, list[list]] = {}

    def put(lengths, n):
        room = seq_len - sum(lengths)
        if room not in open_:
            bisect.insort(spaces, room)
            open_[room] = []
        open_[room].append([lengths, n])

    for length in range(seq_len, 0, -1):
        left = int(counts[length])
        while left:
            i = bisect.bisect_left(spaces, length)
            if i == len(spaces):
                fit = seq_len // length
                if left >= fit:
                    put((length,) * fit, left // fit)
                if left % fit:
                    put((length,) * (left % fit), 1)
                break
            room = spaces[i]
            lengths, n = open_[room].pop()
            use = min(left, n)
            if n > use:
                open_[room].append([lengths, n - use])
            if not open_[room]:
                del open_[room], spaces[i]
            put((*lengths, length), use)
            left -= use
    return [(tuple(lengths), n) for many in open_.values() for lengths, n in many]


def plan(counts: np.ndarray, seq_len: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence's pieces, number of such sequences); counts[l]: pieces of length l.

    The work depends on seq_len alone. Full pieces are a pattern of their own. The repeats of the other
    patterns are fitted and rounded, and what they leave over is packed best fit; this is done
    for each of FITS, and the plan with the fewest sequences is taken.
    """
    full = [((seq_len,), int(counts[seq_len]))] if counts[seq_len] else []
    plans = []
    for room, long in FITS:
        left, out = np.where(np.arange(len(counts)) < seq_len, counts, 0), []
        columns = patterns(np.flatnonzero(left), seq_len, room)
        columns = columns[columns[:, 2] > seq_len // 2] if long else columns
        x = fit_repeats(columns, left) if len(columns) else np.zeros(0)
        for i in np.argsort(-x, kind="stable"):
            n = int(x[i] + 0.5)
            if not n:
                break
            lengths = [int(v) for v in columns[i] if v]
            n = min([n, *(int(left[v]) // lengths.count(v) for v in lengths)])
            if n > 0:
                out.append((tuple(lengths), n))
                for v in lengths:
                    left[v] -= n
        plans.append(full + out + best_fit(left, seq_len))
    return min(plans, key=lambda p: sum(n for _, n in p))


def _cut(path: str, seq_len: int, end_id: int, cache: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = np.array([end_id], dtype="<u4").tobytes()
        for whole in batches:
            for batch in runs(whole):
                rows: tuple[list, ...] = ([], [], [], [], [])
                for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder(path, cache).encode(batch.column("text").to_pylist())):
                    ids += tail
                    n = len(ids) // 4
                    start, end, piece = 0, (n - 1) % seq_len + 1, 0
                    while start < n:
                        for col, v in zip(rows, (doc_id, piece, start, end - start, ids[4 * start : 4 * end])):
                            col.append(v)
                        start, end, piece = end, end + seq_len, piece + 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))], ["doc_id", "piece", "start", "length", "ids"])
        if cache <= SMALL_CACHE:
            encoder(path, cache).forget()

    return run


def cut_pieces(docs: DataFrame, path: str, seq_len: int = SEQ_LEN, end_id: int = END_ID, cache: int = CACHE) -> DataFrame:
    """Each text's ids and the end id, in pieces of seq_len, the first shorter if need be.

    Columns doc_id, piece, start, length and ids (little-endian unsigned 32-bit). Null text
    counts as empty: one piece, the end id alone.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return docs.mapInArrow(trimmed(_cut(path, seq_len, end_id, cache)), PIECE_SCHEMA)


def _place(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, low, sequence, offset = shared.value
        for batch in batches:
            rank = np.asarray(batch.column("__rank"))
            key = (np.asarray(batch.column("length")) << 44) + rank
            i = np.searchsorted(keys, key, side="right") - 1
            rest = batch.select([n for n in batch.schema.names if n != "__rank"])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(sequence[i] + rank - low[i]), pa.array(offset[i])], [*rest.schema.names, "sequence_id", "offset"])

    return run


def place(pieces: DataFrame, seq_len: int = SEQ_LEN, slot: int = 20_000) -> DataFrame:
    """Adds sequence_id and offset to rows with a ``length`` of 1 to seq_len.

    ``pieces`` is read several times and should be a written table; its other columns are
    carried along. Every sequence is filled from 0 without gaps, to seq_len at most.
    """
    spark = pieces.sparkSession
    counts = np.zeros(seq_len + 1, dtype=np.int64)
    for length, n in pieces.groupBy("length").count().collect():  # at most seq_len rows
        counts[length] = n
    rows, taken, sequences = [], np.zeros(seq_len + 1, dtype=np.int64), 0
    for lengths, n in plan(counts, seq_len):
        offset = 0
        for length in lengths:
            rows.append((length, int(taken[length]), sequences, offset))
            taken[length] += n
            offset += length
        sequences += n
    rows.sort()
    length, low, sequence, offset = (np.array(c, dtype=np.int64) for c in (zip(*rows) if rows else ((),) * 4))
    shared = spark.sparkContext.broadcast(((length << 44) + low, low, sequence, offset))
    slots = max(8, int(counts.sum()) // slot)
    dealt = pieces.withColumn("__slot", F.pmod(F.xxhash64(*pieces.columns), F.lit(slots)))
    base = dealt.groupBy("length", "__slot").count()
    base = base.withColumn("__base", F.sum("count").over(Window.partitionBy("length").orderBy("__slot")) - F.col("count")).drop("count")
    own = Window.partitionBy("__slot", "length").orderBy(*[c for c in ("doc_id", "piece") if c in pieces.columns] or ["__slot"])
    ranked = dealt.withColumn("__own", F.row_number().over(own)).join(base, ["__slot", "length"]).select(*pieces.columns, (F.col("__base") + F.col("__own") - 1).cast("long").alias("__rank"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields]
    return ranked.mapInArrow(_place(shared), ", ".join([*fields, "sequence_id long", "offset long"]))


def pack(docs: DataFrame, path: str, seq_len: int = SEQ_LEN, end_id: int = END_ID, digest: bool = False, cache: int = CACHE) -> DataFrame:
    """Packs whole texts into as few sequences of seq_len tokens as it can.

    Columns of ``cut_pieces`` plus sequence_id and offset; with ``digest`` the crc32 of a
    piece's ids (ids_crc32) in place of the ids, which then are never shuffled. Null text
    counts as empty, null doc_id stays null, repeated rows are packed once each, other
    columns are ignored, an empty table gives no rows.
    """
    spark = prepare(docs.sparkSession)
    pieces = cut_pieces(docs, path, seq_len, end_id, cache)
    if digest:
        pieces = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return place(Kept(spark).table(pieces, "pieces"), seq_len)


def sequences(packed: DataFrame) -> DataFrame:
    """The token arrays themselves: (sequence_id, ids), each at most seq_len ids long."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.aggregate(parts, F.lit(b"").cast("binary"), lambda out, p: F.concat(out, p["ids"])).alias("ids"))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), tokenizer_path(), digest=True)


def packed_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the pieces of all that is left, with their places.

    Null text is one piece with the end id alone, null doc_id stays, each of repeated rows is packed, other columns
    are left out, an empty table gives no rows.
    """
    return pack(docs, tokenizer_path(), digest=True, cache=SMALL_CACHE)
