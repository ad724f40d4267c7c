"""Operator 3: cross-entropy difference between a target and a background n-gram model.

Both models are interpolated bigram models over all words and pairs of all texts; none is
dropped and nothing is broadcast. Rows are dealt to blocks of bounded size. A block sends its
distinct words and pairs with its own counts, a compressed row for each part of the range of
their fingerprints; where they meet, a part adds them up and answers each block with the
whole table's counts in the order asked; then each block scores its rows. So a word
or pair, however common, costs a number for each block, and the models grow with the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._session import Kept, documents, partitions, prepare
from tessera.llm._text import BASE, SPACED, buffers, lower, mix, span_hashes, word_spans
from tessera.llm._text import pieces as runs

#: Bytes of a block's texts, at least and at most.
SMALLEST, LARGEST = 1 << 24, 1 << 28
#: Weight of the unigram model, as pseudo-counts of a history (Dirichlet smoothing).
MU = 50.0
#: Ids of target documents that are broadcast at most; more are joined.
MOST_IDS = 1_000_000
#: Stands before a row's first word; a word's fingerprint otherwise.
MARK = np.uint64(0)
SCORED = "doc_id long, n_tokens long, target_loss double, background_loss double, score double"


def _words(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of a batch's lower-cased words and each row's first word."""
    data, offsets = buffers(batch.column("text"))
    data = lower(data)
    starts, ends, first = word_spans(data, offsets, SPACED)
    return span_hashes(data, starts, ends), first


def _follows(first: np.ndarray) -> np.ndarray:
    """For each word: 1 where another of its row comes next."""
    out = np.ones(first[-1], np.int64)
    out[first[1:][np.diff(first) > 0] - 1] = 0
    return out


def _weights(batch: pa.RecordBatch, first: np.ndarray) -> np.ndarray:
    return np.repeat(np.asarray(batch.column("target").cast(pa.int64())), np.diff(first))


class _Sums:
    """Counts by key, kept small by merging: what a task sends is one row for each of its keys."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def add(self, keys: np.ndarray, *weights: np.ndarray) -> None:
        keys, at = np.unique(keys, return_inverse=True)
        self.parts.append((keys, *(np.bincount(at, w, len(keys)).astype(np.int64) for w in weights)))
        self.held += len(keys)

    def merge(self) -> None:
        if len(self.parts) > 1:
            cols = [np.concatenate(c) for c in zip(*self.parts)]
            self.parts, self.held = [], 0
            self.add(*cols)

    def rows(self) -> Iterator[pa.RecordBatch]:
        self.merge()
        for keys, *sums in self.parts:
            for i in range(0, len(keys), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 100_000]) for x in (keys.view(np.int64), *sums)], ["key", *COUNTS])
        self.parts, self.held = [], 0


#: Occurrences in the background and in the target.
COUNTS = ["n", "t"]
#: Distinct keys a counting task holds before it sends them on.
HELD = 2_000_000


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums = _Sums()
    for whole in batches:
        for batch in runs(whole):
            hashes, first = _words(batch)
            t = _weights(batch, first)
            sums.add(hashes, np.ones_like(t), t)
            if sums.held > HELD:
                sums.merge()
                if sums.held > HELD // 2:
                    yield from sums.rows()
    yield from sums.rows()


def _ids(hashes: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    """1-based places in the sorted vocabulary, 0 for rare words."""
    if not len(vocabulary):
        return np.zeros(len(hashes), np.int64)
    at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
    return np.where(vocabulary[at] == hashes, at + 1, 0)


def _pairs(hashes: np.ndarray, first: np.ndarray, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word ids and, for each word, its pair (word before, word); a row's first word follows a mark."""
    w = _ids(hashes, vocabulary)
    before = np.empty_like(w)
    before[1:] = w[:-1]
    before[first[:-1][np.diff(first) > 0]] = len(vocabulary) + 1
    return w, before * (len(vocabulary) + 2) + w


def _count_pairs(shared):
    """Pairs with words outside the vocabulary count too, as pairs of one class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums()
        for whole in batches:
            for batch in runs(whole):
                hashes, first = _words(batch)
                w, pairs = _pairs(hashes, first, shared.value)
                t = _weights(batch, first)
                sums.add(pairs, np.ones_like(t), t)
                if sums.held > HELD:
                    sums.merge()
                    if sums.held > HELD // 2:
                        yield from sums.rows()
        yield from sums.rows()

    return run


class Model:
    """P(w | v) = (c(v, w) + mu P(w)) / (c(v) + mu) with P(w) = (c(w) + 1) / (N + V + 1)."""

    def __init__(self, words: np.ndarray, total: int, pairs: np.ndarray, counts: np.ndarray):
        """words: counts by id, the rare class at 0; pairs: ascending keys."""
        v = len(words) - 1
        self.unigram = (words + 1.0) / (total + v + 1.0)
        self.pairs, self.counts = pairs, counts.astype(np.float64)
        self.history = np.bincount(pairs // (v + 2), self.counts, v + 2)
        self.v = v

    def loss(self, w: np.ndarray, pairs: np.ndarray) -> np.ndarray:
        """-log P of each word after the one before it."""
        c = np.zeros(len(w))
        if len(self.pairs):
            at = np.minimum(np.searchsorted(self.pairs, pairs), len(self.pairs) - 1)
            c = np.where(self.pairs[at] == pairs, self.counts[at], 0.0)
        return -np.log((c + MU * self.unigram[w]) / (self.history[pairs // (self.v + 2)] + MU))


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, target, background = shared.value
        for whole in batches:
            for batch in runs(whole):
                hashes, first = _words(batch)
                w, pairs = _pairs(hashes, first, vocabulary)
                n = np.diff(first)
                sums = [np.diff(np.concatenate([[0.0], np.cumsum(m.loss(w, pairs))])[first]) for m in (target, background)]
                means = [np.where(n > 0, s / np.maximum(n, 1), np.nan) for s in sums]
                cols = [batch.column("doc_id"), pa.array(n), *(pa.array(x, mask=n == 0) for x in (*means, means[0] - means[1]))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "target_loss", "background_loss", "score"])

    return run


def _pack(*columns: np.ndarray) -> bytes:
    """64-bit columns, byte planes apart, compressed: small numbers and differences take little room."""
    planes = b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(-1, 8).T).tobytes() for c in columns)
    return pa.compress(planes, codec="zstd", asbytes=True)


def _unpack(packed: bytes, rows: int, columns: int) -> list[np.ndarray]:
    """The columns of ``_pack``, as signed numbers."""
    planes = np.frombuffer(pa.decompress(packed, rows * columns * 8, codec="zstd", asbytes=True), np.uint8).reshape(columns, 8, rows)
    return [np.ascontiguousarray(c.T).reshape(-1).view(np.int64) for c in planes]


def _summed(keys: np.ndarray, *weights: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, and the sums of each weight."""
    order = np.argsort(keys)
    sorted_ = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = sorted_[1:] != sorted_[:-1]
    first = np.flatnonzero(new)
    return sorted_[first], *(np.add.reduceat(w[order], first) for w in weights)


class _Block:
    """The words of a block's rows: rows come one batch after the other, keys are asked for at the end."""

    def __init__(self):
        self.hashes: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.targets: list[np.ndarray] = []
        self.ids: list[pa.Array] = []

    def add(self, batch: pa.RecordBatch) -> None:
        for piece in runs(batch):
            hashes, first = _words(piece)
            self.hashes.append(hashes)
            self.counts.append(np.diff(first))
            self.targets.append(np.asarray(piece.column("target").cast(pa.int64()).fill_null(0)))
            self.ids.append(piece.column("doc_id"))

    def close(self) -> None:
        self.n = np.concatenate(self.counts)
        self.first = np.concatenate([[0], np.cumsum(self.n)])
        self.words = np.concatenate(self.hashes)
        self.starts = self.first[:-1][self.n > 0]
        self.before = np.empty_like(self.words)
        self.before[1:] = self.words[:-1]
        self.before[self.starts] = MARK
        self.pairs = mix(mix(self.before * BASE) + self.words)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple], _Block]]:
    """From rows in order of block: (block, its answers, its texts)."""
    block, answers, texts = None, [], _Block()
    for whole in batches:
        ids = np.asarray(whole.column("block"))
        for a, b in zip(*(lambda cut: (cut[:-1], cut[1:]))([0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), len(ids)] if len(ids) else [0])):
            if ids[a] != block and block is not None:
                yield block, answers, texts
                answers, texts = [], _Block()
            block, rows = int(ids[a]), whole.slice(a, b - a)
            kind = np.asarray(rows.column("kind"))
            asked = int(np.searchsorted(kind, 1))
            answers += zip(*(rows.column(c).slice(0, asked).to_pylist() for c in ANSWER))
            if asked < len(rows):
                texts.add(rows.slice(asked))
    if block is not None:
        yield block, answers, texts


#: A row from or to a block about the keys of one part of their range: words and pairs apart.
ANSWER = ["n_words", "words", "n_pairs", "pairs"]
ASKED = ["block", "part", *ANSWER]


def _ask(parts: int):
    """Each block's distinct words and pairs with its own counts, one row for each part of the range of keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, texts in _blocks(batches):
            texts.close()
            if not len(texts.words):
                continue
            t = np.repeat(np.concatenate(texts.targets), texts.n)
            one, follows = np.ones_like(t), _follows(texts.first)
            rows = t[texts.starts]
            words = _summed(np.concatenate([texts.words, np.full(len(rows), MARK)]), *map(np.concatenate, ((one, np.ones_like(rows)), (t, rows), (1 - follows, 0 * rows), ((1 - follows) * t, 0 * rows))))
            pairs = _summed(texts.pairs, one, t)
            borders = np.array([p * (2**64 // parts) for p in range(1, parts)], np.uint64)
            cuts = [np.concatenate([[0], np.searchsorted(c[0], borders), [len(c[0])]]) for c in (words, pairs)]
            for part in range(parts):
                row = [block, part]
                for columns, cut in zip((words, pairs), cuts):
                    keys, *counts = (c[cut[part] : cut[part + 1]] for c in columns)
                    row += [len(keys), _pack(np.diff(keys, prepend=np.uint64(0)), *counts)]
                if row[2] or row[4]:
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.binary()))], ASKED)

    return run


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From ``_ask``'s rows in order of part: to each the whole table's counts of its keys, and each part's totals once."""

    def out(rows):
        columns, totals = [], None
        for at, width in ((2, 5), (4, 3)):
            asked = [_unpack(r[at + 1], r[at], width) for r in rows]
            keys = np.concatenate([np.cumsum(a[0].view(np.uint64), dtype=np.uint64) for a in asked])
            distinct, *sums = _summed(keys, *(np.concatenate(c) for c in list(zip(*asked))[1:])) if len(keys) else (keys,)
            if totals is None:
                word = distinct != MARK
                totals = [int(s[word].sum()) for s in sums[:2]] + [int(word.sum())] if sums else [0, 0, 0]
            place, answers = np.searchsorted(distinct, keys), []
            for a in asked:
                m, place = place[: len(a[0])], place[len(a[0]) :]
                answers.append(_pack(*(s[m] for s in sums)) if sums else b"")
            columns.append(answers)
        for i, r in enumerate(rows):
            values = [r[0], r[1], r[2], columns[0][i], r[4], columns[1][i], *(totals if i == 0 else (0, 0, 0))]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.binary(), *[pa.int64()] * 3))], [*ASKED, "total", "total_t", "distinct"])

    part, held = None, []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ASKED)):
            if row[1] != part and held:
                yield from out(held)
                held = []
            part = row[1]
            held.append(row)
    if held:
        yield from out(held)


def _losses(total: int, total_t: int, distinct: int):
    """From texts and answers in order of block: each row's mean losses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, answers, texts in _blocks(batches):
            texts.close()
            n, sums = texts.n, []
            if len(texts.words):
                keys, w = np.unique(np.concatenate([[MARK], texts.words]), return_inverse=True)
                pairs, p = np.unique(texts.pairs, return_inverse=True)
                counts = [list(map(np.concatenate, zip(*(_unpack(a[at + 1], a[at], width) for a in answers if a[at])))) for at, width in ((0, 4), (2, 2))]
                if len(counts[0][0]) != len(keys) or len(counts[1][0]) != len(pairs):
                    raise RuntimeError("a block's texts are not those that its words were counted of")
                w, mark = w[1:], w[0]
                before = np.empty_like(w)
                before[1:] = w[:-1]
                before[texts.starts] = mark
                for own, size in ((1, total_t), (0, total)):
                    unigram = (counts[0][own] + 1.0) / (size + distinct + 1.0)
                    history = np.log(counts[0][own] - counts[0][own + 2] + MU)
                    each = history[before] - np.log(counts[1][own][p] + MU * unigram[w])
                    sums.append(np.diff(np.concatenate([[0.0], np.cumsum(each)])[texts.first]))
            else:
                sums = [np.zeros(len(n))] * 2
            means = [np.where(n > 0, s / np.maximum(n, 1), np.nan) for s in sums]
            cols = [pa.concat_arrays(texts.ids), pa.array(n), *(pa.array(x, mask=n == 0) for x in (*means, means[0] - means[1]))]
            for i in range(0, len(n), 10_000):
                yield pa.RecordBatch.from_arrays([c.slice(i, 10_000) for c in cols], ["doc_id", "n_tokens", "target_loss", "background_loss", "score"])

    return run


def blocks(n_bytes: int) -> int:
    """How many blocks texts of so many bytes make: 16 MB each up to a GB, then growing by the square root up to 256 MB."""
    return max(1, -(-n_bytes // int(min(LARGEST, max(SMALLEST, (n_bytes * (1 << 18)) ** 0.5)))))


def _cut(texts: DataFrame, marked: DataFrame, kept: Kept, vocabulary: int, pairs: int) -> DataFrame:
    """Scores by models of frequent words and pairs alone, which are broadcast."""
    sc = texts.sparkSession.sparkContext
    sums = lambda f, cols: marked.mapInArrow(f, ", ".join(f"{c} long" for c in ("key", *cols))).groupBy("key").agg(*(F.sum(c).alias(c) for c in cols))
    words = kept.table(sums(_count_words, COUNTS), "words")
    total, total_t = (int(x or 0) for x in words.agg(F.sum("n"), F.sum("t")).first())
    frequent = words.where(F.col("n") * vocabulary >= total).orderBy("key").toArrow()  # at most that many rows
    frequent = {c: frequent.column(c).to_numpy() for c in ("key", *COUNTS)}
    order = np.argsort(frequent["key"].view(np.uint64))
    frequent = {c: x[order] for c, x in frequent.items()}
    vocab = frequent["key"].view(np.uint64)
    found = kept.table(sums(_count_pairs(sc.broadcast(vocab)), COUNTS), "pairs")
    own = found.where((F.col("n") * pairs >= total) | ((F.col("t") * pairs >= total_t) & (F.col("t") > 0))).orderBy("key").toArrow()  # at most twice that many rows
    own = {c: own.column(c).to_numpy() for c in ("key", *COUNTS)}
    bag = lambda c, n: np.concatenate([[n - frequent[c].sum()], frequent[c]]).astype(np.float64)
    model = lambda c, n: Model(bag(c, n), n, own["key"], own[c])
    return texts.mapInArrow(_score(sc.broadcast((vocab, model("t", total_t), model("n", total)))), SCORED)


def cross_entropy_difference(docs: DataFrame, target_ids: DataFrame, vocabulary: int | None = None, pairs: int | None = None) -> DataFrame:
    """Scores each row by mean loss under the target model less that under the background model.

    ``target_ids`` (doc_id) names the target documents; the background is every document.
    Returns doc_id, n_tokens, target_loss, background_loss (nats a word) and score: the lower,
    the more like the target. A row without words (null or empty text) has 0 tokens and null losses. Null doc_id is
    scored and never target; repeated rows count each; other columns are ignored; without target documents the
    target model is uniform; an empty table gives no rows.

    Every word and pair counts, by 64-bit fingerprint. Only where ``vocabulary`` and ``pairs`` are given (both), the
    models are cut to words and pairs of at least such a share (1 / vocabulary, 1 / pairs), and all else is one class.
    A text of any length is one row of one block. Wholly repeated rows meet in one block.
    """
    spark = prepare(docs.sparkSession)
    kept = Kept(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ids = target_ids.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(True).alias("target")).where("doc_id is not null").distinct()
    ids = kept.table(ids, "target")
    marked = texts.join(F.broadcast(ids) if ids.count() <= MOST_IDS else ids, "doc_id", "left").withColumn("target", F.coalesce("target", F.lit(False)))
    if vocabulary and pairs:
        return _cut(texts, marked, kept, vocabulary, pairs)
    n = blocks(texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).alias("block")
    no_answer = [F.lit(None).cast(t).alias(c) for c, t in zip(ANSWER, ("int", "binary", "int", "binary"))]
    width = max(n, partitions(spark))
    dealt = marked.select(block, F.lit(1).alias("kind"), "doc_id", "text", "target", *no_answer).repartition(width, "block").sortWithinPartitions("block")
    asked = dealt.mapInArrow(_ask(n), "block long, part int, n_words int, words binary, n_pairs int, pairs binary")
    met = asked.repartition(width, "part").sortWithinPartitions("part").mapInArrow(_answer, "block long, part int, n_words int, words binary, n_pairs int, pairs binary, total long, total_t long, distinct long")
    answers = kept.table(met, "answers")
    totals = [int(x or 0) for x in answers.agg(F.sum("total"), F.sum("total_t"), F.sum("distinct")).first()]
    rows = texts.select(block, F.lit(1).alias("kind"), F.lit(0).alias("part"), "doc_id", "text", F.lit(False).alias("target"), *no_answer)
    both = rows.union(answers.select("block", F.lit(0), "part", F.lit(None), F.lit(None), F.lit(None), *ANSWER)).repartition(width, "block").sortWithinPartitions("block", "kind", "part")
    return both.mapInArrow(_losses(*totals), SCORED)


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: documents labelled of good quality and not toxic."""
    labels = prepare(spark).read.parquet(f"{sf_dir}/labels.parquet")
    return cross_entropy_difference(documents(spark, sf_dir), labels.where("quality = 1 and toxic = 0").select("doc_id"))
