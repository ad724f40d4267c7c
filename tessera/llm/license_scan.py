"""Operator 5: license scans by diagonal voting.

All rolling word k-gram hashes of all texts are joined to the positions of the templates'
k-grams (a fixed table, broadcast). A hit votes for its diagonal, text position less
template position. A phrase stands where one diagonal has a vote from each of the phrase's
k-grams; a longer notice where neighbouring diagonals (words put in or left out shift
them) together cover enough of the template. Such a run of diagonals is only a candidate: its
words are aligned with the template, which cuts out each span where the notice stands, and of
templates that claim one span the best stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm._session import Kept, documents, prepare
from tessera.llm._text import ALNUM, buffers, chain, lower, span_hashes, word_spans
from tessera.llm._text import pieces as runs

K = 3
#: Diagonals no further apart than this are one match of a notice.
GAP = 8
#: Share of a notice's k-grams that its span must hold.
COVER = 0.6

#: Words that make another license of a notice: one that is put in or left out is no small change.
QUALIFIERS = frozenset("sharealike alike noncommercial commercial noderivatives noderivs derivatives derivs nc nd sa lesser library affero".split())
#: Alignment: a word that matches, one replaced or left out, one put in.
MATCH, MISS, EXTRA = 2.0, -1.0, -0.25
#: Candidates (rows) that are broadcast at most; more are joined.
MOST_CANDIDATES = 100_000

#: Phrases with their labels (exact), from the contract.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

#: Opening words of public license texts and of usual notices, with SPDX-like labels.
NOTICES = (
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("this work is licensed under the gnu general public license version 2", "gpl-2"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache-2"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("this work is licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa"),
    ("all rights reserved no part of this publication may be reproduced", "all-rights-reserved"),
)


def _grams(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, position, hash) of every k-gram, and per row its number of words."""
    data, offsets = buffers(texts)
    data = lower(data)
    starts, ends, first = word_spans(data, offsets, ALNUM)
    hashes = chain(span_hashes(data, starts, ends), k)
    at = np.arange(len(hashes))
    row = np.searchsorted(first, at, side="right") - 1
    inside = at + k <= first[row + 1] if len(at) else np.zeros(0, bool)
    return np.stack([row[inside], at[inside] - first[row[inside]], hashes[inside].view(np.int64)], axis=1), np.diff(first), row


def template_table(spark: SparkSession, phrases=PHRASES, notices=NOTICES, k: int = K) -> DataFrame:
    """(gram, tpos, template, label, size, exact): one row for each template position."""
    rows = []
    for n, (text, label) in enumerate((*phrases, *notices)):
        grams = _grams(pa.array([text]), k)[0]
        if not len(grams):
            raise ValueError(f"a template needs {k} words: {text}")
        rows += [(int(g), int(p), n, label, len(grams), n < len(phrases)) for _, p, g in grams]
    return spark.createDataFrame(rows, "gram long, tpos int, template int, label string, size int, exact boolean")


def _all_grams(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every k-gram of every row; for each row also its number of words, at position -1."""
        for whole in batches:
            for batch in runs(whole, 1 << 21):
                grams, words, _ = _grams(batch.column("text"), k)
                rid = np.asarray(batch.column("rid"))
                ids = batch.column("doc_id")
                yield pa.RecordBatch.from_arrays([pa.array(rid), ids, pa.array(np.full(len(rid), -1, np.int64)), pa.array(words)], ["rid", "doc_id", "pos", "gram"])
                for i in range(0, len(grams), 200_000):
                    part = grams[i : i + 200_000]
                    yield pa.RecordBatch.from_arrays([pa.array(rid[part[:, 0]]), pa.nulls(len(part), pa.int64()), pa.array(part[:, 1]), pa.array(part[:, 2])], ["rid", "doc_id", "pos", "gram"])

    return run


def _needed(words: list[str], label: str) -> list[int]:
    """Places of the words that tell a template from its like: qualifiers, and the version that the label names."""
    version = label.rsplit("-", 1)[-1]
    return [i for i, w in enumerate(words) if w in QUALIFIERS or (version.isdigit() and w == version)]


def align(words: list[str], template: list[str]) -> Iterator[tuple[float, int, list[int]]]:
    """Best alignments of the whole template inside ``words`` that don't overlap, best first.

    Yields score, the first word's place, and for each template word the place of its equal (-1: none).
    """
    m = len(template)
    up = [(MISS * i, 0) for i in range(m + 1)]
    ends, moves = [], []
    for j, w in enumerate(words):
        row, move = [(0.0, j + 1)], [0]
        for i, t in enumerate(template, 1):
            best, how = (up[i - 1][0] + (MATCH if w == t else MISS), up[i - 1][1] if i > 1 else j), 1
            if up[i][0] + EXTRA > best[0]:
                best, how = (up[i][0] + EXTRA, up[i][1]), 2
            if row[i - 1][0] + MISS > best[0]:
                best, how = (row[i - 1][0] + MISS, row[i - 1][1]), 3
            row.append(best)
            move.append(how)
        up = row
        moves.append(move)
        ends.append((-row[m][0], j, row[m][1]))
    used = np.zeros(len(words) + 1, bool)
    for score, j, start in sorted(ends):
        if score >= 0:
            break
        if used[min(start, j) : j + 1].any():
            continue
        used[min(start, j) : j + 1] = True
        i, x, at = m, j, [-1] * m
        while i and x >= 0:
            how = moves[x][i]
            if how == 1 and words[x] == template[i - 1]:
                at[i - 1] = x
            i, x = i - (how != 2), x - (how != 3)
        yield -score, start, at


def verify(words: list[str], candidates: list[tuple[int, int, int]], templates: list[tuple[list[str], str]], k: int, cover: float) -> list[tuple[str, int, int, float]]:
    """(label, first word, last k-gram's start, cover) of the notices that stand where candidates (template, low, high) say."""
    found = []
    for n, low, high in candidates:
        template, label = templates[n]
        m, skip = len(template), max(0, low - len(template))
        for score, _, at in align(words[skip : high + k + m], template):
            share = sum(all(at[i + x] == at[i] + x >= x for x in range(k)) and at[i] >= 0 for i in range(m - k + 1)) / (m - k + 1)
            if share < cover or any(at[i] < 0 for i in _needed(template, label)):
                continue
            places = [x + skip for x in at if x >= 0]
            others = set(range(places[0], places[-1] + 1)).difference(places)
            if not any(words[x] in QUALIFIERS for x in others):
                found.append((score / m, score, places[0], places[-1], label, share))
    kept: list[tuple] = []
    for f in sorted(set(found), key=lambda f: (-f[1], -f[0], f[2], f[4])):
        both = [(min(f[3], g[3]) - max(f[2], g[2]) + 1) / (min(f[3] - f[2], g[3] - g[2]) + 1) for g in kept]
        if all(x <= 0.5 for x in both):
            kept.append(f)
    return [(label, a, b - k + 1, share) for _, _, a, b, label, share in kept]


def _verify(templates: list[tuple[list[str], str]], k: int, cover: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in runs(whole, 1 << 21):
                data, offsets = buffers(batch.column("text"))
                data = lower(data)
                starts, ends, first = word_spans(data, offsets, ALNUM)
                raw, out = data.tobytes(), []
                for i, (rid, found) in enumerate(zip(batch.column("rid").to_pylist(), batch.column("found").to_pylist())):
                    words = [raw[a:b].decode() for a, b in zip(starts[first[i] : first[i + 1]], ends[first[i] : first[i + 1]])]
                    out += [(rid, *f) for f in verify(words, [(c["template"], c["first_word"], c["last_word"]) for c in found], templates, k, cover)]
                cols = list(zip(*out)) or [()] * 5
                types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["rid", "label", "first_word", "last_word", "cover"])

    return run


def scan(docs: DataFrame, phrases=PHRASES, notices=NOTICES, k: int = K, gap: int = GAP, cover: float = COVER) -> tuple[DataFrame, DataFrame]:
    """(rows, spans). rows: rid, doc_id, n_words, one for each input row. spans: rid, label, exact,
    first_word, last_word (its last k-gram's start), cover (0 to 1), verified.
    A notice's votes stand as spans too, not verified; verified are those cut out by alignment.

    rid is a 64-bit name of (doc_id, text); repeated rows share it. Null text has no words.
    """
    spark = prepare(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.select(F.xxhash64("doc_id", "text").alias("rid"), "doc_id", "text")
    grams = texts.mapInArrow(_all_grams(k), "rid long, doc_id long, pos long, gram long")
    templates = F.broadcast(template_table(spark, phrases, notices, k))
    hits = Kept(spark).table(grams.join(templates, (grams.gram == templates.gram) & (grams.pos >= 0), "left").drop(templates.gram).where("template is not null or pos = -1"), "hits")
    rows = hits.where("pos = -1").select("rid", "doc_id", F.col("gram").alias("n_words"))
    votes = hits.where("pos >= 0").withColumn("diagonal", F.col("pos") - F.col("tpos"))
    votes = votes.groupBy("rid", "template", "label", "size", "exact", "diagonal").agg(F.collect_set("tpos").alias("at"), F.min("pos").alias("low"), F.max("pos").alias("high"))
    phrase = votes.where(F.col("exact") & (F.size("at") == F.col("size"))).select("rid", "label", "exact", F.col("diagonal").alias("first_word"), F.col("high").alias("last_word"), F.lit(1.0).alias("cover"), F.lit(True).alias("verified"))
    order = Window.partitionBy("rid", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > gap, F.lit(True))
    merged = votes.where(~F.col("exact")).withColumn("run", F.sum(apart.cast("int")).over(order))
    merged = merged.groupBy("rid", "template", "label", "size", "exact", "run").agg(F.size(F.array_distinct(F.flatten(F.collect_list("at")))).alias("n"), F.min("low").alias("first_word"), F.max("high").alias("last_word"))
    share = F.col("n") / F.col("size")
    merged = Kept(spark).table(merged.withColumn("cover", share), "runs")
    voted = merged.select("rid", "label", "exact", "first_word", "last_word", "cover", F.lit(False).alias("verified"))
    candidates = merged.where(F.col("cover") >= cover).groupBy("rid").agg(F.collect_list(F.struct("template", "first_word", "last_word")).alias("found"))
    candidates = Kept(spark).table(candidates, "candidates")
    few = candidates.count() <= MOST_CANDIDATES
    suspects = texts.select("rid", "text").join(F.broadcast(candidates) if few else candidates, "rid").dropDuplicates(["rid"])
    split = [(text.split(), label) for text, label in (*phrases, *notices)]
    checked = suspects.mapInArrow(_verify(split, k, cover), "rid long, label string, first_word long, last_word long, cover double")
    notice = voted.unionByName(checked.withColumns({"exact": F.lit(False), "verified": F.lit(True)}))
    return rows, phrase.unionByName(notice)


def license_labels(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Base columns come from the exact phrases, ``labels`` from verified notices too; score is the best share of a
    template found (1: whole). Nothing found: n_base 0, first_word and last_word null, empty
    label strings, score 0. Null and empty text have no words; null doc_id stays; repeated rows give
    the same row each; other columns are ignored; an empty table gives no rows.
    """
    rows, spans = scan(docs)
    own = F.when(F.col("exact"), F.col("label"))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    found = spans.groupBy("rid").agg(
        F.count(own).alias("n_base"), F.min(F.when(F.col("exact"), F.col("first_word"))).alias("first_word"), F.max(F.when(F.col("exact"), F.col("first_word"))).alias("last_word"),
        joined(own).alias("base_labels"), joined(F.when(F.col("verified"), F.col("label"))).alias("labels"), F.max("cover").alias("score"),
    )
    empty = {"n_base": F.lit(0), "base_labels": F.lit(""), "labels": F.lit(""), "score": F.lit(0.0)}
    out = rows.join(found, "rid", "left").withColumns({c: F.coalesce(F.col(c), v) for c, v in empty.items()})
    return out.select("doc_id", "n_words", F.col("n_base").cast("long").alias("n_base"), F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"), "base_labels", "labels", "score")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_labels(documents(spark, sf_dir))
