"""Similarity links inside candidate groups by T-occurrence search (DivideSkip), in blocks.

A candidate group is cut into blocks of bounded total set size; each task searches one
pair of blocks, so no group meets in one task and nothing emits all pairs of a group.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._session import Kept, partitions, trimmed
from tessera.llm._text import mix

#: Set elements in a block; a task holds two blocks.
BLOCK = 200_000
LINK_SCHEMA = "a long, b long, w long"


class Lists:
    """Inverted lists of some sets: element -> ascending positions of the sets that hold it."""

    def __init__(self, sets: list[np.ndarray]):
        sizes = np.array([len(s) for s in sets], dtype=np.int64)
        owner = np.repeat(np.arange(len(sets)), sizes)
        elements = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        order = np.argsort(elements, kind="stable")
        self.owner, elements = owner[order], elements[order]
        self.keys, starts = np.unique(elements, return_index=True)
        self.starts = np.append(starts, len(elements))
        self.sets, self.sizes = sets, sizes

    def search(self, query: np.ndarray, num: int, den: int, after: int = -1) -> np.ndarray:
        """Positions over ``after`` of sets with ``den * |both| >= num * |either|``.

        Any such set shares T = ceil(num * n / den) of the query's n elements. The T - 1
        longest lists can't make up T alone: the other, short lists are merged, and only
        what occurs there is probed in the long ones. Where merging everything is cheaper
        (lists about as long as each other), no list counts as long.
        """
        n = len(query)
        t = -(-num * n // den)
        if not n or not len(self.keys):
            return np.zeros(0, np.int64)
        at = np.searchsorted(self.keys, query)
        there = at < len(self.keys)
        there[there] = self.keys[at[there]] == query[there]
        at = at[there]
        if len(at) < t:
            return np.zeros(0, np.int64)
        lens = self.starts[at + 1] - self.starts[at]
        order = np.argsort(lens, kind="stable")
        at, lens = at[order], lens[order]
        cut = len(at) - (t - 1)
        short = int(lens[:cut].sum())
        likely = min(len(self.sets), short)
        if likely * (20 + t // 4) > int(lens.sum()):
            cut = len(at)
        merged = np.concatenate([self.owner[self.starts[x] : self.starts[x + 1]] for x in at[:cut]])
        counts = np.bincount(merged, minlength=len(self.sets))
        found = np.flatnonzero(counts >= max(1, t - (len(at) - cut)))
        found = found[found > after]
        out = []
        long = np.sort(self.keys[at[cut:]])
        for x in found:
            both = int(counts[x])
            if len(long):
                own = self.sets[x]
                p = np.minimum(np.searchsorted(own, long), len(own) - 1)
                both += int((own[p] == long).sum())
            if den * both >= num * (n + int(self.sizes[x]) - both):
                out.append(x)
        return np.array(out, dtype=np.int64)


class Forest:
    """Union-find over a task's own sets; ``join`` tells whether a link adds to the forest."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def _compare_few(sids: list[int], sets: list[np.ndarray], num: int, den: int) -> tuple[list, list, list]:
    """Forest links of a few sets, each pair not yet joined compared as it is."""
    forest, out = Forest(len(sids)), ([], [], [])
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if num * max(len(a), len(b)) > den * min(len(a), len(b)) or forest.find(i) == forest.find(j):
                continue
            p = np.minimum(np.searchsorted(b, a), len(b) - 1)
            both = int((b[p] == a).sum())
            if den * both >= num * (len(a) + len(b) - both) and forest.join(j, i):
                out[0].append(sids[j])
                out[1].append(sids[i])
                out[2].append(0)
    return out


def _search_task(sids: list[int], sets: list[np.ndarray], copies: list[int], sides: list[int], num: int, den: int) -> tuple[list, list, list]:
    """Forest links (a, b, 0) and, for each set, (a, a, copies that its links reach)."""
    left = [i for i, s in enumerate(sides) if s != 1]
    right = [i for i, s in enumerate(sides) if s != 0]
    own = bool(sides) and sides[0] == 2
    lists = Lists([sets[i] for i in right])
    forest, reach = Forest(len(sids)), [0] * len(sids)
    out: tuple[list, list, list] = [], [], []
    for k, i in enumerate(left):
        for x in lists.search(sets[i], num, den, k if own else -1):
            j = right[int(x)]
            reach[i] += copies[j]
            reach[j] += copies[i]
            if forest.join(i, j):
                out[0].append(sids[i])
                out[1].append(sids[j])
                out[2].append(0)
    for i, w in enumerate(reach):
        if w:
            out[0].append(sids[i])
            out[1].append(sids[i])
            out[2].append(w)
    return out


def _patterns(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Elements of two sets or more, those that are in just the same sets as one pattern.

    Returns the patterns' sets in one array, each pattern's first place and length there, and how many elements it has.
    """
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    elements = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    order = np.argsort(elements, kind="stable")
    owner, elements = owner[order], elements[order]
    starts = np.flatnonzero(np.append(True, elements[1:] != elements[:-1])) if len(elements) else np.zeros(0, np.int64)
    lens = np.diff(np.append(starts, len(elements)))
    names = np.add.reduceat(mix(owner.astype(np.uint64) + np.uint64(1)), starts) if len(starts) else np.zeros(0, np.uint64)
    shared = lens > 1
    _, at, weights = np.unique(names[shared], return_index=True, return_counts=True)
    return owner, starts[shared][at], lens[shared][at], weights


def _ranges(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one after the other."""
    return np.repeat(starts - np.cumsum(lens) + lens, lens) + np.arange(int(lens.sum()))


#: Numbers in a matrix of a task's comparison.
CELLS = 1 << 22


def _shared(sets: list[np.ndarray], n: int, first: int) -> Iterator[tuple[int, np.ndarray]]:
    """How many elements each of the first ``n`` sets shares with each from ``first`` on, some rows at a time.

    A matrix product over patterns where that is the least work, else the sets of each set's patterns are counted.
    """
    owner, starts, lens, weights = _patterns(sets)
    right = len(sets) - first
    if n * right <= CELLS and n * right * len(starts) <= 64 * float((lens.astype(float) ** 2).sum()) + 1e6 * n:
        kind = np.float32 if max(map(len, sets), default=0) < 1 << 24 else np.float64  # exact either way
        both, width = np.zeros((n, right), kind), max(1, CELLS // len(sets))
        for i in range(0, len(starts), width):
            part = lens[i : i + width]
            table = np.zeros((len(sets), len(part)), kind)
            table[owner[_ranges(starts[i : i + width], part)], np.repeat(np.arange(len(part)), part)] = 1
            both += (table[:n] * weights[i : i + width].astype(kind)) @ table[first:].T
        rows = max(1, CELLS // 16 // max(1, right))
        for i in range(0, n, rows):
            yield i, both[i : i + rows].astype(np.int64)
        return
    patterns = np.repeat(np.arange(len(starts)), lens)
    members = owner[_ranges(starts, lens)]
    order = np.argsort(members, kind="stable")
    patterns, ends = patterns[order], np.searchsorted(members[order], np.arange(n + 1))
    for i in range(n):
        own = patterns[ends[i] : ends[i + 1]]
        with_ = owner[_ranges(starts[own], lens[own])]
        counts = np.bincount(with_, np.repeat(weights[own], lens[own]), len(sets))
        yield i, counts[None, first:].astype(np.int64)


def _forest_task(sids: list[int], sets: list[np.ndarray], left: int | None, num: int, den: int) -> tuple[list, list, list]:
    """Forest links (a, b, 0) of all pairs of sets, or with ``left`` of the first so many with the others."""
    n, first = (len(sets), 0) if left is None else (left, left)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    tree = np.arange(len(sets))
    out: tuple[list, list, list] = [], [], []
    for at, both in _shared(sets, n, first):
        near = den * both >= num * (sizes[at : at + len(both), None] + sizes[None, first:] - both)
        near &= both > 0
        for i, row in enumerate(near, at):
            found = np.flatnonzero(row) + first
            found = found[tree[found] != tree[i]]
            while len(found):
                j = int(found[0])
                out[0].append(sids[i])
                out[1].append(sids[j])
                out[2].append(0)
                tree[tree == tree[j]] = tree[i]
                found = found[tree[found] != tree[i]]
    return out


def stored(elements: list[bytes]) -> list[np.ndarray]:
    """Sets that are stored as sorted distinct unsigned 64-bit elements."""
    return [np.frombuffer(e, dtype=np.uint64) for e in elements]


#: Groups of so few sets are compared pair by pair where only links are asked for.
FEW = 6
#: Bytes of elements that a task takes in before it compares the groups it holds.
HELD = 100_000


def _run_tasks(num: int, den: int, decode, reach: bool, folder: str | None = None):
    """Links of each task; a task of side 3 is a block, written under ``folder``: (task, null, null, path)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, ([], [], [], [])
        waiting: list[tuple[list, list, list, list]] = []  # groups whose sets are made together
        size = 0

        def flush():
            out: tuple[list, list, list, list] = [], [], [], []
            sets = decode([x for group in waiting for x in group[1]])
            at = 0
            for sids, elements, copies, sides in waiting:
                own, at = sets[at : at + len(sids)], at + len(sids)
                if reach:
                    found = _search_task(sids, own, copies, sides, num, den)
                elif len(sids) <= FEW and sides[0] == 2:
                    found = _compare_few(sids, own, num, den)
                else:
                    found = _forest_task(sids, own, sides.count(0) if sides[0] == 0 else None if sides[0] == 2 else 0, num, den)
                for x, y in zip(out, found):
                    x.extend(y)
            waiting.clear()
            return record(*out[:3], None)

        def record(a, b, w, path):
            out = {"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "w": pa.array(w, pa.int64())}
            if folder is not None:
                out["path"] = pa.array([path] * len(a), pa.string())
            return pa.RecordBatch.from_pydict(out)

        def end():
            nonlocal held, size
            done, held = held, ([], [], [], [])
            if done[3][0] == 3:
                yield record([key], [None], [None], _write_block(folder, *done[:3]))
            elif len(done[0]) > 1 or reach:
                size += sum(map(len, done[1]))
                waiting.append(done)
                if size > HELD:
                    size = 0
                    yield flush()

        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("task", "sid", "elements", "copies", "side")]
            for task, sid, elements, copies, side in zip(*cols):
                if task != key and held[0]:
                    yield from end()
                if task == key and held[0] and held[0][-1] == sid:
                    continue  # a repeated row
                key = task
                held[0].append(sid)
                held[1].append(elements)
                held[2].append(copies)
                held[3].append(side)
        if held[0]:
            yield from end()
        if waiting:
            yield flush()

    return run


def _write_block(folder: str, sids: list[int], elements: list[bytes], copies: list[int]) -> str:
    """A file with a block's sets; its path. A second attempt's file has another name."""
    from pyarrow.fs import FileSystem

    store, root = FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    name = f"{uuid.uuid4().hex}.arrow"
    table = pa.RecordBatch.from_arrays([pa.array(sids, pa.int64()), pa.array(elements, pa.binary()), pa.array(copies, pa.int64())], ["sid", "elements", "copies"])
    with store.open_output_stream(f"{root}/{name}") as out, pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(table)
    return f"{folder}/{name}"


def _read_block(path: str) -> tuple[list[int], list[bytes], list[int]]:
    from pyarrow.fs import FileSystem

    store, at = FileSystem.from_uri(path)
    with store.open_input_stream(at) as source, pa.ipc.open_stream(source) as reader:
        table = reader.read_all()
    return tuple(table.column(c).to_pylist() for c in ("sid", "elements", "copies"))


def _run_pairs(num: int, den: int, decode, reach: bool):
    """Searches pairs of blocks, each read where they meet; of a run of pairs, the left block is read once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, first = None, None
        for batch in batches:
            for a, b in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist()):
                if a != path:
                    sids, elements, copies = _read_block(a)
                    path, first = a, (sids, decode(elements), copies)
                sids, sets, copies = first
                left = None
                if a != b:
                    more = _read_block(b)
                    left = len(sids)
                    sids, sets, copies = sids + more[0], sets + decode(more[1]), copies + more[2]
                if reach:
                    sides = [2] * len(sids) if left is None else [0] * left + [1] * (len(sids) - left)
                    found = _search_task(sids, sets, copies, sides, num, den)
                else:
                    found = _forest_task(sids, sets, left, num, den)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["a", "b", "w"])

    return run


def _stored_links(found: DataFrame, blocks: DataFrame, num: int, den: int, decode, reach: bool) -> DataFrame:
    """Links of small groups, and those of all pairs of ``blocks`` (task, grp, band, h), whose files ``found`` names.

    A block is written once, to the shared store; the tasks that compare it get its name and read it. So what is
    written grows with the groups, and only what is read and compared with the pairs of a group's blocks.
    """
    n = partitions(found.sparkSession)
    blocks = blocks.join(found.where("path is not null").select(F.col("a").alias("task"), "path"), "task")
    one, two = blocks.alias("one"), blocks.alias("two")
    order = F.struct("one.band", "one.h") <= F.struct("two.band", "two.h")
    pairs = one.join(two, (F.col("one.grp") == F.col("two.grp")) & order & (F.col("two.band") - F.col("one.band") <= 1))
    pairs = pairs.select(F.col("one.path").alias("left"), F.col("two.path").alias("right"))
    dealt = pairs.repartition(n, "left", "right").sortWithinPartitions("left", "right")
    return found.where("path is null").drop("path").union(dealt.mapInArrow(trimmed(_run_pairs(num, den, decode, reach)), LINK_SCHEMA))


def links(sets: DataFrame, sizes: DataFrame, num: int, den: int, block: int = BLOCK, decode=stored, sized: bool = True, kept: Kept | None = None) -> DataFrame:
    """All links inside candidate groups, as forest links plus reach.

    sets: (sid long, elements binary), made sets of by ``decode``; sizes: (sid, grp long, n long, copies long).
    With ``sized``, n is a set's exact size, sets too unlike in size are never compared, and reach is
    returned; without, only links are.
    Returns (a, b, w): w = 0 for links (enough of them to keep everything connected that is
    linked), a = b and w > 0 for how many rows the links of ``a`` reach in one task.
    With ``kept``, blocks of large groups are stored there and read by their tasks, else rows are sent to each of them.
    """
    band = math.log(den / num) * 1.000001
    sizes = sizes.withColumn("band", F.floor(F.log(F.greatest(F.col("n"), F.lit(1))) / band) if sized else F.lit(0).cast("long"))
    groups = sizes.groupBy("grp").agg(F.sum("n").alias("total"), F.count("*").alias("members")).where("members > 1")
    cut = sizes.groupBy("grp", "band").agg(F.ceil(F.sum("n") / block).cast("int").alias("cuts"))
    small = sizes.join(groups.where(F.col("total") <= block), "grp").select("sid", "copies", F.lit(2).alias("side"), F.xxhash64("grp").alias("task"))
    large = sizes.join(groups.where(F.col("total") > block).select("grp"), "grp").join(cut, ["grp", "band"])
    dealt_sets = lambda tasks: tasks.join(sets, "sid").repartition(partitions(sets.sparkSession), "task").sortWithinPartitions("task", "side", "sid").select("task", "sid", "elements", "copies", "side")
    if kept is not None:
        h = F.pmod(F.xxhash64("sid"), F.col("cuts")).cast("int")
        large = large.select("sid", "copies", F.lit(3).alias("side"), F.xxhash64("grp", "band", F.lit(2), h).alias("task"), "grp", "band", h.alias("h"))
        folder = kept.folder("blocks")
        found = dealt_sets(small.union(large.select(small.columns))).mapInArrow(trimmed(_run_tasks(num, den, decode, sized, folder)), f"{LINK_SCHEMA}, path string")
        return _stored_links(kept.table(found, "tasks"), large.select("task", "grp", "band", "h").distinct(), num, den, decode, sized)
    near = cut.select("grp", (F.col("band") - 1).alias("band"), F.col("cuts").alias("above"))
    below = cut.select("grp", (F.col("band") + 1).alias("band"), F.col("cuts").alias("under"))
    large = large.join(near, ["grp", "band"], "left").join(below, ["grp", "band"], "left").withColumn("h", F.pmod(F.xxhash64("sid"), F.col("cuts")).cast("int"))
    upto = lambda c: F.when(F.col(c) > 0, F.sequence(F.lit(0), F.col(c) - 1)).otherwise(F.array().cast("array<int>"))
    slot = lambda band, x, y, side, kind: F.struct(F.xxhash64("grp", band, F.lit(kind), x, y).alias("task"), side.alias("side"))
    own = F.transform(upto("cuts"), lambda x: slot(F.col("band"), F.least(x, F.col("h")), F.greatest(x, F.col("h")), F.when(x == F.col("h"), 2).when(x > F.col("h"), 0).otherwise(1), 0))
    up = F.transform(upto("above"), lambda x: slot(F.col("band"), F.col("h"), x, F.lit(0), 1))
    down = F.transform(upto("under"), lambda x: slot(F.col("band") - 1, x, F.col("h"), F.lit(1), 1))
    large = large.select("sid", "copies", F.explode(F.concat(own, up, down)).alias("s")).select("sid", "copies", "s.side", "s.task")
    return dealt_sets(small.union(large)).mapInArrow(trimmed(_run_tasks(num, den, decode, sized)), LINK_SCHEMA)
