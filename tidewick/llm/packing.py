"""Best-fit packing by patterns: non-negative least squares over the histogram of piece lengths.

Tasks encode whole texts, cut them into pieces and number the pieces of each length. The driver sees a histogram, one
count for each length, whatever the corpus holds. Patterns of up to three lengths that nearly fill a sequence are fitted
to it, with a small cost for what they leave empty; a share of their repeats is taken, rounded down, and the lengths that
are left go best-fit into the free space of these patterns and into new sequences. Of a few such shares, the one that
takes the fewest sequences is the plan. It is a short table of rank ranges for each length, from which every task reads
where its pieces go.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .encoding import SLICE_BYTES, encoder
from .tables import settled, table

CAPACITY, END, TOKENIZER = 1024, 2, "byte_bpe_50k.json"
#: The largest share of a sequence that a pattern leaves empty.
SPARE = 0.3
#: What a sequence left empty costs in the fit, in mean counts of a length; one after the other, with so many steps each.
COSTS, STEPS = (30.0, 3.0, 0.3), 150
#: Shares of the fitted repeats that are taken in turn; after them, none at all (plain best-fit) as a last resort.
SHARES = (1.0, 0.98, 0.9, 0.75, 0.5, 0.25)

Pattern = tuple[tuple[int, ...], int]


def patterns(present: np.ndarray, capacity: int, spare: float = SPARE) -> np.ndarray:
    """Patterns of one to three of the lengths present, as rows padded with 0: the last length is the largest that fits.

    Patterns that leave more than `spare` of a sequence empty are none: their lengths are packed best-fit.
    """
    n = len(present)
    i, j = np.triu_indices(n)
    rest = capacity - present[i] - present[j]
    i, j, rest = i[rest >= 0], j[rest >= 0], rest[rest >= 0]
    k = np.searchsorted(present, rest, "right") - 1
    three = k >= j
    rows = [np.column_stack([present[i[three]], present[j[three]], present[k[three]]])]
    k = np.searchsorted(present, capacity - present, "right") - 1
    two = k >= np.arange(n)
    rows.append(np.column_stack([present[two], present[k[two]], np.zeros(two.sum(), np.int64)]))
    rows.append(np.column_stack([present, np.zeros((n, 2), np.int64)]))
    every = np.concatenate(rows)
    return every[capacity - every.sum(axis=1) <= capacity * spare]


def fit(every: np.ndarray, counts: np.ndarray, empty: np.ndarray, costs: tuple[float, ...] = COSTS, steps: int = STEPS) -> np.ndarray:
    """Repeats x >= 0 of the patterns that minimise half the squares of (lengths used - counts) plus cost * `empty` * x.

    Projected gradients with momentum. The cost falls step by step, so patterns that fill a sequence are used first.
    """
    size = len(counts)
    used = every > 0

    def forward(x: np.ndarray) -> np.ndarray:
        out = np.zeros(size)
        for c in range(every.shape[1]):
            out += np.bincount(every[:, c], x, size)
        out[0] = 0
        return out

    degree = forward(np.ones(len(every)))
    # a diagonal bound of the normal matrix, so that every pattern has a step of its own
    step = 1 / np.maximum(1, (degree[every] * used).sum(axis=1))
    x = np.where(used, counts[every] / np.maximum(1, degree[every]), np.inf).min(axis=1)
    for cost in costs:
        y, t = x.copy(), 1.0
        for _ in range(steps):
            gap = counts - forward(y)
            new = np.maximum(0, y + step * ((gap[every] * used).sum(axis=1) - cost * empty))
            after = (1 + np.sqrt(1 + 4 * t * t)) / 2
            y, x, t = new + (t - 1) / after * (new - x), new, after
            np.maximum(y, 0, out=y)
    return x


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Patterns and repeats that use every piece of the histogram exactly, in no more sequences than best-fit takes."""
    return min(candidates(counts, capacity), key=lambda found: sum(n for _, n in found))


def candidates(counts: dict[int, int], capacity: int = CAPACITY) -> Iterator[list[Pattern]]:
    """Plans by each of SHARES, then plain best-fit decreasing."""
    left = np.zeros(capacity + 1, np.int64)
    for length, count in counts.items():
        left[length] = count
    full = [((capacity,), int(left[capacity]))] if left[capacity] else []
    left[capacity] = 0
    present = np.flatnonzero(left)
    every = patterns(present, capacity) if len(present) else np.zeros((0, 3), np.int64)
    if len(every):
        x = fit(every, left.astype(float), (1 - every.sum(axis=1) / capacity) * left[present].mean())
        for share in SHARES:
            rest = left.copy()
            found = full + _taken(every, x * share, rest)
            yield best_fit(rest, capacity, found)
    yield best_fit(left, capacity, full)


def _taken(every: np.ndarray, x: np.ndarray, left: np.ndarray) -> list[Pattern]:
    """As many whole repeats of each pattern as x says and `left` has pieces for; these leave `left`."""
    out: list[Pattern] = []
    for p in np.argsort(-x, kind="stable"):
        if x[p] < 1:
            break
        parts = every[p][every[p] > 0]
        lengths, often = np.unique(parts, return_counts=True)
        times = int(min(int(x[p]), *(left[lengths] // often)))
        if times:
            left[lengths] -= times * often
            out.append((tuple(sorted(map(int, parts), reverse=True)), times))
    return out


def best_fit(left: np.ndarray, capacity: int, begun: list[Pattern] = ()) -> list[Pattern]:
    """Best-fit decreasing of the counts `left` into the free space of `begun` and into new sequences, lengths at once."""
    open_: dict[int, list[list]] = defaultdict(list)  # free space: patterns so far and how many of each
    for parts, times in begun:
        open_[capacity - sum(parts)].append([parts, times])
    for length in np.flatnonzero(left)[::-1].tolist():
        count = int(left[length])
        for space in sorted(s for s in open_ if s >= length):
            while count and open_[space]:
                parts, times = open_[space].pop()
                each = min(count, space // length)  # as many into one as fit
                some = min(times, count // each)
                if times > some:
                    open_[space].append([parts, times - some])
                open_[space - each * length].append([(*parts, *([length] * each)), some])
                count -= some * each
            if not count:
                break
        while count:
            each = min(count, capacity // length)
            times = count // each
            open_[capacity - each * length].append([(length,) * each, times])
            count -= times * each
    return [(tuple(parts), times) for groups in open_.values() for parts, times in groups]


def places(found: list[Pattern]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first ranks of its ranges, the sequence of the first rank in each, and the offset there."""
    used: dict[int, int] = defaultdict(int)
    ranges: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    sequence = 0
    for parts, times in found:
        offset = 0
        for length in parts:
            ranges[length].append((used[length], sequence, offset))
            used[length] += times
            offset += length
        sequence += times
    return {length: tuple(np.array(c, np.int64) for c in zip(*rows, strict=True)) for length, rows in ranges.items()}


def pieces(docs: DataFrame, capacity: int = CAPACITY, end: int = END, name: str = TOKENIZER) -> DataFrame:
    """Rows doc_id, piece, start, length, ids_crc32, and part, rank: the piece's number among its partition's of that length."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, seen = encoder(name), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for some in tokens.slices(batches, "text", SLICE_BYTES, keep="encoder"):
            rows = []
            for doc, ids in zip(some.column("doc_id").to_pylist(), own.ended(some.column("text"), end), strict=True):
                first = (len(ids) - 1) % capacity + 1
                edges = [0, *range(first, len(ids) + 1, capacity)]
                wide = ids.astype("<u4")
                for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                    rows.append((doc, k, a, b - a, zlib.crc32(wide[a:b]), part, int(seen[b - a])))
                    seen[b - a] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
    return docs.select("doc_id", "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long")


def pack(docs: DataFrame, capacity: int = CAPACITY, end: int = END, name: str = TOKENIZER) -> DataFrame:
    """Rows doc_id, piece, start, length, ids_crc32, sequence_id, offset: all of `docs` (doc_id, text) in sequences.

    A document is the ids of its whole text (null: empty) and the id `end`. Only documents longer than `capacity` are
    cut: the first piece takes the remainder, all others are full. Repeated rows and null ids are packed like any other
    row; columns other than doc_id and text are ignored. An empty table gives no rows.
    """
    cut = settled(pieces(docs, capacity, end, name))
    tally = cut.groupBy("length", "part").agg(F.count("*").alias("n"))  # counted twice, not kept: a file for each partition costs more
    counts = {r["length"]: r["n"] for r in tally.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # `capacity` rows at most
    where = places(plan(counts, capacity))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sizes, ranks = length.to_numpy(), rank.to_numpy()
        sequence, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        order = np.argsort(sizes, kind="stable")
        for group in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1) if len(order) else []:
            first, base, at = where[int(sizes[group[0]])]
            k = np.searchsorted(first, ranks[group], "right") - 1
            sequence[group], offset[group] = base[k] + ranks[group] - first[k], at[k]
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    # one row for each length and partition: numbers of a length go on from partition to partition
    w = Window.partitionBy("length").orderBy("part")
    before = tally.select("length", "part", (F.sum("n").over(w) - F.col("n")).alias("before"))
    out = cut.join(before, ["length", "part"]).withColumn("_at", place("length", F.col("before") + F.col("rank")))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "_at.sequence_id", "_at.offset")


def op8(spark, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences; nulls, empty texts, repeats and empty tables as in pack."""
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"))
