"""Document fingerprints by locally consistent parsing.

A text's bytes are parsed into phrases, the phrases into phrases of phrases, and so on. Where a phrase ends depends only
on the few symbols around: equal neighbours are drawn together first; then deterministic coin tossing turns each symbol
into the lowest bit in which it differs from its left neighbour, again and again until six labels are left, which are
reduced to three; phrases begin at the local maxima, so they have two to four symbols. A phrase's name is a hash of the
names in it. So equal substrings get the same names wherever they stand, but for a few symbols at both ends, and a
fingerprint is a sample of a text's names: the smallest hashes of them, and the name of the whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .tables import Scratch, setting, table

#: Names of this level (three or so words) and above are sampled; of the levels below only where there are fewer than
#: FEW names, so that short texts have some too.
LEVEL, FEW = 3, 12
#: Hashes of a fingerprint, 32 bits each.
SAMPLE = 64
#: Bytes of texts that are parsed at once. Parsing takes 43 times as many for a while.
SLICE_BYTES = 250_000
#: Rows that the JVM reads at once. Spark's own 4,096 are 13 MB of text in one array for each task, and the heap grows by such.
READ_ROWS = 512
#: Ends of partitions that a task compares with the first documents of the next ones.
ENDS = 100

_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20250817))
_STEP = _rng.integers(1, 2**63, 8, dtype=np.uint64) * _U(2) + _U(1)
_LEVELS = _rng.integers(1, 2**63, 64, dtype=np.uint64)
_BYTES = tokens.mix(np.arange(256, dtype=np.uint64))
_RUN, _TOP = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F)


def _labels(symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels 0 to 2 of symbols, neighbours of a text differing if their symbols do; `first` are where texts begin."""
    label, bits = symbols, symbols.dtype.itemsize * 8
    while True:
        differ = label.copy()
        differ[1:] ^= label[:-1]
        differ[first] = 1  # a text's first symbol has no left neighbour: its lowest bit tells
        lowest = differ & (~differ + differ.dtype.type(1))
        at = np.bitwise_count(lowest - lowest.dtype.type(1)).astype(np.uint8)
        own = (label & lowest) != 0
        label = 2 * at + own
        if bits == 3:  # three bits give six labels, and these three bits again
            break
        bits = (2 * bits - 1).bit_length()
    for much in (5, 4, 3):
        left, right = np.full(len(label), 9, np.uint8), np.full(len(label), 9, np.uint8)
        left[1:], right[:-1] = label[:-1], label[1:]
        left[first] = 9
        right[first[1:] - 1] = 9
        at = np.flatnonzero(label == much)
        a, b = left[at], right[at]
        free = np.where((a != 0) & (b != 0), 0, np.where((a != 1) & (b != 1), 1, 2))
        label[at] = free
    return label


def _runs(symbols: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal neighbours drawn together: a symbol and a length for each run, and the bounds of the texts among runs."""
    new = np.ones(len(symbols), bool)
    new[1:] = symbols[1:] != symbols[:-1]
    new[bounds[:-1][bounds[:-1] < len(symbols)]] = True
    at = np.flatnonzero(new)
    return symbols[at], np.diff(np.append(at, len(symbols))), np.searchsorted(at, bounds)


def _names(symbols: np.ndarray, lengths: np.ndarray, at: np.ndarray, salt: np.uint64) -> np.ndarray:
    """Hashes of the phrases that begin at `at`, by their symbols, the lengths of these runs, and the level's salt."""
    value = _BYTES[symbols] if symbols.dtype == np.uint8 else tokens.mix(symbols)
    long = np.flatnonzero(lengths > 1)
    value[long] = tokens.mix(value[long] + lengths[long].astype(np.uint64) * _RUN)
    size = np.diff(np.append(at, len(symbols)))
    out = value[at] * _STEP[0] + size.astype(np.uint64) + salt
    for k in range(1, int(size.max(initial=0))):
        some = np.flatnonzero(size > k)
        out[some] += value[at[some] + k] * _STEP[k]
    return tokens.mix(out)


def parse(column: pa.Array) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For each level the names and the n + 1 bounds of the texts among them; and each text's name, 0 for an empty one.

    A text leaves the levels once it is a single name. A null is an empty text.
    """
    symbols, bounds = tokens.utf8(column)
    top, levels = np.zeros(len(column), np.uint64), []
    while True:
        symbols, lengths, bounds = _runs(symbols, bounds)
        start = bounds[:-1][bounds[:-1] < bounds[1:]]  # of the texts that still have symbols
        # labels go by the symbols alone: neighbours differ, as runs are drawn together
        label = _labels(symbols, start)
        before, after = np.zeros(len(label), np.uint8), np.zeros(len(label), np.uint8)
        before[1:], after[:-1] = label[:-1], label[1:]
        after[start[1:] - 1] = 0  # nothing of the next text
        begins = (label > before) & (label > after)
        begins[np.minimum(start + 1, len(begins) - 1)] = False  # so a text has fewer names each time
        begins[start] = True
        at = np.flatnonzero(begins)
        names = _names(symbols, lengths, at, _LEVELS[len(levels) & 63])
        bounds = np.searchsorted(at, bounds)
        levels.append((names, bounds))
        count = np.diff(bounds)
        single = count == 1
        top[single] = names[bounds[:-1][single]]
        # texts of one name are done: their symbols go
        symbols = names[~np.repeat(single, count)]
        bounds = np.concatenate([[0], np.cumsum(np.where(single, 0, count))])
        if not len(symbols):
            return levels, top


def sketches(column: pa.Array) -> list[tuple[int, np.ndarray]]:
    """For each text its own name and the SAMPLE smallest 32-bit hashes of its names, ascending."""
    levels, top = parse(column)
    n = len(column)
    taken, have = [], np.zeros(n, np.int64)
    for k in reversed(range(len(levels))):
        names, bounds = levels[k]
        count = np.diff(bounds)
        text = np.repeat(np.arange(n), count)
        if k < LEVEL - 1:  # of the levels below, for texts with few names
            some = (have < FEW)[text]
            names, text = names[some], text[some]
        taken.append((text.astype(np.uint64) << _U(32)) | (tokens.mix(names + _TOP) >> _U(32)))
        have += np.bincount(text, minlength=n)
    key = np.sort(np.concatenate(taken))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    key = key[new]
    bounds = np.searchsorted(key, np.arange(n + 1, dtype=np.uint64) << _U(32))
    hashes = key.astype(np.uint32)
    return [(int(t), hashes[a : min(b, a + SAMPLE)]) for t, a, b in zip(top, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def packed(sketch: tuple[int, np.ndarray]) -> bytes:
    """A fingerprint's bytes: 8 of the whole text's name, then 4 for each hash."""
    return sketch[0].to_bytes(8, "big") + sketch[1].astype(">u4").tobytes()


def unpacked(fingerprint: bytes) -> tuple[int, np.ndarray]:
    return int.from_bytes(fingerprint[:8], "big"), np.frombuffer(fingerprint[8:], ">u4").astype(np.uint32)


def written(sketch: tuple[int, np.ndarray]) -> str:
    """A fingerprint as hexadecimal text."""
    return packed(sketch).hex()


def read(fingerprint: str) -> tuple[int, np.ndarray]:
    return unpacked(bytes.fromhex(fingerprint))


def alike(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> float:
    """The estimated share of names that two texts have in common: twice the common ones by all of either, 0 to 1.

    The smallest hashes of both together are a sample of the union; of these, the ones in both are counted. Texts with
    no more names than a sample has are compared exactly. Two empty texts are alike, an empty and another one aren't.
    """
    if a[0] == b[0]:
        return 1.0
    every = np.union1d(a[1], b[1])
    whole = min(SAMPLE if len(a[1]) == SAMPLE or len(b[1]) == SAMPLE else len(every), len(every))
    both = np.isin(every[:whole], np.intersect1d(a[1], b[1])).sum()
    share = both / whole if whole else 0.0
    return float(2 * share / (1 + share))


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text; a null counts as an empty one. Equal texts have equal fingerprints."""

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        column = pa.RecordBatch.from_arrays([pa.array(texts, pa.string(), from_pandas=True)], ["text"])
        return pd.Series([written(s) for part in tokens.slices([column], "text", SLICE_BYTES) for s in sketches(part.column(0))], dtype=object)

    return of(text)


def likeness(a: Column, b: Column) -> Column:
    """How alike the texts of two fingerprints are, 0 to 1; null if either is null."""

    @F.pandas_udf("double")
    def of(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else alike(read(p), read(q)) for p, q in zip(x, y, strict=True)], dtype=object)

    return of(a, b)


_FOUND = "doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
_EDGE = "part int, first_text string, first_print binary, last_text string"


def edited(text: str, following: str) -> str:
    """`text` with its last quarter (rounded down) replaced by as much of the beginning of `following`, or all of it."""
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


def _compared(docs: list[tuple], following: list[tuple]) -> list[tuple]:
    """Rows as in _FOUND for documents (doc_id, text, sketch) and those that follow each."""
    changed = [edited(d[1], f[1]) for d, f in zip(docs, following, strict=True)]
    other: list[tuple[int, np.ndarray]] = []
    for part in tokens.slices([pa.RecordBatch.from_arrays([pa.array(changed, pa.large_string())], ["text"])], "text", SLICE_BYTES):
        other += sketches(part.column(0))
    return [
        (d[0], len(d[1]), hashlib.sha256(c.encode()).digest(), packed(d[2]), packed(s), alike(d[2], s), alike(d[2], f[2]))
        for d, f, c, s in zip(docs, following, changed, other, strict=True)
    ]


def with_following(docs: DataFrame) -> DataFrame:
    """Rows doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of all of `docs`.

    Documents ascend by doc_id; null ids come first, equal ids ascend by a hash of the text and then by the text. A null
    text is an empty one; the document after the last is the first, so a single document follows itself. Other columns
    are ignored. An empty table gives no rows. Texts are shuffled once and not kept: a task compares neighbours as they
    come, a slice at a time, and leaves the last document of its partition for later, with the first one.
    """
    keep = Scratch(docs.sparkSession)
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    laid = docs.select("doc_id", "text").repartitionByRange(partitions, *order).sortWithinPartitions(*order, F.col("text").asc_nulls_first())

    names = [f.split()[0] for f in _FOUND.split(", ")] + [f.split()[0] for f in _EDGE.split(", ")]
    kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 3, pa.float64(), pa.float64(), pa.int32(), pa.string(), pa.binary(), pa.string()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, last = TaskContext.get().partitionId(), None, None
        for some in tokens.slices(batches, "text", SLICE_BYTES):
            texts = some.column("text").fill_null("")
            own = list(zip(some.column("doc_id").to_pylist(), texts.to_pylist(), sketches(texts), strict=True))
            first = first or own[0]
            whole = [last, *own] if last else own
            last = whole[-1]
            if len(whole) > 1:
                yield batch([(*r, None, None, None, None) for r in _compared(whole[:-1], whole[1:])])
        if last:
            yield batch([(last[0], None, None, None, None, None, None, part, first[1], packed(first[2]), last[1])])

    with setting(docs.sparkSession, {"spark.sql.parquet.columnarReaderBatchSize": str(READ_ROWS)}):
        found = keep(laid.mapInArrow(compare, f"{_FOUND}, {_EDGE}"))
    # one row for each partition: its last document waits for the first one of the next partition
    edges = found.where("part is not null")
    parts = edges.select("part")
    one = Window.orderBy("part")
    after = parts.select("part", F.coalesce(F.lead("part").over(one), F.first("part").over(one)).alias("next"))
    firsts = edges.select(F.col("part").alias("next"), "first_text", F.col("first_print").alias("next_print"))
    met = edges.select("part", "doc_id", "last_text").join(after, "part").join(firsts, "next").select("doc_id", "last_text", "first_text", "next_print")
    met = met.coalesce(-(-partitions // ENDS))  # else as many tasks and files of a row each as there are partitions

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in tokens.slices(batches, "last_text", SLICE_BYTES):
            for row in some.to_pylist():
                own = row["doc_id"], row["last_text"], sketches(pa.array([row["last_text"]]))[0]
                yield batch([(*r, None, None, None, None) for r in _compared([own], [(None, row["first_text"], unpacked(row["next_print"]))])])

    closed = met.mapInArrow(close, f"{_FOUND}, {_EDGE}")
    every = found.where("part is null").union(closed).drop("part", "first_text", "first_print", "last_text")
    return every.select(*[F.lower(F.hex(c)).alias(c) if kind == "binary" else F.col(c) for c, kind in every.dtypes])


def op13(spark, sf_dir: str) -> DataFrame:
    """All documents against their edited texts and the documents that follow; odd rows as in with_following."""
    return with_following(table(spark, sf_dir, "documents"))
