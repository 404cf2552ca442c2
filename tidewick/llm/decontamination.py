"""Benchmark decontamination by spaced seeds.

A seed is a fixed mask over a few neighbouring words: the words at its places must agree, those between are ignored,
so a hit survives substitutions. Test items are hashed under every mask and every place. Documents are read once for
each block of items: a task looks its words up in the block's hashes and verifies every hit on the spot, by counting
the equal words of item and document around the hit. A block holds a bounded number of hashes, however many items
there are, and only blocks are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .tables import Scratch, table

#: Places that must agree, fixed values. The last two together hit every stretch of 13 words of which two differ,
#: whichever two; the first one adds hits.
MASKS = ((0, 1, 2, 3, 4, 5), (0, 1, 2, 4, 6, 7), (0, 4, 7, 8, 9, 10))
#: For items of 6 to 12 words: together they hit every one of which a fifth of the words differ, whichever they are.
SHORT_MASKS = ((0, 1, 2, 3), (0, 1, 3, 4))
#: Items shorter than this are no evidence. A stretch of at most WINDOW words must agree in PERCENT of its words.
LEAST_WORDS, WINDOW, PERCENT = 6, 13, 80
#: Words of items in a block of the broadcast side (about 48 bytes each).
BLOCK_WORDS = 1_000_000
_FILTER_BITS = 20


def _seeds(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, ...]]]:
    """Sorted seed hashes of all items under the masks of their length, the word at which each begins, and the masks."""
    size = np.diff(bounds)
    ends, short = np.repeat(bounds[1:], size), np.repeat(size < WINDOW, size)
    used = np.repeat(size >= LEAST_WORDS, size)
    found, where, masks = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], []
    for mask in (*MASKS, *SHORT_MASKS):
        count = max(0, len(h) - mask[-1])
        at = np.flatnonzero(used[:count] & (short[:count] == (mask in SHORT_MASKS)) & (np.arange(count) + mask[-1] < ends[:count]))
        if len(at):
            masks.append(mask)
            found.append(_under(h, mask)[at])
            where.append(at)
    found, where = np.concatenate(found), np.concatenate(where)
    order = np.argsort(found, kind="stable")
    return found[order], where[order], masks


def _under(h: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """The hashes of all places under a mask; masks don't mix."""
    return tokens.masked(h, mask, max(0, len(h) - mask[-1])) ^ np.uint64(sum(1 << p for p in mask))


def _best(x: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, int, int]:
    """Of the words of `item` laid against x at `shift`: the most equal words in a stretch, its length and its place in
    x, and all equal words."""
    a, b = max(0, -shift), min(len(item), len(x) - shift)
    size = min(WINDOW, len(item))
    if b - a < size:
        return 0, size, 0, 0
    total = np.concatenate([[0], np.cumsum(x[a + shift : b + shift] == item[a:b])])
    run = total[size:] - total[:-size]
    at = int(run.argmax())
    return int(run[at]), size, a + shift + at, int(total[-1])


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows doc_id, item_id, start_word, n_equal, n_window, n_item_equal, n_item_words: the test items found in documents.

    Words are runs of letters and digits (all bytes beyond ASCII count as letters) with A-Z lower-cased. An item is in a
    document if some stretch of 13 of its words (all its words, if it has fewer) agrees with the document in 80 percent
    of its words, place by place, and a seed hits in the stretch or beside it. Items of fewer than 6 words and null texts
    match nothing. Of several places in one document the best one is returned, the first of equals. Repeated rows of a
    document, or of an item, give repeated rows; equal items are looked for once. Null ids are carried as they are. An
    empty table gives no rows.
    """
    words = F.size(F.split(F.col("text"), "[^0-9A-Za-z\u0080-\U0010ffff]+"))
    named = benchmark.where("text is not null").select("item_id", "text", F.sha2(F.col("text").cast("binary"), 256).alias("item"))
    items = named.groupBy("item").agg(F.any_value("text").alias("text")).withColumn("n", words.cast("long"))
    size = items.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    blocks = max(1, -(-size // BLOCK_WORDS))
    parts = [items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k) for k in range(blocks)]
    # one block after the other: the driver and the workers hold one at a time
    keep = Scratch(docs.sparkSession) if blocks > 1 else None
    found = reduce(DataFrame.unionByName, [_against(docs, part.select("item", "text"), keep) for part in parts])
    return found.join(named.select("item", "item_id"), "item").select("doc_id", "item_id", "start_word", "n_equal", "n_window", "n_item_equal", "n_item_words")


def _against(docs: DataFrame, items: DataFrame, keep: Scratch | None) -> DataFrame:
    """The finds of one block; with `keep` they are stored there, and the block's broadcast goes."""
    spark = docs.sparkSession
    block = items.toArrow().combine_chunks()  # one block: bounded by BLOCK_WORDS
    ids = block.column("item").to_pylist()
    text = block.column("text").combine_chunks() if block.num_rows else pa.array([], pa.string())
    words = tokens.Words(text if isinstance(text, pa.Array) else text.chunk(0), tokens.PUNCTUATION)
    seeds, where, masks = _seeds(words.hashes, words.bounds)
    coarse = np.zeros(1 << _FILTER_BITS, bool)
    coarse[(seeds >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
    side = spark.sparkContext.broadcast((seeds, where, words.hashes, words.bounds, ids, coarse))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds, where, item_words, item_bounds, ids, coarse = side.value
        for part in tokens.slices(batches, "text"):
            docs_ids = part.column("doc_id").to_pylist()
            own = tokens.Words(part.column("text"), tokens.PUNCTUATION)
            h, bounds = own.hashes, own.bounds
            tried: set[tuple[int, int, int]] = set()
            best: dict[tuple[int, int], tuple] = {}
            for mask in masks:
                mine = _under(h, mask)
                at = np.flatnonzero(coarse[(mine >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
                low, high = np.searchsorted(seeds, mine[at], "left"), np.searchsorted(seeds, mine[at], "right")
                hit = np.flatnonzero(high > low)
                for p, lo, hi in zip(at[hit].tolist(), low[hit].tolist(), high[hit].tolist(), strict=True):
                    d = int(np.searchsorted(bounds, p, "right")) - 1
                    for q in where[lo:hi].tolist():
                        i = int(np.searchsorted(item_bounds, q, "right")) - 1
                        shift = (p - int(bounds[d])) - (q - int(item_bounds[i]))
                        if (d, i, shift) in tried:
                            continue
                        tried.add((d, i, shift))
                        item = item_words[item_bounds[i] : item_bounds[i + 1]]
                        equal, size, start, whole = _best(h[bounds[d] : bounds[d + 1]], item, shift)
                        if 100 * equal >= PERCENT * size:
                            best[d, i] = max(best.get((d, i), (0, 0, 0, 0, 0)), (whole, equal, -start, size, len(item)))
            rows = [(docs_ids[d], ids[i], -start, equal, size, whole, n) for (d, i), (whole, equal, start, size, n) in sorted(best.items())]
            if rows:
                kinds = [pa.int64(), pa.string(), *[pa.int64()] * 5]
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    names = ["doc_id", "item", "start_word", "n_equal", "n_window", "n_item_equal", "n_item_words"]
    found = docs.select("doc_id", "text").mapInArrow(scan, ", ".join(f"{c} {'string' if c == 'item' else 'long'}" for c in names))
    if keep is None:
        return found
    found = keep(found)
    side.destroy()
    return found


def clean_of(docs: DataFrame, found: DataFrame) -> DataFrame:
    """`docs` without the documents in `found` (doc_id), all rows of an id. Rows with a null id stay."""
    return docs.join(found.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def op5(spark, sf_dir: str) -> DataFrame:
    """Every test item found in a document, over all documents and items."""
    return contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
