"""MinHash near-dedup: one-permutation hashing, optimal densification, banded buckets and star-shaped candidate links.

Texts with equal shingle sets are one class from the start. Of each other class, one scan makes the signature. A bucket
of a band links its members to its smallest one only, so a bucket of n classes makes n - 1 candidates, not n * n / 2;
every candidate is confirmed on the full shingle sets.

What a star can miss are links between members of one bucket that its centre is not linked to. Where the members of a
bucket lie in several components, an exact prefix filter finds the rest: if two sets are similar enough, they share one
of their rarest shingles, and neither has more shingles of its own than the threshold allows. Rare shingles make short
lists, so a large group of copies that have drifted apart makes few pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .graph import components
from .tables import settled, stored, table

BINS, ROWS = 128, 4
_rng = np.random.Generator(np.random.PCG64(99))
#: The order in which an empty bin of a signature looks for a filled one to borrow from: its own permutation of bins.
_PROBES = np.array([_rng.permutation(BINS) for _ in range(BINS)])
_BAND = _rng.integers(1, 2**63, (BINS // ROWS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(column: pa.Array, n: int) -> list[np.ndarray]:
    """The sorted set of each text's n-word shingle hashes; a text of fewer words has its whole sequence as one."""
    words = tokens.Words(column)
    hashes, _, bounds = words.shingles(n)
    out = []
    for i in range(len(column)):
        if bounds[i + 1] > bounds[i]:
            out.append(np.unique(hashes[bounds[i] : bounds[i + 1]]))
        elif words.bounds[i + 1] > words.bounds[i]:
            out.append(np.array([words.whole(i)], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(s: np.ndarray) -> np.ndarray:
    """The densified one-permutation signature of a set that isn't empty: the least hash in each bin of hash values."""
    bins = (s >> np.uint64(57)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], bins[1:] != bins[:-1]]))
    least, filled = np.zeros(BINS, np.uint64), np.zeros(BINS, bool)
    least[bins[first]], filled[bins[first]] = s[first], True
    if not filled.all():
        empty = np.flatnonzero(~filled)
        probes = _PROBES[empty]
        least[empty] = least[probes[np.arange(len(empty)), filled[probes].argmax(axis=1)]]
    return least


def band_keys(s: np.ndarray) -> np.ndarray:
    rows = signature(s).reshape(-1, ROWS)
    return tokens.mix((rows * _BAND).sum(axis=1, dtype=np.uint64) + np.arange(len(rows), dtype=np.uint64)).view(np.int64)


def signed(docs: DataFrame, n: int) -> DataFrame:
    """Rows doc_id, n_shingles, f1, f2 (a 128-bit mark of the set) and keys of its bands, in one scan of the texts."""
    bands = BINS // ROWS

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tokens.slices(batches, "text"):
            sets = shingle_sets(part.column("text"), n)
            marks = np.array([[np.sum(tokens.mix(s), dtype=np.uint64), np.sum(tokens.mix(s ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)] for s in sets], np.uint64).view(np.int64).reshape(-1, 2)
            keys = [band_keys(s) if len(s) else np.zeros(0, np.int64) for s in sets]
            offsets = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(marks[:, 0]), pa.array(marks[:, 1]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(keys)))],
                ["doc_id", "n_shingles", "f1", "f2", "keys"],
            )

    assert bands * ROWS == BINS
    return docs.select("doc_id", "text").mapInArrow(sign, "doc_id long, n_shingles long, f1 long, f2 long, keys array<long>")


def confirmed(pairs: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Of `pairs` (a, b), those whose full sets share at least `percent` of their union; texts by id from `docs`."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tokens.slices(batches, "text_b"):
            for k in range(0, part.num_rows, 512):
                some = part.slice(k, 512)
                uses, index = np.unique(some.column("a").to_numpy(), return_index=True)
                centre = dict(zip(uses, shingle_sets(some.column("text_a").take(pa.array(index)), n), strict=True))
                ok = []
                for a, y in zip(some.column("a").to_numpy(), shingle_sets(some.column("text_b"), n), strict=True):
                    x = centre[a]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    ok.append(100 * both >= percent * (len(x) + len(y) - both))
                yield pa.RecordBatch.from_arrays([some.column("a"), some.column("b"), pa.array(ok, pa.bool_())], ["a", "b", "linked"])

    texts = docs.select("doc_id", "text")
    found = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    found = found.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    return found.select("a", "b", "text_a", "text_b").mapInArrow(check, "a long, b long, linked boolean")


def prefix_pairs(rest: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Pairs a < b of `rest` (rep, comp) in different components, with all pairs that are similar enough among them.

    All sets are sorted by one order, the rarest shingles first. Two sets of sizes x and y that share `percent` of their
    union have their first common shingle among the first x - ceil(percent * x / 100) + 1 of the one, and likewise of the
    other, with enough shingles behind it in both. Shingles of one set alone count as places but need no lists.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tokens.slices(batches, "text"):
            sets = shingle_sets(part.column("text"), n)
            size = np.array([len(x) for x in sets], np.int32)
            columns = [np.repeat(part.column(c).to_numpy(), size) for c in ("rep", "comp")]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64)), *map(pa.array, columns), pa.array(np.repeat(size, size))], ["token", "rep", "comp", "size"])

    texts = docs.select(F.col("doc_id").alias("rep"), "text").join(rest, "rep").select("rep", "comp", "text")
    held = texts.mapInArrow(spread, "token long, rep long, comp long, size int")
    # `cross`: sets of several components have the shingle; without that it makes no pair
    often = held.groupBy("token").agg(F.count("*").alias("df"), F.min("comp").alias("c1"), F.max("comp").alias("c2")).where("df > 1").selectExpr("token", "df", "c1 != c2 as cross")
    sets = held.join(settled(often), "token").groupBy("rep", "comp", "size").agg(F.array_sort(F.collect_list(F.struct("df", "token", "cross"))).alias("list"))
    sets = sets.withColumn("alone", F.col("size") - F.size("list"))
    head = F.expr(f"size - cast(ceil({percent} * size / 100) as int) + 1 - alone")
    heads = sets.withColumn("head", head).where("head > 0").select("rep", "comp", "size", "alone", F.posexplode(F.slice("list", 1, F.col("head"))).alias("at", "x"))
    lists = heads.where("x.cross").select(F.col("x.token").alias("token"), "rep", "comp", "size", (F.col("size") - F.col("alone") - F.col("at")).alias("behind"))
    other = lists.toDF("token", "rep2", "comp2", "size2", "behind2")
    near = f"rep < rep2 and comp != comp2 and {100 + percent} * least(behind, behind2) >= {percent} * (size + size2) and 100 * least(size, size2) >= {percent} * greatest(size, size2)"
    return lists.join(other, "token").where(near).select(F.col("rep").alias("a"), F.col("rep2").alias("b")).distinct()


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """Rows doc_id, n_shingles, component_id, kept for `docs` (doc_id, text).

    Words are runs of characters other than space and tab to return, with A-Z lower-cased; a text's set are its distinct
    n-word shingles. Texts whose sets share `percent` of their union are linked, and component_id is the smallest doc_id
    reachable. A null or wordless text has an empty set and no links. doc_id is meant to be a key: rows that repeat it
    are returned as often as they come, and rows with a null id are left unlinked (component_id null, kept true). Ties
    can't arise. Columns other than doc_id and text are ignored. An empty table gives no rows.
    """
    marks = settled(signed(docs, n))
    linked = marks.where("n_shingles > 0 and doc_id is not null")
    # one class for each set; all rows of a class have the same keys, so any of them will do
    classes = settled(linked.groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.any_value("keys").alias("keys")))
    buckets = classes.select("rep", F.explode("keys").alias("key"))
    # a table of its own, so that Spark can split the task of a bucket that very many texts share
    many = buckets.groupBy("key").agg(F.min("rep").alias("centre"), F.count("*").alias("members")).where("members > 1").select("key", "centre")
    members = settled(buckets.join(settled(many), "key"))
    # only texts that share a bucket are looked at again
    some = stored(docs.select("doc_id", "text").join(members.select(F.col("rep").alias("doc_id")).distinct().hint("merge"), "doc_id", "left_semi"))
    star = members.where("rep != centre").select(F.col("centre").alias("a"), F.col("rep").alias("b")).distinct()
    found = settled(confirmed(star, some, n, percent))
    comp = components(found.where("linked"))
    placed = members.select("key", "rep").join(comp.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    split = placed.groupBy("key").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2")).where("c1 != c2").select("key")
    rest = settled(placed.join(settled(split), "key").select("rep", "comp").distinct())
    pairs = prefix_pairs(rest, some, n, percent).join(found.select("a", "b"), ["a", "b"], "left_anti")
    more = stored(confirmed(pairs, some, n, percent).where("linked"))  # no files for the many partitions without a row
    if not more.isEmpty():
        comp = components(found.where("linked").union(more))
    ids = classes.select("f1", "f2", "n_shingles", "rep").join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("f1", "f2", "n_shingles", F.coalesce("comp", "rep").alias("component_id"))
    out = marks.select("doc_id", "n_shingles", "f1", "f2").join(ids, ["f1", "f2", "n_shingles"], "left")
    own = F.when(F.col("doc_id").isNull() | (F.col("n_shingles") == 0), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op6(spark, sf_dir: str) -> DataFrame:
    """Components of all documents whose sets of four-word shingles share 80 percent; edge cases as in near_duplicates.

    The pipeline's stage takes five words, which near-duplicate stages take unless a contract says otherwise.
    """
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), n=4, percent=80)
