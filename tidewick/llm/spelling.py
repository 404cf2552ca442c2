"""Spelling variants: words at one edit from each other, and for each word the common form that it may be a slip of.

Each word generates the edits that lead from it to a word it could be a neighbour of: all deletions, and replacements by
a later symbol, so that no pair comes up twice. Edits are probed against blocked Bloom filters of the vocabulary, one
for each word length; what a filter lets through, a few wrong ones included, goes to a join with the vocabulary itself.
Filters are built by Spark in slices, and broadcast in passes of bounded size: a larger vocabulary takes more passes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .tables import Scratch, table

#: The symbols of words: a to z and U+00C0 to U+00FF; those of runs in a text: A to Z too.
ALPHABET = "".join(map(chr, [*range(97, 123), *range(0xC0, 0x100)]))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Shortest word, fewest occurrences, and how many times as frequent as the word its form is.
LENGTH, COUNT, TIMES = 7, 2, 10
#: One of so many runs loses a code point.
SLIP = 31

#: Bits of a filter for each word of its length and bits that a word sets, all of them in one block of 512.
BITS, HASHES = 24, 5
#: Words from this length on share one filter.
LONG = 64
#: Blocks of a slice (64 bytes each), and bytes of all filters that are broadcast in one pass.
SLICE_BLOCKS, PASS_BYTES = 256, 32 << 20
#: Numbers in one array of a probing task.
CHUNK = 1 << 18

_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)
_BACK = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LENGTHS = 0xC2B2AE3D27D4EB4F


def vocabulary(docs: DataFrame, length: int = LENGTH, count: int = COUNT) -> DataFrame:
    """Rows word, n: the runs of letters in all texts, some with a code point deleted, of at least `length` and `count`.

    Only A to Z are lower-cased. The checksum of `<doc_id>:<run>` decides whether and where a run loses a code point. A
    null text has no words, a null doc_id counts as an empty one; repeated rows count each time. Counts are added up
    before the shuffle, so a frequent word is one row of each task.
    """
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all("text", F.lit(f"[A-Za-z\\u00C0-\\u00FF]{{{length},}}"), F.lit(0))).alias("run"))
    low = runs.select("id", F.translate("run", UPPER, LOWER).alias("run"))
    h = low.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = h.select(F.when(F.col("h") % SLIP == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= count)


class Alphabet:
    """Hashes of words over these symbols, each a sum over their places, so that an edit's hash takes one step."""

    def __init__(self, symbols: str):
        self.codes = np.sort(np.frombuffer(symbols.encode("utf-32-le"), "<u4"))
        self.values = np.random.Generator(np.random.PCG64(20250211)).integers(1, 2**63, len(self.codes), dtype=np.uint64) * _U(2) + _U(1)

    def symbols(self, words: list[str], length: int) -> np.ndarray:
        return np.searchsorted(self.codes, np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), length))

    def hashes(self, words: list[str]) -> np.ndarray:
        out = np.zeros(len(words), np.uint64)
        for length, at in by_length(words):
            some = self.symbols([words[i] for i in at], length)
            out[at] = _ended((self.values[some] * _powers(length)).sum(axis=1, dtype=np.uint64), length)
        return out


def _powers(length: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(length - 1, _STEP)]))


def _ended(sums: np.ndarray, length: int) -> np.ndarray:
    return tokens.mix(sums + _U(length * _LENGTHS % 2**64))


def by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    """The places of words of each length, in pieces that fit into one array of CHUNK numbers (one word at least)."""
    lengths = np.array([len(w) for w in words], np.int64)
    for length in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == length)
        for k in range(0, len(at), max(1, CHUNK // length)):
            yield length, at[k : k + max(1, CHUNK // length)]


class Filter:
    """Blocks `first` to `end` of a Bloom filter that has `blocks` of them."""

    def __init__(self, blocks: int, first: int, end: int):
        self.blocks, self.first, self.end = blocks, first, end
        self.words = np.zeros((end - first) * 8, np.uint64)

    def block(self, h: np.ndarray) -> np.ndarray:
        return ((h >> _U(32)) * _U(self.blocks) >> _U(32)).astype(np.int64)

    def add(self, h: np.ndarray) -> None:
        base = (self.block(h) - self.first) * 8
        for k in range(HASHES):
            bits = (h >> _U(9 * k)) & _U(511)
            np.bitwise_or.at(self.words, base + (bits >> _U(6)).astype(np.int64), _U(1) << (bits & _U(63)))

    def among(self, h: np.ndarray) -> np.ndarray:
        """The places of hashes that may be in it."""
        block = self.block(h)
        at = np.flatnonzero((block >= self.first) & (block < self.end))
        for k in range(HASHES):
            bits = (h[at] >> _U(9 * k)) & _U(511)
            word = self.words[(block[at] - self.first) * 8 + (bits >> _U(6)).astype(np.int64)]
            at = at[(word >> (bits & _U(63))) & _U(1) == 1]
        return at


def shard(length: int) -> int:
    return min(length, LONG)


def edits(words: list[str], alphabet: Alphabet, filters: dict[int, Filter]) -> Iterator[tuple[int, str]]:
    """Places of words and edits of theirs that the filters let through, each edit once."""
    for length, at in by_length(words):
        some = [words[i] for i in at]
        own, shorter = filters.get(shard(length)), filters.get(shard(length - 1))
        if own is None and shorter is None:
            continue
        symbols, powers = alphabet.symbols(some, length), _powers(length)
        parts = alphabet.values[symbols] * powers
        upto = np.cumsum(parts, axis=1, dtype=np.uint64)
        total = upto[:, -1:]
        if shorter is not None and length > 1:
            h = _ended(upto - parts + (total - upto) * _BACK, length - 1)
            new = np.ones(symbols.shape, bool)  # a run of one symbol loses any of them
            new[:, 1:] = symbols[:, 1:] != symbols[:, :-1]
            row, place = np.nonzero(new)
            for k in shorter.among(h[row, place]).tolist():
                w, i = some[row[k]], place[k]
                yield int(at[row[k]]), w[:i] + w[i + 1 :]
        for s in range(1, len(alphabet.codes)) if own is not None else ():
            row, place = np.nonzero(symbols < s)
            h = _ended(total[row, 0] + (alphabet.values[s] - alphabet.values[symbols[row, place]]) * powers[place], length)
            for k in own.among(h).tolist():
                w, i = some[row[k]], place[k]
                yield int(at[row[k]]), w[:i] + chr(alphabet.codes[s]) + w[i + 1 :]


def _slices(words: DataFrame, alphabet: Alphabet, blocks: dict[int, int]) -> DataFrame:
    """Rows shard, slice, bits: the filters of all lengths, in pieces of SLICE_BLOCKS blocks."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = batch.column(0).to_pylist()
            h = alphabet.hashes(some)
            shards = np.array([shard(len(w)) for w in some], np.int32)
            size = np.array([blocks[s] for s in shards.tolist()], np.uint64)
            piece = ((h >> _U(32)) * size >> _U(32)).astype(np.int64) // SLICE_BLOCKS
            yield pa.RecordBatch.from_arrays([pa.array(shards), pa.array(piece), pa.array(h.view(np.int64))], ["shard", "slice", "h"])

    def built(piece: pa.Table) -> pa.Table:
        s, k = piece.column("shard")[0].as_py(), piece.column("slice")[0].as_py()
        own = Filter(blocks[s], k * SLICE_BLOCKS, min(blocks[s], (k + 1) * SLICE_BLOCKS))
        own.add(piece.column("h").to_numpy().view(np.uint64))
        return pa.table({"shard": pa.array([s], pa.int32()), "slice": pa.array([k], pa.int64()), "bits": pa.array([own.words.tobytes()], pa.binary())})

    return words.select("word").mapInArrow(hashed, "shard int, slice long, h long").groupBy("shard", "slice").applyInArrow(built, "shard int, slice long, bits binary")


def passes(blocks: dict[int, int], most: int) -> list[list[tuple[int, int, int]]]:
    """Shards and their slices a to b, without b, in groups of at most `most` bytes (one slice at least)."""
    out: list[list[tuple[int, int, int]]] = []
    room = 0
    for s, n in sorted(blocks.items()):
        for k in range(-(-n // SLICE_BLOCKS)):
            size = 64 * min(SLICE_BLOCKS, n - k * SLICE_BLOCKS)
            if size > room:
                out.append([])
                room = max(most, size)
            if out[-1] and out[-1][-1][0] == s:
                out[-1][-1] = (s, out[-1][-1][1], k + 1)
            else:
                out[-1].append((s, k, k + 1))
            room -= size
    return out


def near_pairs(words: DataFrame, symbols: str = ALPHABET, most: int = PASS_BYTES, keep: Scratch | None = None) -> DataFrame:
    """Rows word, n, other, other_n: each pair of different words at one edit once. `words`: word (distinct, not null), n.

    Words are made of `symbols`. The driver sees one count for each length (LONG at most) and, pass by pass, filters of
    at most `most` bytes. A pass reads only words of lengths that its filters can concern.
    """
    spark, alphabet = words.sparkSession, Alphabet(symbols)
    keep = keep or Scratch(spark)
    counts = words.groupBy(F.least(F.length("word"), F.lit(LONG)).alias("shard")).agg(F.count("*").alias("n")).collect()
    blocks = {r["shard"]: -(-r["n"] * BITS // 512) for r in counts}
    built = keep(_slices(words, alphabet, blocks))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), sum(r["n"] for r in counts) // 50_000)
    kinds = {f.name: f.dataType for f in words.schema}

    def probing(filters):
        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                some = batch.column(0).to_pylist()
                found = list(edits(some, alphabet, filters.value))
                at = pa.array([i for i, _ in found], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array([e for _, e in found], pa.string())], ["word", "n", "edit"])

        return probe

    found = None
    for own in passes(blocks, most):
        filters = {s: Filter(blocks[s], a * SLICE_BLOCKS, min(blocks[s], b * SLICE_BLOCKS)) for s, a, b in own}
        wanted = " or ".join(f"(shard = {s} and slice >= {a} and slice < {b})" for s, a, b in own)
        for r in built.where(wanted).toLocalIterator():  # as many bytes as the filters
            bits = np.frombuffer(r["bits"], np.uint64)
            at = (r["slice"] * SLICE_BLOCKS - filters[r["shard"]].first) * 8
            filters[r["shard"]].words[at : at + len(bits)] = bits
        sent = spark.sparkContext.broadcast(filters)
        lengths = F.least(F.length("word"), F.lit(LONG)).isin([*filters]) | F.least(F.length("word") - 1, F.lit(LONG)).isin([*filters])
        some = words.select("word", "n").where(lengths).repartition(parts, "word")
        hits = keep(some.mapInArrow(probing(sent), f"word string, n {kinds['n'].simpleString()}, edit string"))
        sent.destroy()
        found = hits if found is None else found.union(hits)
    if found is None:
        return words.select("word", "n", F.col("word").alias("other"), F.col("n").alias("other_n")).where("false")
    return found.join(words.select(F.col("word").alias("edit"), F.col("n").alias("other_n")), "edit").select("word", "n", F.col("edit").alias("other"), "other_n")


def variants(words: DataFrame, symbols: str = ALPHABET, times: int = TIMES, most: int = PASS_BYTES) -> DataFrame:
    """Rows word, form, root, n, n_near, form_n for `words` (word, n): distinct words over `symbols` and their counts.

    A word's form is its most frequent near word (equal counts: the smallest by code points) if that is at least `times`
    as frequent; root follows forms to the last one. Words with no near word have n_near 0 and are their own root. Other
    columns are ignored; an empty table gives no rows. `times` of 2 or more makes chains of forms end.
    """
    keep = Scratch(words.sparkSession)
    words = keep(words.select("word", F.col("n").cast("long").alias("n")))
    pairs = keep(near_pairs(words, symbols, most, keep))
    one = lambda a, b, n: F.struct(F.col(a).alias("word"), F.lit(None).cast("long").alias("n"), F.struct((-F.col(n)).alias("less"), F.col(b).alias("form")).alias("near"))
    both = pairs.select(F.inline(F.array(one("word", "other", "other_n"), one("other", "word", "n"))))
    every = both.union(words.select("word", "n", F.lit(None).cast(both.schema["near"].dataType)))
    best = every.groupBy("word").agg(F.max("n").alias("n"), F.count("near").alias("n_near"), F.min("near").alias("best"))
    formed = -F.col("best.less") >= times * F.col("n")
    judged = keep(best.select("word", "n", "n_near", F.when(formed, F.col("best.form")).alias("form"), F.when(formed, -F.col("best.less")).alias("form_n")))
    jump = judged.where("form is not null").select("word", F.col("form").alias("root"))
    while True:  # each round doubles the steps that a root is away
        further = jump.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = keep(jump.join(further, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")))
        jump = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            break
    return judged.join(jump, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12(spark, sf_dir: str) -> DataFrame:
    """Variants among the words of all documents; nulls, repeats and empty tables as in vocabulary and variants."""
    return variants(vocabulary(table(spark, sf_dir, "documents")))


#: Words that share what is left without one place, or of which one is what is left of the other.
OP12_SQL = f"""WITH RECURSIVE tab AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c FROM range(256) r(i))),
run AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]{{{LENGTH},}}')), '{UPPER}', '{LOWER}') AS run FROM documents),
h AS (SELECT run, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(id || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195::BIGINT, unicode(c)::BIGINT - 64] END))),
  lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS h FROM run, tab),
v AS (SELECT word, count(*) AS n FROM (SELECT CASE WHEN h % {SLIP} = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word FROM h) WHERE length(word) >= {LENGTH} GROUP BY word HAVING count(*) >= {COUNT}),
rest AS (SELECT word, i, substr(word, 1, CAST(i AS INT) - 1) || substr(word, CAST(i AS INT) + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v)),
near AS (SELECT a.word, b.word AS other FROM rest a JOIN rest b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT rest.word, v.word FROM rest JOIN v ON v.word = rest.rest UNION SELECT v.word, rest.word FROM rest JOIN v ON v.word = rest.rest),
best AS (SELECT near.word, other, n, count(*) OVER (PARTITION BY near.word) AS n_near FROM near JOIN v ON v.word = other QUALIFY row_number() OVER (PARTITION BY near.word ORDER BY n DESC, other) = 1),
form AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN b.n >= {TIMES} * v.n THEN other END AS form, CASE WHEN b.n >= {TIMES} * v.n THEN b.n END AS form_n FROM v LEFT JOIN best b ON b.word = v.word),
walk AS (SELECT word, word AS at FROM form UNION ALL SELECT w.word, f.form FROM walk w JOIN form f ON f.word = w.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, w.at AS root, f.n, f.n_near, f.form_n FROM form f JOIN walk w ON w.word = f.word JOIN form e ON e.word = w.at WHERE e.form IS NULL"""
