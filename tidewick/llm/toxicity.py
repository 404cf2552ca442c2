"""Toxicity by a factorization machine over hashed terms.

Terms are the words of a text and the beginnings of its longer words, hashed into a fixed number of buckets; a text has
a term or not. The machine scores a text by a bias, a weight for each term and, for each pair of terms, the product of
their factors, so an insult beside a mention of a group can weigh more than both alone. It is fitted on a bounded sample
of labelled rows; which buckets it uses is decided by how their shares differ between the sample's classes, counted in
Spark. All texts are then scored in one scan: the model is a table of fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .tables import settled, table

BUCKET_BITS = 20
PREFIXES = (4, 5, 6, 7, 8)
#: The sample: rows of each class at most, those with the smallest hashes of their ids.
TOXIC_ROWS, CLEAN_ROWS = 4_000, 8_000
#: Buckets of the model at most, texts that must have one, and standard deviations between its shares in the classes.
FEATURES, LEAST_TEXTS, LEAST_Z = 4_096, 3, 4.0
#: Buckets that are taken for being in many texts, whatever their shares: alone they tell nothing, a pair of them may.
FREQUENT = 128
FACTORS, STEPS, RATE, RIDGE = 8, 300, 0.05, 1e-4


def term_buckets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Text number and bucket of every term of a slice of texts, repeats included."""
    words = tokens.Words(column, tokens.PUNCTUATION, prefixes=PREFIXES)
    text = np.repeat(np.arange(len(column)), np.diff(words.bounds))
    hashes, texts = [words.hashes], [text]
    for at, prefix in words.prefixes.values():
        hashes.append(prefix)
        texts.append(text[at])
    return np.concatenate(texts), (np.concatenate(hashes) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


@dataclass
class Machine:
    bias: float
    buckets: np.ndarray
    weights: np.ndarray
    factors: np.ndarray

    def scores(self, text: np.ndarray, bucket: np.ndarray, texts: int) -> np.ndarray:
        """Probabilities of `texts` texts, from the texts and buckets of their terms."""
        slot = np.zeros(1 << BUCKET_BITS, np.int32)
        slot[self.buckets] = np.arange(1, len(self.buckets) + 1)
        index = slot[bucket]
        used = np.flatnonzero(index)
        pairs = np.unique(text[used] * np.int64(len(self.buckets) + 1) + index[used])
        of, term = np.divmod(pairs, np.int64(len(self.buckets) + 1))
        return 1 / (1 + np.exp(-np.clip(self.margin(of, term - 1, texts)[0], -30, 30)))

    def margin(self, of: np.ndarray, term: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
        total, squares = np.zeros((texts, self.factors.shape[1])), np.zeros(texts)
        for k in range(self.factors.shape[1]):  # one factor at a time keeps little in memory
            v = self.factors[term, k]
            total[:, k] = np.bincount(of, v, texts)
            squares += np.bincount(of, v * v, texts)
        return self.bias + np.bincount(of, self.weights[term], texts) + 0.5 * ((total * total).sum(axis=1) - squares), total


def fit(terms: list[np.ndarray], toxic: np.ndarray) -> Machine:
    """A machine for texts with the given distinct buckets; without both classes it knows the bias alone."""
    n, ones = len(toxic), int(toxic.sum())
    bias = float(np.log((ones + 0.5) / (n - ones + 0.5)))
    nothing = Machine(bias, np.zeros(0, np.int64), np.zeros(0), np.zeros((0, FACTORS)))
    if not 0 < ones < n:
        return nothing
    of, bucket = np.repeat(np.arange(n), [len(t) for t in terms]), np.concatenate(terms).astype(np.int64)
    size = 1 << BUCKET_BITS
    every, bad = np.bincount(bucket, minlength=size), np.bincount(bucket[toxic[of] == 1], minlength=size)
    share = every / n
    z = (bad / ones - (every - bad) / (n - ones)) / np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / ones + 1 / (n - ones)))
    z[every < LEAST_TEXTS] = 0
    chosen = np.argsort(-np.abs(z), kind="stable")[:FEATURES]
    chosen = np.sort(chosen[np.abs(z[chosen]) >= LEAST_Z])
    common = np.argsort(-every, kind="stable")[:FREQUENT]
    chosen = np.union1d(chosen, common[every[common] >= LEAST_TEXTS])
    if not len(chosen):
        return nothing
    slot = np.full(size, -1)
    slot[chosen] = np.arange(len(chosen))
    used = slot[bucket] >= 0
    of, term = of[used], slot[bucket[used]]
    machine = Machine(bias, chosen, np.zeros(len(chosen)), np.random.Generator(np.random.PCG64(3)).normal(0, 0.05, (len(chosen), FACTORS)))
    weight = np.where(toxic == 1, 0.5 / ones, 0.5 / (n - ones))
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (np.zeros(1), machine.weights, machine.factors)]
    for step in range(1, STEPS + 1):
        margin, total = machine.margin(of, term, n)
        gap = weight * (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - toxic)
        g = gap[of]
        grads = (
            np.array([gap.sum()]), np.bincount(term, g, len(chosen)) + RIDGE * machine.weights,
            np.column_stack([np.bincount(term, g * (total[of, k] - machine.factors[term, k]), len(chosen)) for k in range(FACTORS)]) + RIDGE * machine.factors,
        )
        moves = []
        for grad, s in zip(grads, state, strict=True):  # Adam
            s[0], s[1] = 0.9 * s[0] + 0.1 * grad, 0.999 * s[1] + 0.001 * grad * grad
            moves.append(RATE * (s[0] / (1 - 0.9**step)) / (np.sqrt(s[1] / (1 - 0.999**step)) + 1e-8))
        machine.bias -= float(moves[0][0])
        machine.weights = machine.weights - moves[1]
        machine.factors = machine.factors - moves[2]
    return machine


def held_out(doc_id) -> F.Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def train(docs: DataFrame, labels: DataFrame) -> Machine:
    """A machine fitted to at most TOXIC_ROWS + CLEAN_ROWS labelled ids of `docs` that aren't held out.

    Of an id's labels the largest counts; null labels and ids count for nothing; of the documents that repeat an id the one
    with the smallest hash of its text counts, so an id that very many rows have weighs no more than others.
    Without both classes, or in empty tables, the machine knows the bias alone. A term that is as frequent among toxic as
    among other texts is taken if it is one of the sample's FREQUENT most frequent ones, as a pair with it may tell.
    """
    marks = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    marks = marks.where(~held_out(F.col("doc_id"))).withColumn("_order", F.xxhash64("doc_id", F.lit(1)))
    some = marks.where("toxic = 1").orderBy("_order", "doc_id").limit(TOXIC_ROWS).unionByName(marks.where("toxic = 0").orderBy("_order", "doc_id").limit(CLEAN_ROWS))

    def featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tokens.slices(batches, "text"):
            text, bucket = term_buckets(part.column("text"))
            pairs = np.unique((text << BUCKET_BITS) | bucket)
            bounds = np.searchsorted(pairs >> BUCKET_BITS, np.arange(part.num_rows + 1)).astype(np.int32)
            terms = pa.array((pairs & ((1 << BUCKET_BITS) - 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("mark"), pa.ListArray.from_arrays(pa.array(bounds), terms), part.column("toxic")], ["doc_id", "mark", "terms", "toxic"])

    # the sample's size is bounded by its parameters; its terms are counted in Spark, so that only those stand out come here
    rows = docs.select("doc_id", "text").join(F.broadcast(some.select("doc_id", "toxic")), "doc_id").select("doc_id", "text", "toxic", F.xxhash64("text").alias("mark"))
    # one text for each id, so that rows are bounded as ids are; all but one of an id's rows go before the shuffle
    first = rows.mapInArrow(featurize, "doc_id long, mark long, terms array<int>, toxic int").groupBy("doc_id").agg(F.min(F.struct("mark", "terms", "toxic")).alias("x"))
    sample = settled(first.select("doc_id", "x.terms", "x.toxic"))
    n, ones = sample.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not 0 < ones < n:
        return fit([np.zeros(0, np.int64)] * n, np.repeat([1, 0], [ones, n - ones]))
    bad, share = F.col("bad"), F.col("every") / n
    z = (bad / ones - (F.col("every") - bad) / (n - ones)) / F.sqrt(F.greatest(share * (1 - share), F.lit(1e-12)) * (1 / ones + 1 / (n - ones)))
    counted = sample.select("toxic", F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("every"), F.sum("toxic").alias("bad")).where(F.col("every") >= LEAST_TEXTS)
    # a few more than the machine takes, so that it decides ties itself; FEATURES and FREQUENT bound them
    stands_out = counted.withColumn("z", F.abs(z)).where(F.col("z") >= LEAST_Z - 0.01).orderBy(F.desc("z"), "term").limit(FEATURES + 1_000)
    common = counted.orderBy(F.desc("every"), "term").limit(FREQUENT)
    telling = np.array([r["term"] for r in stands_out.select("term").union(common.select("term")).distinct().collect()], np.int32)

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [t[np.isin(t, telling)] for t in (np.asarray(x.values) for x in batch.column("terms"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(terms, pa.list_(pa.int32())), batch.column("toxic")], ["doc_id", "terms", "toxic"])

    few = sample.mapInArrow(narrow, "doc_id long, terms array<int>, toxic int").toArrow().sort_by("doc_id")
    return fit([np.asarray(t.values).astype(np.int64) for t in few.column("terms")], few.column("toxic").to_numpy())


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """Rows doc_id, score for `docs` (doc_id, text), one for each row. Null and empty texts get the bias alone."""
    side = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tokens.slices(batches, "text"):
            text, bucket = term_buckets(part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(side.value.scores(text, bucket, part.num_rows))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def op3(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents, one for each row, repeats included; nulls and empty texts as in train and score."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
