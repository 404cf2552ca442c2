"""Quality rules: a hashed n-gram log-likelihood ratio between trusted texts and the whole corpus, and base checks.

Unigrams and bigrams of words fall into a fixed number of buckets. Over all documents, Spark counts each bucket in
the trusted texts and in the corpus; the two smoothed multinomials give each bucket a weight. Only this vector of
fixed size passes the driver. A document's ratio is the mean weight of its n-grams; it is kept if that reaches a
fixed threshold. Weights are whole micro-nats, so sums are exact in any order. Built-in functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import table

BUCKETS = 1 << 15
SMOOTHING = 1.0
#: Mean weight of an n-gram, in micro-nats, from which a document is kept.
THRESHOLD = -70_000
SYMBOLS = "#*$%&|<>"
SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def _let(value: Column, body) -> Column:
    """`body` of a value that is computed once, however often `body` refers to it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def word_hashes(text: Column) -> Column:
    """A 64-bit hash of each word."""
    return F.transform(words_of(text), lambda w: F.xxhash64(w))


def ngram_buckets(hashes: Column, buckets: int = BUCKETS) -> Column:
    """The bucket of every unigram and bigram, from the hashes of the words."""
    return F.concat(
        F.transform(hashes, lambda h: F.pmod(h, F.lit(buckets)).cast("int")),
        F.transform(F.slice(hashes, 1, F.greatest(F.size(hashes) - 1, F.lit(0))), lambda h, i: F.pmod(F.xxhash64(h, F.get(hashes, i + 1)), F.lit(buckets)).cast("int")),
    )


def repeated_words(hashes: Column, window: int = 5) -> Column:
    """How many words lie in windows that are found twice or more in the text, the first included."""

    def covered(found: Column) -> Column:
        # found: hashes of windows with their places, sorted; equal neighbours are repeats
        last = F.size(found) - 1
        twice = F.filter(found, lambda x, i: F.when(i > 0, F.get(found, i - 1)["h"] == x["h"]).otherwise(False) | F.when(i < last, F.get(found, i + 1)["h"] == x["h"]).otherwise(False))
        places = F.array_sort(F.transform(twice, lambda x: x["p"]))
        start = F.struct(F.lit(-window).cast("int").alias("last"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(places, start, lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(p - a["last"], F.lit(window))).cast("long").alias("n")), lambda a: a["n"])

    windows = F.transform(
        F.slice(hashes, 1, F.greatest(F.size(hashes) - (window - 1), F.lit(0))), lambda h, i: F.xxhash64(h, *(F.get(hashes, i + k) for k in range(1, window)))
    )
    return _let(windows, lambda hs: F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0).cast("long")).otherwise(
        _let(F.sort_array(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("p")))), covered)))


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.translate(x, SPACES, "") != "")
    return _let(lines, lambda ls: (F.size(ls) - F.size(F.array_distinct(ls))).cast("long"))


def bucket_weights(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Micro-nats of each bucket: ln p(trusted) - ln p(corpus), counted over all of `docs` (doc_id, text).

    `trusted` has the ids of trusted documents. Without any, all weights are 0. The result has `buckets` numbers.
    """
    marks = trusted.select("doc_id").where(F.col("doc_id").isNotNull()).distinct().withColumn("_trusted", F.lit(1))
    # labels grow with the corpus, so they are never broadcast
    marked = docs.select("doc_id", "text").join(marks.hint("merge"), "doc_id", "left").select(F.coalesce("_trusted", F.lit(0)).alias("t"), word_hashes(F.col("text")).alias("hashes"))
    grams = marked.select("t", F.explode(ngram_buckets(F.col("hashes"), buckets)).alias("b"))
    rows = grams.groupBy("b").agg(F.count("*").alias("raw"), F.sum("t").alias("good")).collect()  # `buckets` rows at most
    raw, good = [0] * buckets, [0] * buckets
    for r in rows:
        raw[r["b"]], good[r["b"]] = r["raw"], r["good"]
    n, m, a = sum(raw), sum(good), SMOOTHING
    if not m:
        return [0] * buckets
    ratio = math.log((n + a * buckets) / (m + a * buckets))
    return [round(1e6 * (math.log((g + a) / (r + a)) + ratio)) for g, r in zip(good, raw, strict=True)]


def quality(docs: DataFrame, trusted: DataFrame, threshold: int = THRESHOLD, buckets: int = BUCKETS) -> DataFrame:
    """Adds the base figures, `ratio` (mean micro-nats an n-gram, 0 without words), base_failed and kept to `docs`.

    A null text has no words and fails the base check. Repeated rows are judged alike, each on its own; a null id is
    never trusted. An empty table stays empty. Input columns of these names are replaced, all others pass through.
    """
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "ratio", "base_failed", "kept"]
    weights = bucket_weights(docs, trusted, buckets)
    weight = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<int>")  # one constant for the whole plan
    text = F.coalesce("text", F.lit(""))

    def judged(hs: Column) -> Column:
        ratio = _let(ngram_buckets(hs, buckets), lambda bs: F.aggregate(bs, F.lit(0).cast("long"), lambda s, b: s + F.get(weight, b), lambda s: s / F.greatest(F.size(bs), F.lit(1))))
        found = F.struct(F.size(hs).cast("long").alias("n_words"), repeated_words(hs).alias("n_repeat_words"), ratio.alias("ratio"))

        def verdict(x: Column) -> Column:
            failed = (x["n_words"] < 10) | (100 * x["n_repeat_words"] > 20 * x["n_words"])
            return F.struct(x["n_words"].alias("n_words"), x["n_repeat_words"].alias("n_repeat_words"), x["ratio"].alias("ratio"), failed.alias("base_failed"), (~failed & (x["ratio"] >= threshold)).alias("kept"))

        return _let(found, verdict)

    # one expression for all that needs the words, so that a filter on `kept` computes it once
    out = docs.drop(*made).withColumn("_judged", _let(word_hashes(F.col("text")), judged))
    length = F.length(text)
    plain = {
        "word_chars": F.length(F.translate(text, SPACES, "")).cast("long"),
        "n_symbols": (length - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": duplicate_lines(F.col("text")),
    }
    return out.select(*[c for c in out.columns if c != "_judged"], *[plain[c].alias(c) if c in plain else F.col(f"_judged.{c}").alias(c) for c in made])


def trusted_ids(labels: DataFrame) -> DataFrame:
    return labels.where(F.col("quality") == 1).select("doc_id")


def op10(spark, sf_dir: str) -> DataFrame:
    """Figures and verdicts of all documents, one row for each, repeats included; edge cases as in quality."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality(docs, trusted_ids(table(spark, sf_dir, "labels")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio")
