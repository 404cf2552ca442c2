"""A reproducible global shuffle: a Feistel permutation with cycle walking over global row numbers.

Row numbers come from one range partitioning by id, in which every task numbers its own rows; only one count per
partition is summed up. The permutation needs no state, so any task can compute the shard and the slot of any row,
and its inverse gives the row that stands in a given slot.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import settled

ROUNDS = 6


def _half_bits(n: int) -> int:
    return max(1, (max(n - 1, 1).bit_length() + 1) // 2)


def _scramble(x: np.ndarray, key: int) -> np.ndarray:
    x = (x + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _network(x: np.ndarray, bits: int, seed: int, inverse: bool) -> np.ndarray:
    mask = np.uint64((1 << bits) - 1)
    left, right = x >> np.uint64(bits), x & mask
    keys = [(seed * 0x2545F491 + r * 0x9E3779B1 + 1) & 0xFFFFFFFFFFFF for r in range(ROUNDS)]
    if inverse:
        for key in reversed(keys):
            left, right = right ^ (_scramble(left, key) & mask), left
    else:
        for key in keys:
            left, right = right, left ^ (_scramble(right, key) & mask)
    return (left << np.uint64(bits)) | right


def permute(x: np.ndarray, n: int, seed: int, inverse: bool = False) -> np.ndarray:
    """The image of row numbers 0..n-1 under a permutation of 0..n-1; values out of range walk on until inside."""
    bits = _half_bits(n)
    y = _network(np.asarray(x).astype(np.uint64), bits, seed, inverse)
    out = np.flatnonzero(y >= np.uint64(n))
    while len(out):
        y[out] = _network(y[out], bits, seed, inverse)
        out = out[y[out] >= np.uint64(n)]
    return y.astype(np.int64)


def number_rows(df: DataFrame, order: list[str], partitions: int | None = None) -> tuple[DataFrame, int]:
    """Rows row, row_no: each row of `df` as a struct with its gapless number from 0 in the given order; and their count.

    The sorted rows are settled once; a row's number is its place in its partition plus the rows of all partitions
    before. The driver sees one count per partition. Columns may have any names, as they stay in the struct.
    """
    spark = df.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col("row")[c].asc_nulls_first() for c in order]
    rows = df.select(F.struct(*df.columns).alias("row"))
    laid = settled(rows.repartitionByRange(partitions, *keys).sortWithinPartitions(*keys))
    at = laid.withColumn("_at", F.monotonically_increasing_id())
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = at.groupBy(part.alias("_part")).count()
    before = counts.select("_part", (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_before"))
    total = counts.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    # one row for each partition of the sort, so the broadcast side is bounded by `partitions`
    out = at.withColumn("_part", part).join(F.broadcast(before), "_part")
    return out.select("row", (F.col("_before") + place).alias("row_no")), int(total)


def shard_rows(df: DataFrame, order: list[str], shards: int = 24, seed: int = 7) -> DataFrame:
    """Adds `shard` and `slot`: rows in `order` are shuffled by the permutation and dealt out like cards.

    Shard sizes differ by one row at most, slots are gapless from 0. The placing depends on the ranks of the rows
    under `order`, their number and the seed alone. Null ids sort first; rows that are equal in all of `order` are
    interchangeable; an empty table stays empty. Extra columns pass through, but for ones named `shard` or `slot`, which
    the new ones replace.
    """
    numbered, n = number_rows(df, order)

    @F.pandas_udf("long")
    def place(x: pd.Series) -> pd.Series:
        return pd.Series(permute(x.to_numpy(), n, seed))

    moved = numbered.select("row", place("row_no").alias("to"))
    kept = [F.col("row")[c].alias(c) for c in df.columns if c not in ("shard", "slot")]
    return moved.select(*kept, (F.col("to") % shards).cast("int").alias("shard"), F.floor(F.col("to") / shards).cast("long").alias("slot"))


def op7(spark, sf_dir: str) -> DataFrame:
    """Shards 0 to 23 over all documents by the `rows` law. A null text has size 8 and the checksum of no bytes."""
    from .tables import table

    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(raw) + 8).cast("long").alias("size"), F.crc32(raw).alias("text_crc32")
    )
    out = shard_rows(docs, ["doc_id", "text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _network_sql(source: str) -> str:
    """SQL of one pass of the network over `source` (pos, x, b, ...): rows with y, the image of x."""
    sql = f"SELECT *, x >> b AS l, x & m AS r FROM (SELECT *, (1::UBIGINT << b) - 1::UBIGINT AS m FROM {source})"
    for r in range(ROUNDS):
        key = (7 * 0x2545F491 + r * 0x9E3779B1 + 1) & 0xFFFFFFFFFFFF
        first = f"CAST((r::UHUGEINT + {key}::UHUGEINT) * {0x9E3779B97F4A7C15}::UHUGEINT % 18446744073709551616::UHUGEINT AS UBIGINT)"
        second = f"CAST(xor(s, s >> 29)::UHUGEINT * {0xBF58476D1CE4E5B9}::UHUGEINT % 18446744073709551616::UHUGEINT AS UBIGINT)"
        sql = f"SELECT * EXCLUDE (l, r, s, t), r AS l, xor(l, xor(t, t >> 32) & m) AS r FROM (SELECT *, {second} AS t FROM (SELECT *, {first} AS s FROM ({sql})))"
    return f"SELECT * EXCLUDE (l, r, m), (l << b) | r AS y FROM ({sql})"


#: The same law in SQL: ranks, the network with cycle walking as a recursion, and checksums byte by byte.
OP7_SQL = f"""WITH RECURSIVE tab AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c FROM range(256) r(i))),
raw AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 8 AS size, flatten(list_transform(list_transform(string_split(coalesce(text, ''), ''), lambda c: unicode(c)::BIGINT),
  lambda u: CASE WHEN u < 0 THEN [] WHEN u < 128 THEN [u] WHEN u < 2048 THEN [192 + (u >> 6), 128 + (u & 63)] WHEN u < 65536 THEN [224 + (u >> 12), 128 + ((u >> 6) & 63), 128 + (u & 63)]
    ELSE [240 + (u >> 18), 128 + ((u >> 12) & 63), 128 + ((u >> 6) & 63), 128 + (u & 63)] END)) AS bytes FROM documents),
d AS (SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS text_crc32 FROM raw, tab),
n AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS pos, count(*) OVER () AS n FROM d),
w AS (SELECT pos, n, y FROM ({_network_sql("(SELECT pos, n, pos::UBIGINT AS x, greatest(1, (floor(log2(greatest(n - 1, 1)))::INT + 2) // 2)::UBIGINT AS b FROM n)")})
  UNION ALL SELECT pos, n, y FROM ({_network_sql("(SELECT pos, n, y AS x, greatest(1, (floor(log2(greatest(n - 1, 1)))::INT + 2) // 2)::UBIGINT AS b FROM w WHERE y >= n)")}))
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(y % 24 AS INT) AS shard, CAST(y // 24 AS BIGINT) AS slot, NULL::INT AS grown_shard FROM n JOIN w USING (pos) WHERE y < w.n"""
