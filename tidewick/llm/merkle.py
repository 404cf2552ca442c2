"""A Merkle manifest of a table: one digest for all rows, and for each row the siblings that lead from it to that digest.

Nodes are numbered within their group by one range sort. A node's number, written with ARITY as its base, gives a column
for each digit. A block is ARITY ** DIGITS consecutive nodes; within it the digits are grouped away one after the
other, the last first, so that each group is a run of siblings and becomes one struct with its digest and its children.
All of this is local to a block's partition. A block's digest is a node of the tier above, of which there are few; the
digests of the last tier are those of the groups, which are the nodes of one more tree of the same kind. On the way back
every block gets the path above it, a nested transform hands paths down to its children, and an explode emits them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import Scratch, table

ARITY, DIGITS = 3, 6
#: Siblings on the way to the root: digests to the left of the own one and to the right of it, concatenated.
PATH = "array<struct<left: string, right: string>>"


def leaf(columns: list[str | Column]) -> Column:
    """sha256 of all columns: `-` for a null, else the byte count of its text, a colon and the text."""
    texts = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns]
    return F.sha2(F.concat(*[F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)) for c in texts]), 256)


def folded(digest: Column, path: Column) -> Column:
    """What a leaf and its siblings come to: the root, if neither has changed."""
    return F.aggregate(path, digest, lambda own, s: F.sha2(F.concat(s["left"], own, s["right"]), 256))


def proof_digest(path: Column) -> Column:
    """sha256 of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def ranked(rows: DataFrame, group: str, order: list[str], keep: Scratch) -> DataFrame:
    """`rows` with `rank`, their numbers from 0 within each group in the given order; nulls come first.

    A task numbers what it has of each group. Only the first group of a partition can have begun in an earlier one, so
    what is added to numbers is one row for each partition at most.
    """
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c).asc_nulls_first() for c in [group, *order]]
    laid = rows.repartitionByRange(partitions, *keys).sortWithinPartitions(*keys)
    at = laid.columns.index(group)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last = TaskContext.get().partitionId(), None
        for batch in batches:
            if not batch.num_rows:
                continue
            runs = pc.run_end_encode(batch.column(at))
            ends, values = np.asarray(runs.run_ends), runs.values.to_pylist()
            starts = np.concatenate([[0], ends[:-1]])
            place = np.arange(batch.num_rows) - np.repeat(starts, ends - starts)
            if last and values[0] == last[0]:
                place[: ends[0]] += last[1]
            last = values[-1], int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(place)], [*batch.schema.names, "_part", "_place"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in laid.schema)
    numbered = keep(laid.mapInArrow(number, f"{kinds}, _part int, _place long"))
    counts = numbered.groupBy(group, "_part").agg((F.max("_place") + 1).alias("n"))
    before = F.sum("n").over(Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    begun = counts.select(F.col(group).alias("_group"), F.col("_part").alias("_in"), before.alias("_before")).where("_before > 0")
    # one row for each partition of the sort at most, so the broadcast side is bounded by their number
    out = numbered.join(F.broadcast(begun), (F.col("_part") == F.col("_in")) & F.col(group).eqNullSafe(F.col("_group")), "left")
    return out.select(*rows.columns, (F.col("_place") + F.coalesce("_before", F.lit(0))).alias("rank"))


def rollup(nodes: DataFrame, payload: list[str], size: int = DIGITS) -> DataFrame:
    """Nodes (group, rank, digest and `payload`) in blocks of ARITY ** size: rows group, block, digest, run, passes.

    `run` is the last run of siblings with all that is below, `passes` is true where there is a single node left in its
    whole level, which stays as it is. Such a node is the first one and has no sibling, which its block can tell alone.
    """
    digits = [f"_d{k}" for k in range(size)]
    place = [F.expr(f"cast((rank div {ARITY**k}) % {ARITY} as int)").alias(d) for k, d in enumerate(digits)]
    rows = nodes.select("group", F.expr(f"rank div {ARITY**size}").alias("block"), *place, F.struct("digest", *payload).alias("node"))
    rows = rows.repartition(F.col("group"), F.col("block"))
    for k, digit in enumerate(digits):
        upper = digits[k + 1 :]
        run = F.sort_array(F.collect_list(F.struct(digit, "node")))
        rows = rows.groupBy("group", "block", *upper).agg(run.alias("run"))
        rows = rows.withColumn("run", F.transform("run", lambda x: x["node"]))
        first = reduce(lambda a, b: a & b, [F.col(c) == 0 for c in ["block", *upper]])
        rows = rows.withColumn("passes", first & (F.size("run") == 1))
        joined = F.sha2(F.array_join(F.transform("run", lambda x: x["digest"]), ""), 256)
        rows = rows.withColumn("digest", F.when(F.col("passes"), F.get("run", F.lit(0))["digest"]).otherwise(joined))
        rows = rows.select("group", "block", *upper, F.struct("digest", "run", "passes").alias("node"))
    return rows.select("group", "block", "node.*")


def _unfolded(run: Column, passes: Column, above: Column, payload: list[str], level: int) -> Column:
    """All nodes below a run as an array of structs: digest, payload and the path from there to the root."""

    def each(x: Column, i: Column) -> Column:
        beside = lambda some: F.array_join(F.transform(some, lambda y: y["digest"]), "")
        step = F.struct(beside(F.slice(run, F.lit(1), i)).alias("left"), beside(F.slice(run, i + 2, F.lit(ARITY))).alias("right"))
        path = F.concat(F.when(passes, F.array().cast(PATH)).otherwise(F.array(step)), above)
        if level == 0:
            return F.struct(*[x[c].alias(c) for c in ("digest", *payload)], path.alias("path"))
        return _unfolded(x["run"], x["passes"], path, payload, level - 1)

    inner = F.transform(run, each)
    return inner if level == 0 else F.flatten(inner)


def _climb(nodes: DataFrame, payload: list[str], size: int, keep: Scratch) -> list[DataFrame]:
    """The blocks of all tiers, the nodes' own first; the last tier has one block for each group."""
    tiers = [keep(rollup(nodes, payload, size))]
    while not tiers[-1].where("block > 0").isEmpty():
        tiers.append(keep(rollup(tiers[-1].select("group", F.col("block").alias("rank"), "digest"), ["rank"], size)))
    return tiers


def _descend(tiers: list[DataFrame], payload: list[str], size: int, top: DataFrame) -> DataFrame:
    """Rows group, top, digest, payload, path. `top` has group, path and a struct `top` for each group.

    A block and the path above it meet in one group of two rows.
    """
    above = top.select("group", F.lit(0).cast("long").alias("block"), "path", "top")
    for k, blocks in reversed(list(enumerate(tiers))):
        kinds, own = dict(above.dtypes), dict(blocks.dtypes)
        tree = blocks.select("group", "block", "run", "passes", F.lit(None).cast(kinds["path"]).alias("path"), F.lit(None).cast(kinds["top"]).alias("top"))
        paths = above.select("group", "block", F.lit(None).cast(own["run"]).alias("run"), F.lit(None).cast("boolean").alias("passes"), "path", "top")
        both = tree.union(paths).groupBy("group", "block").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("run", "passes", "path", "top")])
        names = payload if k == 0 else ["rank"]
        out = both.select("group", "top", F.inline(_unfolded(F.col("run"), F.col("passes"), F.col("path"), names, size - 1)))
        above = out if k == 0 else out.select("group", F.col("rank").alias("block"), "path", "top")
    return above


def manifest(rows: DataFrame, columns: list[str], group: str, key: str, payload: list[str] | None = None, digits: int = DIGITS) -> DataFrame:
    """One row for each of `rows`: `group`, `key`, `payload`, leaf, subroot, root and path.

    Leaves cover `columns`; within a group they ascend by `key` (nulls first, equal keys by their leaves, so that equal
    rows are interchangeable), groups ascend by their bytes (null first; it is a group like any other). Every ARITY
    nodes of a level become one, the last run may be shorter; a level of one node is the end. Other columns are
    ignored. An empty table gives no rows. A group may hold any share of all rows: no task needs more than a block of it, of
    ARITY ** digits leaves, in memory.
    """
    names = [key, *(payload or [])]
    keep = Scratch(rows.sparkSession)
    leaves = keep(rows.select(F.col(group).alias("group"), F.struct(*names).alias("own"), leaf(columns).alias("digest"), F.col(key).alias("_key")))
    tiers = _climb(ranked(leaves, "group", ["_key", "digest"], keep), ["own"], digits, keep)
    groups = tiers[-1].select(F.lit(0).alias("group"), F.col("group").alias("name"), "digest")
    over = _climb(ranked(groups, "group", ["name"], keep), ["name"], digits, keep)
    root = over[-1].select("digest").first()  # a single row
    summit = rows.sparkSession.range(1 if root else 0).select(F.lit(0).alias("group"), F.array().cast(PATH).alias("path"), F.lit(None).cast("string").alias("top"))
    tops = keep(_descend(over, ["name"], digits, summit)).select(F.col("name").alias("group"), "path", F.col("digest").alias("top"))
    out = _descend(tiers, ["own"], digits, tops)
    return out.select(F.col("group").alias(group), "own.*", F.col("digest").alias("leaf"), F.col("top").alias("subroot"), F.lit(root.digest if root else None).cast("string").alias("root"), "path")


COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def op11(spark, sf_dir: str) -> DataFrame:
    """The manifest of all documents by source, each checked again with the line breaks of every second text deleted.

    Nulls, ties, repeats, extra columns and empty tables as in manifest; a null doc_id's decimal text is empty here.
    """
    docs = table(spark, sf_dir, "documents")
    chosen = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 2 == 0
    cut = F.when(chosen, F.translate("text", "\n", "")).otherwise(F.col("text"))
    rows = docs.select(*COLUMNS, F.when(chosen & F.contains("text", F.lit("\n")), leaf([cut if c == "text" else c for c in COLUMNS])).alias("tampered"))
    found = manifest(rows, COLUMNS, "source", "doc_id", ["tampered"])
    again = folded(F.coalesce("tampered", "leaf"), F.col("path"))
    out = found.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), again.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


#: The tree as a recursion over levels; the checksum of a decimal number from its table of 256 remainders.
OP11_SQL = """WITH RECURSIVE tab AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c FROM range(256) r(i))),
d AS (SELECT *, replace(text, chr(10), '') AS cut, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(doc_id::VARCHAR, ''), ''), lambda x: ascii(x)::BIGINT)),
  lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 2 = 0 AS chosen FROM documents, tab),
f AS (SELECT *, coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-') || coalesce(octet_length(encode(lang)) || ':' || lang, '-')
  || coalesce(octet_length(encode(n_chars::VARCHAR)) || ':' || n_chars, '-') AS head FROM d),
l AS (SELECT source, doc_id, leaf, tampered, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank, count(*) OVER (PARTITION BY source) AS n FROM (
  SELECT source, doc_id, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf, sha256(head || CASE WHEN chosen THEN coalesce(octet_length(encode(cut)) || ':' || cut, '-') ELSE coalesce(octet_length(encode(text)) || ':' || text, '-') END) AS tampered FROM f)),
low AS (SELECT source, 0 AS level, rank, n, leaf AS digest FROM l
  UNION ALL SELECT source, level + 1, rank // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY rank)) FROM low WHERE n > 1 GROUP BY source, level, n, rank // 3),
s AS (SELECT source, digest AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS rank, count(*) OVER () AS n FROM low WHERE n = 1),
high AS (SELECT 0 AS level, rank, n, subroot AS digest FROM s
  UNION ALL SELECT level + 1, rank // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY rank)) FROM high WHERE n > 1 GROUP BY level, n, rank // 3),
steps AS (SELECT l.source, l.rank AS own, w.level, coalesce(string_agg(w.digest, '' ORDER BY w.rank) FILTER (w.rank < l.rank // pow(3, w.level)::BIGINT), '') AS a, coalesce(string_agg(w.digest, '' ORDER BY w.rank) FILTER (w.rank > l.rank // pow(3, w.level)::BIGINT), '') AS b
    FROM l JOIN low w ON w.source IS NOT DISTINCT FROM l.source AND w.n > 1 AND w.rank // 3 = l.rank // pow(3, w.level + 1)::BIGINT GROUP BY l.source, l.rank, w.level
  UNION ALL SELECT l.source, l.rank, 100 + w.level, coalesce(string_agg(w.digest, '' ORDER BY w.rank) FILTER (w.rank < s.rank // pow(3, w.level)::BIGINT), ''), coalesce(string_agg(w.digest, '' ORDER BY w.rank) FILTER (w.rank > s.rank // pow(3, w.level)::BIGINT), '')
    FROM l JOIN s ON s.source IS NOT DISTINCT FROM l.source JOIN high w ON w.n > 1 AND w.rank // 3 = s.rank // pow(3, w.level + 1)::BIGINT GROUP BY l.source, l.rank, w.level),
paths AS (SELECT source, own, list({'a': a, 'b': b} ORDER BY level) AS path FROM steps GROUP BY source, own),
out AS (SELECT l.doc_id, l.leaf, s.subroot, (SELECT digest FROM high WHERE n = 1) AS root, coalesce(path, []) AS path, l.tampered FROM l JOIN s ON s.source IS NOT DISTINCT FROM l.source
  LEFT JOIN paths p ON p.source IS NOT DISTINCT FROM l.source AND p.own = l.rank)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda x: x.a || x.b), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM (
  SELECT *, list_reduce(list_prepend({'a': tampered, 'b': ''}, path), lambda x, y: {'a': sha256(y.a || x.a || y.b), 'b': ''}).a AS folded_root FROM out)"""
