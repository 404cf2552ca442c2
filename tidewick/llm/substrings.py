"""Substring dedup by compact windows: near-duplicate passages across documents, found, verified and cut.

Under one hash function, all subsequences of a text that have the same least token make up a compact window (l, c, r):
any passage within l..r that holds c has token c as its min-hash. The windows wide enough for a passage are the large
subtrees of a Cartesian tree over the hash values. Tokens are shingles of five words. Windows of different texts that
share a signature are joined; those with the same offset between their texts are merged as intervals, and the passages
around them are verified word by word.

A window's signature is its token together with the one five words on, or back for every other hash function (which
functions look which way, the token's own hash says), so ten equal words are needed to meet; in repetitive stretches the
whole passage from the token on signs as well. Each signature links its windows to the one in the smallest document
only: a passage in n documents makes n - 1 candidates.

That star misses passages whose signature is a stock phrase which the smallest document has without the passage. So
signatures that three windows or more share are looked at again. A stretch counts there if windows of enough hash
functions over it are shared, and is open if no passage found so far covers it. The stretches of all documents that
share a signature with an open one meet once more in stars, this time by what is rare among them: equal stretches link
to the smallest document that has them, and each rare shingle of an open stretch (one of those of which two similar
stretches must share one) to the smallest document that has it there. So n stretches make a few times n candidates,
however many of them are alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .tables import Scratch, table

SHINGLE = 5
#: Words of a passage at least, hash functions, and similarity of passages in percent.
MIN_WORDS, HASHES, PERCENT = 50, 4, 80
#: Hash functions whose windows over a stretch must be shared for a second look at it.
AGREE = 2
#: Bits for how far a window reaches to either side.
_REACH = 14

_U = np.uint64
_PLACES = np.random.Generator(np.random.PCG64(6)).integers(1, 2**63, 4096, dtype=np.uint64) * _U(2) + _U(1)
_SEEDS = np.random.Generator(np.random.PCG64(5)).integers(1, 2**63, 64, dtype=np.uint64)


def _sliding_min(v: np.ndarray, t: int) -> np.ndarray:
    """The least of v[i : i + t] for every i (running minima of blocks from both sides)."""
    n = len(v)
    padded = np.full(-(-n // t) * t, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = v
    blocks = padded.reshape(-1, t)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - t + 1], ahead[t - 1 : n])


def _smaller(rank: np.ndarray, of: np.ndarray, step: int) -> np.ndarray:
    """For the places `of`, the nearest place before (step -1) or behind (step 1) with a smaller rank.

    All between a place and where it points to is larger, so one that points to a larger place may go on to where that
    one points to; chains halve each round.
    """
    to = np.arange(len(rank)) + step
    far = of
    while len(far):
        far = far[rank[to[far]] > rank[far]]
        to[far] = to[to[far]]
    return to[of]


def compact_windows(v: np.ndarray, bounds: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """l, c, r of all compact windows of t tokens at least, for hash values v of texts with the given bounds.

    A token that is least in some t tokens heads a subtree of that size. The tokens that bound its subtree head larger
    subtrees themselves, so the nearest smaller ones among these few tokens give the tree.
    """
    if len(v) < t:
        return (np.zeros(0, np.int64),) * 3
    bits = _U(int(len(v)).bit_length())
    place = np.arange(len(v), dtype=np.uint64)
    keyed = ((v >> bits) << bits) | place  # ties fall to the earlier token
    least = _sliding_min(keyed, t)
    ends = np.repeat(bounds[1:], np.diff(bounds))
    inside = np.flatnonzero(np.arange(len(least)) + t <= ends[: len(least)])
    heads = (least[inside] & ((_U(1) << bits) - _U(1))).astype(np.int64)
    if not len(heads):
        return (np.zeros(0, np.int64),) * 3
    heads = heads[np.concatenate([[True], heads[1:] != heads[:-1]])]
    text = np.searchsorted(bounds, heads, "right") - 1
    # one place of rank 0 before the heads of each text, and one behind the last: no search passes it
    slot = np.arange(len(heads)) + np.cumsum(np.concatenate([[True], text[1:] != text[:-1]]))
    rank, at, edge = np.zeros(slot[-1] + 2, np.uint64), np.zeros(slot[-1] + 2, np.int64), np.ones(slot[-1] + 2, bool)
    rank[slot], at[slot], edge[slot] = keyed[heads], heads, False
    before, behind = _smaller(rank, slot, -1), _smaller(rank, slot, 1)
    return np.where(edge[before], bounds[text], at[before] + 1), heads, np.where(edge[behind], bounds[text + 1], at[behind]) - 1


def windows(docs: DataFrame, min_words: int = MIN_WORDS, hashes: int = HASHES) -> DataFrame:
    """Rows key, doc_id, spot for all compact windows of `docs`; spot holds c, the hash function, c - l and r - c in 32, 4,
    14 and 14 bits.

    Only what a window wider than 16383 tokens to one side reaches is cut; the windows within it cover that text too.
    """
    t = min_words - SHINGLE + 1

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tokens.slices(batches, "text"):
            ids = part.column("doc_id").to_numpy()
            s, _, bounds = tokens.Words(part.column("text")).shingles(SHINGLE)
            text = np.repeat(np.arange(len(ids)), np.diff(bounds))
            for k in range(hashes):
                l, c, r = compact_windows(tokens.mix(s ^ _SEEDS[k]), bounds, t)
                if not len(c):
                    continue
                of = text[c]
                step = np.where((s[c] ^ _U(k)) & _U(1), SHINGLE, -SHINGLE)
                beside = c + step
                beside = np.where((beside < bounds[of]) | (beside >= bounds[of + 1]), c - step, beside)
                key = tokens.mix(s[c] * _U(3) + tokens.mix(s[beside] + _SEEDS[32 + k]))
                # of a chain of heads that repeat one signature a few words apart, the first one stands for all
                chain = np.zeros(len(c), bool)
                chain[1:] = (key[1:] == key[:-1]) & (of[1:] == of[:-1]) & (np.diff(c) <= SHINGLE)
                l, c, r, of, key = (x[~chain] for x in (l, c, r, of, key))
                # a token that recurs soon stands in a repetitive stretch, where ten words say little: all t tokens sign too
                whole = np.flatnonzero(c + t <= bounds[of + 1])
                ahead = s[c[whole][:, None] + np.arange(t)]
                again = (ahead[:, 1:] == ahead[:, :1]).any(axis=1)
                whole = whole[again]
                key = np.concatenate([key, tokens.mix((tokens.mix(ahead[again]) * _PLACES[:t]).sum(axis=1, dtype=np.uint64))])
                most = (1 << _REACH) - 1
                spot = ((c - bounds[of]) << 32) | (k << 2 * _REACH) | (np.minimum(c - l, most) << _REACH) | np.minimum(r - c, most)
                row = np.concatenate([np.arange(len(c)), whole])
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids[of[row]]), pa.array(spot[row].astype(np.int64))], ["key", "doc_id", "spot"])

    return docs.select("doc_id", "text").mapInArrow(emit, "key long, doc_id long, spot long")


def _runs(mask: np.ndarray) -> np.ndarray:
    """First and behind-last places of the runs of True."""
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.column_stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)])


def matched(x: np.ndarray, y: np.ndarray, t: int, percent: int, behind: list[int] = ()) -> np.ndarray:
    """Runs [start, end) of x, in shingles, covered by t shingles that are similar enough to t shingles of y.

    For t shingles of x, the t shingles of y begin as many places earlier as one of `behind` says, or where their first
    common shingle (or their last) stands first in y; the similarity counts shared shingles against the union.
    """
    if len(x) < t or len(y) < t:
        return np.zeros((0, 2), np.int64)
    order = np.argsort(y, kind="stable")
    spot = np.minimum(np.searchsorted(y[order], x), len(y) - 1)
    place = np.where(y[order[spot]] == x, order[spot], -1)
    need = -(-2 * t * percent // (100 + percent))
    there = place >= 0
    total = np.concatenate([[0], np.cumsum(there)])
    enough = total[t:] - total[:-t] >= need
    good = np.zeros(len(enough), bool)
    if not enough.any():
        return np.zeros((0, 2), np.int64)
    for d in behind:
        a, b = max(0, d), min(len(x), len(y) + d)
        if b - a >= t:
            run = np.concatenate([[0], np.cumsum(x[a:b] == y[a - d : b - d])])
            good[a : b - t + 1] |= run[t:] - run[:-t] >= need
    shift = place - np.arange(len(x))
    for d, count in zip(*np.unique(shift[there], return_counts=True), strict=True):
        if count >= need:
            run = np.concatenate([[0], np.cumsum(there & (shift == d))])
            good |= run[t:] - run[:-t] >= need
    # what is left has words put in or left out between
    for block in np.array_split(np.flatnonzero(enough & ~good), max(1, len(x) // 4096)):
        near = place[block[:, None] + np.arange(t)]
        inside = near >= 0
        for end in (inside.argmax(axis=1), t - 1 - inside[:, ::-1].argmax(axis=1)):
            start = (near[np.arange(len(block)), end] - end)[:, None]
            good[block[((near >= start) & (near < start + t) & inside).sum(axis=1) >= need]] = True
    cover = np.zeros(len(x) + 1, np.int64)
    at = np.flatnonzero(good)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + t, -1)
    return _runs(np.cumsum(cover)[:-1] > 0)


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, hashes: int = HASHES, percent: int = PERCENT) -> DataFrame:
    """Rows doc_id, source_id, start_word, end_word, start_char, end_char: passages that a smaller document has too.

    A passage is a run of at least `min_words` words (runs of characters other than space and tab to return, A-Z
    lower-cased); it is reported where every `min_words` words of it, or words beside them, have at least `percent`
    similar shingles of five words in `source_id`. end_word and end_char stand behind the passage; chars count code
    points. Shorter texts, null texts and null ids have no rows. doc_id is meant to be a key: rows that repeat it count as
    one document with the passages of any of them, each given once. Of equal passages the one of the smallest id is the
    source. Columns other than doc_id and text are ignored. An empty table gives no rows.
    """
    t = min_words - SHINGLE + 1
    texts = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    scratch = Scratch(docs.sparkSession)
    found = scratch(windows(texts, min_words, hashes))  # read twice
    # what a join adds to its rows is a table before: so Spark can split the task of a signature that very many texts have
    shared = found.groupBy("key").agg(F.min("doc_id").alias("source_id"), F.max("doc_id").alias("most"), (F.count("*") > 2).alias("wide")).where("source_id < most").select("key", "source_id", "wide")
    near = scratch(found.join(scratch(shared), "key"))
    first = scratch(near.where("doc_id = source_id").groupBy("key").agg(F.min("spot").alias("spot2")).select("key", "spot2"))
    reach = (1 << _REACH) - 1
    pairs = near.where("doc_id > source_id").join(first, "key").selectExpr(
        "doc_id", "source_id", "(spot >> 32) - (spot2 >> 32) as shift", f"(spot >> 32) - ((spot >> {_REACH}) & {reach}) as lo", f"(spot >> 32) + (spot & {reach}) as hi"
    )
    spans = scratch(_spans(pairs))
    ids = spans.select("doc_id").union(spans.select(F.col("source_id").alias("doc_id"))).distinct()
    some = scratch(texts.join(ids.hint("merge"), "doc_id", "left_semi"))
    star = scratch(_verified(spans, some, t, percent))
    more = scratch(_spans(_unexplained(near.where("wide"), star, some, t, percent, scratch)))
    # a pair that is looked at again is verified at all its offsets at once
    before = spans.toDF("doc_id", "source_id", "lo1", "hi1", "shifts1")
    both = more.join(before, ["doc_id", "source_id"], "left").selectExpr(
        "doc_id", "source_id", "least(lo, lo1) as lo", "greatest(hi, hi1) as hi", "if(shifts1 is null, shifts, array_union(shifts, shifts1)) as shifts"
    )
    return scratch.keep(star.join(more.select("doc_id", "source_id"), ["doc_id", "source_id"], "left_anti").unionByName(_verified(both, some, t, percent)).distinct())


def _spans(pairs: DataFrame) -> DataFrame:
    """One row doc_id, source_id, lo, hi, shifts for each pair of documents of `pairs` (doc_id, source_id, shift, lo, hi)."""
    # intervals of one pair of documents at one offset merge; then all intervals of the pair meet in one row
    merged = pairs.groupBy("doc_id", "source_id", "shift").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return merged.groupBy("doc_id", "source_id").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.collect_set("shift").alias("shifts"))


def _verified(spans: DataFrame, texts: DataFrame, t: int, percent: int) -> DataFrame:
    """The passages of pairs of documents around their `spans`; texts by id from `texts`."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tokens.slices(batches, "text"):
            for k in range(0, part.num_rows, 256):
                some = part.slice(k, 256)
                words = tokens.Words(some.column("text"))
                mine, _, bounds = words.shingles(SHINGLE)
                theirs, _, other = tokens.Words(some.column("source_text")).shingles(SHINGLE)
                rows = []
                cols = [some.column(c).to_pylist() for c in ("doc_id", "source_id", "lo", "hi", "shifts")]
                for i, (d, src, lo, hi, shifts) in enumerate(zip(*cols, strict=True)):
                    lo, hi = max(0, lo - t), min(bounds[i + 1] - bounds[i], hi + t + 1)
                    lo2, hi2 = max(0, lo - max(shifts) - t), min(other[i + 1] - other[i], hi - min(shifts) + t)
                    x, y = mine[bounds[i] + lo : bounds[i] + hi], theirs[other[i] + lo2 : other[i] + max(lo2, hi2)]
                    for a, b in matched(x, y, t, percent, [z - lo + lo2 for z in shifts]):
                        a, b = int(lo + a), int(lo + b + SHINGLE - 1)
                        at = words.starts[words.bounds[i] + a], words.ends[words.bounds[i] + b - 1]
                        chars = [int(np.count_nonzero((words.data[words.offsets[i] : p] & 0xC0) != 0x80)) for p in at]
                        rows.append((d, src, a, b, *chars))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], ["doc_id", "source_id", "start_word", "end_word", "start_char", "end_char"])

    both = spans.join(texts, "doc_id").join(texts.select(F.col("doc_id").alias("source_id"), F.col("text").alias("source_text")), "source_id")
    kind = "doc_id long, source_id long, start_word long, end_word long, start_char long, end_char long"
    return both.select("doc_id", "source_id", "lo", "hi", "shifts", "text", "source_text").mapInArrow(verify, kind)


def _covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n places lie in one of the ranges [start, end)."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, ends, -1)
    return np.cumsum(edge)[:-1] > 0


def _count(mask: np.ndarray, t: int) -> np.ndarray:
    """How many of mask[i : i + t] are set, for every i."""
    total = np.concatenate([[0], np.cumsum(mask)])
    return total[t:] - total[:-t]


def _ranges(spots: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash function, first start and last start of the stretches of t shingles for which each window speaks."""
    most = (1 << _REACH) - 1
    c = spots >> 32
    return (spots >> 2 * _REACH) & 15, c - np.minimum((spots >> _REACH) & most, t - 1), c - t + 1 + np.minimum(spots & most, t - 1)


def _unexplained(members: DataFrame, star: DataFrame, texts: DataFrame, t: int, percent: int, scratch: Scratch, agree: int = AGREE) -> DataFrame:
    """Rows doc_id, source_id, shift, lo, hi: places around `members` (key, doc_id, spot) to be verified besides those in `star`.

    An open stretch needs all but t - need of its shingles in another document, and so does the stretch there; sorted by
    one order, the rarest shingles first, two such stretches share one of their first t - need + 1.
    """
    need = -(-2 * t * percent // (100 + percent))
    slack = t - need

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                d, held = batch.column("doc_id")[i].as_py(), batch.column("held")[i].values
                key, spot = (held.field(k).to_numpy() for k in range(2))
                known = [np.array(batch.column(c)[i].as_py() or [], np.int64) for c in ("starts", "ends")]
                function, first, last = _ranges(spot, t)
                n = int(last.max()) + t
                shared = np.zeros(n - t + 1, np.int64)
                for k in np.unique(function):
                    shared += _covered(len(shared), first[function == k], last[function == k] + 1)
                inside = np.minimum(known[0], n), np.minimum(known[1] - SHINGLE + 1, n)
                good = np.concatenate([[0], np.cumsum(shared >= agree)])
                is_open = np.concatenate([[0], np.cumsum((shared >= agree) & (_count(_covered(n, *inside), t) < t))])
                held = good[last + 1] > good[first]
                rows.append((key[held], np.full(held.sum(), d), first[held], last[held], is_open[last[held] + 1] > is_open[first[held]]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*rows, strict=True)], ["key", "doc_id", "first", "last", "open"])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tokens.slices(batches, "text"):
            s, _, bounds = tokens.Words(part.column("text")).shingles(SHINGLE)
            rows = []
            for i, d in enumerate(part.column("doc_id").to_pylist()):
                x = part.column("held")[i].values
                first, last, is_open = (x.field(k).to_numpy(zero_copy_only=False) for k in range(3))
                n = int(bounds[i + 1] - bounds[i])
                at = np.flatnonzero(_covered(n, first, last + t))
                rows.append((s[bounds[i] + at].view(np.int64), np.full(len(at), d), at.astype(np.int32), _covered(n, first[is_open], last[is_open] + t)[at]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*rows, strict=True)], ["token", "doc_id", "place", "open"])

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                d, x = batch.column("doc_id")[i].as_py(), batch.column("list")[i].values
                place, df, token, is_open = (x.field(k).to_numpy(zero_copy_only=False) for k in range(4))
                order = np.lexsort((token, df))
                token, place, is_open = token[order], place[order].astype(np.int64), is_open[order]
                low = int(place.min()) - slack
                rank = np.full(int(place.max()) - low + slack + 1, -1)  # shingles of one document alone come first
                rank[place - low] = np.arange(len(order))
                count = _count(rank >= 0, t)
                closed = np.zeros(len(rank), bool)
                closed[place[~is_open] - low] = True
                opened = _count(closed, t) == 0
                heads, marks = [], []
                good = np.flatnonzero(count >= need)
                for at in np.array_split(good, max(1, len(good) // 4096)):
                    near = rank[at[:, None] + np.arange(t)]
                    head = np.partition(near, slack, axis=1)[:, : slack + 1] if len(at) else near
                    heads.append(np.unique(head[head >= 0]))
                    full = count[at] == t
                    sign = tokens.mix((tokens.mix(token[near[full]].view(np.uint64)) * _PLACES[:t]).sum(axis=1, dtype=np.uint64))
                    marks.append((sign.view(np.int64), at[full] + low, opened[at[full]]))
                heads = np.unique(np.concatenate(heads))
                sign, at, full = (np.concatenate(x) for x in zip(*marks, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat([False, True], [len(heads), len(sign)])), pa.array(np.concatenate([token[heads], sign])), pa.array(np.full(len(heads) + len(sign), d)),
                        pa.array(np.concatenate([place[heads], at])), pa.array(np.concatenate([is_open[heads], full])),
                    ],
                    ["whole", "sign", "doc_id", "place", "open"],
                )

    held = members.groupBy("doc_id").agg(F.collect_list(F.struct("key", "spot")).alias("held"))
    known = star.groupBy("doc_id").agg(F.collect_list("start_word").alias("starts"), F.collect_list("end_word").alias("ends"))
    places = scratch(held.join(known, "doc_id", "left").select("doc_id", "held", "starts", "ends").mapInArrow(judge, "key long, doc_id long, first long, last long, open boolean"))
    asked = scratch(places.where("open").select("key").distinct())
    near = places.join(asked, "key", "left_semi").groupBy("doc_id").agg(F.collect_set(F.struct("first", "last", "open")).alias("held"))
    held = scratch(texts.join(near, "doc_id").select("doc_id", "text", "held").mapInArrow(mark, "token long, doc_id long, place int, open boolean"))
    often = held.groupBy("token").agg(F.count("*").alias("df"), F.min("doc_id").alias("low"), F.max(F.when(F.col("open"), F.col("doc_id"))).alias("high")).where("low < high").select("token", "df")
    lists = held.join(scratch(often), "token").groupBy("doc_id").agg(F.collect_list(F.struct("place", "df", "token", "open")).alias("list")).where(F.size("list") >= need)
    signs = scratch(lists.mapInArrow(stretches, "whole boolean, sign long, doc_id long, place long, open boolean"))
    least = signs.groupBy("whole", "sign").agg(F.min(F.struct("doc_id", "place")).alias("least"), F.max(F.when(F.col("open"), F.col("doc_id"))).alias("high")).where("least.doc_id < high")
    least = scratch(least.selectExpr("whole", "sign", "least.doc_id as source_id", "least.place as place2"))
    return signs.where("open").join(least, ["whole", "sign"]).where("source_id < doc_id").selectExpr(
        "doc_id", "source_id", "place - place2 as shift", f"if(whole, place, place - {t}) as lo", f"place + {t} as hi"
    )


def cut_passages(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """`docs` without the passages (doc_id, start_char, end_char); where passages overlap, all they cover goes.

    What remains is joined as it stands. Rows without passages, and all other columns, stay as they are.
    """
    w = Window.partitionBy("doc_id").orderBy("start_char", "end_char")
    behind = F.max("end_char").over(w.rowsBetween(Window.unboundedPreceding, -1))
    islands = passages.select("doc_id", "start_char", "end_char").withColumn("_new", F.coalesce(F.col("start_char") > behind, F.lit(True)).cast("int"))
    islands = islands.withColumn("_run", F.sum("_new").over(w)).groupBy("doc_id", "_run").agg(F.min("start_char").alias("s"), F.max("end_char").alias("e"))
    cuts = islands.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("_cuts"))
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(a, c):
        return F.struct(F.concat(a["out"], F.substring("text", (a["at"] + 1).cast("int"), (c["s"] - a["at"]).cast("int"))).alias("out"), c["e"].alias("at"))

    rest = F.aggregate("_cuts", start, step, lambda a: F.concat(a["out"], F.substring("text", (a["at"] + 1).cast("int"), F.length("text"))))
    out = docs.join(cuts, "doc_id", "left")
    return out.select(*[(F.when(F.col("_cuts").isNull(), F.col("text")).otherwise(rest).alias("text") if c == "text" else F.col(c)) for c in docs.columns])


def op2(spark, sf_dir: str) -> DataFrame:
    """All passages of 50 words or more that a document shares with one of a smaller id."""
    return repeated_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))
