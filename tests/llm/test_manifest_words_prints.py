"""Manifest, spelling variants and fingerprints against brute force, and their edge cases."""

import hashlib
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidewick.llm import fingerprints, merkle, spelling
from tidewick.llm.tables import setting

KINDS = "doc_id long, text string, lang string, source string, n_chars long, path string, rank int, edit string"


def prose(n, seed, size=400):
    r = np.random.default_rng(11)
    words = ["".join(r.choice(list("abcdefghij"), 6)) for _ in range(size)]
    return " ".join(np.random.default_rng(seed).choice(words, n))


def docs(spark, rows):
    """Rows (doc_id, text, source); other columns have names that operators use for their own."""
    return spark.createDataFrame([(i, t, "en" if i else None, s, len(t or ""), "p", 1, "e") for i, t, s in rows], KINDS)


def saved(spark, path, rows):
    docs(spark, rows).write.parquet(f"{path}/documents.parquet")
    return str(path)


ODD = [(None, "nobody\nknows", None), (None, None, "b"), (5, "same\ntext", "a"), (5, "same\ntext", "a"), (5, None, "a"), (6, "", ""), (-3, "\n\n", "b")]


def H(x):
    return hashlib.sha256(x.encode()).hexdigest()


def plain_leaf(values):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(leaves):
    """Root and, for each leaf, its steps (left, right)."""
    steps, nodes, own = [[] for _ in leaves], leaves, list(range(len(leaves)))
    while len(nodes) > 1:
        for k, at in enumerate(own):
            a = at // 3 * 3
            steps[k].append(("".join(nodes[a:at]), "".join(nodes[at + 1 : a + 3])))
        nodes, own = [H("".join(nodes[a : a + 3])) for a in range(0, len(nodes), 3)], [at // 3 for at in own]
    return nodes[0], steps


def plain_manifest(rows):
    """Sorted rows doc_id, leaf, subroot, root, proof, folded_root, verified."""
    by = {}
    for i, t, s in rows:
        by.setdefault(s, []).append((i, t))
    first = lambda x: (x is not None, x or 0)
    groups = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    leaf = lambda i, t, s, text: plain_leaf([i, s, "en" if i else None, len(t or ""), text])
    trees = []
    for s in groups:
        own = sorted(by[s], key=lambda r: (first(r[0]), leaf(*r, s, r[1])))
        trees.append((own, *plain_tree([leaf(*r, s, r[1]) for r in own])))
    root, above = plain_tree([t[1] for t in trees])
    out = []
    for s, (own, sub, steps), over in zip(groups, trees, above, strict=True):
        for (i, t), path in zip(own, steps, strict=True):
            path = path + over
            cut = t.replace("\n", "") if t is not None and zlib.crc32(str("" if i is None else i).encode()) % 2 == 0 else t
            node = leaf(i, t, s, cut)
            for a, b in path:
                node = H(a + node + b)
            out.append((i, leaf(i, t, s, t), sub, root, H("".join(a + b for a, b in path)), node, node == root))
    return sorted(out, key=str)


def test_manifest_of_many_sources_and_a_large_one(spark, tmp_path):
    rows = [(i, prose(5, i) + "\n" * (i % 3), "hot" if i % 3 else f"s{i % 7}") for i in range(120)] + ODD
    got = merkle.op11(spark, saved(spark, tmp_path, rows)).collect()
    assert sorted(map(tuple, got), key=str) == plain_manifest(rows)
    assert {r.verified for r in got} == {True, False}


def test_manifest_over_several_tiers(spark):
    for n in (1, 2, 3, 4, 9, 10, 12, 91):
        rows = [(i, f"t{i}", "x" if i < n else f"y{i}") for i in range(n + 11)]
        found = merkle.manifest(docs(spark, rows), merkle.COLUMNS, "source", "doc_id", ["n_chars"], digits=1 if n < 20 else 2)
        out = found.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")), merkle.folded(F.col("leaf"), F.col("path")))
        want = {r[0]: r for r in plain_manifest(rows)}
        assert len(want) == n + 11
        for r in out.collect():
            assert tuple(r[:5]) == want[r.doc_id][:5] and r[5] == r.root


def test_manifest_of_few_or_no_rows(spark, tmp_path):
    assert merkle.op11(spark, saved(spark, tmp_path / "none", [])).collect() == []
    one = [(7, "a\nb", None)]
    assert [tuple(r) for r in merkle.op11(spark, saved(spark, tmp_path / "one", one)).collect()] == plain_manifest(one)


def plain_words(rows):
    n = Counter()
    for i, t, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            n[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 31 == 0 else w] += 1
    return {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_variants(n):
    form, count = {}, {}
    for w in n:
        others = [v for v in n if v != w and near(v, w)]
        best = min(others, key=lambda v: (-n[v], v), default=None)
        count[w], form[w] = len(others), best if best and n[best] >= 10 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], count[w], n[form[w]] if form[w] else None))
    return out


def many_words(seed):
    """Frequent words, words at one or two edits from them, and words beside these."""
    r, out = np.random.default_rng(seed), []
    letters = list("abcéÿ×")
    for k in range(14):
        word = "".join(r.choice(letters, int(r.integers(7, 11))))
        out += [word] * (300 if k < 4 else 12)
        for _ in range(12):
            at, w = int(r.integers(len(word))), word
            w = [w[:at] + w[at + 1 :], w[:at] + str(r.choice(letters)) + w[at:], w[:at] + str(r.choice(letters)) + w[at + 1 :]][int(r.integers(3))]
            out += [w] * int(r.integers(1, 20))
    return [str(w) for w in r.permutation(out)]


def test_variants_of_documents(spark, tmp_path):
    words = many_words(1)
    rows = [(i, " ".join(words[k : k + 60]) + " Short ÉTUDEÉÉÉ etude", "s") for i, k in enumerate(range(0, len(words), 60))] + ODD
    rows += [(900, "abcdefgh" * 40 + " " + "abcdefgh" * 40 + "1" + "abcdefgh" * 40 + "x", None), (901, "abcdefgh" * 40 + "x", None)]
    got = spelling.op12(spark, saved(spark, tmp_path, rows)).collect()
    want = plain_variants(plain_words(rows))
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert any(w[1] and w[1] != w[2] for w in want) and any(w[1] is None for w in want)
    assert spelling.op12(spark, saved(spark, tmp_path / "none", [])).collect() == []


def test_variants_in_many_passes(spark, monkeypatch):
    monkeypatch.setattr(spelling, "SLICE_BLOCKS", 1)
    n = Counter(many_words(2))
    words = spark.createDataFrame([(w, c, "extra") for w, c in n.items()], "word string, n int, other string")
    blocks = {k: -(-c * spelling.BITS // 512) for k, c in Counter(map(len, n)).items()}
    assert len(spelling.passes(blocks, 128)) > 2
    assert {tuple(r) for r in spelling.variants(words, most=128).collect()} == plain_variants(n)


def test_passes_hold_every_slice_once():
    blocks = {7: 5000, 8: 1, 9: 2048, 64: 9000}
    for most in (64, 1 << 18, 1 << 20, 1 << 30):
        found = spelling.passes(blocks, most)
        assert sorted((s, k) for own in found for s, a, b in own for k in range(a, b)) == [(s, k) for s, n in blocks.items() for k in range(-(-n // spelling.SLICE_BLOCKS))]
        for own in found:
            size = sum(64 * (min(blocks[s], b * spelling.SLICE_BLOCKS) - a * spelling.SLICE_BLOCKS) for s, a, b in own)
            assert size <= max(most, 64 * spelling.SLICE_BLOCKS)


def test_edits_of_one_symbol_come_once():
    own = spelling.Alphabet("abc")
    full = {}
    for n in (1, 2, 3, 4):
        f = spelling.Filter(4, 0, 4)
        f.words[:] = np.uint64(2**64 - 1)
        full[n] = f
    got = [e for _, e in spelling.edits(["aab"], own, full)]
    assert sorted(got) == sorted({"ab", "aa", "bab", "cab", "abb", "acb", "aac"})


def plain_parse(text):
    """Names of all levels of one text, by lists and recursion over its symbols."""
    mix = lambda x: int(fingerprints.tokens.mix(np.array([x % 2**64], np.uint64))[0])
    step = [int(x) for x in fingerprints._STEP]
    symbols, size, levels = list(text.encode()), 8, []
    while symbols:
        runs = []
        for s in symbols:
            if runs and runs[-1][0] == s:
                runs[-1][1] += 1
            else:
                runs.append([s, 1])
        label, bits = [s for s, _ in runs], size
        for _ in range(3 if size == 8 else 4):
            new = []
            for k, x in enumerate(label):
                low = 0 if k == 0 else ((x ^ label[k - 1]) & -(x ^ label[k - 1])).bit_length() - 1
                new.append(2 * low + (x >> low & 1))
            label = new
        for much in (5, 4, 3):
            label = [min({0, 1, 2} - {*label[max(0, k - 1) : k], *label[k + 1 : k + 2]}) if x == much else x for k, x in enumerate(label)]
        begins = [k for k, x in enumerate(label) if k == 0 or k > 1 and x > label[k - 1] and x > (label[k + 1] if k + 1 < len(label) else 0)]
        names = []
        for a, b in zip(begins, [*begins[1:], len(runs)], strict=True):
            value = [mix(s) if n == 1 else mix(mix(s) + n * int(fingerprints._RUN)) for s, n in runs[a:b]]
            names.append(mix(sum(v * c for v, c in zip(value, step, strict=False)) + b - a + int(fingerprints._LEVELS[len(levels)])))
        levels.append(names)
        symbols, size = (names if len(names) > 1 else []), 64
    return levels


TEXTS = ["", "a", "aa", "ab", "aaaaaaab", "the same", "éèê 中文", prose(3, 1), prose(40, 2), prose(300, 3), "ab" * 200, prose(40, 2)]


def test_names_against_a_plain_parse():
    levels, top = fingerprints.parse(pa.array([*TEXTS, None]))
    for k, t in enumerate([*TEXTS, ""]):
        want = plain_parse(t)
        assert [n for n in ([int(x) for x in names[b[k] : b[k + 1]]] for names, b in levels) if n] == want
        assert int(top[k]) == (want[-1][0] if want else 0)
    alone = [fingerprints.written(fingerprints.sketches(pa.array([t]))[0]) for t in TEXTS]
    assert alone == [fingerprints.written(s) for s in fingerprints.sketches(pa.array(TEXTS))] and len(set(alone)) == len(set(TEXTS))


def test_equal_substrings_share_interior_names():
    middle = prose(200, 20)
    a, b = prose(30, 21) + middle + prose(25, 22), prose(7, 23) + "x" + middle
    (names_a, names_b) = ({x for n in plain_parse(t) for x in n} for t in (a, b))
    inside = [x for n in plain_parse(middle) for x in n]
    assert sum(x in names_a and x in names_b for x in inside) > 0.9 * len(inside)


def test_likeness_follows_the_share_in_common():
    base = prose(600, 30, 4000)
    sketch = lambda t: fingerprints.sketches(pa.array([t]))[0]
    for share in (0.0, 0.25, 0.5, 0.75, 1.0):
        cut = int(share * len(base))
        found = [fingerprints.alike(sketch(base), sketch(base[:cut] + prose(600, 40 + k, 4000)[: len(base) - cut])) for k in range(8)]
        assert abs(np.mean(found) - share) < 0.08
    small, other = sketch("one two"), sketch("one twx")
    assert fingerprints.alike(small, small) == 1 and 0 <= fingerprints.alike(small, other) < 1
    assert fingerprints.alike(sketch(""), sketch("")) == 1 and fingerprints.alike(sketch(""), small) == 0
    assert fingerprints.read(fingerprints.written(small))[1].tolist() == small[1].tolist()


def plain_following(rows):
    rows = [(i, t or "") for i, t, _ in rows]
    out = []
    for (i, t), (_, f) in zip(rows, rows[1:] + rows[:1], strict=True):
        cut = len(t) // 4
        e = t[: len(t) - cut] + f[:cut]
        a, b, c = (fingerprints.sketches(pa.array([x]))[0] for x in (t, e, f))
        out.append((i, len(t), H(e), fingerprints.written(a), fingerprints.written(b), fingerprints.alike(a, b), fingerprints.alike(a, c)))
    return sorted(out, key=str)


def test_fingerprints_of_documents_and_those_that_follow(spark, tmp_path):
    rows = [(None, "first of all, with no number", "a"), *[(i, prose(1 + i * 7 % 90, 50 + i) + "é" * (i % 3), "s") for i in range(-5, 60)], (70, None, "b"), (71, "", None), (72, "abc", "c"), (80, prose(3000, 60), "d")]
    got = fingerprints.op13(spark, saved(spark, tmp_path, rows)).collect()
    assert sorted(map(tuple, got), key=str) == plain_following(rows)
    for few in ([], rows[3:4], rows[3:5], [(4, "same", "x")] * 5):
        found = fingerprints.with_following(docs(spark, few)).collect()
        assert sorted(map(tuple, found), key=str) == plain_following(few) if few else found == []
    texts = docs(spark, rows)
    both = texts.select("doc_id", fingerprints.fingerprint(F.col("text")).alias("f")).select("doc_id", "f", fingerprints.likeness(F.col("f"), F.lit(None).cast("string")).alias("none"), fingerprints.likeness(F.col("f"), F.col("f")).alias("own"))
    assert {(r.doc_id, r.f, r.none, r.own) for r in both.collect()} == {(r[0], r[3], None, 1.0) for r in plain_following(rows)}


def test_parsing_takes_little_memory():
    long = prose(300_000, 90)
    texts = [long[k : k + 4000] for k in range(0, len(long), 4000)]
    own = [(i, t, s) for i, (t, s) in enumerate(zip(texts, fingerprints.sketches(pa.array(texts)), strict=True))]
    tracemalloc.start()
    fingerprints._compared(own, own[1:] + own[:1])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 25_000_000


def test_ends_of_partitions_meet_in_few_tasks(spark, tmp_path):
    rows = [(i, prose(1 + i % 5, 70 + i % 7), "s") for i in range(400)]
    with setting(spark, {"spark.sql.shuffle.partitions": "80", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}):
        fingerprints.with_following(docs(spark, rows)).write.parquet(f"{tmp_path}/found")
    assert spark.conf.get("spark.sql.parquet.columnarReaderBatchSize") == "4096"
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/found").collect()), key=str) == plain_following(rows)
    assert len(list(tmp_path.glob("found/part-*"))) < 20
