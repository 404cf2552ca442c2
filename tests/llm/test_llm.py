"""Operators on small tables against brute force, and their edge cases: nulls, empty texts, repeats, ties, no rows."""

import os
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewick.llm import decontamination, html_text, minhash, packing, quality, sharding, substrings, token_files, tokens, toxicity, url_reputation
from tidewick.llm.encoding import Encoder, encoder
from tidewick.llm.tables import stored

rng = np.random.default_rng(7)
VOCABULARY = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(3000)]


def prose(n, seed):
    return " ".join(np.random.default_rng(seed).choice(VOCABULARY, n))


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, kept string, n_words long")


ODD = [(900, None), (901, ""), (902, " \n\t "), (903, "one"), (904, "one"), (None, "nobody knows")]


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


@pytest.fixture(scope="module")
def copies():
    base = prose(200, 1).split()
    near = base.copy()
    near[50] = "changed"
    far = base[:100] + prose(100, 3).split()
    passage = prose(60, 9)
    texts = [" ".join(base), " ".join(near), " ".join(far), " ".join(base), prose(80, 4) + " " + passage + " " + prose(40, 5), prose(30, 6) + "\n" + passage.upper() + " " + prose(90, 7), prose(300, 8), "de " * 120 + prose(60, 10), prose(60, 11) + " de" * 90]
    return list(enumerate(texts))


def test_near_duplicates(spark, copies):
    rows = copies + ODD
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs(spark, rows), n=4).collect()}
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = {tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set())
    parent = {i: i for i, _ in rows if i is not None}
    for _ in parent:
        for a in parent:
            for b in parent:
                if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    parent[a] = parent[b] = min(parent[a], parent[b])
    want = {(i, len(sets[i]), parent[i], parent[i] == i) for i in parent} | {(None, 1, None, True)}
    assert got == want
    assert minhash.near_duplicates(docs(spark, [])).collect() == []


def test_drifted_copies_are_linked_exactly(spark):
    base = prose(120, 20).split()
    rows = []
    for i in range(60):
        r, t = np.random.default_rng(100 + i), base.copy()
        for k in r.choice(120, int(r.integers(0, 9)), replace=False):
            t[k] = f"own{i}x{k}"
        rows.append((i, " ".join(t)))
    sets = {i: {tuple(w[k : k + 4]) for k in range(len(w) - 3)} for i, t in rows for w in [t.split()]}
    parent = dict.fromkeys(sets)
    parent = {i: i for i in sets}
    for _ in range(60):
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    parent[a] = parent[b] = min(parent[a], parent[b])
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs(spark, rows), n=4).collect()} == parent


def test_compact_windows_against_their_definition():
    r = np.random.default_rng(1)
    for _ in range(60):
        bounds, t = np.concatenate([[0], np.cumsum(r.integers(0, 40, 5))]), int(r.integers(1, 12))
        v = r.integers(0, 50, bounds[-1]).astype(np.uint64) << np.uint64(20)
        want = set()
        for a, b in zip(bounds, bounds[1:], strict=False):
            for c in range(a, b):
                left = next((k for k in range(c - 1, a - 1, -1) if v[k] <= v[c]), a - 1) + 1
                right = next((k for k in range(c + 1, b) if v[k] < v[c]), b) - 1
                if right - left + 1 >= t:
                    want.add((left, c, right))
        assert set(zip(*(x.tolist() for x in substrings.compact_windows(v, bounds, t)), strict=True)) == want


def test_repeated_passages_and_cuts(spark, copies):
    rows = copies + ODD
    df = docs(spark, rows)
    found = substrings.repeated_passages(df).collect()
    cover, texts = {}, dict(rows)
    for r in found:
        assert words(texts[r.doc_id][r.start_char : r.end_char]) == words(texts[r.doc_id])[r.start_word : r.end_word]
        cover.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    seen, want = {}, {}
    for i, t in copies:
        w = words(t)
        for k in range(len(w) - 49):
            if seen.setdefault(tuple(w[k : k + 50]), i) != i:
                want.setdefault(i, set()).update(range(k, k + 50))
    assert all(want[i] <= cover.get(i, set()) for i in want) and {5, 3, 8} <= set(want) and not {0, 4, 6} & set(cover)
    cut = {r.doc_id: r.text for r in substrings.cut_passages(df, substrings.repeated_passages(df)).collect()}
    assert words(cut[5]) == [w for k, w in enumerate(words(texts[5])) if k not in cover[5]] and cut[6] == texts[6] and cut[900] is None
    assert substrings.repeated_passages(docs(spark, [])).collect() == []


def test_seeds_meet_any_permitted_substitutions():
    from itertools import combinations

    for n in range(6, 31):
        size = min(n, decontamination.WINDOW)
        differ = size - -(-decontamination.PERCENT * size // 100)
        masks = decontamination.SHORT_MASKS if n < decontamination.WINDOW else decontamination.MASKS[1:]
        for out in combinations(range(size), differ):  # fewer substitutions leave more places
            assert any(not set(out) & {s + p for p in m} for m in masks for s in range(size - m[-1])), (n, out)


def test_short_and_repeated_items_are_found(spark):
    rows, items = [], []
    for n in range(6, 16):
        item = prose(n, 3000 + n).split()
        differ = min(n, 13) - -(-80 * min(n, 13) // 100)
        changed = item.copy()
        for k in range(differ):
            changed[1 + 3 * k] = "other"
        rows.append((n, prose(40, 3100 + n) + " " + " ".join(changed) + " " + prose(40, 3200 + n)))
        items += [(n, " ".join(item)), (100 + n, " ".join(item))]
    benchmark = spark.createDataFrame(items + [(None, items[0][1])], "item_id long, text string")
    got = sorted(((r.doc_id, r.item_id) for r in decontamination.contaminated(docs(spark, rows + ODD), benchmark).collect()), key=str)
    assert got == sorted([(n, i) for n in range(6, 16) for i in (n, 100 + n)] + [(6, None)], key=str)


def test_contaminated(spark):
    item = prose(30, 40).split()
    two = item.copy()
    two[3], two[9], two[20], two[27] = "p", "q", "r", "s"
    rows = [(1, prose(50, 41) + " " + " ".join(item).upper() + ", " + prose(20, 42)), (2, " ".join(two) + prose(80, 43)), (3, prose(200, 44)), (4, " ".join(item[:7]) + " " + prose(50, 45)), *ODD]
    benchmark = spark.createDataFrame([(7, " ".join(item)), (8, None), (9, "too short")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs(spark, rows), benchmark).collect()} == {(1, 7), (2, 7)}
    assert decontamination.contaminated(docs(spark, rows), benchmark.where("false")).collect() == []
    left = decontamination.clean_of(docs(spark, rows), decontamination.contaminated(docs(spark, rows), benchmark))
    assert left.count() == len(rows) - 2 and left.columns == docs(spark, []).columns


def test_quality_figures(spark):
    texts = [prose(60, 50), "a b c d e f g\n" * 6 + "end", "x #$% y|z", "w1 w2 w3 w4 w5 " * 2 + prose(40, 51), *[t for _, t in ODD]]
    rows = list(enumerate(texts))
    got = {r.doc_id: r for r in quality.quality(docs(spark, rows), spark.createDataFrame([(0,), (None,)], "doc_id long")).collect()}
    for i, t in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        n = Counter(windows)
        repeated = len({p for k, x in enumerate(windows) if n[x] > 1 for p in range(k, k + 5)})
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), repeated)
        assert r.base_failed == (len(w) < 10 or 100 * repeated > 20 * len(w)) and not (r.base_failed and r.kept)
    assert quality.quality(docs(spark, []), spark.createDataFrame([], "doc_id long")).collect() == []


def test_quality_separates_symbols_from_prose(spark):
    # few words, so that the trusted texts show what the language is like
    some = lambda seed: np.random.default_rng(seed).choice(VOCABULARY[:20], 400)
    clean = [(i, " ".join(some(60 + i))) for i in range(20)]
    junk = [(100 + i, " ".join(w + "%%%" for w in some(90 + i))) for i in range(20)]
    out = quality.quality(docs(spark, clean + junk), spark.createDataFrame([(i,) for i, _ in clean[:15]], "doc_id long"))
    assert {r.doc_id for r in out.where("kept").collect()} == {i for i, _ in clean}


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5000), st.integers(0, 99))
def test_permutation(n, seed):
    x = np.arange(n)
    y = sharding.permute(x, n, seed)
    assert sorted(y.tolist()) == x.tolist() and (sharding.permute(y, n, seed, inverse=True) == x).all()


def test_shards(spark):
    rows = docs(spark, [(i % 50, prose(3, i)) for i in range(130)] + ODD)
    out = sharding.shard_rows(rows.select("doc_id", "text"), ["doc_id", "text"], shards=7).collect()
    by = Counter(r.shard for r in out)
    assert len(out) == 136 and max(by.values()) - min(by.values()) <= 1
    assert all(sorted(r.slot for r in out if r.shard == s) == list(range(by[s])) for s in by)
    assert sharding.shard_rows(docs(spark, []).select("doc_id", "text"), ["doc_id"]).collect() == []


def test_shards_of_rows_with_clashing_columns(spark):
    rows = docs(spark, [(i, prose(3, i)) for i in range(40)]).selectExpr("doc_id", "text", "doc_id as shard", "'s' as slot", "doc_id * 2 as row_no", "doc_id * 3 as _at", "doc_id * 4 as _part", "doc_id * 5 as row", "doc_id * 6 as to")
    out = sharding.shard_rows(rows, ["doc_id"], shards=7)
    assert sorted(out.columns) == sorted(rows.columns) and dict(out.dtypes)["slot"] == "bigint"
    assert {(r.doc_id, r.row_no, r._at, r._part, r.row, r.to) for r in out.collect()} == {(i, 2 * i, 3 * i, 4 * i, 5 * i, 6 * i) for i in range(40)}


def test_shard_query_against_plain_python(spark, tmp_path):
    rows = [(i, prose(1 + i % 9, i) + "é" * (i % 3)) for i in range(100, 160)] + [(7, None), (7, None), (None, "n"), (8, "")]
    docs(spark, rows).withColumnRenamed("kept", "shard").withColumnRenamed("n_words", "slot").write.parquet(str(tmp_path / "documents.parquet"))
    raw = lambda t: (t or "").encode()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, zlib.crc32(raw(r[1])), len(raw(r[1]))))
    to = sharding.permute(np.arange(len(rows)), len(rows), 7)
    want = Counter((i, len(raw(t)) + 8, zlib.crc32(raw(t)), "rows", int(p) % 24, int(p) // 24, None) for (i, t), p in zip(order, to, strict=True))
    assert Counter(map(tuple, sharding.op7(spark, str(tmp_path)).collect())) == want


def histogram(counts):
    return np.bincount(list(counts), list(counts.values()), 1025).astype(np.int64)


def sequences(found):
    return sum(n for _, n in found)


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.integers(1, 1024), st.integers(1, 300), min_size=1, max_size=40))
def test_plan_uses_every_piece_and_is_never_worse_than_best_fit(counts):
    found, used = packing.plan(counts), Counter()
    for parts, times in found:
        assert times > 0 and sum(parts) <= 1024
        for p in parts:
            used[p] += times
    assert used == Counter(counts)
    assert -(-sum(k * n for k, n in counts.items()) // 1024) <= sequences(found) <= sequences(packing.best_fit(histogram(counts), 1024))


def test_plan_on_hard_and_random_histograms():
    assert sequences(packing.plan({1: 13, 502: 8, 522: 8})) == 9
    r = np.random.default_rng(5)
    for _ in range(1_000):
        lengths = r.choice(np.arange(1, 1025), int(r.integers(1, 41)), replace=False)
        counts = {int(k): int(n) for k, n in zip(lengths, r.integers(1, 301, len(lengths)), strict=True)}
        assert sequences(packing.plan(counts)) <= sequences(packing.best_fit(histogram(counts), 1024))


def test_patterns_fill_what_single_lengths_leave():
    # pairs that only fit each other: patterns find all of them
    counts = {k: 50 for k in range(300, 725) if k != 512}
    found = packing.plan(counts)
    assert sequences(found) <= 1.01 * sum(k * n for k, n in counts.items()) / 1024
    for plan in packing.candidates(counts):
        assert sum(len(parts) * n for parts, n in plan) == sum(counts.values())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="needs the given tables")
def test_plan_of_given_documents_is_near_the_lower_bound():
    import pyarrow.parquet as pq

    texts, counts = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"]).column(0).combine_chunks(), Counter()
    own = Encoder("byte_bpe_50k.json")
    for k in range(0, len(texts), 500):
        for ids in own.ended(texts.slice(k, 500), 2):
            first = (len(ids) - 1) % 1024 + 1
            counts[first] += 1
            counts[1024] += (len(ids) - first) // 1024
    least = -(-sum(k * n for k, n in counts.items()) // 1024)
    assert least <= sequences(packing.plan(counts)) <= least + 2


def encoded(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own.encode_special_tokens = True
    return [x.ids for x in own.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_encoder_equals_the_tokenizer():
    texts = ["  a b", "a  b\nc", "a\n\nb", "x \ny", "é b c", " lead", "trail ", "<|endoftext|> hi", "don't 've", "a\tb", "中文 字 12 3½", "a\x1cb", "", " ", "\n", "a b　d", "a b", prose(200, 70)]
    texts += ["a\nb\nc", "a\n", "\na", "x\u00a0y z", "x\u00a0 z", "it's 's\n're ok's", "end.\n(Next) 12,5 %", None, "1 2\n3", "#$% ## a", *[prose(30, 71 + k) for k in range(5)]]
    own = Encoder("byte_bpe_50k.json")
    for _ in range(2):
        assert [x.tolist() for x in own.encode(pa.array(texts))] == encoded(texts)
        assert [x.tolist() for x in own.ended(pa.array(texts), 7)] == [[*x, 7] for x in encoded(texts)]
    assert own.encode(pa.array([], pa.string())) == [] and [len(x) for x in own.encode(pa.array([None, ""], pa.string()))] == [0, 0]


def test_encoder_compares_bytes_where_hashes_are_equal(monkeypatch):
    monkeypatch.setattr(tokens, "mix", lambda h: h & np.uint64(3))
    monkeypatch.setattr("tidewick.llm.encoding.CACHE", 3)
    texts = [prose(6, 80 + k) for k in range(6)]
    own = Encoder("byte_bpe_50k.json")
    for _ in range(2):
        assert [x.tolist() for x in own.encode(pa.array(texts))] == encoded(texts)


def test_packed_pieces(spark):
    rows = [(i, prose(int(n), 200 + i)) for i, n in enumerate((5, 300, 900, 20, 700, 150))] + ODD
    out = packing.pack(docs(spark, rows)).collect()
    ids = dict(zip([i for i, _ in rows], [x + [2] for x in encoded([t for _, t in rows])], strict=True))
    spans, seqs = {}, {}
    for r in out:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(part)}I", *part)) and len(part) == r.length
        spans.setdefault(r.doc_id, []).append((r.piece, r.start, r.length))
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, x in spans.items():
        x.sort()
        assert [p for p, _, _ in x] == list(range(len(x))) and sum(n for _, _, n in x) == len(ids[i]) and all(n == 1024 for _, _, n in x[1:])
        assert len(x) == -(-len(ids[i]) // 1024)
    for x in seqs.values():
        x.sort()
        assert x[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(x, x[1:], strict=False)) and sum(n for _, n in x) <= 1024
    assert packing.pack(docs(spark, [])).collect() == []


def test_packed_repeats_are_packed_each(spark):
    text = prose(700, 250)
    rows = [(1, text), (1, text), (1, text), (2, "x"), (2, "x"), (2, None), (None, "x")]
    out = packing.pack(docs(spark, rows).selectExpr("doc_id", "text", "1 as length", "2 as rank", "3 as piece", "4 as part")).collect()
    want = Counter()
    for (i, _), ids in zip(rows, encoded([t for _, t in rows]), strict=True):
        ids, at = ids + [2], 0
        for k, n in enumerate([(len(ids) - 1) % 1024 + 1, *[1024] * ((len(ids) - 1) // 1024)]):
            want[i, k, at, n, zlib.crc32(struct.pack(f"<{n}I", *ids[at : at + n]))] += 1
            at += n
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    taken = sorted((r.sequence_id, r.offset, r.length) for r in out)
    assert all(s != t or a + n == b for (s, a, n), (t, b, _) in zip(taken, taken[1:], strict=False)) and all(a + n <= 1024 for _, a, n in taken)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3000), min_size=0, max_size=300))
def test_elias_fano(gaps):
    v = np.concatenate([[0], np.cumsum(np.array(gaps, np.int64))]).astype(np.int64)
    e = token_files.EliasFano.encoded(v)
    assert e.all().tolist() == v.tolist() == [e.select(i) for i in range(len(v))]
    assert all(e.between(a, b).tolist() == v[a:b].tolist() for a in range(0, len(v), 37) for b in (a, a + 1, (a + len(v)) // 2, len(v)) if a <= b <= len(v))


def test_token_files_keep_any_ids_and_equal_ones(spark, tmp_path):
    rows = [(i, f"text {k}") for k, i in enumerate([-(2**63), 2**63 - 1, 5, 5, 5, None, None, -7])] + [(5, "text 2")]
    manifest = token_files.write_token_files(docs(spark, rows), str(tmp_path / "out"), shards=2)
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens) for r in token_files.read_token_files(manifest).collect())
    assert got == sorted((i is not None, i or 0, len(x) + 1) for (i, _), x in zip(rows, encoded([t for _, t in rows]), strict=True))


def test_token_files_round_trip(spark, tmp_path):
    rows = [(i, prose(30 + i, 300 + i)) for i in range(40)] + ODD
    manifest = token_files.write_token_files(docs(spark, rows), str(tmp_path / "out"), shards=3)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files.read_token_files(manifest).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0]))
    at = 0
    for (i, _), ids in zip(order, encoded([t for _, t in order]), strict=True):
        ids = ids + [0]
        assert got[i] == (at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        at += len(ids)
    shard = token_files.Shard(manifest.orderBy("shard").first().path)
    assert shard.document(0).tolist() == encoded([order[0][1]])[0] + [0]
    assert token_files.read_token_files(token_files.write_token_files(docs(spark, []), str(tmp_path / "none"))).collect() == []


PAGE = """<!DOCTYPE html><html><head><title>t</title><script>var x="</p>";</script></head><body><nav><ul><li><a href="/a">Menu</a></ul></nav>
<div class="ad">Buy</div><article><h1>Head &amp; line</h1><p><b>First&nbsp;one
 goes on<br><p>Second.</p></article><aside>side</aside><form><p>mail</p></form><div id="comments"><p>nice</p></div><footer>&copy; x</footer></body>"""


def test_html(spark):
    assert html_text.main_text(PAGE) == "Head & line\nFirst one goes on\nSecond."
    assert [html_text.main_text(x) for x in (None, "", "plain text", "<p>", "<div>a<")] == ["", "", "plain text", "", "a<"]
    body = "<div class=post><h1>T</h1><p>" + prose(40, 400) + "<p>" + prose(30, 401) + "</div><div class=sidebar><a href=1>more</a></div>"
    assert html_text.main_text(body) == "T\n" + prose(40, 400) + "\n" + prose(30, 401)
    pages = spark.createDataFrame([(1, "u", PAGE), (1, "u", PAGE), (None, None, None)], "page_id long, url string, html string")
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in html_text.extract(pages).collect()) == [(0, "", 0)] + [(1, html_text.main_text(PAGE), 37)] * 2


def test_notices_longer_than_the_article_stay_cut():
    assert html_text.main_text(f"<body><div class=ad>{prose(30, 413)}</div><article><h1>Title</h1><p>Title.</article>") == "Title\nTitle."


def test_comments_that_are_articles_stay_cut_beside_the_article():
    page = f"<body><div class=has-sidebar><article><div class='post related-enabled'><p>{prose(40, 414)}</div></article><div id=comments><article>{prose(30, 415)}</article></div></div>"
    assert html_text.main_text(page) == prose(40, 414)


def test_urls(spark):
    rows = [(1, "http://Www.Example.com/en/12?x"), (2, "https://example.com/en/7#t"), (3, "http://a.example.net/de/81"), (4, "http://b.net/de/1"), (5, "http://bad.biz/1"), (6, None), (7, "nothing"), (8, "http://x.org"), (9, "http://notexample.com/en/7")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    outcomes = spark.createDataFrame([("http://bad.biz/x", 1)] * 40 + [("http://x.org/", 0)] * 40, "url string, bad int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_reputation.judge_urls(pages, outcomes).collect()}
    assert got == {
        1: ("www.example.com", "/en/12", "com/en/", "block"), 2: ("example.com", "/en/7", "example.com/en/7", "allow"), 3: ("a.example.net", "/de/81", "example.net/de/8", "block"), 4: ("b.net", "/de/1", "net/de/", "allow"),
        5: ("bad.biz", "/1", None, "block"), 6: ("", "", None, "allow"), 7: ("", "", None, "allow"), 8: ("x.org", "", None, "allow"), 9: ("notexample.com", "/en/7", "com/en/", "block"),
    }
    assert {r.verdict for r in url_reputation.judge_urls(pages.where("page_id = 5"), outcomes.where("false")).collect()} == {"allow"}


def test_toxicity_learns_and_scores_whole_tables(spark):
    rows = [(i, prose(40, 500 + i) + (" gribbleword" if i % 3 == 0 else "")) for i in range(150)] + ODD
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(150)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    out = toxicity.score(docs(spark, rows), toxicity.train(docs(spark, rows), labels)).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    assert all((r.score >= 0.5) == (r.doc_id % 3 == 0) for r in out if r.doc_id is not None and r.doc_id < 150)
    empty = toxicity.score(docs(spark, rows), toxicity.train(docs(spark, rows), labels.where("false")))
    assert empty.count() == len(rows)


def test_machine_learns_a_pair():
    terms = [np.array(t) for t in ([5], [9], [5, 9], [77]) for _ in range(60)]
    toxic = np.array([0] * 120 + [1] * 60 + [0] * 60)
    m = toxicity.fit(terms, toxic)
    text, bucket = np.array([0, 1, 2, 2]), np.array([5, 9, 5, 9])
    p = m.scores(text, bucket, 4)
    assert p[2] > 0.5 and p[0] < 0.5 and p[1] < 0.5 and p[3] < 0.5


def test_machine_learns_where_only_the_pair_tells():
    r = np.random.default_rng(1)
    first, second = r.integers(0, 2, 4_000), r.integers(0, 2, 4_000)  # either alone is toxic, neither or both aren't
    terms = [np.unique(np.concatenate([[11][:a], [22][:b], r.choice(np.arange(100, 160), 8, replace=False)]).astype(np.int64)) for a, b in zip(first, second, strict=True)]
    toxic = (first != second).astype(int)
    m = toxicity.fit(terms[:3_000], toxic[:3_000])
    p = m.scores(np.repeat(np.arange(1_000), [len(t) for t in terms[3_000:]]), np.concatenate(terms[3_000:]), 1_000)
    assert ((p >= 0.5) == toxic[3_000:]).mean() > 0.7


def test_machine_equals_the_sum_over_pairs():
    r = np.random.default_rng(5)
    m = toxicity.Machine(0.3, np.sort(r.choice(1 << toxicity.BUCKET_BITS, 40, replace=False)), r.normal(size=40), r.normal(size=(40, 8)) / 3)
    texts = [r.choice(40, int(r.integers(0, 12)), replace=False) for _ in range(30)]
    want = []
    for t in texts:
        margin = m.bias + sum(m.weights[i] for i in t) + sum(float(m.factors[i] @ m.factors[j]) for a, i in enumerate(t) for j in t[a + 1 :])
        want.append(1 / (1 + np.exp(-margin)))
    text = np.concatenate([np.full(2 * len(t), k) for k, t in enumerate(texts)])
    bucket = np.concatenate([m.buckets[np.concatenate([t, t])] for t in texts])  # repeats count once
    assert np.allclose(m.scores(text, bucket, 30), want)


def test_words_split_like_a_regular_expression():
    texts = ["A b c\x0bD", None, "", "é\tx", " x ", "  y"]
    w = tokens.Words(pa.array(texts))
    assert np.diff(w.bounds).tolist() == [len(words(t)) for t in texts]


def test_pipeline(spark, tmp_path, copies):
    import corpus_pipeline

    good = [(i, t) for i, t in copies if i < 7]
    item = prose(40, 800)
    rows = good + [(50 + i, prose(100, 700 + i)) for i in range(5)] + [(60, prose(30, 801) + " " + item), (61, "bad % " * 3)] + ODD
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in [*range(7), *range(50, 55), 60]], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == {0, 2, 4, 5, 6, 50, 51, 52, 53, 54}


@pytest.mark.parametrize("changed", [(), (2,)])
def test_passages_around_a_stock_phrase_of_a_smaller_document(spark, changed):
    # many smaller documents have the phrase alone; in one of them the phrase stands early and the passage later
    stock = prose(40, 900)
    rows = [(i, prose(40, 910 + i) + " " + stock + " " + prose(60, 930 + i)) for i in range(12)]
    rows.append((12, prose(40, 950) + " " + stock + " " + prose(70, 951) + " " + prose(6, 952) + " " + stock + " " + prose(6, 953) + " " + prose(40, 954)))
    for k in range(20):
        passage = (prose(6, 1000 + k) + " " + stock + " " + prose(6, 1100 + k)).split()
        copy = passage.copy()
        for c in changed:
            copy[c] = "changed"
        rows += [(100 + 2 * k, prose(50, 1200 + k) + " " + " ".join(passage) + " " + prose(50, 1300 + k)), (101 + 2 * k, prose(30, 1400 + k) + " " + " ".join(copy) + " " + prose(70, 1500 + k))]
    rows.append((200, prose(30, 960) + " " + prose(6, 952) + " " + stock + " " + prose(6, 953) + " " + prose(50, 961)))
    found = substrings.repeated_passages(docs(spark, rows)).collect()
    cover = {(r.doc_id, r.source_id): (r.start_word, r.end_word) for r in found}
    for k in range(20):
        a, b = cover[101 + 2 * k, 100 + 2 * k]
        assert a <= 30 + 8 and b >= 82, k
    assert cover[200, 12][0] <= 30 and cover[200, 12][1] >= 82
    assert {d for d, _ in cover} == {101 + 2 * k for k in range(20)} | {200}


@pytest.mark.parametrize("start, end", [
    ('<body><div class="content-sidebar-wrap">', "</div>"), ('<body><div id="page" class="has-sidebar">', "</div>"), ('<body><div class="post related-enabled">', "</div>"),
    ("<head><title>t</title><body>", ""), ("<head><meta charset=utf-8><title>t</title>", ""), ('<body><form id="aspnetForm">', "</form>"),
])
@pytest.mark.parametrize("tag", ["article", "div"])
def test_wrappers_open_heads_and_page_wide_forms_keep_the_text(start, end, tag):
    page = f"<html>{start}<{tag}><p>{prose(40, 410)}<p>{prose(30, 411)}</{tag}><div class=sidebar>{prose(5, 412)}</div><form><p>mail</form>{end}</html>"
    assert html_text.main_text(page) == prose(40, 410) + "\n" + prose(30, 411)


def test_thresholds_choose_beside_an_article():
    parts = [prose(60, 420 + k) for k in range(4)]
    two = f"<main><article><p>{parts[0]}<p>{parts[1]}</article><article><p>{parts[2]}<p>{parts[3]}</article></main>"
    assert html_text.main_text(two) == "\n".join(parts)
    beside = f"<article><p>{parts[0]}<p>{parts[1]}</article><div><p>{parts[2]}<p>{parts[3]}</div><ul><li><a href=1>one</a><li><a href=2>two</a></ul>"
    assert html_text.main_text(beside) == "\n".join(parts)


def test_density_sums_against_recursion():
    import math

    def weighed(node):
        texts = [len(" ".join(x.split())) for x in node.items if isinstance(x, str)]
        inner = [x for x in node.items if isinstance(x, html_text.Node)]
        below = [weighed(x) for x in inner]
        chars, tags = sum(texts) + sum(b[0] for b in below), len(below) + sum(b[1] for b in below)
        links = chars if node.tag == "a" else sum(b[2] for b in below)
        link_tags = (node.tag == "a") + sum(b[3] for b in below)
        return chars, tags, links, link_tags

    def density(node, share):
        chars, tags, links, link_tags = weighed(node)
        if not chars:
            return 0.0
        base = math.log(chars / max(1, chars - links) * links + share * chars + math.e)
        value = math.log(max(chars / max(1, links) * max(1, tags) / max(1, link_tags), 1.0))
        return chars / max(1, tags) * value / (math.log(base) if base > 1 else 1)

    page = f"<body><div><p>{prose(40, 430)}<a href=1>{prose(3, 431)}</a><div><p>{prose(50, 432)}<ul><li><a>x y</a><li>{prose(9, 433)}</ul></div></div><p>{prose(5, 434)}"
    nodes = html_text._uncut(html_text.parse(page))
    html_text._weigh(nodes)
    chars, _, links, _ = weighed(nodes[0])
    for node in nodes:
        want = sum(density(x, links / max(1, chars)) for x in node.items if isinstance(x, html_text.Node) and x.tag != "a")
        assert abs(node.sum - want) < 1e-6 and abs(node.density - density(node, links / max(1, chars))) < 1e-6


def test_density_chooses_without_article_or_marked_classes():
    links = "".join(f"<li><a href={k}>{prose(3, 440 + k)}</a></li>" for k in range(30))
    text = [prose(60, 470 + k) for k in range(3)]
    page = f"<body><div><ul>{links}</ul></div><div><div>{''.join(f'<p>{t}</p>' for t in text)}</div></div><div><ul>{links}</ul></div>"
    assert html_text.main_text(page) == "\n".join(text)


def test_pages_in_linear_time(spark):
    import time

    def took(page):
        began = time.process_time()
        html_text.main_text(page)
        return time.process_time() - began

    for make in (lambda n: "<div>" * n + "text " * 20, lambda n: "<p>" + "word</b> " * n, lambda n: "<span>" * n + "<div>x</div>" * n, lambda n: "<b><div>" * n + "</b>x" * n):
        assert took(make(40_000)) < 8 * took(make(10_000)) + 0.5
    deep = "<div>" * 10_000 + f"<p>{prose(40, 480)}"
    pages = spark.createDataFrame([(1, "u", deep)], "page_id long, url string, html string")
    assert [r.text for r in html_text.extract(pages.selectExpr("*", "'x' as text", "1 as n_chars")).collect()] == [prose(40, 480)]
    assert html_text.extract(pages.where("false")).collect() == []


def test_oracles_are_sql_of_registered_queries():
    import __spark_entry__ as entry

    assert all(isinstance(x, str) for x in entry.oracle_sql().values()) and set(entry.oracle_sql()) <= set(entry.queries())


def paragraphs(n, seed, size=40):
    return [prose(size, seed + k) for k in range(n)]


@pytest.mark.parametrize("start, end", [("<article>", "</article>"), ("<main>", "</main>"), ("", "")])
def test_names_and_attribute_values_that_are_no_markup_keep_the_text(start, end):
    texts = paragraphs(6, 2000)
    titled = f"<body>{start}<div title='The hidden costs'><p>{texts[0]}<p>{texts[1]}</div>{end}"
    assert html_text.main_text(titled) == "\n".join(texts[:2])
    for name in ("elementor-widget", "widget", "wp-block-widget col"):
        page = f"<body>{start}{''.join(f'<div class={chr(34)}{name}{chr(34)}><p>{t}</p></div>' for t in texts)}{end}"
        assert html_text.main_text(page) == "\n".join(texts), name
    for attribute in ("aria-label='the hidden costs'", "id=related-work", "id='social-history'", "class='not-hidden'", "data-x='display:none'", "hidden=until-found"):
        page = f"<body>{start}<p>{texts[0]}</p><section {attribute}><h2>Head</h2><p>{texts[1]}</section><p>{texts[2]}</p>{end}"
        assert html_text.main_text(page) == f"{texts[0]}\n" + f"Head\n{texts[1]}\n{texts[2]}", attribute


@pytest.mark.parametrize("start, end", [("<article>", "</article>"), ("", "")])
@pytest.mark.parametrize("part", [
    "<div class='post-comments'><p>{}</div>", "<section id=comments-section><p>{}</section>", "<ul class='related-stories'><li><a href=1>{}</a></ul>", "<div hidden><p>{}</div>", "<p aria-hidden='true'>{}</p>",
    "<div style='color: red; display: none'><p>{}</div>", "<div class=commentList><p>{}</div>", "<div role='complementary'>{}</div>", "<div class='ad-box-300'>{}</div>", "<nav>{}</nav>",
])
def test_what_is_no_article_stays_cut_beside_long_text(start, end, part):
    texts = paragraphs(4, 2100)
    page = f"<body>{start}<p>{texts[0]}</p>{part.format(prose(20, 2200))}<p>{texts[1]}<p>{texts[2]}<p>{texts[3]}{end}"
    assert html_text.main_text(page) == "\n".join(texts)


def test_density_leaves_link_lists_that_no_name_marks():
    links = "".join(f"<li><a href={k}>{prose(4, 2300 + k)}</a>" for k in range(25))
    texts = paragraphs(5, 2400)
    page = f"<body><div><ul>{links}</ul></div><div><div><h1>Title</h1>{''.join(f'<p>{t}' for t in texts)}</div><div><ul>{links}</ul></div></div><div><a href=x>{prose(3, 2450)}</a> {prose(2, 2451)}</div>"
    got = html_text.main_text(page)
    assert got.startswith("Title\n" + "\n".join(texts)) and prose(4, 2305) not in got


def test_pages_with_odd_rows_and_columns(spark):
    rows = spark.createDataFrame([(1, "u", PAGE, "x"), (None, None, "", "y"), (2, None, None, None), (2, None, None, None)], "page_id long, url string, html string, text string")
    got = Counter((r.page_id, r.url, r.n_chars) for r in html_text.extract(rows).collect())
    assert got == Counter({(1, "u", 37): 1, (None, None, 0): 1, (2, None, 0): 2})


def test_toxicity_counts_an_id_once(spark):
    rows = [(i, prose(40, 500 + i) + (" gribbleword" if i % 3 == 0 else "")) for i in range(150)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(150)] * 2, "doc_id long, toxic int")
    repeated = docs(spark, rows).union(docs(spark, [(1, prose(40, 501))]).select(F.explode(F.sequence(F.lit(1), F.lit(20_000))).alias("k"), "*").drop("k"))
    once, often = toxicity.train(docs(spark, rows), labels), toxicity.train(repeated, labels)
    assert (once.buckets == often.buckets).all() and np.allclose(once.weights, often.weights) and np.allclose(once.factors, often.factors)
    extra = docs(spark, rows).selectExpr("*", "1 as toxic", "2 as mark", "3 as terms", "4 as score")
    assert toxicity.score(extra, toxicity.train(extra, labels)).count() == 150


def plain_finds(rows, items):
    """All places of all items in all documents, one by one."""
    split = lambda t: [w for w in re.split("[^0-9A-Za-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]
    out = set()
    for d, t in rows:
        for i, item in items:
            x, y = split(t), split(item)
            size = min(13, len(y))
            if size >= 6 and any(100 * sum(a == b for a, b in zip(x[p : p + size], y[q : q + size], strict=True)) >= 80 * size for p in range(len(x) - size + 1) for q in range(len(y) - size + 1)):
                out.add((d, i))
    return out


def test_contaminated_against_a_plain_scan_in_many_blocks(spark, monkeypatch):
    r = np.random.default_rng(3)
    items, rows = [], []
    for i in range(14):
        item = prose(int(r.integers(6, 40)), 2500 + i).split()
        items.append((i, " ".join(item)))
        for k in range(4):
            at = int(r.integers(0, max(1, len(item) - 12)))
            copy = item[at : at + int(r.integers(5, 30))]
            for c in r.choice(len(copy), int(r.integers(0, 1 + len(copy) // 4)), replace=False):
                copy[c] = f"other{c}"
            rows.append((4 * i + k, prose(int(r.integers(0, 40)), 2600 + 4 * i + k) + " " + " ".join(copy) + ". " + prose(int(r.integers(0, 30)), 2700 + 4 * i + k)))
    items += [(100, items[3][1]), (101, None), (102, "")]
    rows += [(900 + k, rows[k][1]) for k in range(5)] + [(950, " ".join(t for _, t in rows)), (951, None), (952, "")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    want = plain_finds(rows, items)
    extra = docs(spark, rows).selectExpr("*", "1 as item", "2 as n_equal")
    assert {(x.doc_id, x.item_id) for x in decontamination.contaminated(extra, benchmark).collect()} == want and len(want) > 20
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", 60)
    assert {(x.doc_id, x.item_id) for x in decontamination.contaminated(extra, benchmark).collect()} == want


def as_documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_near_dedup_stage_loses_no_text_of_a_repeated_id(spark):
    import corpus_pipeline

    a, b = prose(60, 2800), prose(60, 2801)
    rows = [(3, a), (5, a), (5, b), (6, b), (7, None), (None, a), (8, ""), (9, a)]
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, as_documents(spark, rows), "").collect())
    assert {t for _, t in got} == {a, b, None, ""} and got == Counter([(3, a), (5, a), (5, b), (7, None), (None, a), (8, "")])


def test_stages_of_empty_tables_and_hot_groups(spark, tmp_path):
    import corpus_pipeline

    as_documents(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, as_documents(spark, []), str(tmp_path))
        assert out.collect() == [] and out.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    passage = prose(60, 2900)
    hot = [(i, prose(30, 2901)) for i in range(200)] + [(300 + i, prose(60, 3000 + i) + " " + passage + " " + prose(60, 3100 + i)) for i in range(60)]
    kept = corpus_pipeline.near_dedup(spark, as_documents(spark, hot), str(tmp_path))
    assert {r.doc_id for r in kept.collect()} == {0} | set(range(300, 360))
    cut = {r.doc_id: r for r in corpus_pipeline.substring_dedup(spark, kept, str(tmp_path)).collect()}
    assert passage in cut[300].text and all(passage not in cut[i].text and cut[i].n_chars == len(cut[i].text) for i in range(301, 360))


def test_similar_passages_are_recalled(spark):
    """Passages of 52 to 120 words of which one word is changed, put in or left out, with stock phrases around: 0.95 found."""
    r, rows, want = np.random.default_rng(9), [], set()
    stock = [prose(12, 3200 + k) for k in range(3)]
    for k in range(120):
        size = int(r.integers(52, 121))
        passage = prose(size, 3300 + k).split()
        copy, at = passage.copy(), int(r.integers(0, size))
        copy[at : at + int(k % 3 != 1)] = [] if k % 3 == 2 else [f"new{k}"]
        if k % 3 == 2 and size == 52:
            continue
        for i, p in ((2 * k, passage), (2 * k + 1, copy)):
            rows.append((i, " ".join([prose(30, 3500 + i), stock[k % 3], *p, stock[(k + i) % 3], prose(30, 3800 + i)])))
        want.add((2 * k + 1, 2 * k))
    found = substrings.repeated_passages(docs(spark, rows + rows[:4]))
    got = {(x.doc_id, x.source_id) for x in found.collect()}
    assert len(got & want) >= 0.95 * len(want) and not got - want and found.count() == found.distinct().count()


def test_very_long_texts(spark):
    """Texts of 40,000 words beside short ones: near copies, passages, quality figures and packing see all of them."""
    long = prose(40_000, 4000).split()
    near = long.copy()
    near[20_000] = "changed"
    passage = prose(60, 4001)
    rows = [(1, " ".join(long)), (2, " ".join(near)), (3, " ".join(long[:39_000]) + " " + prose(5, 4002)), (4, prose(30, 4003) + " " + passage), (5, prose(39_000, 4004) + " " + passage + " " + prose(500, 4005))]
    found = {r.doc_id: r for r in minhash.near_duplicates(docs(spark, rows)).collect()}
    assert [found[i].component_id for i in range(1, 6)] == [1, 1, 1, 4, 5] and found[1].n_shingles == 39_996
    spans = {(r.doc_id, r.source_id): (r.start_word, r.end_word) for r in substrings.repeated_passages(docs(spark, rows[3:])).collect()}
    assert spans[5, 4][0] <= 39_000 + 2 and spans[5, 4][1] >= 39_060 - 2
    figures = {r.doc_id: r for r in quality.quality(docs(spark, rows), spark.createDataFrame([(1,)], "doc_id long")).collect()}
    assert figures[1].n_words == 40_000 and figures[1].word_chars == 240_000 and figures[5].n_words == 39_560
    pieces = packing.pack(docs(spark, rows[:1])).collect()
    assert sum(r.length for r in pieces) == len(encoded([rows[0][1]])[0]) + 1 and len(pieces) == -(-sum(r.length for r in pieces) // 1024)


def test_near_duplicates_of_repeated_rows(spark):
    text = prose(50, 4100)
    rows = [(4, text), (4, text), (2, text), (9, None), (9, None)]
    got = Counter((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(docs(spark, rows)).collect())
    assert got == Counter({(4, 2, False): 2, (2, 2, True): 1, (9, 9, True): 2})


def test_urls_of_empty_tables_and_repeated_rows(spark):
    pages = spark.createDataFrame([(1, "http://bad.biz/1", "x"), (1, "http://bad.biz/1", "y"), (None, None, "z")], "page_id long, url string, host string")
    outcomes = spark.createDataFrame([("http://bad.biz/x", 1)] * 40, "url string, bad int")
    got = Counter((r.page_id, r.host, r.verdict) for r in url_reputation.judge_urls(pages, outcomes).collect())
    # every outcome is bad, so the priors block a host without any of its own too
    assert got == Counter({(1, "bad.biz", "block"): 2, (None, "", "block"): 1})
    assert url_reputation.judge_urls(pages.where("false"), outcomes).collect() == []


def test_rows_for_workers_come_in_bounded_batches(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = [r["n"] for r in stored(spark.range(0, 2500, 1, 1).mapInArrow(sizes, "n long")).collect()]
    assert sorted(got) == [500, 1000, 1000]
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_windows_are_computed_once(spark, monkeypatch):
    d = docs(spark, [(i, prose(80, 40) + " " + prose(60, i)) for i in range(8)])
    once, made = substrings.windows(d).count(), spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    plain = substrings.windows
    monkeypatch.setattr(substrings, "windows", lambda *a: plain(*a).mapInArrow(counted, "key long, doc_id long, spot long"))
    assert substrings.repeated_passages(d).select("doc_id").distinct().count() == 7
    assert made.value == once > 0


def test_workers_let_the_encoder_go_for_other_operators(spark):
    def left(batches):
        for part in tokens.slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([pa.array([encoder.cache_info().currsize] * part.num_rows, pa.int32())], ["n"])

    def kept(batches):
        for part in tokens.slices(batches, "text", keep="encoder"):
            yield pa.RecordBatch.from_arrays([pa.array([encoder.cache_info().currsize] * part.num_rows, pa.int32())], ["n"])

    d = docs(spark, [(i, prose(50, i)) for i in range(64)]).repartition(4)
    rows = packing.pack(d).count()
    assert any(r["n"] for r in d.select("text").mapInArrow(kept, "n int").collect())  # its own tasks find it again
    assert [r["n"] for r in d.select("text").mapInArrow(left, "n int").collect()] == [0] * 64
    assert packing.pack(d).count() == rows  # and make it anew
