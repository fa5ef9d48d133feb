"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator; results against brute force."""

import hashlib
import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from weft.llm import bpe, embedding_dedup, html_extract, lm_scoring, minhash, packing, quality_classifier, quality_rules, token_files, token_rollup
from weft.llm.components import components
from weft.llm.queries import BYTE_VOCABULARY, WORD_VOCABULARY
from weft.llm.storage import new_path
from weft.llm.tokenize import CachedEncoder, read_vocabulary

LONG = "the long tale of " * 9000 + "\n\n\n   end"
TEXTS = {
    1: "Hello world, it's a   fine day.\nAgain\n\n\nand again",
    2: None,
    3: "",
    4: "one",
    5: "one two",
    6: "Straße über naïve façade déjà vu — 中文字符 😀   nbsp",
    7: LONG,
    8: "<|endoftext|> marks <|ENDOFTEXT|> and <|startoftext|>",
    9: "x" * 30_000,
    10: " \t\r\n ",
    11: "Hello world, it's a   fine day.\nAgain\n\n\nand again",
}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_tokens string, length string, kept string, quality string, node string, component string, start string, target string, score string"


def frame(spark, texts=TEXTS):
    """Also a row without an id, a repeated row, and columns named as the operators name theirs."""
    rows = [(k, v, None if k == 4 else "en", "s" if k % 2 else None, None) + ("x",) * 9 for k, v in texts.items()]
    rows += [(None, "no id here", "en", "s", 1) + (None,) * 9, rows[0]] if rows else []
    return spark.createDataFrame(rows, SCHEMA)


def pairs(texts=TEXTS):
    return [*texts.items(), (None, "no id here"), next(iter(texts.items()))]


def key(x):
    return -1 if x is None else x


def u32(ids):
    return np.array(ids, dtype="<u4").tobytes()


def test_bpe_against_library(spark):
    t = Tokenizer.from_file(BYTE_VOCABULARY)
    expected = []
    for i, x in pairs():
        ids = t.encode(x or "", add_special_tokens=False).ids
        expected.append((key(i), len(ids), hashlib.sha256(u32(ids)).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    rows = bpe.digests(frame(spark), BYTE_VOCABULARY).collect()
    assert sorted((key(r[0]), *r[1:]) for r in rows) == sorted(expected)
    back = bpe.decode(bpe.encode(frame(spark), BYTE_VOCABULARY).withColumn("decoded", F.lit(1)), BYTE_VOCABULARY)
    assert Counter(r["decoded"] for r in back.collect()) == Counter((x or "") for _, x in pairs())
    assert bpe.digests(frame(spark, {}), BYTE_VOCABULARY).count() == 0


@pytest.mark.parametrize("path,make", [(BYTE_VOCABULARY, bpe.PrefixCoder), (BYTE_VOCABULARY, CachedEncoder), (WORD_VOCABULARY, CachedEncoder)])
def test_encoders_on_odd_texts(path, make):
    draw = random.Random(7)
    parts = ["a", "aa", "  ", "\n", "\t", "th", "é", "ß", "中", "😀", "'s", "1", "23", "***", "<|endoftext|>", "\x1c", "́", "İ", "Σ", "²", "\x85", "\xa0", " ", "\r\n", "_"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 50))) for _ in range(1500)]
    texts += ["".join(chr(draw.choice([draw.randint(1, 127), draw.randint(128, 0x2FFF)])) for _ in range(40)) for _ in range(800)]
    texts += ["a" * 5000, " " * 3000, "\n" * 999 + "x", "ab" * 4000]
    library, own = Tokenizer.from_file(path), make(read_vocabulary(path), 500)  # a small memory, so that it turns over
    expected = [u32(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert own.encode([x.encode() for x in texts]) == expected


def test_prefix_coder_has_one_last_token_per_prefix():
    own = bpe.PrefixCoder(read_vocabulary(BYTE_VOCABULARY))
    for text in (b" international", b"aaaaaaaaaaaaa", " über".encode()):
        for n in range(1, len(text) + 1):
            fits = [t for t in own.whole if text[:n].endswith(t) and (len(t) == n or own._parted(own.piece(text[: n - len(t)])[-1], own.whole[t]))]
            assert fits == [own.texts[own.piece(text[:n])[-1]]]


def test_elias_fano():
    for n in (0, 1, 2, 7, 300, 5000):
        for top in (1, 300, 100_000):
            v = np.cumsum(np.random.default_rng(n).integers(0, top, n))
            e = token_files.EliasFano.encode(v)
            assert (e.decode() == v).all()
            assert [e.select(i) for i in range(n)] == v.tolist()
    with pytest.raises(IndexError):
        e.select(5000)
    big = token_files.EliasFano.encode(np.arange(100_000) * 1000)
    assert 8 * (len(big.low) + len(big.high)) < 100_000 * (2 + np.log2(1000) + 1)


@pytest.mark.parametrize("shard", [50, 4_000_000])
def test_token_files(spark, shard):
    t = Tokenizer.from_file(BYTE_VOCABULARY)
    path = new_path(spark, "t")
    token_files.write(frame(spark), BYTE_VOCABULARY, path, shard_ids=shard)
    rows = token_files.read(spark, path, with_ids=True).collect()
    ordered = sorted(pairs(), key=lambda p: (key(p[0]), p[1] or ""))
    at, expected = 0, []
    for i, x in ordered:
        ids = u32([*t.encode(x or "", add_special_tokens=False).ids, 2])
        expected.append((key(i), at, len(ids) // 4, zlib.crc32(ids), ids))
        at += len(ids) // 4
    assert sorted(((key(r[0]), *r[1:4], bytes(r[4])) for r in rows), key=lambda r: r[1]) == expected
    assert token_files.round_trip(frame(spark, {}), BYTE_VOCABULARY).count() == 0


def test_embedding_dedup(spark):
    draw = np.random.default_rng(3)
    base = draw.standard_normal((12, 16))
    rows = []
    for k in range(300):
        v = base[k % 12] + draw.standard_normal(16) * (0.05 if k % 3 else 0.16)
        rows.append((k, v.tolist(), k % 3, "x", "y"))
    rows += [(1000 + k, base[0].tolist(), 0, None, None) for k in range(40)]  # copies
    rows += [(2000, (base[0] * 1e200).tolist(), 0, None, None), (2001, None, 0, None, None), (2002, [0.0] * 16, 0, None, None), (2003, [float("nan")] * 16, 0, None, None), (2004, base[0].tolist(), None, None, None), (2005, [None, *base[0][1:].tolist()], 0, None, None), (2006, base[0][:8].tolist(), 0, None, None), (2007, [float("inf"), *base[0][1:].tolist()], 0, None, None), (None, base[0].tolist(), 0, None, None), (5, rows[5][1], 5 % 3, None, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, node string, n_links string")
    for block in (1024, 16):  # small blocks give the same
        found = {r.vec_id: r for r in embedding_dedup.near_duplicates(df, embedding_dedup.SignHash(block=block)).collect()}
        usable = {r[0]: (np.array(r[1]), r[2]) for r in rows if r[0] is not None and (r[0] < 2001 or r[0] == 2006)}
        parent = {k: k for k in usable}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        links = Counter()
        for a in usable:
            for b in usable:
                (x, lx), (y, ly) = usable[a], usable[b]
                if a < b and lx == ly and len(x) == len(y):
                    x, y = x / np.abs(x).max(), y / np.abs(y).max()
                    if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93:
                        links[a] += 1
                        links[b] += 1
                        parent[max(root(a), root(b))] = min(root(a), root(b))
        for k in usable:
            assert (found[k].n_links, found[k].component_id, found[k].kept) == (links[k], root(k), root(k) == k)
        for k in (2001, 2002, 2003, 2004, 2005, 2007):
            assert (found[k].n_links, found[k].component_id, found[k].kept) == (0, k, True)
        assert found[None].component_id is None and found[None].kept
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_packing_plan(seed):
    draw = random.Random(seed)
    histogram = {draw.randint(1, 64): draw.randint(1, 90) for _ in range(draw.choice([1, 3, 30]))}
    runs, n = packing.plan(histogram, 64)
    rooms, held = [], Counter()
    for r in runs:
        held[r.length] += r.count
    assert held == histogram
    places = {}
    for r in runs:
        for q in range(r.count):
            places.setdefault(r.sequence + q // r.each, []).append((r.offset + q % r.each * r.length, r.length))
    assert sorted(places) == list(range(n))
    for x in places.values():
        end = 0
        for at, size in sorted(x):
            assert at == end
            end += size
        assert end <= 64
    for size in sorted((s for s in histogram for _ in range(histogram[s])), reverse=True):  # best fit, piece by piece
        fits = [k for k, r in enumerate(rooms) if r >= size]
        k = min(fits, key=lambda k: rooms[k], default=None)
        if k is None:
            rooms.append(64 - size)
        else:
            rooms[k] -= size
    assert n == len(rooms)


def test_packing(spark):
    t = Tokenizer.from_file(WORD_VOCABULARY)
    rows = packing.best_fit(frame(spark), WORD_VOCABULARY, with_ids=True).collect()
    expected = Counter()
    for i, x in pairs():
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 1]
        for at in range(0, len(ids), 4096):
            expected[(key(i), at // 4096, at, len(ids[at : at + 4096]), u32(ids[at : at + 4096]))] += 1
    assert Counter((key(r.doc_id), r.piece, r.start, r.length, bytes(r.ids)) for r in rows) == expected
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in rows)
    held = {}
    for r in rows:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for x in held.values():
        x.sort()
        assert [a for a, _ in x] == [sum(n for _, n in x[:k]) for k in range(len(x))] and sum(n for _, n in x) <= 4096
    assert packing.best_fit(frame(spark, {}), WORD_VOCABULARY).count() == 0


def test_classifier(spark):
    texts = dict(TEXTS) | {100 + k: ("alpha beta gamma delta. Rivers run to the sea and fields are green, " * (k % 5 + 1) + str(k)) if k % 2 else "BUY!! NOW!! " * (k % 7 + 4) for k in range(120)}
    labels = spark.createDataFrame([(k, k % 2, 0) for k in texts if k >= 100] + [(None, 1, 0), (1, None, 0), (4, 7, 1), (5, 0, 0), (5, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality_classifier.classify(frame(spark, texts), labels).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        if r.doc_id is not None and r.doc_id >= 100:
            assert r.predicted == r.doc_id % 2
    # what is held out has no say: other labels there, same scores
    turned = labels.withColumn("quality", F.when(quality_classifier.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality_classifier.classify(frame(spark, texts), turned).collect()
    assert sorted((key(r.doc_id), round(r.score, 12)) for r in rows) == sorted((key(r.doc_id), round(r.score, 12)) for r in again)
    assert {r.score for r in quality_classifier.classify(frame(spark), labels.limit(0)).collect()} == {0.5}
    assert quality_classifier.classify(frame(spark, {}), labels).count() == 0


def test_discriminant_is_the_density_ratio():
    draw = np.random.default_rng(1)
    d = len(quality_classifier.FEATURES)
    x = {c: draw.standard_normal((400, d)) @ draw.standard_normal((d, d)) + c for c in (0, 1)}
    m = quality_classifier.fit({c: (400.0, v.sum(axis=0), v.T @ v) for c, v in x.items()}, 0.0, 0.0, 1.0)
    point = x[1][:5]
    logs = []
    for c in (0, 1):
        mean, cov = x[c].mean(axis=0), np.cov(x[c].T, bias=True)
        z = point - mean
        logs.append(-0.5 * np.einsum("ij,jk,ik->i", z, np.linalg.inv(cov), z) - 0.5 * np.linalg.slogdet(cov)[1])
    assert np.allclose(m.score(point), 1 / (1 + np.exp(-np.clip(logs[1] - logs[0], -60, 60))), atol=1e-6)


def test_lm_scoring(spark):
    how = lm_scoring.Bigrams(words=64, pairs=128)
    texts = dict(TEXTS) | {50 + k: f"to be or not to be {k % 3} that is the question" for k in range(8)}
    wanted = spark.createDataFrame([(50,), (52,), (52,), (1,), (None,), (999,)], "doc_id long")
    rows = lm_scoring.score(frame(spark, texts), wanted, how).collect()
    held = pairs(texts)
    target = {50, 52, 1}
    counts = {True: np.zeros(how.slots), False: np.zeros(how.slots)}
    for i, x in held:
        for at in lm_scoring.places((x or "").encode(), how):
            np.add.at(counts[False], at, 1)
            if i in target:
                np.add.at(counts[True], at, 1)

    def loss(c, total, scale, w, b, p):
        out = 0.0
        for x, y, z in zip(w, b, p, strict=True):
            one = (c[x] * scale + how.add) / (total * scale + how.add * how.words)
            out -= np.log((c[z] * scale + how.prior * one) / (c[y] * scale + how.prior))
        return out / len(w)

    expected = []
    for i, x in held:
        w, b, p = lm_scoring.places((x or "").encode(), how)
        if not len(w):
            expected.append((key(i), 0, 0.0, 0.0, 0.0))
            continue
        own = np.zeros(how.slots)
        for at in (w, b, p):
            np.add.at(own, at, 1)
        t, n = counts[True] - (own if i in target else 0), counts[False] - own
        st, sn = t[: how.words].sum(), n[: how.words].sum()
        lt, ln = loss(t, st, 1.0, w, b, p), loss(n, sn, max(st, 1) / max(sn, 1), w, b, p)
        expected.append((key(i), len(w), lt, ln, ln - lt))
    for got, want in zip(sorted((key(r[0]), *r[1:]) for r in rows), sorted(expected), strict=True):
        assert got == pytest.approx(want, rel=1e-9)
    assert lm_scoring.score(frame(spark, {}), wanted, how).count() == 0


def test_lm_scoring_exact_counts(spark):
    """Words and pairs that share a slot of 2^18 or 2^20 are counted apart, over all documents."""
    many = {100 + k: " ".join(f"w{(k * 7919 + j * j) % 30_000}" for j in range(600)) for k in range(60)}
    texts = TEXTS | many
    rows = lm_scoring.score(frame(spark, texts), spark.createDataFrame([(k,) for k in (1, 100, 107, 121, 121, 999)], "doc_id long")).collect()
    target, how = {1, 100, 107, 121}, lm_scoring.Bigrams()
    held = [(i, (x or "").encode().lower().split()) for i, x in pairs(texts)]
    models = {True: [Counter(), Counter(), Counter()], False: [Counter(), Counter(), Counter()]}
    grams = [(w, [None, *w[:-1]][: len(w)], list(zip([None, *w[:-1]], w, strict=False))) for _, w in held]
    for (i, _), found in zip(held, grams, strict=True):
        for into in [False, True][: 1 + (i in target)]:
            for c, x in zip(models[into], found, strict=True):
                c.update(x)
    vocabulary = len(models[False][0])
    assert vocabulary > 20_000

    expected = []
    for (i, w), found in zip(held, grams, strict=True):
        own = [Counter(x) for x in found]

        def loss(of, out, scale_to=None):
            one, before, pair = ((lambda x, c=c, o=o: c[x] - (o[x] if out else 0)) for c, o in zip(models[of], own, strict=True))
            total = models[of][0].total() - (len(w) if out else 0)
            s = 1.0 if scale_to is None else max(scale_to, 1) / max(total, 1)
            terms = [-np.log((pair(z) * s + how.prior * (one(x) * s + how.add) / (total * s + how.add * vocabulary)) / (before(y) * s + how.prior)) for x, y, z in zip(*found, strict=True)]
            return float(np.mean(terms)) if terms else 0.0

        size = models[True][0].total() - (len(w) if i in target else 0)
        t, b = loss(True, i in target), loss(False, True, size)
        expected.append((key(i), len(w), t, b, b - t))
    for got, want in zip(sorted((key(r[0]), *r[1:]) for r in rows), sorted(expected), strict=True):
        assert got == pytest.approx(want, rel=1e-9, abs=1e-12)


PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body class="post-page">
<header class="site-header"><h2>Site</h2></header><nav><ul><li><a href=1>Home</a><li><a href=2>More</a></ul></nav><div class="cookie-notice">We use cookies.</div>
%s
<aside>Other things to read that are quite long and of no use here at all</aside><section id="comments"><p>First! A reader wrote this long comment about the matter.</p></section><form><label>Mail</label><input></form><footer>&copy; All rights</footer></body></html>"""
ARTICLE = "<article><h1>Head &amp; shoulders</h1><p>Some <b>bold</b>\n  words &lt;here&gt;.<p>Next&nbsp;one<br>line<div class='ad'>Buy</div><ul><li>a<li>b</ul><p>End.</article>"


def test_html(spark):
    text = "Head & shoulders Some bold words <here>. Next one line a b End."
    assert html_extract.main_text(PAGE % ARTICLE) == text
    body = "<div><p>" + "A paragraph of an article that no element marks, long enough to be one. " * 3 + "</p><p>And its second paragraph, which is shorter than that.</p></div>"
    plain = " ".join(["A paragraph of an article that no element marks, long enough to be one."] * 3) + " And its second paragraph, which is shorter than that."
    assert html_extract.main_text(PAGE % (body + "<div><a href=1>x</a> <a href=2>y</a></div>")) == plain
    wrapped = "<div class='layout no-sidebar'><div class='sidebar-right'><article class='post has-comments'><div class='entry-header'><h1>Title</h1></div><p>Body text.</p></article><p>Aside</p></div></div>"
    assert html_extract.main_text(PAGE % wrapped) == "Title Body text."
    comments = "<div id='comments'><article><p>Reader one.</p></article></div><article class='comment'><p>Reader two.</p></article>"
    assert html_extract.main_text(PAGE % (ARTICLE + comments)) == text
    rows = spark.createDataFrame([(1, "u", PAGE % ARTICLE, "z"), (2, None, None, "z"), (3, "u", "", "z"), (None, "u", "<p>open <b>text", "z"), (1, "u", PAGE % ARTICLE, "z"), (5, "u", "<article>" + "<p>word " * 20_000, "z"), (6, "u", "<div>" * 3000 + "deep", "z"), (7, "u", "<script>", "z")], "page_id long, url string, html string, text string")
    got = sorted((key(r.page_id), r.url, r.text, r.n_chars) for r in html_extract.extract(rows).select("page_id", F.coalesce("url", F.lit("")).alias("url"), "text", "n_chars").collect())
    assert got == sorted([(1, "u", text, len(text))] * 2 + [(2, "", "", 0), (3, "u", "", 0), (-1, "u", "open text", 9), (5, "u", " ".join(["word"] * 20_000), 99_999), (6, "u", "deep", 4), (7, "u", "", 0)])
    assert html_extract.extract(rows.limit(0)).count() == 0


def brute_components(sets, num, den):
    ids = sorted(sets)
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {i: root(i) for i in ids}


def word_sets(texts, n):
    out = {}
    for i, x in texts.items():
        w = (x or "").encode().lower().split()
        out[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    return out


@pytest.mark.parametrize("words,num", [(3, 85), (5, 80)])
def test_minhash(spark, words, num):
    draw = random.Random(words)
    lexicon = ["".join(draw.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    texts = dict(TEXTS)
    for g in range(12):
        base = [draw.choice(lexicon) for _ in range(120)]
        for c in range(14):
            w = list(base)
            for _ in range(draw.choice([0, 1, 1, 2, 4])):
                w[draw.randrange(len(w))] = draw.choice(lexicon)
            texts[100 + 20 * g + c] = " ".join(w) if c % 2 else " ".join(w).upper()
    expected = brute_components(word_sets(texts, words), num, 100)
    small = dict(list_block=5, cluster_block=4, block_shingles=700)
    for more in ({}, small):
        rows = minhash.near_duplicates(frame(spark, texts), minhash.MinHash(words=words, numerator=num, **more)).collect()
        assert len(rows) == len(texts) + 2
        for r in rows:
            if r.doc_id is None:
                assert r.component_id is None and r.kept
            else:
                assert r.component_id == expected[r.doc_id] and r.kept == (expected[r.doc_id] == r.doc_id)
                assert r.n_shingles == len(word_sets({0: texts[r.doc_id]}, words)[0])
    kept = minhash.filter_rows(frame(spark, texts), minhash.MinHash(words=words, numerator=num))
    assert kept.columns == frame(spark).columns
    assert sorted(key(r.doc_id) for r in kept.collect()) == [-1, *sorted(set(expected.values()))]
    assert minhash.near_duplicates(frame(spark, {}), minhash.MinHash()).count() == 0


def test_match_threshold_misses_little():
    how = minhash.MinHash(numerator=85)
    draw = np.random.default_rng(0)
    assert (draw.binomial(how.coordinates, 0.85, 200_000) >= how.matches).mean() > 0.9997


def test_components(spark):
    draw = random.Random(5)
    edges = [(a, a + 1) for a in range(0, 60)] + [(100, x) for x in range(200, 260)] + [(draw.randrange(300, 400), draw.randrange(300, 400)) for _ in range(90)] + [(7, 7), (None, 3), (4, None), (61, 60), (60, 61)]
    rows = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    sets = {}
    for a, b in edges:
        if a is not None and b is not None and a != b:
            sets.setdefault(a, set()).add(b)
            sets.setdefault(b, set()).add(a)
    for node in sets:
        seen, todo = {node}, [node]
        while todo:
            for x in sets[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        assert rows[node] == min(seen)
    assert set(rows) == set(sets)
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_rollup(spark):
    store = token_rollup.Rollup(spark, new_path(spark, "r"))
    schema = "source string, lang string, tokenizer_version string, n_tokens long, old_n_tokens long, n_docs string"
    one = spark.createDataFrame([("a", "en", "v1", 10, None, "x"), ("a", "en", "v1", 5, None, "x"), (None, None, "v1", None, None, "x")], schema)
    assert store.totals().count() == 0
    assert store.commit("first/1", token_rollup.inserts(one)) and not store.commit("first/1", token_rollup.inserts(one))
    assert store.commit("second", token_rollup.deletes(one.where("n_tokens = 5")))
    assert store.commit("third", token_rollup.revisions(spark.createDataFrame([("a", "en", "v1", 12, 10, "x")], schema)))
    # a batch that broke off before its marker does not count, and can be committed after all
    (spark.createDataFrame([("a", "en", "v1", 9, 99)], "source string, lang string, tokenizer_version string, n_docs long, n_tokens long").write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(store._folder("broken")))
    assert store.committed() == ["first/1", "second", "third"]
    assert sorted(map(tuple, store.totals().collect()), key=str) == sorted([("a", "en", "v1", 1, 12), (None, None, "v1", 1, 0)], key=str)
    assert store.commit("broken", token_rollup.inserts(one.where("n_tokens = 10")))
    assert {tuple(r) for r in store.totals().collect()} == {("a", "en", "v1", 2, 22), (None, None, "v1", 1, 0)}
    got = token_rollup.maintain(frame(spark), new_path(spark, "r")).collect()
    words = sum(len((x or "").encode().split()) for _, x in pairs() if len((x or "").encode().split()) >= 20)
    assert sum(r.n_tokens for r in got if r.tokenizer_version == "words-1") == words
    assert token_rollup.maintain(frame(spark, {}), new_path(spark, "r")).count() == 0


def test_rollup_of_short_documents(spark):
    """With ``back``, a key that holds only short texts stays, and every row counts."""
    got = {(r.source, r.lang, r.tokenizer_version): (r.n_docs, r.n_tokens) for r in token_rollup.maintain(frame(spark), new_path(spark, "r"), back=True).collect()}
    assert sum(n for k, (n, _) in got.items() if k[2] == "words-1") == sum(n for k, (n, _) in got.items() if k[2] == "pieces-1") == len(pairs())
    assert sum(n for k, (_, n) in got.items() if k[2] == "words-1") == sum(len((x or "").encode().split()) for _, x in pairs())
    assert got[None, None, "words-1"] == (1, 1)


def naive_rules(text, bands):
    raw = (text or "").encode()
    words = raw.split()
    windows = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    hit = set()
    for k in range(len(words) - 7):
        if windows[tuple(words[k : k + 8])] > 1:
            hit |= set(range(k, k + 8))
    lines, dup = set(), 0
    for line in raw.split(b"\n"):
        if line.split():
            dup += line in lines
            lines.add(line)
    c = zstandard.ZstdCompressor(level=3)
    fine = bool(raw)
    for part in [raw, *([x for x in (raw[k : k + 4096] for k in range(0, len(raw), 4096)) if len(x) >= 1024] if len(raw) > 4096 else [])]:
        if part:
            low, high = [b[1:] for b in bands.limits if len(part) >= b[0]][-1]
            fine &= low <= len(c.compress(part)) / len(part) <= high
    failed = len(words) < 20 or 100 * len(hit) > 30 * len(words)
    return len(words), sum(len(w.decode()) for w in words), sum((text or "").count(x) for x in "#*$%&|<>"), dup, len(hit), failed, fine and not failed


def test_rules_of_tails():
    """A last chunk under 1024 bytes is judged: a repetitive or incompressible end does not pass in a clean text."""
    bands, c, draw = quality_rules.Bands(), zstandard.ZstdCompressor(level=3), random.Random(5)
    lexicon = ["".join(draw.choice("eeeettaaooinshrdlu") for _ in range(draw.randint(2, 9))) for _ in range(700)]
    clean = " ".join(draw.choice(lexicon) for _ in range(4000)).encode()
    assert quality_rules.measure(clean[:8192], bands, c)[-1] and quality_rules.measure(clean[:9192], bands, c)[-1]
    noise = bytes(draw.randrange(33, 127) for _ in range(1000))
    for tail in (b"again " * 167, noise):
        text = clean[:8192] + tail[:1000]
        *_, least, most, kept = quality_rules.measure(text, bands, c)
        low, high = bands.of(1024)
        assert not kept and (least < low or most > high)


@pytest.mark.parametrize("n, words, letters", [(300, 6, 62), (600, 20, 62), (1024, 40, 62), (1600, 80, 62), (3000, 80, 26), (4096, 80, 26), (9000, 80, 26), (20_000, 80, 26)])
def test_rules_of_bands(n, words, letters):
    """Planted texts of each length: few words over and over, and random letters with spaces, go; prose of many words stays."""
    bands, c, draw = quality_rules.Bands(), zstandard.ZstdCompressor(level=3), random.Random(7)

    def text(lexicon):
        return " ".join(draw.choice(lexicon) for _ in range(n)).encode()[:n]

    def lexicon(alphabet, size):
        return ["".join(draw.choice(alphabet) for _ in range(draw.randint(2, 9))) for _ in range(size)]

    letter = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"[:letters]
    low, high = bands.of(n)
    few, noise, prose = (quality_rules.measure(x, bands, c) for x in (text(lexicon("abcdefghijklmnopqrstuvwxyz", words)), "".join(" " if draw.random() < 0.15 else draw.choice(letter) for _ in range(n)).encode(), text(lexicon("eeeettaaooinshrdlu", 700))))
    assert few[6] < low and not few[-1]
    assert noise[6] > high and not noise[-1] and not noise[5]
    assert low <= prose[6] <= high and prose[-1]


def test_rules(spark):
    draw = random.Random(2)
    lexicon = ["".join(draw.choice("abcdefghijklmnop") for _ in range(draw.randint(2, 9))) for _ in range(900)]
    texts = dict(TEXTS) | {100 + k: " ".join(draw.choice(lexicon) for _ in range(draw.randint(5, 1500))) for k in range(30)}
    texts |= {200: "a b c\nd # e\na b c\n \n" * 5, 201: " ".join(lexicon[:60]) + " " + " ".join(lexicon[20:40]), 202: "".join(chr(draw.randrange(33, 127)) for _ in range(6000)) + " w" * 25, 203: " ".join(lexicon[:700]) + " pad" * 900}
    bands = quality_rules.Bands()
    rows = quality_rules.judge(frame(spark, texts), bands).collect()
    got = Counter((key(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in rows)
    assert got == Counter((key(i), *naive_rules(x, bands)) for i, x in pairs(texts))
    kept = quality_rules.filter_rows(frame(spark, texts), bands)
    assert kept.columns == frame(spark).columns
    assert Counter(key(r.doc_id) for r in kept.collect()) == Counter(key(i) for i, x in pairs(texts) if naive_rules(x, bands)[-1])
    assert quality_rules.judge(frame(spark, {})).count() == 0


def _unmarked(paragraphs, extra=""):
    links = "".join(f"<div><a href='/{k}'>item {k}</a></div>" for k in range(12))
    return f"<html><head><title>t</title></head><body><div>{links}</div>{''.join(f'<div><p>{p}</p></div>' for p in paragraphs)}<div>{links}</div>{extra}</body></html>"


def test_html_ratios_smoothing_and_threshold_decide(monkeypatch):
    """Nothing here is named: no article, no class, no nav."""
    long = "A paragraph of some length that says a thing or two about the matter at hand and then goes on. " * 3
    paragraphs = [long.strip(), "Short one.", long.strip(), long.strip()]
    whole = " ".join(paragraphs)
    assert html_extract.main_text(_unmarked(paragraphs)) == whole
    # without smoothing the short paragraph falls to the links
    assert html_extract.main_text(_unmarked(paragraphs), html_extract.Ratios(sigma=0.01)) == " ".join([*paragraphs[:1], *paragraphs[2:]])
    # without a threshold on what the ratios say, the links come along
    monkeypatch.setattr(html_extract, "smooth", lambda x, sigma: np.ones(len(x)))
    assert html_extract.main_text(_unmarked(paragraphs)) != whole


def test_html_names_lower_but_do_not_decide():
    long = "A paragraph of some length that says a thing or two about the matter at hand and then goes on. " * 30
    assert html_extract.main_text(f"<body><nav><a>One</a><a>Two</a></nav><div class='sidebar'><p>{long}</p></div><footer>End of it</footer></body>") == long.strip()
    assert html_extract.main_text("<body><nav><a>One</a><a>Two</a></nav><footer>End of it</footer></body>") == ""


def test_html_without_marks_on_whole_table(spark):
    """Articles and adverts of the table's pages in plain divs: ratios find the text of nearly every page."""
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect() if r.html]
    plain = [x.replace("<article>", "<div>").replace("</article>", "</div>").replace('<div class="ad">', "<div>") for x in pages]
    same = sum(html_extract.main_text(x) == html_extract.main_text(y) for x, y in zip(pages, plain))
    assert same >= 0.9 * len(pages)


@pytest.mark.parametrize("few", [0, 2, 1000])
def test_embedding_recall_at_many_bits(spark, monkeypatch, few):
    """Pairs just above the least cosine, 12 bits a code; pairs sent one by one, by blocks, and both."""
    monkeypatch.setattr(embedding_dedup, "FEW_PAIRS", few)
    draw = np.random.default_rng(8)
    a = draw.standard_normal((1500, 32))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    side = draw.standard_normal(a.shape)
    side -= (side * a).sum(axis=1, keepdims=True) * a
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    c = draw.uniform(0.931, 0.935, (1500, 1))
    x = np.vstack([a, c * a + np.sqrt(1 - c * c) * side, a[:1] + 0.02 * draw.standard_normal((80, 32))]).astype(np.float32)
    how = embedding_dedup.SignHash(per_bucket=1)
    assert how.bits(len(x)) == 12
    df = spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    found = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(df, how).collect()}
    y = x.astype(np.float64)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    true = ((y @ y.T >= 0.93).sum(axis=1) - 1).tolist()
    assert all(found[k] <= n for k, n in enumerate(true))
    assert sum(found.values()) >= 0.998 * sum(true) and sum(true) > 9000


def test_a_key_with_very_many_rows_is_dealt_to_several_tasks(spark):
    from weft.llm.components import salted_join

    rows = spark.range(20_000).select(F.when(F.col("id") < 12_000, 7).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    groups = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("v").alias("least"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = salted_join(rows, groups, ["k"], F.xxhash64("v"), 20_000)
        sizes = [r["count"] for r in joined.where("k = 7").groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) > 1 and sum(sizes) == 12_000
        assert joined.where("k = 7").agg(F.min("least"), F.max("least")).first()[:] == (0, 0) and joined.count() == 20_000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_groups_of_several_parts_are_spanned(spark):
    """A chain, in which the first document is linked with few, against a union of all links."""
    lexicon = [f"w{k}" for k in range(4000)]
    texts = {k: " ".join(lexicon[4 * k : 4 * k + 100]) for k in range(60)} | {1000 + k: " ".join(lexicon[2000:2100]) + f" x{k}" for k in range(60)}
    expected = brute_components(word_sets(texts, 3), 85, 100)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    how = minhash.MinHash(words=3, numerator=85, list_block=7, cluster_block=6)
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(df, how).collect()} == expected


def test_minhash_filter_among_rows_that_repeat_an_id(spark):
    rows = [(1, "b " * 30, "x"), (1, "a " * 30, "y"), (2, None, "z"), (2, "c", "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, place_ string")
    assert sorted((r.doc_id, r.place_) for r in minhash.filter_rows(df).collect()) == [(1, "y"), (2, "z")]


def test_rollup_by_vocabularies(spark):
    versions = {"byte": BYTE_VOCABULARY, "word": WORD_VOCABULARY}
    got = token_rollup.maintain(frame(spark), new_path(spark, "r"), back=True, vocabularies=versions).collect()
    for version, path in versions.items():
        t = Tokenizer.from_file(path)
        t.no_truncation()
        assert sum(r.n_docs for r in got if r.tokenizer_version == version) == len(pairs())
        assert sum(r.n_tokens for r in got if r.tokenizer_version == version) == sum(len(t.encode(x or "", add_special_tokens=False).ids) for _, x in pairs())
    assert token_rollup.maintain(frame(spark, {}), new_path(spark, "r"), back=True, vocabularies=versions).count() == 0


def test_rollup_with_two_writers_and_snapshots(spark, monkeypatch):
    rows = spark.createDataFrame([("a", "en", "v1", 10), (None, "en", "v1", 4)], "source string, lang string, tokenizer_version string, n_tokens long")
    path = new_path(spark, "r")
    store, other = token_rollup.Rollup(spark, path), token_rollup.Rollup(spark, path)
    expected = {("a", "en", "v1", 1, 10), (None, "en", "v1", 1, 4)}
    # both have looked before either has written
    with monkeypatch.context() as m:
        m.setattr(other, "_marked", lambda prefix: {})
        assert store.commit("one", token_rollup.inserts(rows)) and not other.commit("one", token_rollup.inserts(rows))
    assert {tuple(r) for r in store.totals().collect()} == expected
    assert store.compact() and len(store._parts()) == 1
    assert {tuple(r) for r in other.totals().collect()} == expected
    assert not other.commit("one", token_rollup.inserts(rows))
    assert other.commit("two", token_rollup.deletes(rows.where("source = 'a'"))) and len(store._parts()) == 2
    assert store.compact() and {tuple(r) for r in store.totals().collect()} == {(None, "en", "v1", 1, 4)} and store.committed() == ["one", "two"]


def test_intermediate_tables_go(spark):
    from weft.llm.storage import materialize, new_path, temporary

    kept = new_path(spark, "kept")
    spark.range(3).write.parquet(kept)
    with temporary(spark):
        held = materialize(spark.range(5), "held")
        folder = os.path.dirname(held.inputFiles()[0].removeprefix("file://"))
        assert held.count() == 5 and os.path.isdir(folder)
    assert not os.path.exists(folder) and spark.read.parquet(kept).count() == 3


def test_packing_keeps_other_columns(spark):
    cut = packing.pieces(frame(spark), read_vocabulary(WORD_VOCABULARY)).withColumn("rank", F.lit("r")).withColumn("offset", F.lit(-1)).withColumn("deal", F.lit(7))
    out = packing.pack(cut).collect()
    assert {(r.rank, r.deal) for r in out} == {("r", 7)} and min(r.offset for r in out) == 0


@pytest.mark.parametrize("path", [BYTE_VOCABULARY, WORD_VOCABULARY])
def test_encoders_on_cuts(path):
    """White space, commas, stops and control characters in every order, many texts at a time."""
    draw = random.Random(3)
    parts = ["a", "The", "İ", "'s", "Ünï", "中", "é", "é", "12", "…", "!!", ".", ",", ",", " ,", "3.14", "\x00", "\x01", "\x1c", "​", " ", "　", "\xa0", "\n", "\n\n", " ", " ", "  ", "\t", "<|endoftext|>", "—."]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 25))) for _ in range(4000)] + ["", " ", "\n", ",", "\x00", "\x01,", "\x00,"]
    t = Tokenizer.from_file(path)
    coder = CachedEncoder(read_vocabulary(path), 500)
    for at in range(0, len(texts), 111):
        some = texts[at : at + 111]
        assert coder.encode([x.encode() for x in some]) == [u32(t.encode(x, add_special_tokens=False).ids) for x in some]
