"""The pipeline against its operators' brute-force versions on small tables, and the queries on the smallest real ones."""

import os
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from weft.llm import quality_classifier, quality_rules
from weft.llm.queries import BYTE_VOCABULARY, OPERATORS, WORD_VOCABULARY, oracle_sql, queries

from test_edges import brute_components, naive_rules, word_sets

FOLDER = "/root/testdata/sf0.001"


def tables(spark, tmp_path, rows, labels):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    return f"file://{tmp_path}"


def corpus():
    draw = random.Random(11)
    lexicon = ["".join(draw.choice("abcdefghijklmnoprstu") for _ in range(draw.randint(2, 8))) for _ in range(700)]
    rows = []
    for k in range(160):
        n = draw.randint(30, 260)
        words = [draw.choice(lexicon) for _ in range(n)]
        if k % 4 == 1 and k > 20:  # near copies of an earlier good one
            words = rows[k - 1][1].replace(".", "").split()
            words[draw.randrange(len(words))] = "changed"
        text = " ".join(w + "." if j % 9 == 8 else w for j, w in enumerate(words))
        if k % 8 == 7:
            text = " ".join(w.upper() + "!!" for w in words)
        if k % 16 == 3:
            text = (" ".join(words[:12]) + "\n") * 20
        rows.append((k, text, "en", "s", len(text)))
    rows += [rows[0], (None, rows[8][1] + " and more of it", None, None, None), (500, None, "en", "s", 0), (501, "", "en", "s", 0)]
    return rows, [(k, 0 if k % 8 == 7 or k % 16 == 3 else 1, 0) for k in range(160)]


def test_pipeline_against_brute_force(spark, tmp_path):
    rows, labels = corpus()
    folder = tables(spark, tmp_path, rows, labels)
    got = corpus_pipeline.run(spark, folder).collect()
    known = dict((a, b) for a, b, _ in labels)
    d = len(quality_classifier.FEATURES)
    moments = {}
    for c in (0, 1):
        # a repeated row is learned as often as it is there
        x = np.array([quality_classifier.statistics((t or "").encode()) for i, t, *_ in rows if known.get(i) == c and zlib.crc32(str(i).encode()) % 4 != 2]).reshape(-1, d)
        moments[c] = (float(len(x)), x.sum(axis=0), x.T @ x)
    model = quality_classifier.fit(moments)
    left = [r for r in rows if model.score(np.array([quality_classifier.statistics((r[1] or "").encode())]))[0] >= 0.7]
    assert 0 < len(left) < len(rows)
    left = [r for r in left if naive_rules(r[1], quality_rules.Bands())[-1]]
    keyed = {i: t for i, t, *_ in left if i is not None}
    component = brute_components(word_sets(keyed, 5), 80, 100)
    assert len(set(component.values())) < len(component)
    left = [(i, t) for i, t in keyed.items() if component[i] == i] + [(None, t) for i, t, *_ in left if i is None]
    t = Tokenizer.from_file(WORD_VOCABULARY)
    expected = Counter()
    for i, text in left:
        ids = [*t.encode(text, add_special_tokens=False).ids, 1]
        for at in range(0, len(ids), 4096):
            expected[(i, at // 4096, at, len(ids[at : at + 4096]), zlib.crc32(np.array(ids[at : at + 4096], dtype="<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == expected
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for x in places.values():
        x.sort()
        assert [a for a, _ in x] == [sum(n for _, n in x[:k]) for k in range(len(x))]


def test_stages_keep_columns_and_take_empty_tables(spark, tmp_path):
    rows, labels = corpus()
    folder = tables(spark, tmp_path, rows[:0], labels[:0])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and out.count() == 0
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_registered():
    assert [f.__name__.split("_")[0] for f in OPERATORS] == [f"op{k}" for k in range(1, 11)]
    assert set(queries()) <= set(__spark_entry__.queries()) and set(oracle_sql()) <= set(queries())
    assert os.path.isfile(BYTE_VOCABULARY)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
def test_rollup_query_against_sql(spark):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    expected = {tuple(r) for r in c.sql(oracle_sql()["op9_token_rollup"]).fetchall()}
    assert {tuple(r) for r in queries()["op9_token_rollup"](spark, FOLDER).select("source", "lang", "tokenizer_version", "n_docs", "n_tokens").collect()} == expected


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
def test_rollup_of_all_documents_against_sql(spark):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    expected = {tuple(r) for r in c.sql(oracle_sql()["op9_token_rollup_all"]).fetchall()}
    got = queries()["op9_token_rollup_all"](spark, FOLDER).select("source", "lang", "tokenizer_version", "n_docs", "n_tokens").collect()
    assert {tuple(r) for r in got} == expected
    assert sum(r.n_docs for r in got if r.tokenizer_version == "words-1") == c.sql("SELECT count(*) FROM documents").fetchall()[0][0]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
def test_classifier_on_held_out_rows(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    rows = [r for r in queries()["op5_quality_classifier"](spark, FOLDER).collect() if r.held_out and r.doc_id in labels]
    assert rows and sum(r.predicted == labels[r.doc_id] for r in rows) / len(rows) >= 0.9


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
def test_token_counts_against_the_library(spark):
    expected = Counter()
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").select("source", "lang", "text").collect()
    for version, path in (("byte_bpe_50k", BYTE_VOCABULARY), ("word_bpe_49k", WORD_VOCABULARY)):
        t = Tokenizer.from_file(path)
        t.no_truncation()
        for r in rows:
            expected[r.source, r.lang, version, "docs"] += 1
            expected[r.source, r.lang, version, "tokens"] += len(t.encode(r.text or "", add_special_tokens=False).ids)
    got = Counter()
    for r in queries()["op9_token_counts"](spark, FOLDER).collect():
        got[r.source, r.lang, r.tokenizer_version, "docs"] += r.n_docs
        got[r.source, r.lang, r.tokenizer_version, "tokens"] += r.n_tokens
    assert got == expected
