"""Ranked search against brute force, and what it shuffles."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphweft.operators import search
from graphweft.plans import activity_queries, lookup_queries


def brute(queries, docs, k):
    """``(query, doc, score, rank)`` as the SQL of BM25 says it, rows of one document and length together."""
    split = [(doc, re.findall("[a-z0-9]+", text.lower())) for doc, text in docs if text is not None]
    n, mean = len(split), sum(len(ws) for _, ws in split) / max(1, len(split))
    tf = Counter((w, doc, len(ws)) for doc, ws in split for w in ws)
    df = Counter(w for w, _, _ in tf)
    score = defaultdict(float)
    for (w, doc, length), t in tf.items():
        for q, terms in queries:
            if w in terms:
                score[q, doc] += math.log((n - df[w] + 0.5) / (df[w] + 0.5) + 1) * t * 2.2 / (t + 1.2 * (0.25 + 0.75 * length / mean))
    return score, {(q, d, round(s, 6), r) for q, _ in queries for r, (s, d) in enumerate(sorted(((s, d) for (p, d), s in score.items() if p == q), key=lambda x: (-round(x[0], 6), x[1]))[:k], 1)}


def told(seed, n, repeat):
    draw = random.Random(seed)
    return [(k // repeat, " ".join(draw.choice("abcdefghij") * draw.randrange(1, 3) for _ in range(draw.randrange(9)))) for k in range(n)] + [(n, None), (n + 1, "zz"), (n + 2, "")]


@pytest.mark.parametrize("repeat", [1, 2])
def test_best_field_equals_brute_force(spark, repeat):
    names, paths = told(1, 300, repeat), told(2, 300, repeat)
    asked = [(q, ["a", "b", "a", "cc"] if q % 2 else ["d", "ee", "missing", "zz"]) for q in range(6)] + [(9, []), (10, ["missing"])]
    rows = [(d, a, b) for (d, a), (_, b) in zip(names, paths)]
    found = search.best_field(spark.createDataFrame(asked, "query int, terms array<string>"), spark.createDataFrame(rows, "id int, name string, path string"), "id", [F.col("name"), F.col("path")])
    (one, _), (two, _) = brute(asked, names, 10), brute(asked, paths, 10)
    best = {key: max(round(s.get(key, 0), 6) for s in (one, two)) for key in {*one, *two}}
    want = {(q, d, s, r) for q, _ in asked for r, (s, d) in enumerate(sorted(((s, d) for (p, d), s in best.items() if p == q), key=lambda x: (-x[0], x[1]))[:10], 1)}
    assert {tuple(r) for r in found.select("query", "doc", "score", "rank").collect()} == want


def test_products_in_blocks_and_chunks(monkeypatch):
    for name, value in (("BAGS", 7), ("QUERIES", 5), ("DENSE", 3), ("DENSE_BYTES", 8 * 17 * 2)):
        monkeypatch.setattr(search, name, value)
    draw = np.random.default_rng(4)
    holds, tf = draw.random((17, 12)) < np.linspace(0.05, 0.9, 12), draw.integers(0, 3, (60, 12))
    code, query = np.nonzero(holds.T)
    lists = lambda x: pa.array(x, pa.list_(pa.int32()))
    codes = [np.flatnonzero(r) for r in tf]
    batch = pa.RecordBatch.from_arrays([lists([[k] for k in range(60)]), lists(codes), lists([r[c] for r, c in zip(tf, codes)]), lists([[5] * len(c) for c in codes])], names=["docs", "codes", "tfs", "lengths"])
    idf = np.linspace(1, 2, 12)
    best, docs = search._scored((17, np.searchsorted(code, np.arange(13)), query), idf, 4.0, 3, iter([batch.slice(0, 25), batch.slice(25)]))
    weight = idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * 5 / 4))
    scores = np.round(weight @ holds.T, 6)
    for q in range(17):
        want = [k for k in np.lexsort((np.arange(60), -scores[:, q]))[:3] if scores[k, q] > 0]
        assert [b for b, s in zip(best.bag[q], best.score[q]) if s >= 0] == want


def shuffled(spark):
    """Rows shuffled so far."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


#: 400 texts that all hold a word, 100 of which are asked.
ASKED, TEXTS = 100, [(k, f"cache n{k} " + "x " * k) for k in range(400)]


def test_node_search_shuffles_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(lookup_queries, "_asking", lambda *_: spark.createDataFrame([(k, ["cache"]) for k in range(ASKED)], "query int, terms array<string>"))
    monkeypatch.setattr(lookup_queries, "vertices", lambda *_: spark.createDataFrame([(str(k), t, t) for k, t in TEXTS], "id string, name string, file_path string"))
    before = shuffled(spark)
    assert lookup_queries.node_search(spark, "").count() == 10 * ASKED
    assert shuffled(spark) - before < ASKED * len(TEXTS) / 2


def test_bm25_documents_shuffles_no_pairs(spark, tmp_path):
    spark.createDataFrame([(100 * k if k < ASKED else 100 * k + 1, t) for k, t in TEXTS], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    before = shuffled(spark)
    found = activity_queries.bm25_documents(spark, str(tmp_path))
    assert found.count() == 10 * ASKED
    assert shuffled(spark) - before < ASKED * len(TEXTS) / 2


def test_hybrid_documents_shuffles_no_pairs(spark, tmp_path):
    told = [(100 * k if k < ASKED else 100 * k + 1, t, "wiki", f"p/{k}.ts") for k, t in TEXTS]
    spark.createDataFrame(told, "doc_id long, text string, source string, file_path string").write.parquet(str(tmp_path / "documents.parquet"))
    before = shuffled(spark)
    assert activity_queries.hybrid_documents(spark, str(tmp_path)).count() == 10 * ASKED
    assert shuffled(spark) - before < ASKED * len(TEXTS)


@pytest.mark.parametrize("repeat", [1, 2])
def test_fields_of_shared_parts_equal_brute_force(spark, repeat):
    texts, names = told(5, 300, repeat), told(6, 300, repeat)
    asked = [(q, ["a", "b", "a", "cc"] if q % 3 else ["d", "ee", "missing", "zz"]) for q in range(7)] + [(8, []), (9, ["missing"])]
    rows = [(d, a, b) for (d, a), (_, b) in zip(texts, names)]
    both = [(d, " ".join(x for x in (b, a) if x is not None) if a is not None or b is not None else None) for d, a, b in rows]
    table = spark.createDataFrame(rows, "id int, text string, name string")
    found = search.bm25_fields(spark.createDataFrame(asked, "query int, terms array<string>"), table, "id", [F.col("text"), F.col("name")], [[0], [1, 0]], 20)
    for field, docs in zip(found, (texts, both)):
        assert {tuple(r) for r in field.select("query", "doc", "score", "rank").collect()} == brute(asked, docs, 20)[1]


@pytest.mark.parametrize("dense", [1, 40])
def test_screened_products_equal_brute_force(monkeypatch, dense):
    for name, value in (("BAGS", 90), ("QUERIES", 8), ("DENSE", dense), ("PAIRS", 13)):
        monkeypatch.setattr(search, name, value)
    draw = np.random.default_rng(7)
    holds, tf = draw.random((20, 30)) < np.linspace(0.1, 1, 30), draw.integers(0, 3, (400, 30))
    tf[200:300] = tf[100:200]  # equal scores, of which the first count
    code, query = np.nonzero(holds.T)
    lists = lambda x: pa.array(x, pa.list_(pa.int32()))
    codes = [np.flatnonzero(r) for r in tf]
    batch = pa.RecordBatch.from_arrays([lists([[k] for k in range(400)]), lists(codes), lists([r[c] for r, c in zip(tf, codes)]), lists([[5] for _ in codes])], names=["docs", "codes", "tfs", "lengths"])
    idf = np.linspace(0.01, 2, 30)
    best, _ = search._scored((20, np.searchsorted(code, np.arange(31)), query), idf, 4.0, 3, iter([batch]))
    weight = idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * 5 / 4))
    scores = np.floor(weight @ holds.T * 1e6 + 0.5)
    for q in range(20):
        want = np.lexsort((np.arange(400), -scores[:, q]))[:3]
        assert (best.bag[q] == want).all() and (best.score[q] == scores[want, q]).all()


def test_hybrid_documents_splits_each_text_once(spark, tmp_path, monkeypatch):
    told = [(k, t, "wiki", f"p/{k}.ts") for k, t in TEXTS]
    spark.createDataFrame(told, "doc_id long, text string, source string, file_path string").write.parquet(str(tmp_path / "documents.parquet"))
    split = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def counted(text):
        split.add(len(text))
        return text.split()

    monkeypatch.setattr(activity_queries.texts, "letter_words", counted)
    assert activity_queries.hybrid_documents(spark, str(tmp_path)).count() == 40
    assert 0 < split.value < 1.5 * sum(len(t) + len(f"wiki p/{k}.ts") for k, t in TEXTS)
