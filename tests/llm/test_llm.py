"""Training-data operators against brute force, round trips and known boundaries."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from itertools import combinations
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from graphweft.llm import cooccur, encode, mixing, runs, sentences, topn

VOCABULARY = Path(encode.VOCABULARIES) / encode.VOCABULARY


def brute_runs(data):
    by = defaultdict(dict)
    for s, at, i, a, b in data:
        if s is not None and at is not None and i is not None:
            by[s][i] = (at, i, a, b)
    out = []
    for s, events in by.items():
        run = []
        for e in sorted(events.values(), key=lambda e: e[:2]):
            if run and run[-1][2:] != e[2:]:
                out.append((s, run))
                run = []
            run.append(e)
        out.append((s, run))
    return sorted((s, r[0][1], r[-1][1], len(r), r[-1][0] - r[0][0]) for s, r in out)


@pytest.mark.parametrize("piece", [1, 7, 60])
def test_runs(spark, piece):
    rnd = random.Random(piece)
    data = [(rnd.choice(["s", "s", "t", None]), rnd.randrange(60), k, rnd.choice(["A", "B", None]), rnd.choice(["x", None])) for k in range(300)]
    data += [("u", 5, 1000 + k, "A", "x") for k in range(20)] + [("v", k, 2000 + k, "A", None) for k in range(40)] + [("s", None, 9, "A", "x"), ("s", 1, None, "A", "x")]
    df = spark.createDataFrame(data + data[:50], "s string, at long, id long, a string, b string").withColumn("seq", F.lit("clash")).withColumn("n", F.lit(1))
    got = runs.collapse_runs(df, "s", "at", "id", ["a", "b"], pieces=piece)
    assert sorted((r.s, r.first_id, r.last_id, r.n_events, r.duration) for r in got.collect()) == brute_runs(data)
    late = spark.createDataFrame([("s", 0, 0)] + [("s", 10**9 + k // 50, k + 1) for k in range(5000)], "s string, at long, id long")
    sizes = late.repartitionByRange(10, "s", "at", "id").groupBy(F.spark_partition_id()).count().toPandas()["count"]
    assert sizes.max() < 1500 and runs.collapse_runs(late, "s", "at", "id", [], pieces=10).select("n_events").collect() == [(5001,)]
    assert runs.collapse_runs(df.limit(0), "s", "at", "id", ["a", "b"]).isEmpty()


def brute_pairs(data):
    baskets, sizes = defaultdict(set), defaultdict(set)
    for g, b, i in data:
        if g is not None and b is not None:
            sizes[g].add(b)
            if i is not None:
                baskets[g, b].add(i)
    single, pair = Counter(), Counter()
    for (g, _), items in baskets.items():
        single.update((g, i) for i in items)
        pair.update((g, *p) for p in combinations(sorted(items), 2))
    return {(g, a, b): (c, single[g, a], single[g, b], len(sizes[g])) for (g, a, b), c in pair.items()}


@pytest.mark.parametrize("frequent, tile, block", [(4, 3, 8), (1, 500, 4096), (1, 4, 4096), (10**6, 5, 10)])
def test_cooccurrence(spark, monkeypatch, frequent, tile, block):
    monkeypatch.setattr(cooccur, "RARE_AT_ONCE", 3)
    monkeypatch.setattr(cooccur, "BLOCK_RARE", 5)
    rnd = random.Random(frequent)
    data = [(rnd.choice(["g", "h", None]), rnd.choice([*range(30), None]), rnd.choice([*"aaabbbccdefghijé", None])) for _ in range(600)]
    data += [("g", 99, chr(0x61 + k)) for k in range(26)] + [("h", 77, None)]
    df = spark.createDataFrame(data, "repo string, commit long, item string").withColumn("grp", F.lit("clash")).withColumn("n", F.lit(1))
    got = cooccur.cooccurrence(df, "repo", "commit", "item", frequent=frequent, tile_items=tile, block_baskets=block)
    assert {(r.repo, r.item_a, r.item_b): (r.n_ab, r.n_a, r.n_b, r.n) for r in got.collect()} == brute_pairs(data)
    few = cooccur.cooccurrence(df, "repo", "commit", "item", min_together=3, min_lift=1.2, frequent=frequent, tile_items=tile, block_baskets=block)
    want = {k for k, (c, a, b, n) in brute_pairs(data).items() if c >= 3 and c * n >= 1.2 * a * b}
    assert {(r.repo, r.item_a, r.item_b) for r in few.collect()} == want
    assert cooccur.cooccurrence(df.limit(0), "repo", "commit", "item").isEmpty()


def test_top_n(spark):
    rnd = random.Random(1)
    data = [(rnd.choice([0] * 8 + [1, 2, None]), rnd.choice([0.1, 0.2, 0.5, None, float("nan"), rnd.random()]), f"i{k}") for k in range(800)] + [(7, 0.5, "z"), (7, 0.5, "z"), (8, 0.1, None)]
    df = spark.createDataFrame(data, "g int, score double, id string").repartition(5).withColumn("grp", F.lit("clash")).withColumn("pos", F.lit(1))
    by = defaultdict(list)
    for g, s, i in data:
        if g is not None and i is not None and s is not None and s == s:
            by[g].append((-s, i))
    want = {(g, p + 1, i) for g, xs in by.items() for p, (_, i) in enumerate(sorted(xs)[:5])}
    assert {(r.g, r.pos, r.id) for r in topn.top_n(df, "g", "score", "id", 5).collect()} == want
    for most in (0, 1):
        assert {(r.g, r.pos, r.id) for r in topn.top_n(df, "g", "score", "id", 5, broadcast_rows=most).collect()} == want
    slim = df.select(F.col("g").alias("grp"), "score", F.col("id").alias("item")).dropna()
    least = {g: sorted(xs)[4] for g, xs in by.items() if len(xs) >= 5}
    for r in topn.local_bounds(slim, 5, most=20).collect():
        assert r.score != r.score or (-r.score, r.item) >= least[r.grp]
    assert topn.top_n(df.limit(0), "g", "score", "id", 5).isEmpty()


def test_latest_rows(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "y"), ("b", None, "z"), (None, 1, "w")], "id string, v int, c string")
    assert sorted(map(tuple, topn.latest_rows(df, "id", "v").collect())) == [("a", 2, "y"), ("b", None, "z")]


@pytest.fixture(scope="module")
def coder():
    if not VOCABULARY.exists():
        pytest.skip("no vocabulary here")
    return encode.Encoder(str(VOCABULARY))


def test_fragments_encode_like_the_whole(coder):
    rnd = random.Random(7)
    pool = [chr(c) for c in [*range(32, 127), 9, 10, 13, 0x85, 0xA0, 0x1C, 0x3000, 0x2003, 0x200B, 0xE9, 0x434, 0x905, 0xE01, 0x4E2D, 0x3042, 0xAC00, 0x1F600]] + [" ", "  ", "'s", "'re", "\n\n", "<|endoftext|>"]
    cut = 0
    for _ in range(5000):
        text = "".join(rnd.choice(pool) for _ in range(rnd.randrange(1, 50)))
        cut += len(coder.cuts(text.encode()))
        assert coder.ids(text) == coder.plain.encode_ordinary(text)
        assert coder.plain.decode(coder.ids(text)) == text
    assert cut > 5000
    long = "中文и text's  end\n" * 50_000
    assert coder.ids(long) == coder.plain.encode_ordinary(long)


def test_encode(spark, coder):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, None), (3, ""), (None, " "), (4, "<|endoftext|>")], "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = [(r.doc_id, r.ids) for r in encode.encode(df, "doc_id", "text").collect()]
    one = coder.plain.encode_ordinary
    assert got == [(1, one("a b")), (1, one("a b")), (2, []), (3, []), (None, one(" ")), (4, one("<|endoftext|>"))] and len(got[-1][1]) > 1
    assert encode.encode(df.limit(0), "doc_id", "text").isEmpty()


def test_mixing(spark, coder):
    rnd = random.Random(2)
    words = {"code": ["def", "return", "class"], "news": ["today", "minister", "said"], "tiny": ["quark", "boson"]}
    data = [(k, " ".join(rnd.choices(words[s], k=rnd.randrange(5, 40))), s) for k, s in enumerate(["code"] * 400 + ["news"] * 300 + ["tiny"] * 20)]
    data += [(9000 + k, " ".join(rnd.choices(words["news"], k=20)), None) for k in range(40)] + [(9100, None, "code"), (9101, "", None), (9102, "x y", "else"), (None, "def", "code")]
    df = spark.createDataFrame(data, "doc_id long, text string, source string").withColumn("p", F.lit(1)).withColumn("size", F.lit(1))
    targets = spark.createDataFrame([("code", 0.5, 1), ("news", 0.3, 2), ("tiny", 0.1, 4), ("gone", 0.1, 3), (None, 0.5, 1)], "source string, target_share double, max_repeats int")
    mixture, shares = mixing.mix(df, "doc_id", "text", "source", targets)
    got = {r.source: r for r in shares.collect()}
    assert abs(got["code"].actual_share - 0.5 / 0.9) < 0.02 and abs(got["news"].actual_share - 0.3 / 0.9) < 0.02 and abs(got["tiny"].actual_share - 0.1 / 0.9) < 0.02
    assert got["gone"].n_texts == 0 and got["gone"].tokens_taken < 1
    caps = {"code": 1, "news": 2, "tiny": 4, None: 4}
    taken = mixture.collect()
    assert all(0 < r.repeats <= caps[r.source] and r.tokens > 0 for r in taken) and {r.source for r in taken} <= set(caps)
    assert mixing.mix(df.limit(0), "doc_id", "text", "source", targets)[0].isEmpty()
    assert mixing.mix(df, "doc_id", "text", "source", targets.limit(0))[0].isEmpty()
    many = spark.range(mixing.MOST_SOURCES + 1).selectExpr("string(id) as source", "0.1d as target_share", "1 as max_repeats")
    with pytest.raises(ValueError):
        mixing.mix(df, "doc_id", "text", "source", many)


def test_fit_is_not_the_closed_form(spark, coder):
    """Most texts have no label and look like neither domain: rates of target / held miss, the fit does not, and rounding keeps it."""
    rnd = random.Random(8)
    words = {"a": ["def", "return"], "b": ["today", "said"], "c": ["quark", "boson"]}
    data = [(k, " ".join(rnd.choices(words["ab"[k % 2]], k=30)), "ab"[k % 2]) for k in range(400)]
    data += [(1000 + k, " ".join(rnd.choices(words["c"], k=30)), None) for k in range(800)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 0.8, 2), ("b", 0.2, 2)], "source string, target_share double, max_repeats int")
    known = df.join(spark.createDataFrame([("a", 0), ("b", 1)], "source string, domain int"), "source", "left").withColumnRenamed("doc_id", "doc")
    model = mixing.fit_classifier(known, 2, str(VOCABULARY))
    member = mixing.memberships(known, model, str(VOCABULARY), 0.01).toPandas()
    p, size = np.stack(member["p"]), member["size"].to_numpy(float)
    total = 12_000
    target, held = np.array([0.8, 0.2]) * total, size @ p
    closed = p @ (target / held)
    missed = abs(((closed * size) @ p)[0] / (closed @ size) - 0.8)
    mixture, shares = mixing.mix(df, "doc_id", "text", "source", targets, total_tokens=total)
    got = {r.source: r for r in shares.collect()}
    assert missed > 0.05 and abs(got["a"].expected_share - 0.8) < 0.01
    assert abs(sum(r.tokens * r.repeats for r in mixture.collect()) - total) < 0.02 * total


def test_rounding_keeps_the_rates(spark):
    rnd = random.Random(6)
    data = [(k, k % 3, rnd.choice([3, 40, 41, 900]), rnd.choice([0.2, 1.4, 2.0])) for k in range(600)] + [(700, 5, 100, 0.3)]
    got = mixing.rounded(spark.createDataFrame(data, "doc long, stratum int, size long, rate double")).collect()
    assert len(got) == len(data) and all(abs(r.repeats - r.rate) < 1 for r in got)
    for k in range(3):
        assert abs(sum(r["size"] * (r.repeats - r.rate) for r in got if r.stratum == k)) < 40


def test_rates_reach_soft_targets():
    p = np.array([[1.0, 0.0], [0.0, 1.0], [0.5, 0.5]])
    size, cap, target = np.array([100.0, 50.0, 40.0]), np.array([1.0, 3.0, 2.0]), np.array([60.0, 90.0])
    history = np.zeros((0, 2))
    for _ in range(200):
        now = (mixing._rates(p, cap, history) * size) @ p
        history = np.vstack([history, (now - target) / (size @ p)])
    rate = mixing._rates(p, cap, history)
    assert np.allclose((rate * size) @ p, target, rtol=1e-3) and (rate >= 0).all() and (rate <= cap).all()


DOCUMENTS = Path("/root/testdata/sf0.1/documents.parquet")


@pytest.fixture(scope="module")
def halves():
    if not DOCUMENTS.exists():
        pytest.skip("no documents here")
    rows = pd.read_parquet(DOCUMENTS, columns=["doc_id", "text", "source"])
    rows = rows[(rows.source != "tool_output") & (rows.text.str.len() > 0) & (rows.text.str.len() <= 20_000)]
    return rows[rows.doc_id % 2 == 0].text.head(1500).tolist(), rows[rows.doc_id % 2 == 1].text.head(1500).tolist()


@pytest.fixture(scope="module")
def tagger(halves):
    return sentences.Tagger().fit(*sentences.training_chains(halves[0]))


def cut(text, tagger, per_line=False):
    return [text[a:b] for a, b in sentences.units(text, per_line, tagger)]


@pytest.mark.parametrize(
    "text, want",
    [
        ("The scan took 2.5 s. Rule 3 holds.", ["The scan took 2.5 s.", "Rule 3 holds."]),
        ("# Head\n\n- one\n* two. Three.\n2. four\n\nfive\nsix.", ["# Head", "- one", "* two.", "Three.", "2. four", "five\nsix."]),
        ("The text “Not now! Ask first.” still shows. Done!", ["The text “Not now! Ask first.” still shows.", "Done!"]),
        ("(It skips a.rs.) It runs.", ["(It skips a.rs.)", "It runs."]),
        ("完成！规则4.2禁止导入。“不要删除！”这条注释仍在。", ["完成！", "规则4.2禁止导入。", "“不要删除！”这条注释仍在。"]),
        ("รุ่นv5ลบแคช เสร็จแล้ว! ค่าของaลดจาก1.5เหลือ2", ["รุ่นv5ลบแคช", "เสร็จแล้ว!", "ค่าของaลดจาก1.5เหลือ2"]),
        ("Γιατί το nodePolicy.ts; Έτοιμο!", ["Γιατί το nodePolicy.ts;", "Έτοιμο!"]),
        ("﻿ Really?! \r\n \r\n\t\r\nNo end", ["Really?!", "No end"]),
        ("", []), (None, []), (" \n\t​", []),
    ],
)
def test_sentences(tagger, text, want):
    assert cut(text, tagger) == want


def test_lines_of_output(tagger):
    assert cut("\tat a.b (c.ts:1)\n\n====\r\nError: x! See y. ", tagger, True) == ["at a.b (c.ts:1)", "====", "Error: x! See y."]


@pytest.mark.parametrize("text", ["Gen. Smith met Sen. Lee at Mt. Rainier.", "M. Dupont est arrivé.", "The U.S. Senate met.", "Ing. Novák přišel."])
def test_names_that_the_corpus_does_not_hold(tagger, text):
    assert cut(text, tagger) == [text]


def joined_blocks(texts, n=600):
    """Blocks of one unit each (no mark or open blank before their end), by script."""
    by = defaultdict(list)
    for text in texts:
        for a, b in sentences.blocks(text):
            block = text[a:b].strip()
            if sentences._HEADING.match(block) or sentences._ITEM.match(block) or "\n" in block or sentences.places(block):
                continue
            if block[-1] in ".!?。！？।؟" or sentences._NO_MARKS.search(block):
                by[sentences._script(block)].append(block)
    return {k: v[:n] for k, v in by.items() if len(set(v)) >= 8}


def test_tagger_on_units_known_by_layout(halves, tagger):
    """Held-out accuracy by script: blocks of one unit by the layout, joined, must come apart again and nowhere else."""
    rnd = random.Random(4)
    scripts = joined_blocks(halves[1])
    assert len(scripts) >= 5
    for script, units in scripts.items():
        right = wanted = found = 0
        for _ in range(60):
            some = rnd.sample(units, 4)
            got = cut(" ".join(some), tagger)
            right, wanted, found = right + len(set(got) & set(some)), wanted + len(set(some)), found + len(set(got))
        assert right / wanted >= 0.95 and right / found >= 0.95, script


def test_moves_help_where_words_are_unknown(halves, tagger):
    bare = sentences.Tagger()
    bare.weights = tagger.weights

    def wrong(model):
        n = 0
        for text in halves[1]:
            for a, b in sentences.blocks(text):
                own = sentences.places(text[a:b])
                near = [sentences._near(x, y) for x, y in zip(own, own[1:])]
                blind = model.decode([p.features[p.words :] for p in own], near)
                n += sum(x != y for x, y in zip(blind, tagger.tags(own)))
        return n

    assert wrong(tagger) < 0.9 * wrong(bare)


def test_viterbi_is_the_best_path():
    rnd = random.Random(9)
    t = sentences.Tagger()
    t.weights = {f: rnd.uniform(-1, 1) for f in "abcd"}
    t.moves = {(x, y, d): rnd.uniform(-1, 1) for x in (0, 1) for y in (0, 1) for d in range(4)}
    for _ in range(50):
        chain, near = [rnd.sample("abcd", 2) for _ in range(6)], [rnd.randrange(4) for _ in range(5)]
        score = lambda tags: sum((1 if y else -1) * sum(t.weights[f] for f in fs) for fs, y in zip(chain, tags)) + sum(t.moves[m] for m in zip(tags, tags[1:], near))
        best = max(([(k >> i) & 1 for i in range(6)] for k in range(64)), key=score)
        assert abs(score(t.decode(chain, near)) - score(best)) < 1e-9


def test_long_texts_take_linear_time(tagger):
    assert len(cut("Done. " * 100_000, tagger)) == 100_000
    assert cut("(" * 100_000 + "]" * 100_000, tagger)


def test_sentences_frame(spark):
    df = spark.createDataFrame([(1, "One is. Two is.", False), (2, "a. b\nc", True), (3, None, None), (4, "", False), (None, "Null key.", None)], "doc_id long, text string, flat boolean").withColumn("key", F.lit("clash"))
    got = sentences.sentences(df.union(df.where("doc_id = 4")), "doc_id", "text", per_line="flat")
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [(1, 0, 7), (1, 8, 15), (2, 0, 4), (2, 5, 6), (None, 0, 9)]))
    assert sentences.sentences(df.limit(0), "doc_id", "text").isEmpty()
