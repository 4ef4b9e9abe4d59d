"""Quality rules, licences, toxicity and language-model scores against plain versions."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from samples import awkward, empty, split, words
from thermograph.llm import license as lic
from thermograph.llm import lm, quality, toxicity

EN = "the of and to in is that for with as on by".split()


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(EN) if r.random() < 0.4 else "".join(r.choice("etaoinshrdlu") for _ in range(r.randrange(3, 9))) for _ in range(n))


def plain_repeat_words(text):
    w = split(text)
    n = Counter(zip(w, w[1:], w[2:]))
    return len({i + k for i in range(len(w) - 2) if n[tuple(w[i:i + 3])] > 1 for k in range(3)})


@pytest.fixture(scope="module")
def judged(spark):
    texts = [prose(300, i) for i in range(12)] + [prose(300, 50).upper().replace(" ", "!! "), " ".join(w + "$$$" for w in prose(200, 51).split()), "the of and " * 40,
             prose(20, 52), prose(100, 53) + "\n" + "\n".join(["again and again", "", "  ", "again and again"]), "a b c d a b c e a b", "x" * 5000, prose(6000, 54), "ÄÖÜ #1 <b> & 100%" * 9]
    docs = awkward(spark, texts)
    return docs, quality.quality_rules(docs).collect()


def test_quality_counts(judged):
    docs, rows = judged
    source = docs.collect()
    want = []
    for r in source:
        w, t = split(r.text), r.text or ""
        lines = [x for x in t.split("\n") if split(x)]
        repeat = plain_repeat_words(t)
        want.append((r.doc_id, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), repeat, len(w) < 50 or 100 * repeat > 50 * len(w)))
    got = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows]
    assert sorted(map(repr, want)) == sorted(map(repr, got))


def test_quality_verdicts(judged):
    by = {r.doc_id: r for r in judged[1]}
    assert all(by[i].kept for i in range(12)) and by[19].kept
    assert not by[12].kept and not by[13].kept and not by[14].kept and not by[15].kept
    assert not by[9000].kept and not by[9001].kept and by[9001].word_distance is None


def test_quality_windows_sharing_forty_bits(spark):
    """The exact form is taken where packed hashes mix up two windows; both give the same on any text."""
    docs = spark.createDataFrame([(1, " ".join(words(400, 3, 12)), "en")], "doc_id long, text string, lang string")
    assert quality.features(docs).first().n_repeat_words == plain_repeat_words(docs.first().text)


def test_quality_without_references(spark):
    docs = spark.createDataFrame([(1, prose(80, 1), "xx"), (2, "", None)], "doc_id long, text string, lang string")
    assert {r.doc_id: r.kept for r in quality.quality_rules(docs).collect()} == {1: True, 2: False}
    assert quality.quality_rules(empty(spark)).count() == 0


def test_quality_main_path_is_native(spark):
    plan = quality.features(empty(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_license_phrases_and_templates(spark):
    texts = ["See the MIT License, or the mit-license.", "general Public\nLICENSE", "words\nLicensed under CC BY-NC 4.0.\nmore", "Licensed under CC BY-NC only", "All rights are reserved",
             "all RIGHTS reserved x" * 2, "apache license apache license", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is granted", "nothing " * 5000, "Émit license mit_license"]
    docs = awkward(spark, texts)
    by = {r.doc_id: r for r in lic.license_scan(docs).collect()}
    assert lic.license_scan(docs).count() == docs.count()
    assert (by[0].n_base, by[0].first_word, by[0].last_word, by[0].base_labels, by[0].score) == (2, 2, 6, "mit", 1.0)
    assert (by[1].n_base, by[1].base_labels) == (1, "gpl")
    assert (by[2].n_base, by[2].labels, by[2].score, by[2].first_word) == (0, "cc-by-nc", 1.0, None)
    assert by[3].labels == "" and by[4].labels == "reserved" and by[5].labels == "reserved"
    assert (by[6].n_base, by[6].first_word, by[6].last_word) == (2, 0, 2)
    assert by[7].labels == "isc" and 0.8 <= by[7].score < 1
    assert (by[8].n_words, by[8].labels, by[9].n_base) == (5000, "", 1)
    assert (by[9000].n_words, by[9000].labels, by[9000].score, by[9000].first_word) == (0, "", 0.0, None)
    assert lic.license_scan(empty(spark)).count() == 0


def test_license_join_equals_all_pairs(spark):
    rng = random.Random(5)
    vocabulary = sorted({w for _, t in lic.TEMPLATES for w in lic.template_words(t)})
    blocks = [" ".join(rng.sample(vocabulary, rng.randrange(2, 40))) for _ in range(80)] + [" ".join(rng.sample(lic.template_words(t), max(1, len(lic.template_words(t)) - rng.randrange(4)))) for _, t in lic.TEMPLATES * 4]
    docs = spark.createDataFrame([(i, b) for i, b in enumerate(blocks)], "doc_id long, text string")
    got = {(r.doc_id, r.template) for r in lic.matching_blocks(docs).collect()}
    want = {(i, n) for i, b in enumerate(blocks) for n, (_, t) in enumerate(lic.TEMPLATES) if len(set(b.split()) & set(lic.template_words(t))) >= math.ceil(0.8 * len(lic.template_words(t)) - 1e-9)}
    assert got == want and want


def labelled(spark, n=400, identity_bias=True):
    r = random.Random(4)
    rows = []
    for i in range(n):
        toxic = i % 4 == 0
        text = words(30, i) + (["scumbag", "vile"][:1 + i % 2] if toxic and i % 8 else [])
        if toxic and i % 8 == 0:  # toxic without a toxic word, but naming a group
            text += ["muslim"] if identity_bias else ["scumbag"]
        elif not toxic and i % 40 == 1:
            text += ["christian"]
        r.shuffle(text)
        rows.append((" ".join(text), int(toxic)))
    return spark.createDataFrame(rows + [(None, 0), ("", None)], "text string, label int")


def test_toxicity_swaps_reduce_identity_weight(spark):
    data = labelled(spark)
    free, held = toxicity.train(data, swap_penalty=0.0), toxicity.train(data)
    assert free.weights["muslim"] > 1
    gap = lambda m: abs(m.weights.get("muslim", 0) - m.weights.get("christian", 0))
    assert gap(held) < 0.25 * gap(free)
    assert held.weights["scumbag"] > 1


def test_toxicity_scores(spark):
    model = toxicity.train(labelled(spark, identity_bias=False))
    texts = ["w1 w2 SCUMBAG w3", "w1 w2 w3", "neutral women and muslim christian men", "word " * 20000 + "scumbag"]
    docs = awkward(spark, texts)
    out = toxicity.score(docs, model)
    by = {r.doc_id: r for r in out.collect()}
    assert out.count() == docs.count() and out.columns.count("score") == 1
    assert [by[i].predicted for i in range(4)] == [1, 0, 0, 1]
    assert by[9000].score == by[9001].score == pytest.approx(1 / (1 + math.exp(-model.bias)))
    assert toxicity.score(empty(spark), model).count() == 0


def test_toxicity_degenerate_labels(spark):
    one = toxicity.train(spark.createDataFrame([("a", 0), ("b", 0)], "text string, label int"))
    assert one.weights == {} and one.bias < 0
    none = toxicity.train(spark.createDataFrame([], "text string, label int"))
    assert none.weights == {} and none.bias == 0
    with pytest.raises(ValueError):
        toxicity.train(spark.createDataFrame([("a", 0), ("b", 1)], "text string, label int"), sample_rows=1)


def test_toxicity_held_out(spark):
    q = toxicity.op4_toxicity(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").filter("held_out AND toxic IS NOT NULL")
    rows = q.select("toxic", "predicted").collect()
    assert np.mean([r.toxic == r.predicted for r in rows]) >= 0.97


def plain_lm(rows, learn):
    """Token counts and base scores; and the mixture with given weights."""
    tokens = [[w if not w.isascii() else w.lower() for w in split("".join(c.lower() if "A" <= c <= "Z" else c for c in (t or "")))] + [None] for _, t in rows]
    train = [t for t, use in zip(tokens, learn) if use]
    c = Counter(w for t in train for w in t)
    n, v = sum(c.values()), len(c)
    pairs = Counter(p for t in train for p in zip(["<s>", *t], t))
    return tokens, c, n, v, pairs


def test_lm_counts_and_mixture(spark, monkeypatch):
    texts = [" ".join(words(60, i, 50)) for i in range(30)] + ["A a ÀÀ àà", "one", "x " * 4000, "never seen words here"]
    docs = awkward(spark, texts)
    rows = docs.select("doc_id", "text").collect()
    learn = [r.doc_id is not None and r.doc_id % 3 != 0 for r in rows]
    fixed = np.tile([0.5, 0.3, 0.2], (66, 1))
    fixed[0] = [0.0, 0.6, 0.4]
    monkeypatch.setattr(lm, "learn_weights", lambda *a: fixed)
    got = lm.score_documents(docs, "doc_id % 3 != 0").collect()
    tokens, c, n, v, pairs = plain_lm(rows, learn)
    starts = c[None]
    want = []
    for r, t in zip(rows, tokens):
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t)
        score = 0
        for a, w in zip(["<s>", *t], t):
            ca = starts if a == "<s>" else c[a]
            score += math.log10((0.5 * pairs[a, w] / ca + 0.3 * c[w] / n + 0.2 / (v + 1)) if ca else (0.6 * c[w] / n + 0.4 / (v + 1)))
        want.append((repr(r.doc_id), len(t), sum(c[w] > 0 for w in t), n, round(base, 6), round(score, 6)))
    assert sorted(want) == sorted((repr(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got)


def test_lm_is_a_distribution_and_learns(spark):
    """Probabilities of all continuations of a context sum to at most one; held-out text scores above the base."""
    texts = [" ".join(["a", "b", "c", "d"] * 10) for _ in range(20)] + ["a", "b", "c", "d", "", "zz"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    by = {r.doc_id: r for r in lm.score_documents(docs, "doc_id < 15").collect()}
    assert by[16].score > by[16].base_score
    w = lm.learn_weights(np.array([1, 5, 5]), np.array([0.0, 50.0, 0.0]), np.array([3.0, 2.0, 9.0]), np.array([10, 80, 20]))
    assert np.allclose(w.sum(1), 1) and (w >= 0).all() and w[0, 0] == 0 and w[5, 0] > w[1, 0]


def test_lm_without_training(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert [(r.n_known, r.train_tokens, r.base_score, abs(r.score) < 1e-9) for r in lm.score_documents(docs, "false").collect()] == [(0, 0, 0.0, True)] * 2
    assert lm.score_documents(empty(spark)).count() == 0
