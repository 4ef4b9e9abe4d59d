"""Substring, line and n-gram dedup against plain versions on small tables."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from samples import awkward, empty, split, words
from thermograph.llm import jaccard, keycount, lines, substrings
from thermograph.llm.graph import components


def plain_repeats(texts, window):
    every = [split(t) for t in texts]
    count = Counter(tuple(w[i:i + window]) for w in every for i in range(len(w) - window + 1))
    out = []
    for w in every:
        gone = set()
        for i in range(len(w) - window + 1):
            if count[tuple(w[i:i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def repeat_texts():
    passage, other = words(60, 1), words(40, 2)
    texts = [" ".join(words(80, 10 + i) + passage[i:i + 50] + words(30, 50 + i)) for i in range(6)]
    texts += [" ".join(other), " ".join(words(5, 3) + other[:34]), " ".join(words(5, 4) + other[:35] + ["end"]), "same " * 100, "a b " * 60, "a a b b " * 40, " ".join(words(3000, 5) * 2)]
    return texts


@pytest.mark.parametrize("window", [3, 9, 35])
def test_repeats_equal_plain_version(spark, window):
    docs = awkward(spark, repeat_texts())
    got = substrings.remove_repeats(docs, window)
    assert got.columns == [c for c in docs.columns if c not in ("n_words", "n_removed")] + ["n_words", "n_removed"]
    rows = got.select("doc_id", "n_words", "n_removed", "text", "key").collect()
    source = docs.select("doc_id", "text").collect()
    want = [(r.doc_id, *w) for r, w in zip(source, plain_repeats([r.text for r in source], window))]
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.n_words, r.n_removed, r.text)) for r in rows)
    assert {r.key for r in rows} == {"yek"}


def test_repeats_layout_and_empty(spark):
    docs = spark.createDataFrame([(1, "one  two\nthree"), (2, "x y  z " * 30)], "doc_id long, text string")
    rows = {r.doc_id: r for r in substrings.remove_repeats(docs, 35, layout=True).collect()}
    assert rows[1].text == "one  two\nthree" and rows[2].text == "" and rows[2].n_removed == 90
    assert substrings.remove_repeats(empty(spark)).count() == 0


def test_window_always_holds_a_symbol():
    for window in (1, 3, 7, 31, 35, 100):
        rounds, margin, longest = substrings.rounds_for(window)
        assert 2 * margin + 2 * longest - 1 <= window
        h = keycount.mix(np.random.default_rng(window).integers(0, 4, 5000).astype(np.uint64))
        names, start = substrings.parse(h, np.zeros(5000, np.int64), rounds)
        assert np.diff(start).max() <= longest


def test_equal_stretches_parse_alike():
    rng = np.random.default_rng(3)
    inner = rng.integers(0, 5, 200).astype(np.uint64)
    parsed = []
    for seed in (1, 2):
        text = np.concatenate([np.random.default_rng(seed).integers(0, 5, 50).astype(np.uint64), inner, np.random.default_rng(seed + 9).integers(0, 5, 50).astype(np.uint64)])
        names, start = substrings.parse(keycount.mix(text), np.zeros(300, np.int64), 3)
        parsed.append({(int(s) - 50, int(n)) for s, n in zip(start, names) if 58 <= s < 234})
    assert parsed[0] == parsed[1]


def plain_lines(rows, run):
    order = sorted({(r.doc_id is None, r.doc_id or 0, r.text) for r in rows if r.text is not None})
    seen, gone = set(), defaultdict(set)
    for key in order:
        content = [j for j, x in enumerate(key[2].split("\n")) if split(x)]
        parts = key[2].split("\n")
        for i in range(len(content) - run + 1):
            w = tuple(parts[j] for j in content[i:i + run])
            if w in seen:
                gone[key].update(content[i:i + run])
            seen.add(w)
    out = []
    for r in rows:
        if r.text is None:
            out.append((r.doc_id, None, 0, 0))
            continue
        g = gone[(r.doc_id is None, r.doc_id or 0, r.text)]
        out.append((r.doc_id, "\n".join(x for j, x in enumerate(r.text.split("\n")) if j not in g), sum(bool(split(x)) for x in r.text.split("\n")), len(g)))
    return out


@pytest.mark.parametrize("run", [1, 2, 3])
def test_lines_equal_plain_version(spark, run):
    block = [f"line {i} of a block" for i in range(6)]
    texts = ["\n".join(["head"] + block), "\n".join(["x", *block[1:5], "", "y"]), "\n".join([block[0], "", " ", *block[1:3], "tail"]), "a\na\na\na\na", "one\n\ntwo",
             "\n".join(block[4:]), "\n".join(str(i % 7) for i in range(300)), "quote ' and \\ back\nb\nc", "quote ' and \\ back\nb\nc\nd"]
    docs = awkward(spark, texts)
    got = lines.drop_repeated_runs(docs, run)
    assert got.columns == [c for c in docs.columns if c not in ("n_lines", "n_removed")] + ["n_lines", "n_removed"]
    rows = got.collect()
    want = plain_lines(docs.collect(), run)
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.text, r.n_lines, r.n_removed)) for r in rows)
    assert {r.key for r in rows} == {"yek"}


def test_lines_of_empty_table(spark):
    assert lines.drop_repeated_runs(empty(spark)).count() == 0


def test_native_plan_has_no_python(spark):
    docs = spark.createDataFrame([(1, "a\nb\nc\nd")], "doc_id long, text string")
    plan = lines.windows(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def plain_links(texts, similarity):
    sets = []
    for t in texts:
        w = [x.lower() for x in split(t)]
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    linked = {(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]) - 1e-9}
    root = list(range(len(sets)))
    for _ in sets:
        for i, j in linked:
            root[i] = root[j] = min(root[i], root[j])
    return [sum(i in p for p in linked) for i in range(len(sets))], root


def near_texts():
    base = words(150, 7, 5000)
    out = []
    for i in range(40):  # a group of near copies
        w = list(base)
        for k in range(i % 9):
            w[(i * 17 + k * 31) % 150] = f"new{i}{k}"
        out.append(" ".join(w))
    out += ["short one", "Short ONE", "short one two", "x", "x"] + [" ".join(words(60, 100 + i, 5000)) for i in range(20)] + ["long " + " ".join(words(20000, 8)), "long " + " ".join(words(20000, 8)) + " tail"]
    return out


def test_jaccard_equals_plain_version(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_TEXTS", 9)  # several blocks a cluster
    texts = near_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in jaccard.jaccard_join(docs).collect()}
    n, root = plain_links(texts, 0.8)
    assert [got[i].n_links for i in range(len(texts))] == n
    assert [got[i].class_id for i in range(len(texts))] == root
    assert [got[i].kept for i in range(len(texts))] == [root[i] == i for i in range(len(texts))]


def test_jaccard_awkward_rows(spark):
    docs = awkward(spark, near_texts()[:12] + ["lonely text of seven words in all"])
    rows = jaccard.jaccard_join(docs).collect()
    assert len(rows) == docs.count()
    assert all(r.n_links == 0 and r.kept and r.class_id == r.doc_id for r in rows if r.doc_id in (9000, 9001, 9002))
    kept = jaccard.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(0) == 1 and 12 in ids and {9000, 9001, 9002} <= set(ids) and ids.count(None) == 2
    assert jaccard.jaccard_join(empty(spark)).count() == 0 and jaccard.keep_one_of_each(empty(spark)).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7)]
    got = {r.v: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {100 + i: 100 for i in range(1, 50)}


def test_key_totals(spark):
    keys = [np.sort(np.random.default_rng(i).choice(2**40, 500, replace=False).astype(np.uint64) << np.uint64(20)) for i in range(3)]
    keys.append(keys[0])
    rows = [{"chunk": i, **b} for i, k in enumerate(keys) for b in keycount.blocks(k, np.arange(len(k)), 4)]
    out = keycount.key_totals(spark.createDataFrame(rows, "chunk long, bucket int, keys binary, counts binary, checks binary")).toPandas()
    got = keycount.in_order(out[out["chunk"] == 0])
    assert (got == 2 * np.arange(500)).all()
    assert out["n_total"].sum() == 4 * np.arange(500).sum()


def test_kept_digest(spark):
    docs = spark.createDataFrame([(1, "ä b")], "doc_id long, text string")
    out = substrings.remove_repeats(docs).select(F.sha2(F.col("text").cast("binary"), 256).alias("s")).first()
    assert out.s == hashlib.sha256("ä b".encode()).hexdigest()
