"""Language profiles, collocations and whitening against plain versions."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from samples import awkward, empty, words
from thermograph.llm import language, phrases, whitening
from thermograph.llm.common import held_out


def plain_grams(text):
    out = Counter()
    for w in re.findall(r"[^\W\d_]+", text or ""):
        w = "".join(c.lower() if len(c.lower()) == 1 else c for c in w)
        out.update(w)
        for n in (2, 3):
            out.update(f" {w} "[i:i + n] for i in range(len(w) + 3 - n))
    return out


def ranked(counts, size):
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], len(x[0]), x[0]))[:size]]


def plain_language(text, profiles, size):
    own = ranked(plain_grams(text), size)
    if not own or not profiles:
        return "und", 0.0
    gap = {k: sum(abs(i - p.index(g)) if g in p else size for i, g in enumerate(own)) for k, p in profiles.items()}
    best = min(sorted(gap), key=gap.get)
    return best, 1 - gap[best] / (size * len(own))


@pytest.fixture
def tongues(spark):
    texts = [" ".join(words(60, i, 40)) + "." for i in range(4)] + ["Über ÄÖ straße İstanbul ǅ", "a", "b b", "12 34 _ --", "日本 語", "x" * 300, "Word " * 500, "étude aé", "ab ab\nab"]
    return awkward(spark, texts).withColumn("lang", F.when(F.col("doc_id") % 3 == 0, "fr").when(F.col("doc_id") % 3 == 1, "en").when(F.col("doc_id") == 2, None).otherwise("é'x"))


@pytest.mark.parametrize("size", [7, 400])
def test_language_profiles_are_plain(spark, tongues, size, monkeypatch):
    rows = tongues.collect()
    total = defaultdict(Counter)
    for r in rows:
        if r.lang is not None:
            total[r.lang].update(plain_grams(r.text))
    want = {k: ranked(c, size) for k, c in total.items() if c}
    profiles = language.learn_profiles(tongues, size)
    letters = lambda code: "".join(chr(code >> s & 0x1FFFFF) for s in (42, 21, 0) if code >> s)
    assert {k: [letters(int(g)) for g in p] for k, p in profiles.items()} == want
    got = language.identify(tongues, profiles, size).collect()
    assert sorted((repr(r.doc_id), r.text or "", r.lang_pred, round(r.score, 12)) for r in got) == sorted((repr(r.doc_id), r.text or "", *(x if isinstance(x, str) else round(x, 12) for x in plain_language(r.text, want, size))) for r in rows)
    assert {c: getattr(got[0], c) for c in ("key", "rank")} == {"key": "yek", "rank": "knar"}


def test_language_of_giant_texts_in_parts(monkeypatch):
    text = " ".join(words(400, 9)) + "," + "y" * 90 + " ends"
    whole = list(language.gram_counts([text]))[0]
    monkeypatch.setattr(language, "GROUP_CHARS", 64)
    part = list(language.gram_counts(["short", text, None, ""]))
    assert [len(p[0]) for p in part[2:]] == [0, 0]
    assert (part[1][0] == whole[0]).all() and (part[1][1] == whole[1]).all()


def test_language_without_rows_or_profiles(spark):
    assert language.learn_profiles(empty(spark)) == {} and language.identify(empty(spark), {}).count() == 0
    assert language.identify(spark.createDataFrame([(1, "some text")], "doc_id long, text string"), {}).first().lang_pred == "und"


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language.op11_language_id(spark, "/root/testdata/sf0.01").filter("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    right, n = out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert right >= 0.99 and n == docs.filter(held_out("doc_id", 4, 2)).count()


def plain_collocations(rows, least, top):
    f, size = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = [x for x in re.split(r"[\x20\x09]", piece) if x]
            size[lang] += len(w)
            for n in range(1, 5):
                f[lang].update(tuple(w[i:i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, counts in f.items():
        cand = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        inside = defaultdict(int)
        for p, a in cand.items():
            for n in range(2, len(p)):
                for i in range(len(p) - n + 1):
                    inside[p[i:i + n]] = max(inside[p[i:i + n]], a)
        own = []
        for p, a in cand.items():
            if 100 * inside[p] < 80 * a or not inside[p]:
                score, k = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
                own.append((score, a, " ".join(p), counts[p[:k]], counts[p[k:]]))
        own.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, i, p, a, left, right, size[lang], s) for i, (s, a, p, left, right) in enumerate(own[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("chunk,keys,merge", [(phrases.CHUNK_BYTES, phrases.PARTITION_KEYS, phrases.MERGE_KEYS), (400, 300, 50)])
def test_collocations_are_plain(spark, chunk, keys, merge, monkeypatch):
    r = random.Random(4)
    fixed = ["New York", "new york city hall", "the\tquick  fox", "É é ß", "a b c", "of the"]
    texts = [" ".join(r.choice(fixed) if r.random() < 0.4 else r.choice(words(6, i, 30)) + r.choice(["", "", ",", ".", "\n", "\r", "! "]) for _ in range(120)) for i in range(30)] + ["the same passage of many words " * 300, ".,;:!?"]
    docs = awkward(spark, texts).withColumn("lang", F.when(F.col("doc_id") % 4 == 0, None).when(F.col("doc_id") % 4 == 1, "und").otherwise(F.lit("fr")))
    pieces = list(phrases._cut(texts[-2] + texts[0], 500))
    assert "".join(pieces) == texts[-2] + texts[0] and len(pieces) > 2
    for name, value in (("CHUNK_BYTES", chunk), ("PARTITION_KEYS", keys), ("MERGE_KEYS", merge)):
        monkeypatch.setattr(phrases, name, value)
    for least, top in ((5, 40), (30, 2000)):
        got = sorted((x.lang, x["rank"], x.phrase, x.a, x.l, x.r, x.n, x.score) for x in phrases.collocations(docs, least, top=top).collect())
        assert got == plain_collocations([(x.lang, x.text) for x in docs.collect()], least, top) and got


def test_collocations_of_empty_tables(spark):
    assert phrases.collocations(empty(spark)).collect() == []
    assert phrases.collocations(spark.createDataFrame([(None, None), ("en", ""), ("en", " . ")], "lang string, text string")).collect() == []


def test_summaries_keep_every_frequent_key():
    r = np.random.default_rng(5)
    for trial in range(40):
        n = r.integers(1, 4000)
        keys = np.minimum(r.geometric(0.002 * (1 + trial % 5), n), 900).astype(np.uint64)
        least = int(r.integers(2, 40))
        summary = phrases.Summary(len(keys) // least + 1)
        for part in np.array_split(keys, int(r.integers(1, 9))):
            summary.merge(part, np.ones(len(part), np.int64))
        exact = Counter(keys.tolist())
        assert {k for k, c in exact.items() if c >= least} <= set(summary.at_least(least).tolist())
        assert len(summary.keys) <= summary.capacity and summary.error * (summary.capacity + 1) <= len(keys)
        assert all(exact[k] - summary.error <= c <= exact[k] for k, c in zip(summary.keys.tolist(), summary.counts.tolist()))


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "other", 1) for i, v in rows], "vec_id long, embedding array<double>, label string, n int")


def check_whitened(got, rows, wanted=32):
    x = np.floor(64 * np.array([v for _, v in rows])).astype(object) + 1000000
    n, sums = len(x), x.sum(0)
    gaps = n * x - sums
    c = gaps.astype(float) / n
    cov = c.T @ c / n
    e = np.linalg.eigvalsh(cov)[::-1]
    rank = int((e > e[0] * 1e-12).sum())
    m = min(wanted, rank)
    table = defaultdict(dict)
    by = sorted(((r.vec_id, r.deviation, r.component, r.whitened, r.explained, r.n, r.identity_error) for r in got), key=repr)
    assert len(by) == n * m and all(r[5] == n and r[6] <= 1e-8 for r in by)
    for r in by:
        table[r[0], r[1]].setdefault(r[2], r)
    for i, (key, _) in enumerate(rows):
        own = table[key, int(sum(g * g for g in gaps[i]))]
        assert sorted(own) == list(range(1, m + 1))
        assert np.allclose([own[k][4] for k in sorted(own)], e[:m] / e.sum(), rtol=1e-9)
    y = np.array([[table[key, int(sum(g * g for g in gaps[i]))][k][3] for k in range(1, m + 1)] for i, (key, _) in enumerate(rows)])
    # Scores times scale give the best approximation of rank m, whatever the sign or the turn within equal variances.
    _, s, vt = np.linalg.svd(c, full_matrices=False)
    assert np.allclose(np.abs((c.T @ y / n / np.sqrt(e[:m])).T @ vt[:m].T), np.eye(m), atol=1e-8) if (np.diff(e[:m + 1 if m < len(e) else m]) < -1e-6 * e[0]).all() else np.allclose(y.T @ y / n, np.eye(m), atol=1e-8)


def test_whitening_equals_an_eigendecomposition(spark):
    r = np.random.default_rng(3)
    rows = [(i, (r.standard_normal(12) * np.arange(1, 13) * 3).tolist()) for i in range(300)]
    rows += [(5, rows[5][1]), (None, rows[6][1])]
    bad = [(900, None), (901, []), (902, [float("nan")] * 12), (903, [None] + [0.0] * 11), (904, [float("inf")] + [0.0] * 11), (905, [1.0, 2.0]), (906, [1e300] * 12)]
    check_whitened(whitening.whiten(vectors(spark, rows + bad)).collect(), rows)
    check_whitened(whitening.whiten(vectors(spark, rows + bad), 4).collect(), rows, 4)


def test_whitening_of_repeated_and_missing_directions(spark):
    """Equal variances are all found; directions without variance are left out."""
    corners = [(2 * d + s, [(8.0 if k == d else 0.0) * (1 - 2 * s) for k in range(6)]) for d in range(4) for s in (0, 1)]
    check_whitened(whitening.whiten(vectors(spark, corners)).collect(), corners)
    for rows in ([(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [], [(1, None)]):
        assert whitening.whiten(vectors(spark, rows)).collect() == []


def test_whitening_of_large_entries(spark):
    rows = [(i, [float(i * 10**9), float(i % 3)]) for i in range(9)]
    got = whitening.whiten(vectors(spark, rows)).collect()
    assert len(got) == 18 and all((r.deviation is None) == (r.vec_id != 4) for r in got) and got[0].identity_error < 1e-6


def test_bidiagonalisation_ends_early_when_nothing_is_missing():
    r = np.random.default_rng(8)
    x = r.standard_normal((200, 80)) * 0.5 ** np.arange(80)
    steps = []

    def product(w, w_all):
        t = x @ w
        steps.append(1)
        return t @ t, x.T @ t, (x @ w_all).T @ t

    v, b = whitening.bidiagonalise(product, 80, np.linalg.norm(x), 4)
    s = np.linalg.svd(b, compute_uv=False)
    assert len(steps) < 80 and np.allclose(s[:4], np.linalg.svd(x, compute_uv=False)[:4], rtol=1e-12)
    assert np.allclose(np.tril(b, -1), 0) and np.allclose(np.triu(b, 2), 0) and np.allclose(v.T @ v, np.eye(v.shape[1]), atol=1e-12)


def test_lm_weights_come_from_texts_held_out_with_their_copies(spark, monkeypatch):
    """The estimates that EM sees are those of the held-out part under counts of the rest, by a plain recount."""
    from thermograph.llm import lm

    texts = [" ".join(words(30, i, 25)) for i in range(40)] + [" ".join(words(30, 3, 25))] * 3 + ["", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    flags = {r.doc_id: r.apart for r in docs.select("doc_id", (F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(lm.PARTS)) == 0).alias("apart")).collect()}
    learn = [i for i in range(len(texts)) if i % 5]
    tokens = {i: [*(texts[i] or "").split(), "\x00end"] for i in learn}
    rest, apart = [i for i in learn if not flags[i]], [i for i in learn if flags[i]]
    one, two = Counter(w for i in rest for w in tokens[i]), Counter(p for i in rest for p in zip(["\x00start", *tokens[i]], tokens[i]))
    one["\x00start"] = one["\x00end"]
    uniform = 1 / (len({w for i in learn for w in tokens[i]}) + 1)
    want = Counter()
    for i in apart:
        for v, w in zip(["\x00start", *tokens[i]], tokens[i]):
            q2 = round(lm.GRID * np.log2(two[v, w] / one[v] / uniform)) if two[v, w] else -9999
            q1 = round(lm.GRID * np.log2(one[w] / sum(one[x] for x in one if x != "\x00start") / uniform)) if one[w] else -9999
            want[int(lm.context_bucket(np.array([one[v]]))[0]), q2, q1] += 1
    seen = []
    original = lm.learn_weights
    monkeypatch.setattr(lm, "learn_weights", lambda *a: seen.append(a) or original(*a))
    lm.score_documents(docs, "doc_id % 5 != 0").collect()
    b, r2, r1, n = seen[0]
    back = lambda r: np.where(r > 0, np.round(lm.GRID * np.log2(np.maximum(r, 1e-300))), -9999).astype(int)
    got = Counter()
    for key, k in zip(zip(b.tolist(), back(r2).tolist(), back(r1).tolist()), n.tolist()):
        got[key] += k
    assert got == want and want and apart


def test_labels_of_repeated_ids_and_bounded_samples(spark):
    from thermograph.llm import toxicity

    docs = spark.createDataFrame([(i % 900, f"text {i}") for i in range(1000)] + [(None, "no id")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(800)] + [(0, 1), (2, None), (None, 1), (5000, 1)], "doc_id long, toxic int")
    everything = toxicity.labelled_sample(docs, labels)
    assert sorted((r.text, r.label) for r in everything.collect()) == sorted((f"text {i}", 1 if i % 900 == 0 else i % 900 % 2) for i in range(1000) if i % 900 < 800)
    some = [sorted((r.text, r.label) for r in toxicity.labelled_sample(d, labels, rows=100).collect()) for d in (docs, docs.repartition(7))]
    assert some[0] == some[1] and 80 <= len(some[0]) <= 100
    assert toxicity.labelled_sample(docs, labels.limit(0)).count() == 0
