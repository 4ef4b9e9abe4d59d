"""Packing, vectors, pieces, and the pipeline on small tables."""

import math
import random
import struct
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from samples import awkward, empty, words
from thermograph.llm import embeddings, packing, pieces

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", "  a  b\n\n c ", "日本 x🙂y ¦ ¦¦ a¦b", "İstanbul ΣΑΣ ſtraße Ǆ don't we'll I'M 3x4 x_y <|endoftext|> 'S", "é ́x a\x1cb a b c", "Hello, World!! (ÀÉÎ) ÿÿ.,;:", "tab\tand\x0bfeed"]


def test_words_encode_like_whole_texts():
    tok = Tokenizer.from_file(WORD_BPE)
    for text in ODD + [" ".join(words(200, 1)), "Mixed CASE words, and marks; " * 30]:
        assert packing.encode_words(text, WORD_BPE) == np.array(tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


@pytest.mark.parametrize("seed", range(4))
def test_plan_fills_sequences(seed):
    r = random.Random(seed)
    capacity = [10, 64, 4096, 7][seed]
    histogram = {n: r.randrange(1, 60) for n in r.sample(range(1, capacity + 1), min(capacity, 40))}
    bins, ranks = defaultdict(list), defaultdict(int)
    for length, rank, n, first, offset in packing.plan_best_fit(histogram, capacity):
        assert rank == ranks[length]
        ranks[length] += n
        for i in range(n):
            bins[first + i].append((offset, length))
    assert dict(ranks) == histogram
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(k * v for k, v in histogram.items())
    assert len(bins) <= math.ceil(11 / 9 * total / capacity) + 2


def test_packed_documents(spark):
    docs = awkward(spark, ODD + [" ".join(words(n, n)) for n in (5, 300, 2500, 9000)])
    rows = packing.packed_documents(docs, WORD_BPE).collect()
    tok = Tokenizer.from_file(WORD_BPE)
    want, sequences = [], defaultdict(list)
    for r in docs.collect():
        ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, 1]
        for i in range(0, len(ids), 4096):
            part = ids[i:i + 4096]
            want.append((r.doc_id, i // 4096, i, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))))
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in rows)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.packed_documents(empty(spark), WORD_BPE).count() == 0


def vectors(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(60, 16))
    rows = [(i, x.tolist()) for i, x in enumerate(base)]
    rows += [(100 + i, (base[0] + rng.normal(size=16) * 0.08).tolist()) for i in range(40)]
    rows += [(200 + i, (base[1] * (i + 1)).tolist()) for i in range(3)] + [(300, base[2].tolist()), (300, base[2].tolist()), (301, None), (302, [0.0] * 16), (303, [float("nan")] + [1.0] * 15),
             (304, [float("inf")] + [1.0] * 15), (305, [None] + [1.0] * 15), (306, []), (307, base[3][:8].tolist()), (None, base[4].tolist()), (308, (base[5] * 1e-200).tolist()), (309, (base[5] * 1e200).tolist())]
    return rows


def test_vectors_equal_plain_version(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "CELL_VECTORS", 12)
    monkeypatch.setattr(embeddings, "BLOCK_VECTORS", 7)
    rows = vectors(spark)
    table = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, label int").repartition(4)
    unit = []
    for _, v in rows:
        x = np.array([np.nan if c is None else c for c in (v or [])], float)
        good = len(x) > 0 and np.isfinite(x).all() and x.any()
        unit.append(x / np.abs(x).max() / np.linalg.norm(x / np.abs(x).max()) if good else None)
    linked = [[a is not None and b is not None and len(a) == len(b) and i != j and a @ b >= 0.95 for j, b in enumerate(unit)] for i, a in enumerate(unit)]
    root = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            root[i] = min([root[i]] + [root[j] for j in range(len(rows)) if linked[i][j]])
    least = defaultdict(list)
    for (vec, _), r in zip(rows, root):
        least[r].append(vec)
    want = [(vec, int(sum(x)), min((v for v in least[r] if v is not None), default=None)) for (vec, _), x, r in zip(rows, linked, root)]
    got = embeddings.near_vectors(table).collect()
    assert sorted(map(repr, want)) == sorted(repr((r.vec_id, r.n_links, r.component_id)) for r in got)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert embeddings.near_vectors(table.limit(0)).count() == 0


def brute(model, text):
    """Plain Viterbi over the whole text."""
    score, back = model.best(text, [0.0], len(text))
    return model.trace(text, back, len(text))[1]


@pytest.fixture(scope="module")
def model():
    return pieces.Pieces(PIECES)


def test_units_stop_all_paths(model):
    assert model.units is not None
    for text in ODD + [" ".join(words(100, 2)), "a" * 500, "x" + " " * 50 + "y"]:
        t = pieces.marked(text)
        assert model.encode(t) == brute(model, t)
        assert model.decode(model.encode(t)) == text


def test_matrices_combine(model):
    text = pieces.marked("internationalisation" * 20 + " of everything " * 5)
    parts = [(text[i:i + 64], text[i + 64:i + 64 + model.longest - 1]) for i in range(0, len(text), 64)]
    a, b, c = (model.transfer(*p) for p in parts[:3])
    assert np.array_equal(pieces.times(pieces.times(a, b), c), pieces.times(a, pieces.times(b, c)))


@pytest.mark.parametrize("chunk", [16, 61, 700])
def test_giant_texts_in_chunks(spark, model, chunk):
    texts = ODD + ["supercalifragilistic" * 60, " ".join(words(900, 3)), "line\n" * 300, "日本語" * 200, "a" + " " * 400 + "b"]
    docs = awkward(spark, texts)
    out = pieces.decode_documents(pieces.encode_documents(docs, PIECES, chunk), PIECES).collect()
    want = [(r.doc_id, brute(model, pieces.marked(r.text)), r.text or "") for r in docs.collect()]
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, bytes(r.ids), r.text)) for r in out)


def test_pieces_of_empty_table(spark):
    assert pieces.encode_documents(empty(spark), PIECES).count() == 0


def test_pipeline_stages(spark):
    small = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    bad = spark.createDataFrame([(None, None, None, None, None), (900001, "", None, None, 0), (900002, " ", "en", "x", 1), (900002, " ", "en", "x", 1)], small.schema)
    docs, before = small.unionByName(bad), None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001").cache()
        assert out.columns == docs.columns, name
        n = docs.count()
        assert 0.8 * n < out.count() <= n, name
        assert out.filter("doc_id = 900001").count() == 1 and out.filter("doc_id IS NULL").count() == 1, name
        assert stage(spark, docs.limit(0), "/root/testdata/sf0.001").count() == 0, name
        docs, before = out, docs
    assert docs.filter("text != '' AND n_chars != char_length(text)").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001")
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 4096").count() == 0
    assert before is not None
