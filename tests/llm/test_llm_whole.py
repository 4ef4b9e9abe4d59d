"""Cases that operators once left out."""

import textwrap

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from samples import awkward, words
from thermograph.llm import license as lic
from thermograph.llm import lines, pieces, quality


def test_license_notices_wrapped_over_lines(spark):
    long = [i for i, (_, t) in enumerate(lic.TEMPLATES) if len(t) > 90]
    texts = [f"words before\n\n{mark}" + f"\n{mark}".join(textwrap.wrap("Copyright (c) 2020 A. Person. " + lic.TEMPLATES[i][1] + ", and so on with other words.", width)) + "\n\nafter it"
             for i in long for width in (20, 40, 72) for mark in ("", "# ", " * ")]
    labels = [lic.TEMPLATES[i][0] for i in long for _ in range(9)]
    apart = "Permission is hereby granted, free of charge,\n\n" + "other words " * 40 + "\n\nto any person obtaining a copy of this software and associated documentation files"
    one_long = "filler " * 500 + "Redistribution and use in source and binary forms,\nwith or without modification, are permitted provided that the following conditions are met " + "filler " * 500
    by = {r.doc_id: r for r in lic.license_scan(awkward(spark, [*texts, apart.replace("to any person obtaining a copy", "to a person with a copy"), one_long])).collect()}
    n = len(texts)
    assert all(label in by[i].labels.split(",") for i, label in enumerate(labels))
    assert all(by[i].score >= 0.8 for i in range(n))
    assert by[n].labels == "" and by[n + 1].labels == "bsd" and by[n + 1].score == 1


def test_lines_of_short_texts_and_long_lines(spark):
    long, part = " ".join(words(137, 1)), [" ".join(words(20, i)) for i in (2, 3)]
    texts = ["two words", "two words", "a\n\nb", "a\n\nb", f"head\n{long}", f"{long}\ntail", "\n".join(["x", *part, "y"]), "\n".join(["z", *part]), "two words\nand more", part[0] + "\nrest"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    by = {r.doc_id: (r.text, r.n_removed) for r in lines.drop_repeated_runs(docs, short_words=35).collect()}
    want = {i: (t, 0) for i, t in enumerate(texts)} | {1: ("", 1), 3: ("", 2), 5: ("tail", 1), 7: ("z", 2)}
    assert by == {**want, 3: ("", 2)}


def test_lines_of_texts_that_share_an_id(spark):
    """Different texts of one doc_id, or of none, with a run at the same place: one keeps it."""
    for key in (5, None):
        docs = spark.createDataFrame([(key, "a\nb\nc\nend"), (key, "a\nb\nc\nother end"), (key, "a\nb\nc\nthird")], "doc_id long, text string")
        assert sorted(r.n_removed for r in lines.drop_repeated_runs(docs).collect()) == [0, 3, 3]


@pytest.mark.parametrize("chunk", [16, 300, pieces.CHUNK_CHARS])
def test_pieces_are_those_of_the_library(spark, chunk):
    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    own = [" lead and trail ", "a\n\n b \n", "\u2581mark\u2581", "x" * 500, "日本語🙂 é́ " * 30, "tab\tand  two   three ", "\n" * 40, "word\nword " * 50, " " * 90]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(own)], "doc_id long, text string"))
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in pieces.encode_documents(docs, path, chunk).collect()}
    assert got == {r.doc_id: sp.encode(r.text or "") for r in docs.collect()}


def test_quality_of_languages_without_a_reference(spark, tmp_path):
    """Clean Russian text stays, junk that claims to be Russian goes; Russian text that claims to be English, or claims nothing, is far from every reference."""
    import duckdb

    en = " ".join(w for k in range(60) for w in ("the", f"house{k}", "of", f"stone{k}", "and", "to", f"river{k}", "in", "is", f"field{k}"))
    ru = " ".join(w for k in range(60) for w in ("и", f"дом{k}", "в", f"река{k}", "не", "на", f"поле{k}", "что"))
    junk = " ".join(f"#{k}$$% <{k * 7}> ||*" for k in range(120))
    rows = [(i, en.replace("river", f"r{i}'"), "en") for i in range(12)] + [(20, ru, "ru"), (21, ru, "en"), (22, ru, None), (23, "много слов " * 60, "ru"), (24, "мало слов", "ru"), (25, junk, "ru"), (26, junk, None), (27, None, "en"), (28, "", "o'x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    by = {r.doc_id: r.kept for r in quality.quality_rules(docs).collect()}
    assert by == {**{i: i < 12 or i == 20 for i in by}} and len(by) == len(rows)
    docs.coalesce(1).write.parquet(f"{tmp_path}/docs")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/docs/*.parquet'")
    assert {r[0]: r[-1] for r in con.execute(quality.QUERIES["op10_quality_rules"][1]).fetchall()} == by


def test_license_scan_equals_its_sql(spark, tmp_path):
    """Wrapped, marked and interrupted notices, Unicode look-alikes of K and I, and odd line ends."""
    import duckdb

    notices = [t for _, t in lic.TEMPLATES]
    texts = [f"{mark}" + f"{end}{mark}".join(textwrap.wrap("Some words. " + t + " and more", width)) for t in notices for width, mark, end in ((12, "", "\n"), (30, "// ", "\n"), (50, "", "\n\n"), (45, "", "\r\n"), (25, "\t", "\n \n"))]
    texts += ["MIT Keep LİCENSE", "mit license", "general\npublic\n\nlicense", *notices, "\n\n\n", "all\nrights\nreserved\n" * 20]
    docs = awkward(spark, texts)
    docs.select("doc_id", "text").coalesce(1).write.parquet(f"{tmp_path}/docs")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/docs/*.parquet'")
    want = con.execute(lic.QUERIES["op2_license_scans"][1]).fetchall()
    got = [tuple(r) for r in lic.license_scan(docs).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and sum(r[6] != r[5] for r in got) > 20
