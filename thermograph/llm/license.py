"""License scans as an exact set-similarity join of text blocks with templates.

A block (a line, or words on both sides of a line break) matches a template when
it holds at least ``threshold`` of the template's distinct words. One pass splits
every text once, counts in how many lines each template word stands, and cuts
blocks of those texts that hold enough words of a template at all. Words are
ordered by those counts, rarest first; only blocks holding a word of a template's
prefix in that order can match, and length and positional filters discard most
of them before the overlap is counted.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from thermograph.llm.common import row_key, spill, sql_strings, table
from thermograph.llm.keycount import small_batches

#: Opening words of public licences, with the label each stands for.
TEMPLATES = [
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by", "Licensed under the Creative Commons Attribution 4.0 International License"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("reserved", "All rights reserved"),
]
THRESHOLD = 0.8
#: Phrases of the base rule and their labels.
PHRASES = [("mit", ["mit", "license"]), ("apache", ["apache", "license"]), ("gpl", ["general", "public", "license"])]
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Bytes of words, and A-Z in lower case.
INSIDE = np.array([c >= 128 or chr(c).isascii() and chr(c).isalnum() for c in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def template_words(text: str) -> list[str]:
    return sorted(set(re.findall(WORD, text.translate(str.maketrans(UPPER, UPPER.lower())))))


def _needs(words: list[list[str]], threshold: float) -> list[int]:
    return [math.ceil(threshold * len(ws) - 1e-9) for ws in words]


class Split:
    """The words of many texts at once, known words by number (-1: another word)."""

    def __init__(self, texts: list[bytes], vocabulary: list[str]) -> None:
        data = b"\n".join(texts)
        buf = np.frombuffer(data, np.uint8)
        inside = INSIDE[buf]
        steps = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
        starts, ends = np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)
        offsets = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int64)
        self.words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(LOWER[buf[inside]])])
        coded = self.words.dictionary_encode()
        number = {w: i for i, w in enumerate(vocabulary)}
        known = np.array([number.get(w, -1) for w in coded.dictionary.to_pylist()], np.int64)
        self.number = known[coded.indices.to_numpy()] if len(starts) else np.zeros(0, np.int64)
        self.first = np.searchsorted(starts, np.cumsum([0] + [len(t) + 1 for t in texts]))
        self.text = np.repeat(np.arange(len(texts)), np.diff(self.first))
        breaks = np.flatnonzero(buf == 10)
        self.line = np.searchsorted(breaks, starts)

    def places(self, phrase: list[int]) -> np.ndarray:
        """Words at which the known words of ``phrase`` stand consecutively in one text."""
        n = len(self.number) - len(phrase) + 1
        hit = np.ones(max(n, 0), bool)
        for k, w in enumerate(phrase):
            hit &= self.number[k:k + max(n, 0)] == w
        at = np.flatnonzero(hit)
        return at[self.text[at] == self.text[at + len(phrase) - 1]]

    def blocks(self, i: int, span: int, least: int) -> Iterator[tuple[int, int, np.ndarray]]:
        """Start, end and distinct known words of text i's lines, and of the ``span`` words before and after each line break.

        A block of the second kind stays in its paragraph (lines without an empty
        one between), so it holds any notice of up to ``span`` words that starts
        in that line and ends in a later one. Blocks of fewer than ``least``
        known words are left out.
        """
        a, b = self.first[i], self.first[i + 1]
        line = self.line[a:b]
        heads = np.flatnonzero(np.diff(line, prepend=-1))
        ends = np.append(heads[1:], len(line))
        gaps = np.diff(line[heads], append=np.iinfo(np.int64).max) > 1
        last = ends[np.flatnonzero(gaps)] if len(heads) else ends
        paragraph = last[np.searchsorted(last, ends)] if len(heads) else ends
        own = self.number[a:b]
        held = np.concatenate(([0], np.cumsum(own >= 0)))
        for s, e, p, gap in zip(heads.tolist(), ends.tolist(), paragraph.tolist(), gaps.tolist()):
            for start, end in ((s, e),) if gap else ((s, e), (max(s, e - span), min(p, e + span))):
                if held[end] - held[start] >= least:
                    known = np.unique(own[start:end])
                    yield start, end, known[known >= 0]


def scanned(docs: DataFrame, templates: list[tuple[str, str]], threshold: float) -> DataFrame:
    """One pass over (doc_id, text): base counts of each row, blocks of rows that may match, and line counts of template words.

    ``lines`` is set on one row of a batch only: in how many of the batch's lines
    each word of the vocabulary stands.
    """
    words = [template_words(t) for _, t in templates]
    vocabulary = sorted({w for ws in words for w in ws} | {w for _, p in PHRASES for w in p})
    number = {w: i for i, w in enumerate(vocabulary)}
    needs = _needs(words, threshold)
    member = np.zeros((len(vocabulary), len(words)), np.int64)
    for t, ws in enumerate(words):
        member[[number[w] for w in ws], t] = 1
    span = max((len(re.findall(WORD, t)) for _, t in templates), default=1)
    phrases = [[number[w] for w in p] for _, p in PHRASES]
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = (f"doc_id {kind}, key struct<a:bigint,b:bigint>, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base array<string>, "
              "blocks array<struct<start:bigint,size:bigint,block:string,held:array<string>>>, lines array<bigint>")
    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            split = Split([b"" if t is None else t.encode() for t in batch.column(2).to_pylist()], vocabulary)
            n_words = np.diff(split.first)
            known = np.flatnonzero(split.number >= 0)
            v = len(vocabulary)
            # A line of the batch belongs to one text, so its number is enough.
            of_line = np.unique(split.line[known] * v + split.number[known])
            lines = np.bincount(of_line % v, minlength=v)
            present = np.zeros((rows, v), np.int64)
            present[split.text[known], split.number[known]] = 1
            may = ((present @ member) >= np.array(needs, np.int64)).any(1) if needs else np.zeros(rows, bool)
            n_base, first, last = np.zeros(rows, np.int64), np.full(rows, np.iinfo(np.int64).max), np.full(rows, -1)
            base: list[list[str]] = [[] for _ in range(rows)]
            for (label, _), phrase in zip(PHRASES, phrases):
                at = split.places(phrase)
                text, place = split.text[at], at - split.first[split.text[at]]
                np.add.at(n_base, text, 1)
                np.minimum.at(first, text, place)
                np.maximum.at(last, text, place)
                for i in np.unique(text):
                    base[i].append(label)
            blocks = [[{"start": s, "size": e - s, "block": " ".join(split.words[split.first[i] + s:split.first[i] + e].to_pylist()), "held": [vocabulary[k] for k in held]}
                       for s, e, held in split.blocks(i, span, min(needs))] if may[i] else None for i in range(rows)]
            none = n_base == 0
            columns = [batch.column(0), batch.column(1), pa.array(n_words), pa.array(n_base), pa.array(first, mask=none), pa.array(last, mask=none), pa.array(base, out.field("base").type),
                       pa.array(blocks, out.field("blocks").type), pa.array([lines.tolist()] + [None] * (rows - 1), out.field("lines").type)]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, out)], schema=out)

    rows = small_batches(docs.select("doc_id", row_key("doc_id", "text").alias("key"), "text"))
    return rows.mapInArrow(run, schema)


def _matches(rows: DataFrame, templates: list[tuple[str, str]], threshold: float) -> DataFrame:
    words = [template_words(t) for _, t in templates]
    vocabulary = sorted({w for ws in words for w in ws} | {w for _, p in PHRASES for w in p})
    counts = {vocabulary[r["i"]]: r["n"] for r in rows.select(F.posexplode("lines").alias("i", "n")).groupBy("i").agg(F.sum("n").alias("n")).collect()}
    order = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}
    index = []
    for n, ((label, _), ws, need) in enumerate(zip(templates, words, _needs(words, threshold))):
        ranked = sorted(ws, key=order.get)
        index += [(w, n, label, ranked, i, need) for i, w in enumerate(ranked[:len(ws) - need + 1])]
    prefix = rows.sparkSession.createDataFrame(index, "word string, template int, label string, tokens array<string>, i int, need int")
    ranks = "map(" + ", ".join(f"'{w}', {i}" for w, i in order.items()) + ")"
    near = rows.filter("blocks IS NOT NULL").select("key", "doc_id", F.explode("blocks").alias("x")).select("key", "doc_id", "x.*").filter(f"arrays_overlap(held, array({sql_strings({x[0] for x in index})}))")
    near = near.selectExpr("key", "doc_id", "start", "size", "block", f"transform(array_sort(transform(held, w -> named_struct('r', {ranks}[w], 'w', w))), x -> x.w) AS held")
    probes = near.select("key", "doc_id", "start", "size", "block", "held", F.posexplode("held").alias("j", "word"))
    # The words before the shared one agree in min(i, j) at most, those after in the shorter rest.
    found = probes.join(F.broadcast(prefix), "word").filter("size(held) >= need AND least(i, j) + 1 + least(size(tokens) - i - 1, size(held) - j - 1) >= need")
    found = found.selectExpr("key", "doc_id", "start", "size", "block", "label", "template", "need", "size(tokens) AS n", "size(array_intersect(held, tokens)) AS common").filter("common >= need")
    return found.selectExpr("key", "doc_id", "start", "size", "block", "label", "template", "CAST(common AS DOUBLE) / n AS containment").distinct()


def matching_blocks(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """All (block, template) with enough containment: key, doc_id, start, size, block, label, template, containment.

    ``key`` tells rows by content, ``start`` and ``size`` count words of the
    text, ``block`` is their text. Templates are a constant of the caller, so
    they and the counts of their words (one row per word) are the only things
    that reach the driver or every task.
    """
    return _matches(spill(scanned(docs, templates, threshold)), templates, threshold)


def license_scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Base phrases and matched templates of every row.

    Result: doc_id, n_words, n_base, first_word, last_word, base_labels, labels,
    score. The score is 1 where a base phrase stands, else the largest
    containment of a matched block, else 0. Only A-Z are lower-cased. Null and
    empty texts have no words, places null, labels empty, score 0. Repeated rows
    are reported each. Other columns are ignored.
    """
    rows = spill(scanned(docs, templates, threshold))
    hits = _matches(rows, templates, threshold).groupBy("key").agg(F.max("containment").alias("best"), F.collect_set("label").alias("more"))
    some = rows.filter("blocks IS NOT NULL").join(hits, "key", "left").select("doc_id", "n_words", "n_base", "first_word", "last_word", "base", "best", "more")
    rest = rows.filter("blocks IS NULL").select("doc_id", "n_words", "n_base", "first_word", "last_word", "base", F.lit(None).cast("double").alias("best"), F.lit(None).cast("array<string>").alias("more"))
    return some.unionByName(rest).selectExpr(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "array_join(array_sort(base), ',') AS base_labels",
        "array_join(array_sort(array_union(base, coalesce(more, CAST(array() AS array<string>)))), ',') AS labels", "CASE WHEN n_base > 0 THEN 1D ELSE coalesce(best, 0D) END AS score")


def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _oracle() -> str:
    """The same in DuckDB: lines, and up to ``span`` words on both sides of each line break within a paragraph."""
    low = f"translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}')"
    span = max(len(re.findall(WORD, t)) for _, t in TEMPLATES)
    hits = ", ".join(f"list_filter(range(0, len(w) - {len(p) - 1}), lambda i: {' AND '.join(f'w[i + {k + 1}] = {x!r}' for k, x in enumerate(p))}) AS p{n}" for n, (_, p) in enumerate(PHRASES))
    base = ", ".join(f"CASE WHEN len(p{n}) > 0 THEN '{label}' END" for n, (label, _) in enumerate(PHRASES))
    every = "list_concat(list_concat(p0, p1), p2)"
    rows = ", ".join(f"({n}, '{label}', [{sql_strings(template_words(t))}], {math.ceil(THRESHOLD * len(template_words(t)) - 1e-9)})" for n, (label, t) in enumerate(TEMPLATES))
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, {low} AS t FROM documents),
e AS (SELECT *, regexp_extract_all(t, '{WORD}') AS w FROM d),
p AS (SELECT k, doc_id, w, {hits} FROM e),
b AS (SELECT k, doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len({every}) AS BIGINT) AS n_base, CAST(list_min({every}) AS BIGINT) AS first_word, CAST(list_max({every}) AS BIGINT) AS last_word,
  list_filter([{base}], lambda x: x IS NOT NULL) AS base FROM p),
x AS (SELECT k, unnest(l) AS x, unnest(range(1, len(l) + 1)) AS i FROM (SELECT k, string_split(t, chr(10)) AS l FROM d)),
n AS (SELECT k, i, len(regexp_extract_all(x, '{WORD}')) AS n FROM x),
y AS (SELECT k, i, n, sum(n) OVER (PARTITION BY k ORDER BY i) AS e, sum(CASE WHEN n = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY i) AS part FROM n),
z AS (SELECT k, e - n AS s, e, max(e) OVER (PARTITION BY k, part) AS top FROM y WHERE n > 0),
r AS (SELECT k, s, e FROM z UNION SELECT k, greatest(s, e - {span}), least(top, e + {span}) FROM z WHERE top > e),
l AS (SELECT r.k, list_distinct(e.w[CAST(r.s AS BIGINT) + 1:CAST(r.e AS BIGINT)]) AS w FROM r JOIN e ON e.k = r.k),
v(template, label, tokens, need) AS (VALUES {rows}),
h AS (SELECT k, label, len(list_intersect(w, tokens))::DOUBLE / len(tokens) AS c FROM l JOIN v ON len(list_intersect(w, tokens)) >= need),
g AS (SELECT k, max(c) AS best, list(DISTINCT label) AS more FROM h GROUP BY k)
SELECT doc_id, n_words, n_base, first_word, last_word, array_to_string(list_sort(base), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(base, coalesce(more, [])))), ',') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0::DOUBLE) END AS score
FROM b LEFT JOIN g USING (k)"""


QUERIES = {"op2_license_scans": (op2_license_scans, _oracle())}
