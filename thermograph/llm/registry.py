"""Registered queries of the subpackage: name -> (Spark callable, reference SQL or None)."""

from __future__ import annotations

import importlib

MODULES = ["thermograph.llm." + m for m in ("jaccard", "license", "toxicity", "lines", "packing", "pieces", "substrings", "embeddings", "lm", "quality", "language", "phrases", "whitening")] + ["corpus_pipeline"]


def registered() -> dict:
    from thermograph.llm.oracles import SQL

    out: dict = {}
    for name in MODULES:
        out.update({k: (fn, sql or SQL.get(k)) for k, (fn, sql) in importlib.import_module(name).QUERIES.items()})
    return out
