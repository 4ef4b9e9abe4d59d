"""Numbered names that several bases may want (``A`` + 11 and ``A1`` + 1)."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import pairwise
from math import inf

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thermograph.session import cut_lineage


class _Rows:
    """A base's rows, known at some of them: ``at[i]`` is the order of its ``count[i]``-th row, from the first to the last."""

    def __init__(self, at: list, count: list):
        self.at, self.count, self.early, self.late = at, count, -inf, -inf

    def least(self, t) -> int:
        i = bisect_right(self.at, t)
        return self.count[i - 1] if i else 0

    def most(self, t) -> int:
        i = bisect_right(self.at, t)
        return self.count[-1] if i == len(self.at) else self.count[i] - 1


def _full(some: list[_Rows], size: int, count, since: list[int]):
    """The first known order at which ``size`` rows have come, each base counted from ``since`` on."""
    come = lambda t: sum(max(0, count(r, t) - n) for r, n in zip(some, since))
    if come(inf) < size:
        return inf
    best = inf
    for r in some:
        i = bisect_left(r.at, size, key=come)
        best = min(best, r.at[i]) if i < len(r.at) else best
    return best


def stretches(bases: dict[str, _Rows], used: set[str]) -> Iterator[tuple]:
    """(digits, size, [(base, before, after)], early, late) of each run of free names that the same bases pass.

    Every base takes its names by length and then by value, so names are
    decided in that order. Along a run each name goes to the earliest row of
    its bases that has no name yet: all of them together fill it from the left,
    and each goes on to its next run when this one is full. The order at
    which it is full lies between ``early`` and ``late``; these meet where all
    rows near them are known. ``before`` and ``after`` are the (least, most)
    rows of a base named at entry and when the run is full.
    """
    level = min(map(len, bases))
    while True:
        alive = {b: r for b, r in bases.items() if r.early < r.at[-1]}
        if not alive:
            return
        level = max(level, min(map(len, alive)))
        come, go, taken = {}, {}, {int(u or 0) for u in used if len(u) == level}
        for b in alive:
            d = level - len(b)
            if d >= 0:
                first = int(b or 0) * 10 ** d
                come.setdefault(first + (10 ** (d - 1) if d else 0), []).append(b)
                go.setdefault(first + 10 ** d, []).append(b)
        here: dict[str, None] = {}
        for p, q in pairwise(sorted({*come, *go, *taken, *(u + 1 for u in taken)})):
            for b in go.get(p, ()):
                del here[b]
            here.update(dict.fromkeys(come.get(p, ())))
            on = [b for b in here if bases[b].early < bases[b].at[-1]]
            if p in taken or not on:
                continue
            rows = [bases[b] for b in on]
            least, most = [r.least(r.early) for r in rows], [0 if r.late == -inf else r.most(r.late) for r in rows]
            early, late = _full(rows, q - p, _Rows.most, least), _full(rows, q - p, _Rows.least, most)
            for r in rows:
                r.early, r.late = max(r.early, early), max(r.late, late)
            yield str(p).zfill(level), q - p, [(b, (n, m), (r.least(r.early), r.most(r.late))) for b, r, n, m in zip(on, rows, least, most)], early, late
        level += 1


def _read(pdf: pd.DataFrame) -> tuple[dict[str, _Rows], set[str]]:
    known = pdf[pdf["_k"] > 0].sort_values(["_t", "_k"])
    return {b: _Rows(x["_at"].tolist(), x["_k"].tolist()) for b, x in known.groupby("_t")}, set(pdf.loc[pdf["_k"] == 0, "_t"])


def contested_names(rows: DataFrame, used: DataFrame, keys: list[str], order: str, block_rows: int) -> DataFrame:
    """Adds ``_s``, the run of names a row is named from, and ``_i0``, the number its base gives to the run's first name.

    ``rows``: keys, _g, _b, _n, _k and the order; ``_g`` is the shortest base of
    a group, ``_k`` numbers the ``_n`` rows of a base from 1. A task finds the
    runs of a group from one row in ``block_rows``, then from all rows of the
    blocks in which a run can get full; rows find their run by ``_k``.
    """
    group = [*keys, "_g"]
    tail = F.expr("substring(_b, length(_g) + 1)")
    rows = cut_lineage(rows.withColumn("_block", F.floor((F.col("_k") - 1) / block_rows)))
    known = lambda r: r.select(*group, tail.alias("_t"), F.col("_k").cast("bigint").alias("_k"), F.col(order).alias("_at"))
    mark = (F.col("_k") == 1) | (F.col("_k") == F.col("_n")) | (F.col("_k") % block_rows == 0)
    taken = used.select(*group, F.concat(tail, F.when(F.col("_i") > 0, F.col("_i").cast("string")).otherwise("")).alias("_t"), F.lit(0).cast("bigint").alias("_k"), F.lit(0).cast(rows.schema[order].dataType).alias("_at"))
    of_group = [rows.schema[k] for k in group]
    fields = lambda *names: T.StructType([*of_group, T.StructField("_b", T.StringType()), *[T.StructField(n, T.LongType()) for n in names]])

    def near(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        bases, taken = _read(pdf)
        blocks = set()
        for _, _, some, early, late in stretches(bases, taken):
            if early < inf:
                for b, _, _ in some:
                    r = bases[b]
                    low, high = r.least(early) // block_rows, min(r.most(late), r.count[-1] - 1) // block_rows
                    blocks.update((b, i) for i in range(low, high + 1))
        return pd.DataFrame([(*key, key[-1] + b, i) for b, i in blocks], columns=[*group, "_b", "_block"])

    def runs(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for s, (digits, _, some, early, late) in enumerate(stretches(*_read(pdf))):
            if early != late or any(n[0] != n[1] for _, *ends in some for n in ends):
                raise RuntimeError(f"names of {key} are not decided")
            out += [(*key, key[-1] + b, s, before[0], after[0], int(digits[len(b):] or 0)) for b, before, after in some if after[0] > before[0]]
        return pd.DataFrame(out, columns=[*group, "_b", "_s", "_from", "_to", "_i0"])

    blocks = known(rows.filter(mark)).unionByName(taken).groupBy(*group).applyInPandas(near, fields("_block"))
    more = rows.join(blocks.withColumn("_open", F.lit(True)), [*group, "_b", "_block"], "left").filter(mark | F.col("_open"))
    found = known(more).unionByName(taken).groupBy(*group).applyInPandas(runs, fields("_s", "_from", "_to", "_i0"))
    found = found.withColumn("_block", F.explode(F.sequence(F.floor(F.col("_from") / block_rows), F.floor((F.col("_to") - 1) / block_rows))))
    return rows.join(found, [*group, "_b", "_block"]).filter((F.col("_k") > F.col("_from")) & (F.col("_k") <= F.col("_to"))).drop("_block", "_from", "_to")
