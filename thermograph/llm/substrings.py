"""Removal of repeated word windows by recompression.

Every text is parsed in rounds: short runs of one symbol, then neighbouring
pairs, are replaced by names. A name is a hash of what it stands for, so all
tasks give equal content the same name without a dictionary; whether two
neighbours join depends on those two alone, so equal substrings get the same
symbols inside, except within a fixed margin of their ends. One symbol of each
window, chosen by content, is exchanged with its context; windows on a symbol
found again are then verified by 128-bit hashes of all their words.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from thermograph.llm.common import spill, table
from thermograph.llm.keycount import BLOCKS, blocks, bucket_count, chunk_texts, distinct, exploded, in_order, key_totals, mix, small_batches, text_bytes

WINDOW = 35
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)  # odd multipliers of the two rolling hashes


def rounds_for(window: int) -> tuple[int, int, int]:
    """(rounds, margin, longest symbol) such that each window holds a whole symbol between its margins.

    A symbol's identity depends on its own words and a margin on both sides.
    The round for runs makes symbols of 2 words with margin 2; each pair round
    adds the longest symbol to the margin and doubles it.
    """
    rounds, margin, longest = 0, 0, 1
    while True:
        m, n = (2, 2) if rounds == 0 else (margin + longest, 2 * longest)
        if 2 * m + 2 * n - 1 > window:
            return rounds, margin, longest
        rounds, margin, longest = rounds + 1, m, n


def parse(words: np.ndarray, doc: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Names and first words of the symbols after some rounds; ``doc`` parts the texts."""
    names, start = words, np.arange(len(words))
    for level in range(rounds):
        same_doc = doc[start[:-1]] == doc[start[1:]]
        if level == 0:  # runs of exactly two; longer ones stay single symbols
            equal = (names[:-1] == names[1:]) & same_doc
            joins = equal & ~np.concatenate(([False], equal[:-1])) & ~np.concatenate((equal[1:], [False])) if len(equal) else equal
        else:
            side = (mix(names + np.uint64(level)) & np.uint64(1)).astype(bool)
            joins = ~side[:-1] & side[1:] & same_doc
        joined = np.flatnonzero(joins)
        names = names.copy()
        names[joined] = mix(mix(names[joined] + np.uint64(level * 2 + 1)) * np.uint64(BASES[0]) + names[joined + 1])
        keep = np.ones(len(names), bool)
        keep[joined + 1] = False
        names, start = names[keep], start[keep]
    return names, start


class Chunk:
    """Words of a chunk of texts and the hashes of any of their stretches."""

    def __init__(self, texts: pa.Array, window: int):
        self.window = window
        self.words = [(t.as_py() or "").encode().split() for t in texts]
        self.lengths = np.array([len(w) for w in self.words], np.int64)
        places: dict[bytes, int] = {}
        stream = np.array([places.setdefault(w, len(places)) for ws in self.words for w in ws], np.int64)
        self.hashes = np.array([xxhash.xxh64_intdigest(w) for w in places], np.uint64)[stream] if len(stream) else np.zeros(0, np.uint64)
        self.doc = np.repeat(np.arange(len(self.lengths)), self.lengths)
        ends = np.cumsum(self.lengths)
        left = np.repeat(ends, self.lengths) - np.arange(len(self.doc))
        self.places = np.flatnonzero(left >= window)  # where a window can start

    def stretch(self, first: np.ndarray, after: np.ndarray, seed: int) -> np.ndarray:
        """64-bit hashes of the words from ``first`` up to ``after``."""
        base = np.uint64(BASES[seed])
        n = len(self.hashes)
        power = np.full(n + 1, base, np.uint64)
        power[0] = 1
        np.multiply.accumulate(power, out=power)
        back = np.full(n + 1, np.uint64(pow(BASES[seed], -1, 2**64)), np.uint64)
        back[0] = 1
        np.multiply.accumulate(back, out=back)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(self.hashes + np.uint64(seed)) * power[:n], dtype=np.uint64, out=total[1:])
        return mix((total[after] - total[first]) * back[first] + (after - first).astype(np.uint64))

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct anchor keys, their counts, and the place of each window's anchor in them."""
        if not len(self.places):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        rounds, margin, _ = rounds_for(self.window)
        names, start = parse(self.hashes, self.doc, rounds)
        end = np.append(start[1:], len(self.hashes))
        order = (mix(names) & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(names), dtype=np.uint64)
        lo = np.searchsorted(start, self.places + margin)
        hi = np.searchsorted(end, self.places + self.window - margin, "right")
        size = hi - lo
        best = np.zeros(len(lo), np.uint64)
        least, width = order, 1
        while width <= size.max():
            own = (size >= width) & (size < 2 * width)
            best[own] = np.minimum(least[lo[own]], least[hi[own] - width])
            least = np.minimum(least[:-width], least[width:]) if len(least) > width else least
            width *= 2
        chosen, which = np.unique((best & np.uint64(0xFFFFFFFF)).astype(np.int64), return_inverse=True)
        keys = self.stretch(start[chosen] - margin, end[chosen] + margin, 0)
        found, place, _ = distinct(keys)
        return found, np.bincount(place, minlength=len(found)), place[which]

    def windows(self, totals: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of the windows whose anchor occurs twice or more: distinct keys, counts, check bits, and starts with places."""
        _, _, place = self.anchors()
        first = self.places[totals[place] >= 2] if len(place) else self.places
        k, which, checks = distinct(self.stretch(first, first + self.window, 0), self.stretch(first, first + self.window, 1))
        return k, np.bincount(which, minlength=len(k)), checks, first, which

    def kept(self, anchors: np.ndarray, totals: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Texts of the words that no repeated window covers, and the number of words removed."""
        *_, first, which = self.windows(anchors)
        again = first[totals[which] >= 2] if len(which) else first
        edge = np.zeros(len(self.doc) + 1, np.int64)
        np.add.at(edge, again, 1)
        np.add.at(edge, again + self.window, -1)
        gone = np.cumsum(edge[:-1]) > 0
        removed = np.bincount(self.doc[gone], minlength=len(self.lengths))
        starts = np.cumsum(self.lengths) - self.lengths
        texts = [b" ".join(w if not r else [x for x, g in zip(w, gone[s:s + len(w)]) if not g]).decode() for w, s, r in zip(self.words, starts, removed)]
        return texts, removed


def remove_repeats(docs: DataFrame, window: int = WINDOW, layout: bool = False) -> DataFrame:
    """Remove each word covered by a window of words that also starts anywhere else.

    Result: the columns of ``docs`` with ``text`` as the kept words joined by one
    space, and ``n_words``, ``n_removed`` (replacing columns of these names).
    Windows are judged on the input; every occurrence of a repeated window is
    removed, the first included, be it in the same text or another. Words are
    runs without ASCII white space, unchanged. A null text counts as empty and
    becomes empty; texts shorter than the window keep all words. With ``layout``
    a text that loses nothing stays as it is, white space and all. Repeated rows
    are repeats of each other, whatever their doc_id. An empty table gives an
    empty result.
    """
    rest = [c for c in docs.columns if c not in ("text", "n_words", "n_removed")]
    packed = docs.select("text", F.struct(*rest, F.lit(0).alias("__pad")).alias("row"))
    kind = packed.schema["row"].dataType.simpleString()
    schema = f"chunk bigint, texts array<string>, rows array<{kind}>, found {BLOCKS}"
    buckets = bucket_count(text_bytes(docs) // 40)
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def first(texts: pa.Array) -> dict:
        keys, counts, _ = Chunk(texts, window).anchors()
        return {"found": blocks(keys, counts, buckets)}

    chunks = spill(small_batches(packed).mapInArrow(partial(chunk_texts, f=first, schema=arrow), schema))
    anchors = spill(key_totals(exploded(chunks, "found")).select("chunk", "bucket", "totals").withColumn("kind", F.lit("anchor")))

    def verify(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [{"chunk": left["chunk"][i].as_py(), "found": blocks(k, c, buckets, m)} for i in range(left.num_rows)
               for k, c, m, *_ in [Chunk(left["texts"][i].values, window).windows(in_order(right.to_pandas()))]]
        return pa.Table.from_pylist(out, schema=pa.schema([arrow.field("chunk"), arrow.field("found")]))

    texts = chunks.select("chunk", "texts")
    windows = spill(texts.groupBy("chunk").cogroup(anchors.groupBy("chunk")).applyInArrow(verify, f"chunk bigint, found {BLOCKS}"))
    repeats = key_totals(exploded(windows, "found")).select("chunk", "bucket", "totals").withColumn("kind", F.lit("window"))
    values = spill(anchors.unionByName(repeats))
    result = f"text string, row {kind}, n_words bigint, n_removed bigint"
    shape = to_arrow_schema(StructType.fromDDL(result))

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        totals = right.to_pandas()
        out = []
        for i in range(left.num_rows):
            chunk = Chunk(left["texts"][i].values, window)
            kept, removed = chunk.kept(*(in_order(totals[totals["kind"] == k]) for k in ("anchor", "window")))
            if layout:
                kept = [k if r else t.as_py() for k, r, t in zip(kept, removed, left["texts"][i].values)]
            out.append(pa.Table.from_arrays([pa.array(kept, pa.string()), left["rows"][i].values.cast(shape.field("row").type), pa.array(chunk.lengths), pa.array(removed.astype(np.int64))], schema=shape))
        return pa.concat_tables(out) if out else shape.empty_table()

    done = chunks.select("chunk", "texts", "rows").groupBy("chunk").cogroup(values.groupBy("chunk")).applyInArrow(finish, result)
    return done.select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns if c not in ("n_words", "n_removed")], "n_words", "n_removed")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


QUERIES = {"op7_substring_dedup": (op7_substring_dedup, None)}
