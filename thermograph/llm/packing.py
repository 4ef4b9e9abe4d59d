"""Best-fit packing by length-histogram planning.

The plan is made over counts of lengths (at most ``capacity`` of them), so the
driver never sees a document. Each piece then takes the planned slot of its
rank within its length.
"""

from __future__ import annotations

import bisect
import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from thermograph.llm.common import spill, table

CAPACITY = 4096
END_ID = 1
#: Words whose ids a Python worker remembers; beyond it the memory starts anew.
CACHE_WORDS = 800_000
#: Stands between words that are encoded together; words holding it are encoded alone.
MARK = "¦"
#: Rows of one rank group; the number of groups follows the number of rows.
GROUP_ROWS = 100_000

#: Words of plain Latin letters with marks behind, which lower-casing byte-level tokenizers split there.
PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-į]+)([!-&(-/:-@[-`{-~]*)")
PROBES = ["Word", "word,", "Éa.", "STRASSE!?", "niño", "Übergröße--", "x_"]

_TOKENIZERS: dict[str, tuple] = {}


def _byte_level() -> dict[int, str]:
    """Byte-level spelling of the bytes of a word: printable ones as they are, others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


SPELLING = _byte_level()


def _plain_ids(tok, word: str, known: dict[str, bytes]) -> bytes | None:
    """Ids of a plain word straight from the tokenizer's model; None for any other word.

    ``known`` takes up the ids of the letters and of the marks.
    """
    m = PLAIN.fullmatch(word)
    if m is None:
        return None
    out = b""
    for x in (m[1].lower(), m[2]):
        ids = known.get(x)
        if ids is None:
            spelled = x if x.isascii() else x.encode().decode("latin1").translate(SPELLING)
            found = [t.id for t in tok.model.tokenize(spelled)]
            ids = known[x] = struct.pack(f"<{len(found)}I", *found)
        out += ids
    return out


def _tokenizer(path: str) -> tuple:
    """The tokenizer of a file and its word cache, once per Python worker."""
    if path not in _TOKENIZERS:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        mark = tok.encode(MARK, add_special_tokens=False).ids
        try:  # the short way is taken only where it gives what the whole tokenizer does
            short = all(_plain_ids(tok, w, {"": b""}) == np.array(tok.encode(w, add_special_tokens=False).ids, "<u4").tobytes() for w in PROBES)
        except Exception:
            short = False
        _TOKENIZERS[path] = (tok, mark[0] if len(mark) == 1 else None, {"": b""}, short)
    return _TOKENIZERS[path]


def _learn(words: list[str], path: str) -> None:
    """Cache the ids of unseen words as uint32 bytes; words that aren't plain are encoded in one string, parted by MARK."""
    tok, mark, cache, short = _tokenizer(path)
    if short:
        found = {w: _plain_ids(tok, w, cache) for w in words}
        words = [w for w, ids in found.items() if ids is None]
        cache.update((w, ids) for w, ids in found.items() if ids is not None)
    plain = [w for w in words if MARK not in w] if mark is not None else []
    alone = [w for w in words if MARK in w] if mark is not None else words
    for at in range(0, len(plain), 2000):
        part = plain[at:at + 2000]
        ids = np.array(tok.encode_batch_fast([f" {MARK} ".join(part)], add_special_tokens=False)[0].ids, "<u4")
        cuts = np.flatnonzero(ids == mark)
        if len(cuts) != len(part) - 1:  # a word's own ids hold the mark's
            alone += part
            continue
        for w, x in zip(part, np.split(ids, cuts)):
            cache[w] = x.tobytes() if w is part[0] else x[1:].tobytes()
    for w in alone:
        cache[w] = np.array(tok.encode(w, add_special_tokens=False).ids, "<u4").tobytes()


def encode_words(text: str, path: str) -> bytes:
    """Ids of a text as little-endian uint32; equal to encoding the whole text.

    The tokenizer never joins what stands on both sides of a blank or a line
    feed, so a text's ids are those of its chunks in order.
    """
    cache = _tokenizer(path)[2]
    words = text.replace("\n", " ").split(" ")
    try:
        return b"".join(map(cache.__getitem__, words))
    except KeyError:
        if len(cache) > CACHE_WORDS:
            cache.clear()
            cache[""] = b""
        for at in range(0, len(words), CACHE_WORDS):
            _learn([w for w in dict.fromkeys(words[at:at + CACHE_WORDS]) if w not in cache], path)
        return b"".join(map(cache.__getitem__, words))


def tokenize_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of at most ``capacity`` tokens: doc_id, piece, start, length, ids.

    ``ids`` are little-endian unsigned 32-bit ids. A null text counts as empty
    and is one piece holding ``end_id`` alone. Repeated rows and null doc_ids
    make pieces of their own; other columns are ignored.
    """
    out = pa.schema([("doc_id", docs.schema["doc_id"].dataType.simpleString() == "string" and pa.string() or pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])
    end = struct.pack("<I", end_id)
    step = capacity * 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for at in range(0, batch.num_rows, 64):
                rows: list[tuple] = []
                for key, text in zip(ids.slice(at, 64).to_pylist(), texts.slice(at, 64)):
                    data = encode_words(text.as_py() or "", tokenizer) + end
                    rows += [(key, i, i * capacity, len(data[i * step:(i + 1) * step]) // 4, data[i * step:(i + 1) * step]) for i in range(-(-len(data) // step))]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), out.types)], schema=out)

    kind = "string" if out.field(0).type == pa.string() else "bigint"
    return docs.select(F.col("doc_id").cast(kind), "text").mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids binary")


def plan_best_fit(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts: (length, first rank, ranks, first sequence, offset).

    Rank first + i of a length goes into sequence first + i at the offset. Open
    sequences are kept as runs with the same room; each step moves whole runs,
    so the work depends on the number of lengths, not of pieces.
    """
    plan: list[tuple[int, int, int, int, int]] = []
    rooms: list[int] = []  # sorted rooms left that some open sequence has
    runs: dict[int, list[tuple[int, int]]] = {}
    opened = 0
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                room, each = capacity, capacity // length
                first, n = opened, max(1, left // each)
                opened += n
            else:
                room = rooms[at]
                each = room // length
                first, n = runs[room].pop()
                if left < each * n and left >= each:
                    runs[room].append((first + left // each, n - left // each))
                    n = left // each
                elif left < each:
                    if n > 1:
                        runs[room].append((first + 1, n - 1))
                    n = 1
                if not runs[room]:
                    del runs[room], rooms[at]
            fill = min(each, left)
            for j in range(fill):
                plan.append((length, rank, n, first, capacity - room + j * length))
                rank += n
            left -= fill * n
            rest = room - fill * length
            if rest:
                if rest not in runs:
                    bisect.insort(rooms, rest)
                runs.setdefault(rest, []).append((first, n))
    return plan


def ranked(pieces: DataFrame, by: str, order: list[str]) -> DataFrame:
    """Adds ``rank`` from 0 within each value of ``by``, without a task per value.

    Rows of a value are dealt to groups by a hash of ``order``; groups are
    numbered inside and get the sum of the groups before them. ``order`` should
    tell rows apart; where it doesn't, equal rows take ranks in any order.
    """
    groups = max(16, pieces.count() // GROUP_ROWS)
    salted = pieces.withColumn("g", F.pmod(F.xxhash64(*order), F.lit(groups)))
    sizes = salted.groupBy(by, "g").agg(F.count("*").alias("n"))
    before = sizes.select(by, "g", (F.sum("n").over(Window.partitionBy(by).orderBy("g")) - F.col("n")).alias("before"))
    inside = salted.withColumn("r", F.row_number().over(Window.partitionBy(by, "g").orderBy(*order)) - 1)
    return inside.join(before, [by, "g"]).withColumn("rank", F.col("r") + F.col("before")).drop("g", "r", "before")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces with a ``length`` of 1 to ``capacity``.

    Places within a sequence are gapless from 0. Pieces of equal length take
    their slots by rank in (doc_id, piece) order within rank groups. An empty
    table gives an empty result. The plan holds a few rows per length and pair
    of lengths, whatever the number of pieces, and goes to tasks as arrays.
    """
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = plan_best_fit(histogram, capacity)
    lengths, firsts, _, seqs, offsets = (np.array(c, np.int64) for c in (zip(*plan) if plan else [[]] * 5))
    at = {int(n): (int(np.searchsorted(-lengths, -n, "left")), int(np.searchsorted(-lengths, -n, "right"))) for n in histogram}
    shared = spark.sparkContext.broadcast((at, firsts, seqs, offsets))

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def slot(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        at, firsts, seqs, offsets = shared.value
        n, r = length.to_numpy(), rank.to_numpy()
        found = np.zeros(len(n), np.int64)
        for value in np.unique(n):
            lo, hi = at[int(value)]
            own = n == value
            found[own] = lo + np.searchsorted(firsts[lo:hi], r[own], "right") - 1
        return pd.DataFrame({"sequence_id": seqs[found] + r - firsts[found], "offset": offsets[found]})

    columns = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    return ranked(pieces.select(columns), "length", ["doc_id", "piece"]).withColumn("slot", slot("length", "rank")).select(*columns, "slot.sequence_id", "slot.offset")


def packed_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Tokenise, cut and pack: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Token ids themselves are in ``tokenize_pieces``; (doc_id, piece) join both.
    """
    pieces = tokenize_pieces(docs, tokenizer, capacity, end_id)
    return pack(spill(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))), capacity)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op6_best_fit_packing": (op6_best_fit_packing, None)}
