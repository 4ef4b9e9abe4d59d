"""SentencePiece encoding and decoding, by merges or by a max-plus parallel scan.

Models of the BPE kind merge pairs by rank, and no sum of scores gives their
ids: the library itself encodes texts, and giant ones in chunks that end where
no piece can reach across. The rest holds for unigram models.

A text's segmentation is the path of pieces with the largest sum of scores. A
giant text is split into chunks. For a chunk, a matrix holds the best score
from every way the last piece of the chunk before may reach into it, to every
way its own last piece may reach out. Matrices combine associatively under
(max, +), first in blocks of chunks, then over blocks; with the best scores at
its borders known, each chunk is then traced back on its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thermograph.llm.common import spill, table
from thermograph.llm.keycount import small_batches

SPACE = "▁"
#: Characters of a chunk; texts up to that size are encoded at once.
CHUNK_CHARS = 16_384
#: Chunks whose matrices are multiplied in one task.
BLOCK_CHUNKS = 64
UNKNOWN_PENALTY = 10.0
CACHE_UNITS = 900_000
NONE = -np.inf

_MODELS: dict[str, Pieces] = {}


def is_bpe(proto: bytes) -> bool:
    """Whether a serialized model says so: trainer_spec (field 2), model_type (field 3) = 2."""
    def fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
        at = 0

        def number() -> int:
            nonlocal at
            out = shift = 0
            while True:
                x = b[at]
                at += 1
                out |= (x & 127) << shift
                shift += 7
                if x < 128:
                    return out

        while at < len(b):
            tag = number()
            if tag & 7 == 0:
                yield tag >> 3, number()
            else:
                n = {1: 8, 5: 4}.get(tag & 7) or number()
                yield tag >> 3, b[at:at + n]
                at += n

    return any(k == 3 and x == 2 for f, spec in fields(proto) if f == 2 for k, x in fields(spec))


class Pieces:
    """Pieces and scores of a model file, and the best segmentation by them."""

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.merges = is_bpe(sp.serialized_model_proto())
        every = range(sp.vocab_size())
        plain = [i for i in every if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
        self.ids = {sp.id_to_piece(i): i for i in plain}
        self.scores = {sp.id_to_piece(i): float(sp.get_score(i)) for i in plain}
        self.byte_ids = {int(sp.id_to_piece(i)[3:5], 16): i for i in every if sp.is_byte(i)}
        self.unknown_id = sp.unk_id()
        self.unknown = min(self.scores.values()) - UNKNOWN_PENALTY
        self.longest = max(map(len, self.ids))
        self.table = [b""] * sp.vocab_size()
        for p, i in self.ids.items():
            self.table[i] = p.replace(SPACE, " ").encode()
        for b, i in self.byte_ids.items():
            self.table[i] = bytes([b])
        # Where no piece can reach across, paths must stop: before a space mark after another character, and around a line feed.
        joined = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        feeds = any("\n" in p and len(p) > 1 for p in self.ids)
        self.units = None if joined else re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+" if feeds else f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")
        self.cache: dict[str, tuple[float, bytes]] = {}

    def merged(self, text: str, kind: type = int) -> list:
        """Ids (or pieces) by the library, of text that starts with a mark or with a line feed that is a unit."""
        plain = text.replace(SPACE, " ")
        if not plain.startswith(" "):
            return self.sp.encode(plain, out_type=kind)[1:] if plain else []
        # The library puts the first mark in front itself, but not in front of nothing.
        return self.sp.encode(plain[1:], out_type=kind) if len(plain) > 1 else [self.ids.get(SPACE, self.unknown_id) if kind is int else SPACE]

    def chunks(self, text: str, size: int) -> Iterator[str]:
        """Parts of at least ``size`` characters that no piece crosses and ``merged`` can encode alone."""
        at = 0
        for m in self.units.finditer(text) if self.units else ():
            if m.start() - at >= size and m[0][0] in f"{SPACE}\n":
                yield text[at:m.start()]
                at = m.start()
        yield text[at:]

    def best(self, text: str, entry: list[float], stop: int) -> tuple[list[float], list[int]]:
        """The model's own segmentation of a whole marked text where it merges, else as ``scan``."""
        if not (self.merges and entry == [0.0] and stop == len(text) and text.startswith(SPACE)):
            return self.scan(text, entry, stop)
        score, back, end, pending = [NONE] * (len(text) + 1), [-1] * (len(text) + 1), 0, b""
        score[0] = 0.0
        for piece in self.merged(text, str):
            if piece not in self.ids and self.byte_ids:
                pending += bytes([int(piece[3:5], 16)])
                if len(pending) < len(text[end].encode()):
                    continue
                piece, pending = text[end], b""
            start, end = end, end + len(piece)
            score[end], back[end] = score[start] + self.scores.get(piece, self.unknown), start
        return score, back

    def scan(self, text: str, entry: list[float], stop: int) -> tuple[list[float], list[int]]:
        """Best score at each place of ``text`` and where the last piece starts (-1: at entry).

        ``entry`` are scores of the first places; pieces start before ``stop``.
        Of equal scores the piece that starts first stays.
        """
        n, longest, scores = len(text), self.longest, self.scores
        score = [NONE] * (n + 1)
        score[:len(entry)] = entry[:n + 1]
        back = [-1] * (n + 1)
        for at in range(min(stop, n)):
            here = score[at]
            if here == NONE:
                continue
            for to in range(at + 1, min(at + longest, n) + 1):
                s = scores.get(text[at:to])
                if s is None:
                    if to > at + 1:
                        continue
                    s = self.unknown
                if here + s > score[to]:
                    score[to], back[to] = here + s, at
        return score, back

    def trace(self, text: str, back: list[int], end: int) -> tuple[int, bytes]:
        """Where the path to ``end`` entered, and its ids as uint32 bytes."""
        ids: list[int] = []
        while back[end] >= 0:
            piece = text[back[end]:end]
            i = self.ids.get(piece)
            if i is not None:
                ids.append(i)
            elif self.byte_ids:
                ids += [self.byte_ids[b] for b in reversed(piece.encode())]
            else:
                ids.append(self.unknown_id)
            end = back[end]
        return end, np.array(ids[::-1], "<u4").tobytes()

    def unit(self, text: str) -> tuple[float, bytes]:
        """Score and ids of a stretch between two places where all paths stop."""
        found = self.cache.get(text)
        if found is None:
            if len(self.cache) > CACHE_UNITS:
                self.cache.clear()
            score, back = self.best(text, [0.0], len(text))
            found = score[-1], self.trace(text, back, len(text))[1]
            if len(text) < 64:
                self.cache[text] = found
        return found

    def encode(self, text: str) -> bytes:
        if self.merges:
            return np.array(self.merged(text), "<u4").tobytes()
        if self.units is None:
            return self.unit(text)[1]
        cache = self.cache
        return b"".join([(cache.get(u) or self.unit(u))[1] for u in self.units.findall(text)])

    def cuts(self, body: str) -> tuple[int, int] | None:
        """First and last place of a chunk where all paths stop, both beyond what enters it."""
        starts = [m.start() for m in self.units.finditer(body)] if self.units else []
        inner = [s for s in starts if s >= self.longest]
        return (inner[0], inner[-1]) if inner else None

    def middle(self, body: str, first: int, last: int) -> tuple[float, bytes]:
        parts = [self.unit(u) for u in self.units.findall(body[first:last])]
        return sum(p[0] for p in parts), b"".join(p[1] for p in parts)

    def transfer(self, body: str, ahead: str) -> np.ndarray:
        """Max-plus matrix of a chunk: [characters entered with, characters left with]."""
        k, n = self.longest, len(body)
        cut = self.cuts(body)
        out = np.full((k, k), NONE)
        whole = body + ahead
        if cut is None:
            for i in range(min(k, n + 1)):
                score, _ = self.scan(whole, [NONE] * i + [0.0], n)
                out[i, :len(score) - n] = score[n:n + k]
            return out
        first, last = cut
        score, _ = self.scan(whole[last:], [0.0], n - last)
        leave = np.full(k, NONE)
        leave[:len(score) - (n - last)] = score[n - last:n - last + k]
        enter = np.array([self.scan(body[:first], [NONE] * i + [0.0], first)[0][first] for i in range(k)])
        return enter[:, None] + self.middle(body, first, last)[0] + leave[None, :]

    def entries(self, body: str, ahead: str, entry: list[float]) -> list[int]:
        """For each way out of a chunk, the way in of its best path (-1: none)."""
        cut = self.cuts(body)
        if cut is None:
            whole = body + ahead
            score, back = self.scan(whole, entry, len(body))
            return [self.trace(whole, back, len(body) + j)[0] if len(body) + j <= len(whole) and score[len(body) + j] > NONE else -1 for j in range(self.longest)]
        _, back = self.scan(body[:cut[0]], entry, cut[0])
        return [self.trace(body[:cut[0]], back, cut[0])[0]] * self.longest

    def path(self, body: str, ahead: str, entry: list[float], leave: int) -> bytes:
        """Ids of the pieces that start in a chunk on the best path that leaves it by ``leave`` characters."""
        cut = self.cuts(body)
        whole = body + ahead
        if cut is None:
            return self.trace(whole, self.scan(whole, entry, len(body))[1], len(body) + leave)[1]
        first, last = cut
        head = self.trace(body[:first], self.scan(body[:first], entry, first)[1], first)[1]
        tail = self.trace(whole[last:], self.scan(whole[last:], [0.0], len(body) - last)[1], len(body) - last + leave)[1]
        return head + self.middle(body, first, last)[1] + tail

    def decode(self, ids: bytes) -> str:
        text = b"".join(map(self.table.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def model_of(path: str) -> Pieces:
    """The model of a file, once per Python worker."""
    if path not in _MODELS:
        _MODELS[path] = Pieces(path)
    return _MODELS[path]


def marked(text: str | None) -> str:
    """The text as pieces spell it: spaces as marks, and one in front unless it is empty."""
    return SPACE + text.replace(" ", SPACE) if text else ""


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of two max-plus matrices."""
    return (a[:, :, None] + b[None, :, :]).max(1)


def encode_documents(docs: DataFrame, model: str, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """doc_id and ``ids`` (little-endian uint32 bytes) of every row.

    Pieces and scores are those of the SentencePiece file ``model``; a BPE model
    merges as its library does, else the path with the largest sum is taken. Unknown characters become byte pieces where
    the model has them. Null and empty texts have no ids. Repeated rows and null
    doc_ids are encoded each; other columns are ignored. A text is bounded by
    what one row may hold, not by the memory of a segmentation.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    size = F.char_length(F.coalesce("text", F.lit("")))

    @F.pandas_udf("binary")
    def whole(texts: pd.Series) -> pd.Series:
        m = model_of(model)
        return pd.Series([m.encode(marked(t)) for t in texts], dtype=object)

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            m = model_of(model)
            step = max(chunk_chars, m.longest)
            for uid, key, text in zip(df["uid"], df["doc_id"], df["text"]):
                t = marked(text)
                for k, at in enumerate(range(0, len(t), step)):
                    yield pd.DataFrame({"uid": [uid], "doc_id": pd.Series([key], dtype=object), "k": [k], "n": [-(-len(t) // step)], "body": [t[at:at + step]], "ahead": [t[at + step:at + step + m.longest - 1]]})

    docs = small_batches(docs.select("doc_id", "text"))
    short = docs.filter(size <= chunk_chars).select("doc_id", whole("text").alias("ids"))
    giant = docs.filter(size > chunk_chars).select(F.expr("uuid()").alias("uid"), F.col("doc_id").cast("string"), "text")
    if model_of(model).merges:
        def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for df in batches:
                for uid, key, text in zip(df["uid"], df["doc_id"], df["text"]):
                    for k, body in enumerate(model_of(model).chunks(marked(text), chunk_chars)):
                        yield pd.DataFrame({"uid": [uid], "doc_id": pd.Series([key], dtype=object), "k": [k], "body": [body]})

        def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for df in batches:
                yield df[["uid", "doc_id", "k"]].assign(ids=[model_of(model).encode(b) for b in df["body"]])

        parts = spill(giant.mapInPandas(cut, "uid string, doc_id string, k int, body string")).repartition("uid", "k")
        return short.unionByName(_in_order(parts.mapInPandas(merge, "uid string, doc_id string, k int, ids binary"), kind))
    chunks = spill(giant.mapInPandas(split, "uid string, doc_id string, k int, n int, body string, ahead string"))

    def matrix(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            m = model_of(model)
            yield pd.DataFrame({"uid": df["uid"], "k": df["k"], "block": df["k"] // BLOCK_CHUNKS, "m": [m.transfer(b, a).tobytes() for b, a in zip(df["body"], df["ahead"])]})

    def square(data: bytes) -> np.ndarray:
        a = np.frombuffer(data)
        return a.reshape(int(len(a) ** 0.5), -1)

    def product(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("k")
        out = square(df["m"].iloc[0])
        for x in df["m"].iloc[1:]:
            out = times(out, square(x))
        return pd.DataFrame({"uid": [df["uid"].iloc[0]], "block": [df["block"].iloc[0]], "m": [out.tobytes()]})

    def starts(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("block")
        at, out = None, []
        for x in df["m"]:
            x = square(x)
            at = np.where(np.arange(len(x)) == 0, 0.0, NONE) if at is None else at
            out.append(at.tobytes())
            at = (at[:, None] + x).max(0)
        return pd.DataFrame({"uid": df["uid"], "block": df["block"], "v": out})

    def inside(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        df, at, out = left.sort_values("k"), np.frombuffer(right["v"].iloc[0]), []
        for x in df["m"]:
            out.append(at.tobytes())
            at = (at[:, None] + square(x)).max(0)
        return pd.DataFrame({"uid": df["uid"], "k": df["k"], "entry": out})

    matrices = spill(chunks.select("uid", "k", "body", "ahead").mapInPandas(matrix, "uid string, k int, block int, m binary"))
    first = matrices.groupBy("uid", "block").applyInPandas(product, "uid string, block int, m binary").groupBy("uid").applyInPandas(starts, "uid string, block int, v binary")
    entries = spill(matrices.groupBy("uid", "block").cogroup(first.groupBy("uid", "block")).applyInPandas(inside, "uid string, k int, entry binary"))

    def ways(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            m = model_of(model)
            yield df[["uid", "k"]].assign(ways=[m.entries(b, a, np.frombuffer(e).tolist()) for b, a, e in zip(df["body"], df["ahead"], df["entry"])])

    def back(df: pd.DataFrame) -> pd.DataFrame:
        df, leave, out = df.sort_values("k", ascending=False), 0, []
        for w in df["ways"]:
            out.append(leave)
            leave = int(w[leave])
        return pd.DataFrame({"uid": df["uid"], "k": df["k"], "leave": out})

    def paths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            m = model_of(model)
            yield df[["uid", "doc_id", "k"]].assign(ids=[m.path(b, a, np.frombuffer(e).tolist(), x) for b, a, e, x in zip(df["body"], df["ahead"], df["entry"], df["leave"])])

    begun = chunks.join(entries.hint("merge"), ["uid", "k"])
    leaves = spill(begun.select("uid", "k", "body", "ahead", "entry").mapInPandas(ways, "uid string, k int, ways array<int>").groupBy("uid").applyInPandas(back, "uid string, k int, leave int"))
    traced = begun.join(leaves.hint("merge"), ["uid", "k"]).select("uid", "doc_id", "k", "body", "ahead", "entry", "leave").mapInPandas(paths, "uid string, doc_id string, k int, ids binary")
    return short.unionByName(_in_order(traced, kind))


def _in_order(parts: DataFrame, kind: str) -> DataFrame:
    """doc_id and ids of texts from those of their chunks."""
    joined = parts.groupBy("uid").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("k", "ids"))).alias("parts"))
    return joined.select(F.col("doc_id").cast(kind), F.expr("aggregate(parts, CAST('' AS BINARY), (a, x) -> concat(a, x.ids))").alias("ids"))


def decode_documents(encoded: DataFrame, model: str) -> DataFrame:
    """The columns of ``encoded`` and the ``text`` of its ``ids``; null ids give null."""
    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        m = model_of(model)
        return ids.map(lambda x: None if x is None else m.decode(x))

    return small_batches(encoded).withColumn("text", text("ids"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    encoded = encode_documents(table(spark, sf_dir, "documents"), model)
    return decode_documents(encoded, model).select("doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_ids"), F.crc32("ids").alias("ids_crc32"), F.md5(F.col("text").cast("binary")).alias("decoded_md5"))


QUERIES = {"op3_sentencepiece": (op3_sentencepiece, None)}
