"""Language-model scores by deleted interpolation.

Word bigram, unigram and uniform estimates are mixed with weights that depend
on how often the context was seen. The weights are learned by expectation-
maximisation on held-out counts: a part of the learning texts, chosen by their
content so that copies stay together, is predicted from the counts of the rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from thermograph.llm.common import held_out, spill, table
from thermograph.llm.keycount import CHUNK_BYTES, blocks, bucket_count, expand, in_order, key_totals, mix, new_chunk, small_batches, squeeze, text_bytes

#: Outside of all words, which hold no white space.
END, START = b" end", b" start"
#: Steps per factor of two, to which ratios of estimates are rounded for EM only.
GRID = 4
ROUNDS = 60
#: One part in so many of the learning texts is held out to learn the weights.
PARTS = 8
LEAST = 1e-6


def _pairs(words: np.ndarray, stream: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bigram key of every token, and its context's place in ``words`` (-1: start of a text)."""
    context = np.concatenate(([-1], stream[:-1])).astype(np.int64)
    starts = np.cumsum(lengths) - lengths
    context[starts] = -1
    left = np.where(context < 0, np.uint64(xxhash.xxh64_intdigest(START)), words[context])
    return mix(left * np.uint64(0x9E3779B97F4A7C15) + words[stream]), context


def token_chunks(docs: DataFrame, learn: str) -> DataFrame:
    """Chunks of whole documents as sorted word hashes and token streams."""
    schema = "chunk bigint, doc_ids array<string>, learn binary, apart binary, lengths binary, words binary, stream binary"

    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        learns: list[bool] = []
        aparts: list[bool] = []
        tokens: list[list[bytes]] = []
        held = 0

        def close() -> pa.RecordBatch:
            places: dict[bytes, int] = {}
            stream = np.array([places.setdefault(w, len(places)) for doc in tokens for w in doc], np.int64)
            lengths = np.array([len(d) for d in tokens], np.int64)
            hashes = np.array([xxhash.xxh64_intdigest(w) for w in places], np.uint64)
            words, rank = np.unique(hashes, return_inverse=True)
            row = {"chunk": new_chunk(), "doc_ids": ids, "learn": squeeze(np.array(learns, np.uint8)), "apart": squeeze(np.array(aparts, np.uint8)), "lengths": squeeze(lengths), "words": squeeze(np.diff(words, prepend=np.uint64(0))),
                   "stream": squeeze(rank[stream].astype(np.uint32))}
            return pa.RecordBatch.from_pylist([row], schema=out)

        for batch in batches:
            for key, text, train, apart in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                data = (text.as_py() or "").encode()
                ids.append(key)
                learns.append(train)
                aparts.append(train and apart)
                tokens.append([*data.lower().split(), END])
                held += len(data) + 8
                if held >= CHUNK_BYTES:
                    yield close()
                    ids, learns, aparts, tokens, held = [], [], [], [], 0
        if ids:
            yield close()

    return small_batches(docs).select(F.col("doc_id").cast("string"), "text", F.expr(learn).alias("learn"), (F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(PARTS)) == 0).alias("apart")).mapInArrow(run, schema)


def _apart(row, stream: np.ndarray, lengths: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of held-out texts, and the numbers of the words and pairs among them."""
    apart = np.repeat(expand(row.apart, np.uint8), lengths) > 0
    return apart, np.unique(stream[apart]), np.unique(which[apart])


def _blocks(chunks: DataFrame, buckets: int) -> DataFrame:
    """Key blocks of every chunk: words, pairs (buckets from ``buckets`` on), and the same of held-out texts alone (from twice and three times)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for row in df.itertuples():
                words = np.cumsum(expand(row.words, np.uint64), dtype=np.uint64)
                stream, lengths = expand(row.stream, np.uint32).astype(np.int64), expand(row.lengths)
                train = np.repeat(expand(row.learn, np.uint8), lengths)
                pairs, which = np.unique(_pairs(words, stream, lengths)[0], return_inverse=True)
                apart, own_words, own_pairs = _apart(row, stream, lengths, which)
                parts = [(words, np.bincount(stream, train, len(words))), (pairs, np.bincount(which, train, len(pairs))),
                         (words[own_words], np.bincount(stream[apart], minlength=len(words))[own_words]), (pairs[own_pairs], np.bincount(which[apart], minlength=len(pairs))[own_pairs])]
                out = [pd.DataFrame(blocks(keys, n, buckets), columns=["bucket", "keys", "counts", "checks"]).assign(bucket=lambda x, i=i: x["bucket"] + i * buckets) for i, (keys, n) in enumerate(parts) if len(keys)]
                yield pd.concat(out).assign(chunk=row.chunk, bucket=lambda x: x["bucket"].astype(np.int32))[["chunk", "bucket", "keys", "counts", "checks"]]

    return chunks.select("chunk", "words", "stream", "lengths", "learn", "apart").mapInPandas(run, "chunk bigint, bucket int, keys binary, counts binary, checks binary")


def _per_chunk(chunks: DataFrame, totals: DataFrame, buckets: int, f, schema: str) -> DataFrame:
    """``f`` of every chunk's row and its tokens' counts: of the word, of the pair, of the context, less those of held-out texts where ``f`` says so."""
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        row = left.iloc[0]
        words = np.cumsum(expand(row["words"], np.uint64), dtype=np.uint64)
        word, pair, word_apart, pair_apart = (in_order(right[right["bucket"] // buckets == i]) for i in range(4))
        stream, lengths = expand(row["stream"], np.uint32).astype(np.int64), expand(row["lengths"])
        key, context = _pairs(words, stream, lengths)
        _, which = np.unique(key, return_inverse=True)
        if f.held_out:
            apart, own_words, own_pairs = _apart(row, stream, lengths, which)
            word, pair = word.copy(), pair.copy()
            word[own_words] -= word_apart
            pair[own_pairs] -= pair_apart
        ends = np.searchsorted(words, np.uint64(xxhash.xxh64_intdigest(END)))
        cv = np.where(context < 0, word[ends], word[context])  # as many starts as ends
        c, cvw = word[stream], pair[which]
        return f(row, *((x[apart] for x in (c, cvw, cv)) if f.held_out else (c, cvw, cv)), lengths)

    return chunks.select("chunk", "doc_ids", "learn", "apart", "lengths", "words", "stream").groupBy("chunk").cogroup(totals.groupBy("chunk")).applyInPandas(run, schema)


def context_bucket(count: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else 1 + the whole part of log2 of its count."""
    return np.where(count > 0, 1 + np.floor(np.log2(np.maximum(count, 1))), 0).astype(np.int64)


def learn_weights(bucket: np.ndarray, ratio2: np.ndarray, ratio1: np.ndarray, n: np.ndarray) -> np.ndarray:
    """EM of the weights (bigram, unigram, uniform) of every context bucket.

    Ratios are the estimates over the uniform one. A bucket without counts
    takes the weights learned over all; without any count all are equal.
    """
    def em(r2: np.ndarray, r1: np.ndarray, n: np.ndarray) -> np.ndarray:
        w = np.full(3, 1 / 3)
        for _ in range(ROUNDS):
            parts = np.stack([w[0] * r2, w[1] * r1, np.full(len(r1), w[2])])
            w = (parts / parts.sum(0) * n).sum(1) / n.sum()
            w = np.maximum(w, LEAST) / np.maximum(w, LEAST).sum()
        return w

    whole = em(ratio2, ratio1, n) if len(n) else np.full(3, 1 / 3)
    out = np.tile(whole, (66, 1))
    for b in np.unique(bucket):
        own = bucket == b
        out[b] = em(ratio2[own], ratio1[own], n[own])
    rest = out[0, 1:] / out[0, 1:].sum()  # an unseen context has no bigram estimate
    out[0] = [0.0, *rest]
    return out


def score_documents(docs: DataFrame, learn: str = "true") -> DataFrame:
    """Scores of every row by the model of the rows for which the SQL condition ``learn`` holds.

    Result: doc_id, learned, n_tokens, n_known, train_tokens, base_score, score
    (log10 probabilities). A token is a word, A-Z in lower case, or the end of a
    text. Null texts count as empty: their one token is the end. Repeated rows
    are counted and scored each; a null condition does not learn; without any
    training token both scores are 0. Words and pairs are told apart by 64-bit
    hashes. Other columns are ignored.
    """
    buckets = bucket_count(text_bytes(docs) // 8)
    chunks = spill(token_chunks(docs, f"coalesce({learn}, false)"))
    totals = spill(key_totals(_blocks(chunks, buckets)))
    n_types, n_train = totals.filter(F.col("bucket") < buckets).agg(F.coalesce(F.sum("n_keys"), F.lit(0)), F.coalesce(F.sum("n_total"), F.lit(0))).first()
    n_rest = n_train - (totals.filter(F.floor(F.col("bucket") / buckets) == 2).agg(F.sum("n_total")).first()[0] or 0)
    uniform = 1.0 / (n_types + 1)
    values = totals.select("chunk", "bucket", "totals")

    def held(row, c, cvw, cv, lengths):
        with np.errstate(divide="ignore"):
            q2 = np.where(cvw > 0, np.round(GRID * np.log2(cvw / np.maximum(cv, 1) / uniform)), -9999).astype(np.int64)
            q1 = np.where(c > 0, np.round(GRID * np.log2(c / max(n_rest, 1) / uniform)), -9999).astype(np.int64)
        code, n = np.unique(np.stack([context_bucket(cv), q2, q1]), axis=1, return_counts=True) if len(c) else (np.zeros((3, 0), np.int64), np.zeros(0, np.int64))
        return pd.DataFrame({"b": code[0], "q2": code[1], "q1": code[2], "n": n})

    held.held_out = True
    grid = spill(_per_chunk(chunks, values, buckets, held, "b bigint, q2 bigint, q1 bigint, n bigint").groupBy("b", "q2", "q1").agg(F.sum("n").alias("n"))).toPandas().sort_values(["b", "q2", "q1"])
    ratio = lambda q: np.where(q == -9999, 0.0, np.exp2(q / GRID))
    weights = learn_weights(*(grid[c].to_numpy() if c in "bn" else ratio(grid[c].to_numpy()) for c in ("b", "q2", "q1", "n")))
    weights[:, 2] = np.where(n_train, weights[:, 2], 1.0)

    def score(row, c, cvw, cv, lengths):
        w = weights[context_bucket(cv)]
        p = w[:, 0] * cvw / np.maximum(cv, 1) + w[:, 1] * c / max(n_train, 1) + w[:, 2] * uniform
        base = np.log10((c + 1) / (n_train + n_types + 1))
        starts = np.cumsum(lengths) - lengths
        return pd.DataFrame({"doc_id": pd.Series(list(row["doc_ids"]), dtype=object), "learned": expand(row["learn"], np.uint8) > 0, "n_tokens": lengths, "n_known": np.add.reduceat((c > 0).astype(np.int64), starts),
                             "train_tokens": n_train, "base_score": np.add.reduceat(base, starts), "score": np.add.reduceat(np.log10(p), starts)})

    score.held_out = False
    kind = docs.schema["doc_id"].dataType.simpleString()
    return _per_chunk(chunks, values, buckets, score, "doc_id string, learned boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double").withColumn("doc_id", F.col("doc_id").cast(kind))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (~held_out("doc_id", 7, 2)).alias("learn"))
    return score_documents(docs, "learn").select("doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op9_lm_scoring": (op9_lm_scoring, None)}
