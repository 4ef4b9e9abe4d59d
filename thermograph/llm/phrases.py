"""Phrase collocations from mergeable Misra-Gries summaries.

Tasks count the phrases of a chunk of texts and send hashes of them to hash
partitions. There the counts of all chunks are merged into one summary, whose
capacity exceeds the partition's mass divided by the threshold, so that every
frequent phrase survives. Survivors return to the chunks that hold them, and a
second pass counts them exactly, as text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.ipc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from thermograph.llm.common import discard, spill, spill_kinds, table
from thermograph.llm.keycount import CHUNK_BYTES, blocks, expand, mix, new_chunk, small_batches, squeeze, text_bytes

LEAST_COUNT, LONGEST, TOP = 30, 4, 2000
#: A phrase goes if a longer one around it occurs at least NUMERATOR / DENOMINATOR as often.
NUMERATOR, DENOMINATOR = 4, 5
SCORE_SCALE = 2_000_000
UNKNOWN = "und"
#: Keys of a hash partition on average, and keys that a merge adds at once; both bound a task's memory.
PARTITION_KEYS, MERGE_KEYS = 1_500_000, 2_000_000
#: Bytes of text to a hash partition of the second pass.
EXACT_BYTES = 24_000_000
#: Candidates that share one word are dealt to so many tasks.
SALTS = 16

ENDS = b".,;:!?\n\x0b\x0c\r"
BLANKS = b" \t"
KIND = np.zeros(256, np.uint8)
KIND[list(BLANKS)] = 1
KIND[list(ENDS)] = 2
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def counted(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(len(keys), 1), bool), keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(n, first) if len(first) else n


class Phrases:
    """Distinct phrases of the texts of a chunk, by number of words, with counts. All of it is exact."""

    def __init__(self, langs: list[str], texts: list[str], longest: int = LONGEST) -> None:
        data = [t.encode() for t in texts]
        until = np.cumsum([len(d) + 1 for d in data])
        data = b"\n".join(data)
        buf = np.frombuffer(data, np.uint8)
        kind = KIND[buf]
        steps = np.diff((kind == 0).view(np.int8), prepend=0, append=0)
        starts, ends = np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)
        del steps
        piece = np.searchsorted(np.flatnonzero(kind == 2), starts).astype(np.int32)
        self.langs, of = np.unique(np.array(langs, object), return_inverse=True)
        lang = of[np.searchsorted(until, starts, "right")] if len(starts) else np.zeros(0, np.int64)
        letters = LOWER[buf[kind == 0]]
        del kind, buf, data
        offsets = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int64)
        del starts, ends
        found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(letters)]).dictionary_encode()
        self.words: list[bytes] = found.dictionary.to_pylist()
        word = found.indices.to_numpy().astype(np.int64)
        del found, letters, offsets
        self.sizes = np.bincount(lang, minlength=len(self.langs))
        self.base = max(len(self.words), 1)
        #: Codes of distinct phrases by number of words; ``whole`` turns them into words.
        self.codes: dict[int, np.ndarray] = {}
        self.counts: dict[int, np.ndarray] = {}
        one = lang * self.base + word
        self.codes[1], self.counts[1] = np.unique(one, return_counts=True)
        apart = lambda n: np.flatnonzero(piece[n - 1:] == piece[:len(piece) - n + 1])
        at = apart(2)
        self.codes[2], which, self.counts[2] = np.unique(one[at] * self.base + word[at + 1], return_inverse=True, return_counts=True)
        pair = np.full(len(one), -1)
        pair[at] = which
        pairs = max(len(self.codes[2]), 1)
        if longest >= 3:
            at = apart(3)
            self.codes[3], self.counts[3] = np.unique(pair[at] * self.base + word[at + 2], return_counts=True)
        if longest >= 4:
            at = apart(4)
            self.codes[4], self.counts[4] = np.unique(pair[at] * pairs + pair[at + 2], return_counts=True)
        self.pairs = pairs

    def keys(self) -> dict[int, np.ndarray]:
        """A 64-bit hash of every distinct phrase, the same in all chunks."""
        factor = np.uint64(0x9E3779B97F4A7C15)
        names = np.array([xxhash.xxh64_intdigest(w) for w in self.words], np.uint64)
        homes = np.array([xxhash.xxh64_intdigest(x.encode(), 7) for x in self.langs], np.uint64)
        out = {1: mix(homes[self.codes[1] // self.base] * factor + names[self.codes[1] % self.base])}
        first = np.searchsorted(self.codes[1], self.codes[2] // self.base)
        out[2] = mix(out[1][first] * factor + names[self.codes[2] % self.base])
        if 3 in self.codes:
            out[3] = mix(out[2][self.codes[3] // self.base] * factor + names[self.codes[3] % self.base])
        if 4 in self.codes:
            out[4] = mix(mix(out[2][self.codes[4] // self.pairs] * factor) + out[2][self.codes[4] % self.pairs])
        return out

    def openings(self, keys: dict[int, np.ndarray], n: int, which: np.ndarray) -> np.ndarray:
        """Of some distinct phrases of n words, the hash of their first two words (of one, where n is 1)."""
        if n < 3:
            return keys[n][which]
        return keys[2][self.codes[n][which] // (self.base if n == 3 else self.pairs)]

    def parts(self, n: int, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of some distinct phrases of n words, the number of their language and those of their words, -1 after the last."""
        code = self.codes[n][which]
        tail: list[np.ndarray] = []
        if n == 4:
            rest = self.codes[2][code % self.pairs]
            tail = [rest // self.base % self.base, rest % self.base]
            code = self.codes[2][code // self.pairs]
        elif n == 3:
            tail = [code % self.base]
            code = self.codes[2][code // self.base]
        if n >= 2:
            tail = [code % self.base, *tail]
            code = code // self.base
        none = [np.full(len(which), -1)] * (LONGEST - n)
        return code // self.base, np.column_stack([code % self.base, *tail, *none])


def _cut(text: str, size: int) -> Iterator[str]:
    """Parts of a long text between piece ends, each of about ``size`` bytes or one longer piece."""
    data = text.encode()
    at = 0
    while len(data) - at > size:
        ends = np.flatnonzero(KIND[np.frombuffer(data, np.uint8, size, at)] == 2)
        if len(ends):
            to = at + int(ends[-1]) + 1
        else:
            to, step = len(data), at + size
            while step < len(data):
                more = np.flatnonzero(KIND[np.frombuffer(data, np.uint8, min(size, len(data) - step), step)] == 2)
                if len(more):
                    to = step + int(more[0]) + 1
                    break
                step += size
        yield data[at:to].decode()
        at = to
    yield data[at:].decode()


def phrase_chunks(docs: DataFrame, partitions: int, bits: int, longest: int = LONGEST) -> DataFrame:
    """Chunks of (lang, text), as rows of kind ``text``, and the hashed counts of their phrases by hash partition, of kind ``block``."""
    schema = "kind string, chunk bigint, texts binary, bucket int, keys binary, counts binary, mass bigint"
    out = to_arrow_schema(StructType.fromDDL(schema))
    mask = np.uint64(((1 << bits) - 1) << (64 - bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs: list[str] = []
        texts: list[str] = []
        held = 0

        def close() -> pa.RecordBatch:
            own = Phrases(langs, texts, longest)
            keys = own.keys()
            rows = []
            # A quarter of the hashes at a time, which bounds the copies that sorting makes.
            for quarter in range(4):
                at = {n: np.flatnonzero(k >> np.uint64(62) == quarter) for n, k in keys.items()}
                some = counted(np.concatenate([keys[n][at[n]] for n in at]) & mask, np.concatenate([own.counts[n][at[n]].astype(np.uint32) for n in at]))
                rows += blocks(*some, partitions) if len(some[0]) else []
            pa.default_memory_pool().release_unused()
            chunk = new_chunk()
            for row in rows:
                row |= {"kind": "block", "chunk": chunk, "mass": int(expand(row["counts"], np.uint32).sum(dtype=np.int64))}
            return pa.RecordBatch.from_pylist([{"kind": "text", "chunk": chunk, "texts": _pack(pa.table({"lang": pa.array(langs, pa.string()), "text": pa.array(texts, pa.string())}))}, *rows], schema=out)

        for batch in batches:
            for lang, whole in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for text in _cut(whole, CHUNK_BYTES):
                    langs.append(lang)
                    texts.append(text)
                    held += len(text) + 8
                    if held >= CHUNK_BYTES:
                        yield close()
                        langs, texts, held = [], [], 0
        if texts:
            yield close()

    return small_batches(docs).mapInArrow(run, schema)


class Summary:
    """A Misra-Gries summary: at most ``capacity`` counters, each too low by ``error`` at most."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.error = capacity, 0
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def merge(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Adds counters; where they are too many, all lose the largest count that doesn't fit.

        That takes as much from capacity + 1 counters at least, so error times
        (capacity + 1) never exceeds the mass added.
        """
        keys, counts = counted(np.concatenate((self.keys, keys)), np.concatenate((self.counts, counts)))
        if len(keys) > self.capacity:
            loss = int(np.partition(counts, len(counts) - self.capacity - 1)[len(counts) - self.capacity - 1])
            self.error += loss
            kept = counts > loss
            keys, counts = keys[kept], counts[kept] - loss
        self.keys, self.counts = keys, counts

    def at_least(self, count: int) -> np.ndarray:
        """Sorted keys that may occur ``count`` times; with a capacity over mass / count - 1 all that do are among them."""
        return self.keys[self.counts + self.error >= count]


def survivors(rows: DataFrame, least: int = LEAST_COUNT) -> DataFrame:
    """chunk, keys: of every chunk, the hashes of its phrases that survive the summary of their partition."""
    def run(df: pd.DataFrame) -> pd.DataFrame:
        summary = Summary(int(df["mass"].sum()) // least + 1)
        keys: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        held = 0
        own = lambda data: np.cumsum(expand(data, np.uint64), dtype=np.uint64)
        for k, c in zip(df["keys"], df["counts"]):
            keys.append(own(k))
            counts.append(expand(c, np.uint32).astype(np.int64))
            held += len(keys[-1])
            if held >= MERGE_KEYS:
                summary.merge(np.concatenate(keys), np.concatenate(counts))
                keys, counts, held = [], [], 0
        if keys:
            summary.merge(np.concatenate(keys), np.concatenate(counts))
        found = summary.at_least(least)
        back = []
        for k in df["keys"]:
            mine = own(k)
            at = np.searchsorted(found, mine)
            hit = mine[found[np.minimum(at, len(found) - 1)] == mine] if len(found) else mine[:0]
            back.append(squeeze(np.diff(hit, prepend=np.uint64(0))) if len(hit) else None)
        return pd.DataFrame({"chunk": df["chunk"], "keys": pd.Series(back, dtype=object)}).dropna()

    return rows.groupBy("bucket").applyInPandas(run, "chunk bigint, keys binary")


def frequent_phrases(docs: DataFrame, least: int = LEAST_COUNT, longest: int = LONGEST) -> DataFrame:
    """lang, phrase, words, n: all phrases of up to ``longest`` (2 to 4) words that occur ``least`` times in a language.

    One more row a language, without a phrase, has words 0 and the number of all
    word occurrences. Input: (lang, text) without nulls.
    """
    size = text_bytes(docs)
    bits = min(64, max(24, math.ceil(math.log2(size + 2)) + 2))
    chunks = spill_kinds(phrase_chunks(docs, max(8, size * longest // 6 // PARTITION_KEYS), bits, longest), {"text": ["chunk", "texts"], "block": ["chunk", "bucket", "keys", "counts", "mass"]})
    kept = spill(survivors(chunks["block"], least))
    discard(chunks["block"])
    buckets = max(8, size // EXACT_BYTES)
    mask = np.uint64(((1 << bits) - 1) << (64 - bits))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        texts = pa.ipc.open_stream(left["texts"].iloc[0]).read_all()
        own = Phrases(texts["lang"].to_pylist(), texts["text"].to_pylist(), longest)
        found = np.sort(np.concatenate([np.zeros(0, np.uint64), *(np.cumsum(expand(k, np.uint64), dtype=np.uint64) for k in right["keys"])]))
        parts = [pa.table({"lang": own.langs, "phrase": pa.nulls(len(own.langs), pa.string()), "words": np.zeros(len(own.langs), np.int32), "n": own.sizes, "bucket": np.arange(len(own.langs)) % buckets})]
        rows = []
        every = own.keys()
        for words, keys in every.items():
            short = keys & mask
            hit = np.flatnonzero(found[np.minimum(np.searchsorted(found, short), len(found) - 1)] == short) if len(found) else np.zeros(0, np.int64)
            lang, which = own.parts(words, hit)
            rows.append(np.column_stack(((own.openings(every, words, hit) % np.uint64(buckets)).astype(np.int64), lang, which, own.counts[words][hit])))
        # A language's words count as a phrase of none.
        rows.append(np.column_stack((np.arange(len(own.langs)) % buckets, np.arange(len(own.langs)), np.full((len(own.langs), LONGEST), -1), own.sizes)))
        table = np.concatenate(rows)
        table = table[np.lexsort(table[:, :-1].T[::-1])]
        cuts = np.flatnonzero(np.diff(table[:, 0], prepend=-1))
        return pd.DataFrame([_block(part, own) for part in np.split(table, cuts[1:])] if len(table) else [], columns=["bucket", "langs", "words", "rows"])

    def total(df: pd.DataFrame) -> pd.DataFrame:
        blocks = [(x.langs, zstandard.decompress(x.words).decode().split("\n"), expand(x.rows).reshape(LONGEST + 2, -1)) for x in df.itertuples()]
        langs, of_lang = np.unique(np.concatenate([np.array(b[0], object) for b in blocks]), return_inverse=True)
        of_word, words = pd.factorize(np.concatenate([np.array(b[1], object) for b in blocks]))
        at_lang = np.cumsum([0] + [len(b[0]) for b in blocks])
        at_word = np.cumsum([0] + [len(b[1]) for b in blocks])
        rows = np.concatenate([np.vstack((of_lang[at_lang[i] + b[2][0]], np.where(b[2][1:-1] < 0, -1, of_word[at_word[i] + np.maximum(b[2][1:-1], 0)]), b[2][-1:])) for i, b in enumerate(blocks)], axis=1)
        order = np.lexsort(rows[:-1])
        rows = rows[:, order]
        first = np.flatnonzero(np.concatenate(([True], (rows[:-1, 1:] != rows[:-1, :-1]).any(0))))
        sums, rows = np.add.reduceat(rows[-1], first), rows[:, first]
        n_words = (rows[1:-1] >= 0).sum(0)
        keep = np.flatnonzero((sums >= least) | (n_words == 0))
        texts = [" ".join(words[k] for k in own if k >= 0) for own in rows[1:-1, keep].T.tolist()]
        return pd.DataFrame({"lang": langs[rows[0, keep]], "phrase": texts, "words": n_words[keep].astype(np.int32), "n": sums[keep]})

    packed = chunks["text"].groupBy("chunk").cogroup(kept.groupBy("chunk")).applyInPandas(run, "bucket int, langs array<string>, words binary, rows binary")
    out = spill(packed.groupBy("bucket").applyInPandas(total, "lang string, phrase string, words int, n bigint"))
    discard(kept)
    discard(chunks["text"])
    # Words are counted by chunk in several partitions; phrases have one each.
    sizes = out.filter("words = 0").groupBy("lang").agg(F.sum("n").alias("n")).select("lang", F.lit(None).cast("string").alias("phrase"), F.lit(0).alias("words"), "n")
    return out.filter("words > 0").unionByName(sizes)


def _block(rows: np.ndarray, own: Phrases) -> tuple[int, list[str], bytes, bytes]:
    """Sorted rows of one bucket (bucket, language, words, count), with the words and languages they name."""
    words, which = np.unique(rows[:, 2:-1], return_inverse=True)
    none = int(len(words) > 0 and words[0] < 0)
    langs, lang = np.unique(rows[:, 1], return_inverse=True)
    table = np.vstack((lang, which.reshape(-1, LONGEST).T - none, rows[:, -1]))
    return int(rows[0, 0]), [own.langs[i] for i in langs], zstandard.compress(b"\n".join(own.words[i] for i in words[none:]), 3), squeeze(table.ravel())


def _pack(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(rows.combine_chunks())
    return sink.getvalue().to_pybytes()


def collocations(docs: DataFrame, least: int = LEAST_COUNT, longest: int = LONGEST, top: int | None = TOP) -> DataFrame:
    """Phrases of each language by how much more often their parts stand together than apart.

    Input: documents with lang (null: ``und``) and text (null: empty). Result:
    lang, rank, phrase, a, l, r, n, score, the ``top`` first of each language
    (None: all). Counts, quotients and comparisons are exact integers. Repeated
    rows count each; empty tables and texts without words give no rows; other
    columns are ignored.
    """
    plain = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), F.col("text")).filter("text != ''")
    counts = frequent_phrases(plain, least, longest)
    sizes = counts.filter("words = 0").select("lang", F.col("n").alias("size"))
    phrases = counts.filter("words > 0")
    cuts = phrases.filter("words > 1").select("lang", "phrase", F.col("n").alias("a"), "words", F.explode(F.expr("sequence(1, words - 1)")).alias("k"))
    # One word may open or end a large share of all candidates.
    cuts = cuts.selectExpr("*", "substring_index(phrase, ' ', k) AS head", "substring_index(phrase, ' ', k - words) AS tail", f"CAST(pmod(xxhash64(phrase), {SALTS}) AS INT) AS s")
    cuts = cuts.selectExpr("*", "IF(k = 1, s, 0) AS head_salt", "IF(words - k = 1, s, 0) AS tail_salt")
    known = phrases.filter(f"words < {longest}").select("lang", "phrase", "n", F.explode(F.expr(f"IF(words = 1, sequence(0, {SALTS - 1}), array(0))")).alias("salt"))
    heads = known.select("lang", F.col("phrase").alias("head"), F.col("salt").alias("head_salt"), F.col("n").alias("l"))
    tails = known.select("lang", F.col("phrase").alias("tail"), F.col("salt").alias("tail_salt"), F.col("n").alias("r"))
    cuts = cuts.join(heads, ["lang", "head", "head_salt"]).join(tails, ["lang", "tail", "tail_salt"])
    exact = "decimal(20,0)"
    scored = cuts.selectExpr("lang", "phrase", "a", f"named_struct('score', CAST({SCORE_SCALE} AS decimal(8,0)) * CAST(a AS {exact}) div (CAST(l AS {exact}) + CAST(r AS {exact})), 'k', k, 'l', l, 'r', r) AS cut", "CAST(NULL AS BIGINT) AS cover")
    inner = "flatten(transform(sequence(2, words - 1), m -> transform(sequence(0, words - m), i -> array_join(slice(w, i + 1, m), ' '))))"
    covers = phrases.filter("words > 2").selectExpr("lang", "n", "words", "split(phrase, ' ') AS w").select("lang", F.explode(F.array_distinct(F.expr(inner))).alias("phrase"), "n")
    empty = F.lit(None).cast(scored.schema["cut"].dataType)
    rows = scored.unionByName(covers.select("lang", "phrase", F.lit(None).cast("bigint").alias("a"), empty.alias("cut"), F.col("n").alias("cover")))
    best = rows.groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.min("cut").alias("cut"), F.max("cover").alias("cover"))
    best = best.filter(f"cover IS NULL OR {DENOMINATOR} * CAST(cover AS {exact}) < {NUMERATOR} * CAST(a AS {exact})")
    best = best.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    if top is not None:
        # The first of a language are among the first of each of its parts.
        part = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
        best = best.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top).drop("part")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint"))
    if top is not None:
        ranked = ranked.filter(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("size").alias("n"), "score")


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("lang", "text"))


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '{UNKNOWN}') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM d),
g AS (SELECT lang, 1 AS m, unnest(w) AS phrase FROM p
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: array_to_string(w[i:i + 1], ' '))) FROM p WHERE len(w) >= 2
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) FROM p WHERE len(w) >= 3
  UNION ALL SELECT lang, 4, unnest(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) FROM p WHERE len(w) >= 4),
f AS MATERIALIZED (SELECT lang, m, phrase, count(*) AS n FROM g GROUP BY ALL HAVING count(*) >= {LEAST_COUNT}),
s AS (SELECT lang, sum(len(w)) AS n FROM p GROUP BY lang),
c AS (SELECT lang, m, phrase, n AS a, string_split(phrase, ' ') AS w, unnest(range(1, m)) AS k FROM f WHERE m > 1),
x AS (SELECT c.lang, c.phrase, a, k, l.n AS l, r.n AS r, CAST({SCORE_SCALE}::HUGEINT * a // (l.n + r.n) AS BIGINT) AS score FROM c
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(w[:k], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(w[k + 1:], ' ')),
b AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
o AS (SELECT lang, m, n, unnest(flatten([[array_to_string(w[i:j], ' ') FOR j IN range(i + 1, m + 1) IF j - i + 1 < m] FOR i IN range(1, m)])) AS phrase FROM (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE m > 2)),
v AS (SELECT lang, phrase, max(n) AS cover FROM o GROUP BY ALL),
q AS (SELECT b.* FROM b LEFT JOIN v ON v.lang = b.lang AND v.phrase = b.phrase WHERE cover IS NULL OR 100::HUGEINT * cover < 80::HUGEINT * a)
SELECT q.lang, row_number() OVER (PARTITION BY q.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(s.n AS BIGINT) AS n, score FROM q JOIN s ON s.lang = q.lang
QUALIFY row_number() OVER (PARTITION BY q.lang ORDER BY score DESC, a DESC, phrase) <= {TOP}"""

QUERIES = {"op12_phrase_collocations": (op12_phrase_collocations, ORACLE)}
