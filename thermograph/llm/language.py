"""Language identification by rank-order profiles.

A profile lists the most frequent letter n-grams (one to three letters, words
padded with blanks) of a language by rank. A document's own ranks are compared
with every profile: each of its n-grams adds how far its rank is out of place,
or the length of a profile where the profile lacks it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from thermograph.llm.common import held_out, table
from thermograph.llm.keycount import small_batches

#: N-grams of a profile, and of a document that are compared with it.
PROFILE = 400
UNKNOWN = "und"
#: Characters that are split at once, and distinct n-grams a task holds before it passes them on.
GROUP_CHARS, HELD_GRAMS = 1_000_000, 2_000_000
BLANK = 32


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """Lower-case letter of every code point, blank where it is no letter. Letters of two lower-case characters stay."""
    out = np.full(0x110000, BLANK, np.int32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def _letters(text: str) -> np.ndarray:
    return letter_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]


def text_grams(texts: list[str]) -> Iterator[np.ndarray]:
    """All n-grams of each text as numbers: up to three letters of 21 bits, the first one highest.

    One- and two-letter n-grams come first, so numbers order n-grams by length, then by letters.
    """
    raw = _letters("\n" + "\n".join(texts) + "\n")
    kept = np.ones(len(raw), bool)
    kept[1:] = (raw[1:] != BLANK) | (raw[:-1] != BLANK)
    at = np.cumsum(kept) - 1
    c = raw[kept].astype(np.int64)
    ends = at[np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))]
    letter = c != BLANK
    two = (c[:-1] << 21) | c[1:]
    three = (two[:-1] << 21) | c[2:]
    whole = letter[1:-1]  # no n-gram crosses a blank
    n1, n3 = np.concatenate(([0], np.cumsum(letter))), np.concatenate(([0], np.cumsum(whole)))
    one, three = c[letter], three[whole]
    for a, b in zip(ends[:-1], ends[1:]):
        yield np.concatenate((one[n1[a]:n1[b]], two[a:b], three[n3[a]:n3[max(b - 1, a)]]))


def counted(grams: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers in order, and how often each occurs (the sum of its weights)."""
    if weights is not None:
        order = np.argsort(grams, kind="stable")
        grams, weights = grams[order], weights[order]
    else:
        grams = np.sort(grams)
    first = np.flatnonzero(np.concatenate((np.ones(min(len(grams), 1), bool), grams[1:] != grams[:-1])))
    if weights is not None:
        return grams[first], np.add.reduceat(weights, first) if len(first) else weights
    return grams[first], np.diff(np.append(first, len(grams)))


def gram_counts(texts: Iterable[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """N-grams and counts of each text; short texts are split many at a time, giant ones in parts that end between words."""
    group: list[str] = []
    held = 0

    def parts(text: str) -> Iterator[str]:
        at = 0
        while at < len(text):
            to = at + GROUP_CHARS
            while to < len(text):
                blanks = np.flatnonzero(_letters(text[at:to]) == BLANK)
                if len(blanks):
                    to = at + int(blanks[-1]) + 1
                    break
                to += GROUP_CHARS
            yield text[at:to]
            at = to

    def giant(text: str) -> tuple[np.ndarray, np.ndarray]:
        total = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        for part in parts(text):
            own = counted(next(text_grams([part])))
            total = counted(np.concatenate((total[0], own[0])), np.concatenate((total[1], own[1])))
        return total

    def close() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for grams in text_grams(group) if group else ():
            yield counted(grams)

    for text in texts:
        text = text or ""
        if len(text) > GROUP_CHARS:
            yield from close()
            group, held = [], 0
            yield giant(text)
            continue
        group.append(text)
        held += len(text) + 1
        if held > GROUP_CHARS:
            yield from close()
            group, held = [], 0
    yield from close()


def learn_profiles(docs: DataFrame, size: int = PROFILE) -> dict[str, np.ndarray]:
    """The ``size`` most frequent n-grams of each non-null lang of (lang, text), most frequent first.

    Ties go to the smaller n-gram (shorter, then by letters). Counts cover all
    rows; null and empty texts have none. At most ``size`` numbers a language
    reach the driver.
    """
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def rows() -> Iterator[pd.DataFrame]:
            for lang, (grams, n) in held.items():
                yield pd.DataFrame({"lang": lang, "gram": grams, "n": n})

        for df in batches:
            for lang, own in df.groupby("lang")["text"]:
                parts = [held[lang]] if lang in held else []
                size = 0
                for part in gram_counts(own):
                    parts.append(part)
                    size += len(part[0])
                    if size > HELD_GRAMS:
                        parts, size = [counted(*map(np.concatenate, zip(*parts)))], 0
                if parts:
                    held[lang] = counted(*map(np.concatenate, zip(*parts)))
            if sum(len(g) for g, _ in held.values()) > HELD_GRAMS:
                yield from rows()
                held.clear()
        yield from rows()

    counts = small_batches(docs.filter("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text")).mapInPandas(count, "lang string, gram bigint, n bigint")
    total = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    best = total.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= size).select("lang", "gram", "rank").toPandas()
    return {lang: own.sort_values("rank")["gram"].to_numpy(np.int64) for lang, own in sorted(best.groupby("lang"), key=lambda x: x[0])}


class Distances:
    """Out-of-place distances of documents to profiles."""

    def __init__(self, profiles: dict[str, np.ndarray], size: int) -> None:
        self.size, self.langs = size, sorted(profiles)
        self.known = np.unique(np.concatenate([profiles[k] for k in self.langs])) if profiles else np.zeros(0, np.int64)
        # -1: the profile lacks the n-gram.
        self.ranks = np.full((len(self.langs), len(self.known) + 1), -1, np.int64)
        for i, lang in enumerate(self.langs):
            self.ranks[i, np.searchsorted(self.known, profiles[lang])] = np.arange(len(profiles[lang]))

    def nearest(self, grams: np.ndarray, n: np.ndarray) -> tuple[str, float]:
        if not len(grams) or not self.langs:
            return UNKNOWN, 0.0
        if len(n) > self.size:
            # All n-grams as frequent as the last one that counts, and only those, can matter.
            enough = np.flatnonzero(n >= np.partition(n, -self.size)[-self.size])
            grams, n = grams[enough], n[enough]
        grams = grams[np.argsort(-n, kind="stable")[:self.size]]
        at = np.searchsorted(self.known, grams)
        at[at == len(self.known)] = -1
        at[self.known[at] != grams] = len(self.known)
        ranks = self.ranks[:, at]
        gaps = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(grams))))
        total = gaps.sum(1)
        best = int(total.argmin())
        return self.langs[best], 1.0 - float(total[best]) / (self.size * len(grams))


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], size: int = PROFILE) -> DataFrame:
    """Adds ``lang_pred`` and ``score`` to every row; columns of these names are replaced.

    The nearest profile names the language, the first by name on ties. The score
    is one less the distance as a share of the largest possible one. Texts that
    are null or have no letter, and all texts where there are no profiles, get
    ``und`` and 0. Only the whole text counts; repeated rows are judged each.
    """
    distances = Distances(profiles, size)

    @F.pandas_udf("lang_pred string, score double")
    def judge(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([distances.nearest(*x) for x in gram_counts(texts)], columns=["lang_pred", "score"])

    columns = [F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score")]
    return small_batches(docs).select(*columns, judge("text").alias("__judged")).select(*columns, "__judged.lang_pred", "__judged.score")


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    profiles = learn_profiles(docs.filter(~held_out("doc_id", 4, 2)))
    return identify(docs.select("doc_id", "text"), profiles).select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")


#: crc32 by its bits; an n-gram is a part of a word between blanks.
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, lang, text, list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}]+', ' ', 'g'), ' '), lambda w: w <> '') AS words,
  xor(list_reduce(flatten(list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: [ord((doc_id::VARCHAR)[i])::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END, 4294967295::BIGINT), 4294967295::BIGINT) % 4 = 2 AS held_out FROM documents),
w AS (SELECT k, ' ' || word || ' ' AS p, count(*) AS n FROM (SELECT k, unnest(words) AS word FROM d) GROUP BY ALL),
g AS (SELECT k, g, sum(n) AS n FROM (SELECT k, n, unnest(flatten([[p[i:i + m - 1] FOR i IN range(CASE WHEN m = 1 THEN 2 ELSE 1 END, length(p) - m + CASE WHEN m = 1 THEN 1 ELSE 2 END)] FOR m IN [1, 2, 3]])) AS g FROM w) GROUP BY ALL),
p AS (SELECT lang, g, row_number() OVER (PARTITION BY lang ORDER BY n DESC, length(g), g) AS rank FROM (SELECT lang, g, sum(n) AS n FROM g JOIN d USING (k) WHERE NOT held_out AND lang IS NOT NULL GROUP BY ALL)
  QUALIFY rank <= {PROFILE}),
o AS (SELECT k, g, row_number() OVER (PARTITION BY k ORDER BY n DESC, length(g), g) AS rank FROM g QUALIFY rank <= {PROFILE}),
m AS (SELECT k, count(*) AS size FROM o GROUP BY k),
s AS (SELECT k, p.lang, sum(abs(o.rank - p.rank) - {PROFILE}) AS gain FROM o JOIN p ON o.g = p.g GROUP BY ALL),
l AS (SELECT DISTINCT lang FROM p),
b AS (SELECT m.k, l.lang, 1.0::DOUBLE - (size * {PROFILE} + coalesce(gain, 0))::DOUBLE / ({PROFILE} * size)::DOUBLE AS score FROM m CROSS JOIN l LEFT JOIN s ON s.k = m.k AND s.lang = l.lang
  QUALIFY row_number() OVER (PARTITION BY m.k ORDER BY coalesce(gain, 0), l.lang) = 1)
SELECT doc_id, held_out, coalesce(b.lang, '{UNKNOWN}') AS lang_pred, coalesce(score, 0) AS score FROM d LEFT JOIN b USING (k)"""

QUERIES = {"op11_language_id": (op11_language_id, ORACLE)}
