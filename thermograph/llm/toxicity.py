"""Toxicity by a counterfactual-regularised classifier.

Logistic regression over the presence of words and word beginnings. Identity
terms of labelled texts are swapped for others of their group, and training
penalises any change of the score, so that naming a group weighs nothing by
itself even where the labels suggest it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thermograph.llm.common import held_out, spill, table
from thermograph.llm.keycount import small_batches

#: At most this many labelled rows are used for fitting (those with the least hash), and this many features.
SAMPLE_ROWS = 20_000
MAX_FEATURES = 2048
#: A feature counts from this many rows of the sample on.
MIN_ROWS = 3
SAMPLE_TASKS = 24
RIDGE = 1e-4
SWAP_PENALTY = 10.0
STEPS = 300

#: Groups whose members may stand for each other.
IDENTITY_TERMS = {
    "gender": ["women", "men", "transgender", "girls", "boys"],
    "person": ["woman", "man", "girl", "boy"],
    "religion": ["muslim", "jewish", "christian", "hindu", "buddhist", "sikh", "atheist", "catholic"],
    "religions": ["muslims", "jews", "christians", "hindus", "buddhists", "sikhs", "atheists", "catholics"],
    "descent": ["black", "white", "asian", "african", "arab", "latino", "european", "indigenous"],
    "orientation": ["gay", "lesbian", "straight", "bisexual", "queer", "heterosexual"],
    "origin": ["immigrants", "refugees", "foreigners", "natives"],
    "ability": ["deaf", "blind", "disabled", "autistic"],
    "age": ["old", "young", "elderly"],
    "femmes": ["femmes", "hommes"], "frauen": ["frauen", "männer"], "mujeres": ["mujeres", "hombres"],
    "religionen": ["muslime", "juden", "christen"], "religions_fr": ["musulmans", "juifs", "chrétiens"], "religiones": ["musulmanes", "judíos", "cristianos"],
}
GROUP = {t: ts for ts in IDENTITY_TERMS.values() for t in ts}
LETTERS = re.compile(r"[^\W\d_]+")
PREFIXES = (3, 4, 5, 6)


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    bias: float


def word_features(word: str) -> list[str]:
    """The word itself and its beginnings, marked by a stroke."""
    return [word, *(word[:n] + "-" for n in PREFIXES if len(word) > n)]


def features(words: set[str]) -> set[str]:
    return {f for w in words for f in word_features(w)}


def words_of(text: str | None) -> set[str]:
    return set(LETTERS.findall((text or "").lower()))


def swapped(words: set[str], turn: int) -> set[str] | None:
    """The words with each identity term replaced by the ``turn``-th other one of its group; None without any."""
    found = words & GROUP.keys()
    if not found:
        return None
    other = {t: [x for x in GROUP[t] if x != t] for t in found}
    return (words - found) | {other[t][turn % len(other[t])] for t in found}


def fit(x: list[np.ndarray], y: np.ndarray, pairs: list[tuple[int, np.ndarray]], n_features: int, swap_penalty: float = SWAP_PENALTY) -> tuple[np.ndarray, float]:
    """Weights and bias minimising balanced log loss + ridge + swap_penalty · mean squared change of the logit.

    ``x`` are the feature numbers of each row, ``pairs`` a row and the numbers of
    its swapped version. Accelerated gradient steps of a fixed number.
    """
    rows = np.repeat(np.arange(len(x)), [len(v) for v in x])
    cols = np.concatenate(x) if len(rows) else np.zeros(0, np.int64)
    prow = np.concatenate([np.repeat(i, len(x[r]) + len(v)) for i, (r, v) in enumerate(pairs)]) if pairs else np.zeros(0, np.int64)
    pcol = np.concatenate([np.concatenate((x[r], v)) for r, v in pairs]) if pairs else np.zeros(0, np.int64)
    sign = np.concatenate([np.concatenate((np.ones(len(x[r])), -np.ones(len(v)))) for r, v in pairs]) if pairs else np.zeros(0)
    n = len(x)
    weight = np.where(y > 0, 0.5 / y.sum(), 0.5 / (n - y.sum()))  # both labels count the same in all
    w, b = np.zeros(n_features), 0.0
    # Adam: features differ much in how many rows they are in.
    m, v = np.zeros(n_features + 1), np.zeros(n_features + 1)
    for step in range(1, STEPS + 1):
        z = np.bincount(rows, w[cols], n) + b
        d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight
        g = np.append(np.bincount(cols, d[rows], n_features) + RIDGE * w, d.sum())
        if pairs:
            change = np.bincount(prow, w[pcol] * sign, len(pairs))
            g[:-1] += np.bincount(pcol, 2 * swap_penalty * change[prow] * sign / len(pairs), n_features)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.1 * (1 - 0.9 * step / STEPS) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-10)
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)


def train(labelled: DataFrame, swap_penalty: float = SWAP_PENALTY, sample_rows: int = SAMPLE_ROWS, max_features: int = MAX_FEATURES) -> Model:
    """Fit on (text, label 0/1); at most ``sample_rows`` rows may be given, null labels are left out.

    Feature counts are made on executors; feature numbers of the sample's rows
    (at most ``max_features`` a row) are fitted on the driver. With labels of
    one kind only, or none, the model is their smoothed share alone.
    """
    sample = spill(labelled.select("text", F.col("label").cast("int").alias("label")).filter("label IS NOT NULL").repartition(SAMPLE_TASKS))
    total, positive = sample.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if total > sample_rows:
        raise ValueError(f"{total} labelled rows; sample_rows is {sample_rows}")
    share = (positive + 0.5) / (total + 1)
    if positive in (0, total):
        return Model({}, float(np.log(share / (1 - share))))

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            n: Counter[str] = Counter()
            toxic: Counter[str] = Counter()
            for t, y in zip(df["text"], df["label"]):
                found = features(words_of(t))
                n.update(found)
                if y:
                    toxic.update(found)
            yield pd.DataFrame({"feature": list(n), "n": list(n.values()), "toxic": [toxic[f] for f in n]})

    counts = small_batches(sample).mapInPandas(spread, "feature string, n bigint, toxic bigint").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    counts = spill(counts)
    gap = F.abs(F.col("toxic") - F.col("n") * F.lit(positive / total)) / F.sqrt(F.col("n"))
    identity = sorted(f for t in GROUP for f in word_features(t))
    best = counts.filter(F.col("n") >= MIN_ROWS).orderBy(gap.desc(), "feature").limit(max_features)
    known = [r["feature"] for r in best.unionByName(counts.filter(F.col("feature").isin(identity))).select("feature").distinct().collect()]
    number = {f: i for i, f in enumerate(sorted(known))}

    def numbers(words: set[str]) -> list[int]:
        return sorted(number[f] for f in features(words) if f in number)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            words = [words_of(t) for t in df["text"]]
            other = [swapped(w, len(w)) for w in words]
            yield pd.DataFrame({"label": df["label"], "x": [numbers(w) for w in words], "other": [None if o is None else numbers(o) for o in other]})

    rows = small_batches(sample).mapInPandas(encode, "label int, x array<int>, other array<int>").collect()
    x = [np.array(r["x"], np.int64) for r in rows]
    pairs = [(i, np.array(r["other"], np.int64)) for i, r in enumerate(rows) if r["other"] is not None]
    w, b = fit(x, np.array([r["label"] for r in rows], float), pairs, len(number), swap_penalty)
    return Model({f: float(w[i]) for f, i in number.items()}, b)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Adds ``score`` (0 to 1, higher: more likely toxic) and ``predicted`` (1 from 0.5 on) to every row.

    Only the whole text counts. Null and empty texts get the model's bias alone.
    Repeated rows are scored each; columns of these two names are replaced.
    """
    weights = model.weights
    cache: dict[str, float | tuple] = {}

    def own(word: str) -> tuple:
        if len(cache) > 300_000:
            cache.clear()
        found = tuple(f for f in word_features(word) if f in weights)
        cache[word] = found
        return found

    @F.pandas_udf("double")
    def probability(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            found: set[str] = set()
            for w in words_of(t):
                hit = cache.get(w)
                if hit is None:
                    hit = own(w)
                if hit:
                    found.update(hit)
            out.append(model.bias + sum(sorted(weights[f] for f in found)))
        return pd.Series(1 / (1 + np.exp(-np.clip(np.array(out, float), -700, 700))))

    columns = [c for c in docs.columns if c not in ("score", "predicted")]
    scored = small_batches(docs).select(*columns, probability("text").alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = SAMPLE_ROWS) -> DataFrame:
    """(text, label) of at most ``rows`` documents with a label, those with the least hash of doc_id.

    A doc_id with several labels has the largest. Several documents of one id
    all count; should they be too many, those with the least hash of id and text
    stay. Only about as many rows as asked for leave their tasks: a bound on the
    hash comes before any sort. The sample of labels is bounded by ``rows``, so
    it is broadcast to the documents.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label"))

    def least(df: DataFrame, n: int, *order: str) -> DataFrame:
        total = df.count()
        if total <= n:
            return df
        h = F.xxhash64(*order)
        # The bound lets a fifth more pass than is wanted; hashes fill the signed 64 bits evenly.
        share = (1.2 * n + 50) / total
        near = df.filter(h < F.lit(int(-2**63 + min(share, 1.0) * (2**64 - 1)))) if share < 1 else df
        return near.orderBy(h, *order).limit(n)

    picked = spill(least(known, rows, "doc_id"))
    found = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    return least(found, rows, "doc_id", "text").select("text", "label")


def toxicity_model(spark: SparkSession, sf_dir: str) -> Model:
    labels = table(spark, sf_dir, "labels").filter(~held_out("doc_id", 5, 0))
    return train(labelled_sample(table(spark, sf_dir, "documents"), labels))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score(table(spark, sf_dir, "documents").select("doc_id", "text"), toxicity_model(spark, sf_dir))
    return scored.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", "predicted")


QUERIES = {"op4_toxicity": (op4_toxicity, None)}
