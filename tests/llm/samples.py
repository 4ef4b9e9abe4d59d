"""Small tables with the awkward cases: nulls, empty and long texts, repeated rows, clashing names."""

import random
import re

CLASHING = ["key", "v", "row", "chunk", "n_words", "n_removed", "n_lines", "score", "predicted", "label", "rank", "length", "block", "h", "text_md5", "doc", "offset", "__v"]


def words(n, seed, vocabulary=400):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


def awkward(spark, texts):
    """Texts as documents: row i has doc_id i; two repeated rows, a null doc_id, null, empty and blank texts are added."""
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [rows[0], rows[0], (None, "a text without a number " * 12), (9000, None), (9001, ""), (9002, " \n\t \x0b "), (None, None)]
    extra = {c: c[::-1] for c in CLASHING}
    data = [(i, t, None if k % 3 == 0 else "en", *extra.values()) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(data, "doc_id bigint, text string, lang string, " + ", ".join(f"`{c}` string" for c in CLASHING))


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def empty(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
