"""Line dedup by winnowing, in DataFrame functions only.

Lines with a word are hashed. The least hash of every window of ``run`` lines
is a fingerprint, so any run of that many lines found in two places has a
fingerprint in common. Around fingerprints found again, windows are compared
whole; neighbouring repeated windows extend a match both ways, and the lines of
all but the first occurrence go. On request, fewer lines make a window too if
they hold enough words or are a whole text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thermograph.llm.common import row_key, spill, table

RUN = 3
#: Words from which fewer lines than a run are a window of their own.
SHORT_WORDS = 35
HAS_WORD = "rlike '[^\\\\x20\\\\x09-\\\\x0D]'"


def windows(docs: DataFrame, run: int = RUN, short_words: int | None = None) -> DataFrame:
    """Every window of ``run`` lines with a word: key, doc_id, i, n, f, p, w1, w2.

    ``i`` counts such lines from 0; ``f`` is the window's least line hash and
    ``p`` its (leftmost) place; (w1, w2) are 128 bits of the whole window and
    ``n`` its lines. With ``short_words``, windows of fewer lines with so many
    words follow, and whole texts of fewer lines and words, told apart by n and kind.
    """
    lines = docs.select("doc_id", row_key("doc_id", "text").alias("key"), F.expr(f"filter(split(text, '\\n'), l -> l {HAS_WORD})").alias("l")).filter(F.size("l") >= (run if short_words is None else 1))
    hashed = lines.selectExpr("key", "doc_id", "transform(l, x -> xxhash64(x)) AS h", "transform(l, x -> xxhash64(7, x)) AS g", *([] if short_words is None else [
        "transform(l, x -> size(array_remove(split(x, '[\\\\x20\\\\x09-\\\\x0D]+'), ''))) AS c"]))
    all_of = lambda a, n=run: ", ".join(f"{a}[i + {k}]" for k in range(n))
    every = f"""transform(sequence(0, size(h) - {run}), i -> named_struct('i', i, 'n', {run}, 'f', array_min(slice(h, i + 1, {run})),
        'p', CAST(i + array_position(slice(h, i + 1, {run}), array_min(slice(h, i + 1, {run}))) - 1 AS INT), 'w1', xxhash64({all_of('h')}), 'w2', xxhash64({all_of('g')})))"""
    if short_words is not None:
        none = "CAST(array() AS array<struct<i: int, n: int, f: bigint, p: int, w1: bigint, w2: bigint>>)"
        parts = [f"CASE WHEN size(h) >= {run} THEN {every} ELSE {none} END"]
        for n in range(1, run):
            words = " + ".join(f"c[i + {k}]" for k in range(n))
            kind = f"CASE WHEN {words} >= {short_words} THEN {n} ELSE {-n} END"
            parts.append(f"""CASE WHEN size(h) >= {n} THEN transform(filter(sequence(0, size(h) - {n}), i -> {words} >= {short_words} OR size(h) = {n}), i -> named_struct('i', i, 'n', {n},
                'f', xxhash64({kind}, {all_of('h', n)}), 'p', i, 'w1', xxhash64({kind}, {all_of('h', n)}), 'w2', xxhash64({kind}, {all_of('g', n)}))) ELSE {none} END""")
        every = f"concat({', '.join(parts)})"
    each = hashed.selectExpr("key", "doc_id", f"explode({every}) AS w")
    return each.select("key", "doc_id", "w.*")


def repeated_windows(docs: DataFrame, run: int = RUN, short_words: int | None = None) -> DataFrame:
    """(key, i, n) of the windows that are no first occurrence, in order of doc_id (null last), hash of the text and place."""
    every = spill(windows(docs, run, short_words))
    again = spill(every.select("f", "key", "p").distinct().groupBy("f").agg(F.count("*").alias("n")).filter("n > 1").select("f"))
    near = spill(every.join(again.hint("merge"), "f").select("key", "doc_id", "i", "n", "w1", "w2"))
    place = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "key", "i")
    first = spill(near.groupBy("w1", "w2").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1").select("w1", "w2", "first"))
    return near.join(first.hint("merge"), ["w1", "w2"]).filter(~place.eqNullSafe(F.col("first"))).select("key", "i", near["n"])


def drop_repeated_runs(docs: DataFrame, run: int = RUN, short_words: int | None = None) -> DataFrame:
    """``docs`` without the lines of later repeated runs, and ``n_lines``, ``n_removed``.

    A line is one between line feeds; lines without a word are no part of runs
    and stay. A run is ``run`` or more lines equal to those of an earlier place,
    earlier by doc_id (null last), a hash of the text, then by position; shorter
    repeats stay, unless ``short_words`` is given: then repeats of fewer lines go
    too if they hold so many words, or if a whole text repeats a whole one. Runs
    may overlap: of one line repeated many times, the first stays. Rows equal in
    doc_id and text are one place and treated alike. Null texts stay null, empty
    ones empty, both with 0 lines. ``n_lines`` counts lines with a word before
    removal; columns of these two names are replaced.
    """
    gone = spill(repeated_windows(docs, run, short_words).groupBy("key").agg(F.collect_set(F.struct("i", "n")).alias("starts")))
    rest = [c for c in docs.columns if c not in ("text", "n_lines", "n_removed")]
    packed = docs.select(row_key("doc_id", "text").alias("key"), "text", F.struct(*rest, F.lit(0).alias("__pad")).alias("row")).join(gone.hint("merge"), "key", "left")
    cut = packed.selectExpr("row", "text", "starts", "split(text, '\\n') AS l").selectExpr("*", f"filter(transform(l, (x, j) -> CASE WHEN x {HAS_WORD} THEN j END), j -> j IS NOT NULL) AS at")
    cut = cut.selectExpr("*", f"CASE WHEN starts IS NOT NULL THEN array_distinct(flatten(transform(starts, s -> slice(at, s.i + 1, s.n)))) END AS out")
    kept = "CASE WHEN out IS NULL THEN text ELSE array_join(transform(array_except(sequence(0, size(l) - 1), out), j -> l[j]), '\\n') END"
    done = cut.selectExpr("row", f"{kept} AS text", "CAST(coalesce(size(at), 0) AS BIGINT) AS n_lines", "CAST(coalesce(size(out), 0) AS BIGINT) AS n_removed")
    return done.select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns if c not in ("n_lines", "n_removed")],
                       F.greatest("n_lines", F.lit(0)).alias("n_lines"), F.greatest("n_removed", F.lit(0)).alias("n_removed"))


def op5_line_dedup_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with repeats of fewer lines, as in the pipeline."""
    return _digest(drop_repeated_runs(table(spark, sf_dir, "documents").select("doc_id", "text"), short_words=SHORT_WORDS))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(drop_repeated_runs(table(spark, sf_dir, "documents").select("doc_id", "text")))


def _digest(out: DataFrame) -> DataFrame:
    return out.select("doc_id", "n_lines", "n_removed", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def dedup_sql(source: str, columns: str = "", run: int = RUN) -> str:
    """The same in DuckDB over a source of distinct doc_ids, with text as ``kept``."""
    parts = " || chr(10) || ".join(f"lead(x, {k}) OVER p" if k else "x" for k in range(run))
    return f"""
WITH src AS (SELECT * FROM {source}),
r AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(0, len(string_split(text, chr(10))))) AS j FROM src WHERE text IS NOT NULL),
c AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY j) - 1 AS i FROM r WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]')),
w AS (SELECT doc_id, i, {parts} AS w FROM c WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
o AS (SELECT doc_id, i, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) AS n FROM w WHERE w IS NOT NULL),
g AS (SELECT DISTINCT doc_id, i + k AS i FROM (SELECT doc_id, i, unnest(range(0, {run})) AS k FROM o WHERE n > 1)),
m AS (SELECT r.doc_id, r.j, r.x, c.i IS NOT NULL AS counts, g.i IS NOT NULL AS gone FROM r LEFT JOIN c ON r.doc_id = c.doc_id AND r.j = c.j LEFT JOIN g ON c.doc_id = g.doc_id AND c.i = g.i),
t AS (SELECT doc_id, CAST(count(*) FILTER (counts) AS BIGINT) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_removed, coalesce(string_agg(x, chr(10) ORDER BY j) FILTER (NOT gone), '') AS kept FROM m GROUP BY doc_id)
SELECT src.doc_id, {columns} coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, kept FROM src LEFT JOIN t USING (doc_id)"""


def short_dedup_sql(source: str, run: int = RUN, short_words: int = SHORT_WORDS) -> str:
    """``dedup_sql`` with the windows of fewer lines."""
    sql = dedup_sql(source, run=run)
    joined = lambda n: " || chr(10) || ".join(f"lead(x, {k}) OVER p" if k else "x" for k in range(n))
    words = lambda n: f"len(regexp_extract_all(w, '[^\\x20\\x09-\\x0D]+')) >= {short_words}"
    one = f"SELECT doc_id, i, {joined(run)} AS w FROM c WINDOW p AS (PARTITION BY doc_id ORDER BY i)"
    every = [f"SELECT doc_id, i, {run} AS n, w FROM ({one})"]
    for n in range(1, run):
        every.append(f"SELECT doc_id, i, CASE WHEN {words(n)} THEN {n} ELSE {-n} END AS n, w FROM (SELECT doc_id, i, {joined(n)} AS w, count(*) OVER (PARTITION BY doc_id) AS l FROM c WINDOW p AS (PARTITION BY doc_id ORDER BY i)) WHERE w IS NOT NULL AND (l = {n} OR {words(n)})")
    for old, new in ((one, " UNION ALL ".join(every)), ("SELECT doc_id, i, row_number() OVER (PARTITION BY w ", "SELECT doc_id, i, abs(n) AS len, row_number() OVER (PARTITION BY n, w "), (f"unnest(range(0, {run}))", "unnest(range(0, len))")):
        if old not in sql:
            raise ValueError(old)
        sql = sql.replace(old, new)
    return sql


QUERIES = {"op5_line_dedup": (op5_line_dedup, f"SELECT doc_id, n_lines, n_removed, md5(kept) AS text_md5 FROM ({dedup_sql('documents')})"),
           "op5_line_dedup_short": (op5_line_dedup_short, f"SELECT doc_id, n_lines, n_removed, md5(kept) AS text_md5 FROM ({short_dedup_sql('documents')})")}
