"""Quality rules by distribution divergence.

A document's character-class and common-word histograms are compared with the
histograms of whole languages by Jensen-Shannon distance. All of it is SQL
expressions over one row; the only shuffle sums histograms per language.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from thermograph.llm.common import spill, table

#: Words of a language's reference: its most frequent ones.
COMMON = 12
#: A language has a reference from this many rows with words on.
MIN_ROWS = 10
SYMBOLS = "#*$%&|<>"
#: ASCII classes in the order in which they are taken out of a text.
ASCII_CLASSES = [
    ("lower", "abcdefghijklmnopqrstuvwxyz"), ("upper", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("digit", "0123456789"),
    ("stop", ".,;:?'\"()-"), ("symbol", SYMBOLS), ("other", "!/=@[\\]^_`{}~+"),
]
CLASSES = ["space", *[n for n, _ in ASCII_CLASSES], "wide_upper", "wide"]
#: Classes whatever the script: all letters, and all beyond ASCII, are one.
LETTERS = ["lower", "upper", "wide_upper", "wide"]
PLAIN = [[CLASSES.index(n) for n in LETTERS], *[[i] for i, n in enumerate(CLASSES) if n not in LETTERS]]

#: A distance rejects above base + allowance / sqrt(words): few words scatter more by chance.
CHAR_LIMIT = (0.17, 0.9)
WORD_LIMIT = (0.09, 1.6)
#: Guards: below these lengths a histogram says too little to reject by it.
MIN_CHARS = 200
MIN_WORDS = 80


def _literal(chars: str) -> str:
    """A Spark SQL string of exactly these characters, whatever the escape mode."""
    return "concat(" + ", ".join(f"char({ord(c)})" for c in chars) + ")"


def _string(value: str) -> str:
    """A Spark SQL string of any characters."""
    return f"decode(unhex('{value.encode().hex()}'), 'utf-8')"


def common_words(docs: DataFrame) -> dict[str, list[str]]:
    """The COMMON most frequent words with a letter of each non-null lang that has MIN_ROWS rows with words, ties by the word.

    Words are lower-cased and counted over all rows. COMMON words a language
    reach the driver.
    """
    rows = docs.filter("lang IS NOT NULL").selectExpr("lang", "array_remove(split(lower(coalesce(text, '')), '[\\\\x20\\\\x09-\\\\x0D]+'), '') AS v").filter("size(v) > 0")
    langs = rows.groupBy("lang").agg(F.count("*").alias("rows")).filter(F.col("rows") >= MIN_ROWS).select("lang")
    counts = rows.select("lang", F.explode("v").alias("word")).filter("word rlike '\\\\p{L}'").groupBy("lang", "word").agg(F.count("*").alias("n")).join(langs, "lang")
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    out: dict[str, list[str]] = {}
    for r in counts.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= COMMON).orderBy("lang", "r").collect():
        out.setdefault(r["lang"], []).append(r["word"])
    return out


def features(docs: DataFrame, words: list[str] = ()) -> DataFrame:
    """Counts of each row: the base rules' and both histograms.

    Adds ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` and the
    arrays ``chars`` (by CLASSES) and ``commons`` (by ``words``) to doc_id and lang.
    Null and empty texts count zero everywhere. Nothing is shuffled: repeated
    3-word windows are found by sorting each row's packed window hashes.
    """
    text = "coalesce(text, '')"
    df = docs.selectExpr("doc_id", "lang", f"{text} AS text", f"array_remove(split({text}, '[\\\\x20\\\\x09-\\\\x0D]+'), '') AS w",
                         f"filter(split({text}, '\\n'), l -> l rlike '[^\\\\x20\\\\x09-\\\\x0D]') AS l", f"array_remove(split(lower({text}), '[\\\\x20\\\\x09-\\\\x0D]+'), '') AS v")
    df = df.selectExpr(
        "doc_id", "lang", "CAST(char_length(text) AS BIGINT) AS n_chars", "CAST(size(w) AS BIGINT) AS n_words", "array_join(w, '') AS word_text",
        "CAST(size(l) - size(array_distinct(l)) AS BIGINT) AS n_dup_lines", f"filter(v, x -> x IN ({', '.join(map(_string, words))})) AS low" if words else "CAST(array() AS array<string>) AS low",
        "CASE WHEN size(w) >= 3 THEN transform(sequence(0, size(w) - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2])) ELSE CAST(array() AS array<bigint>) END AS g")
    # Taking lower-case letters out first leaves little for the other classes.
    df = df.selectExpr("*", "regexp_replace(word_text, '[a-z]+', '') AS rest_lower", "size(array_distinct(g)) < size(g) AS again")
    rest, steps = "rest_lower", []
    for name, chars in ASCII_CLASSES[1:]:
        steps.append((name, rest, f"rest_{name}"))
        df = df.withColumn(f"rest_{name}", F.expr(f"translate({rest}, {_literal(chars)}, '')"))
        rest = f"rest_{name}"
    named = {n: f"char_length({a}) - char_length({b})" for n, a, b in steps}
    upper = f"(char_length({rest}) - char_length(regexp_replace({rest}, '\\\\p{{Lu}}+', '')))"
    counts = ["n_chars - char_length(word_text)", "char_length(word_text) - char_length(rest_lower)", *named.values(), upper, f"char_length({rest}) - {upper}"]
    # Only rows with an equal pair of windows sort them: high 40 bits of the hash, low 24 bits of the place.
    df = df.selectExpr(
        "doc_id", "lang", "n_words", "CAST(char_length(word_text) AS BIGINT) AS word_chars", f"CAST({named['symbol']} AS BIGINT) AS n_symbols", "n_dup_lines", "low", "again",
        f"array({', '.join(f'CAST({c} AS BIGINT)' for c in counts)}) AS chars", "CASE WHEN again THEN g END AS g",
        "CASE WHEN again THEN sort_array(transform(g, (h, i) -> (h & -16777216L) | CAST(i AS BIGINT))) END AS pk")
    df = df.selectExpr("*", "CASE WHEN again THEN filter(pk, (x, j) -> (j > 0 AND (x ^ get(pk, j - 1)) BETWEEN 0 AND 16777215) OR (j < size(pk) - 1 AND (x ^ get(pk, j + 1)) BETWEEN 0 AND 16777215)) END AS near")
    # Where two different windows share those 40 bits, or places need more than 24 bits, the slower exact form decides.
    df = df.selectExpr("*", "again AND (size(g) > 16777216 OR exists(sequence(1, greatest(size(near) - 1, 1)), j -> j < size(near) AND (near[j] ^ near[j - 1]) BETWEEN 0 AND 16777215 "
                       "AND g[CAST(near[j] & 16777215L AS INT)] != g[CAST(near[j - 1] & 16777215L AS INT)])) AS mixed")
    df = df.selectExpr("*", "CASE WHEN mixed THEN sort_array(g) END AS sg")
    df = df.selectExpr("*", "CASE WHEN mixed THEN array_distinct(filter(sg, (x, j) -> j > 0 AND x = sg[j - 1])) END AS twice")
    df = df.selectExpr("*", "CASE WHEN mixed THEN filter(transform(g, (h, i) -> CASE WHEN array_contains(twice, h) THEN i END), i -> i IS NOT NULL) "
                       "WHEN again THEN transform(near, x -> CAST(x & 16777215L AS INT)) END AS places")
    commons = ", ".join(f"CAST(size(low) - size(array_remove(low, {_string(w)})) AS BIGINT)" for w in words)
    return df.selectExpr("doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                         "CASE WHEN again THEN CAST(size(array_distinct(flatten(transform(places, p -> array(p, p + 1, p + 2))))) AS BIGINT) ELSE 0L END AS n_repeat_words",
                         "chars", f"CAST(array({commons}) AS array<bigint>) AS commons")


def references(feats: DataFrame, words: dict[str, list[str]], every: list[str]) -> tuple[dict[str, tuple[list[int], list[int], int]], list[int]]:
    """Class counts, common-word counts and words of each language, and the class counts of all rows.

    One row a language reaches the driver, and one for all.
    """
    sums = [F.sum(F.col("chars")[i]).alias(f"c{i}") for i in range(len(CLASSES))]
    commons = [F.sum(F.col("commons")[i]).alias(f"w{i}") for i in range(len(every))]
    rows = feats.filter(F.col("lang").isin(list(words))).groupBy("lang").agg(*sums, *commons, F.sum("n_words").alias("n")).collect() if words else []
    own = {r["lang"]: ([r[f"c{i}"] for i in range(len(CLASSES))], [r[f"w{every.index(w)}"] for w in words[r["lang"]]], r["n"]) for r in sorted(rows, key=lambda r: r["lang"])}
    whole = feats.agg(*sums).first()
    return own, [x or 0 for x in whole]


def _distance(shares: str, ref: list[int]) -> str:
    """Jensen-Shannon distance (base 2) of an array of shares and reference counts, as SQL.

    A term 2x·ln(2x/(x+y)) is zero where x is.
    """
    term = "CASE WHEN p > 0 THEN p * ln(2 * p / (p + q)) ELSE 0D END + CASE WHEN q > 0 THEN q * ln(2 * q / (p + q)) ELSE 0D END"
    whole = float(sum(ref))
    return (f"sqrt(greatest(0D, aggregate(zip_with({shares}, array({', '.join(f'{r / whole!r}D' for r in ref)}), (p, q) -> {term}), 0D, (a, x) -> a + x) "
            f"/ {2 * 0.6931471805599453!r}D))")


def _limit(limit: tuple[float, float]) -> str:
    return f"{limit[0]!r}D + {limit[1]!r}D / sqrt(CAST(n_words AS DOUBLE))"


def quality_rules(docs: DataFrame, char_limit: tuple[float, float] = CHAR_LIMIT, word_limit: tuple[float, float] = WORD_LIMIT,
                  min_chars: int = MIN_CHARS, min_words: int = MIN_WORDS) -> DataFrame:
    """Base counts, distances to the nearest language and a verdict, one row per row.

    Result: doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, char_distance, word_distance, language, kept.

    Every lang of the table with MIN_ROWS rows has a reference: the histograms
    of all its rows over its own common words. A row's language is the reference
    with the least word distance (first by name on ties), whatever its own lang
    says. Rows of a lang without a reference, and all rows where there is none,
    are judged by the character classes of the whole table alone, all letters
    being one class, as nothing is known of their script. A distance is
    judged from min_chars characters or min_words words on; below, the rule
    keeps the row and the distance is still reported (null for empty texts).
    Null and empty texts fail the base rule of 50 words. Repeated rows are
    judged alike, each for itself; other columns are ignored.
    """
    words = common_words(docs)
    every = sorted({w for ws in words.values() for w in ws})
    feats = spill(features(docs, every))
    refs, pooled = references(feats, words, every)
    at = {w: f"commons[{i}]" for i, w in enumerate(every)}
    rest = lambda ws: f"(n_words - ({' + '.join(at[w] for w in ws)}))"
    names = {k: f"own_{i}" for i, k in enumerate(refs)}
    shares = feats.selectExpr("*", "aggregate(chars, 0L, (a, x) -> a + x) AS n_chars", "n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed",
                              *[f"array({', '.join(at[w] for w in words[k])}, {rest(words[k])}) AS {name}" for k, name in names.items()])
    shares = shares.selectExpr("*", "transform(chars, x -> CAST(x AS DOUBLE) / nullif(n_chars, 0)) AS char_shares",
                               f"transform(array({', '.join(' + '.join(f'chars[{i}]' for i in own) for own in PLAIN)}), x -> CAST(x AS DOUBLE) / nullif(n_chars, 0)) AS plain_shares", *[f"transform({n}, x -> CAST(x AS DOUBLE) / nullif(n_words, 0)) AS shares_{n}" for n in names.values()])
    char = lambda ref, shares="char_shares": f"CASE WHEN word_chars > 0 THEN {_distance(shares, ref)} END" if sum(ref) else "CAST(NULL AS DOUBLE)"
    alone = f"named_struct('word', CAST(NULL AS DOUBLE), 'language', CAST(NULL AS STRING), 'char', {char([sum(pooled[i] for i in own) for own in PLAIN], 'plain_shares')})"
    cols = [f"named_struct('word', CASE WHEN n_words > 0 THEN {_distance(f'shares_{names[k]}', [*ref, n - sum(ref)])} END, 'language', {_string(k)}, 'char', {char(chars)})" for k, (chars, ref, n) in refs.items()]
    known = f"lang IS NULL OR lang IN ({', '.join(map(_string, refs))})" if refs else "false"
    best = shares.selectExpr("*", f"CASE WHEN {known} THEN array_min(array({', '.join(cols)})) ELSE {alone} END AS best" if refs else f"{alone} AS best")
    return best.selectExpr("doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                           "best.char AS char_distance", "best.word AS word_distance", "best.language AS language",
                           f"NOT base_failed AND (n_chars < {min_chars} OR best.char IS NULL OR best.char <= {_limit(char_limit)}) "
                           f"AND (n_words < {min_words} OR best.word IS NULL OR best.word <= {_limit(word_limit)}) AS kept")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _oracle() -> str:
    """The same rules in DuckDB, by unnesting words and three-word windows."""
    def klass(chars: str) -> str:
        escaped = "".join("\\" + c if c in "\\^-]['\"" else c for c in chars).replace("'", "''")
        return f"length(t) - length(regexp_replace(t, '[{escaped}]', '', 'g'))"

    named = {n: klass(c) for n, c in ASCII_CLASSES}
    named["space"] = "length(t) - length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g'))"
    named["wide_upper"] = "length(u) - length(regexp_replace(u, '\\p{Lu}', '', 'g'))"
    named["wide"] = "length(regexp_replace(u, '\\p{Lu}', '', 'g'))"
    chars = ", ".join(f"CAST({named[n]} AS BIGINT) AS c{i}" for i, n in enumerate(CLASSES))
    sums = ", ".join(f"sum(c{i})::DOUBLE AS r{i}" for i in range(len(CLASSES)))

    def term(p: str, q: str) -> str:
        return f"CASE WHEN {p} > 0 THEN {p} * ln(2 * {p} / ({p} + {q})) ELSE 0 END + CASE WHEN {q} > 0 THEN {q} * ln(2 * {q} / ({p} + {q})) ELSE 0 END"

    whole = lambda x: "(" + " + ".join(f"{x}{i}" for i in range(len(CLASSES))) + ")::DOUBLE"
    char = "sqrt(greatest(0, (" + " + ".join(term(f"(c{i} / {whole('c')})", f"(r{i} / {whole('r')})") for i in range(len(CLASSES))) + ") / (2 * ln(2))))"
    some = lambda x, own: "(" + " + ".join(f"{x}{i}" for i in own) + ")"
    plain = "sqrt(greatest(0, (" + " + ".join(term(f"({some('c', own)} / {whole('c')})", f"({some('r', own)} / {whole('r')})") for own in PLAIN) + ") / (2 * ln(2))))"
    limit = lambda x: f"{x[0]} + {x[1]} / sqrt(n_words::DOUBLE)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
  regexp_replace(coalesce(text, ''), '[\\x00-\\x7F]', '', 'g') AS u, list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS l FROM documents),
g AS (SELECT k, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM d WHERE len(w) >= 3),
m AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS n FROM g) WHERE n >= 2),
r AS (SELECT k, count(DISTINCT p) AS n_repeat FROM (SELECT k, unnest([i, i + 1, i + 2]) AS p FROM m) GROUP BY k),
f AS (SELECT d.k, doc_id, lang, len(w) AS n_words, CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n_repeat, 0) AS n_repeat_words,
  length(t) AS n_chars, {chars} FROM d LEFT JOIN r USING (k)),
v AS (SELECT k, lang, lower(unnest(w)) AS word FROM d), n AS (SELECT k, lang, word, count(*) AS n FROM v GROUP BY ALL),
tw AS (SELECT lang, word, sum(n) AS n FROM n WHERE lang IN (SELECT lang FROM f WHERE n_words > 0 GROUP BY lang HAVING count(*) >= {MIN_ROWS}) AND regexp_matches(word, '\\p{{L}}') GROUP BY lang, word QUALIFY row_number() OVER (PARTITION BY lang ORDER BY sum(n) DESC, word) <= {COMMON}),
refs AS (SELECT lang AS lang2, {sums}, sum(n_words)::DOUBLE AS s_n FROM f WHERE lang IN (SELECT lang FROM tw) GROUP BY lang),
pool AS (SELECT {sums} FROM f),
pq AS (SELECT f.k, refs.lang2, coalesce(n.n, 0) / n_words AS p, tw.n / s_n AS q FROM f JOIN refs ON f.n_words > 0 JOIN tw ON tw.lang = refs.lang2 LEFT JOIN n ON n.k = f.k AND n.word = tw.word),
z AS (SELECT k, lang2, p, q FROM pq UNION ALL SELECT k, lang2, 1 - sum(p), 1 - sum(q) FROM pq GROUP BY k, lang2),
wd AS (SELECT k, lang2, sqrt(greatest(0, sum({term('greatest(p, 0)', 'greatest(q, 0)')}) / (2 * ln(2)))) AS wd FROM z GROUP BY k, lang2),
near AS (SELECT f.k, refs.*, wd FROM f JOIN refs ON f.lang IS NULL OR f.lang IN (SELECT lang2 FROM refs) LEFT JOIN wd ON wd.k = f.k AND wd.lang2 = refs.lang2 QUALIFY row_number() OVER (PARTITION BY f.k ORDER BY wd NULLS FIRST, refs.lang2) = 1),
b AS (SELECT f.*, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, wd, CASE WHEN word_chars > 0 THEN {char} END AS cd FROM f LEFT JOIN near ON near.k = f.k WHERE near.k IS NOT NULL
  UNION ALL SELECT f.*, n_words < 50 OR 100 * n_repeat_words > 50 * n_words, NULL, CASE WHEN word_chars > 0 THEN {plain} END FROM f CROSS JOIN pool WHERE k NOT IN (SELECT k FROM near))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, word_chars, n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND (n_chars < {MIN_CHARS} OR cd IS NULL OR cd <= {limit(CHAR_LIMIT)}) AND (n_words < {MIN_WORDS} OR wd IS NULL OR wd <= {limit(WORD_LIMIT)}) AS kept
FROM b"""


QUERIES = {"op10_quality_rules": (op10_quality_rules, _oracle())}
