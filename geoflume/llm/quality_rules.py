"""Quality rules: fixed limits, then robust multivariate outliers within each language and source.

DataFrame functions only. A text is read once: its counts are worked out within its
row (windows of words by sorting their hashes inside the row), so no text or word is
shuffled. Counts become five statistics that don't grow with the length of a text,
shrunk towards usual values for short ones, transformed (square roots of shares, a
logarithm) and rounded to hundredths. Documents with equal statistics are counted
together first, so everything after works on distinct vectors with counts.

The minimum-covariance-determinant estimate of each (lang, source) starts at medians
and absolute deviations and takes ``STEPS`` concentration steps. A step deals each
vector to a level of its distance (sixteenths of its logarithm), adds up counts, sums
and cross-products by group and level, and keeps the levels up to the one that holds
the ``HALF`` n-th smallest distance: mean and covariance of those are the next
estimate. So a step is one aggregation with partial sums, and a window over at most
a few thousand levels a group; sums are whole numbers, the result doesn't hang on
their order. Covariances are made consistent for normal data and get ``FLOOR``
squared on the diagonal (statistics that are 0 nearly everywhere have none of their
own). A document is kept if its squared distance is at most the chi-square quantile
that a share ``TAIL`` of normal vectors exceeds (small, as shares have long tails). Groups of under ``FEWEST`` documents
are judged by the estimate over all groups.

The same expressions, written once as SQL, run in Spark and in the oracle.

Defined cases: a null or empty text has no words and fails the fixed limits; these
documents aren't fitted; null languages and sources are groups of their own; each row
is judged by itself, so repeated rows and shared or null doc_ids are no matter; equal
distances are kept or left together; windows of words are told apart by 64-bit hashes
within their text; other columns have no effect; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from geoflume.llm._common import cut, table

HALF, STEPS, FEWEST, TAIL, WINDOW = 0.75, 6, 50, 1e-10, 8
MIN_WORDS, MAX_REPEAT = 20, 30
_SPACE = " \t\n\x0b\x0c\r"
_WS = r"[\x20\x09-\x0D]"

#: Each statistic as SQL over the counts, and the standard deviation (in hundredths) that it has at least.
STATISTICS = (
    ("sqrt(CAST(n_symbols AS DOUBLE) / (word_chars + 500))", 2.5),
    ("sqrt(CAST(n_repeat_words AS DOUBLE) / (n_words + 100))", 8.0),
    ("sqrt(CAST(n_dup_lines AS DOUBLE) / (n_lines + 10))", 8.0),
    ("ln(CAST(word_chars + 250 AS DOUBLE) / (n_words + 50))", 3.0),
    ("sqrt(CAST(n_odd AS DOUBLE) / (word_chars + 100))", 3.0),
)
D = range(len(STATISTICS))
_PAIRS = [(i, j) for i in D for j in range(i + 1)]
GROUP = ("lang", "source", "pooled")


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value worked out once, however often f names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """How many of the words are in windows of so many that are found twice or more in the array."""

    def covered(hashes: Column) -> Column:
        order = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            same = lambda k, by: F.coalesce(F.get(s, k).getField("h") == F.get(s, k + by).getField("h"), F.lit(False))
            twice = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: same(k, -1) | same(k, 1))
            return F.sort_array(F.transform(twice, lambda k: F.get(s, k).getField("i")))

        def add(a: Column, i: Column) -> Column:
            return F.struct((a.getField("n") + F.least(F.lit(window), i - a.getField("last"))).alias("n"), i.alias("last"))

        found = F.aggregate(_let(order, starts), F.struct(F.lit(0).alias("n"), F.lit(-window).alias("last")), add, lambda a: a.getField("n"))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(found)

    def windows(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(1), F.size(w) - window + 1), lambda i: F.xxhash64(F.slice(w, i, window)))
        return F.when(F.size(w) < window, 0).otherwise(_let(hashes, covered))

    return _let(words, windows).cast("long")


def counts(documents: DataFrame) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_odd of each row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    spaced = F.regexp_replace(F.btrim(text, F.lit(_SPACE)), f"{_WS}+", " ")

    def measure(s: Column) -> Column:
        solid = F.replace(s, F.lit(" "), F.lit(""))
        return F.struct(
            F.when(s == "", 0).otherwise(F.length(s) - F.length(solid) + 1).cast("long").alias("n_words"),
            F.length(solid).cast("long").alias("word_chars"),
            (F.length(s) - F.length(F.regexp_replace(s, r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
            (F.length(solid) - F.length(F.regexp_replace(solid, r"[\p{Lu}\p{P}\p{S}\p{N}]+", ""))).cast("long").alias("n_odd"),
            repeated_words(F.split(s, " ")).alias("n_repeat_words"),
        )

    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(_SPACE)) != "")
    line_counts = _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), _let(spaced, measure).alias("m"), line_counts.alias("l"))
    return rows.select("doc_id", "lang", "source", "m.n_words", "m.word_chars", "m.n_symbols", "l.n_dup_lines", "m.n_repeat_words", "l.n_lines", "m.n_odd")


def chi2_quantile(p: float, df: int) -> float:
    """The value that a chi-square variable of df degrees stays under with chance p."""
    low, high = 0.0, 1e4
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, df) < p else (low, mid)
    return (low + high) / 2


def chi2_cdf(x: float, df: int) -> float:
    a, term, total = df / 2, 1.0, 1.0
    for k in range(1, 2000):
        term *= x / 2 / (a + k)
        total += term
    return total * math.exp(a * math.log(x / 2) - x / 2 - math.lgamma(a + 1)) if x > 0 else 0.0


#: Covariance of the nearest HALF of normal vectors, times this, is that of all.
FACTOR = HALF / chi2_cdf(chi2_quantile(HALF, len(D)), len(D) + 2)
CUTOFF = chi2_quantile(1 - TAIL, len(D))

# Expressions for both engines; a later one may name an earlier one's alias.
_BASE = f"(n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words) AS base_failed"
_STATS = [f"CAST(floor(100 * {sql} + 0.5) AS BIGINT) AS x{i}" for i, (sql, _) in enumerate(STATISTICS)]
#: Sums over vectors with count c.
_SUMS = ["CAST(sum(c) AS BIGINT) AS n", *(f"CAST(sum(c * x{i}) AS BIGINT) AS s{i}" for i in D), *(f"CAST(sum(c * x{i} * x{j}) AS BIGINT) AS s{i}_{j}" for i, j in _PAIRS)]
_SUMMED = ["n", *(f"s{i}" for i in D), *(f"s{i}_{j}" for i, j in _PAIRS)]


def _factors() -> list[str]:
    """A covariance v (lower triangle) as L * diag(d) * L'."""
    out = []
    for i, j in _PAIRS:
        rest = "".join(f" - l{i}_{k} * l{j}_{k} * d{k}" if i != j else f" - l{i}_{k} * l{i}_{k} * d{k}" for k in range(j))
        out.append(f"v{i}_{j}{rest} AS d{i}" if i == j else f"(v{i}_{j}{rest}) / d{j} AS l{i}_{j}")
    return out


_MODEL = [*(f"m{i}" for i in D), *(f"d{i}" for i in D), *(f"l{i}_{j}" for i, j in _PAIRS if i != j)]
_MOMENTS = [
    *(f"CAST(s{i} AS DOUBLE) / n AS m{i}" for i in D),
    *(f"(CAST(s{i}_{j} AS DOUBLE) / n - m{i} * m{j}) * CAST({FACTOR!r} AS DOUBLE)" + f" + {STATISTICS[i][1] ** 2!r}" * (i == j) + f" AS v{i}_{j}" for i, j in _PAIRS),
    *_factors(),
]
_START = [*(f"CAST(med{i} AS DOUBLE) AS m{i}" for i in D), *(f"CAST(1.4826 AS DOUBLE) * mad{i} * mad{i} * 1.4826 + {STATISTICS[i][1] ** 2!r} AS d{i}" for i in D), *(f"CAST(0 AS DOUBLE) AS l{i}_{j}" for i, j in _PAIRS if i != j)]
_DISTANCE = [*(f"x{i} - m{i}" + "".join(f" - l{i}_{k} * z{k}" for k in range(i)) + f" AS z{i}" for i in D), " + ".join(f"z{i} * z{i} / d{i}" for i in D) + " AS dist"]
_LEVEL = "CAST(floor(16 * ln(dist + 0.000001)) AS INT) AS level"


#: Groups of a model up to which it is broadcast.
FEW = 100_000


def _few(groups: DataFrame) -> bool:
    return groups.limit(FEW + 1).count() <= FEW


def _beside(rows: DataFrame, model: DataFrame, few: bool, *columns: str) -> DataFrame:
    """The rows with columns of their group's model, which is broadcast if its rows, counted by the caller, are few."""
    named = model.select(*[F.col(c).alias(f"g_{c}") for c in GROUP], *(columns or _MODEL))
    return rows.join(F.broadcast(named) if few else named, F.expr(" AND ".join(f"{c} <=> g_{c}" for c in GROUP))).drop(*[f"g_{c}" for c in GROUP])


def vectors(rows: DataFrame) -> DataFrame:
    """lang, source, pooled, x0 .., c: the distinct statistics of each group and of all groups together, with counts."""
    xs = [f"x{i}" for i in D]
    own = rows.groupBy("lang", "source", *xs).agg(F.count("*").alias("c")).withColumn("pooled", F.lit(False))
    own = cut(own.select(*GROUP, *xs, "c"))
    every = own.groupBy(*xs).agg(F.sum("c").alias("c")).select(*[F.lit(None).cast("string").alias(c) for c in ("lang", "source")], F.lit(True).alias("pooled"), *xs, "c")
    return cut(own.unionByName(every))


def estimates(cells: DataFrame, half: float = HALF, steps: int = STEPS) -> DataFrame:
    """The model of each group of vectors(): m (means), d and l (factors of the covariance), size."""
    middle = cut(cells.groupBy(*GROUP).agg(F.sum("c").alias("size"), *[F.percentile(f"x{i}", F.lit(0.5), F.col("c")).alias(f"med{i}") for i in D]))
    few = _few(middle)
    near = _beside(cells, middle, few, "size", *[f"med{i}" for i in D])
    near = near.groupBy(*GROUP).agg(F.first("size").alias("size"), *[F.first(f"med{i}").alias(f"med{i}") for i in D], *[F.percentile(F.abs(F.col(f"x{i}") - F.col(f"med{i}")), F.lit(0.5), F.col("c")).alias(f"mad{i}") for i in D])
    model = cut(near.selectExpr(*GROUP, "size", *_START))
    up_to = W.partitionBy(*GROUP).orderBy("level").rowsBetween(W.unboundedPreceding, 0)
    for _ in range(steps):
        dealt = _beside(cells, model, few).selectExpr("*", *_DISTANCE).selectExpr("*", _LEVEL)
        levels = dealt.groupBy(*GROUP, "level").agg(*[F.expr(e) for e in _SUMS])
        levels = levels.select(*GROUP, "level", F.col("n").alias("here"), F.sum("n").over(W.partitionBy(*GROUP)).alias("size"), *[F.sum(c).over(up_to).alias(c) for c in _SUMMED])
        due = F.ceil(F.lit(half) * F.col("size"))
        model = cut(levels.filter((F.col("n") >= due) & (F.col("n") - F.col("here") < due)).selectExpr(*GROUP, "size", *_MOMENTS).select(*GROUP, "size", *_MODEL))
    return model


def judged(documents: DataFrame, half: float = HALF, steps: int = STEPS, fewest: int = FEWEST, cutoff: float = CUTOFF) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance (squared; null where base_failed)."""
    rows = cut(counts(documents).selectExpr("*", _BASE, *_STATS))
    sized = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    model = estimates(vectors(rows.filter("NOT base_failed")), half, steps)
    small = model.filter(~F.col("pooled") & (F.col("size") < fewest)).select("lang", "source", "pooled", "size")
    whole = model.filter("pooled").select(*_MODEL).first() or [None] * len(_MODEL)  # one row; none if there are no groups either
    used = model.filter(~F.col("pooled") & (F.col("size") >= fewest)).select(*GROUP, "size", *_MODEL)
    used = cut(used.unionByName(small.select("*", *[F.lit(x).cast("double").alias(m) for x, m in zip(whole, _MODEL)])))
    passed = _beside(rows.filter("NOT base_failed").withColumn("pooled", F.lit(False)), used, _few(used)).selectExpr("*", *_DISTANCE)
    passed = passed.select(*sized, (F.col("dist") <= F.lit(cutoff)).alias("kept"), F.col("dist").alias("distance"))
    failed = rows.filter("base_failed").select(*sized, F.lit(False).alias("kept"), F.lit(None).cast("double").alias("distance"))
    return passed.unionByName(failed)


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents")).drop("distance")


def _oracle() -> str:
    model = ", ".join(_MODEL)
    join = " AND ".join(f"a.{c} IS NOT DISTINCT FROM b.{c}" for c in GROUP)
    group, xs = ", ".join(GROUP), ", ".join(f"x{i}" for i in D)
    steps = []
    for k in range(STEPS):
        steps.append(f"""
dist{k} AS (SELECT a.*, {", ".join(f"b.{m}" for m in _MODEL)} FROM cells a JOIN model{k} b ON {join}),
level{k} AS (SELECT *, {_LEVEL} FROM (SELECT *, {", ".join(_DISTANCE)} FROM dist{k})),
sums{k} AS (SELECT {group}, level, {", ".join(_SUMS)} FROM level{k} GROUP BY {group}, level),
cums{k} AS (
  SELECT {group}, n AS here, sum(n) OVER (PARTITION BY {group}) AS size, {", ".join(f"sum({c}) OVER (PARTITION BY {group} ORDER BY level) AS {c}" for c in _SUMMED if c != "n")},
    sum(n) OVER (PARTITION BY {group} ORDER BY level) AS up
  FROM sums{k}
),
model{k + 1} AS MATERIALIZED (
  SELECT {group}, size, {model} FROM (SELECT *, {", ".join(_MOMENTS)} FROM (SELECT * EXCLUDE (up), up AS n FROM cums{k} WHERE up >= ceil({HALF} * size) AND up - here < ceil({HALF} * size)))
)""")
    return rf"""
WITH base AS (
  SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
),
words AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM base WHERE len(w) >= {WINDOW}),
wins AS (
  SELECT r, i, concat_ws(' ', word, {", ".join(f"lead(word, {k}) OVER o" for k in range(1, WINDOW))}) AS k
  FROM words WINDOW o AS (PARTITION BY r ORDER BY i) QUALIFY lead(word, {WINDOW - 1}) OVER o IS NOT NULL
),
twice AS (SELECT r, i FROM wins QUALIFY count(*) OVER (PARTITION BY r, k) > 1),
rep AS (
  SELECT r, sum(g)::BIGINT AS n_repeat_words
  FROM (SELECT r, least({WINDOW}, i - coalesce(lag(i) OVER (PARTITION BY r ORDER BY i), -{WINDOW})) AS g FROM twice) GROUP BY r
),
counted AS (
  SELECT r, doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (length(array_to_string(w, '')) - length(regexp_replace(array_to_string(w, ''), '[\p{{Lu}}\p{{P}}\p{{S}}\p{{N}}]', '', 'g')))::BIGINT AS n_odd,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM base
),
rows_ AS MATERIALIZED (
  SELECT *, {_BASE}, {", ".join(_STATS)}
  FROM (SELECT * EXCLUDE (l, n_repeat_words), len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM counted LEFT JOIN rep USING (r))
),
ok AS (
  SELECT lang, source, false AS pooled, {xs} FROM rows_ WHERE NOT base_failed
  UNION ALL SELECT NULL, NULL, true, {xs} FROM rows_ WHERE NOT base_failed
),
cells AS MATERIALIZED (SELECT {group}, {xs}, count(*)::BIGINT AS c FROM ok GROUP BY ALL),
middle AS MATERIALIZED (SELECT {group}, count(*) AS size, {", ".join(f"quantile_cont(x{i}, 0.5) AS med{i}" for i in D)} FROM ok GROUP BY {group}),
model0 AS MATERIALIZED (
  SELECT {group}, size, {model} FROM (SELECT *, {", ".join(_START)} FROM (
    SELECT {", ".join(f"a.{c}" for c in GROUP)}, any_value(size) AS size, {", ".join(f"any_value(med{i}) AS med{i}, quantile_cont(abs(x{i} - med{i}), 0.5) AS mad{i}" for i in D)}
    FROM ok a JOIN middle b ON {join} GROUP BY ALL))
),{",".join(steps)},
used AS (
  SELECT a.lang, a.source, {", ".join(f"CASE WHEN a.size < {FEWEST} THEN b.{m} ELSE a.{m} END AS {m}" for m in _MODEL)} FROM model{STEPS} a, model{STEPS} b WHERE NOT a.pooled AND b.pooled
),
far AS (
  SELECT *, {", ".join(_DISTANCE)} FROM (SELECT a.*, {", ".join(f"b.{m}" for m in _MODEL)} FROM rows_ a LEFT JOIN used b ON NOT a.base_failed AND a.lang IS NOT DISTINCT FROM b.lang AND a.source IS NOT DISTINCT FROM b.source)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, coalesce(NOT base_failed AND dist <= {CUTOFF!r}, false) AS kept FROM far"""


QUERIES = {"op11_quality_rules": op11_quality_rules}
ORACLE = {"op11_quality_rules": _oracle()}
