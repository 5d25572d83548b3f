r"""Quality rules with adaptive thresholds from mergeable quantile sketches, one for each language, source and metric.

Native: DataFrame functions only. Each document's counts are taken once and written to the shared folder. A sketch is a table of counts by
logarithmic bucket (relative error GAMMA - 1 over 2, exact zeros), so sketches merge by adding counts, in any order
and with the same result; the sketch of a language is the sum of its sources', that of the corpus the sum of all. A group
of n documents has the threshold (n * own + prior * parent's) / (n + prior): a small group leans on its language, a language on the corpus, and
no document more or less changes that at a stroke.

A sketch's own threshold is q75 + spread * (q75 - q25): it follows the bulk of the group, and no cutoff is added to it. A document is rejected if it fails the
base rules or one metric exceeds its group's threshold by more than chance: a document of n units that keeps to a rate t shows up to
n * t + z * sqrt(n * t + z^2 / 4) + z^2 / 2 events (the upper end of the score interval of a Poisson count). So a short text, or one of a group in which nearly all
documents agree (t = 0), is not rejected for an event or two, and the longer a text is, the nearer it is held to the threshold itself.

Metrics: symbols (of #*$%&|<> per word), caps (capital letters A-Z per character of a word), bangs (! per word), repeats (words in repeated 5-word windows per
word), dup_lines (repeated lines per line), word_len (characters per word). Units are words, characters or lines; of words in repeated windows 25 are taken as one event (a sentence
and its copy), as they never come singly.

Edge cases: null and empty texts have no words, hence fail the base rules; they take no part in the sketches. Null languages and sources are groups of
their own. Texts are taken whole, very long ones too; repeated rows and ids are judged each by itself, ties (a value equal to its threshold) are kept. An empty table
gives none. rules() keeps documents' other columns, whatever their names, but for one named as `as_`, which its result takes the place of.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import saved, table

WORD, SPACE, SYMBOL = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]", r"[#*$%&|<>]"
SIZE = 5
GAMMA = 1.02
ZERO = -(1 << 30)
#: Metric: how many of what it counts make one event.
METRICS = {"symbols": 1, "caps": 1, "bangs": 1, "repeats": 25, "dup_lines": 1, "word_len": 1}
SPREAD, PRIOR, Z = 3.0, 20, 2.0


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    """Words in windows of SIZE that occur twice or more. Sorting is left to texts in which some window repeats."""
    window = lambda i: F.xxhash64(*(words[i + k] for k in range(SIZE)))
    starts = F.sequence(F.lit(0), F.size(words) - SIZE)

    def repeated(sorted_: Column) -> Column:
        near = lambda k: F.coalesce(F.get(sorted_, k)["h"], F.lit(None).cast("long"))
        same = F.filter(sorted_, lambda x, k: F.coalesce(x["h"] == near(k - 1), F.lit(False)) | F.coalesce(x["h"] == near(k + 1), F.lit(False)))
        return let(F.sort_array(F.transform(same, lambda x: x["i"])), lambda at: F.aggregate(F.transform(at, lambda p, k: F.least(F.lit(SIZE), F.coalesce(F.get(at, k + 1) - p, F.lit(SIZE)))), F.lit(0), lambda a, b: a + b))

    def counted(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), repeated))

    return F.when(F.size(words) < SIZE, F.lit(0)).otherwise(let(F.transform(starts, window), counted))


def counts(text: Column) -> Column:
    """A struct of one text's counts; null counts as empty."""
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(WORD))
    n = lambda rx: F.regexp_count(whole, F.lit(rx)).cast("long")
    of_words = let(F.regexp_extract_all(whole, F.lit(WORD), F.lit(0)), lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeat_words(w).cast("long").alias("repeats")))
    of_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dups")))
    return F.struct(
        of_words.alias("words"), of_lines.alias("lines"), (F.length(whole) - n(SPACE)).cast("long").alias("word_chars"), n(SYMBOL).alias("n_symbols"), n("[A-Z]").alias("n_caps"), n("!").alias("n_bangs")
    )


def _measures(c: Column) -> dict[str, Column]:
    per = lambda x, of: F.when(of > 0, x / of)
    n = c["words"]["n"]
    return {
        "symbols": per(c["n_symbols"], n), "caps": per(c["n_caps"], c["word_chars"]), "bangs": per(c["n_bangs"], n), "repeats": per(c["words"]["repeats"], n),
        "dup_lines": per(c["lines"]["dups"], c["lines"]["n"]), "word_len": per(c["word_chars"], n),
    }


def _units(c: Column) -> dict[str, Column]:
    """What each metric is a rate of."""
    return {k: c["word_chars"] if k == "caps" else c["lines"]["n"] if k == "dup_lines" else c["words"]["n"] for k in METRICS}


def chance(limit: Column, units: Column, z: float = Z) -> Column:
    """By how much a document of so many units exceeds a rate by chance."""
    return (z * F.sqrt(units * limit + z * z / 4) + z * z / 2) / units


def base_failed(c: Column) -> Column:
    n = c["words"]["n"]
    return (n < 10) | (100 * c["words"]["repeats"] > 20 * n)


def sketches(counted: DataFrame, as_: str) -> DataFrame:
    """lang, source, metric, bucket, n: the mergeable sketches of all documents with words."""
    pairs = F.array(*(F.struct(F.lit(k).alias("metric"), v.alias("x")) for k, v in _measures(F.col(as_)).items()))
    bucket = F.when(F.col("m.x") > 0, F.ceil(F.round(F.ln("m.x") / F.ln(F.lit(GAMMA)), 9)).cast("int")).otherwise(F.lit(ZERO))
    rows = counted.select("lang", "source", F.explode(pairs).alias("m")).where("m.x is not null")
    return rows.groupBy("lang", "source", F.col("m.metric").alias("metric"), bucket.alias("bucket")).agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, *by: str) -> DataFrame:
    """Sketches with the same `by` added up."""
    return sketch.groupBy(*by, "metric", "bucket").agg(F.sum("n").alias("n"))


def limits(sketch: DataFrame, *by: str, spread: float = SPREAD) -> DataFrame:
    """by, n, and a threshold for each metric."""
    group = Window.partitionBy(*by, "metric")
    value = F.when(F.col("bucket") == ZERO, F.lit(0.0)).otherwise(2 * F.pow(F.lit(GAMMA), F.col("bucket")) / (1 + GAMMA))
    ranked = sketch.withColumns({"up_to": F.sum("n").over(group.orderBy("bucket")), "total": F.sum("n").over(group), "v": value})
    q = lambda share: F.min(F.when(F.col("up_to") >= F.ceil(F.col("total") * share), F.col("v")))
    each = ranked.groupBy(*by, "metric").agg(F.max("total").alias("n"), q(0.25).alias("q1"), q(0.75).alias("q3"))
    limit = F.col("q3") + spread * (F.col("q3") - F.col("q1"))
    return each.groupBy(*by).agg(F.max("n").alias("n"), *(F.max(F.when(F.col("metric") == k, limit)).alias(k) for k in METRICS))


def thresholds(sketch: DataFrame, prior: int = PRIOR, spread: float = SPREAD) -> DataFrame:
    """A row for each language and source: its thresholds, leaning on its language's and the corpus' as much as `prior` documents of theirs weigh."""
    sketch = saved(sketch, "sketch")
    own = limits(sketch, "lang", "source", spread=spread).alias("o")
    lang = limits(merged(sketch, "lang"), "lang", spread=spread).alias("l")
    every = limits(merged(sketch.withColumn("every", F.lit(1)), "every"), "every", spread=spread).alias("e")
    joined = own.join(lang, F.col("o.lang").eqNullSafe(F.col("l.lang")), "left").join(F.broadcast(every), F.lit(True), "left")  # `every` is one row
    lean = lambda p, k, parent: (F.col(f"{p}.n") * F.col(f"{p}.{k}") + prior * parent) / (F.col(f"{p}.n") + prior)
    return joined.select(F.col("o.lang").alias("lang"), F.col("o.source").alias("source"), *(lean("o", k, lean("l", k, F.col(f"e.{k}"))).alias(k) for k in METRICS))


def rules(docs: DataFrame, as_: str = "quality", text: str = "text", keep: tuple[str, ...] | None = None, prior: int = PRIOR, spread: float = SPREAD, z: float = Z) -> DataFrame:
    """docs (or their columns `keep`) with a struct `as_`: counts, base_failed, limits and kept."""
    names = [c for c in keep or docs.columns if c != as_]
    row = docs.select(F.struct(*names).alias("row"), F.col("lang").alias("lang"), F.col("source").alias("source"), counts(F.col(text)).alias("c"))
    counted = saved(row, "counts")
    found = saved(thresholds(sketches(counted, "c"), prior, spread), "thresholds")  # read back, so that its size decides how it is joined
    t = found.select(F.col("lang").alias("t_lang"), F.col("source").alias("t_source"), F.struct(*METRICS).alias("limits"))
    joined = counted.join(t, F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source")), "left")
    over, units = F.lit(False), _units(F.col("c"))
    for k, v in _measures(F.col("c")).items():
        limit = F.col("limits")[k]
        over = over | F.coalesce(v > limit + chance(limit, units[k] / METRICS[k], z), F.lit(False))
    fields = [F.col("c")[k].alias(k) for k in ("words", "lines", "word_chars", "n_symbols", "n_caps", "n_bangs")]
    failed = base_failed(F.col("c"))
    out = F.struct(*fields, "limits", failed.alias("base_failed"), (~failed & ~over).alias("kept"))
    return joined.select(*(F.col("row")[c].alias(c) for c in names), out.alias(as_))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rules(table(spark, sf_dir, "documents"), "q", keep=("doc_id",))
    return out.select("doc_id", F.col("q.words.n").alias("n_words"), "q.word_chars", "q.n_symbols", F.col("q.lines.dups").alias("n_dup_lines"), F.col("q.words.repeats").alias("n_repeat_words"), "q.base_failed", "q.kept")


def _sql() -> str:
    measures = {"symbols": "n_symbols / nullif(n_words, 0)", "caps": "n_caps / nullif(word_chars, 0)", "bangs": "n_bangs / nullif(n_words, 0)", "repeats": "n_repeat_words / nullif(n_words, 0)", "dup_lines": "n_dup_lines / nullif(n_lines, 0)", "word_len": "word_chars / nullif(n_words, 0)"}
    units = {"caps": "word_chars", "dup_lines": "n_lines", "repeats": f"n_words / {METRICS['repeats']}"}
    quantiles = lambda by, src: f"""SELECT {by}, metric, max(total) AS n, min(v) FILTER (up_to >= ceil(total * 0.25)) AS q1, min(v) FILTER (up_to >= ceil(total * 0.75)) AS q3 FROM (
    SELECT *, sum(n) OVER (PARTITION BY {by}, metric ORDER BY bucket) AS up_to, sum(n) OVER (PARTITION BY {by}, metric) AS total,
      CASE WHEN bucket = {ZERO} THEN 0.0::DOUBLE ELSE 2 * pow({GAMMA}::DOUBLE, bucket) / (1 + {GAMMA}::DOUBLE) END AS v FROM {src}) GROUP BY {by}, metric"""  # noqa: E731
    limit = lambda p: f"({p}.q3 + {SPREAD}::DOUBLE * ({p}.q3 - {p}.q1))"
    return f"""
WITH w AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
x AS (SELECT *, row_number() OVER () AS id, len(ws) AS n_words FROM w),
win AS (SELECT id, i, list_aggregate(ws[i:i+4], 'string_agg', ' ') AS g FROM (SELECT id, ws, unnest(range(1, n_words - 3)) AS i FROM x WHERE n_words >= 5)),
rep AS (SELECT id, i, count(*) OVER (PARTITION BY id, g) AS c FROM win),
cov AS (SELECT id, sum(least(5, coalesce(nxt - i, 5))) AS n FROM (SELECT id, i, lead(i) OVER (PARTITION BY id ORDER BY i) AS nxt FROM rep WHERE c > 1) GROUP BY id),
c AS (SELECT x.id, doc_id, lang, source, n_words, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
  length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_caps, length(t) - length(replace(t, '!', '')) AS n_bangs,
  list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS ls FROM x LEFT JOIN cov USING (id)),
d AS (SELECT *, len(ls) AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines FROM c),
m AS ({' UNION ALL '.join(f"SELECT id, lang, source, '{k}' AS metric, ({v})::DOUBLE AS v, ({units.get(k, 'n_words')})::DOUBLE AS u FROM d" for k, v in measures.items())}),
s AS (SELECT lang, source, 1 AS every, metric, CASE WHEN v > 0 THEN ceil(round(ln(v) / ln({GAMMA}::DOUBLE), 9))::INT ELSE {ZERO} END AS bucket, count(*) AS n FROM m WHERE v IS NOT NULL GROUP BY ALL),
o AS ({quantiles('lang, source', 's')}), l AS ({quantiles('lang', '(SELECT lang, metric, bucket, sum(n) AS n FROM s GROUP BY ALL)')}), e AS ({quantiles('every', '(SELECT every, metric, bucket, sum(n) AS n FROM s GROUP BY ALL)')}),
size AS (SELECT lang, source, max(n) AS n FROM o GROUP BY ALL), lsize AS (SELECT lang, max(n) AS n FROM l GROUP BY ALL),
t AS (SELECT o.lang, o.source, o.metric, (size.n * {limit('o')} + {PRIOR} * ((lsize.n * {limit('l')} + {PRIOR} * {limit('e')}) / (lsize.n + {PRIOR}))) / (size.n + {PRIOR}) AS lim
  FROM o JOIN size ON o.lang IS NOT DISTINCT FROM size.lang AND o.source IS NOT DISTINCT FROM size.source JOIN lsize ON o.lang IS NOT DISTINCT FROM lsize.lang
  JOIN l ON o.lang IS NOT DISTINCT FROM l.lang AND o.metric = l.metric JOIN e ON o.metric = e.metric),
bad AS (SELECT DISTINCT m.id FROM m JOIN t ON m.lang IS NOT DISTINCT FROM t.lang AND m.source IS NOT DISTINCT FROM t.source AND m.metric = t.metric WHERE m.v > t.lim + ({Z}::DOUBLE * sqrt(m.u * t.lim + {Z * Z / 4}::DOUBLE) + {Z * Z / 2}::DOUBLE) / m.u)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND id NOT IN (SELECT id FROM bad) AS kept FROM d"""


SQL = {"op10_quality_rules": _sql()}
