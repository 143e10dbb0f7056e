"""Quality rules: one table of thresholds, compiled into Spark projections."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, documents, words

SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Common short words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in is that for it as was with be by on not he this are or his from at which but have an "
    "le la les de des du et en un une que qui dans pour au il est par sur elle ne pas plus avec son se "
    "der die das den dem und von zu mit ein eine ist im auf für des sich als auch nicht es an "
    "el los las del y por con para una su al lo como más o pero sus"
).split()


class Rule(NamedTuple):
    """A document keeps the rule while low <= measure <= high; None leaves a side open."""

    measure: str
    low: float | None
    high: float | None


#: Ratios are by word or by line. A text without lines or words has ratio 0.
RULES = (
    Rule("n_words", 10, None),
    Rule("mean_word_chars", 2.0, 14.0),
    Rule("symbols_per_word", None, 0.3),
    Rule("capital_word_ratio", None, 0.5),
    Rule("stop_word_ratio", 0.01, None),
    Rule("dup_line_ratio", None, 0.3),
)


#: Columns that a text is measured by.
MEASURES = "n_words word_chars n_symbols n_dup_lines n_repeat_words mean_word_chars symbols_per_word capital_word_ratio stop_word_ratio dup_line_ratio".split()


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs and the measures of its whole texts, which take the place of columns of their names; each
    array is a column of its own before it is used again, so that no projection computes it twice."""
    kept = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col(text_col).alias("_text"))
    names = [c for c in docs.columns if c.lower() not in MEASURES]
    return _measures(kept).select(*(F.col("_row").getField(c).alias(c) for c in names), *MEASURES)


def _measures(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("_text"), F.lit(""))
    parts = docs.withColumns(
        {
            "_words": words(F.col("_text")),
            "_lines": F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
            "word_chars": F.length(F.translate(text, SPACES, "")).cast("long"),
            "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        }
    )
    counted = parts.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "_n_lines": F.size("_lines"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_stops": F.size(F.filter("_words", lambda w: F.lower(w).isin(STOP_WORDS))),
            "_capitals": F.size(F.filter("_words", lambda w: (F.upper(w) == w) & (F.lower(w) != w) & (F.length(w) > 1))),
            "_hash": F.transform("_words", lambda w: F.xxhash64(w)),
        }
    ).drop("_words", "_lines")

    def ahead(name: str, n: int) -> Column:
        return F.slice(name, n + 1, F.size(name))

    # hash of the words i, i+1, then of i .. i+3, then of i .. i+4; ends without a whole window are cut off
    pair = counted.withColumn("_pair", F.zip_with("_hash", ahead("_hash", 1), lambda a, b: F.xxhash64(a, b)))
    four = pair.withColumn("_four", F.zip_with("_pair", ahead("_pair", 2), lambda a, b: F.xxhash64(a, b)))
    five = four.withColumn("_five", F.slice(F.zip_with("_four", ahead("_hash", 4), lambda a, b: F.xxhash64(a, b)), F.lit(1), F.greatest(F.col("n_words") - (WINDOW - 1), F.lit(0)).cast("int"))).drop("_hash", "_pair", "_four")
    # windows sorted by hash, only where a text has some twice
    twice = five.withColumn("_twice", F.size(F.array_distinct("_five")) < F.size("_five"))
    ordered = twice.withColumn("_order", F.when(F.col("_twice"), F.sort_array(F.transform("_five", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("_five", "_twice")
    same = ordered.withColumn("_same", F.zip_with("_order", ahead("_order", 1), lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))))
    flagged = same.withColumn("_flag", F.zip_with("_same", F.concat(F.array(F.lit(False)), "_same"), lambda a, b: a | b)).drop("_same")
    places = flagged.withColumn("_at", F.sort_array(F.transform(F.filter(F.zip_with("_order", "_flag", lambda o, f: F.struct(o["i"].alias("i"), f.alias("f"))), lambda x: x["f"]), lambda x: x["i"]))).drop("_order", "_flag")
    steps = F.zip_with("_at", ahead("_at", 1), lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW)).cast("long"))
    covered = F.coalesce(F.aggregate(steps, F.lit(0).cast("long"), lambda s, x: s + x), F.lit(0).cast("long"))
    n = F.col("n_words")
    return places.withColumns(
        {
            "n_repeat_words": covered,
            "mean_word_chars": _ratio(F.col("word_chars"), n),
            "symbols_per_word": _ratio(F.col("n_symbols"), n),
            "capital_word_ratio": _ratio(F.col("_capitals"), n),
            "stop_word_ratio": _ratio(F.col("_stops"), n),
            "dup_line_ratio": _ratio(F.col("n_dup_lines"), F.col("_n_lines")),
        }
    ).drop("_at", "_stops", "_capitals", "_n_lines")


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """All rules as one boolean expression."""
    kept = F.lit(True)
    for r in rules:
        if r.low is not None:
            kept &= F.col(r.measure) >= r.low
        if r.high is not None:
            kept &= F.col(r.measure) <= r.high
    return kept


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """docs with measures, base_failed and kept.

    One narrow pass, no shuffle and no user function. base_failed: under 10 words, or over 20% of
    the words in 5-word windows that occur twice or more in the text. kept: not base_failed, and
    within every rule. Null, empty or blank text: all measures 0, base_failed. Repeated rows are
    judged alike, and a text of any length as a whole; other columns pass through, but those named like a
    measure, base_failed or kept are replaced. An empty table gives none.
    """
    # always true, and it keeps a filter on kept above the measures: pushed down, its expression would
    # hold all of theirs many times over
    here = F.spark_partition_id() >= 0
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return measure(docs, text_col).withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & verdict(rules) & here)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql_verdict() -> str:
    return " AND ".join(x for r in RULES for x in ([f"{r.measure} >= {r.low}"] * (r.low is not None) + [f"{r.measure} <= {r.high}"] * (r.high is not None)))


OP9_SQL = f"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS x,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS l
  FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, w FROM t WHERE len(w) >= 5),
h AS (SELECT doc_id, i, array_to_string(w[i:i+4], ' ') AS g FROM g),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM h),
p AS (SELECT DISTINCT doc_id, unnest(range(i, i + 5)) AS j FROM r WHERE c > 1),
c AS (SELECT doc_id, count(*) AS n_repeat_words FROM p GROUP BY doc_id),
m AS (SELECT doc_id, len(w) AS n_words, len(array_to_string(w, '')) AS word_chars,
    len(x) - len(translate(x, '{SYMBOLS}', '')) AS n_symbols,
    len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    len(w) AS d, len(l) AS nl,
    len(list_filter(w, lambda v: list_contains([{', '.join(repr(x) for x in STOP_WORDS)}], lower(v)))) AS s,
    len(list_filter(w, lambda v: upper(v) = v AND lower(v) <> v AND len(v) > 1)) AS u
  FROM t LEFT JOIN c USING (doc_id)),
q AS (SELECT *, CASE WHEN d > 0 THEN word_chars / d ELSE 0 END AS mean_word_chars,
    CASE WHEN d > 0 THEN n_symbols / d ELSE 0 END AS symbols_per_word, CASE WHEN d > 0 THEN u / d ELSE 0 END AS capital_word_ratio,
    CASE WHEN d > 0 THEN s / d ELSE 0 END AS stop_word_ratio, CASE WHEN nl > 0 THEN n_dup_lines / nl ELSE 0 END AS dup_line_ratio,
    n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND {_sql_verdict()} AS kept FROM q
"""
