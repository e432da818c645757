"""Quality rules: a threshold table compiled into one projection of built-in expressions.

Nothing here shuffles and nothing leaves the JVM: a document's words, lines and windows are arrays
within its own row, and a rule is a comparison of one named ratio with a bound.

Defined results: a null or empty text has no words (all counts 0, base_failed true, kept false);
repeated rows are judged alike, each on its own; other columns of the input are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import WORD, table

SYMBOLS = "#*$%&|<>"
# Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "the of and to in is that for it as was with be by on not he at are this have from or an they which but had his".split()
    + "der die und den von zu das mit sich des auf ist im dem nicht ein eine als auch er sie nach bei".split()
    + "de la le et les des en un du une que est pour qui dans par pas au sur ne se".split()
    + "el y los del las por con no su para es al lo como una".split()
)


@dataclass(frozen=True)
class Rule:
    """A document is rejected when its metric is below `low` or above `high`."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None


#: The production table. Metrics are the keys of `metrics`.
RULES = (
    Rule("mean_word_length", "mean_word_length", low=2.0, high=16.0),
    Rule("symbols_per_word", "symbol_ratio", high=0.25),
    Rule("shouted_words", "upper_pairs", high=1.0),
    Rule("stop_words", "stop_ratio", low=0.02),
    Rule("repeated_lines", "dup_line_ratio", high=0.50),
    Rule("repeated_windows", "repeat_word_ratio", high=0.45),
)


def text_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the exact base counts of each text (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) and n_lines, n_stop, n_upper, in place of df's columns of those names."""
    whole = F.coalesce(F.col(text), F.lit(""))
    words, windows, ordered, lines = (F.col(c) for c in ("__words", "__windows", "__ordered", "__lines"))
    n = F.size(words)
    # Each array is a column of its own, so that no lambda computes it anew for each element.
    out = df.withColumn("__words", F.regexp_extract_all(whole, F.lit(WORD), F.lit(0)))
    out = out.withColumn("__lines", F.filter(F.split(whole, "\n", -1), lambda line: line.rlike(WORD)))
    three = lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    out = out.withColumn("__windows", F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), three)))
    # Only texts with a repeated window sort their windows; in sorted order a repeated one has an equal neighbour.
    numbered = F.sort_array(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    out = out.withColumn("__ordered", F.when(F.size(F.array_distinct(windows)) < F.size(windows), numbered))
    same = lambda x, k: F.coalesce(F.get(ordered, k)["w"] == x["w"], F.lit(False))
    repeated = F.transform(ordered, lambda x, k: F.when(same(x, k - 1) | same(x, k + 1), x["i"]))
    out = out.withColumn("__starts", F.sort_array(F.array_compact(repeated)))
    covered = F.aggregate(
        F.col("__starts"),
        F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
        lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")),
        lambda a: a["n"],
    )
    without = lambda chars: sum(F.octet_length(whole) - F.octet_length(F.replace(whole, F.lit(c))) for c in chars)
    counts = {
        "n_words": n,
        "word_chars": F.length(F.array_join(words, "")),
        "n_symbols": without(SYMBOLS),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": F.coalesce(covered, F.lit(0)),
        "n_lines": F.size(lines),
        "n_stop": F.size(F.filter(words, lambda w: w.isin(*STOP_WORDS))),
        "n_upper": F.regexp_count(whole, F.lit("[A-Z]{2}")),
    }
    return out.select(*[F.col(c) for c in df.columns if c not in counts], *[v.cast("long").alias(k) for k, v in counts.items()])


def metrics() -> dict[str, Column]:
    """The named ratios that a rule may bound; null where a text has no words."""
    per_word = lambda c: F.try_divide(F.col(c).cast("double"), F.col("n_words"))
    return {
        "n_words": F.col("n_words").cast("double"),
        "mean_word_length": per_word("word_chars"),
        "symbol_ratio": per_word("n_symbols"),
        "stop_ratio": per_word("n_stop"),
        "upper_pairs": per_word("n_upper"),
        "repeat_word_ratio": per_word("n_repeat_words"),
        "dup_line_ratio": F.try_divide(F.col("n_dup_lines").cast("double"), F.col("n_lines")),
    }


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """True where no rule of the table rejects."""
    named = metrics()
    ok = F.lit(True)
    for r in rules:
        m = F.coalesce(named[r.metric], F.lit(0.0))
        if r.low is not None:
            ok = ok & (m >= F.lit(float(r.low)))
        if r.high is not None:
            ok = ok & (m <= F.lit(float(r.high)))
    return ok


def apply_rules(df: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """df with its counts, base_failed, and kept: not base_failed and no rule of the table rejects."""
    counted = text_counts(df, text)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return counted.withColumn("base_failed", failed).withColumn("kept", ~failed & verdict(rules))


COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: the counts and the verdict of every document."""
    return apply_rules(table(spark, sf_dir, "documents").select("doc_id", "text")).select(*COLUMNS)


def oracle_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The same rows in DuckDB's SQL."""
    ratio = {
        "n_words": "n_words",
        "mean_word_length": "word_chars / nullif(n_words, 0)",
        "symbol_ratio": "n_symbols / nullif(n_words, 0)",
        "stop_ratio": "n_stop / nullif(n_words, 0)",
        "upper_pairs": "n_upper / nullif(n_words, 0)",
        "repeat_word_ratio": "n_repeat_words / nullif(n_words, 0)",
        "dup_line_ratio": "n_dup_lines / nullif(n_lines, 0)",
    }
    bounds = [f"coalesce({ratio[r.metric]}, 0) {op} {bound!r}::DOUBLE" for r in rules for op, bound in ((">=", r.low), ("<=", r.high)) if bound is not None]
    stop = ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(set(STOP_WORDS)))
    return rf"""
WITH d AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
win AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM d, unnest(range(1, len(w) - 1)) AS u(i)),
rep AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win),
nxt AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nx FROM rep WHERE c >= 2),
cov AS (SELECT doc_id, sum(least(3, coalesce(nx - i, 3)))::BIGINT AS n FROM nxt GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(cov.n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines,
         len(list_filter(w, lambda x: x IN ({stop})))::BIGINT AS n_stop,
         len(regexp_extract_all(t, '[A-Z]{{2}}'))::BIGINT AS n_upper
  FROM d LEFT JOIN cov ON d.doc_id = cov.doc_id),
b AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND {' AND '.join(bounds)}) AS kept
FROM b"""
