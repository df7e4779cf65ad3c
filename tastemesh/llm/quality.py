"""Quality rules with verdicts by host, in SQL functions only.

Each document is measured in its own row: nothing of a text is shuffled. Rule failures are counted by host
(``source``) and rule; a host's rate is shrunk towards the corpus rate by a beta prior whose strength comes
from the spread between hosts (method of moments), so a host of few documents is not judged by chance. A host is

* ``reject``: one rule fails so often that the rate less two posterior deviations exceeds ``reject_rate``;
  all its documents go;
* ``strict``: the rate less two deviations exceeds ``strict_factor`` times the corpus rate and ``strict_floor``;
  its documents must pass every rule;
* ``normal``: only the base rules (too short, too repetitive) decide.

Edge cases: a null text has no words and fails; documents without ``source`` form a host of their own; equal rows
each count and get a row; other columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastemesh.llm.exprs import let, positions, words
from tastemesh.sources.staging import stage

WINDOW = 5
RULES = {
    "short": "n_words < 10",
    "repeats": "100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "lines": "100 * n_dup_lines > 30 * n_lines",
}
BASE = "n_words < 10 OR 100 * n_repeat_words > 20 * n_words"


def repeat_words(tokens: Column) -> Column:
    """How many words lie in a 5-word window found twice or more in the text."""

    def by_hashes(h: Column) -> Column:
        windows = F.transform(
            positions(0, F.size(h) - (WINDOW - 1)), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(WINDOW))))
        return let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(repeated(w)))

    def repeated(w: Column) -> Column:
        ordered = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        marked = let(ordered, lambda s: F.transform(s, lambda e, j: F.when(
            (e["x"] == F.get(s, j - 1)["x"]) | (e["x"] == F.get(s, j + 1)["x"]), e["i"])))
        starts = F.sort_array(F.filter(marked, lambda p: p.isNotNull()))
        return let(starts, lambda p: F.aggregate(
            F.transform(p, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - x, F.lit(WINDOW)))),
            F.lit(0), lambda s, x: s + x))

    return let(F.transform(tokens, lambda t: F.xxhash64(t)), by_hashes)


def measures(documents: DataFrame) -> DataFrame:
    """``doc_id``, ``source`` and the counts that the rules use."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    counted = let(words(F.col("text")), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.aggregate(w, F.lit(0).cast("long"), lambda s, t: s + F.length(t)).alias("word_chars"),
        repeat_words(w).cast("long").alias("n_repeat_words")))
    return documents.select(
        "doc_id", "source", counted.alias("c"),
        (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(
            F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("l"),
    ).select(
        "doc_id", "source", "c.n_words", "c.word_chars", "n_symbols", F.col("l.n").alias("n_lines"),
        F.col("l.dup").alias("n_dup_lines"), "c.n_repeat_words")


def host_rates(measured: DataFrame) -> DataFrame:
    """By host and rule: documents, failures, the shrunk failure rate, its deviation and the corpus rate."""
    counts = measured.groupBy("source").agg(
        F.count("*").alias("n"), *(F.sum(F.expr(f"CAST({rule} AS long)")).alias(name) for name, rule in RULES.items()))
    by_rule = counts.unpivot(["source", "n"], list(RULES), "rule", "failed")
    # Variance between hosts: that of the rates, by documents, less what sampling alone would give.
    corpus = by_rule.groupBy("rule").agg(
        F.sum("n").alias("docs"), F.count("*").alias("hosts"), (F.sum("failed") / F.sum("n")).alias("rate"))
    spread = by_rule.join(corpus, "rule").groupBy("rule", "rate", "docs", "hosts").agg(
        F.expr("sum(n * pow(failed / n - rate, 2)) / docs - rate * (1 - rate) * (hosts - 1) / docs").alias("between"))
    prior = spread.select(
        "rule", "rate", F.expr("greatest(1D, least(10000D, rate * (1 - rate) / greatest(between, 1e-9D) - 1))").alias("strength"))
    shrunk = by_rule.join(prior, "rule").withColumn("shrunk", F.expr("(failed + strength * rate) / (n + strength)"))
    return shrunk.withColumn("deviation", F.expr("sqrt(shrunk * (1 - shrunk) / (n + strength + 1))"))


def host_verdicts(measured: DataFrame, reject_rate: float = 0.6, strict_factor: float = 2.0,
                  strict_floor: float = 0.2) -> DataFrame:
    """``source``, ``verdict`` and the worst shrunk rate."""
    sure = "(shrunk - 2 * deviation)"
    return host_rates(measured).groupBy("source").agg(
        F.max("shrunk").alias("worst_rate"),
        F.expr(f"""CASE WHEN max({sure}) > {reject_rate} THEN 'reject'
                        WHEN bool_or({sure} > {strict_floor} AND {sure} > {strict_factor} * rate) THEN 'strict'
                        ELSE 'normal' END""").alias("verdict"))


def quality(documents: DataFrame, **thresholds: float) -> DataFrame:
    """Measures of each document, ``base_failed``, ``broken`` (any rule), the host's ``verdict`` and ``kept``."""
    measured = stage(measures(documents), "measures")
    hosts = stage(host_verdicts(measured, **thresholds), "hosts")
    joined = measured.alias("d").join(hosts.alias("h"), F.col("d.source").eqNullSafe(F.col("h.source")))
    failed = " OR ".join(f"({rule})" for rule in RULES.values())
    return joined.select("d.*", "verdict", "worst_rate").withColumns({
        "base_failed": F.expr(BASE),
        "broken": F.expr(failed),
        "kept": F.expr(f"NOT ({BASE}) AND (verdict = 'normal' OR (verdict = 'strict' AND NOT ({failed})))"),
    })
