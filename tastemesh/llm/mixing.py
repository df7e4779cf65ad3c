"""Mixing sources to target weights by entropy balancing.

Targets: sources in code point order weigh 5, 2, 1, repeating; all words are shared out by weight, a source's
target stops at ``MOST`` times its size, and the excess is shared again until none is above.

Rates: of all document rates whose words meet the targets, entropy balancing takes those closest to one. The
problem's convex dual has one unknown a source, ``lam``, and the rate of a document is
``min(MOST, exp(lam * size / mean size))``. Newton steps on the dual run as Spark aggregations over the histogram of
(source, size), all sources at once, and fall back to halving the bracket where a step would leave it.

Copies: rates become whole copies, the next lower or higher number, from the longest documents down, the words
over or under carried on to the next size; so a source misses its target by about its smallest documents. The copies
of one size are spread evenly over its documents in ``doc_id`` order.

Hot sources: only the histogram is grouped by source, its rows bounded by the number of distinct sizes. Places within
one size come from ranks over all documents, dealt out by ranges, so neither ids that do not count up nor a size that a
third of all documents share meet in one task; the copies of a size are joined in blocks of ``_BLOCK`` ranks.

Edge cases: null or blank texts have size 0 and are not taken; null sources are one source, the last; equal rows are
dealt with one by one; a source of few documents can only come as near as whole copies allow; other columns are not read;
an empty table gives an empty table.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tastemesh.llm.exprs import words
from tastemesh.operators.ranking import whole_ranks
from tastemesh.sources.staging import stage

WEIGHTS = (5, 2, 1)
MOST = 3
TOLERANCE = 1e-9
ROUNDS = 100
_BLOCK = 1 << 16


def targets(sources: DataFrame) -> DataFrame:
    """``target`` words for each row of ``sources`` (``source``, ``source_size``)."""
    # One row a source, so the ordering task holds names only.
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(ordered) - 1) % len(WEIGHTS)
    weighed = stage(sources.withColumn("weight", F.get(F.array(*map(F.lit, WEIGHTS)), place)), "source-weights")
    level, before = None, -1.0
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    while level != before:
        before = level
        capped = F.lit(False) if level is None else MOST * F.col("source_size") < level * F.col("weight")
        full, weight = weighed.agg(
            F.sum(F.when(capped, MOST * F.col("source_size")).otherwise(0)), F.sum(F.when(capped, 0).otherwise(F.col("weight")))).first()
        level = (total - full) / weight if weight else before
        if level is None:
            break
    return weighed.withColumn("target", F.least(F.lit(float(MOST)) * F.col("source_size"), F.lit(float(level or 0)) * F.col("weight")))


def balance(histogram: DataFrame, goals: DataFrame) -> DataFrame:
    """``skey``, ``lam``, ``mean``: the dual solution of each source with a target between none and all."""
    sums = histogram.groupBy("skey").agg(
        F.sum(F.col("size") * F.col("n")).alias("total"), (F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"))
    state = stage(sums.join(goals.select("skey", "target"), "skey").where("target > 0 AND target < total * 3").withColumns({
        # Sizes are 1 at least, so all rates reach MOST at hi, and at lo the words fall short of the target.
        "lam": F.lit(0.0), "hi": F.log(F.lit(float(MOST))) * F.col("mean"),
        "lo": F.expr("least(0D, -(ln(total / target) + 1) * mean)"), "miss": F.lit(None).cast("double")}), "dual")
    tilt = F.exp(F.col("lam") * F.col("size") / F.col("mean"))
    mass = F.col("n") * F.col("size")
    for _ in range(ROUNDS):
        if state.where(f"miss IS NULL OR miss > {TOLERANCE} * target").isEmpty():
            break
        found = histogram.join(state, "skey").groupBy("skey", "total", "mean", "target", "lam", "hi", "lo").agg(
            (F.sum(mass * F.least(F.lit(float(MOST)), tilt)) - F.col("target")).alias("over"),
            F.sum(F.when(tilt < MOST, mass * F.col("size") / F.col("mean") * tilt)).alias("slope"))
        bounded = found.withColumns({
            "lo": F.when(F.col("over") < 0, F.col("lam")).otherwise(F.col("lo")),
            "hi": F.when(F.col("over") > 0, F.col("lam")).otherwise(F.col("hi"))})
        step = F.when(F.col("slope") > 0, F.col("lam") - F.col("over") / F.col("slope"))
        state = stage(bounded.select(
            "skey", "total", "mean", "target", "lo", "hi",
            F.when(F.abs("over") <= TOLERANCE * F.col("target"), F.col("lam"))
            .when((step > F.col("lo")) & (step < F.col("hi")), step)
            .otherwise((F.col("lo") + F.col("hi")) / 2).alias("lam"),
            # A bracket that cannot be halved any more is solved as well as doubles can.
            F.when(F.col("hi") - F.col("lo") <= 1e-13 * F.abs("hi"), 0.0).otherwise(F.abs("over")).alias("miss")), "dual")
    return state.select("skey", "lam", "mean")


def _round_down_sizes(rows: pd.DataFrame) -> pd.DataFrame:
    """Copies for each size of one source, longest first; the miss in words is carried on."""
    rows = rows.sort_values("size", ascending=False)
    copies, miss = [], 0.0
    for size, n, rate in zip(rows["size"], rows["n"], rows["rate"], strict=True):
        low, high = n * int(rate // 1), n * int(-(-rate // 1))
        got = min(max(round(n * rate + miss / size), low), high)
        miss += (n * rate - got) * size
        copies.append(int(got))
    return rows.assign(copies=copies)[["skey", "size", "n", "rate", "copies"]]


def _block(rank: Column) -> Column:
    return F.floor(rank / _BLOCK)


def mix(documents: DataFrame) -> DataFrame:
    """Per document ``size``, ``source_size``, ``target``, ``rate``, ``copies`` and ``taken`` words."""
    sized = stage(documents.select(
        "doc_id", "source", F.coalesce(F.concat(F.lit("="), "source"), F.lit("-")).alias("skey"),
        F.size(words(F.col("text"))).cast("long").alias("size"), F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("row")), "sizes")
    goals = stage(targets(sized.groupBy("source", "skey").agg(F.sum("size").alias("source_size"))), "targets")
    # The row number only parts rows that are equal in all else, so that they need not lie in one range.
    order = [F.col("skey"), F.col("size"), F.col("doc_id").asc_nulls_last(), F.col("tie"), F.col("row")]
    placed = stage(whole_ranks(sized.drop("source"), [], order), "places")
    histogram = stage(placed.where("size > 0").groupBy("skey", "size").agg(F.count("*").alias("n"), F.min("rank").alias("first")), "histogram")
    dual = balance(histogram, goals)
    rates = histogram.join(goals.select("skey", "target"), "skey").join(dual, "skey", "left").select(
        "skey", "size", "n",
        F.when(F.col("target") <= 0, 0.0).when(F.col("lam").isNull(), float(MOST))
        .otherwise(F.least(F.lit(float(MOST)), F.exp(F.col("lam") * F.col("size") / F.col("mean")))).alias("rate"))
    rounded = rates.groupBy("skey").applyInPandas(_round_down_sizes, "skey string, size long, n long, rate double, copies long")
    dealt = rounded.join(histogram.select("skey", "size", "first"), ["skey", "size"]).withColumn(
        "block", F.explode(F.sequence(_block(F.col("first")), _block(F.col("first") + F.col("n") - 1))))
    cut = placed.withColumn("block", _block(F.col("rank"))).join(dealt, ["skey", "size", "block"], "left")
    # Decimals, since the product of two counts of documents may pass 64 bits.
    upto = "cast(rank - first + {} AS decimal(19, 0)) * (copies % n) div n"
    copies = F.expr(f"coalesce(copies div n + {upto.format(1)} - {upto.format(0)}, 0)")
    return cut.select("doc_id", "skey", "size", "rate", copies.alias("copies")).join(
        goals.select("skey", "source_size", "target"), "skey").select(
        "doc_id", "size", "source_size", "target", F.coalesce("rate", F.lit(0.0)).alias("rate"), "copies", (F.col("copies") * F.col("size")).alias("taken"))
