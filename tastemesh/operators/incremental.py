"""TF-IDF vectors that follow their items: what did not change is not tokenised again.

A store is a folder of generations. The first holds all items; each later one only the items that were added, changed or
dropped since. A generation has four tables:

* ``items``: ``item_id, text, print, live, gen`` of its items; the newest row of an item counts.
* ``counts``: ``item_id, term, tf, gen`` for listed terms: all of the generation's items, and for a term that has
  entered the list all items that have it.
* ``terms``: the ``RESERVE`` times ``max_features`` most frequent n-grams with exact totals, the listed ones with the
  generation they entered in.
* ``state``: one row, written last; a generation without it does not exist, so a broken-off update is simply done again.

The number of items is part of every weight, so weights are formed when the vectors are read; texts are not needed for
that.

An n-gram outside the reserve has a total of ``ceiling`` at most. An update adds up the n-grams of new texts and takes
off those of the old; one outside the reserve can only reach the list if the ceiling and what it gained do, and those
few are counted over all texts. The others raise the ceiling by what they gained. Where the last listed total has come
down to the ceiling, the next update would read most items anyway or generations have become many, everything is built
anew. So the list is always that of a full build.

Item ids must be unique and not null; others are an error. A null text counts as an empty one: an item without terms.
An empty input gives no vectors. One writer at a time.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tastemesh.functions import text as X
from tastemesh.operators import tfidf
from tastemesh.sources.staging import stage

RESERVE = 2
MAX_GENERATIONS = 16


class VectorStore:
    """TF-IDF vectors of a changing table of items, with the parameters of ``tfidf_vectors``."""

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        max_features: int = 5000,
        low: int = 1,
        high: int = 3,
        stop_words: Sequence[str] = X.ENGLISH_STOP_WORDS,
    ):
        self.spark, self.max_features = spark, max_features
        self.shape = (low, high, tuple(stop_words))
        name = hashlib.sha256(json.dumps([max_features, low, high, list(stop_words)]).encode()).hexdigest()[:32]
        self.folder = f"{root.rstrip('/')}/tfidf-{name}"

    def state(self) -> Row | None:
        """``gen, base, ceiling, n, rewritten`` of the last finished generation; ``rewritten`` counts its items."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder, "gen-*/state/_SUCCESS")
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        marks = fs.globStatus(path) or []
        names = [mark.getPath().getParent().getParent().getName() for mark in marks]
        return self.spark.read.parquet(f"{self.folder}/{max(names)}/state").first() if names else None

    def update(self, items: DataFrame) -> Row:
        """Make the store hold exactly ``items`` (``item_id, text``) and give its state."""
        now = stage(items.select("item_id", F.coalesce("text", F.lit("")).alias("text")), "items")
        n, named, distinct = now.agg(F.count("*"), F.count("item_id"), F.count_distinct("item_id")).first()
        if not n == named == distinct:
            raise ValueError(f"{n} items have {distinct} different ids, {n - named} have none")
        prints = now.select("item_id", F.sha2("text", 256).alias("print"))
        state = self.state()
        if state is None:
            return self._build(now, prints, n, 0)
        known = self._items(state).where("live").select("item_id", F.col("print").alias("old_print"), F.col("gen").alias("old_gen"))
        changed = stage(
            prints.join(known, "item_id", "full").where(~F.col("print").eqNullSafe(F.col("old_print"))), "changed")
        n_changed = changed.count()
        if n_changed == 0:
            return state
        if 2 * n_changed > n or state.gen - state.base >= MAX_GENERATIONS:
            return self._build(now, prints, n, state.gen + 1)
        return self._append(now, prints, changed, n, n_changed, state)

    def vectors(self) -> DataFrame:
        """``item_id, term, weight``, the rows of ``tfidf_vectors`` of the last update's items."""
        state = self.state()
        if state is None:
            raise ValueError("the store holds no items")
        since = self._items(state).where("live").select("item_id", F.col("gen").alias("since"))
        listed = self._table(state.gen, "terms").where("listed").select("term", "entered")
        counts = (
            self._since(state, "counts")
            .join(tfidf.lookup(listed, self.max_features), "term").where("gen >= entered")
            .join(since, "item_id").where("gen >= since")
        )
        return tfidf.weighted(stage(counts.select("item_id", "term", "tf"), "counts"), state.n, self.max_features)

    def _build(self, now: DataFrame, prints: DataFrame, n: int, gen: int) -> Row:
        low, high, stop_words = self.shape
        size = RESERVE * self.max_features
        reserve = stage(tfidf.vocabulary(now, size, low, high, stop_words), "reserve")
        found, last = reserve.agg(F.count("*"), F.min("total")).first()
        terms = self._listed(reserve, None, gen)
        self._write(gen, "terms", terms)
        listed = self._table(gen, "terms").where("listed")
        counts = tfidf.term_frequencies(now, listed, self.max_features, low, high, stop_words)
        self._write(gen, "counts", counts.withColumn("gen", F.lit(gen)))
        return self._finish(
            gen, gen, int(last) if found == size else 0, n, n, self._rows(now.join(prints, "item_id"), gen))

    def _append(self, now: DataFrame, prints: DataFrame, changed: DataFrame, n: int, n_changed: int, state: Row) -> Row:
        low, high, stop_words = self.shape
        gen = state.gen + 1
        fresh = now.join(changed.where(F.col("print").isNotNull()).select("item_id", "print"), "item_id")
        texts = self._since(state, "items").select("item_id", "gen", "text")
        gone = texts.join(changed.select("item_id", F.col("old_gen").alias("gen")), ["item_id", "gen"])
        moved = stage(
            fresh.select("item_id", "text", F.lit(1).alias("sign"))
            .unionByName(gone.select("item_id", "text", F.lit(-1).alias("sign"))), "moved")
        gains = stage(
            tfidf.ngrams(tfidf.spread(moved), low, high, stop_words, "sign")
            .groupBy("term").agg(F.sum("sign").alias("gain")).where("gain != 0"), "gains")

        before = self._table(state.gen, "terms")
        reserve = stage(
            before.join(gains, "term", "left").withColumn("total", F.col("total") + F.coalesce("gain", F.lit(0)))
            .where("total > 0").select("term", "total"), "reserve")
        reached, last = self._most(reserve).agg(F.count("*"), F.min("total")).first()
        threshold = last if reached == self.max_features else 1
        if threshold <= state.ceiling:
            return self._build(now, prints, n, gen)
        others = gains.join(before.select("term"), "term", "left_anti").where("gain > 0")
        possible = stage(others.where(F.col("gain") + state.ceiling >= threshold).select("term"), "possible")
        raised = others.where(F.col("gain") + state.ceiling < threshold).agg(F.max("gain")).first()[0] or 0
        n_possible = possible.count()
        # What may enter the list, from outside or from the reserve, is counted by item in one pass over all texts.
        near = self._most(reserve).join(before.where("listed").select("term"), "term", "left_anti").select("term")
        wanted = stage(possible.unionByName(near), "wanted")
        n_wanted = wanted.count()
        if n_wanted:
            found = stage(tfidf.term_frequencies(now, wanted, n_wanted, low, high, stop_words), "found")
        if n_possible:
            counted = found.join(tfidf.lookup(possible, n_possible), "term", "left_semi").groupBy("term").agg(
                F.sum("tf").alias("total"))
            reserve = stage(reserve.unionByName(counted), "reserve")
        # What falls out of the reserve may be as frequent as its first n-gram.
        size = RESERVE * self.max_features
        kept = stage(reserve.orderBy(F.col("total").desc(), F.col("term")).limit(size), "kept")
        dropped = reserve.join(kept, "term", "left_anti").agg(F.max("total")).first()[0] or 0
        ceiling = max(state.ceiling + raised, dropped)
        self._write(gen, "terms", self._listed(kept, before.where("listed").select("term", "entered"), gen))

        listed = self._table(gen, "terms").where("listed")
        counts = tfidf.term_frequencies(fresh, listed, self.max_features, low, high, stop_words)
        if n_wanted:
            entered = tfidf.lookup(listed.where(F.col("entered") == gen).select("term"), n_wanted)
            rest = found.join(changed.select("item_id"), "item_id", "left_anti").join(entered, "term", "left_semi")
            counts = counts.unionByName(rest.select("item_id", "term", "tf"))
        self._write(gen, "counts", counts.withColumn("gen", F.lit(gen)))
        dropped_items = changed.where(F.col("print").isNull()).select("item_id", F.lit(None).cast("string").alias("text"), "print")
        rows = fresh.select("item_id", "text", "print").unionByName(dropped_items)
        return self._finish(gen, state.base, int(ceiling), n, n_changed, self._rows(rows, gen))

    def _most(self, totals: DataFrame) -> DataFrame:
        return totals.orderBy(F.col("total").desc(), F.col("term")).limit(self.max_features)

    def _listed(self, reserve: DataFrame, before: DataFrame | None, gen: int) -> DataFrame:
        """The reserve with ``listed`` and the generation in which listed terms entered."""
        listed = self._most(reserve).select("term", F.lit(True).alias("listed"))
        marked = reserve.join(listed, "term", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
        entered = F.lit(gen)
        if before is not None:
            marked = marked.join(before, "term", "left")
            entered = F.coalesce("entered", entered)
        return marked.select(
            "term", F.col("total").cast("long").alias("total"), "listed", F.when(F.col("listed"), entered).alias("entered"))

    def _rows(self, items: DataFrame, gen: int) -> DataFrame:
        live = F.col("print").isNotNull().alias("live")
        return items.select("item_id", "text", "print", live, F.lit(gen).alias("gen"))

    def _finish(self, gen: int, base: int, ceiling: int, n: int, rewritten: int, items: DataFrame) -> Row:
        self._write(gen, "items", items)
        schema = T.StructType([T.StructField(name, T.LongType()) for name in ("gen", "base", "ceiling", "n", "rewritten")])
        self._write(gen, "state", self.spark.createDataFrame([(gen, base, ceiling, n, rewritten)], schema))
        return self.state()

    def _items(self, state: Row) -> DataFrame:
        """The newest row of each item, without its text: ``item_id, print, live, gen``."""
        newest = F.max_by(F.struct("print", "live", "gen"), "gen").alias("newest")
        return self._since(state, "items").groupBy("item_id").agg(newest).select("item_id", "newest.*")

    def _path(self, gen: int, table: str) -> str:
        return f"{self.folder}/gen-{gen:09d}/{table}"

    def _table(self, gen: int, table: str) -> DataFrame:
        return self.spark.read.parquet(self._path(gen, table))

    def _since(self, state: Row, table: str) -> DataFrame:
        """The rows of a table in all generations since the last full build."""
        return self.spark.read.parquet(*(self._path(g, table) for g in range(state.base, state.gen + 1)))

    def _write(self, gen: int, table: str, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(self._path(gen, table))
