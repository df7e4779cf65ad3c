"""Licence scans: a trained classifier of passages, confirmed by comparison with templates. SQL functions only.

Texts are cut into paragraphs at blank lines and these into sentences, a single line break being a blank, so notices
wrapped over lines are whole. A sentence over several lines is also read line by line, for notices without a full
stop. Passages with a word that licence notices are made of (``CUES``) go to a multinomial logistic regression with
elastic net on hashed word 1- to 3-grams. It is trained on variants of the ``TEMPLATES`` (words dropped, order kept, some
after other words) and, as class ``unknown``, on bounded samples of the corpus (``UNKNOWN_PASSAGES`` each) and on
``DECOYS``, which use licence words for other things. One sample is of other sentences, the other of the distinct passages
that are judged, less those with more than ``FAR`` of a template. Variants whose words the training has not seen set
the probability from which a family is believed, so that ``PRECISION`` of what is believed is right; anything below is
unknown.

A believed family is confirmed where the passage holds enough of the word pairs of one of its templates, or the
template of those of the passage (a single line: the line of those of the template); it must also hold a word that tells
this family from the others, if the template has one, have the same qualifying pairs (BY-NC-SA is no BY-NC), and not be
negated. As part of this a confirmed passage holds a cue, so the search for cues first loses none.

Edge cases: null and blank texts have no passages; long texts are cut and read whole; of families with equal
probability the first of ``TEMPLATES`` is taken; rows are told apart by a row number, so equal rows and null ``doc_id`` each
get their row, and repeated passages weigh once in training; other columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tastemesh.llm.exprs import let, positions
from tastemesh.sources.staging import stage

UNKNOWN = "unknown"
UNKNOWN_PASSAGES = 2000
FAR = 0.34
VARIANTS = 24
FEATURES = 1 << 13
PRECISION = 0.98
OVERLAP = 0.6
# Usual wordings of licence notices, by family.
TEMPLATES = {
    "mit": (
        "Released under the MIT License.", "This project is licensed under the terms of the MIT license.", "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.",
        "SPDX-License-Identifier: MIT"),
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.", "Released under the Apache License 2.0.", "This project is licensed under the Apache License Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0"),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 2.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "Released under the GPL version 3.", "SPDX-License-Identifier: GPL-3.0-or-later"),
    "lgpl": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.", "Released under the LGPL version 3.",
        "SPDX-License-Identifier: LGPL-2.1-or-later"),
    "agpl": ("This work is licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only"),
    "bsd": (
        "Released under the BSD License.", "Licensed under the BSD 3-Clause License.", "Released under the BSD 2-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "SPDX-License-Identifier: BSD-3-Clause"),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, Version 2.0.",
        "SPDX-License-Identifier: MPL-2.0"),
    "isc": (
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.", "SPDX-License-Identifier: ISC"),
    "cc-by": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "cc0": ("Released under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    "public-domain": ("This is free and unencumbered software released into the public domain.", "This work is dedicated to the public domain."),
    "all-rights-reserved": ("All rights reserved.", "Copyright the authors. All rights reserved.", "No part of this publication may be reproduced without prior written permission."),
}
DECOYS = (
    "He lost his driver license on the road.", "The fishing licence costs ten euros a year.", "You need permission from your parents to go.",
    "Permission denied while opening the file.", "Copyright law is taught in the second year.", "The software was released in the spring.",
    "She studied at MIT before the war.", "The Apache people lived in the plains.", "The general public was not admitted.", "They reserved all rooms of the hotel.",
    "The warranty ends after two years.", "The rights of the citizens are listed below.", "Creative people and the commons of the village.",
)
CUES = (
    r"(?i)licen[sc]|copyright|permission|permitted|\brights\b|reserved|public\s+domain|spdx|\bgpl\b|\blgpl\b|\bagpl\b|\bcc0\b|\bcc[-\s]by\b"
    r"|creative\s+commons|redistribut|free\s+software|mozilla\s+public|unencumbered")
# Word pairs that make another licence of one with the same words.
QUALIFYING = (
    "by nc", "by nd", "by sa", "nc nd", "nc sa", "attribution noncommercial", "attribution noderivatives", "attribution sharealike",
    "noncommercial noderivatives", "noncommercial sharealike", "lesser general", "affero general",
)
NEGATED = (
    r"\b(?:not|never|neither|no longer|isn t|wasn t|aren t)(?: [a-z0-9.]+){0,2}"
    r" (?:licen[sc]ed|released|distributed|published|available|dedicated|granted|permitted|reserved|under)\b")
_SENTENCE = r"\n[\x20\t\r]*\n\s*|(?<=[.!?])\s+"
_LINE = r"\s*\n\s*"
_NO_PASSAGES = "CAST(array() AS array<struct<sentence:int,piece:int,passage:string,negated:boolean>>)"


def passages(text: Column, cues: str = CUES) -> Column:
    """Sentences with a cue, each as ``piece`` 0 and, if over several lines, with its lines from 1 on that have one."""

    def lines(sentence: Column, i: Column) -> Column:
        def line(every: Column) -> Callable[[Column, Column], Column]:
            def of(p: Column, k: Column) -> Column:
                before = F.get(every, k - 1)
                across = _negated(F.concat_ws(" ", before, p)) & ~F.coalesce(_negated(before), F.lit(False))
                return F.struct(i.alias("sentence"), (k + 1).alias("piece"), p.alias("passage"), (_negated(p) | across).alias("negated"))

            return of

        return let(F.split(sentence, _LINE), lambda every: F.filter(F.transform(every, line(every)), lambda x: x["passage"].rlike(cues)))

    def readings(sentence: Column, i: Column) -> Column:
        whole = F.struct(i.alias("sentence"), F.lit(0).alias("piece"), sentence.alias("passage"), _negated(sentence).alias("negated"))
        return F.concat(F.array(whole), F.when(F.contains(sentence, F.lit("\n")), lines(sentence, i)).otherwise(F.expr(_NO_PASSAGES)))

    return F.flatten(F.transform(F.filter(F.split(text, _SENTENCE), lambda p: p.rlike(cues)), readings))


def tokens(passage: Column) -> Column:
    """Lower-case words and numbers, version points kept."""
    joined = F.regexp_replace(F.lower(passage), r"\b(non|share|no)[-\s]+(commercial|alike|derivatives)\b", "$1$2")
    return F.filter(F.split(joined, r"[^a-z0-9.]+|\.(?![0-9])"), lambda w: w != "")


def _negated(passage: Column) -> Column:
    return F.concat_ws(" ", tokens(passage)).rlike(NEGATED)


def grams(words: Column) -> Column:
    """1- to 3-grams of the words."""

    def of(w: Column) -> Column:
        pick = lambda n: F.transform(positions(0, F.size(w) - (n - 1)), lambda i: F.concat_ws(" ", *(F.get(w, i + k) for k in range(n))))
        return F.concat(w, pick(2), pick(3))

    return let(words, of)


def _pairs(words: Column) -> Column:
    """Distinct neighbouring word pairs, framed, so that one word has pairs too."""
    framed = F.concat(F.array(F.lit("<")), words, F.array(F.lit(">")))
    return let(framed, lambda w: F.array_distinct(F.transform(positions(0, F.size(w) - 1), lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1)))))


def _qualifying(pairs: Column) -> Column:
    return F.sort_array(F.array_intersect(pairs, F.array(*map(F.lit, QUALIFYING))))


def template_table(spark: SparkSession) -> DataFrame:
    """``family``, ``template`` number, ``passage`` and ``telling``: its words that no other family's templates hold."""
    rows = [(family, n, text) for family, texts in TEMPLATES.items() for n, text in enumerate(texts)]
    templates = spark.createDataFrame(rows, "family string, template int, passage string")
    words = templates.select("family", F.explode(tokens(F.col("passage"))).alias("word"))
    own = words.groupBy("word").agg(F.min("family").alias("family"), F.max("family").alias("last")).where("family = last")
    telling = own.groupBy("family").agg(F.collect_set("word").alias("own"))
    return templates.join(telling, "family", "left").select(
        "family", "template", "passage",
        F.array_intersect(tokens(F.col("passage")), F.coalesce("own", F.array().cast("array<string>"))).alias("telling"))


def _made(spark: SparkSession) -> DataFrame:
    """``family``, ``words``, ``fold`` of variants of templates and decoys; equal ones are in one fold."""
    decoys = spark.createDataFrame([(UNKNOWN, d) for d in DECOYS], "family string, passage string").withColumn("telling", F.array().cast("array<string>"))
    families = template_table(spark).select("family", "passage", "telling").unionByName(decoys)
    variants = families.withColumn("full", tokens(F.col("passage"))).withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(VARIANTS - 1))))
    # Variant 0 is the template; the others miss about a sixth of the words, but none that tells the family.
    stays = lambda x, i: (F.col("variant") == 0) | F.array_contains("telling", x) | (F.pmod(F.xxhash64(x, i, F.col("variant")), F.lit(6)) != 0)
    some = F.pmod(F.xxhash64("passage", "variant"), F.lit(len(DECOYS))).cast("int")
    before = F.get(F.array(*(tokens(F.lit(d)) for d in DECOYS)), some)
    said = variants.withColumn("said", F.filter("full", stays)).withColumn(
        "words", F.when((F.col("variant") % 3 == 2) & (F.col("family") != UNKNOWN), F.concat(before, "said")).otherwise(F.col("said")))
    return said.select("family", "words", ((F.col("words") != F.col("full")) & (F.pmod(F.xxhash64("words"), F.lit(4)) == 1)).alias("fold"))


def _unlike(wordings: DataFrame) -> DataFrame:
    """The ``words`` of those passages that share ``FAR`` or less with every template, by word pairs."""
    pairs = wordings.withColumn("words", tokens(F.col("passage"))).withColumn("pairs", _pairs(F.col("words")))
    templates = template_table(wordings.sparkSession).select("family", "template", _pairs(tokens(F.col("passage"))).alias("of"))
    said = pairs.select("passage", F.size("pairs").alias("all"), F.explode("pairs").alias("pair"))
    held = templates.select("family", "template", F.size("of").alias("held"), F.explode("of").alias("pair"))
    near = said.join(F.broadcast(held), "pair").groupBy("passage", "family", "template").agg(  # a few hundred pairs
        (F.count("*") / F.least(F.first("all"), F.first("held"))).alias("share")).where(F.col("share") > FAR)
    return pairs.join(near.select("passage").distinct(), "passage", "left_anti").select("words")


def _training(documents: DataFrame, found: DataFrame) -> DataFrame:
    """``family``, ``words``, ``fold`` of template variants, decoys, other sentences of the corpus and passages unlike any template."""

    def about(rows: DataFrame, key: Column) -> DataFrame:
        share = min(1.0, UNKNOWN_PASSAGES / max(1, rows.count()))
        return rows.where(F.pmod(F.xxhash64(key, F.lit("licence")), F.lit(1_000_000)) < int(share * 1_000_000))

    by_words = (F.pmod(F.xxhash64("words"), F.lit(4)) == 1).alias("fold")
    texts = about(documents.where("text IS NOT NULL").select(F.xxhash64("doc_id", "text").alias("key"), "text"), F.col("key"))
    other = F.filter(F.split("text", _SENTENCE), lambda p: ~p.rlike(CUES))
    one = F.get(other, F.pmod(F.col("key"), F.greatest(F.size(other), F.lit(1))).cast("int"))
    plain = texts.select(F.lit(UNKNOWN).alias("family"), F.coalesce(tokens(one), F.array().cast("array<string>")).alias("words"))
    wordings = stage(found.where("piece = 0").select("passage").distinct(), "licence-wordings")
    unlike = _unlike(about(wordings, F.col("passage")))
    return _made(documents.sparkSession).unionByName(plain.select("family", "words", by_words)).unionByName(
        unlike.select(F.lit(UNKNOWN).alias("family"), "words", by_words))


def _hashed(rows: DataFrame) -> DataFrame:
    return HashingTF(numFeatures=FEATURES, binary=True, inputCol="grams", outputCol="features").transform(rows.withColumn("grams", grams(F.col("words"))))


def classify(documents: DataFrame, found: DataFrame) -> DataFrame:
    """``found`` passages with ``family``, its ``score``, and the score from which it is believed."""
    names = [*TEMPLATES, UNKNOWN]
    number = F.array_position(F.array(*map(F.lit, names)), F.col("family")) - 1
    rows = stage(_hashed(_training(documents, found)).withColumn("label", number.cast("double")).select("label", "features", "fold"), "licence-training")
    model = LogisticRegression(regParam=0.002, elasticNetParam=0.3, maxIter=60, family="multinomial").fit(rows.where("NOT fold").repartition(4))

    def best(df: DataFrame) -> DataFrame:
        out = model.transform(df).withColumn("chances", vector_to_array("probability"))
        return out.withColumns({"score": F.array_max("chances"), "number": (F.array_position("chances", F.array_max("chances")) - 1).cast("int")})

    # Of the other variants, from the surest down, PRECISION must be right.
    steps = best(rows.where("fold")).where(F.col("number") < len(TEMPLATES)).groupBy(F.floor(F.col("score") * 50).alias("step")).agg(
        F.sum((F.col("number") == F.col("label")).cast("int")).alias("right"), F.count("*").alias("all")).orderBy(F.desc("step")).collect()
    believed, right, total = 1.0, 0, 0
    for row in steps:  # 51 at most
        right, total = right + row.right, total + row.all
        if right >= PRECISION * total:
            believed = row.step / 50
    return best(_hashed(found)).withColumns({
        "family": F.get(F.array(*map(F.lit, names)), F.col("number")), "threshold": F.lit(believed)})


def scan(documents: DataFrame, cues: str = CUES) -> DataFrame:
    """``row``, ``doc_id`` and by passage ``sentence``, ``piece``, ``passage``, ``family``, ``score``, ``threshold``, ``overlap``, ``confirmed``.

    All documents are kept: one without a candidate passage has one row with null ``passage``.
    """
    keyed = stage(documents.select(
        F.monotonically_increasing_id().alias("row"), "doc_id",
        F.when(F.col("text").rlike(cues), passages(F.col("text"), cues)).alias("passages")), "licence-passages")
    found = keyed.select("row", F.posexplode("passages").alias("passage_no", "p")).select("row", "passage_no", "p.*").withColumn(
        "words", tokens(F.col("passage")))
    judged = classify(documents.select("doc_id", "text"), found)
    known = template_table(documents.sparkSession).select("family", "telling", _pairs(tokens(F.col("passage"))).alias("template"))  # a few dozen rows
    whole = F.when(F.col("piece") == 0, F.least(F.size("pairs"), F.size("template"))).otherwise(F.size("template"))
    fits = ((F.size("telling") == 0) | F.arrays_overlap("telling", "words")) & (_qualifying(F.col("pairs")) == _qualifying(F.col("template")))
    compared = judged.where(f"family <> '{UNKNOWN}' AND score >= threshold AND NOT negated").withColumn("pairs", _pairs(F.col("words"))).join(
        known, "family").where(F.col("passage").rlike(CUES) & fits).groupBy("row", "passage_no").agg(
        F.max(F.size(F.array_intersect("pairs", "template")) / whole).alias("overlap"))
    named = judged.select("row", "passage_no", "sentence", "piece", "passage", "family", "score", "threshold").join(compared, ["row", "passage_no"], "left")
    return keyed.select("row", "doc_id").join(named, "row", "left").drop("passage_no").withColumn(
        "confirmed", F.coalesce(F.col("overlap") >= OVERLAP, F.lit(False)))


def by_document(documents: DataFrame) -> DataFrame:
    """``summary`` of the documents' passages."""
    return summary(scan(documents))


def summary(scanned: DataFrame) -> DataFrame:
    """Per document the number of candidate sentences, of licences confirmed in them, and the confirmed ``families``, sorted."""
    sure = F.col("confirmed")
    return scanned.groupBy("row", "doc_id").agg(
        F.count(F.when(F.col("piece") == 0, 1)).alias("n_candidates"),
        F.size(F.collect_set(F.when(sure, F.struct("sentence", "family")))).cast("long").alias("n_licences"),
        F.array_join(F.sort_array(F.collect_set(F.when(sure, F.col("family")))), ",").alias("families"),
        F.max(F.when(sure, F.col("score"))).alias("score")).drop("row")
