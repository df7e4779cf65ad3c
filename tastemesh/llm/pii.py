"""Personal data: base patterns, and more spans chosen by boosted trees over candidates. SQL functions only.

High-recall generators propose spans, overlapping between kinds. A candidate carries its format (length, digits,
groups, checks) and its context (the characters and words before it, the character after). Gradient-boosted trees
are trained on a bounded sample (``TRAIN_ROWS``, shared by the kinds) of the candidates whose checks tell what they are:
checksums, ranges, reserved numbers; and on texts made from ``EXAMPLES``, so that every kind added to the base ones has
labelled candidates of both sorts in any corpus. The checks are no features, so the trees learn what such data looks like and judge
candidates without one. Other labelled candidates, all of them, calibrate one threshold a kind: the least score at
which ``PRECISION`` of them are personal. Spans of the base patterns that pass their checks are always kept, and so are
valid IBANs and written-out addresses that are mail addresses once their signs are put back, whatever the threshold. Of these
two kinds nothing else is added, as their checks tell about every span.
A base kind without labelled candidates in the corpus stays uncalibrated, and nothing is added of it.

The texts are read once; what leaves their rows are the candidates. Positions are code points. Patterns use
possessive groups, and a run of characters is entered at its start only, so long runs cost linear time.

Edge cases: null texts have no spans; rows are told apart by a row number, so equal rows and null ``doc_id`` each get
their row; other columns are not read.
"""

from __future__ import annotations

import random

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tastemesh.llm.exprs import let, positions
from tastemesh.sources.staging import stage

TRAIN_ROWS = 20_000
PRECISION = 0.9
BASE_KINDS = ("email", "ip", "card", "phone")
_LOCAL = "A-Za-z0-9._%+-"
# The base patterns (fixed by contract, in linear-time form), then the generators of further candidates.
PATTERNS = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "handle": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++(?:@|\x20?[(\[]at[)\]]\x20?)[A-Za-z0-9-]++(?:(?:\.|\x20?[(\[]dot[)\]]\x20?)[A-Za-z0-9-]++)*+",
    "call": r"(?<![0-9+(.-])\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{4}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "mac": r"(?<![0-9A-Fa-f:-])[0-9A-Fa-f]{2}(?:[:-][0-9A-Fa-f]{2}){5}(?![0-9A-Fa-f:-])",
    "secret": r"(?:(?<![A-Za-z0-9_])|\G)(?i:token|secret|password|passwd|api_key|apikey|access_key)\x20?[=:]\x20?[\"']?[A-Za-z0-9+/_.=-]{6,}",
}
# What a text must hold for the pattern to be tried at all; each is part of every match.
_NEEDS = {"email": "@", "phone": "+", "ssn": "-", "secret": None, "ip": "."}
CONTEXT = {
    "says_mail": r"(?i)\b(?:e-?mail|mail|write|contact)\b",
    "says_call": r"(?i)\b(?:phone|tel|call|fax|mobile|cell)\b",
    "says_pay": r"(?i)\b(?:card|visa|pay|iban|account|bank)\b",
    "says_id": r"(?i)\b(?:ssn|social|security|passport|id)\b",
    "says_net": r"(?i)\b(?:ip|host|server|address|mac|from)\b",
    "says_key": r"(?i)\b(?:token|key|secret|password|auth)\b",
    "says_version": r"(?i)\b(?:version|ver|v|section|release|order|no|item)\b",
}
# By kind, personal data and what looks like it. ``#`` is a digit, ``x`` a hex digit, ``a`` a small letter,
# ``A`` a capital one, ``*`` any of them; the rest stands for itself. ``{}`` is the value.
EXAMPLES = {
    "handle": (
        ("aaaa.aaaa (at) aaaaaa (dot) aaa", "aaaaa [at] aaaaaaa [dot] aaa [dot] aa", "aaaa##(at)aaaaa(dot)aaa", "aaa.aaaaa (at) aaaaaaaa.aaa"),
        ("aaaa@aaaaa", "aaaa.aaaa@aaaaaa", "aaaa (at) aaaaa", "aaa##@aaaa-##", "aaaaa [at] aaa"),
        ("write to {} please", "my mail: {}", "contact {}", "login {}", "{}", "see {} now")),
    "call": (
        ("(2##) 3##-####", "2##-3##-####", "0## 4## ####", "2##.3##.####", "0### 5## ####"),
        ("## ### 20##", "##.###.####", "19## 19## 20##", "20## 201# 202#", "## #### 19##", "#### #### #### ####"),
        ("call me: {}.", "phone {}", "tel. {}", "my number is {}", "{}", "fax {} or mail"),
        ("order no {}", "version {}", "in the years {}", "item {}", "section {}", "parts {} in total")),
    "ssn": (
        ("1##-4#-1###", "2##-5#-6###", "5##-1#-7###"), ("9##-4#-1###", "000-5#-6###", "5##-00-7###"),
        ("my ssn is {}", "social security {}", "ssn: {}", "id {}"), ("order {}", "item {} sold", "version {}", "no {}")),
    "mac": (
        ("0x:1x:4x:xx:xx:xx", "3C-22-xx-xx-xx-xx", "cx:5x:xx:xx:xx:xx", "D4:xx:xx:xx:xx:xx"),
        ("00:00:00:00:00:00", "FF:FF:FF:FF:FF:FF", "ff-ff-ff-ff-ff-ff", "1#:2#:3#:4#:5#:1#", "20-1#-0#-1#-2#-3#", "01:02:03:04:05:06"),
        ("mac address {}", "from {}", "host {} is up", "device {}", "{}"), ("times {}", "version {}", "broadcast {}", "set {}", "on {}")),
    "secret": (
        ("password: aaaa##", "password: Aaaa#aa", "passwd=a#a#a#a#", "secret: ##aaaa##", "password = Aaaa_##_Aa", "pwtoken=******a#", "api_key=******#a****",
         "password: ########", "password: AaAaaAaA", "password: aaaaa-aaaaaa-aaaaaa", "secret=aaaaaaaaAAAAaaaa", "token = \"xxxxxxxxxxxxxxxxxxxxxxxx1a"),
        ("password: aaaaaa", "password: aaaaaaaa", "password: aaaaaaaaaa", "token: aaaaaaa", "secret: aaaaaaaa", "secret = Aaaaaaa", "api_key: aaaaaa", "password: ******"),
        ("the {} is new", "{}", "set {} now", "his {}", "with {} and")),
}
EXAMPLE_TEXTS = 60  # of each kind and sort
FEATURES = (
    "kind_no", "length", "digits", "letters", "digit_share", "upper_share", "groups", "longest_group", "shortest_group", "marks",
    "distinct_share", "value_length", "value_digits", "value_capitals", "value_marks", "octets", "after_word", "before_word", "before_blank", "after_digits", "before_digits", *CONTEXT,
)


def _found(text: Column, kind: str) -> Column:
    """All matches of the kind's pattern: the code points since the match before, and what stands around."""
    pattern = F.lit(PATTERNS[kind])

    def gather(both: Column) -> Column:
        return F.transform(both["hits"], lambda hit, i: F.struct(
            F.lit(kind).alias("kind"), i.alias("i"), F.length(F.get(both["gaps"], i)).alias("gap"), hit.alias("span"),
            F.right(F.get(both["gaps"], i), F.lit(32)).alias("before"), F.left(F.get(both["gaps"], i + 1), F.lit(4)).alias("after")))

    none = F.expr("CAST(array() AS array<struct<kind:string,i:int,gap:int,span:string,before:string,after:string>>)")
    seen = F.contains(text, F.lit(_NEEDS[kind])) & text.rlike(PATTERNS[kind]) if _NEEDS.get(kind) else text.rlike(PATTERNS[kind])
    return F.when(seen, let(F.struct(
        F.split(text, PATTERNS[kind], -1).alias("gaps"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("hits")), gather)).otherwise(none)


def _luhn(digits: Column) -> Column:
    def weigh(i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda s, i: s + weigh(i)) % 10 == 0


def _iban_valid(span: Column) -> Column:
    """The remainder by 97 of the number that the rearranged IBAN stands for."""
    bare = F.replace(span, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(bare, F.lit(5), F.length(bare)), F.substring(bare, 1, 4))

    def step(s: Column, ch: Column) -> Column:
        return F.when(ch.rlike("[0-9]"), (s * 10 + F.expr("0") + F.ascii(ch) - 48) % 97).otherwise((s * 100 + F.ascii(ch) - 55) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), lambda s, ch: F.when(ch == "", s).otherwise(step(s, ch))) == 1


def _written_out(span: Column) -> Column:
    """The span with ``(at)`` and ``(dot)`` as signs."""
    return F.regexp_replace(F.regexp_replace(span, r"\x20?[(\[]at[)\]]\x20?", "@"), r"\x20?[(\[]dot[)\]]\x20?", ".")


def candidates(scanned: DataFrame) -> DataFrame:
    """One row a candidate: ``start``, ``end``, whether it is a ``base`` span or ``sure``, ``label`` (null: unknown), features."""
    rows = scanned.select("row", F.explode("found").alias("f")).select("row", "f.*")
    upto = Window.partitionBy("row", "kind").orderBy("i")
    size = F.length("span")
    placed = rows.withColumn("end", F.sum(F.col("gap") + size).over(upto)).withColumn("start", F.col("end") - size)
    span, digits = F.col("span"), F.regexp_replace("span", "[^0-9]", "")
    groups = F.filter(F.split(span, "[^A-Za-z0-9]+"), lambda g: g != "")
    n_digits, longest, shortest = F.length(digits), F.array_max(F.transform(groups, F.length)), F.array_min(F.transform(groups, F.length))
    passes = {
        "email": F.lit(True),
        "ip": F.forall(F.split(span, r"\."), lambda p: p.cast("double") <= 255),
        "card": n_digits.between(12, 19) & _luhn(digits),
        "phone": n_digits.between(9, 15),
    }
    address = _written_out(span).rlike(rf"^[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++$")
    value = F.regexp_extract(span, r"[=:]\x20?[\"']?(.*)$", 1)
    told = {
        **passes,
        "card": F.when(n_digits.between(12, 19), _luhn(digits)),
        "handle": address,
        "ssn": ~span.rlike("^(?:000|666|9)|-00-|-0000$"),
        "iban": _iban_valid(span),
        # Short values, and those without a digit, may be either; plain words of a usual length are none.
        "secret": F.when((F.length(value) >= 16) & value.rlike("[0-9]") & value.rlike("[A-Za-z]"), F.lit(True)).when(
            value.rlike("^[A-Z]?[a-z]{1,11}$"), F.lit(False)),
        "mac": F.when(F.size(F.array_distinct(F.split(span, "[:-]"))) == 1, F.lit(False)),
    }
    sure = {"iban": _iban_valid(span), "handle": address}

    def by_kind(checks: dict[str, Column], other: Column) -> Column:
        out = F
        for kind, check in checks.items():
            out = out.when(F.col("kind") == kind, check)
        return out.otherwise(other)

    part = lambda pattern: size - F.length(F.regexp_replace("span", pattern, ""))
    return placed.select(
        "row", "kind", F.col("start").cast("long"), F.col("end").cast("long"),
        by_kind(passes, F.lit(False)).alias("base"), F.coalesce(by_kind(sure, F.lit(False)), F.lit(False)).alias("sure"), by_kind(told, F.lit(None).cast("boolean")).cast("double").alias("label"),
        *(x.cast("double").alias(name) for name, x in {
            "kind_no": F.array_position(F.array(*map(F.lit, PATTERNS)), F.col("kind")), "length": size, "digits": n_digits,
            "letters": part("[A-Za-z]"), "digit_share": n_digits / size, "upper_share": part("[A-Z]") / size,
            "groups": F.size(groups), "longest_group": F.coalesce(longest, F.lit(0)), "shortest_group": F.coalesce(shortest, F.lit(0)),
            "marks": part("[^A-Za-z0-9]"),
            "value_length": F.length(value), "value_digits": F.length(F.regexp_replace(value, "[^0-9]", "")),
            "value_capitals": F.length(F.regexp_replace(value, "[^A-Z]", "")), "value_marks": F.length(F.regexp_replace(value, "[A-Za-z0-9]", "")),
            "octets": F.size(F.array_distinct(groups)),
            "distinct_share": F.size(F.array_distinct(F.split(span, ""))) / size,
            "after_word": F.col("after").rlike("^[A-Za-z0-9]"), "before_word": F.col("before").rlike("[A-Za-z0-9]$"),
            "before_blank": F.col("before").rlike(r"(?:^|\s)$"),
            "after_digits": F.col("after").rlike(r"^[\x20.-]?[0-9]"), "before_digits": F.col("before").rlike(r"[0-9][\x20.-]?$"),
            **{name: F.col("before").rlike(pattern) for name, pattern in CONTEXT.items()},
        }.items()))


def examples(spark: SparkSession) -> DataFrame:
    """Labelled candidates of texts made from ``EXAMPLES``, the same in every run; ``row`` is negative."""
    rnd, rows = random.Random(11), []
    drawn = {"#": "0123456789", "x": "0123456789abcdef", "a": "abcdefghijklmnopqrstuvwxyz", "A": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
             "*": "abcdefghijklmnopqrstuvwxyz0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    for kind, (yes, no, frames, *others) in EXAMPLES.items():
        for label, shapes, around in ((1.0, yes, frames), (0.0, no, others[0] if others else frames)):
            for n in range(EXAMPLE_TEXTS):
                shape, keyword = shapes[n % len(shapes)], ""
                if kind == "secret":  # the keyword stands as it is
                    cut = next(i for i, c in enumerate(shape) if c in ":=") + 1
                    keyword, shape = shape[:cut].replace("pwtoken", "token"), shape[cut:]
                    if label == 0.0:
                        shape = shape.replace("*", "a")
                fixed = shape.split("(at)") if kind == "handle" and "(at)" in shape else [shape]
                made = []
                for part in fixed:
                    pieces = part.replace("[at]", "\0").replace("(dot)", "\1").replace("[dot]", "\2")
                    made.append("".join(rnd.choice(drawn[c]) if c in drawn else c for c in pieces))
                value = "(at)".join(made).replace("\0", "[at]").replace("\1", "(dot)").replace("\2", "[dot]")
                rows.append((-1 - len(rows), around[rnd.randrange(len(around))].format(keyword + value), kind, label))
    texts = spark.createDataFrame(rows, "row long, text string, wanted string, told double")
    found = candidates(texts.select("row", F.concat(*(_found(F.col("text"), kind) for kind in PATTERNS)).alias("found")))
    return found.join(texts.select("row", "wanted", "told"), "row").where("kind = wanted").withColumn("label", F.col("told")).drop("wanted", "told")


def _sampled(rows: DataFrame, counts: dict[str, int], limit: int) -> DataFrame:
    """About ``limit`` rows at most, shared by the kinds, by a hash of their place; the same in every run."""
    share = F.lit(0)
    for kind, count in counts.items():
        share = F.when(F.col("kind") == kind, int(min(1.0, limit / len(counts) / max(1, count)) * 1_000_000)).otherwise(share)
    return rows.where((F.col("row") < 0) | (F.pmod(F.xxhash64("row", "kind", "start", F.lit("train")), F.lit(1_000_000)) < share))


def scored(found: DataFrame) -> DataFrame:
    """Candidates with ``score`` and the kind's ``threshold``."""
    spark = found.sparkSession
    made = stage(examples(spark), "pii-examples")
    halved = F.pmod(F.xxhash64("row", F.lit("fold")), F.lit(2))
    told = found.where("label IS NOT NULL").unionByName(made).withColumn("fit", halved == 0)
    counts = {r["kind"]: r["count"] for r in told.where("fit").groupBy("kind").count().collect()}  # a row a kind
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    training = _sampled(told.where("fit"), counts, TRAIN_ROWS)
    training = training.withColumn("weight", F.lit(1.0) / F.count("*").over(Window.partitionBy("kind"))).select("label", "weight", *FEATURES)
    training = stage(training.repartition(4), "pii-training")  # a bounded sample
    trees = GBTClassifier(maxIter=20, maxDepth=4, stepSize=0.2, seed=7, maxBins=32, weightCol="weight").fit(vectors.transform(training))
    judged = trees.transform(vectors.transform(found.unionByName(made))).withColumn(
        "score", F.get(vector_to_array("probability"), F.lit(1))).drop("features", "rawPrediction", "probability", "prediction")
    judged = stage(judged, "pii-scores")
    # All labelled candidates of the other fold, in a hundred steps of the score.
    fold = judged.where("label IS NOT NULL").where(halved == 1)
    steps = fold.groupBy("kind", F.floor(F.col("score") * 100).alias("step")).agg(
        F.sum("label").alias("yes"), F.count("*").alias("all"))
    above = Window.partitionBy("kind").orderBy(F.desc("step"))
    curve = steps.select("kind", "step", (F.sum("yes").over(above) / F.sum("all").over(above)).alias("precision"))
    own = curve.where(F.col("precision") >= PRECISION).groupBy("kind").agg(F.min("step").alias("least"))
    known = curve.select("kind").distinct().join(own, "kind", "left").select(
        "kind", F.coalesce(F.col("least") / 100, F.lit(2.0)).alias("threshold"))
    kinds = spark.createDataFrame([(k,) for k in PATTERNS], "kind string")
    limits = stage(kinds.join(known, "kind", "left").select("kind", F.coalesce("threshold", F.lit(2.0)).alias("threshold")), "pii-limits")
    return judged.where("row >= 0").join(limits, "kind", "left")


def scan(documents: DataFrame) -> DataFrame:
    """``row``, ``doc_id`` and all pattern matches of each document."""
    text = F.coalesce("text", F.lit(""))
    return documents.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.concat(*(_found(text, kind) for kind in PATTERNS)).alias("found"))


def spans(documents: DataFrame) -> DataFrame:
    """Per document the ``spans`` to redact, ordered by start and kind, with ``base`` and ``score`` (base spans: 1)."""
    scanned = stage(scan(documents), "pii-scan")
    found = stage(candidates(scanned), "pii-candidates")
    chosen = scored(found).where("base OR sure OR (score >= threshold AND kind NOT IN ('iban', 'handle'))")  # their checks decide all
    rank = F.array_position(F.array(*map(F.lit, PATTERNS)), F.col("kind"))
    lists = chosen.groupBy("row").agg(F.sort_array(F.collect_list(F.struct(
        "start", rank.alias("rank"), "end", "kind", "base", F.when(F.col("base"), 1.0).otherwise(F.col("score")).alias("score")))).alias("spans"))
    # A chosen span inside a base span, or inside a longer one, says nothing new.
    new = let(F.col("spans"), lambda kept: F.filter(kept, lambda s: s["base"] | ~F.exists(
        kept, lambda b: (b["start"] <= s["start"]) & (b["end"] >= s["end"]) & (b["base"] | (b["end"] - b["start"] > s["end"] - s["start"])))))
    return scanned.select("row", "doc_id").join(lists.withColumn("spans", new), "row", "left").select(
        "row", "doc_id",
        F.coalesce("spans", F.expr("CAST(array() AS array<struct<start:bigint,rank:bigint,end:bigint,kind:string,base:boolean,score:double>>)")).alias("spans"))


def span_text(found: Column) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    return F.concat_ws(",", F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def redact(documents: DataFrame, key: str | None = None) -> DataFrame:
    """The documents, all columns, with every span of ``text`` replaced by its kind in square brackets.

    ``key`` is a column that tells all rows apart; without one a copy of the input with row numbers is staged.
    """
    columns, keyed = documents.columns, documents
    if key is None:
        key, keyed = "pii_row", stage(documents.withColumn("pii_row", F.monotonically_increasing_id()), "pii-input")
    found = spans(keyed.select(F.col(key).alias("doc_id"), "text")).where(F.size("spans") > 0)
    marked = keyed.join(found.select(F.col("doc_id").alias(key), F.col("spans").alias("pii_spans")), key, "left")
    # Overlapping spans become one cut, named by the first.
    joined = F.aggregate("pii_spans", F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out")), lambda s, x: F.struct(
        F.greatest(s["at"], x["end"]).alias("at"),
        F.when(x["start"] >= s["at"], F.concat(s["out"], F.array(
            F.substring("text", (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int")), F.concat(F.lit("["), x["kind"], F.lit("]")))))
        .otherwise(s["out"]).alias("out")))
    redacted = let(joined, lambda s: F.concat(F.array_join(s["out"], ""), F.substring("text", (s["at"] + 1).cast("int"), F.length("text"))))
    return marked.select(*(
        F.when(F.size("pii_spans") > 0, redacted).otherwise(F.col("text")).alias("text") if c == "text" else c for c in columns))
