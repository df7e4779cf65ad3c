"""Quality rules, licences and personal data against brute force and planted cases."""

import re

import pytest
from llm_brute import BASE, corpus, frame, measures, personal, sha
from pyspark.sql import functions as F

from tastemesh.llm import licences as L
from tastemesh.llm import pii as P
from tastemesh.llm import quality as Q


@pytest.fixture(scope="module")
def docs():
    return corpus()


def test_measures(spark, docs):
    docs = docs | {200: "l one two\nl one two\n\n \nl one two\nx # $ <>", 201: "a b c d e f a b c d e g a b c d e"}
    rows = Q.measures(frame(spark, docs)).withColumn("failed", F.expr(Q.BASE)).collect()
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.failed) for r in rows}
    assert got == {i: measures(t) for i, t in docs.items()}


GOOD = "this is a clean text of more than ten different words in all of its lines {}"
BAD = "### $$$ *** %%% &&& some ### words $$$ between *** many %%% signs &&& here {}"


def _hosts(spark):
    rows = [(10_000 + i, GOOD.format(i), "good") for i in range(1500)]
    rows += [(1000 + i, BAD.format(i) if i % 10 else GOOD.format(i), "bad") for i in range(200)]
    rows += [(2000 + i, BAD.format(i) if i % 2 else GOOD.format(i), "mixed") for i in range(200)]
    rows += [(3000, BAD, "tiny"), (3001, GOOD, None), (3002, None, None), (3003, BAD, None)]
    rows += [(4000 + 100 * h + i, GOOD.format(i), f"h{h}") for h in range(12) for i in range(20)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_host_verdicts(spark):
    rows = {r.doc_id: r for r in Q.quality(_hosts(spark)).collect()}
    verdicts = {r.source: r.verdict for r in rows.values()}
    assert verdicts["good"] == verdicts["tiny"] == verdicts[None] == "normal"
    assert verdicts["bad"] == "reject" and verdicts["mixed"] == "strict"
    assert all(r.kept for r in rows.values() if r.source == "good")
    assert not any(r.kept for r in rows.values() if r.source == "bad")
    assert all(r.kept == (r.n_symbols == 0) for r in rows.values() if r.source == "mixed")
    assert rows[3000].kept and rows[3001].kept and not rows[3002].kept and rows[3002].base_failed


def test_shrinking(spark):
    rates = {(r.source, r.rule): r for r in Q.host_rates(Q.measures(_hosts(spark))).collect()}
    tiny, bad = rates["tiny", "symbols"], rates["bad", "symbols"]
    assert tiny.failed == tiny.n == 1 and tiny.rate < tiny.shrunk < 1
    assert abs(bad.shrunk - bad.failed / bad.n) < 0.05 and bad.deviation < tiny.deviation


def test_quality_of_edges(spark, docs):
    twice = frame(spark, {5: docs[5]}).unionByName(frame(spark, {5: docs[5]}))
    assert Q.quality(twice).count() == 2
    assert Q.quality(twice.where("false")).count() == 0


PII = {
    1: "write to jane.doe+x@mail.example.co.uk, or +49 (171) 555-0199. bye",
    2: "host 10.0.0.1 and 300.1.1.1 and 1.2.3.4.5.6.7.8 and 0255.000.1.2",
    3: "card 4111 1111 1111 1111, not 4111111111111112, nor 1 2 3; 4111-1111-1111-1111-99999",
    4: "é漢 \U0001f600 a@b.c%x@d.e é a@@b.c @x.y a@b .c x@y-.z.",
    5: "+1234567 +12345678901234567 +1 2 3 4 5 6 7 8 9 (0) ++49 30 1234567",
    6: None, 7: "", 8: "9" * 40_000, 9: "a" * 40_000 + "@", 10: "1.1" * 20_000, 11: "a@b.c " * 3000, 12: "1 " * 30_000,
    13: "a@b" + ".c" * 20_000,
}


def test_base_spans(spark):
    docs = PII | {100 + i: f"call +44 20 7946 {1000 + i} or mail u{i}@host{i}.org from 10.1.{i}.7 {4000 + i}" for i in range(80)}
    rows = P.spans(frame(spark, docs)).collect()
    assert len(rows) == len(docs)
    for r in rows:
        got = [(s.start, list(BASE).index(s.kind), s.end, s.kind) for s in r.spans if s.base]
        assert got == personal(docs[r.doc_id]), r.doc_id
        assert [s.start for s in r.spans] == sorted(s.start for s in r.spans)


def test_trees_add_spans(spark):
    """Secrets are found, plain values and card-like numbers that fail the check digit are not."""
    docs = {}
    for i in range(300):
        digits = f"{i:04d}" + sha(str(i)).translate(str.maketrans("abcdef", "123456"))[:12]
        docs[i] = [f'the token = "{sha(str(i))[:40]}" is new', f"set password: changeme{'x' * (i % 3)} now", f"item {digits} sold",
                   f"mail me at u{i}@example.org", f"my ssn is {100 + i}-45-{1000 + i}", "nothing here"][i % 6]
    found = {r.doc_id: [(s.kind, s.base) for s in r.spans] for r in P.spans(frame(spark, docs)).collect()}
    assert all(found[i] == [("secret", False)] for i in range(0, 300, 6))
    assert all(found[i] == [] for i in range(1, 300, 6))
    assert all(("email", True) in found[i] for i in range(3, 300, 6))
    assert all(found[i] == [] for i in range(5, 300, 6))


def test_every_added_kind_is_found(spark):
    """Planted spans of each kind, in a corpus with many that look like them, or none."""
    planted = {
        1: ("please write to jane.doe (at) example (dot) com today", "handle"), 2: ("pay to DE89 3704 0044 0532 0130 00 soon", "iban"),
        3: ("call me: (212) 555-0187.", "call"), 4: ("mac address 00:1b:44:11:3a:b7", "mac"), 5: ("the password: hunter27 is new", "secret"),
        6: ("my ssn is 123-45-6789", "ssn"), 7: ("set password = Xk7_pQ2m now", "secret"), 8: ("joe [at] mail [dot] example [dot] org", "handle"),
    }
    plain = {20: "login joe@localhost", 21: "in the years 1998 2001 2004", 22: "broadcast ff:ff:ff:ff:ff:ff", 23: "set password: changeme now",
             24: "account DE00 3704 0044 0532 0130 00 closed"}
    crowd = {100 + i: [f"login u{i}@host{i}", f"account DE{i % 90 + 10} 3704 0044 0532 0130 {i:02d} closed", "set password: changeme now"][i % 3] for i in range(240)}
    for docs in (planted | plain | crowd, planted | plain):
        rows = {r.doc_id: [s.kind for s in r.spans] for r in P.spans(frame(spark, {i: t[0] if isinstance(t, tuple) else t for i, t in docs.items()})).collect()}
        assert {i: rows[i] for i in planted} == {i: [k] for i, (_, k) in planted.items()}
        assert [rows[i] for i in plain] == [[]] * len(plain)


def test_examples_have_both_sorts(spark):
    rows = P.examples(spark).groupBy("kind").agg(F.sum("label").alias("yes"), F.count("*").alias("all")).collect()
    assert {r.kind for r in rows} == {"handle", "call", "ssn", "mac", "secret"}
    assert all(r.yes >= 50 and r["all"] - r.yes >= 50 for r in rows)


def test_redaction(spark):
    rows = {r.doc_id: r for r in P.redact(frame(spark, PII)).collect()}
    assert len(rows) == len(PII) and rows[1].columns if hasattr(rows[1], "columns") else True
    assert rows[1].text == "write to [email], or [phone]. bye"
    assert rows[4].text.startswith("é漢 \U0001f600 [email]") and rows[6].text is None and rows[7].text == ""
    assert set(rows[1].asDict()) == set(frame(spark, {}).columns)


def test_pii_without_labels(spark):
    assert P.spans(frame(spark, {1: "nothing", 2: None})).where(F.size("spans") > 0).isEmpty()
    assert P.spans(frame(spark, {1: "x"}).where("false")).count() == 0
    twice = frame(spark, {1: "a@b.cd"}).unionByName(frame(spark, {1: "a@b.cd"}))
    assert [len(r.spans) for r in P.spans(twice).collect()] == [1, 1]


def test_licences(spark, docs):
    texts = {
        1: "Some text.\nReleased under the MIT License.", 2: "a b c. Licensed under the Apache License, Version 2.0. more words",
        3: "This work is licensed under the GNU General Public License, version 3.", 4: "Licensed under CC BY-NC 4.0.",
        5: "He lost his driver license on the way.", 6: "Permission to enter the castle was denied.", 7: None, 8: "",
        9: "MIT students read about copyright law.", 10: "Copyright 2020 Example Corp. All rights reserved.",
        11: "Licensed under CC BY-SA 4.0.\nReleased under the MIT License.", 12: "license " * 5000,
    }
    rows = {r.doc_id: r for r in L.by_document(frame(spark, texts | {i + 1000: t for i, t in docs.items()})).collect()}
    assert {i: rows[i].families for i in texts} == {
        1: "mit", 2: "apache-2.0", 3: "gpl", 4: "cc-by-nc", 5: "", 6: "", 7: "", 8: "", 9: "", 10: "all-rights-reserved", 11: "cc-by-sa,mit", 12: ""}
    assert all(r.families == "" and r.n_licences == 0 for i, r in rows.items() if i >= 1000)
    assert len(rows) == len(texts) + len(docs)


NOTICES = {
    1: ("Intro text here.\nLicensed under CC\nBY-NC 4.0.", "cc-by-nc"),
    2: ("Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation\nfiles, to deal in it.", "mit"),
    3: ("Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following\nconditions are met:", "bsd"),
    4: ("This library is licensed under the GNU Lesser General Public\nLicense, version 2.1.", "lgpl"),
    5: ("Licensed under CC BY-NC-SA 4.0.", ""), 6: ("Not licensed under the MIT License.", ""), 7: ("This is not\nreleased under the MIT License.", ""),
    8: ("A heading\nReleased under the MIT License\n\nThe next paragraph", "mit"), 9: ("Released under the LGPL version 3.", "lgpl"),
    10: ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", ""),
    11: ("Licensed under CC BY-SA 4.0\nReleased under the MIT License", "cc-by-sa,mit"), 12: ("Released under the Apache\r\nLicense 2.0.\r\n\r\nMore", "apache-2.0"),
}


def test_wrapped_and_near_notices(spark, docs):
    """Equal rows and null ids each get their row; the search for cues loses no confirmed passage."""
    rows = frame(spark, {i: t for i, (t, _) in NOTICES.items()} | {1000 + i: t for i, t in docs.items() if len(t or "") < 2000})
    more = rows.where("doc_id IN (2, 8)").unionByName(rows.where("doc_id = 6").withColumn("doc_id", F.lit(None).cast("long")))
    rows = rows.unionByName(more)
    scanned = L.scan(rows).persist()
    found = L.summary(scanned).collect()
    assert len(found) == rows.count()
    want = {i: f for i, (_, f) in NOTICES.items()} | {None: ""}
    assert [(r.doc_id, r.families) for r in found if r.families != want.get(r.doc_id, "")] == []
    assert {r.n_licences for r in found if r.doc_id == 11} == {2} and {r.n_licences for r in found if r.doc_id == 2} == {1}
    seen = {(r.row, r.sentence, r.piece): r for r in scanned.collect() if r.passage is not None}
    texts = {r.doc_id: r.text for r in rows.collect()}
    for doc_id in {r.doc_id for r in seen.values()}:
        assert {(r.sentence, r.piece, r.passage) for r in seen.values() if r.doc_id == doc_id} == set(_cue_passages(texts[doc_id]))
    for r in seen.values():
        assert r.confirmed == _confirmed(r), r
    every = [r for r in L.scan(rows, cues="(?s).").collect() if r.confirmed]
    assert {(r.doc_id, r.passage) for r in every} == {(r.doc_id, r.passage) for r in seen.values() if r.confirmed}


def _cue_passages(text):
    sentences = [s for s in re.split(r"\n[ \t\r]*\n\s*|(?<=[.!?])\s+", text) if re.search(L.CUES, s)]
    for i, sentence in enumerate(sentences):
        yield i, 0, sentence
        if "\n" in sentence:
            yield from ((i, k, p) for k, p in enumerate(re.split(r"\s*\n\s*", sentence), 1) if re.search(L.CUES, p))


def _confirmed(row):
    """Overlap, telling words and qualifying pairs; the planted notices are negated as wholes only."""

    def tokens(passage):
        joined = re.sub(r"\b(non|share|no)[-\s]+(commercial|alike|derivatives)\b", r"\1\2", passage.lower())
        return [w for w in re.split(r"[^a-z0-9.]+|\.(?![0-9])", joined) if w]

    def pairs(words):
        return set(zip(["<", *words], [*words, ">"]))

    if row.family == L.UNKNOWN or row.score < row.threshold:
        return False
    words, best = tokens(row.passage), 0
    if re.search(r"\bnot (licensed|released)\b", " ".join(words)) or row.doc_id == 7:
        return False
    elsewhere = {w for f, texts in L.TEMPLATES.items() if f != row.family for t in texts for w in tokens(t)}
    qualifying = {tuple(q.split()) for q in L.QUALIFYING}
    for template in L.TEMPLATES[row.family]:
        telling, own = set(tokens(template)) - elsewhere, pairs(tokens(template))
        if (not telling or telling & set(words)) and own & qualifying == pairs(words) & qualifying:
            best = max(best, len(own & pairs(words)) / (len(own) if row.piece else min(len(own), len(pairs(words)))))
    return best >= L.OVERLAP


def test_licences_of_an_empty_table(spark):
    assert L.by_document(frame(spark, {1: "x"}).where("false")).count() == 0
