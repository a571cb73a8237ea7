"""Licence scans against every rule on every text."""

import re

import pytest

from regweave.llm.license_rules import read_rules
from regweave.llm.licenses import BASE, Ruleset, scan_licenses, words_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
TEXTS = ["Licensed under CC BY-NC 4.0.", "All rights reserved. (c) all RIGHTS, reserved", "GNU General Public License, version 2.0 or later",
         "This work is licensed under the GNU General Public License, version 3.", "Released under the MIT License.",
         "Licensed under the Apache License, Version 2.0 (the \"License\"); see http://www.apache.org/licenses/LICENSE-2.0",
         "SPDX-License-Identifier: BSD-3-Clause", "cc cc by by-sa 3.0", "This is free and unencumbered software released into the public domain.",
         "Redistribution and use in source and binary forms, with or without modification, are permitted", "Kein Wort davon, Überraschung",
         "general public", "", None, "mit license " * 300, "é All rights reserved"]


def brute(text, rules):
    lowered = (text or "").translate(LOWER)
    words = WORD.findall(lowered)
    base = sorted((i, label) for phrase, label in BASE.items() for i in range(len(words))
                  if words[i:i + len(phrase.split())] == phrase.split())
    joined, kept = " ".join(words), []
    for rule in rules:
        found = [(joined[:m.start()].count(" "), joined[:m.end()].count(" "), rule) for m in rule.pattern.finditer(joined)]
        kept += [d for d in found if not any(k[0] <= d[0] and d[1] <= k[1] for k in kept)]
    at = [m.span() for m in WORD.finditer(lowered)]
    return len(words), base, sorted((at[a][0], at[z][1], r.name) for a, z, r in kept)


def test_rules():
    rules = read_rules()
    assert len(rules) > 300 and len({r.name for r in rules}) == len(rules)
    assert all(r.words and all(words_of(w.encode()) == [w.encode()] for w in r.words) for r in rules)


@pytest.mark.parametrize("text, label", [
    ("the GNU Lesser General Public License v3.0", "lgpl-3.0"), ("Creative Commons Attribution-ShareAlike 4.0", "cc-by-sa-4.0"),
    ("http://creativecommons.org/licenses/by-nc-nd/3.0/", "cc-by-nc-nd-3.0"), ("under the new BSD license", "bsd-3-clause"),
    ("subject to the terms of the Mozilla Public License, v. 2.0", "mpl-2.0"), ("Eclipse Public License - v 2.0", "epl-2.0"),
    ("SPDX-License-Identifier: GPL-2.0-or-later", "gpl-2.0-or-later"), ("dual-licensed", "dual"), ("SIL Open Font License 1.1", "ofl-1.1")])
def test_labels(text, label):
    assert label in {r.label for _, _, r in Ruleset(read_rules()).detections(words_of(text.encode()))}


def test_earlier_rules_suppress_what_they_contain():
    found = Ruleset(read_rules()).detections(words_of(b"SPDX-License-Identifier: MIT-0, and the MIT License"))
    assert [r.label for _, _, r in found] == ["mit", "mit-0", "mit"] or [r.label for _, _, r in found] == ["mit-0", "mit"]
    found = Ruleset(read_rules()).detections(words_of(b"GNU Affero General Public License version 3"))
    assert [(a, z, r.label) for a, z, r in found] == [(0, 6, "agpl-3.0")]


def test_against_every_rule(spark, documents):
    rules = read_rules()
    texts = TEXTS + [f"{a} and {b}" for a in TEXTS[:10] for b in TEXTS[:10]]
    rows = [(1000 + i, t) for i, t in enumerate(texts)]
    more = spark.createDataFrame(rows, "doc_id long, text string")
    docs = documents.select("doc_id", "text").unionByName(more).selectExpr("*", "text as base", "1 as score", "2 as id")
    out = {r.doc_id: r for r in scan_licenses(docs).collect()}
    for r in docs.collect():
        n, base, kept = brute(r.text, rules)
        got = out[r.doc_id]
        assert (got.n_words, [(b.word, b.label) for b in got.base]) == (n, base)
        assert sorted((d.from_char, d.to_char, d.rule) for d in got.detections) == kept
        assert 0 <= got.score <= 1 and (got.score > 0) == bool(base or kept)


def test_odd_rows(odd_documents, no_documents):
    assert scan_licenses(no_documents).count() == 0
    out = scan_licenses(odd_documents).collect()
    assert len(out) == 7 and all(r.score == 0 and r.detections == [] for r in out)
