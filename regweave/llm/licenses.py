"""Licence scan by ordered signature rules.

A text is normalised to words. Each rule names words it needs; only the rules whose
words are all in a text are tried there, on its words joined by single spaces. The
matches then compete in the order of the rules: one that lies inside a match of an
earlier rule is suppressed. What stays are the detections, mapped back to offsets of
the text. A few base phrases are always reported, suppressed or not.

Edge cases: a null or empty text has no words and no detections; ties between
matches of one rule cannot be, since a rule's matches do not overlap; repeated rows
are judged one by one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regweave.llm import blocks as B
from regweave.llm.license_rules import Rule, read_rules

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Phrases whose places are all counted, and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
SCANNED = ("doc_id long, n_words long, base array<struct<label:string,word:long>>, "
           "detections array<struct<label:string,rule:string,weight:double,from_char:long,to_char:long>>, score double")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


class Ruleset:
    """The rules and which of them a set of words admits."""

    def __init__(self, rules: list[Rule], base: dict[str, str] = BASE):
        self.rules = rules
        self.base = {tuple(p.encode().split()): label for p, label in base.items()}
        self.by_word: dict[bytes, list[int]] = defaultdict(list)
        for i, r in enumerate(rules):
            for w in r.words:
                self.by_word[w.encode()].append(i)
        self.keywords = frozenset(self.by_word)
        self.firsts = frozenset(p[0] for p in self.base)

    def admitted(self, words: list[bytes]) -> list[int]:
        """Rules all of whose words are there, in order."""
        if self.keywords.isdisjoint(words):
            return []
        there = defaultdict(int)
        for w in self.keywords.intersection(words):
            for i in self.by_word[w]:
                there[i] += 1
        return sorted(i for i, n in there.items() if n == len(self.rules[i].words))

    def base_places(self, words: list[bytes]) -> list[tuple[int, str]]:
        """(first word, label) of every place of a base phrase."""
        if self.firsts.isdisjoint(words):
            return []
        out = []
        for phrase, label in self.base.items():
            at = -1
            for _ in range(words.count(phrase[0])):
                at = words.index(phrase[0], at + 1)
                if tuple(words[at:at + len(phrase)]) == phrase:
                    out.append((at, label))
        return sorted(out)

    def detections(self, words: list[bytes]) -> list[tuple[int, int, Rule]]:
        """(first word, last word, rule) of every match that stays."""
        rules = self.admitted(words)
        if not rules:
            return []
        text = b" ".join(words).decode()
        gaps = np.array([m.start() for m in re.finditer(" ", text)], np.int64)
        kept: list[tuple[int, int, Rule]] = []
        starts, reach = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for i in rules:
            found = np.array([m.span() for m in self.rules[i].pattern.finditer(text) if m.end() > m.start()], np.int64)
            if not len(found):
                continue
            first = np.searchsorted(gaps, found[:, 0])
            last = np.searchsorted(gaps, found[:, 1] - 1)
            # the furthest end of the kept matches that begin at or before this one
            before = np.searchsorted(starts, first, "right") - 1
            free = (before < 0) | (reach[before] < last) if len(starts) else np.ones(len(found), bool)
            kept += [(int(a), int(z), self.rules[i]) for a, z in zip(first[free], last[free])]
            ordered = sorted((a, z) for a, z, _ in kept)
            starts = np.array([a for a, _ in ordered], np.int64)
            reach = np.maximum.accumulate(np.array([z for _, z in ordered], np.int64)) if ordered else starts
        return sorted(kept, key=lambda d: d[:2])


def scan_licenses(docs: DataFrame, rules: list[Rule] | None = None, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, base, detections, score) of every document.

    base: label and first word of every place of a base phrase. detections: label,
    rule, weight and character offsets of the matches that stay. score: one minus the
    product of (1 - weight) over the labels detected, each with its heaviest match, or
    of 0.5 for base labels that no detection has.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ruleset = Ruleset(read_rules() if rules is None else rules)
        for part in B.text_slices(batches, 1):
            rows = []
            for raw in B.text_bytes(part.column(1)):
                words = words_of(raw)
                base, kept = ruleset.base_places(words), ruleset.detections(words)
                at = [m.span() for m in WORD.finditer(_lowered(raw))] if kept else []
                found = [(r.label, r.name, r.weight, at[a][0], at[z][1]) for a, z, r in kept]
                rows.append((len(words), base, found, score(base, found)))
            yield pa.RecordBatch.from_arrays([
                part.column(0), pa.array([r[0] for r in rows], pa.int64()),
                pa.array([[{"label": c, "word": w} for w, c in r[1]] for r in rows], _BASE),
                pa.array([[dict(zip(_NAMES, d)) for d in r[2]] for r in rows], _FOUND),
                pa.array([r[3] for r in rows], pa.float64())], ["doc_id", "n_words", "base", "detections", "score"])
        B.release()

    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, SCANNED)


def _lowered(raw: bytes) -> str:
    return raw.lower().decode()  # bytes.lower() changes A-Z only


def score(base: list[tuple[int, str]], found: list[tuple]) -> float:
    weight = {label: 0.5 for _, label in base}
    for label, _, w, *_ in found:
        weight[label] = max(weight.get(label, 0.0), w)
    return 1.0 - float(np.prod([1.0 - w for _, w in sorted(weight.items())])) if weight else 0.0


_NAMES = ["label", "rule", "weight", "from_char", "to_char"]
_BASE = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))
_FOUND = pa.list_(pa.struct([("label", pa.string()), ("rule", pa.string()), ("weight", pa.float64()),
                             ("from_char", pa.int64()), ("to_char", pa.int64())]))
