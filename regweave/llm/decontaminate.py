"""Benchmark decontamination with an Aho-Corasick automaton.

Texts are normalised to words (ASCII upper case lowered, runs of characters that
are ASCII digits, ASCII letters or beyond ASCII), joined by single spaces. The
automaton holds every window of the benchmark's items, delimited by spaces, and
reads each normalised text once; matches are mapped back to words and to offsets
of the original.

The benchmark is a parameter-sized table. Its windows are put into automatons of
at most ``MAX_BYTES`` of normalised text; a larger benchmark takes several passes
over the documents, one automaton each, whose results are combined.

Edge cases: a null or empty text has no words; an item without words has no
windows; an item whose id is null marks words but is not listed; rows that share
an item id are one item; repeated documents are judged one by one; an empty
benchmark or document table gives no hits or no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regweave.llm import blocks as B

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
MAX_BYTES = 16 << 20
HITS = ("doc_id long, n_words long, hits array<int>, items array<string>, "
        "spans array<struct<from_char:long,to_char:long>>")


def normalised(text: str) -> list[str]:
    return WORD.findall(text.translate(LOWER))


def _windows(items: list[tuple], length: int) -> dict[str, tuple[int, list[str]]]:
    """Delimited window -> (its number of words, ids of the items that hold it)."""
    out: dict[str, tuple[int, dict]] = {}
    for item, text in items:
        words = normalised(text or "")
        n = min(length, len(words))
        for i in range(len(words) - n + 1 if words else 0):
            held = out.setdefault(" " + " ".join(words[i:i + n]) + " ", (n, {}))[1]
            if item is not None:
                held[str(item)] = True
    return {k: (n, list(held)) for k, (n, held) in out.items()}


def _automaton(items: list[tuple], length: int):
    import ahocorasick
    out = ahocorasick.Automaton()
    for key, value in _windows(items, length).items():
        out.add_word(key, value)
    if len(out):
        out.make_automaton()
    return out


_built: dict[tuple, object] = {}


def _scanner(items: list[tuple], length: int, key: tuple):
    """Scan documents against one part of the benchmark."""
    def scan(text: str, automaton):
        lowered = text.translate(LOWER)
        words = WORD.findall(lowered)
        if not words or not len(automaton):
            return len(words), [], [], []
        joined = " " + " ".join(words) + " "
        ends, counts, items = [], [], {}
        for end, (n, held) in automaton.iter(joined):
            ends.append(end)
            counts.append(n)
            items.update(dict.fromkeys(held))
        if not ends:
            return len(words), [], [], []
        last = np.cumsum([len(w) + 1 for w in words])  # where the space after each word is
        stop = np.searchsorted(last, ends) + 1
        step = np.bincount(stop - np.array(counts), minlength=len(words) + 1)
        step = step - np.bincount(stop, minlength=len(words) + 1)
        hit = np.flatnonzero(np.cumsum(step)[:-1] > 0)
        at = [m.span() for m in WORD.finditer(lowered)]
        runs = B.spans_of(np.isin(np.arange(len(words)), hit))
        return len(words), hit.tolist(), sorted(items), [(at[a][0], at[b - 1][1]) for a, b in runs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _built:
            _built.clear()
            _built[key] = _automaton(items, length)
        automaton = _built[key]
        for b in B.text_slices(batches, 1):
            rows = [scan(t or "", automaton) for t in b.column(1).to_pylist()]
            n, hits, found, spans = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(hits, pa.list_(pa.int32())),
                 pa.array(found, pa.list_(pa.string())),
                 pa.array([[{"from_char": a, "to_char": z} for a, z in s] for s in spans],
                          pa.list_(pa.struct([("from_char", pa.int64()), ("to_char", pa.int64())]))),
                 *b.columns[2:]],
                ["doc_id", "n_words", "hits", "items", "spans", *b.schema.names[2:]])
    return run


def _parts(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple]]:
    """The benchmark in parts of bounded size, in order of its items."""
    rows = benchmark.select(F.col(id_col).cast("string"), F.col(text_col).cast("string"))
    part, size = [], 0
    for item, text in rows.toLocalIterator():
        part.append((item, text))
        size += len(text or "")
        if size > MAX_BYTES:
            yield part
            part, size = [], 0
    yield part


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, length: int = 10, id_col: str = "doc_id",
                   text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """(doc_id, n_words, hits, items, spans) of every document.

    hits: positions of words inside an occurrence of a window; items: ids of the
    items with occurring windows, as ascending strings; spans: the hit runs as
    character offsets of the original text.
    """
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    first, *others = _parts(benchmark, item_col, "text")
    if not others:
        return narrow.mapInArrow(_scanner(first, length, (id(first), length)), HITS)
    # several automatons: scan the same rows again, carrying the text along
    kept = HITS + ", text string"
    out = narrow.withColumn("again", F.col("text")).mapInArrow(
        _scanner(first, length, (id(first), length)), HITS + ", again string")
    for part in others:
        scan = _scanner(part, length, (id(part), length))

        def more(batches, scan=scan):
            for b in B.text_slices(batches, -1):
                got = next(scan(iter([pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), b.column("again")], ["id", "text"])])))
                merged = [[sorted(set(x) | set(y)) for x, y in zip(b.column(c).to_pylist(), got.column(c).to_pylist())]
                          for c in ("hits", "items")]
                spans = [_joined(x, y) for x, y in zip(b.column("spans").to_pylist(), got.column("spans").to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), b.column("n_words"), pa.array(merged[0], pa.list_(pa.int32())),
                     pa.array(merged[1], pa.list_(pa.string())), pa.array(spans, b.schema.field("spans").type),
                     b.column("again")], b.schema.names)
        out = out.mapInArrow(more, kept.replace("text string", "again string"))
    return out.drop("again")


def without_hits(docs: DataFrame, benchmark: DataFrame, length: int = 10, text_col: str = "text",
                 item_col: str = "item_id") -> DataFrame:
    """The rows of ``docs`` without a word in a benchmark window, with all their columns."""
    out, place = docs, docs.columns.index(text_col)
    for part in _parts(benchmark, item_col, "text"):
        scan = _scanner(part, length, (id(part), length))

        def clean(batches, scan=scan):
            for b in B.text_slices(batches, place):
                text = b.column(place).cast(pa.string())
                got = next(scan(iter([pa.RecordBatch.from_arrays([pa.nulls(len(b), pa.int64()), text], ["id", "text"])])))
                yield b.filter(pc.equal(pc.list_value_length(got.column("hits")), 0))
        out = out.mapInArrow(clean, docs.schema)
    return out


def _joined(x: list[dict], y: list[dict]) -> list[dict]:
    """Union of two lists of character runs."""
    out: list[dict] = []
    for s in sorted(x + y, key=lambda r: (r["from_char"], r["to_char"])):
        if out and s["from_char"] <= out[-1]["to_char"]:
            out[-1]["to_char"] = max(out[-1]["to_char"], s["to_char"])
        else:
            out.append(dict(s))
    return out
