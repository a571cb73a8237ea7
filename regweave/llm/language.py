"""Language identification by interpolated Kneser-Ney character models.

A word, between two spaces, is the unit: its characters are predicted from up to
``ORDER - 1`` characters before them, so equal words have equal probabilities.

1. Blocks. Documents are packed into blocks of about ``BLOCK_BYTES`` of text, each
   with its distinct words and the words of every document as numbers of them, so
   a text is split once.
2. Counts. Words per language come from the blocks, character n-grams from the
   distinct words. The highest order uses counts, the lower orders continuation
   counts, with one discount per order (n1 / (n1 + 2 n2)); the lowest order is
   interpolated with a uniform distribution. Joins of each order with the one
   below give the log probabilities, and each context its back-off weight.
3. Scores. A block asks the buckets of the hash space for the n-grams of its
   distinct words, and gets what each language holds of them; these sorted hash
   arrays score the words, and their numbers the documents. The model as a whole
   is in no task and not on the driver, whatever its size; every order is kept.
4. Calibration. About ``CALIBRATION`` labelled documents at most, chosen by hash
   and a tenth at most, are left out of the counts. The temperature of a softmax
   of the entropies is the likeliest for them, with smoothed targets; below the
   rejection limit lies the confidence of 1 in 200 of those classified rightly.

The language of least cross-entropy per character is chosen; ties go to the first
by name. The set of languages is held by the driver and every task.

Edge cases: a text that is null or has no letter is ``und`` with score 0; a null
language is no training row; a language all of whose documents would be left out
keeps them; without training rows every text is ``und``; repeated rows count as
often as they occur; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regweave.llm import blocks as B
from regweave.session import cut_lineage, discard

ORDER = 5
CALIBRATION = 20_000
BLOCK_BYTES = 32 << 20
#: Characters of words that are scored at once.
PART = 1 << 18
#: Log probability of a character that a language never has.
NEVER = float(np.log(1e-7))
WORD = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"
_TRAIN, _FOLD = 1, 2


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _words(text: str) -> list[str]:
    return WORD.findall(text.lower())


# -- blocks ------------------------------------------------------------------------------------

def _write_blocks(docs: DataFrame) -> DataFrame:
    """(block, payload, n_bytes) of (id, text, held, lab, part)."""
    types = {"id": pa.int64(), "held": pa.bool_(), "lab": pa.int32(), "part": pa.int32()}

    def build(batches):
        number = TaskContext.get().partitionId() << 24
        columns: list[list] = [[] for _ in types]
        place: dict[str, int] = {}
        counts, codes, size = [], [], 0

        def flush():
            code = np.concatenate(codes)
            one = [pa.array([x], pa.list_(t)) for x, t in zip(columns, types.values())]
            one += [pa.array([np.concatenate(counts)], pa.list_(pa.int32())),
                    pa.array([list(place)], pa.list_(pa.string())),
                    # byte by byte, which compresses better
                    pa.array([code.view(np.uint8).reshape(-1, 4).T.tobytes()], pa.binary())]
            whole = pa.RecordBatch.from_arrays(one, [*types, "count", "word", "code"])
            return pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([B.packed(whole)], pa.binary()),
                 pa.array([size], pa.int64())], ["block", "payload", "n_bytes"])

        for b in B.text_slices(batches, 1):
            texts = [_words(t or "") for t in b.column(1).to_pylist()]
            codes.append(np.fromiter((place.setdefault(w, len(place)) for w in chain.from_iterable(texts)), "<i4"))
            counts.append(np.fromiter(map(len, texts), np.int32, len(texts)))
            for held, c in zip(columns, (0, 2, 3, 4)):
                held.extend(b.column(c).to_pylist())
            size += b.column(1).nbytes
            if size >= BLOCK_BYTES:
                yield flush()
                columns, place, counts, codes, size = [[] for _ in types], {}, [], [], 0
                number += 1
        if counts:
            yield flush()
        B.release()

    return cut_lineage(docs.mapInArrow(build, "block long, payload binary, n_bytes long"))


def _own_codes(docs: pa.Table) -> np.ndarray:
    data = docs["code"][0].as_py()
    return np.frombuffer(data, np.uint8).reshape(4, -1).T.copy().view("<i4").ravel()


def _own(docs: pa.Table, column: str):
    return docs[column].combine_chunks().values


def _count_words(_: int, docs: pa.Table, got: B.Answers) -> Iterator[pa.RecordBatch]:
    """Words per language of the training documents of a block."""
    words = _own(docs, "word")
    count, code = _own(docs, "count").to_numpy(), _own_codes(docs)
    lab, part = (_own(docs, c).to_numpy() for c in ("lab", "part"))
    used = np.repeat(part == _TRAIN, count)
    key, n = np.unique(np.repeat(lab, count)[used].astype(np.int64) * max(1, len(words)) + code[used],
                       return_counts=True)
    lang, word = np.divmod(key, max(1, len(words)))
    yield pa.RecordBatch.from_arrays([pa.array(lang.astype(np.int32)), words.take(pa.array(word)),
                                      pa.array(n.astype(np.int64))], ["lang", "word", "n"])


# -- counts and probabilities ------------------------------------------------------------------

def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words, each between two spaces, and where each word begins."""
    joined = "".join(f" {w} " for w in words)
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.array([len(w) + 2 for w in words], np.int64)
    return points, np.cumsum(sizes) - sizes


def _ngrams(words: list[str], order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For n = 1..order: hash of the n-gram that ends at each character, and where it fits in the word."""
    points, starts = _codes(words)
    depth = np.arange(len(points)) - np.repeat(starts, np.diff(np.append(starts, len(points))))
    out = []
    for n in range(1, order + 1):
        h = np.zeros(len(points), np.uint64)
        for j in range(min(n, len(points))):
            h[j:] += (points[:len(points) - j] + np.uint64(1)) * B.odd(7000 + j)
        out.append((B.mix(h + np.uint64(n)), depth >= n - 1))
    return out


def _count_ngrams(order: int):
    """Counts of the n-grams of weighted words: (lang, n, gram, context, n-1 suffix, count)."""
    def fn(batches):
        for b in B.text_slices(batches, 1, 200_000):
            langs, words, weights = (c.to_pylist() for c in b.columns)
            by: dict[str, list[int]] = {}
            for i, lang in enumerate(langs):
                by.setdefault(lang, []).append(i)
            for lang, rows in by.items():
                own = [words[i] for i in rows]
                grams = _ngrams(own, order)
                points, starts = _codes(own)
                w = np.repeat(np.array([weights[i] for i in rows], np.int64), np.diff(np.append(starts, len(points))))
                first = np.zeros(len(points), bool)
                first[starts] = True
                for n in range(1, order + 1):
                    h, fits = grams[n - 1]
                    at = np.flatnonzero(fits & ~first)  # the space before a word is never predicted
                    if not len(at):
                        continue
                    g = B.Groups(h[at])
                    one = at[g.order[g.starts]]
                    context = grams[n - 2][0][one - 1] if n > 1 else np.zeros(len(one), np.uint64)
                    shorter = grams[n - 2][0][one] if n > 1 else np.zeros(len(one), np.uint64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(one), lang, np.int32)), pa.array(np.full(len(one), n, np.int32)),
                         pa.array(g.values.view(np.int64)), pa.array(context.view(np.int64)),
                         pa.array(shorter.view(np.int64)), pa.array(g.reduce(np.add, w[at]))],
                        ["lang", "n", "gram", "context", "shorter", "count"])
    return fn


def _log_table(words: DataFrame, order: int) -> DataFrame:
    """(key, code, value): of language ``code // 2`` the log probability (even code) or back-off weight (odd)."""
    schema = "lang int, n int, gram long, context long, shorter long, count long"
    counts = cut_lineage(words.mapInArrow(_count_ngrams(order), schema).groupBy("lang", "n", "gram").agg(
        F.first("context").alias("context"), F.first("shorter").alias("shorter"), F.sum("count").alias("count")))
    # continuation counts: how many longer n-grams end in this one
    longer = counts.filter("n > 1").groupBy("lang", (F.col("n") - 1).alias("n"), F.col("shorter").alias("gram")).agg(
        F.count("*").alias("before"))
    used = cut_lineage(counts.join(longer, ["lang", "n", "gram"], "left").select(
        "lang", "n", "gram", "context", "shorter",
        # the n-grams at the start of a word have nothing before them and keep their count
        F.when(F.col("n") == order, F.col("count")).otherwise(F.coalesce("before", "count")).alias("c")))
    ones, twos = F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)
    discounts = used.groupBy("lang", "n").agg(
        F.when((ones > 0) & (twos > 0), ones / (ones + 2 * twos)).otherwise(F.lit(0.5)).alias("d"))
    spread = used.groupBy("lang", "n", "context").agg(F.sum("c").alias("total"), F.count("*").alias("kinds"))
    # one row per language and order
    terms = cut_lineage(used.join(spread, ["lang", "n", "context"]).join(F.broadcast(discounts), ["lang", "n"]).select(
        "lang", "n", "gram", "context", "shorter",
        (F.greatest(F.col("c") - F.col("d"), F.lit(0.0)) / F.col("total")).alias("own"),
        (F.col("d") * F.col("kinds") / F.col("total")).alias("back")))
    letters = terms.filter("n = 1").select("gram").distinct().count()
    levels: list[DataFrame] = []
    for n in range(1, order + 1):
        level = terms.filter(F.col("n") == n)
        if n == 1:
            level = level.withColumn("below", F.lit(1.0 / (letters + 1)))
        else:
            level = level.join(levels[-1].select("lang", F.col("gram").alias("shorter"), F.col("p").alias("below")),
                               ["lang", "shorter"])
        levels.append(cut_lineage(level.select("lang", "gram", (F.col("own") + F.col("back") * F.col("below")).alias("p"))))
    out = terms.filter("n > 1").groupBy("lang", "context").agg(F.first("back").alias("back")).select(
        F.col("context").alias("key"), (2 * F.col("lang") + 1).alias("code"), F.log("back").cast("float").alias("value"))
    for level in levels:
        out = out.unionByName(level.select(
            F.col("gram").alias("key"), (2 * F.col("lang")).alias("code"), F.log("p").cast("float").alias("value")))
    out = cut_lineage(out)
    for table in (counts, used, terms, *levels):
        discard(table)
    return out


# -- scores ------------------------------------------------------------------------------------

_ENTRY = np.dtype([("key", "<u8"), ("code", "<i4"), ("value", "<f4")])


def _model_messages(buckets: int):
    """The model as messages of block -1."""
    def run(batches):
        def rows():
            for b in batches:
                found = np.empty(len(b), _ENTRY)
                found["key"] = b.column(0).to_numpy().view(np.uint64)
                found["code"], found["value"] = b.column(1).to_numpy(), b.column(2).to_numpy()
                for bucket, idx in B.route(B.buckets_of(found["key"], buckets)):
                    yield bucket, -1, found[idx].tobytes()
        yield from B.message_batches(rows(), ["bucket", "block", "data"])
    return run


def _parts(words: list[str]) -> Iterator[list[str]]:
    """Words in slices of about ``PART`` characters."""
    at, size = 0, 0
    for i, w in enumerate(words):
        if size > PART:
            yield words[at:i]
            at, size = i, 0
        size += len(w)
    if words:
        yield words[at:]


def _wanted(words: list[str], order: int) -> np.ndarray:
    """Ascending hashes of the n-grams of words."""
    parts = [np.unique(np.concatenate([h[fits] for h, fits in _ngrams(part, order)])) for part in _parts(words)]
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def _sender(order: int, buckets: int):
    def fn(docs: pa.Table, got: B.Answers) -> Iterator[tuple[int, bytes]]:
        keys = _wanted(_own(docs, "word").to_pylist(), order)
        for bucket, idx in B.route(B.buckets_of(keys, buckets)):
            yield bucket, keys[idx].tobytes()
    return fn


def _look_up(blocks: list[int], messages: list[bytes]) -> Iterator[tuple[int, bytes]]:
    """For each asked hash the number of its entries, then their codes and values."""
    model = np.concatenate([np.zeros(0, _ENTRY)] + [np.frombuffer(m, _ENTRY) for b, m in zip(blocks, messages) if b < 0])
    model = model[np.lexsort((model["code"], model["key"]))]
    for block, m in zip(blocks, messages):
        if block < 0:
            continue
        asked = np.frombuffer(m, np.uint64)
        lo, hi = (np.searchsorted(model["key"], asked, side) for side in ("left", "right"))
        n = hi - lo
        at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        data = n.astype(np.uint32).tobytes() + model["code"][at].tobytes() + model["value"][at].tobytes()
        yield block, len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


class Model:
    """Ascending hashes of n-grams, and per (hash, language) log probabilities and back-off weights."""

    def __init__(self, keys: np.ndarray, logs: np.ndarray, backs: np.ndarray, order: int):
        self.keys, self.logs, self.backs, self.order = keys, logs, backs, order

    @classmethod
    def of(cls, keys: np.ndarray, answers: dict[int, bytes], languages: int, buckets: int, order: int) -> Model:
        logs = np.full((len(keys), languages), np.nan, np.float32)
        backs = np.zeros((len(keys), languages), np.float32)
        for bucket, idx in B.route(B.buckets_of(keys, buckets)):
            answer = answers[bucket]
            data = pa.decompress(answer[8:], int.from_bytes(answer[:8], "little"), "zstd", asbytes=True)
            n = np.frombuffer(data, np.uint32, len(idx))
            code = np.frombuffer(data, np.int32, int(n.sum()), 4 * len(idx))
            value = np.frombuffer(data, np.float32, len(code), 4 * (len(idx) + len(code)))
            row, odd = np.repeat(idx, n), code % 2 == 1
            logs[row[~odd], code[~odd] // 2] = value[~odd]
            backs[row[odd], code[odd] // 2] = value[odd]
        return cls(keys, logs, backs, order)

    def scores(self, words: list[str]) -> np.ndarray:
        """Log probability of each word in each language."""
        points, starts = _codes(words)
        grams = _ngrams(words, self.order)
        first = np.zeros(len(points), bool)
        first[starts] = True
        at = np.flatnonzero(~first)
        total = np.zeros((len(at), self.logs.shape[1]))
        missing = np.ones(total.shape, bool)
        for n in range(self.order, 0, -1):
            h, fits = grams[n - 1]
            usable = np.flatnonzero(fits[at])
            value = self.logs[self._row(h[at[usable]])]
            found = missing[usable] & ~np.isnan(value)
            total[usable] += np.where(found, value, 0)
            missing[usable] &= ~found
            if n > 1:
                shorter, fits = grams[n - 2]
                usable = np.flatnonzero(fits[at - 1])
                weight = self.backs[self._row(shorter[at[usable] - 1])]
                total[usable] += np.where(missing[usable], weight, 0)
        total[missing] += NEVER
        return np.add.reduceat(total, np.searchsorted(at, starts), axis=0)

    def _row(self, wanted: np.ndarray) -> np.ndarray:
        """Where a hash is; all n-grams of the words were asked for."""
        return np.searchsorted(self.keys, wanted)


def _scorer(languages: int, order: int, buckets: int):
    def fn(_: int, docs: pa.Table, got: B.Answers) -> Iterator[pa.RecordBatch]:
        words = _own(docs, "word").to_pylist()
        model = Model.of(_wanted(words, order), got.get(0, {}), languages, buckets, order)
        table = np.concatenate([np.zeros((0, languages))] + [model.scores(part) for part in _parts(words)])
        count, code = _own(docs, "count").to_numpy(), _own_codes(docs)
        some = np.flatnonzero(count)
        begins = (np.cumsum(count, dtype=np.int64) - count)[some]
        chars, entropy = np.zeros(len(count), np.int64), np.zeros((len(count), languages))
        if len(some):
            chars[some] = np.add.reduceat(np.array([len(w) + 1 for w in words], np.int64)[code], begins)
            for k in range(languages):
                entropy[some, k] = -np.add.reduceat(table[code, k], begins) / chars[some]
        yield pa.RecordBatch.from_arrays(
            [_own(docs, "id"), _own(docs, "held"), _own(docs, "lab"), _own(docs, "part"), pa.array(chars),
             pa.ListArray.from_arrays(pa.array(np.arange(len(count) + 1, dtype=np.int32) * languages),
                                      pa.array(entropy.ravel()))],
            ["doc_id", "held_out", "lab", "part", "chars", "entropies"])
    return fn


def calibrate(entropy: np.ndarray, lang: np.ndarray) -> tuple[float, float]:
    """Temperature and rejection limit from documents that were left out of the counts.

    The right language of N documents has the target (N + 1) / (N + 2), the others
    share the rest, so a temperature above zero is likeliest even without errors.
    """
    if not len(lang) or entropy.shape[1] < 2:
        return 1.0, 0.0
    right, n = np.arange(len(lang)), len(lang)
    rest = 1 / (n + 2)

    def likelihood(t: float) -> float:
        x = (entropy.min(axis=1, keepdims=True) - entropy) / t
        x = x - np.log(np.exp(x).sum(axis=1, keepdims=True))
        own = x[right, lang]
        return float(((1 - rest) * own + rest * (x.sum(axis=1) - own) / (entropy.shape[1] - 1)).mean())

    temperature = max((2.0 ** (k / 4) for k in range(-40, 13)), key=likelihood)
    sure = 1 / np.exp((entropy.min(axis=1, keepdims=True) - entropy) / temperature).sum(axis=1)
    good = entropy.argmin(axis=1) == lang
    return temperature, float(np.quantile(sure[good], 0.005)) if good.any() else 0.0


def identify_languages(docs: DataFrame, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text",
                       lang_col: str = "lang", sample: int = CALIBRATION) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected, entropy).

    The models know the documents that are not held out; all are predicted, from
    the text alone.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"),
        F.col(lang_col).cast("string").alias("lang"), held_out(F.col(id_col)).alias("held"),
        F.pmod(F.xxhash64(F.lit(11), F.col(id_col)), F.lit(1_000_000)).alias("dice"))
    known = rows.filter("lang is not null and not held")
    share = int(min(0.1, sample / max(1, known.count())) * 1_000_000)
    found = known.groupBy("lang").agg(F.count_if(F.col("dice") >= share).alias("kept")).orderBy("lang").collect()
    langs = [r.lang for r in found]
    if not langs:
        return rows.select(F.col("id").alias("doc_id"), F.col("held").alias("held_out"), F.lit(UNKNOWN).alias("lang_pred"),
                           F.lit(0.0).alias("score"), F.lit(True).alias("rejected"), F.lit(None).cast("double").alias("entropy"))
    names = F.array(*map(F.lit, langs))
    whole = [r.lang for r in found if not r.kept]
    left_out = (F.col("dice") < share) & ~F.col("lang").isin(whole)
    blocks = _write_blocks(rows.select(
        "id", "text", "held",
        F.coalesce(F.array_position(names, F.col("lang")) - 1, F.lit(-1)).cast("int").alias("lab"),
        F.when(F.col("lang").isNull() | F.col("held"), 0).when(left_out, _FOLD).otherwise(_TRAIN).alias("part")))
    words = cut_lineage(B.each_block(blocks, [], _count_words, "lang int, word string, n long")
                        .groupBy("lang", "word").agg(F.sum("n").alias("n")))
    table = _log_table(words, order)
    discard(words)
    buckets = B.bucket_count(blocks, 0.4)
    sent = B.send(blocks, [], _sender(order, buckets)).unionByName(
        table.mapInArrow(_model_messages(buckets), B.MESSAGES))
    answers = B.relay(sent, 0, _look_up, written=False)
    scored = cut_lineage(B.each_block(
        blocks, [answers], _scorer(len(langs), order, buckets),
        "doc_id long, held_out boolean, lab int, part int, chars long, entropies array<double>"))
    for written in (blocks, table):
        discard(written)
    fold = scored.filter((F.col("part") == _FOLD) & (F.col("chars") > 0)).select("lab", "entropies").toArrow()
    temperature, limit = calibrate(
        np.array(fold["entropies"].to_pylist()).reshape(fold.num_rows, len(langs)), fold["lab"].to_numpy())
    low = F.array_min("entropies")
    score = 1 / F.aggregate("entropies", F.lit(0.0), lambda a, e: a + F.exp((low - e) / temperature))
    some = F.col("chars") > 0
    return scored.select(
        "doc_id", "held_out",
        F.when(some, F.element_at(names, F.array_position("entropies", low).cast("int"))).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(some, score).otherwise(0.0).alias("score"),
        (~some | (score < limit)).alias("rejected"), F.when(some, low).alias("entropy"))
