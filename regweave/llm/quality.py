"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or abstain on every document; the table of
labels, where it has a row, is one more labeller. Votes are counted by pattern over
all documents, and expectation-maximisation on these counts estimates how often
each labeller is right when it votes good or bad, and from that the probability of
good for each pattern. A linear scorer over hashed words and heuristic votes (never
the labels) is then trained towards these posteriors and scores all documents. A
document is rejected by its score, or by a posterior of its votes below ``DOUBT``.

Training of the scorer uses at most ``SAMPLE`` documents, and the vocabulary of
the toxicity labeller at most ``SAMPLE`` labelled rows, both chosen by hash; votes,
accuracies, posteriors and scores cover every document.

Edge cases: a null or empty text has no words, every labeller abstains but the one
for length, which votes bad, and it is rejected; null ids are kept; repeated rows
are judged alike; an empty table gives no rows; without labels the default terms
are used. Other columns of the input are kept by ``filter_quality``.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regweave.llm.blocks import release, text_slices
from regweave.session import cut_lineage

DIMENSIONS = 1 << 18
SAMPLE = 8_000
#: What makes a word or the beginning of a word a toxic term.
WORD_SHARE, LEAST, KINDS, MOST, PREFIXES = 0.08, 10, 4, 0.02, (4, 5, 6)
#: Terms that count as toxic besides those learned from labels.
TOXIC_TERMS = ("idiot", "moron", "stupid", "scum", "trash", "loser", "worthless", "pathetic", "disgusting", "clown")
ABSTAIN, BAD, GOOD = 0, 1, 2
#: Labellers: name, vote, from and to which value of the signal they cast it. They abstain otherwise.
LABELLERS = (
    ("upper", BAD, 0.3, 9e9), ("repeated", BAD, 0.15, 9e9), ("symbols", BAD, 0.25, 9e9), ("tables", BAD, 0.08, 9e9),
    ("variety", BAD, 0.85, 9e9), ("toxic", BAD, 0.01, 9e9), ("empty", BAD, 1.0, 9e9), ("prose", GOOD, 0.7, 9e9),
)
#: Accuracies that bad, good and label votes start with, and how many times its votes this counts
#: against what is observed.
START_BAD, START_GOOD, START_LABEL, TRUST = 0.97, 0.7, 0.999, 0.2
#: Share of good documents to start with.
BALANCE = 0.9
DOUBT = 0.2
SCORED = "doc_id long, score double, votes string, posterior double, keep boolean"
_SYMBOLS = b"#$%&*!?@^~=+<>"
_PUNCTUATION = string.punctuation.encode()


Terms = tuple[frozenset, frozenset, tuple]


def bare_words(text: str) -> list[bytes]:
    """Lower-case words (UTF-8) without ASCII punctuation."""
    return text.lower().encode("utf-8", "replace").translate(None, _PUNCTUATION).split()


def signals(text: str, terms: Terms) -> tuple[list[float], set[bytes]]:
    """Values of the labellers' signals, and the bare words.

    ``terms``: words, and beginnings of words with their lengths, that count as toxic.
    """
    toxic, begins, lengths = terms
    words, raw = text.split(), text.encode("utf-8", "replace")
    n = len(words)
    bare = bare_words(text)
    own = set(bare)
    if not n:
        return [0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0], own
    few = 20  # shares of fewer words are damped
    m = max(n, few)
    hits = own & toxic
    hits.update(w for k in lengths for w in own if w[:k] in begins)
    return [
        sum(map(str.isupper, words)) / m,
        sum(map(eq, words, words[1:])) / m,
        (len(raw) - len(raw.translate(None, _SYMBOLS))) / m,
        words.count("|") / m,
        # share of words that are repeats, in excess of what long texts have anyway
        max(0.0, 1 - len(own) / min(n, 400)) if n >= few else 0.0,
        # one such word among many is left to the scorer
        sum(map(hits.__contains__, bare)) / m if hits else 0.0,
        0.0,
        sum(map(str.islower, words)) / m,
    ], own


def votes(values: list[float]) -> str:
    return "".join(str(vote if low <= v <= high else ABSTAIN) for v, (_, vote, low, high) in zip(values, LABELLERS))


def estimate(patterns: dict[str, int], rounds: int = 1000, tol: float = 1e-9) -> tuple[dict[str, float], np.ndarray]:
    """Posterior of good for each vote pattern, and accuracy of each labeller's bad and good votes.

    The accuracy of a vote is how often it is right where it is cast. A document
    starts from the overall odds, and each vote multiplies them by what it changes:
    its own odds against the overall ones. Abstaining says nothing.
    """
    keys = sorted(patterns)
    if not keys:
        return {}, np.zeros((0, 2))
    n = np.array([patterns[k] for k in keys], float)
    v = np.array([[int(c) for c in k] for k in keys], int).reshape(len(keys), -1)
    start = np.tile([0.5, START_BAD, START_GOOD], (v.shape[1], 1))
    start[len(LABELLERS):, 1:] = START_LABEL
    right, good, share = start.copy(), np.zeros(len(keys)), BALANCE
    for _ in range(rounds):
        overall = np.log(share / (1 - share))
        odds = np.log(right / (1 - right)) * np.array([0.0, -1.0, 1.0]) - overall * np.array([0.0, 1.0, 1.0])
        log = sum((odds[j][v[:, j]] for j in range(v.shape[1])), np.full(len(keys), overall))
        new = 1 / (1 + np.exp(-np.clip(log, -50, 50)))
        done = np.abs(new - good).max() < tol
        good = new
        if done:
            break
        share = float(np.clip((n @ good + BALANCE) / (n.sum() + 1), 0.02, 0.98))
        for j in range(v.shape[1]):
            for vote, p in ((BAD, 1 - good), (GOOD, good)):
                cast = n * (v[:, j] == vote)
                right[j, vote] = (cast @ p + start[j, vote] * (TRUST * cast.sum() + 1)) / ((1 + TRUST) * cast.sum() + 1)
        right = np.clip(right, 0.02, 0.999)
    return dict(zip(keys, good.tolist())), right[:, 1:]


def _slot(name: str | bytes) -> int:
    import xxhash
    return xxhash.xxh3_64_intdigest(name) % DIMENSIONS


class _Slots(dict):
    def __missing__(self, word):
        if len(self) > 500_000:
            self.clear()
        self[word] = s = _slot(word)
        return s


class _Weights(dict):
    """Weight of each word or vote in the scorer."""

    def __init__(self, weights: np.ndarray):
        super().__init__()
        self.all = weights.astype(float).tolist()

    def __missing__(self, word: str | bytes) -> float:
        if len(self) > 500_000:
            self.clear()
        self[word] = x = self.all[_slot(word)]
        return x


def _features(vote: str, own: set[bytes], slots: _Slots) -> list[int]:
    """Slots of the votes cast, one for each labeller, and after them those of the distinct words."""
    return [slots[f"\0{j}:{c}"] for j, c in enumerate(vote)] + sorted(slots[w] for w in own)


def _values(n: int) -> np.ndarray:
    """Values of ``n`` features: a vote counts 1; the words of a text have length 1 together."""
    votes_ = len(LABELLERS)
    out = np.full(n, 1 / np.sqrt(max(1, n - votes_)))
    out[:votes_] = 1.0
    return out


def _scan(terms: Terms):
    """Vote pattern of each document."""
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, 1):
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([votes(signals(t or "", terms)[0]) for t in b.column(1).to_pylist()], pa.string())],
                ["doc_id", "votes"])
    return fn


def learned_terms(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[frozenset, frozenset]:
    """Words, and beginnings of words, that mark toxic texts.

    From the distinct texts of at most ``sample`` labelled rows: words in ``WORD_SHARE``
    of the toxic texts or more, and beginnings that ``KINDS`` or more words share and
    that occur ``LEAST`` times or more; of neither may more than ``MOST`` be elsewhere.
    """
    marked = labels.filter(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    share = min(1.0, sample / max(1, marked.count()))
    marked = marked.filter(F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    texts = docs.select("doc_id", "text").join(marked, "doc_id").select("text", "toxic").distinct()

    def words(batches):
        counts: dict[str, list[int]] = {}
        for b in text_slices(batches, 0):
            for t, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for w in {*bare_words(t or ""), b""}:
                    counts.setdefault(w, [0, 0])[k == 1] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array([c[1] for c in counts.values()], pa.int64()),
             pa.array([c[0] for c in counts.values()], pa.int64())], ["word", "bad", "good"])

    counts = cut_lineage(texts.mapInArrow(words, "word string, bad long, good long").groupBy("word").agg(
        F.sum("bad").alias("bad"), F.sum("good").alias("good")))
    total = counts.filter("word = ''").first()
    if total is None or not total["bad"]:
        return frozenset(), frozenset()
    clear = F.col("good") <= MOST * (F.col("bad") + F.col("good"))
    found = counts.filter((F.col("word") != "") & (F.col("bad") >= max(5, WORD_SHARE * total["bad"])) & clear)
    begins = (counts.select(F.explode(F.array(*(F.lit(n) for n in PREFIXES))).alias("n"), "word", "bad", "good")
              .filter(F.length("word") >= F.col("n")).groupBy(F.expr("substring(word, 1, n)").alias("begin"))
              .agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"), F.count(F.when(F.col("bad") > 0, 1)).alias("kinds"))
              .filter((F.col("bad") >= LEAST) & (F.col("kinds") >= KINDS) & clear))
    # bounded by the words of the sampled texts
    return frozenset(r["word"] for r in found.collect()), frozenset(r["begin"] for r in begins.collect())


def fit_scorer(slots: np.ndarray, sizes: np.ndarray, target: np.ndarray, epochs: int = 200,
               ridge: float = 1e-6) -> np.ndarray:
    """Logistic regression towards soft labels by adaptive gradient steps over all rows.

    Row i has the next ``sizes[i]`` of ``slots``. Returns a weight per slot, and the bias last.
    """
    w, seen, n = np.zeros(DIMENSIONS + 1), np.full(DIMENSIONS + 1, 1e-8), len(sizes)
    if not n:
        return w
    ends = np.cumsum(sizes)
    flat = np.insert(slots.astype(np.int32), ends, DIMENSIONS)
    x = np.insert(np.concatenate([_values(k) for k in sizes]), ends, 1.0)
    sizes = sizes + 1
    starts = np.cumsum(sizes) - sizes
    for _ in range(epochs):
        p = 1 / (1 + np.exp(-np.clip(np.add.reduceat(w[flat] * x, starts), -30, 30)))
        g = np.bincount(flat, np.repeat(p - target, sizes) * x, DIMENSIONS + 1) / n + ridge * w
        seen += g * g
        w -= 0.5 * g / np.sqrt(seen)
    return w


def classify(docs: DataFrame, labels: DataFrame | None = None, threshold: float = 0.35, sample: int = SAMPLE,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, votes, posterior, keep) of every document."""
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    run = _scorer(narrow, labels, threshold, sample)
    return narrow.select("text", "doc_id").mapInArrow(run, SCORED)


def filter_quality(docs: DataFrame, labels: DataFrame | None = None, threshold: float = 0.35,
                   sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    run = _scorer(narrow, labels, threshold, sample)

    def keep(batches):
        for b in text_slices(batches, place):
            if len(b):
                ids = pa.nulls(len(b), pa.int64())
                text = b.column(place).cast(pa.string())
                got = next(run(iter([pa.RecordBatch.from_arrays([text, ids], ["text", "doc_id"])])))
                yield b.filter(got.column("keep"))
        release()

    place = docs.columns.index(text_col)

    return docs.mapInArrow(keep, docs.schema)


def _verdicts(labels: DataFrame | None, narrow: DataFrame) -> DataFrame:
    """(doc_id, verdict): the vote of the labels; bad if any row of the document says so."""
    if labels is None:
        return narrow.sparkSession.createDataFrame([], "doc_id long, verdict string")
    good = (F.min("quality") == 1) & (F.coalesce(F.max("toxic"), F.lit(0)) == 0)
    return labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.when(F.min("quality").isNull() & F.max("toxic").isNull(), str(ABSTAIN))
        .when(F.coalesce(good, F.lit(False)), str(GOOD)).otherwise(str(BAD)).alias("verdict"))


def _with_verdict(voted: DataFrame, verdicts: DataFrame) -> DataFrame:
    return voted.join(verdicts, "doc_id", "left").withColumn(
        "votes", F.concat("votes", F.coalesce("verdict", F.lit(str(ABSTAIN)))))


def _scorer(narrow: DataFrame, labels: DataFrame | None, threshold: float, sample: int):
    words, begins = learned_terms(narrow, labels, sample) if labels is not None else (frozenset(), frozenset())
    begins = frozenset(x.encode() for x in begins if not any(x[:n] in begins for n in range(1, len(x))))
    terms = (frozenset(w.encode() for w in (*words, *TOXIC_TERMS)), begins, tuple(sorted({len(x) for x in begins})))
    verdicts = _verdicts(labels, narrow)
    counted = _with_verdict(narrow.mapInArrow(_scan(terms), "doc_id long, votes string"), verdicts)
    patterns = {r["votes"]: r["count"] for r in counted.groupBy("votes").count().collect()}  # a few per labeller
    posterior, _ = estimate(patterns)
    share = min(1.0, sample / max(1, sum(patterns.values())))
    chosen = narrow.filter(F.pmod(F.xxhash64(F.lit(17), "doc_id", "text"), F.lit(1 << 20)) < int(share * (1 << 20)))

    def describe(batches):
        slots = _Slots()
        for b in text_slices(batches, 1):
            rows = []
            for t in b.column(1).to_pylist():
                values, own = signals(t or "", terms)
                v = votes(values)
                rows.append((v, _features(v, own, slots)))
            v, f = zip(*rows) if rows else ((), ())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(v, pa.string()), pa.array(f, pa.list_(pa.int32()))],
                ["doc_id", "h", "votes", "f"])

    described = chosen.withColumn("h", F.xxhash64("doc_id", "text")).mapInArrow(
        describe, "doc_id long, h long, votes string, f array<int>")
    got = _with_verdict(described, verdicts).select("h", "f", "votes").toArrow().combine_chunks()
    got = got.sort_by("h")  # whatever the order of the tasks
    f = got["f"].combine_chunks()
    weights = fit_scorer(f.flatten().to_numpy(), np.diff(f.offsets.to_numpy()),
                         np.array([posterior[v] for v in got["votes"].to_pylist()]))
    shared = narrow.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = _Weights(shared.value)
        bias = weight.all[DIMENSIONS]
        for b in text_slices(batches, 0):
            rows = []
            for t in b.column(0).to_pylist():
                values, own = signals(t or "", terms)
                v = votes(values)
                z = bias + sum(weight[f"\0{j}:{c}"] for j, c in enumerate(v))
                z += sum(map(weight.__getitem__, own)) / max(1, len(own)) ** 0.5
                s = 1 / (1 + np.exp(-max(-30.0, min(30.0, z))))
                known = posterior.get(v + "0", s)
                rows.append((s, v, known, s >= threshold and known >= DOUBT))
            s, v, p, k = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column(1), pa.array(s, pa.float64()), pa.array(v, pa.string()), pa.array(p, pa.float64()),
                 pa.array(k, pa.bool_())], ["doc_id", "score", "votes", "posterior", "keep"])
    return score
