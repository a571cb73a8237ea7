"""Position-weight-matrix scans over region sequences.

``pwms(motif, pos, base, score)`` holds integer scores (log-odds times a scale).
Sequences are scanned whole, on both strands, inside Arrow batches: the batch is
one code array with separators, so a window never crosses two sequences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regweave.operators.skew import running_counts, salted_join

_BASES = "ACGT"
_NO_MATCH = -(10**9)
_PWM_ROWS = 200_000      # matrix entries shipped with one scan
_SCAN_BASES = 2_000_000  # bases scored together inside a batch


def log_odds(pfm: DataFrame, background: dict[str, float] | None = None,
             pseudo: float = 0.8, scale: int = 1000) -> DataFrame:
    """Integer log2-odds from counts or frequencies ``(motif, pos, base, count)``."""
    bg = background or {b: 0.25 for b in _BASES}
    table = F.create_map(*[F.lit(x) for kv in bg.items() for x in kv])
    total = pfm.groupBy("motif", "pos").agg(F.sum("count").alias("total"))
    freq = ((F.col("count") + pseudo * table[F.col("base")]) / (F.col("total") + pseudo))
    score = F.round(F.log2(freq / table[F.col("base")]) * scale).cast("int")
    return pfm.join(total, ["motif", "pos"]).select("motif", "pos", "base", score.alias("score"))


def _matrices(pwms: DataFrame) -> dict:
    pdf = pwms.select("motif", "pos", "base", "score").toPandas()
    out = {}
    for motif, d in pdf.groupby("motif"):
        pos = np.unique(d["pos"])
        m = np.full((len(pos), 5), _NO_MATCH, dtype=np.int64)
        m[np.searchsorted(pos, d["pos"]), [_BASES.index(b) for b in d["base"]]] = d["score"]
        out[motif] = m
    return out


def _chunks(pwms: DataFrame) -> list[dict]:
    """Motif sets small enough to ship; larger collections take several scans."""
    parts = max(1, -(-pwms.count() // _PWM_ROWS))
    if parts == 1:
        return [_matrices(pwms)]
    h = F.pmod(F.xxhash64("motif"), F.lit(parts))
    return [_matrices(pwms.filter(h == k)) for k in range(parts)]


def _encode(seqs) -> tuple[np.ndarray, np.ndarray]:
    lut = np.full(256, 4, dtype=np.int8)
    for k, b in enumerate(_BASES):
        lut[ord(b)] = lut[ord(b.lower())] = k
    joined = "\n".join(seqs) + "\n"
    codes = lut[np.frombuffer(joined.encode("latin-1", "replace"), dtype=np.uint8)]
    ends = np.cumsum([len(s) + 1 for s in seqs])
    return codes, np.r_[0, ends[:-1]]


def _slices(pdf: pd.DataFrame, seq_col: str) -> Iterator[pd.DataFrame]:
    """Consecutive whole sequences of about ``_SCAN_BASES`` bases."""
    part = pdf[seq_col].str.len().to_numpy().cumsum() // _SCAN_BASES
    cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1), len(pdf)]
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield pdf.iloc[a:b]


def _window_scores(codes: np.ndarray, m: np.ndarray) -> np.ndarray:
    n = len(codes) - len(m) + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    s = np.zeros(n, dtype=np.int64)
    for k in range(len(m)):
        s += m[k][codes[k:k + n]]
    return s


def _reverse(m: np.ndarray) -> np.ndarray:
    r = m[::-1].copy()
    r[:, :4] = r[:, 3::-1]
    return r


def best_scores(sequences: DataFrame, pwms: DataFrame, id_col: str = "region_id",
                seq_col: str = "seq") -> DataFrame:
    """``(id, motif, score)``: best window of either strand, where any window fits."""
    out = None
    src = sequences.select(id_col, seq_col).filter(F.length(seq_col) > 0)
    itype = sequences.schema[id_col].dataType.simpleString()
    for mats in _chunks(pwms):
        def run(batches: Iterator[pd.DataFrame], mats=mats) -> Iterator[pd.DataFrame]:
            for pdf in (piece for batch in batches for piece in _slices(batch, seq_col)):
                codes, starts = _encode(pdf[seq_col].tolist())
                ids = pdf[id_col].to_numpy()
                for motif, m in mats.items():
                    pad = np.full(len(codes), _NO_MATCH, dtype=np.int64)
                    fwd, rev = _window_scores(codes, m), _window_scores(codes, _reverse(m))
                    pad[:len(fwd)] = np.maximum(fwd, rev)
                    best = np.maximum.reduceat(pad, starts)
                    ok = best > _NO_MATCH // 2
                    yield pd.DataFrame({id_col: ids[ok], "motif": motif, "score": best[ok]})
        part = src.mapInPandas(run, f"{id_col} {itype}, motif string, score long")
        out = part if out is None else out.unionByName(part)
    return out


def score_histogram(sequences: DataFrame, pwms: DataFrame, seq_col: str = "seq") -> DataFrame:
    """``(motif, score, n)`` over every window of both strands."""
    out = None
    src = sequences.select(seq_col).filter(F.length(seq_col) > 0)
    for mats in _chunks(pwms):
        def run(batches: Iterator[pd.DataFrame], mats=mats) -> Iterator[pd.DataFrame]:
            for pdf in (piece for batch in batches for piece in _slices(batch, seq_col)):
                codes, _ = _encode(pdf[seq_col].tolist())
                for motif, m in mats.items():
                    s = np.concatenate([_window_scores(codes, m),
                                        _window_scores(codes, _reverse(m))])
                    val, cnt = np.unique(s[s > _NO_MATCH // 2], return_counts=True)
                    yield pd.DataFrame({"motif": motif, "score": val, "n": cnt})
        part = src.mapInPandas(run, "motif string, score long, n long")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("motif", "score").agg(F.sum("n").alias("n"))


def score_thresholds(background: DataFrame, pwms: DataFrame, p_cutoff: float = 5e-5,
                     seq_col: str = "seq") -> DataFrame:
    """``(motif, threshold)``: lowest score whose tail share is at most ``p_cutoff``.

    Where even the highest observed score is more frequent than that, the
    threshold lies one above it.
    """
    h = score_histogram(background, pwms, seq_col)
    r = running_counts(h.select("motif", F.col("score").cast("double").alias("value"),
                                F.col("n").alias("c")), ["motif"])
    tail = (F.col("total") - F.col("below")) / F.col("total")
    return r.groupBy("motif").agg(F.coalesce(
        F.min(F.when(tail <= p_cutoff, F.col("value"))), F.max("value") + 1)
        .cast("long").alias("threshold"))


def find_hits(sequences: DataFrame, pwms: DataFrame, thresholds: DataFrame,
              id_col: str = "region_id", seq_col: str = "seq") -> DataFrame:
    """``(id, motif, score)`` for regions with a window at or above the threshold."""
    s = best_scores(sequences, pwms, id_col, seq_col)
    return (salted_join(s, thresholds, ["motif"], [id_col])
            .filter(F.col("score") >= F.col("threshold")).select(id_col, "motif", "score"))


def region_sequences(regions: DataFrame, genome: DataFrame, chunk: int) -> DataFrame:
    """``(region_id, seq)`` cut from ``genome(chrom, offset, seq)``.

    Chunks are ``chunk`` bases long and start at 0-based multiples of it; a
    region collects only the chunks it touches. Bases of missing or short chunks
    are ``N``, so that no window spans a gap.
    """
    first = F.floor((F.col("start") - 1) / chunk)
    last = F.floor((F.col("end") - 1) / chunk)
    want = regions.select("region_id", "chrom", "start", "end",
                          F.explode(F.sequence(first, last)).alias("k"))
    parts = genome.select("chrom", F.floor(F.col("offset") / chunk).alias("k"), "offset", "seq")
    at = F.col("k") * chunk
    lo = F.greatest(F.col("start") - 1 - at, F.lit(0))
    n = (F.least(F.col("end") - at, F.lit(chunk)) - lo).cast("int")
    piece = F.rpad(F.substr(F.coalesce("seq", F.lit("")), (lo + 1).cast("int"), n), n, F.lit("N"))
    return (want.join(parts, ["chrom", "k"], "left")
            .groupBy("region_id")
            .agg(F.array_sort(F.collect_list(F.struct("k", piece.alias("s")))).alias("p"))
            .select("region_id", F.concat_ws("", F.transform("p", lambda x: x["s"])).alias("seq")))
