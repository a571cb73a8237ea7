"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_divide(num: Column, den: Column) -> Column:
    """Division that gives NULL instead of an ANSI error on a zero divisor."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def region_name(chrom="chrom", start="start", end="end", sep=("-", "-")) -> Column:
    """``chrom<sep0>start<sep1>end``."""
    return F.concat(
        F.col(chrom), F.lit(sep[0]), F.col(start).cast("string"),
        F.lit(sep[1]), F.col(end).cast("string"),
    )


def region_parts(name: Column, sep=("-", "-")) -> tuple[Column, Column, Column]:
    """Inverse of :func:`region_name`; the chromosome may itself hold separators."""
    def quoted(s: str) -> str:
        return "".join("\\" + c if not c.isalnum() else c for c in s)
    pattern = f"^(.+){quoted(sep[0])}(\\d+){quoted(sep[1])}(\\d+)$"
    return (
        F.regexp_extract(name, pattern, 1),
        F.regexp_extract(name, pattern, 2).cast("bigint"),
        F.regexp_extract(name, pattern, 3).cast("bigint"),
    )


def split_region(df, column: str, sep=("-", "-")):
    """Add ``chrom, start, end`` parsed from a region name column."""
    c, s, e = region_parts(F.col(column), sep)
    return df.withColumns({"chrom": c, "start": s, "end": e})


def pseudo_log10(x: Column) -> Column:
    """asinh(x/2)/ln(10): log-like for large x and linear near zero."""
    return F.asinh(x / F.lit(2.0)) / F.lit(2.302585092994046)


def order_bucket(x: Column, per_octave: int = 64) -> Column:
    """Integer that never decreases with ``x``; equal values share a bucket.

    Works on the logarithm of the magnitude, so it needs no knowledge of the
    data: values near zero and large values are both spread over many buckets.
    """
    mag = F.log2(F.lit(1.0) + F.abs(x)) * F.lit(float(per_octave))
    return F.floor(F.signum(x) * mag).cast("bigint")


def unit_bucket(p: Column, per_octave: int = 64) -> Column:
    """Like :func:`order_bucket` for probabilities: fine near zero as well."""
    return F.when(p <= 0, F.lit(-(10**7)).cast("bigint")).otherwise(
        F.floor(F.log2(p) * F.lit(float(per_octave))).cast("bigint")
    )


def salt_of(*cols, buckets: int) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(buckets)).cast("int")


def all_salts(buckets: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(buckets - 1)))
