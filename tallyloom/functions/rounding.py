"""Rounding and rates. Everything published rounds half up; a rate over nothing is null, never zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def r1(x: Column) -> Column:
    return F.round(x, 1)


def r2(x: Column) -> Column:
    return F.round(x, 2)


def pct(count: Column, base: Column, places: int = 1) -> Column:
    """``count`` in per cent of its own base."""
    return F.round(100.0 * count / F.nullif(base, F.lit(0)), places)


def net(high: Column, low: Column, base: Column, low_base: Column | None = None) -> Column:
    """Difference of two rounded shares, rounded again; each over its own base."""
    return r1(pct(high, base) - pct(low, base if low_base is None else low_base))


def net_of_counts(high: Column, low: Column, base: Column) -> Column:
    """The difference rounded once."""
    return F.round(100.0 * (high - low) / F.nullif(base, F.lit(0)), 1)


def whole_or_double(x: Column) -> Column:
    """Text of a number, without a fraction if it has none."""
    return F.when(x == F.floor(x), F.floor(x).cast("long").cast("string")).otherwise(x.cast("string"))


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0).cast("long"), lambda a, v: a + v)


def end_width(n_rungs: int, ladder: bool) -> int:
    """Rungs at each end that count as low and high."""
    return 1 if ladder or n_rungs < 4 else 2


def shares(counts: Column, n_rungs: int, ladder: bool = False) -> dict[str, Column]:
    """Low, mid and high share of a vector of counts, in per cent."""
    k = end_width(n_rungs, ladder)
    n = _sum(counts)
    low, high = _sum(F.slice(counts, 1, k)), _sum(F.slice(counts, -k, k))
    return {"lo_pct": pct(low, n), "mid_pct": pct(n - low - high, n), "hi_pct": pct(high, n)}


def mean_rung(counts: Column) -> Column:
    """Mean position, counted from 1, of a vector of counts; two places."""
    at = F.transform(counts, lambda c, i: c * (i + 1))
    return r2(_sum(at) / F.nullif(_sum(counts), F.lit(0)))


def metric(counts: Column, n_rungs: int, name: str, ladder: bool = False) -> Column:
    """support, oppose, net or mean of a vector of counts."""
    k = end_width(n_rungs, ladder)
    n, low, high = _sum(counts), _sum(F.slice(counts, 1, k)), _sum(F.slice(counts, -k, k))
    return {"support": pct(high, n), "oppose": pct(low, n), "net": net(high, low, n), "mean": mean_rung(counts)}[name]


def metric_tint(counts: Column, n_rungs: int, name: str, diverging: bool = True, ladder: bool = False) -> Column:
    """(value, tint) of a vector of counts, unrounded: shares as fractions, and the value on a colour scale.

    A diverging scale runs from -1 to 1: opposition and low means are negative. Else it runs from 0 to 1, and a net counts
    by its size. Null without answers."""
    k = end_width(n_rungs, ladder)
    n = F.nullif(_sum(counts), F.lit(0))
    low, high = _sum(F.slice(counts, 1, k)) / n, _sum(F.slice(counts, -k, k)) / n
    mean = _sum(F.transform(counts, lambda c, i: c * (i + 1))) / n
    middle = (1 + n_rungs) / 2
    value = {"support": high, "oppose": low, "net": high - low, "mean": mean}[name]
    if name == "mean":
        tint = (mean - middle) / (middle - 1) if diverging else (mean - 1) / (n_rungs - 1)
    elif name == "oppose":
        tint = -low if diverging else low
    elif name == "net":
        tint = value if diverging else F.abs(value)
    else:
        tint = value
    return F.struct(value.alias("value"), tint.alias("tint"))


def pct_nudged(part: Column, base: Column) -> Column:
    """Per cent of ``base`` to one place, a hair under a tie taken for the tie; nothing of nothing is 0."""
    share = part / F.nullif(base, F.lit(0))
    return F.coalesce(F.floor(share * 1000 + 1e-9 + 0.5) / 10, F.lit(0.0))


def pct_text(value: Column, places: int = 1) -> Column:
    """A per cent number as text with fixed places, nudged by one bit so that 46.15 is not 46.1; a dash for null."""
    scale = 10.0**places
    nudged = F.floor((value + 2.0**-52) * scale + 0.5) / scale
    shown = F.format_string(f"%.{places}f%%", nudged)
    return F.when(value.isNull() | F.isnan(value), "—").otherwise(shown)
