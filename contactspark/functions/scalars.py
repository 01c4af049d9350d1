"""Column expressions shared by the operators; all stay in generated JVM code."""

from __future__ import annotations

from decimal import Decimal, localcontext
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from contactspark.settings import AUTOSOMES, BANDS


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fdiv(value, size: int) -> Column:
    """Integer quotient of non-negative integers.  Refers to its input once, so nested uses stay small."""
    return F.call_function("div", col(value), F.lit(size))


def floor_to(position, size: int) -> Column:
    """Start of the bin that holds a non-negative position."""
    return fdiv(position, size) * size


def within(value, low: int, high: int) -> Column:
    """Whether ``low <= value < high``.  Refers to its input once.

    Spark moves a filter down to the scan with the whole expression behind every reference; what a few references unfold to is too large
    for the JVM to compile, so each record would be interpreted.
    """
    return F.exists(F.array(col(value)), lambda v: (v >= low) & (v < high))


def chrom_number(chrom="chrom") -> Column:
    """Number of an autosome label; any other label is an error."""
    text = F.regexp_extract(col(chrom), r"^chr([0-9]+)$", 1)
    number = F.when(text != "", text).cast("int")
    return F.when(number >= 1, number).otherwise(
        F.raise_error(F.concat(F.lit("not an autosome: "), F.coalesce(col(chrom), F.lit("null")))).cast("int")
    )


def chromosome_fold(chrom="chrom", folds: int = 5) -> Column:
    if folds < 2:
        raise ValueError("at least two folds are needed")
    return (chrom_number(chrom) - 1) % folds


def genome_key(chrom, bin_i, bin_j, offsets: dict[str, int], total_bins: int, bin_size: int) -> Column:
    """One integer per bin pair of the genome; ``offsets`` holds each chromosome's first bin."""
    table = F.create_map(*[F.lit(x) for pair in offsets.items() for x in pair])
    start = table[col(chrom)]
    return (start + fdiv(bin_i, bin_size)) * total_bins + start + fdiv(bin_j, bin_size)


def distance_band(distance="distance_bp", bands=BANDS) -> Column:
    """Name of the half-open band; null when no band holds the value."""
    out = F.lit(None).cast("string")
    for band in reversed(bands):
        out = F.when((col(distance) >= band.low) & (col(distance) < band.high), F.lit(band.id)).otherwise(out)
    return out


def strict_distance_band(distance="distance_bp", bands=BANDS) -> Column:
    """As ``distance_band``; a value in no band is an error."""
    band = distance_band(distance, bands)
    return F.coalesce(band, F.raise_error(F.concat(F.lit("no band holds "), col(distance).cast("string"))).cast("string"))


def aligned_target_start(start="input_start", end="input_end", bin_size: int = 10_000, span: int = 1_000_000) -> Column:
    """Grid start nearest to the centred target, halves rounded up; too short a window is an error."""
    width = col(end) - col(start)
    slack = F.when(width >= span, width - span).otherwise(F.raise_error(F.lit("window shorter than its target")).cast("long"))
    ideal = col(start) + fdiv(slack, 2)
    return floor_to(ideal + bin_size // 2, bin_size)


def exposure(map_i, map_j, valid_i, valid_j, sites_i, sites_j, floor: float = 1e-6, ceiling: float = 1e6):
    """``(exposure, clipped)``: geometric means of mappability and valid sequence times site counts."""
    raw = (
        F.sqrt(F.greatest(col(map_i) * col(map_j), F.lit(1e-12)))
        * F.sqrt(F.greatest(col(valid_i) * col(valid_j), F.lit(1e-6)))
        * (1 + col(sites_i))
        * (1 + col(sites_j))
    )
    return F.least(F.greatest(raw, F.lit(floor)), F.lit(ceiling)), (raw < floor) | (raw > ceiling)


def log_rate(exposure_, offset, residual, alpha=None) -> Column:
    value = F.log(F.greatest(col(exposure_), F.lit(1e-12))) + col(offset) + col(residual)
    return value if alpha is None else value + col(alpha)


def bounded_exp(value) -> Column:
    """exp with its argument held to [-40, 30]."""
    return F.exp(F.least(F.greatest(col(value), F.lit(-40.0)), F.lit(30.0)))


def combine_support(primary, reproduced, splits: int) -> Column:
    share = col(reproduced) / F.lit(float(splits))
    return F.greatest(col(primary) * (0.5 + 0.5 * share), share)


@cache
def _logarithms(size: int = 1024) -> tuple[str, str, str, float, float]:
    """Arrays of the logarithms of 0 (unused) to ``size - 1``: rounded, as a whole number of 2**-40, and what is left; both parts for 2."""
    with localcontext() as context:
        context.prec = 50
        exact = [Decimal(max(n, 1)).ln() for n in range(size)]
        high = [float(round(v * 2**40)) / 2**40 for v in exact]
        low = [float(v - Decimal(h)) for v, h in zip(exact, high)]
    texts = [f"array({', '.join(f'{v!r}D' for v in values)})" for values in (map(float, exact), high, low)]
    return *texts, high[2], low[2]


def correct_log(x) -> Column:
    """Natural logarithm that is rounded to the nearest double for whole numbers, as counts are.

    ``F.log`` is off in the last place for some of them (3 and 48 among them). Where differences of logarithms are ranked, that place
    decides which rows tie. Numbers from 1,024 on are ``c * 2**k`` with a rest of less than a 256th, whose logarithm is added in two parts.
    """
    x = col(x).cast("double")
    rounded, high, low, high_2, low_2 = _logarithms()
    k = F.greatest(F.floor(F.log2(x)).cast("double") - 8, F.lit(0.0))
    step = F.pow(F.lit(2.0), k)
    c = F.floor(x / step).cast("double")
    z = (x - c * step) / (c * step)
    whole = F.floor(z * F.lit(2.0**40)).cast("double") / F.lit(2.0**40)
    rest = ((x - c * step) - whole * (c * step)) / (c * step)
    series = F.lit(0.0)
    for n in range(8, 1, -1):
        series = z * (F.lit((-1.0) ** (n - 1) / n) + series)
    at = c.cast("int")
    large = (k * high_2 + F.get(F.expr(high), at) + whole) + (k * low_2 + F.get(F.expr(low), at) + rest + z * series)
    return F.when((x != F.floor(x)) | (x < 1) | (x >= F.lit(2.0**53)), F.log(x)).when(x < 1024, F.get(F.expr(rounded), x.cast("int"))).otherwise(large)


def log_enrichment(count, mean, shape) -> Column:
    """Gamma-Poisson shrunken log enrichment over a mean."""
    if isinstance(shape, (int, float)):
        if not shape > 0:
            raise ValueError("shape must be positive")
        shape = F.lit(float(shape))
    return correct_log(col(count) + col(shape)) - correct_log(col(mean) + col(shape))


def hypergeom_any(population, marked, drawn) -> Column:
    """Chance that a draw without replacement holds at least one marked item."""
    n, k, d = col(population).cast("long"), col(marked).cast("long"), col(drawn).cast("long")
    none = F.aggregate(
        F.sequence(F.lit(0).cast("long"), F.greatest(k - 1, F.lit(0).cast("long"))),
        F.lit(1.0),
        lambda acc, i: acc * F.greatest((n - d - i).cast("double"), F.lit(0.0)) / F.greatest((n - i).cast("double"), F.lit(1.0)),
    )
    return F.when(k > 0, 1 - none).otherwise(F.lit(0.0))


def fraction_k(count, fraction) -> Column:
    """``max(1, ceil(fraction * count))``."""
    return F.greatest(F.lit(1).cast("long"), F.ceil(col(count) * (F.lit(fraction) if isinstance(fraction, float) else col(fraction))))


def symmetric_pair(x_i, x_j) -> tuple[Column, Column]:
    """Order-free encoding of two anchors: sum and absolute difference."""
    return col(x_i) + col(x_j), F.abs(col(x_i) - col(x_j))


def symmetric_vectors(x_i, x_j) -> Column:
    """Order-free encoding of two anchor vectors: sums, then absolute differences."""
    return F.concat(
        F.zip_with(col(x_i), col(x_j), lambda a, b: a + b), F.zip_with(col(x_i), col(x_j), lambda a, b: F.abs(a - b))
    )


def softplus(x) -> Column:
    x = col(x)
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def finite(x) -> Column:
    """The value, or null when it is null, NaN or infinite."""
    x = col(x).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def known_autosomes() -> list[str]:
    return [f"chr{n}" for n in range(1, AUTOSOMES + 1)]
