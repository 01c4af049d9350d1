"""Seeded draws that depend on key values only, never on partitioning or row order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_RESOLUTION = float(1 << 52)


def uniform(seed: int, *keys) -> Column:
    """Uniform number in [0, 1) from md5 of the seed and the keys, joined by ``|``."""
    text = F.concat_ws("|", F.lit(str(seed)), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(_RESOLUTION)


def integer_below(size, seed: int, *keys) -> Column:
    """Uniform integer in ``[0, size)``."""
    size = F.col(size) if isinstance(size, str) else size
    return F.floor(uniform(seed, *keys) * size).cast("long")
