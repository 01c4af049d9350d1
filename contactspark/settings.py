"""Fixed parameters of the analysis and the checks made on them before any job starts."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Band:
    """Half-open distance range ``[low, high)`` in base pairs."""

    id: str
    low: int
    high: int


# fixed values: 10 kb bins, contacts of 250 kb up to 1 Mb in two bands
BIN_SIZE = 10_000
BANDS = (Band("250-500", 250_000, 500_000), Band("500-1000", 500_000, 1_000_000))
TILE_SPAN = 1_000_000
AUTOSOMES = 19


@dataclass(frozen=True)
class Geometry:
    """Bin size and modelled distance range."""

    bin_size: int = BIN_SIZE
    bands: tuple[Band, ...] = field(default=BANDS)

    def __post_init__(self):
        check_bands(self.bands)
        distance_range(self.bands[0].low, self.bin_size, maximum_exclusive=self.bands[-1].high)

    @property
    def minimum(self) -> int:
        return self.bands[0].low

    @property
    def maximum_exclusive(self) -> int:
        return self.bands[-1].high

    @property
    def bins(self) -> range:
        """Distances in bins that the range holds."""
        return range(self.minimum // self.bin_size, self.maximum_exclusive // self.bin_size)


def check_bands(bands) -> None:
    """Bands must be non-empty, in order, contiguous and of distinct names."""
    if not bands:
        raise ValueError("no distance bands")
    if len({b.id for b in bands}) != len(bands):
        raise ValueError("distance band names repeat")
    for band in bands:
        if band.low >= band.high:
            raise ValueError(f"band {band.id} is empty")
    for left, right in zip(bands, bands[1:]):
        if left.high != right.low:
            raise ValueError(f"bands {left.id} and {right.id} do not meet")


def distance_range(minimum: int, bin_size: int, *, maximum: int | None = None, maximum_exclusive: int | None = None):
    """``(minimum, maximum_exclusive)``; without an exclusive end it is one bin past ``maximum``."""
    end = maximum_exclusive if maximum_exclusive is not None else maximum + bin_size
    if minimum % bin_size or end % bin_size:
        raise ValueError("distance range does not align to the bin size")
    if not 0 <= minimum < end:
        raise ValueError("distance range is empty")
    return minimum, end


def check_strata(required, descriptive, known) -> None:
    """Required and descriptive strata must not overlap and together be all known strata."""
    required, descriptive = set(required), set(descriptive)
    if required & descriptive:
        raise ValueError(f"strata in both lists: {sorted(required & descriptive)}")
    if required | descriptive != set(known):
        raise ValueError(f"strata lists differ from {sorted(known)}")


def check_calibration(rows, geometry: Geometry) -> None:
    """Rows of ``(band, low, high, alpha, dispersion)`` must cover the range with positive dispersion."""
    ordered = sorted(rows, key=lambda r: r[1])
    check_bands([Band(r[0], r[1], r[2]) for r in ordered])
    if (ordered[0][1], ordered[-1][2]) != (geometry.minimum, geometry.maximum_exclusive):
        raise ValueError("calibration bands do not cover the modelled range")
    if any(not r[4] > 0 for r in ordered):
        raise ValueError("dispersion must be positive")
