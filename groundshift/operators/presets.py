"""Detection presets: which maps, thresholds and floors each vertical uses."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Rule:
    map: str
    direction: str
    threshold: float

    def __post_init__(self):
        if self.direction not in ("increase", "decrease", "at_least", "at_most"):
            raise ValueError(f"unknown direction {self.direction}")
        if self.direction in ("increase", "decrease") and self.threshold <= 0:
            raise ValueError("increase and decrease need a threshold above 0")


@dataclass(frozen=True)
class Preset:
    vertical: str
    change_type: str
    rules: tuple[Rule, ...]
    primary_map: str
    min_area_m2: float
    focus_radius_m: float | None = None
    open_size: int = 3
    close_size: int = 3
    ssim_band: str = "red"

    def __post_init__(self):
        if not self.rules or self.primary_map not in {r.map for r in self.rules}:
            raise ValueError("the primary map needs a rule")
        if self.min_area_m2 <= 0:
            raise ValueError("the area floor must be above 0")

    @property
    def primary(self) -> Rule:
        return next(r for r in self.rules if r.map == self.primary_map)


#: Shipped presets in order of the vertical's number (fixed values).
PRESETS = (
    Preset("port", "construction", (Rule("ssim_dissim", "increase", 0.55),), "ssim_dissim", 5000.0, 2000.0),
    Preset("forest", "vegetation_loss", (Rule("ndvi", "decrease", 0.15), Rule("ndvi_before", "increase", 0.50)), "ndvi", 3000.0),
    Preset("flood", "flooding", (Rule("ndwi", "increase", 0.20), Rule("ndwi_before", "decrease", 0.05)), "ndwi", 10000.0),
)


def preset_table(spark: SparkSession, presets=PRESETS) -> DataFrame:
    """One row per rule: vertical, change_type, map, direction, threshold, is_primary, min_area_m2, focus_radius_m."""
    rows = [(p.vertical, p.change_type, r.map, r.direction, r.threshold, r is p.primary, p.min_area_m2, p.focus_radius_m) for p in presets for r in p.rules]
    return spark.createDataFrame(rows, "vertical string, change_type string, map string, direction string, threshold double, is_primary boolean, min_area_m2 double, focus_radius_m double")


def override(preset: Preset, thresholds: dict[str, float] | None = None, min_area_m2: float | None = None) -> Preset:
    """The preset with some thresholds (by map) or the area floor replaced."""
    given = thresholds or {}
    rules = tuple(replace(r, threshold=given.get(r.map, r.threshold)) for r in preset.rules)
    return replace(preset, rules=rules, min_area_m2=preset.min_area_m2 if min_area_m2 is None else min_area_m2)
