"""Effective settings of an analysis run."""

from __future__ import annotations

from dataclasses import dataclass, field
from types import MappingProxyType
from typing import Mapping

# Weights of the confidence formula and the lower edge of each band.
WEIGHTS = MappingProxyType(
    {"name": 0.15, "type": 0.30, "value": 0.40, "uniqueness": 0.10, "null": 0.05}
)
BAND_HIGH = 0.85
BAND_MEDIUM = 0.70
BAND_LOW = 0.50

# Alias groups shipped as defaults (group, then its column names).
DEFAULT_ALIASES = MappingProxyType(
    {
        "api": ("api_number", "api_num", "well_api", "api_no", "well_number"),
        "lease": ("lease_num", "leasen", "lease_number", "lease_no", "unit_num"),
        "well": ("well_name", "wellname", "well_no", "well_num"),
        "operator": ("company", "company_name", "oper", "operator_name", "opr_name"),
        "block": ("block_num", "blocknumber", "blk_num", "protr_number"),
        "area": ("area_code", "area_name", "protr_area_code"),
        "date": ("p_date", "prod_date", "production_date", "activity_date", "eff_date"),
        "oil": ("oil_prod", "oill", "oil_rate", "oil_volume"),
        "gas": ("gas_prod", "gass", "gas_rate", "gas_volume"),
        "water": ("water_prod", "water_rate", "water_volume"),
    }
)


@dataclass(frozen=True)
class Config:
    """Settings with an effect; weights, bands and minimums default to the original tool's.

    Every row is read unless ``sample_fraction`` is given, the share of rows to read of
    each table in mode B or C; ``sample_by`` ``"rows"`` reads all and keeps a share, ``"files"`` reads a
    share of a table's files only.  ``scope`` picks the value sets that are compared: ``"full"``
    takes all distinct values and tokens, ``"top"`` only the ``top_n`` most frequent values
    and the samples of each column.  ``common_values`` limits the shared values that are
    listed; without it all are.
    """

    name_similarity_min: float = 0.6
    type_compatibility: str = "strict"
    band_high: float = BAND_HIGH
    band_medium: float = BAND_MEDIUM
    band_low: float = BAND_LOW
    weights: Mapping[str, float] = field(default_factory=lambda: WEIGHTS)
    categorical_distinct_max: int = 20
    aliases: Mapping[str, tuple[str, ...]] = field(default_factory=lambda: DEFAULT_ALIASES)
    mode_a_max_rows: int = 100_000
    sample_fraction: float | None = None
    sample_by: str = "rows"
    sample_size: int = 100
    top_n: int = 10
    sample_values: int = 20
    common_values: int | None = None
    fuzzy_value_threshold: float = 0.8
    column_patterns: tuple[str, ...] = ()
    table_patterns: tuple[str, ...] = ()
    promotion_threshold: int = 3
    scope: str = "full"

    def __post_init__(self) -> None:
        if not 0.0 < self.name_similarity_min <= 1.0:
            raise ValueError("name_similarity_min must be above 0 and at most 1")
        if self.type_compatibility not in ("strict", "relaxed"):
            raise ValueError("type_compatibility is 'strict' or 'relaxed'")
        if self.scope not in ("full", "top"):
            raise ValueError("scope is 'full' or 'top'")
        if self.sample_fraction is not None and not 0.0 < self.sample_fraction <= 1.0:
            raise ValueError("sample_fraction must be above 0 and at most 1")
        if self.sample_by not in ("rows", "files"):
            raise ValueError("sample_by is 'rows' or 'files'")

    @property
    def strict(self) -> bool:
        return self.type_compatibility == "strict"
