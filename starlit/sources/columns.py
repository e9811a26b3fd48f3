"""Observation columns and the instrument columns that can fill them."""

from __future__ import annotations

from dataclasses import dataclass

# Fixed values of the light-curve file layout: instrument columns in order of preference.
TIME_COLUMNS = ["TIME"]
FLUX_COLUMNS = ["PDCSAP_FLUX", "SAP_FLUX"]
FLUX_ERR_COLUMNS = ["PDCSAP_FLUX_ERR", "SAP_FLUX_ERR"]
QUALITY_COLUMNS = ["SAP_QUALITY", "QUALITY"]


@dataclass(frozen=True)
class Source:
    """Candidates of one observation column; ``absent`` fills it when none is there and it isn't required."""

    candidates: list[str]
    required: bool = False
    absent: float | None = None


OBSERVED = {
    "time": Source(TIME_COLUMNS, required=True),
    "flux": Source(FLUX_COLUMNS, required=True),
    "flux_err": Source(FLUX_ERR_COLUMNS),
    "quality": Source(QUALITY_COLUMNS, absent=0.0),
}


def resolve_column(columns, candidates: list[str]) -> str | None:
    """Actual name of the first candidate present (compared without case), else None."""
    by_upper = {}
    for c in columns:
        by_upper.setdefault(c.upper(), c)
    return next((by_upper[c.upper()] for c in candidates if c.upper() in by_upper), None)


def resolve_observed(columns, where: str) -> dict[str, str | None]:
    """Column that fills each observation column (None: absent); raises when a required one has no candidate."""
    found = {name: resolve_column(columns, s.candidates) for name, s in OBSERVED.items()}
    lacking = [name for name, s in OBSERVED.items() if s.required and found[name] is None]
    if lacking:
        raise ValueError(f"{where} has no column for {' or '.join(lacking)}; it has {', '.join(map(str, columns)) or 'none'}")
    return found
