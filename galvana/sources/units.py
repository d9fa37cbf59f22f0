"""Units of cycler columns: from a header or stated, never from magnitudes."""

from __future__ import annotations

import re

#: Factors to the canonical unit of each field (Ah, A, V, s, degrees C).
FACTORS = {
    "Ah": {"ah": 1.0, "mah": 1e-3},
    "A": {"a": 1.0, "ma": 1e-3},
    "V": {"v": 1.0, "mv": 1e-3},
    "s": {"s": 1.0, "sec": 1.0, "min": 60.0, "h": 3600.0, "hr": 3600.0},
    "degC": {"degc": 1.0, "c": 1.0, "℃": 1.0},
}


def unit_of_header(header: str) -> str | None:
    """The unit in brackets, or a trailing ``_sec``, ``_mAh``, ``_Ah`` and the like."""
    if found := re.search(r"[\[(]([^\])]+)[\])]\s*$", header.strip()):
        return found[1].strip()
    found = re.search(r"_(sec|min|mAh|Ah|mA|mV|degC)$", header.strip())
    return found[1] if found else None


def factor(unit: str, canonical: str) -> float:
    try:
        return FACTORS[canonical][unit.strip().lower()]
    except KeyError:
        raise ValueError(f"unsupported unit {unit!r} for {canonical}") from None


def resolve(header: str, canonical: str, explicit: str | None = None) -> tuple[float, bool]:
    """Factor to the canonical unit, and whether it was assumed; a stated unit must not contradict the header's."""
    named = unit_of_header(header)
    if explicit and named and factor(explicit, canonical) != factor(named, canonical):
        raise ValueError(f"unit {explicit!r} contradicts header {header!r}")
    unit = explicit or named
    return (factor(unit, canonical), False) if unit else (1.0, True)
