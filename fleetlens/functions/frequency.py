"""Fixed-width frequencies as microseconds, and their texts ("1h", "90min", "31s")."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Microseconds of each unit, widest first; and other spellings of units.
UNITS = {"D": 86_400_000_000, "h": 3_600_000_000, "min": 60_000_000, "s": 1_000_000, "ms": 1_000, "us": 1}
ALIASES = {"d": "D", "H": "h", "T": "min", "S": "s", "L": "ms", "U": "us", "m": "min"}


def parse_frequency(text: str) -> int:
    """Microseconds of a frequency, which may have several parts ("1h30min")."""
    parts = re.findall(r"(\d*\.?\d*)\s*([A-Za-z]+)", text)
    if not parts or "".join(f"{a}{b}" for a, b in parts) != re.sub(r"\s", "", text):
        raise ValueError(f"not a frequency: {text!r}")
    total = 0.0
    for number, unit in parts:
        unit = ALIASES.get(unit, unit)
        if unit not in UNITS:
            raise ValueError(f"unknown or calendar unit {unit!r} in {text!r}")
        total += float(number or 1) * UNITS[unit]
    if total < 1 or total != int(total):
        raise ValueError(f"a frequency needs whole, positive microseconds: {text!r}")
    return int(total)


def format_frequency(us: int) -> str:
    """The text in the widest unit that divides; no number where it is one."""
    unit = next(u for u, width in UNITS.items() if us % width == 0)
    return unit if us == UNITS[unit] else f"{us // UNITS[unit]}{unit}"


def frequency_text(us: Column) -> Column:
    """format_frequency() of a column; null for null."""
    out = None
    for unit, width in UNITS.items():
        n = F.floor(us / width).cast("string")
        text = F.when(us == width, F.lit(unit)).otherwise(F.concat(n, F.lit(unit)))
        out = F.when(us % width == 0, text) if out is None else out.when(us % width == 0, text)
    return out
