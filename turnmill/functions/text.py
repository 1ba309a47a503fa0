"""String helpers with the same blank rules as Python's ``str.strip``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every code point Python counts as white space.
_BLANK_CODES = (
    *range(0x0009, 0x000E), *range(0x001C, 0x0021), 0x0085, 0x00A0, 0x1680,
    *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)
PY_WS = "".join(map(chr, _BLANK_CODES))

# Binary size units, smallest first.
_SIZE_UNITS = ("B", "KiB", "MiB", "GiB", "TiB")


def is_blank(text: Column) -> Column:
    return F.ltrim(text, F.lit(PY_WS)) == ""


def human_bytes(size: Column) -> Column:
    """``1536`` -> ``1.50 KiB``; sizes past the last unit stay in that unit."""
    last = len(_SIZE_UNITS) - 1
    rendered = None
    for power, unit in enumerate(_SIZE_UNITS):
        scaled = F.bround(size / F.lit(float(1024**power)), 2)
        label = F.format_string(f"%.2f {unit}", scaled)
        below = F.lit(True) if power == last else F.abs(size) < F.lit(1024 ** (power + 1))
        rendered = F.when(below, label) if rendered is None else rendered.when(below, label)
    return rendered
