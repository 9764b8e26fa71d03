"""Text helpers with Python's idea of white space and digits."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, functions as F

from .dialect import SPACE

# Every character that Python counts as white space lies below this code point.
_SPACE_LIMIT = 0x3001
_SPACE_CHARS = "".join(chr(i) for i in range(_SPACE_LIMIT) if chr(i).isspace())

# Characters that end a line for splitlines() but not for a text file read line by line.
EXTRA_LINE_BREAKS = r"[\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.char_length(text)


def strip(text: Column) -> Column:
    """Remove leading and trailing white space of any script."""
    return F.btrim(text, F.lit(_SPACE_CHARS))


def not_blank(text: Column) -> Column:
    return strip(text) != ""


def decode_lenient(raw: Column) -> Column:
    """Replace malformed UTF-8 with U+FFFD."""
    return F.make_valid_utf8(raw)


def decode_strict(raw: Column) -> Column:
    """Fail on malformed UTF-8."""
    return F.validate_utf8(raw)


def words(text: Column) -> Column:
    """Split on runs of white space, ignoring it at both ends."""
    return F.split(strip(text), f"[{SPACE}]+")


@cache
def digit_class() -> str:
    """Java class of the characters Python's isdigit() accepts: decimals and, by rule, the rest."""
    ranges: list[list[int]] = []
    for point in range(0x20000):
        char = chr(point)
        if char.isdigit() and not char.isdecimal():
            if ranges and ranges[-1][1] == point - 1:
                ranges[-1][1] = point
            else:
                ranges.append([point, point])
    extra = "".join(rf"\x{{{low:x}}}-\x{{{high:x}}}" for low, high in ranges)
    return rf"[\p{{Nd}}{extra}]"
