"""Row-local line parsing: timestamp, severity, component, source and host."""

from __future__ import annotations

import unicodedata
from datetime import UTC, datetime

from pyspark.sql import Column, functions as F

from .dialect import to_java
from .text import is_ascii

# The accepted leading timestamps, severity words, component and file-name
# shapes, and month names.
LEADING_TIMESTAMP = (
    r"^(?:\d{4}-\d{2}-\d{2}(?:T\d{2}:\d{2}:\d{2}(?:\.\d+)?Z"
    r"| \d{2}:\d{2}:\d{2}(?:,\d{3})?)"
    r"|[A-Z][a-z]{2} \d{2} \d{2}:\d{2}:\d{2})"
)
SEVERITIES = ("DEBUG", "INFO", "WARN", "WARNING", "ERROR", "CRITICAL", "FATAL")
COMPONENT = r"\[([A-Za-z0-9_.-]+)\]"
FILE_STEM = r"^([a-zA-Z][a-zA-Z0-9-]*?)(?:[_-]([a-zA-Z]+[a-zA-Z0-9-]*\d+))?$"
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")

_SYSLOG_LENGTH = len("Mar 30 10:15:10")


def current_utc_year() -> int:
    return datetime.now(UTC).year


def _zeros() -> list[str]:
    """The zero of every decimal digit block that Python knows."""
    return [chr(c) for c in range(0x660, 0x20000) if unicodedata.decimal(chr(c), None) == 0]


def ascii_digits(text: Column) -> Column:
    """Decimal digits of all scripts as ASCII ones."""
    others = "".join(chr(ord(zero) + d) for zero in _zeros() for d in range(10))
    return F.translate(text, others, "0123456789" * (len(others) // 10))


def timestamp(text: Column, reference_year: int | None = None, on_bad: str = "null") -> Column:
    """UTC wall-clock time at the start of a line, null if there is none.

    The syslog form has no year and takes `reference_year` (default: the current one). A
    value of the right shape that is no real time gives null, or an error if `on_bad` is
    "fail".
    """
    if on_bad not in ("null", "fail"):
        raise ValueError(f"on_bad must be 'null' or 'fail', not {on_bad!r}")
    year = reference_year if reference_year is not None else current_utc_year()
    # One pass finds whichever form starts the line; length and punctuation tell them apart.
    fast, full = (F.regexp_extract(text, to_java(LEADING_TIMESTAMP, ascii_text), 0) for ascii_text in (True, False))
    found = F.when(is_ascii(text), fast).otherwise(ascii_digits(full))
    months = F.create_map(*[F.lit(v) for i, m in enumerate(MONTHS, 1) for v in (m, f"{i:02d}")])
    syslog = F.concat(
        F.lit(f"{year:04d}-"),
        F.coalesce(F.try_element_at(months, F.substring(found, 1, 3)), F.lit("??")),
        F.lit("-"),
        F.substring(found, 5, _SYSLOG_LENGTH - 4),
    )
    canonical = F.when(F.length(found) == _SYSLOG_LENGTH, syslog).otherwise(
        F.translate(found, ",Z", ".")
    )
    parsed = canonical.try_cast("timestamp_ntz") if on_bad == "null" else canonical.cast("timestamp_ntz")
    if on_bad == "null":
        real = ~canonical.startswith("0000")
    else:
        no_year = F.raise_error(F.concat(F.lit("no such year: "), found)).cast("boolean")
        real = F.when(canonical.startswith("0000"), no_year).otherwise(F.lit(True))
    return F.when((found != "") & real, parsed)


def severity(text: Column) -> Column:
    """First severity word standing alone, case-sensitive."""
    pattern = rf"\b({'|'.join(SEVERITIES)})\b"
    fast, full = (F.regexp_extract(text, to_java(pattern, ascii_text), 1) for ascii_text in (True, False))
    return F.nullif(F.when(is_ascii(text), fast).otherwise(full), F.lit(""))


def component(text: Column) -> Column:
    """First bracketed label, without its brackets."""
    return F.nullif(F.regexp_extract(text, COMPONENT, 1), F.lit(""))


def file_stem(path: Column) -> Column:
    """Last path part without its last suffix."""
    name = F.substring_index(path, "/", -1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]+$", "")


def source_of(path: Column) -> Column:
    return F.nullif(F.regexp_extract(file_stem(path), to_java(FILE_STEM), 1), F.lit(""))


def host_of(path: Column) -> Column:
    return F.nullif(F.regexp_extract(file_stem(path), to_java(FILE_STEM), 2), F.lit(""))


def record_id(job_id: Column, path: Column, line_number: Column, mode: str = "stable") -> Column:
    """Record identity: a digest of where the line stands, or a random uuid.

    The stable form survives task retries and makes a repeated ingest replace its own rows.
    """
    if mode == "random":
        return F.uuid()
    if mode != "stable":
        raise ValueError(f"id mode must be 'stable' or 'random', not {mode!r}")
    key = F.concat_ws("\0", F.coalesce(job_id, F.lit("")), path, line_number.cast("string"))
    return F.sha2(key, 256)
