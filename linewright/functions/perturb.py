"""Deterministic replacement of unstable tokens by other ones of the same class.

Everything derives from a digest of (seed, row index, text), so a row is perturbed the same
way on every run and in every task. The random stream is this module's own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from .dialect import to_java
from .rules import rule_named
from .text import is_ascii

# Token ranges, unit of last resort and identifier length.
OCTET_LOW, OCTET_HIGH = 1, 254
DURATION_LOW, DURATION_HIGH = 5, 5000
DEFAULT_UNIT = "ms"
ID_LENGTH = 16
UUID_GROUPS = (8, 4, 4, 4, 12)
DEFAULT_SEED = 7


_NUMBER_DIGITS = 15  # hex digits that fit a positive 64-bit integer


def _number(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, _NUMBER_DIGITS), 16, 10).cast("bigint")


def random_ip(digest: Column, _found: Column) -> Column:
    span = OCTET_HIGH - OCTET_LOW + 1
    # Octets from overlapping bits of one number.
    octets = [F.shiftright(_number(digest), 12 * i) % span + OCTET_LOW for i in range(4)]
    return F.concat_ws(".", *[octet.cast("string") for octet in octets])


def random_uuid(digest: Column, _found: Column) -> Column:
    starts = [sum(UUID_GROUPS[:i]) + 1 for i in range(len(UUID_GROUPS))]
    return F.concat_ws("-", *[F.substring(digest, s, n) for s, n in zip(starts, UUID_GROUPS)])


def random_duration(digest: Column, found: Column) -> Column:
    span = DURATION_HIGH - DURATION_LOW + 1
    letters = F.regexp_replace(found, "[^A-Za-z]", "")
    unit = F.when(letters == "", F.lit(DEFAULT_UNIT)).otherwise(letters)
    return F.concat_ws(" ", (_number(digest) % span + DURATION_LOW).cast("string"), unit)


def random_long_id(digest: Column, _found: Column) -> Column:
    return F.substring(digest, 1, ID_LENGTH)


# Token classes in the order they are replaced; each is found by the rule of that name.
STEPS: tuple[tuple[str, Callable[[Column, Column], Column]], ...] = (
    ("ip_address", random_ip),
    ("uuid", random_uuid),
    ("duration", random_duration),
    ("long_id", random_long_id),
)


def _fresh(step: str, token: Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
    def make(match: Column, position: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", F.col("_key"), F.lit(step), position.cast("string")), 256)
        return token(digest, match)

    return make


def perturb(df: DataFrame, text: str = "raw_text", index: str = "index", seed: int = DEFAULT_SEED) -> DataFrame:
    """Replace `text` in place, one token class after the other.

    A line is taken apart at the tokens found and put together with new ones.
    """
    key = F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(index).cast("string"), F.col(text)), 256)
    out = df.withColumn("_key", key)
    for step, token in STEPS:
        pattern = rule_named(step).pattern
        fast, full = to_java(pattern, True), to_java(pattern)
        ascii_row, current = is_ascii(F.col(text)), F.col(text)
        found = F.when(ascii_row, F.regexp_extract_all(current, F.lit(fast), F.lit(0))).otherwise(
            F.regexp_extract_all(current, F.lit(full), F.lit(0))
        )
        parts = F.when(ascii_row, F.split(current, fast, -1)).otherwise(F.split(current, full, -1))
        tail = F.zip_with(
            F.transform("_found", _fresh(step, token)),
            F.slice("_parts", F.lit(2), F.size("_parts")),
            lambda new, rest: F.concat(new, rest),
        )
        out = (
            out.withColumn("_found", found)
            .withColumn("_parts", parts)
            .withColumn(text, F.concat(F.element_at("_parts", 1), F.array_join(tail, "")))
        )
    return out.drop("_key", "_found", "_parts")
