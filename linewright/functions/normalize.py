"""Ordered regex normalization as a stack of projections.

Rules become literals in the plan, so each pattern is compiled once per task. ASCII rows,
the bulk of most logs, take the fast form of every pattern; other rows the full one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .dialect import to_java, to_java_replacement
from .rules import DEFAULT_RULES, Rule
from .text import is_ascii

# Private-use character put before each replacement so that replacements can be counted
# from the byte length. It is not ASCII, so no ASCII row can contain it already.
_MARK = "\ue000"
_MARK_BYTES = 3


def active(rules: Sequence[Rule]) -> list[Rule]:
    return [rule for rule in rules if rule.enabled]


def _fast_rows(text: Column, rules: Sequence[Rule]) -> Column:
    # A replacement that is not ASCII would take a row out of ASCII half way.
    return is_ascii(text) if all(rule.replacement.isascii() for rule in rules) else F.lit(False)


def _substitute(text: Column, rule: Rule, ascii_text: bool, prefix: str = "") -> Column:
    replacement = to_java_replacement(rule.replacement, rule.pattern)
    return F.regexp_replace(text, to_java(rule.pattern, ascii_text), prefix + replacement)


def normalize(text: Column, rules: Sequence[Rule] = DEFAULT_RULES) -> Column:
    """Apply every enabled rule in order, each to the output of the one before."""
    rules = active(rules)
    fast = full = text
    for rule in rules:
        fast = _substitute(fast, rule, True)
        full = _substitute(full, rule, False)
    return F.when(_fast_rows(text, rules), fast).otherwise(full)


def count_column(position: int) -> str:
    return f"_hits_{position}"


def with_trace(
    df: DataFrame, text: str = "raw_text", rules: Sequence[Rule] = DEFAULT_RULES
) -> DataFrame:
    """Add `normalized_text`, `changed` and `replacement_counts` (rule name -> hits above 0)."""
    rules = active(rules)
    counted = with_counts(df, text, rules)
    hits = [count_column(i) for i in range(len(rules))]
    return counted.withColumn("replacement_counts", _count_map(rules)).drop(*hits)


def with_counts(
    df: DataFrame, text: str = "raw_text", rules: Sequence[Rule] = DEFAULT_RULES
) -> DataFrame:
    """Add `normalized_text`, `changed` and one hit-count column per enabled rule."""
    rules = active(rules)
    keep = [F.col(c) for c in df.columns if c != "normalized_text"]
    fast, current = F.col("_fast"), F.col("_current")
    out = df.select(*keep, _fast_rows(F.col(text), rules).alias("_fast"), F.col(text).alias("_current"))
    for position, rule in enumerate(rules):
        marked = F.when(fast, _substitute(current, rule, True, _MARK)).otherwise(
            _substitute(current, rule, False)
        )
        # Rows off the fast path are counted on the text before the substitution.
        counted = F.when(~fast, F.regexp_count(current, F.lit(to_java(rule.pattern))))
        clean = F.when(fast, F.replace("_marked", F.lit(_MARK), F.lit(""))).otherwise(F.col("_marked"))
        removed = F.col("_length") - F.octet_length(current)
        hits = F.coalesce("_counted", (removed / _MARK_BYTES).cast("int")).alias(count_column(position))
        out = out.select(*keep, fast, marked.alias("_marked"), counted.alias("_counted"))
        out = out.select(
            *keep, fast, clean.alias("_current"), F.octet_length("_marked").alias("_length"), "_counted"
        )
        out = out.select(*keep, hits, fast, current)
        keep.append(F.col(count_column(position)))
    return out.select(*keep, current.alias("normalized_text"), (current != F.col(text)).alias("changed"))


def _count_map(rules: Sequence[Rule]) -> Column:
    """Map of rule name to hits; rules sharing a name add up, zero hits are left out."""
    names = list(dict.fromkeys(rule.name for rule in rules))
    if not names:
        return F.lit(None).cast("map<string,int>")
    totals = [hits_of(name, rules) for name in names]
    pairs = F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*totals))
    return F.map_filter(pairs, lambda _, hits: hits > 0)


def hits_of(name: str, rules: Sequence[Rule]) -> Column:
    """Sum of the hit columns of all rules called `name`."""
    total = None
    for position, rule in enumerate(rules):
        if rule.name == name:
            column = F.col(count_column(position))
            total = column if total is None else total + column
    return total
