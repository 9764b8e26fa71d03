"""Normalization rules: plain data in Python regex syntax, applied in order."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    name: str
    pattern: str
    replacement: str
    enabled: bool = True


# Names, order, patterns and placeholders decide the normalized text.
DEFAULT_RULES: tuple[Rule, ...] = (
    Rule("ip_address", r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "<IP>"),
    Rule("uuid", r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b", "<UUID>"),
    Rule("hex_value", r"\b0x[0-9a-fA-F]+\b", "<HEX>"),
    Rule("duration", r"\b\d+(?:\.\d+)?\s?(?:ms|s|sec|secs|seconds|m|min|mins|minutes|h|hr|hrs|hours)\b", "<DURATION>"),
    Rule("file_path", r"(?<!\w)(?:/[\w.\-/]+)", "<PATH>"),
    Rule("float_value", r"(?<![\w.])[-+]?\d+\.\d+(?![\w.])", "<FLOAT>"),
    Rule("long_id", r"\b[A-Za-z0-9][A-Za-z0-9_-]{11,}\b", "<ID>"),
    Rule("integer", r"(?<![\w.])[-+]?\d+(?![\w.])", "<INT>"),
)


def rule_named(name: str) -> Rule:
    return next(rule for rule in DEFAULT_RULES if rule.name == name)
