"""Rule lists from JSON or YAML files."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import SparkSession

from ..functions.dialect import to_java, to_java_replacement
from ..functions.rules import Rule

try:
    import yaml
except ImportError:  # JSON rule files still work
    yaml = None


def rules_from(entries: Iterable[Mapping[str, Any]]) -> list[Rule]:
    """Enabled rules in file order; a missing key or an untranslatable pattern fails here."""
    rules = [
        Rule(entry["name"], entry["pattern"], entry["replacement"])
        for entry in entries
        if entry.get("enabled", True)
    ]
    for rule in rules:
        to_java(rule.pattern)
        to_java_replacement(rule.replacement, rule.pattern)
    return rules


def load_rules(path: str, spark: SparkSession | None = None) -> list[Rule]:
    """Read a `{rules: [...]}` document; the rules become literals of the query plan.

    With a session the file may be on any file system Spark reads.
    """
    if spark is None:
        with open(path, encoding="utf-8") as handle:
            content = handle.read()
    else:
        row = spark.read.text(path, wholetext=True).first()
        content = row["value"] if row else ""
    document = yaml.safe_load(content) if yaml is not None else json.loads(content)
    return rules_from((document or {}).get("rules", []))
