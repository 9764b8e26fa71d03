"""Generalized token signature of a normalized line."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .parse import SEVERITIES
from .text import digit_class, is_ascii, words

VARIABLE = "<VAR>"
_TOKEN_EDGES = ",;"


def _token(raw: Column, digits: str) -> Column:
    token = F.btrim(raw, F.lit(_TOKEN_EDGES))
    upper = F.upper(token)
    return (
        F.when(token.startswith("<") & token.endswith(">"), token)
        .when(token.startswith("[") & token.endswith("]"), F.lower(token))
        .when(upper.isin(*SEVERITIES), upper)
        .when(F.rlike(token, F.lit(digits)), F.lit(VARIABLE))
        .otherwise(F.lower(token))
    )


def token_signature(text: Column) -> Column:
    """Keep placeholders, lower-case words, and turn any token with a digit into <VAR>."""
    tokens = words(text)
    ascii_form = F.transform(tokens, lambda t: _token(t, "[0-9]"))
    full_form = F.transform(tokens, lambda t: _token(t, digit_class()))
    return F.array_join(F.when(is_ascii(text), ascii_form).otherwise(full_form), " ")
