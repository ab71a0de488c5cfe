"""Column helpers shared by the log operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# Unicode whitespace (strip() semantics), from the rule rather than a list.
WHITESPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it in ``body`` as often as needed, also inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def or_zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0))


def non_empty(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def drop_nulls(*items: Column) -> Column:
    return F.array_compact(F.array(*items))


def any_contains(text: Column, terms: list[str]) -> Column:
    found = F.lit(False)
    for term in terms:
        found = found | text.contains(term)
    return found
