"""Small builders of Spark SQL expression text. Page features are nested higher-order functions; as SQL text each one
is parsed once on the JVM instead of being assembled call by call from Python."""

from __future__ import annotations

from crawlgrain.functions.expr import WHITESPACE


def lit(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def in_list(items) -> str:
    return "(" + ", ".join(lit(i) for i in items) + ")"


def let(name: str, value: str, body: str) -> str:
    """Evaluate ``value`` once per row and use it as ``name`` in ``body`` as often as needed, also in lambdas."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def strip(text: str) -> str:
    return f"btrim({text}, {lit(WHITESPACE)})"


def non_empty(text: str) -> str:
    return f"nullif({text}, '')"


def struct(**fields: str) -> str:
    return "named_struct(" + ", ".join(f"'{name}', {value}" for name, value in fields.items()) + ")"


def drop_nulls(*items: str) -> str:
    return f"array_compact(array({', '.join(items)}))"


def any_of(*tests: str) -> str:
    return "(" + " OR ".join(tests) + ")"


def first_of_runs(ordered: str, key: str) -> str:
    """First element of each run of equal ``key`` fields in an already sorted array."""
    return let("xs", ordered, f"filter(xs, (x, i) -> i = 0 OR x.{key} <> get(xs, i - 1).{key})")


def counted_runs(words: str) -> str:
    """array<string> -> array<struct<word, n, pos>>: each distinct word, its count and first position.

    Sorting (word, position) pairs makes equal words adjacent, so counts are distances between run starts:
    n log n within the row, and no shuffle of word rows.
    """
    pairs = f"sort_array(transform({words}, (w, i) -> {struct(word='w', pos='i')}))"
    starts = ("filter(transform(xs, (x, i) -> CASE WHEN i = 0 OR x.word <> get(xs, i - 1).word THEN i END), "
              "s -> s IS NOT NULL)")
    counts = struct(word="get(xs, s).word", n="coalesce(get(ss, j + 1), size(xs)) - s", pos="get(xs, s).pos")
    return let("xs", pairs, let("ss", starts, f"transform(ss, (s, j) -> {counts})"))
