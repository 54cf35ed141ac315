"""Regular-expression helpers that keep line numbers, without a Python UDF.

They return SQL expression text over the columns ``path`` and ``content``: one parse per rule is far
cheaper to plan than hundreds of single Column calls.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def any_of(patterns: Sequence[str]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def matches(value: str, pattern: str) -> str:
    return f"rlike({value}, {literal(pattern)})"


def contains_any(words: Sequence[str], value: str = "content") -> str:
    """A cheap byte search that goes ahead of a regular expression."""
    return "(" + " OR ".join(f"contains({value}, {literal(w)})" for w in words) + ")"


def match_lines(pattern: str) -> str:
    """Line number of every match, in match order.

    Each match start gets one extra character; a line that grew by n holds n match starts. The lines
    themselves stay as they were, so this is linear in the text and right for multi-line matches.
    """
    marked = f"regexp_replace(content, {literal(f'({pattern})')}, '\\u0001$1')"
    grown = f"zip_with(split({marked}, '\\n', -1), split(content, '\\n', -1), (m, o) -> length(m) - length(o))"
    hits = f"filter(transform({grown}, (n, i) -> struct(i + 1 AS line, n AS n)), h -> h.n > 0)"
    return f"flatten(transform({hits}, h -> array_repeat(h.line, h.n)))"


def match_group(pattern: str, group: int) -> str:
    return f"regexp_extract_all(content, {literal(pattern)}, {group})"


def first_match_line(pattern: str) -> str:
    before = f"substring(content, 1, regexp_instr(content, {literal(pattern)}) - 1)"
    return f"1 + length({before}) - length(translate({before}, '\\n', ''))"


def trim_end(text: Column) -> Column:
    from plumbline.fixed_values import WS

    return F.regexp_replace(text, rf"{WS}+\z", "")
