"""Text patterns of the profiler."""

from __future__ import annotations

from pyspark.sql import Column

# (?U) reads \d and \s as Unicode classes, (?d) lets $ stop only before a line feed.
FLAGS = "(?Ud)"

# Formats in the order in which they are tried.
STRING_FORMATS = {
    "email": r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$",
    "url": r"^https?://",
    "phone": r"^\+?[\d\s\-\(\)]{10,}$",
    "uuid": r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
}
NUMERIC_LIKE = r"^-?\d+\.?\d*$"

# Thresholds, all strict.
FORMAT_SHARE = 0.8
NUMERIC_SHARE = 0.5
NULL_PERCENT = 50


def format_test(text: str, name: str) -> str:
    """SQL: whether ``text`` has the named format; a cheap necessary condition comes before the pattern."""
    hint = {
        "email": f"contains({text}, '@')",
        "url": f"startswith({text}, 'http')",
        "phone": f"length({text}) >= 10",
        "uuid": f"length({text}) BETWEEN 36 AND 37",
    }[name]
    subject = f"lower({text})" if name == "uuid" else text
    return f"({hint} AND {subject} RLIKE r'{FLAGS}{STRING_FORMATS[name]}')"


def format_choice(shares: dict[str, str]) -> str:
    """SQL: the first format whose share of matching values exceeds the threshold, else NULL."""
    tests = " ".join(f"WHEN {shares[name]} > {FORMAT_SHARE}D THEN '{name}'" for name in STRING_FORMATS)
    return f"CASE {tests} END"


def looks_numeric(col: Column) -> Column:
    return col.rlike(FLAGS + NUMERIC_LIKE)
