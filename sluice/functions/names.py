"""Column names of user data may hold anything, dots and backquotes included."""

from pyspark.sql import Column, functions as F


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def column(name: str) -> Column:
    return F.col(quoted(name))


def literal(text: str) -> str:
    """Text as a SQL literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def unique_names(cells: list[str | None]) -> list[str]:
    """Header cells as column names: empty ones are numbered, repeated ones (in any case) get a suffix."""
    taken: set[str] = set()
    out = []
    for at, cell in enumerate(cells):
        base = cell if cell else f"column{at}"
        name, n = base, 0
        while name.lower() in taken:
            n += 1
            name = f"{base}_{n}"
        taken.add(name.lower())
        out.append(name)
    return out
