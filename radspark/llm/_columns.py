"""Names for helper columns that don't clash with a table's own."""

from __future__ import annotations

from pyspark.sql import DataFrame


def fresh(taken: list[str] | DataFrame, *names: str) -> list[str]:
    """The names, each with as many leading underscores as it takes to differ from every taken one (in any case)."""
    used, out = {c.lower() for c in (taken.columns if isinstance(taken, DataFrame) else taken)}, []
    for name in names:
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        out.append(name)
    return out
