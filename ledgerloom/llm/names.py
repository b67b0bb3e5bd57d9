"""Column names that do not clash with those of a user's table."""

from __future__ import annotations

from collections.abc import Iterable


def free(columns: Iterable[str], *wanted: str) -> list[str]:
    """``wanted`` with underscores put in front until none is among ``columns``, whatever the case."""
    taken = {c.lower() for c in columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
