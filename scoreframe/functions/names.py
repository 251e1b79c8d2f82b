"""Names for helper columns that no column of the user's has."""

from __future__ import annotations


def unused(taken: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores before it as tell it from all columns there are."""
    have, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in have:
            name = "_" + name
        have.add(name.lower())
        out.append(name)
    return out
