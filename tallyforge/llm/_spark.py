"""Session helpers of the library, and names that do not clash with a user's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..sources.scratch import release, scratch_path, shared_dir, stored

__all__ = ["free", "release", "scratch_path", "shared_dir", "stored"]


def free(df: DataFrame, *names: str) -> list[str]:
    """Each of ``names``, with underscores before it until no column of ``df`` is called so in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out
