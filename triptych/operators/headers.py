"""Columns found by name."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame


def trim_headers(df: DataFrame) -> DataFrame:
    names = [name.strip() for name in df.columns]
    repeated = sorted({n for n in names if names.count(n) > 1})
    if repeated:
        raise ValueError(f"columns with the same name after trimming: {repeated}")
    return df.toDF(*names)


def find_header(columns: Sequence[str], wanted: Sequence[str]) -> str | None:
    """The first wanted name that is a column or part of one.

    For each wanted name in turn an exact column comes first, then the
    leftmost column that contains it.
    """
    for name in wanted:
        hits = [c for c in columns if name in c]
        if hits:
            return name if name in hits else hits[0]
    return None


def resolve_roles(columns: Sequence[str], wanted: Mapping[str, Sequence[str]]) -> dict[str, str]:
    """The column of each role; every role must have one."""
    found = {role: find_header(columns, names) for role, names in wanted.items()}
    missing = [role for role, name in found.items() if name is None]
    if missing:
        raise ValueError(f"no column for {', '.join(missing)} among {list(columns)}")
    return {role: name for role, name in found.items() if name is not None}


def require_columns(df: DataFrame, names: Sequence[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}")
