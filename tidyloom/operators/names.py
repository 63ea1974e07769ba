"""Columns by name, whatever characters the name holds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RID = "_rid"


def told(problem: BaseException) -> str:
    """An error in one short line."""
    return f"{type(problem).__name__}: {' '.join(str(problem).split())[:200]}"


def col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def mask(name: str) -> str:
    return f"m__{name}"


def fixed(name: str) -> str:
    return f"x__{name}"


def flag(name: str) -> str:
    return f"f__{name}"


def trail(name: str) -> str:
    return f"t__{name}"
