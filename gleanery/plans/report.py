"""Result tables as Markdown."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.utils import AnalysisException


def load_table(spark: SparkSession, folder: str, name: str) -> DataFrame | None:
    """A result table, or None if it was never written."""
    try:
        return spark.read.options(header=True, inferSchema=True).csv(f"{folder.rstrip('/')}/{name}")
    except AnalysisException:
        return None


def cell(value) -> str:
    if value is None:
        return "-"
    return f"{value:.4f}".rstrip("0").rstrip(".") if isinstance(value, float) else str(value)


def table(columns: list[str], rows: Iterable) -> str:
    lines = ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    return "\n".join([*lines, *("| " + " | ".join(map(cell, r)) + " |" for r in rows)])


def section(title: str, df: DataFrame | None, note: str = "", most: int = 50) -> str:
    """A heading, a note and the first `most` rows of a result table."""
    body = "_not available_" if df is None else table(df.columns, df.limit(most).collect())
    return "\n\n".join(x for x in (f"## {title}", note, body) if x)


def leakage_note(effects: dict[str, float]) -> str:
    """Which of the two leaks inflates the score more, from the numbers themselves."""
    a, b = sorted(effects, key=lambda k: -effects[k])[:2]
    return f"{a} inflates PR-AUC more ({effects[a]:+.4f}) than {b} ({effects[b]:+.4f})."


def document(title: str, sections: Iterable[str]) -> str:
    return "\n\n".join([f"# {title}", *sections]) + "\n"
