"""Writing report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from oddsift.functions.scalars import regional_text
from oddsift.operators.prepare import quoted


def regional(df: DataFrame) -> DataFrame:
    """Fractional numbers as text with a decimal comma."""
    fractional = (T.DoubleType, T.FloatType, T.DecimalType)
    return df.select(*[
        (regional_text(quoted(f.name)) if isinstance(f.dataType, fractional) else quoted(f.name)).alias(f.name)
        for f in df.schema.fields
    ])


def write_regional_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    regional(df).write.mode(mode).option("sep", ";").option("header", True).option("escape", '"').csv(path)


def write_document(doc: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object per row of ``doc``: a nested report, or a report in lines."""
    doc.write.mode(mode).json(path)


def write_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A plain CSV table with a header."""
    df.write.mode(mode).option("header", True).csv(path)
