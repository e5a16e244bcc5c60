"""Reading official sheets and extracts that were exported as CSV."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sectorlens.operators.outline import LEVELS

ROW_NO = "row_no"
OUTLINE_COLUMNS = tuple(c for level in LEVELS for c in (level, f"{level}_name"))
INDICATOR_SCHEMA = (
    "DATE string, GEOGRAPHY_NAME string, GEOGRAPHY_CODE string, "
    "VARIABLE_NAME string, MEASURES_NAME string, OBS_VALUE double"
)


def read_sheet(
    spark: SparkSession, path: str, columns: Sequence[str], skip_rows: int, line_breaks: bool = False
) -> DataFrame:
    """A sheet as strings under the given column names.

    The export leads with the sheet's row number (from 0), so the sheet may come in any number
    of files. Rows before ``skip_rows`` are titles and headers; empty rows go; cells are trimmed.
    Only with ``line_breaks`` may a cell hold a line break, as Spark can't split such files.
    """
    schema = ", ".join([f"{ROW_NO} long", *[f"`{c}` string" for c in columns]])
    rows = spark.read.schema(schema).option("multiLine", line_breaks).csv(path)
    return (
        rows.where(F.col(ROW_NO) >= skip_rows)
        .dropna(how="all", subset=[f"`{c}`" for c in columns])
        .withColumns({c: F.trim(F.col(f"`{c}`")) for c in columns})
    )


def read_outline(spark: SparkSession, path: str) -> DataFrame:
    """The code hierarchy: one title row, one header row, then code and name per level."""
    return read_sheet(spark, path, OUTLINE_COLUMNS, skip_rows=2)


def read_yearly(
    spark: SparkSession, path: str, ids: Sequence[str], years: Sequence[str], skip_rows: int
) -> DataFrame:
    """A sheet of area columns and one numeric column per year."""
    rows = read_sheet(spark, path, [*ids, *years], skip_rows)
    return rows.withColumns({y: F.col(f"`{y}`").try_cast("double") for y in years}).drop(ROW_NO)


def read_population(spark: SparkSession, path: str, skip_rows: int) -> DataFrame:
    """A population-estimate sheet of area codes and totals; keeps the row number."""
    rows = read_sheet(spark, path, ["Code", "All ages"], skip_rows)
    return rows.withColumn("All ages", F.col("All ages").try_cast("long"))


def read_indicators(spark: SparkSession, path: str, schema: str = INDICATOR_SCHEMA) -> DataFrame:
    """An indicator extract with a header line."""
    return spark.read.schema(schema).option("header", True).csv(path)


def population_lookup(cleaned: DataFrame, row_no: str = ROW_NO) -> DataFrame:
    """Area code to population; of repeated codes the last row stays."""
    return cleaned.groupBy("geo_code").agg(F.max_by("pop_2020", row_no).alias("pop_2020"))
