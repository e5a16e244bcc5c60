"""Official statistics: wide yearly sheets, indicator extracts, ratios."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The columns of the yearly sheets that name an area.
AREA_COLUMNS = ["itl1_region", "la_code", "la_name"]


def clean_yearly(df: DataFrame) -> DataFrame:
    """Drop footnote rows (no area code); headers to snake case without note suffixes."""
    headers = [re.sub(r"\s*\[note \d+\]", "", c).strip().lower().replace(" ", "_") for c in df.columns]
    return df.dropna(subset=["LA code"]).toDF(*headers)


def melt_years(df: DataFrame, value_name: str, ids: Sequence[str] = tuple(AREA_COLUMNS)) -> DataFrame:
    """Wide years to one row per area and year."""
    years = [c for c in df.columns if c not in ids]
    return (
        df.unpivot(list(ids), years, "year", value_name)
        .withColumnRenamed("itl1_region", "nuts1_name")
        .withColumn("year", F.col("year").cast("int"))
    )


def ratio_per_head(gva: DataFrame, population: DataFrame) -> DataFrame:
    """Value in millions per head, rounded half to even at two digits."""
    keys = ["nuts1_name", "la_code", "la_name", "year"]
    per_head = F.try_divide(F.lit(1e6) * F.col("gva"), F.col("pop"))
    return gva.join(population, keys).select(*keys, F.bround(per_head, 2).alias("gva_pc"))


def clean_indicator(df: DataFrame, only: Mapping[str, str], variable: str, **added: str) -> DataFrame:
    """An extract in the shared long form: the rows that ``only`` selects, the date as a year.

    ``only`` gives the value that a column must have, ``variable`` names the column of the
    indicator's name, and ``added`` are columns with one value, such as the source.
    """
    year = F.split_part(F.col("DATE").cast("string"), F.lit("-"), F.lit(1)).cast("int")
    named = {"geography_name": "GEOGRAPHY_NAME", "geography_code": "GEOGRAPHY_CODE", "variable": variable, "value": "OBS_VALUE"}
    for column, value in only.items():
        df = df.where(F.col(column) == value)
    return df.select(
        year.alias("date"), *[F.col(c).alias(out) for out, c in named.items()], *[F.lit(v).alias(c) for c, v in added.items()]
    )


def union_indicators(*cleaned: DataFrame) -> DataFrame:
    """All indicator sources as one table."""
    merged = cleaned[0]
    for other in cleaned[1:]:
        merged = merged.unionByName(other)
    return merged


def labour_table(indicators: DataFrame) -> DataFrame:
    """Indicator table under the column names of the other official tables."""
    return indicators.withColumnsRenamed(
        {"date": "year", "geography_name": "la_name", "geography_code": "la_code"}
    )


def clean_population(df: DataFrame) -> DataFrame:
    """Area code and population of a population-estimate sheet; a row number stays."""
    kept = [c for c in df.columns if c == "row_no"]
    return df.select(F.col("Code").alias("geo_code"), F.col("All ages").alias("pop_2020"), *kept)
