"""Code hierarchies kept as an outline: headings above the rows they cover."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sectorlens.operators.ranking import fill_down, next_row

# The five levels, top down.
LEVELS = ("section", "division", "group", "class", "subclass")

# Subclasses that a company register adds to the official list.
EXTRA_SUBCLASSES = (
    ("74990", "Non-trading company"),
    ("98000", "Residents property management"),
    ("99999", "Dormant company"),
)


def outline_fill(
    df: DataFrame,
    levels: Sequence[str] = LEVELS[:3],
    row_no: str = "row_no",
    keys: Sequence[str] = (),
    chunk_rows: int = 100_000,
) -> DataFrame:
    """Carry each level's heading to the rows below it and drop the heading rows.

    A row with only one of code and name is a note and goes. A row dropped at one level takes no
    part in the levels below. Both follow from the row itself, so one pass fills all levels.
    """
    left, shown = F.lit(True), {}
    for code in levels:
        name = f"{code}_name"
        taking_part = left & (F.col(code).isNull() == F.col(name).isNull())
        shown.update({c: F.when(taking_part, F.col(c)) for c in (code, name)})
        left = taking_part & F.col(code).isNull()
    rows = df.withColumns({**shown, "_left": left})
    return fill_down(rows, list(shown), row_no, keys, chunk_rows).where("_left").drop("_left")


def derive_subclass(
    df: DataFrame, row_no: str = "row_no", keys: Sequence[str] = (), chunk_rows: int = 100_000
) -> DataFrame:
    """Give every row a class and a subclass; rows that become equal are kept once.

    A missing subclass comes from the next row, else it is the class with ``/0``.
    """
    rows = fill_down(df, ["class", "class_name"], row_no, keys, chunk_rows)
    rows = next_row(rows, ["subclass", "subclass_name"], row_no, keys, chunk_rows)
    own = {c: F.coalesce(c, f"next_{c}") for c in ("subclass", "subclass_name")}
    missing = F.col("subclass").isNull()
    completed = (
        rows.withColumns(own)
        .withColumns(
            {
                "subclass_name": F.when(missing, F.col("class_name")).otherwise(F.col("subclass_name")),
                "subclass": F.when(missing, F.concat("class", F.lit("/0"))).otherwise(F.col("subclass")),
            }
        )
        .drop("next_subclass", "next_subclass_name")
    )
    return completed.groupBy(*[c for c in completed.columns if c != row_no]).agg(F.min(row_no).alias(row_no))


def normalise_codes(df: DataFrame, levels: Sequence[str] = LEVELS) -> DataFrame:
    """Codes without dots and slashes."""
    return df.withColumns({c: F.regexp_replace(c, "[./]", "") for c in levels})


def append_extras(df: DataFrame) -> DataFrame:
    """Add the register's own subclasses; the other levels stay null."""
    extras = df.sparkSession.createDataFrame(list(EXTRA_SUBCLASSES), "subclass string, subclass_name string")
    return df.unionByName(extras, allowMissingColumns=True)


def level_names(df: DataFrame, row_no: str | None = None) -> DataFrame:
    """One long table (level, code, name); of repeated codes the last row's name stays."""
    # Appended rows have no row number and come last.
    order = F.struct(F.col(row_no).isNull(), row_no) if row_no else F.lit(0)
    entries = F.array(
        *[
            F.struct(F.lit(i).alias("level"), F.col(c).alias("code"), F.col(f"{c}_name").alias("name"))
            for i, c in enumerate(LEVELS, start=1)
        ]
    )
    # Names break ties of the row order, so the result never depends on the task order.
    return (
        df.select(order.alias("_order"), F.explode(entries).alias("e"))
        .select("_order", "e.*")
        .dropna(subset=["code", "name"])
        .groupBy("level", "code")
        .agg(F.max_by("name", F.struct("_order", "name")).alias("name"))
    )


def level_lookup(names: DataFrame, level: int) -> DataFrame:
    """Code to name at one level, 1 (section) to 5 (subclass)."""
    if level not in range(1, len(LEVELS) + 1):
        raise ValueError(f"level {level} is not between 1 and {len(LEVELS)}")
    return names.where(F.col("level") == level).select("code", "name")
