"""The sector-code hierarchy from its sheet."""

from __future__ import annotations

from pyspark.sql import DataFrame

from sectorlens.operators.outline import append_extras, derive_subclass, normalise_codes, outline_fill


def code_hierarchy(sheet: DataFrame, row_no: str = "row_no", chunk_rows: int = 100_000) -> DataFrame:
    """Every subclass with all its ancestors, codes normalised, register extras appended.

    Feed the result to :func:`~sectorlens.operators.outline.level_names` for the lookups.
    """
    filled = outline_fill(sheet, row_no=row_no, chunk_rows=chunk_rows)
    return append_extras(normalise_codes(derive_subclass(filled, row_no=row_no, chunk_rows=chunk_rows)))
