"""Wide tables of any width as text files: a column per group, written in parallel and without a pivot.

A pivot needs the groups as columns of a plan, which ends at some thousands. Here a row's cells are
one sorted array of (place, value); the line follows from the gaps between places, so it costs as
much as the row has values. The header is one line that every task writes first, as readers of
headered files expect it in each file.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sectorlens.operators.graph import top_docs, top_words, topic_distribution
from sectorlens.operators.ranking import ranked
from sectorlens.session import cut


def _quoted(value: Column, sep: str) -> Column:
    """As Spark's own writer: quotes around values with separators, quotes or line ends, quotes escaped."""
    special = value.contains(sep) | value.contains('"') | value.contains("\n") | value.contains("\r")
    return F.when(special, F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('\\"')), F.lit('"'))).otherwise(value)


def wide_lines(cells: DataFrame, rows: Sequence[str], group: str, label: str, value: str, sep: str = ",") -> tuple[str, DataFrame]:
    """The header, and ``(value)`` with a line per combination of ``rows``; a cell without a row stays empty.

    ``group`` numbers the columns from 0; the header calls them by ``label`` and number from 1, in order.
    """
    cells = cut(cells.select(*rows, group, value))
    groups = cut(cells.where(F.col(group).isNotNull()).select(group).distinct())
    places = cut(ranked(groups, [], [F.col(group)], out="_place"))
    names = [r[0] for r in places.orderBy("_place").select(group).toLocalIterator()]  # a number per column of the file
    header = sep.join([*rows, *[f"{label} {g + 1}" for g in names]])
    cell = F.struct("_place", _quoted(F.col(value).cast("string"), sep).alias("v"))
    per_row = cells.join(places, group).groupBy(*rows).agg(F.array_sort(F.collect_list(cell)).alias("x"))

    def joined(c: Column, i: Column) -> Column:
        before = F.when(i == 0, F.lit(1)).otherwise(F.get("x", i - 1)["_place"])
        return F.concat(F.repeat(F.lit(sep), (c["_place"] - before).cast("int")), F.coalesce(c["v"], F.lit("")))

    behind = F.repeat(F.lit(sep), (len(names) - F.element_at("x", -1)["_place"]).cast("int"))
    keys = [F.coalesce(_quoted(F.col(c).cast("string"), sep), F.lit("")) for c in rows]
    line = F.concat(F.concat_ws(sep, *keys), F.lit(sep), F.array_join(F.transform("x", joined), ""), behind)
    return header, per_row.select(line.alias("value"))


def write_wide(header: str, lines: DataFrame, path: str) -> None:
    """Text files that each begin with the header."""

    def rows(batches):
        yield pa.RecordBatch.from_arrays([pa.array([header])], ["value"])
        yield from batches

    lines.mapInArrow(rows, "value string").write.mode("overwrite").text(path)


def export_topics(topics: DataFrame, path: str, sep: str = ",") -> None:
    """A column per topic with its words, the most probable first."""
    write_wide(*wide_lines(top_words(topics, None), ["sector", "rank"], "word_group", "Topic", "word", sep), path)


def export_topic_distribution(topics_of_docs: DataFrame, path: str, sep: str = ",") -> None:
    """A row per document with its share of every topic of its sector."""
    write_wide(*wide_lines(topic_distribution(topics_of_docs), ["sector", "doc_id"], "word_group", "Topic", "p", sep), path)


def export_clusters(membership: DataFrame, path: str, sep: str = ",") -> None:
    """A column per document group with its documents."""
    write_wide(*wide_lines(top_docs(membership, None), ["sector", "rank"], "doc_group", "Cluster", "doc_id", sep), path)
