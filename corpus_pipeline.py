"""The corpus pipeline: each stage reads what its predecessor kept, as a written table.

Every stage takes and, but for the last, returns the columns of its documents, whatever other columns
these have. Null and empty texts, ties and repeated rows: see each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sectorlens.llm import jaccard, language, lines, packing, secrets
from sectorlens.session import cut

ORACLE_SQL = None
LEAST_SCORE = 0.5
LISTED = 2_000_000  # ids at most that are sent to every task


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a language that the labelled documents teach, surer than not.

    Null and empty texts, and those without a letter, go. Repeated rows are judged alike; of
    languages with equal probability the first by name counts. Without a labelled document all go.
    """
    languages, table = language.fit(docs.where(language.training_rows(docs)))
    # The documents' columns travel under names of their own, as they may be called like the judgement's.
    places = [f"_column{i}" for i in range(len(docs.columns))]
    named = docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(p) for c, p in zip(docs.columns, places, strict=True)])
    judged = language.identify(named, languages, table, keep=tuple(places))
    kept = judged.where((F.col("lang_pred") != language.UNDECIDED) & (F.col("score") >= LEAST_SCORE))
    return kept.select(*[F.col(p).alias(c) for c, p in zip(docs.columns, places, strict=True)])


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines of templates that recur across documents; no document goes.

    Null texts stay null, empty ones empty. Repeated rows count once and lose the same lines.
    """
    return _measured(lines.drop_recurring(docs), docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest doc_id of each group of linked documents, one row of rows that repeat it.

    Null and empty texts link with nothing and stay, as do rows with a null doc_id. Of rows that
    share a doc_id but differ, all stay or none.
    """
    groups = cut(jaccard.jaccard_components(docs))
    # Up to LISTED ids travel to the tasks, so that the texts don't move; more are joined by a shuffle.
    repeated = _listed(groups.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    kept = docs.join(_listed(groups.where("doc_id <> component_id").select("doc_id").distinct()), "doc_id", "left_anti")
    # Compared as text, since columns such as maps have no equality.
    row = "_" + max(docs.columns, key=len)  # a name that no column has
    several = kept.join(repeated, "doc_id", "left_semi").withColumn(row, F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns])))
    once = several.dropDuplicates([row]).drop(row)
    return kept.join(repeated, "doc_id", "left_anti").unionByName(once).select(*[F.col(f"`{c}`") for c in docs.columns])


def _listed(ids: DataFrame) -> DataFrame:
    ids = cut(ids)
    return F.broadcast(ids) if ids.count() <= LISTED else ids


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret in the texts by its kind; null and empty texts and repeated rows stay as they are."""
    return _measured(secrets.redact(docs), docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents' tokens into training sequences.

    A null or empty text is its end token alone; repeated rows are packed each.
    """
    return packing.pack(docs)


def _measured(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The length column follows the changed text."""
    if "n_chars" not in columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*columns)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("jaccard_join", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs
