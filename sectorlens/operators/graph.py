"""The word-document graph of each sector and the statistics of its groups.

Edges are (sector, doc_id, word, cnt); labels are (sector, doc_id, doc_group) and
(sector, word, word_group).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sectorlens.operators.ranking import ranked, top_per_key
from sectorlens.session import cut


def frequent_words(edges: DataFrame, n_min: int | None) -> DataFrame:
    """Edges of the words with at least ``n_min`` edges."""
    if n_min is None:
        return edges
    kept = edges.groupBy("sector", "word").agg(F.count("*").alias("degree")).where(F.col("degree") >= n_min)
    return edges.join(kept.select("sector", "word"), ["sector", "word"], "left_semi")


def bow_edges(corpora: DataFrame, counts: bool = True, n_min: int | None = None) -> DataFrame:
    """One edge per document and word with its count, or one edge per occurrence."""
    words = corpora.select("sector", F.col("org_id").alias("doc_id"), F.explode("tokens").alias("word"))
    if counts:
        edges = words.groupBy("sector", "doc_id", "word").agg(F.count("*").alias("cnt"))
    else:
        edges = words.withColumn("cnt", F.lit(1).cast("long"))
    return frequent_words(edges, n_min)


def matrix_edges(
    matrix: DataFrame, word: str, documents: Sequence[str], sector: str, counts: bool = True, n_min: int | None = None
) -> DataFrame:
    """Edges of a bag-of-words matrix: a row per word, a column per document; cells below 1 are no edge."""
    cells = (
        matrix.unpivot([word], list(documents), "doc_id", "cnt")
        .where("cnt >= 1")
        .select(F.lit(sector).alias("sector"), "doc_id", F.col(word).alias("word"), "cnt")
    )
    if not counts:
        if not cells.where("cnt <> floor(cnt)").isEmpty():
            raise ValueError("cells must be whole numbers when every occurrence is an edge")
        occurrences = F.explode(F.array_repeat(F.lit(1).cast("long"), F.col("cnt").cast("int")))
        cells = cells.select("sector", "doc_id", "word", occurrences.alias("cnt"))
    return frequent_words(cells, n_min)


def graph_sizes(edges: DataFrame) -> DataFrame:
    """Words, documents and edges of each sector."""
    return edges.groupBy("sector").agg(
        F.countDistinct("word").alias("n_words"),
        F.countDistinct("doc_id").alias("n_docs"),
        F.count("*").alias("n_edges"),
    )


def labelled(edges: DataFrame, doc_groups: DataFrame, word_groups: DataFrame) -> DataFrame:
    return edges.join(doc_groups, ["sector", "doc_id"]).join(word_groups, ["sector", "word"])


def _sums(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    return edges.groupBy(*keys).agg(F.sum("cnt").alias("n"))


def word_group_counts(edges: DataFrame, word_groups: DataFrame) -> DataFrame:
    """Half-edges per word and word group."""
    return _sums(edges.join(word_groups, ["sector", "word"]), ["sector", "word", "word_group"])


def doc_group_counts(edges: DataFrame, doc_groups: DataFrame) -> DataFrame:
    """Half-edges per document and document group."""
    return _sums(edges.join(doc_groups, ["sector", "doc_id"]), ["sector", "doc_id", "doc_group"])


def doc_word_group_counts(edges: DataFrame, word_groups: DataFrame) -> DataFrame:
    """Half-edges per document and word group."""
    return _sums(edges.join(word_groups, ["sector", "word"]), ["sector", "doc_id", "word_group"])


def share_of(df: DataFrame, keys: Sequence[str], value: str = "n", out: str = "p") -> DataFrame:
    """Value divided by its sum per key. The sums are aggregated, never windowed, so a key of any size works."""
    totals = df.groupBy(*keys).agg(F.sum(value).alias("_total"))
    return df.join(totals, list(keys)).withColumn(out, F.try_divide(value, "_total")).drop("_total")


def word_membership(edges: DataFrame, word_groups: DataFrame) -> DataFrame:
    """P(word group | word)."""
    return share_of(word_group_counts(edges, word_groups), ["sector", "word"]).drop("n")


def doc_membership(edges: DataFrame, doc_groups: DataFrame) -> DataFrame:
    """P(document group | document)."""
    return share_of(doc_group_counts(edges, doc_groups), ["sector", "doc_id"]).drop("n")


def topic_words(edges: DataFrame, word_groups: DataFrame) -> DataFrame:
    """P(word | word group)."""
    return share_of(word_group_counts(edges, word_groups), ["sector", "word_group"]).drop("n")


def doc_topics(edges: DataFrame, word_groups: DataFrame) -> DataFrame:
    """P(word group | document)."""
    counts = cut(doc_word_group_counts(edges, word_groups))  # read by the sums and by the shares
    return share_of(counts, ["sector", "doc_id"]).drop("n")


def group_numbers(doc_groups: DataFrame, word_groups: DataFrame) -> DataFrame:
    """Number of document and word groups of each sector."""
    docs = doc_groups.groupBy("sector").agg(F.countDistinct("doc_group").alias("n_doc_groups"))
    words = word_groups.groupBy("sector").agg(F.countDistinct("word_group").alias("n_word_groups"))
    return docs.join(words, "sector")


def group_mixture(edges: DataFrame, doc_groups: DataFrame, word_groups: DataFrame, norm: bool = True) -> DataFrame:
    """Edges between document and word groups, as shares of the sector or as counts."""
    counts = _sums(labelled(edges, doc_groups, word_groups), ["sector", "doc_group", "word_group"])
    return share_of(counts, ["sector"]).drop("n") if norm else counts


def group_pmi(mixture: DataFrame) -> DataFrame:
    """Pointwise mutual information of document and word groups; pairs without edges have no row."""
    docs = mixture.groupBy("sector", "doc_group").agg(F.sum("p").alias("p_doc"))
    words = mixture.groupBy("sector", "word_group").agg(F.sum("p").alias("p_word"))
    joined = mixture.join(docs, ["sector", "doc_group"]).join(words, ["sector", "word_group"])
    return joined.select(
        "sector", "doc_group", "word_group", F.log(F.col("p") / (F.col("p_doc") * F.col("p_word"))).alias("pmi")
    )


def top_words(topics: DataFrame, n: int | None = 10) -> DataFrame:
    """The ``n`` most probable words of each topic, or all, ranked; equal ones by word."""
    present = topics.where("p > 0")
    keys = ["sector", "word_group"]
    if n is None:
        return ranked(present, keys, [-F.col("p"), F.col("word")], out="rank")
    return top_per_key(present, keys, [F.desc("p"), F.col("word")], n).withColumn("rank", F.col("rank").cast("long"))


def top_docs(membership: DataFrame, n: int | None = 10) -> DataFrame:
    """The ``n`` most representative documents of each group, or all, ranked; equal ones by id."""
    present = membership.where("p > 0")
    keys = ["sector", "doc_group"]
    if n is None:
        return ranked(present, keys, [-F.col("p"), F.col("doc_id")], out="rank")
    return top_per_key(present, keys, [F.desc("p"), F.col("doc_id")], n).withColumn("rank", F.col("rank").cast("long"))


def topic_distribution(topics_of_docs: DataFrame) -> DataFrame:
    """P(topic | document) with a zero for every topic a document lacks."""
    docs = topics_of_docs.select("sector", "doc_id").distinct()
    topics = topics_of_docs.groupBy("sector").agg(F.collect_set("word_group").alias("topics"))
    cells = docs.join(topics, "sector").select("sector", "doc_id", F.explode("topics").alias("word_group"))
    return cells.join(topics_of_docs, ["sector", "doc_id", "word_group"], "left").withColumn(
        "p", F.coalesce("p", F.lit(0.0))
    )


def cluster_peers(doc_groups: DataFrame, asked: DataFrame) -> DataFrame:
    """The other documents in the group of each asked document (sector, doc_id)."""
    homes = asked.join(doc_groups, ["sector", "doc_id"]).withColumnRenamed("doc_id", "asked_id")
    return doc_groups.join(homes, ["sector", "doc_group"]).where("doc_id <> asked_id").select(
        "sector", "asked_id", "doc_group", "doc_id"
    )


# Text sectors.


def docs_to_assign(share: int | float | str, corpus_size: Column) -> Column:
    """Documents kept per group: a count as it is, a fraction of the sector, a word for all of it."""
    if isinstance(share, bool) or not isinstance(share, (int, float, str)):
        raise ValueError(f"{share!r} says no number of documents")
    if isinstance(share, int):
        limit = F.lit(share)
    elif isinstance(share, float):
        limit = F.floor(corpus_size * F.lit(share))
    else:
        limit = corpus_size
    return limit.cast("long")


DEFAULT_SHARES = (10, 100, 500, 0.5, "all")


def text_sectors(doc_groups: DataFrame, shares: Sequence[int | float | str] = DEFAULT_SHARES) -> DataFrame:
    """(param, sector_id, org_id): the leading documents of every group, for all shares in one job.

    In groups without overlap all members are equally representative, so they go by id.
    """
    sizes = doc_groups.groupBy("sector").agg(F.count("*").alias("_size"))
    limits = F.array(
        *[
            F.struct(F.lit(f"assigned_{s}").alias("param"), docs_to_assign(s, F.col("_size")).alias("limit"))
            for s in shares
        ]
    )
    placed = ranked(doc_groups, ["sector", "doc_group"], [F.col("doc_id")])
    return (
        placed.join(sizes, "sector")
        .withColumn("_share", F.explode(limits))
        .where(F.col("rn") <= F.col("_share.limit"))
        .select(
            "_share.param",
            F.concat_ws("_", "sector", "doc_group").alias("sector_id"),
            F.col("doc_id").alias("org_id"),
        )
    )


# Wide export tables.


def _wide(df: DataFrame, rows: Sequence[str], group: str, label: str, value: str) -> DataFrame:
    # Written first, as the columns' names are collected before the table is made.
    named = cut(df.withColumn("_column", F.concat(F.lit(f"{label} "), (F.col(group) + 1).cast("string"))))
    return named.groupBy(*rows).pivot("_column").agg(F.first(value))


def topics_table(topics: DataFrame) -> DataFrame:
    """A column per topic with its words, the most probable first."""
    return _wide(top_words(topics, None), ["sector", "rank"], "word_group", "Topic", "word")


def topic_distribution_table(topics_of_docs: DataFrame) -> DataFrame:
    """A row per document with its share of every topic."""
    return _wide(topic_distribution(topics_of_docs), ["sector", "doc_id"], "word_group", "Topic", "p")


def clusters_table(membership: DataFrame) -> DataFrame:
    """A column per document group with its documents."""
    return _wide(top_docs(membership, None), ["sector", "rank"], "doc_group", "Cluster", "doc_id")


def export_table(table: DataFrame, path: str, sep: str = ",") -> None:
    """Write a wide table as CSV, or as TSV with a tab as ``sep``."""
    table.write.mode("overwrite").option("header", True).option("sep", sep).csv(path)
