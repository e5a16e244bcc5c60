"""Embedding descriptions and checking the result."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sectorlens.functions.text import token_count
from sectorlens.operators.factors import decompose
from sectorlens.operators.knn import knn_join
from sectorlens.operators.lengths import cumulative_histogram, percentile_rank
from sectorlens.operators.sampling import first_rows, sample_exact
from sectorlens.operators.subwords import subword_counts
from sectorlens.session import cut


def embed_tokens(corpus: DataFrame, dim: int = 64, hashes: int = 4, seed: int = 100) -> DataFrame:
    """(org_id, embedding): TF-IDF weights under signed feature hashing, scaled to length 1.

    Each token adds its weight, with a sign, to ``hashes`` places taken from its hash
    (Weinberger et al. 2009). Hashes are computed once per distinct token.
    A document without tokens has the zero vector.
    """
    documents = corpus.agg(F.count("*").alias("n_docs"))  # a single row
    counts = _row_counts(corpus)
    digest = F.md5(F.concat(F.lit(f"{seed}:"), "token"))

    def number(start: int, length: int):
        return F.conv(F.substring(digest, start, length), 16, 10).cast("long")

    places = F.array(
        *[
            ((number(8 * i + 1, 7) % dim).cast("int") + 1) * F.when(number(8 * i + 8, 1) % 2 == 0, 1).otherwise(-1)
            for i in range(hashes)
        ]
    )  # a place from 1 on, with the sign
    frequency = _holders(corpus).groupBy("token").agg(F.count("*").alias("df"))
    weights = frequency.join(F.broadcast(documents)).select(
        "token", (F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1).alias("idf"), places.alias("places")
    )
    # Written first, so that the hashing is not repeated for every row of the join. The rows go to
    # their document once, with all places, and are added up there.
    met = counts.join(cut(weights), "token").select("org_id", (F.col("tf") * F.col("idf")).alias("w"), "places").repartition("org_id")
    sums = (
        met.select("org_id", "w", F.explode("places").alias("p"))
        .groupBy("org_id", (F.abs("p") - 1).alias("place"))
        .agg(F.sum(F.col("w") * F.signum("p")).alias("v"))
    )
    # A list of at most `dim` cells per document, spread over the places of the vector.
    cells = sums.groupBy("org_id").agg(
        F.collect_list("place").alias("places"), F.collect_list("v").alias("values"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm")
    )

    def value(place: Column) -> Column:
        found = F.get("values", F.coalesce(F.array_position("places", place), F.lit(0)).cast("int") - 1)
        return F.coalesce(F.try_divide(found, F.col("norm")), F.lit(0.0)).cast("float")

    vector = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), value)
    return corpus.select("org_id").join(cells, "org_id", "left").select("org_id", vector.alias("embedding"))


def _row_counts(corpus: DataFrame) -> DataFrame:
    """(org_id, token, tf): one row per row of the corpus and token, counted inside the row."""
    # The sorted tokens and the places where a new one starts travel in one-element arrays, so they are computed once.
    counted = F.expr(
        "flatten(transform(array(array_sort(tokens)), s ->"
        " flatten(transform(array(filter(sequence(0, size(s) - 1), i -> i = 0 or not (s[i] <=> s[i - 1]))), starts ->"
        "  transform(starts, (at, j) -> struct(s[at] as token, coalesce(get(starts, j + 1), size(s)) - at as tf))))))"
    )
    return corpus.where(F.size("tokens") > 0).select("org_id", F.explode(counted).alias("c")).select("org_id", "c.token", "c.tf")


def _holders(corpus: DataFrame) -> DataFrame:
    """(token): one row per organisation that holds the token, however many rows it has."""
    several = cut(corpus.groupBy("org_id").count().where("count > 1").select(F.col("org_id").alias("_id")))
    present = corpus.select("org_id", F.explode(F.array_distinct("tokens")).alias("token"))
    same = F.col("org_id").eqNullSafe(F.col("_id"))
    once = present.join(several, same, "left_anti").select("token")
    return once.unionByName(present.join(several, same, "left_semi").distinct().select("token"))


def learned_embedding(corpus: DataFrame, dim: int = 64, seed: int = 100) -> DataFrame:
    """(org_id, embedding): the strongest ``dim`` directions of the TF-IDF table, weighted and scaled to length 1.

    A corpus with fewer directions has zeros behind them, a document without tokens the zero vector.
    """
    documents = corpus.agg(F.count("*").alias("n_docs"))  # a single row
    counts = cut(corpus.select("org_id", F.explode("tokens").alias("token")).groupBy("org_id", "token").agg(F.count("*").alias("tf")))
    frequency = counts.groupBy("token").agg(F.count("*").alias("df"))
    idf = frequency.join(F.broadcast(documents)).select("token", (F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1).alias("idf"))
    cells = cut(counts.join(idf, "token").select("org_id", "token", ((1 + F.log("tf")) * F.col("idf")).alias("w")))
    norms = cells.groupBy("org_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    scaled = cells.join(norms, "org_id").select(F.col("org_id").alias("row"), F.col("token").alias("col"), (F.col("w") / F.col("norm")).alias("value"))
    rows, weights, _ = decompose(scaled, dim, seed=seed)
    strong = F.array(*[F.lit(float(w)) for w in weights]) if len(weights) else F.array().cast("array<double>")
    vector = F.zip_with("vector", strong, lambda v, w: v * w)
    length = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda total, v: total + v * v))
    unit = F.transform(vector, lambda v: F.coalesce(F.try_divide(v, length), F.lit(0.0)).cast("float"))
    filled = F.slice(F.concat(F.coalesce(unit, F.array().cast("array<float>")), F.array_repeat(F.lit(0.0).cast("float"), dim)), 1, dim)
    return corpus.select("org_id").join(rows.withColumnRenamed("row", "org_id"), "org_id", "left").select("org_id", filled.alias("embedding"))


def embed_with_model(
    descriptions: DataFrame,
    make_encoder: Callable[[], Callable[[np.ndarray], np.ndarray]],
    text: str = "description",
    batch_size: int = 64,
) -> DataFrame:
    """(org_id, embedding) from an encoder of the user's own, loaded once per worker."""
    encode = predict_batch_udf(make_encoder, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size)
    return descriptions.select("org_id", encode(text).alias("embedding"))


def length_report(
    descriptions: DataFrame, max_length: int, n_samples: int | None = 100_000, nrows: int | None = None, seed: int = 100
) -> tuple[DataFrame, DataFrame]:
    """(percent not truncated, cumulative histogram) of the token counts of a sample."""
    sample = descriptions if n_samples is None else sample_exact(descriptions, n_samples, "org_id", seed)
    lengths = first_rows(sample, ["org_id"], nrows).select(token_count("description").alias("length"))
    return percentile_rank(lengths, "length", max_length), cumulative_histogram(lengths, "length")


def subword_report(
    descriptions: DataFrame, pieces: DataFrame, max_length: int, n_samples: int | None = 100_000, nrows: int | None = None, seed: int = 100
) -> tuple[DataFrame, DataFrame]:
    """As :func:`length_report`, counting the sub-words of a vocabulary (piece) and the special tokens."""
    sample = descriptions if n_samples is None else sample_exact(descriptions, n_samples, "org_id", seed)
    counted = subword_counts(first_rows(sample, ["org_id"], nrows), pieces)
    lengths = cut(counted.select(F.col("n_tokens").cast("int").alias("length")))
    return percentile_rank(lengths, "length", max_length), cumulative_histogram(lengths, "length")


def sample_neighbours(
    embedded: DataFrame, n_samples: int = 100, nrows: int | None = None, normalise: bool = False, seed: int = 100
) -> DataFrame:
    """For sampled organisations and every model the nearest other organisation, with descriptions.

    ``embedded`` is (model_name, org_id, embedding, description). Models are compared by
    organisation id, whatever the order of their tables.
    """
    orgs = first_rows(embedded.groupBy("org_id").agg(F.min("description").alias("description")), ["org_id"], nrows)
    sampled = sample_exact(orgs, n_samples, "org_id", seed)
    index = embedded.join(orgs.select("org_id"), "org_id", "left_semi") if nrows else embedded
    asked = index.join(sampled.select("org_id"), "org_id", "left_semi")
    nearest = knn_join(asked, index, 1, by=["model_name"], normalise=normalise)
    return (
        nearest.join(sampled.withColumnRenamed("org_id", "query_id"), "query_id")
        .join(
            orgs.select(F.col("org_id").alias("neighbour_id"), F.col("description").alias("nn_description")),
            "neighbour_id",
        )
        .select(
            F.col("query_id").alias("org_id"), "description", "model_name",
            F.col("neighbour_id").alias("nn_id"), "nn_description", F.col("sim").alias("score"),
        )
    )
