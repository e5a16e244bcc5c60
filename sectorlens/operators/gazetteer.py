"""Names of a gazetteer in tokenised texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mark_names(corpus: DataFrame, names: DataFrame) -> DataFrame:
    """(org_id, tokens): every name in the tokens replaced by its kind.

    ``names`` is (tokens, kind), the names tokenised like the corpus; of a name with several kinds
    the first counts. Of names that overlap the first in the text wins, of those that start
    together the longest. Names of any length are searched, by the widths that occur among them.
    """
    known = (
        names.where(F.size("tokens") > 0)
        .groupBy(F.array_join("tokens", " ").alias("name")).agg(F.min("kind").alias("kind"))
    )
    widths = names.where(F.size("tokens") > 0).agg(F.collect_set(F.size("tokens")).alias("widths"))
    spans = corpus.crossJoin(F.broadcast(widths)).select(
        "org_id", "tokens", F.explode(F.filter("widths", lambda w: w <= F.size("tokens"))).alias("width")
    ).select(
        "org_id", "width",
        F.posexplode(F.transform(
            F.sequence(F.lit(1), F.size("tokens") - F.col("width") + 1),
            lambda i: F.array_join(F.slice("tokens", i, F.col("width")), " "),
        )).alias("start", "name"),
    )
    found = spans.join(known, "name").groupBy("org_id").agg(
        F.array_sort(F.collect_list(F.struct("start", (-F.col("width")).alias("order"), "width", "kind"))).alias("found")
    )
    # Walk over the hits from left to right; one that starts inside the last taken one is skipped.
    taken = F.aggregate(
        "found",
        F.expr("struct(0 as stop, cast(array() as array<struct<start:int,order:int,width:int,kind:string>>) as hits)"),
        lambda state, hit: F.when(hit["start"] < state["stop"], state).otherwise(
            F.struct((hit["start"] + hit["width"]).alias("stop"), F.concat(state["hits"], F.array(hit)).alias("hits"))
        ),
        lambda state: state["hits"],
    )
    pieces = F.expr(
        "flatten(transform(sequence(0, size(hits)), i -> concat("
        "  slice(tokens, if(i = 0, 0, hits[i - 1].start + hits[i - 1].width) + 1,"
        "        if(i = size(hits), size(tokens), hits[i].start) - if(i = 0, 0, hits[i - 1].start + hits[i - 1].width)),"
        "  if(i = size(hits), cast(array() as array<string>), array(hits[i].kind)))))"
    )
    joined = corpus.select("org_id", "tokens").join(found.select("org_id", taken.alias("hits")), "org_id", "left")
    return joined.select("org_id", F.when(F.col("hits").isNull(), F.col("tokens")).otherwise(pieces).alias("tokens"))
