"""Token corpora per sector."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sectorlens.functions.text import strip_placeholders


def matched_only(df: DataFrame, matched: DataFrame, key: str = "org_id") -> DataFrame:
    """Rows of matched organisations."""
    return df.join(matched.select(key), key, "left_semi")


def big_sectors(sic4: DataFrame, min_sector_size: int = 1000) -> DataFrame:
    """(sector, n) of the sectors with more than ``min_sector_size`` matched organisations."""
    sizes = sic4.groupBy(F.col("sic4").alias("sector")).agg(F.count("*").alias("n"))
    return sizes.where(F.col("n") > min_sector_size)


def tokens_by_sector(tokens: DataFrame, sic4: DataFrame, sectors: DataFrame) -> DataFrame:
    """(sector, org_id, tokens) of the organisations in the given sectors."""
    members = sic4.select("org_id", F.col("sic4").alias("sector")).join(sectors.select("sector"), "sector", "left_semi")
    return tokens.join(members, "org_id").select("sector", "org_id", "tokens")


def sector_corpora(sic4: DataFrame, tokens: DataFrame, min_sector_size: int = 1000) -> DataFrame:
    """Placeholder-free tokens of matched organisations in big sectors."""
    stripped = tokens.withColumn("tokens", strip_placeholders("tokens"))
    return tokens_by_sector(matched_only(stripped, sic4), sic4, big_sectors(sic4, min_sector_size))


def first_sectors(corpora: DataFrame, n: int = 2) -> DataFrame:
    """The corpora of the first ``n`` sectors, for trial runs."""
    return corpora.join(corpora.select("sector").distinct().orderBy("sector").limit(n), "sector", "left_semi")
