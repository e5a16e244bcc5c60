"""Cleaning, dating and linking the records of company registers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sectorlens.functions.dates import day_first_date
from sectorlens.operators.ranking import latest_per_key


def register_organisations(df: DataFrame) -> DataFrame:
    """Company facts: text columns, dates from day-first strings, no ``uri``."""
    return df.withColumns(
        {
            **{c: F.col(c).cast("string") for c in ("company_number", "category", "status")},
            **{c: day_first_date(c) for c in ("dissolution_date", "incorporation_date")},
        }
    ).drop("uri")


def register_names(df: DataFrame) -> DataFrame:
    """Name history; a null ``invalid_date`` marks the current name."""
    return df.select(
        F.col("company_number").cast("string").alias("company_number"),
        F.col("name_age_index").cast("int").alias("name_age_index"),
        F.col("name").cast("string").alias("name"),
        day_first_date("invalid_date").alias("invalid_date"),
    )


def register_sectors(df: DataFrame) -> DataFrame:
    """Latest sector code per company and rank; an undated code counts as the latest."""
    latest = latest_per_key(df, ["company_number", "rank"], "date", nulls="first", tie=["sector_id"])
    return latest.select(
        F.col("company_number").cast("string").alias("company_number"),
        F.col("sector_id").cast("string").alias("sic5"),
        F.col("rank").cast("int").alias("rank"),
    )


def org_profiles(df: DataFrame) -> DataFrame:
    """Organisation name and website."""
    return df.select(
        F.col("org_id").cast("long").alias("org_id"),
        F.col("name").cast("string").alias("name"),
        F.col("website").cast("string").alias("website"),
    )


def org_addresses(links: DataFrame, addresses: DataFrame) -> DataFrame:
    """Latest address per organisation and rank."""
    joined = links.join(addresses, "address_id").drop("address_id")
    latest = latest_per_key(joined, ["org_id", "rank"], "date", tie=["address_text", "postcode"])
    return latest.select(
        "org_id",
        F.col("address_text").cast("string").alias("address_text"),
        F.col("postcode").cast("string").alias("postcode"),
        "rank",
    )


def org_sectors(links: DataFrame, sectors: DataFrame) -> DataFrame:
    """Latest sector name per organisation and rank."""
    joined = links.join(sectors, "sector_id").drop("sector_id")
    latest = latest_per_key(joined, ["org_id", "rank"], "date", tie=["sector_name"])
    return latest.select("org_id", F.col("sector_name").cast("string").alias("sector_name"), "rank")


def org_descriptions(df: DataFrame) -> DataFrame:
    """Latest description per organisation."""
    return latest_per_key(df, ["org_id"], "date", tie=["description"]).select("org_id", "description")


def validate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Return ``df``; raise when a key occurs more than once."""
    repeated = df.groupBy(*keys).count().where("count > 1").limit(1).collect()
    if repeated:
        raise ValueError(f"key {list(keys)} is not unique, for example {repeated[0].asDict()}")
    return df


def accept_matches(matches: DataFrame, threshold: float = 80, persisted_at: float = 50) -> DataFrame:
    """Organisation to company, for matches scoring at least ``threshold``."""
    if threshold < persisted_at:
        raise ValueError(f"threshold {threshold} is below {persisted_at}, where matches were dropped")
    return matches.where(F.col("sim_mean") >= threshold).select("org_id", "company_number")


def company_to_org(matches: DataFrame, order_col: str = "org_id") -> DataFrame:
    """Invert organisation to company; of several organisations the last by ``order_col`` stays."""
    return matches.groupBy("company_number").agg(F.max_by("org_id", order_col).alias("org_id"))


def sic4_of_orgs(sectors: DataFrame, matches: DataFrame) -> DataFrame:
    """First-ranked sector of each matched organisation, cut to four digits."""
    first = sectors.where("rank = 1").select(
        "company_number", F.expr("left(sic5, greatest(length(sic5) - 1, 0))").alias("sic4")
    )
    return (
        first.join(company_to_org(matches), "company_number")
        .dropna(subset=["org_id"])
        .select("org_id", "sic4")
    )
