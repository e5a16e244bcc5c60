"""Company descriptions to n-gram tokens."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from sectorlens.operators.corpus import matched_only
from sectorlens.operators.gazetteer import mark_names
from sectorlens.functions.text import STOP_WORDS, filter_tokens, strip_html, tokenize
from sectorlens.operators.phrases import filter_frequency, ngrams
from sectorlens.session import cut


def tokenized(
    descriptions: DataFrame,
    text: str = "description",
    mappings: Mapping[str, str] | None = None,
    stop_words: Sequence[str] = STOP_WORDS,
    gazetteer: DataFrame | None = None,
) -> DataFrame:
    """(org_id, tokens) of the descriptions; names of the gazetteer (name, kind) become their kind."""
    tokens = descriptions.select("org_id", tokenize(strip_html(text), mappings, stop_words).alias("tokens"))
    if gazetteer is None:
        return tokens
    return mark_names(tokens, gazetteer.select(tokenize("name", mappings, stop_words).alias("tokens"), "kind"))


def ngram_tokens(
    corpus: DataFrame,
    n: int = 2,
    stop_words: Sequence[str] = STOP_WORDS,
    no_below: int = 10,
    no_above: float = 0.9,
    keep_n: int | None = None,
) -> DataFrame:
    """Rare tokens out, n-grams joined, weak tokens out, rare and ubiquitous n-grams out."""
    common = cut(filter_frequency(corpus, no_below=no_below, no_above=1.0, keep_n=keep_n))
    joined = ngrams(common, n)
    useful = joined.withColumn("tokens", filter_tokens("tokens", stop_words))
    return filter_frequency(cut(useful), no_below=no_below, no_above=no_above, keep_n=keep_n)


def description_tokens(
    descriptions: DataFrame,
    n: int = 2,
    text: str = "description",
    mappings: Mapping[str, str] | None = None,
    stop_words: Sequence[str] = STOP_WORDS,
    keep_n: int | None = None,
    matched: DataFrame | None = None,
    gazetteer: DataFrame | None = None,
) -> DataFrame:
    """(org_id, tokens) of every description; a description without tokens keeps an empty list.

    With ``matched`` only descriptions of matched organisations are tokenised.
    """
    if matched is not None:
        descriptions = matched_only(descriptions, matched)
    corpus = cut(tokenized(descriptions, text, mappings, stop_words, gazetteer))
    return ngram_tokens(corpus, n, stop_words, keep_n=keep_n)
