"""Text cleaning and tokens as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from html.entities import name2codepoint
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Named character references: the standard's names, and a plain blank for the fixed one.
REFERENCES = {name: chr(code) for name, code in sorted(name2codepoint.items())} | {"apos": "'", "nbsp": " "}

# What is cut from HTML, in this order. Only whole tags match.
HTML_PATTERNS = (
    r"(?s)<!--.*?-->",
    r"(?is)<script\b[^>]*>.*?</script\s*>",
    r"(?is)<style\b[^>]*>.*?</style\s*>",
    r"</?[A-Za-z!][^<>]*>",
)

# Entity types and the placeholder put in their place.
ENTITY_TYPES = (
    "CARDINAL", "DATE", "GPE", "LOC", "MONEY", "NORP",
    "ORDINAL", "ORG", "PERCENT", "PERSON", "QUANTITY", "TIME",
)

# Months and units in the patterns below.
MONTHS = "january|february|march|april|may|june|july|august|september|october|november|december"
UNITS = "kg|km|cm|mm|tonnes|tons|miles|metres|litres|acres|hectares|mw|kw|gb|tb"

# Patterns of entity types on lower-case text, tried in this order.
ENTITY_PATTERNS = (
    ("MONEY", r"[$£€]\s?[0-9][0-9.,]*(?:\s?(?:million|billion|thousand|m|bn|k)\b)?"),
    ("PERCENT", r"[0-9][0-9.,]*\s?(?:%|percent\b|per cent\b)"),
    ("DATE", rf"\b(?:[0-9]{{1,2}}\s)?(?:{MONTHS})\s[0-9]{{4}}\b|\b[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{2,4}}\b|\b(?:19|20)[0-9]{{2}}\b"),
    ("TIME", r"\b[0-9]{1,2}:[0-9]{2}(?:\s?[ap]m)?\b|\b[0-9]{1,2}\s?[ap]m\b"),
    ("ORDINAL", r"\b[0-9]+(?:st|nd|rd|th)\b"),
    ("QUANTITY", rf"\b[0-9][0-9.,]*\s?(?:{UNITS})\b"),
    ("CARDINAL", r"\b[0-9][0-9.,]*\b"),
)

# Number words, replaced token by token.
NUMBER_WORDS = {
    "CARDINAL": ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten"),
    "ORDINAL": ("first", "second", "third"),
}

# Placeholder codes whose tokens are dropped before clustering.
STRIPPED_CODES = (
    "CARDINAL", "DATE", "GPE", "LOC", "MONEY", "NORP", "ORDINAL", "ORG", "PERSON", "QUANTITY", "TIME",
)

# English function words.
STOP_WORDS = (
    "a", "about", "after", "all", "also", "an", "and", "any", "are", "as", "at", "be", "been", "before",
    "being", "between", "both", "but", "by", "can", "could", "did", "do", "does", "each", "every", "for",
    "from", "had", "has", "have", "he", "her", "here", "him", "his", "how", "i", "if", "in", "into", "is",
    "it", "its", "just", "may", "me", "more", "most", "must", "my", "no", "nor", "not", "of", "off", "on",
    "only", "or", "other", "our", "out", "over", "own", "same", "she", "should", "so", "some", "such",
    "than", "that", "the", "their", "them", "then", "there", "these", "they", "this", "those", "through",
    "to", "too", "under", "until", "up", "us", "very", "was", "we", "were", "what", "when", "where",
    "which", "while", "who", "whom", "why", "will", "with", "would", "you", "your",
)

# Plural endings that lose "es", and endings whose "s" stays.
ES_ENDINGS = ("sses", "shes", "ches", "xes", "zes")
KEPT_ENDINGS = ("ss", "us", "is")

TOKEN_PATTERN = r"\p{L}+"
LENGTH_PATTERN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"


def _column(column: str | Column) -> Column:
    return F.col(column) if isinstance(column, str) else column


DECIMAL, HEX, NAMED = r"^#([0-9]{1,7});", r"^#[xX]([0-9A-Fa-f]{1,6});", r"^([A-Za-z][A-Za-z0-9]{1,9});"


def decode_references(column: str | Column) -> Column:
    """Replace decimal, hexadecimal and named character references by their characters, once each."""
    # The text is cut before each `&`; a part that starts with a reference has it replaced.
    parts = F.split(_column(column), "&")
    names = F.create_map(*[F.lit(x) for pair in REFERENCES.items() for x in pair])

    def decoded(part: Column) -> Column:
        decimal, hexadecimal = F.regexp_extract(part, DECIMAL, 1), F.regexp_extract(part, HEX, 1)
        value = F.when(decimal != "", decimal.try_cast("int")).when(hexadecimal != "", F.conv(hexadecimal, 16, 10).try_cast("int"))
        valid = value.between(1, 0x10FFFF) & ~value.between(0xD800, 0xDFFF)
        numbered = F.when(valid, F.decode(F.unhex(F.lpad(F.hex(value), 8, "0")), "UTF-32"))
        character = F.coalesce(numbered, F.try_element_at(names, F.regexp_extract(part, NAMED, 1)))
        rest = F.substring(part, F.instr(part, ";") + 1, F.length(part))
        return F.coalesce(F.concat(character, rest), F.concat(F.lit("&"), part))

    tail = F.transform(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), decoded)
    return F.concat(F.element_at(parts, 1), F.array_join(tail, ""))


def strip_html(column: str | Column) -> Column:
    """Text without comments, scripts, styles and tags, references decoded; partial tags stay.

    Most texts hold no markup; the checks spare them the patterns.
    """
    raw = _column(column)
    text = raw
    for pattern in HTML_PATTERNS:
        text = F.regexp_replace(text, pattern, "")
    text = F.when(raw.contains("<"), text).otherwise(raw)
    return F.when(raw.contains("&"), decode_references(text)).otherwise(text)


def mark_entities(column: str | Column, mappings: Mapping[str, str] | None = None) -> Column:
    """Lower-case text with amounts, dates and numbers replaced by the words in ``mappings``.

    Without mappings a type is replaced by its own name; types left out of them stay as text.
    Every pattern needs a digit, so texts without one are not searched.
    """
    mappings = _mappings(mappings)
    plain = F.lower(_column(column))
    text = plain
    for kind, pattern in ENTITY_PATTERNS:
        if kind in mappings:
            text = F.regexp_replace(text, pattern, f" {mappings[kind]} ")
    return F.when(plain.rlike("[0-9]"), text).otherwise(plain)


def _mappings(mappings: Mapping[str, str] | None) -> Mapping[str, str]:
    return {t: t for t in ENTITY_TYPES} if mappings is None else mappings


def lemma(token: Column) -> Column:
    """Singular form of a lower-case token by its ending; other tokens stay."""
    length = F.length(token)

    def ends(*endings: str) -> Column:
        return reduce(or_, [token.endswith(e) for e in endings])

    return (
        F.when(~token.endswith("s") | (length < 4), token)
        .when(token.endswith("ies") & (length > 4), F.concat(F.left(token, length - 3), F.lit("y")))
        .when(ends(*ES_ENDINGS) & (length > 4), F.left(token, length - 2))
        .when(ends(*KEPT_ENDINGS), token)
        .otherwise(F.left(token, length - 1))
    )


def tokenize(
    column: str | Column,
    mappings: Mapping[str, str] | None = None,
    stop_words: Sequence[str] = STOP_WORDS,
) -> Column:
    """Lemmas in text order, stop words and punctuation left out, entities as placeholders."""
    words = F.regexp_extract_all(mark_entities(column, mappings), F.lit(TOKEN_PATTERN), F.lit(0))
    mappings = _mappings(mappings)

    def normal(word: Column) -> Column:
        result = lemma(word)
        for kind, number_words in NUMBER_WORDS.items():
            if kind in mappings:
                result = F.when(word.isin(*number_words), mappings[kind]).otherwise(result)
        return result

    return F.transform(F.filter(words, lambda w: ~w.isin(*stop_words)), normal)


def strip_placeholders(tokens: str | Column, codes: Sequence[str] = STRIPPED_CODES) -> Column:
    """Tokens that contain none of the codes, anywhere in the token."""
    return F.filter(_column(tokens), lambda t: ~t.rlike("|".join(codes)))


def filter_tokens(tokens: str | Column, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    """Tokens of three characters or more that are no stop word and no pair of stop words."""

    def kept(token: Column) -> Column:
        halves = F.split(token, "_")
        stop_pair = (F.size(halves) == 2) & halves[0].isin(*stop_words) & F.get(halves, F.lit(1)).isin(*stop_words)
        return (F.length(token) > 2) & ~token.isin(*stop_words) & ~F.coalesce(stop_pair, F.lit(False))

    return F.filter(_column(tokens), kept)


def token_count(column: str | Column) -> Column:
    """Number of word and punctuation tokens of a text."""
    return F.size(F.regexp_extract_all(_column(column), F.lit(LENGTH_PATTERN), F.lit(0)))
