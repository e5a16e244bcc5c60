"""Text of HTML that is not well formed.

One pattern reads a text from left to right, as a browser would: a comment or tag begins where the
one before has ended, so markup inside comments, quoted attribute values and raw text is no markup.
What isn't closed runs to the end of the text. A `<` that begins no markup, and parts of tags without
their `<`, stay.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sectorlens.functions.text import decode_references

# Elements whose content is no text, and those whose content is text without tags.
RAW, PLAIN = ("script", "style"), ("textarea", "title")


def lexer(repeat: str = "*+") -> str:
    """The pattern; no repetition is ever taken back, so with possessive ones tags of any length match in a loop."""
    # Attributes up to the tag's end; a `>` in quotes doesn't end it.
    inside = rf"""(?:[^'">]+|"[^"]*(?:"|\z)|'[^']*(?:'|\z)){repeat}"""
    rest = rf"(?:[\s/]{inside})?(?:>|\z)"
    return "(?is)" + "|".join(
        [
            r"<!--.*?(?:-->|\z)",
            *[rf"<{name}{rest}.*?(?:</{name}\s*>|\z)" for name in RAW],
            *[rf"<{name}{rest}(.*?)(?:</{name}\s*>|\z)" for name in PLAIN],
            rf"</?[a-z]{inside}(?:>|\z)",
            r"<[!?][^>]*(?:>|\z)",
        ]
    )


def strip_markup(column: str | Column) -> Column:
    """The text without markup, references decoded; content of titles and text areas stays as it is written."""
    raw = F.col(column) if isinstance(column, str) else column
    text = F.when(raw.contains("<"), F.regexp_replace(raw, F.lit(lexer()), F.lit("$1$2"))).otherwise(raw)
    return F.when(raw.contains("&"), decode_references(text)).otherwise(text)
