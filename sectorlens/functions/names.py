"""Name cleaning and name similarity expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Legal forms dropped from company names.
LEGAL_FORMS = (
    "limited", "ltd", "plc", "llp", "llc", "lp", "inc", "incorporated", "corp", "corporation",
    "company", "co", "cic", "gmbh", "ag", "sa", "bv", "nv", "holdings", "group",
)

# Modulus of the min-hash permutations, and the bases of their coefficients.
PRIME = 2**31 - 1
MULTIPLIER_BASE = 48271
OFFSET_BASE = 16807


def permutations(n: int) -> list[tuple[int, int]]:
    """Coefficients (a, b) of ``n`` permutations ``(a * h + b) % PRIME``."""
    return [(pow(MULTIPLIER_BASE, i, PRIME), pow(OFFSET_BASE, i, PRIME)) for i in range(1, n + 1)]


def clean_name(column: str | Column) -> Column:
    """Lower case, punctuation as blanks, no legal forms, single blanks."""
    text = F.col(column) if isinstance(column, str) else column
    words = F.split(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), " ")
    kept = F.filter(words, lambda w: ~w.isin(*LEGAL_FORMS))
    return F.array_join(F.when(F.size(kept) > 0, kept).otherwise(words), " ")


def shingles(name: str, k: int = 3) -> Column:
    """Distinct substrings of length ``k``; a shorter name is its own shingle."""
    return F.expr(
        f"array_distinct(transform(sequence(1, greatest(length({name}) - {k - 1}, 1)), "
        f"i -> substring({name}, i, {k})))"
    )


def minhashes(shingle_set: Column, n: int) -> Column:
    """Minimum of the shingle hashes under each of ``n`` permutations."""
    seeds = F.array(*[F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for a, b in permutations(n)])
    hashes = F.transform(shingle_set, lambda s: F.conv(F.substring(F.md5(s), 1, 8), 16, 10).cast("long") % PRIME)
    # Folding over the hashes keeps each shingle's hash from being computed once per permutation.
    return F.aggregate(
        hashes,
        F.array_repeat(F.lit(PRIME).cast("long"), n),
        lambda low, h: F.zip_with(low, seeds, lambda m, s: F.least(m, (h * s.a + s.b) % PRIME)),
    )


def jaccard_score(left: Column, right: Column) -> Column:
    """Shared share of two shingle sets, 0 to 100."""
    return 100.0 * F.size(F.array_intersect(left, right)) / F.size(F.array_union(left, right))


def levenshtein_score(left: str, right: str) -> Column:
    """100 for equal names, 0 when every position has to change."""
    longest = F.greatest(F.length(left), F.length(right))
    return F.when(longest == 0, 100.0).otherwise(100.0 * (1 - F.try_divide(F.levenshtein(left, right), longest)))
