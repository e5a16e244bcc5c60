"""Legal forms learned from a register: words that end names far more often than they stand elsewhere.

A word's places are compared with those of all words by the log-likelihood ratio (Dunning 1993). A
word that ends many names, is rarely elsewhere and passes the ratio is a form. Forms are taken from
the end of a name, one after the other, as long as a word remains. As a form ends at least the stated
share of all names, there are at most one over that share of them per round.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sectorlens.session import cut

LEAST_SHARE = 0.005  # of the names with two words or more
LEAST_LAST = 0.8  # of a form's places
LEAST_RATIO = 10.83  # the ratio that chance exceeds once in a thousand
ROUNDS = 2


def name_words(name: str | Column) -> Column:
    """Lower-case words of a name, punctuation as blanks."""
    text = F.col(name) if isinstance(name, str) else name
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.filter(F.split(plain, " "), lambda w: w != "")


def _part(k: Column, row: Column, column: Column, total: Column) -> Column:
    return F.when(k > 0, k * F.log(k * total / (row * column))).otherwise(0.0)


def place_ratios(words: DataFrame) -> DataFrame:
    """``(word, n_last, n_other, names, ratio)`` of every word in names (words) of two words or more.

    The ratio is negative where a word ends names less often than words do.
    """
    names = words.where(F.size("words") > 1)
    placed = names.select(F.size("words").alias("size"), F.posexplode("words").alias("at", "word")).withColumn("last", F.col("at") == F.col("size") - 1)
    counts = placed.groupBy("word").agg(F.count_if("last").alias("n_last"), F.count_if(~F.col("last")).alias("n_other"))
    totals = names.agg(F.count("*").cast("double").alias("names"), F.sum(F.size("words") - 1).cast("double").alias("others"))  # a single row
    a, b = F.col("n_last").cast("double"), F.col("n_other").cast("double")
    c, d = F.col("names") - a, F.col("others") - b
    total = F.col("names") + F.col("others")
    cells = ((a, a + b, F.col("names")), (b, a + b, F.col("others")), (c, c + d, F.col("names")), (d, c + d, F.col("others")))
    ratio = 2 * reduce(Column.__add__, [_part(k, row, column, total) for k, row, column in cells])
    signed = F.when(a * F.col("others") >= b * F.col("names"), ratio).otherwise(-ratio)
    return counts.join(F.broadcast(totals)).select("word", "n_last", "n_other", "names", F.round(signed, 6).alias("ratio"))


def accepted_forms(ratios: DataFrame, least_share: float = LEAST_SHARE, least_last: float = LEAST_LAST, least_ratio: float = LEAST_RATIO) -> DataFrame:
    """``(word, n_last, n_other, ratio)`` of the words that count as legal forms."""
    often = (F.col("n_last") >= F.lit(least_share) * F.col("names")) & (F.col("n_last") > 1)
    at_end = F.col("n_last") >= F.lit(least_last) * (F.col("n_last") + F.col("n_other"))
    return ratios.where(often & at_end & (F.col("ratio") >= least_ratio)).select("word", "n_last", "n_other", "ratio")


def strip_forms(words: DataFrame, forms: DataFrame) -> DataFrame:
    """The rows with forms taken from the end of ``words``; names that consist of forms stay whole."""
    known = forms.agg(F.collect_set("word").alias("_forms"))  # at most one over the least share of them, twice
    place = F.transform("words", lambda w, i: F.when(~F.array_contains("_forms", w), i + 1))
    last = F.array_max(place)
    kept = F.when(last.isNull(), F.col("words")).otherwise(F.slice("words", 1, last))
    return words.join(F.broadcast(known)).withColumn("words", kept).drop("_forms")


def learn_forms(names: DataFrame, name: str = "name", rounds: int = ROUNDS, least_share: float = LEAST_SHARE) -> DataFrame:
    """``(word)``: the forms of a register; later rounds find those that stand before other forms."""
    words = cut(names.select(name_words(name).alias("words")))
    found = None
    for _ in range(rounds):
        left = words if found is None else strip_forms(words, found)
        new = accepted_forms(place_ratios(left), least_share).select("word")
        found = cut(new if found is None else found.union(new).distinct())
    return found


def clean_names(names: DataFrame, forms: DataFrame, name: str = "name") -> DataFrame:
    """The rows with ``name`` in lower case, without punctuation and trailing legal forms."""
    stripped = strip_forms(names.withColumn("words", name_words(name)), forms)
    return stripped.withColumn(name, F.array_join("words", " ")).drop("words")
