"""Sub-word tokens: words cut into the longest pieces of a given vocabulary, from the left.

The vocabulary is a table (piece); a piece that continues a word begins with ``##``. Each distinct
word is cut once: its parts are joined to the pieces, the longest piece of each place is kept, and a
fold goes from piece to piece. A word with a place that no piece fits, or of more than `LONGEST_WORD`
characters, is one unknown token. Texts are joined to the words they hold, not to the vocabulary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sectorlens.operators.joins import spread_join
from sectorlens.session import cut

# The marks of a sub-word vocabulary and the length from which words are unknown.
CONTINUES, UNKNOWN, LONGEST_WORD = "##", "[UNK]", 100
SPECIAL = 2  # tokens around each text
WORD_PATTERN = r"[\p{L}\p{N}\p{M}_]+|[^\p{L}\p{N}\p{M}_\s]"
HOT = 100_000


def split_words(text: str | Column) -> Column:
    """Lower-case words; every punctuation mark is a word."""
    column = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(F.coalesce(column, F.lit(""))), F.lit(WORD_PATTERN), F.lit(0))


def segment_words(words: DataFrame, pieces: DataFrame) -> DataFrame:
    """``(word, pieces)``: the pieces of each distinct word, or the unknown token alone."""
    known = pieces.where("piece <> ''").select("piece").distinct()
    continues = F.startswith("piece", F.lit(CONTINUES)) & (F.length("piece") > len(CONTINUES))
    known = known.select(
        F.when(continues, F.substring("piece", len(CONTINUES) + 1, 1_000_000)).otherwise(F.col("piece")).alias("part"), continues.alias("inner")
    )
    widest = F.broadcast(known.agg(F.coalesce(F.max(F.length("part")), F.lit(0)).alias("widest")))  # a single row
    distinct = cut(words.where("word <> ''").select("word").distinct())
    short = distinct.where(F.length("word") <= LONGEST_WORD)
    parts = (
        short.join(widest)
        .select("word", "widest", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("start"))
        .select("word", "start", F.explode(F.sequence(F.lit(1), F.least("widest", F.length("word") - F.col("start") + 1))).alias("width"))
        .select("word", "start", "width", F.substring("word", F.col("start"), F.col("width")).alias("part"), (F.col("start") > 1).alias("inner"))
        .where("width > 0")
    )
    longest = parts.join(known, ["part", "inner"]).groupBy("word", "start").agg(F.max("width").alias("width"))
    ways = longest.groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("start", "width"))).alias("ways"))  # a word's places

    def step(state: Column, start: Column) -> Column:
        width = F.try_element_at("ways", start)
        own = F.substring("word", start, width)
        named = F.when(start > 1, F.concat(F.lit(CONTINUES), own)).otherwise(own)
        taken = F.struct((start + width).alias("next"), F.concat(state["pieces"], F.array(named)).alias("pieces"))
        return F.when((start == state["next"]) & width.isNotNull(), taken).otherwise(state)

    begin = F.struct(F.lit(1).alias("next"), F.array().cast("array<string>").alias("pieces"))
    walked = F.aggregate(F.sequence(F.lit(1), F.length("word")), begin, step)
    found = distinct.join(ways, "word", "left").withColumn("walk", F.when(F.col("ways").isNotNull(), walked))
    whole = F.col("walk.next") == F.length("word") + 1
    return found.select("word", F.when(whole, F.col("walk.pieces")).otherwise(F.array(F.lit(UNKNOWN))).alias("pieces"))


def subword_counts(
    texts: DataFrame, pieces: DataFrame, key: str = "org_id", text: str = "description", special: int = SPECIAL,
    max_length: int | None = None,
) -> DataFrame:
    """``(key, n_tokens, n_kept)``: the sub-words and special tokens of each text, and how many truncation keeps.

    A text without words has the special tokens only. Repeated keys are added up.
    """
    counts = texts.select(key, F.explode(split_words(text)).alias("word")).groupBy(key, "word").agg(F.count("*").alias("times"))
    counts = cut(counts)
    sizes = segment_words(counts.select("word"), pieces).select("word", F.size("pieces").alias("size"))
    # A common word is in most texts, so its rows are dealt over tasks.
    sums = spread_join(counts, sizes, ["word"], key, HOT).groupBy(key).agg(F.sum(F.col("times") * F.col("size")).alias("n"))
    total = (F.coalesce("n", F.lit(0)) + special).cast("long")
    kept = F.least(total, F.lit(max_length).cast("long")) if max_length is not None else total
    return texts.select(key).distinct().join(sums, key, "left").select(key, total.alias("n_tokens"), kept.alias("n_kept"))
