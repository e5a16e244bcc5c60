"""Lemmas from the corpus itself: which endings replace which, learned from stems that occur with both.

A rule (suffix, replacement) maps a word to a base form: ``ies`` to ``y``, ``ing`` to nothing or
``e``. Its support are the stems that occur with both endings, its share the part of the words with
the suffix whose base form occurs too. A word takes the rule with the longest suffix whose base form
is in the vocabulary; words that no rule fits stay. Only distinct words meet rules; texts are joined
to their words. Replacements have at most one letter, so a stem meets few base forms.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sectorlens.operators.joins import spread_join
from sectorlens.operators.phrases import SENT_BYTES, by_repetition, flat, in_parts, places
from sectorlens.session import cut

LEAST_STEM, LONGEST_SUFFIX = 3, 4
LEAST_SUPPORT, LEAST_SHARE = 8, 0.15
HOT = 100_000


def vocabulary(corpus: DataFrame, tokens: str = "tokens") -> DataFrame:
    """``(word, n)``: the distinct words that consist of lower-case letters, with their occurrences."""
    words = corpus.select(F.explode(tokens).alias("word")).where(F.col("word").rlike(r"^\p{L}+$") & (F.lower("word") == F.col("word")))
    return words.groupBy("word").agg(F.count("*").alias("n"))


def _splits(words: DataFrame) -> DataFrame:
    """``(word, stem, suffix)`` for every suffix that leaves a stem."""
    size = F.length("word")
    lengths = F.sequence(F.lit(1), F.least(F.lit(LONGEST_SUFFIX), size - LEAST_STEM))
    each = words.where(size > LEAST_STEM).select("word", F.explode(lengths).alias("k"))
    return each.select("word", F.left("word", F.length("word") - F.col("k")).alias("stem"), F.right("word", F.col("k")).alias("suffix"))


def _bases(words: DataFrame) -> DataFrame:
    """``(stem, replacement, base)``: every word as a stem with nothing or its last letter replaced."""
    size = F.length("word")
    whole = words.where(size >= LEAST_STEM).select(F.col("word").alias("stem"), F.lit("").alias("replacement"), F.col("word").alias("base"))
    short = words.where(size > LEAST_STEM).select(F.left("word", size - 1).alias("stem"), F.right("word", F.lit(1)).alias("replacement"), F.col("word").alias("base"))
    return whole.unionByName(short)


def _differ(suffix: Column, replacement: Column) -> Column:
    """The two begin with different letters; else a longer stem says the same."""
    return F.left(suffix, F.lit(1)) != replacement


def suffix_rules(words: DataFrame, least_support: int = LEAST_SUPPORT, least_share: float = LEAST_SHARE) -> DataFrame:
    """``(suffix, replacement, support, share)`` of the accepted rules."""
    splits = _splits(words.select("word"))
    met = splits.join(_bases(words.select("word")), "stem").where(_differ(F.col("suffix"), F.col("replacement")))
    support = met.groupBy("suffix", "replacement").agg(F.count("*").alias("support"))
    frequency = splits.groupBy("suffix").agg(F.count("*").alias("words"))
    rules = support.join(frequency, "suffix").withColumn("share", F.round(F.col("support") / F.col("words"), 9))
    return rules.where((F.col("support") >= least_support) & (F.col("share") >= least_share)).select("suffix", "replacement", "support", "share")


def lemma_of(words: DataFrame, rules: DataFrame) -> DataFrame:
    """``(word, lemma)``: one application of the rules to each distinct word.

    The longest suffix goes first, then the rule with more support, then the base form by name.
    """
    distinct = cut(words.select("word").distinct())
    hits = _splits(distinct).join(rules, "suffix").join(_bases(distinct), ["stem", "replacement"])
    order = F.struct((-F.length("suffix")).alias("k"), (-F.col("support")).alias("s"), F.col("base").alias("base"))
    best = hits.groupBy("word").agg(F.min(order)["base"].alias("base"))
    return distinct.join(best, "word", "left").select("word", F.coalesce("base", "word").alias("lemma"))


def lemma_table(words: DataFrame, rules: DataFrame, passes: int = 2) -> DataFrame:
    """``(word, lemma)`` after several applications, so that ``workings`` joins ``working`` and ``work``."""
    once = cut(lemma_of(words, rules))
    table = once
    for _ in range(passes - 1):
        step = once.select(F.col("word").alias("lemma"), F.col("lemma").alias("_next"))
        table = table.join(step, "lemma").select("word", F.col("_next").alias("lemma"))
    return table


def lemmatise(corpus: DataFrame, lemmas: DataFrame, key: str = "org_id", tokens: str = "tokens") -> DataFrame:
    """``(key, tokens)`` with every token replaced by its lemma; tokens without one stay.

    Words with another lemma go to the tasks, up to a bound, so that texts don't move; beyond it, and
    for keys that repeat or are null, tokens are joined to them.
    """
    changed = cut(lemmas.where("word <> lemma").select("word", "lemma"))
    size, n, words = changed.agg(F.sum(F.octet_length("word") + F.octet_length("lemma") + 8), F.count("*"), F.countDistinct("word")).first()
    if (size or 0) > SENT_BYTES or n != words:
        return _lemmatised_by_join(corpus, changed, key, tokens)
    table = changed.toArrow()
    word, lemma = (table.column(c).combine_chunks().cast(pa.string()) for c in ("word", "lemma"))
    once, others = by_repetition(corpus, key, tokens)

    def rows(batches):
        for batch in in_parts(batches, tokens):
            column = batch.column(tokens)
            values, lengths = flat(column)
            found = places(values, word)
            ends = pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32), mask=np.r_[column.is_null().to_numpy(zero_copy_only=False), False])
            lists = pa.ListArray.from_arrays(ends, pc.coalesce(lemma.take(pa.array(found, mask=found < 0)), values))
            yield pa.RecordBatch.from_arrays([batch.column(key), lists], [key, "tokens"])

    schema = T.StructType([once.schema[key], T.StructField("tokens", once.schema[tokens].dataType)])
    replaced = once.mapInArrow(rows, schema)
    return replaced if others is None else replaced.unionByName(_lemmatised_by_join(others, changed, key, tokens))


def _lemmatised_by_join(corpus: DataFrame, changed: DataFrame, key: str, tokens: str) -> DataFrame:
    each = cut(corpus.select(key, F.posexplode(tokens).alias("_at", "word")).withColumn("_row", F.struct(key, "_at")))
    met = spread_join(each, changed, ["word"], "_row", HOT)
    per_row = met.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_at", "lemma"))).alias("_found"))  # a text's tokens
    joined = corpus.select(key, F.col(tokens).alias("tokens")).join(per_row, key, "left")
    placed = joined.withColumn("_new", F.filter("_found", lambda n: n["_at"] < F.size("tokens")))
    # Tokens between two changed ones are copied as slices, so a text costs one pass.
    pieces = F.expr(
        "flatten(transform(sequence(0, size(_new)), i -> concat("
        "  slice(tokens, if(i = 0, 0, _new[i - 1]._at + 1) + 1,"
        "        if(i = size(_new), size(tokens), _new[i]._at) - if(i = 0, 0, _new[i - 1]._at + 1)),"
        "  if(i = size(_new), cast(array() as array<string>), array(_new[i].lemma))"
        ")))"
    )
    return placed.select(key, F.when(F.col("_new").isNull(), F.col("tokens")).otherwise(pieces).alias("tokens"))
