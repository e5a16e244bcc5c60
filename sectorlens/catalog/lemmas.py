"""Lemmas learned from the documents' own words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sectorlens.catalog.registry import Tables, query
from sectorlens.functions.text import TOKEN_PATTERN
from sectorlens.operators import lemmas as lm
from sectorlens.session import cut

S, K = lm.LEAST_STEM, lm.LONGEST_SUFFIX

RULES = f"""spoken as (select doc_id as org_id, regexp_extract_all(lower(text), '{TOKEN_PATTERN}') as tokens from documents),
words as (select distinct word from (select unnest(tokens) as word from spoken) where regexp_matches(word, '^\\p{{L}}+$') and lower(word) = word),
splits as (
  select word, left(word, length(word) - k) as stem, right(word, k) as suffix from words, range(1, {K + 1}) r(k) where length(word) - k >= {S}),
bases as (
  select word as stem, '' as replacement, word as base from words where length(word) >= {S}
  union all select left(word, length(word) - 1), right(word, 1), word from words where length(word) > {S}),
rules as (
  select suffix, replacement, support, round(support / n, 9) as share
  from (select suffix, replacement, count(*) as support from splits join bases using (stem) where left(suffix, 1) <> replacement group by all)
  join (select suffix, count(*) as n from splits group by suffix) using (suffix)
  where support >= {lm.LEAST_SUPPORT} and share >= {lm.LEAST_SHARE})"""

LEMMAS = f"""{RULES}, once as (
  select word, coalesce(base, word) as lemma from words left join (
    select word, base from splits join rules using (suffix) join bases using (stem, replacement)
    qualify row_number() over (partition by word order by length(suffix) desc, support desc, base) = 1) using (word))"""


def spoken(t: Tables) -> DataFrame:
    return cut(t.documents.select(F.col("doc_id").alias("org_id"), F.regexp_extract_all(F.lower("text"), F.lit(TOKEN_PATTERN), F.lit(0)).alias("tokens")))


@query("f2_lemma_rules", f"with {RULES} select * from rules")
def f2_lemma_rules(t):
    return lm.suffix_rules(cut(lm.vocabulary(spoken(t))))


@query("f2_lemmas", f"with {LEMMAS} select word, lemma from once")
def f2_lemmas(t):
    words = cut(lm.vocabulary(spoken(t)))
    return lm.lemma_of(words, cut(lm.suffix_rules(words)))


@query(
    "f2_lemmatised",
    f"""with {LEMMAS}, twice as (select a.word, b.lemma from once a join once b on b.word = a.lemma),
    each as (select org_id, unnest(tokens) as word, unnest(range(1, len(tokens) + 1)) as i from spoken),
    lists as (select org_id, string_agg(coalesce(lemma, word), ' ' order by i) as tokens from each left join twice using (word) group by org_id)
    select org_id, coalesce(lists.tokens, '') as tokens from spoken left join lists using (org_id)""",
)
def f2_lemmatised(t):
    corpus = spoken(t)
    words = cut(lm.vocabulary(corpus))
    table = cut(lm.lemma_table(words, cut(lm.suffix_rules(words))))
    return lm.lemmatise(corpus, table).select("org_id", F.array_join("tokens", " ").alias("tokens"))
