"""Sub-word counts; the vocabulary are the beginnings and inner parts of the benchmark's words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sectorlens.catalog.registry import Tables, query
from sectorlens.catalog.text import described
from sectorlens.catalog.vectors import SEED, histogram_sql
from sectorlens.operators import subwords as sw
from sectorlens.plans import embedding as em

STARTS, INNER, LIMIT = 5, 3, 512

WORDS = f"regexp_extract_all(lower(coalesce(text, '')), '{sw.WORD_PATTERN}')"

SEGMENTED = f"""source as (select distinct unnest({WORDS}) as w from benchmark),
pieces as (
  select distinct left(w, k) as part, false as inside from source, range(1, {STARTS + 1}) r(k) where k <= length(w)
  union select distinct substr(w, i, k), true
  from (select w, unnest(range(2, length(w) + 1)) as i from source), range(1, {INNER + 1}) r(k) where i + k - 1 <= length(w)),
counts as (
  select doc_id, word, count(*) as times from (select doc_id, unnest({WORDS}) as word from documents) group by all),
distinct_words as (select distinct word from counts),
longest as (
  select word, start, max(k) as width from (
    select word, i as start, k from (select word, unnest(range(1, length(word) + 1)) as i from distinct_words where length(word) <= {sw.LONGEST_WORD}),
      range(1, {max(STARTS, INNER) + 1}) r(k) where i + k - 1 <= length(word))
  join pieces on part = substr(word, start, k) and inside = (start > 1) group by all),
walk(word, pos, found) as (
  select word, 1::bigint, []::varchar[] from distinct_words
  union all
  select w.word, pos + width, list_append(found, case when pos > 1 then '{sw.CONTINUES}' else '' end || substr(w.word, pos, width))
  from walk w join longest l on l.word = w.word and l.start = w.pos),
segmented as (
  select word, coalesce(max(found) filter (pos = length(word) + 1), ['{sw.UNKNOWN}']) as pieces from walk group by word),
token_counts as (
  select doc_id, {sw.SPECIAL} + coalesce(sum(times * len(pieces)), 0)::bigint as n_tokens
  from documents left join counts using (doc_id) left join segmented using (word) group by doc_id)"""


def pieces(t: Tables) -> DataFrame:
    words = t.benchmark.select(F.explode(sw.split_words("text")).alias("w")).distinct()
    size = F.length("w")
    starts = words.select("w", F.explode(F.sequence(F.lit(1), F.least(size, F.lit(STARTS)))).alias("k")).select(F.left("w", F.col("k")).alias("piece"))
    places = words.where(size > 1).select("w", F.explode(F.sequence(F.lit(2), size)).alias("i"))
    inner = places.select("w", "i", F.explode(F.sequence(F.lit(1), F.least(F.lit(INNER), size - F.col("i") + 1))).alias("k"))
    return starts.union(inner.select(F.concat(F.lit(sw.CONTINUES), F.substring("w", F.col("i"), F.col("k"))))).distinct()


@query("f11_word_pieces", f"with recursive {SEGMENTED} select word, array_to_string(pieces, ' ') as pieces from segmented")
def f11_word_pieces(t):
    words = t.documents.select(F.explode(sw.split_words("text")).alias("word"))
    return sw.segment_words(words, pieces(t)).select("word", F.array_join("pieces", " ").alias("pieces"))


@query("f11_subword_counts", f"with recursive {SEGMENTED} select doc_id, n_tokens, least(n_tokens, {LIMIT})::bigint as n_kept from token_counts")
def f11_subword_counts(t):
    return sw.subword_counts(t.documents, pieces(t), "doc_id", "text", max_length=LIMIT)


SAMPLED = f"""{SEGMENTED}, lengths as (
  select n_tokens::int as length from token_counts
  semi join (select doc_id from documents order by md5('{SEED}:' || doc_id), doc_id limit 150) using (doc_id))"""


@query(
    "t11_subwords_not_truncated",
    f"""with recursive {SAMPLED}, c as (select count(*) filter (length < {LIMIT}) as l, count(*) filter (length <= {LIMIT}) as r, count(*) as n from lengths)
    select (l + r + (r > l)::int) * 50.0::double / n as percentile from c""",
)
def t11_subwords_not_truncated(t):
    return em.subword_report(described(t), pieces(t), LIMIT, 150, seed=SEED)[0]


@query("t11_subword_histogram", f"with recursive {SAMPLED}, {histogram_sql('max(length)')}")
def t11_subword_histogram(t):
    return em.subword_report(described(t), pieces(t), LIMIT, 150, seed=SEED)[1]
