"""Groups on several levels: given ones with their statistics, and the nested co-clustering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sectorlens.catalog.registry import Tables, query
from sectorlens.catalog.sectors import EDGES, GIVEN, doc_groups, edges, p9d, text_sectors_sql, word_groups
from sectorlens.operators import cocluster as cc
from sectorlens.operators import graph as g
from sectorlens.operators import nested
from sectorlens.session import cut

# Given levels: documents by source and words by length, three groups of a level in one above, twice.

DEPTH = 2

GIVEN_LEVELS = f"""{EDGES}, {GIVEN}, labels as (
  select sector, 'doc' as kind, doc_id::varchar as node, doc_group as grp from doc_groups
  union all select distinct sector, 'word', word, least(length(word), 9)::int from edges),
levels as (
  select sector, kind, level, node, (grp // (3 ** level)::int)::int as grp from labels, (select unnest(range({DEPTH + 1}))::int as level)),
lab as (
  select e.sector, e.doc_id, e.word, e.cnt, d.grp as doc_group, w.grp as word_group
  from edges e join levels d on d.sector = e.sector and d.kind = 'doc' and d.node = e.doc_id::varchar and d.level = 1
  join levels w on w.sector = e.sector and w.kind = 'word' and w.node = e.word and w.level = 1)"""


def given_levels(t: Tables, e: DataFrame) -> DataFrame:
    labels = doc_groups(t).select("sector", F.lit("doc").alias("kind"), F.col("doc_id").cast("string").alias("node"), F.col("doc_group").alias("grp")).unionByName(
        word_groups(e).select("sector", F.lit("word").alias("kind"), F.col("word").alias("node"), F.col("word_group").alias("grp"))
    )
    third = F.floor(F.col("grp") / 3).cast("int")
    parents, grps = [], labels.select("sector", "kind", "grp").distinct()
    for level in range(1, DEPTH + 1):
        parents.append(grps.select("sector", "kind", F.lit(level).alias("level"), "grp", third.alias("parent")))
        grps = grps.select("sector", "kind", third.alias("grp")).distinct()
    return nested.project_levels(labels, cut(parents[0].unionByName(parents[1])))


def level_one(t: Tables):
    e = edges(t)
    return e, *nested.at_level(given_levels(t, e), 1, "long")


@query("a7_levels", f"with {GIVEN_LEVELS} select * from levels")
def a7_levels(t):
    return given_levels(t, edges(t))


@query(
    "a7_level_topic_words",
    f"""with {GIVEN_LEVELS} select sector, word, word_group, round(n / sum(n) over (partition by sector, word_group), 9) as p
    from (select sector, word, word_group, sum(cnt)::bigint as n from lab group by all)""",
)
def a7_level_topic_words(t):
    e, _, words = level_one(t)
    return p9d(g.topic_words(e, words))


@query(
    "a7_level_doc_topics",
    f"""with {GIVEN_LEVELS} select sector, doc_id, word_group, round(n / sum(n) over (partition by sector, doc_id), 9) as p
    from (select sector, doc_id, word_group, sum(cnt)::bigint as n from lab group by all)""",
)
def a7_level_doc_topics(t):
    e, _, words = level_one(t)
    return p9d(g.doc_topics(e, words))


@query(
    "a8_level_mixture",
    f"""with {GIVEN_LEVELS} select sector, doc_group, word_group, round(n / sum(n) over (partition by sector), 9) as p
    from (select sector, doc_group, word_group, sum(cnt)::bigint as n from lab group by all)""",
)
def a8_level_mixture(t):
    e, docs, words = level_one(t)
    return p9d(g.group_mixture(e, docs, words))


@query(
    "w7_level_top_words",
    f"""with {GIVEN_LEVELS}, topics as (
      select sector, word, word_group, n / sum(n) over (partition by sector, word_group) as p
      from (select sector, word, word_group, sum(cnt)::bigint as n from lab group by all))
    select sector, word, word_group, round(p, 9) as p, row_number() over (partition by sector, word_group order by p desc, word) as rank
    from topics qualify rank <= 10""",
)
def w7_level_top_words(t):
    e, _, words = level_one(t)
    return p9d(g.top_words(g.topic_words(e, words), 10))


@query(
    "w8_level_top_docs",
    f"""with {GIVEN_LEVELS} select sector, doc_group, doc_id, 1.0::double as p,
      row_number() over (partition by sector, doc_group order by doc_id) as rank
    from (select distinct sector, doc_group, doc_id from lab) qualify rank <= 10""",
)
def w8_level_top_docs(t):
    e, docs, _ = level_one(t)
    return g.top_docs(g.doc_membership(e, docs), 10)


@query(
    "w10_level_cluster_peers",
    f"""with {GIVEN_LEVELS}, own as (select sector, node::bigint as doc_id, grp from levels where kind = 'doc' and level = 1),
    asked as (select sector, min(doc_id) as asked_id from own group by sector)
    select a.sector, asked_id, d.grp as doc_group, d.doc_id
    from asked a join own h on h.sector = a.sector and h.doc_id = asked_id
    join own d on d.sector = a.sector and d.grp = h.grp and d.doc_id <> asked_id""",
)
def w10_level_cluster_peers(t):
    _, docs, _ = level_one(t)
    return g.cluster_peers(docs, docs.groupBy("sector").agg(F.min("doc_id").alias("doc_id")))


LEVEL_SECTORS = text_sectors_sql("level_groups")


@query(
    "r4_level_cluster_rows",
    f"""with {GIVEN_LEVELS}, level_groups as (select sector, node::bigint as doc_id, grp as doc_group from levels where kind = 'doc' and level = 1),
    {LEVEL_SECTORS} select sector_id, org_id from text_sectors where param = 'assigned_10'""",
)
def r4_level_cluster_rows(t):
    _, docs, _ = level_one(t)
    return g.text_sectors(docs, [10]).select("sector_id", "org_id")


# Fits with open group numbers and their own stop rules; planted groups test them.


@query("t6_nested")
def t6_nested(t):
    return nested.fit_levels(edges(t), start_groups=4, patience=1)[0]


@query("t6_open_numbers")
def t6_open_numbers(t):
    return cc.cocluster(edges(t))[2]
