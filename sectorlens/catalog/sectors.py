"""Sector corpora, word-document graphs, group statistics and text sectors of the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sectorlens.catalog.registry import Tables, query
from sectorlens.catalog.text import CORPUS, corpus, described
from sectorlens.functions import text as x
from sectorlens.operators import cocluster as cc
from sectorlens.operators import corpus as c
from sectorlens.operators import export
from sectorlens.operators import graph as g
from sectorlens.plans.descriptions import tokenized
from sectorlens.session import cut, scratch_path
from sectorlens.sources import store

# Labelled documents stand in for matched organisations, their source for the sector code.

MIN_SIZE = 20


def sic4(t: Tables) -> DataFrame:
    return t.labels.join(t.documents, "doc_id").select(F.col("doc_id").alias("org_id"), F.col("source").alias("sic4"))


SIC4 = "sic4 as (select doc_id as org_id, source as sic4 from labels join documents using (doc_id))"
CODES = "|".join(x.STRIPPED_CODES)
STRIPPED = f"stripped as (select org_id, list_filter(tokens, lambda t: not regexp_matches(t, '{CODES}')) as tokens from corpus)"
BIG = f"big as (select sic4 as sector, count(*) as n from sic4 group by 1 having count(*) > {MIN_SIZE})"
TEXT = "array_to_string(tokens, ' ') as tokens"


def shown(df: DataFrame) -> DataFrame:
    return df.withColumn("tokens", F.array_join("tokens", " "))


@query("p11_strip_placeholders", f"with {CORPUS}, {STRIPPED} select org_id, {TEXT} from stripped")
def p11(t):
    return shown(corpus(t).withColumn("tokens", x.strip_placeholders("tokens")))


def matched_corpus(t: Tables) -> DataFrame:
    """Tokens of the matched documents only, chosen before tokenising."""
    return cut(tokenized(c.matched_only(described(t), sic4(t))))


@query("j6_matched_only", f"with {CORPUS}, {SIC4} select org_id, {TEXT} from corpus semi join sic4 using (org_id)")
def j6(t):
    return shown(matched_corpus(t))


@query("a1_big_sectors", f"with {SIC4}, {BIG} select sector, n from big")
def a1(t):
    return c.big_sectors(sic4(t), MIN_SIZE)


@query(
    "j7_tokens_by_sector",
    f"""with {CORPUS}, {SIC4}, {BIG} select sector, org_id, {TEXT}
    from corpus join sic4 using (org_id) join big on sector = sic4""",
)
def j7(t):
    return shown(c.tokens_by_sector(matched_corpus(t), sic4(t), c.big_sectors(sic4(t), MIN_SIZE)))


CORPORA = f"""{CORPUS}, {SIC4}, {STRIPPED}, {BIG}, corpora as (
  select sector, org_id, tokens from stripped join sic4 using (org_id) join big on sector = sic4)"""


def corpora(t: Tables) -> DataFrame:
    return c.sector_corpora(sic4(t), matched_corpus(t), MIN_SIZE)


@query("t14_sector_corpora", f"with {CORPORA} select sector, org_id, {TEXT} from corpora")
def t14(t):
    return shown(corpora(t))


@query(
    "l2_first_sectors",
    f"""with {CORPORA} select sector, org_id, {TEXT} from corpora
    where sector in (select distinct sector from corpora order by sector limit 2)""",
)
def l2(t):
    return shown(c.first_sectors(corpora(t), 2))


# The graph: language as the sector, all documents.


def by_language(t: Tables) -> DataFrame:
    return corpus(t).join(t.documents.select(F.col("doc_id").alias("org_id"), F.col("lang").alias("sector")), "org_id")


WORDS = f"""{CORPUS}, words as (
  select lang as sector, org_id as doc_id, unnest(tokens) as word from corpus join documents on org_id = doc_id)"""
EDGES = f"{WORDS}, edges as (select sector, doc_id, word, count(*) as cnt from words group by all)"


def edges(t: Tables) -> DataFrame:
    return cut(g.bow_edges(by_language(t)))


@query("a2_bow_edges", f"with {EDGES} select * from edges")
def a2(t):
    return g.bow_edges(by_language(t))


@query(
    "a2_bow_occurrences",
    f"with {WORDS} select sector, doc_id, word, 1::bigint as cnt from words",
)
def a2_occurrences(t):
    return g.bow_edges(by_language(t), counts=False)


@query(
    "a3_frequent_words",
    f"""with {EDGES} select * from edges
    semi join (select sector, word from edges group by all having count(*) >= 5) using (sector, word)""",
)
def a3(t):
    return g.bow_edges(by_language(t), n_min=5)


@query(
    "a4_matrix_edges",
    f"""with {EDGES}, cells as (select word, sector as doc_id, sum(cnt) as cnt from edges group by all)
    select 'all' as sector, doc_id, word, cnt::bigint as cnt from cells
    semi join (select word from cells group by word having count(*) >= 2) using (word)""",
)
def a4(t):
    e = edges(t)
    languages = [r["sector"] for r in e.select("sector").where("sector is not null").distinct().orderBy("sector").collect()]
    matrix = e.groupBy("word").pivot("sector", languages).agg(F.sum("cnt")).fillna(0)
    return g.matrix_edges(matrix, "word", languages, "all", n_min=2)


@query(
    "a5_graph_sizes",
    f"""with {EDGES} select sector, count(distinct word) as n_words, count(distinct doc_id) as n_docs,
      count(*) as n_edges from edges group by sector""",
)
def a5(t):
    return g.graph_sizes(edges(t))


# Given groups: documents by source, words by length.


def doc_groups(t: Tables) -> DataFrame:
    return t.documents.select(
        F.col("lang").alias("sector"), "doc_id", F.substring("source", 4, 9).cast("int").alias("doc_group")
    )


def word_groups(e: DataFrame) -> DataFrame:
    return e.select("sector", "word").distinct().withColumn("word_group", F.least(F.length("word"), F.lit(9)))


GROUPED = f"""{EDGES}, doc_groups as (
  select lang as sector, doc_id, substr(source, 4)::int as doc_group from documents),
word_groups as (select distinct sector, word, least(length(word), 9)::int as word_group from edges),
lab as (select * from edges join doc_groups using (sector, doc_id) join word_groups using (sector, word)),
n_wb as (select sector, word, word_group, sum(cnt)::bigint as n from lab group by all),
n_db as (select sector, doc_id, doc_group, sum(cnt)::bigint as n from lab group by all),
n_dbw as (select sector, doc_id, word_group, sum(cnt)::bigint as n from lab group by all),
mix as (select sector, doc_group, word_group, sum(cnt)::bigint as n from lab group by all),
p_mix as (select *, n / sum(n) over (partition by sector) as p from mix)"""


@query("a6_word_group_counts", f"with {GROUPED} select * from n_wb")
def a6_words(t):
    e = edges(t)
    return g.word_group_counts(e, word_groups(e))


@query("a6_doc_group_counts", f"with {GROUPED} select * from n_db")
def a6_docs(t):
    return g.doc_group_counts(edges(t), doc_groups(t))


@query("a6_doc_word_group_counts", f"with {GROUPED} select * from n_dbw")
def a6_doc_words(t):
    e = edges(t)
    return g.doc_word_group_counts(e, word_groups(e))


def p9d(df: DataFrame, column: str = "p") -> DataFrame:
    return df.withColumn(column, F.round(column, 9))


@query("a7_word_membership", f"with {GROUPED} select sector, word, word_group, round(n / sum(n) over (partition by sector, word), 9) as p from n_wb")
def a7_word(t):
    e = edges(t)
    return p9d(g.word_membership(e, word_groups(e)))


@query("a7_doc_membership", f"with {GROUPED} select sector, doc_id, doc_group, round(n / sum(n) over (partition by sector, doc_id), 9) as p from n_db")
def a7_doc(t):
    return p9d(g.doc_membership(edges(t), doc_groups(t)))


@query("a7_topic_words", f"with {GROUPED} select sector, word, word_group, round(n / sum(n) over (partition by sector, word_group), 9) as p from n_wb")
def a7_topics(t):
    e = edges(t)
    return p9d(g.topic_words(e, word_groups(e)))


@query("a7_doc_topics", f"with {GROUPED} select sector, doc_id, word_group, round(n / sum(n) over (partition by sector, doc_id), 9) as p from n_dbw")
def a7_doc_topics(t):
    e = edges(t)
    return p9d(g.doc_topics(e, word_groups(e)))


@query(
    "a7_group_numbers",
    f"""with {GROUPED} select d.sector, n_doc_groups, n_word_groups
    from (select sector, count(distinct doc_group) as n_doc_groups from doc_groups group by 1) d
    join (select sector, count(distinct word_group) as n_word_groups from word_groups group by 1) w using (sector)""",
)
def a7_numbers(t):
    return g.group_numbers(doc_groups(t), word_groups(edges(t)))


@query("a8_group_mixture", f"with {GROUPED} select sector, doc_group, word_group, round(p, 9) as p from p_mix")
def a8(t):
    e = edges(t)
    return p9d(g.group_mixture(e, doc_groups(t), word_groups(e)))


@query("a8_group_mixture_counts", f"with {GROUPED} select sector, doc_group, word_group, n from mix")
def a8_counts(t):
    e = edges(t)
    return g.group_mixture(e, doc_groups(t), word_groups(e), norm=False)


@query(
    "a9_group_pmi",
    f"""with {GROUPED} select sector, doc_group, word_group,
      round(ln(p / (sum(p) over (partition by sector, doc_group) * sum(p) over (partition by sector, word_group))), 8) as pmi
    from p_mix""",
)
def a9(t):
    e = edges(t)
    return g.group_pmi(g.group_mixture(e, doc_groups(t), word_groups(e))).withColumn("pmi", F.round("pmi", 8))


TOPICS = f"""{GROUPED}, topics as (
  select sector, word, word_group, n / sum(n) over (partition by sector, word_group) as p from n_wb),
ranked_words as (
  select *, row_number() over (partition by sector, word_group order by p desc, word) as rank from topics),
ranked_docs as (
  select sector, doc_group, doc_id, row_number() over (partition by sector, doc_group order by doc_id) as rank
  from n_db)"""


@query("w7_top_words", f"with {TOPICS} select sector, word, word_group, round(p, 9) as p, rank from ranked_words where rank <= 10")
def w7(t):
    e = edges(t)
    return p9d(g.top_words(g.topic_words(e, word_groups(e)), 10))


@query("w7_all_words", f"with {TOPICS} select sector, word, word_group, round(p, 9) as p, rank from ranked_words")
def w7_all(t):
    e = edges(t)
    return p9d(g.top_words(g.topic_words(e, word_groups(e)), None))


@query("w8_top_docs", f"with {TOPICS} select sector, doc_group, doc_id, 1.0::double as p, rank from ranked_docs where rank <= 10")
def w8(t):
    return g.top_docs(g.doc_membership(edges(t), doc_groups(t)), 10)


DISTRIBUTION = f"""{GROUPED}, dist as (
  select d.sector, d.doc_id, w.word_group, coalesce(p, 0) as p
  from (select distinct sector, doc_id from n_dbw) d join (select distinct sector, word_group from n_dbw) w using (sector)
  left join (select *, n / sum(n) over (partition by sector, doc_id) as p from n_dbw) q
    on q.sector = d.sector and q.doc_id = d.doc_id and q.word_group = w.word_group)"""


@query("w9_topic_distribution", f"with {DISTRIBUTION} select sector, doc_id, word_group, round(p, 9) as p from dist")
def w9(t):
    e = edges(t)
    return p9d(g.topic_distribution(g.doc_topics(e, word_groups(e))))


@query(
    "w10_cluster_peers",
    f"""with {GROUPED}, asked as (select sector, min(doc_id) as asked_id from doc_groups group by sector)
    select a.sector, asked_id, d.doc_group, d.doc_id
    from asked a join doc_groups h on h.sector = a.sector and h.doc_id = asked_id
    join doc_groups d on d.sector = a.sector and d.doc_group = h.doc_group and d.doc_id <> asked_id""",
)
def w10(t):
    groups = doc_groups(t)
    return g.cluster_peers(groups, groups.groupBy("sector").agg(F.min("doc_id").alias("doc_id")))


# Export and storage of the graph.


def wide_sql(source: str, rows: str, group: str, label: str, value: str, groups: range) -> str:
    cells = ", ".join(f"""max({value}) filter ({group} = {i}) as "{label} {i + 1}\"""" for i in groups)
    return f"select {rows}, {cells} from {source} group by {rows}"


@query("s11_topics_table", f"with {TOPICS} {wide_sql('ranked_words', 'sector, rank', 'word_group', 'Topic', 'word', range(1, 10))}")
def s11_topics(t):
    e = edges(t)
    return g.topics_table(g.topic_words(e, word_groups(e)))


@query("s11_topic_distribution_table", f"with {DISTRIBUTION} {wide_sql('dist', 'sector, doc_id', 'word_group', 'Topic', 'round(p, 9)', range(1, 10))}")
def s11_distribution(t):
    e = edges(t)
    return g.topic_distribution_table(p9d(g.doc_topics(e, word_groups(e))))


@query("s11_clusters_table", f"with {TOPICS} {wide_sql('ranked_docs', 'sector, rank', 'doc_group', 'Cluster', 'doc_id', range(20))}")
def s11_clusters(t):
    path = scratch_path(t.spark, "clusters")
    table = g.clusters_table(g.doc_membership(edges(t), doc_groups(t)))
    g.export_table(table, path, sep="\t")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema)
    return t.spark.read.schema(schema).option("header", True).option("sep", "\t").csv(path)


def read_back(t: Tables, path: str, rows: str, label: str, groups: range, kind: str) -> DataFrame:
    """A written table by its known columns."""
    found = t.spark.read.option("header", True).option("sep", "\t").csv(path)
    names = [f"{label} {i + 1}" for i in groups]
    first, second = rows.split(", ")
    return found.select(first, F.col(second).cast("long"), *[F.col(f"`{n}`").cast(kind) if n in found.columns else F.lit(None).cast(kind).alias(n) for n in names])


@query("s11_exported_clusters", f"with {TOPICS} {wide_sql('ranked_docs', 'sector, rank', 'doc_group', 'Cluster', 'doc_id', range(20))}")
def s11_exported_clusters(t):
    path = scratch_path(t.spark, "wide-clusters")
    export.export_clusters(g.doc_membership(edges(t), doc_groups(t)), path, sep="\t")
    return read_back(t, path, "sector, rank", "Cluster", range(20), "long")


@query("s11_exported_topics", f"with {TOPICS} {wide_sql('ranked_words', 'sector, rank', 'word_group', 'Topic', 'word', range(1, 10))}")
def s11_exported_topics(t):
    path = scratch_path(t.spark, "wide-topics")
    e = edges(t)
    export.export_topics(g.topic_words(e, word_groups(e)), path, sep="\t")
    return read_back(t, path, "sector, rank", "Topic", range(1, 10), "string")


@query("s12_saved_graph", f"with {EDGES} select sector, doc_id, word, cnt from edges")
def s12(t):
    path = scratch_path(t.spark, "graph")
    store.save_graph(g.bow_edges(by_language(t)), path)
    return store.load_graph(t.spark, path).select("sector", "doc_id", "word", "cnt")


@query("s12_graph_words", f"with {EDGES} select distinct sector, word from edges")
def s12_words(t):
    return store.graph_words(edges(t))


@query("s12_graph_documents", f"with {EDGES} select distinct sector, doc_id from edges")
def s12_documents(t):
    return store.graph_documents(edges(t))


# Text sectors.

SHARES = (10, 0.5, "all")
LIMITS = "(values ('assigned_10', 10, 0.0), ('assigned_0.5', null, 0.5), ('assigned_all', null, 1.0)) s(param, k, f)"


def text_sectors_sql(groups: str) -> str:
    return f"""sizes as (select sector, count(*) as n from {groups} group by sector),
placed as (select *, row_number() over (partition by sector, doc_group order by doc_id) as rn from {groups}),
text_sectors as (
  select param, sector || '_' || doc_group as sector_id, doc_id as org_id
  from placed join sizes using (sector), {LIMITS} where rn <= coalesce(k, floor(n * f::double)))"""


GIVEN = "doc_groups as (select lang as sector, doc_id, substr(source, 4)::int as doc_group from documents)"


@query("t7_text_sectors", f"with {GIVEN}, {text_sectors_sql('doc_groups')} select * from text_sectors")
def t7(t):
    return g.text_sectors(doc_groups(t), SHARES)


@query(
    "r4_cluster_rows",
    f"with {GIVEN}, {text_sectors_sql('doc_groups')} select sector_id, org_id from text_sectors where param = 'assigned_10'",
)
def r4(t):
    return g.text_sectors(doc_groups(t), [10]).select("sector_id", "org_id")


@query(
    "l3_docs_to_assign",
    f"""with {GIVEN}, sizes as (select sector, count(*) as n from doc_groups group by sector)
    select sector, param, coalesce(k, floor(n * f::double))::bigint as n_docs from sizes, {LIMITS}""",
)
def l3(t):
    sizes = doc_groups(t).groupBy("sector").agg(F.count("*").alias("n"))
    limits = F.array(*[F.struct(F.lit(f"assigned_{s}").alias("param"), g.docs_to_assign(s, F.col("n")).alias("n_docs")) for s in SHARES])
    return sizes.select("sector", F.inline(limits))


@query(
    "u6_share_fan_out",
    f"with {GIVEN}, {text_sectors_sql('doc_groups')} select param, count(*) as n_orgs from text_sectors group by param",
)
def u6(t):
    return g.text_sectors(doc_groups(t), SHARES).groupBy("param").agg(F.count("*").alias("n_orgs"))


@query(
    "s14_text_sectors_of",
    f"with {GIVEN}, {text_sectors_sql('doc_groups')} select sector_id, org_id from text_sectors where param = 'assigned_0.5'",
)
def s14_sectors(t):
    path = scratch_path(t.spark, "text-sectors")
    store.save_table(g.text_sectors(doc_groups(t), SHARES), path, ["param"])
    return store.text_sectors_of(store.load_table(t.spark, path), "assigned_0.5")


# Co-clustering: the SQL unrolls two passes of two runs.

RUNS = ((0, 2, 2), (1, 4, 4))
ALPHA = 1e-9


def _starts_sql(name: str, nodes: str, node: str, place: int) -> str:
    each = " union all ".join(
        f"select sector, {node}, {run[0]} as run, ('0x' || substr(md5('0:' || {node}), 1, 7))::bigint % {run[place]} as label from {nodes}"
        for run in RUNS
    )
    return f"{name} as ({each})"


def _half_sql(name: str, other: str, own: str, across: str, node: str, place: int) -> str:
    """New labels of the nodes from those across the edges; the most likely, then the lowest."""
    sizes = ", ".join(f"({run[0]}, {run[place]})" for run in RUNS)
    return f"""{name}_t as (
  select sector, run, {node}, label as other, sum(cnt)::bigint as e from edges join {other} using (sector, {across}) group by all),
{name}_b as (
  select sector, run, o.label, t.other, sum(e) as e from {name}_t t join {own} o using (sector, run, {node}) group by all),
{name}_n as (select sector, run, label, sum(e) as total from {name}_b group by all),
{name}_r as (
  select n.sector, n.run, n.label, g.other, ln((coalesce(b.e, 0) + {ALPHA}) / (n.total + {ALPHA} * s.size)) as rate
  from {name}_n n join (values {sizes}) s(run, size) on s.run = n.run
    join lateral (select unnest(range(0, s.size)) as other) g on true
    left join {name}_b b on b.sector = n.sector and b.run = n.run and b.label = n.label and b.other = g.other),
{name}_f as (
  select t.sector, t.run, {node}, r.label, round(sum(t.e * r.rate), 6) as fit
  from {name}_t t join {name}_r r on r.sector = t.sector and r.run = t.run and r.other = t.other group by all),
{name} as (
  select sector, run, {node}, label from {name}_f
  qualify row_number() over (partition by sector, run, {node} order by fit desc, label) = 1)"""


def _factorial_sql(n: str) -> str:
    return f"case when {n} > 0 then {n} * ln({n}) - {n} + ln({n} * 2 * pi()) / 2 else 0 end"


def _choose_sql(n: str, k: str) -> str:
    return f"({_factorial_sql(n)} - ({_factorial_sql(k)}) - ({_factorial_sql(f'({n} - {k})')}))"


def _length_sql(name: str, docs: str, words: str) -> str:
    """Description length of every run."""
    sides = ", ".join(
        f"""{name}_{side} as (
  select sector, run, count(*) as used, {_factorial_sql('sum(n)')} - sum({_factorial_sql('n')}) + {_choose_sql('(sum(n) - 1)', '(count(*) - 1.0::double)')} as cost
  from (select sector, run, label, count(*)::double as n from {labels} group by all) group by all)"""
        for side, labels in (("sd", docs), ("sw", words))
    )
    return f"""{name}_c as (
  select sector, run, w.label as s, d.label as r, sum(cnt)::double as e
  from edges join {words} w using (sector, word) join {docs} d using (sector, run, doc_id) group by all),
{name}_e as (
  select *, sum(e) over (partition by sector, run, s) as e_s, sum(e) over (partition by sector, run, r) as e_r from {name}_c),
{name}_g as (select sector, run, sum(e * ln(e / (e_r * e_s))) as fit, sum(e) as edges from {name}_e group by all),
{sides},
{name} as (
  select g.sector, g.run, fit, d.used as used_docs, w.used as used_words,
    round(d.cost + w.cost + {_choose_sql('(d.used * w.used + edges - 1)', 'edges')} - fit, 6) as description_length
  from {name}_g g join {name}_sd d using (sector, run) join {name}_sw w using (sector, run))"""


COCLUSTERED = ",\n".join(
    [
        EDGES,
        _starts_sql("d0", "(select distinct sector, doc_id from edges)", "doc_id", 1),
        _starts_sql("w0", "(select distinct sector, word from edges)", "word", 2),
        _half_sql("d1", "w0", "d0", "word", "doc_id", 2), _half_sql("w1", "d1", "w0", "doc_id", "word", 1),
        _half_sql("d2", "w1", "d1", "word", "doc_id", 2), _half_sql("w2", "d2", "w1", "doc_id", "word", 1),
        _length_sql("l1", "d1", "w1"), _length_sql("l2", "d2", "w2"),
        "lengths as (select 0 as pass, * from l1 union all select 1, * from l2)",
        """chosen as (select * from lengths qualify row_number() over (partition by sector order by description_length, run, pass desc) = 1)""",
        """docs as (select 0 as pass, * from d1 union all select 1, * from d2)""",
        """words_of as (select 0 as pass, * from w1 union all select 1, * from w2)""",
    ]
)


def two_passes(t: Tables):
    return cc.fit_runs(edges(t), [run[1:] for run in RUNS], max_iter=2, epsilon=0.0)


@query("t6_first_labels", f"with {COCLUSTERED} select sector, run, doc_id, label::int as doc_group from d1")
def t6_labels(t):
    return two_passes(t)[1].where("pass = 0").select("sector", "run", "doc_id", "doc_group")


@query(
    "t6_description_lengths",
    f"""with {COCLUSTERED} select sector, run, pass, used_docs, used_words, round(fit, 3) as fit,
      round(description_length, 3) as description_length from lengths""",
)
def t6_lengths(t):
    history = two_passes(t)[0].withColumns({c: F.round(c, 3) for c in ("fit", "description_length")})
    return history.select("sector", "run", "pass", "used_docs", "used_words", "fit", "description_length")


@query(
    "t6_cocluster",
    f"""with {COCLUSTERED}
    select sector, 'doc' as kind, doc_id::varchar as node, (dense_rank() over (partition by sector order by label) - 1)::int as grp
    from docs semi join chosen using (sector, run, pass)
    union all
    select sector, 'word', word, (dense_rank() over (partition by sector order by label) - 1)::int
    from words_of semi join chosen using (sector, run, pass)""",
)
def t6(t):
    docs, words, _ = cc.cocluster(edges(t), [run[1:] for run in RUNS], max_iter=2, epsilon=0.0)
    return docs.select("sector", F.lit("doc").alias("kind"), F.col("doc_id").cast("string").alias("node"), F.col("doc_group").alias("grp")).unionByName(
        words.select("sector", F.lit("word").alias("kind"), F.col("word").alias("node"), F.col("word_group").alias("grp"))
    )
