"""Embeddings, nearest neighbours, reassignment, and checks of embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sectorlens.catalog.registry import Tables, query
from sectorlens.catalog.sectors import text_sectors_sql
from sectorlens.catalog.text import CORPUS, corpus
from sectorlens.functions import text as x
from sectorlens.functions.vectors import inner_product, l2_normalise
from sectorlens.operators import graph as g
from sectorlens.operators import knn as kn
from sectorlens.operators import lengths as ln
from sectorlens.operators import reassign as r
from sectorlens.operators import sampling as s
from sectorlens.plans import embedding as em
from sectorlens.plans.reassignment import reassign_orgs
from sectorlens.session import cut, scratch_path
from sectorlens.sources import store

K = 20
MIN_SIM = 0.25  # the test vectors point in random directions, few similarities exceed 0.3
SHARES = (10, 0.05, "all")
# Means of similarities of 9 decimals often end in a 5; shown shifted, they never round on a half.
SHIFT = 3.37e-10


def vectors(t: Tables) -> DataFrame:
    return t.embeddings.select(F.col("vec_id").alias("org_id"), "embedding")


def clusters(t: Tables) -> DataFrame:
    groups = t.embeddings.select(F.lit("s").alias("sector"), F.col("vec_id").alias("doc_id"), F.col("label").alias("doc_group"))
    return g.text_sectors(groups, SHARES)


def labels(t: Tables) -> DataFrame:
    return clusters(t).select("param", "org_id", F.col("sector_id").alias("label"))


GROUPS = "groups as (select 's' as sector, vec_id as doc_id, label as doc_group from embeddings)"
CLUSTERS = f"""{GROUPS}, {text_sectors_sql('groups').replace(
    "('assigned_0.5', null, 0.5)", "('assigned_0.05', null, 0.05)")},
labels as (select param, org_id, sector_id as label from text_sectors),
vec as (select vec_id as org_id, embedding::double[] as v,
        sqrt(list_dot_product(embedding::double[], embedding::double[])) as norm from embeddings)"""
NEAR = f"""{CLUSTERS}, hits as (
  select p.param, q.org_id as query_id, i.org_id as neighbour_id,
    round(list_dot_product(q.v, i.v) / (q.norm * i.norm), 9) as sim
  from vec q, (select distinct param from labels) p, labels l join vec i using (org_id)
  where l.param = p.param and q.org_id <> i.org_id),
near as (
  select *, (row_number() over (partition by param, query_id order by sim desc, neighbour_id))::int as rank from hits
  qualify rank <= {K}),
knn as (select near.* from near semi join labels l on l.param = near.param and l.org_id = query_id),
rest as (select near.* from near anti join labels l on l.param = near.param and l.org_id = query_id)"""


def neighbours(t: Tables) -> DataFrame:
    index = kn.clustered_vectors(clusters(t).select("param", "org_id"), vectors(t))
    return cut(kn.knn_join(index, index, K, by=["param"]))


def rest_neighbours(t: Tables) -> DataFrame:
    own = clusters(t).select("param", "org_id")
    index = kn.clustered_vectors(own, vectors(t))
    return cut(kn.knn_join(kn.left_over_vectors(own, vectors(t)), index, K, by=["param"]))


@query(
    "f10_l2_normalise",
    """select vec_id, i, round(embedding[i]::double * 2 / sqrt(list_dot_product(v, v)), 9) as value
    from (select vec_id, embedding, list_transform(embedding, lambda e: e::double * 2) as v,
          unnest(range(1, 65))::int as i from embeddings)""",
)
def f10(t):
    doubled = F.transform("embedding", lambda v: v.cast("double") * 2)
    return t.embeddings.select("vec_id", F.posexplode(l2_normalise(doubled)).alias("i", "value")).select(
        "vec_id", (F.col("i") + 1).alias("i"), F.round("value", 9).alias("value")
    )


@query(
    "f10_inner_product",
    "select vec_id, round(list_dot_product(embedding::double[], list_reverse(embedding)::double[]), 9) as product from embeddings",
)
def f10_product(t):
    return t.embeddings.select("vec_id", F.round(inner_product("embedding", F.reverse("embedding")), 9).alias("product"))


CELLS = "unnest(range(1, len(v) + 1))::int as i, round(unnest(v), 6) as value"


def cells(df: DataFrame, *columns: str) -> DataFrame:
    """One row per component of each vector."""
    placed = df.select(*columns, F.posexplode("embedding").alias("i", "v"))
    return placed.select(*columns, (F.col("i") + 1).alias("i"), F.round(F.col("v").cast("double"), 6).alias("value"))


@query("j8_clustered_vectors", f"with {CLUSTERS} select param, org_id, {CELLS} from labels join vec using (org_id)")
def j8(t):
    found = kn.clustered_vectors(clusters(t).select("param", "org_id"), vectors(t))
    return cells(found, "param", "org_id")


@query(
    "j9_left_over_vectors",
    f"""with {CLUSTERS} select param, org_id, {CELLS} from (select distinct param from labels), vec
    anti join labels using (param, org_id)""".replace("select distinct param from labels), vec", "select param, org_id, v from (select distinct param from labels), vec)"),
)
def j9(t):
    found = kn.left_over_vectors(clusters(t).select("param", "org_id"), vectors(t))
    return cells(found, "param", "org_id")


NEIGHBOUR = "param, query_id, rank, neighbour_id, sim"


@query("j12_knn_join", f"with {NEAR} select {NEIGHBOUR} from knn")
def j12(t):
    return neighbours(t).select("param", "query_id", "rank", "neighbour_id", "sim")


@query("j12_knn_join_left_over", f"with {NEAR} select {NEIGHBOUR} from rest")
def j12_rest(t):
    return rest_neighbours(t).select("param", "query_id", "rank", "neighbour_id", "sim")


@query("j12_knn_join_cells", f"with {NEAR} select {NEIGHBOUR} from knn")
def j12_cells(t):
    """The same search with several cells and small blocks."""
    index = kn.clustered_vectors(clusters(t).select("param", "org_id"), vectors(t))
    found = kn.knn_join(index, index, K, by=["param"], pivots=8, block_rows=256)
    return found.select("param", "query_id", "rank", "neighbour_id", "sim")


@query("j13_neighbour_labels", f"with {NEAR} select knn.*, label from knn join labels l on l.param = knn.param and l.org_id = neighbour_id")
def j13(t):
    return r.neighbour_labels(neighbours(t), labels(t)).select("param", "query_id", "neighbour_id", "sim", "rank", "label")


@query("j14_drop_surplus", f"with {NEAR} select {NEIGHBOUR} from knn")
def j14(t):
    index = kn.clustered_vectors(clusters(t).select("param", "org_id"), vectors(t))
    hits = kn.knn_join(index, index, K + 1, by=["param"], exclude_self=False)
    return kn.drop_surplus(hits, K, ["param"]).select("param", "query_id", "rank", "neighbour_id", "sim")


MEANS = f"""{NEAR}, means as (
  select knn.param, query_id, label, round(avg(sim), 12) as mean_sim
  from knn join labels l on l.param = knn.param and l.org_id = neighbour_id group by all)"""


@query("a10_label_means", f"with {MEANS} select param, query_id, label, round(mean_sim + {SHIFT}, 8) as mean_sim from means")
def a10(t):
    return r.label_means(neighbours(t), labels(t)).withColumn("mean_sim", F.round(F.col("mean_sim") + SHIFT, 8))


@query(
    "w6_best_label",
    f"""with {MEANS} select param, query_id, label, round(mean_sim + {SHIFT}, 8) as mean_sim from means
    qualify row_number() over (partition by param, query_id order by means.mean_sim desc, label desc) = 1""",
)
def w6(t):
    return r.best_label(r.label_means(neighbours(t), labels(t))).withColumn("mean_sim", F.round(F.col("mean_sim") + SHIFT, 8))


def pass_sql(before: str, after: str) -> str:
    return f"""{after}_m as materialized (
  select knn.param, query_id, label, round(avg(sim), 12) as mean_sim
  from knn join {before} l on l.param = knn.param and l.org_id = neighbour_id group by all),
{after} as materialized (
  select l.param, l.org_id, case when b.mean_sim >= {MIN_SIM} then b.label else l.label end as label
  from {before} l left join (select * from {after}_m
    qualify row_number() over (partition by param, query_id order by mean_sim desc, label desc) = 1) b
    on b.param = l.param and b.query_id = l.org_id)"""


THREE = f"{NEAR}, {pass_sql('labels', 'one')}, {pass_sql('one', 'two')}, {pass_sql('two', 'three')}"


@query("t8_one_pass", f"with {NEAR}, {pass_sql('labels', 'one')} select param, org_id, label from one")
def t8_one(t):
    return r.one_pass(neighbours(t), labels(t), MIN_SIM)


@query("t8_reassign", f"with {THREE} select param, org_id, label from three")
def t8(t):
    return r.reassign(neighbours(t), labels(t), MIN_SIM, n_iter=3, epsilon=0.0)[0]


# The default stop rule: a parameter keeps the pass that moves less than a twentieth, or the last of twenty.

STOP, PASSES = 0.05, 20
LABELS = ["labels", *[f"pass_{i}" for i in range(1, PASSES + 1)]]
STOPPED = ",\n".join(
    [
        NEAR,
        *[pass_sql(before, after) for before, after in zip(LABELS, LABELS[1:])],
        "shifts as ("
        + " union all ".join(
            f"select param, {i} as step, avg((a.label <> b.label)::int) as shift from {before} a join {after} b using (param, org_id) group by param"
            for i, (before, after) in enumerate(zip(LABELS, LABELS[1:]), 1)
        )
        + ")",
        f"stops as (select param, min(step) as step from shifts where shift < {STOP} or step = {PASSES} group by param)",
        *[
            f"three{suffix} as ("
            + " union all ".join(f"select p.* from {name}{suffix} p join stops using (param) where step = {i}" for i, name in enumerate(LABELS[1:], 1))
            + ")"
            for suffix in ("", "_m")
        ],
    ]
)


@query("t8_reassign_until_settled", f"with {STOPPED} select param, org_id, label from three")
def t8_settled(t):
    return r.reassign(neighbours(t), labels(t), MIN_SIM, n_iter=PASSES, epsilon=STOP)[0]


@query(
    "a11_changed_fraction",
    f"""with {NEAR}, {pass_sql('labels', 'one')}
    select param, round(avg((a.label <> b.label)::int), 9) as shift from labels a join one b using (param, org_id) group by param""",
)
def a11(t):
    before = labels(t)
    return r.changed_fraction(before, r.one_pass(neighbours(t), before, MIN_SIM)).withColumn("shift", F.round("shift", 9))


def entropy_sql(labels_table: str) -> str:
    return f"""select param, query_id as org_id, round(abs(log2(sum(c)) - sum(c * log2(c)) / sum(c)), 9) as entropy
    from (select knn.param, query_id, label, count(*) as c from knn
      join {labels_table} l on l.param = knn.param and l.org_id = neighbour_id group by all) group by all"""


@query("a12_neighbour_entropy", f"with {NEAR} {entropy_sql('labels')}")
def a12(t):
    return r.neighbour_entropy(neighbours(t), labels(t))


REST = f"""{NEAR}, rest_m as (
  select rest.param, query_id, label, round(avg(sim), 12) as mean_sim
  from rest join labels l on l.param = rest.param and l.org_id = neighbour_id group by all),
rest_best as (select * from rest_m qualify row_number() over (partition by param, query_id order by mean_sim desc, label desc) = 1)"""


@query(
    "t9_assign_rest",
    f"with {REST} select param, query_id as org_id, case when mean_sim >= {MIN_SIM} then label end as label from rest_best",
)
def t9(t):
    return r.assign_rest(rest_neighbours(t), labels(t), MIN_SIM)


def shown_records(df: DataFrame) -> DataFrame:
    """Arrays as strings, similarities in millionths."""

    def shown(field):
        fractions = field.dataType.elementType.typeName() in ("double", "float")
        parts = F.transform(field.name, lambda v: (F.round(v * 1_000_000).cast("long") if fractions else v).cast("string"))
        return F.array_join(parts, "|")

    return df.withColumns({f.name: shown(f) for f in df.schema if f.dataType.typeName() == "array"})


MILLIONTHS = "round({} * 1000000)::bigint::varchar"


RECORDS = f"""select k.param, query_id as org_id, string_agg(neighbour_id::varchar, '|' order by rank) as knn_org_ids,
    string_agg(a.label, '|' order by rank) as knn_original_text_sectors,
    string_agg(b.label, '|' order by rank) as knn_assigned_text_sectors,
    string_agg({MILLIONTHS.format('sim')}, '|' order by rank) as knn_sims
  from {{knn}} k join labels a on a.param = k.param and a.org_id = neighbour_id
  join {{after}} b on b.param = k.param and b.org_id = neighbour_id group by all"""


@query("r5_neighbour_records", f"with {NEAR}, {pass_sql('labels', 'one')} {RECORDS.format(knn='knn', after='one')}")
def r5(t):
    found, original = neighbours(t), labels(t)
    records = r.neighbour_records(found, original, r.one_pass(found, original, MIN_SIM))
    return shown_records(records)


@query("p12_int_ids", f"with {CLUSTERS} select param, sector_id, org_id from text_sectors")
def p12(t):
    return r.int_ids(clusters(t).withColumn("org_id", F.col("org_id").cast("string")))


@query(
    "a17_smallest_params",
    f"""with {CLUSTERS} select param, sector_id, org_id from text_sectors
    semi join (select param from text_sectors group by param
      qualify rank() over (order by count(*)) = 1) using (param)""",
)
def a17(t):
    return r.smallest_params(clusters(t))


ALL = f"""{THREE}, {REST.replace(NEAR + ', ', '')},
rest_label as (select param, query_id as org_id, case when mean_sim >= {MIN_SIM} then label end as label from rest_best),
in_records as ({RECORDS.format(knn='knn', after='three')}),
out_records as ({RECORDS.format(knn='rest', after='three')}),
in_means as (select param, query_id as org_id, string_agg(label, '|' order by label) as agg_sectors,
  string_agg({MILLIONTHS.format('mean_sim')}, '|' order by label) as agg_sims from three_m group by all),
out_means as (select param, query_id as org_id, string_agg(label, '|' order by label) as agg_sectors,
  string_agg({MILLIONTHS.format('mean_sim')}, '|' order by label) as agg_sims from rest_m group by all),
result as (
  select param, true as clustered, org_id, a.label as original_text_sector, b.label as assigned_text_sector,
    knn_org_ids, knn_original_text_sectors, knn_assigned_text_sectors, knn_sims, agg_sectors, agg_sims
  from in_records join labels a using (param, org_id) join three b using (param, org_id) join in_means using (param, org_id)
  union all
  select param, false, org_id, null, b.label, knn_org_ids, knn_original_text_sectors, knn_assigned_text_sectors, knn_sims, agg_sectors, agg_sims
  from out_records join rest_label b using (param, org_id) join out_means using (param, org_id))"""


def reassigned(t: Tables) -> tuple[DataFrame, DataFrame]:
    return reassign_orgs(clusters(t), vectors(t), K, MIN_SIM, n_iter=3, epsilon=0.0)


@query("t10_reassign_until_settled", f"with {ALL.replace(THREE, STOPPED)} select * from result")
def t10_settled(t):
    return shown_records(reassign_orgs(clusters(t), vectors(t), K, MIN_SIM, n_iter=PASSES, epsilon=STOP)[0])


@query("t10_reassign_orgs", f"with {ALL} select * from result")
def t10(t):
    return shown_records(reassigned(t)[0])


@query(
    "t10_entropy",
    f"""with {THREE}, before as ({entropy_sql('labels')}), after as ({entropy_sql('three')})
    select param, org_id, before.entropy as entropy_before, after.entropy as entropy_after
    from before join after using (param, org_id)""",
)
def t10_entropy(t):
    return reassigned(t)[1]


GETTERS = (
    (store.org_ids, "org_ids", ""),
    (store.original_text_sector, "original_text_sector", ", original_text_sector"),
    (store.assigned_text_sector, "assigned_text_sector", ", assigned_text_sector"),
    (store.knn_org_ids, "knn_org_ids", ", knn_org_ids"),
    (store.knn_original_text_sectors, "knn_original_text_sectors", ", knn_original_text_sectors"),
    (store.knn_assigned_text_sectors, "knn_assigned_text_sectors", ", knn_assigned_text_sectors"),
    (store.knn_sims, "knn_sims", ", knn_sims"),
    (store.knn_sector_means, "knn_sector_means", ", agg_sectors, agg_sims"),
)


def stored_table(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "reassigned")
    store.save_table(reassigned(t)[0], path, ["clustered"])
    return store.load_table(t.spark, path)


def _getter(getter, name, columns):
    sql = " union all ".join(f"select param, org_id, {flag} as clustered{columns} from result where clustered = {flag}" for flag in ("true", "false"))

    @query(f"s13_{name}", f"with {ALL} {sql}")
    def read(t):
        table = stored_table(t)
        parts = [getter(table, flag).withColumn("clustered", F.lit(flag)) for flag in (True, False)]
        return shown_records(parts[0].unionByName(parts[1]))


for _entry in GETTERS:
    _getter(*_entry)


# Embedding of documents and its checks.

DIM, HASHES, SEED = 64, 4, 100
NUMBER = "('0x' || substr(h, {}, {}))::bigint"
EMBEDDED = f"""{CORPUS}, tf as (
  select org_id, token, count(*) as tf from (select org_id, unnest(tokens) as token from corpus) group by all),
df as (select token, count(*) as df, md5('{SEED}:' || token) as h from tf group by token),
n as (select count(*) as n_docs from corpus),
places as ({' union all '.join(
    f"select token, ln((1 + n_docs) / (1 + df)) + 1 as idf, {NUMBER.format(8 * i + 1, 7)} % {DIM} as place, "
    f"case when {NUMBER.format(8 * i + 8, 1)} % 2 = 0 then 1 else -1 end as sign from df, n" for i in range(HASHES))}),
cells as (select org_id, place, sum(tf * idf * sign) as v from tf join places using (token) group by all),
embedded as (select org_id, place, v / sqrt(sum(v * v) over (partition by org_id)) as v from cells)"""


@query(
    "t5_embed_tokens",
    f"""with {EMBEDDED} select c.org_id, p::int as place, round(coalesce(v, 0)::float::double, 4) + 0 as value
    from corpus c cross join range({DIM}) r(p) left join embedded e on e.org_id = c.org_id and place = p""",
)
def t5(t):
    embedded = em.embed_tokens(corpus(t), DIM, HASHES, SEED)
    placed = embedded.select("org_id", F.posexplode("embedding").alias("place", "v"))
    return placed.select("org_id", "place", (F.round(F.col("v").cast("double"), 4) + 0.0).alias("value"))


@query("t5_learned_embedding")
def t5_learned(t):
    placed = em.learned_embedding(corpus(t), DIM, SEED).select("org_id", F.posexplode("embedding").alias("place", "v"))
    return placed.select("org_id", "place", (F.round(F.col("v").cast("double"), 4) + 0.0).alias("value"))


LENGTHS = f"lengths as (select len(regexp_extract_all(text, '{x.LENGTH_PATTERN}'))::int as length from documents)"


def text_lengths(t: Tables) -> DataFrame:
    return t.documents.select(x.token_count("text").alias("length"))


@query(
    "a15_percentile_rank",
    f"""with {LENGTHS}, c as (select count(*) filter (length < 512) as l, count(*) filter (length <= 512) as r, count(*) as n from lengths)
    select (l + r + (r > l)::int) * 50.0::double / n as percentile from c""",
)
def a15(t):
    return ln.percentile_rank(text_lengths(t), "length", 512)


def histogram_sql(bins: str) -> str:
    return f"""b as (select min(length) as lo, max(length) as hi, count(*) as total, {bins} as bins from lengths),
w as (select *, (hi - lo) / bins as width from b),
h as (select least(floor((length - lo) / width), bins - 1)::bigint as bin, lo, width, total, count(*) as n
      from lengths, w group by all)
select bin, lo + (bin + 1) * width as upper, n, sum(n) over (order by bin) / total as cumulative from h"""


@query("a16_cumulative_histogram", f"with {LENGTHS}, {histogram_sql('max(length)')}")
def a16(t):
    return ln.cumulative_histogram(text_lengths(t), "length")


@query("l1_first_rows", "select doc_id, n_chars from documents order by doc_id limit 100")
def l1(t):
    return s.first_rows(t.documents.select("doc_id", "n_chars"), ["doc_id"], 100)


@query("l4_sample_exact", f"select doc_id, lang from documents order by md5('{SEED}:' || doc_id), doc_id limit 100")
def l4(t):
    return s.sample_exact(t.documents.select("doc_id", "lang"), 100, "doc_id", SEED)


# Two models: the vectors as they are, and halved and turned around.


def two_models(t: Tables) -> DataFrame:
    described = t.embeddings.select(
        F.col("vec_id").alias("org_id"), F.concat(F.lit("label "), "label").alias("description"), "embedding"
    )
    second = described.withColumn(
        "embedding", F.transform(F.reverse("embedding"), lambda v: (v * (F.col("org_id") % 7 + 1)).cast("float"))
    )
    return described.withColumn("model_name", F.lit("plain")).unionByName(second.withColumn("model_name", F.lit("scaled")))


MODELS = """models as (
  select 'plain' as model_name, vec_id as org_id, 'label ' || label as description, embedding::double[] as v from embeddings
  union all select 'scaled', vec_id, 'label ' || label,
    list_transform(list_reverse(embedding), lambda e: (e * (vec_id % 7 + 1))::float::double) from embeddings)"""


@query(
    "j15_sample_neighbours",
    f"""with {MODELS}, sampled as (
      select vec_id as org_id from embeddings order by md5('{SEED}:' || vec_id), vec_id limit 100),
    hits as (select a.org_id, a.description, a.model_name, b.org_id as nn_id, b.description as nn_description,
        round(list_dot_product(a.v, b.v), 9) as score
      from models a semi join sampled using (org_id) join models b on a.model_name = b.model_name and a.org_id <> b.org_id)
    select org_id, description, model_name, nn_id, nn_description, round(score, 6) as score from hits
    qualify row_number() over (partition by model_name, org_id order by hits.score desc, nn_id) = 1""",
)
def j15(t):
    return em.sample_neighbours(two_models(t), 100, seed=SEED).withColumn("score", F.round("score", 6))


@query(
    "s14_embeddings_of",
    f"select vec_id as org_id, 'label ' || label as description, {CELLS} from (select *, embedding::double[] as v from embeddings)",
)
def s14_embeddings(t):
    path = scratch_path(t.spark, "embedded")
    store.save_table(two_models(t), path, ["model_name"])
    found = store.embeddings_of(store.load_table(t.spark, path), "plain")
    return cells(found, "org_id", "description")


@query("s14_encoder_names", f"with {MODELS} select distinct model_name from models")
def s14_names(t):
    return store.encoder_names(two_models(t))


SAMPLED = f"""lengths as (
  select len(regexp_extract_all(text, '{x.LENGTH_PATTERN}'))::int as length
  from (select text from documents order by md5('{SEED}:' || doc_id), doc_id limit 150))"""


def described(t: Tables) -> DataFrame:
    return t.documents.select(F.col("doc_id").alias("org_id"), F.col("text").alias("description"))


@query(
    "t11_percent_not_truncated",
    f"""with {SAMPLED}, c as (select count(*) filter (length < 512) as l, count(*) filter (length <= 512) as r, count(*) as n from lengths)
    select (l + r + (r > l)::int) * 50.0::double / n as percentile from c""",
)
def t11_percent(t):
    return em.length_report(described(t), 512, 150, seed=SEED)[0]


@query("t11_length_histogram", f"with {SAMPLED}, {histogram_sql('max(length)')}")
def t11_histogram(t):
    return em.length_report(described(t), 512, 150, seed=SEED)[1]
