"""Name matching of customers (company register) and suppliers (organisations)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sectorlens.catalog.registry import Tables, query
from sectorlens.functions import names as n
from sectorlens.operators import matching as m
from sectorlens.plans.name_matching import match_names

BLOCK = 50
HOT_PAIRS = 20000
K = 10

FORMS_SQL = ", ".join(f"'{w}'" for w in n.LEGAL_FORMS)


def clean_sql(column: str) -> str:
    words = f"string_split(trim(regexp_replace(lower({column}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ')"
    kept = f"list_filter({words}, lambda w: w not in ({FORMS_SQL}))"
    return f"array_to_string(case when len({kept}) > 0 then {kept} else {words} end, ' ')"


def shingle_sql(name: str) -> str:
    return (
        f"list_distinct(list_transform(range(1, greatest(length({name}) - 2, 1) + 1), "
        f"lambda i: substr({name}, i::int, 3)))"
    )


SIDES = f"""xs as (
  select {clean_sql("c_name || case when c_acctbal > 5000 then ' Ltd.' else '' end")} as name, min(c_custkey) as x
  from customer group by 1),
ys as (
  select {clean_sql("s_name || ' (' || s_nationkey || ')'")} as name, min(s_suppkey) as y from supplier group by 1)"""


def companies(t: Tables):
    suffix = F.when(F.col("c_acctbal") > 5000, " Ltd.").otherwise("")
    return t.customer.select(F.col("c_custkey").alias("x"), F.concat("c_name", suffix).alias("name"))


def orgs(t: Tables):
    return t.supplier.select(
        F.col("s_suppkey").alias("y"), F.concat("s_name", F.lit(" ("), "s_nationkey", F.lit(")")).alias("name")
    )


def sides(t: Tables):
    return m.distinct_names(m.cleaned(companies(t), "x")), m.distinct_names(m.cleaned(orgs(t), "y"))


@query("f5_clean_names", f"""select c_custkey as id, {clean_sql("c_name || case when c_acctbal > 5000 then ' Ltd.' else '' end")} as name from customer""")
def f5(t):
    return m.cleaned(companies(t), "x")


# Minhash bands. The SQL compares the minhashes themselves instead of their hash.

PERM_SQL = "[" + ", ".join(f"{{'a': {a}::bigint, 'b': {b}::bigint}}" for a, b in n.permutations(64)) + "]"


def lsh_sql() -> str:
    parts = []
    for side in ("x", "y"):
        parts.append(f"""s{side} as (
          select {side}, list_transform({PERM_SQL}, lambda s: list_min(list_transform(h, lambda v: (v * s.a + s.b) % {n.PRIME}))) as sig
          from (select {side}, list_transform({shingle_sql('name')}, lambda s: ('0x' || substr(md5(s), 1, 8))::bigint % {n.PRIME}) as h from {side}s)),
        b{side} as (
          select {side}, band, array_to_string(list_slice(sig, band * 4 + 1, band * 4 + 4), ',') as key from s{side}, range(16) r(band))""")
    return ",\n".join([*parts, "lsh as (select distinct x, y from bx join b_y using (band, key))".replace("b_y", "by_")]).replace("by as (", "by_ as (")


@query("j10_lsh_candidates", f"with {SIDES}, {lsh_sql()} select x, y from lsh")
def j10(t):
    return m.lsh_candidates(*sides(t), block=BLOCK)


# Cosine: the SQL scores every pair that shares a word.

VECTOR_SQL = """words as (
  select 'x' as side, x as id, unnest(string_split(name, ' ')) as term from xs
  union all select 'y', y, unnest(string_split(name, ' ')) from ys),
tf as (select side, id, term, count(*) as tf from words group by all),
df as (select term, count(*) as df from tf group by term),
total as (select (select count(*) from xs) + (select count(*) from ys) as n),
raw as (select side, id, term, tf * (ln((1 + n) / (1 + df)) + 1) as w from tf join df using (term), total),
vec as (select *, sqrt(sum(w * w) over (partition by side, id)) as norm from raw),
cos as (
  select a.id as x, b.id as y, round(sum(a.w * b.w) / (any_value(a.norm) * any_value(b.norm)), 9) as cosine
  from vec a join vec b on a.term = b.term and a.side = 'x' and b.side = 'y' group by all)"""
TOP_SQL = f"""{VECTOR_SQL}, top as (
  select x, y, cosine from cos qualify row_number() over (partition by y order by cosine desc, x) <= {K})"""


@query("j11_cosine_candidates", f"with {SIDES}, {TOP_SQL} select x, y, cosine from top")
def j11(t):
    return m.cosine_candidates(m.tfidf_vectors(*sides(t), hot_pairs=HOT_PAIRS), K)


UNION_SQL = f"""{lsh_sql()}, {TOP_SQL}, pairs as (select x, y from lsh union select x, y from top)"""


def candidates(t: Tables, min_score: float):
    left, right = sides(t)
    vectors = m.tfidf_vectors(left, right, hot_pairs=HOT_PAIRS)
    return m.union_candidates(
        m.lsh_candidates(left, right, min_score=min_score, block=BLOCK, vectors=vectors), m.cosine_candidates(vectors, K)
    ), vectors


def all_candidates(t: Tables):
    left, right = sides(t)
    vectors = m.tfidf_vectors(left, right, hot_pairs=HOT_PAIRS)
    return *m.union_of_all(left, right, vectors, K, block=BLOCK), vectors


@query("u4_union_candidates", f"with {SIDES}, {UNION_SQL} select x, y from pairs")
def u4(t):
    pairs, others, _ = all_candidates(t)
    pairs = pairs.pairs()
    return pairs if others is None else pairs.unionByName(others)


SCORED_SQL = f"""{UNION_SQL}, three as (
  select p.x, p.y,
    100.0::double * len(list_intersect({shingle_sql('xs.name')}, {shingle_sql('ys.name')}))
      / len(list_distinct(list_concat({shingle_sql('xs.name')}, {shingle_sql('ys.name')}))) as jaccard,
    100.0::double * (1 - levenshtein(xs.name, ys.name)::double / greatest(length(xs.name), length(ys.name))) as levenshtein,
    100 * coalesce(cosine, 0) as cosine
  from pairs p join xs on p.x = xs.x join ys on p.y = ys.y left join cos on cos.x = p.x and cos.y = p.y),
scored as (select *, round((jaccard + levenshtein + cosine) / 3, 6) as sim_mean from three)"""


for key, column in (("f6_jaccard", "jaccard"), ("f7_levenshtein", "levenshtein"), ("f8_cosine", "cosine")):
    query(key, f"with {SIDES}, {SCORED_SQL} select x, y, round({column}, 6) as {column} from scored")(
        lambda t, column=column: m.score_union(*all_candidates(t), scores=[column], digits=6)
    )


@query("f9_mean_score", f"with {SIDES}, {SCORED_SQL} select x, y, sim_mean from scored where sim_mean >= 50")
def f9(t):
    return m.score_pairs(*candidates(t, 50), min_score=50).select("x", "y", "sim_mean")


@query(
    "t4_match_names",
    f"""with {SIDES}, {SCORED_SQL}, best as (
      select x, y, sim_mean from scored where sim_mean >= 50
      qualify row_number() over (partition by y order by sim_mean desc, x) = 1)
    select sim_mean, s.s_suppkey as org_id, s_name || ' (' || s_nationkey || ')' as org_name, c_custkey as company_number,
        c_name || case when c_acctbal > 5000 then ' Ltd.' else '' end as company_name
      from best b join ys using (y) join customer on c_custkey = b.x
      join supplier s on {clean_sql("s_name || ' (' || s_nationkey || ')'")} = ys.name""",
)
def t4(t):
    named = companies(t).withColumnsRenamed({"x": "company_number", "name": "company_name"})
    return match_names(
        named, orgs(t).withColumnsRenamed({"y": "org_id", "name": "org_name"}), clean=True, top_k=K, hot_pairs=HOT_PAIRS
    )
