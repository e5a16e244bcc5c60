"""Entities by the sequence model: learned from and applied to sentences of suppliers, nations and regions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sectorlens.catalog.registry import Tables, query
from sectorlens.operators import recogniser as rec

# One sentence per supplier: tokens of letters and of digits, region and nation names as the known ones.

NAMES = """traded as (
  select s_suppkey as org_id, 'Traders of ' || n_name || ' and all ' || r_name || ' with ' || s_name as description, n_name, r_name
  from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
names as (
  select token, min(kind) as kind from (
    select regexp_extract_all(r_name, '[A-Z]+')[1] as token, 'LOC' as kind from region
    union all select regexp_extract_all(n_name, '[A-Z]+')[1], 'GPE' from nation) group by token)"""


def sentences(t: Tables) -> DataFrame:
    areas = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    placed = t.supplier.join(areas, F.col("s_nationkey") == F.col("n_nationkey"))
    text = F.concat(F.lit("Traders of "), "n_name", F.lit(" and all "), "r_name", F.lit(" with "), "s_name")
    return rec.sentences(placed.select(F.col("s_suppkey").alias("org_id"), text.alias("description")))


def tagged(t: Tables) -> DataFrame:
    def first(name: str):
        return F.array(F.regexp_extract(name, "[A-Z]+", 0)).alias("tokens")

    names = t.region.select(first("r_name"), F.lit("LOC").alias("kind")).union(t.nation.select(first("n_name"), F.lit("GPE")))
    return rec.tag_names(sentences(t), names)


TAGGED = f"""{NAMES}, tok as (
  select org_id, i as pos, i = 1 as first, w[i] as token, coalesce(kind, '{rec.OUTSIDE}') as tag from (
    select org_id, w, unnest(range(1, len(w) + 1)) as i from (select org_id, regexp_extract_all(description, '{rec.TOKEN}') as w from traded))
  left join names on token = w[i]),
moves as (
  select before, tag, count(*) as n from (
    select coalesce(lag(tag) over (partition by org_id order by pos), '{rec.BEGIN}') as before, tag from tok) group by all),
formed as (
  select *, concat_ws('|', case when upper(token) = lower(token) then case when regexp_matches(token, '^\\p{{N}}') then '9' else '.' end
      when token = upper(token) and length(token) > 1 then 'XX' when left(token, 1) <> left(lower(token), 1) then 'Xx' else 'x' end,
    case when upper(token) = lower(token) then '' else right(lower(token), {rec.ENDING}) end, case when first then '1' else '0' end) as form
  from tok),
emits as (
  select token as symbol, true as whole, tag, count(*) as n from formed where token in (select token from tok group by token having count(*) >= {rec.LEAST}) group by all
  union all select form, false, tag, count(*) from (select distinct token, tag, first, form from formed) group by all)"""


@query("f3_transition_counts", f"with {TAGGED} select before, tag, n from moves")
def f3_transition_counts(t):
    return rec.transition_counts(tagged(t))


@query("f3_emission_counts", f"with {TAGGED} select symbol, whole, tag, n from emits")
def f3_emission_counts(t):
    return rec.emission_counts(tagged(t))


S = rec.SMOOTH

DECODED = f"""{TAGGED}, tags as (select list(distinct tag order by tag) as tags from moves),
froms as (select before, list_transform(tags, lambda t: ln((coalesce(m[t], 0) + {S}) / (total + {S} * len(tags)))) as logs
  from (select before, map_from_entries(list({{'k': tag, 'v': n}})) as m, sum(n) as total from moves group by before), tags),
model as (select tags, (select logs from froms where before = '{rec.BEGIN}') as begin,
  (select list(logs order by before) from froms where before <> '{rec.BEGIN}') as moves from tags),
totals as (select whole, map_from_entries(list({{'k': tag, 'v': {{'total': total, 'kinds': kinds}}}})) as t
  from (select whole, tag, sum(n) as total, count(*) as kinds from emits group by all) group by whole),
symbols as (
  select symbol, whole, list_transform(tags, lambda g: ln((coalesce(m[g], 0) + {S}) / (coalesce(t[g].total, 0) + {S} * (coalesce(t[g].kinds, 0) + 1)))) as logs
  from (select symbol, whole, map_from_entries(list({{'k': tag, 'v': n}})) as m from emits group by all) join totals using (whole), tags),
heard as (
  select org_id, pos, token, coalesce(a.logs, b.logs) as logs
  from formed left join symbols a on a.whole and a.symbol = token left join symbols b on not b.whole and b.symbol = form),
walk(org_id, pos, scores, paths) as (
  select org_id, pos, list_transform(range(1, len(tags) + 1), lambda t: round(begin[t], 9) + logs[t]), list_transform(range(1, len(tags) + 1), lambda t: [t])
  from heard, model where pos = 1
  union all
  select org_id, pos, list_transform(range(1, len(best) + 1), lambda t: best[t].score + logs[t]),
    list_transform(range(1, len(best) + 1), lambda t: list_append(paths[-best[t].b], t))
  from (
    select h.org_id, h.pos, h.logs, w.paths, list_transform(range(1, len(tags) + 1), lambda t: list_max(
      list_transform(range(1, len(tags) + 1), lambda b: {{'score': round(w.scores[b] + moves[b][t], 9), 'b': -b}}))) as best
    from walk w join heard h on h.org_id = w.org_id and h.pos = w.pos + 1, model))"""


@query(
    "f3_recognise",
    f"""with recursive {DECODED}, ends as (
      select org_id, paths[-list_max(list_transform(range(1, len(scores) + 1), lambda t: {{'s': round(scores[t], 9), 't': -t}})).t] as path
      from walk qualify row_number() over (partition by org_id order by pos desc) = 1),
    words as (select org_id, list(token order by pos) as w from tok group by org_id)
    select org_id, array_to_string(w, ' ') as tokens, array_to_string(list_transform(path, lambda p: tags[p]), ' ') as tags
    from ends join words using (org_id), model""",
)
def f3_recognise(t):
    model, symbols = rec.learn(tagged(t))
    return rec.recognise(sentences(t), model, symbols).select("org_id", F.array_join("tokens", " ").alias("tokens"), F.array_join("tags", " ").alias("tags"))
