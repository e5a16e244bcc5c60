"""Legal forms of the companies' names, learned from the names."""

from __future__ import annotations

from sectorlens.catalog.names import companies
from sectorlens.catalog.registry import query
from sectorlens.operators import legal_forms as lf
from sectorlens.session import cut

NAMES = """named as (
  select c_custkey as x, list_filter(string_split(trim(regexp_replace(lower(c_name || case when c_acctbal > 5000 then ' Ltd.' else '' end),
    '[^\\p{L}\\p{N}]+', ' ', 'g')), ' '), lambda w: w <> '') as words from customer)"""


def ratios_sql(source: str, out: str) -> str:
    def part(k: str, row: str, column: str) -> str:
        return f"case when {k} > 0 then {k} * ln({k} * (names + others) / (({row}) * ({column}))) else 0 end"

    a, b, c, d = "n_last::double", "n_other::double", "(names - n_last)", "(others - n_other)"
    total = " + ".join(
        [part(a, "n_last + n_other", "names"), part(b, "n_last + n_other", "others"), part(c, f"{c} + {d}", "names"), part(d, f"{c} + {d}", "others")]
    )
    return f"""{out}_t as (select count(*)::double as names, sum(len(words) - 1)::double as others from {source} where len(words) > 1),
{out}_c as (
  select word, count(*) filter (last) as n_last, count(*) filter (not last) as n_other
  from (select unnest(words) as word, unnest(range(1, len(words) + 1)) = len(words) as last from {source} where len(words) > 1) group by word),
{out} as (
  select word, n_last, n_other, names, round(2 * ({total}) * case when n_last * others >= n_other * names then 1 else -1 end, 6) as ratio from {out}_c, {out}_t)"""


def forms_sql(ratios: str) -> str:
    return f"""select word from {ratios} where n_last >= {lf.LEAST_SHARE} * names and n_last > 1
      and n_last >= {lf.LEAST_LAST} * (n_last + n_other) and ratio >= {lf.LEAST_RATIO}"""


def strip_sql(source: str, forms: str) -> str:
    return f"""select x, case when last is null then words else words[:last] end as words from (
      select x, words, list_max(list_transform(words, lambda w, i: case when not list_contains(f, w) then i end)) as last
      from {source}, (select coalesce(list(word), []) as f from {forms}))"""


LEARNED = f"""{NAMES}, {ratios_sql('named', 'r1')}, f1 as ({forms_sql('r1')}), once as ({strip_sql('named', 'f1')}),
{ratios_sql('once', 'r2')}, forms as (select word from f1 union ({forms_sql('r2')}))"""


@query("f5_place_ratios", f"with {NAMES}, {ratios_sql('named', 'r1')} select word, n_last, n_other, round(ratio, 4) as ratio from r1")
def f5_place_ratios(t):
    words = companies(t).select(lf.name_words("name").alias("words"))
    return lf.place_ratios(words).selectExpr("word", "n_last", "n_other", "round(ratio, 4) as ratio")


@query("f5_learned_forms", f"with {LEARNED} select word from forms")
def f5_learned_forms(t):
    return lf.learn_forms(companies(t))


@query("f5_clean_by_learned_forms", f"with {LEARNED}, cleaned as ({strip_sql('named', 'forms')}) select x as id, array_to_string(words, ' ') as name from cleaned")
def f5_clean_by_learned_forms(t):
    names = cut(companies(t))
    return lf.clean_names(names, lf.learn_forms(names)).selectExpr("x as id", "name")
