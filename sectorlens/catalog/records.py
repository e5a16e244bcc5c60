"""Register records: dating, linking, matching keys, snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sectorlens.catalog.registry import Tables, query
from sectorlens.functions.dates import day_first_date
from sectorlens.operators import matching, records
from sectorlens.operators.ranking import latest_per_key
from sectorlens.sources import publish, snapshots, store
from sectorlens.session import scratch_path

# Line items stand in for dated link rows and for scored name pairs.


def dated_links(t: Tables) -> DataFrame:
    return t.lineitem.select(
        F.col("l_orderkey").alias("org_id"),
        F.col("l_linenumber").alias("rank"),
        F.when(F.col("l_returnflag") != "R", F.col("l_shipdate").cast("date")).alias("date"),
        "l_partkey",
        "l_suppkey",
    )


LINKS = """links as (
  select l_orderkey as org_id, l_linenumber as rank,
         case when l_returnflag <> 'R' then l_shipdate::date end as date, l_partkey, l_suppkey
  from lineitem)"""


@query(
    "w1_latest_per_key",
    f"""with {LINKS}
    select org_id, rank, date, l_partkey, l_suppkey from links
    qualify row_number() over (partition by org_id, rank order by date desc nulls last, l_partkey, l_suppkey) = 1""",
)
def w1(t):
    return latest_per_key(dated_links(t), ["org_id", "rank"], "date", tie=["l_partkey", "l_suppkey"])


@query(
    "w1_org_descriptions",
    f"""with {LINKS}, d as (
      select org_id, date, 'makes part ' || l_partkey || ' for ' || l_suppkey as description from links)
    select org_id, description from d
    qualify row_number() over (partition by org_id order by date desc nulls last, description) = 1""",
)
def w1_descriptions(t):
    described = dated_links(t).select(
        "org_id",
        "date",
        F.concat(F.lit("makes part "), "l_partkey", F.lit(" for "), "l_suppkey").alias("description"),
    )
    return records.org_descriptions(described)


def register_sector_rows(t: Tables) -> DataFrame:
    return dated_links(t).select(
        F.col("l_partkey").cast("string").alias("company_number"),
        "rank",
        F.lpad(F.col("l_suppkey").cast("string"), 5, "1").alias("sector_id"),
        "date",
    )


SECTORS = f"""{LINKS}, sectors as (
  select l_partkey::varchar as company_number, rank,
         lpad(l_suppkey::varchar, 5, '1') as sic5, date from links
  qualify row_number() over (
    partition by l_partkey, rank order by date desc nulls first, lpad(l_suppkey::varchar, 5, '1')) = 1)"""


@query("w2_register_sectors", f"with {SECTORS} select company_number, sic5, rank from sectors")
def w2(t):
    return records.register_sectors(register_sector_rows(t))


def scored_pairs(t: Tables) -> DataFrame:
    return t.lineitem.select(
        F.col("l_partkey").alias("x"),
        F.col("l_orderkey").alias("y"),
        F.round(F.col("l_discount") * 1000).alias("sim_mean"),
    )


PAIRS = """pairs as (
  select l_partkey as x, l_orderkey as y, round(l_discount * 1000) as sim_mean from lineitem)"""
BEST = f"""{PAIRS}, best as (
  select x, y, sim_mean from pairs
  qualify row_number() over (partition by y order by sim_mean desc, x) = 1)"""


@query("w5_best_match", f"with {BEST} select x, y, sim_mean from best")
def w5(t):
    return matching.best_matches(scored_pairs(t))


@query("s4_persisted_pairs", f"with {PAIRS} select x, y, sim_mean from pairs")
def s4(t):
    return store.persist_pairs(scored_pairs(t), scratch_path(t.spark, "pairs"))


def org_names(t: Tables) -> DataFrame:
    return t.orders.select(
        F.col("o_orderkey").alias("y"), F.col("o_orderkey").alias("org_id"), F.col("o_orderpriority").alias("org_name")
    )


def company_names(t: Tables) -> DataFrame:
    return t.part.select(
        F.col("p_partkey").alias("x"),
        F.col("p_partkey").cast("string").alias("company_number"),
        F.col("p_name").alias("company_name"),
    )


def named_matches(t: Tables) -> DataFrame:
    return matching.attach_names(matching.best_matches(scored_pairs(t)), company_names(t), org_names(t))


MATCHES = f"""{BEST}, matches as (
  select sim_mean, o_orderkey as org_id, o_orderpriority as org_name,
         p_partkey::varchar as company_number, p_name as company_name
  from best join orders on y = o_orderkey join part on x = p_partkey)"""


@query("j4_attach_names", f"with {MATCHES} select * from matches")
def j4(t):
    return named_matches(t)


@query("s14_matches_of", f"with {MATCHES} select * from matches")
def s14_matches(t):
    path = scratch_path(t.spark, "matches")
    store.save_table(named_matches(t), path)
    return store.matches_of(store.load_table(t.spark, path))


ACCEPTED = f"""{MATCHES}, accepted as (
  select org_id, company_number from matches where sim_mean >= 80)"""


@query("p8_accept_matches", f"with {ACCEPTED} select * from accepted")
def p8(t):
    return records.accept_matches(named_matches(t))


INVERTED = f"""{ACCEPTED}, inverted as (
  select company_number, max(org_id) as org_id from accepted group by company_number)"""


@query("j5_company_to_org", f"with {INVERTED} select * from inverted")
def j5(t):
    return records.company_to_org(records.accept_matches(named_matches(t)))


@query(
    "p9_first_ranked_sector",
    f"""with {SECTORS} select company_number, left(sic5, length(sic5) - 1) as sic4
    from sectors where rank = 1""",
)
def p9(t):
    own = register_sector_rows(t).select(F.col("company_number"), F.col("company_number").alias("org_id")).distinct()
    return records.sic4_of_orgs(records.register_sectors(register_sector_rows(t)), own).withColumnRenamed(
        "org_id", "company_number"
    )


def sic4(t: Tables) -> DataFrame:
    return records.sic4_of_orgs(
        records.register_sectors(register_sector_rows(t)), records.accept_matches(named_matches(t))
    )


@query(
    "t13_sic4_of_orgs",
    f"""with {SECTORS}, {INVERTED.replace('with ', '')}
    select org_id, left(sic5, length(sic5) - 1) as sic4
    from sectors join inverted using (company_number) where rank = 1""",
)
def t13(t):
    return sic4(t)


# Links to dimensions.


@query(
    "j1_org_addresses",
    f"""with {LINKS}
    select org_id, p_name as address_text, p_brand as postcode, rank
    from links join part on l_partkey = p_partkey
    qualify row_number() over (partition by org_id, rank order by date desc nulls last, p_name, p_brand) = 1""",
)
def j1(t):
    links = dated_links(t).select("org_id", F.col("l_partkey").alias("address_id"), "rank", "date")
    addresses = t.part.select(
        F.col("p_partkey").alias("address_id"),
        F.col("p_name").alias("address_text"),
        F.col("p_brand").alias("postcode"),
    )
    return records.org_addresses(links, addresses)


@query(
    "j2_org_sectors",
    f"""with {LINKS}
    select org_id, s_name as sector_name, rank
    from links join supplier on l_suppkey = s_suppkey
    qualify row_number() over (partition by org_id, rank order by date desc nulls last, s_name) = 1""",
)
def j2(t):
    links = dated_links(t).select("org_id", F.col("l_suppkey").alias("sector_id"), "rank", "date")
    sectors = t.supplier.select(F.col("s_suppkey").alias("sector_id"), F.col("s_name").alias("sector_name"))
    return records.org_sectors(links, sectors)


# Dates and projections.

DATE_TEXT = """case o_orderstatus when 'O' then strftime(o_orderdate, '%d/%m/%Y')
  when 'F' then strftime(o_orderdate, '%Y-%m-%d') else 'not ' || o_orderpriority end"""


def dated_text(column: str = "o_orderdate"):
    return (
        F.when(F.col("o_orderstatus") == "O", F.date_format(column, "dd/MM/yyyy"))
        .when(F.col("o_orderstatus") == "F", F.date_format(column, "yyyy-MM-dd"))
        .otherwise(F.concat(F.lit("not "), "o_orderpriority"))
    )


@query(
    "p5_day_first_date",
    f"""with d as (select o_orderkey, {DATE_TEXT} as text from orders)
    select o_orderkey, text, coalesce(try_strptime(text, '%d/%m/%Y'), try_strptime(text, '%Y-%m-%d'))::date as date
    from d""",
)
def p5(t):
    return t.orders.select("o_orderkey", dated_text().alias("text")).withColumn("date", day_first_date("text"))


@query(
    "p4_register_organisations",
    """select o_orderkey::varchar as company_number, o_orderpriority as category, o_orderstatus as status,
      'GB' as country_of_origin,
      case when o_orderstatus in ('O', 'F') then o_orderdate::date end as dissolution_date,
      o_orderdate::date as incorporation_date
    from orders""",
)
def p4(t):
    return records.register_organisations(
        t.orders.select(
            F.col("o_orderkey").alias("company_number"),
            F.col("o_orderpriority").alias("category"),
            F.col("o_orderstatus").alias("status"),
            F.lit("GB").alias("country_of_origin"),
            dated_text().alias("dissolution_date"),
            F.date_format("o_orderdate", "d/M/yyyy").alias("incorporation_date"),
            F.concat(F.lit("uri:"), "o_orderkey").alias("uri"),
        )
    )


@query(
    "p6_register_names",
    """select o_custkey::varchar as company_number,
      (row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) - 1)::int as name_age_index,
      o_orderpriority as name,
      case when o_orderstatus in ('O', 'F') then o_orderdate::date end as invalid_date
    from orders""",
)
def p6(t):
    from pyspark.sql import Window as W

    age = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")) - 1
    return records.register_names(
        t.orders.select(
            F.col("o_custkey").alias("company_number"),
            age.alias("name_age_index"),
            F.col("o_orderpriority").alias("name"),
            dated_text().alias("invalid_date"),
        )
    )


@query(
    "p7_org_profiles",
    """select c_custkey as org_id, c_name as name, 'http://' || lower(c_mktsegment) || '.example' as website
    from customer""",
)
def p7(t):
    return records.org_profiles(
        t.customer.select(
            F.col("c_custkey").alias("org_id"),
            F.col("c_name").alias("name"),
            F.concat(F.lit("http://"), F.lower("c_mktsegment"), F.lit(".example")).alias("website"),
            (F.col("c_acctbal") > 0).alias("active"),
        )
    )


# Runs.


def runs(t: Tables) -> DataFrame:
    return t.orders.select(
        F.col("o_orderpriority").alias("flow_name"),
        F.col("o_orderkey").alias("run_id"),
        F.when(F.col("o_orderstatus") == "O", "prod").otherwise("user").alias("branch"),
        (F.col("o_totalprice") > 100000).alias("successful"),
        F.col("o_orderdate").cast("date").alias("finished_at"),
        F.when(F.col("o_totalprice") < 300000, F.concat(F.lit("model-"), F.year("o_orderdate"))).alias("model_name"),
    )


RUNS = """runs as (
  select o_orderpriority as flow_name, o_orderkey as run_id,
    case when o_orderstatus = 'O' then 'prod' else 'user' end as branch, o_totalprice > 100000 as successful,
    o_orderdate::date as finished_at,
    case when o_totalprice < 300000 then 'model-' || year(o_orderdate) end as model_name
  from orders)"""


@query(
    "s5_latest_snapshot",
    f"""with {RUNS} select flow_name, run_id, finished_at from runs
    where flow_name = '1-URGENT' and branch = 'prod' and successful
    order by finished_at desc, run_id desc limit 1""",
)
def s5(t):
    return snapshots.latest_snapshot(runs(t), "1-URGENT")


@query(
    "s6_latest_snapshot_per_model",
    f"""with {RUNS} select model_name, run_id, finished_at from runs
    where flow_name = '1-URGENT' and branch = 'prod' and successful and model_name is not null
    qualify row_number() over (partition by model_name order by finished_at desc, run_id desc) = 1""",
)
def s6(t):
    return snapshots.latest_snapshot_per_model(runs(t), "1-URGENT")


@query(
    "s7_read_pinned",
    """select l_orderkey as org_id, l_partkey, l_linenumber::bigint as run_id from lineitem where l_linenumber = 3""",
)
def s7(t):
    path = scratch_path(t.spark, "runs")
    table = t.lineitem.select(
        F.col("l_orderkey").alias("org_id"), "l_partkey", F.col("l_linenumber").cast("long").alias("run_id")
    )
    store.save_table(table, path, ["run_id"])
    known = table.select(F.lit("links").alias("flow_name"), "run_id", F.lit(True).alias("successful")).distinct()
    return snapshots.read_pinned(t.spark, path, known, "links", 3).select(
        "org_id", "l_partkey", F.col("run_id").cast("long").alias("run_id")
    )


# Runs published as a whole, one of them on another branch.


def published(t: Tables) -> str:
    root = scratch_path(t.spark, "runs")
    names = t.customer.select(F.col("c_custkey").alias("x"), F.col("c_name").alias("name"))
    for run, branch in ((1, "prod"), (2, "prod"), (3, "test")):
        tables = {"names": names.withColumn("run", F.lit(run)), "sizes": names.groupBy().agg(F.count("*").alias("n"))}
        publish.publish(t.spark, root, "match", run, tables, branch)
    return root


@query("s5_published_latest", "select c_custkey as x, c_name as name, 2 as run from customer")
def s5_published_latest(t):
    return publish.read_published(t.spark, published(t), "match", "names")


@query("s7_published_pinned", "select c_custkey as x, c_name as name, 1 as run from customer")
def s7_published_pinned(t):
    return publish.read_published(t.spark, published(t), "match", "names", run_id=1)
