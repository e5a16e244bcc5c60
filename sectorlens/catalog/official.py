"""Official statistics and the code hierarchy."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sectorlens.catalog.registry import Tables, query
from sectorlens.operators import official, outline
from sectorlens.plans.hierarchy import code_hierarchy
from sectorlens.session import cut, scratch_path
from sectorlens.sources import sheets

# The order years of the test tables, the last with a note in its header.
YEARS = [str(y) for y in range(1995, 2002)]
HEADERS = [*YEARS[:-1], f"{YEARS[-1]}\n[note 3]"]
ID_HEADERS = ["ITL1 Region", "LA code", "LA name"]


def yearly_sheet(t: Tables, measure: str) -> DataFrame:
    """Orders per nation and year as a wide sheet, with one footnote row per region."""
    value = {
        "gva": F.round(F.sum("o_totalprice") / 1e6, 4),
        "pop": F.count(F.lit(1)).cast("double"),
    }[measure]
    areas = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    wide = (
        t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .withColumn("year", F.year("o_orderdate"))
        .groupBy("c_nationkey")
        .pivot("year", [int(y) for y in YEARS])
        .agg(value)
    )
    rows = areas.join(wide, F.col("n_nationkey") == F.col("c_nationkey")).select(
        F.col("r_name").alias("ITL1 Region"),
        F.col("n_nationkey").cast("string").alias("LA code"),
        F.col("n_name").alias("LA name"),
        *[F.col(y).alias(h) for y, h in zip(YEARS, HEADERS)],
    )
    notes = t.region.select(
        F.concat(F.lit("Note "), "r_name").alias("ITL1 Region"),
        F.lit(None).cast("string").alias("LA code"),
        F.lit(None).cast("string").alias("LA name"),
        *[F.lit(None).cast("double").alias(h) for h in HEADERS],
    )
    return rows.unionByName(notes)


VALUE_SQL = {"gva": "round(sum(o_totalprice) / 1e6, 4)", "pop": "count(*)::double"}
LONG_SQL = {
    name: f"""{name}_long as (
      select r_name as nuts1_name, n_nationkey::varchar as la_code, n_name as la_name,
             year(o_orderdate)::int as year, {value} as {name}
      from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
           join region on n_regionkey = r_regionkey
      where year(o_orderdate) between 1995 and 2001 group by all)"""
    for name, value in VALUE_SQL.items()
}
FULL_SQL = {
    name: f"""{LONG_SQL[name]}, cells as (
      select distinct nuts1_name, la_code, la_name, y::int as year
      from {name}_long, range(1995, 2002) r(y))
    select c.nuts1_name, c.la_code, c.la_name, c.year, {name}
    from cells c left join {name}_long l on c.la_code = l.la_code and c.year = l.year"""
    for name in VALUE_SQL
}


@query(
    "p1_clean_yearly",
    f"""with {LONG_SQL['gva']}
    select nuts1_name as itl1_region, la_code, la_name,
      {', '.join(f'max(gva) filter (year = {y}) as "{y}"' for y in YEARS)}
    from gva_long group by all""",
)
def p1(t):
    return official.clean_yearly(yearly_sheet(t, "gva"))


@query("r1_melt_gva", f"with {FULL_SQL['gva']}")
def r1_gva(t):
    return official.melt_years(official.clean_yearly(yearly_sheet(t, "gva")), "gva")


@query("r1_melt_population", f"with {FULL_SQL['pop']}")
def r1_pop(t):
    return official.melt_years(official.clean_yearly(yearly_sheet(t, "pop")), "pop")


@query(
    "j3_ratio_per_head",
    f"""with {LONG_SQL['gva']}, {LONG_SQL['pop']}, cells as (
      select distinct nuts1_name, la_code, la_name, y::int as year from gva_long, range(1995, 2002) r(y))
    select c.nuts1_name, c.la_code, c.la_name, c.year, round_even(1e6 * gva / pop, 2) as gva_pc
    from cells c left join gva_long g on c.la_code = g.la_code and c.year = g.year
         left join pop_long p on c.la_code = p.la_code and c.year = p.year""",
)
def j3(t):
    gva, pop = (official.melt_years(official.clean_yearly(yearly_sheet(t, m)), m) for m in ("gva", "pop"))
    return official.ratio_per_head(gva, pop)


def write_csv(df: DataFrame, name: str, header: bool = False) -> str:
    path = scratch_path(df.sparkSession, name)
    df.write.option("header", header).csv(path)
    return path


@query("s2_read_yearly", f"""with {LONG_SQL['gva']} select nuts1_name as itl1_region, la_code, la_name,
      {', '.join(f'max(gva) filter (year = {y}) as "{y}"' for y in YEARS)}
    from gva_long group by all""")
def s2(t):
    sheet = yearly_sheet(t, "gva")
    numbered = sheet.select(
        F.coalesce(F.col("LA code").cast("long") + 2, F.lit(1000)).alias("row_no"),
        *[F.col(f"`{c}`").cast("string") for c in sheet.columns],
    )
    titles = t.region.where("r_regionkey < 2").select(
        F.col("r_regionkey").cast("long").alias("row_no"),
        *[F.lit(f"title {c}").alias(c) for c in sheet.columns],
    )
    path = write_csv(titles.unionByName(numbered), "yearly")
    return official.clean_yearly(sheets.read_yearly(t.spark, path, ID_HEADERS, HEADERS, skip_rows=2))


def population_sheet(t: Tables) -> DataFrame:
    return t.customer.select(
        (F.col("c_custkey") + 1).alias("row_no"),
        F.col("c_nationkey").cast("string").alias("Code"),
        F.round("c_acctbal").cast("long").alias("All ages"),
    )


@query("p3_clean_population", 'select c_nationkey::varchar as geo_code, round(c_acctbal)::bigint as pop_2020 from customer')
def p3(t):
    return official.clean_population(population_sheet(t).drop("row_no"))


@query(
    "s10_population_lookup",
    """select c_nationkey::varchar as geo_code, arg_max(round(c_acctbal)::bigint, c_custkey) as pop_2020
    from customer group by c_nationkey""",
)
def s10(t):
    header = t.region.where("r_regionkey = 0").select(
        F.lit(0).cast("long").alias("row_no"), F.lit("Code").alias("Code"), F.lit("All ages").alias("All ages")
    )
    rows = population_sheet(t).withColumn("All ages", F.col("All ages").cast("string"))
    path = write_csv(header.unionByName(rows), "population")
    read = sheets.read_population(t.spark, path, skip_rows=1)
    return sheets.population_lookup(official.clean_population(read))


# Indicators: events of two types stand in for two extracts.


def extract(t: Tables, monthly: bool) -> DataFrame:
    return t.events.select(
        F.date_format("ts", "yyyy-MM" if monthly else "yyyy").alias("DATE"),
        F.concat(F.lit("user "), "user_id").alias("GEOGRAPHY_NAME"),
        F.col("user_id").cast("string").alias("GEOGRAPHY_CODE"),
        F.col("props").alias("VARIABLE_NAME"),
        F.col("event_type").alias("MEASURES_NAME"),
        F.col("value").alias("OBS_VALUE"),
    )


INDICATOR_SQL = """select year(ts)::int as date, 'user ' || user_id as geography_name,
  user_id::varchar as geography_code, props as variable, value, '{source}' as source
  from events where event_type = '{kind}'"""


@query("p2_clean_indicator", INDICATOR_SQL.format(source="aps", kind="click"))
def p2(t):
    return official.clean_indicator(extract(t, True), {"MEASURES_NAME": "click"}, "VARIABLE_NAME", source="aps")


@query(
    "s3_read_indicators",
    """select strftime(ts, '%Y-%m') as "DATE", 'user ' || user_id as "GEOGRAPHY_NAME",
      user_id::varchar as "GEOGRAPHY_CODE", props as "VARIABLE_NAME", event_type as "MEASURES_NAME",
      value as "OBS_VALUE" from events""",
)
def s3(t):
    return sheets.read_indicators(t.spark, write_csv(extract(t, True), "indicators", header=True))


def indicators(t: Tables) -> DataFrame:
    return official.union_indicators(
        official.clean_indicator(extract(t, True), {"MEASURES_NAME": "click"}, "VARIABLE_NAME", source="aps"),
        official.clean_indicator(extract(t, False), {"MEASURES_NAME": "view"}, "VARIABLE_NAME", source="ashe"),
    )


UNION_SQL = f"""{INDICATOR_SQL.format(source='aps', kind='click')} union all
{INDICATOR_SQL.format(source='ashe', kind='view')}"""


@query("u1_union_indicators", UNION_SQL)
def u1(t):
    return indicators(t)


@query(
    "r2_labour_table",
    f"""select date as year, geography_name as la_name, geography_code as la_code, variable, value, source
    from ({UNION_SQL})""",
)
def r2(t):
    return official.labour_table(indicators(t))


# Outline: regions, nations and suppliers as sections, divisions and classes.

SHEET_SQL = """sheet as (
  select r_regionkey * 100000000::bigint as row_no, chr(65 + r_regionkey) as section, r_name as section_name,
    null as division, null as division_name, null as "group", null as group_name,
    null as class, null as class_name, null as subclass, null as subclass_name from region
  union all select (n_regionkey * 100 + n_nationkey + 1) * 1000000::bigint, null, null,
    n_nationkey::varchar, n_name, null, null, null, null, null, null from nation
  union all select (n_regionkey * 100 + n_nationkey + 1) * 1000000::bigint + 1, null, null,
    null, 'Note on ' || n_name, null, null, null, null, null, null from nation
  union all select (n_regionkey * 100 + n_nationkey + 1) * 1000000::bigint + 2, null, null,
    null, null, n_nationkey || '.1', n_name || ' makers', null, null, null, null from nation
  union all select (n_regionkey * 100 + n_nationkey + 1) * 1000000::bigint + (s_suppkey + 1) * 10, null, null,
    null, null, null, null, n_nationkey || '.1' || s_suppkey, s_name, null, null
    from supplier join nation on s_nationkey = n_nationkey
  union all select (n_regionkey * 100 + n_nationkey + 1) * 1000000::bigint + (s_suppkey + 1) * 10 + i, null, null,
    null, null, null, null, null, null, n_nationkey || '.1' || s_suppkey || '/' || i, s_name || ' ' || i
    from supplier join nation on s_nationkey = n_nationkey, range(1, 3) r(i) where s_acctbal > 5000)"""


def outline_sheet(t: Tables) -> DataFrame:
    nothing = {c: F.lit(None).cast("string") for c in sheets.OUTLINE_COLUMNS}
    block = (F.col("n_regionkey") * 100 + F.col("n_nationkey") + 1).cast("long") * 1000000

    def rows(df, row_no, **cells):
        filled = {**nothing, **cells}
        return df.select(row_no.cast("long").alias("row_no"), *[filled[c].alias(c) for c in filled])

    makers = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    code = F.concat("n_nationkey", F.lit(".1"), "s_suppkey")
    split = makers.where("s_acctbal > 5000").withColumn("i", F.explode(F.array(F.lit(1), F.lit(2))))
    parts = [
        rows(t.region, F.col("r_regionkey").cast("long") * 100000000,
             section=F.char(F.col("r_regionkey") + 65), section_name=F.col("r_name")),
        rows(t.nation, block, division=F.col("n_nationkey").cast("string"), division_name=F.col("n_name")),
        rows(t.nation, block + 1, division_name=F.concat(F.lit("Note on "), "n_name")),
        rows(t.nation, block + 2, group=F.concat("n_nationkey", F.lit(".1")),
             group_name=F.concat("n_name", F.lit(" makers"))),
        rows(makers, block + (F.col("s_suppkey") + 1) * 10, **{"class": code, "class_name": F.col("s_name")}),
        rows(split, block + (F.col("s_suppkey") + 1) * 10 + F.col("i"),
             subclass=F.concat(code, F.lit("/"), "i"), subclass_name=F.concat_ws(" ", "s_name", "i")),
    ]
    sheet = parts[0]
    for part in parts[1:]:
        sheet = sheet.unionByName(part)
    return sheet


def fill_sql() -> str:
    steps, source = [], "sheet"
    for level in ("section", "division", '"group"'):
        name = level.strip('"') + "_name"
        others = [c for c in ("section", "division", '"group"') if c != level]
        kept = ", ".join(["row_no", *[f"{c}, {c.strip(chr(34))}_name" for c in others],
                          "class, class_name, subclass, subclass_name"])
        out = f"f_{level.strip(chr(34))}"
        steps.append(f"""{out} as (select {kept}, {level}, {name} from (
          select {kept}, {level} is not null as heading,
            last_value({level} ignore nulls) over w as {level}, last_value({name} ignore nulls) over w as {name}
          from {source} where ({level} is null) = ({name} is null)
          window w as (order by row_no rows unbounded preceding)) where not heading)""")
        source = out
    return ", ".join(steps)


OUT_COLUMNS = 'section, section_name, division, division_name, "group", group_name, class, class_name, subclass, subclass_name'
FILLED_SQL = f"{SHEET_SQL}, {fill_sql()}"
SUBCLASS_SQL = f"""{FILLED_SQL}, c1 as (
  select * exclude (class, class_name, subclass, subclass_name),
    last_value(class ignore nulls) over w as class, last_value(class_name ignore nulls) over w as class_name,
    coalesce(subclass, lead(subclass) over (order by row_no)) as sub,
    coalesce(subclass_name, lead(subclass_name) over (order by row_no)) as sub_name
  from f_group window w as (order by row_no rows unbounded preceding)),
c2 as (select * exclude (sub, sub_name), case when sub is null then class || '/0' else sub end as subclass,
    case when sub is null then class_name else sub_name end as subclass_name from c1),
derived as (select min(row_no) as row_no, {OUT_COLUMNS} from c2 group by all)"""
TREE_SQL = f"""{SUBCLASS_SQL}, tree as (
  select row_no, replace(replace(section, '.', ''), '/', '') as section, section_name,
    replace(replace(division, '.', ''), '/', '') as division, division_name,
    replace(replace("group", '.', ''), '/', '') as "group", group_name,
    replace(replace(class, '.', ''), '/', '') as class, class_name,
    replace(replace(subclass, '.', ''), '/', '') as subclass, subclass_name from derived)"""
EXTRA_SQL = f"""{TREE_SQL}, full_tree as (
  select * from tree union all by name
  select * from (values ('74990', 'Non-trading company'), ('98000', 'Residents property management'),
    ('99999', 'Dormant company')) e(subclass, subclass_name))"""
NAMES_SQL = f"""{EXTRA_SQL}, names as (
  select level, code, arg_max(name, (coalesce(row_no, 9000000000000000000), name)) as name from (
    {' union all '.join(f'select {i} as level, row_no, {c} as code, {n} as name from full_tree'
     for i, (c, n) in enumerate([('section', 'section_name'), ('division', 'division_name'), ('"group"', 'group_name'),
     ('class', 'class_name'), ('subclass', 'subclass_name')], 1))})
  where code is not null and name is not null group by level, code)"""


@query("s1_read_outline", f"with {SHEET_SQL} select row_no + 2 as row_no, {OUT_COLUMNS} from sheet")
def s1(t):
    sheet = outline_sheet(t)
    cells = {c: F.concat(F.lit(" "), F.col(c), F.lit("  ")) for c in sheets.OUTLINE_COLUMNS}
    body = sheet.withColumns(cells).withColumn("row_no", F.col("row_no") + 2)
    blank = t.region.select((F.col("r_regionkey").cast("long") * 100000000 + 9).alias("row_no"))
    titles = t.region.where("r_regionkey < 2").select(
        F.col("r_regionkey").cast("long").alias("row_no"),
        *[F.lit(f"header {c}").alias(c) for c in sheets.OUTLINE_COLUMNS],
    )
    path = write_csv(
        titles.unionByName(body).unionByName(blank, allowMissingColumns=True), "outline"
    )
    return sheets.read_outline(t.spark, path)


@query("w3_outline_fill", f"with {FILLED_SQL} select row_no, {OUT_COLUMNS} from f_group")
def w3(t):
    return outline.outline_fill(outline_sheet(t))


@query("w4_derive_subclass", f"with {SUBCLASS_SQL} select row_no, {OUT_COLUMNS} from derived")
def w4(t):
    return outline.derive_subclass(outline.outline_fill(outline_sheet(t)))


@query("u3_distinct_rows", f"with {SUBCLASS_SQL} select distinct {OUT_COLUMNS} from derived")
def u3(t):
    return outline.derive_subclass(outline.outline_fill(outline_sheet(t))).drop("row_no")


@query("p10_normalise_codes", f"with {TREE_SQL} select row_no, {OUT_COLUMNS} from tree")
def p10(t):
    return outline.normalise_codes(outline.derive_subclass(outline.outline_fill(outline_sheet(t))))


@query("u2_append_extras", f"with {EXTRA_SQL} select {OUT_COLUMNS} from full_tree")
def u2(t):
    return outline.append_extras(
        outline.normalise_codes(outline.derive_subclass(outline.outline_fill(outline_sheet(t))))
    ).drop("row_no")


@query("t12_code_hierarchy", f"with {EXTRA_SQL} select row_no, {OUT_COLUMNS} from full_tree")
def t12(t):
    return code_hierarchy(outline_sheet(t))


@query("s8_level_names", f"with {NAMES_SQL} select level::int as level, code, name from names")
def s8(t):
    return outline.level_names(code_hierarchy(outline_sheet(t)), "row_no")


@query("s9_level_lookup", f"with {NAMES_SQL} select level, code, name from names")
def s9(t):
    names = cut(outline.level_names(code_hierarchy(outline_sheet(t)), "row_no"))
    each = [outline.level_lookup(names, i).select(F.lit(i).alias("level"), "code", "name") for i in range(1, 6)]
    return reduce(DataFrame.unionByName, each)
