import datetime
import random

import pandas as pd
import pytest

from sectorlens.functions.dates import day_first_date
from sectorlens.operators import official, outline, records
from sectorlens.operators.lengths import percentile_rank
from sectorlens.operators.ranking import fill_down, latest_per_key, next_row, ranked
from sectorlens.operators.sampling import sample_exact
from sectorlens.plans.hierarchy import code_hierarchy
from sectorlens.sources import snapshots
from pyspark.sql import functions as F

DAY = datetime.date


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_null_date_loses_or_wins(spark):
    df = spark.createDataFrame(
        [(1, DAY(2020, 1, 1), "old"), (1, DAY(2021, 1, 1), "new"), (1, None, "undated"), (2, None, "only")],
        "k int, date date, v string",
    )
    assert rows(latest_per_key(df, ["k"], "date"), "k", "v") == [(1, "new"), (2, "only")]
    assert rows(latest_per_key(df, ["k"], "date", nulls="first"), "k", "v") == [(1, "undated"), (2, "only")]
    with pytest.raises(ValueError):
        latest_per_key(df, ["k"], "date", nulls="middle")


def test_equal_dates_go_by_tie_columns(spark):
    df = spark.createDataFrame([(1, DAY(2020, 1, 1), "b"), (1, DAY(2020, 1, 1), "a")], "k int, date date, v string")
    assert rows(latest_per_key(df, ["k"], "date", tie=["v"]), "v") == [("a",)]


def test_ranked_equals_sorting_with_a_hot_group(spark):
    random.seed(1)
    data = [("hot" if i % 3 else f"g{i % 7}", random.randint(0, 50), i) for i in range(600)]
    df = spark.createDataFrame(data, "g string, v int, id int")
    got = rows(ranked(df, ["g"], [-F.col("v"), F.col("id")], slice_rows=7), "g", "id", "rn")
    want, seen = [], {}
    for g, v, i in sorted(data, key=lambda r: (r[0], -r[1], r[2])):
        seen[g] = seen.get(g, 0) + 1
        want.append((g, i, seen[g]))
    assert got == sorted(want)


@pytest.mark.parametrize("chunk_rows", [1, 3, 1000])
def test_fill_down_and_next_row_across_chunks(spark, chunk_rows):
    random.seed(2)
    data = [(i * 2, random.choice([None, None, f"v{i}"]), random.choice([None, f"w{i}"])) for i in range(40)]
    df = spark.createDataFrame(data, "row_no long, a string, b string")
    pdf = pd.DataFrame(data, columns=["row_no", "a", "b"])
    filled = pdf.assign(a=pdf.a.ffill(), b=pdf.b.ffill())
    want = [tuple(None if pd.isna(v) else v for v in r) for r in filled.itertuples(index=False)]
    got = fill_down(df, ["a", "b"], "row_no", chunk_rows=chunk_rows).orderBy("row_no").select("row_no", "a", "b")
    assert [tuple(r) for r in got.collect()] == want
    following = next_row(df, ["a"], "row_no", chunk_rows=chunk_rows).orderBy("row_no").collect()
    assert [r.next_a for r in following] == [d[1] for d in data[1:]] + [None]


def test_day_first_dates(spark):
    df = spark.createDataFrame([("03/04/2001",), ("nonsense",), (None,), ("2001-04-03",), ("31/02/2001",)], "s string")
    got = [r.d for r in df.select(day_first_date("s").alias("d")).collect()]
    assert got == [DAY(2001, 4, 3), None, None, DAY(2001, 4, 3), None]


@pytest.mark.parametrize(
    "text,want",
    [
        ("03/04/01", DAY(2001, 4, 3)), ("03/04/98", DAY(1998, 4, 3)), ("3-4-69", DAY(1969, 4, 3)), ("2001-04-03 00:00:00", DAY(2001, 4, 3)),
        ("2001-04-03T12:30:00Z", DAY(2001, 4, 3)), ("3/4/2001 9:05", DAY(2001, 4, 3)), ("3 April 2001", DAY(2001, 4, 3)),
        ("3 Apr 2001", DAY(2001, 4, 3)), ("20010403", DAY(2001, 4, 3)), ("13/13/2001", None), ("", None), ("29/02/2001", None),
    ],
)
def test_more_dates(spark, text, want):
    df = spark.createDataFrame([(text,)], "s string")
    assert df.select(day_first_date("s").alias("d")).first().d == want


SHEET = [
    ("A", "Farming", None, None, None, None, None, None, None, None),
    (None, None, "01", "Crops", None, None, None, None, None, None),
    (None, None, None, "a note", None, None, None, None, None, None),
    (None, None, None, None, "01.1", "Annual crops", None, None, None, None),
    (None, None, None, None, None, None, "01.11", "Cereals", None, None),
    (None, None, None, None, None, None, "01.12", "Rice", None, None),
    (None, None, None, None, None, None, None, None, "01.12/1", "Wet rice"),
    (None, None, None, None, None, None, None, None, "01.12/2", "Dry rice"),
]
COLUMNS = [c for level in outline.LEVELS for c in (level, f"{level}_name")]


@pytest.mark.parametrize("chunk_rows", [1, 2, 1000])
def test_hierarchy(spark, chunk_rows):
    schema = "row_no long, " + ", ".join(f"`{c}` string" for c in COLUMNS)
    sheet = spark.createDataFrame([(i, *r) for i, r in enumerate(SHEET)], schema)
    tree = code_hierarchy(sheet, chunk_rows=chunk_rows)
    got = rows(tree, "subclass", "subclass_name")
    assert got == [
        ("01110", "Cereals"), ("01121", "Wet rice"), ("01122", "Dry rice"),
        ("74990", "Non-trading company"), ("98000", "Residents property management"), ("99999", "Dormant company"),
    ]
    names = outline.level_names(tree, "row_no")
    assert rows(outline.level_lookup(names, 1), "code", "name") == [("A", "Farming")]
    assert rows(outline.level_lookup(names, 4), "code", "name") == [("0111", "Cereals"), ("0112", "Rice")]
    for level in (0, 6):
        with pytest.raises(ValueError):
            outline.level_lookup(names, level)


def test_match_thresholds_and_inversion(spark):
    matches = spark.createDataFrame(
        [(1, "c1", 80.0), (2, "c1", 95.0), (3, "c2", 79.9)], "org_id long, company_number string, sim_mean double"
    )
    accepted = records.accept_matches(matches, 80, 50)
    assert rows(accepted, "org_id") == [(1,), (2,)]
    assert rows(records.company_to_org(accepted), "company_number", "org_id") == [("c1", 2)]
    with pytest.raises(ValueError):
        records.accept_matches(matches, 40, 50)
    with pytest.raises(ValueError):
        records.validate_keys(matches, ["company_number"])
    assert records.validate_keys(matches, ["org_id"]) is matches


def test_sic4_takes_the_first_rank(spark):
    sectors = spark.createDataFrame([("c1", "12345", 1), ("c1", "99999", 2), ("c2", "11111", 1)], "company_number string, sic5 string, rank int")
    matches = spark.createDataFrame([(7, "c1")], "org_id long, company_number string")
    assert rows(records.sic4_of_orgs(sectors, matches), "org_id", "sic4") == [(7, "1234")]


def test_yearly_sheet_headers_and_ratio(spark):
    df = spark.createDataFrame(
        [("N", "E1", "Leeds", 1.0, 2.0), ("note", None, None, None, None)],
        "`ITL1 Region` string, `LA code` string, `LA name` string, `2018` double, `2019\n[note 3]` double",
    )
    clean = official.clean_yearly(df)
    assert clean.columns == ["itl1_region", "la_code", "la_name", "2018", "2019"]
    gva, pop = official.melt_years(clean, "gva"), official.melt_years(clean, "pop")
    assert rows(official.ratio_per_head(gva, pop.withColumn("pop", F.lit(8e6))), "year", "gva_pc") == [(2018, 0.12), (2019, 0.25)]
    zero = official.ratio_per_head(gva, pop.withColumn("pop", F.lit(0.0)))
    assert {r.gva_pc for r in zero.collect()} == {None}


def test_indicator_dates(spark):
    schema = "DATE string, GEOGRAPHY_NAME string, GEOGRAPHY_CODE string, V string, MEASURES_NAME string, OBS_VALUE double"
    df = spark.createDataFrame([("2019-12", "a", "1", "x", "Value", 1.0), ("2018", "a", "1", "x", "Other", 2.0)], schema)
    assert rows(official.clean_indicator(df, {"MEASURES_NAME": "Value"}, "V", source="aps"), "date", "source") == [(2019, "aps")]


def test_snapshots(spark):
    at = datetime.datetime
    runs = spark.createDataFrame(
        [("f", 1, "prod", True, at(2020, 1, 1), "m"), ("f", 2, "prod", False, at(2021, 1, 1), "m"),
         ("f", 3, "user", True, at(2022, 1, 1), "m"), ("f", 4, "prod", True, at(2019, 1, 1), None)],
        "flow_name string, run_id long, branch string, successful boolean, finished_at timestamp, model_name string",
    )
    assert snapshots.latest_snapshot(runs, "f").first().run_id == 1
    assert rows(snapshots.latest_snapshot_per_model(runs, "f"), "model_name", "run_id") == [("m", 1)]
    with pytest.raises(LookupError):
        snapshots.latest_snapshot(runs, "other")
    with pytest.raises(ValueError):
        snapshots.read_pinned(spark, "/nowhere", runs, "f", 2)


def test_exact_sample(spark):
    df = spark.range(1000).withColumnRenamed("id", "org_id")
    first = rows(sample_exact(df, 37, "org_id"), "org_id")
    assert len(set(first)) == 37 and first == rows(sample_exact(df.repartition(5), 37, "org_id"), "org_id")
    assert first != rows(sample_exact(df, 37, "org_id", seed=1), "org_id")
    with pytest.raises(ValueError):
        sample_exact(df, 1001, "org_id")


def test_percentile_rank(spark):
    df = spark.createDataFrame([(1,), (2,), (2,), (4,)], "n int")
    assert percentile_rank(df, "n", 2).first()[0] == 62.5
    assert percentile_rank(df, "n", 3).first()[0] == 75.0
