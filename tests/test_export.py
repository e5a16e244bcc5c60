"""Wide exports against a plain table."""

import csv
import glob

from sectorlens.operators import export, graph


def lines_of(path, sep):
    """Header and rows over all files; every file begins with the header."""
    headers, rows = set(), []
    for name in glob.glob(f"{path}/*.txt"):
        with open(name, newline="", encoding="utf-8") as file:
            found = list(csv.reader(file, delimiter=sep, escapechar="\\"))
        headers.add(tuple(found[0]))
        rows += [tuple(r) for r in found[1:]]
    assert len(headers) == 1
    return headers.pop(), sorted(rows)


def test_clusters_of_any_number(spark, tmp_path):
    groups = 15_000
    table = spark.range(3 * groups).selectExpr("'s' as sector", "id as doc_id", "cast(id % 15000 as int) as doc_group", "1.0D as p")
    table = table.union(spark.sql("select 't', 7L, 20000, 1.0D"))
    export.export_clusters(table, f"{tmp_path}/c")
    header, rows = lines_of(f"{tmp_path}/c", ",")
    assert header == ("sector", "rank", *[f"Cluster {i + 1}" for i in range(groups)], "Cluster 20001")
    want = [("s", str(k + 1), *[str(k * groups + i) for i in range(groups)], "") for k in range(3)] + [("t", "1", *[""] * groups, "7")]
    assert rows == sorted(want)


def test_same_rows_as_the_pivot(spark, tmp_path):
    words = [("s", w, i % 3, 0.1 * (i + 1)) for i, w in enumerate(['a', 'b,c', 'd"e', "f", "g\th", "i", "ü"])] + [("t", "x", 5, 1.0)]
    topics = spark.createDataFrame(words, "sector string, word string, word_group int, p double")
    export.export_topics(topics, f"{tmp_path}/t")
    header, rows = lines_of(f"{tmp_path}/t", ",")
    pivot = graph.topics_table(topics)
    assert set(header) == set(pivot.columns)
    want = sorted(tuple("" if r[c] is None else str(r[c]) for c in header) for r in pivot.collect())
    assert rows == want
    shares = spark.createDataFrame([("s", 1, 0, 0.25), ("s", 1, 1, 0.75), ("s", 2, 1, 1.0)], "sector string, doc_id long, word_group int, p double")
    export.export_topic_distribution(shares, f"{tmp_path}/d", sep="\t")
    assert lines_of(f"{tmp_path}/d", "\t") == (("sector", "doc_id", "Topic 1", "Topic 2"), [("s", "1", "0.25", "0.75"), ("s", "2", "0.0", "1.0")])


def test_topic_shares_are_computed_once(spark):
    edges = spark.createDataFrame([("s", 1, "a", 2), ("s", 1, "b", 1), ("s", 2, "b", 4)], "sector string, doc_id long, word string, cnt long")
    groups = spark.createDataFrame([("s", "a", 0), ("s", "b", 1)], "sector string, word string, word_group int")
    topics = graph.doc_topics(edges, groups)
    table = graph.topic_distribution_table(topics)
    assert "LogicalRDD" not in topics._jdf.queryExecution().analyzed().toString()
    assert "Join" not in table._jdf.queryExecution().analyzed().toString()
    want = [(1, round(2 / 3, 9), round(1 / 3, 9)), (2, 0.0, 1.0)]
    assert sorted((r.doc_id, round(r["Topic 1"] or 0.0, 9), round(r["Topic 2"], 9)) for r in table.collect()) == want
