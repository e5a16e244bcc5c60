"""Order-insensitive comparison of a Spark result with a DuckDB result."""

from __future__ import annotations

import datetime
import decimal
import math
import sys

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(directory: str):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{directory}/{table}.parquet'")
    return con


def plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9) + 0.0
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if hasattr(value, "tolist"):
        return plain(value.tolist())
    return value


def sortable(row):
    return tuple((v is None, str(type(v)), str(v)) for v in row)


# DuckDB's names of the Spark types that the queries return.
TYPE_NAMES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "float": "FLOAT",
    "string": "VARCHAR", "date": "DATE", "boolean": "BOOLEAN",
}


def type_difference(con, df, sql) -> str | None:
    """None when the columns have the same types on both sides."""
    want = {r[0]: r[1] for r in con.execute(f"describe {sql}").fetchall()}
    got = {f.name: TYPE_NAMES.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema}
    wrong = {c: (got.get(c), want.get(c)) for c in {*got, *want} if got.get(c) != want.get(c)}
    return f"types {wrong}" if wrong else None


def spark_rows(df):
    columns = sorted(df.columns)
    return columns, sorted(
        (tuple(plain(r[c]) for c in columns) for r in df.select(*[f"`{c}`" for c in columns]).collect()), key=sortable
    )


def duck_rows(con, sql):
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    rows = (tuple(plain(r[i]) for i in order) for r in rel.fetchall())
    return [names[i] for i in order], sorted(rows, key=sortable)


def difference(got, want) -> str | None:
    """None when equal, else what differs first."""
    (gc, gr), (wc, wr) = got, want
    if gc != wc:
        return f"columns {gc} != {wc}"
    if len(gr) != len(wr):
        extra = [r for r in gr if r not in set(wr)][:2] if len(gr) < 20000 else ""
        lacking = [r for r in wr if r not in set(gr)][:2] if len(gr) < 20000 else ""
        return f"rows {len(gr)} != {len(wr)}; only here {extra}; only there {lacking}"
    for a, b in zip(gr, wr):
        if a != b:
            return f"{a} != {b}"
        if [type(x) for x in a] != [type(x) for x in b]:
            return f"types {[type(x) for x in a]} != {[type(x) for x in b]}"
    return None


if __name__ == "__main__":
    import time

    sys.path.insert(0, __file__.rsplit("/", 2)[0])
    import __spark_entry__ as entry
    from sectorlens.session import build_session

    directory, wanted = sys.argv[1], sys.argv[2:]
    spark = build_session(
        "compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
        "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(directory)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if wanted and not any(name == w or name.startswith(w + "_") or w == "all" for w in wanted):
            continue
        start = time.time()
        try:
            got = spark_rows(fn(spark, directory))
        except Exception as exc:
            bad += 1
            print(f"ERROR {name}: {str(exc)[:700]}", flush=True)
            continue
        took = time.time() - start
        if name not in oracles:
            print(f"rows  {name}: {len(got[1])} rows, {took:.1f}s", flush=True)
            continue
        try:
            start = time.time()
            text = difference(got, duck_rows(con, oracles[name]))
        except Exception as exc:
            text = f"SQL failed: {str(exc)[:600]}"
        bad += text is not None
        print(f"{'ok   ' if text is None else 'DIFF '} {name}: {len(got[1])} rows, {took:.1f}s, sql {time.time()-start:.1f}s {text or ''}", flush=True)
    print("bad:", bad)
