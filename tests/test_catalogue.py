"""Catalogue queries against the same SQL in another engine, on a tiny star schema with the edge cases."""

import datetime
import random

import duckdb
import pytest

from metalith.plans import binary, catalogue  # noqa: F401


@pytest.fixture(scope="module")
def tiny(spark, tmp_path_factory):
    r = random.Random(4)
    day = datetime.datetime(1995, 1, 1)
    customers = [(k, f"Customer#{k}") for k in range(12)]
    orders = [(k, r.randrange(12), day + datetime.timedelta(days=k)) for k in range(160)]
    items = [(r.randrange(160), r.randrange(400), r.randrange(20), r.randrange(1, 7), float(r.randrange(1, 50)), r.choice("RAN"), day + datetime.timedelta(days=r.randrange(900))) for _ in range(700)]
    folder = tmp_path_factory.mktemp("tiny")
    for name, rows, ddl in (
        ("customer", customers, "c_custkey long, c_name string"),
        ("orders", orders, "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz"),
        ("lineitem", items, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string, l_shipdate timestamp_ntz"),
    ):
        spark.createDataFrame(rows, ddl).write.parquet(f"{folder}/{name}.parquet")
    db = duckdb.connect(config={"temp_directory": ""})
    for name in ("customer", "orders", "lineitem"):
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    return str(folder), db


def plain(x):
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    return tuple(x) if isinstance(x, list) else x


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_same_as_sql(spark, tiny, name):
    folder, db = tiny
    df = catalogue.QUERIES[name](spark, folder)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(x) for x in r) for r in df.select(*columns).collect()), key=str)
    sql = db.sql(catalogue.ORACLE_SQL[name])
    assert sorted(sql.columns) == columns
    want = sorted((tuple(plain(x) for x in r) for r in sql.project(", ".join(f'"{c}"' for c in columns)).fetchall()), key=str)
    assert got == want


@pytest.mark.parametrize("name", ["scan_links", "scan_layouts", "scan_objects"])
def test_arrays_are_made_once(spark, tiny, name):
    """No filter is inferred from an explode: below the projection it would make links and components again, and components are compiled, not interpreted."""
    plan = catalogue.QUERIES[name](spark, tiny[0])._jdf.queryExecution().executedPlan().toString()
    assert "size(" not in plan and "transform(" not in plan
