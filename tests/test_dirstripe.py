"""The object index is read only where shards and masters may be."""

import pytest
from pyspark.sql import functions as F

from metalith.functions.fid import _once, format_fid, parse_fid, parse_shard_name
from metalith.operators import dirstripe
from metalith.plans import derived


@pytest.fixture(scope="module")
def star(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("star"))
    spark.range(12).selectExpr("id AS c_custkey", "'c' || id AS c_name").write.parquet(f"{folder}/customer.parquet")
    spark.range(300).selectExpr("id AS o_orderkey", "id % 12 AS o_custkey", "TIMESTAMP_NTZ '1995-01-01' AS o_orderdate").write.parquet(f"{folder}/orders.parquet")
    items = "id % 300 AS l_orderkey", "id % 390 AS l_partkey", "id % 20 AS l_suppkey", "CAST(id % 6 + 1 AS INT) AS l_linenumber", "1D AS l_quantity", "'R' AS l_returnflag", "TIMESTAMP_NTZ '1995-01-01' AS l_shipdate"
    spark.range(900).selectExpr(*items).write.parquet(f"{folder}/lineitem.parquet")
    return folder


@pytest.mark.parametrize("sequences", [0, 1, 1000])
def test_narrow_gives_the_same(spark, star, monkeypatch, sequences):
    monkeypatch.setattr(dirstripe, "SEQUENCES", sequences)
    raw = derived.raw(spark, star)
    whole = dirstripe.dirstripe(raw, derived.dirents(spark, star)).collect()
    narrow = dirstripe.dirstripe(raw, derived.shard_entries(spark, star), narrow=True).collect()
    assert len(whole) > 400 and sorted(narrow, key=str) == sorted(whole, key=str)


def test_files_do_not_reach_the_join(spark, star):
    raw = derived.raw(spark, star)
    asked = spark.createDataFrame([("[0x200000405:0x28:0x0]",), (None,)], "fid string")
    index = dirstripe.of_sequences(raw.select("fid"), asked)
    assert 0 < index.count() == raw.where("fid LIKE '[0x200000405:%'").count()
    assert dirstripe.of_sequences(raw.select("fid"), asked.where("false")).count() == 0


def test_usual_shard_names_are_read_alike(spark):
    """With the shortcut and without, names give the same; the usual ones don't go through the parser."""
    names = ["[0x200000405:0x28:0x0]:3", "[0x0:0x0:0x0]:0", "[0xffffffffffffffff:0xffffffff:0xffffffff]:18", "[0x1:0x100000000:0x0]:1", "[0x01:0x2:0x3]:1", "[0x1:2:03]:7", "[0xAB:0x1:0x0]:1"]
    names += ["[0x1:0x2:0x3]:1\n", "[0x1:0x2:0x3]:", "[0x1:0x2:0x3]:x", "[0x1:0x2]:1", "[0x1:0x2:0x3:0x4]:1", "[0x1:0x2:0x3]:99999999999999999999", "plain", "", None]
    name = F.col("name")
    fid, index = (F.regexp_extract(name, r"^(\[[^\]]*\]):([0-9]+)$", i) for i in (1, 2))
    slow = _once(parse_fid(fid), lambda p: F.when(p.isNotNull(), F.struct(format_fid(p["seq"], p["oid"], p["ver"]).alias("fid"), index.try_cast("bigint").alias("index"))))
    rows = spark.createDataFrame([(n,) for n in names], "name string").select("name", parse_shard_name(name).alias("got"), slow.alias("want")).collect()
    assert [(r["name"], r["got"]) for r in rows] == [(r["name"], r["want"]) for r in rows]
    assert sum(r["got"] is not None for r in rows) >= 8
