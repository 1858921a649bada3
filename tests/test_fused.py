"""Joins on identifiers, and objects of a few chosen inodes."""

from metalith.operators import fused
from metalith.plans import catalogue


def test_join_of_repeated_and_missing_identifiers(spark):
    """Rows, columns and their order are those of a plain join; the hash decides the order of the sort only."""
    left = spark.createDataFrame([("a", 1, 10), ("a", 1, 11), ("a", 2, 12), ("b", None, 13), (None, 1, 14)], "fid string, comp_index long, x long")
    right = spark.createDataFrame([("a", 1, "p"), ("a", 1, "q"), ("b", None, "r"), (None, 1, "s"), ("c", 1, "t")], "fid string, comp_index long, device string")
    right_named = right.withColumnRenamed("device", "layout_device")
    for got, want in (
        (fused.object_layouts(left, right), left.join(right_named, ["fid", "comp_index"])),
        (fused.inode_layouts(left.drop("comp_index"), right), left.drop("comp_index").join(right_named, "fid")),
    ):
        assert got.columns == want.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) != []
    plan = fused.link_objects(left.drop("comp_index"), right)._jdf.queryExecution().optimizedPlan().toString()
    assert "xxhash64" in plan.split("\n")[1]


def test_objects_of_a_few_are_not_dealt_out(spark, tmp_path):
    folder = str(tmp_path)
    spark.range(12).selectExpr("id AS c_custkey", "'c' || id AS c_name").write.parquet(f"{folder}/customer.parquet")
    spark.range(300).selectExpr("id AS o_orderkey", "id % 12 AS o_custkey", "TIMESTAMP_NTZ '1995-01-01' AS o_orderdate").write.parquet(f"{folder}/orders.parquet")
    items = "id % 300 AS l_orderkey", "id % 390 AS l_partkey", "id % 20 AS l_suppkey", "CAST(id % 6 + 1 AS INT) AS l_linenumber", "1D AS l_quantity", "'R' AS l_returnflag", "TIMESTAMP_NTZ '1995-01-01' AS l_shipdate"
    spark.range(900).selectExpr(*items).write.parquet(f"{folder}/lineitem.parquet")
    r = catalogue.Relations(spark, folder)
    chosen = r.inodes.where("uid = 11 AND type = 'file'").select("fid")
    twice = chosen.unionByName(chosen)
    got = catalogue.objects_of(r, twice)
    want = r.objects.select("fid", "ost_idx", "comp_index").join(twice, "fid")
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect())) != []
    plan = catalogue.QUERIES["bloom_runtime_filter"](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and plan.index("LeftSemi") > plan.index("Generate explode")
