"""The named queries of the engine and their SQL equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from metalith.functions import fid as fids
from metalith.operators import dirstripe as stripes
from metalith.operators import fused, paths, relations
from metalith.plans import derived

QUERIES = {}
ORACLE_SQL = {}


class Relations:
    """The relations of one input, made on demand."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.raw = derived.raw(spark, sf_dir)

    def once(self, *columns: str) -> Relations:
        """The same with the narrow part of raw, or only ``columns``, written once, for queries that meet it several times; layouts and objects aren't in it."""
        self.raw = paths.settle(self.raw.select(*columns) if columns else self.raw.drop("comps"))
        return self

    def table(self, name: str) -> DataFrame:
        return derived.table(self.spark, self.sf_dir, name)

    @property
    def inodes(self) -> DataFrame:
        return relations.inodes(self.raw)

    @property
    def links(self) -> DataFrame:
        return relations.links(self.raw)

    @property
    def layouts(self) -> DataFrame:
        return relations.layouts(self.raw)

    @property
    def objects(self) -> DataFrame:
        return relations.objects(self.raw)

    @property
    def dirents(self) -> DataFrame:
        return derived.dirents(self.spark, self.sf_dir, self.raw)

    @property
    def dirstripe(self) -> DataFrame:
        return stripes.dirstripe(self.raw, derived.shard_entries(self.spark, self.sf_dir), narrow=True)


def query(name: str, sql: str, recursive: bool = False, plain: bool = False):
    """Register a query on the relations and its SQL; ``plain`` SQL brings its own tables."""

    def register(f):
        QUERIES[name] = lambda spark, sf_dir: f(Relations(spark, sf_dir))
        ORACLE_SQL[name] = sql if plain else f"WITH {'RECURSIVE ' if recursive else ''}{derived.SQL.strip()}{derived.PATHS_SQL.rstrip() if recursive else ''}\n{sql}"
        return f

    return register


def objects_of(r: Relations, chosen: DataFrame) -> DataFrame:
    """(fid, ost_idx, comp_index) of the objects of ``chosen`` (fid). It is written first: then its size is known, and where it is small,
    inodes are filtered by it before their components are made, let alone dealt out."""
    chosen = paths.settle(chosen)
    return relations.objects(r.raw.join(chosen, "fid", "left_semi")).select("fid", "ost_idx", "comp_index").join(chosen, "fid")


# Scans

query("scan_inodes", "SELECT * FROM inodes")(lambda r: r.inodes)
query("scan_links", "SELECT * FROM links")(lambda r: r.links)
query("scan_layouts", "SELECT * FROM layouts")(lambda r: r.layouts)
query("scan_objects", "SELECT * FROM objects")(lambda r: r.objects)
query("scan_dirstripe", "SELECT * FROM dirstripe")(lambda r: r.dirstripe)
query("multi_device_scan", "SELECT * FROM inodes WHERE device IN ('mdt1', 'mdt3')")(lambda r: relations.inodes(r.raw, ["mdt1", "mdt3"]))
query("single_device_scan", "SELECT * FROM links WHERE device = 'mdt2'")(lambda r: relations.links(r.raw, "mdt2"))
query("skip_no_fid_off", "SELECT * EXCLUDE (linked) FROM typed WHERE linked")(lambda r: relations.inodes(r.raw, skip_no_fid=False))
query("skip_no_linkea_off", "SELECT * EXCLUDE (linked) FROM typed WHERE fid IS NOT NULL")(lambda r: relations.inodes(r.raw, skip_no_linkea=False))
query("skip_both_off", "SELECT * EXCLUDE (linked) FROM typed")(lambda r: relations.inodes(r.raw, skip_no_fid=False, skip_no_linkea=False))
query("links_skip_no_fid_off", "SELECT fid, parent_fid, name, device FROM all_links")(lambda r: relations.links(r.raw, skip_no_fid=False))
query("layouts_skip_no_fid_off", "SELECT * EXCLUDE (l_orderkey) REPLACE (coalesce(fid, '[0x0:0x0:0x0]') AS fid) FROM all_layouts")(lambda r: relations.layouts(r.raw, skip_no_fid=False))

# Filters

query("filter_cmp_numeric", "SELECT fid, uid, size FROM inodes WHERE size >= 20971520 AND nlink < 2 AND uid <> 7")(
    lambda r: r.inodes.where((F.col("size") >= 20 << 20) & (F.col("nlink") < 2) & (F.col("uid") != 7)).select("fid", "uid", "size")
)
query("filter_cmp_timestamp", "SELECT fid, mtime FROM inodes WHERE mtime >= TIMESTAMP '1996-01-01' AND mtime < TIMESTAMP '1997-01-01'")(
    lambda r: r.inodes.where("mtime >= TIMESTAMP '1996-01-01' AND mtime < TIMESTAMP '1997-01-01'").select("fid", "mtime")
)
query("filter_in", "SELECT fid, gid, type FROM inodes WHERE gid IN (1, 2, 3) AND type IN ('file', 'link')")(
    lambda r: r.inodes.where(F.col("gid").isin(1, 2, 3) & F.col("type").isin("file", "link")).select("fid", "gid", "type")
)
query("filter_null", "SELECT fid, ino, atime FROM typed WHERE linked AND (fid IS NULL OR atime IS NULL AND mtime IS NOT NULL)")(
    lambda r: relations.inodes(r.raw, skip_no_fid=False).where(F.col("fid").isNull() | (F.col("atime").isNull() & F.col("mtime").isNotNull())).select("fid", "ino", "atime")
)
query("filter_and", "SELECT fid FROM inodes WHERE uid = 10 AND flags = 16 AND projid > 100")(lambda r: r.inodes.where("uid = 10 AND flags = 16 AND projid > 100").select("fid"))
query("filter_or", "SELECT fid, uid FROM inodes WHERE uid = 10 OR uid = 20 OR size > 52000000")(lambda r: r.inodes.where((F.col("uid") == 10) | (F.col("uid") == 20) | (F.col("size") > 52000000)).select("fid", "uid"))
query("filter_type", "SELECT fid, type, mode FROM inodes WHERE type = 'dir'")(lambda r: r.inodes.where(F.col("type") == "dir").select("fid", "type", "mode"))
query("filter_flags_bitand", "SELECT dir_fid, dir_device, lma_incompat FROM dirstripe WHERE lma_incompat & 4 <> 0")(
    lambda r: r.dirstripe.where(F.col("lma_incompat").bitwiseAND(F.lit(stripes.REMOTE_PARENT)) != 0).select("dir_fid", "dir_device", "lma_incompat")
)
query("fid_point_lookup", "SELECT * FROM inodes WHERE fid = '[0x200000403:0x10:0x0]'")(lambda r: r.inodes.where(F.col("fid") == "[0x200000403:0x10:0x0]"))
query("fid_in_lookup", "SELECT * FROM links WHERE fid IN ('[0x200000403:0x10:0x0]', '[0x200000402:0x5:0x0]', '[0x1:0x1:0x0]')")(
    lambda r: r.links.where(F.col("fid").isin("[0x200000403:0x10:0x0]", "[0x200000402:0x5:0x0]", "[0x1:0x1:0x0]"))
)
query("parent_fid_lookup", "SELECT * FROM links WHERE parent_fid = '[0x200000402:0x5:0x0]'")(lambda r: r.links.where(F.col("parent_fid") == "[0x200000402:0x5:0x0]"))
query("name_prefix", "SELECT * FROM links WHERE name LIKE 'O12%' AND name >= 'O121' AND name <= 'O125'")(lambda r: r.links.where(F.col("name").startswith("O12") & F.col("name").between("O121", "O125")))
query("bloom_runtime_filter", "SELECT o.fid, o.ost_idx, o.comp_index FROM objects o JOIN inodes i ON i.fid = o.fid WHERE i.uid = 11 AND i.type = 'file'")(
    lambda r: objects_of(r, r.inodes.where("uid = 11 AND type = 'file'").select("fid"))
)

# Joins

query("join_inode_link_fid", "SELECT i.fid, i.size, i.uid, l.name, l.parent_fid FROM inodes i JOIN links l ON i.fid = l.fid")(lambda r: fused.inode_links(r.inodes, r.links).select("fid", "size", "uid", "name", "parent_fid"))
query("join_inode_link_parent", "SELECT i.fid, i.uid, l.name FROM inodes i JOIN links l ON i.fid = l.parent_fid")(lambda r: fused.inode_links(r.inodes, r.links, on_parent=True).select("fid", "uid", "name"))
query("count_entries_per_dir", "SELECT i.fid, count(*) AS entries FROM inodes i JOIN links l ON i.fid = l.parent_fid GROUP BY i.fid")(lambda r: fused.entries_per_directory(r.inodes, r.links))
query("join_inode_object", "SELECT i.fid, i.size, o.comp_index, o.ost_idx FROM inodes i JOIN objects o ON i.fid = o.fid")(lambda r: fused.inode_objects(r.inodes, r.objects).select("fid", "size", "comp_index", "ost_idx"))
query("join_inode_layout", "SELECT i.fid, i.size, y.comp_index, y.pool, y.extent_end FROM inodes i JOIN layouts y ON i.fid = y.fid")(
    lambda r: fused.inode_layouts(r.inodes, r.layouts).select("fid", "size", "comp_index", "pool", "extent_end")
)
query("join_link_object", "SELECT l.fid, l.name, o.comp_index, o.stripe_index FROM links l JOIN objects o ON l.fid = o.fid")(lambda r: fused.link_objects(r.links, r.objects).select("fid", "name", "comp_index", "stripe_index"))
query("join_link_layout", "SELECT l.fid, l.name, y.comp_index, y.stripe_count FROM links l JOIN layouts y ON l.fid = y.fid")(lambda r: fused.link_layouts(r.links, r.layouts).select("fid", "name", "comp_index", "stripe_count"))
query("join_object_layout", "SELECT o.fid, o.comp_index, o.ost_idx, y.pool FROM objects o JOIN layouts y ON o.fid = y.fid AND o.comp_index = y.comp_index")(
    lambda r: fused.object_layouts(r.objects, r.layouts).select("fid", "comp_index", "ost_idx", "pool")
)
query("join_link_dirstripe", "SELECT l.fid, l.name, d.dir_fid, d.stripe_index FROM links l JOIN dirstripe d ON l.parent_fid = d.parent_fid")(
    lambda r: fused.link_dirstripe(r.links, r.dirstripe).select("fid", "name", "dir_fid", "stripe_index")
)
query("join_inode_dirstripe", "SELECT i.fid, i.uid, d.parent_fid, d.source FROM inodes i JOIN dirstripe d ON i.fid = d.dir_fid")(
    lambda r: fused.inode_dirstripe(r.inodes, r.dirstripe).select("fid", "uid", "parent_fid", "source")
)
query("join_link_dirstripe_inode", "SELECT l.fid, l.name, d.dir_fid, i.uid AS dir_uid, i.size AS dir_size FROM links l JOIN dirstripe d ON l.parent_fid = d.parent_fid JOIN inodes i ON i.fid = d.dir_fid")(
    lambda r: fused.link_inode_dirstripe(r.links, r.dirstripe, r.inodes).select("fid", "name", "dir_fid", "dir_uid", "dir_size")
)
query("logical_dir_entry_count", "SELECT d.dir_fid, count(*) AS entry_count FROM links l JOIN dirstripe d ON l.parent_fid = d.parent_fid JOIN inodes i ON i.fid = d.dir_fid WHERE i.type = 'dir' GROUP BY d.dir_fid")(
    lambda r: fused.entry_counts(r.links, r.dirstripe, r.inodes).select("dir_fid", F.col("entry_count").cast("bigint").alias("entry_count"))
)

# Directory stripes

query("dirstripe_plain", "SELECT * FROM dirstripe WHERE source = 'plain'")(lambda r: r.dirstripe.where("source = 'plain'"))
query("dirstripe_master_shards", "SELECT * FROM dirstripe WHERE source = 'master' AND parent_fid <> dir_fid")(lambda r: r.dirstripe.where("source = 'master' AND parent_fid <> dir_fid"))
query("dirstripe_slave_fallback", "SELECT * FROM dirstripe WHERE source = 'slave'")(lambda r: r.dirstripe.where("source = 'slave'"))
query("dirstripe_agent_skipped", "SELECT i.fid FROM inodes i WHERE i.type = 'dir' AND i.fid NOT IN (SELECT dir_fid FROM dirstripe UNION ALL SELECT parent_fid FROM dirstripe)")(
    lambda r: r.inodes.where("type = 'dir'").select("fid").join(r.dirstripe.select(F.explode(F.array("dir_fid", "parent_fid")).alias("fid")), "fid", "left_anti")
)
query(
    "shard_name_parse",
    r"SELECT name, regexp_extract(name, '^(\[[^\]]*\]):([0-9]+)$', 1) AS shard_fid, CAST(regexp_extract(name, '^(\[[^\]]*\]):([0-9]+)$', 2) AS BIGINT) AS shard_index FROM dirents WHERE name LIKE '[%'",
)(lambda r: r.dirents.select("name", fids.parse_shard_name(F.col("name")).alias("s")).where("s IS NOT NULL").select("name", F.col("s.fid").alias("shard_fid"), F.col("s.index").alias("shard_index")))

# Paths

#: What paths are made from.
UPWARD = ["device", "ord", "mode", "fid", "links", "lmv"]
query("fid2path", "SELECT fid, list(path ORDER BY ord) AS paths FROM found GROUP BY fid", recursive=True)(lambda r: paths.fid2path(r.once(*UPWARD).raw))
query("fid2path_multi_link", "SELECT fid, list(path ORDER BY ord) AS paths FROM found WHERE fid IN (SELECT fid FROM all_links WHERE ord = 1) GROUP BY fid", recursive=True)(
    lambda r: paths.fid2path(r.once(*UPWARD).raw, r.raw.where((F.size("links") > 1) & F.col("fid").isNotNull()).select("fid").distinct()).where("paths IS NOT NULL")
)
query("fid2path_through_shard", "SELECT fid, list(path ORDER BY ord) AS paths FROM found WHERE fid IN (SELECT fid FROM all_links WHERE parent_fid LIKE '[0x200000405:%') GROUP BY fid", recursive=True)(
    lambda r: paths.fid2path(r.once(*UPWARD).raw, r.links.where("parent_fid LIKE '[0x200000405:%'").select("fid").distinct()).where("paths IS NOT NULL")
)
query("fid2path_unresolvable", "SELECT DISTINCT fid FROM all_links WHERE fid IS NOT NULL AND fid NOT IN (SELECT fid FROM found)", recursive=True)(
    lambda r: paths.without_path(r.once(*UPWARD).raw)
)
query(
    "path2fid",
    "SELECT '/' || c.c_name || '/O' || CAST(o_orderkey AS VARCHAR) AS path, od.fid FROM od JOIN customer c ON c.c_custkey = od.o_custkey WHERE role <> 'slave'",
    recursive=False,
)(
    lambda r: paths.path2fid(
        paths.settle(r.table("orders").where("o_orderkey % 100 <> 55").join(r.table("customer"), F.col("o_custkey") == F.col("c_custkey")).selectExpr("'/' || c_name || '/O' || o_orderkey AS path")), r.dirents
    )
)
query("path2fid_root_and_miss", "SELECT * FROM (VALUES ('/', '[0x200000007:0x1:0x0]'), ('', '[0x200000007:0x1:0x0]'), ('/none/at/all', NULL), (NULL, NULL)) t(path, fid)")(
    lambda r: paths.path2fid(r.spark.createDataFrame([("/",), ("",), ("/none/at/all",), (None,)], "path string"), r.dirents)
)
query("directory_paths", "SELECT fid, path FROM dirpath", recursive=True)(lambda r: paths.directory_paths(r.raw))


def recursive_subtree(r: Relations) -> DataFrame:
    edges = paths.directory_edges(r.raw).select("fid", "parent_fid")
    return r.spark.sql(
        """WITH RECURSIVE tree(fid, lvl) MAX RECURSION LEVEL 4096 AS (
             SELECT CAST('[0x200000402:0x5:0x0]' AS STRING), 0 UNION ALL SELECT e.fid, t.lvl + 1 FROM tree t JOIN {edges} e ON e.parent_fid = t.fid)
           SELECT fid, lvl FROM tree""",
        edges=edges,
    )


query("recursive_subtree", ", tree(fid, lvl) AS (SELECT '[0x200000402:0x5:0x0]', 0 UNION ALL SELECT e.fid, t.lvl + 1 FROM tree t JOIN edges e ON e.parent_fid = t.fid) SELECT fid, lvl FROM tree", recursive=True)(recursive_subtree)

# Identifiers and modes

query("fid_format", "SELECT l_orderkey, '[0x' || lower(hex(8589938688 + l_orderkey)) || ':0x' || lower(hex(l_partkey)) || ':0x' || lower(hex(l_linenumber)) || ']' AS fid FROM lineitem", plain=True)(
    lambda r: r.table("lineitem").select("l_orderkey", fids.format_fid(F.col("l_orderkey") + 8589938688, F.col("l_partkey"), F.col("l_linenumber")).alias("fid"))
)
PARSED = """SELECT fid, CAST('0x' || regexp_extract(fid, '0x([0-9a-f]+):0x([0-9a-f]+):0x([0-9a-f]+)', 1) AS BIGINT) AS seq, CAST('0x' || regexp_extract(fid, '0x([0-9a-f]+):0x([0-9a-f]+):0x([0-9a-f]+)', 2) AS BIGINT) AS oid,
  CAST('0x' || regexp_extract(fid, '0x([0-9a-f]+):0x([0-9a-f]+):0x([0-9a-f]+)', 3) AS BIGINT) AS ver FROM inodes"""


def parsed(r: Relations) -> DataFrame:
    return r.inodes.select("fid", fids.parse_fid(F.col("fid")).alias("p")).select("fid", F.col("p.seq").cast("bigint").alias("seq"), "p.oid", "p.ver")


query("fid_parse", PARSED)(parsed)
query("fid_order", f"SELECT fid, row_number() OVER (ORDER BY seq, oid, ver) AS n FROM ({PARSED} WHERE type = 'dir') QUALIFY n <= 1000")(
    lambda r: r.inodes.where("type = 'dir'").select("fid").orderBy(*fids.fid_order(F.col("fid"))).limit(1000).withColumn("n", F.row_number().over(Window.orderBy(*fids.fid_order(F.col("fid")))).cast("bigint"))
)
query("fid_valid", "SELECT * FROM (VALUES ('[0x0:0x0:0x0]', false), ('[0x0:0x0:0x7]', false), ('[0x1:0x0:0x0]', true), ('[0x0:0x1:0x0]', true), ('junk', false), (NULL, false)) t(fid, valid)", plain=True)(
    lambda r: r.spark.createDataFrame([("[0x0:0x0:0x0]",), ("[0x0:0x0:0x7]",), ("[0x1:0x0:0x0]",), ("[0x0:0x1:0x0]",), ("junk",), (None,)], "fid string").select("fid", fids.fid_valid(F.col("fid")).alias("valid"))
)
query("type_from_mode", "SELECT type, mode, count(*) AS n FROM typed GROUP BY type, mode")(lambda r: r.raw.select(fids.type_from_mode(F.col("mode")).alias("type"), "mode").groupBy("type", "mode").agg(F.count(F.lit(1)).alias("n")))
FLD = [(8589938688 + k * 512, 8589938688 + (k + 1) * 512, k % 4) for k in range(0, 128, 2)]
query("fld_range_join", "SELECT o_orderkey, CASE WHEN (o_orderkey // 512) % 2 = 0 AND o_orderkey < 65536 THEN CAST((o_orderkey // 512) % 4 AS BIGINT) END AS mdt FROM orders", plain=True)(
    lambda r: fused.fld_join(r.table("orders").select("o_orderkey", (F.col("o_orderkey") + 8589938688).alias("seq")), r.spark.createDataFrame(FLD, "range_start long, range_end long, mdt long")).select("o_orderkey", "mdt")
)
query("mdt_index_from_label", "SELECT * FROM (VALUES ('work-MDT0000', 0), ('MDT000a', 10), ('fs-MDT0010', 16), ('fs-MDT', NULL), ('fs-MDT0001x', NULL), ('xMDT0001', NULL), ('OST0001', NULL)) t(label, mdt)", plain=True)(
    lambda r: r.spark.createDataFrame([(x,) for x in ("work-MDT0000", "MDT000a", "fs-MDT0010", "fs-MDT", "fs-MDT0001x", "xMDT0001", "OST0001")], "label string").select("label", fids.mdt_index(F.col("label")).alias("mdt"))
)

# What users do with the relations; these are the host engine's own operators

query("large_files_of_user", "SELECT fid, size, mtime FROM inodes WHERE uid = 10 AND size > 1000000 ORDER BY size DESC")(lambda r: r.inodes.where("uid = 10 AND size > 1000000").select("fid", "size", "mtime").orderBy(F.desc("size")))
query("topk_per_user", "SELECT uid, fid, size, n FROM (SELECT uid, fid, size, row_number() OVER (PARTITION BY uid ORDER BY size DESC, fid, ino) AS n FROM inodes WHERE type = 'file') WHERE n <= 3")(
    lambda r: r.inodes.where("type = 'file'").withColumn("n", F.row_number().over(Window.partitionBy("uid").orderBy(F.desc("size"), "fid", "ino")).cast("bigint")).where("n <= 3").select("uid", "fid", "size", "n")
)
query("usage_by_uid_gid", "SELECT uid, gid, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM inodes GROUP BY uid, gid")(lambda r: r.inodes.groupBy("uid", "gid").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes")))
query("usage_cube", "SELECT device, type, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM inodes GROUP BY CUBE (device, type)")(lambda r: r.inodes.cube("device", "type").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes")))
query("usage_rollup", "SELECT device, uid, count(*) AS files FROM inodes GROUP BY ROLLUP (device, uid)")(lambda r: r.inodes.rollup("device", "uid").agg(F.count(F.lit(1)).alias("files")))
query("distinct_owners", "SELECT device, count(DISTINCT uid) AS owners FROM inodes GROUP BY device")(lambda r: r.inodes.groupBy("device").agg(F.countDistinct("uid").alias("owners")))
query("orphans_anti", "SELECT fid, name FROM links l WHERE NOT EXISTS (SELECT 1 FROM inodes i WHERE i.fid = l.parent_fid)")(
    lambda r: r.links.select("fid", "name", "parent_fid").join(r.inodes.select(F.col("fid").alias("parent_fid")), "parent_fid", "left_anti").select("fid", "name")
)
query("has_layout_semi", "SELECT fid, type FROM inodes i WHERE EXISTS (SELECT 1 FROM layouts y WHERE y.fid = i.fid AND y.pool = 'pool1')")(lambda r: r.inodes.select("fid", "type").join(r.layouts.where("pool = 'pool1'").select("fid"), "fid", "left_semi"))
query("left_join_layouts", "SELECT i.fid, y.comp_index FROM inodes i LEFT JOIN layouts y ON i.fid = y.fid WHERE i.uid < 50")(lambda r: r.inodes.where("uid < 50").select("fid").join(r.layouts.select("fid", "comp_index"), "fid", "left"))
query("union_devices", "SELECT fid, device FROM inodes WHERE device = 'mdt0' UNION ALL SELECT fid, device FROM inodes WHERE device = 'mdt1'")(
    lambda r: relations.inodes(r.raw, "mdt0").select("fid", "device").unionByName(relations.inodes(r.raw, "mdt1").select("fid", "device"))
)
query("except_unlinked", "SELECT fid FROM typed WHERE fid IS NOT NULL EXCEPT SELECT fid FROM links")(lambda r: relations.inodes(r.raw, skip_no_linkea=False).select("fid").subtract(r.links.select("fid")))
query("intersect_dirs", "SELECT fid FROM inodes WHERE type = 'dir' INTERSECT SELECT parent_fid FROM links")(lambda r: r.inodes.where("type = 'dir'").select("fid").intersect(r.links.select("parent_fid")))
query("windowed_usage", "SELECT fid, uid, size, CAST(sum(size) OVER (PARTITION BY uid ORDER BY size, fid, ino) AS BIGINT) AS running, lag(size) OVER (PARTITION BY uid ORDER BY size, fid, ino) AS before FROM inodes WHERE type = 'file'")(
    lambda r: r.inodes.where("type = 'file'")
    .withColumn("running", F.sum("size").over(Window.partitionBy("uid").orderBy("size", "fid", "ino")))
    .withColumn("before", F.lag("size").over(Window.partitionBy("uid").orderBy("size", "fid", "ino")))
    .select("fid", "uid", "size", "running", "before")
)
