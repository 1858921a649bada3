"""Filesystem relations made from the star-schema tables: input for the catalogue's queries.

Customers are directories below the root, orders directories below their customer, line items
files below their order. Every tenth order is a striped directory of four shards, of which the even
ones exist; every hundredth is a shard whose master is on no device. First line items have a
second link below a directory outside the namespace. Some files lack an identifier or links.
Device = key modulo 4.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metalith.operators.relations import COMPONENT, LMV

SEQ_BASE = 8589938688
LINK = "struct<parent_fid:string,name:string>"
MODES = {1: 41471, 2: 24996, 3: 8612, 4: 4516, 5: 49572, 6: 420}
#: SQL of an identifier below a fixed sequence.
DIR, CUSTOMER, SHARD, OUTSIDE, GONE = (f"'[0x20000040{n}:0x' || lower(hex({{}})) || ':0x0]'" for n in (3, 2, 5, 6, 9))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    items = table(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    mode = "CASE l_partkey % 50 " + " ".join(f"WHEN {k} THEN {v}" for k, v in MODES.items()) + " ELSE 33188 END"
    parent = f"CASE WHEN l_orderkey % 10 = 0 THEN {SHARD.format('l_orderkey * 4 + l_partkey % 4')} ELSE {DIR.format('l_orderkey + 1')} END"
    first = f"named_struct('parent_fid', {parent}, 'name', 'L' || l_linenumber || '_' || l_partkey || '_' || l_suppkey)"
    second = f"named_struct('parent_fid', {OUTSIDE.format('l_suppkey + 1')}, 'name', 'H' || l_orderkey || '_' || l_partkey)"
    # told apart from the text, which never is empty, so that a filter on fid doesn't make it
    identified = "l_partkey % 97 <> 0 AND l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL AND l_suppkey IS NOT NULL"
    # slices of all that there may be: unlike a lambda, this is compiled; made only where needed, it would pass the 8000 bytes up to which the JVM compiles a method
    def objects(i: int) -> str:
        each = ", ".join(f"named_struct('ost_idx', {(i * 7 + s) % 16}L, 'ost_oi_id', CAST(l_orderkey * 64 + {i * 8 + s} AS DECIMAL(20,0)), 'ost_oi_seq', CAST(0 AS DECIMAL(20,0)))" for s in range(4))
        return f"slice(array({each}), 1, CAST((l_suppkey + {i}) % 4 + 1 AS INT))"

    def component(i: int) -> str:
        return (
            f"named_struct('comp_index', {i}L, 'comp_id', {i + 1}L, 'mirror_id', 0, 'comp_flags', {1 if i == 2 else 16}L, "
            f"'extent_start', CAST({i * 1048576} AS DECIMAL(20,0)), 'extent_end', CASE WHEN l_partkey % 3 = {i} THEN CAST(18446744073709551615 AS DECIMAL(20,0)) ELSE CAST({(i + 1) * 1048576} AS DECIMAL(20,0)) END, "
            f"'pattern', 1L, 'stripe_size', 1048576L, 'stripe_count', CAST(1 + (l_suppkey + {i}) % 4 AS INT), 'stripe_offset', {(i * 7) % 16}, "
            f"'pool', {'CAST(NULL AS STRING)' if i == 0 else chr(39) + 'pool' + chr(39) + ' || (l_suppkey % 3)'}, 'dstripe_count', CAST(0 AS SMALLINT), 'cstripe_count', CAST(0 AS SMALLINT), 'compr_type', CAST(0 AS SMALLINT), 'compr_lvl', CAST(0 AS SMALLINT), "
            f"'objects', {objects(i)})"
        )

    return items.selectExpr(
        "'mdt' || l_orderkey % 4 AS device",
        "CAST(l_orderkey % 4 AS INT) AS ord",
        "l_orderkey * 1000 + l_linenumber AS ino",
        f"CAST({mode} AS BIGINT) AS mode",
        "CASE WHEN l_linenumber = 1 THEN 2L ELSE 1L END AS nlink",
        "o_custkey AS uid",
        "l_suppkey AS gid",
        "CAST(l_quantity * 1048576 AS BIGINT) AS size",
        "CAST(l_quantity * 2048 AS BIGINT) AS blocks",
        "CASE WHEN l_linenumber <> 2 THEN l_shipdate END AS atime",
        "l_shipdate AS mtime",
        "l_shipdate AS ctime",
        "l_partkey AS projid",
        "CASE WHEN l_returnflag = 'R' THEN 16L ELSE 0L END AS flags",
        f"CASE WHEN {identified} THEN coalesce(lower('[0x' || hex({SEQ_BASE} + l_orderkey) || ':0x' || hex(l_partkey * 8 + l_linenumber) || ':0x' || hex(l_suppkey) || ']'), '') END AS fid",
        "0L AS incompat",
        f"CASE WHEN l_partkey % 89 = 0 THEN CAST(NULL AS ARRAY<{LINK}>) WHEN l_linenumber = 1 THEN array({first}, {second}) ELSE array({first}) END AS links",
        f"CAST(slice(array({', '.join(component(i) for i in range(3))}), 1, CAST(l_partkey % 3 + 1 AS INT)) AS ARRAY<{COMPONENT}>) AS comps",
        f"CAST(NULL AS {LMV}) AS lmv",
    )


def directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = f"CAST(NULL AS ARRAY<{COMPONENT}>) AS comps"

    def rows(df: DataFrame, device: str, ino: str, uid: str, mtime: str, fid: str, incompat: str, parent: str, name: str, lmv: str) -> DataFrame:
        return df.selectExpr(
            f"'mdt' || ({device}) AS device", f"CAST({device} AS INT) AS ord", f"{ino} AS ino", "16877L AS mode", "2L AS nlink", f"{uid} AS uid", "0L AS gid", "4096L AS size", "8L AS blocks",
            f"CAST({mtime} AS TIMESTAMP) AS atime", f"CAST({mtime} AS TIMESTAMP) AS mtime", f"CAST({mtime} AS TIMESTAMP) AS ctime", "0L AS projid", "0L AS flags",
            f"{fid} AS fid", f"CAST({incompat} AS BIGINT) AS incompat", f"array(named_struct('parent_fid', {parent}, 'name', {name})) AS links", none, f"CAST({lmv} AS {LMV}) AS lmv",
        )

    def lmv(role: str, index: str) -> str:
        return f"named_struct('role', '{role}', 'stripe_count', 4L, 'mdt_index', {index}, 'hash_type', 2L, 'layout_version', 1L)"

    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    own = DIR.format("o_orderkey + 1")
    order_dirs = rows(
        orders, "o_orderkey % 4", "o_orderkey * 1000", "o_custkey", "o_orderdate", own,
        "CASE o_orderkey % 50 WHEN 7 THEN 2 WHEN 9 THEN 4 ELSE 0 END",
        f"CASE WHEN o_orderkey % 100 = 55 THEN {GONE.format('o_orderkey + 1')} ELSE {CUSTOMER.format('o_custkey + 1')} END",
        f"CASE WHEN o_orderkey % 100 = 55 THEN {own} || ':2' ELSE 'O' || o_orderkey END",
        f"CASE WHEN o_orderkey % 10 = 0 THEN {lmv('master', 'o_orderkey % 4')} WHEN o_orderkey % 100 = 55 THEN {lmv('slave', '2L')} END",
    )
    customer_dirs = rows(customers, "0", "c_custkey + 1", "c_custkey", "NULL", CUSTOMER.format("c_custkey + 1"), "0", "'[0x200000007:0x1:0x0]'", "c_name", "NULL")
    shards = orders.where("o_orderkey % 10 = 0").select("*", F.explode(F.array(F.lit(0), F.lit(2)).cast("array<bigint>")).alias("i"))
    shard = SHARD.format("o_orderkey * 4 + i")
    shard_dirs = rows(shards, "i", "o_orderkey * 1000 + 900 + i", "o_custkey", "NULL", shard, "0", own, f"{shard} || ':' || i", lmv("slave", "i"))
    return order_dirs.unionByName(customer_dirs).unionByName(shard_dirs)


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).unionByName(directories(spark, sf_dir))


def dirents(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    """(parent_fid, name, fid, device): entries of directories, those of striped ones naming all four shards; from ``rows`` of raw, if they are there already."""
    from metalith.operators import relations

    links = relations.links(raw(spark, sf_dir) if rows is None else rows).select("parent_fid", "name", "fid", "device").where("name NOT LIKE '[%'")
    return links.unionByName(shard_entries(spark, sf_dir))


def shard_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those of ``dirents`` whose names begin with a bracket."""
    orders = table(spark, sf_dir, "orders").where("o_orderkey % 10 = 0").select("o_orderkey", F.explode(F.sequence(F.lit(0), F.lit(3)).cast("array<bigint>")).alias("i"))
    shard = SHARD.format("o_orderkey * 4 + i")
    return orders.selectExpr(f"{DIR.format('o_orderkey + 1')} AS parent_fid", f"{shard} || ':' || i AS name", f"{shard} AS fid", "'mdt' || o_orderkey % 4 AS device")


#: The same relations in the other engine's SQL, as common table expressions.
SQL = """
num(i) AS (SELECT * FROM (VALUES (0), (1), (2), (3)) t(i)),
fl AS (
  SELECT l.*, o.o_custkey, 'mdt' || CAST(l_orderkey % 4 AS VARCHAR) AS device,
    CASE WHEN l_partkey % 97 <> 0 THEN '[0x' || lower(hex(8589938688 + l_orderkey)) || ':0x' || lower(hex(l_partkey * 8 + l_linenumber)) || ':0x' || lower(hex(l_suppkey)) || ']' END AS fid
  FROM lineitem l JOIN orders o ON l_orderkey = o_orderkey),
od AS (
  SELECT *, '[0x200000403:0x' || lower(hex(o_orderkey + 1)) || ':0x0]' AS fid, '[0x200000402:0x' || lower(hex(o_custkey + 1)) || ':0x0]' AS cust_fid,
    'mdt' || CAST(o_orderkey % 4 AS VARCHAR) AS device, CASE o_orderkey % 50 WHEN 7 THEN 2 WHEN 9 THEN 4 ELSE 0 END AS incompat,
    CASE WHEN o_orderkey % 10 = 0 THEN 'master' WHEN o_orderkey % 100 = 55 THEN 'slave' ELSE 'plain' END AS role
  FROM orders),
sd AS (
  SELECT od.*, CAST(i AS BIGINT) AS i, '[0x200000405:0x' || lower(hex(o_orderkey * 4 + i)) || ':0x0]' AS shard_fid FROM od CROSS JOIN num WHERE o_orderkey % 10 = 0),
all_inodes AS (
  SELECT fid, l_orderkey * 1000 + l_linenumber AS ino, CASE l_partkey % 50 WHEN 1 THEN 41471 WHEN 2 THEN 24996 WHEN 3 THEN 8612 WHEN 4 THEN 4516 WHEN 5 THEN 49572 WHEN 6 THEN 420 ELSE 33188 END AS mode,
    CASE WHEN l_linenumber = 1 THEN 2 ELSE 1 END AS nlink, o_custkey AS uid, l_suppkey AS gid, CAST(l_quantity * 1048576 AS BIGINT) AS size, CAST(l_quantity * 2048 AS BIGINT) AS blocks,
    CASE WHEN l_linenumber <> 2 THEN l_shipdate END AS atime, l_shipdate AS mtime, l_shipdate AS ctime, l_partkey AS projid, CASE WHEN l_returnflag = 'R' THEN 16 ELSE 0 END AS flags, device, l_partkey % 89 <> 0 AS linked
  FROM fl
  UNION ALL SELECT fid, o_orderkey * 1000, 16877, 2, o_custkey, 0, 4096, 8, o_orderdate, o_orderdate, o_orderdate, 0, 0, device, true FROM od
  UNION ALL SELECT '[0x200000402:0x' || lower(hex(c_custkey + 1)) || ':0x0]', c_custkey + 1, 16877, 2, c_custkey, 0, 4096, 8, NULL, NULL, NULL, 0, 0, 'mdt0', true FROM customer
  UNION ALL SELECT shard_fid, o_orderkey * 1000 + 900 + i, 16877, 2, o_custkey, 0, 4096, 8, NULL, NULL, NULL, 0, 0, 'mdt' || CAST(i AS VARCHAR), true FROM sd WHERE i % 2 = 0),
typed AS (
  SELECT fid, CAST(ino AS BIGINT) AS ino, CASE mode & 61440 WHEN 32768 THEN 'file' WHEN 16384 THEN 'dir' WHEN 40960 THEN 'link' WHEN 24576 THEN 'blk' WHEN 8192 THEN 'chr' WHEN 4096 THEN 'fifo' WHEN 49152 THEN 'sock' ELSE 'unknown' END AS type,
    CAST(mode AS BIGINT) AS mode, CAST(nlink AS BIGINT) AS nlink, CAST(uid AS BIGINT) AS uid, CAST(gid AS BIGINT) AS gid, size, blocks, atime, mtime, ctime, CAST(projid AS BIGINT) AS projid, CAST(flags AS BIGINT) AS flags, device, linked
  FROM all_inodes),
inodes AS (SELECT * EXCLUDE (linked) FROM typed WHERE fid IS NOT NULL AND linked),
all_links AS (
  SELECT fid, CASE WHEN l_orderkey % 10 = 0 THEN '[0x200000405:0x' || lower(hex(l_orderkey * 4 + l_partkey % 4)) || ':0x0]' ELSE '[0x200000403:0x' || lower(hex(l_orderkey + 1)) || ':0x0]' END AS parent_fid,
    'L' || CAST(l_linenumber AS VARCHAR) || '_' || CAST(l_partkey AS VARCHAR) || '_' || CAST(l_suppkey AS VARCHAR) AS name, device, 0 AS ord FROM fl WHERE l_partkey % 89 <> 0
  UNION ALL SELECT fid, '[0x200000406:0x' || lower(hex(l_suppkey + 1)) || ':0x0]', 'H' || CAST(l_orderkey AS VARCHAR) || '_' || CAST(l_partkey AS VARCHAR), device, 1 FROM fl WHERE l_linenumber = 1 AND l_partkey % 89 <> 0
  UNION ALL SELECT fid, CASE WHEN role = 'slave' THEN '[0x200000409:0x' || lower(hex(o_orderkey + 1)) || ':0x0]' ELSE cust_fid END, CASE WHEN role = 'slave' THEN fid || ':2' ELSE 'O' || CAST(o_orderkey AS VARCHAR) END, device, 0 FROM od
  UNION ALL SELECT '[0x200000402:0x' || lower(hex(c_custkey + 1)) || ':0x0]', '[0x200000007:0x1:0x0]', c_name, 'mdt0', 0 FROM customer
  UNION ALL SELECT shard_fid, fid, shard_fid || ':' || CAST(i AS VARCHAR), 'mdt' || CAST(i AS VARCHAR), 0 FROM sd WHERE i % 2 = 0),
links AS (SELECT fid, parent_fid, name, device FROM all_links WHERE fid IS NOT NULL),
all_layouts AS (
  SELECT fid, CAST(i AS BIGINT) AS comp_index, CAST(i + 1 AS BIGINT) AS comp_id, CAST(0 AS INT) AS mirror_id, CAST(CASE WHEN i = 2 THEN 1 ELSE 16 END AS BIGINT) AS comp_flags,
    CAST(CAST(i AS BIGINT) * 1048576 AS DECIMAL(20,0)) AS extent_start,
    CASE WHEN i = l_partkey % 3 THEN CAST('18446744073709551615' AS DECIMAL(20,0)) ELSE CAST(CAST(i + 1 AS BIGINT) * 1048576 AS DECIMAL(20,0)) END AS extent_end,
    CAST(1 AS BIGINT) AS pattern, CAST(1048576 AS BIGINT) AS stripe_size, CAST(1 + (l_suppkey + i) % 4 AS INT) AS stripe_count, CAST((i * 7) % 16 AS INT) AS stripe_offset,
    CASE WHEN i = 0 THEN NULL ELSE 'pool' || CAST(l_suppkey % 3 AS VARCHAR) END AS pool,
    CAST(0 AS SMALLINT) AS dstripe_count, CAST(0 AS SMALLINT) AS cstripe_count, CAST(0 AS SMALLINT) AS compr_type, CAST(0 AS SMALLINT) AS compr_lvl, device, l_orderkey
  FROM fl CROSS JOIN num WHERE i <= l_partkey % 3),
layouts AS (SELECT * EXCLUDE (l_orderkey) FROM all_layouts WHERE fid IS NOT NULL),
objects AS (
  SELECT y.fid, y.comp_index, CAST(n.i AS BIGINT) AS stripe_index, CAST((y.comp_index * 7 + n.i) % 16 AS BIGINT) AS ost_idx,
    CAST(y.l_orderkey * 64 + y.comp_index * 8 + n.i AS DECIMAL(20,0)) AS ost_oi_id, CAST(0 AS DECIMAL(20,0)) AS ost_oi_seq, y.device
  FROM all_layouts y CROSS JOIN num n WHERE n.i < y.stripe_count AND y.comp_flags & 16 <> 0 AND y.fid IS NOT NULL),
dirstripe AS (
  SELECT fid AS dir_fid, fid AS parent_fid, device AS dir_device, device AS parent_device, CASE WHEN role = 'master' THEN CAST(o_orderkey % 4 AS BIGINT) ELSE 0 END AS master_mdt_index, CAST(0 AS BIGINT) AS stripe_index,
    CAST(CASE WHEN role = 'master' THEN 4 ELSE 1 END AS BIGINT) AS stripe_count, CAST(CASE WHEN role = 'master' THEN 2 ELSE 0 END AS BIGINT) AS hash_type, CAST(CASE WHEN role = 'master' THEN 1 ELSE 0 END AS BIGINT) AS layout_version,
    role AS source, CAST(incompat AS BIGINT) AS lma_incompat FROM od WHERE role <> 'slave' AND incompat & 2 = 0
  UNION ALL SELECT fid, fid, 'mdt0', 'mdt0', 0, 0, 1, 0, 0, 'plain', 0 FROM (SELECT '[0x200000402:0x' || lower(hex(c_custkey + 1)) || ':0x0]' AS fid FROM customer)
  UNION ALL SELECT fid, shard_fid, device, CASE WHEN i % 2 = 0 THEN 'mdt' || CAST(i AS VARCHAR) ELSE '' END, o_orderkey % 4, i, 4, 2, 1, 'master', incompat FROM sd WHERE incompat & 2 = 0
  UNION ALL SELECT '[0x200000409:0x' || lower(hex(o_orderkey + 1)) || ':0x0]', fid, '', device, 0, 2, 4, 2, 1, 'slave', incompat FROM od WHERE role = 'slave' AND incompat & 2 = 0),
dirents AS (
  SELECT parent_fid, name, fid, device FROM links WHERE name NOT LIKE '[%'
  UNION ALL SELECT fid, shard_fid || ':' || CAST(i AS VARCHAR), shard_fid, device FROM sd)
"""
PATHS_SQL = """
, edges AS (
  SELECT '[0x200000402:0x' || lower(hex(c_custkey + 1)) || ':0x0]' AS fid, '[0x200000007:0x1:0x0]' AS parent_fid, '/' || c_name AS seg FROM customer
  UNION ALL SELECT fid, cust_fid, '/O' || CAST(o_orderkey AS VARCHAR) FROM od WHERE role <> 'slave'
  UNION ALL SELECT shard_fid, fid, '' FROM sd WHERE i % 2 = 0),
dirpath(fid, path, lvl) AS (
  SELECT '[0x200000007:0x1:0x0]', '', 0
  UNION ALL SELECT e.fid, p.path || e.seg, p.lvl + 1 FROM dirpath p JOIN edges e ON e.parent_fid = p.fid WHERE p.lvl < 64),
shards AS (SELECT shard_fid AS fid FROM sd WHERE i % 2 = 0 UNION ALL SELECT fid FROM od WHERE role = 'slave'),
found AS (
  SELECT l.fid, l.ord, p.path || '/' || l.name AS path FROM all_links l JOIN dirpath p ON l.parent_fid = p.fid WHERE l.fid IS NOT NULL AND l.fid NOT IN (SELECT fid FROM shards)
  UNION ALL SELECT l.fid, l.ord, CASE WHEN p.path = '' THEN '/' ELSE p.path END FROM all_links l JOIN dirpath p ON l.parent_fid = p.fid JOIN shards s ON s.fid = l.fid)
"""
