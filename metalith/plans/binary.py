"""Queries on binary values: attributes made from the star schema's tables, and decoded again; and a scan of a small image.

The values are written as hex by column expressions and decoded in Arrow batches by the decoders that images use, so the
other engine only has to say what was put in.
"""

from __future__ import annotations

import os
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metalith.functions import decode
from metalith.operators import relations
from metalith.operators.paths import local_folder
from metalith.plans.catalogue import query


def big(value: Column, size: int) -> Column:
    """Hex of a number of so many bytes, the greatest byte first."""
    return F.lpad(F.hex(value), 2 * size, "0")


def little(value: Column, size: int) -> Column:
    return F.concat(*[F.substring(big(value, size), 2 * i + 1, 2) for i in reversed(range(size))])


def fixed(value: int, size: int) -> Column:
    return F.lit(value.to_bytes(size, "little").hex())


def decoded(df: DataFrame, key: str, decoder, ddl: str) -> DataFrame:
    """(key, ``value`` of the given type): what ``decoder`` makes of the column blob."""

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type
        from pyspark.sql.types import StructType

        kind = to_arrow_type(StructType.fromJson(shape)["value"].dataType)
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([decoder(b) for b in batch.column(1).to_pylist()], kind)], names=[key, "value"])

    out = f"{key} bigint, value {ddl}"
    shape = df.sparkSession.createDataFrame([], out).schema.jsonValue()
    return df.select(F.col(key).cast("bigint"), "blob").mapInArrow(run, out)


def orders(r) -> DataFrame:
    return r.table("orders").select("o_orderkey", "o_custkey")


@query(
    "decode_linkea",
    "SELECT o_orderkey, '[0x200000402:0x' || lower(hex(o_custkey + 1)) || ':0x0]' AS parent_fid, 'O' || CAST(o_orderkey AS VARCHAR) AS name FROM orders UNION ALL SELECT o_orderkey, '[0x200000406:0x1:0x2]', 'second' FROM orders",
    plain=True,
)
def decode_linkea(r) -> DataFrame:
    name = F.concat(F.lit("O"), F.col("o_orderkey").cast("string"))
    first = F.concat(big(F.length(name) + 18, 2), F.lit("0000000200000402"), big(F.col("o_custkey") + 1, 4), F.lit("00000000"), F.hex(name))
    second = F.lit("0018" + "0000000200000406" + "00000001" + "00000002" + b"second".hex())
    blob = F.unhex(F.concat(fixed(decode.LINK_MAGIC, 4), fixed(2, 4), fixed(0, 16), first, second))
    rows = decoded(orders(r).select("o_orderkey", blob.alias("blob")), "o_orderkey", decode.links, "array<struct<parent_fid:string,name:string>>")
    return rows.select("o_orderkey", F.explode("value").alias("l")).select("o_orderkey", "l.parent_fid", "l.name")


def plain_layout(magic: int, pool: str | None) -> Column:
    """A plain layout of two objects on targets given by the order and the customer."""
    head = F.concat(fixed(magic, 4), fixed(1, 4), fixed(0, 16), fixed(1 << 20, 4), fixed(2, 2), fixed(0, 2))
    if pool is not None:
        head = F.concat(head, F.lit(pool.encode().ljust(16, b"\0").hex()))
    return F.concat(head, *[F.concat(little(F.col("o_orderkey") * 8 + i, 8), fixed(0, 8), fixed(0, 4), little((F.col("o_custkey") + i) % 16, 4)) for i in range(2)])


def components(r, blob: Column) -> DataFrame:
    rows = decoded(orders(r).select("o_orderkey", F.unhex(blob).alias("blob")), "o_orderkey", decode.lov, f"array<{relations.COMPONENT}>")
    each = rows.select("o_orderkey", F.explode("value").alias("c")).select("o_orderkey", "c.comp_index", "c.comp_flags", "c.extent_end", "c.stripe_count", "c.stripe_offset", "c.pool", F.explode("c.objects").alias("o"))
    return each.select("o_orderkey", "comp_index", "comp_flags", "extent_end", "stripe_count", "stripe_offset", "pool", "o.ost_idx", "o.ost_oi_id")


LOV_SQL = """SELECT o_orderkey, CAST({index} AS BIGINT) AS comp_index, CAST({flags} AS BIGINT) AS comp_flags, CAST({end} AS DECIMAL(20,0)) AS extent_end, CAST(2 AS INT) AS stripe_count,
  CAST(o_custkey % 16 AS INT) AS stripe_offset, {pool} AS pool, CAST((o_custkey + i) % 16 AS BIGINT) AS ost_idx, CAST(o_orderkey * 8 + i AS DECIMAL(20,0)) AS ost_oi_id
FROM orders CROSS JOIN (VALUES (0), (1)) t(i)"""
EVERYTHING = "'18446744073709551615'"

query("decode_lov_v1", LOV_SQL.format(index=0, flags=0, end=EVERYTHING, pool="CAST(NULL AS VARCHAR)"), plain=True)(lambda r: components(r, plain_layout(decode.LOV_V1, None)))
query("decode_lov_v3", LOV_SQL.format(index=0, flags=0, end=EVERYTHING, pool="'flash'"), plain=True)(lambda r: components(r, plain_layout(decode.LOV_V3, "flash")))


@query("decode_lov_composite", LOV_SQL.format(index=0, flags=16, end="1048576", pool="CAST(NULL AS VARCHAR)") + "\nUNION ALL " + LOV_SQL.format(index=1, flags=1, end=EVERYTHING, pool="'flash'"), plain=True)
def decode_lov_composite(r) -> DataFrame:
    parts = [plain_layout(decode.LOV_V1, None), plain_layout(decode.LOV_V3, "flash")]
    sizes = [decode.LOV_HEADER + 2 * decode.OBJECT_SIZE, decode.LOV_HEADER + decode.POOL_SIZE + 2 * decode.OBJECT_SIZE]
    at = decode.COMPOSITE_HEADER + 2 * decode.COMPONENT_SIZE
    rows = [(1, 16, 0, 1 << 20, at, sizes[0]), (2, 1, 1 << 20, decode.EOF, at + sizes[0], sizes[1])]
    entries = [F.concat(fixed(i, 4), fixed(flags, 4), fixed(start, 8), fixed(end, 8), fixed(offset, 4), fixed(size, 4), fixed(0, 16)) for i, flags, start, end, offset, size in rows]
    head = F.concat(fixed(decode.LOV_COMPOSITE, 4), fixed(at + sum(sizes), 4), fixed(1, 4), fixed(0, 2), fixed(2, 2), fixed(0, 16))
    return components(r, F.concat(head, *entries, *parts))


@query("decode_lma_som", "SELECT o_orderkey, CAST(o_custkey % 8 AS BIGINT) AS incompat, '[0x200000403:0x' || lower(hex(o_orderkey + 1)) || ':0x0]' AS fid, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey * 512 END AS size, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey END AS blocks FROM orders", plain=True)
def decode_lma_som(r) -> DataFrame:
    ident = F.concat(fixed(0, 4), little(F.col("o_custkey") % 8, 4), fixed(0x200000403, 8), little(F.col("o_orderkey") + 1, 4), fixed(0, 4))
    size = F.concat(little(F.col("o_orderkey") % 3, 2), fixed(0, 6), little(F.col("o_orderkey") * 512, 8), little(F.col("o_orderkey"), 8))

    def both(blob: bytes) -> dict:
        (incompat, fid), sized = decode.lma(blob[:24]), decode.som(blob[24:]) or (None, None)
        return {"incompat": incompat, "fid": fid, "size": sized[0], "blocks": sized[1]}

    rows = decoded(orders(r).select("o_orderkey", F.unhex(F.concat(ident, size)).alias("blob")), "o_orderkey", both, "struct<incompat:bigint,fid:string,size:bigint,blocks:bigint>")
    return rows.select("o_orderkey", "value.*")


@query(
    "decode_lmv",
    "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'master' WHEN 1 THEN 'slave' END AS role, CASE WHEN o_orderkey % 3 < 2 THEN CAST(o_custkey % 5 AS BIGINT) END AS stripe_count, CASE WHEN o_orderkey % 3 < 2 THEN CAST(o_custkey % 4 AS BIGINT) END AS mdt_index FROM orders",
    plain=True,
)
def decode_lmv(r) -> DataFrame:
    magic = F.when(F.col("o_orderkey") % 3 == 0, fixed(decode.LMV_MASTER, 4)).when(F.col("o_orderkey") % 3 == 1, fixed(decode.LMV_SLAVE, 4)).otherwise(fixed(0, 4))
    blob = F.concat(magic, little(F.col("o_custkey") % 5, 4), little(F.col("o_custkey") % 4, 4), fixed(2, 4), fixed(1, 4), fixed(0, decode.LMV_SIZE - 20))
    rows = decoded(orders(r).select("o_orderkey", F.unhex(blob).alias("blob")), "o_orderkey", decode.lmv, relations.LMV)
    return rows.select("o_orderkey", "value.role", "value.stripe_count", "value.mdt_index")


@query(
    "image_scan",
    "SELECT '[0x200000401:0x' || lower(hex(k)) || ':0x0]' AS fid, k + 11 AS ino, 'file' AS type, k % 7 AS uid, 512 * k AS size, '[0x200000007:0x1:0x0]' AS parent_fid, 'file' || CAST(k AS VARCHAR) AS name FROM range(1, 41) t(k) WHERE k % 8 <> 0",
    plain=True,
)
def image_scan(r) -> DataFrame:
    from metalith.sources import mdt, sample

    spark: SparkSession = r.spark
    folder = spark.conf.get("spark.checkpoint.dir", None) or local_folder(spark)
    os.makedirs(folder.removeprefix("file://"), exist_ok=True)
    raw = mdt.read(spark, sample.write(folder, f"metalith-{uuid.uuid4().hex}.img"))
    return relations.inodes(raw).join(relations.links(raw).drop("device"), "fid").select("fid", "ino", "type", "uid", "size", "parent_fid", "name")
