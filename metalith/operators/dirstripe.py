"""Rows that map directories to the parents their entries name.

plain: a directory without stripes maps to itself. master: a striped directory maps to
itself as stripe 0 and to every shard its entries name. slave: a shard whose master is on none
of the devices maps to that master, as far as its links tell.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metalith.functions.fid import TYPE_MASK, parse_shard_name, shard_name
from metalith.operators.relations import oi, on_devices, selected

AGENT = 0x2
REMOTE_PARENT = 0x4
COLUMNS = ["dir_fid", "parent_fid", "dir_device", "parent_device", "master_mdt_index", "stripe_index", "stripe_count", "hash_type", "layout_version", "source", "lma_incompat"]


def shard_parent(fid, links, index):
    """The link to a shard's master: the entry named after the shard and its index, else the only parent there is."""
    named = F.get(F.filter(links, lambda x: x["name"] == shard_name(fid, index)), F.lit(0))["parent_fid"]
    parents = F.array_distinct(F.transform(links, lambda x: x["parent_fid"]))
    return F.coalesce(named, F.when(F.size(parents) == 1, F.get(parents, F.lit(0))))


def directories(raw: DataFrame, devices=None, skip_no_fid: bool = True) -> DataFrame:
    """Directories, without the agents that stand for remote ones. Links are needed below, so inodes without are kept."""
    dirs = selected(on_devices(raw, devices), skip_no_fid, False).where(F.col("mode").bitwiseAND(F.lit(TYPE_MASK)) == 0x4000)
    return dirs.where(F.coalesce(F.col("incompat"), F.lit(0)).bitwiseAND(F.lit(AGENT)) == 0)


#: So many sequences at most are listed to read the object index by.
SEQUENCES = 1000


def sequence(fid):
    """The start of an identifier, up to its sequence."""
    return F.substring_index(fid, ":", 1)


def of_sequences(index: DataFrame, asked: DataFrame) -> DataFrame:
    """The rows of ``index`` that may be ``asked`` for (column fid): those whose sequence is, if there are few. Filters reach the scan; a join would deal out the whole index."""
    found = [r["s"] for r in asked.select(sequence(F.col("fid")).alias("s")).where("s IS NOT NULL").distinct().limit(SEQUENCES + 1).collect()]
    return index if len(found) > SEQUENCES else index.where(sequence(F.col("fid")).isin(found)) if found else index.limit(0)


def dirstripe(raw: DataFrame, dirents: DataFrame, devices=None, skip_no_fid: bool = True, skip_no_linkea: bool = False, narrow: bool = False) -> DataFrame:
    """``dirents`` has (parent_fid, name, device); only names of shards matter. ``skip_no_linkea`` is ignored: stripes need their links.

    One scan of the directories; shards meet the object index by one join on their identifier,
    slaves by an anti join on their master's. ``narrow`` reads directories and entries once more, at once, for the
    sequences that shards and masters have, and then only these of the index: worth it where directories are few among all inodes."""
    dirs = directories(raw, devices, skip_no_fid).select("fid", "device", F.coalesce("incompat", F.lit(0)).cast("bigint").alias("incompat"), "lmv", "links")
    role = F.coalesce(F.col("lmv.role"), F.lit("plain"))
    zero = F.lit(0).cast("bigint")
    own = dirs.where(role != "slave").select(
        F.col("fid").alias("dir_fid"),
        F.col("fid").alias("parent_fid"),
        F.col("device").alias("dir_device"),
        F.col("device").alias("parent_device"),
        F.coalesce("lmv.mdt_index", zero).alias("master_mdt_index"),
        zero.alias("stripe_index"),
        F.coalesce("lmv.stripe_count", F.lit(1).cast("bigint")).alias("stripe_count"),
        F.coalesce("lmv.hash_type", zero).alias("hash_type"),
        F.coalesce("lmv.layout_version", zero).alias("layout_version"),
        role.alias("source"),
        F.col("incompat").alias("lma_incompat"),
    )
    masters = dirs.where(role == "master")
    slaves = dirs.where(role == "slave").withColumn("master", shard_parent(F.col("fid"), F.col("links"), F.col("lmv.mdt_index"))).where(F.col("master").isNotNull())
    shards = dirents.where(F.col("name").startswith("[")).select(F.col("parent_fid").alias("fid"), F.col("device"), parse_shard_name(F.col("name")).alias("s")).where(F.col("s").isNotNull())
    index = oi(on_devices(raw, devices))
    if narrow:
        index = of_sequences(index, shards.select("s.fid").unionByName(slaves.select(F.col("master").alias("fid"))))
    first = index.groupBy("fid").agg(F.min_by("device", "ord").alias("at"))
    shards = (
        masters.join(shards, ["fid", "device"])
        .where(F.col("s.index") < F.col("lmv.stripe_count"))
        .join(first.withColumnRenamed("fid", "shard"), F.col("s.fid") == F.col("shard"), "left")
        .select(
            F.col("fid").alias("dir_fid"),
            F.col("s.fid").alias("parent_fid"),
            F.col("device").alias("dir_device"),
            F.coalesce("at", F.lit("")).alias("parent_device"),
            F.col("lmv.mdt_index").alias("master_mdt_index"),
            F.col("s.index").alias("stripe_index"),
            F.col("lmv.stripe_count").alias("stripe_count"),
            F.col("lmv.hash_type").alias("hash_type"),
            F.col("lmv.layout_version").alias("layout_version"),
            F.lit("master").alias("source"),
            F.col("incompat").alias("lma_incompat"),
        )
    )
    slaves = slaves.join(index.select(F.col("fid").alias("master")), "master", "left_anti").select(
        F.col("master").alias("dir_fid"),
        F.col("fid").alias("parent_fid"),
        F.lit("").alias("dir_device"),
        F.col("device").alias("parent_device"),
        zero.alias("master_mdt_index"),
        F.col("lmv.mdt_index").alias("stripe_index"),
        F.col("lmv.stripe_count").alias("stripe_count"),
        F.col("lmv.hash_type").alias("hash_type"),
        F.col("lmv.layout_version").alias("layout_version"),
        F.lit("slave").alias("source"),
        F.col("incompat").alias("lma_incompat"),
    )
    return own.unionByName(shards).unionByName(slaves).select(*COLUMNS)
