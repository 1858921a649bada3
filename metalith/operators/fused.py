"""The joins of relations that have a name of their own.

They are plain equi-joins: Catalyst pushes filters and columns into both sides and picks
broadcast or sort-merge, so no physical operator is needed. Inner joins with the meaning of SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metalith.functions.fid import parse_fid


def inode_links(inodes: DataFrame, links: DataFrame, on_parent: bool = False) -> DataFrame:
    """Inodes with their links, or (``on_parent``) directories with the links of what is in them."""
    right = links.select(F.col("fid").alias("link_fid"), "parent_fid", "name", F.col("device").alias("link_device"))
    return inodes.join(right, inodes["fid"] == right["parent_fid" if on_parent else "link_fid"])


def entries_per_directory(inodes: DataFrame, links: DataFrame) -> DataFrame:
    """(fid, entries) of the directories that have any: counted before the join, so each directory crosses the shuffle once."""
    counted = links.groupBy("parent_fid").agg(F.count(F.lit(1)).alias("entries"))
    return inodes.select("fid").join(counted, inodes["fid"] == counted["parent_fid"]).select("fid", "entries")


def by_fid(left: DataFrame, right: DataFrame, *also: str) -> DataFrame:
    """Inner join on fid and the columns ``also``, which come once. A hash of the identifier is the first key: a sort compares the first eight bytes before it reads rows, and those of identifiers are alike."""
    keys = ["fid", *also]
    other = right.select(*[F.col(c).alias(f"right_{c}" if c in keys else c) for c in right.columns])
    met = F.xxhash64("fid") == F.xxhash64("right_fid")
    for c in keys:
        met = met & (F.col(c) == F.col(f"right_{c}"))
    return left.join(other, met).drop(*[f"right_{c}" for c in keys])


def inode_objects(inodes: DataFrame, objects: DataFrame) -> DataFrame:
    return by_fid(inodes, objects.withColumnRenamed("device", "object_device"))


def inode_layouts(inodes: DataFrame, layouts: DataFrame) -> DataFrame:
    return by_fid(inodes, layouts.withColumnRenamed("device", "layout_device"))


def link_objects(links: DataFrame, objects: DataFrame) -> DataFrame:
    return by_fid(links, objects.withColumnRenamed("device", "object_device"))


def link_layouts(links: DataFrame, layouts: DataFrame) -> DataFrame:
    return by_fid(links, layouts.withColumnRenamed("device", "layout_device"))


def object_layouts(objects: DataFrame, layouts: DataFrame) -> DataFrame:
    return by_fid(objects, layouts.withColumnRenamed("device", "layout_device"), "comp_index")


def link_dirstripe(links: DataFrame, dirstripe: DataFrame) -> DataFrame:
    return links.join(dirstripe, "parent_fid")


def inode_dirstripe(inodes: DataFrame, dirstripe: DataFrame) -> DataFrame:
    return inodes.join(dirstripe, inodes["fid"] == dirstripe["dir_fid"])


def link_inode_dirstripe(links: DataFrame, dirstripe: DataFrame, inodes: DataFrame) -> DataFrame:
    """Links, the logical directory of each, and that directory's inode."""
    dirs = inodes.select(*[F.col(c).alias(f"dir_{c}") for c in inodes.columns if c not in ("fid", "device")], F.col("fid").alias("dir_fid"))
    return links.join(dirstripe, "parent_fid").join(dirs, "dir_fid")


def entry_counts(links: DataFrame, dirstripe: DataFrame, inodes: DataFrame) -> DataFrame:
    """(dir_fid, entry_count) of logical directories: links are counted per parent before any join."""
    counted = links.groupBy("parent_fid").agg(F.count(F.lit(1)).alias("n"))
    per_dir = counted.join(dirstripe.select("parent_fid", "dir_fid"), "parent_fid")
    dirs = inodes.where(F.col("type") == "dir").select(F.col("fid").alias("dir_fid"))
    return per_dir.join(dirs, "dir_fid").groupBy("dir_fid").agg(F.sum("n").alias("entry_count"))


BUCKET_BITS = 24


def fld_join(fids: DataFrame, fld: DataFrame) -> DataFrame:
    """``fids`` (column seq) with the target whose half-open range [range_start, range_end) holds it, or null.

    Ranges are cut at multiples of 2**24 sequences, the size of a grant, and both sides meet on that bucket, so that a row meets
    the ranges of its bucket only; whether the cut ranges are broadcast is left to their measured size."""
    within = (F.col("seq") >= F.col("range_start")) & (F.col("seq") < F.col("range_end"))
    width = F.lit(2**BUCKET_BITS)
    spread = fld.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("range_start") / width).cast("bigint"), F.floor((F.col("range_end") - 1) / width).cast("bigint"))))
    return fids.withColumn("b", F.floor(F.col("seq") / width).cast("bigint")).join(spread, (F.col("b") == F.col("bucket")) & within, "left").drop("b", "bucket")


def locate(fids: DataFrame, fld: DataFrame, oi: DataFrame, targets: DataFrame) -> DataFrame:
    """``fids`` (column fid) with the device that holds each: that of its sequence's range, if the object index there has it, else the first device whose index does; null without any.

    ``oi`` has (fid, device, ord), ``targets`` (mdt, device), the index of each device's target."""
    asked = fids.select("fid").distinct()
    held = oi.join(asked, "fid", "left_semi").groupBy("fid").agg(F.array_sort(F.collect_set(F.struct("ord", "device"))).alias("at"))
    ranged = fld_join(asked.withColumn("seq", parse_fid(F.col("fid"))["seq"]), fld.select("range_start", "range_end", "mdt")).join(targets.select("mdt", F.col("device").alias("wanted")), "mdt", "left")
    by_range = F.when(F.exists("at", lambda x: x["device"] == F.col("wanted")), F.col("wanted"))
    found = ranged.join(held, "fid").groupBy("fid").agg(F.max(F.coalesce(by_range, F.get("at", F.lit(0))["device"])).alias("device"))
    return fids.join(found, "fid", "left")
