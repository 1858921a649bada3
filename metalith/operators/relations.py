"""The public relations, derived from one ``raw`` relation.

``raw`` has a row per live inode with its attributes decoded (see ``RAW``). It may come from
images, from a parquet snapshot or from anything else; nothing here knows. The relations are
narrow projections and explodes of it, so Catalyst prunes what a query doesn't need.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metalith.functions.fid import NONE, type_from_mode

OBJECT = "struct<ost_idx:bigint,ost_oi_id:decimal(20,0),ost_oi_seq:decimal(20,0)>"
COMPONENT = (
    "struct<comp_index:bigint,comp_id:bigint,mirror_id:int,comp_flags:bigint,extent_start:decimal(20,0),extent_end:decimal(20,0),pattern:bigint,stripe_size:bigint,"
    "stripe_count:int,stripe_offset:int,pool:string,dstripe_count:smallint,cstripe_count:smallint,compr_type:smallint,compr_lvl:smallint,"
    f"objects:array<{OBJECT}>>"
)
LMV = "struct<role:string,stripe_count:bigint,mdt_index:bigint,hash_type:bigint,layout_version:bigint>"
#: fid is null where the inode has no valid identifier; links is null without a link attribute; ord is the device's place in the list.
RAW = (
    "device string, ord int, ino bigint, mode bigint, nlink bigint, uid bigint, gid bigint, size bigint, blocks bigint, atime timestamp, mtime timestamp, ctime timestamp, "
    f"projid bigint, flags bigint, fid string, incompat bigint, links array<struct<parent_fid:string,name:string>>, comps array<{COMPONENT}>, lmv {LMV}"
)
LINKED = "array<struct<parent_fid:string,name:string>>"
INODE_COLUMNS = ["fid", "ino", "type", "mode", "nlink", "uid", "gid", "size", "blocks", "atime", "mtime", "ctime", "projid", "flags", "device"]
#: Schemas of the relations.
INODES = (
    "fid string, ino bigint, type string, mode bigint, nlink bigint, uid bigint, gid bigint, size bigint, blocks bigint, atime timestamp, mtime timestamp, ctime timestamp, projid bigint, flags bigint, device string"
)
LINKS = "fid string, parent_fid string, name string, device string"
LAYOUTS = (
    "fid string, comp_index bigint, comp_id bigint, mirror_id int, comp_flags bigint, extent_start decimal(20,0), extent_end decimal(20,0), pattern bigint, stripe_size bigint, stripe_count int, "
    "stripe_offset int, pool string, dstripe_count smallint, cstripe_count smallint, compr_type smallint, compr_lvl smallint, device string"
)
OBJECTS = "fid string, comp_index bigint, stripe_index bigint, ost_idx bigint, ost_oi_id decimal(20,0), ost_oi_seq decimal(20,0), device string"
LINK_COLUMNS = ["fid", "parent_fid", "name", "device"]
LAYOUT_FIELDS = "comp_index comp_id mirror_id comp_flags extent_start extent_end pattern stripe_size stripe_count stripe_offset pool dstripe_count cstripe_count compr_type compr_lvl".split()
LAYOUT_COLUMNS = ["fid", *LAYOUT_FIELDS, "device"]
OBJECT_COLUMNS = ["fid", "comp_index", "stripe_index", "ost_idx", "ost_oi_id", "ost_oi_seq", "device"]
#: A component is instantiated.
INIT = 0x10


def has_links(raw: DataFrame):
    return F.coalesce(F.size("links"), F.lit(0)) > 0


def selected(raw: DataFrame, skip_no_fid: bool, skip_no_linkea: bool) -> DataFrame:
    if skip_no_fid:
        raw = raw.where(F.col("fid").isNotNull())
    if skip_no_linkea:
        raw = raw.where(has_links(raw))
    return raw


def on_devices(raw: DataFrame, devices: str | list[str] | None) -> DataFrame:
    """The rows of one device or of a list of devices; None takes all."""
    if devices is None:
        return raw
    names = [devices] if isinstance(devices, str) else list(devices)
    if not names:
        raise ValueError("the list of devices is empty")
    return raw.where(F.col("device").isin(names))


def each(column: str, of: str):
    """The array to explode. Of a bare column Catalyst infers filters (not null, not empty), which below a projection evaluate all that makes the array again, once a filter."""
    return F.coalesce(F.col(column), F.array().cast(of))


def inodes(raw: DataFrame, devices=None, skip_no_fid: bool = True, skip_no_linkea: bool = True) -> DataFrame:
    """A row per inode; times of 0 are null in raw already."""
    return selected(on_devices(raw, devices), skip_no_fid, skip_no_linkea).withColumn("type", type_from_mode(F.col("mode"))).select(*INODE_COLUMNS)


def links(raw: DataFrame, devices=None, skip_no_fid: bool = True, skip_no_linkea: bool = True) -> DataFrame:
    """A row per hard link; none for an inode with an empty list, whatever the flags."""
    return selected(on_devices(raw, devices), skip_no_fid, False).select("fid", F.explode(each("links", LINKED)).alias("l"), "device").select("fid", "l.parent_fid", "l.name", "device")


def layouts(raw: DataFrame, devices=None, skip_no_fid: bool = True, skip_no_linkea: bool = True) -> DataFrame:
    """A row per layout component. Links don't matter here; an invalid identifier is printed as zeros."""
    rows = selected(on_devices(raw, devices), skip_no_fid, False).select(F.coalesce("fid", F.lit(NONE)).alias("fid"), F.explode(each("comps", f"array<{COMPONENT}>")).alias("c"), "device")
    return rows.select("fid", *[F.col(f"c.{x}").alias(x) for x in LAYOUT_FIELDS], "device")


def objects(raw: DataFrame, devices=None, skip_no_fid: bool = True, skip_no_linkea: bool = True) -> DataFrame:
    """A row per stripe of the components that have their objects (no flags, or instantiated)."""
    rows = selected(on_devices(raw, devices), skip_no_fid, False).select(F.coalesce("fid", F.lit(NONE)).alias("fid"), F.explode(each("comps", f"array<{COMPONENT}>")).alias("c"), "device")
    ready = rows.where((F.col("c.stripe_count") > 0) & ((F.col("c.comp_flags") == 0) | (F.col("c.comp_flags").bitwiseAND(F.lit(INIT)) != 0)))
    stripes = ready.select("fid", "c.comp_index", F.posexplode(each("c.objects", f"array<{OBJECT}>")).alias("stripe_index", "o"), "device")
    return stripes.select("fid", "comp_index", F.col("stripe_index").cast("bigint").alias("stripe_index"), "o.ost_idx", "o.ost_oi_id", "o.ost_oi_seq", "device")


def oi(raw: DataFrame) -> DataFrame:
    """(fid, device, ord): which identifiers each device's object index holds, whatever the flags."""
    return raw.where(F.col("fid").isNotNull()).select("fid", "device", "ord")
