"""Images as a Spark data source: ``spark.read.format("mdt")``.

Options: ``device`` (a path) or ``devices`` (a JSON list of paths), and ``relation``:
``raw`` (see ``operators.relations``), ``dirents``, ``oi`` or ``fld``; ``groups``: block groups
a partition; ``columns`` (a JSON list, for raw): only these are read, and only the attributes they need are decoded;
``names``: false leaves the names of links out; ``fids`` (a JSON list): of raw, the inodes of these identifiers, found through
the object index, and of dirents, the entries of these directories, both without a scan. Every executor must see the devices under the same paths. A partition is a range of
block groups of one device, so a task can be repeated anywhere; empty groups have no task.

Filters are left to Spark: a Python source that accepts filters keeps them for later
reads of the same frame, which would be wrong.
"""

from __future__ import annotations

import json
import os
import struct
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from metalith.functions import decode
from metalith.functions.fid import NONE, TYPE_MASK, TYPES
from metalith.operators import relations

GROUPS = 8
#: More identifiers than these are looked up by a scan and a join.
MOST_LOOKUPS = 8192
BATCH = 4096
SCHEMAS = {
    "raw": relations.RAW,
    "dirents": "parent_fid string, name string, fid string, device string",
    "oi": "fid string, ino bigint, device string, ord int",
    "fld": "range_start decimal(20,0), range_end decimal(20,0), mdt bigint, device string",
}


#: Columns of raw that need no attribute.
PLAIN = {"device", "ord", "ino", "mode", "nlink", "uid", "gid", "atime", "mtime", "ctime", "projid", "flags"}


def columns_of(ddl: str) -> dict[str, str]:
    """Names and types of a schema's text."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(ddl + ","):
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append(ddl[start:i].strip().split(" ", 1))
            start = i + 1
    return dict(out)


@dataclass
class Part(InputPartition):
    device: str
    ord: int
    groups: list
    fids: list | None = None


def devices_of(options) -> list[str]:
    found = json.loads(options["devices"]) if "devices" in options else [options["device"]] if "device" in options else []
    if not found or not all(isinstance(x, str) and x for x in found):
        raise ValueError("the list of devices is empty")
    return found


class MdtSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mdt"

    def schema(self) -> str:
        relation = self.options.get("relation", "raw")
        if relation not in SCHEMAS:
            raise ValueError(f"unknown relation {relation!r}")
        if "columns" not in self.options or relation != "raw":
            return SCHEMAS[relation]
        every = columns_of(SCHEMAS[relation])
        wanted = json.loads(self.options["columns"])
        if not wanted or set(wanted) - set(every):
            raise ValueError(f"no such columns: {sorted(set(wanted) - set(every))}")
        return ", ".join(f"{c} {every[c]}" for c in wanted)

    def reader(self, schema) -> DataSourceReader:
        return MdtReader(schema, self.options)


class MdtReader(DataSourceReader):
    def __init__(self, schema, options):
        from pyspark.sql.pandas.types import to_arrow_schema

        self.relation = options.get("relation", "raw")
        self.devices = devices_of(options)
        self.step = int(options.get("groups", GROUPS))
        self.arrow = to_arrow_schema(schema)
        self.names = options.get("names", "true") != "false"
        self.fids = json.loads(options["fids"]) if "fids" in options else None
        if self.fids is not None and self.relation not in ("raw", "dirents"):
            raise ValueError("only raw and dirents are looked up by identifier")

    def partitions(self):
        from metalith.sources.ext4 import Image

        parts = []
        if self.fids is not None:
            wanted = sorted(set(self.fids))
            step = max(1, MOST_LOOKUPS // 16)
            return [Part(d, i, [], wanted[k : k + step]) for i, d in enumerate(self.devices) for k in range(0, len(wanted), step)]
        for i, device in enumerate(self.devices):
            image = Image(device)
            used = image.used_groups()
            image.close()
            if self.relation in ("oi", "fld"):
                parts.append(Part(device, i, []))
            else:
                parts += [Part(device, i, used[k : k + self.step]) for k in range(0, len(used), self.step)]
        return parts

    def read(self, part: Part):
        from metalith.sources.ext4 import Image

        image = Image(part.device)
        rows = []
        wanted = {f.name for f in self.arrow}
        made = {"raw": lambda: raw_rows(image, part, wanted, self.names), "dirents": lambda: dirent_rows(image, part), "oi": lambda: oi_rows(image, part), "fld": lambda: fld_rows(image, part)}
        for row in made[self.relation]():
            rows.append(row)
            if len(rows) == BATCH:
                yield self.batch(rows)
                rows = []
        if rows:
            yield self.batch(rows)
        image.close()

    def batch(self, rows: list[dict]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([r[f.name] for r in rows], f.type) for f in self.arrow], schema=self.arrow)


def moment(seconds: int):
    return datetime.fromtimestamp(seconds, timezone.utc) if seconds else None


def inodes_of_part(image, part: Part):
    """The inodes of a part's block groups, or those of its identifiers."""
    if part.fids is None:
        yield from image.scan(part.groups)
        return
    from metalith.sources.lookup import Device, parse

    device = Device(part.device)
    for fid in part.fids:
        ident = parse(fid)
        inode = device.find(ident) if ident else None
        if inode is not None and inode.live:
            yield inode
    device.image.close()


def raw_rows(image, part: Part, wanted: set[str], names: bool = True):
    """Attributes are read only for the columns that need any, and each is decoded only where it is asked for."""
    attributed = bool(wanted - PLAIN)
    for n in inodes_of_part(image, part):
        row = {
            "device": part.device, "ord": part.ord, "ino": n.ino, "mode": n.mode, "nlink": n.nlink, "uid": n.uid, "gid": n.gid,
            "atime": moment(n.atime), "mtime": moment(n.mtime), "ctime": moment(n.ctime), "projid": n.projid, "flags": n.flags,
        }
        if attributed:
            values = image.attributes(n)
            if wanted & {"fid", "incompat"}:
                ident = decode.lma(values.get("lma"))
                row |= {"fid": ident[1] if ident else None, "incompat": ident[0] if ident else None}
            if wanted & {"size", "blocks"}:
                row["size"], row["blocks"] = decode.som(values.get("som")) or (n.size, n.blocks)
            if "links" in wanted:
                row["links"] = decode.links(values.get("link"), names)
            if "comps" in wanted:
                row["comps"] = decode.lov(values.get("lov"))
            if "lmv" in wanted:
                row["lmv"] = decode.lmv(values.get("lmv"))
        yield row


def every_row(devices):
    """Raw rows of devices, one after another; for the table functions."""
    from metalith.sources.ext4 import Image

    wanted = set(columns_of(relations.RAW))
    for i, device in enumerate(devices):
        image = Image(device)
        yield from raw_rows(image, Part(device, i, image.used_groups()), wanted)
        image.close()


def inodes_of(row: dict, linked: bool):
    if row["links"] or not linked:
        kind = TYPES.get(row["mode"] & TYPE_MASK, "unknown")
        yield tuple(kind if c == "type" else row[c] for c in relations.INODE_COLUMNS)


def links_of(row: dict, linked: bool):
    for x in row["links"] or ():
        yield row["fid"], x["parent_fid"], x["name"], row["device"]


def layouts_of(row: dict, linked: bool):
    for c in row["comps"] or ():
        yield (row["fid"] or NONE, *(c[x] for x in relations.LAYOUT_FIELDS), row["device"])


def objects_of(row: dict, linked: bool):
    for c in row["comps"] or ():
        if c["stripe_count"] > 0 and (not c["comp_flags"] or c["comp_flags"] & relations.INIT):
            for k, o in enumerate(c["objects"]):
                yield row["fid"] or NONE, c["comp_index"], k, o["ost_idx"], o["ost_oi_id"], o["ost_oi_seq"], row["device"]


def dirent_rows(image, part: Part):
    def fid(inode):
        ident = decode.lma(image.attributes(inode).get("lma")) if inode else None
        return ident[1] if ident else None

    for n in inodes_of_part(image, part):
        if n.mode & 0xF000 == 0x4000:
            own = fid(n)
            for name, ino in image.entries(n):
                yield {"parent_fid": own, "name": name, "fid": fid(image.inode(ino)), "device": part.device}


def oi_rows(image, part: Part):
    from metalith.sources.ext4 import ROOT_INO

    names = {f"oi.16.{i}" for i in range(64)} | {"oi.16"}
    for name, ino in image.entries(image.inode(ROOT_INO)):
        if name in names:
            for key, record in image.index(image.inode(ino), 16, 8):
                yield {"fid": decode.fid_text(*struct.unpack(">QII", key)), "ino": struct.unpack_from(">I", record)[0], "device": part.device, "ord": part.ord}


def fld_rows(image, part: Part):
    from decimal import Decimal

    found = image.named("fld")
    for _, record in image.index(found, 8, 24) if found else ():
        start, end, mdt, flags = struct.unpack(">QQII", record)
        if start < end and flags & 3 == 0:
            yield {"range_start": Decimal(start), "range_end": Decimal(end), "mdt": mdt, "device": part.device}


def read(spark: SparkSession, devices: str | list[str], relation: str = "raw", columns: list[str] | None = None, names: bool = True, fids: list[str] | None = None) -> DataFrame:
    """A relation of one or more images; ``columns``, ``names`` and ``fids`` as the options of the source.

    Up to ``MOST_LOOKUPS`` identifiers are found through the object index; for more, the images are scanned and joined with them."""
    spark.dataSource.register(MdtSource)
    paths = [devices] if isinstance(devices, str) else list(devices)
    reader = spark.read.format("mdt").option("devices", json.dumps(paths)).option("relation", relation).option("names", str(names).lower())
    if fids is not None and len(set(fids)) > MOST_LOOKUPS:
        key = "fid" if relation == "raw" else "parent_fid"
        found = read(spark, devices, relation, None if columns is None else list(dict.fromkeys([*columns, key])), names).join(spark.createDataFrame([(f,) for f in set(fids)], f"{key} string"), key, "left_semi")
        return found if columns is None else found.select(*columns)
    if columns is not None and relation == "raw":
        reader = reader.option("columns", json.dumps(columns))
    if fids is not None:
        reader = reader.option("fids", json.dumps(list(fids)))
    return reader.load()


def snapshot(spark: SparkSession, devices: str | list[str], path: str) -> None:
    """Decode images once into parquet, which later queries read with full pruning."""
    for relation in SCHEMAS:
        read(spark, devices, relation).write.mode("overwrite").parquet(os.path.join(path, relation))


def register_views(spark: SparkSession, devices: str | list[str], skip_no_fid: bool = True, skip_no_linkea: bool = True, prefix: str = "") -> None:
    """Temporary views inodes, links, layouts, objects and dirstripe over images, and fid_paths (fid, paths); ``prefix`` is put before their names, so that several lists of devices can be told apart."""
    from metalith.operators import dirstripe, paths

    raw, dirents = read(spark, devices), read(spark, devices, "dirents")
    for name in ("inodes", "links", "layouts", "objects"):
        getattr(relations, name)(raw, None, skip_no_fid, skip_no_linkea).createOrReplaceTempView(prefix + name)
    dirstripe.dirstripe(raw, dirents, None, skip_no_fid).createOrReplaceTempView(prefix + "dirstripe")
    paths.fid2path(raw).createOrReplaceTempView(prefix + "fid_paths")
