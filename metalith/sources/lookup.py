"""Keyed access to images: identifiers and paths of single files, without a scan.

A ``Namespace`` is a list of opened devices. It finds an inode by its identifier through the object index (one
block a level), walks links up to the root for paths, and directories down for identifiers. ``register_functions`` offers this
to SQL, as scalar functions and as table functions; devices are a path or an array of paths. Each Python worker keeps the
few namespaces it used last.
"""

from __future__ import annotations

import functools
import struct

from pyspark.sql import SparkSession

from metalith.functions import decode
from metalith.functions.fid import ROOT
from metalith.sources.ext4 import ROOT_INO, Image, Inode

MAX_DEPTH = 4096
INDEX_FILES = 64


def parse(text: str | None) -> tuple[int, int, int] | None:
    """(seq, oid, ver) of an identifier's text, or None."""
    try:
        seq, oid, ver = text.strip("[]").split(":") if text.startswith("[") and text.endswith("]") else ()
        return int(seq, 0), int(oid, 0) & 0xFFFFFFFF, int(ver, 0) & 0xFFFFFFFF
    except (ValueError, AttributeError):
        return None


class Device:
    """An image with its object index."""

    def __init__(self, path: str):
        self.path, self.image = path, Image(path)
        root = self.image.inode(ROOT_INO)
        files = {n: i for n, i in self.image.entries(root)} if root else {}
        numbered = {k: files[f"oi.16.{k}"] for k in range(INDEX_FILES) if f"oi.16.{k}" in files} or ({0: files["oi.16"]} if "oi.16" in files else {})
        self.index = {k: self.image.inode(ino) for k, ino in numbered.items()}
        #: A power of two: the index file of an identifier is given by the low bits of its sequence.
        self.files = 1 << (max(numbered, default=0)).bit_length()

    def find(self, fid: tuple[int, int, int]) -> Inode | None:
        file = self.index.get(fid[0] & (self.files - 1))
        record = self.image.lookup(file, struct.pack(">QII", *fid), 8) if file else None
        return self.image.inode(struct.unpack_from(">I", record)[0]) if record else None

    def fid_of(self, inode: Inode | None) -> str | None:
        ident = decode.lma(self.image.attributes(inode).get("lma")) if inode else None
        return ident[1] if ident else None


class Namespace:
    def __init__(self, devices):
        self.devices = [Device(d) for d in devices]

    def find(self, fid: tuple[int, int, int]) -> tuple[Device, Inode] | None:
        """On the first device whose index has it."""
        return next(((d, i) for d in self.devices if (i := d.find(fid)) is not None), None)

    def _up(self, fid: str):
        """(links, slave's link to its master or None, whether it is a slave) of an identifier, or None."""
        ident = parse(fid)
        at = self.find(ident) if ident else None
        if at is None:
            return None
        values = at[0].image.attributes(at[1])
        links = decode.links(values.get("link"))
        if not links:
            return None
        lmv = decode.lmv(values.get("lmv"))
        if not lmv or lmv["role"] != "slave":
            return links, None, False
        name = f"{decode.fid_text(*ident)}:{lmv['mdt_index']}"
        parents = {x["parent_fid"] for x in links}
        master = next((x["parent_fid"] for x in links if x["name"] == name), None) or (parents.pop() if len(parents) == 1 else None)
        return links, master, True

    def _path(self, name: str, parent: str | None) -> str | None:
        names = [name] if name else []
        for _ in range(MAX_DEPTH):
            if parent is None:
                return None
            if parent == ROOT:
                return "/" + "/".join(reversed(names))
            up = self._up(parent)
            if up is None:
                return None
            links, master, slave = up
            if slave:
                parent = master  # a shard is passed through without a name
            elif len({(x["parent_fid"], x["name"]) for x in links}) == 1:
                names.append(links[0]["name"])
                parent = links[0]["parent_fid"]
            else:
                return None
        return None

    def paths(self, fid: str | None) -> list[str] | None:
        """Paths of an inode in the order of its links, or None; as ``operators.paths.fid2path``."""
        up = self._up(fid)
        if up is None:
            return None
        links, master, slave = up
        found = [self._path("", master)] if slave else [self._path(x["name"], x["parent_fid"]) for x in links]
        return [x for x in found if x is not None] or None

    def fid(self, path: str | None) -> str | None:
        """Identifier that a path leads to, or None; as ``operators.paths.path2fid``."""
        if path is None:
            return None
        here = ROOT
        for name in filter(None, path.split("/")):
            at = self.find(parse(here))
            child = next((i for n, i in at[0].image.entries(at[1]) if n == name), None) if at else None
            here = at[0].fid_of(at[0].image.inode(child)) if child else None
            if here is None:
                return None
        return here


@functools.lru_cache(4)
def namespace(devices: tuple[str, ...]) -> Namespace:
    return Namespace(devices)


def listed(devices) -> tuple[str, ...]:
    return () if devices is None else (devices,) if isinstance(devices, str) else tuple(d for d in devices if d is not None)


def register_functions(spark: SparkSession) -> None:
    """For SQL: ``mdt_fid2path(fid, device)`` and ``mdt_path2fid(path, device)``, and the table functions ``mdt_inodes``, ``mdt_links``, ``mdt_layouts`` and ``mdt_objects``
    ``(device, skip_no_fid, skip_no_linkea)``. Without a device nothing is found but the root.

    A table function reads its devices in one task; ``mdt.read`` and the views deal block groups to tasks, and suit whole images."""
    from pyspark.sql.functions import udf, udtf

    from metalith.operators import relations
    from metalith.sources import mdt

    spark.udf.register("mdt_fid2path", udf(lambda fid, devices: namespace(listed(devices)).paths(fid), "array<string>"))
    spark.udf.register("mdt_path2fid", udf(lambda path, devices: namespace(listed(devices)).fid(path), "string"))
    for name, ddl in (("inodes", relations.INODES), ("links", relations.LINKS), ("layouts", relations.LAYOUTS), ("objects", relations.OBJECTS)):
        rows = getattr(mdt, f"{name}_of")

        class Table:
            _rows = staticmethod(rows)

            def eval(self, device, skip_no_fid=True, skip_no_linkea=True):
                for row in mdt.every_row(listed(device)):
                    if not (skip_no_fid and row["fid"] is None):
                        yield from self._rows(row, skip_no_linkea)

        spark.udtf.register(f"mdt_{name}", udtf(Table, returnType=ddl))
