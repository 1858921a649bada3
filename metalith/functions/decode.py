"""Decoders of the binary attributes of an inode. Little-endian unless said otherwise."""

from __future__ import annotations

import struct
from decimal import Decimal

EOF = 2**64 - 1
UNKNOWN_OST = 0xFFFF
#: Fixed values of the on-disk format.
LINK_MAGIC, LOV_V1, LOV_V3, LOV_COMPOSITE, LMV_MASTER, LMV_SLAVE = 0x11EAF1DF, 0x0BD10BD0, 0x0BD30BD0, 0x0BD60BD0, 0x0CD20CD0, 0x0CD40CD0
LINK_HEADER, LINK_ENTRY, LOV_HEADER, OBJECT_SIZE, POOL_SIZE, COMPOSITE_HEADER, COMPONENT_SIZE, LMV_SIZE = 24, 18, 32, 24, 16, 32, 48, 56


def fid_text(seq: int, oid: int, ver: int) -> str:
    return f"[0x{seq:x}:0x{oid:x}:0x{ver:x}]"


def lma(blob: bytes | None) -> tuple[int, str | None] | None:
    """(incompat, fid or None if it isn't valid)."""
    if blob is None or len(blob) < 24:
        return None
    _, incompat, seq, oid, ver = struct.unpack_from("<IIQII", blob)
    return incompat, fid_text(seq, oid, ver) if seq or oid else None


def som(blob: bytes | None) -> tuple[int, int] | None:
    """(size, blocks) if they are valid."""
    if blob is None or len(blob) < 24:
        return None
    valid, size, blocks = struct.unpack_from("<H6xQQ", blob)
    return (size, blocks) if valid else None


def links(blob: bytes | None, names: bool = True) -> list[dict] | None:
    """Entries (parent_fid, name), or None without a list; entry lengths and parents are big-endian. Stops at the first entry that doesn't fit. Without ``names`` these are null."""
    if blob is None or len(blob) < LINK_HEADER:
        return None
    magic, count = struct.unpack_from("<II", blob)
    if magic != LINK_MAGIC or not count:
        return None
    out, at = [], LINK_HEADER
    for _ in range(count):
        if at + LINK_ENTRY > len(blob):
            break
        size, seq, oid, ver = struct.unpack_from(">HQII", blob, at)
        if size < LINK_ENTRY or at + size > len(blob):
            break
        name = blob[at + LINK_ENTRY : at + size].rstrip(b"\0").decode("utf-8", "replace") if names else None
        out.append({"parent_fid": fid_text(seq, oid, ver), "name": name})
        at += size
    return out


def _component(index: int) -> dict:
    return {
        "comp_index": index, "comp_id": 0, "mirror_id": 0, "comp_flags": 0, "extent_start": Decimal(0), "extent_end": Decimal(EOF), "pattern": 0, "stripe_size": 0,
        "stripe_count": 0, "stripe_offset": UNKNOWN_OST, "pool": None, "dstripe_count": 0, "cstripe_count": 0, "compr_type": 0, "compr_lvl": 0, "objects": [],
    }


def _plain(blob: bytes, into: dict) -> bool:
    """Read a plain layout; False if it isn't one."""
    if len(blob) < LOV_HEADER:
        return False
    magic, pattern = struct.unpack_from("<II", blob)
    if magic not in (LOV_V1, LOV_V3):
        return False
    size, count = struct.unpack_from("<IH", blob, 24)
    at = LOV_HEADER
    into |= {"pattern": pattern, "stripe_size": size, "stripe_count": count}
    if magic == LOV_V3:
        pool = blob[at : at + POOL_SIZE].split(b"\0")[0].decode("utf-8", "replace")
        into["pool"] = pool or None
        at += POOL_SIZE
    if count and at + count * OBJECT_SIZE <= len(blob):
        for i in range(count):
            oi_id, oi_seq, _, ost = struct.unpack_from("<QQII", blob, at + i * OBJECT_SIZE)
            into["objects"].append({"ost_idx": ost, "ost_oi_id": Decimal(oi_id), "ost_oi_seq": Decimal(oi_seq)})
        into["stripe_offset"] = into["objects"][0]["ost_idx"] & 0xFFFF
    return True


def lov(blob: bytes | None) -> list[dict] | None:
    """Components of a file's layout. A component of a foreign kind is a row of defaults; one outside the value is left out."""
    if blob is None or len(blob) < LOV_HEADER:
        return None
    magic = struct.unpack_from("<I", blob)[0]
    if magic != LOV_COMPOSITE:
        one = _component(0)
        return [one] if _plain(blob, one) else None
    count = struct.unpack_from("<H", blob, 14)[0]
    if COMPOSITE_HEADER + count * COMPONENT_SIZE > len(blob):
        return None
    out = []
    for i in range(count):
        at = COMPOSITE_HEADER + i * COMPONENT_SIZE
        ident, flags, start, end, offset, size = struct.unpack_from("<IIQQII", blob, at)
        if offset + size > len(blob):
            continue
        one = _component(i)
        if not _plain(blob[offset : offset + size], one):
            out.append(_component(0))
            continue
        data, code, kind, level = blob[at + 44 : at + 48]
        one |= {"comp_id": ident, "mirror_id": (ident & 0x7FFF0000) >> 16, "comp_flags": flags, "extent_start": Decimal(start), "extent_end": Decimal(end)}
        one |= {"dstripe_count": data, "cstripe_count": code, "compr_type": kind, "compr_lvl": level & 15}
        out.append(one)
    return out


def lmv(blob: bytes | None) -> dict | None:
    """A directory's striping, or None if it is plain."""
    if blob is None or len(blob) < LMV_SIZE:
        return None
    magic, count, index, hashed, version = struct.unpack_from("<IIIII", blob)
    role = {LMV_MASTER: "master", LMV_SLAVE: "slave"}.get(magic)
    return {"role": role, "stripe_count": count, "mdt_index": index, "hash_type": hashed, "layout_version": version} if role else None
