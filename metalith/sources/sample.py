"""A small image made from a rule, for the query ``image_scan``: one block group, a file per number, identifiers and links in the inodes."""

from __future__ import annotations

import struct

BLOCK, INODE, FILES, FIRST = 1024, 512, 40, 11
#: The sequence of the files' identifiers, and the root's.
SEQUENCE, ROOT_SEQUENCE = 0x200000401, 0x200000007


def attribute(values: dict[str, bytes], room: int) -> bytes:
    """Attributes in an inode: entries from the front, values from the back."""
    entries, body = b"", bytearray(room)
    at = room
    for name, value in values.items():
        at = at - len(value) & ~3
        body[at : at + len(value)] = value
        label = name.encode()
        entries += struct.pack("<BBHIII", len(label), 4, at, 0, len(value), 0) + label + bytes(-len(label) % 4)
    assert len(entries) + 4 <= at
    body[: len(entries)] = entries
    return bytes(body)


def inode(mode: int, uid: int, size: int, nlink: int, seconds: int, values: dict[str, bytes]) -> bytes:
    head = struct.pack("<HHIIIIIHHII", mode, uid & 0xFFFF, size, seconds, seconds, seconds, 0, 0, nlink, size // 512, 0)
    return head.ljust(128, b"\0") + struct.pack("<H", 32).ljust(32, b"\0") + struct.pack("<I", 0xEA020000) + attribute(values, INODE - 164)


def lma(seq: int, oid: int) -> bytes:
    return struct.pack("<IIQII", 0, 0, seq, oid, 0)


def link(name: str) -> bytes:
    body = struct.pack(">HQII", 18 + len(name), ROOT_SEQUENCE, 1, 0) + name.encode()
    return struct.pack("<IIQQ", 0x11EAF1DF, 1, 24 + len(body), 0) + body


def build() -> bytes:
    """File k (1 to ``FILES``) has identifier k, owner k modulo 7, size 512 k, name ``file<k>``; every eighth has no identifier."""
    per_group = 64
    table = 5
    sb = bytearray(1024)
    struct.pack_into("<IIIII", sb, 0, per_group, 64, 0, 0, per_group - FIRST - FILES)
    struct.pack_into("<II", sb, 20, 1, 0)
    struct.pack_into("<I", sb, 32, 8192)
    struct.pack_into("<I", sb, 40, per_group)
    struct.pack_into("<H", sb, 56, 0xEF53)
    struct.pack_into("<I", sb, 76, 1)
    struct.pack_into("<H", sb, 88, INODE)
    sb[120:131] = b"sample-MDT0"
    descriptor = struct.pack("<IIIHH", 3, 4, table, 0, per_group - FIRST - FILES).ljust(32, b"\0")
    inodes = bytearray(per_group * INODE)

    def put(ino: int, body: bytes) -> None:
        inodes[(ino - 1) * INODE : ino * INODE] = body

    put(2, inode(0x41ED, 0, 0, 2, 0, {"lma": lma(ROOT_SEQUENCE, 1)}))
    for k in range(1, FILES + 1):
        ident = {} if k % 8 == 0 else {"lma": lma(SEQUENCE, k)}
        put(FIRST + k, inode(0x81A4, k % 7, 512 * k, 1, 86400 * k, {**ident, "link": link(f"file{k}")}))
    return (bytes(1024) + bytes(sb) + descriptor.ljust(BLOCK, b"\0")).ljust(table * BLOCK, b"\0") + bytes(inodes)


def write(folder: str, name: str = "sample.img") -> str:
    path = f"{folder.removeprefix('file://')}/{name}"
    with open(path, "wb") as f:
        f.write(build())
    return path
