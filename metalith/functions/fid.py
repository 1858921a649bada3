"""File identifiers and mode bits as column expressions.

An identifier is (seq: 64 bits, oid: 32, ver: 32); in relations it is its text
``[0x<seq>:0x<oid>:0x<ver>]``, lower-case hex without padding.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ROOT = "[0x200000007:0x1:0x0]"
NONE = "[0x0:0x0:0x0]"
#: File type bits of a mode.
TYPE_MASK = 0xF000
TYPES = {0x8000: "file", 0x4000: "dir", 0xA000: "link", 0x6000: "blk", 0x2000: "chr", 0x1000: "fifo", 0xC000: "sock"}


def _once(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once: parsed identifiers are used several times in an expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def format_fid(seq: Column, oid: Column, ver: Column) -> Column:
    """Text of an identifier given as longs (seq may be a decimal above 2**63)."""
    return F.concat(F.lit("[0x"), _hex(seq), F.lit(":0x"), _hex(oid), F.lit(":0x"), _hex(ver), F.lit("]"))


def _hex(c: Column) -> Column:
    return F.lower(F.conv(c.cast("string"), 10, 16))


def _number(text: Column) -> Column:
    """A field in base 0 (hex, octal or decimal; what follows the digits is ignored) as decimal(20,0); null without digits."""
    hexa = F.regexp_extract(text, r"^\s*\+?0[xX]([0-9a-fA-F]+)", 1)
    octal = F.regexp_extract(text, r"^\s*\+?(0[0-7]*)", 1)
    plain = F.regexp_extract(text, r"^\s*\+?([1-9][0-9]*)", 1)
    return (
        F.when(hexa != "", F.conv(hexa, 16, 10))
        .when(plain != "", plain)
        .when(octal != "", F.conv(octal, 8, 10))
        .cast("decimal(20,0)")
    )


def parse_fid(text: Column) -> Column:
    """struct(seq decimal(20,0), oid long, ver long), or null if the text is no identifier. Fields are lenient; oid and ver keep their low 32 bits."""
    inner = F.regexp_extract(text, r"^\[(.*)\]$", 1)
    low = F.lit(4294967296).cast("decimal(20,0)")

    def whole(x: Column) -> Column:
        good = (F.size(x) == 3) & F.get(x, F.lit(0)).isNotNull() & F.get(x, F.lit(1)).isNotNull() & F.get(x, F.lit(2)).isNotNull()
        return F.when(good, F.struct(F.get(x, F.lit(0)).alias("seq"), (F.get(x, F.lit(1)) % low).cast("long").alias("oid"), (F.get(x, F.lit(2)) % low).cast("long").alias("ver")))

    return _once(F.transform(F.split(F.when(F.length(text) >= 5, inner), ":", 3), _number), whole)


def fid_valid(text: Column) -> Column:
    """Neither seq nor oid is set: not valid. Version doesn't count. False for what isn't an identifier."""
    return F.coalesce(_once(parse_fid(text), lambda p: (p["seq"] != 0) | (p["oid"] != 0)), F.lit(False))


def fid_order(text: Column) -> list[Column]:
    """Sort keys of identifier order (seq, oid, ver), which differs from text order."""
    p = parse_fid(text)
    return [p["seq"], p["oid"], p["ver"]]


def type_from_mode(mode: Column) -> Column:
    bits = mode.bitwiseAND(F.lit(TYPE_MASK))
    out = F.lit("unknown")
    for value, name in TYPES.items():
        out = F.when(bits == value, name).otherwise(out)
    return F.when(mode.isNotNull(), out)


def shard_name(fid: Column, index: Column) -> Column:
    """Name of the entry that stands for a shard of a striped directory."""
    return F.concat_ws(":", fid, index.cast("string"))


#: A shard's entry name whose identifier is written as ``format_fid`` writes it.
USUAL_SHARD_NAME = r"^\[0x(?:0|[1-9a-f][0-9a-f]{0,15})(?::0x(?:0|[1-9a-f][0-9a-f]{0,7})){2}\]:[0-9]+\z"


def parse_shard_name(name: Column) -> Column:
    """struct(fid, index) of a shard's entry name, else null. Only unusual identifiers are taken apart and written anew."""
    usual = F.struct(F.substring_index(name, ":", 3).alias("fid"), F.substring_index(name, ":", -1).try_cast("bigint").alias("index"))
    fid = F.regexp_extract(name, r"^(\[[^\]]*\]):([0-9]+)$", 1)
    index = F.regexp_extract(name, r"^(\[[^\]]*\]):([0-9]+)$", 2)
    rest = _once(parse_fid(fid), lambda p: F.when(p.isNotNull(), F.struct(format_fid(p["seq"], p["oid"], p["ver"]).alias("fid"), index.try_cast("bigint").alias("index"))))
    return F.when(name.rlike(USUAL_SHARD_NAME), usual).otherwise(rest)


def mdt_index(label: Column) -> Column:
    """Index of a metadata target from its volume label: ``MDT<hex>`` at the start or after a dash, to the end."""
    digits = F.regexp_extract(label, r"(?:^|-)MDT([0-9a-fA-F]+)$", 1)
    return F.when(digits != "", F.conv(digits, 16, 10).cast("long"))
