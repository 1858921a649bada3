"""Binary attributes: hand-made values and damaged ones."""

import struct
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from metalith.functions import decode, fid

LMA = "000000000400000001040000020000000500000000000000"
SOM = "010000000000000040e2010000000000f800000000000000"
LINK = "dff1ea110200000042000000000000000000000000000000001700000002000000070000000100000000612e74787400130000000200000402000000090000000062"
LOV_V1 = "d00bd10b010000000100000000000000010400000200000000001000020000000b00000000000000000000000000000000000000030000000c0000000000000000000000000000000000000005000000"
LOV_V3 = "d00bd30b01000000010000000000000001040000020000000000400001000000666c6173680000000000000000000000150000000000000000000000000000000000000007000000"
LOV_COMP = (
    "d00bd60bf000000001000000000002000000000000000000000000000000000001000100100000000000000000000000000010000000000080000000380000000100000000000000000000000000000002000100"
    "010000000000100000000000ffffffffffffffffb80000003800000001000000000000000000000004020135d00bd10b010000000100000000000000010400000200000000001000010000001f0000000000000000"
    "000000000000000000000002000000d00bd10b01000000010000000000000001040000020000000000100001000000000000000000000000000000000000000000000000000000"
)
LMV_M = "d00cd20c040000000000000002000000010000000000" + "00" * 34
LMV_S = "d00cd40c040000000200000002000000010000000000" + "00" * 34


def test_identity_and_size():
    assert decode.lma(bytes.fromhex(LMA)) == (4, "[0x200000401:0x5:0x0]")
    assert decode.lma(bytes(24)) == (0, None) and decode.lma(bytes(23)) is None and decode.lma(None) is None
    assert decode.som(bytes.fromhex(SOM)) == (123456, 248) and decode.som(bytes(24)) is None


def test_links():
    blob = bytes.fromhex(LINK)
    assert decode.links(blob) == [{"parent_fid": "[0x200000007:0x1:0x0]", "name": "a.txt"}, {"parent_fid": "[0x200000402:0x9:0x0]", "name": "b"}]
    assert decode.links(b"x" + blob[1:]) is None and decode.links(b"") is None
    assert decode.links(blob[:-1]) == decode.links(blob)[:1]
    assert decode.links(blob[:24] + b"\x00\x11" + blob[26:]) == []
    assert decode.links(blob[:4] + bytes(4) + blob[8:]) is None


def test_layouts():
    (one,) = decode.lov(bytes.fromhex(LOV_V1))
    assert (one["pattern"], one["stripe_size"], one["stripe_count"], one["stripe_offset"], one["pool"], one["extent_end"]) == (1, 1 << 20, 2, 3, None, Decimal(2**64 - 1))
    assert [(o["ost_idx"], o["ost_oi_id"]) for o in one["objects"]] == [(3, 11), (5, 12)]
    (one,) = decode.lov(bytes.fromhex(LOV_V3))
    assert (one["pool"], one["stripe_offset"], one["objects"][0]["ost_oi_id"]) == ("flash", 7, 21)
    a, b = decode.lov(bytes.fromhex(LOV_COMP))
    assert (a["comp_id"], a["mirror_id"], a["comp_flags"], a["extent_end"], a["stripe_offset"]) == (65537, 1, 16, 1 << 20, 2)
    assert (b["comp_flags"], b["dstripe_count"], b["cstripe_count"], b["compr_type"], b["compr_lvl"]) == (1, 4, 2, 1, 5)


def test_damaged_layouts():
    blob = bytearray.fromhex(LOV_COMP)
    assert decode.lov(bytes(blob[:31])) is None
    foreign = bytearray(blob)
    foreign[128:132] = b"\1\2\3\4"
    first = decode.lov(bytes(foreign))[0]
    assert (first["comp_index"], first["comp_id"], first["stripe_offset"], first["extent_end"]) == (0, 0, 0xFFFF, Decimal(2**64 - 1))
    struct.pack_into("<I", blob, 32 + 28, 4000)
    assert [c["comp_index"] for c in decode.lov(bytes(blob))] == [1]
    struct.pack_into("<H", blob, 14, 99)
    assert decode.lov(bytes(blob)) is None


def test_stripes():
    assert decode.lmv(bytes.fromhex(LMV_M)) == {"role": "master", "stripe_count": 4, "mdt_index": 0, "hash_type": 2, "layout_version": 1}
    assert decode.lmv(bytes.fromhex(LMV_S))["role"] == "slave" and decode.lmv(bytes.fromhex(LMV_S))["mdt_index"] == 2
    assert decode.lmv(bytes.fromhex(LMV_M)[:55]) is None and decode.lmv(bytes(56)) is None


CASES = [
    ("[1:2:3]", (1, 2, 3)), ("[010:0x1:0]", (8, 1, 0)), ("[0x1zz:0x2:0x0]", (1, 2, 0)), ("[0xffffffffffffffff:0xffffffff:0xffffffff]", (2**64 - 1, 2**32 - 1, 2**32 - 1)),
    ("[0x1:0x100000002:0x0]", (1, 2, 0)), ("[0x0:0x0:0x0]", (0, 0, 0)), ("[]", None), ("0x1:0x2:0x3", None), ("[0x1:0x2]", None), ("[:0x1:0x0]", None), (None, None),
]


@pytest.mark.parametrize("text,want", CASES)
def test_parse(spark, text, want):
    row = spark.createDataFrame([(text,)], "t string").select(fid.parse_fid(F.col("t")).alias("p")).first()["p"]
    assert (tuple(int(x) for x in row) if row else None) == want


def test_format_is_the_inverse(spark):
    texts = ["[0x0:0x0:0x0]", "[0xffffffffffffffff:0xffffffff:0xffffffff]", "[0x200000007:0x1:0x0]"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", fid.parse_fid(F.col("t")).alias("p"))
    assert all(r["t"] == r["u"] for r in df.select("t", fid.format_fid(F.col("p.seq"), F.col("p.oid"), F.col("p.ver")).alias("u")).collect())
