"""Relations read from small images made with the filesystem's own tools."""

import os
import shutil
import struct
import subprocess

import pytest

from metalith.functions import decode
from metalith.operators import dirstripe, fused, paths, relations
from metalith.sources import ext4, lookup, mdt
from tests.test_decode import LMV_M, LMV_S, LOV_COMP, LOV_V1

TOOLS = {n: shutil.which(n) or shutil.which(n, path="/usr/sbin:/sbin") for n in ("mke2fs", "debugfs")}
pytestmark = pytest.mark.skipif(not all(TOOLS.values()), reason="needs the ext4 tools")


SHARD = "[0x200000405:0x1:0x0]"


def lma(seq, oid, incompat=0):
    return struct.pack("<IIQII", 0, incompat, seq, oid, 0)


def linkea(*entries):
    body = b"".join(struct.pack(">HQII", 18 + len(n), *p, 0) + n for p, n in entries)
    return struct.pack("<IIQQ", 0x11EAF1DF, len(entries), 24 + len(body), 0) + body


def index_file(key, record, rows, block=1024):
    """An index file of one leaf."""
    root = struct.pack("<QHHHBB", 0xBEDABB1ED, key, record, 4, 0, 0)
    first = struct.pack("<HH", 40, 2).ljust(key + 4, b"\0") + rows[0][0] + struct.pack("<I", 1)
    leaf = struct.pack("<HH", 0x1976, len(rows)) + b"".join(k + v for k, v in rows)
    return (root + first).ljust(block, b"\0") + leaf.ljust(block, b"\0")


def run(folder, commands, path):
    (folder / "script").write_text("\n".join(commands) + "\n")
    done = subprocess.run([TOOLS["debugfs"], "-w", "-f", str(folder / "script"), path], capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


@pytest.fixture(scope="module")
def image(tmp_path_factory):
    folder = tmp_path_factory.mktemp("image")
    path = str(folder / "mdt0.img")
    subprocess.run([TOOLS["mke2fs"], "-q", "-F", "-t", "ext4", "-I", "512", "-N", "512", "-g", "1024", "-b", "1024", "-O", "^has_journal", "-L", "work-MDT0000", path, "16M"], check=True)
    blobs = {
        "root.lma": lma(0x200000007, 1), "dir.lma": lma(0x200000401, 1), "dir.link": linkea(((0x200000007, 1), b"d")),
        "f.lma": lma(0x200000401, 2), "f.link": linkea(((0x200000401, 1), b"f"), ((0x200000007, 1), b"hard")), "f.lov": bytes.fromhex(LOV_COMP),
        "g.lma": lma(0x200000401, 3), "g.link": linkea(((0x200000007, 1), b"g")), "g.lov": bytes.fromhex(LOV_V1), "g.som": struct.pack("<HHIQQ", 1, 0, 0, 777, 8),
        "s.lma": lma(0x200000401, 4), "s.link": linkea(((0x200000007, 1), b"s")), "s.lmv": bytes.fromhex(LMV_M),
        "big.lma": lma(0x200000401, 5), "big.link": linkea(*(((0x200000007, 1), b"n%03d" % i) for i in range(20))),
        "slave.lma": lma(0x200000405, 1), "slave.link": linkea(((0x200000401, 4), b"[0x200000405:0x1:0x0]:1")), "slave.lmv": bytes.fromhex(LMV_S[:16] + "01000000" + LMV_S[24:]),
        "fld": index_file(8, 24, [(struct.pack(">Q", 0x200000400), struct.pack(">QQII", 0x200000400, 0x240000400, 0, 0)), (struct.pack(">Q", 0x240000400), struct.pack(">QQII", 0x240000400, 0x280000400, 1, 1))]),
    }
    for name, body in blobs.items():
        (folder / name).write_bytes(body)
    at = lambda n: f"-f {folder / n}"
    commands = ["mkdir d", "mkdir s", f"write {folder / 'fld'} fld"]
    commands += [f"write {folder / 'dir.lma'} {x}" for x in ("g", "big", "plain", "gone")] + ["cd d", f"write {folder / 'dir.lma'} f", "cd /", "mkdir s/[0x200000405:0x1:0x0]:1"]
    commands += [f"ea_set {at(a)} {t} trusted.{x}" for t, names in (("/", ["root.lma"]), ("/d", ["dir.lma", "dir.link"]), ("/d/f", ["f.lma", "f.link", "f.lov"]), ("/g", ["g.lma", "g.link", "g.lov", "g.som"]), ("/s", ["s.lma", "s.link", "s.lmv"]), ("/big", ["big.lma", "big.link"]), ("/s/[0x200000405:0x1:0x0]:1", ["slave.lma", "slave.link", "slave.lmv"])) for a in names for x in [a.split(".")[1]]]
    commands += ["sif /gone dtime 1700000000", "sif /g uid 70000", "sif /g atime 0"]
    run(folder, commands, path)
    made = ext4.Image(path)
    rows = sorted((struct.pack(">QII", *lookup.parse(fid)), struct.pack(">II", i.ino, 1)) for i in made.scan(made.used_groups()) if (fid := (decode.lma(made.attributes(i).get("lma")) or (0, None))[1]))
    made.close()
    (folder / "oi.16").write_bytes(index_file(16, 8, rows))
    run(folder, [f"write {folder / 'oi.16'} oi.16"], path)
    assert os.path.getsize(path) == 16 << 20
    return path


def test_relations(spark, image):
    raw = mdt.read(spark, image)
    got = {r["fid"]: r for r in relations.inodes(raw).collect()}
    assert set(got) == {f"[0x200000401:0x{i}:0x0]" for i in (1, 2, 3, 4, 5)} | {SHARD}
    g = got["[0x200000401:0x3:0x0]"]
    assert (g["type"], g["size"], g["blocks"], g["uid"], g["atime"]) == ("file", 777, 8, 70000, None)
    assert got["[0x200000401:0x1:0x0]"]["type"] == "dir"
    links = {(r["fid"], r["name"]) for r in relations.links(raw).collect()}
    assert {("[0x200000401:0x2:0x0]", "f"), ("[0x200000401:0x2:0x0]", "hard")} <= links and len([x for x in links if x[0] == "[0x200000401:0x5:0x0]"]) == 20
    comps = sorted((r["fid"], r["comp_index"], r["stripe_count"]) for r in relations.layouts(raw).collect())
    assert comps == [("[0x200000401:0x2:0x0]", 0, 1), ("[0x200000401:0x2:0x0]", 1, 1), ("[0x200000401:0x3:0x0]", 0, 2)]
    objects = sorted((r["fid"], r["comp_index"], r["ost_idx"]) for r in relations.objects(raw).collect())
    assert objects == [("[0x200000401:0x2:0x0]", 0, 2), ("[0x200000401:0x3:0x0]", 0, 3), ("[0x200000401:0x3:0x0]", 0, 5)]


def test_flags_and_deleted(spark, image):
    raw = mdt.read(spark, image)
    every = relations.inodes(raw, skip_no_fid=False, skip_no_linkea=False)
    assert every.where("fid IS NULL AND type = 'file'").count() >= 3
    assert relations.inodes(raw, skip_no_linkea=False).where("fid = '[0x200000007:0x1:0x0]'").count() == 1
    with pytest.raises(ValueError):
        relations.inodes(raw, [])


def test_paths_and_stripes(spark, image):
    raw, dirents = mdt.read(spark, image), mdt.read(spark, image, "dirents")
    found = {r["fid"]: r["paths"] for r in paths.fid2path(raw).collect()}
    assert found["[0x200000401:0x2:0x0]"] == ["/d/f", "/hard"] and found["[0x200000401:0x3:0x0]"] == ["/g"]
    asked = spark.createDataFrame([("/d/f",), ("/none",), ("/",)], "path string")
    assert {r["path"]: r["fid"] for r in paths.path2fid(asked, dirents).collect()} == {"/d/f": "[0x200000401:0x2:0x0]", "/none": None, "/": "[0x200000007:0x1:0x0]"}
    rows = {(r["dir_fid"], r["parent_fid"], r["source"], r["parent_device"]) for r in dirstripe.dirstripe(raw, dirents).collect()}
    assert found[SHARD] == ["/s"] and "[0x200000007:0x1:0x0]" not in found
    assert ("[0x200000401:0x4:0x0]", "[0x200000405:0x1:0x0]", "master", image) in rows and ("[0x200000401:0x1:0x0]", "[0x200000401:0x1:0x0]", "plain", image) in rows


def test_index_files(spark, image):
    scanned = {(r["fid"], r["ino"]) for r in mdt.read(spark, image).where("fid IS NOT NULL").collect()}
    assert {(r["fid"], r["ino"]) for r in mdt.read(spark, image, "oi").collect()} == scanned and len(scanned) == 7
    fld = mdt.read(spark, image, "fld")
    assert [(int(r["range_start"]), int(r["range_end"]), r["mdt"]) for r in fld.collect()] == [(0x200000400, 0x240000400, 0)]
    seqs = spark.createDataFrame([(0x200000401,), (0x240000400,)], "seq long")
    assert {r["seq"]: r["mdt"] for r in fused.fld_join(seqs, fld.select("range_start", "range_end", "mdt")).collect()} == {0x200000401: 0, 0x240000400: None}


def test_views_and_snapshot(spark, image, tmp_path):
    mdt.register_views(spark, [image])
    assert spark.sql("SELECT count(*) FROM inodes i JOIN links l ON i.fid = l.fid").first()[0] == 26
    mdt.snapshot(spark, image, str(tmp_path / "snap"))
    assert spark.read.parquet(str(tmp_path / "snap" / "raw")).where("fid IS NOT NULL").count() == 7


def test_lookups_without_a_scan(spark, image):
    """By identifiers, rows are those of the scan; unknown ones are left out; columns are read alone; beyond the limit a join says the same."""
    fids = ["[0x200000401:0x2:0x0]", "[0x200000401:0x3:0x0]", "[0x1:0x1:0x0]", "junk"]
    wanted = mdt.read(spark, image).where(f"fid IN ('{fids[0]}', '{fids[1]}')").orderBy("fid").collect()
    assert mdt.read(spark, image, fids=fids).orderBy("fid").collect() == wanted
    narrow = mdt.read(spark, image, columns=["size", "fid"], fids=fids)
    assert narrow.columns == ["size", "fid"] and sorted(tuple(r) for r in narrow.collect()) == sorted((r["size"], r["fid"]) for r in wanted)
    many = fids + [f"[0x300000000:0x{i:x}:0x0]" for i in range(1, mdt.MOST_LOOKUPS + 1)]
    assert sorted(tuple(r) for r in mdt.read(spark, image, columns=["size", "fid"], fids=many).collect()) == sorted(tuple(r) for r in narrow.collect())
    assert {r["name"] for r in mdt.read(spark, image, "dirents", fids=["[0x200000401:0x1:0x0]"]).collect()} == {"f"}
    assert mdt.read(spark, image, columns=["ino"]).count() == mdt.read(spark, image).count()
    bare = mdt.read(spark, image, columns=["fid", "links"], names=False).where("fid = '[0x200000401:0x2:0x0]'").first()["links"]
    assert [(x["parent_fid"], x["name"]) for x in bare] == [("[0x200000401:0x1:0x0]", None), ("[0x200000007:0x1:0x0]", None)]
    with pytest.raises(Exception):
        mdt.read(spark, image, columns=["nothing"]).count()


def test_sql_functions(spark, image):
    lookup.register_functions(spark)
    found = {r["fid"]: r["paths"] for r in paths.fid2path(mdt.read(spark, image)).collect()}
    fids = sorted({r["fid"] for r in mdt.read(spark, image, columns=["fid"]).collect() if r["fid"]}) + ["[0x1:0x1:0x0]", "junk", None]
    spark.createDataFrame([(f,) for f in fids], "fid string").createOrReplaceTempView("asked_fids")
    for device in (f"'{image}'", f"array('{image}')"):
        assert {r["fid"]: r["p"] for r in spark.sql(f"SELECT fid, mdt_fid2path(fid, {device}) AS p FROM asked_fids").collect()} == {f: found.get(f) for f in fids}
        got = spark.sql(f"SELECT p, mdt_path2fid(p, {device}) AS fid FROM VALUES ('/d/f'), ('//d//'), ('/'), (''), ('/none'), (CAST(NULL AS STRING)) AS t(p)").collect()
        assert {r["p"]: r["fid"] for r in got} == {"/d/f": "[0x200000401:0x2:0x0]", "//d//": "[0x200000401:0x1:0x0]", "/": "[0x200000007:0x1:0x0]", "": "[0x200000007:0x1:0x0]", "/none": None, None: None}
    assert [r[0] for r in spark.sql("SELECT mdt_path2fid(p, CAST(NULL AS STRING)) FROM VALUES ('/'), ('/d') AS t(p)").collect()] == ["[0x200000007:0x1:0x0]", None]
    raw = mdt.read(spark, image)
    for name in ("inodes", "links", "layouts", "objects"):
        for flags in ((True, True), (False, False)):
            sql = spark.sql(f"SELECT * FROM mdt_{name}('{image}', skip_no_fid => {flags[0]}, skip_no_linkea => {flags[1]})")
            want = getattr(relations, name)(raw, None, *flags)
            assert sql.columns == want.columns
            assert sorted(map(str, sql.collect())) == sorted(map(str, want.collect())), (name, flags)


def test_locate(spark):
    fids = spark.createDataFrame([("[0x400:0x1:0x0]",), ("[0x400:0x2:0x0]",), ("[0x900:0x1:0x0]",), ("[0x901:0x1:0x0]",), (None,)], "fid string")
    fld = spark.createDataFrame([(0x400, 0x500, 1)], "range_start long, range_end long, mdt long")
    oi = spark.createDataFrame([("[0x400:0x1:0x0]", "a", 0), ("[0x400:0x1:0x0]", "b", 1), ("[0x400:0x2:0x0]", "a", 0), ("[0x900:0x1:0x0]", "c", 2), ("[0x900:0x1:0x0]", "b", 1)], "fid string, device string, ord int")
    targets = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "mdt long, device string")
    got = {r["fid"]: r["device"] for r in fused.locate(fids, fld, oi, targets).collect()}
    assert got == {"[0x400:0x1:0x0]": "b", "[0x400:0x2:0x0]": "a", "[0x900:0x1:0x0]": "b", "[0x901:0x1:0x0]": None, None: None}


@pytest.mark.parametrize("features", ["^resize_inode,meta_bg", "inline_data"])
def test_meta_groups_and_inline_data(spark, tmp_path, features):
    """Images whose descriptors lie in their groups, and whose small files and directories lie in their inodes."""
    path = str(tmp_path / "x.img")
    subprocess.run([TOOLS["mke2fs"], "-q", "-F", "-t", "ext4", "-I", "512", "-N", "4096", "-g", "256", "-b", "1024", "-O", f"^has_journal,{features}", path, "12M"], check=True)
    (tmp_path / "lma").write_bytes(lma(0x200000401, 9))
    (tmp_path / "root").write_bytes(lma(0x200000007, 1))
    (tmp_path / "text").write_text("some text")
    commands = ["mkdir d"] + [f"write {tmp_path / 'text'} d/f{i}" if i else "cd d" for i in range(1)] + [f"write {tmp_path / 'text'} f{i}" for i in range(3)] + [f"ea_set -f {tmp_path / 'lma'} f2 trusted.lma", f"ea_set -f {tmp_path / 'root'} / trusted.lma"]
    run(tmp_path, commands, path)
    rows = mdt.read(spark, path, "dirents").where("name LIKE 'f_'").collect()
    assert sorted((r["name"], r["fid"]) for r in rows) == [("f0", None), ("f1", None), ("f2", "[0x200000401:0x9:0x0]")]
    image = ext4.Image(path)
    names = dict(image.entries(image.inode(dict(image.entries(image.inode(2)))["d"])))
    assert image.data(image.inode(names["f1"])) == b"some text"
    image.close()
