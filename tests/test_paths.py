"""Paths where identifiers repeat: the first device decides, however many there are."""

import itertools
import random

import pytest

from metalith.functions.fid import ROOT
from metalith.operators import paths

RAW = "device string, ord int, mode bigint, fid string, links array<struct<parent_fid:string,name:string>>, lmv struct<role:string,stripe_count:bigint,mdt_index:bigint,hash_type:bigint,layout_version:bigint>"
DIR, FILE = 0x41ED, 0x81A4


def inodes():
    r = random.Random(5)
    rows = [("mdt0", 0, DIR, f"[0x{d}:0x0:0x0]", [(ROOT, f"d{d}")], None) for d in range(1, 9)]
    rows += [("mdt1", 1, DIR, f"[0x{d}:0x0:0x0]", [(ROOT, f"other{d}")], None) for d in range(1, 4)]
    for k in range(60):
        for device in sorted(r.sample(range(4), r.choice([1, 1, 2, 3]))):
            links = [(f"[0x{r.randrange(1, 13)}:0x0:0x0]", f"f{k}_{device}_{i}") for i in range(r.choice([0, 1, 1, 2, 3]))]
            rows.append((f"mdt{device}", device, FILE, f"[0xf:0x{k}:0x0]", links or None, None))
    rows.append(("mdt0", 0, DIR, "[0x20:0x0:0x0]", None, ("slave", 4, 1, 2, 1)))
    rows.append(("mdt0", 0, DIR, "[0x21:0x0:0x0]", [("[0x5:0x0:0x0]", "[0x21:0x0:0x0]:1")], ("slave", 4, 1, 2, 1)))
    return rows


def plainly(rows):
    first = {}
    for row in sorted(rows, key=lambda x: x[1]):
        first.setdefault(row[3], row)
    above = {ROOT: ""} | {f: f"/{row[4][0][1]}" for f, row in first.items() if row[2] == DIR and not row[5]}
    found = {}
    for fid, row in first.items():
        ups = [(p, "" if row[5] else "/" + n) for p, n in row[4] or []]
        if got := [above[p] + n for p, n in ups if p in above]:
            found[fid] = got
    return found, {row[3] for row in rows if row[4]} - set(found)


@pytest.mark.parametrize("few", [0, 100_000])
def test_repeated_identifiers(spark, monkeypatch, few):
    monkeypatch.setattr(paths, "FEW", few)
    rows = inodes()
    raw = spark.createDataFrame(rows, RAW)
    found, lost = plainly(rows)
    assert lost and {r["fid"]: r["paths"] for r in paths.fid2path(raw).collect()} == found
    assert sorted(r["fid"] for r in paths.without_path(raw).collect()) == sorted(lost)
    asked = spark.createDataFrame([(f,) for f in [*found, "[0xf:0xffff:0x0]"]], "fid string")
    assert {r["fid"]: r["paths"] for r in paths.fid2path(raw, asked).collect()} == found | {"[0xf:0xffff:0x0]": None}


def test_inodes_of_one_link_are_not_grouped(spark):
    """Nothing sorts or groups all inodes; only those of several links are."""
    raw = spark.createDataFrame([x for x in inodes() if x[1] == 0], RAW)
    plan = paths.fid2path(raw)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "Window" not in plan


DIRENTS = "parent_fid string, name string, fid string, device string, ord int"


def test_path2fid_on_odd_entries(spark):
    """As walking down entry by entry: the first device decides, names with a slash or without a letter lead nowhere, and the rows asked are kept as they are."""
    r = random.Random(7)
    fids = [f"[0x{d}:0x0:0x0]" for d in range(1, 300)]
    tops = [ROOT, *fids]
    rows = [(tops[r.randrange(k // 2 + 1)], r.choice([*"aabbccdd", "a/b", "", None]), fid, "mdt1", 1) for k, fid in enumerate(fids)]
    # the same names on a device before and one after; on the first some have no identifier
    rows += [(parent, name, r.choice([f"[0xf0:0x{k}:0x0]", None]), f"mdt{ord}", ord) for k, (parent, name, *_) in enumerate(rows) for ord in r.choice([[], [], [], [], [2], [0], [0, 2]])]
    first = {}
    for parent, name, fid, _, ord in sorted(rows, key=lambda x: (x[4], x[2] or "")):
        first.setdefault((parent, name), fid)

    def walked(path):
        at = ROOT
        for part in [x for x in path.split("/") if x]:
            at = at and first.get((at, part))
        return at

    asked = ["", "/", "//a//", "a/b", None, "/none", "/a", "/a"] + ["/" + "/".join(x) for n in range(1, 5) for x in itertools.product("abcd", repeat=n)]
    want = sorted((path or "-", k, (path is not None and walked(path)) or "-") for k, path in enumerate(asked))
    assert len({fid for _, _, fid in want}) > 8
    got = paths.path2fid(spark.createDataFrame(list(enumerate(asked)), "k int, path string"), spark.createDataFrame(rows, DIRENTS))
    assert got.columns == ["path", "k", "fid"]
    assert sorted((x["path"] or "-", x["k"], x["fid"] or "-") for x in got.collect()) == want


def test_entries_nobody_asks_for_are_not_dealt_out(spark, monkeypatch):
    """Of many entries only those asked for, and a few others, are grouped; the asked paths themselves aren't grouped."""
    rows = spark.range(100_000).selectExpr(f"'{ROOT}' AS parent_fid", "'n' || id AS name", "'[0x1:0x' || hex(id) || ':0x0]' AS fid", "'mdt0' AS device")
    asked = spark.range(1000).selectExpr("'/n' || id * 3 AS path")
    written, settle = [], paths.settle
    monkeypatch.setattr(paths, "settle", lambda df: written.append(df) or settle(df))
    got = paths.path2fid(asked, rows)
    assert got.where("fid IS NOT NULL").count() == 1000
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan
    before = written[0]._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" not in before and "BroadcastHashJoin" in before
    some = paths.perhaps_among(rows, "name", asked.selectExpr("substr(path, 2)"))
    assert some.columns == rows.columns and 1000 <= some.count() < 1100
