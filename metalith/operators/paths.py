"""Identifiers to paths and back.

Every directory has one link that leads up, so directories form a forest. Paths of all
directories come from pointer doubling: each round joins a directory's ancestor with that
ancestor's own ancestor, so depth d takes log2(d) joins, not d; what hasn't met the root after
twelve rounds (4096 levels) lies on a cycle or is cut off, and has no path.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from metalith.functions.fid import ROOT, TYPE_MASK
from metalith.operators.dirstripe import shard_parent
from metalith.operators.relations import LINKED, each, has_links

ROUNDS = 12


def local_folder(spark: SparkSession) -> str:
    """A folder of our own, where the session names none: in local mode only, since other machines wouldn't see it."""
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="metalith-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def settle(df: DataFrame) -> DataFrame:
    """Write to the folder all executors share, ``spark.checkpoint.dir``, and read back."""
    spark: SparkSession = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or local_folder(spark)
    path = f"{folder}/metalith-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Up to so many repeated identifiers are sorted out apart from the rest.
FEW = 100_000


def on_first_device(inodes: DataFrame) -> DataFrame:
    """``inodes`` (fid, ord, …) with one row an identifier, that of the least ord; ``linked``, if there is such a column, is true if it was on any.

    Only rows that share a 64-bit hash of their identifier with another are sorted; to find them, the hashes alone are dealt out."""
    key = F.xxhash64("fid")
    # sorted, since a hash table of all takes three times the memory and can't spill
    again = F.lag("h").over(Window.partitionBy("h").orderBy("h"))
    repeated = settle(inodes.select(key.alias("h")).withColumn("again", again).where("again IS NOT NULL").select("h").distinct())
    n = repeated.count()
    if n == 0:
        return inodes
    columns = inodes.columns

    def first(rows: DataFrame) -> DataFrame:
        same = Window.partitionBy(key, "fid")
        ranked = rows.withColumn("rank", F.row_number().over(same.orderBy("ord")))
        if "linked" in columns:
            ranked = ranked.withColumn("linked", F.max("linked").over(same))
        return ranked.where("rank = 1").select(columns)

    if n > FEW:
        return first(inodes)
    keyed, few = inodes.withColumn("h", key), F.broadcast(repeated)
    return keyed.join(few, "h", "left_anti").select(columns).unionByName(first(keyed.join(few, "h", "left_semi").select(columns)))


def directory_edges(raw: DataFrame) -> DataFrame:
    """(fid, parent_fid, step) of each directory; a shard is passed through without a name, an ambiguous directory has no edge."""
    dirs = raw.where((F.col("mode").bitwiseAND(F.lit(TYPE_MASK)) == 0x4000) & F.col("fid").isNotNull() & (F.col("fid") != ROOT))
    distinct = F.array_distinct(F.col("links"))
    only = F.when(F.size(distinct) == 1, F.get(distinct, F.lit(0)))
    slave = F.coalesce(F.col("lmv.role") == "slave", F.lit(False))
    up = F.when(slave, shard_parent(F.col("fid"), F.col("links"), F.col("lmv.mdt_index"))).otherwise(only["parent_fid"])
    step = F.when(slave, F.lit("")).otherwise(F.concat(F.lit("/"), only["name"]))
    edges = dirs.select("fid", "ord", up.alias("parent_fid"), step.alias("step")).where(F.col("parent_fid").isNotNull())
    return on_first_device(edges).select("fid", "parent_fid", "step")


def climbed(edges: DataFrame) -> DataFrame:
    """(fid, path) of what reaches the root over edges (fid, up, path), and of the root, whose path is empty."""
    state = settle(edges)
    for _ in range(ROUNDS):
        pending = state.where(F.col("up") != ROOT)
        if pending.isEmpty():
            break
        above = state.select(F.col("fid").alias("up"), F.col("up").alias("higher"), F.col("path").alias("before"))
        moved = pending.join(above, "up").select("fid", F.col("higher").alias("up"), F.concat("before", "path").alias("path"))
        state = settle(state.where(F.col("up") == ROOT).unionByName(moved))
    root = edges.sparkSession.range(1).select(F.lit(ROOT).alias("fid"), F.lit("").alias("path"))
    return state.where(F.col("up") == ROOT).select("fid", "path").unionByName(root)


def directory_paths(raw: DataFrame) -> DataFrame:
    """(fid, path) of every directory below the root, and of the root, whose path is empty."""
    return climbed(directory_edges(raw).select("fid", F.col("parent_fid").alias("up"), F.col("step").alias("path")))


def ascents(raw: DataFrame, fids: DataFrame | None = None) -> DataFrame:
    """(fid, linked, n, ups) of each inode, or of those in ``fids``: the n entries (parent_fid, name) by which paths lead to it; a shard has its master's."""
    inodes = raw.where(F.col("fid").isNotNull()).select("fid", "ord", has_links(raw).alias("linked"), "links", "lmv")
    if fids is not None:
        inodes = settle(inodes.join(fids.select("fid").distinct(), "fid", "left_semi"))
    slave = F.coalesce(F.col("lmv.role") == "slave", F.lit(False))
    master = shard_parent(F.col("fid"), F.col("links"), F.col("lmv.mdt_index"))
    ups = F.when(slave, F.array(F.struct(master.alias("parent_fid"), F.lit("").alias("name")))).otherwise(F.col("links"))
    ups = F.coalesce(ups, F.array().cast(LINKED))
    return on_first_device(inodes).select("fid", "linked", F.size(ups).alias("n"), ups.alias("ups"))


def resolved(ascents: DataFrame, above: DataFrame, how: str) -> DataFrame:
    """(fid, at, path) of each entry of ``ascents``, in their order; path is null where it doesn't lead to a directory of ``above`` (fid, path), if ``how`` keeps such rows."""
    entries = ascents.select("fid", F.posexplode(each("ups", LINKED)).alias("at", "l")).select("fid", "at", "l.parent_fid", "l.name")
    # the hash is what rows are sorted by: identifiers begin alike
    met = (F.xxhash64("parent_fid") == F.xxhash64("dir")) & (F.col("parent_fid") == F.col("dir"))
    named = F.when(F.col("name") != "", F.concat("above", F.lit("/"), "name")).when(F.col("above") != "", F.col("above")).when(F.col("above").isNotNull(), F.lit("/"))
    return entries.join(above.toDF("dir", "above"), met, how).select("fid", "at", named.alias("path"))


def fid2path(raw: DataFrame, fids: DataFrame | None = None) -> DataFrame:
    """(fid, paths): the paths of each inode in the order of its links; links that lead nowhere are left out, and an inode without any path has no row.

    A shard of a striped directory has one path, that of the directory; its own name isn't shown.
    With ``fids`` (column fid), one row for each of them, with null where nothing resolves. Only inodes with several links are grouped; they take a scan of their own."""
    all_ups, above = ascents(raw, fids), directory_paths(raw)
    single = resolved(all_ups.where("n = 1"), above, "inner").select("fid", F.array("path").alias("paths"))
    several = resolved(all_ups.where("n > 1"), above, "inner").groupBy("fid").agg(F.array_sort(F.collect_list(F.struct("at", "path"))).alias("p"))
    paths = single.unionByName(several.select("fid", F.transform("p", lambda x: x["path"]).alias("paths")))
    return paths if fids is None else fids.join(paths, "fid", "left")


def without_path(raw: DataFrame) -> DataFrame:
    """(fid), once each: the identifiers with links that ``fid2path`` has no row for."""
    all_ups, above = ascents(raw).where("linked"), directory_paths(raw)
    single = resolved(all_ups.where("n = 1"), above, "left").where("path IS NULL").select("fid")
    several = resolved(all_ups.where("n > 1"), above, "left").groupBy("fid").agg(F.count("path").alias("found")).where("found = 0").select("fid")
    return single.unionByName(several).unionByName(all_ups.where("n = 0").select("fid"))


#: A filter of strings: so many blocks of so many words of 64 bits, 32 MB in all.
BLOCKS, WORDS = 1 << 19, 8


def marks(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with the block (b) that ``column`` falls in, the word in it (w) and the word's two bits (bits)."""
    bit = "shiftleft(1L, CAST(shiftright(h, {}) & 63 AS INT))"
    hashed = rows.withColumn("h", F.xxhash64(column))
    return hashed.selectExpr(*rows.columns, f"h & {BLOCKS - 1}L AS b", f"shiftright(h, 40) & {WORDS - 1}L AS w", f"{bit.format(44)} | {bit.format(52)} AS bits")


def perhaps_among(rows: DataFrame, column: str, values: DataFrame) -> DataFrame:
    """The ``rows`` whose ``column`` is among ``values`` (one column), and a few others, without dealing any out: a Bloom filter.

    Its size is fixed, and so is that of the broadcast table: of 10 million values one other row in a hundred passes, of 60 million one in seven."""
    words = [F.bit_or(F.when(F.col("w") == i, F.col("bits")).otherwise(F.lit(0).cast("bigint"))).alias(f"w{i}") for i in range(WORDS)]
    table = F.broadcast(marks(values.toDF("value"), "value").groupBy("b").agg(*words))
    word = F.coalesce(*[F.when(F.col("w") == i, F.col(f"w{i}")) for i in range(WORDS)])
    return marks(rows, column).join(table, "b").where(word.bitwiseAND(F.col("bits")) == F.col("bits")).select(rows.columns)


def path2fid(paths: DataFrame, dirents: DataFrame) -> DataFrame:
    """``paths`` (column path) with the fid each leads to, or null; it is read twice.

    ``dirents`` has (parent_fid, name, fid, device[, ord]) and is read once: only entries whose name some
    path asks for are kept, and a few others. Directories among them get their paths from the root by pointer doubling, and
    each asked path meets the paths of the entries in one join, where it finds one at most. Empty names are dropped, and the
    empty path is the root. An entry that lives in a shard isn't found from its directory: for
    that, pass ``logical_dirents``. Of entries with one parent and name the first device's counts; one without an identifier leads nowhere."""
    parts = F.array_remove(F.split("path", "/"), "")
    first = "ord" if "ord" in dirents.columns else "device" if "device" in dirents.columns else "fid"
    # a name with a slash would pass for a path of two
    named = dirents.select("parent_fid", "name", "fid", F.col(first).alias("o")).where((F.col("name") != "") & ~F.contains("name", F.lit("/")))
    some = perhaps_among(named, "name", paths.select(F.explode(parts)))
    # the hash is what rows are sorted by: identifiers begin alike
    ranked = some.groupBy(F.xxhash64("parent_fid", "name"), "parent_fid", "name").agg(F.min(F.struct("o", "fid"))["fid"].alias("fid"))
    entries = settle(ranked.where(F.col("fid").isNotNull()).select("parent_fid", "name", "fid"))
    inner = perhaps_among(entries, "fid", entries.select("parent_fid")).select("fid", F.col("parent_fid").alias("up"), F.concat(F.lit("/"), "name").alias("path"))
    met = (F.xxhash64("parent_fid") == F.xxhash64("dir")) & (F.col("parent_fid") == F.col("dir"))
    found = entries.join(climbed(inner).toDF("dir", "above"), met).select(F.concat("above", F.lit("/"), "name").alias("__found"), F.col("fid").alias("__fid"))
    asked = paths.withColumn("__asked", F.concat(F.lit("/"), F.array_join(parts, "/")))
    same = (F.xxhash64("__asked") == F.xxhash64("__found")) & (F.col("__asked") == F.col("__found"))
    fid = F.when(F.col("__asked") == "/", F.lit(ROOT)).otherwise(F.col("__fid")).alias("fid")
    return asked.join(found, same, "left").select("path", *[c for c in paths.columns if c != "path"], fid)


def logical_dirents(dirents: DataFrame, dirstripe: DataFrame) -> DataFrame:
    """``dirents`` whose parents are the directories that users see, not shards."""
    up = dirstripe.where(F.col("parent_fid") != F.col("dir_fid")).select(F.col("parent_fid"), "dir_fid").distinct()
    joined = dirents.join(up, "parent_fid", "left")
    return joined.select(F.coalesce("dir_fid", "parent_fid").alias("parent_fid"), *[c for c in dirents.columns if c != "parent_fid"])
