"""Directory trees: paths, reachability and changes of the tree.

Ways to the root are found by pointer doubling: each node knows an ancestor and
the way to it, and in a round takes over what that ancestor knows, so the ways
double and a tree of any depth needs as many rounds as its depth has binary
digits. Each round is a join of the nodes with themselves and a table in the
shared folder. A round in which no node arrives means that none can: what is
left hangs on a cycle, or on no root.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.session import new_folder, remove, written

ROOT = 1


def _arrived(nodes: DataFrame, step) -> DataFrame:
    """Rows of (id, up, .., arrived) that have arrived. ``step`` joins those under way (l) with what they point to (r)."""
    spark = nodes.sparkSession
    folder, n = new_folder(spark, "tree"), 0
    state = written(nodes, f"{folder}/0")
    there = state.where("arrived").count()
    while True:
        moved = step(state.where(~F.col("arrived")).alias("l"), state.alias("r")).select(*state.columns)
        n += 1
        state = written(state.where("arrived").unionByName(moved), f"{folder}/{n}")
        remove(spark, f"{folder}/{n - 1}")
        before, there = there, state.where("arrived").count()
        if there == before:
            return state.where("arrived")


def with_paths(inodes: DataFrame) -> DataFrame:
    """(id, ino, is_dir, path, depth) of everything under the root, which is ``/``. What hangs on a cycle isn't under it."""
    root = F.col("ino") == ROOT
    slim = inodes.select(
        "id", "ino", "is_dir", F.when(~root, F.col("parent_id")).alias("up"), F.when(root, "").otherwise(F.concat(F.lit("/"), "name")).alias("path"), F.when(root, 0).otherwise(1).alias("depth"), root.alias("arrived")
    )

    def step(l: DataFrame, r: DataFrame) -> DataFrame:
        both = l.join(r, F.col("l.up") == F.col("r.id"))
        return both.select("l.id", "l.ino", "l.is_dir", "r.up", F.concat("r.path", "l.path").alias("path"), (F.col("l.depth") + F.col("r.depth")).alias("depth"), "r.arrived")

    found = _arrived(slim, step)
    return found.select("id", "ino", "is_dir", F.when(F.col("path") == "", "/").otherwise(F.col("path")).alias("path"), "depth")


def reachable_files(inodes: DataFrame) -> DataFrame:
    return with_paths(inodes).where(~F.col("is_dir"))


def clean_path(path: str) -> str:
    """Without blanks around, empty segments and closing slashes."""
    return "/" + "/".join(part for part in path.strip().split("/") if part)


def resolve(inodes: DataFrame, path: str) -> DataFrame:
    """The inode a path names: a point lookup for each segment, so only one row of a level is read on."""
    found = inodes.where(F.col("ino") == ROOT)
    for part in clean_path(path).split("/"):
        if part:
            here = found.select(F.col("id").alias("_parent"))
            found = inodes.join(F.broadcast(here.limit(1)), F.col("parent_id") == F.col("_parent")).where(F.col("name") == part).drop("_parent")
    return found


def must_resolve(inodes: DataFrame, path: str):
    row = resolve(inodes, path).first()
    if row is None:
        raise FileNotFoundError(path)
    return row


def descendants(inodes: DataFrame, roots: DataFrame) -> DataFrame:
    """Ids of ``roots`` (id) and of everything below them, in a cycle too."""
    tops = roots.select("id").distinct()
    nodes = inodes.select("id", F.col("parent_id").alias("up")).join(tops.withColumn("below", F.lit(True)), "id", "full_outer")
    below = F.coalesce("below", F.lit(False))
    nodes = nodes.select("id", "up", below.alias("below"), (below | F.col("up").isNull()).alias("arrived"))

    def step(l: DataFrame, r: DataFrame) -> DataFrame:
        both = l.join(r, F.col("l.up") == F.col("r.id"), "left")
        return both.select("l.id", "r.up", F.coalesce("r.below", F.lit(False)).alias("below"), F.coalesce("r.arrived", F.lit(True)).alias("arrived"))

    return _arrived(nodes, step).where("below").select("id")


def delete_cascade(inodes: DataFrame, gone: DataFrame, versions: DataFrame, dependants: dict[str, tuple[DataFrame, str]]) -> dict[str, DataFrame]:
    """All tables without the inodes ``gone`` (id), their versions, and rows that hang on those versions.

    dependants: name -> (table, column that names the version).
    """
    left = versions.join(gone.select(F.col("id").alias("inode_id")), "inode_id", "left_anti")
    dead = versions.join(gone.select(F.col("id").alias("inode_id")), "inode_id", "left_semi").select(F.col("id").alias("_v"))
    out = {"inode_registry": inodes.join(gone.select("id"), "id", "left_anti"), "file_versions": left}
    for name, (df, column) in dependants.items():
        out[name] = df.join(dead, F.col(column) == F.col("_v"), "left_anti")
    return out


def rename(inodes: DataFrame, source: object, parent: object, name: str) -> tuple[DataFrame, DataFrame]:
    """(inodes after the move, ids that its target replaced); the source itself is never replaced."""
    at_target = F.col("parent_id").eqNullSafe(F.lit(parent)) & (F.col("name") == name) & (F.col("id") != source)
    replaced = inodes.where(at_target).select("id")
    kept = inodes.where(~F.coalesce(at_target, F.lit(False)))
    moving = F.col("id") == source
    return kept.withColumns({"parent_id": F.when(moving, F.lit(parent)).otherwise(F.col("parent_id")), "name": F.when(moving, F.lit(name)).otherwise(F.col("name"))}), replaced


def set_attributes(inodes: DataFrame, inode: object, **given) -> DataFrame:
    """Only what is given changes; a mode keeps the type bits it had."""
    here = F.col("id") == inode
    changes = {}
    for column, value in given.items():
        new = F.lit(value).cast(inodes.schema[column].dataType)
        if column == "mode" and value is not None:
            new = F.col("mode").bitwiseAND(F.lit(0o170000)).bitwiseOR(F.lit(value & 0o7777))
        changes[column] = F.when(here, F.coalesce(new, F.col(column))).otherwise(F.col(column))
    return inodes.withColumns(changes)


def touch_access(inodes: DataFrame, inode: object, now, due) -> DataFrame:
    """The access time moves only where it is due."""
    return inodes.withColumn("atime", F.when((F.col("id") == inode) & due, F.lit(now)).otherwise(F.col("atime")))


def create_inode(inodes: DataFrame, parent: object, name: str, inode: object, is_dir: bool = False, **given) -> DataFrame:
    """inodes with a new entry numbered after the last; a name that is taken in its folder is an error."""
    from palimpsest.schema import conform

    spark = inodes.sparkSession
    taken = inodes.where(F.col("parent_id").eqNullSafe(F.lit(parent)) & (F.col("name") == name))
    if not taken.isEmpty():
        raise FileExistsError(name)
    last = inodes.agg(F.coalesce(F.max("ino"), F.lit(0)).alias("_last"))
    new = spark.range(1).crossJoin(F.broadcast(last)).select(F.lit(inode).alias("id"), (F.col("_last") + 1).alias("ino"), F.lit(parent).alias("parent_id"), F.lit(name).alias("name"), F.lit(is_dir).alias("is_dir"), *(F.lit(v).alias(k) for k, v in given.items()))
    return inodes.unionByName(conform(new, "inode_registry").select(*inodes.columns))
