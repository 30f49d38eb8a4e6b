"""Links between rows that share a listed key, and the groups the links make.

``linked_groups`` never emits all pairs of a list. First each list is a star:
its member of least id (its "hub") is compared with every other. Groups are
formed, and lists whose members now lie in one group are settled: no pair in
them can change anything. Of the others, short ones are compared whole across
groups; long ones are split by finer keys where such are sure to part no link,
and stars again where still long; without such keys they stay whole.
What stays unsettled is gathered and compared in blocks of bounded size:
the members outside a gathering's largest group against all its members, within
a task's memory, returning links alone. No partner is capped or left out.

Most keys are one member's alone. An aggregate that combines before its exchange
finds those that two different members have, with their hubs; only their
postings are written, and everything after works on these.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import kernels
from palimpsest.llm.spark_io import Scratch

#: Unsettled lists up to this length are compared whole.
SHORT_LIST = 24
#: Edges up to this many are joined by one task, some 50 MB of its memory.
ONE_TASK = 500_000
#: Members of a block: those that look for links, and those looked at.
SEEKERS, SOUGHT = 2048, 2048
#: Members that small gatherings, a block each, are put together up to.
TOGETHER = 4096


class Side(NamedTuple):
    """What a block knows of its seekers or of those sought, but their payloads."""

    ids: np.ndarray
    groups: np.ndarray
    lists: np.ndarray
    seeks: np.ndarray
    places: np.ndarray | None = None


def meets(own: Side, i, other: Side, j=slice(None)) -> np.ndarray:
    """Whom seekers are compared with: others of their list and not of their group; of two that seek each other one alone does."""
    ids = other.ids[j]
    turn = (ids > own.ids[i]) ^ (((ids ^ own.ids[i]) & 1) == 1)
    return (other.lists[j] == own.lists[i]) & (other.groups[j] != own.groups[i]) & (turn | ~other.seeks[j])


def _component_batches(batches) -> Iterator[pa.RecordBatch]:
    """(id, component) by edges; each end is hooked to the least root that its edges lead to, until none changes."""
    held = [np.stack([np.asarray(batch.column(k)) for k in (0, 1)]) for batch in batches]
    if not held:
        return
    ids, ends = np.unique(np.concatenate(held, axis=1), return_inverse=True)
    one, other = ends.reshape(2, -1)
    root = np.arange(len(ids))
    while (root[one] != root[other]).any():
        np.minimum.at(root, np.maximum(root[one], root[other]), np.minimum(root[one], root[other]))
        while (root[root] != root).any():
            root = root[root]
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ids[root], pa.int64())], names=["id", "component"])


def connected_components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(id, component) of every id in ``edges`` (a, b); component is the least id reachable.

    Up to ONE_TASK edges are joined by one task. More take alternating large-star
    and small-star steps; each is an aggregate and a join, so a hub is
    pre-aggregated and its join can be split.
    """
    current = scratch.write(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    if current.limit(ONE_TASK + 1).count() <= ONE_TASK:
        return current.repartition(1).mapInArrow(kernels.tidy(_component_batches), "id long, component long")
    while True:
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(down, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        after = scratch.write(small)
        scratch.drop(current)
        current = after
        # done when every edge leads to a centre: no lower end of an edge is an upper end of another
        if current.join(current.select(F.col("u").alias("w")), F.col("v") == F.col("w"), "left_semi").isEmpty():
            break
    own = current.select("v").distinct().select(F.col("v").alias("id"), F.col("v").alias("component"))
    return current.select(F.col("u").alias("id"), F.col("v").alias("component")).union(own)


def linked_groups(
    scratch: Scratch,
    postings: DataFrame,
    finer: Callable[[DataFrame, DataFrame], DataFrame],
    verify: Callable[[DataFrame], DataFrame],
    payload: Callable[[DataFrame], DataFrame],
    links_within: Callable[[list[bytes], list[bytes], Side, Side], Iterator[tuple[int, int]]],
    further: DataFrame | None = None,
    certain: DataFrame | None = None,
) -> DataFrame:
    """(id, component) of every id linked to another that shares a key.

    postings: (key, id), rows may repeat. finer splits long lists: it takes
    (parent, id, ..) and the listed (key, id) and returns (key, id, ..) with the
    keys of the lists that ``parent`` falls into; it must part no two members that
    are linked. verify takes distinct (a, b),
    a < b, and returns those linked. payload returns (id, payload binary) for ids;
    links_within takes payloads and sides of seekers and sought, and yields
    positions of links between those that meet, enough to join what is joined.
    further: (a, b), a < b, pairs to verify whatever lists they share; certain:
    pairs that are linked.
    """
    hubs = postings.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("last")).where("hub <> last").select("key", "hub")
    listed = scratch.write(postings.join(hubs.hint("shuffle_hash"), "key").distinct())
    scratch.settle()
    star = listed.where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b"))
    links = verify((star if further is None else star.union(further)).distinct())
    links = scratch.write(links if certain is None else links.union(certain))
    groups = scratch.write(connected_components(scratch, links))
    scratch.settle()

    rest = scratch.write(_unsettled(listed, groups, "key"))
    if rest.isEmpty():
        return groups
    # a list's own hub has met the others already
    short = _across(rest.where((F.col("n") <= SHORT_LIST) & (F.col("id") != F.col("hub"))))
    split = finer(rest.where(F.col("n") > SHORT_LIST).select(F.col("key").alias("parent"), "id", "component"), listed.select("key", "id")).select("key", "id", "component").distinct()
    counted = split.groupBy("key").agg(F.count("*").alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key", "n")
    split = scratch.write(split.join(counted, "key"))
    still = split.where(F.col("n") > SHORT_LIST)
    pairs = short.union(_across(split.where(F.col("n") <= SHORT_LIST))).union(_star(still))
    groups, links = _extend(scratch, verify(pairs.distinct()), groups, links)
    scratch.settle()

    hub = still.groupBy("key").agg(F.min("id").alias("hub"))
    gathered = _unsettled(still.select("key", "id"), groups, "key").select("key", "id").join(hub, "key").select("hub", "id").distinct()
    rest = scratch.write(_unsettled(gathered, groups, "hub").drop("n"))
    if rest.isEmpty():
        return groups
    return _extend(scratch, _blocks(scratch, rest, payload, links_within), groups, links)[0]


def linked_lists(
    scratch: Scratch,
    listed: DataFrame,
    fits: Callable[[str, str], Column],
    verify: Callable[[DataFrame], DataFrame],
    payload: Callable[[DataFrame], DataFrame],
    links_within: Callable[[list[bytes], list[bytes], Side, Side], Iterator[tuple[int, int]]],
) -> DataFrame:
    """(id, component) of every id linked to another of one of its lists, where members have places in lists.

    listed: (key, id, place, .., hub, n, near), the members of lists, each once,
    with the list's hub, its length and whether the member fits the hub. fits
    tells of two tables of members, by their names, which rows fit: pairs that
    don't are not linked by this list. verify, payload and links_within as in
    ``linked_groups``; long lists are compared whole.
    """
    links = scratch.write(verify(listed.where("near and id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()))
    groups = scratch.write(connected_components(scratch, links))
    scratch.settle()
    # a list's own hub has met the others already, so lists of two are done
    rest = scratch.write(_unsettled(listed.where("n > 2").drop("n", "near"), groups, "key"))
    if rest.isEmpty():
        return groups
    short = rest.where((F.col("n") <= SHORT_LIST) & (F.col("id") != F.col("hub")))
    fitting = F.expr("x.key = y.key and x.id < y.id and x.component <> y.component") & fits("x", "y")
    pairs = short.alias("x").join(short.alias("y"), fitting).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    groups, links = _extend(scratch, verify(pairs), groups, links)
    scratch.settle()
    # of long lists with the same members as far apart, as clusters of copies and passages have them, one is compared
    long = rest.where(F.col("n") > SHORT_LIST).select("key", "id", "place")
    far = long.join(long.groupBy("key").agg(F.min("place").alias("least")).hint("shuffle_hash"), "key").withColumn("far", F.col("place") - F.col("least"))
    marks = far.groupBy("key").agg(F.count("*").alias("n"), F.min("least").alias("least"), F.expr("bit_xor(xxhash64(id, far)) AS x"), F.expr("bit_xor(xxhash64(far, id)) AS y"))
    once = marks.groupBy("n", F.col("least") < 0, "x", "y").agg(F.min("key").alias("key")).select("key")
    rest = _unsettled(long.join(once, "key"), groups, "key")
    rest = scratch.write(rest.select(F.col("key").alias("hub"), "id", "component", "place"))
    if rest.isEmpty():
        return groups
    return _extend(scratch, _blocks(scratch, rest, payload, links_within), groups, links)[0]


def _blocks(scratch: Scratch, rest: DataFrame, payload, links_within) -> DataFrame:
    """Links between groups within each gathering (hub, id, component, perhaps place), block by block."""
    placed_too = "place" in rest.columns
    by_group = rest.groupBy("hub", "component").agg(F.count("*").alias("n"))
    shape = by_group.groupBy("hub").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.sum("n").alias("all"), F.max("n").alias("most"))
    shape = shape.select("hub", "main", F.ceil((F.col("all") - F.col("most")) / SEEKERS).alias("rows"), F.ceil(F.col("all") / SOUGHT).alias("cols"))
    row, col = F.pmod(F.xxhash64("id"), F.col("rows")), F.pmod(F.xxhash64("id", F.lit(1)), F.col("cols"))
    # a member gets its payload once, then its places in blocks: as a seeker one in each column, as one sought one in each row
    loaded = rest.join(payload(rest.select("id").distinct()), "id").join(shape, "hub")
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    seek = F.transform(F.when(F.col("component") != F.col("main"), upto(F.col("cols"))).otherwise(F.array().cast("array<long>")), lambda c: F.struct(F.lit(True).alias("seeks"), row.cast("long").alias("row"), c.alias("col")))
    sought = F.transform(upto(F.col("rows")), lambda r: F.struct(F.lit(False).alias("seeks"), r.alias("row"), col.cast("long").alias("col")))
    buckets = max(1, -(-rest.count() // TOGETHER))
    small = (F.col("rows") == 1) & (F.col("cols") == 1)
    block = F.when(small, F.pmod(F.xxhash64("hub", F.lit(2)), F.lit(buckets))).otherwise(F.col("hub"))
    # a gathering of one block has its members there once, whether they seek, are sought or both
    alone = F.array(F.struct(F.lit(None).cast("boolean").alias("seeks"), F.lit(0).cast("long").alias("row"), F.lit(0).cast("long").alias("col")))
    placed = loaded.withColumn("at", F.explode(F.when(small, alone).otherwise(F.concat(seek, sought)))).select(small.alias("small"), block.alias("block"), "at.row", "at.col", "hub", "id", "component", (F.col("component") != F.col("main")).alias("open"), "at.seeks", *(["place"] if placed_too else []), "payload")

    def compare(block: pa.Table) -> pa.Table:
        sides = [np.asarray(block[c]) for c in ("id", "component", "hub", "open")]
        if placed_too:
            sides.append(np.asarray(block["place"]))
        seeks = np.asarray(block["seeks"].fill_null(False))
        loads_ = block["payload"].to_pylist()
        both = np.asarray(block["seeks"].is_null())
        one, other = np.flatnonzero(seeks | (both & sides[3])), np.flatnonzero(~seeks)
        ids = sides[0]
        found = [(ids[one[i]], ids[other[j]]) for i, j in links_within([loads_[i] for i in one], [loads_[j] for j in other], Side(*(x[one] for x in sides)), Side(*(x[other] for x in sides)))]
        kernels.give_back()
        return pa.table({"a": pa.array([min(p) for p in found], pa.int64()), "b": pa.array([max(p) for p in found], pa.int64())})

    # blocks are few bytes and much work, so they are dealt to all tasks, whatever their bytes
    parts = int(scratch.spark.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartition(parts, "small", "block", "row", "col").groupBy("small", "block", "row", "col").applyInArrow(compare, "a long, b long")


def _extend(scratch: Scratch, found: DataFrame, groups: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    more = scratch.write(found)
    if more.isEmpty():
        return groups, links
    links = scratch.write(links.union(more))
    return scratch.write(connected_components(scratch, links)), links


def _star(lists: DataFrame) -> DataFrame:
    """Each list's member of least id with every other of another group."""
    hub = lists.groupBy("key").agg(F.min(F.struct("id", "component")).alias("h")).select("key", F.col("h.id").alias("hub"), F.col("h.component").alias("c"))
    return lists.join(hub, "key").where("id <> hub and component <> c").select(F.col("hub").alias("a"), F.col("id").alias("b"))


def _across(lists: DataFrame) -> DataFrame:
    """Pairs of members of one list that lie in different groups."""
    left = lists.select("key", F.col("id").alias("a"), F.col("component").alias("ca"))
    right = lists.select("key", F.col("id").alias("b"), F.col("component").alias("cb"))
    return left.join(right, "key").where("a < b and ca <> cb").select("a", "b")


def _unsettled(members: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """Members of lists that lie in two groups or more, with their groups and how many they are (n)."""
    named = members.join(groups, "id", "left").withColumn("component", F.coalesce("component", "id"))
    open_lists = named.groupBy(key).agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n")).where("lo <> hi").select(key, "n")
    return named.join(open_lists.hint("shuffle_hash"), key)
