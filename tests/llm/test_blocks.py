"""Blocks of gatherings: every pair of two groups meets, once."""

from itertools import combinations

from pyspark.sql import functions as F

from palimpsest.llm import components
from palimpsest.llm.spark_io import Scratch


def test_every_pair_of_two_groups_meets_once(spark, monkeypatch):
    meets = components.meets
    monkeypatch.setattr(components, "SEEKERS", 8)
    monkeypatch.setattr(components, "SOUGHT", 16)
    monkeypatch.setattr(components, "TOGETHER", 32)
    def all_that_meet(seekers, sought, side, other):
        for i in range(len(seekers)):
            for j in meets(side, i, other).nonzero()[0]:
                assert seekers[i] != sought[j]
                yield i, j

    shapes = {1: [30, 9, 1, 1, 1, 40], 2: [1] * 50, 3: [2, 3], 4: [1, 1, 1], 5: [4, 1]}  # sizes of the groups of each gathering
    rows, wanted, at = [], [], 0
    for hub, sizes in shapes.items():
        members = [(hub, at + k, at + sum(sizes[:g])) for g, n in enumerate(sizes) for k in range(sum(sizes[:g]), sum(sizes[:g]) + n)]
        wanted += [(a[1], b[1]) for a, b in combinations(members, 2) if a[2] != b[2]]
        rows += members
        at += sum(sizes)
    scratch = Scratch(spark, "blocks")
    rest = scratch.write(spark.createDataFrame(rows, "hub long, id long, component long"))
    asked = []

    def payload(ids):
        loads = ids.withColumn("payload", F.col("id").cast("string").cast("binary"))
        asked.append(loads.count())
        return loads

    met = components._blocks(scratch, rest, payload, all_that_meet).collect()
    assert sorted((r.a, r.b) for r in met) == sorted(wanted)
    assert asked == [len(rows)]
