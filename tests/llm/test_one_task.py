"""Components by one task and by star steps are the same; workers forget what other operators keep."""

import random

from palimpsest.llm import byte_bpe, components, kernels
from palimpsest.llm.queries import vocabulary
from palimpsest.llm.spark_io import Scratch


def test_components_by_one_task_equal_those_by_stars(spark, monkeypatch):
    rng = random.Random(61)
    edges = [(rng.randrange(-300, 300), rng.randrange(-300, 300)) for _ in range(250)]
    edges += [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2000 + i) for i in range(40)] + [(7, 7), (1000, 1001)]
    rng.shuffle(edges)
    df = spark.createDataFrame(edges, "a long, b long")
    found = []
    for most in (10_000, 0):
        monkeypatch.setattr(components, "ONE_TASK", most)
        found.append(sorted(tuple(r) for r in components.connected_components(Scratch(spark, "components"), df).collect()))
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((top(a), top(b)))
            parent[y] = x
    assert found[0] == found[1] == sorted((x, top(x)) for x in parent)
    monkeypatch.setattr(components, "ONE_TASK", 10_000)
    assert components.connected_components(Scratch(spark, "components"), df.limit(0)).count() == 0


def test_tasks_of_one_operator_make_a_worker_forget_another():
    byte_bpe.encoder(vocabulary("byte_bpe_50k.tiktoken"))

    def run(batches):
        yield from batches

    run.__module__ = byte_bpe.__name__
    assert list(kernels.tidy(run)(iter([1]))) == [1] and byte_bpe.encoder.cache_info().currsize == 1
    run.__module__ = "palimpsest.llm.line_dedup"
    assert list(kernels.tidy(run)(iter([1]))) == [1] and byte_bpe.encoder.cache_info().currsize == 0
