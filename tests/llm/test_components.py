"""Components of graphs that fit a task, and of larger ones."""

import random

import pytest

from tests.llm.test_shingles import roots
from veilspark.llm.components import components

N = 900


def graph():
    draw = random.Random(5)
    edges = [(k, k + 1) for k in range(200)] + [(300, k) for k in range(301, 420)]  # a long path, a hub
    edges += [(draw.randrange(420, N), draw.randrange(420, N)) for _ in range(260)]
    edges += [(b, a) for a, b in edges[::7]] + [(N - 1, N - 1)]  # either way, repeated; a loop
    draw.shuffle(edges)
    return edges


@pytest.mark.parametrize("task_edges", [1, 40, 400, 200_000])
def test_any_number_of_tasks_gives_the_components(spark, task_edges):
    edges = graph()
    want = dict(enumerate(roots(N, edges)))
    on = {x for a, b in edges if a != b for x in (a, b)}
    rows = components(spark.createDataFrame([(a - 450, b - 450) for a, b in edges], "a long, b long").repartition(6), task_edges).collect()
    assert {r.node + 450: r.root + 450 for r in rows} == {x: want[x] for x in on} and len(rows) == len(on)


def test_a_small_graph_takes_few_shuffles(spark):
    number = lambda: spark.sparkContext._jsc.sc().newShuffleId()
    df = spark.createDataFrame(graph(), "a long, b long")
    first = number()
    components(df).collect()
    assert number() - first <= 6
