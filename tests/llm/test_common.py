import random

from wareloom.llm.common import Scratch, connected_components


def test_components_of_any_graph(spark):
    for seed in range(6):
        r = random.Random(seed)
        n = r.choice([3, 20, 60])
        edges = [(r.randrange(n), r.randrange(n)) for _ in range(r.choice([1, n // 2, n]))]
        edges += [(None, 1), (2, None), (5, 5), *edges[:3]]
        if seed == 0:
            edges = [(k, k + 1) for k in range(40)]  # a chain
        if seed == 1:
            edges = [(0, k) for k in range(1, 30)]  # a star
        parent = {}

        def find(a, parent=parent):
            while parent.setdefault(a, a) != a:
                a = parent[a]
            return a

        for a, b in edges:
            if a is not None and b is not None and a != b:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
        found = connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test")).collect()
        assert len(found) == len({r.id for r in found})
        assert {r.id: r.component for r in found} == {k: find(k) for k in parent}


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "test")).count() == 0
