"""Connected components loop against a union-find."""

import random

from densitykit.operators.components import connected_components


def uf_labels(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    comp = {}
    for n in nodes:
        comp.setdefault(find(n), []).append(n)
    return {n: min(c) for c in comp.values() for n in c}


def run(spark, nodes, edges):
    v = spark.createDataFrame([(n,) for n in nodes], "node BIGINT")
    e = spark.createDataFrame(edges, "src BIGINT, dst BIGINT")
    res = connected_components(v, e)
    return {r["node"]: r["label"] for r in res.labels.collect()}, res.rounds


def test_long_path_converges_fast(spark):
    n = 2000
    order = list(range(n))
    random.Random(1).shuffle(order)
    edges = [(order[i], order[i + 1]) for i in range(n - 1)]
    labels, rounds = run(spark, range(n), edges)
    assert set(labels.values()) == {0}
    assert rounds <= 12


def test_monotone_path_and_isolated(spark):
    edges = [(i, i + 1) for i in range(500)]
    labels, _ = run(spark, list(range(501)) + [1000, 1001], edges)
    assert labels[500] == 0 and labels[1000] == 1000 and labels[1001] == 1001


def test_random_graph(spark):
    rnd = random.Random(2)
    nodes = list(range(300))
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(250)]
    labels, _ = run(spark, nodes, edges)
    assert labels == uf_labels(nodes, edges)
