import random

from reviewloom.operators.graph import connected_components


def brute(edges):
    label = {n: n for e in edges for n in e}
    moved = True
    while moved:
        moved = False
        for a, b in edges:
            least = min(label[a], label[b])
            moved |= label[a] != least or label[b] != least
            label[a] = label[b] = least
    return label


def test_components_match_brute_force(spark):
    random.seed(4)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(160)]
    edges = [e for e in edges if e[0] != e[1]] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, 6000 + i) for i in range(50)]
    df = spark.createDataFrame(edges + edges[:20] + [(b, a) for a, b in edges[:20]] + [(None, 1), (7, 7)], "src int, dst int")
    assert {r["node"]: r["component"] for r in connected_components(df).collect()} == brute(edges)


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "src string, dst string")).count() == 0
