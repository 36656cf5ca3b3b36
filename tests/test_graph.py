"""Graph algorithms against brute force on random graphs, and closed forms."""

import heapq
import itertools
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from spandrel import procedures
from spandrel.graph import analytics, dml, paths, traverse
from spandrel.graph.components import connected_components
from spandrel.graph.model import PropertyGraph


def make(spark, edges, n):
    nodes = spark.createDataFrame([(i, ["Node"], float(i)) for i in range(n)], "id long, labels array<string>, x double")
    rows = [(i, a, b, "E", float(w)) for i, (a, b, w) in enumerate(edges)]
    return PropertyGraph(nodes, spark.createDataFrame(rows, "id long, src long, dst long, edge_type string, weight double"))


@pytest.fixture(scope="module")
def sample(spark):
    rng = random.Random(4)
    n = 14
    edges = [(a, b, rng.randint(1, 9)) for a in range(n - 2) for b in range(n - 2) if a != b and rng.random() < 0.16]
    return make(spark, edges, n), edges, n


def out(edges):
    near = {}
    for a, b, w in edges:
        near.setdefault(a, []).append((b, w))
    return near


def depths_from(near, start):
    seen, todo = {start: 0}, deque([start])
    while todo:
        a = todo.popleft()
        for b, _ in near.get(a, ()):
            if b not in seen:
                seen[b] = seen[a] + 1
                todo.append(b)
    return seen


def test_reach_is_least_depth(sample):
    g, edges, n = sample
    found = {(r.source, r.node): r.depth for r in traverse.reach(g, g.nodes, 0).collect()}
    assert found == {(s, v): d for s in range(n) for v, d in depths_from(out(edges), s).items()}


def test_sssp_and_paths(sample):
    g, edges, _ = sample
    near, best, todo = out(edges), {0: 0.0}, [(0.0, 0)]
    while todo:
        d, a = heapq.heappop(todo)
        for b, w in near.get(a, ()):
            if d + w < best.get(b, 1e9):
                best[b] = d + w
                heapq.heappush(todo, (d + w, b))
    rows = paths.sssp(g, 0).collect()
    assert {r.node: r.distance for r in rows} == best
    cost = {(a, b): w for a, b, w in edges}
    for r in rows:
        assert sum(cost[p] for p in zip(r.path, r.path[1:])) == r.distance
    at = {r.node: r for r in rows}
    far = sorted(best, key=best.get)
    for target in (0, far[len(far) // 2], far[-1]):
        assert [(r.path, r.total_cost) for r in paths.dijkstra(g, 0, target).collect()] == [(at[target].path, best[target])]
    assert paths.dijkstra(g, 0, 13).count() == 0


def test_equal_distances_take_fewer_edges_then_lesser_ids(spark):
    g = make(spark, [(0, 5, 1), (5, 9, 1), (0, 3, 1), (3, 9, 1), (0, 1, 0), (1, 2, 1), (2, 9, 1), (9, 8, 0)], 10)
    at = {r.node: (r.distance, r.path) for r in paths.sssp(g, 0).collect()}
    assert at[9] == (2.0, [0, 3, 9]) and at[8] == (2.0, [0, 3, 9, 8])
    assert [(r.total_cost, r.path) for r in paths.astar(g, 0, 8).collect()] == [(2.0, [0, 3, 9, 8])]


def test_negative_weight_is_refused(spark):
    with pytest.raises(ValueError):
        paths.sssp(make(spark, [(0, 1, -1)], 2), 0)


def test_all_shortest_paths(sample):
    g, edges, n = sample
    depth = depths_from(out(edges), 0)
    target = max(depth, key=lambda v: (depth[v], v))
    near = out(edges)
    want = set()

    def walk(path):
        if len(path) - 1 == depth[target]:
            if path[-1] == target:
                want.add(tuple(path))
            return
        for b, _ in near.get(path[-1], ()):
            walk([*path, b])

    walk([0])
    assert {tuple(r.nodes) for r in paths.all_shortest_paths(g, 0, target).collect()} == want
    assert paths.all_shortest_paths(g, 0, n - 1).count() == 0


def every_shortest(edges, n):
    """{(source, target): set of node lists} of all shortest paths, by breadth-first extension of whole paths."""
    near, found = out(edges), {}
    for s in range(n):
        depth, front = {s: 0}, [(s,)]
        while front:
            for p in front:
                found.setdefault((s, p[-1]), set()).add(p)
            k = len(front[0])
            front = [(*p, b) for p in front for b, _ in near.get(p[-1], ()) if depth.setdefault(b, k) == k]
    return found


def test_paths_between_many_ends(spark, sample):
    g, edges, n = sample
    want = every_shortest(edges, n)
    got = {}
    for r in paths.paths_between(g, g.nodes.selectExpr("id as source"), g.nodes.selectExpr("id as target")).collect():
        got.setdefault((r.source, r.target), set()).add(tuple(r.nodes))
        assert r.length == len(r.nodes) - 1 == len(r.edges)
    assert got == want
    pairs = [(0, 5), (0, 5), (0, n - 1), (3, 7), (3, 3), (None, 2), (4, None)]
    ends = spark.createDataFrame(pairs, "source long, target long")
    one = [(r.source, r.target, tuple(r.nodes)) for r in paths.paths_between(g, ends.select("source"), ends, every=False).collect()]
    assert sorted(one) == sorted((*p, min(want[p])) for p in {(0, 5), (0, n - 1), (3, 7), (3, 3)} if p in want)
    assert paths.paths_between(g, ends.select("source"), ends.where("false")).count() == 0


def test_components(sample, spark):
    g, edges, n = sample
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b, _ in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    assert {r.id: r.component for r in analytics.connected_components(g).collect()} == {i: root(i) for i in range(n)}
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)], "src long, dst long")
    assert {r.component for r in connected_components(chain).collect()} == {0}
    assert connected_components(chain.limit(0)).count() == 0


def test_strong_components(sample):
    g, edges, n = sample
    near = out(edges)
    reach = {i: set(depths_from(near, i)) for i in range(n)}
    want = {frozenset(j for j in range(n) if j in reach[i] and i in reach[j]) for i in range(n)}
    groups = {}
    for r in analytics.strongly_connected_components(g).collect():
        groups.setdefault(r.component, set()).add(r.id)
    assert {frozenset(v) for v in groups.values()} == want


def test_betweenness(sample):
    g, edges, n = sample
    both = {}
    for a, b, _ in edges:
        both.setdefault(a, set()).add(b)
        both.setdefault(b, set()).add(a)
    score = dict.fromkeys(range(n), 0.0)
    for s, e in itertools.combinations(range(n), 2):
        todo, found, seen = [[s]], [], {s: 0}
        while todo and not found:
            following = []
            for p in todo:
                for b in both.get(p[-1], ()):
                    if seen.get(b, len(p)) >= len(p):
                        seen[b] = len(p)
                        following.append([*p, b])
            found = [p for p in following if p[-1] == e]
            todo = following
        for p in found:
            for v in p[1:-1]:
                score[v] += 1 / len(found)
    rows = analytics.betweenness_centrality(g).collect()
    for r in rows:
        assert r.score == pytest.approx(score[r.id] * 2 / ((n - 1) * (n - 2)))


def test_pagerank_sums_to_one_and_star_centre_wins(spark):
    g = make(spark, [(i, 0, 1) for i in range(1, 8)], 8)
    rows = {r.id: r.score for r in analytics.pagerank(g).collect()}
    assert sum(rows.values()) == pytest.approx(1.0)
    assert max(rows, key=rows.get) == 0


def test_complete_graph_triangles(spark):
    g = make(spark, [(a, b, 1) for a in range(5) for b in range(a)], 5)
    assert {r.triangles for r in analytics.triangles(g).collect()} == {6}
    assert {r.coefficient for r in analytics.clustering_coefficients(g).collect()} == {1.0}


def test_louvain_and_labels_separate_cliques(spark):
    edges = [(a, b, 1) for base in (0, 5) for a in range(base, base + 5) for b in range(base, a)] + [(4, 5, 1)]
    g = make(spark, edges, 10)
    found = analytics.louvain(g)
    groups = {}
    for r in found.collect():
        groups.setdefault(r.community, set()).add(r.id)
    assert sorted(map(sorted, groups.values())) == [[0, 1, 2, 3, 4], [5, 6, 7, 8, 9]]
    assert analytics.modularity(g, found) > 0.4
    labels = {r.id: r.community for r in analytics.label_propagation(g).collect()}
    assert len({labels[i] for i in range(4)}) == 1


def test_delete_needs_detach(spark):
    g = make(spark, [(0, 1, 1)], 3)
    with pytest.raises(dml.HasEdges):
        dml.delete_nodes(g, F.col("id") == 0)
    left = dml.delete_nodes(g, F.col("id") == 0, detach=True)
    assert left.nodes.count() == 2 and left.edges.count() == 0


def test_procedures(sample, spark):
    g, _, n = sample
    assert procedures.call("algo.pagerank", g, 0.5, 3).columns == ["nodeId", "score"]
    with pytest.raises(LookupError):
        procedures.call("algo.none", g)
    assert procedures.show_procedures(spark).count() == len(procedures.PROCEDURES) == 21


def test_depth_first_differs_from_breadth_first(spark):
    from spandrel.graph import traverse
    from spandrel.graph.model import PropertyGraph

    g = PropertyGraph.from_edges(spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 1), (1, 4)], "src long, dst long"))
    assert [(r.node, r.depth, r.path) for r in traverse.dfs(g, 1).orderBy("place").collect()] == [(1, 0, [1]), (2, 1, [1, 2]), (3, 2, [1, 2, 3]), (4, 1, [1, 4])]
    assert {r.node: r.depth for r in traverse.bfs(g, 1).collect()} == {1: 0, 2: 1, 3: 1, 4: 1}
    assert [r.node for r in traverse.dfs(g, 1, max_depth=0).collect()] == [1]


def test_depth_first_equals_recursion(spark):
    import random

    from spandrel.graph import traverse
    from spandrel.graph.model import PropertyGraph

    rng = random.Random(3)
    edges = sorted({(rng.randrange(40), rng.randrange(40)) for _ in range(90)})
    seen, order = set(), []

    def visit(node, depth):
        seen.add(node)
        order.append((node, depth))
        for a, b in edges:
            if a == node and b not in seen:
                visit(b, depth + 1)

    start = edges[0][0]
    visit(start, 0)
    g = PropertyGraph.from_edges(spark.createDataFrame(edges, "src long, dst long"))
    assert [(r.node, r.depth) for r in traverse.dfs(g, start).orderBy("place").collect()] == order


def test_distinct_nodes_or_edges_of_a_pattern(spark):
    from spandrel.graph import pattern
    from spandrel.graph.model import PropertyGraph
    from spandrel.graph.pattern import Hop, Node

    g = PropertyGraph.from_edges(spark.createDataFrame([(1, 2), (3, 2)], "src long, dst long"))
    chain = [Node("a"), Hop(), Node("b"), Hop(direction="in"), Node("c")]
    assert pattern.match(g, chain).count() == 4
    assert {(r.a, r.c) for r in pattern.match(g, chain, distinct="edges").collect()} == {(1, 3), (3, 1)}
    assert {(r.a, r.c) for r in pattern.match(g, chain, distinct="nodes").collect()} == {(1, 3), (3, 1)}


@pytest.mark.parametrize("measure", ["jaccard", "cosine", "overlap"])
def test_node_similarity_with_a_cutoff_loses_no_pair(spark, measure):
    rng = random.Random(3)
    edges = [(a, 100 + b, 1) for a in range(30) for b in {0, *rng.sample(range(1, 7), rng.randint(1, 5))}]
    near = {a: {b for x, b, _ in edges if x == a} for a in range(30)}
    bottom = {"jaccard": lambda x, y: len(x | y), "cosine": lambda x, y: (len(x) * len(y)) ** 0.5, "overlap": lambda x, y: min(len(x), len(y))}[measure]
    want = {(a, b): len(near[a] & near[b]) / bottom(near[a], near[b]) for a in range(30) for b in range(a + 1, 30)}
    g = make(spark, edges, 107)
    for cutoff in (0.5, 2 / 3, 1.0):
        found = {(r.node1, r.node2): r.similarity for r in analytics.node_similarity(g, measure, cutoff=cutoff).collect()}
        assert found == pytest.approx({p: v for p, v in want.items() if v >= cutoff})
