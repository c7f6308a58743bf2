import heapq
import random

from geotide.operators.paths import shortest_paths
from geotide.operators.patterns import kmeans_per_client


def _dijkstra(edges, s, t):
    g = {}
    for a, b, w in edges:
        g.setdefault(a, []).append((b, w))
    dist = {s: 0.0}
    pq = [(0.0, s)]
    while pq:
        d, u = heapq.heappop(pq)
        if d > dist.get(u, float("inf")):
            continue
        for v, w in g.get(u, []):
            if d + w < dist.get(v, float("inf")):
                dist[v] = d + w
                heapq.heappush(pq, (d + w, v))
    return dist.get(t)


def test_square_with_heavy_diagonal(spark):
    nodes = spark.createDataFrame([(1, 18.0, 59.3), (2, 18.001, 59.3), (3, 18.001, 59.301), (4, 18.0, 59.301),
                                   (5, 18.0005, 59.3005)], "node_id long, lon double, lat double")
    e = [(1, 2, 1.0), (2, 3, 1.0), (3, 4, 1.0), (4, 1, 1.0), (1, 3, 5.0)]
    e = e + [(b, a, w) for a, b, w in e]
    edges = spark.createDataFrame(e, "src long, dst long, length_m double")
    req = spark.createDataFrame([("r1", 59.3, 18.0, 59.301, 18.001), ("r2", 59.3, 18.0, 59.3005, 18.0005)],
                                "request_id string, origin_lat double, origin_lon double, goal_lat double, "
                                "goal_lon double")
    out = {r["request_id"]: r for r in shortest_paths(req, nodes, edges).collect()}
    assert out["r1"]["length_m"] == 2.0 and len(out["r1"]["path"]) == 3
    assert out["r1"]["path"][0]["lon"] == 18.0 and out["r1"]["path"][-1]["lat"] == 59.301
    assert out["r2"]["length_m"] is None and out["r2"]["path"] == []


def test_random_graph_matches_dijkstra(spark):
    r = random.Random(5)
    n = 30
    nodes = [(i, 18.0 + r.random() * 0.01, 59.3 + r.random() * 0.01) for i in range(n)]
    e = []
    for _ in range(80):
        a, b = r.randrange(n), r.randrange(n)
        if a != b:
            w = round(r.random() * 10 + 1, 3)
            e += [(a, b, w), (b, a, w)]
    ndf = spark.createDataFrame(nodes, "node_id long, lon double, lat double")
    edf = spark.createDataFrame(e, "src long, dst long, length_m double")
    reqs = [(f"q{i}", nodes[a][2], nodes[a][1], nodes[b][2], nodes[b][1], a, b)
            for i, (a, b) in enumerate([(0, 5), (3, 17), (8, 29), (11, 2)])]
    rdf = spark.createDataFrame([q[:5] for q in reqs], "request_id string, origin_lat double, origin_lon double, "
                                                       "goal_lat double, goal_lon double")
    out = {x["request_id"]: x["length_m"] for x in shortest_paths(rdf, ndf, edf, buffer_deg=1.0).collect()}
    for q in reqs:
        want = _dijkstra(e, q[5], q[6])
        got = out[q[0]]
        assert (want is None and got is None) or abs(got - want) < 1e-9


def test_kmeans_invariants(spark):
    r = random.Random(3)
    centres = [(0.0, 0.0), (0.05, 0.05), (0.1, 0.0)]
    pts = [("c", 59.3 + centres[i % 3][0] + r.gauss(0, 0.002), 18.0 + centres[i % 3][1] + r.gauss(0, 0.002))
           for i in range(200)]
    pts += [("small", 59.3, 18.0)] * 2
    df = spark.createDataFrame(pts, "client_id string, lat double, lon double")
    lab = kmeans_per_client(df, k=3).collect()
    assert {x["client_id"] for x in lab} == {"c"}
    assert sum(x["weight"] for x in lab) == 200
    assert {x["cluster"] for x in lab} == {0, 1, 2}
    # three well separated groups are recovered
    groups = {}
    for x in lab:
        groups.setdefault(x["cluster"], []).append((round((x["lat"] - 59.3) / 0.05), round((x["lon"] - 18.0) / 0.05)))
    assert all(len(set(v)) == 1 for v in groups.values())


def test_settled_runs_rest_while_others_move(spark, monkeypatch):
    """Later rounds of k-means take the centres of runs that still move, and the end has all of them."""
    from geotide.operators import patterns
    seen, real = [], patterns._nearest

    def nearest(points, cents):
        seen.append(cents.count())
        return real(points, cents)

    monkeypatch.setattr(patterns, "_nearest", nearest)
    r = random.Random(3)
    rows = [("still", 59.0 + k, 18.0 + k) for k in (0, 0, 1, 1)] + [("moving", 59 + r.random(), 18 + r.random()) for _ in range(80)]
    out = kmeans_per_client(spark.createDataFrame(rows, "client_id string, lat double, lon double"), k=2).collect()
    assert {(x["client_id"], x["cluster"]) for x in out} == {("still", 0), ("still", 1), ("moving", 0), ("moving", 1)}
    assert seen[1] == 40 and min(seen[2:-2]) <= 20  # after the seeding: two clients, ten runs, two centres
    assert seen[-2] == 40
