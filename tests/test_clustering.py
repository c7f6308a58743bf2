import random

from geotide.functions.geo import EARTH_RADIUS_M
from geotide.operators.clustering import density_cluster


def _brute_dbscan(points, eps_m, min_samples):
    import math

    def d(a, b):
        p1, p2 = math.radians(a[0]), math.radians(b[0])
        dp, dl = p2 - p1, math.radians(b[1] - a[1])
        h = math.sin(dp / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(dl / 2) ** 2
        return 2 * EARTH_RADIUS_M * math.asin(math.sqrt(min(h, 1.0)))

    n = len(points)
    nb = [[j for j in range(n) if d(points[i], points[j]) <= eps_m] for i in range(n)]
    core = [len(nb[i]) >= min_samples for i in range(n)]
    comp = list(range(n))

    def find(x):
        while comp[x] != x:
            comp[x] = comp[comp[x]]
            x = comp[x]
        return x
    for i in range(n):
        if core[i]:
            for j in nb[i]:
                if core[j]:
                    comp[find(i)] = find(j)
    groups = {}
    for i in range(n):
        if core[i]:
            groups.setdefault(find(i), set()).add(points[i])
    return sorted(sorted(g) for g in groups.values()), core


def test_two_groups_and_noise(spark):
    pts = [(59.30, 18.00), (59.3001, 18.0001), (59.3002, 18.0), (59.40, 18.2), (59.4001, 18.2001),
           (59.4002, 18.2), (59.9, 18.9)]
    df = spark.createDataFrame([("c", la, lo) for la, lo in pts], "client_id string, lat double, lon double")
    out = density_cluster(df, 100.0, 2).collect()
    labels = {(r["lat"], r["lon"]): r["label"] for r in out}
    assert labels[(59.9, 18.9)] is None
    assert len({labels[p] for p in pts[:6]}) == 2
    out1 = density_cluster(df, 100.0, 1).collect()
    assert len({r["label"] for r in out1}) == 3


def test_core_components_match_brute_force(spark):
    r = random.Random(7)
    pts = list({(round(59.3 + r.random() * 0.02, 5), round(18.0 + r.random() * 0.02, 5)) for _ in range(120)})
    df = spark.createDataFrame([("c", la, lo) for la, lo in pts], "client_id string, lat double, lon double")
    out = density_cluster(df, 250.0, 4).collect()
    groups = {}
    for row in out:
        if row["is_core"]:
            groups.setdefault(row["label"], set()).add((row["lat"], row["lon"]))
    got = sorted(sorted(g) for g in groups.values())
    want, _ = _brute_dbscan(pts, 250.0, 4)
    assert got == want


def _labels(points, eps, min_samples, dist):
    """Plain DBSCAN: label (smallest core point of the cluster) of every distinct point, None for noise."""
    weight = {}
    for p in points:
        weight[p] = weight.get(p, 0) + 1
    pts = sorted(weight)
    nb = {p: [q for q in pts if dist(p, q) <= eps] for p in pts}
    core = {p for p in pts if sum(weight[q] for q in nb[p]) >= min_samples}
    label = {}
    for p in pts:  # in order, so a cluster is named by its smallest core point
        if p in core and p not in label:
            todo = [p]
            while todo:
                q = todo.pop()
                if q not in label:
                    label[q] = p
                    todo += [x for x in nb[q] if x in core and x not in label]
    for p in pts:
        if p not in core:
            label[p] = min((label[q] for q in nb[p] if q in core), default=None)
    return label, core


def test_cells_match_plain_dbscan(spark):
    """Dense and sparse cells, chains across many cells, several clients, high latitudes, negative coordinates, two metrics."""
    import math

    def sphere(a, b):
        p1, p2 = math.radians(a[0]), math.radians(b[0])
        h = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
        return 2 * EARTH_RADIUS_M * math.asin(math.sqrt(min(h, 1.0)))

    def planar(a, b):
        return math.hypot(a[0] - b[0], a[1] - b[1])

    r = random.Random(3)
    clients = {}
    for name, (lat, lon, spread) in {"a": (59.3, 18.0, 0.02), "b": (-33.1, -70.2, 0.03), "c": (0.0, 0.0, 0.02), "d": (84.0, 179.0, 0.05)}.items():
        pts = [(round(lat + r.uniform(-spread, spread), 4), round(lon + r.uniform(-spread, spread), 4)) for _ in range(150)]
        pts += [(round(lat + spread / 2 + r.gauss(0, 0.0008), 5), round(lon + r.gauss(0, 0.0008), 5)) for _ in range(120)]  # a crowd
        pts += [pts[0]] * 4 + [(round(lat - spread + 0.0015 * k, 5), lon - spread) for k in range(12)]                       # copies, a chain
        clients[name] = pts
    df = spark.createDataFrame([(c, *p) for c, pts in clients.items() for p in pts], "client_id string, lat double, lon double")
    for metric, dist, eps, least in (("sphere", sphere, 180.0, 4), ("sphere", sphere, 400.0, 12), ("planar", planar, 0.0016, 3), ("planar", planar, 0.0016, 1)):
        got = density_cluster(df, eps, least, metric=metric).collect()
        assert len(got) == sum(len(set(p)) for p in clients.values())
        for c, pts in clients.items():
            label, core = _labels(pts, eps, least, dist)
            assert {(x["lat"], x["lon"]): None if x["label"] is None else tuple(x["label"]) for x in got if x["client_id"] == c} == label
            assert {(x["lat"], x["lon"]) for x in got if x["client_id"] == c and x["is_core"]} == core


def test_no_points(spark):
    assert density_cluster(spark.createDataFrame([], "client_id string, lat double, lon double"), 100.0, 2).count() == 0
