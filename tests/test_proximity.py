"""Neighbours against brute force, with hot spots and sparse surroundings."""

import math
import random

import pytest

from schedlake.operators import proximity as X

SCHEMA = "ord bigint, city_slug string, district_slug string, village string, lat double, lng double"


def km(a, b):
    la, lo, lb, lp = map(math.radians, (a[4], a[5], b[4], b[5]))
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((lp - lo) / 2) ** 2
    return round(2 * 6371 * math.atan2(math.sqrt(h), math.sqrt(1 - h)), 9)


def valid(p):
    return p[4] is not None and p[5] is not None and 21.5 <= p[4] <= 25.5 and 119.5 <= p[5] <= 122.5


def brute(points, k=5):
    out = {}
    for p in points:
        if valid(p):
            near = sorted((km(p, q), q[0]) for q in points if q[0] != p[0] and q[1:3] == p[1:3] and valid(q))[:k]
            out[p[0]] = [n for _, n in near]
    return out


def collected(df):
    got = {}
    for r in sorted(df.collect(), key=lambda r: (r["ord"], r["rank"])):
        got.setdefault(r["ord"], []).append(r.neighbour)
    return got


def hot_points(seed, n):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        kind = rnd.random()
        if kind < 0.33:  # a third of all rows on one coordinate
            lat, lng = 24.123456, 121.5
        elif kind < 0.6:  # a dense spot of a few metres
            lat, lng = 24.2 + rnd.random() * 1e-4, 121.6 + rnd.random() * 1e-4
        elif kind < 0.9:
            lat, lng = rnd.uniform(21.5, 25.5), rnd.uniform(119.5, 122.5)
        else:
            lat, lng = rnd.choice([(None, None), (10.0, 121.0), (25.5, 122.5), (21.5, 119.5)])
        out.append((i + 1, "c", f"d{i % 2 if i % 7 else 2}", f"v{i % 3}" if i % 5 else None, lat, lng))
    # a block with fewer points than neighbours asked for, and a lonely one
    out += [(n + 1, "c", "few", None, 24.0, 121.0), (n + 2, "c", "few", None, 24.5, 121.0), (n + 3, "c", "few", "v", 22.0, 120.0), (n + 4, "c", "lonely", None, 24.0, 121.0)]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_knn_geo_is_exact(spark, seed):
    points = hot_points(seed, 400)
    want = {k: v for k, v in brute(points).items() if v}
    assert collected(X.knn_geo(spark.createDataFrame(points, SCHEMA))) == want


def test_spots_denser_than_a_metre(spark):
    """Distinct points within half a metre and within a micrometre: the grid goes as deep as they need."""
    rnd = random.Random(9)
    points = [(i, "c", "d", None, 24.0 + rnd.random() * 5e-6, 121.0 + rnd.random() * 5e-6) for i in range(300)]
    points += [(1000 + i, "c", "d", None, 23.0 + rnd.random() * 1e-11, 120.0 + rnd.random() * 1e-11) for i in range(120)]
    points += [(2000 + i, "c", "d", None, rnd.uniform(22, 25), rnd.uniform(120, 122)) for i in range(50)]
    got = collected(X.knn_geo(spark.createDataFrame(points, SCHEMA)))
    assert got == brute(points)


def test_fallback_prefers_the_village(spark):
    points = hot_points(3, 150)
    got = collected(X.knn_fallback(spark.createDataFrame(points, SCHEMA)))
    for p in points:
        if not valid(p):
            others = [q for q in points if q[0] != p[0] and q[1:3] == p[1:3]]
            same = [q[0] for q in others if p[3] and q[3] == p[3]]
            rest = [q[0] for q in others if not (p[3] and q[3] == p[3])]
            assert got.get(p[0], []) == (same + rest)[:5]


def test_candidates_are_exact(spark):
    points = hot_points(4, 150)
    got = collected(X.knn_candidates(spark.createDataFrame(points, SCHEMA), enough=12))
    for p in points:
        others = [q for q in points if q[0] != p[0] and q[1:3] == p[1:3]]
        near = [q for q in others if p[3] and q[3] == p[3]]
        cand = near if p[3] and len(near) >= 12 else others
        if valid(p):
            want = [q for _, q in sorted((km(p, q), q[0]) for q in cand if valid(q))]
        else:
            want = [q[0] for q in cand if p[3] and q[3] == p[3]] + [q[0] for q in cand if not (p[3] and q[3] == p[3])]
        assert got.get(p[0], []) == want[:5]


def test_heading(spark):
    points = [(1, "c", "d", "v", 24.0, 121.0), (2, "c", "d", "v", None, None), (3, "c", "d", "w", None, None), (4, "c", "e", "x", None, None), (5, "c", "e", None, None, None)]
    got = {r["ord"]: r.heading for r in X.neighbour_heading(spark.createDataFrame(points, SCHEMA)).collect()}
    assert got == {1: "鄰近清運點", 2: "同行政區的清運點", 3: "同行政區的清運點", 4: "同行政區的清運點", 5: "同行政區的清運點"}


def compared(spark, n):
    """Rows that the comparison of ``n`` points in a dense spot and 20 lone ones far away reads, without collapsing any."""
    rnd = random.Random(n)
    rows = [("c", "d", 24.0 + rnd.random() * 1e-3, 121.0 + rnd.random() * 1e-3, 1) for _ in range(n)]
    rows += [("c", "d", 22.0 + i * 0.07, 120.0 + (i * i % 17) * 0.1, 1) for i in range(20)]
    sites = spark.createDataFrame(rows, "city_slug string, district_slug string, lat double, lng double, n int")
    reached, placed = X.cells_in_reach(sites, X.BLOCK, 6)
    sizes = placed.groupBy("city_slug", "district_slug", "level", "cy", "cx").count()
    met = reached.join(sizes, ["city_slug", "district_slug", "level", "cy", "cx"]).groupBy((reached.lat < 23.9).alias("lone")).sum("count")
    return {r.lone: r["sum(count)"] for r in met.collect()}


def test_comparisons_grow_with_the_points(spark):
    """Cells divide by 16, so how full they are repeats every 16 times as many points: the rows per point stay the same then, and
    are bounded in between. A lone site meets the near edge of the spot, not the spot."""
    sizes = [1000, 4000, 16000]
    met = [compared(spark, n) for n in sizes]
    assert all(m[False] < 300 * n for n, m in zip(sizes, met))
    assert met[2][False] < 16 * 1.6 * met[0][False]
    assert all(m[True] < 20 * 0.2 * n for n, m in zip(sizes, met)) and met[2][True] < 8 * met[0][True], met
