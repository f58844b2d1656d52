"""Contiguous growth and far sites against plain scans."""

import math
import random



def km(a, b):
    la1, lo1, la2, lo2 = map(math.radians, (*a, *b))
    h = math.sin((la2 - la1) / 2) ** 2 + math.cos(la1) * math.cos(la2) * math.sin((lo2 - lo1) / 2) ** 2
    return 2 * 6371.0088 * math.asin(math.sqrt(min(1.0, h)))


def test_growth(spark):
    """All standing offers are looked at in every step, in place of a queue."""
    from geoterra.operators.solvers import grown

    rng = random.Random(3)
    place = {g: {k: (rng.uniform(-9, 0), rng.uniform(-60, -50)) for k in range(40)} for g in "ab"}
    load = {k: float(rng.randint(0, 30)) for k in range(40)}
    near = {g: {k: [j for j in range(40) if j != k and km(place[g][k], place[g][j]) < 250] for k in range(40)} for g in "ab"}
    seats, want = {"a": [3, 17, 20], "b": [5]}, {}
    for g in "ab":
        share = sum(load.values()) / len(seats[g])
        owner, carried, offers = {s: s for s in seats[g]}, {s: load[s] for s in seats[g]}, []
        offer = lambda u, s: [(km(place[g][j], place[g][s]) + 120 * max((carried[s] + load[j]) / share - 1, 0), j, s) for j in near[g][u] if j not in owner]  # noqa: B023, E731
        for s in seats[g]:
            offers += offer(s, s)
        while offers := [o for o in offers if o[1] not in owner]:
            _, unit, seat = min(offers)
            owner[unit] = seat
            carried[seat] += load[unit]
            offers += offer(unit, seat)
        want |= {(g, k): owner.get(k) for k in range(40)}
    units = spark.createDataFrame([(g, k, k in seats[g], load[k], *place[g][k]) for g in "ab" for k in range(40)], "state string, unit_id long, seat boolean, load double, lat double, lon double")
    edges = spark.createDataFrame([(g, k, j, 1.0) for g in "ab" for k in range(40) for j in near[g][k]], "state string, src long, dst long, km double")
    assert {(r.state, r.unit_id): r.pole_unit for r in grown(units, edges, "state").collect()} == want


def test_far_sites(spark):
    from geoterra.operators.solvers import greedy_sites

    rng = random.Random(9)
    rows = [(("a", "b", None)[k % 3], k, rng.choice([0.5, 1.0, rng.random()]), float(k % 4), rng.uniform(-30, 0), rng.uniform(-60, -40)) for k in range(60)] + [("tiny", 100, 1.0, 1.0, 0.0, 0.0), ("a", 200, None, None, -1.0, -50.0), ("a", 201, 1.0, 1.0, None, 0.0)]
    units = spark.createDataFrame(rows, "g string, unit_id long, relevance double, population double, lat double, lon double")
    for seeds in (None, [0, 3, 7]):
        want = set()
        for g in {r[0] for r in rows}:
            mine = [(r[1], r[2] or 0.0, r[3] or 0.0, r[4:]) for r in rows if r[0] == g and r[4] is not None]
            got = {r[0]: 0 for r in mine if seeds and r[0] in seeds}
            for step in range(1, 5):
                free = [r for r in mine if r[0] not in got]
                if free:
                    far = lambda r: min((km(r[3], s[3]) for s in mine if s[0] in got), default=1.0)  # noqa: B023, E731
                    got[min(free, key=lambda r: (-round(r[1] * far(r), 9), -r[2], r[0]))[0]] = step
            want |= {(g, k, s) for k, s in got.items()}
        given = None if seeds is None else spark.createDataFrame([(s,) for s in seeds], "unit_id long")
        assert {tuple(r) for r in greedy_sites(units, "g", 4, given).collect()} == want
    assert greedy_sites(units.limit(0), "g", 2).count() == 0


def test_certified_gap(spark):
    """The bound lies under the best of all choices, and that under the value; with and without capacity."""
    import itertools

    import pytest

    from geoterra.operators.siting import certified

    rng, rows, best, assigned = random.Random(4), [], {}, []
    for g in ("a", "b"):
        cost = {(u, c): rng.uniform(1, 30) for u in range(8) for c in range(5)}
        load = {u: rng.choice([1.0, 2.0, 3.0]) for u in range(8)}
        rows += [(g, u, c, cost[u, c], 2.0, load[u]) for u, c in cost]
        for cap in (None, 0.6 * sum(load.values())):
            options = [(sum(2 * cost[u, c] for u, c in enumerate(way)), way) for two in itertools.combinations(range(5), 2) for way in itertools.product(two, repeat=8) if cap is None or all(sum(load[u] for u in range(8) if way[u] == c) <= cap for c in two)]
            best[g, cap is None] = min(options)[0]
            if cap:
                assigned += [(g, u, c) for u, c in enumerate(sorted(options)[5][1])]
                limit = cap
        rows += [(g, 0, 9, None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "g string, unit_id long, candidate long, cost double, weight double, load double")
    way = spark.createDataFrame(assigned, "g string, unit_id long, candidate long")
    for cap in (None, limit):
        for r in certified(df.filter("g = 'b'"), "g", 2, way, cap, rounds=8).collect():
            assert r.bound <= best[r.g, cap is None] + 1e-6 and best[r.g, False] <= r.value + 1e-6
            assert r.bound >= 0.6 * best[r.g, cap is None] and r.gap == pytest.approx((r.value - r.bound) / r.value)
    short = certified(df, "g", 2, way.filter("unit_id > 0"), rounds=1).collect()
    assert len(short) == 2 and all(r.value is None and r.gap is None for r in short)


def test_paths_by_frontier(spark):
    """Shortest paths with ties against a plain relaxation of every edge."""
    from geoterra.operators.graph import voronoi

    rng = random.Random(12)
    lengths = {}
    for _ in range(120):
        a, b = rng.sample(range(40), 2)
        lengths[a, b] = lengths[b, a] = float(rng.randint(1, 6))
    roots = [0, 5, 6]
    state = {r: (0.0, r, -1) for r in roots}
    for _ in range(60):
        for (a, b), km_ in lengths.items():
            if a in state and b not in roots:
                state[b] = min(state.get(b, (9e9, 0, 0)), (state[a][0] + km_, state[a][1], a))
    edges = spark.createDataFrame([(a, b, k) for (a, b), k in lengths.items()], "src long, dst long, km double")
    got = voronoi(spark.createDataFrame([(r,) for r in roots], "unit_id long"), edges)
    assert {r.unit_id: (r.km, r.root) for r in got.collect()} == {u: s[:2] for u, s in state.items()}
