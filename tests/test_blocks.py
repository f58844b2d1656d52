"""Cut units, the enforced metropolitan minimum and anchored seeds, against brute force and cases worked by hand."""

import random

from geoterra.operators import blocks, graph, minimum


def parts(units, near):
    left, n = set(units), 0
    while left:
        front, n = [left.pop()], n + 1
        while front:
            more = [v for u in front for v in near.get(u, ()) if v in left]
            left -= set(more)
            front = list(set(more))
    return n


def both(pairs):
    return [(a, b) for a, b in pairs] + [(b, a) for a, b in pairs]


def around(pairs):
    near = {}
    for a, b in both(pairs):
        near.setdefault(a, set()).add(b)
    return near


def test_cut_points_against_removal_of_every_unit(spark):
    """Thirty random graphs side by side, sparse ones to dense ones, with trees, rings, lone units, loops and repeated edges."""
    rng, units, pairs = random.Random(5), [], []
    for g in range(30):
        n = rng.randint(1, 14)
        units += [g * 100 + i for i in range(n)]
        pairs += [(g * 100 + rng.randrange(n), g * 100 + rng.randrange(n)) for _ in range(rng.randint(0, 2 * n))]
    near = around([p for p in pairs if p[0] != p[1]])
    whole = parts(units, near)
    lone = {u for u in units if not near.get(u)}
    want = {u for u in units if u not in lone and parts([v for v in units if v != u], near) > whole}
    nodes = spark.createDataFrame([(u,) for u in [*units, units[0], None]], "unit_id long")
    edges = spark.createDataFrame(both(pairs) + [(units[0], 10**6)], "src long, dst long")
    assert {r.unit_id for r in blocks.cut_points(nodes, edges).collect()} == want
    assert len(want) > 20


def test_blocks_of_two_rings_that_share_a_unit_and_a_tail(spark):
    pairs = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 3), (5, 6)]
    nodes = spark.createDataFrame([(i,) for i in range(1, 8)], "unit_id long")
    found = blocks.blocks(nodes, spark.createDataFrame(both(pairs), "src long, dst long")).collect()
    of = {}
    for r in found:
        of.setdefault(r.block, set()).update({r.unit_id, r.parent})
    assert sorted(map(sorted, of.values())) == [[1, 2, 3], [3, 4, 5], [5, 6]]


def test_cut_units_of_nothing_and_of_unserved_units(spark):
    edges = spark.createDataFrame(both([(1, 2), (2, 3)]), "src long, dst long")
    assert graph.cut_units(spark.createDataFrame([], "unit_id long, pole_id string"), edges).collect() == []
    assert graph.cut_units(spark.createDataFrame([(1, None), (2, None), (3, None)], "unit_id long, pole_id string"), edges).collect() == []
    assert [tuple(r) for r in graph.cut_units(spark.createDataFrame([(1, "a"), (2, "a"), (3, "a")], "unit_id long, pole_id string"), edges).collect()] == [("a", 2)]


def in_turn(units, poles, cost, near, wanted, most):
    """The rule as a plain scan, city by city and pole by pole."""
    owner, moves, lack = {u: row["pole"] for u, row in units.items()}, [], []
    for city in sorted({c for c in poles.values() if c}):
        theirs, members = sorted(p for p, c in poles.items() if c == city), [u for u, row in units.items() if row["city"] == city]
        if not members:
            continue
        least = min(wanted, max(len(members) // len(theirs), 1))
        has = lambda p: sum(owner[u] == p for u in members)  # noqa: B023, E731
        for to in theirs:
            while has(to) < least:
                options = []
                for u in members:
                    mine = owner[u]
                    if mine is None or mine == to or units[u]["fixed"] or (mine in theirs and has(mine) <= least):
                        continue
                    rest = [v for v in owner if owner[v] == mine and v != u]
                    if not any(owner[v] == to for v in near.get(u, ())) or parts(rest, near) > 1 or (u, to) not in cost:
                        continue
                    if sum(units[v]["load"] for v in owner if owner[v] == to) + units[u]["load"] <= most:
                        options.append(((cost[u, to] - cost.get((u, mine), 0.0)) * units[u]["weight"], u, mine))
                if not options:
                    lack.append((city, to))
                    break
                _, u, mine = min(options)
                owner[u] = to
                moves.append((city, u, mine, to))
    return owner, moves, lack


def enforce(spark, units, poles, cost, near, wanted, most):
    u = spark.createDataFrame([(k, r["city"], r["pole"], r["load"], r["weight"], r["fixed"]) for k, r in units.items()], "unit_id long, city string, pole_id string, load double, weight double, fixed boolean")
    p = spark.createDataFrame(list(poles.items()), "pole_id string, city string")
    c = spark.createDataFrame([(*k, v) for k, v in cost.items()], "unit_id long, pole_id string, cost double")
    e = spark.createDataFrame([(a, b) for a, bs in near.items() for b in bs], "src long, dst long")
    now, moves, lack = minimum.enforced(u, p, c, e, wanted, most)
    made = [(r.city, r.unit_id, r.origin, r.destination) for r in sorted(moves.collect(), key=lambda r: (r.city, r.round))]
    return {r.unit_id: r.pole_id for r in now.collect()}, made, sorted((r.city, r.pole_id) for r in lack.collect())


def unit(city, pole, fixed=False, load=1.0, weight=1.0):
    return {"city": city, "pole": pole, "fixed": fixed, "load": load, "weight": weight}


def test_poles_that_share_few_districts_need_no_move(spark):
    """Three districts of one city between two poles: an equal share is one, so two each are not asked."""
    units = {0: unit("a", "p", True), 1: unit("a", "q", True), 2: unit("a", "q"), 3: unit(None, "r", True)}
    poles, near = {"p": "a", "q": "a", "r": None}, around([(0, 1), (1, 2), (2, 3)])
    cost = {(i, p): 0.0 for i in units for p in poles}
    assert enforce(spark, units, poles, cost, near, 2, 99.0) == ({0: "p", 1: "q", 2: "q", 3: "r"}, [], [])


def test_minimum_against_the_scan_in_turn(spark):
    """A chain of districts in two cities, each on its own: seats fixed, one pole's load full, one that cannot be helped."""
    rng = random.Random(11)
    units, near = {}, {}
    for base, city in ((0, "a"), (100, "b")):
        # A grid of three by three districts; the first pole holds nearly all of them.
        cells = {(x, y): base + 10 * x + y for x in range(3) for y in range(3)}
        for (x, y), k in cells.items():
            pole = f"{city}3" if (x, y) == (2, 2) else f"{city}2" if (x, y) == (0, 2) else f"{city}1"
            units[k] = unit(city, pole, (x, y) in ((0, 0), (2, 2), (0, 2)), rng.choice([1.0, 2.0]), rng.choice([0.5, 1.0, 3.0]))
        near |= around([(k, cells[x + i, y + j]) for (x, y), k in cells.items() for i, j in ((1, 0), (0, 1)) if (x + i, y + j) in cells])
    units[200], units[201], near[200], near[201] = unit("b", "b4", True), unit(None, None), {201}, {200}
    poles = {f"{c}{i}": c for c in "ab" for i in (1, 2, 3)} | {"b4": "b"}
    cost = {(u, p): round(rng.random() * 50, 3) for u in units for p in poles}
    cost.pop((2, "a2"))
    owner, moves, lack = in_turn(units, poles, cost, near, 3, 5.0)
    assert enforce(spark, units, poles, cost, near, 3, 5.0) == (owner, moves, sorted(lack))
    assert len(moves) >= 3 and ("b", "b4") in lack


def test_minimum_of_nothing(spark):
    u = spark.createDataFrame([], "unit_id long, city string, pole_id string, load double, weight double, fixed boolean")
    now, moves, lack = minimum.enforced(u, spark.createDataFrame([("p", "a")], "pole_id string, city string"), spark.createDataFrame([], "unit_id long, pole_id string, cost double"), spark.createDataFrame([], "src long, dst long"), 2, 9.0)
    assert (now.count(), moves.count(), lack.count()) == (0, 0, 0)
