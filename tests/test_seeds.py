"""Seats of split cities with anchors, against a plain scan and cases worked by hand."""

import random

import pytest

from geoterra.operators import seeds

NEED = "city string, load double, population double, seats int"
PAIRS = "city string, unit_id long, candidate long, home string, cost double, weight double, opening double"


def scan(pairs, need, total, anchors):
    """One seat after another, by the rule as it is stated."""
    cost, weight, opening, home = {}, {}, {}, {}
    for city, u, c, h, km, w, o in pairs:
        cost[city, u, c], weight[city, u], opening[c], home[c] = km, w, o, h
    order = [c for c, *_ in sorted(need, key=lambda x: (-x[1], -x[2], x[0]))]
    load, want = {c: x for c, x, *_ in need}, {c: s for c, *_, s in need}
    chosen = [(c, city) for c, city in sorted(anchors)]
    have = {c: sum(city == c for _, city in chosen) for c in order}

    def pick(city):
        taken, options = {c for c, _ in chosen}, []
        for c in sorted(c for c, h in home.items() if h == city and c not in taken):
            new, less = 0.0, opening[c]
            for (k, u), w in weight.items():
                if k == city and (k, u, c) in cost:
                    now = min((cost[k, u, t] for t in taken if (k, u, t) in cost), default=None)
                    new -= w if now is None else 0
                    less += w * (cost[k, u, c] if now is None else min(now, cost[k, u, c]) - now)
            options.append((round(new, 6), round(less, 6), c))
        return min(options)[2] if options else None

    for city in order:
        if len(chosen) < total and have[city] == 0 and want[city] > 0 and (c := pick(city)) is not None:
            chosen.append((c, city))
            have[city] += 1
    while len(chosen) < total:
        open_ = sorted((c for c in order if have[c] < want[c]), key=lambda c: (-(want[c] - have[c]), -load[c] / max(have[c], 1)))
        found = next(((pick(c), c) for c in open_ if pick(c) is not None), None)
        if found is None:
            break
        chosen.append(found)
        have[found[1]] += 1
    return [(i + 1, city, c) for i, (c, city) in enumerate(chosen)], {c: want[c] - have[c] for c in order if want[c] > have[c]}


@pytest.mark.parametrize("total", [5, 30])
def test_seeds_against_a_scan(spark, total):
    """Six cities, some beside each other; one has fewer candidates than it wants, one has two anchors, one anchor lies in no split city."""
    rng = random.Random(3)
    cities = {c: (rng.uniform(0, 6), rng.uniform(0, 6)) for c in "abcdef"}
    units = [(c, 10 * i + j, x + rng.random(), y + rng.random()) for i, (c, (x, y)) in enumerate(cities.items()) for j in range(5)]
    sites = [u for u in units if not (u[0] == "c" and u[1] % 10 > 1)] + [("z", 99, 3.0, 3.0)]
    km = lambda a, b: ((a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2) ** 0.5
    pairs = [(u[0], u[1], s[1], s[0], round(km(u, s), 6), 1.0 + u[1] % 3, 0.1 * (s[1] % 4)) for u in units for s in sites if u[0] == s[0] or km(u, s) < 2.5]
    need = [(c, float(100 - 7 * i), 1e6, 1 + i % 4) for i, c in enumerate("abcdef")]
    anchors = [(99, "z"), (31, "d"), (32, "d")]
    want, lack = scan(pairs, need, total, anchors)
    got, missing = seeds.seeds(spark.createDataFrame(pairs, PAIRS), spark.createDataFrame(need, NEED), total, spark.createDataFrame(anchors, "candidate long, city string"))
    assert sorted(map(tuple, got.collect())) == want
    assert {r.city: r.missing for r in missing.collect()} == lack
    assert total > 5 or lack


def test_anchors_relax_the_minimum_of_units(spark):
    """One city of three districts: two units for each seat allow one seat; two anchors make it two, of one unit at least."""
    units = spark.createDataFrame([(i, "m", 2.3e6, 1.0) for i in range(3)] + [(9, "s", 4e5, 1.0), (10, "v", 100.0, 1.0)], "unit_id long, city string, population double, load double")
    sites = spark.createDataFrame([(i, "m") for i in range(3)] + [(9, "s")], "candidate long, city string")
    need = seeds.requirements(units, sites, 1.0, 2, 3e5, 0.9)
    rows = {r.city: r for r in need.collect()}
    assert (rows["m"].most_with_minimum, rows["m"].most, rows["m"].minimum, rows["m"].seats, rows["m"].status) == (1, 3, 2, 1, "GRANULARIDADE_SUFICIENTE")
    assert (rows["s"].minimum, rows["s"].seats, rows["s"].status) == (1, 1, "LIMITADO_A_1_POLO_DISTRITO_OFICIAL_UNICO") and "v" not in rows
    two = {r.city: r for r in seeds.anchored(need, spark.createDataFrame([(0, "m"), (1, "m")], "candidate long, city string"), 2).collect()}
    assert (two["m"].anchors, two["m"].seats, two["m"].minimum, two["m"].status) == (2, 2, 1, "MINIMO_RELAXADO_POR_ANCORAS_GR")
    assert (two["s"].anchors, two["s"].seats, two["s"].status) == (0, 1, "LIMITADO_A_1_POLO_DISTRITO_OFICIAL_UNICO")
    with pytest.raises(ValueError, match="s \\(2 > 1\\)"):
        seeds.anchored(need, spark.createDataFrame([(7, "s"), (8, "s")], "candidate long, city string"), 2)


def test_seeds_of_nothing(spark):
    none = spark.createDataFrame([], "candidate long, city string")
    got, lack = seeds.seeds(spark.createDataFrame([], PAIRS), spark.createDataFrame([("a", 1.0, 1.0, 2)], NEED), 3, none)
    assert got.collect() == [] and [tuple(r) for r in lack.collect()] == [("a", 2)]
