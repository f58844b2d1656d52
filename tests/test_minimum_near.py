import math
import random

from geoterra.functions.geo import EARTH_KM
from geoterra.operators import minimum
from test_blocks import in_turn, unit


def km(a, b):
    (y, x), (v, w) = (tuple(map(math.radians, p)) for p in (a, b))
    return 2 * EARTH_KM * math.asin(math.sqrt(min(1.0, math.sin((v - y) / 2) ** 2 + math.cos(y) * math.cos(v) * math.sin((w - x) / 2) ** 2)))


def test_minimum_by_distance_against_the_scan_in_turn(spark):
    """Two groups of one city each, with units of no city and without a pole; costs and edges follow from where they lie."""
    rng = random.Random(5)
    units, poles, at, seat, group = {}, {}, {}, {}, {}
    for base, city in ((0, "a"), (100, "b")):
        for j in range(7):
            poles[f"{city}{j}"], seat[f"{city}{j}"] = city, (rng.random() * 6, rng.random() * 6)
        for k in range(base, base + 60):
            at[k], group[k] = (rng.random() * 6, rng.random() * 6), city.upper()
            near = min(seat, key=lambda p: (poles[p] != city, km(at[k], seat[p])))
            units[k] = unit(city if rng.random() < 0.5 else None, None if rng.random() < 0.05 else near, rng.random() < 0.1, rng.choice([1.0, 2.0]), rng.choice([0.5, 1.0, 3.0]))
    reach = 150.0
    beside = {a: {b for b in units if a != b and group[a] == group[b] and km(at[a], at[b]) <= reach} for a in units}
    cost = {(k, p): km(at[k], seat[p]) for k in units for p in poles if group[k] == poles[p].upper()}
    _, moves, _ = in_turn(units, poles, cost, beside, 4, 22.0)
    u = spark.createDataFrame([(group[k], k, r["city"], r["pole"], r["load"], r["weight"], r["fixed"], *at[k]) for k, r in units.items()], "g string, unit_id long, city string, pole_id string, load double, weight double, fixed boolean, lat double, lon double")
    p = spark.createDataFrame([(c.upper(), k, c, *seat[k]) for k, c in poles.items()], "g string, pole_id string, city string, lat double, lon double")
    got = sorted(minimum.enforced_near(u, p, "g", reach, 4, 22.0).collect(), key=lambda r: (r.city, r.round))
    assert [(r.city, r.unit_id, r.origin, r.destination) for r in got] == moves and len(moves) >= 4
    assert minimum.enforced_near(u.limit(0), p, "g", reach, 4, 22.0).count() == 0
