import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from geoterra.operators import balance, contracts, graph, rebalance, spatial, summaries
from geoterra.sources import drafts, reports


def grid(n, step=0.5):
    """A square of units with their edges in both directions."""
    at = [(i, j) for i in range(n) for j in range(n)]
    number = {c: k for k, c in enumerate(at)}
    units = pd.DataFrame({"unit_id": range(len(at)), "lat": [i * step for i, _ in at], "lon": [j * step for _, j in at]})
    edges = [(number[a], number[b]) for a, b in itertools.permutations(at, 2) if abs(a[0] - b[0]) + abs(a[1] - b[1]) == 1]
    return units, pd.DataFrame(edges, columns=["src", "dst"])


def parts(nodes, edges):
    left, count = set(nodes), 0
    while left:
        count, front = count + 1, [left.pop()]
        while front:
            at = front.pop()
            new = {b for a, b in edges if a == at and b in left}
            left -= new
            front += new
    return count


def test_new_seats_spread():
    units = pd.DataFrame({"unit_id": [1, 2, 3, 4], "lat": [0.0, 0.0, 0.0, 0.0], "lon": [0.0, 1.0, 5.0, 9.0], "population": [10.0, 10.0, 10.0, 10.0]})
    anchors = pd.DataFrame({"lat": [0.0], "lon": [0.0]})
    assert [units["unit_id"][i] for i in rebalance.new_seats(units, anchors, 2)] == [4, 3]
    assert rebalance.new_seats(units, anchors.iloc[:0], 1) == [3]
    with pytest.raises(ValueError):
        rebalance.new_seats(units, anchors, 5)


def objective(region, owner):
    cost, w, t = region.fixed_cost(), region.profile.balance, region.target
    load = np.bincount(owner, region.pop, len(region.p))
    return cost[np.arange(len(owner)), owner].sum() + w * (((load - t) / t) ** 2).sum()


@pytest.mark.parametrize("profile", rebalance.PROFILES, ids=lambda p: p.name)
def test_assignment_is_a_local_optimum(profile):
    rng = np.random.default_rng(3)
    n = 30
    units = pd.DataFrame({"unit_id": range(n), "lat": rng.random(n), "lon": rng.random(n), "population": rng.integers(1, 100, n).astype(float), "state": rng.choice(["A", "B"], n), "original_pole": rng.choice(["x", "y", "z"], n), "scale": 50.0})
    poles = pd.DataFrame({"pole_id": ["x", "y", "z"], "seat_unit": [0, 1, 2], "lat": units["lat"][:3], "lon": units["lon"][:3], "state": units["state"][:3]})
    region = rebalance._Region(units, poles, profile, 200)
    region.assign()
    best, held = objective(region, region.owner), np.bincount(region.owner, minlength=3)
    assert list(region.owner[:3]) == [0, 1, 2]
    for i, j in itertools.product(range(3, n), range(3)):
        if held[region.owner[i]] > 1:
            other = region.owner.copy()
            other[i] = j
            assert objective(region, other) >= best - 1e-9


def test_rebalanced_regions(spark):
    units = spark.createDataFrame([(r, 10.0, i + 10 * k, "S", "p0", 5.0, float(i), float(k)) for k, r in enumerate("NM") for i in range(4)], "region string, scale double, unit_id long, state string, original_pole string, population double, lat double, lon double")
    places = spark.createDataFrame([("N", "p0", 0, "S", 0.0, 0.0), ("N", "p1", 3, "S", 3.0, 0.0)], "region string, pole_id string, seat_unit long, state string, lat double, lon double")
    out = rebalance.rebalanced(units, places).toPandas()
    assert set(out["profile"]) == {p.name for p in rebalance.PROFILES} and set(out["region"]) == {"N"} and len(out) == 12
    assert (out.groupby("profile")["pole_id"].nunique() == 2).all()


def test_scales(spark):
    units = spark.createDataFrame([("N", 1, 0.0, 0.0), ("N", 2, 0.0, 1.0), ("M", 3, 0.0, 0.0)], "region string, unit_id long, lat double, lon double")
    base = spark.createDataFrame([("N", "p", 0.0, 1.0)], "region string, pole_id string, km double, population double")
    got = {r.region: r.scale for r in rebalance.scales(units, base).collect()}
    assert got["M"] == 1.0 and got["N"] == pytest.approx(111.195, rel=1e-3)


def test_balancing_keeps_portfolios_whole():
    units, edges = grid(5)
    seats = {0, 24}
    units = units.assign(seat=units["unit_id"].isin(seats), owner=[24 if i == 24 else 0 for i in range(25)], load=1.0, weight=1.0, strategic=False, small=False, stores=1)
    p = balance.Portfolios(units, edges, balance.Limits(extra_km=1e9, km_for_balance=1e6))
    p.balance()
    assert p.loads().max() <= p.target * 1.25 and p.loads().min() >= p.target * 0.75
    pairs = list(edges.itertuples(index=False, name=None))
    for j in range(2):
        assert parts(np.flatnonzero(p.owner == j).tolist(), pairs) == 1
    assert p.owner[0] == 0 and p.owner[24] == 1


def test_repair_and_release():
    units, edges = grid(3)
    owner = [0, 0, 0, 8, 8, 8, 0, 8, 8]
    units = units.assign(seat=units["unit_id"].isin({0, 8}), owner=owner, load=1.0, weight=1.0, strategic=False, small=[i == 2 for i in range(9)], stores=0)
    p = balance.Portfolios(units, edges, balance.Limits(small_km=50.0, repair_slack=9.0, repair_km=1e9))
    p.repair()
    assert p.owner[6] == 1 and [x[3] for x in p.log] == ["REPARO_ILHA"]
    p.release_small()
    assert p.owner[2] == -1 and p.owner[1] == 0


def test_balanced_handles_bare_groups(spark):
    units = spark.createDataFrame([("A", 1, None, False, 1.0, 1.0, 0.0, 0.0, False, False, 0)], "g string, unit_id long, owner long, seat boolean, load double, weight double, lat double, lon double, strategic boolean, small boolean, stores long")
    edges = spark.createDataFrame([], "g string, src long, dst long")
    assert balance.balanced(units, edges, "g").count() == 0
    one = balance.balanced(units.withColumn("seat", F.lit(True)).withColumn("owner", F.lit(1).cast("long")), edges, "g").first()
    assert (one.origin, one.destination, one.moves) == (1, 1, 0)


def test_cut_units_against_removal(spark):
    rng = np.random.default_rng(5)
    n = 24
    owner = rng.choice(["a", "b"], n)
    links = {(int(a), int(b)) for a, b in rng.integers(0, n, (34, 2)) if a != b}
    links |= {(b, a) for a, b in links}
    assigned = spark.createDataFrame([(i, str(o)) for i, o in enumerate(owner)], "unit_id long, pole_id string")
    edges = spark.createDataFrame([(a, b, 1.0) for a, b in links], "src long, dst long, km double")
    want = set()
    for o in "ab":
        nodes = [i for i in range(n) if owner[i] == o]
        inside = [(a, b) for a, b in links if owner[a] == owner[b] == o]
        want |= {i for i in nodes if parts(set(nodes) - {i}, inside) > parts(nodes, inside)}
    assert {r.unit_id for r in graph.cut_units(assigned, edges).collect()} == want


def test_reached_leaves_islands_out(spark):
    places = spark.createDataFrame([(i, 0.0, 0.1 * i) for i in range(6)] + [(9, 0.0, 4.0)], "unit_id long, lat double, lon double")
    centre = spark.createDataFrame([("c", 0.0, 0.0), ("far", 60.0, 60.0)], "pole_id string, lat double, lon double")
    assert {(r.pole_id, r.unit_id) for r in graph.reached(places, centre, 500.0).collect()} == {("c", i) for i in range(6)}


def test_polygon_joins(spark):
    square = lambda x, y, s: [Row(lon=float(x + i * s), lat=float(y + j * s)) for i, j in ((0, 0), (1, 0), (1, 1), (0, 1))]
    polygons = spark.createDataFrame([(1, square(0, 0, 2)), (2, square(1, 1, 2)), (3, square(8, 8, 1)), (4, None)], "k long, ring array<struct<lon double, lat double>>")
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.5, 1.5), (3, 2.5, 2.5), (4, 5.0, 5.0)], "unit_id long, lat double, lon double")
    for cell in (0.3, 1.0, 7.0):
        assert {(r.unit_id, r.k) for r in spatial.containing(points, polygons, "k", cell).collect()} == {(1, 1), (2, 1), (3, 2)}
        assert [tuple(r) for r in spatial.box_pairs(polygons, "k", cell).collect()] == [(1, 2)]


def test_left_unique(spark):
    a, b = spark.createDataFrame([(1,), (2,)], ["k"]), spark.createDataFrame([(1, "x"), (1, "y")], ["k", "v"])
    assert contracts.left_unique(a, b.limit(1), ["k"]).count() == 2
    with pytest.raises(Exception, match="keys repeat"):
        contracts.left_unique(a, b, ["k"]).collect()


def test_draft_revisions(spark, tmp_path):
    path = f"file://{tmp_path}/drafts"
    assert drafts.latest(drafts.revisions(spark, path)).count() == 0
    assert drafts.write(spark, path, "a", None, "first") == 1
    assert drafts.write(spark, path, "a", 1, "second") == 2
    with pytest.raises(drafts.Conflict):
        drafts.write(spark, path, "a", 1, "late")
    assert [r.name for r in drafts.latest(drafts.revisions(spark, path)).collect()] == ["second"]
    drafts.write(spark, path, "a", 2, deleted=True)
    assert drafts.latest(drafts.revisions(spark, path)).count() == 0
    assert drafts.write(spark, path, "a", None, "again") == 4


def test_report_texts(spark, tmp_path):
    df = spark.createDataFrame([("a|b\nc", None)], "x string, y string")
    assert reports.markdown_rows(df).first().line == "| a\\|b c |  |"
    assert reports.markdown_head(["x", "y"]) == ["| x | y |", "|---|---|"]
    reports.workbook({"One": df}, str(tmp_path / "w"))
    assert "<Data" in spark.read.text(str(tmp_path / "w/One/rows")).first().value


def test_weighted_or_plain(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", 3.0, 3.0), ("b", 1.0, 0.0), ("b", 3.0, 0.0)], ["k", "v", "w"])
    assert {r.k: r.m for r in df.groupBy("k").agg(summaries.weighted_or_plain(F.col("v"), F.col("w")).alias("m")).collect()} == {"a": 2.5, "b": 2.0}
