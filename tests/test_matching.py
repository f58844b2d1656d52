import numpy as np
import pandas as pd
import pytest

from geoterra.operators import matching, solvers


def places(rng, n, kind):
    """Spread, on a coarse grid with shared places, or in two far towns."""
    x = rng.random((2, n)) * 10
    x = np.round(x) if kind == 1 else np.where(x > 5, x / 1000, 30 + x / 1000) if kind == 2 else x
    return pd.DataFrame({"lat": x[0], "lon": x[1]})


@pytest.mark.parametrize("kind", [0, 1, 2])
def test_matching_of_near_places_against_the_table_of_pairs(kind):
    rng = np.random.default_rng(kind)
    for k in range(40):
        n = int(rng.integers(1, 14))
        a, b = places(rng, n, kind), places(rng, n + int(rng.integers(0, 6)), kind)
        cost = solvers.distances(a, b)
        near = lambda: matching.Nearby(a["lat"], a["lon"], b["lat"], b["lon"], 20 if k % 2 else 10_000)  # noqa: B023, E731
        to = matching.least_sum(near())
        assert len(set(to)) == n and cost[range(n), to].sum() == pytest.approx(cost[range(n), solvers.assignment(cost)].sum(), abs=1e-6)
        at, most = solvers.bottleneck(cost)
        level = matching.least_most(near())
        to = matching.least_sum(near(), level)
        assert level == pytest.approx(most, abs=1e-6) and len(set(to)) == n
        assert cost[range(n), to].max() <= most + 1e-6 and cost[range(n), to].sum() == pytest.approx(cost[range(n), at].sum(), abs=1e-6)


@pytest.mark.parametrize("how", ["sum", "max"])
def test_large_groups_are_matched_without_a_table_of_pairs(spark, how):
    rng = np.random.default_rng(7)
    frame = lambda n: spark.createDataFrame([("N", str(i), i, float(y), float(x)) for i, (y, x) in enumerate(rng.random((n, 2)) * 20)], "g string, pole_id string, pole_num long, lat double, lon double")
    a, b = frame(60), frame(50)
    few, many = (solvers.matched(a, b, "g", how, few=n).toPandas() for n in (0, 10_000))
    assert len(few) == few["current"].nunique() == few["proposed"].nunique() == 50
    assert few["km"].sum() == pytest.approx(many["km"].sum()) and few["km"].max() == pytest.approx(many["km"].max())
