"""Connected parts without all pairs in reach, and edges inside portfolios only."""

import random

import duckdb
import pytest

from test_scale import crowd, km

FOLDER = "/root/testdata/sf0.001"


def brute(rows, reach):
    """Smallest id of each part, by plain search; rows are (id, lat, lon, state)."""
    of = {}
    for r in sorted(rows):
        if r[0] in of:
            continue
        of[r[0]], front = r[0], [r]
        while front:
            a = front.pop()
            for b in rows:
                if b[0] not in of and b[3] == a[3] and None not in (a[1], b[1]) and km(a, b) <= reach:
                    of[b[0]] = r[0]
                    front.append(b)
    return of


@pytest.mark.parametrize("reach", [0.05, 30.0, 700.0, 4000.0])
def test_parts_are_those_of_all_pairs_in_reach(spark, reach):
    from geoterra.operators.graph import near_components

    rng = random.Random(7)
    rows = [(*p, "s" if p[0] % 3 else "t") for p in crowd(240, 5, 0.4)]
    # Two crowded lines whose cells are neighbours, some in reach of each other and some not; and a unit without a place.
    rows += [(1000 + i, 10.0 + rng.uniform(0, 0.1), 20.0 + (i % 2) * rng.choice([0.29, 6.3, 6.6]), "u") for i in range(60)] + [(2000, None, 1.0, "s")]
    df = spark.createDataFrame(rows, "unit_id long, lat double, lon double, state string")
    assert dict(near_components(df, reach, ["state"]).collect()) == brute(rows, reach)


@pytest.mark.parametrize("name", ["r04_components", "r08_cut_units", "r09_fragmentation", "r10_frontier_pairs", "r11_severed_parts", "f01_seed_of_each_component", "q04_hard_violations"])
def test_no_query_of_parts_forms_all_edges(spark, monkeypatch, name):
    import __spark_entry__ as entry
    from geoterra.plans.views import Territory

    def never(self):
        raise AssertionError("all pairs within reach are formed")

    monkeypatch.setattr(Territory, "edges", property(never))
    got = sorted(map(tuple, entry.queries()[name](spark, FOLDER).collect()), key=repr)
    if name not in entry.oracle_sql():
        return
    with duckdb.connect() as c:
        for t in ("nation", "region", "customer", "supplier", "orders", "lineitem", "part"):
            c.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
        assert got == sorted(c.sql(entry.oracle_sql()[name]).fetchall(), key=repr)
