"""The nearest feasible site without all pairs in reach."""

import duckdb
import pytest

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["f19_nearest_feasible", "f19_store_coverage", "f19_best_coverage_seed"])
def test_only_units_that_nobody_serves_are_paired(spark, monkeypatch, name):
    import __spark_entry__ as entry
    from geoterra.operators import spatial

    seen, real = [], spatial.within_km

    def within_km(left, right, km, keys):
        seen.append(left.count())
        return real(left, right, km, keys)

    monkeypatch.setattr(spatial, "within_km", within_km)
    got = sorted(map(tuple, entry.queries()[name](spark, FOLDER).collect()), key=repr)
    with duckdb.connect() as c:
        for t in ("nation", "region", "customer", "supplier", "orders", "lineitem", "part"):
            c.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
        sql = entry.oracle_sql()
        assert got == sorted(c.sql(sql[name]).fetchall(), key=repr)
        served = len(c.sql(sql["f19_nearest_feasible"]).fetchall())
        unserved = len(c.sql(f"select * from customer where c_custkey not in (select unit_id from ({sql['f19_nearest_feasible']}))").fetchall())
    # Some are served and some are not, so the seed is put to the test.
    assert served and unserved and (not seen or (name == "f19_best_coverage_seed" and seen[0] <= unserved))
