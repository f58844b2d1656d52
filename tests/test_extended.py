"""Files, runs, shapes, distance joins, siting and whole pipelines against brute force or known cases."""

import io
import json
import math
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

RNG = np.random.default_rng(3)


def km(a, b):
    la, lo, lb, lp = map(math.radians, (*a, *b))
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((lp - lo) / 2) ** 2
    return 2 * 6371.0088 * math.asin(min(1, math.sqrt(h)))


def places(spark, n, kind, wide=True):
    lat = RNG.uniform(-89, 89, n) if wide else RNG.uniform(-30, 0, n)
    lon = RNG.uniform(-180, 180, n) if wide else RNG.uniform(-70, -40, n)
    rows = [(i, f"p{i}", ["x", "y"][i % 2], float(a), float(b)) for i, (a, b) in enumerate(zip(lat, lon, strict=True))]
    return rows, spark.createDataFrame(rows, f"{kind} long, pole_id string, g string, lat double, lon double")


@pytest.mark.parametrize("wide", [True, False])
def test_nearest_equals_all_pairs(spark, wide):
    from geoterra.operators.spatial import nearest

    u, units = places(spark, 120, "unit_id", wide)
    p, poles = places(spark, 60, "pole_num", False)
    for keys in (None, ["g"]):
        got = {r.unit_id: (r.pole_id, r.km) for r in nearest(units, poles, keys).collect()}
        for i, _, g, *at in u:
            want = min((km(at, q), k, name) for k, name, h, *q in p if keys is None or g == h)
            assert got[i][0] == want[2] and got[i][1] == pytest.approx(want[0])


def test_within_km_equals_all_pairs(spark):
    from geoterra.operators.spatial import within_km

    a, left = places(spark, 150, "unit_id")
    extra = [(900, "p", "x", 10.0, 179.9), (901, "p", "x", 10.0, -179.9), (902, "p", "x", 88.0, 0.0), (903, "p", "x", 88.0, 179.0)]
    a, left = a + extra, left.union(spark.createDataFrame(extra, left.schema))
    for far in (300.0, 2500.0):
        got = sorted((r[0], r[1]) for r in within_km(left, left, far, ["g"]).select("a.unit_id", "b.unit_id").collect())
        assert got == sorted((i, j) for i, _, g, *x in a for j, _, h, *y in a if g == h and km(x, y) <= far)


def test_long_paths_reach_the_fixpoint(spark):
    from geoterra.operators.graph import components, voronoi

    n = 203
    edges = spark.createDataFrame([(i, i + 1, 1.0) for i in range(n)] + [(i + 1, i, 1.0) for i in range(n)], "src long, dst long, km double")
    out = {r.unit_id: r.km for r in voronoi(spark.createDataFrame([(0,)], "unit_id long"), edges).collect()}
    assert out == {i: float(i) for i in range(n + 1)}
    assert {r.component for r in components(spark.range(n + 1).withColumnRenamed("id", "unit_id"), edges).collect()} == {0}


L_SHAPE = [(0, 0), (4, 0), (4, 1), (1, 1), (1, 4), (0, 4)]


def ring(points):
    return [{"lon": float(x), "lat": float(y)} for x, y in points]


def test_shapes(spark):
    from geoterra.functions import shapes

    kind = shapes.RING
    rows = [(1, ring(L_SHAPE), ring([(0, 0), (2, 0), (2, 2), (0, 2)])), (2, ring(L_SHAPE[::-1]), ring([(2, 2), (4, 2), (4, 4), (2, 4)])), (3, ring([(0, 0), (2, 0), (2, 2), (0, 2)]), ring(L_SHAPE)), (4, ring([(0, 0), (9, 0), (9, 9), (0, 9)]), ring(L_SHAPE[2:] + L_SHAPE[:2]))]
    df = spark.createDataFrame(rows, f"i long, a {kind}, b {kind}")
    a, b = F.col("a"), F.col("b")
    got = {r.i: r for r in df.select("i", shapes.common_area(a, b).alias("both"), shapes.representative_point(a).alias("p"), shapes.rings_apart(a, b).alias("gap"), shapes.in_ring(shapes.representative_point(a)["lon"], shapes.representative_point(a)["lat"], a).alias("inside")).collect()}
    assert [got[i].both for i in (1, 2, 3, 4)] == pytest.approx([3, 0, 3, 7])
    assert all(r.inside for r in got.values())
    assert got[2].gap == pytest.approx(1.0)
    cut = df.filter("i = 1").select(shapes.clipped(a, b).alias("c")).select(shapes.signed_area(F.col("c")).alias("s")).first().s
    assert abs(cut) == pytest.approx(3)


def test_parents_that_bend(spark):
    from geoterra.functions import shapes
    from geoterra.operators.mesh import reconciled

    kind = "array<struct<lon:double,lat:double>>"
    parent = spark.createDataFrame([("m", ring(L_SHAPE))], f"parent string, ring {kind}")
    one = lambda name, points: spark.createDataFrame([(name, "m", ring(points))], f"district string, parent string, ring {kind}")
    area = lambda df: df.select(F.sum(shapes.signed_area(F.col("ring"))), F.count("*")).first()
    cut, audit = reconciled(one("d", [(0, 0), (2, 0), (2, 2), (0, 2)]), parent)
    assert audit.first().outside == pytest.approx(1) and audit.first().status == "AJUSTADO"
    assert tuple(area(cut)) == (pytest.approx(3), 1)
    assert tuple(area(reconciled(one("d", [(0.5, 3), (3, 0.5), (4, 0.5), (0.5, 4)]), parent)[0])) == (pytest.approx(audit_of(reconciled(one("d", [(0.5, 3), (3, 0.5), (4, 0.5), (0.5, 4)]), parent))), 2)
    assert reconciled(one("d", [(0, 0), (1, 0), (1, 1), (0, 1)]), parent)[0].count() == 1
    wide = spark.createDataFrame([("m", ring([(0, 0), (1000, 0), (1000, 1000), (0, 1000)]))], f"parent string, ring {kind}")
    got = reconciled(one("d", [(0, 0), (1100, 0), (1100, 1000), (0, 1000)]), wide)[1].first()
    assert (got.inside, got.outside) == (pytest.approx(1e6), pytest.approx(1e5))


def audit_of(found):
    return found[1].first().inside


def test_outlines_and_mask(spark):
    from geoterra.operators.mesh import mask, outlines

    cells = [(x, y) for x in range(3) for y in range(3) if (x, y) != (1, 1)]
    rows = [("s", ring([(x, y), (x + 1, y), (x + 1, y + 1), (x, y + 1)])) for x, y in cells]
    out = outlines(spark.createDataFrame(rows, "state string, ring array<struct<lon:double,lat:double>>"), "state")
    assert sorted(len(r.ring) for r in out.collect()) == [4, 12]
    whole = mask(out.filter("size(ring) = 12").select("part", "ring")).collect()
    assert sorted(len(r.ring) for r in whole) == [5, 13] and all(r.ring[0] == r.ring[-1] for r in whole)


def test_files(spark, tmp_path):
    from geoterra.sources import files

    (tmp_path / "q.sql").write_bytes(b"\xef\xbb\xbfselect 1 as x\n")
    assert files.sql_text(spark, str(tmp_path / "q.sql")) == "select 1 as x"
    (tmp_path / "empty.sql").write_text(" ")
    with pytest.raises(ValueError, match="empty"):
        files.sql_text(spark, str(tmp_path / "empty.sql"))
    (tmp_path / "a.csv").write_bytes("cod_ibge ;Nome\n3550308;São\n".encode("cp1252"))
    (tmp_path / "b.csv").write_bytes("COD_IBGE|Nome\n3550308|São\n".encode("utf-8-sig"))
    for name in ("a.csv", "b.csv"):
        df = files.robust_csv(spark, str(tmp_path / name))
        assert df.columns == ["COD_IBGE", "NOME"] and df.collect() == [("3550308", "São")]
        assert files.excluded_codes(spark, str(tmp_path / name)).collect() == [("3550308",)]
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("x.csv", "no\n")
        z.writestr("Basico_SP.csv", "h\nSão\n".encode("latin-1"))
    assert [(r.member, r.line, r.text) for r in files.archive_members(spark, str(tmp_path / "z.zip")).collect()] == [("Basico_SP.csv", 0, "h"), ("Basico_SP.csv", 1, "São")]
    book(tmp_path / "resultado_1.xlsx")
    rows = files.workbook_rows(spark, str(tmp_path / "resultado_1.xlsx"), ("Polos",))
    assert files.sheet_table(rows, "Polos", ("ID", "NOME", "MISSING")).collect() == [("1", "São & Cia", None), ("2", None, None)]
    (tmp_path / "map.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"CD_MUN": 3550308, "n": None}, "geometry": {"type": "MultiPolygon", "coordinates": [[[[0, 0], [1, 0], [1, 1]]], [[[5, 5], [6, 5], [6, 6]]]]}}, {"type": "Feature", "geometry": None}]}))
    got = files.geojson_features(spark, str(tmp_path / "map.geojson")).collect()
    assert [(r.feature, r.properties, r.ring and len(r.ring)) for r in got] == [(0, {"CD_MUN": "3550308"}, 3), (0, {"CD_MUN": "3550308"}, 3), (1, {}, None)]
    assert files.geojson_features(spark, str(tmp_path / "none.geojson"), missing_ok=True).count() == 0
    (tmp_path / "bad.geojson").write_text("{}")
    with pytest.raises(Exception, match="no feature collection"):
        files.geojson_features(spark, str(tmp_path / "bad.geojson")).collect()
    assert [r.folder.rsplit("/", 1)[1] for r in files.discovered(spark, str(tmp_path)).collect()] == [tmp_path.name]


def book(path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Other" r:id="a"/><sheet name="Polos" r:id="b"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="a" Target="worksheets/s1.xml"/><Relationship Id="b" Target="/xl/worksheets/s2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>id </t></si><si><r><t>No</t></r><r><t>me</t></r></si></sst>")
        z.writestr("xl/worksheets/s1.xml", f"<worksheet {ns}><sheetData/></worksheet>")
        z.writestr("xl/worksheets/s2.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row><c r="A2"><v>1</v></c><c r="C2" t="inlineStr"><is><t>São &amp; Cia</t></is></c></row><row><c r="A3"><v>2</v></c></row></sheetData></worksheet>')


def test_configuration(spark, tmp_path):
    from geoterra.sources import files

    good = {"regions": [{"name": "A", "areas": ["N"], "ufs": ["aa"], "targetPoles": 1}, {"name": "B", "areas": ["S"], "ufs": ["BB"], "targetPoles": 3}]}
    (tmp_path / "c.json").write_text("﻿" + json.dumps(good), encoding="utf-8")
    config = files.rebalance_config(spark, str(tmp_path / "c.json"))
    assert config["regions"][0]["states"] == ["AA"] and config["passes"] == 10 and files.region_maps(spark, config)[2].count() == 2
    for change in ({"ufs": ["AA"]}, {"areas": ["N"]}, {"name": "A"}, {"targetPoles": 0}, {"targetPoles": 1.5}, {"areas": []}):
        bad = {"regions": [good["regions"][0], good["regions"][1] | change]}
        with pytest.raises(ValueError):
            files.checked_config(bad)
    for change in ({"balanceTolerancePct": 100}, {"maxP90IncreasePct": -1}, {"maxAssignmentPasses": 0}, {"regions": None}):
        with pytest.raises(ValueError):
            files.checked_config(good | change)


def test_snapshots_and_runs(spark, tmp_path):
    from geoterra.sources import drafts, files, runs

    path = f"{tmp_path}/snap"
    good = lambda: spark.range(3)
    assert files.cached(good, path).filter("not stale").count() == 3
    broken = lambda: spark.sql("select * from no_such_table")
    assert files.cached(broken, path).filter("stale").count() == 3
    with pytest.raises(Exception, match="no_such_table"):
        files.cached(broken, f"{tmp_path}/none")
    files.snapshot(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5
    assert runs.recorded(spark, str(tmp_path), "r1", {"a": 1}, lambda: {"t": spark.range(2), "none": spark.range(0)}).keys() == {"t", "none"}
    with pytest.raises(KeyError):
        runs.recorded(spark, str(tmp_path), "r2", {"a": 1}, lambda: {}["x"])
    assert sorted((r.run_id, r.status, r.detail_type) for r in runs.statuses(spark, str(tmp_path)).collect()) == [("r1", "CONCLUIDO", None), ("r2", "ERRO", "KeyError")]
    assert runs.checkpointed_solution(spark.range(4), str(tmp_path), "r1").count() == 4
    assert drafts.write(spark, f"{tmp_path}/drafts", "d", None) == 1
    files.created_once(spark, f"{tmp_path}/drafts.claims/{__import__('hashlib').sha256(b'd').hexdigest()}/2")
    with pytest.raises(drafts.Conflict):
        drafts.write(spark, f"{tmp_path}/drafts", "d", 1)


def scenario(spark, poles, units, summary=True):
    from geoterra.operators.scenario import Scenario

    p = spark.createDataFrame(poles, "position long, pole_id string, name string, area string, lat double, lon double")
    u = spark.createDataFrame(units, "position long, source_id string, kind string, municipality_code string, district_code string, name string, state string, pole_id string, population double, stores double, lat double, lon double")
    return Scenario(p, u, spark.createDataFrame([(float(len(poles)), float(len(units)))] if summary else [], "total_poles double, total_units double"))


def test_scenario_rules_and_comparison(spark):
    from geoterra.operators import scenario as s

    poles = [(0, "1", "A", "N", 0.0, 0.0), (1, " ", "B", "N", 0.0, 0.0), (2, "1", "C", "N", 1.0, 1.0), (3, "2", None, None, None, 0.0)]
    units = [
        (0, "u1", "MUNICIPIO", "100", None, "x", "AA", "1", 100.0, 2.0, 0.0, 1.0), (1, "u1", "MUNICIPIO", "100", None, "x", "AA", "1", 90.0, 3.0, 0.0, 1.5),
        (2, None, "MUNICIPIO", "200", None, "y", "AA", None, float("nan"), -1.0, 999.0, 0.0), (3, "u4", "DISTRITO", "300", "30005", "z", "AA", "7", 5.0, 1.0, 0.0, 0.0),
    ]
    bad = scenario(spark, poles, units, False)
    found = sorted((r.code, r.entity) for r in s.issues(bad).collect())
    assert found == sorted([
        ("SUMMARY_AUSENTE", ""), ("POLO_SEM_ID", "1"), ("POLO_DUPLICADO", "1"), ("COORDENADA_POLO_INVALIDA", "2"), ("UNIDADE_ID_DUPLICADO", "u1"), ("UNIDADE_SEM_POLO", "linha-3"), ("POLO_NAO_ENCONTRADO", "u4"),
        ("COORDENADA_UNIDADE_INVALIDA", "linha-3"), ("CORRESPONDENTES_INVALIDOS", "linha-3"), ("POPULACAO_INVALIDA", "linha-3"), ("COORDENADAS_DIVERGENTES", "u1"),
    ])
    rows = s.portfolio_rows(bad).collect()
    assert [(r.unit_key, r.stores, r.population, r.lon, r.records) for r in rows] == [("MUN:100", 5.0, 100.0, 1.0, 2)]
    ok = scenario(spark, [(0, "1", "A", "N", 0.0, 0.0), (1, "2", "B", "S", 1.0, 0.0)], [(i, f"u{i}", "MUNICIPIO", f"{100 + i}", None, "x", "AA", "12"[i % 2], 10.0, 1.0, 0.0, float(i)) for i in range(6)])
    same = s.compare(ok, ok)
    told = {(r.priority, r.theme) for r in same.insights.collect()}
    assert ("NEUTRA", "Distância nacional") in told and ("NEUTRA", "Gerência de área") in told and not any(t[1] == "Qualidade dos dados" for t in told)
    assert same.quality.count() == 0 and {r.movement for r in same.movements.collect()} == {"MANTIDA"}
    other = scenario(spark, [(0, "1", "A", "N", 0.0, 0.0), (1, "3", "B", "S", 1.0, 0.0)], [(i, f"u{i}", "MUNICIPIO", f"{100 + i}", None, "x", "AA", "13"[i % 2], 10.0, 1.0, 0.0, float(i)) for i in range(6)])
    got = s.compare(ok, other)
    assert {(r.situation, r.pole_id) for r in got.unmatched.collect()} == {("SOMENTE_ATUAL", "2"), ("SOMENTE_PROPOSTO", "3")}
    assert [r.pole_id for r in got.portfolios.collect()] == ["1"] and {r.movement for r in got.movements.collect()} == {"MANTIDA", "MOVIDA"}
    assert "IDs não correspondentes" in {r.theme for r in got.insights.collect()}


def test_rebalancing_run(spark):
    from geoterra.operators.pipelines import rebalance_scenario
    from geoterra.sources.files import checked_config

    poles = [(i, f"P{i}", f"p{i}", "A" if i < 3 else "B", float(i), 0.0) for i in range(4)]
    units = [(i, f"u{i}", "MUNICIPIO", f"{100 + i}", None, "x", "AA" if i < 4 else "BB", f"P{min(i % 4, 3)}", 100.0, 1.0, float(i), 1.0) for i in range(10)]
    units.append((10, "again", "MUNICIPIO", "100", None, "x", "AA", "P1", 90.0, 7.0, 0.0, 1.0))
    s = scenario(spark, poles, units)
    config = {"regions": [{"name": "A", "areas": ["A"], "ufs": ["AA"], "targetPoles": 1}, {"name": "B", "areas": ["B"], "ufs": ["BB"], "targetPoles": 3}]}
    out = rebalance_scenario(s, checked_config(config))
    for profile in ("conservador", "equilibrado", "geografico"):
        u = out["units"].filter(F.col("profile") == profile).collect()
        assert len(u) == 10 and sum(r.population for r in u) == 1000 and sum(r.stores for r in u) == 17
        seats = {(r.region, r.pole_id, r.seat) for r in out["poles"].filter(F.col("profile") == profile).collect()}
        assert sorted(r for r, *_ in seats) == ["A", "B", "B", "B"] and {p for _, p, _ in seats} == {"P0", "P1", "P2", "P3"}
        owner = {r.unit_key: r.pole_id for r in u}
        assert all(owner[seat] == p for _, p, seat in seats)
    one = out["consolidation"].first()
    assert (one.unit_key, one.records, one.poles, one.population, one.stores, one.original_pole) == ("MUN:100", 2, 2, 100.0, 8.0, "P1")
    again = rebalance_scenario(s, checked_config(config))
    assert sorted(map(tuple, again["units"].collect())) == sorted(map(tuple, out["units"].collect()))
    config["regions"][1]["targetPoles"] = 2
    with pytest.raises(ValueError, match="targets"):
        rebalance_scenario(s, checked_config(config))
    with pytest.raises(ValueError, match="unknown poles"):
        rebalance_scenario(scenario(spark, poles, units[:-1] + [(10, "z", "MUNICIPIO", "900", None, "x", "AA", "P9", 1.0, 1.0, 0.0, 0.0)]), checked_config(config))


def test_p_median_and_refinement(spark):
    from geoterra.operators import siting

    cost = RNG.uniform(1, 9, (12, 6)).round(3)
    weight, opening = RNG.uniform(1, 3, 12).round(2), RNG.uniform(0, 2, 6).round(2)
    rows = [("g", i, j, float(cost[i, j]), float(weight[i]), float(opening[j])) for i in range(12) for j in range(6)]
    got = {r.step: r.candidate for r in siting.p_median(spark.createDataFrame(rows, "g string, unit_id long, candidate long, cost double, weight double, opening double"), "g", 3).collect()}
    best, chosen = np.full(12, 1e9), []
    for _ in range(3):
        score = [np.inf if j in chosen else (np.minimum(best, cost[:, j]) * weight).sum() + opening[j] for j in range(6)]
        chosen.append(int(np.argmin(score)))
        best = np.minimum(best, cost[:, chosen[-1]])
    assert [got[k] for k in range(3)] == chosen
    at = np.concatenate([RNG.normal(0, 1, (8, 2)), RNG.normal(20, 1, (8, 2))])
    away = np.hypot(*(at[:, None] - at[None]).transpose(2, 0, 1))
    rows = [("g", i, j, float(away[i, j]), 1.0) for i in range(16) for j in range(16)]
    pairs, seats = spark.createDataFrame(rows, "g string, unit_id long, seat long, km double, weight double"), spark.createDataFrame([("g", 0), ("g", 1)], "g string, seat long")
    before = np.minimum(away[:, 0], away[:, 1]).sum()
    out = siting.refined(pairs, seats, "g", 6).collect()
    assert sum(r.km for r in out) < before and len(out) == 16
    still = siting.refined(pairs, seats, "g", 6, locked=spark.createDataFrame([(0,), (1,)], "seat long")).collect()
    assert {r.seat for r in still} == {0, 1}
    o = spark.createDataFrame([(1, 0.0, 0.0, "a"), (2, 0.0, 0.1, "a"), (3, 50.0, 0.0, "a")], "office long, lat double, lon double, area string")
    c = spark.createDataFrame([(7, 0.0, 0.0, "a")], "candidate long, lat double, lon double, area string")
    found, short = siting.anchor_pairs(o, c, 50.0, ["area"])
    assert found.count() == 2 and {(r.office, r.reason) for r in short.collect()} == {(1, "HALL"), (2, "HALL"), (3, "SEM_CANDIDATO")}


def test_metropolitan_seeds_follow_gap_and_pressure(spark):
    from geoterra.operators import siting

    wanted = {"a": (3, 90.0), "b": (2, 100.0), "c": (1, 5.0), "d": (3, 95.0)}
    rows = [(city, i, j, abs(i - j) + 0.1 * i * j, 1.0, 0.0) for city in wanted for i in range(4) for j in range(4)]
    pairs = spark.createDataFrame(rows, "city string, unit_id long, candidate long, cost double, weight double, opening double")
    seats, lack = siting.metropolitan_seeds(pairs, spark.createDataFrame([(c, *x) for c, x in wanted.items()], "city string, seats int, load double"), 8)
    have, order = dict.fromkeys(wanted, 0), []
    for city in sorted(wanted):
        have[city] += 1
        order.append(city)
    while len(order) < 8:
        city = max((c for c in wanted if have[c] < wanted[c][0]), key=lambda c: (wanted[c][0] - have[c], wanted[c][1] / max(have[c], 1)))
        have[city] += 1
        order.append(city)
    got = sorted(seats.collect())
    assert [r.city for r in got] == order and len({(r.city, r.candidate) for r in got}) == 8
    assert {r.city: r.missing for r in lack.collect()} == {c: n - have[c] for c, (n, _) in wanted.items() if n > have[c]}
