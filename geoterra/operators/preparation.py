"""Preparation of what models start from: regional points, hierarchy, poles and stores, the stores' units, census populations, centres, scenarios from sheets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import values as v
from ..functions.geo import box_centre, haversine, in_world
from ..functions.records import AREA_STATES, area_of_state, state_of_code
from .contracts import must
from .mesh import located
from .scenario import Scenario


def _kept(df: DataFrame, key: str, order: list[str] | None = None) -> DataFrame:
    """One located row for each non-empty key: the first by ``order``."""
    here = df.withColumn(key, F.nullif(F.trim(F.col(key).cast("string")), F.lit(""))).filter(F.col(key).isNotNull() & in_world(F.col("lat"), F.col("lon")) & F.col("lat").isNotNull() & F.col("lon").isNotNull())
    first = Window.partitionBy(key).orderBy(*(order or ["lat", "lon"]))
    return here.withColumn("_r", F.row_number().over(first)).filter("_r = 1").drop("_r")


def _counted(df: DataFrame, expected: int | None, what: str) -> DataFrame:
    if expected is not None and (n := df.count()) != expected:
        raise ValueError(f"{n} {what} in place of {expected}")
    return df


def regional_points(points: DataFrame, municipalities: DataFrame, cell: float, expected: int | None = None) -> DataFrame:
    """(office, name, lat, lon, municipality_code, method, state, area): offices by the municipality that holds them (DENTRO), else the nearest one (MAIS_PROXIMO).

    ``points`` has (office, name, lat, lon), ``municipalities`` (municipality_code, ring). Offices without id, name or valid place are left out;
    a repeated id, a number other than ``expected`` and an office without an area fail.
    """
    here = points.filter(F.coalesce(F.trim("office"), F.lit("")) != "").filter(F.coalesce(F.trim("name"), F.lit("")) != "").filter(in_world(F.col("lat"), F.col("lon")) & F.col("lat").isNotNull() & F.col("lon").isNotNull())
    once = Window.partitionBy("office")
    here = _counted(here.withColumn("office", F.trim("office")), expected, "regional points").withColumn("_n", F.count("*").over(once)).filter(must(F.col("_n") == 1, "an office id stands twice")).drop("_n")
    at = located(here.select(F.col("office").alias("unit_id"), "lat", "lon"), municipalities, "municipality_code", cell)
    out = here.join(at.withColumnRenamed("unit_id", "office"), "office").withColumn("state", state_of_code(F.col("municipality_code")))
    return out.withColumn("area", area_of_state(F.col("state"))).filter(must(F.col("area").isNotNull(), "an office without an area"))


def hierarchy(rows: DataFrame) -> DataFrame:
    """(supervision, area, coordination): one row for each supervision, areas in canonical form; a supervision of two areas fails."""
    key = v.text_key(F.col("area"))
    canonical = F.coalesce(*[F.when(key == v.text_key(F.lit(a)), a) for a in AREA_STATES], F.trim("area"))
    clean = rows.withColumn("supervision", F.nullif(F.trim("supervision"), F.lit(""))).filter("supervision is not null").withColumn("area", canonical)
    one = clean.groupBy("supervision").agg(F.min(F.struct("area", "coordination")).alias("x"), F.count_distinct("area").alias("n"))
    return one.filter(must(F.col("n") <= 1, "a supervision of several areas")).select("supervision", "x.area", "x.coordination")


def current_poles(rows: DataFrame, expected: int | None = None) -> DataFrame:
    """The first located row of each supervision (supervision, lat, lon); a number other than ``expected`` fails."""
    return _counted(_kept(rows, "supervision"), expected, "current poles")


def stores(rows: DataFrame, reference: DataFrame) -> DataFrame:
    """Located stores (store, code, lat, lon, supervision) with municipality_code and state: codes of the reference, by seven digits or by the first six of them; others are left out, and a store counts once."""
    known = reference.select(v.code_last(F.col("code"), 7).alias("municipality_code"))
    six = known.groupBy(F.substring("municipality_code", 1, 6).alias("_six")).agg(F.min("municipality_code").alias("_by_six"))
    d = v.digits(F.col("code").cast("string"))
    coded = rows.withColumn("_code", F.when(F.length(d) > 6, v.code_last(d, 7))).withColumn("_six", F.substring(d, 1, 6))
    j = coded.join(known, F.col("_code") == F.col("municipality_code"), "left").join(six, "_six", "left")
    j = j.withColumn("municipality_code", F.when(F.length(d) == 6, F.col("_by_six")).otherwise(F.col("municipality_code"))).filter("municipality_code is not null").drop("_code", "_six", "_by_six")
    return _kept(j, "store").withColumn("state", state_of_code(F.col("municipality_code")))


def stores_to_units(located_stores: DataFrame, units: DataFrame, districts: DataFrame, cell: float) -> DataFrame:
    """(store, unit_key, method): the unit of each store whose municipality has one.

    ``located_stores`` has (store, municipality_code, lat, lon), ``units`` (unit_key, municipality_code, district_code, is_district, lat, lon), ``districts`` (district_code, municipality_code, ring).
    A municipality that is one unit takes its stores by code (CODIGO_MUNICIPIO). In one split into districts, the district of the same municipality that holds the store takes it
    (PONTO_DENTRO_DISTRITO), else the nearest district of that municipality (DISTRITO_MAIS_PROXIMO). No store goes to another municipality's district.
    """
    whole = units.filter("not is_district").select("municipality_code", "unit_key")
    parts = units.filter("is_district")
    by_code = located_stores.join(whole, "municipality_code").select("store", "unit_key", F.lit("CODIGO_MUNICIPIO").alias("method"))
    rest = located_stores.join(parts.select("municipality_code").distinct(), "municipality_code", "left_semi").join(whole.select("municipality_code"), "municipality_code", "left_anti")
    rings = districts.join(parts.select("district_code", "unit_key"), "district_code")
    # A point may lie in rings of several municipalities; only those of its own count.
    cells = rest.select("store", "municipality_code", "lat", "lon")
    held = _within_own(cells, rings, cell)
    inside = held.select("store", "unit_key", F.lit("PONTO_DENTRO_DISTRITO").alias("method"))
    left = cells.join(held.select("store"), "store", "left_anti").alias("s").join(parts.select("municipality_code", "unit_key", "lat", "lon").alias("d"), "municipality_code")
    near = left.groupBy("store").agg(F.min(F.struct(haversine(F.col("s.lat"), F.col("s.lon"), F.col("d.lat"), F.col("d.lon")), "unit_key")).alias("b")).select("store", "b.unit_key", F.lit("DISTRITO_MAIS_PROXIMO").alias("method"))
    return by_code.union(inside).union(near)


def _within_own(points: DataFrame, rings: DataFrame, cell: float) -> DataFrame:
    """(store, unit_key): the smallest unit of the point's own municipality whose ring holds it."""
    from ..functions.geo import in_ring
    from .spatial import _boxed

    p = points.withColumn("_x", F.floor(F.col("lon") / cell)).withColumn("_y", F.floor(F.col("lat") / cell))
    hits = p.join(_boxed(rings.select("municipality_code", "unit_key", "ring"), cell), ["municipality_code", "_x", "_y"])
    return hits.filter(in_ring(F.col("lon"), F.col("lat"), F.col("ring"))).groupBy("store").agg(F.min("unit_key").alias("unit_key"))


def census(rows: DataFrame) -> DataFrame:
    """(district_code, municipality_code, population) of census rows (CD_DIST, CD_MUN, V0001) as text: codes padded to nine and seven digits, unreadable numbers null; a district that stands twice fails."""
    code = v.code_padded(F.col("CD_DIST"), 9)
    clean = rows.select(code.alias("district_code"), v.code_padded(F.col("CD_MUN"), 7).alias("municipality_code"), F.trim("V0001").try_cast("long").alias("population"))
    return clean.withColumn("_n", F.count("*").over(Window.partitionBy("district_code"))).filter(must(F.col("_n") == 1, "a district stands twice")).drop("_n")


def census_on_mesh(population: DataFrame, mesh: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Districts (district_code, municipality_code, population, ring) that stand on both sides, and those on one only (district_code, side)."""
    both = population.join(mesh.select("district_code", "ring"), "district_code")
    lost = population.join(mesh, "district_code", "left_anti").select("district_code", F.lit("SEM_GEOMETRIA").alias("side"))
    return both, lost.union(mesh.join(population, "district_code", "left_anti").select("district_code", F.lit("SEM_POPULACAO")))


def municipality_centres(places: DataFrame, mesh: DataFrame) -> DataFrame:
    """(code, lat, lon, source): a municipality's coordinates from the tables (sql), else the middle of its polygon's box (mesh). Codes of seven digits; the zero code goes."""
    code = v.code_padded(F.col("code"), 7)
    valid = lambda df: df.withColumn("code", code).filter("code <> '0000000' and lat is not null and lon is not null and not isnan(lat) and not isnan(lon)")
    own = valid(places).groupBy("code").agg(F.min(F.struct("lat", "lon")).alias("at"))
    boxes = mesh.filter("size(ring) > 0").select("code", box_centre(F.col("ring")).alias("c")).select("code", F.col("c.lat").alias("lat"), F.col("c.lon").alias("lon"))
    other = valid(boxes).groupBy("code").agg(F.min(F.struct("lat", "lon")).alias("at")).join(own.select("code"), "code", "left_anti")
    return own.select("code", "at.lat", "at.lon", F.lit("sql").alias("source")).union(other.select("code", "at.lat", "at.lon", F.lit("mesh")))


def scenario_of_sheets(poles: DataFrame, units: DataFrame) -> Scenario:
    """A scenario of a result workbook's sheets: poles (GERENCIA_ID, NM_MUN_POLO, NM_DIST_POLO, LATITUDE, LONGITUDE, DESC_GERENCIA_AREA_PROPOSTA), units (DEMAND_ID, TIPO_UNIDADE, COD_IBGE, CD_DIST, NM_MUN, UF, GERENCIA_ID,
    POPULACAO_UNIDADE, QTD_LOJAS, LATITUDE, LONGITUDE), all text, numbers with a decimal point or comma; both with ``row``."""
    number = lambda c: v.decimal_comma(F.trim(c))
    p = poles.select(F.col("row").alias("position"), F.col("GERENCIA_ID").alias("pole_id"), v.first_filled(F.col("NM_MUN_POLO"), F.col("NM_DIST_POLO"), F.col("GERENCIA_ID")).alias("name"), F.coalesce(v.first_filled(F.col("DESC_GERENCIA_AREA_PROPOSTA")), F.lit("SEM ÁREA")).alias("area"), number("LATITUDE").alias("lat"), number("LONGITUDE").alias("lon"))
    kind = F.when(F.upper(F.trim("TIPO_UNIDADE")) == "DISTRITO", "DISTRITO").otherwise("MUNICIPIO")
    u = units.select(
        F.col("row").alias("position"), F.coalesce(v.first_filled(F.col("DEMAND_ID")), F.concat(F.lit("UNIDADE-"), F.col("row"))).alias("source_id"), kind.alias("kind"), v.code_six_to_seven(F.col("COD_IBGE")).alias("municipality_code"),
        v.first_filled(F.col("CD_DIST")).alias("district_code"), F.col("NM_MUN").alias("name"), F.col("UF").alias("state"), v.first_filled(F.col("GERENCIA_ID")).alias("pole_id"), number("POPULACAO_UNIDADE").alias("population"), number("QTD_LOJAS").alias("stores"), number("LATITUDE").alias("lat"), number("LONGITUDE").alias("lon"),
    )
    total = p.agg(F.count("*").cast("double").alias("total_poles")).crossJoin(u.agg(F.count("*").cast("double").alias("total_units")))  # one row by one row
    return Scenario(p, u, total)


def model_kind(folder: str, version: str | None) -> str:
    """v5, v4 or v3, by the version that a scenario names, else by its folder."""
    for kind in ("v5", "v4"):
        if kind in (version or "").lower() or kind in folder.lower():
            return kind
    return "v3"
