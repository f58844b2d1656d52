"""Readers and writers."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NAME = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*$")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def checked_name(name: str) -> str:
    """One to three plain identifiers joined by dots; anything else raises."""
    parts = name.split(".")
    if not 1 <= len(parts) <= 3 or not all(NAME.match(p) for p in parts):
        raise ValueError(f"not a table name: {name!r}")
    return name


def text_csv(spark: SparkSession, path: str, columns: list[str], encoding: str = "UTF-8") -> DataFrame:
    """A CSV whose columns are all text; the separator is the most frequent of ``; , | tab`` in its first line."""
    head = spark.read.option("encoding", encoding).text(path).first()
    line = head.value if head else ""
    sep = max(";,|\t", key=line.count)
    return spark.read.csv(path, header=True, sep=sep, encoding=encoding, schema=", ".join(f"`{c}` string" for c in columns), enforceSchema=True)


def scenario(spark: SparkSession, path: str) -> DataFrame:
    """One row for a scenario document, out of its draft envelope if it has one."""
    pole = "struct<id:string,name:string,area:string,regional:string,uf:string,lat:double,lon:double,latitude:double,longitude:double>"
    unit = "struct<id:string,type:string,municipalityCode:string,districtCode:string,name:string,municipalityName:string,districtName:string,uf:string,poleId:string,population:double,stores:double,lat:double,lon:double,latitude:double,longitude:double>"
    columns = {"id": "string", "title": "string", "summary": "struct<totalPoles:double,totalUnits:double,totalStores:double>", "poles": f"array<{pole}>", "units": f"array<{unit}>"}
    body = ",".join(f"{k}:{v}" for k, v in columns.items())
    raw = spark.read.schema(", ".join(f"{k} {v}" for k, v in columns.items()) + f", data struct<{body}>").json(path, multiLine=True)
    inner = F.col("data.poles").isNotNull() | F.col("data.units").isNotNull()
    return raw.select(*[F.when(inner, F.col(f"data.{c}")).otherwise(F.col(c)).alias(c) for c in ("id", "title", "summary", "poles", "units")])


def scenario_poles(document: DataFrame) -> DataFrame:
    rows = document.select(F.posexplode("poles").alias("position", "p"))
    return rows.select("position", F.col("p.id").alias("pole_id"), "p.name", "p.area", F.col("p.uf").alias("state"), F.coalesce("p.lat", "p.latitude").alias("lat"), F.coalesce("p.lon", "p.longitude").alias("lon"))


def scenario_units(document: DataFrame) -> DataFrame:
    rows = document.select(F.posexplode("units").alias("position", "u"))
    return rows.select("position", F.col("u.id").alias("source_id"), F.col("u.type").alias("kind"), F.col("u.municipalityCode").alias("municipality_code"), F.col("u.districtCode").alias("district_code"), F.coalesce("u.name", "u.districtName", "u.municipalityName").alias("name"), F.col("u.uf").alias("state"), F.col("u.poleId").alias("pole_id"), "u.population", "u.stores", F.coalesce("u.lat", "u.latitude").alias("lat"), F.coalesce("u.lon", "u.longitude").alias("lon"))


def json_number(c: str | Column) -> Column:
    """A double as JSON text: plain digits from 1e-4 up to 1e16, else with an exponent as SQL engines and Python write it. Null is null, what is no number is quoted."""
    x = F.col(c) if isinstance(c, str) else c
    text = x.cast("string")
    plain = F.regexp_replace(text.try_cast("decimal(38,21)").cast("string"), r"(\.\d+?)0+$", "$1")
    power = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\.0E", "E"), r"E(\d)", "e+$1"), "E-", "e-"), r"(?<=[+-])(\d)$", "0$1")
    size = F.abs(x)
    return F.coalesce(F.when(F.isnan(x) | (size == float("inf")), F.concat(F.lit('"'), text, F.lit('"'))).when(size == 0, text).when((size >= 1e-4) & (size < 1e16), plain).otherwise(power), F.lit("null"))


def feature_text(kind: str, coordinates: Column, properties: list[str]) -> Column:
    """GeoJSON text of a row's feature; ``coordinates`` is JSON text. Nulls are left out of the properties."""
    return F.concat(F.lit(f'{{"type":"Feature","geometry":{{"type":"{kind}","coordinates":'), coordinates, F.lit('},"properties":'), F.to_json(F.struct(*properties)), F.lit("}")).alias("feature")


def position_text(lon: str | Column, lat: str | Column) -> Column:
    return F.concat(F.lit("["), json_number(lon), F.lit(","), json_number(lat), F.lit("]"))


def point_features(df: DataFrame, properties: list[str]) -> DataFrame:
    """One GeoJSON feature text a row; nulls are left out of the properties."""
    return df.select(feature_text("Point", position_text("lon", "lat"), properties))


def spreadsheet_rows(df: DataFrame) -> DataFrame:
    """SpreadsheetML text of each row, escaped."""

    def cell(name: str, kind: str):
        v = F.coalesce(F.col(name).cast("string"), F.lit(""))
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            v = F.replace(v, F.lit(a), F.lit(b))
        return F.concat(F.lit(f'<Cell><Data ss:Type="{"String" if kind == "string" else "Number"}">'), v, F.lit("</Data></Cell>"))

    return df.select(F.concat(F.lit("<Row>"), *[cell(c, k) for c, k in df.dtypes], F.lit("</Row>")).alias("row"))


def append_run(df: DataFrame, path: str, run_id: str) -> None:
    """Append a frame to a table of runs; an empty frame writes nothing; nested columns become JSON."""
    if df.isEmpty():
        return
    flat = [F.to_json(c).alias(c) if k.startswith(("array", "map", "struct")) else F.col(c) for c, k in df.dtypes]
    df.select(F.lit(run_id).alias("run_id"), *flat).write.mode("append").partitionBy("run_id").parquet(path)
