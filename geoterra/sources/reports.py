"""Reports as text: markdown tables, line features, scenario documents and workbooks of several sheets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import feature_text, position_text, spreadsheet_rows


def markdown_rows(df: DataFrame) -> DataFrame:
    """One markdown row text for each row; bars are escaped, line breaks become blanks, nulls are empty."""
    clean = lambda c: F.replace(F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"[\r\n]+", " "), F.lit("|"), F.lit("\\|"))
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[clean(c) for c in df.columns]), F.lit(" |")).alias("line"))


def markdown_head(columns: list[str]) -> list[str]:
    return [f"| {' | '.join(columns)} |", f"|{'---|' * len(columns)}"]


def line_features(df: DataFrame, properties: list[str]) -> DataFrame:
    """One GeoJSON line text a row, from (lat, lon) to (to_lat, to_lon); rows that lack a coordinate are left out."""
    ends = F.concat(F.lit("["), position_text("lon", "lat"), F.lit(","), position_text("to_lon", "to_lat"), F.lit("]"))
    return df.dropna(subset=["lat", "lon", "to_lat", "to_lon"]).select(feature_text("LineString", ends, properties))


def polygon_features(df: DataFrame, properties: list[str]) -> DataFrame:
    """One GeoJSON polygon text a row from its ring, closed if it is not."""
    points = F.transform("ring", lambda p: position_text(p["lon"], p["lat"]))
    closed = F.when(F.element_at("ring", 1) == F.element_at("ring", -1), points).otherwise(F.concat(points, F.slice(points, 1, 1)))
    return df.filter("size(ring) > 0").select(feature_text("Polygon", F.concat(F.lit("[["), F.concat_ws(",", closed), F.lit("]]")), properties))


def pole_documents(poles: DataFrame, units: DataFrame) -> DataFrame:
    """(pole_id, document): each pole's part of a scenario document, its units sorted by key; a scenario is written as one document a pole, not as one text."""
    held = units.groupBy("pole_id").agg(F.sort_array(F.collect_list(F.struct("unit_key", "population", "stores"))).alias("units"))
    return poles.join(held, "pole_id", "left").select("pole_id", F.to_json(F.struct("pole_id", "name", "area", "lat", "lon", F.coalesce("units", F.array().cast("array<struct<unit_key:string,population:double,stores:bigint>>")).alias("units"))).alias("document"))


def workbook(sheets: dict[str, DataFrame], path: str) -> None:
    """A folder for each sheet with its header and SpreadsheetML rows, written by the tasks; a sheet may be larger than a driver."""
    for name, df in sheets.items():
        head = df.sparkSession.createDataFrame([("".join(f'<Cell><Data ss:Type="String">{c}</Data></Cell>' for c in df.columns),)], "row string")
        head.select(F.concat(F.lit("<Row>"), "row", F.lit("</Row>")).alias("row")).coalesce(1).write.mode("overwrite").text(f"{path}/{name}/header")
        spreadsheet_rows(df).write.mode("overwrite").text(f"{path}/{name}/rows")


def script_safe(text: Column) -> Column:
    """JSON text that may stand inside a script element: no tag can begin in it, and no line separator break it."""
    for a, b in (("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026"), ("\u2028", "\\u2028"), ("\u2029", "\\u2029")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def map_layers(points: dict[str, DataFrame], lines: dict[str, DataFrame], polygons: dict[str, DataFrame], properties: dict[str, list[str]]) -> DataFrame:
    """(layer, feature) of a map: point, line and polygon tables by layer name as script-safe GeoJSON features, with the named properties of each layer. A layer without rows has none."""
    from .tables import point_features

    made = [(n, f(df, properties.get(n, []) or df.columns[:1])) for f, tables in ((point_features, points), (line_features, lines), (polygon_features, polygons)) for n, df in tables.items()]
    return reduce(DataFrame.unionByName, [df.select(F.lit(n).alias("layer"), script_safe(F.col("feature")).alias("feature")) for n, df in made])


def unattended(units: DataFrame, assigned: DataFrame) -> DataFrame:
    """The units that no pole serves, with a place to show them at."""
    return units.join(assigned.filter("pole_id is not null").select("unit_key"), "unit_key", "left_anti").dropna(subset=["lat", "lon"])
