"""Queries over the report texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import reports
from .registry import query, rows
from .summaries import boxes


@query(", a as (select 1) select concat('| ', pole_id, ' | ', name, '\\| | ', area, ' |') as line from fx_pole")
def k06_markdown_rows(t):
    return reports.markdown_rows(t.poles.select("pole_id", F.concat("name", F.lit("|")).alias("name"), "area"))


@query(""", a as (select 1) select concat('{"type":"Feature","geometry":{"type":"LineString","coordinates":[[', cast(u.lon as varchar), ',', cast(u.lat as varchar), '],[', cast(p.lon as varchar), ',', cast(p.lat as varchar), ']]},"properties":{"unit_id":', cast(u.unit_id as varchar), ',"pole_id":"', p.pole_id, '"}}') as feature from fx_pro x join fx_unit u using (unit_id) join fx_pole p on p.pole_id = x.pole_id""")
def k08_service_lines(t):
    ends = t.poles.select("pole_id", F.col("lat").alias("to_lat"), F.col("lon").alias("to_lon"))
    return reports.line_features(t.proposed.join(t.units.select("unit_id", "lat", "lon"), "unit_id").join(ends, "pole_id"), ["unit_id", "pole_id"])


@query()
def k09_polygon_features(t):
    return reports.polygon_features(boxes(t), ["pole_num"])


@query()
def k10_pole_documents(t):
    return reports.pole_documents(t.poles, rows(t))


@query(", a as (select 1) select x.pole_id, u.unit_key, round(x.km, 1) as km from fx_pro x join fx_unit u using (unit_id)")
def k17_area_workbook_units(t):
    return rows(t).select("pole_id", "unit_key", F.round("km", 1).alias("km"))
