"""The test tables as a territory: units, poles, stores, owners, districts and adjacency; and the two scenarios that most queries compare."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import haversine
from ..operators.graph import _checkpointed, near_components
from ..operators.portfolio import dominant
from ..operators.spatial import nearest, within_km
from ..sources.tables import table

#: Units of a state at most this far apart have an edge.
REACH_KM = 500.0


@dataclass
class Territory:
    spark: SparkSession
    folder: str

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)

    @cached_property
    def states(self) -> DataFrame:
        return self.table("nation").join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").cast("long").alias("state_id"), F.col("n_name").alias("state"), F.col("r_name").alias("area"))

    @cached_property
    def poles(self) -> DataFrame:
        k = F.col("s_suppkey")
        rows = self.table("supplier").join(self.states, F.col("s_nationkey") == F.col("state_id"))
        return rows.select(k.cast("string").alias("pole_id"), k.alias("pole_num"), F.col("s_name").alias("name"), "area", "state", (F.lit(-33.0) + ((k * 6007) % 38000).cast("double") / 1000.0).alias("lat"), (F.lit(-73.0) + ((k * 15013) % 38000).cast("double") / 1000.0).alias("lon"))

    @cached_property
    def stores(self) -> DataFrame:
        return self.table("orders").select(F.col("o_orderkey").alias("store_id"), F.col("o_custkey").alias("unit_id"), F.col("o_orderstatus").alias("status"), (F.year("o_orderdate") * 100 + F.month("o_orderdate")).cast("long").alias("period"))

    @cached_property
    def deals(self) -> int:
        """Into how many parts lines are dealt: as many as Spark is set to, or more, so that a part has half a million lines however many there are."""
        return max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-self.table("lineitem").count() // 500_000))

    @cached_property
    def owners(self) -> DataFrame:
        # Dealt by order: joined and told apart where they lie. Few bytes on disk may be many rows, so nothing is broadcast.
        o = self.table("orders").select("o_orderkey", "o_custkey").repartition(self.deals, "o_orderkey")
        lines = self.table("lineitem").select("l_orderkey", "l_suppkey").repartition(self.deals, "l_orderkey")
        return o.hint("merge").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderkey").alias("store_id"), F.col("o_custkey").alias("unit_id"), F.col("l_suppkey").alias("pole_num")).distinct().withColumn("pole_id", F.col("pole_num").cast("string"))

    @cached_property
    def units(self) -> DataFrame:
        k = F.col("c_custkey")
        code = F.lpad(k.cast("string"), 7, "0")
        sums = self.table("orders").groupBy("o_custkey").agg(F.sum("o_totalprice").cast("double").alias("amt"), F.count("*").alias("n"))
        rows = self.table("customer").join(self.states, F.col("c_nationkey") == F.col("state_id")).join(sums, k == F.col("o_custkey"), "left")
        return rows.select(
            k.alias("unit_id"), F.concat(F.lit("MUN:"), code).alias("unit_key"), code.alias("municipality_code"), F.col("c_name").alias("name"), "area", "state",
            (F.lit(-33.0) + ((k * 7919) % 38000).cast("double") / 1000.0).alias("lat"), (F.lit(-73.0) + ((k * 104729) % 38000).cast("double") / 1000.0).alias("lon"),
            F.coalesce(F.round("amt", 2), F.lit(0.0)).alias("population"), F.coalesce("n", F.lit(0)).alias("stores"),
        )

    @cached_property
    def places(self) -> DataFrame:
        """Where units lie, without what they sum up from other tables."""
        k = F.col("c_custkey")
        rows = self.table("customer").join(self.states, F.col("c_nationkey") == F.col("state_id"))
        return rows.select(k.alias("unit_id"), "area", "state", (F.lit(-33.0) + ((k * 7919) % 38000).cast("double") / 1000.0).alias("lat"), (F.lit(-73.0) + ((k * 104729) % 38000).cast("double") / 1000.0).alias("lon"))

    @cached_property
    def excluded(self) -> DataFrame:
        return self.table("customer").filter("c_mktsegment = 'MACHINERY'").select(F.lpad(F.col("c_custkey").cast("string"), 7, "0").alias("municipality_code"))

    @cached_property
    def districts(self) -> DataFrame:
        return self.table("part").select(F.col("p_brand").alias("city_code"), F.col("p_partkey").cast("string").alias("district_code"), F.col("p_size").cast("double").alias("raw_population"), F.col("p_retailprice").cast("double").alias("area_km2"))

    @cached_property
    def edges(self) -> DataFrame:
        u = self.units.select("unit_id", "state", "lat", "lon")
        return within_km(u, u, REACH_KM, ["state"]).filter("a.unit_id <> b.unit_id").select(F.col("a.unit_id").alias("src"), F.col("b.unit_id").alias("dst"), F.round("km", 4).alias("km"))

    def portfolio_edges(self, assigned: DataFrame) -> DataFrame:
        """The edges between units of one portfolio; ``assigned`` has (unit_id, pole_id). Only units of one state and pole are ever paired."""
        u = _checkpointed(self.places.select("unit_id", "state", "lat", "lon").join(assigned.select("unit_id", "pole_id"), "unit_id"))
        return within_km(u, u, REACH_KM, ["state", "pole_id"]).filter("a.unit_id <> b.unit_id").select(F.col("a.unit_id").alias("src"), F.col("b.unit_id").alias("dst"))

    @cached_property
    def parts(self) -> DataFrame:
        """(unit_id, component): the connected parts of the edges, without forming them."""
        return near_components(self.places, REACH_KM, ["state"])

    @cached_property
    def counts(self) -> DataFrame:
        """Stores of each unit and owner, with the owner's distance; what follows by unit finds a unit's rows in one part."""
        n = self.owners.select("unit_id", "pole_num").repartition(self.deals, "pole_num").groupBy("unit_id", "pole_num").agg(F.count("*").alias("n"))
        p = self.poles.select("pole_id", "pole_num", F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"))
        at = n.join(p, "pole_num").repartition(self.deals, "unit_id")
        return at.join(self.places.select("unit_id", "lat", "lon"), "unit_id").select("unit_id", "pole_id", "pole_num", "n", haversine(F.col("lat"), F.col("lon"), F.col("p_lat"), F.col("p_lon")).alias("km"))

    @cached_property
    def current(self) -> DataFrame:
        """Every unit with its dominant owner, or the nearest pole where it has none: (unit_id, pole_id, km, method)."""
        # Kept, since it is read twice: as it is, and for the units that it leaves out.
        own = _checkpointed(dominant(self.counts).select("unit_id", "pole_id", "km", F.lit("DOMINANT").alias("method")))
        rest = self.places.join(own, "unit_id", "left_anti")
        return own.union(nearest(rest, self.poles).select("unit_id", "pole_id", "km", F.lit("NEAREST")))

    @cached_property
    def proposed(self) -> DataFrame:
        """Every unit with the nearest pole of its area."""
        return nearest(self.places, self.poles, ["area"])


#: The same in SQL, for the differential checks.
HAVERSINE = "2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2))))"


def hav(a: str, b: str) -> str:
    return HAVERSINE.format(a=a, b=b)


CTE = f"""with fx_state as (select cast(n_nationkey as bigint) as state_id, n_name as state, r_name as area from nation join region on n_regionkey = r_regionkey),
fx_pole as (select cast(s_suppkey as varchar) as pole_id, s_suppkey as pole_num, s_name as name, d.area, d.state, -33.0 + cast((s_suppkey * 6007) % 38000 as double) / 1000.0 as lat, -73.0 + cast((s_suppkey * 15013) % 38000 as double) / 1000.0 as lon from supplier join fx_state d on s_nationkey = d.state_id),
fx_store as (select o_orderkey as store_id, o_custkey as unit_id, o_orderstatus as status, cast(year(o_orderdate) * 100 + month(o_orderdate) as bigint) as period from orders),
fx_owner as (select distinct o_orderkey as store_id, o_custkey as unit_id, cast(l_suppkey as varchar) as pole_id from orders join lineitem on o_orderkey = l_orderkey),
fx_unit as (select c_custkey as unit_id, concat('MUN:', lpad(cast(c_custkey as varchar), 7, '0')) as unit_key, lpad(cast(c_custkey as varchar), 7, '0') as municipality_code, c_name as name, d.area, d.state, -33.0 + cast((c_custkey * 7919) % 38000 as double) / 1000.0 as lat, -73.0 + cast((c_custkey * 104729) % 38000 as double) / 1000.0 as lon, coalesce(round(o.amt, 2), 0.0) as population, coalesce(o.n, 0) as stores
  from customer join fx_state d on c_nationkey = d.state_id left join (select o_custkey, cast(sum(o_totalprice) as double) as amt, count(*) as n from orders group by o_custkey) o on o.o_custkey = c_custkey),
fx_excluded as (select lpad(cast(c_custkey as varchar), 7, '0') as municipality_code from customer where c_mktsegment = 'MACHINERY'),
fx_district as (select p_brand as city_code, cast(p_partkey as varchar) as district_code, cast(p_size as double) as raw_population, cast(p_retailprice as double) as area_km2 from part),
fx_edge as (select a.unit_id as src, b.unit_id as dst, round({hav("a", "b")}, 4) as km from fx_unit a join fx_unit b on a.state = b.state and a.unit_id <> b.unit_id where {hav("a", "b")} <= 500),
fx_count as (select o.unit_id, o.pole_id, p.pole_num, count(distinct store_id) as n, any_value({hav("u", "p")}) as km from fx_owner o join fx_unit u on o.unit_id = u.unit_id join fx_pole p on o.pole_id = p.pole_id group by 1, 2, 3),
fx_own as (select unit_id, pole_id, km from (select *, row_number() over (partition by unit_id order by n desc, round(km, 9), pole_num) as r from fx_count) where r = 1),
fx_near as (select unit_id, pole_id, km from (select u.unit_id, p.pole_id, {hav("u", "p")} as km, row_number() over (partition by u.unit_id order by {hav("u", "p")}, p.pole_num) as r from fx_unit u cross join fx_pole p) where r = 1),
fx_cur as (select unit_id, pole_id, km, 'DOMINANT' as method from fx_own union all select unit_id, pole_id, km, 'NEAREST' from fx_near where unit_id not in (select unit_id from fx_own)),
fx_pro as (select unit_id, pole_id, km from (select u.unit_id, p.pole_id, {hav("u", "p")} as km, row_number() over (partition by u.unit_id order by {hav("u", "p")}, p.pole_num) as r from fx_unit u join fx_pole p on u.area = p.area) where r = 1)
"""
