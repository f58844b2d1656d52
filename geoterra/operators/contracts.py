"""Checks of tables: as rows that break a rule, or as joins and frames that fail when they run."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def must(condition: Column, message: str) -> Column:
    """A filter that keeps every row and fails the job on one for which ``condition`` is not true."""
    return F.when(condition, True).otherwise(F.raise_error(F.lit(message)).cast("boolean"))


def left_unique(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join whose right side may hold each key once; the job fails otherwise.

    Keys are counted over the partitioning the join needs anyway, so the check adds no shuffle.
    """
    once = right.withColumn("_n", F.count("*").over(Window.partitionBy(*keys))).filter(must(F.col("_n") == 1, f"keys repeat: {keys}")).drop("_n")
    return left.join(once, keys, "left")


def violations(df: DataFrame, key: str, required: list[str], parent: DataFrame | None = None, universe: DataFrame | None = None) -> DataFrame:
    """(rule, entity, n): missing columns, nulls, repeated keys, keys that ``parent`` lacks, and either side's rest of ``universe``.

    ``parent`` is (pole_id), ``universe`` (key). A null key counts as a null, not as a repeated key.
    """
    spark = df.sparkSession
    text = F.col(key).cast("string").alias("entity")
    found = [spark.createDataFrame([("MISSING_COLUMN", c, 1) for c in required if c not in df.columns], "rule string, entity string, n long")]
    present = [c for c in required if c in df.columns]
    if present:
        nulls = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in present])
        found.append(nulls.unpivot([], present, "entity", "n").filter("n > 0").select(F.lit("NULL").alias("rule"), "entity", "n"))
    found.append(df.filter(F.col(key).isNotNull()).groupBy(key).count().filter("count > 1").select(F.lit("REPEATED").alias("rule"), text, F.col("count").alias("n")))
    if parent is not None:
        found.append(df.filter("pole_id is not null").join(parent.select("pole_id"), "pole_id", "left_anti").groupBy("pole_id").count().select(F.lit("NO_PARENT").alias("rule"), F.col("pole_id").alias("entity"), F.col("count").alias("n")))
    if universe is not None:
        for rule, a, b in (("NOT_COVERED", universe, df), ("NOT_KNOWN", df, universe)):
            found.append(a.select(key).filter(F.col(key).isNotNull()).distinct().join(b.select(key), key, "left_anti").select(F.lit(rule).alias("rule"), text, F.lit(1).cast("long").alias("n")))
    return reduce(DataFrame.unionByName, found)


def exclusive(demand: DataFrame) -> DataFrame:
    """(code, problem): municipalities that stand both whole and as districts, or whole more than once; ``demand`` has (municipality_code, is_district)."""
    kinds = demand.groupBy("municipality_code").agg(F.count_if(F.col("is_district")).alias("districts"), F.count_if(~F.col("is_district")).alias("whole"))
    problem = F.when((F.col("districts") > 0) & (F.col("whole") > 0), "WHOLE_AND_DISTRICTS").when(F.col("whole") > 1, "WHOLE_TWICE")
    return kinds.select(F.col("municipality_code").alias("code"), problem.alias("problem")).filter("problem is not null")


def rule_audit(values: DataFrame, rules: list[tuple[str, str, str, float]]) -> DataFrame:
    """(rule, value, expected, status): each rule (name, column, operator, limit) on the one row of ``values``; operators are =, <=, >= and between 0 and the limit (share). Status OK, VIOLACAO, or SEM_VALOR for a null."""
    told = []
    for name, column, op, limit in rules:
        x, bound = F.col(column).cast("double"), F.lit(float(limit))
        holds = {"=": F.abs(x - bound) <= 1e-9, "<=": x <= bound + 1e-9, ">=": x >= bound - 1e-9, "share": x.between(-1e-9, limit + 1e-9)}[op]
        told.append(F.struct(F.lit(name).alias("rule"), x.alias("value"), F.lit(f"{op} {limit:g}").alias("expected"), F.when(x.isNull(), "SEM_VALOR").when(holds, "OK").otherwise("VIOLACAO").alias("status")))
    return values.select(F.explode(F.array(*told)).alias("r")).select("r.*")


def hard_violations(assigned: DataFrame, units: DataFrame, poles: DataFrame, edges: DataFrame, metropolitan: int) -> DataFrame:
    """(rule, entity, value) of a solution that must not be published.

    ``assigned`` has (unit_id, pole_id), ``units`` (unit_id, strategic, city: null outside split cities), ``poles`` (pole_id), ``edges`` (src, dst) in both directions. Rules:
    CARTEIRA_DESCONTINUA (a portfolio in several parts), ESTRATEGICA_SEM_ATENDIMENTO (a strategic unit without a pole), MINIMO_METROPOLITANO (a pole with too few units of a city),
    POLO_SEM_UNIDADES and POLO_DESCONHECIDO.
    """
    from .graph import fragmentation
    from .siting import metropolitan_minimum

    own = assigned.filter("pole_id is not null")
    found = [
        fragmentation(own, edges).filter("parts > 1").select(F.lit("CARTEIRA_DESCONTINUA").alias("rule"), F.col("pole_id").alias("entity"), F.col("parts").cast("long").alias("value")),
        units.filter("strategic").join(own.select("unit_id"), "unit_id", "left_anti").select(F.lit("ESTRATEGICA_SEM_ATENDIMENTO"), F.col("unit_id").cast("string"), F.lit(1).cast("long")),
        metropolitan_minimum(units.filter("city is not null").join(own, "unit_id").select("city", "unit_id", "pole_id"), metropolitan).filter("status = 'VIOLACAO'").select(F.lit("MINIMO_METROPOLITANO"), F.concat_ws("/", "city", "pole_id"), F.col("units").cast("long")),
        poles.join(own.select("pole_id"), "pole_id", "left_anti").select(F.lit("POLO_SEM_UNIDADES"), "pole_id", F.lit(0).cast("long")),
        own.join(poles.select("pole_id"), "pole_id", "left_anti").groupBy("pole_id").count().select(F.lit("POLO_DESCONHECIDO"), "pole_id", F.col("count").cast("long")),
    ]
    return reduce(DataFrame.union, found)
