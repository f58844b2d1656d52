"""Small rules over codes, names, numbers and whole records, as column expressions or frames."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .values import code_last, code_six_to_seven, text_key

#: States by the first two digits of a municipality's code.
STATE_OF_PREFIX = {
    "11": "RO", "12": "AC", "13": "AM", "14": "RR", "15": "PA", "16": "AP", "17": "TO", "21": "MA", "22": "PI", "23": "CE", "24": "RN", "25": "PB", "26": "PE", "27": "AL",
    "28": "SE", "29": "BA", "31": "MG", "32": "ES", "33": "RJ", "35": "SP", "41": "PR", "42": "SC", "43": "RS", "50": "MS", "51": "MT", "52": "GO", "53": "DF",
}
#: The areas and their states.
AREA_STATES = {
    "NORDESTE 2": ("BA", "AL", "SE"), "NORDESTE 1": ("CE", "PB", "PI", "MA", "RN", "PE"), "SÃO PAULO": ("SP",),
    "CENTRO OESTE/NORTE": ("DF", "AP", "AC", "RO", "MT", "MS", "TO", "AM", "RR", "PA", "GO"), "SUL": ("RS", "SC", "PR"), "SUDESTE": ("MG", "ES", "RJ"),
}


def _looked_up(key: Column, table: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for item in table.items() for x in item]), key)


def upper_columns(df: DataFrame) -> DataFrame:
    """Column names trimmed and in upper case; two that become equal raise."""
    names = [c.strip().upper() for c in df.columns]
    if len(set(names)) < len(names):
        raise ValueError(f"columns that differ in case or blanks only: {sorted(df.columns)}")
    return df.toDF(*names)


def aliased(df: DataFrame, aliases: dict[str, tuple[str, ...]], optional: tuple[str, ...] = ()) -> DataFrame:
    """One column for each name: the first of its aliases that ``df`` has, whatever its case; without one it is null if ``optional``, else this raises."""
    have = {c.strip().upper(): c for c in reversed(df.columns)}
    out = []
    for name, options in aliases.items():
        found = next((have[o.upper()] for o in (name, *options) if o.upper() in have), None)
        if found is None and name not in optional:
            raise ValueError(f"no column for {name}: none of {options}")
        out.append((F.col(f"`{found}`") if found is not None else F.lit(None).cast("string")).alias(name))
    return df.select(*out)


def state_of_code(code: Column) -> Column:
    """The state of a municipality's or district's code; empty for an unknown prefix."""
    return F.coalesce(_looked_up(F.substring(code_six_to_seven(code), 1, 2), STATE_OF_PREFIX), F.lit(""))


def area_of_state(state: Column) -> Column:
    """The area of a state; null for an unknown one."""
    return _looked_up(F.upper(F.trim(state)), {s: a for a, states in AREA_STATES.items() for s in states})


def reused_names(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """``wanted`` (name) with ``reused``: the first known name, in order, that is equal without case and accents, else the name itself, trimmed."""
    first = known.groupBy(text_key(F.col("name")).alias("_k")).agg(F.min("name").alias("_known"))
    return wanted.join(first, text_key(wanted["name"]) == first["_k"], "left").select(*wanted.columns, F.coalesce("_known", F.trim("name")).alias("reused"))


def effective_population(units: DataFrame, lookup: DataFrame) -> DataFrame:
    """``units`` (is_district, municipality_code, population) with ``effective``: for municipalities the looked-up population of the code, where there is one, for districts their own; never below zero."""
    known = lookup.groupBy(code_last(F.col("municipality_code"), 7).alias("_code")).agg(F.max("population").alias("_population"))
    own = F.coalesce(F.col("population").cast("double"), F.lit(0.0))
    joined = units.join(known, code_last(units["municipality_code"], 7) == F.col("_code"), "left")
    return joined.select(*[units[c] for c in units.columns], F.greatest(F.when(F.col("is_district"), own).otherwise(F.coalesce(F.col("_population").cast("double"), own)), F.lit(0.0)).alias("effective"))


def config_hash(config: dict) -> str:
    """SHA-256 of the configuration as JSON with sorted keys."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, ensure_ascii=False, default=str).encode()).hexdigest()


def row_hash(*columns: str) -> Column:
    """SHA-256 of some columns as a JSON object whose keys are sorted."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def rounded_ring(ring: Column, digits: int = 5) -> Column:
    return F.transform(ring, lambda p: F.struct(F.round(p["lon"], digits).alias("lon"), F.round(p["lat"], digits).alias("lat")))


def operational_area(code: Column, name: Column, codes: tuple[str, ...] = ()) -> Column:
    """Lakes and the like that are no municipality: by code, or by their name."""
    by_name = F.contains(text_key(F.coalesce(name, F.lit(""))), F.lit("AREA OPERACIONAL"))
    return (by_name | code_last(code, 7).isin(*codes)) if codes else by_name


def json_safe(df: DataFrame) -> DataFrame:
    """NaN and infinities become null, dates and timestamps ISO text; other columns stay."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("double", "float"):
            c = F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
        elif kind.startswith("timestamp"):
            c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
        elif kind == "date":
            c = F.date_format(c, "yyyy-MM-dd")
        out.append(c.alias(name))
    return df.select(*out)


def compact_features(mesh: DataFrame) -> DataFrame:
    """(id, name, state, ring) of a mesh (code, name, state, ring): codes of seven digits, the state from the code where it is missing, coordinates to five decimals; the zero code and empty rings go."""
    code = code_last(F.col("code"), 7)
    state = F.coalesce(F.nullif(F.upper(F.trim("state")), F.lit("")), state_of_code(F.col("code")))
    return mesh.select(code.alias("id"), F.trim("name").alias("name"), state.alias("state"), rounded_ring(F.col("ring")).alias("ring")).filter("id <> '0000000' and size(ring) > 0")


def strict_float(c: Column, name: str) -> Column:
    """A finite number, or the job fails."""
    v = F.trim(c.cast("string")).try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v).otherwise(F.raise_error(F.concat(F.lit(f"no finite number in {name}: "), F.coalesce(c.cast("string"), F.lit("null")))).cast("double"))


def sorted_by(df: DataFrame, metric: str, descending: bool = True, name: str = "name", key: str = "pole_id") -> DataFrame:
    """Rows by a metric, nulls last, then by name without case and accents, then by id; ids that are numbers by their value."""
    from .values import stable_key

    first = F.col(metric).desc_nulls_last() if descending else F.col(metric).asc_nulls_last()
    return df.orderBy(first, text_key(F.col(name)), stable_key(F.col(key)))
