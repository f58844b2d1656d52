"""Codes, ids, text keys, numbers, bands and statuses as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accented letters and their plain forms.
ACCENTED = "ÁÀÂÃÄÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇÑ"
PLAIN = "AAAAAEEEEIIIIOOOOOUUUUCN"
#: Upper limits and colours of the population heat bands.
HEAT = ((30_000, "#fee8c8"), (100_000, "#fdbb84"), (500_000, "#fc8d59"), (1_000_000, "#e34a33"), (None, "#b30000"))


def text_key(c: Column) -> Column:
    """Upper case without accents or white space around, inner white space single."""
    return F.regexp_replace(F.translate(F.upper(F.trim(c)), ACCENTED, PLAIN), r"\s+", " ")


def digits(c: Column) -> Column:
    return F.regexp_replace(c, r"[^0-9]", "")


def normal_id(c: Column) -> Column:
    """Trimmed text without a trailing ``.0``; null if empty."""
    return F.nullif(F.regexp_replace(F.trim(c), r"\.0$", ""), F.lit(""))


def stable_key(c: Column) -> Column:
    """Sort key: numeric ids first and by number, then lower-case text."""
    n = F.when(c.rlike(r"^\d{1,18}$"), F.expr("0")).otherwise(1)
    return F.struct(n.alias("kind"), F.when(c.rlike(r"^\d{1,18}$"), c.try_cast("long")).alias("number"), F.lower(c).alias("text"))


def code_padded(c: Column, width: int) -> Column:
    """Digits padded to the left with zeros, then cut on the right."""
    return F.lpad(digits(c), width, "0")


def code_six_to_seven(c: Column) -> Column:
    """Six digits get a 0 appended; else the first seven."""
    d = digits(c)
    return F.when(F.length(d) == 6, F.concat(d, F.lit("0"))).otherwise(F.substring(d, 1, 7))


def code_last(c: Column, width: int) -> Column:
    """Padded, then the last digits."""
    d = digits(c)
    return F.when(F.length(d) < width, F.lpad(d, width, "0")).otherwise(F.right(d, F.lit(width)))


def code_lookup(c: Column, known: Column, width: int = 7) -> Column:
    """The known code that a join has found, else the padded one."""
    return F.coalesce(known, code_padded(c, width))


def decimal_comma(c: Column) -> Column:
    return F.replace(c, F.lit(","), F.lit(".")).try_cast("double")


def safe_float(c: Column) -> Column:
    """Null for blank, unreadable and non-finite numbers."""
    v = F.trim(c).try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def not_negative(c: Column) -> Column:
    return F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(0.0))


def first_filled(*cols: Column) -> Column:
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in cols])


def unit_key(kind: Column, municipality: Column, district: Column, state: Column, name: Column) -> Column:
    """``DIST:code`` for districts, ``MUN:code`` for municipalities, else from state and name."""
    is_district = F.upper(kind).isin("DISTRICT", "DISTRITO")
    return F.when(is_district & (F.coalesce(district, F.lit("")) != ""), F.concat(F.lit("DIST:"), district)).when(F.coalesce(municipality, F.lit("")) != "", F.concat(F.lit("MUN:"), municipality)).otherwise(F.concat(F.lit("NAME:"), F.coalesce(state, F.lit("")), F.lit(":"), text_key(name)))


def population_rule(pop: Column, district: Column | None = None) -> Column:
    """Struct (band, factor, radius_km): upper-exclusive limits; districts have a band of their own."""
    rows = ((30_000, "ABAIXO_30_MIL", 0.2, None), (50_000, "30_A_50_MIL", 1.0, 50.0), (100_000, "50_A_100_MIL", 1.0, 100.0), (300_000, "100_A_300_MIL", 1.0, 100.0))
    as_struct = lambda b, f, r: F.struct(F.lit(b).alias("band"), F.lit(f).alias("factor"), F.lit(r).cast("double").alias("radius_km"))
    out = F.when(district, as_struct("DISTRITO_GRANDE_CIDADE", 1.0, 50.0)) if district is not None else F.when(F.lit(False), as_struct("", 0.0, None))
    for limit, *row in rows:
        out = out.when(pop < limit, as_struct(*row))
    return out.otherwise(as_struct("300_MIL_OU_MAIS", 1.0, 50.0))


def heat_band(pop: Column, inclusive: bool = True) -> Column:
    """Index of the heat band, upper-inclusive unless told otherwise."""
    v = F.greatest(F.coalesce(pop, F.lit(0.0)), F.lit(0.0))
    out = F.when(v <= HEAT[0][0] if inclusive else v < HEAT[0][0], 0)
    for i, (limit, _) in enumerate(HEAT[1:-1], 1):
        out = out.when(v <= limit if inclusive else v < limit, i)
    return out.otherwise(len(HEAT) - 1)


def heat_colour(band: Column) -> Column:
    return F.element_at(F.array(*[F.lit(c) for _, c in HEAT]), band + 1)


def ink(colour: Column) -> Column:
    """Dark ink on light colours, by luminance."""
    part = lambda at: F.conv(F.substring(colour, at, 2), 16, 10).cast("double")
    return F.when((0.2126 * part(2) + 0.7152 * part(4) + 0.0722 * part(6)) / 255 > 0.55, "#1a1208").otherwise("#fff8f0")


def movement_band(km: Column) -> Column:
    return F.when(km.isNull(), "NAO_APLICAVEL").when(km <= 1, "MESMO_PONTO_APROXIMADO").when(km <= 50, "AJUSTE_LOCAL_ATE_50_KM").when(km <= 150, "MOVIMENTO_REGIONAL_50_A_150_KM").when(km <= 300, "MOVIMENTO_RELEVANTE_150_A_300_KM").otherwise("REDESENHO_ESTRUTURAL_ACIMA_300_KM")


def hierarchy_status(now: Column, then: Column) -> Column:
    return F.when((now == 0) & (then > 0), "CRIAR").when((now > 0) & (then == 0), "REMOVER").when(then > now, "AMPLIAR").when(then < now, "REDUZIR").otherwise("MANTER")


def distance_status(now: Column, then: Column, tolerance: float = 1e-9) -> Column:
    return F.when(now - then > tolerance, "MELHOROU").when(now - then < -tolerance, "PIOROU").otherwise("MANTEVE")


def load_band(index: Column, floor: float = 0.75, ceiling: float = 1.25) -> Column:
    return F.when(index < floor, "ABAIXO").when(index > ceiling, "ACIMA").otherwise("DENTRO")


def delta_pct(old: Column, new: Column) -> Column:
    return F.try_divide(new - old, old)


def brazilian(number: Column, decimals: int) -> Column:
    """Thousands with points, decimals after a comma."""
    return F.translate(F.format_number(number, decimals), ",.", ".,")


def site_penalty(pop: Column, low: float = 30_000, full: float = 300_000, most_km: float = 35.0) -> Column:
    x = (F.ln(F.greatest(pop, F.lit(float(low)))) - F.ln(F.lit(float(low)))) / (F.ln(F.lit(float(full))) - F.ln(F.lit(float(low))))
    return most_km * F.pow(1 - F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)), 2)


def service_cost(km: Column, crosses: Column, radius: Column, crossing_km: float = 40.0) -> Column:
    excess = F.greatest(km - radius, F.lit(0.0))
    return km + F.when(crosses, crossing_km).otherwise(0.0) + F.when(radius > 0, F.pow(excess, 2) / F.greatest(radius, F.lit(1.0))).otherwise(0.0)
