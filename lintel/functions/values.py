"""Scalar functions over names, values and ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Factors to millimetres, square metres, minutes and W/(m2 K).
UNITS = {
    "m": 1000.0, "cm": 10.0, "mm": 1.0, "in": 25.4, "ft": 304.8, "inch": 25.4, "feet": 304.8,
    "m2": 1.0, "m^2": 1.0, "cm2": 0.0001, "mm2": 0.000001, "ft2": 0.0929, "sqft": 0.0929,
    "min": 1.0, "minute": 1.0, "minutes": 1.0, "h": 60.0, "hr": 60.0, "hour": 60.0, "hours": 60.0, "s": 1 / 60, "sec": 1 / 60, "second": 1 / 60,
    "w/(m2k)": 1.0, "w/m2k": 1.0, "btu/(h*ft2*f)": 5.678,
}


def normalize_name(name: Column, dashes: bool = True) -> Column:
    """Lower case without blanks, underscores and (unless `dashes` is false) dashes."""
    return F.translate(F.lower(name), " _-" if dashes else " _", "")


def fire_rating_duration(value: Column) -> Column:
    """'2HR' -> 'P2H', '90 min' -> 'P1H30M', bare numbers are minutes; what has no leading number stays, in upper case."""
    text = F.upper(F.trim(value))
    number = F.regexp_extract(text, r"^(\d+\.?\d*)", 1)
    unit = F.regexp_extract(text, r"^\d+\.?\d*\s*(HR|HOURS?|H|MINUTES?|MIN|M)?", 1)
    amount = F.when(number != "", number.cast("double"))
    minutes = F.floor(F.when(unit.startswith("H"), F.floor(amount) * 60 + F.floor((amount - F.floor(amount)) * 60)).otherwise(F.floor(amount)))
    hours, rest = F.floor(minutes / 60).cast("string"), F.pmod(minutes, F.lit(60)).cast("string")
    by_hour = unit.startswith("H") | (minutes >= 60)
    return (
        F.when(value.isNull(), None)
        .when(number == "", text)
        .when(by_hour & (rest != "0"), F.concat(F.lit("P"), hours, F.lit("H"), rest, F.lit("M")))
        .when(by_hour, F.concat(F.lit("P"), hours, F.lit("H")))
        .otherwise(F.concat(F.lit("P"), rest, F.lit("M")))
    )


def normalize_numeric(value: Column, target_unit: Column) -> Column:
    """Leading number; with a unit and a target unit, times the unit's factor, rounded to 4 places. Null if no number leads."""
    number = F.regexp_extract(value, r"^(-?\d+\.?\d*)", 1)
    unit = F.lower(F.regexp_extract(value, r"^-?\d+\.?\d*\s*(\w+)", 1))
    factors = F.create_map(*[x for k, v in UNITS.items() for x in (F.lit(k), F.lit(v))])
    amount = F.when(number != "", number.cast("double"))
    return F.when((unit != "") & target_unit.isNotNull() & F.map_contains_key(factors, unit), F.round(amount * factors[unit], 4)).otherwise(amount)


def normalize_boolean(value: Column) -> Column:
    """'true' and 'false' for the usual spellings; others stay."""
    low = F.lower(value)
    return F.when(low.isin("true", "yes", "1", "t"), "true").when(low.isin("false", "no", "0", "f"), "false").otherwise(value)


def normalize_value(value: Column, data_type: Column, unit: Column) -> Column:
    """By data type: duration, boolean, number (as text), or unchanged. Null stays null."""
    kind = F.upper(data_type)
    number = normalize_numeric(value, unit)
    return F.when(kind == "DURATION", fire_rating_duration(value)).when(kind == "BOOLEAN", normalize_boolean(value)).when((kind == "REAL") & number.isNotNull(), number.cast("string")).otherwise(value)


def encode_fire_rating(value: Column) -> Column:
    """Hours in a resistance class, the first that the text contains; else 0."""
    out = F.lit(0.0)
    for minutes, hours in reversed(((30, 0.5), (60, 1.0), (90, 1.5), (120, 2.0), (180, 2.5), (240, 3.0))):
        out = F.when(F.contains(F.upper(value), F.lit(f"REI{minutes}")), hours).otherwise(out)
    return F.when(value.isNull(), 0.0).otherwise(out)


def feature_hash(value: Column) -> Column:
    """[0, 1) from the first 32 bits of a text's md5, in thousandths; null is 0."""
    return F.when(value.isNull(), 0.0).otherwise(F.pmod(F.conv(F.substring(F.md5(value), 1, 8), 16, 10).cast("long"), F.lit(1000)) / 1000)


def short_id(*parts: Column, length: int = 8) -> Column:
    """The first hex digits of the md5 of the parts joined by '_'."""
    return F.substring(F.md5(F.concat_ws("_", *parts)), 1, length)


def entity_uri(project: str, key: Column) -> Column:
    """Project address and percent-encoded id."""
    encoded = F.replace(F.replace(F.replace(F.url_encode(key), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    return F.concat(F.lit(project.rstrip("/") + "/"), encoded)


def literal_type(value: Column) -> Column:
    """The XML schema type of a value given as text."""
    return F.when(F.lower(value).isin("true", "false"), "xsd:boolean").when(value.rlike(r"^-?\d+$"), "xsd:integer").when(value.rlike(r"^-?\d+\.\d+$"), "xsd:double").otherwise("xsd:string")


def escaped(value: Column) -> Column:
    """Backslashes, quotes and line ends escaped for N-Triples."""
    out = F.replace(value, F.lit("\\"), F.lit("\\\\"))
    for a, b in (('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def coerce(value: Column, kind: str, default: Column) -> Column:
    """Text to a feature of the kind, `default` where it can't be read."""
    if kind == "numeric":
        return F.coalesce(value.try_cast("double"), default)
    if kind == "boolean":
        low = F.lower(value)
        return F.coalesce(F.when(low.isin("true", "yes", "1", "t"), 1.0).when(low.isin("false", "no", "0", "f"), 0.0), default)
    if kind == "datetime":
        return F.coalesce(value.try_cast("timestamp"), default)
    return F.coalesce(value, default)


def decimal_degrees(parts: Column) -> Column:
    """Degrees, minutes, seconds, millionths of a second; missing ones are 0."""
    at = lambda i: F.coalesce(F.get(parts, i), F.lit(0)).cast("double")
    return at(0) + at(1) / 60 + at(2) / 3600 + at(3) / 3.6e9
