"""Values by dotted path."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _pattern(key: str) -> str:
    return "^" + ".*".join(re.escape(x) for x in key.split("*")) + "$"


def _least_key(keyed: Column, pattern: str) -> Column:
    return F.array_min(F.filter(F.map_keys(keyed), lambda k: k.rlike(pattern)))


def value_at(data: Column, path: str) -> Column:
    """The variant at a dotted path of nested data, null where there is none.

    '*' in a part stands for any characters of a key, of several keys the least counts, and on anything but an object such a part changes nothing. A number
    is an index of a list or a key of an object. Data and the result are variants: cast the result, or take it by try_variant_get.
    """
    now = data if path else F.lit(None).cast("variant")
    for part in path.split(".") if path else []:
        keyed = F.try_variant_get(now, "$", "map<string,variant>")
        if "*" in part:
            key = _least_key(keyed, _pattern(part))
            now = F.when(keyed.isNull(), now).otherwise(F.try_element_at(keyed, key))
        elif re.fullmatch("[0-9]{1,9}", part):
            now = F.coalesce(F.try_variant_get(now, f"$[{int(part)}]", "variant"), F.try_element_at(keyed, F.lit(part)))
        elif "'" in part:  # not a name that a variant's own paths can hold
            now = F.try_element_at(keyed, F.lit(part))
        else:
            now = F.try_variant_get(now, f"$['{part}']", "variant")
    return now


def extract_paths(rows: DataFrame, data: str, paths: dict[str, str]) -> DataFrame:
    """rows with the values at paths of a variant column as strings, by their new names. One pass, no join."""
    return rows.withColumns({name: F.try_variant_get(value_at(F.col(data), path), "$", "string") for name, path in paths.items()})


def extract_path(properties: DataFrame, path: str, name: str) -> DataFrame:
    """global_id and the value at 'set.property'; '*' stands for any characters in the set's name. Of several the greatest."""
    pset, prop = path.rsplit(".", 1)
    return properties.where(F.col("pset").rlike(_pattern(pset)) & (F.col("prop") == prop)).groupBy("global_id").agg(F.max("value").alias(name))
