"""Specifications of the information delivery standard against elements.

A specification table has a row per requirement: spec, entity (upper case), facet (property, attribute, material, classification or
partof), pset, name, kind of the value constraint (simple, pattern, enumeration, bounds or null for none), expected, options (array). `name` is the
property, the attribute or the classification system; bounds have the least and the greatest number as options, null where open; for partof, `expected` is the class to be part of.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel.operators.rules import property_map, value_constraint

COLUMNS = ("spec", "entity", "facet", "pset", "name", "kind", "expected", "options")
#: Distinct values up to which a property's observed values become an enumeration.
MOST_OPTIONS = 3


def specifications(rules: DataFrame, properties: DataFrame, attribute: str = "name", system: str = "Uniclass2015", storey: str = "IfcBuildingStorey", most_options: int = MOST_OPTIONS) -> DataFrame:
    """A specification per class of `rules` (ifc_class, facet, pset, prop, required): its required properties, with the observed values where those
    are few and their bounds where they are more and all numbers, a named attribute of letters, its material, a classification, and the storey that it is part of."""
    number = F.col("value").try_cast("double")
    none, lists = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    values = properties.where("value is not null").groupBy("ifc_class", "pset", "prop").agg(F.count_distinct("value").alias("n"), F.slice(F.array_sort(F.collect_set("value")), 1, most_options).alias("some"), F.count("value").alias("given"), F.count(number).alias("numbers"), F.min(number).alias("least"), F.max(number).alias("greatest"))
    row = lambda facet, pset=none, name=none, kind=none, expected=none, options=lists: (F.concat("ifc_class", F.lit(f" {facet}")).alias("spec"), F.upper("ifc_class").alias("entity"), F.lit(facet).alias("facet"), pset.alias("pset"), name.alias("name"), kind.alias("kind"), expected.alias("expected"), options.alias("options"))
    few, bounded = F.col("n") <= most_options, F.col("numbers") == F.col("given")
    asked = rules.where("facet = 'property' and required").select("ifc_class", "pset", "prop").join(values, ["ifc_class", "pset", "prop"])
    out = asked.select(*row("property", F.col("pset"), F.col("prop"), F.when(few, "enumeration").when(bounded, "bounds"), none, F.when(few, F.col("some")).when(bounded, F.array(F.col("least").cast("string"), F.col("greatest").cast("string")))))
    out = out.unionByName(rules.where("facet = 'material'").select("ifc_class").distinct().select(*row("material")))
    classes = rules.select("ifc_class").distinct()
    for part in (row("attribute", name=F.lit(attribute), kind=F.lit("pattern"), expected=F.lit("[a-z]+( [a-z]+)+$")), row("classification", name=F.lit(system)), row("partof", expected=F.lit(storey))):
        out = out.unionByName(classes.select(*part))
    return out


def applicable(elements: DataFrame, properties: DataFrame, specs: DataFrame) -> DataFrame:
    """spec and global_id: elements whose class (in upper case) meets the specification's constraint and that have its property, where it names one.

    specs: spec, kind (simple, pattern or enumeration), entity, options, prop; one row each, a table of rules. Constraints are tried on the
    distinct classes only; elements are joined by class.
    """
    classes = elements.select("ifc_class").distinct()
    met = classes.join(specs, value_constraint(F.col("kind"), F.col("entity"), F.col("options"), F.upper("ifc_class"))).select("ifc_class", "spec", "prop")
    rows = elements.join(met, "ifc_class").select("spec", "global_id", "prop")
    has = properties.select("global_id", "prop").distinct()
    return rows.where("prop is null").select("spec", "global_id").unionByName(rows.where("prop is not null").join(has, ["global_id", "prop"], "left_semi").select("spec", "global_id"))


def validate(elements: DataFrame, properties: DataFrame, relationships: DataFrame, specs: DataFrame, attributes: tuple[str, ...] = ("name",)) -> DataFrame:
    """spec, global_id, facet, pset, name, result of each requirement of each element of the specification's entity.

    elements: global_id, ifc_class, the attributes, materials and systems (arrays). A requirement without a value constraint asks only that there is
    something: a value of the property or attribute, a material, a classification of the system (or of any), a container (of the class).
    """
    ends = relationships.where(F.col("type").isin("contained_in", "aggregated_by")).groupBy(F.col("source").alias("global_id")).agg(F.collect_set("target_class").alias("wholes"))
    own = [F.col(a).cast("string").alias(f"own_{a}") for a in attributes]  # names of attributes may be those of the specifications' columns
    rows = elements.select("global_id", "ifc_class", "materials", "systems", *own).join(property_map(properties), "global_id", "left").join(ends, "global_id", "left").withColumn("entity", F.upper("ifc_class")).join(specs, "entity")
    own_value = F.try_element_at(F.create_map(*[x for a in attributes for x in (F.lit(a), F.col(f"own_{a}"))]), F.lower(F.col("name")))
    rows = rows.withColumns({"prop_value": F.try_element_at("props", F.concat_ws(".", "pset", "name")), "own_value": own_value})
    holds = lambda actual: F.coalesce(value_constraint(F.col("kind"), F.col("expected"), F.col("options"), actual), F.lit(False))
    given = lambda c: c.isNotNull() & holds(c)
    good = (
        F.when(F.col("facet") == "property", given(F.col("prop_value"))).when(F.col("facet") == "attribute", given(F.col("own_value")))
        .when(F.col("facet") == "material", F.exists(F.coalesce("materials", F.array().cast("array<string>")), holds))
        .when(F.col("facet") == "classification", F.when(F.col("name").isNull(), F.size("systems") > 0).otherwise(F.array_contains("systems", F.col("name"))))
        .when(F.col("facet") == "partof", F.col("wholes").isNotNull() & (F.col("expected").isNull() | F.array_contains("wholes", F.col("expected"))))
    )
    return rows.select("spec", "global_id", "facet", "pset", "name", F.when(F.coalesce(good, F.lit(False)), "PASS").otherwise("FAIL").alias("result"))


def summary(results: DataFrame) -> DataFrame:
    """One row: elements checked (one for each specification that applies), passed, failed, and the pass rate in percent."""
    each = results.groupBy("spec", "global_id").agg(F.bool_and(F.col("result") == "PASS").alias("passed"))
    rows = each.agg(F.count("*").alias("total"), F.count_if("passed").alias("n_passed"))
    return rows.select("total", "n_passed", (F.col("total") - F.col("n_passed")).alias("n_failed"), F.when(F.col("total") == 0, 0.0).otherwise(F.round(F.col("n_passed") * 100.0 / F.col("total"), 6)).alias("pass_rate"))


def part_of(elements: DataFrame, relationships: DataFrame, target_class: str | None = None) -> DataFrame:
    """PASS where an element is contained in or part of something, of the class if one is given."""
    ends = relationships.where(F.col("type").isin("contained_in", "aggregated_by")).groupBy(F.col("source").alias("global_id")).agg(F.collect_set("target_class").alias("classes"))
    good = F.col("classes").isNotNull() & (F.array_contains("classes", target_class) if target_class else F.lit(True))
    return elements.select("global_id").join(ends, "global_id", "left").select("global_id", F.when(good, "PASS").otherwise("FAIL").alias("result"))
