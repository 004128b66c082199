"""Requirement rules and the checks that they make of elements.

Rules are equi-joined by class; the optimizer broadcasts them while their size allows, and shuffles beyond. Property
values are looked up in a map per element, so the large side is grouped once and never joined per property.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lintel.operators.ranks import dense_index

# Required and optional properties of each class.
REQUIREMENTS = [
    ("IfcWall", "Pset_WallCommon", "FireRating", True), ("IfcWall", "Pset_WallCommon", "IsExternal", True), ("IfcWall", "Pset_WallCommon", "LoadBearing", True), ("IfcWall", "Pset_WallCommon", "ThermalTransmittance", False),
    ("IfcDoor", "Pset_DoorCommon", "FireRating", True), ("IfcDoor", "Pset_DoorCommon", "IsExternal", True), ("IfcDoor", "Pset_DoorCommon", "AcousticRating", False),
    ("IfcWindow", "Pset_WindowCommon", "ThermalTransmittance", True), ("IfcWindow", "Pset_WindowCommon", "IsExternal", True), ("IfcWindow", "Pset_WindowCommon", "GlazingAreaFraction", False),
    ("IfcSlab", "Pset_SlabCommon", "LoadBearing", True), ("IfcSlab", "Pset_SlabCommon", "IsExternal", False), ("IfcSlab", "Pset_SlabCommon", "FireRating", False),
    ("IfcBeam", "Pset_BeamCommon", "LoadBearing", False), ("IfcColumn", "Pset_ColumnCommon", "LoadBearing", False),
    ("IfcSpace", "Pset_SpaceCommon", "NetPlannedArea", True), ("IfcSpace", "Pset_SpaceCommon", "PubliclyAccessible", False),
    ("IfcRoof", "Pset_RoofCommon", "IsExternal", True), ("IfcRoof", "Pset_RoofCommon", "ThermalTransmittance", False),
]
MATERIAL_REQUIRED = ("IfcBeam", "IfcColumn")
# Classes and their ancestors, nearest first.
BUILDING = ["IfcBuildingElement", "IfcElement", "IfcProduct"]
ANCESTORS = {"IfcWall": BUILDING, "IfcDoor": BUILDING, "IfcWindow": BUILDING, "IfcSlab": BUILDING, "IfcBeam": BUILDING, "IfcColumn": BUILDING, "IfcSpace": ["IfcSpatialElement", "IfcProduct"]}


def requirements(spark: SparkSession) -> DataFrame:
    """ifc_class, pset, prop, required, ord of the default requirements."""
    return spark.createDataFrame([(*r, i) for i, r in enumerate(REQUIREMENTS)], "ifc_class string, pset string, prop string, required boolean, ord int")


def build_rules(properties: DataFrame, dictionary_classes: DataFrame | None = None) -> DataFrame:
    """ifc_class, facet, pset, prop, required: property rules, a material rule where a class needs one, and containment for all.

    Classes of `dictionary_classes` (ifc_class) without requirements get the containment rule alone.
    """
    facet = lambda name: F.lit(name).alias("facet")
    none = F.lit(None).cast("string")
    classes = properties.select("ifc_class").distinct()
    rules = properties.select("ifc_class", facet("property"), "pset", "prop", "required")
    material = classes.where(F.col("ifc_class").isin(*MATERIAL_REQUIRED)).select("ifc_class", facet("material"), none.alias("pset"), none.alias("prop"), F.lit(True).alias("required"))
    if dictionary_classes is not None:
        classes = classes.unionByName(dictionary_classes.select("ifc_class").join(classes, "ifc_class", "left_anti").distinct())
    contained = classes.select("ifc_class", facet("partof"), none.alias("pset"), none.alias("prop"), F.lit(True).alias("required"))
    return rules.unionByName(material).unionByName(contained)


def class_rules(rules: DataFrame, ancestors: dict[str, list[str]] = ANCESTORS) -> DataFrame:
    """Rules of each class together with those of its ancestors, each once."""
    spark = rules.sparkSession
    pairs = [(c, a) for c, up in ancestors.items() for a in up]
    inherited = spark.createDataFrame(pairs, "own string, ifc_class string").join(rules, "ifc_class").drop("ifc_class").withColumnRenamed("own", "ifc_class")
    return rules.unionByName(inherited.select(*rules.columns)).distinct()


def property_map(properties: DataFrame) -> DataFrame:
    """One row per element: global_id and values by 'pset.prop'; of several values the one with the greatest ord."""
    last = properties.groupBy("global_id", F.concat_ws(".", "pset", "prop").alias("k")).agg(F.max_by("value", "ord").alias("v"))
    return last.groupBy("global_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("props"))


def check_property(value: Column, required: Column) -> Column:
    return F.when(value.isNotNull(), "PASS").when(required, "FAIL").otherwise("N/A")


def check_material(materials: Column, required: Column) -> Column:
    """materials: an array of names."""
    return F.when(F.coalesce(F.size(materials), F.lit(0)) > 0, "PASS").when(required, "FAIL").otherwise("WARNING")


def check_classification(systems: Column, wanted: Column, required: Column) -> Column:
    """systems: an array; wanted: a system or null."""
    some = F.coalesce(F.size(systems), F.lit(0)) > 0
    return F.when(~some & required, "FAIL").when(~some, "N/A").when(wanted.isNull() | F.array_contains(systems, wanted), "PASS").when(required, "FAIL").otherwise("WARNING")


def check_partof(container: Column, required: Column) -> Column:
    return F.when(container.isNotNull(), "PASS").when(required, "FAIL").otherwise("N/A")


def check_attribute(value: Column, expected: Column) -> Column:
    return F.when(value.isNull(), "FAIL").when(expected.isNull() | (value == expected), "PASS").otherwise("FAIL")


def value_constraint(kind: Column, expected: Column, options: Column, actual: Column) -> Column:
    """simple: equal; pattern: matches from the start; enumeration: one of; bounds: a number from the first option to the second, where those are given; any other kind holds."""
    number, least, most = actual.try_cast("double"), F.get(options, 0).try_cast("double"), F.get(options, 1).try_cast("double")
    inside = number.isNotNull() & F.coalesce(number >= least, F.lit(True)) & F.coalesce(number <= most, F.lit(True))
    return F.when(kind == "bounds", inside).when(kind == "simple", actual == expected).when(kind == "pattern", F.regexp_like(actual, F.concat(F.lit("^(?:"), expected, F.lit(")")))).when(kind == "enumeration", F.array_contains(options, actual)).otherwise(True)


def checks(elements: DataFrame, properties: DataFrame, rules: DataFrame) -> DataFrame:
    """global_id, ifc_class, facet, pset, prop, result: a row per element and rule of its class.

    elements: global_id, ifc_class, container, materials (array). An element without properties has no values.
    """
    rows = elements.join(property_map(properties), "global_id", "left").join(rules, "ifc_class")
    value = F.try_element_at("props", F.concat_ws(".", "pset", "prop"))
    result = F.when(F.col("facet") == "property", check_property(value, F.col("required"))).when(F.col("facet") == "material", check_material(F.col("materials"), F.col("required"))).otherwise(check_partof(F.col("container"), F.col("required")))
    return rows.select("global_id", "ifc_class", "facet", "pset", "prop", result.alias("result"))


def element_status(elements: DataFrame, found: DataFrame) -> DataFrame:
    """global_id, n_pass, n_fail, n_warning, status, pass_rate. Elements without checks pass."""
    n = lambda r: F.count_if(F.col("result") == r)
    counts = found.groupBy("global_id").agg(n("PASS").alias("n_pass"), n("FAIL").alias("n_fail"), n("WARNING").alias("n_warning"))
    rows = elements.select("global_id").join(counts, "global_id", "left").fillna(0, ["n_pass", "n_fail", "n_warning"])
    status = F.when(F.col("n_fail") > 0, "FAIL").when(F.col("n_warning") > 0, "WARNING").otherwise("PASS")
    both = F.col("n_pass") + F.col("n_fail")
    return rows.select("*", status.alias("status"), F.when(both == 0, 1.0).otherwise(F.col("n_pass") / both).alias("pass_rate"))


def validation_summary(elements: DataFrame, found: DataFrame) -> DataFrame:
    """One row: totals of elements and checks, and pass rates in percent; N/A stays in the checks' denominator."""
    status = element_status(elements, found).agg(F.count("*").alias("n_elements"), F.count_if(F.col("status") == "PASS").alias("elements_passed"))
    totals = found.agg(F.count("*").alias("n_checks"), F.count_if(F.col("result") == "PASS").alias("checks_passed"))
    rate = lambda a, b, name: F.when(F.col(b) == 0, 0.0).otherwise(F.round(F.col(a) * 100.0 / F.col(b), 1)).alias(name)
    return status.join(totals).select("*", rate("elements_passed", "n_elements", "element_pass_rate"), rate("checks_passed", "n_checks", "check_pass_rate"))  # one row each


def failures(found: DataFrame) -> DataFrame:
    """Failed checks by class and rule."""
    rule = F.concat_ws(": ", "facet", F.coalesce("prop", "facet")).alias("rule")
    return found.where("result = 'FAIL'").groupBy("ifc_class", rule).agg(F.count("*").alias("n_failed"))


def required_properties(rules: DataFrame, ancestors: dict[str, list[str]] = ANCESTORS) -> DataFrame:
    """Requirements (ifc_class, pset, prop, required, ord) of each class and its ancestors; the first of a pset and property wins."""
    spark = rules.sparkSession
    pairs = [(c, u, k) for c, up in ancestors.items() for k, u in enumerate(up, 1)]
    own = spark.createDataFrame(pairs, "entity string, ifc_class string, depth int").unionByName(rules.select(F.col("ifc_class").alias("entity"), "ifc_class", F.lit(0).alias("depth")).distinct())
    first = F.min_by("required", F.struct("depth", "ord")).alias("required")
    return own.join(rules, "ifc_class").groupBy("entity", "pset", "prop").agg(first)


def geometry_requirement(rules: DataFrame, ranks: dict[str, int]) -> DataFrame:
    """Most detailed geometry (greatest rank) per entity and phase. rules: entity, phase, detail."""
    rank = F.create_map(*[x for k, v in ranks.items() for x in (F.lit(k), F.lit(v))])[F.col("detail")]
    return rules.groupBy("entity", "phase").agg(F.max_by("detail", F.struct(rank, "detail")).alias("detail"))


def value_errors(value: Column, allowed: Column, least: Column, most: Column) -> Column:
    """Why a value is invalid, the last reason winning; null if it is valid."""
    number = value.try_cast("double")
    return F.when(most.isNotNull() & number.isNotNull() & (number > most), "above maximum").when(least.isNotNull() & number.isNotNull() & (number < least), "below minimum").when(allowed.isNotNull() & ~F.array_contains(allowed, value), "not allowed")


def loin_completeness(elements: DataFrame, properties: DataFrame, required: DataFrame) -> DataFrame:
    """Per element: requirements, missing (required ones), invalid and valid values, completeness (1 where nothing is asked).

    required: ifc_class, pset, prop, required, allowed (array), least, most.
    """
    rows = elements.select("global_id", "ifc_class").join(required, "ifc_class", "left").join(property_map(properties), "global_id", "left")
    value = F.try_element_at("props", F.concat_ws(".", "pset", "prop"))
    asked = F.col("prop").isNotNull()
    wrong = value_errors(value, F.col("allowed"), F.col("least"), F.col("most"))
    n = F.count_if(asked)
    valid = F.count_if(asked & value.isNotNull() & wrong.isNull())
    return rows.groupBy("global_id").agg(n.alias("n_required"), F.count_if(asked & value.isNull() & F.col("required")).alias("n_missing"), F.count_if(value.isNotNull() & wrong.isNotNull()).alias("n_invalid"), valid.alias("n_valid"), F.when(n == 0, 1.0).otherwise(valid / n).alias("completeness"))


def topics(found: DataFrame, ids_results: DataFrame | None = None, gaps: DataFrame | None = None, mismatches: DataFrame | None = None) -> DataFrame:
    """source, title, description, topic_type, priority, topic_status, ifc_class, element of every issue.

    One topic for each failed check (found), each failed or doubtful requirement of a specification (ids_results: global_id, ifc_class, facet, name,
    result), each element with missing properties (gaps: global_id, ifc_class, phase, missing: an array), each with values against the dictionary (mismatches: global_id, ifc_class, errors: an array).
    """
    columns = ("source", "title", "description", "topic_type", "priority", "topic_status", "ifc_class", "element")
    made = lambda df, *values: df.select(*[(F.lit(v) if isinstance(v, str) else v).alias(c) for c, v in zip(columns, (*values, "Open", F.col("ifc_class"), F.col("global_id")), strict=True)])
    none, listed = F.lit(None).cast("string"), lambda c: F.array_join(F.transform(F.array_sort(c), lambda x: F.concat(F.lit("- "), x)), "\n")
    rule = F.concat_ws(": ", "facet", F.coalesce("prop", "facet"))
    out = made(found.where("result = 'FAIL'"), "Rules", F.concat(F.lit("Missing "), rule), none, "Error", "High")
    if ids_results is not None:
        bad = F.col("result") == "FAIL"
        title = F.concat(F.lit("["), F.upper("facet"), F.lit("] "), F.coalesce("name", F.col("facet")))
        out = out.unionByName(made(ids_results.where("result in ('FAIL', 'WARNING')"), "IDS", title, none, F.when(bad, "Error").otherwise("Warning"), F.when(bad, "High").otherwise("Normal")))
    if gaps is not None:
        out = out.unionByName(made(gaps.where(F.size("missing") > 0), "LOIN", F.concat(F.lit("Missing LOIN Properties: "), F.col("ifc_class")), F.concat(F.lit("missing in "), F.col("phase"), F.lit(":\n"), listed("missing")), "Warning", "Normal"))
    if mismatches is not None:
        out = out.unionByName(made(mismatches.where(F.size("errors") > 0), "bSDD", F.concat(F.lit("bSDD Value Mismatch: "), F.col("ifc_class")), listed("errors"), "Warning", "Normal"))
    return out


def issue_topics(found: DataFrame, **others: DataFrame) -> DataFrame:
    """topics() with a stable id, numbered from 1 over all, by source, class, element and title."""
    rows = dense_index(topics(found, **others), [F.col(c) for c in ("source", "ifc_class", "element", "title")])
    guid = F.md5(F.concat_ws("|", "source", "element", "title"))
    return rows.withColumns({"guid": guid, "idx": F.col("idx") + 1})


def missing_properties(elements: DataFrame, properties: DataFrame, required: DataFrame) -> DataFrame:
    """global_id, ifc_class, missing: 'pset.prop' of each required property that an element has no value of. required: ifc_class, pset, prop, required."""
    rows = elements.select("global_id", "ifc_class").join(required.where("required"), "ifc_class").join(property_map(properties), "global_id", "left")
    key = F.concat_ws(".", "pset", "prop")
    return rows.where(F.try_element_at("props", key).isNull()).groupBy("global_id", "ifc_class").agg(F.collect_set(key).alias("missing"))


#: Share of a class's elements that carry a property from which on it counts as required.
REQUIRED_SHARE = 0.6


def observed_requirements(elements: DataFrame, properties: DataFrame, share: float = REQUIRED_SHARE) -> DataFrame:
    """ifc_class, pset, prop, required of what a model itself carries: required where `share` of the class's elements have a value."""
    size = elements.groupBy("ifc_class").agg(F.count("*").alias("n"))
    carried = properties.where("value is not null").groupBy("ifc_class", "pset", "prop").agg(F.count_distinct("global_id").alias("with_value"))
    return carried.join(size, "ifc_class").select("ifc_class", "pset", "prop", (F.col("with_value") >= share * F.col("n")).alias("required"))
