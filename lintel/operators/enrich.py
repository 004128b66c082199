"""Names and values against a dictionary of standard properties.

The dictionary is reduced to one row per lookup key first, so that no lookup multiplies rows of the large side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintel.functions.values import normalize_name, normalize_value

# Other spellings of standard names, both without blanks, dashes and underscores.
ALIASES = {"firerated": "firerating", "external": "isexternal", "structural": "loadbearing", "uvalue": "thermaltransmittance", "soundrating": "acousticrating", "flammable": "combustible"}
# A dictionary in the order that decides between candidates.
DICTIONARY = [
    ("IfcWall", "Pset_WallCommon", "FireRating", "Duration", None), ("IfcWall", "Pset_WallCommon", "IsExternal", "Boolean", None), ("IfcWall", "Pset_WallCommon", "LoadBearing", "Boolean", None), ("IfcWall", "Pset_WallCommon", "ThermalTransmittance", "Real", "mm"),
    ("IfcDoor", "Pset_DoorCommon", "FireRating", "Duration", None), ("IfcDoor", "Pset_DoorCommon", "IsExternal", "Boolean", None),
    ("IfcWindow", "Pset_WindowCommon", "ThermalTransmittance", "Real", None), ("IfcSlab", "Pset_SlabCommon", "LoadBearing", "Boolean", None),
]
# Classification codes of each class.
CROSSWALK = [
    ("IfcWall", "Ss_25_10_30", "21-02 10 10"), ("IfcDoor", "Pr_30_59_29", "23-17 11 00"), ("IfcWindow", "Pr_30_59_98", "23-17 17 00"), ("IfcSlab", "Ss_25_10_25", "21-02 20 10"),
    ("IfcBeam", "Ss_25_30_20", "21-02 10 20 20"), ("IfcColumn", "Ss_25_30_30", "21-02 10 20 10"), ("IfcRoof", "Ss_25_10_65", "21-02 30 10"),
]


def dictionary(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *r) for i, r in enumerate(DICTIONARY)], "ord int, ifc_class string, pset string, name string, data_type string, unit string")


def crosswalk(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CROSSWALK, "ifc_class string, uniclass string, omniclass string")


def dictionary_lookup(properties: DataFrame, entries: DataFrame, aliases: dict[str, str] = ALIASES) -> DataFrame:
    """properties with standard_name, data_type, unit and match: MAPPED, FUZZY_MATCH or NOT_FOUND.

    In turn: the same class, set and normalised name; the same class and name; any class, the first entry; an alias of a name.
    Names are looked up once for each class, set and name that occur; properties are joined with what was found.
    """
    spark = properties.sparkSession
    entries = entries.withColumn("n", normalize_name(F.col("name")))
    found = F.struct("name", "data_type", "unit")
    first = lambda *keys: entries.groupBy(*keys).agg(F.min_by(found, "ord").alias("found"))
    exact, in_class, anywhere = first("ifc_class", "pset", "n").withColumnRenamed("found", "f1"), first("ifc_class", "n").withColumnRenamed("found", "f2"), first("n").withColumnRenamed("found", "f3")
    known = spark.createDataFrame(list(aliases.items()), "n string, standard string")
    by_alias = known.join(anywhere.select(F.col("n").alias("standard"), F.col("f3").alias("f4")), "standard").select("n", "f4")
    named = properties.select(F.col("ifc_class"), F.col("pset"), F.col("prop")).distinct()
    rows = named.withColumn("n", normalize_name(F.col("prop")))
    rows = rows.join(exact, ["ifc_class", "pset", "n"], "left").join(in_class, ["ifc_class", "n"], "left").join(anywhere, "n", "left").join(by_alias, "n", "left")
    best = F.coalesce("f1", "f2", "f3", "f4")
    match = F.when(F.col("f1").isNotNull(), "MAPPED").when(best.isNotNull(), "FUZZY_MATCH").otherwise("NOT_FOUND")
    rows = rows.select("ifc_class", "pset", "prop", best["name"].alias("standard_name"), best["data_type"].alias("data_type"), best["unit"].alias("unit"), match.alias("match"))
    same = [F.col(f"own.{c}").eqNullSafe(F.col(f"named.{c}")) for c in ("ifc_class", "pset", "prop")]
    return properties.alias("own").join(rows.alias("named"), same, "left").select("own.*", "standard_name", "data_type", "unit", F.coalesce("match", F.lit("NOT_FOUND")).alias("match"))


def enriched(properties: DataFrame, entries: DataFrame) -> DataFrame:
    """dictionary_lookup with normalised values."""
    return dictionary_lookup(properties, entries).withColumn("normalized", normalize_value(F.col("value"), F.col("data_type"), F.col("unit")))


def enrichment_stats(found: DataFrame) -> DataFrame:
    """Per element: properties, exact, fuzzy and unknown ones, and the share found in percent."""
    n = lambda m: F.count_if(F.col("match") == m)
    total = F.count("*")
    return found.groupBy("global_id").agg(total.alias("total"), n("MAPPED").alias("exact"), n("FUZZY_MATCH").alias("fuzzy"), n("NOT_FOUND").alias("not_found"), F.round((n("MAPPED") + n("FUZZY_MATCH")) * 100.0 / total, 1).alias("rate"))


def enrichment_totals(found: DataFrame, codes: DataFrame) -> DataFrame:
    """One row over all elements, with the share found in percent and the elements whose class has a code. codes: ifc_class."""
    n = lambda m: F.count_if(F.col("match") == m)
    coded = codes.select("ifc_class").distinct().withColumn("coded", F.lit(True))
    rate = F.round((n("MAPPED") + n("FUZZY_MATCH")) * 100.0 / F.count("*"), 1)
    numbers = n("MAPPED").alias("exact"), n("FUZZY_MATCH").alias("fuzzy"), n("NOT_FOUND").alias("not_found"), F.count_distinct("global_id").alias("n_elements"), rate.alias("rate"), F.count_distinct(F.when(F.col("coded"), F.col("global_id"))).alias("n_coded")
    return found.join(coded, "ifc_class", "left").agg(F.count("*").alias("total"), *numbers)


def dictionary_mapping(properties: DataFrame, entries: DataFrame) -> DataFrame:
    """Per property the first entry of its class, in order, that equals it (1.0), equals it normalised (0.9) or contains it or is contained (0.7).

    Containment has no join key: names are compared once for each class and name that occur, and properties are joined with the result.
    """
    entries = entries.select(F.col("ifc_class"), F.col("ord").alias("entry_ord"), F.col("name").alias("entry"))
    a, b = normalize_name(F.col("prop"), dashes=False), normalize_name(F.col("entry"), dashes=False)
    confidence = F.when(F.col("prop") == F.col("entry"), 1.0).when(a == b, 0.9).when(F.contains(a, b) | F.contains(b, a), 0.7)
    near = properties.select("ifc_class", "prop").distinct().join(entries, "ifc_class").withColumn("confidence", confidence).where("confidence is not null")
    best = near.groupBy("ifc_class", "prop").agg(F.min_by(F.struct("entry", "confidence"), "entry_ord").alias("best"))
    return properties.select("global_id", "ifc_class", "pset", "prop").distinct().join(best, ["ifc_class", "prop"]).select("global_id", "pset", "prop", "best.entry", "best.confidence")


def missing_dictionary_properties(elements: DataFrame, mapped: DataFrame, entries: DataFrame) -> DataFrame:
    """Entries of an element's class that none of its properties maps to."""
    wanted = elements.select("global_id", "ifc_class").join(entries.select("ifc_class", F.col("name").alias("entry")), "ifc_class")
    return wanted.join(mapped.select("global_id", "entry"), ["global_id", "entry"], "left_anti").select("global_id", "ifc_class", "entry")


def cross_link(elements: DataFrame, codes: DataFrame, base: str = "https://identifier.buildingsmart.org/uri/buildingsmart/ifc/4.3/class/") -> DataFrame:
    """Classification codes of each element's class, null where there are none, and the class's address."""
    return elements.join(codes, "ifc_class", "left").select("global_id", "ifc_class", "uniclass", "omniclass", F.concat(F.lit(base), F.col("ifc_class")).alias("uri"))


def validate_dictionary_value(value, allowed, least, most, numeric):
    """Whether a value is allowed, in range, and a number where one is asked for."""
    number = value.try_cast("double")
    return F.coalesce(~(numeric & number.isNull()) & (allowed.isNull() | F.array_contains(allowed, value)) & (least.isNull() | (number >= least)) & (most.isNull() | (number <= most)), F.lit(False))


def classification_suggestions(elements: DataFrame, classes: DataFrame, limit: int = 10) -> DataFrame:
    """Dictionary classes whose name contains the element's class word; 0.8 if the related entity contains the class, else 0.5. The best `limit` each.

    classes: code, class_name, related.
    """
    from pyspark.sql import Window

    word = F.lower(F.substring("ifc_class", 4, 100))
    # Text containment has no join key, so it is worked out once per element class, of which there are few.
    words = elements.select("ifc_class").distinct().withColumn("word", word)
    per_class = words.join(classes, F.contains(F.lower("class_name"), F.col("word"))).drop("word")
    near = elements.select("global_id", "ifc_class").join(per_class, "ifc_class")
    confidence = F.when(F.contains("related", F.col("ifc_class")), 0.8).otherwise(0.5)
    rank = F.row_number().over(Window.partitionBy("global_id").orderBy(F.desc("confidence"), "code"))
    return near.withColumn("confidence", confidence).withColumn("rank", rank).where(F.col("rank") <= limit).select("global_id", "code", "confidence", F.col("rank").cast("long").alias("rank"))
