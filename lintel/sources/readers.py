"""Readers of parsed documents, elements, rule files, specifications and file trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT = """file_id string, original_filename string, lifecycle_phase string, processed_at string, extension string, status string, full_text string,
  document_type struct<type_id:string,label_en:string,confidence:double>, sections array<struct<title:string,page:int,level:int>>,
  tables array<struct<title:string,headers:array<string>,rows:array<array<string>>,row_count:int>>, metadata map<string,string>, keywords array<struct<word:string,count:int>>, statistics map<string,long>"""
ELEMENT = "global_id string, ifc_class string, name string, container struct<global_id:string,name:string>, materials array<struct<name:string>>, property_sets map<string,map<string,string>>"
# What extensions stand for.
EXTENSIONS = [(".ifc", "bim_model"), (".pdf", "document"), (".docx", "document"), (".doc", "document"), (".hwpx", "document"), (".hwp", "document"), (".xlsx", "spreadsheet"), (".xls", "spreadsheet"), (".csv", "spreadsheet"), (".pptx", "presentation"), (".ppt", "presentation"), (".png", "image"), (".jpg", "image"), (".jpeg", "image"), (".tiff", "image"), (".ids", "standard"), (".bcf", "standard"), (".bcfzip", "standard")]

# Standards that formats follow.
STANDARDS = {
    ".ifc": "ISO 16739-1:2024", ".pdf": "ISO 32000", ".docx": "ISO/IEC 29500", ".hwpx": "KS X 6101", ".xlsx": "ISO/IEC 29500", ".csv": "RFC 4180", ".pptx": "ISO/IEC 29500", ".png": "ISO/IEC 15948", ".jpg": "ISO/IEC 10918", ".jpeg": "ISO/IEC 10918",
    ".ids": "buildingSMART IDS 1.0", ".bcf": "BCF 3.0", ".bcfzip": "BCF 3.0",
}


def read_parsed_documents(spark: SparkSession, path: str, pattern: str = "*_parsed.json", one_per_file: bool = True) -> DataFrame:
    """Completed documents with text among all files of a pattern below a path; not `one_per_file`: one on each line, so that files can be split."""
    rows = spark.read.schema(DOCUMENT).option("multiLine", one_per_file).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).json(path)
    return rows.where("status = 'completed' and trim(full_text) <> ''")


def read_elements(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Elements, and their properties as rows: global_id, pset, prop, value."""
    rows = spark.read.schema(ELEMENT).json(path)
    sets = rows.select("global_id", F.explode("property_sets").alias("pset", "values"))
    return rows, sets.select("global_id", "pset", F.explode("values").alias("prop", "value"))


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """ord, ifc_class, pset, name, data_type, unit of a dictionary file: classes by name, each with lists of properties."""
    schema = "classes map<string,struct<properties:array<struct<propertySet:string,name:string,dataType:string,unit:string>>>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    entries = rows.select(F.explode("classes").alias("ifc_class", "c")).select("ifc_class", F.posexplode("c.properties").alias("ord", "p"))
    return entries.select("ord", "ifc_class", F.col("p.propertySet").alias("pset"), "p.name", F.col("p.dataType").alias("data_type"), "p.unit")


CODE = "struct<code:string,name:string>"
CROSSWALK = f"map<string,struct<uniclass2015:{CODE},omniclass:{CODE},bsdd:struct<uri:string,guid:string>>>"


def read_crosswalk(spark: SparkSession, path: str) -> DataFrame:
    """ifc_class, uniclass, uniclass_name, omniclass, omniclass_name, uri of crosswalk files: an object of classes, each with the codes of its systems.

    An error names a file that is no such object or whose classes have none of the known systems.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.from_json("value", CROSSWALK).alias("classes"))
    known = F.exists(F.map_values("classes"), lambda c: c["uniclass2015"].isNotNull() | c["omniclass"].isNotNull() | c["bsdd"].isNotNull())
    checked = F.when(F.coalesce(known, F.lit(False)), F.col("classes")).otherwise(F.raise_error(F.concat(F.lit("no crosswalk of known systems: "), F.col("file"))))
    rows = files.select(F.explode(checked).alias("ifc_class", "c"))
    return rows.select("ifc_class", F.col("c.uniclass2015.code").alias("uniclass"), F.col("c.uniclass2015.name").alias("uniclass_name"), F.col("c.omniclass.code").alias("omniclass"), F.col("c.omniclass.name").alias("omniclass_name"), "c.bsdd.uri")


ASKED = "required:boolean,rationale:string"
RULES = f"""requirements map<string,struct<properties:array<struct<propertySet:string,name:string,{ASKED}>>,material:struct<{ASKED}>>>,
  global_requirements struct<spatial_containment:struct<{ASKED}>,classification:struct<required:boolean,systems:array<string>,rationale:string>>"""


def read_rule_config(spark: SparkSession, path: str) -> DataFrame:
    """ifc_class, pset, prop, required of a requirement file."""
    return read_requirements(spark, path).where("facet = 'property'").select("ifc_class", "pset", "prop", "required")


def read_requirements(spark: SparkSession, path: str) -> DataFrame:
    """ifc_class, facet (property, material, partof or classification), pset, prop, required, rationale, systems of everything a requirement file asks for; what it asks of all classes has none."""
    rows = spark.read.schema(RULES).option("multiLine", True).json(path)
    none = F.lit(None).cast("string")
    row = lambda facet, of, ifc_class=none, pset=none, prop=none, systems=F.lit(None).cast("array<string>"): [ifc_class.alias("ifc_class"), F.lit(facet).alias("facet"), pset.alias("pset"), prop.alias("prop"), F.col(f"{of}.required").alias("required"), F.col(f"{of}.rationale").alias("rationale"), systems.alias("systems")]
    classes = rows.select(F.explode("requirements").alias("ifc_class", "r"))
    own = F.col("ifc_class")
    out = classes.select("ifc_class", F.explode("r.properties").alias("p")).select(*row("property", "p", own, F.col("p.propertySet"), F.col("p.name")))
    out = out.unionByName(classes.where("r.material is not null").select(*row("material", "r.material", own)))
    every = rows.select("global_requirements.*")
    out = out.unionByName(every.where("spatial_containment is not null").select(*row("partof", "spatial_containment")))
    return out.unionByName(every.where("classification is not null").select(*row("classification", "classification", systems=F.col("classification.systems"))))


# A name is a simple value or bare text.
TEXT, LIMIT = "struct<_VALUE:string,simpleValue:string>", "struct<_value:string>"
VALUE = f"struct<_VALUE:string,simpleValue:string,restriction:struct<pattern:{LIMIT},enumeration:array<{LIMIT}>,minInclusive:{LIMIT},maxInclusive:{LIMIT}>>"
SPECIFICATION = f"""_name string, applicability struct<entity:struct<name:{TEXT}>>, requirements struct<
  property:array<struct<propertySet:{TEXT},baseName:{TEXT},name:{TEXT},value:{VALUE}>>, attribute:array<struct<name:{TEXT},value:{VALUE}>>,
  material:array<struct<value:{VALUE}>>, classification:array<struct<system:{TEXT},value:{VALUE}>>, partOf:array<struct<_relation:string,entity:struct<name:{TEXT}>>>>"""


REQUIREMENT = "array<struct<facet:string,pset:string,name:string,kind:string,expected:string,options:array<string>>>"


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Requirements of specification files, a row each, in the columns of lintel.operators.ids. A value is a simple one, a pattern, an enumeration or bounds.

    Bare text stands for a simple value; a property without a base name goes by its name. A specification without an entity applies to nothing that could be named, which is an error.
    """
    rows = spark.read.format("xml").option("rowTag", "specification").option("ignoreNamespace", True).schema(SPECIFICATION).load(path)
    none, text = F.lit(None).cast("string"), lambda c: F.coalesce(c["simpleValue"], F.nullif(F.trim(c["_VALUE"]), F.lit("")))
    limits = lambda v: F.array(v["restriction"]["minInclusive"]["_value"], v["restriction"]["maxInclusive"]["_value"])
    bounded = lambda v: v["restriction"]["minInclusive"].isNotNull() | v["restriction"]["maxInclusive"].isNotNull()
    value = lambda v: (
        F.when(text(v).isNotNull(), "simple").when(v["restriction"]["pattern"].isNotNull(), "pattern").when(v["restriction"]["enumeration"].isNotNull(), "enumeration").when(bounded(v), "bounds").alias("kind"),
        F.coalesce(text(v), v["restriction"]["pattern"]["_value"]).alias("expected"), F.coalesce(F.transform(v["restriction"]["enumeration"], lambda x: x["_value"]), F.when(bounded(v), limits(v))).alias("options"),
    )
    only = lambda c: (F.lit(None).cast("string").alias("kind"), c.alias("expected"), F.lit(None).cast("array<string>").alias("options"))
    made = {
        "property": lambda x: (text(x["propertySet"]), F.coalesce(text(x["baseName"]), text(x["name"])), value(x["value"])), "attribute": lambda x: (none, text(x["name"]), value(x["value"])), "material": lambda x: (none, none, value(x["value"])),
        "classification": lambda x: (none, text(x["system"]), value(x["value"])), "partOf": lambda x: (none, none, only(text(x["entity"]["name"]))),
    }

    def requirement(facet, parts):
        return lambda x: F.struct(F.lit(facet).alias("facet"), parts(x)[0].alias("pset"), parts(x)[1].alias("name"), *parts(x)[2])

    lists = [F.coalesce(F.transform(F.col("requirements")[k], requirement(k.lower(), f)), F.array().cast(REQUIREMENT)) for k, f in made.items()]
    entity = F.coalesce(text(F.col("applicability.entity.name")), F.raise_error(F.concat(F.lit("a specification without an entity: "), F.coalesce("_name", F.lit("")))).cast("string"))
    return rows.select(F.col("_name").alias("spec"), entity.alias("entity"), F.inline(F.concat(*lists)))


def catalogue_files(spark: SparkSession, path: str) -> DataFrame:
    """path, name, extension, category, standard, size_kb, checksum and model schema of every file below a path. Only the first 4 kB are decoded."""
    return catalogue(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path))


def catalogue(rows: DataFrame, *more: str) -> DataFrame:
    """catalogue_files() of rows path, length, content; columns `more` stay."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    rows = rows.select("path", *more, name.alias("name"), F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1)).alias("extension"), (F.col("length") / 1024).alias("size_kb"), F.sha2("content", 256).alias("checksum"), F.decode(F.substring("content", 1, 4096), "ISO-8859-1").alias("head"))
    known = F.broadcast(rows.sparkSession.createDataFrame(EXTENSIONS, "extension string, category string"))
    standard = F.try_element_at(F.create_map(*[x for k, v in STANDARDS.items() for x in (F.lit(k), F.lit(v))]), F.col("extension"))
    return rows.join(known, "extension", "left").select("path", *more, "name", "extension", F.coalesce("category", F.lit("other")).alias("category"), standard.alias("standard"), "size_kb", "checksum", F.nullif(F.regexp_extract("head", r"FILE_SCHEMA\s*\(\('([^']+)'", 1), F.lit("")).alias("model_schema"))
