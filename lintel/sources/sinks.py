"""Writers of tables, vectors, graphs, triples and topics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel.functions.values import escaped
from lintel.operators.graph import full


def points(embeddings: DataFrame, most: int = 1000) -> DataFrame:
    """id, values, metadata with at most `most` characters of text. embeddings: id, embedding, text."""
    return embeddings.select("id", F.col("embedding").alias("values"), F.struct(F.substring("text", 1, most).alias("text")).alias("metadata"))


def write_embeddings(embeddings: DataFrame, path: str) -> None:
    points(embeddings).write.mode("overwrite").json(path)


def write_tabular(rows: DataFrame, path: str) -> None:
    """The rows as Parquet, CSV and JSON lines, and one JSON row with the columns' types beside them."""
    rows.write.mode("overwrite").parquet(f"{path}/parquet")
    rows.write.mode("overwrite").option("header", True).csv(f"{path}/csv")
    rows.write.mode("overwrite").json(f"{path}/jsonl")
    rows.sparkSession.createDataFrame(rows.dtypes, "name string, type string").coalesce(1).write.mode("overwrite").json(f"{path}/schema")


def write_lines(lines: DataFrame, path: str) -> None:
    """N-Triples or edge lists: one text column."""
    lines.write.mode("overwrite").text(path)


def turtle(triples: DataFrame, prefixes: dict[str, str], tasks: int | None = None) -> DataFrame:
    """One statement per subject after the lines of the prefixes, its predicates joined by ';'. Names that are no plain prefixed names stand as addresses.

    tasks: over how many tasks subjects are dealt, each collected once; otherwise as many as Spark's shuffles have.
    """
    name = lambda c: F.when(F.col(c).rlike(r"^\w+:[\w-]+$"), F.col(c)).otherwise(F.concat(F.lit("<"), full(F.col(c)), F.lit(">")))
    text = F.concat(F.lit('"'), escaped(F.col("object")), F.lit('"'))
    obj = F.when(F.col("object_type") == "uri", name("object")).when(F.col("datatype").isNotNull(), F.concat_ws("^^", text, "datatype")).otherwise(text)
    rows = triples.select(name("subject").alias("s"), F.concat_ws(" ", name("predicate"), obj).alias("p"))
    parts = (rows.repartition(tasks, "s") if tasks else rows).groupBy("s").agg(F.array_sort(F.collect_list("p")).alias("p"))
    head = triples.sparkSession.createDataFrame([(f"@prefix {k}: <{v}> .",) for k, v in prefixes.items()], "value string")
    return head.unionByName(parts.select(F.concat("s", F.lit(" "), F.array_join("p", " ; "), F.lit(" .")).alias("value")))


def json_ld(triples: DataFrame, prefixes: dict[str, str], tasks: int | None = None) -> DataFrame:
    """One JSON object per subject: the context, its id, and lists of objects by predicate, with their types where they have one. tasks: as in turtle()."""
    triples = triples.repartition(tasks, "subject") if tasks else triples
    item = F.struct(F.when(F.col("object_type") == "uri", F.col("object")).alias("@id"), F.when(F.col("object_type") != "uri", F.col("object")).alias("@value"), F.col("datatype").alias("@type"))
    lists = triples.groupBy("subject", "predicate").agg(F.array_sort(F.collect_list(item)).alias("objects"))
    rows = lists.groupBy("subject").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("predicate", "objects")))).alias("p"))
    context = F.create_map(*[x for k, v in prefixes.items() for x in (F.lit(k), F.lit(v))])
    head, body = F.to_json(F.struct(context.alias("@context"), F.col("subject").alias("@id"))), F.to_json("p")
    return rows.select(F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(","), F.substring(body, F.lit(2), F.length(body))).alias("value"))


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").json(f"{path}/nodes")
    edges.write.mode("overwrite").json(f"{path}/edges")


def write_topics(topics: DataFrame, path: str) -> None:
    topics.write.mode("overwrite").json(path)


def ids_documents(specs: DataFrame) -> DataFrame:
    """A row per specification in the nesting of its XML. specs: a requirement per row, in the columns of lintel.operators.ids."""
    simple = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("simpleValue")))
    limits = F.struct(F.when(F.col("kind") == "pattern", F.struct(F.col("expected").alias("_value"))).alias("pattern"), F.when(F.col("kind") == "enumeration", F.transform("options", lambda x: F.struct(x.alias("_value")))).alias("enumeration"),
        *[F.when((F.col("kind") == "bounds") & F.get("options", k).isNotNull(), F.struct(F.get("options", k).alias("_value"))).alias(name) for k, name in enumerate(("minInclusive", "maxInclusive"))])
    value = F.when(F.col("kind").isNotNull(), F.struct(F.when(F.col("kind") == "simple", F.col("expected")).alias("simpleValue"), F.when(F.col("kind") != "simple", limits).alias("restriction"))).alias("value")
    made = {
        "property": (simple("pset").alias("propertySet"), simple("name").alias("baseName"), value), "attribute": (simple("name").alias("name"), value), "material": (value,), "classification": (simple("name").alias("system"), value),
        "partOf": (F.lit("IFCRELCONTAINEDINSPATIALSTRUCTURE").alias("_relation"), F.when(F.col("expected").isNotNull(), F.struct(simple("expected").alias("name"))).alias("entity")),
    }
    lists = [F.collect_list(F.when(F.col("facet") == k.lower(), F.struct(*v))).alias(k) for k, v in made.items()]
    rows = specs.groupBy("spec", "entity").agg(*lists)
    return rows.select(F.col("spec").alias("_name"), F.struct(F.struct(F.struct(F.col("entity").alias("simpleValue")).alias("name")).alias("entity")).alias("applicability"), F.struct(*made).alias("requirements"))


def write_ids(specs: DataFrame, path: str) -> None:
    """Specifications as XML files."""
    ids_documents(specs).write.mode("overwrite").format("xml").option("rootTag", "specifications").option("rowTag", "specification").save(path)


def nested_summary(parts: dict[str, DataFrame], files: DataFrame | None = None) -> DataFrame:
    """One row `value`, JSON: an object for each part, a table of one row, and output_files, one entry for each folder and type among files.

    files: rows as binaryFile gives them (path, length); a file's folder is the last one of its path. Parts come as rows, so no tables are crossed; one of several rows is an error.
    """
    rows = [part.select(F.lit(name).alias("part"), F.to_json(F.struct("*")).alias("of")) for name, part in parts.items()]
    if files is not None:
        folder, kind = F.regexp_extract("path", "([^/]+)/[^/]+$", 1).alias("name"), F.regexp_extract("path", r"\.([^./]+)$", 1).alias("type")
        sizes = files.groupBy(folder, kind).agg(F.count("*").alias("n_files"), F.round(F.sum("length") / 1024, 2).alias("size_kb"))
        rows.append(sizes.agg(F.to_json(F.sort_array(F.collect_list(F.struct("name", "type", "n_files", "size_kb")))).alias("of")).select(F.lit("output_files").alias("part"), "of"))
    parts_of = F.map_entries(F.map_from_entries(F.sort_array(F.collect_list(F.struct("part", "of")))))
    member = lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), e["value"])
    return reduce(DataFrame.unionByName, rows).agg(F.concat(F.lit("{"), F.array_join(F.transform(parts_of, member), ","), F.lit("}")).alias("value"))


def write_summary(summary: DataFrame, path: str) -> None:
    """One row as JSON."""
    summary.coalesce(1).write.mode("overwrite").json(path)
