"""Graphs of elements: nodes, edges, triples and their statistics.

Pairs within a group grow with its square: cliques.py makes them from blocks, or keeps them as classes with members in linear size; `star_edges` serves consumers that only need connectivity.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintel.functions.values import encode_fire_rating, escaped, literal_type
from lintel.operators import cliques
from lintel.operators.ranks import dense_index


def property_graph_nodes(elements: DataFrame, properties: DataFrame) -> DataFrame:
    """id, node_type, label: elements (last writer wins), property sets, materials, classes and storeys (first writer wins)."""
    sets = properties.select(F.concat_ws("/", "global_id", "pset").alias("id"), F.lit("pset").alias("node_type"), F.col("pset").alias("label"), "ord")
    props = properties.select(F.concat_ws("/", "global_id", "pset", "prop").alias("id"), F.lit("property").alias("node_type"), F.concat_ws("=", "prop", "value").alias("label"), (-F.col("ord")).alias("ord"))
    own = elements.select(F.col("global_id").alias("id"), F.lit("element").alias("node_type"), F.col("name").alias("label"), (-F.col("ord")).alias("ord"))
    shared = [elements.where(F.col(c).isNotNull()).select(F.concat(F.lit(f"{kind}:"), F.col(c)).alias("id"), F.lit(kind).alias("node_type"), F.col(c).alias("label"), "ord") for c, kind in (("material", "material"), ("ifc_class", "class"), ("container", "spatial"))]
    rows = own.unionByName(sets).unionByName(props)
    for part in shared:
        rows = rows.unionByName(part)
    return union_nodes(rows.withColumn("ord", F.abs("ord")))


#: Kinds of nodes of which the last writer wins; of all others the first.
LAST_WINS = ("element", "property")


def union_nodes(rows: DataFrame) -> DataFrame:
    """id, node_type, label, each id once: the last writer of elements and properties, the first of all others. rows: also ord, the order of writing."""
    node = F.struct("node_type", "label")
    best = rows.groupBy("id").agg(F.min_by(node, F.struct("ord", "node_type", "label")).alias("first"), F.max_by(node, F.struct("ord", "node_type", "label")).alias("last"))
    best = best.select("id", F.when(F.col("first.node_type").isin(*LAST_WINS), F.col("last")).otherwise(F.col("first")).alias("best"))
    return best.select("id", "best.node_type", "best.label")


def union_edges(rows: DataFrame) -> DataFrame:
    """src, dst, edge_type, each pair of nodes once: the last type wins, of several at once the greatest. rows: also seq, the order of writing."""
    return rows.groupBy("src", "dst").agg(F.max_by("edge_type", F.struct("seq", "edge_type")).alias("edge_type"))


def property_graph_edges(elements: DataFrame, properties: DataFrame) -> DataFrame:
    """src, dst, edge_type, one per pair of nodes; the last type wins."""
    sets = properties.select(F.col("global_id").alias("src"), F.concat_ws("/", "global_id", "pset").alias("dst"), F.lit("HAS_PSET").alias("edge_type"), F.lit(0).alias("seq"))
    props = properties.select(F.concat_ws("/", "global_id", "pset").alias("src"), F.concat_ws("/", "global_id", "pset", "prop").alias("dst"), F.lit("HAS_PROPERTY").alias("edge_type"), F.lit(1).alias("seq"))
    rows = sets.unionByName(props)
    for k, (c, kind, name) in enumerate((("ifc_class", "class", "CLASSIFIED_AS"), ("material", "material", "HAS_MATERIAL"), ("container", "spatial", "CONTAINED_IN"))):
        rows = rows.unionByName(elements.where(F.col(c).isNotNull()).select(F.col("global_id").alias("src"), F.concat(F.lit(f"{kind}:"), F.col(c)).alias("dst"), F.lit(name).alias("edge_type"), F.lit(2 + k).alias("seq")))
    return union_edges(rows)


def same_storey_edges(elements: DataFrame) -> DataFrame:
    """src, dst, edge_type, n_links: a SAME_STOREY edge from each element to the class of its container, which stands for its n_links edges to the other members."""
    rows = cliques.members(elements, "container")
    return rows.select(F.col("id").alias("src"), F.concat(F.lit("storey:"), "class").alias("dst"), F.lit("SAME_STOREY").alias("edge_type"), "n_links")


def pairs_sharing(elements: DataFrame, key: str) -> DataFrame:
    """src, dst of all pairs with src first in order that share a value of `key`, which each element has one of; each pair once. They grow with the square of a class."""
    return cliques.expand(cliques.members(elements, key))


def star_edges(elements: DataFrame, key: str) -> DataFrame:
    """src, dst from each element to the first that shares its value of `key`: as connected as all pairs, and linear."""
    rows = elements.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), "global_id", "ord")
    first = rows.groupBy("k").agg(F.min_by("global_id", "ord").alias("dst"))
    return rows.join(first, "k").where("global_id <> dst").select(F.col("global_id").alias("src"), "dst")


def proximity_edges(elements: DataFrame, threshold: float, same_level: bool = True) -> DataFrame:
    """src, dst, distance, weight in both directions of elements closer than `threshold`.

    Same level: heights differ by at most 0.5 and only the plane counts. A grid of cells as wide as the threshold (as the 0.5 in height) leaves
    27 cells to look in. Blocks of elements meet blocks of these cells, so neither elements nor pairs are repeated for a join.
    """
    widths = {"x": threshold, "y": threshold, "z": 0.5 if same_level else threshold}
    axes = ("x", "y") if same_level else ("x", "y", "z")
    cell = F.struct(*[F.floor(F.col(c) / w).alias(c) for c, w in widths.items()])
    rows = elements.where(" and ".join(f"{c} is not null" for c in widths)).select(cell.alias("class"), F.col("global_id").alias("id"), "x", "y", "z")
    found = cliques.blocks(rows)
    near = F.array(*[F.struct(*[(F.col(f"class.{c}") + d).alias(c) for c, d in zip(widths, step, strict=True)]) for step in product((-1, 0, 1), repeat=3)])
    pairs = cliques.meet(found.select(F.explode(near).alias("class"), F.col("held").alias("src")), found).where("x.id <> y.id")
    gap = lambda c: F.col(f"x.{c}") - F.col(f"y.{c}")
    pairs = pairs.where(F.abs(gap("z")) <= 0.5) if same_level else pairs
    squares = sum((gap(c) * gap(c) for c in axes), F.lit(0.0))
    pairs = pairs.select(F.col("x.id").alias("src"), F.col("y.id").alias("dst"), F.sqrt(squares).alias("distance")).where(F.col("distance") < threshold)
    return pairs.withColumn("weight", 1 - F.col("distance") / threshold)


def undirected(edges: DataFrame) -> DataFrame:
    """Every edge in both directions, once."""
    return edges.select("src", "dst").union(edges.select("dst", "src")).distinct()


# Labels of classes.
CLASS_LABELS = {"IfcWall": 0, "IfcWallStandardCase": 0, "IfcDoor": 1, "IfcWindow": 2, "IfcSlab": 3, "IfcRoof": 4, "IfcBeam": 5, "IfcColumn": 6, "IfcStair": 7, "IfcRailing": 8, "IfcSpace": 9, "IfcCovering": 10, "IfcCurtainWall": 11}


def gnn_nodes(elements: DataFrame, properties: DataFrame, spatial: DataFrame, classes: DataFrame) -> DataFrame:
    """id, node_type, label, features of elements, spaces, storeys, buildings, sites, materials and classifications, each once.

    features of elements: coded class (-1 if unknown), is external, bears load, hours of fire rating, x, y, z, each 0 where nothing is said; of storeys
    the elevation. classes: ifc_class, uniclass.
    """
    none = F.array().cast("array<double>")
    part = lambda df, c, kind, label, features=none: df.select(c.alias("id"), F.lit(kind).alias("node_type"), label.alias("label"), features.alias("features"))
    code = F.coalesce(F.try_element_at(F.create_map(*[x for k, v in CLASS_LABELS.items() for x in (F.lit(k), F.lit(v))]), F.col("ifc_class")), F.lit(-1)).cast("double")
    value = lambda prop: F.max(F.when(F.col("prop") == prop, F.col("value")))
    said = properties.where(F.contains("pset", F.lit("Common"))).groupBy("global_id").agg(value("IsExternal").alias("external"), value("LoadBearing").alias("bears"), value("FireRating").alias("fire"))
    true = lambda c: F.when(F.lower(c).isin("true", "yes", "1"), 1.0).otherwise(0.0)
    place = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("x", "y", "z")]
    fire = encode_fire_rating(F.col("fire")).cast("double")
    own = elements.join(said, "global_id", "left")
    rows = part(own, F.col("global_id"), "element", F.col("ifc_class"), F.array(code, true("external"), true("bears"), fire, *place)).withColumn("node_type", F.when(F.col("label") == "IfcSpace", "space").otherwise(F.col("node_type")))
    for c, label in (("storey", "IfcBuildingStorey"), ("building", "IfcBuilding"), ("site", "IfcSite")):
        rows = rows.unionByName(part(spatial, F.col(c), c, F.lit(label), F.array(F.coalesce(F.col("elevation").cast("double"), F.lit(0.0))) if c == "storey" else none))
    rows = rows.unionByName(part(elements.where("material is not null"), F.concat(F.lit("M:"), F.col("material")), "material", F.lit("IfcMaterial")))
    coded = elements.select("ifc_class").distinct().join(classes.where("uniclass is not null"), "ifc_class")
    rows = rows.unionByName(part(coded, F.concat(F.lit("C:"), F.col("uniclass")), "classification", F.lit("Uniclass2015")))
    best = rows.groupBy("id", "node_type").agg(F.max(F.struct("label", "features")).alias("n"))
    return best.select("id", "node_type", "n.label", "n.features")


def gnn_edges(elements: DataFrame, spatial: DataFrame, relationships: DataFrame, classes: DataFrame) -> DataFrame:
    """src, dst, edge_type: containment both ways down the spatial tree, materials, classifications, and connections both ways; each once."""
    down = spatial.select(F.inline(F.array(F.struct(F.col("site").alias("a"), F.col("building").alias("b")), F.struct(F.col("building").alias("a"), F.col("storey").alias("b")))))
    down = down.unionByName(elements.where("container is not null").select(F.col("container").alias("a"), F.col("global_id").alias("b")))
    both = lambda df, there, back: df.select(F.inline(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(there).alias("edge_type")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst"), F.lit(back).alias("edge_type")))))
    made = elements.where("material is not null").select(F.col("global_id").alias("src"), F.concat(F.lit("M:"), F.col("material")).alias("dst"), F.lit("HAS_MATERIAL").alias("edge_type"))
    coded = elements.join(classes.where("uniclass is not null"), "ifc_class").select(F.col("global_id").alias("src"), F.concat(F.lit("C:"), F.col("uniclass")).alias("dst"), F.lit("HAS_CLASSIFICATION").alias("edge_type"))
    joined = relationships.where("type = 'connected_to'").select(F.col("source").alias("a"), F.col("target").alias("b"))
    return both(down, "CONTAINS", "CONTAINED_IN").unionByName(made).unionByName(coded).unionByName(both(joined, "CONNECTS_TO", "CONNECTS_TO")).distinct()


def node_index(nodes: DataFrame, order: str) -> DataFrame:
    """id and idx, dense from 0 in the order of a unique column."""
    return dense_index(nodes.select("id", order), [F.col(order)]).select("id", "idx")


def edge_index(edges: DataFrame, index: DataFrame) -> DataFrame:
    """src_idx, dst_idx of edges with both ends in the index."""
    a, b = index.select(F.col("id").alias("src"), F.col("idx").alias("src_idx")), index.select(F.col("id").alias("dst"), F.col("idx").alias("dst_idx"))
    return edges.join(a, "src").join(b, "dst").select("src_idx", "dst_idx")


def adjacency(edges: DataFrame) -> DataFrame:
    """src_idx and its neighbours in order, joined by commas."""
    return edges.groupBy("src_idx").agg(F.array_join(F.transform(F.array_sort(F.collect_set("dst_idx")), lambda x: x.cast("string")), ",").alias("neighbours"))


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges and the average degree 2E/N."""
    return nodes.agg(F.count("*").alias("n_nodes")).join(edges.agg(F.count("*").alias("n_edges"))).select("*", F.when(F.col("n_nodes") == 0, 0.0).otherwise(2.0 * F.col("n_edges") / F.col("n_nodes")).alias("average_degree"))


def neighbours(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """id, neighbour, edge_type: one hop from the seeds (id), either way."""
    both = edges.select(F.col("src").alias("id"), F.col("dst").alias("neighbour"), "edge_type").union(edges.select("dst", "src", "edge_type"))
    return both.join(seeds.select("id"), "id", "left_semi").distinct()


def subgraph(nodes: DataFrame, edges: DataFrame, types: list[str], label: str | None = None) -> DataFrame:
    """Edges with both ends of the given types and labels that contain a text."""
    kept = nodes.where(F.col("node_type").isin(*types))
    if label:
        kept = kept.where(F.contains(F.lower("label"), F.lit(label.lower())))
    return edges.join(kept.select(F.col("id").alias("src")), "src", "left_semi").join(kept.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst", "edge_type")


# Prefixes of names, and classes of the building topology and element vocabularies.
PREFIXES = {
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "rdfs": "http://www.w3.org/2000/01/rdf-schema#", "xsd": "http://www.w3.org/2001/XMLSchema#", "bot": "https://w3id.org/bot#", "beo": "https://pi.pauwel.be/voc/buildingelement#",
    "props": "http://lbd.arch.rwth-aachen.de/props#", "foaf": "http://xmlns.com/foaf/0.1/", "ifc": "https://standards.buildingsmart.org/IFC/DEV/IFC4/ADD2/OWL#", "inst": "https://example.org/inst/", "mat": "https://example.org/material/", "class": "https://example.org/class/",
}
TOPOLOGY = {"IfcSpace": "bot:Space", "IfcWall": "beo:Wall", "IfcDoor": "beo:Door", "IfcWindow": "beo:Window", "IfcSlab": "beo:Slab", "IfcRoof": "beo:Roof", "IfcBeam": "beo:Beam"}


def triple_tasks(elements: DataFrame, properties: DataFrame, documents: DataFrame, rows_a_task: int = 100_000) -> int:
    """Over how many tasks the triples of these rows are dealt, and what is made of whole subjects."""
    return max(elements.sparkSession.sparkContext.defaultParallelism, math.ceil((elements.count() + properties.count() + documents.count()) / rows_a_task))


def triples(elements: DataFrame, properties: DataFrame, spatial: DataFrame, classes: DataFrame, documents: DataFrame, rows_a_task: int = 100_000, tasks: int | None = None) -> DataFrame:
    """subject, predicate, object, object_type, datatype, each once: the project and its sites, buildings, storeys and spaces, elements with classes, labels, places,
    property sets, materials and classifications, and documents. classes: ifc_class, uniclass; documents: doc_id, filename, phase.
    rows_a_task: elements, properties and documents whose triples a task holds to keep each once; tasks: triple_tasks() where it is known.
    """
    row = lambda s, p, o, kind="uri", datatype=None: F.struct(s.alias("subject"), (F.lit(p) if isinstance(p, str) else p).alias("predicate"), o.cast("string").alias("object"), F.lit(kind).alias("object_type"), (datatype if datatype is not None else F.lit(None).cast("string")).alias("datatype"))
    uri = lambda c: F.concat(F.lit("inst:"), F.col(c))
    rows = lambda df, *made: df.select(F.inline(F.array(*made)))
    named = lambda s, kinds, c, label: [row(s, "rdf:type", F.lit(k)) for k in kinds] + [row(s, "ifc:globalId_IfcRoot", F.col(c), "literal"), row(s, "rdfs:label", label, "literal")]
    # Inputs are small files of many rows, each of which makes many triples: rows are dealt before triples are made of them, so that no task writes those of a whole
    # split, and triples before equal ones are looked for. What many rows share (materials, classes, sets, sites, buildings) is stated once for all of them.
    tasks = tasks or triple_tasks(elements, properties, documents, rows_a_task)
    elements, properties, spatial, documents = (
        df.select(*columns).repartition(tasks, *columns[:keys])
        for df, keys, columns in (
            (elements, 1, ("global_id", "ifc_class", "name", "container", "material")), (properties, 2, ("global_id", "pset", "prop", "value")),
            (spatial, 1, ("storey", "elevation", "building", "site", "site_name")), (documents, 1, ("doc_id", "filename", "phase")),
        )
    )
    e, project, mat, cls = uri("global_id"), F.lit("inst:project"), F.concat(F.lit("mat:"), F.col("material")), F.concat(F.lit("class:"), F.col("uniclass"))
    topology = F.try_element_at(F.create_map(*[x for k, v in TOPOLOGY.items() for x in (F.lit(k), F.lit(v))]), F.col("ifc_class"))
    space = F.when(F.col("ifc_class") == "IfcSpace", "bot:hasSpace").otherwise("bot:containsElement")
    # The table of classes is the small side, of which the optimizer knows no size: without the hint the elements are broadcast, or sorted by their few classes.
    coded = elements.join(F.broadcast(classes.where("uniclass is not null").select("ifc_class", "uniclass")), "ifc_class", "left")
    out = rows(coded, *named(e, [], "global_id", F.col("name")), row(e, "rdf:type", F.concat(F.lit("ifc:"), F.col("ifc_class"))), row(e, "rdf:type", topology), row(e, "bot:containedIn", uri("container")), row(uri("container"), space, e), row(e, "ifc:hasMaterial", mat), row(e, "ifc:hasClassification", cls))
    shared = rows(coded.select("material", "uniclass").distinct(), row(mat, "rdf:type", F.lit("ifc:IfcMaterial")), row(mat, "rdfs:label", F.col("material"), "literal"), row(cls, "rdf:type", F.lit("ifc:IfcClassificationReference")))
    sites = rows(spatial.select("site", "site_name").distinct(), row(project, "rdf:type", F.lit("ifc:IfcProject")), row(project, "bot:hasSite", uri("site")), *named(uri("site"), ["bot:Site", "ifc:IfcSite"], "site", F.col("site_name")))
    buildings = rows(spatial.select("building", "site").distinct(), *named(uri("building"), ["bot:Building", "ifc:IfcBuilding"], "building", F.col("building")), row(uri("site"), "bot:hasBuilding", uri("building")))
    storeys = rows(spatial, *named(uri("storey"), ["bot:Storey", "ifc:IfcBuildingStorey"], "storey", F.col("storey")), row(uri("storey"), "props:elevation", F.col("elevation"), "typed_literal", F.lit("xsd:double")), row(uri("building"), "bot:hasStorey", uri("storey")))
    pset = F.concat_ws("/", e, F.col("pset"))
    name = F.concat(F.lit("props:"), F.replace("prop", F.lit(" "), F.lit("_")))
    sets = rows(properties.select("global_id", "pset").distinct(), row(pset, "rdf:type", F.lit("ifc:IfcPropertySet")), row(pset, "rdfs:label", F.col("pset"), "literal"), row(e, "ifc:hasPropertySet", pset))
    values = rows(properties, row(pset, name, F.col("value"), "typed_literal", literal_type(F.col("value"))))
    doc = F.concat(F.lit("inst:doc/"), F.col("doc_id").cast("string"))
    papers = rows(documents, row(doc, "rdf:type", F.lit("foaf:Document")), row(doc, "rdfs:label", F.col("filename"), "literal"), row(doc, "props:lifecyclePhase", F.col("phase"), "literal"), row(project, "foaf:topic", doc))
    for part in (shared, sites, buildings, storeys, sets, values, papers):
        out = out.unionByName(part)
    return out.where("subject is not null and object is not null").repartition(tasks, *out.columns).distinct()


def full(name: Column) -> Column:
    """A prefixed name as an address; names of other prefixes stay."""
    known = F.create_map(*[x for k, v in PREFIXES.items() for x in (F.lit(k), F.lit(v))])
    base = F.try_element_at(known, F.substring_index(name, ":", 1))
    return F.when(base.isNotNull(), F.concat(base, F.replace(F.substring(name, F.instr(name, ":") + 1, F.length(name)), F.lit(" "), F.lit("%20")))).otherwise(name)


def ntriples(rows: DataFrame) -> DataFrame:
    """One N-Triples line per row, all names as addresses."""
    text, address = F.concat(F.lit('"'), escaped(F.col("object")), F.lit('"')), lambda c: F.concat(F.lit("<"), full(F.col(c)), F.lit(">"))
    obj = F.when(F.col("object_type") == "uri", address("object")).when(F.col("datatype").isNotNull(), F.concat(text, F.lit("^^"), address("datatype"))).otherwise(text)
    return rows.select(F.concat_ws(" ", address("subject"), address("predicate"), obj, F.lit(".")).alias("value"))


def triple_stats(rows: DataFrame) -> DataFrame:
    """One row: triples, subjects, building elements, predicates."""
    return rows.agg(F.count("*").alias("n_triples"), F.count_distinct("subject").alias("n_subjects"), F.count_if((F.col("predicate") == "rdf:type") & F.col("object").startswith("ifc:Ifc")).alias("n_typed"), F.count_distinct("predicate").alias("n_predicates"))


def pattern_order(patterns: list[tuple[str, str, str]], sizes: list[int]) -> list[int]:
    """In which order patterns are joined: the smallest first, then always the smallest that shares a variable with those before. An error names patterns that share none."""
    variables = [{t for t in p if t.startswith("?")} for p in patterns]
    left = sorted(range(len(patterns)), key=lambda k: (sizes[k], k))
    order, bound = [], set()
    while left:
        near = [k for k in left if not order or variables[k] & bound]
        if not near:
            raise ValueError(f"no variable joins {[patterns[k] for k in left]} with the other patterns")
        order.append(near[0])
        bound |= variables[near[0]]
        left.remove(near[0])
    return order


def meets(pattern: tuple[str, str, str]) -> Column:
    """Whether a triple matches a pattern; a variable that stands twice in it asks for equal terms."""
    out, seen = F.lit(True), {}
    for column, term in zip(("subject", "predicate", "object"), pattern, strict=True):
        out = out & (F.col(column) == (F.col(seen[term]) if term in seen else F.lit(term))) if term in seen or not term.startswith("?") else out
        seen.setdefault(term, column)
    return out


def pattern_sizes(rows: DataFrame, patterns: list[tuple[str, str, str]]) -> DataFrame:
    """One row, n0 and on: how many triples match each pattern. Triples that match none are left out first, so that they are not dealt to keep each once."""
    return rows.where(reduce(Column.__or__, [meets(p) for p in patterns])).agg(*[F.count_if(meets(p)).alias(f"n{k}") for k, p in enumerate(patterns)])


def match_pattern(rows: DataFrame, patterns: list[tuple[str, str, str]]) -> DataFrame:
    """A basic graph pattern: terms that begin with '?' are variables, shared ones join. One column per variable, in the order of the patterns.

    One pass counts what each pattern matches; patterns are then joined from the smallest on, each with one that it shares a variable with.
    """
    out = None
    for k in pattern_order(patterns, list(pattern_sizes(rows, patterns).first())):
        named = {t[1:]: c for c, t in reversed(list(zip(("subject", "predicate", "object"), patterns[k], strict=True))) if t.startswith("?")}
        part = rows.where(meets(patterns[k])).select(*[F.col(c).alias(v) for v, c in named.items()]).distinct()
        out = part if out is None else out.join(part, [v for v in named if v in out.columns])
    return out.select(*dict.fromkeys(t[1:] for p in patterns for t in p if t.startswith("?")))


def type_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """kind (node or edge), type, n."""
    count = lambda df, kind, c: df.groupBy(F.col(c).alias("type")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "type", "n")
    return count(nodes, "node", "node_type").unionByName(count(edges, "edge", "edge_type"))


# Classes of places, and what relates one thing to another.
SPATIAL_TYPES = ("ifc:IfcProject", "ifc:IfcSite", "ifc:IfcBuilding", "ifc:IfcBuildingStorey", "ifc:IfcSpace")
LINKS = ("bot:containedIn", "bot:containsElement", "bot:hasSpace", "bot:hasStorey", "bot:hasBuilding", "bot:hasSite")


def triple_details(rows: DataFrame) -> DataFrame:
    """kind and name with n: `class` the classes of things in use, `property` the names of properties in use, `count` spatial and building things and links between things."""
    typed = rows.where("predicate = 'rdf:type' and object like 'ifc:Ifc%'")
    things = typed.where(~F.col("object").isin("ifc:IfcMaterial", "ifc:IfcPropertySet", "ifc:IfcClassificationReference"))
    of = lambda df, kind, name: df.groupBy(name.alias("name")).agg(F.count_distinct("subject").alias("n")).select(F.lit(kind).alias("kind"), "name", "n")
    out = of(things, "class", F.substring_index("object", ":", -1))
    out = out.unionByName(of(rows.where("predicate like 'props:%'"), "property", F.substring_index("predicate", ":", -1)))
    spatial = F.when(F.col("object").isin(*SPATIAL_TYPES), "spatial").otherwise("building")
    out = out.unionByName(of(things, "count", spatial))
    links = rows.where(F.col("predicate").isin(*LINKS)).groupBy().agg(F.count("*").alias("n"))
    return out.unionByName(links.select(F.lit("count").alias("kind"), F.lit("links").alias("name"), "n"))
