"""Queries over sources and sinks: what is written from the tables and read back, and STEP records made of them."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel.operators import enrich, graph, rules
from lintel.plans.model_queries import CHECKS, CROSS, EDGES, ESCAPED, FOUND, FULL, OBSERVED, PREFIXED, SPEC_ROWS, TOPICS, TRIPLES, all_checks, all_triples, edges, ids_specs, issue_topics, lookup, nodes, specifications, triple_tasks
from lintel.plans.registry import ORACLES, query
from lintel.plans.views import table, view
from lintel.sources import readers, sinks, step
from lintel.sources.scratch import scratch

GUID = "substr(md5({}), 1, 22)"


# Records of the model as STEP: element E is #100*ord+1, its properties #..10 to 13, their set #..2, relations #..3 to 5, materials from #..20 on, placement from #..30 on; storeys, buildings, sites and
# their relations count from 1, 2, 3 and 4 thousand million on, their placements from 6, 7 and 8 on; #9 thousand million is the project. Every other storey is turned by a right angle. The kind of material goes by ord % 7.
STOREYS = """(select storey, cast(substr(storey, 2) as bigint) as n, min(building) as building from (select storey, building from v_spatial union all select container, null from v_elements where container is not null) t group by 1, 2)"""
PLACES = f"""(select 1000000000 + n as id, 'IFCBUILDINGSTOREY' as type, storey as place, 6000000000 + n * 10 as p, case when building is not null then 7000000000 + cast(substr(building, 2) as bigint) * 10 + 2 end as up, n % 2 = 1 as turned from {STOREYS} s
    union all select 2000000000 + cast(substr(building, 2) as bigint), 'IFCBUILDING', building, 7000000000 + cast(substr(building, 2) as bigint) * 10, 8000000000 + cast(substr(site, 2) as bigint) * 10 + 2, false from (select distinct building, site from v_spatial) b
    union all select 3000000000 + cast(substr(site, 2) as bigint), 'IFCSITE', site, 8000000000 + cast(substr(site, 2) as bigint) * 10, null, false from (select distinct site from v_spatial) c)"""
PARTS = f"""(select 4000000000 + n as id, 2000000000 + cast(substr(building, 2) as bigint) as whole, 1000000000 + n as part, building as a, storey as b, 'IFCBUILDING' as ca, 'IFCBUILDINGSTOREY' as cb from {STOREYS} s where building is not null
    union all select 5000000000 + cast(substr(building, 2) as bigint), 3000000000 + cast(substr(site, 2) as bigint), 2000000000 + cast(substr(building, 2) as bigint), site, building, 'IFCSITE', 'IFCBUILDING' from (select distinct site, building from v_spatial) t
    union all select 10000000000 + cast(substr(site, 2) as bigint), 9000000000, 3000000000 + cast(substr(site, 2) as bigint), 'Project', site, 'IFCPROJECT', 'IFCSITE' from (select distinct site from v_spatial) t)"""
KIND = "case ord % 7 when 0 then 'list' when 1 then 'layer' when 2 then 'layer usage' when 3 then 'profile' when 4 then 'profile usage' else 'single' end"
HAS = "material is not null"
# id, type and references (in order) of every record.
STEP = f"""(select ord * 100 + 1 as id, upper(ifc_class) as type, [ord * 100 + 32] as refs from v_elements
    union all select ord * 100 + 30, 'IFCCARTESIANPOINT', [] from v_elements union all select ord * 100 + 31, 'IFCAXIS2PLACEMENT3D', [ord * 100 + 30] from v_elements
    union all select ord * 100 + 32, 'IFCLOCALPLACEMENT', case when container is null then [ord * 100 + 31] else [6000000000 + cast(substr(container, 2) as bigint) * 10 + 2, ord * 100 + 31] end from v_elements
    union all select (ord // 4) * 100 + 10 + ord % 4, 'IFCPROPERTYSINGLEVALUE', [] from v_properties union all select (ord // 4) * 100 + 2, 'IFCPROPERTYSET', list((ord // 4) * 100 + 10 + ord % 4 order by ord) from v_properties group by 1
    union all select ord * 100 + 3, 'IFCRELDEFINESBYPROPERTIES', [ord * 100 + 1, ord * 100 + 2] from v_elements
    union all select ord * 100 + 4, 'IFCRELCONTAINEDINSPATIALSTRUCTURE', [ord * 100 + 1, 1000000000 + cast(substr(container, 2) as bigint)] from v_elements where container is not null
    union all select ord * 100 + 5, 'IFCRELASSOCIATESCLASSIFICATION', [ord * 100 + 1, ord * 100 + 6] from v_elements union all select ord * 100 + 6, 'IFCCLASSIFICATIONREFERENCE', [] from v_elements
    union all select ord * 100 + 7, 'IFCRELASSOCIATESMATERIAL', [ord * 100 + 1, ord * 100 + case {KIND} when 'single' then 20 when 'list' then 21 when 'layer' then 23 when 'layer usage' then 24 when 'profile' then 26 else 27 end] from v_elements where {HAS}
    union all select ord * 100 + 20, 'IFCMATERIAL', [] from v_elements where {HAS} union all select ord * 100 + 21, 'IFCMATERIALLIST', [ord * 100 + 20, ord * 100 + 20] from v_elements where {HAS} and {KIND} = 'list'
    union all select ord * 100 + 22, 'IFCMATERIALLAYER', [ord * 100 + 20] from v_elements where {HAS} and {KIND} like 'layer%' union all select ord * 100 + 23, 'IFCMATERIALLAYERSET', [ord * 100 + 22] from v_elements where {HAS} and {KIND} like 'layer%'
    union all select ord * 100 + 24, 'IFCMATERIALLAYERSETUSAGE', [ord * 100 + 23] from v_elements where {HAS} and {KIND} = 'layer usage'
    union all select ord * 100 + 25, 'IFCMATERIALPROFILE', [ord * 100 + 20] from v_elements where {HAS} and {KIND} like 'profile%' union all select ord * 100 + 26, 'IFCMATERIALPROFILESET', [ord * 100 + 25] from v_elements where {HAS} and {KIND} like 'profile%'
    union all select ord * 100 + 27, 'IFCMATERIALPROFILESETUSAGE', [ord * 100 + 26] from v_elements where {HAS} and {KIND} = 'profile usage'
    union all select id, type, [p + 2] from {PLACES} p union all select 9000000000, 'IFCPROJECT', [] union all select p, 'IFCCARTESIANPOINT', [] from {PLACES} p union all select p + 1, 'IFCAXIS2PLACEMENT3D', case when turned then [p, p + 3] else [p] end from {PLACES} p
    union all select p + 2, 'IFCLOCALPLACEMENT', case when up is null then [p + 1] else [up, p + 1] end from {PLACES} p union all select p + 3, 'IFCDIRECTION', [] from {PLACES} p where turned union all select id, 'IFCRELAGGREGATES', [whole, part] from {PARTS} a)"""


def dealt(rows: DataFrame, key: str, rows_a_task: int = 50_000) -> DataFrame:
    """The rows over as many tasks as their number asks for: a small file, or one row group of it, holds many elements, each of which makes many records."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(rows.count() / rows_a_task)), key)


def step_rows(spark, sf) -> DataFrame:
    """file, value: STEP records of elements, all their properties, materials of every kind, classes and containers, and of the spatial tree."""
    e, p, tree = (view(spark, sf, v) for v in ("v_elements", "v_properties", "v_spatial"))
    dealt_e, p = dealt(e, "global_id"), dealt(p, "global_id")
    number = lambda c: F.substring(c, F.lit(2), F.length(c)).cast("long")
    ref = lambda n: F.concat(F.lit("#"), n.cast("string"))
    own = lambda k: ref(F.col("ord") * 100 + k)
    guid = lambda tag, c: F.substring(F.md5(F.concat(F.lit(tag), c)), 1, 22)
    line = lambda n, *parts: F.concat(ref(n) if not isinstance(n, int) else own(n), F.lit("="), *[F.lit(x) if isinstance(x, str) else x for x in parts])
    rel = lambda k, kind, tag, b: line(k, f"{kind}('", guid(tag, F.col("global_id")), "',$,$,$,(", own(1), "),", b, ")")
    kind, has = F.col("kind"), F.col("material").isNotNull()
    kinds = F.when(F.col("ord") % 7 == 0, "list").when(F.col("ord") % 7 == 1, "layer").when(F.col("ord") % 7 == 2, "layer usage").when(F.col("ord") % 7 == 3, "profile").when(F.col("ord") % 7 == 4, "profile usage").otherwise("single")
    at = F.when(kind == "single", own(20)).when(kind == "list", own(21)).when(kind == "layer", own(23)).when(kind == "layer usage", own(24)).when(kind == "profile", own(26)).otherwise(own(27))
    lines = [
        line(1, F.upper("ifc_class"), "('", guid("", F.col("global_id")), "',$,'", F.col("name"), "',$,$,", own(32), ",$)"),
        line(30, "IFCCARTESIANPOINT((", F.col("x").cast("string"), ",", F.col("y").cast("string"), ",", F.col("z").cast("string"), "))"), line(31, "IFCAXIS2PLACEMENT3D(", own(30), ",$,$)"),
        line(32, "IFCLOCALPLACEMENT(", F.coalesce(ref(number("container") * 10 + 6_000_000_002), F.lit("$")), ",", own(31), ")"), rel(3, "IFCRELDEFINESBYPROPERTIES", "d", own(2)),
        F.when(F.col("container").isNotNull(), rel(4, "IFCRELCONTAINEDINSPATIALSTRUCTURE", "c", ref(number("container") + 1_000_000_000))),
        rel(5, "IFCRELASSOCIATESCLASSIFICATION", "k", own(6)), line(6, "IFCCLASSIFICATIONREFERENCE($,'", F.col("ifc_class"), "','code',$)"),
        F.when(has, rel(7, "IFCRELASSOCIATESMATERIAL", "m", at)), F.when(has, line(20, "IFCMATERIAL('", F.col("material"), "')")), F.when(has & (kind == "list"), line(21, "IFCMATERIALLIST((", own(20), ",", own(20), "))")),
        F.when(has & kind.startswith("layer"), line(22, "IFCMATERIALLAYER(", own(20), ",0.25,$,$,$,$,$)")), F.when(has & kind.startswith("layer"), line(23, "IFCMATERIALLAYERSET((", own(22), "),$,$)")), F.when(has & (kind == "layer usage"), line(24, "IFCMATERIALLAYERSETUSAGE(", own(23), ",.AXIS2.,.POSITIVE.,0.,$)")),
        F.when(has & kind.startswith("profile"), line(25, "IFCMATERIALPROFILE('it''s (a, b)',$,", own(20), ",$,$,$)")), F.when(has & kind.startswith("profile"), line(26, "IFCMATERIALPROFILESET('s',$,(", own(25), "),$)")), F.when(has & (kind == "profile usage"), line(27, "IFCMATERIALPROFILESETUSAGE(", own(26), ",$,$)")),
    ]
    rows = dealt_e.withColumn("kind", kinds).select(F.explode(F.array_compact(F.array(*lines))).alias("value"))
    element, single = F.floor(F.col("ord") / 4), F.floor(F.col("ord") / 4) * 100 + 10 + F.col("ord") % 4
    value = F.coalesce(F.concat(F.lit("IFCLABEL('"), F.col("value"), F.lit("')")), F.lit("$"))
    rows = rows.unionByName(p.select(line(single, "IFCPROPERTYSINGLEVALUE('", F.col("prop"), "',$,", value, ",$)").alias("value")))
    sets = p.groupBy(element.alias("n"), "global_id", "pset").agg(F.array_join(F.transform(F.array_sort(F.collect_list(single)), ref), ",").alias("refs"))
    rows = rows.unionByName(sets.select(line(F.col("n") * 100 + 2, "IFCPROPERTYSET('", guid("p", F.col("global_id")), "',$,'", F.col("pset"), "',$,(", F.col("refs"), "))").alias("value")))
    storeys = tree.select("storey", "building").unionByName(e.where("container is not null").select(F.col("container").alias("storey"), F.lit(None).cast("string").alias("building"))).groupBy("storey").agg(F.min("building").alias("building"))
    one, two, three, moved = 1_000_000_000, 2_000_000_000, 3_000_000_000, 5_000_000_000
    storeys = storeys.join(tree.groupBy("storey").agg(F.max("elevation").alias("elevation")), "storey", "left")
    turned = number("storey") % 2 == 1

    def place(df, c, base, kind, up, point, rest="$)", turn=F.lit(False)):
        """A place, its point, axes, direction and placement."""
        p = number(c) * 10 + base + moved
        lines = [
            line(number(c) + base, f"{kind}('", guid("", F.col(c)), "',$,'", F.col(c), "',$,$,", ref(p + 2), ",", rest), line(p, "IFCCARTESIANPOINT((", *point, "))"),
            line(p + 1, "IFCAXIS2PLACEMENT3D(", ref(p), ",$,", F.when(turn, ref(p + 3)).otherwise("$"), ")"), line(p + 2, "IFCLOCALPLACEMENT(", F.coalesce(up, F.lit("$")), ",", ref(p + 1), ")"), F.when(turn, line(p + 3, "IFCDIRECTION((0.,2.,0.))")),
        ]
        return df.select(F.explode(F.array_compact(F.array(*lines))).alias("value")).distinct()

    part = lambda df, n, a, abase, b, bbase: df.select(line(number(b) + n, "IFCRELAGGREGATES('", guid("a", F.col(b)), "',$,$,$,", ref(number(a) + abase) if a else F.lit("#9000000000"), ",(", ref(number(b) + bbase), "))").alias("value")).distinct()
    digit = lambda n: F.concat(n.cast("string"), F.lit("."))
    for more in (
        place(storeys, "storey", one, "IFCBUILDINGSTOREY", ref(number("building") * 10 + two + moved + 2), [digit(number("storey") % 5), ",0.,3."], F.concat(F.lit("$,$,.ELEMENT.,"), F.coalesce(F.col("elevation").cast("string"), F.lit("$")), F.lit(")")), turned),
        place(tree, "building", two, "IFCBUILDING", ref(number("site") * 10 + three + moved + 2), [digit(number("building") * 10), ",5.,0."]),
        place(tree, "site", three, "IFCSITE", F.lit(None).cast("string"), ["1.E2,200."]),
        part(storeys.where("building is not null"), 4 * one, "building", two, "storey", one), part(tree, 5 * one, "site", three, "building", two), part(tree, 10 * one, None, 0, "site", three),
        tree.sparkSession.range(1).select(F.concat(F.lit("#9000000000=IFCPROJECT('"), guid("", F.lit("Project")), F.lit("',$,'Project',$,$,$,$,$,$)")).alias("value")),
    ):
        rows = rows.unionByName(more)
    return rows.select(F.lit("model").alias("file"), "value")


def records(spark, sf):
    """Parsed once and written: the tables that are made of them read it several times over."""
    path = scratch(spark, "records")
    step.parse_records(step_rows(spark, sf)).write.parquet(path)
    return spark.read.parquet(path)


@query(f"""select 'model' as file, type, n, row_number() over (order by n desc, type) as rank, cast(sum(n) over () as bigint) as total, count(*) over () as n_types from (select type, count(*) as n from {STEP} s group by 1) t qualify rank <= 30""")
def p1_step_census(spark, sf):
    # Read once, and types alone: nothing is written, arguments are not cut.
    return step.census(step.parse_records(step_rows(spark, sf)))


@query(f"select id as source, u.r as target, cast(u.i as int) as pos from (select id, unnest(list_transform(refs, lambda x, i: struct_pack(i := i - 1, r := x))) as u from {STEP} s) t")
def p2_step_reference_edges(spark, sf):
    return step.reference_edges(records(spark, sf)).select("source", "target", "pos")


@query(f"""select 'model' as file, 'contained_in' as type, {GUID.format('global_id')} as source, {GUID.format('container')} as target, upper(ifc_class) as source_class, 'IFCBUILDINGSTOREY' as target_class from v_elements where container is not null
    union all select 'model', 'aggregated_by', {GUID.format('b')}, {GUID.format('a')}, cb, ca from {PARTS} p""")
def p3_extract_relationships(spark, sf):
    return step.relationships(records(spark, sf))


@query(f"select 'model' as file, {GUID.format('global_id')} as global_id, pset, prop, value, false as is_quantity from v_properties")
def p4_extract_properties(spark, sf):
    return step.properties(records(spark, sf))


@query(f"""select 'model' as file, {GUID.format('global_id')} as global_id, split_part({KIND}, ' ', 1) as kind, material, case when {KIND} like 'layer%' then 0.25e0 end as thickness from v_elements where {HAS}
    union all select 'model', {GUID.format('global_id')}, 'list', material, null from v_elements where {HAS} and {KIND} = 'list'""")
def p5_extract_materials(spark, sf):
    return step.materials(records(spark, sf))


@query(f"select 'model' as file, {GUID.format('global_id')} as global_id, cast(null as string) as system, ifc_class as code, 'code' as name from v_elements")
def p6_extract_classifications(spark, sf):
    return step.classifications(records(spark, sf))


# World coordinates of elements in storeys that are turned, or not, and lie in buildings of sites, or not.
@query(f"""select {GUID.format('global_id')} as global_id, x, y, z, case when container is null then x else coalesce(b * 10, 0) + case when building is null then 0 else 100 end + n % 5 + case when n % 2 = 1 then -y else x end end as world_x,
      case when container is null then y else case when building is null then 0 else 205 end + case when n % 2 = 1 then x else y end end as world_y, case when container is null then z else z + 3 end as world_z
    from v_elements left join (select storey, n, building, cast(substr(building, 2) as bigint) as b from {STOREYS} s) t on container = storey
    union all select {GUID.format('storey')}, n % 5, 0, 3, n % 5 + coalesce(b * 10 + 100, 0), case when building is null then 0 else 205 end, 3 from (select storey, n, building, cast(substr(building, 2) as bigint) as b from {STOREYS} s) t
    union all select distinct {GUID.format('building')}, cast(substr(building, 2) as bigint) * 10, 5, 0, cast(substr(building, 2) as bigint) * 10 + 100, 205, 0 from v_spatial union all select distinct {GUID.format('site')}, 100, 200, 0, 100, 200, 0 from v_spatial""")
def p8_placements(spark, sf):
    return step.locations(records(spark, sf)).drop("file")


@query(f"""with storeys as (select storey, min(building) as building, min(site) as site, max(elevation) as elevation from (select storey, building, site, elevation from v_spatial union all select container, null, null, null from v_elements where container is not null) t group by 1),
    paths as (select storey, concat_ws('/', case when building is not null then 'Project' end, site, building, storey) as path, case when building is null then 0 else 3 end as depth from storeys)
    select {GUID.format("'Project'")} as global_id, 'IFCPROJECT' as type, 0 as depth, 'Project' as path, 0 as n_elements, cast(null as bigint) as level union all select distinct {GUID.format('site')}, 'IFCSITE', 1, 'Project/' || site, 0, null from v_spatial
    union all select distinct {GUID.format('building')}, 'IFCBUILDING', 2, 'Project/' || site || '/' || building, 0, null from v_spatial
    union all select {GUID.format('s.storey')}, 'IFCBUILDINGSTOREY', depth, path, coalesce(n, 0), row_number() over (partition by building order by coalesce(elevation, 0), s.storey) from storeys s join paths p on p.storey = s.storey
      left join (select container, count(*) as n from v_elements where ifc_class <> 'IfcSpace' group by 1) c on c.container = s.storey
    union all select {GUID.format('global_id')}, 'IFCSPACE', case when container is null then 0 else depth + 1 end, concat_ws('/', path, name), 0, null from v_elements left join paths on container = storey where ifc_class = 'IfcSpace'""")
def p7_hierarchy_of_the_model(spark, sf):
    return step.hierarchy(records(spark, sf)).drop("file")


@query("""select row_number() over (order by part, place, depth) - 1 as line, text from (
    select distinct 0 as part, site as place, 0 as depth, 'Site: ' || site_name as text from v_spatial union all select distinct 0, site || '/' || building, 1, '  Building: ' || building from v_spatial
    union all select distinct 0, site || '/' || building || '/' || storey, 2, '    Storey: ' || storey || ' (Elevation: ' || coalesce(cast(elevation as string), 'N/A') || ')' from v_spatial
    union all select 1, lpad(cast(e.ord as string), 20, '0'), 0, concat_ws(chr(10), ifc_class || ': ' || coalesce(name, 'Unnamed'), p.t, '  Material: ' || material) from (select * from v_elements order by ord limit 100) e
      left join (select global_id, string_agg('  ' || pset || '.' || prop || ': ' || coalesce(value, 'None'), chr(10) order by ord) as t from v_properties group by 1) p on p.global_id = e.global_id) t""")
def p10_model_text(spark, sf):
    return step.model_text(view(spark, sf, "v_elements"), view(spark, sf, "v_properties"), view(spark, sf, "v_spatial"))


@query(f"select id, type, len(list_distinct(refs)) > 0 as refers from {STEP} s")
def s2_read_step(spark, sf):
    path = scratch(spark, "step")
    step_rows(spark, sf).select(F.concat("value", F.lit(";")).alias("value")).write.text(path)
    return step.read_step(spark, path).select("id", "type", F.exists("args", lambda x: F.contains(x, F.lit("#"))).alias("refers"))


@query("select doc_id, length(text) as n_chars from v_documents where status = 'completed' and trim(text) <> ''")
def s1_read_parsed_documents(spark, sf):
    path = scratch(spark, "documents")
    rows = view(spark, sf, "v_documents").select(F.col("doc_id").cast("string").alias("file_id"), "status", F.col("text").alias("full_text"))
    # One file per task, each a sequence of documents.
    rows.write.json(path)
    back = readers.read_parsed_documents(spark, path, "*.json", one_per_file=False)
    return back.select(F.col("file_id").cast("long").alias("doc_id"), F.char_length("full_text").cast("long").alias("n_chars"))


@query("select global_id, pset, prop, value from v_properties where value is not null")
def s3_read_elements(spark, sf):
    path = scratch(spark, "elements")
    sets = view(spark, sf, "v_properties").where("value is not null").groupBy("global_id", "pset").agg(F.map_from_entries(F.collect_list(F.struct("prop", "value"))).alias("m"))
    sets.groupBy("global_id").agg(F.map_from_entries(F.collect_list(F.struct("pset", "m"))).alias("property_sets")).write.json(path)
    return readers.read_elements(spark, path)[1]


@query("select global_id, ifc_class, x from v_elements")
def s7_write_tabular(spark, sf):
    path = scratch(spark, "tabular")
    sinks.write_tabular(view(spark, sf, "v_elements").select("global_id", "ifc_class", "x"), path)
    return spark.read.schema("global_id string, ifc_class string, x double").option("header", True).csv(f"{path}/csv")


@query(f"select src, dst, edge_type from {EDGES} e")
def s10_write_graph(spark, sf):
    path = scratch(spark, "graph")
    sinks.write_graph(nodes(spark, sf), edges(spark, sf), path)
    return spark.read.schema("src string, dst string, edge_type string").json(f"{path}/edges")


NAME = "case when regexp_matches({0}, '^[A-Za-z0-9_]+:[A-Za-z0-9_-]+$') then {0} else '<' || " + FULL + " || '>' end"


@query(f"""select s || ' ' || string_agg(p, ' ; ' order by p) || ' .' as value from (select {NAME.format('subject')} as s, {NAME.format('predicate')} || ' ' || case when object_type = 'uri' then {NAME.format('object')} when datatype is not null then '"' || {ESCAPED} || '"^^' || datatype else '"' || {ESCAPED} || '"' end as p from {TRIPLES} t) s group by s
    union all select '@prefix ' || prefix || ': <' || base || '> .' from {PREFIXED} p""")
def s9_turtle(spark, sf):
    tasks = triple_tasks(spark, sf)
    return sinks.turtle(all_triples(spark, sf, tasks), graph.PREFIXES, tasks)


@query(f"select subject, predicate, count(*) as n, count(*) filter (where object_type = 'uri') as n_uris, count(datatype) as n_typed from {TRIPLES} t group by 1, 2")
def s9_json_ld(spark, sf):
    tasks = triple_tasks(spark, sf)
    lines = sinks.json_ld(all_triples(spark, sf, tasks), graph.PREFIXES, tasks)
    subject = F.get_json_object("value", "$.@id")
    body = F.map_filter(F.from_json("value", "map<string,string>"), lambda k, v: ~k.startswith("@"))
    rows = lines.select(subject.alias("subject"), F.explode(body).alias("predicate", "v")).withColumn("v", F.from_json("v", "array<struct<`@id`:string,`@value`:string,`@type`:string>>"))
    count = lambda f: F.size(F.filter("v", f)).cast("long")
    return rows.select("subject", "predicate", F.size("v").cast("long").alias("n"), count(lambda x: x["@id"].isNotNull()).alias("n_uris"), count(lambda x: x["@type"].isNotNull()).alias("n_typed"))


@query(f"select guid, title, topic_status, element from {TOPICS} t")
def s11_write_topics(spark, sf):
    path = scratch(spark, "topics")
    sinks.write_topics(issue_topics(spark, sf), path)
    return spark.read.schema("guid string, title string, topic_status string, element string").json(path)


@query(f"select spec, entity, facet, pset, name, kind, expected, array_to_string(options, '|') as options from {SPEC_ROWS} s")
def s5_ids_round_trip(spark, sf):
    return ids_specs(spark, sf).withColumn("options", F.array_join("options", "|"))


@query(f"""select facet, count(*) as n_requirements, count(distinct spec) as n_specs from {SPEC_ROWS} s group by 1""")
def s12_write_ids_rules(spark, sf):
    path = scratch(spark, "specifications")
    sinks.write_ids(specifications(spark, sf), path)
    lines = spark.read.text(path, recursiveFileLookup=True).select(F.explode(F.regexp_extract_all("value", F.lit("<(property|attribute|material|classification|partOf)[ >/]"), F.lit(1))).alias("facet"))
    specs = readers.read_ids(spark, path).groupBy("facet").agg(F.count_distinct("spec").alias("n_specs"))
    return lines.groupBy(F.lower("facet").alias("facet")).agg(F.count("*").alias("n_requirements")).join(specs, "facet")


@query(f"select ifc_class, pset, prop, required from {OBSERVED} o")
def s4_read_rule_config(spark, sf):
    path = scratch(spark, "requirements")
    item = F.struct(F.col("pset").alias("propertySet"), F.col("prop").alias("name"), "required")
    classes = rules.observed_requirements(view(spark, sf, "v_elements"), view(spark, sf, "v_properties")).groupBy("ifc_class").agg(F.struct(F.collect_list(item).alias("properties")).alias("r"))
    classes.agg(F.map_from_entries(F.collect_list(F.struct("ifc_class", "r"))).alias("requirements")).write.json(path)  # a rule file is one object
    return readers.read_rule_config(spark, path)


RATIONALE = "'asked of ' || ifc_class"


@query(f"""select ifc_class, 'property' as facet, pset, prop, required, {RATIONALE} as rationale, cast(null as string) as systems from {OBSERVED} o
    union all select distinct ifc_class, 'material', null, null, ifc_class in ('IfcBeam', 'IfcColumn'), 'structural', null from {OBSERVED} o
    union all select null, 'partof', null, null, true, 'placed', null union all select null, 'classification', null, null, false, 'coded', 'Uniclass2015,OmniClass'""")
def s4_read_requirements(spark, sf):
    path = scratch(spark, "requirements")
    item = F.struct(F.col("pset").alias("propertySet"), F.col("prop").alias("name"), "required", F.concat(F.lit("asked of "), F.col("ifc_class")).alias("rationale"))
    asked = lambda required, why: F.struct(required.alias("required"), F.lit(why).alias("rationale"))
    classes = rules.observed_requirements(view(spark, sf, "v_elements"), view(spark, sf, "v_properties")).groupBy("ifc_class").agg(F.collect_list(item).alias("properties"))
    classes = classes.select("ifc_class", F.struct("properties", asked(F.col("ifc_class").isin("IfcBeam", "IfcColumn"), "structural").alias("material")).alias("r"))
    every = F.struct(asked(F.lit(True), "placed").alias("spatial_containment"), F.struct(F.lit(False).alias("required"), F.array(F.lit("Uniclass2015"), F.lit("OmniClass")).alias("systems"), F.lit("coded").alias("rationale")).alias("classification"))
    classes.agg(F.map_from_entries(F.collect_list(F.struct("ifc_class", "r"))).alias("requirements")).withColumn("global_requirements", every).write.json(path)  # a rule file is one object
    return readers.read_requirements(spark, path).withColumn("systems", F.array_join("systems", ","))


CODED = "(select c.ifc_class, uniclass, omniclass from " + CROSS + " c where c.ifc_class in (select ifc_class from v_elements))"


@query(f"select ifc_class, uniclass, upper(ifc_class) as uniclass_name, case when ifc_class <> 'IfcDoor' then omniclass end as omniclass, case when ifc_class <> 'IfcDoor' then lower(ifc_class) end as omniclass_name, 'uri/' || ifc_class as uri from {CODED} c")
def s4_read_crosswalk(spark, sf):
    path = scratch(spark, "crosswalk")
    rows = enrich.crosswalk(spark).join(view(spark, sf, "v_elements").select("ifc_class").distinct(), "ifc_class")
    code = lambda c, name: F.struct(F.col(c).alias("code"), name.alias("name"))
    systems = F.struct(code("uniclass", F.upper("ifc_class")).alias("uniclass2015"), F.when(F.col("ifc_class") != "IfcDoor", code("omniclass", F.lower("ifc_class"))).alias("omniclass"), F.struct(F.concat(F.lit("uri/"), "ifc_class").alias("uri"), F.col("ifc_class").alias("guid")).alias("bsdd"))
    rows.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("ifc_class", systems)))).alias("value")).coalesce(1).write.text(path)  # a crosswalk is one object
    return readers.read_crosswalk(spark, path)


@query(f"select row_number() over (partition by ifc_class order by pset, prop) - 1 as ord, ifc_class, pset, prop as name, case when required then 'asked' end as data_type, 'mm' as unit from {OBSERVED} o")
def s4_read_dictionary(spark, sf):
    path = scratch(spark, "dictionary")
    item = F.struct(F.col("pset").alias("propertySet"), F.col("prop").alias("name"), F.when(F.col("required"), "asked").alias("dataType"), F.lit("mm").alias("unit"))
    classes = rules.observed_requirements(view(spark, sf, "v_elements"), view(spark, sf, "v_properties")).groupBy("ifc_class").agg(F.struct(F.array_sort(F.collect_list(item)).alias("properties")).alias("r"))
    classes.agg(F.map_from_entries(F.collect_list(F.struct("ifc_class", "r"))).alias("classes")).write.json(path)  # a dictionary is one object
    return readers.read_dictionary(spark, path)


@query("select ifc_class, '.csv' as extension, 'spreadsheet' as category, 'RFC 4180' as standard, cast(null as string) as model_schema, 64 as digits, true as has_bytes from (select distinct ifc_class from v_elements) t")
def s6_catalogue_files(spark, sf):
    path = scratch(spark, "files")
    view(spark, sf, "v_elements").select("global_id", "ifc_class").repartition("ifc_class").write.partitionBy("ifc_class").option("header", True).csv(path)  # one file for each class
    found = readers.catalogue_files(spark, path).where("extension = '.csv'")
    return found.select(F.regexp_extract("path", "ifc_class=([^/]+)/", 1).alias("ifc_class"), "extension", "category", "standard", "model_schema", F.length("checksum").alias("digits"), (F.col("size_kb") > 0).alias("has_bytes"))


@query(ORACLES["v8_validation_summary"])
def s13_write_summary(spark, sf):
    from lintel.operators.rules import validation_summary

    path = scratch(spark, "summary")
    sinks.write_summary(validation_summary(view(spark, sf, "v_elements"), all_checks(spark, sf)), path)
    return spark.read.schema("n_elements long, elements_passed long, n_checks long, checks_passed long, element_pass_rate double, check_pass_rate double").json(path)


SUMMARY = """input struct<total_elements:long, type_distribution:map<string,long>>, validation struct<total_checks:long, checks_passed:long, checks_failed:long, failures_by_type:map<string,long>>,
    enrichment struct<total_properties:long, properties_mapped_exact:long, properties_mapped_fuzzy:long, properties_not_found:long>, output_files array<struct<name:string, type:string, n_files:long, size_kb:double>>"""


@query(f"""select total_elements, walls, total_checks, checks_passed, checks_failed, wall_failures, total_properties, properties_mapped_exact, properties_mapped_fuzzy, properties_not_found, 'csv jsonl parquet schema' as folders, true as have_bytes
    from (select count(*) as total_elements, count(*) filter (where ifc_class = 'IfcWall') as walls from v_elements) a,
    (select count(*) as total_checks, count(*) filter (where result = 'PASS') as checks_passed, count(*) filter (where result = 'FAIL') as checks_failed, count(*) filter (where result = 'FAIL' and ifc_class = 'IfcWall') as wall_failures
      from {CHECKS} c) b,
    (select count(*) as total_properties, count(*) filter (where match = 'MAPPED') as properties_mapped_exact, count(*) filter (where match = 'FUZZY_MATCH') as properties_mapped_fuzzy, count(*) filter (where match = 'NOT_FOUND') as properties_not_found from {FOUND} f) d""")
def s13_run_summary(spark, sf):
    tables, path = scratch(spark, "tabular"), scratch(spark, "summary")
    elements, count = view(spark, sf, "v_elements").select("global_id", "ifc_class"), lambda cond, name: F.count_if(cond).alias(name)
    sinks.write_tabular(elements, tables)
    by_class = F.map_from_entries(F.collect_list(F.struct("ifc_class", "n")))
    sizes = elements.groupBy("ifc_class").agg(F.count("*").alias("n"))
    checks = all_checks(spark, sf).groupBy("ifc_class").agg(F.count("*").alias("all"), count(F.col("result") == "PASS", "good"), count(F.col("result") == "FAIL", "n"))
    parts = {
        "input": sizes.agg(F.sum("n").alias("total_elements"), by_class.alias("type_distribution")),
        "validation": checks.agg(F.sum("all").alias("total_checks"), F.sum("good").alias("checks_passed"), F.sum("n").alias("checks_failed"), by_class.alias("failures_by_type")),
        "enrichment": lookup(spark, sf).agg(F.count("*").alias("total_properties"), count(F.col("match") == "MAPPED", "properties_mapped_exact"), count(F.col("match") == "FUZZY_MATCH", "properties_mapped_fuzzy"), count(F.col("match") == "NOT_FOUND", "properties_not_found")),
    }
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(tables).select("path", "length")
    sinks.write_lines(sinks.nested_summary(parts, files).coalesce(1), path)
    back = spark.read.schema(SUMMARY).json(path)
    return back.select(
        "input.total_elements", F.col("input.type_distribution")["IfcWall"].alias("walls"), "validation.total_checks", "validation.checks_passed", "validation.checks_failed", F.col("validation.failures_by_type")["IfcWall"].alias("wall_failures"),
        "enrichment.*", F.array_join(F.sort_array(F.array_distinct(F.transform("output_files", lambda x: x["name"]))), " ").alias("folders"), F.forall("output_files", lambda x: x["size_kb"] > 0).alias("have_bytes"),
    )
