"""Queries over building elements: rules, checks, enrichment, graphs, features."""

from __future__ import annotations

from pyspark.sql import functions as F

from lintel.functions import values as V
from lintel.operators import cliques, enrich, features, graph, ids, ranks, rules
from lintel.plans.registry import query
from lintel.plans.views import view
from lintel.sources import readers, sinks
from lintel.sources.scratch import scratch


def literals(rows, columns: str) -> str:
    text = lambda x: "null" if x is None else str(x).lower() if isinstance(x, (bool, int, float)) else "'" + x.replace("'", "''") + "'"
    return f"(select * from (values {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) t({columns}))"


REQ = literals([(*r, i) for i, r in enumerate(rules.REQUIREMENTS)], "ifc_class, pset, prop, required, ord")
DICT = literals([(i, *r) for i, r in enumerate(enrich.DICTIONARY)], "ord, ifc_class, pset, name, data_type, unit")
ALIAS = literals(list(enrich.ALIASES.items()), "n, standard")
CROSS = literals(enrich.CROSSWALK, "ifc_class, uniclass, omniclass")
CLASSES = ["IfcBeam", "IfcColumn", "IfcCovering", "IfcDoor", "IfcRoof", "IfcSlab", "IfcSpace", "IfcStair", "IfcWall", "IfcWindow"]
RULES = f"""(select ifc_class, 'property' as facet, pset, prop, required from {REQ}
    union all select distinct ifc_class, 'material', null, null, true from {REQ} where ifc_class in ('IfcBeam', 'IfcColumn')
    union all select distinct ifc_class, 'partof', null, null, true from {REQ} union all select 'IfcStair', 'partof', null, null, true)"""
CHECKS = f"""(select e.global_id, e.ifc_class, r.facet, r.pset, r.prop,
    case when r.facet = 'property' then case when p.value is not null then 'PASS' when r.required then 'FAIL' else 'N/A' end
         when r.facet = 'material' then case when e.material is not null then 'PASS' else 'FAIL' end
         else case when e.container is not null then 'PASS' else 'FAIL' end end as result
    from v_elements e join {RULES} r on e.ifc_class = r.ifc_class
    left join v_properties p on p.global_id = e.global_id and p.pset = r.pset and p.prop = r.prop)"""
STATUS = f"""(select e.global_id, coalesce(n_pass, 0) as n_pass, coalesce(n_fail, 0) as n_fail, coalesce(n_warning, 0) as n_warning,
    case when coalesce(n_fail, 0) > 0 then 'FAIL' when coalesce(n_warning, 0) > 0 then 'WARNING' else 'PASS' end as status,
    case when coalesce(n_pass, 0) + coalesce(n_fail, 0) = 0 then 1.0e0 else n_pass * 1.0e0 / (n_pass + n_fail) end as pass_rate
    from v_elements e left join (select global_id, count(*) filter (where result = 'PASS') as n_pass, count(*) filter (where result = 'FAIL') as n_fail,
      count(*) filter (where result = 'WARNING') as n_warning from {CHECKS} c group by global_id) s on e.global_id = s.global_id)"""
NORM = "translate(lower({}), ' _-', '')"
FOUND = f"""(select p.*, coalesce(f1.name, f2.name, f3.name, f4.name) as standard_name,
    case when f1.name is not null then f1.data_type when f2.name is not null then f2.data_type when f3.name is not null then f3.data_type else f4.data_type end as data_type,
    case when f1.name is not null then f1.unit when f2.name is not null then f2.unit when f3.name is not null then f3.unit else f4.unit end as unit,
    case when f1.name is not null then 'MAPPED' when coalesce(f2.name, f3.name, f4.name) is not null then 'FUZZY_MATCH' else 'NOT_FOUND' end as match
    from v_properties p
    left join (select * from {DICT} d qualify row_number() over (partition by ifc_class, pset, {NORM.format('name')} order by ord) = 1) f1 on f1.ifc_class = p.ifc_class and f1.pset = p.pset and {NORM.format('f1.name')} = {NORM.format('p.prop')}
    left join (select * from {DICT} d qualify row_number() over (partition by ifc_class, {NORM.format('name')} order by ord) = 1) f2 on f2.ifc_class = p.ifc_class and {NORM.format('f2.name')} = {NORM.format('p.prop')}
    left join (select * from {DICT} d qualify row_number() over (partition by {NORM.format('name')} order by ord) = 1) f3 on {NORM.format('f3.name')} = {NORM.format('p.prop')}
    left join {ALIAS} a on a.n = {NORM.format('p.prop')}
    left join (select * from {DICT} d qualify row_number() over (partition by {NORM.format('name')} order by ord) = 1) f4 on {NORM.format('f4.name')} = a.standard)"""


def elements(spark, sf):
    return view(spark, sf, "v_elements")


def properties(spark, sf):
    return view(spark, sf, "v_properties")


def with_materials(spark, sf):
    return elements(spark, sf).withColumn("materials", F.array_compact(F.array("material")))


def all_rules(spark):
    return rules.build_rules(rules.requirements(spark), spark.createDataFrame([("IfcStair",), ("IfcWall",)], "ifc_class string"))


def all_checks(spark, sf):
    return rules.checks(with_materials(spark, sf), properties(spark, sf), all_rules(spark))


def lookup(spark, sf):
    return enrich.dictionary_lookup(properties(spark, sf), enrich.dictionary(spark))


# Rules of what the model itself carries: the classes of elements stand for those of a dictionary.
OBSERVED = f"""(select p.ifc_class, pset, prop, count(distinct global_id) >= {rules.REQUIRED_SHARE}e0 * max(s.n) as required from v_properties p join (select ifc_class, count(*) as n from v_elements group by 1) s on s.ifc_class = p.ifc_class
    where value is not null group by 1, 2, 3)"""
OWN_RULES = f"""(select ifc_class, 'property' as facet, pset, prop, required from {OBSERVED} o union all select distinct ifc_class, 'material', null, null, true from {OBSERVED} o where ifc_class in ('IfcBeam', 'IfcColumn')
    union all select distinct ifc_class, 'partof', null, null, true from v_elements)"""


def own_rules(spark, sf):
    return rules.build_rules(rules.observed_requirements(elements(spark, sf), properties(spark, sf)), elements(spark, sf))


@query(f"select ifc_class, facet, pset, prop, required from {OWN_RULES} r")
def v1_build_rules(spark, sf):
    return own_rules(spark, sf)


# Rules of ancestors hold for their classes too: what is observed of walls is asked of every building element.
INHERITED = f"""(select ifc_class, facet, pset, prop, required from {OWN_RULES} r union select a.c, facet, pset, prop, required from (select 'IfcBuildingElement' as up, facet, pset, prop, required from {OWN_RULES} w where ifc_class = 'IfcWall') r
    join (values {', '.join(f"('{c}', '{u}')" for c, up in rules.ANCESTORS.items() for u in up)}) a(c, u) on a.u = r.up)"""


@query(f"select ifc_class, facet, pset, prop, required from {INHERITED} r")
def j1_class_rules(spark, sf):
    own = own_rules(spark, sf)
    common = own.where("ifc_class = 'IfcWall'").withColumn("ifc_class", F.lit("IfcBuildingElement"))
    return rules.class_rules(own.unionByName(common)).where("ifc_class <> 'IfcBuildingElement'")


@query(f"""select e.global_id, e.ifc_class, r.facet, r.pset, r.prop, case when r.facet = 'property' then case when p.value is not null then 'PASS' when r.required then 'FAIL' else 'N/A' end
      when r.facet = 'material' then case when e.material is not null then 'PASS' else 'FAIL' end else case when e.container is not null then 'PASS' else 'FAIL' end end as result
    from v_elements e join {INHERITED} r on e.ifc_class = r.ifc_class left join v_properties p on p.global_id = e.global_id and p.pset = r.pset and p.prop = r.prop""")
def j1_inherited_checks(spark, sf):
    return rules.checks(with_materials(spark, sf), properties(spark, sf), j1_class_rules(spark, sf))


@query(f"select * from {CHECKS} c")
def j1_checks(spark, sf):
    return all_checks(spark, sf)


@query(f"select global_id, pset, prop, result from {CHECKS} c where facet = 'property'")
def v2_check_property(spark, sf):
    return all_checks(spark, sf).where("facet = 'property'").select("global_id", "pset", "prop", "result")


@query("""select global_id, case when material is not null then 'PASS' when ord % 2 = 0 then 'FAIL' else 'WARNING' end as result from v_elements""")
def v3_check_material(spark, sf):
    return with_materials(spark, sf).select("global_id", rules.check_material(F.col("materials"), F.col("ord") % 2 == 0).alias("result"))


@query(f"""select global_id, case when c.uniclass is null then case when ord % 2 = 0 then 'FAIL' else 'N/A' end
      when ord % 3 = 0 then 'PASS' when ord % 3 = 1 then 'PASS' when ord % 2 = 0 then 'FAIL' else 'WARNING' end as result
    from v_elements e left join {CROSS} c on c.ifc_class = e.ifc_class""")
def v4_check_classification(spark, sf):
    rows = elements(spark, sf).join(enrich.crosswalk(spark), "ifc_class", "left")
    systems = F.when(F.col("uniclass").isNotNull(), F.array(F.lit("Uniclass2015")))
    wanted = F.when(F.col("ord") % 3 == 0, F.lit(None).cast("string")).when(F.col("ord") % 3 == 1, "Uniclass2015").otherwise("OmniClass")
    return rows.select("global_id", rules.check_classification(systems, wanted, F.col("ord") % 2 == 0).alias("result"))


@query("select global_id, case when container is not null then 'PASS' when ord % 2 = 0 then 'FAIL' else 'N/A' end as result from v_elements")
def v5_check_partof(spark, sf):
    return elements(spark, sf).select("global_id", rules.check_partof(F.col("container"), F.col("ord") % 2 == 0).alias("result"))


@query("select global_id, case when material is null then 'FAIL' when ord % 2 = 0 or material = 'ECONOMY' then 'PASS' else 'FAIL' end as result from v_elements")
def v6_check_attribute(spark, sf):
    expected = F.when(F.col("ord") % 2 == 0, F.lit(None).cast("string")).otherwise("ECONOMY")
    return elements(spark, sf).select("global_id", rules.check_attribute(F.col("material"), expected).alias("result"))


@query(f"select * from {STATUS} s")
def v7_element_status(spark, sf):
    return rules.element_status(elements(spark, sf), all_checks(spark, sf))


@query(f"""select n_elements, elements_passed, n_checks, checks_passed, round(elements_passed * 100.0e0 / n_elements, 1) as element_pass_rate, round(checks_passed * 100.0e0 / n_checks, 1) as check_pass_rate
    from (select count(*) as n_elements, count(*) filter (where status = 'PASS') as elements_passed from {STATUS} s) a, (select count(*) as n_checks, count(*) filter (where result = 'PASS') as checks_passed from {CHECKS} c) b""")
def v8_validation_summary(spark, sf):
    return rules.validation_summary(elements(spark, sf), all_checks(spark, sf))


@query(f"select ifc_class, facet || ': ' || coalesce(prop, facet) as rule, count(*) as n_failed from {CHECKS} c where result = 'FAIL' group by 1, 2")
def v8_failures(spark, sf):
    return rules.failures(all_checks(spark, sf))


@query(f"""select p.global_id, p.prop, case when p.prop = 'IsExternal' then p.value = 'true' when p.prop = 'LoadBearing' then p.value in ('yes', 'no')
      when p.prop like 'Thermal%' then regexp_matches(p.value, '^(?:[0-9]+ c)') when p.prop = 'Unknown Prop' then coalesce(try_cast(p.value as double) between 30 and 60, false) when p.prop = 'FireRating' then coalesce(try_cast(p.value as double) <= 44, false) else true end as holds from v_properties p where p.value is not null""")
def f8_value_constraint(spark, sf):
    kind = F.when(F.col("prop") == "IsExternal", "simple").when(F.col("prop") == "LoadBearing", "enumeration").when(F.col("prop").startswith("Thermal"), "pattern").when(F.col("prop").isin("Unknown Prop", "FireRating"), "bounds").otherwise("none")
    options = F.when(F.col("prop") == "Unknown Prop", F.array(F.lit("30"), F.lit("60"))).when(F.col("prop") == "FireRating", F.array(F.lit(None).cast("string"), F.lit("44"))).otherwise(F.array(F.lit("yes"), F.lit("no")))
    expected = F.when(F.col("prop") == "IsExternal", "true").otherwise("[0-9]+ c")
    rows = properties(spark, sf).where("value is not null")
    return rows.select("global_id", "prop", rules.value_constraint(kind, expected, options, F.col("value")).alias("holds"))


@query(f"""select global_id, ifc_class, facet, pset, prop, result from {CHECKS} c where result = 'FAIL' and ifc_class = 'IfcWall'""")
def f9_filter_checks(spark, sf):
    return all_checks(spark, sf).where("result = 'FAIL' and ifc_class = 'IfcWall'")


GAP = f"""(select e.global_id, e.ifc_class, string_agg('- ' || r.pset || '.' || r.prop, chr(10) order by r.pset || '.' || r.prop) as missing from v_elements e join (select * from {REQ} q where required) r on r.ifc_class = e.ifc_class
    left join v_properties p on p.global_id = e.global_id and p.pset = r.pset and p.prop = r.prop where p.value is null group by 1, 2)"""
WRONG = """(select global_id, ifc_class, string_agg('- ' || prop || ': not allowed', chr(10) order by prop) as errors from v_properties where prop in ('IsExternal', 'LoadBearing') and value not in ('true', 'false', 'yes') group by 1, 2)"""


def topic_sql() -> str:
    return f"""(select *, 'Open' as topic_status, md5(source || '|' || element || '|' || title) as guid from (
      select 'Rules' as source, 'Missing ' || facet || ': ' || coalesce(prop, facet) as title, cast(null as string) as description, 'Error' as topic_type, 'High' as priority, ifc_class, global_id as element from {CHECKS} c where result = 'FAIL'
      union all select 'IDS', '[' || upper(r.facet) || '] ' || coalesce(r.name, r.facet), null, 'Error', 'High', e.ifc_class, r.global_id from {IDS_RESULTS} r join v_elements e on e.global_id = r.global_id where r.result = 'FAIL'
      union all select 'LOIN', 'Missing LOIN Properties: ' || ifc_class, 'missing in design:' || chr(10) || missing, 'Warning', 'Normal', ifc_class, global_id from {GAP} g
      union all select 'bSDD', 'bSDD Value Mismatch: ' || ifc_class, errors, 'Warning', 'Normal', ifc_class, global_id from {WRONG} w) t)"""


def issue_topics(spark, sf):
    rows = elements(spark, sf)
    gaps = rules.missing_properties(rows, properties(spark, sf), rules.requirements(spark)).withColumn("phase", F.lit("design"))
    allowed = F.when(F.col("prop").isin("IsExternal", "LoadBearing"), F.array(F.lit("true"), F.lit("false"), F.lit("yes")))
    error = rules.value_errors(F.col("value"), allowed, F.lit(None).cast("double"), F.lit(None).cast("double"))
    wrong = properties(spark, sf).where("value is not null").withColumn("error", error).where("error is not null").groupBy("global_id", "ifc_class").agg(F.collect_list(F.concat_ws(": ", "prop", "error")).alias("errors"))
    results = ids_results(spark, sf).join(rows.select("global_id", "ifc_class"), "global_id")
    return rules.issue_topics(all_checks(spark, sf), ids_results=results, gaps=gaps, mismatches=wrong)


@query(f"""select e.global_id, count(r.prop) as n_required, count(*) filter (where r.prop is not null and p.value is null and r.required) as n_missing,
      count(*) filter (where p.value is not null and r.prop = 'LoadBearing' and p.value <> 'yes') as n_invalid,
      count(*) filter (where p.value is not null and not (r.prop = 'LoadBearing' and p.value <> 'yes')) as n_valid,
      case when count(r.prop) = 0 then 1.0e0 else count(*) filter (where p.value is not null and not (r.prop = 'LoadBearing' and p.value <> 'yes')) * 1.0e0 / count(r.prop) end as completeness
    from v_elements e left join {REQ} r on r.ifc_class = e.ifc_class left join v_properties p on p.global_id = e.global_id and p.pset = r.pset and p.prop = r.prop group by e.global_id""")
def v12_loin_completeness(spark, sf):
    allowed = F.when(F.col("prop") == "LoadBearing", F.array(F.lit("yes")))
    required = rules.requirements(spark).select("ifc_class", "pset", "prop", "required", allowed.alias("allowed"), F.lit(None).cast("double").alias("least"), F.lit(None).cast("double").alias("most"))
    return rules.loin_completeness(elements(spark, sf), properties(spark, sf), required)


@query(f"""select e.entity, r.pset, r.prop, r.required from (select distinct ifc_class as entity from v_elements) e join {REQ} r on r.ifc_class = e.entity""")
def v10_required_properties(spark, sf):
    present = elements(spark, sf).select(F.col("ifc_class").alias("entity")).distinct()
    return rules.required_properties(rules.requirements(spark)).join(present, "entity", "left_semi")


@query("""select ifc_class as entity, p as phase, case max(r) when 3 then 'detailed' when 2 then 'normal' else 'simplified' end as detail
    from (select ifc_class, ord % 3 as p, case ord % 7 when 0 then 3 when 1 then 2 else 1 end as r from v_elements) t group by 1, 2""")
def v11_geometry_requirement(spark, sf):
    detail = F.when(F.col("ord") % 7 == 0, "detailed").when(F.col("ord") % 7 == 1, "normal").otherwise("simplified")
    rows = elements(spark, sf).select(F.col("ifc_class").alias("entity"), (F.col("ord") % 3).alias("phase"), detail.alias("detail"))
    return rules.geometry_requirement(rows, {"simplified": 1, "normal": 2, "detailed": 3})


@query("""select global_id, prop, coalesce(case prop when 'IsExternal' then value in ('true', 'false') when 'FireRating' then try_cast(value as double) is not null and try_cast(value as double) <= 60 else true end, false) as valid
    from v_properties where value is not null""")
def v13_dictionary_values(spark, sf):
    rows = properties(spark, sf).where("value is not null")
    allowed = F.when(F.col("prop") == "IsExternal", F.array(F.lit("true"), F.lit("false")))
    fire = F.col("prop") == "FireRating"
    return rows.select("global_id", "prop", enrich.validate_dictionary_value(F.col("value"), allowed, F.lit(None).cast("double"), F.when(fire, 60.0), fire).alias("valid"))


@query(f"select global_id, pset, prop, value, ord, ifc_class, standard_name, data_type, unit, match from {FOUND} f")
def j2_dictionary_lookup(spark, sf):
    return lookup(spark, sf)


@query(f"""select global_id, count(*) as total, count(*) filter (where match = 'MAPPED') as exact, count(*) filter (where match = 'FUZZY_MATCH') as fuzzy, count(*) filter (where match = 'NOT_FOUND') as not_found,
      round(count(*) filter (where match <> 'NOT_FOUND') * 100.0e0 / count(*), 1) as rate from {FOUND} f group by 1""")
def a5_enrichment_stats(spark, sf):
    return enrich.enrichment_stats(lookup(spark, sf))


@query(f"""select count(*) as total, count(*) filter (where match = 'MAPPED') as exact, count(*) filter (where match = 'FUZZY_MATCH') as fuzzy, count(*) filter (where match = 'NOT_FOUND') as not_found, count(distinct f.global_id) as n_elements,
      round(count(*) filter (where match <> 'NOT_FOUND') * 100.0e0 / count(*), 1) as rate, count(distinct f.global_id) filter (where c.ifc_class is not null) as n_coded from {FOUND} f left join {CROSS} c on c.ifc_class = f.ifc_class""")
def a5_enrichment_totals(spark, sf):
    return enrich.enrichment_totals(lookup(spark, sf), enrich.crosswalk(spark))


MAPPED = f"""(select global_id, pset, prop, entry, confidence from (select p.global_id, p.pset, p.prop, d.name as entry, d.ord as o,
      case when p.prop = d.name then 1.0e0 when translate(lower(p.prop), ' _', '') = translate(lower(d.name), ' _', '') then 0.9e0
        when contains(translate(lower(p.prop), ' _', ''), translate(lower(d.name), ' _', '')) or contains(translate(lower(d.name), ' _', ''), translate(lower(p.prop), ' _', '')) then 0.7e0 end as confidence
    from v_properties p join {DICT} d on d.ifc_class = p.ifc_class) t where confidence is not null qualify row_number() over (partition by global_id, pset, prop order by o) = 1)"""


@query(f"select * from {MAPPED} m")
def j3_dictionary_mapping(spark, sf):
    return enrich.dictionary_mapping(properties(spark, sf), enrich.dictionary(spark))


@query(f"""select e.global_id, e.ifc_class, d.name as entry from v_elements e join {DICT} d on d.ifc_class = e.ifc_class
    where not exists (select 1 from {MAPPED} m where m.global_id = e.global_id and m.entry = d.name)""")
def j4_missing_dictionary_properties(spark, sf):
    entries = enrich.dictionary(spark)
    return enrich.missing_dictionary_properties(elements(spark, sf), enrich.dictionary_mapping(properties(spark, sf), entries), entries)


@query(f"select e.global_id, e.ifc_class, uniclass, omniclass, 'https://identifier.buildingsmart.org/uri/buildingsmart/ifc/4.3/class/' || e.ifc_class as uri from v_elements e left join {CROSS} c on c.ifc_class = e.ifc_class")
def j5_cross_link(spark, sf):
    return enrich.cross_link(elements(spark, sf), enrich.crosswalk(spark))


@query(f"select global_id, ifc_class from v_elements e where not exists (select 1 from {CROSS} c where c.ifc_class = e.ifc_class)")
def j6_elements_without_classification(spark, sf):
    return elements(spark, sf).join(enrich.crosswalk(spark), "ifc_class", "left_anti").select("global_id", "ifc_class")


@query("""select s.storey, s.site_name, e.global_id, p.prop, p.value from v_spatial s join v_elements e on e.container = s.storey join v_properties p on p.global_id = e.global_id where e.ifc_class = 'IfcWall'""")
def j7_storey_wall_properties(spark, sf):
    walls = elements(spark, sf).where("ifc_class = 'IfcWall'").select("global_id", F.col("container").alias("storey"))
    return view(spark, sf, "v_spatial").select("storey", "site_name").join(walls, "storey").join(properties(spark, sf).select("global_id", "prop", "value"), "global_id").select("storey", "site_name", "global_id", "prop", "value")


@query("select container, global_id, name from v_elements where container in (select storey from v_spatial where elevation > 0)")
def j8_elements_in_space(spark, sf):
    storeys = view(spark, sf, "v_spatial").where("elevation > 0").select(F.col("storey").alias("container"))
    return elements(spark, sf).join(storeys, "container", "left_semi").select("container", "global_id", "name")


SPECS = literals([("walls", "simple", "IFCWALL", None, "IsExternal"), ("openings", "enumeration", None, "IFCDOOR,IFCWINDOW", None), ("stairs and slabs", "pattern", "IFCS(TAIR|LAB)$", None, "LoadBearing")], "spec, kind, entity, options, prop")


@query(f"""select s.spec, e.global_id from v_elements e join {SPECS} s on case s.kind when 'simple' then upper(e.ifc_class) = s.entity when 'pattern' then regexp_matches(upper(e.ifc_class), '^(?:' || s.entity || ')') else list_contains(string_split(s.options, ','), upper(e.ifc_class)) end
    where s.prop is null or exists (select 1 from v_properties p where p.global_id = e.global_id and p.prop = s.prop)""")
def j9_ids_applicability(spark, sf):
    specs = [("walls", "simple", "IFCWALL", None, "IsExternal"), ("openings", "enumeration", None, ["IFCDOOR", "IFCWINDOW"], None), ("stairs and slabs", "pattern", "IFCS(TAIR|LAB)$", None, "LoadBearing")]
    return ids.applicable(elements(spark, sf), properties(spark, sf), spark.createDataFrame(specs, "spec string, kind string, entity string, options array<string>, prop string"))


SPEC_ROWS = f"""(select ifc_class || ' property' as spec, upper(ifc_class) as entity, 'property' as facet, pset, prop as name, case when len(v) <= {ids.MOST_OPTIONS} then 'enumeration' end as kind, cast(null as string) as expected, case when len(v) <= {ids.MOST_OPTIONS} then list_sort(v) end as options
      from (select r.ifc_class, r.pset, r.prop, list(distinct p.value) as v from {OWN_RULES} r join v_properties p on p.ifc_class = r.ifc_class and p.pset = r.pset and p.prop = r.prop where r.facet = 'property' and r.required and p.value is not null group by 1, 2, 3) t
    union all select ifc_class || ' material', upper(ifc_class), 'material', null, null, null, null, null from {OWN_RULES} r where facet = 'material'
    union all select ifc_class || ' attribute', upper(ifc_class), 'attribute', null, 'name', 'pattern', '[a-z]+( [a-z]+)+$', null from (select distinct ifc_class from v_elements) c
    union all select ifc_class || ' classification', upper(ifc_class), 'classification', null, 'Uniclass2015', null, null, null from (select distinct ifc_class from v_elements) c
    union all select ifc_class || ' partof', upper(ifc_class), 'partof', null, null, null, 'IfcBuildingStorey', null from (select distinct ifc_class from v_elements) c)"""
IDS_RESULTS = f"""(select s.spec, e.global_id, s.facet, s.pset, s.name, case when case s.facet when 'property' then p.value is not null and (s.kind is null or list_contains(s.options, p.value)) when 'attribute' then regexp_matches(e.name, '^(?:' || s.expected || ')')
      when 'material' then e.material is not null when 'classification' then c.uniclass is not null else w.source is not null end then 'PASS' else 'FAIL' end as result
    from v_elements e join {SPEC_ROWS} s on s.entity = upper(e.ifc_class) left join v_properties p on s.facet = 'property' and p.global_id = e.global_id and p.pset = s.pset and p.prop = s.name
    left join {CROSS} c on c.ifc_class = e.ifc_class left join (select distinct source from v_relationships where type in ('contained_in', 'aggregated_by') and target_class = 'IfcBuildingStorey') w on w.source = e.global_id)"""


def specifications(spark, sf):
    return ids.specifications(own_rules(spark, sf), properties(spark, sf))


def ids_specs(spark, sf):
    """The model's specifications, written as XML and read back."""
    path = scratch(spark, "ids")
    sinks.write_ids(specifications(spark, sf), path)
    return readers.read_ids(spark, path)


def ids_results(spark, sf):
    rows = with_materials(spark, sf).join(enrich.crosswalk(spark), "ifc_class", "left").withColumn("systems", F.array_compact(F.array(F.when(F.col("uniclass").isNotNull(), "Uniclass2015"), F.when(F.col("omniclass").isNotNull(), "OmniClass"))))
    return ids.validate(rows, properties(spark, sf), view(spark, sf, "v_relationships"), ids_specs(spark, sf))


@query(f"select spec, global_id, facet, pset, name, result from {IDS_RESULTS} r")
def v9_ids_validate(spark, sf):
    return ids_results(spark, sf)


@query(f"""select count(*) as total, count(*) filter (where good) as n_passed, count(*) filter (where not good) as n_failed, round(count(*) filter (where good) * 100.0e0 / count(*), 6) as pass_rate
    from (select spec, global_id, bool_and(result = 'PASS') as good from {IDS_RESULTS} r group by 1, 2) t""")
def v9_ids_summary(spark, sf):
    return ids.summary(ids_results(spark, sf))


TOPICS = topic_sql()


@query(f"select guid, row_number() over (order by source, ifc_class, element, title) as idx, source, title, description, topic_type, priority, topic_status, ifc_class, element from {TOPICS} t")
def v20_issue_topics(spark, sf):
    return issue_topics(spark, sf)


@query(f"""select 'status' as dimension, topic_status as value, count(*) as n from {TOPICS} t group by 2 union all select 'type', topic_type, count(*) from {TOPICS} t group by 2 union all select 'source', source, count(*) from {TOPICS} t group by 2
    union all select 'total', null, count(*) from {TOPICS} t union all select 'open', null, count(*) from {TOPICS} t where topic_status = 'Open'""")
def a6_topic_summary(spark, sf):
    from lintel.operators.lake import topic_summary

    return topic_summary(issue_topics(spark, sf))


@query(f"select element, count(*) as n_topics from {TOPICS} t where topic_status = 'Open' group by 1")
def j15_topics_for_element(spark, sf):
    topics = issue_topics(spark, sf).withColumn("affected", F.array("element"))
    return topics.where("topic_status = 'Open'").select(F.explode("affected").alias("element")).groupBy("element").agg(F.count("*").alias("n_topics"))


@query("""select e.global_id, case when count(r.source) = 0 then 'FAIL' when count(*) filter (where r.target_class = 'IfcBuildingStorey') > 0 then 'PASS' else 'FAIL' end as result
    from v_elements e left join v_relationships r on r.source = e.global_id and r.type in ('contained_in', 'aggregated_by') group by 1""")
def j10_part_of_check(spark, sf):
    return ids.part_of(elements(spark, sf), view(spark, sf, "v_relationships"), "IfcBuildingStorey")


SUGGEST = literals([("Ss_25_10_30", "Wall systems", "IfcWall"), ("Pr_30_59_29", "Doors", "IfcDoor"), ("Ss_25_10_31", "Curtain wall systems", "IfcCurtainWall"), ("X_1", "Wall coverings", "IfcCovering")], "code, class_name, related")


@query(f"""select global_id, code, confidence, rank from (select *, row_number() over (partition by global_id order by confidence desc, code) as rank from
    (select e.global_id, s.code, case when contains(s.related, e.ifc_class) then 0.8e0 else 0.5e0 end as confidence from v_elements e join {SUGGEST} s on contains(lower(s.class_name), lower(substr(e.ifc_class, 4)))) t) u where rank <= 10""")
def j17_classification_suggestions(spark, sf):
    classes = spark.createDataFrame([("Ss_25_10_30", "Wall systems", "IfcWall"), ("Pr_30_59_29", "Doors", "IfcDoor"), ("Ss_25_10_31", "Curtain wall systems", "IfcCurtainWall"), ("X_1", "Wall coverings", "IfcCovering")], "code string, class_name string, related string")
    return enrich.classification_suggestions(elements(spark, sf), classes)


# Values


@query(f"select distinct prop, {NORM.format('prop')} as long_form, translate(lower(prop), ' _', '') as short_form from v_properties")
def x1_normalize_name(spark, sf):
    return properties(spark, sf).select("prop").distinct().select("prop", V.normalize_name(F.col("prop")).alias("long_form"), V.normalize_name(F.col("prop"), dashes=False).alias("short_form"))


# All rows of fire ratings, under whatever name.
RATED = "prop in ('FireRating', 'Fire Rating', 'fire_rating', 'Unknown Prop')"


@query(f"""select global_id, value, case value when '2HR' then 'P2H' when '90 min' then 'P1H30M' when '45' then 'P45M' when 'REI60' then 'REI60' end as duration from v_properties where {RATED}""")
def x2_fire_rating(spark, sf):
    return properties(spark, sf).where(RATED).select("global_id", "value", V.fire_rating_duration(F.col("value")).alias("duration"))


@query("""select global_id, case when value like '% cm' then round(try_cast(replace(value, ' cm', '') as double) * 10.0, 4) when value like '% m' then round(try_cast(replace(value, ' m', '') as double) * 1000.0, 4)
    else try_cast(value as double) end as number from v_properties where prop like 'Thermal%'""")
def x3_normalize_numeric(spark, sf):
    return properties(spark, sf).where("prop like 'Thermal%'").select("global_id", V.normalize_numeric(F.col("value"), F.lit("mm")).alias("number"))


@query("select global_id, prop, case when lower(value) in ('true', 'yes', '1', 't') then 'true' when lower(value) in ('false', 'no', '0', 'f') then 'false' else value end as flag from v_properties where prop in ('IsExternal', 'LoadBearing')")
def x4_normalize_boolean(spark, sf):
    return properties(spark, sf).where(F.col("prop").isin("IsExternal", "LoadBearing")).select("global_id", "prop", V.normalize_boolean(F.col("value")).alias("flag"))


@query(f"""select global_id, pset, prop, standard_name, match, case upper(data_type) when 'DURATION' then case value when '2HR' then 'P2H' when '90 min' then 'P1H30M' when '45' then 'P45M' else value end
      when 'BOOLEAN' then case when value in ('true', 'yes') then 'true' when value in ('no', 'false') then 'false' else value end else value end as normalized from {FOUND} f where coalesce(data_type, '') <> 'Real'""")
def x5_normalize_value(spark, sf):
    found = enrich.enriched(properties(spark, sf), enrich.dictionary(spark)).where("coalesce(data_type, '') <> 'Real'")
    return found.select("global_id", "pset", "prop", "standard_name", "match", "normalized")


@query(f"select global_id, value, case when value like '%REI60%' then 1.0e0 else 0.0e0 end as hours from v_properties where {RATED}")
def x6_encode_fire_rating(spark, sf):
    return properties(spark, sf).where(RATED).select("global_id", "value", V.encode_fire_rating(F.col("value")).alias("hours"))


@query("select global_id, prop, case when value is null then 0.0e0 else (cast('0x' || substr(md5(value), 1, 8) as bigint) % 1000) / 1000.0e0 end as hashed from v_properties")
def x7_feature_hash(spark, sf):
    return properties(spark, sf).select("global_id", "prop", V.feature_hash(F.col("value")).alias("hashed"))


@query("select global_id, substr(md5(global_id || '_' || ifc_class), 1, 8) as short_id, substr(md5(global_id || '_' || ifc_class), 1, 12) as long_id from v_elements")
def x8_short_id(spark, sf):
    return elements(spark, sf).select("global_id", V.short_id(F.col("global_id"), F.col("ifc_class")).alias("short_id"), V.short_id(F.col("global_id"), F.col("ifc_class"), length=12).alias("long_id"))


@query("select distinct name, 'https://example.org/project/' || replace(name, ' ', '%20') as uri from v_elements")
def x9_entity_uri(spark, sf):
    return elements(spark, sf).select("name").distinct().select("name", V.entity_uri("https://example.org/project", F.col("name")).alias("uri"))


@query("""select global_id, prop, value, case when lower(value) in ('true', 'false') then 'xsd:boolean' when regexp_matches(value, '^-?[0-9]+$') then 'xsd:integer' when regexp_matches(value, '^-?[0-9]+\\.[0-9]+$') then 'xsd:double' else 'xsd:string' end as datatype
    from v_properties where value is not null""")
def x10_typed_literal(spark, sf):
    return properties(spark, sf).where("value is not null").select("global_id", "prop", "value", V.literal_type(F.col("value")).alias("datatype"))


@query("select global_id, max(value) as external from v_properties where pset like 'Pset\\_%Common' escape '\\' and prop = 'IsExternal' group by 1")
def x11_extract_path(spark, sf):
    from lintel.operators.paths import extract_path

    return extract_path(properties(spark, sf), "Pset_*Common.IsExternal", "external")


@query("""select global_id, max(case when prop = 'IsExternal' then value end) as external, max(case when n = 1 then prop end) as first_prop, max(case when n = 2 then value end) as second_value, max(kind) as kind, cast(null as string) as beyond
    from (select *, substr(ifc_class, 4) as kind, row_number() over (partition by global_id order by ord) as n from v_properties) p group by 1""")
def x11_nested_paths(spark, sf):
    from lintel.operators.paths import extract_paths

    rows = properties(spark, sf).groupBy("global_id", "pset").agg(F.sort_array(F.collect_list(F.struct("ord", "prop", "value"))).alias("listed"), F.first(F.substr("ifc_class", F.lit(4))).alias("kind"))
    sets = F.map_from_entries(F.array(F.struct("pset", F.map_from_entries(F.transform("listed", lambda x: F.struct(x["prop"], x["value"]))))))
    nested = rows.select("global_id", F.parse_json(F.to_json(F.struct(sets.alias("sets"), "listed", F.struct("kind").alias("meta")))).alias("data"))  # one set for each element
    paths = {"external": "sets.Pset_*Common.IsExternal", "first_prop": "listed.0.prop", "second_value": "listed.1.value", "kind": "meta.kind", "beyond": "listed.9.value"}
    return extract_paths(nested, "data", paths).drop("data")


@query("select global_id, prop, coalesce(try_cast(value as double), -1.0e0) as number, coalesce(case when lower(value) in ('true', 'yes', '1', 't') then 1.0e0 when lower(value) in ('false', 'no', '0', 'f') then 0.0e0 end, 0.5e0) as flag from v_properties")
def x12_coerce_value(spark, sf):
    return properties(spark, sf).select("global_id", "prop", V.coerce(F.col("value"), "numeric", F.lit(-1.0)).alias("number"), V.coerce(F.col("value"), "boolean", F.lit(0.5)).alias("flag"))


# Graphs


NODES = """(select global_id as id, 'element' as node_type, name as label from v_elements
    union all select distinct global_id || '/' || pset, 'pset', pset from v_properties
    union all select global_id || '/' || pset || '/' || prop, 'property', case when value is null then prop else prop || '=' || value end from v_properties
    union all select distinct 'material:' || material, 'material', material from v_elements where material is not null
    union all select distinct 'class:' || ifc_class, 'class', ifc_class from v_elements
    union all select distinct 'spatial:' || container, 'spatial', container from v_elements where container is not null)"""
EDGES = """(select distinct global_id as src, global_id || '/' || pset as dst, 'HAS_PSET' as edge_type from v_properties
    union all select global_id || '/' || pset, global_id || '/' || pset || '/' || prop, 'HAS_PROPERTY' from v_properties
    union all select global_id, 'class:' || ifc_class, 'CLASSIFIED_AS' from v_elements
    union all select global_id, 'material:' || material, 'HAS_MATERIAL' from v_elements where material is not null
    union all select global_id, 'spatial:' || container, 'CONTAINED_IN' from v_elements where container is not null)"""


def nodes(spark, sf):
    return graph.property_graph_nodes(elements(spark, sf), properties(spark, sf))


def edges(spark, sf):
    return graph.property_graph_edges(elements(spark, sf), properties(spark, sf))


@query(f"select id, node_type, label from {NODES} n")
def t1_property_graph_nodes(spark, sf):
    return nodes(spark, sf)


@query(f"select src, dst, edge_type from {EDGES} e union all select a.global_id, b.global_id, 'SAME_STOREY' from v_elements a join v_elements b on a.container = b.container and a.ord < b.ord")
def t1_property_graph_edges(spark, sf):
    pairs = graph.pairs_sharing(elements(spark, sf), "container").withColumn("edge_type", F.lit("SAME_STOREY"))
    return edges(spark, sf).unionByName(pairs)


@query("select global_id as src, 'storey:' || container as dst, 'SAME_STOREY' as edge_type, count(*) over (partition by container) - 1 as n_links from v_elements where container is not null")
def t1_storey_classes(spark, sf):
    return graph.same_storey_edges(elements(spark, sf))


# Two writers of one graph: elements with their materials, then the same elements renamed and their materials in capitals.
WRITERS = """(select global_id as id, 'element' as node_type, name as label, ord from v_elements union all select global_id, 'element', upper(name), ord + 100000000 from v_elements
    union all select 'material:' || material, 'material', lower(material), ord from v_elements where material is not null union all select 'material:' || material, 'material', material, ord + 100000000 from v_elements where material is not null)"""


@query(f"select id, node_type, case node_type when 'element' then arg_max(label, ord) else arg_min(label, ord) end as label from {WRITERS} w group by 1, 2")
def u1_graph_union_nodes(spark, sf):
    node = lambda df, c, kind, label, later: df.select(c.alias("id"), F.lit(kind).alias("node_type"), label.alias("label"), (F.col("ord") + later).alias("ord"))
    rows, later = elements(spark, sf), 100_000_000
    made, m = rows.where("material is not null"), F.concat(F.lit("material:"), F.col("material"))
    parts = [node(rows, F.col("global_id"), "element", F.col("name"), 0), node(rows, F.col("global_id"), "element", F.upper("name"), later), node(made, m, "material", F.lower("material"), 0), node(made, m, "material", F.col("material"), later)]
    return graph.union_nodes(parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]))


@query("select source as src, target as dst, substr(max(lpad(cast(ord as string), 20, '0') || type), 21) as edge_type from v_relationships group by 1, 2")
def u1_graph_union_edges(spark, sf):
    return graph.union_edges(view(spark, sf, "v_relationships").select(F.col("source").alias("src"), F.col("target").alias("dst"), F.col("type").alias("edge_type"), F.col("ord").alias("seq")))


@query("""select a.global_id as src, b.global_id as dst, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) as distance, 1 - sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) / 2.5e0 as weight
    from v_elements a, v_elements b where a.global_id <> b.global_id and abs(a.z - b.z) <= 0.5 and sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) < 2.5e0""")
def j11_proximity_edges(spark, sf):
    return graph.proximity_edges(elements(spark, sf), 2.5)


@query("select a.global_id as src, b.global_id as dst from v_elements a join v_elements b on a.container = b.container and a.ord < b.ord")
def j12_same_level_edges(spark, sf):
    return graph.pairs_sharing(elements(spark, sf), "container")


@query("select a.global_id as src, b.global_id as dst from v_elements a join v_elements b on a.material = b.material and a.ord < b.ord")
def j13_same_material_edges(spark, sf):
    return graph.pairs_sharing(elements(spark, sf), "material")


# The same pairs as classes and their members, in linear size.
def _members(key: str) -> str:
    return f"select {key} as class, global_id as id, row_number() over (partition by {key} order by ord) - 1 as rank, count(*) over (partition by {key}) - 1 as n_links from v_elements where {key} is not null"


@query(_members("container"))
def j12_level_classes(spark, sf):
    return cliques.members(elements(spark, sf), "container")


@query(_members("material"))
def j13_material_classes(spark, sf):
    return cliques.members(elements(spark, sf), "material")


# Some of the pairs, by their numbers within a class: every hundredth.
@query("""select class, number, src, dst from (select a.container as class, a.global_id as src, b.global_id as dst, row_number() over (partition by a.container order by a.ord, b.ord) - 1 as number
    from v_elements a join v_elements b on a.container = b.container and a.ord < b.ord) t where number % 100 = 0""")
def j12_numbered_pairs(spark, sf):
    return cliques.every(cliques.members(elements(spark, sf), "container"), 100)


@query("""select a.global_id as src, b.global_id as dst from v_elements a join v_elements b on a.ord <> b.ord and (a.container = b.container or a.material = b.material) where a.ord % 500 = 0""")
def j12_neighbours(spark, sf):
    rows = elements(spark, sf)
    return cliques.neighbours(rows, ["container", "material"], rows.where("ord % 500 = 0"))


@query("""select global_id as src, f as dst from (select global_id, first_value(global_id) over (partition by material order by ord) as f from v_elements where material is not null) t where global_id <> f""")
def j13_material_stars(spark, sf):
    return graph.star_edges(elements(spark, sf), "material")


@query(f"select distinct src, dst from (select src, dst from {EDGES} e union all select dst, src from {EDGES} f) t")
def u4_undirected_edges(spark, sf):
    return graph.undirected(edges(spark, sf))


@query("select global_id as id, row_number() over (order by ord) - 1 as idx from v_elements")
def w8_node_index(spark, sf):
    return graph.node_index(elements(spark, sf).select(F.col("global_id").alias("id"), "ord"), "ord")


COO = """(select a.ord as src_idx, b.ord as dst_idx from (select global_id, row_number() over (order by ord) - 1 as ord from v_elements) a join v_relationships r on r.source = a.global_id join (select global_id, row_number() over (order by ord) - 1 as ord from v_elements) b on b.global_id = r.target where r.type = 'connected_to')"""


def coo(spark, sf):
    found = view(spark, sf, "v_relationships").where("type = 'connected_to'").select(F.col("source").alias("src"), F.col("target").alias("dst"))
    return graph.edge_index(found, graph.node_index(elements(spark, sf).select(F.col("global_id").alias("id"), "ord"), "ord"))


@query(f"select src_idx, dst_idx from {COO} c")
def t13_edge_index(spark, sf):
    return coo(spark, sf)


@query(f"select src_idx, string_agg(cast(dst_idx as string), ',' order by dst_idx) as neighbours from (select distinct src_idx, dst_idx from {COO} c) t group by 1")
def t13_adjacency(spark, sf):
    return graph.adjacency(coo(spark, sf))


@query(f"select n_nodes, n_edges, 2.0e0 * n_edges / n_nodes as average_degree from (select count(*) as n_nodes from {NODES} n) a, (select count(*) as n_edges from {EDGES} e) b")
def a8_graph_stats(spark, sf):
    return graph.graph_stats(nodes(spark, sf), edges(spark, sf))


@query("""select ifc_class, count(*) as n from v_elements where ifc_class <> 'IfcSpace' group by 1""")
def a9_type_distribution(spark, sf):
    return elements(spark, sf).where("ifc_class <> 'IfcSpace'").groupBy("ifc_class").agg(F.count("*").alias("n"))


@query(f"""select distinct id, neighbour, edge_type from (select src as id, dst as neighbour, edge_type from {EDGES} e union all select dst, src, edge_type from {EDGES} f) t where id in (select global_id from v_elements where ord % 20 = 0)""")
def j16_one_hop_neighbours(spark, sf):
    return graph.neighbours(edges(spark, sf), elements(spark, sf).where("ord % 20 = 0").select(F.col("global_id").alias("id")))


@query(f"""select src, dst, edge_type from {EDGES} e where src in (select id from {NODES} n where node_type in ('element', 'material') and contains(lower(label), 'e')) and dst in (select id from {NODES} n where node_type in ('element', 'material') and contains(lower(label), 'e'))""")
def f12_filter_subgraph(spark, sf):
    return graph.subgraph(nodes(spark, sf), edges(spark, sf), ["element", "material"], "e")


BOT = literals(list(graph.TOPOLOGY.items()), "ifc_class, bot")
TYPE_OF = "case when lower({0}) in ('true', 'false') then 'xsd:boolean' when regexp_matches({0}, '^-?[0-9]+$') then 'xsd:integer' when regexp_matches({0}, '^-?[0-9]+\\.[0-9]+$') then 'xsd:double' else 'xsd:string' end"


def _named(subject: str, kinds: list[str], key: str, label: str, source: str) -> str:
    types = "".join(f" union all select {subject}, 'rdf:type', '{k}', 'uri', null from {source}" for k in kinds)
    return f"select {subject}, 'ifc:globalId_IfcRoot', {key}, 'literal', null from {source} union all select {subject}, 'rdfs:label', {label}, 'literal', null from {source}{types}"


TRIPLES = f"""(select distinct * from (
    select 'inst:' || global_id as subject, 'rdf:type' as predicate, 'ifc:' || ifc_class as object, 'uri' as object_type, cast(null as string) as datatype from v_elements
    union all {_named("'inst:' || global_id", [], 'global_id', 'name', 'v_elements')}
    union all select 'inst:' || global_id, 'rdf:type', bot, 'uri', null from v_elements join {BOT} b using (ifc_class)
    union all select 'inst:' || global_id, 'bot:containedIn', 'inst:' || container, 'uri', null from v_elements
    union all select 'inst:' || container, case ifc_class when 'IfcSpace' then 'bot:hasSpace' else 'bot:containsElement' end, 'inst:' || global_id, 'uri', null from v_elements
    union all select 'inst:' || global_id, 'ifc:hasMaterial', 'mat:' || material, 'uri', null from v_elements
    union all select 'mat:' || material, 'rdf:type', 'ifc:IfcMaterial', 'uri', null from v_elements union all select 'mat:' || material, 'rdfs:label', material, 'literal', null from v_elements
    union all select 'inst:' || global_id || '/' || pset, 'rdf:type', 'ifc:IfcPropertySet', 'uri', null from v_properties union all select 'inst:' || global_id || '/' || pset, 'rdfs:label', pset, 'literal', null from v_properties
    union all select 'inst:' || global_id, 'ifc:hasPropertySet', 'inst:' || global_id || '/' || pset, 'uri', null from v_properties
    union all select 'inst:' || global_id || '/' || pset, 'props:' || replace(prop, ' ', '_'), value, 'typed_literal', {TYPE_OF.format('value')} from v_properties
    union all select 'inst:project', 'rdf:type', 'ifc:IfcProject', 'uri', null union all select 'inst:project', 'bot:hasSite', 'inst:' || site, 'uri', null from v_spatial
    union all {_named("'inst:' || site", ['bot:Site', 'ifc:IfcSite'], 'site', 'site_name', 'v_spatial')} union all {_named("'inst:' || building", ['bot:Building', 'ifc:IfcBuilding'], 'building', 'building', 'v_spatial')}
    union all {_named("'inst:' || storey", ['bot:Storey', 'ifc:IfcBuildingStorey'], 'storey', 'storey', 'v_spatial')} union all select 'inst:' || storey, 'props:elevation', cast(elevation as string), 'typed_literal', 'xsd:double' from v_spatial
    union all select 'inst:' || building, 'bot:hasStorey', 'inst:' || storey, 'uri', null from v_spatial union all select 'inst:' || site, 'bot:hasBuilding', 'inst:' || building, 'uri', null from v_spatial
    union all select 'inst:' || global_id, 'ifc:hasClassification', 'class:' || uniclass, 'uri', null from v_elements join {CROSS} c using (ifc_class)
    union all select 'class:' || uniclass, 'rdf:type', 'ifc:IfcClassificationReference', 'uri', null from v_elements join {CROSS} c using (ifc_class)
    union all select 'inst:doc/' || cast(doc_id as string), 'rdf:type', 'foaf:Document', 'uri', null from v_documents union all select 'inst:doc/' || cast(doc_id as string), 'rdfs:label', filename, 'literal', null from v_documents
    union all select 'inst:doc/' || cast(doc_id as string), 'props:lifecyclePhase', phase, 'literal', null from v_documents union all select 'inst:project', 'foaf:topic', 'inst:doc/' || cast(doc_id as string), 'uri', null from v_documents
    ) t where subject is not null and object is not null)"""


def triple_tasks(spark, sf):
    return graph.triple_tasks(elements(spark, sf), properties(spark, sf), view(spark, sf, "v_documents"))


def all_triples(spark, sf, tasks=None):
    return graph.triples(elements(spark, sf), properties(spark, sf), view(spark, sf, "v_spatial"), enrich.crosswalk(spark), view(spark, sf, "v_documents"), tasks=tasks)


@query(f"select subject, predicate, object, object_type, datatype from {TRIPLES} t")
def t2_rdf_triples(spark, sf):
    return all_triples(spark, sf)


PREFIXED = literals(list(graph.PREFIXES.items()), "prefix, base")
FULL = "coalesce((select base from " + PREFIXED + " x where x.prefix = split_part({0}, ':', 1)) || replace(substr({0}, instr({0}, ':') + 1), ' ', '%20'), {0})"
ESCAPED = "replace(replace(object, chr(92), chr(92) || chr(92)), '\"', chr(92) || '\"')"


@query(f"""select '<' || {FULL.format('subject')} || '> <' || {FULL.format('predicate')} || '> ' || case when object_type = 'uri' then '<' || {FULL.format('object')} || '>' when datatype is not null then '"' || {ESCAPED} || '"^^<' || {FULL.format('datatype')} || '>' else '"' || {ESCAPED} || '"' end || ' .' as value from {TRIPLES} t""")
def s9_ntriples(spark, sf):
    return graph.ntriples(all_triples(spark, sf))


@query(f"""select count(*) as n_triples, count(distinct subject) as n_subjects, count(*) filter (where predicate = 'rdf:type' and object like 'ifc:Ifc%') as n_typed, count(distinct predicate) as n_predicates from {TRIPLES} t""")
def a11_knowledge_graph_stats(spark, sf):
    return graph.triple_stats(all_triples(spark, sf))


@query("""select 'inst:' || global_id as e, 'inst:' || container as s, 'inst:' || building as b from v_elements join v_spatial on container = storey where ifc_class = 'IfcDoor'""")
def j18_triple_pattern(spark, sf):
    return graph.match_pattern(all_triples(spark, sf), [("?e", "rdf:type", "ifc:IfcDoor"), ("?e", "bot:containedIn", "?s"), ("?b", "bot:hasStorey", "?s")])


FOUR = [("?site", "bot:hasBuilding", "?b"), ("?e", "rdf:type", "ifc:IfcDoor"), ("?b", "bot:hasStorey", "?s"), ("?e", "bot:containedIn", "?s")]


@query("""select 'inst:' || site as site, 'inst:' || building as b, 'inst:' || global_id as e, 'inst:' || container as s from v_elements join v_spatial on container = storey where ifc_class = 'IfcDoor'""")
def j18_four_patterns(spark, sf):
    return graph.match_pattern(all_triples(spark, sf), FOUR)


@query(f"""select 'class' as kind, substr(object, 5) as name, count(distinct subject) as n from {TRIPLES} t where predicate = 'rdf:type' and object like 'ifc:Ifc%' and object not in ('ifc:IfcMaterial', 'ifc:IfcPropertySet', 'ifc:IfcClassificationReference') group by 2
    union all select 'property', substr(predicate, 7), count(distinct subject) from {TRIPLES} t where predicate like 'props:%' group by 2
    union all select 'count', case when object in ({', '.join(f"'{x}'" for x in graph.SPATIAL_TYPES)}) then 'spatial' else 'building' end, count(distinct subject) from {TRIPLES} t where predicate = 'rdf:type' and object like 'ifc:Ifc%' and object not in ('ifc:IfcMaterial', 'ifc:IfcPropertySet', 'ifc:IfcClassificationReference') group by 2
    union all select 'count', 'links', count(*) from {TRIPLES} t where predicate in ({', '.join(f"'{x}'" for x in graph.LINKS)})""")
def a11_knowledge_graph_details(spark, sf):
    return graph.triple_details(all_triples(spark, sf))


@query(f"select 'node' as kind, node_type as type, count(*) as n from {NODES} n group by 2 union all select 'edge', edge_type, count(*) from {EDGES} e group by 2")
def a8_type_counts(spark, sf):
    return graph.type_counts(nodes(spark, sf), edges(spark, sf))


# Features


@query("""select e.global_id, ifc_class, name, case when lower(ext) in ('true', 'yes', '1', 't') then 1.0e0 when lower(ext) in ('false', 'no', '0', 'f') then 0.0e0 end as is_external, case when lower(bears) in ('true', 'yes', '1', 't') then 1.0e0 when lower(bears) in ('false', 'no', '0', 'f') then 0.0e0 end as load_bearing, fire as fire_rating from v_elements e
    left join (select global_id, max(value) filter (where prop = 'IsExternal') as ext, max(value) filter (where prop = 'LoadBearing') as bears, max(value) filter (where prop = 'FireRating') as fire from v_properties where regexp_full_match(pset, 'Pset_.*Common') group by 1) p on p.global_id = e.global_id""")
def t7_element_basic(spark, sf):
    return features.feature_set(elements(spark, sf), properties(spark, sf), features.FEATURE_SETS["element_basic"])


@query(f"""select e.global_id, e.ifc_class, s.status as validation_status, cast(s.n_pass as double) as pass_count, cast(s.n_fail as double) as fail_count, cast(s.n_warning as double) as warning_count, s.pass_rate as completeness_score from v_elements e join {STATUS} s on s.global_id = e.global_id""")
def t7_validation_features(spark, sf):
    status = rules.element_status(elements(spark, sf), all_checks(spark, sf))
    return features.feature_set(elements(spark, sf).join(status, "global_id"), properties(spark, sf), features.FEATURE_SETS["validation_results"])


@query("select global_id, ifc_class, cast(null as double) as width, cast(null as double) as height, cast(null as double) as length, cast(null as double) as area, cast(null as double) as volume, x as center_x, y as center_y, z as center_z from v_elements")
def t7_element_geometry(spark, sf):
    return features.feature_set(elements(spark, sf), properties(spark, sf), features.FEATURE_SETS["element_geometry"])


VALUES = ("ifc_class", "material", "container", "name")


@query(" union all ".join(f"select '{c}' as column_name, min({c}) as least_text, max({c}) as most_text, case when count(distinct {c}) <= 20 then array_to_string(list_sort(list(distinct {c})), '|') end as \"values\" from v_elements" for c in VALUES))
def a7_column_values(spark, sf):
    return features.value_profile(elements(spark, sf), list(VALUES)).select("column_name", "least_text", "most_text", F.array_join("values", "|").alias("values"))


@query(f"""select e.global_id, e.ifc_class, e.name, e.container, e.material, f.FireRating, f.IsExternal, f.LoadBearing from v_elements e left join (select global_id,
      max(value) filter (where standard_name = 'FireRating') as FireRating, max(value) filter (where standard_name = 'IsExternal') as IsExternal, max(value) filter (where standard_name = 'LoadBearing') as LoadBearing
    from {FOUND} x where standard_name in ('FireRating', 'IsExternal', 'LoadBearing') group by 1) f on f.global_id = e.global_id""")
def t6_wide_dataset(spark, sf):
    return features.wide_dataset(elements(spark, sf), lookup(spark, sf), ["FireRating", "IsExternal", "LoadBearing"])


@query("""select global_id, coalesce(x, 0.0e0) as x, coalesce(material, 'unknown') as material, case when container is null then 0.0e0 else 1.0e0 end as contained from v_elements""")
def t7_feature_table(spark, sf):
    rows = elements(spark, sf)
    return features.feature_table(rows, [("x", "numeric", F.col("x").cast("string"), 0.0), ("material", "categorical", F.col("material"), "unknown"), ("contained", "boolean", F.when(F.col("container").isNotNull(), "true").otherwise("false"), 0.0)])


@query("select material as category, row_number() over (order by f) - 1 as code from (select material, min(ord) as f from v_elements where material is not null group by 1) t")
def w7_label_encode(spark, sf):
    return features.label_encode(elements(spark, sf), "material", "ord")


@query("select global_id, " + ", ".join(f"case when ifc_class = '{c}' then 1 else 0 end as ifc_class_{c}" for c in CLASSES) + " from v_elements")
def t8_one_hot(spark, sf):
    return features.one_hot(elements(spark, sf), "ifc_class", CLASSES)


@query("select global_id, x, (x - lo) / (hi - lo) as normalized from v_elements, (select min(x) as lo, max(x) as hi from v_elements) s")
def t9_minmax(spark, sf):
    return features.normalize_column(elements(spark, sf).select("global_id", "x"), "x", "minmax")


@query("select global_id, x, round(x - mean, 6) as normalized from v_elements, (select avg(x) as mean from v_elements) s")
def t9_center(spark, sf):
    return features.normalize_column(elements(spark, sf).select("global_id", "x"), "x", "center").withColumn("normalized", F.round("normalized", 6))


@query("select global_id, x, case when x > 0 then round(ln(x), 9) else 0.0e0 end as normalized from v_elements")
def t9_log(spark, sf):
    return features.normalize_column(elements(spark, sf).select("global_id", "x"), "x", "log").withColumn("normalized", F.round("normalized", 9))


@query(" union all ".join(f"select '{c}' as column_name, count(*) as n_rows, count(*) filter (where {c} is null) as n_nulls, count(*) filter (where {c} is null) * 1.0e0 / count(*) as null_rate, count(distinct {c}) as n_distinct, {'min(x)' if c == 'x' else 'null'} as least, {'max(x)' if c == 'x' else 'null'} as most, {'avg(x)' if c == 'x' else 'null'} as mean from v_elements" for c in ("x", "material", "container")))
def a7_column_profile(spark, sf):
    return features.column_profile(elements(spark, sf), ["x", "material", "container"])


@query("select global_id, " + " || ',' || ".join(f"case when ifc_class = '{c}' then '1' else '0' end" for c in CLASSES) + " || ',' || cast(cast(x as int) as string) || ',' || cast(cast(y as int) as string) || ',' || cast(cast(z as int) as string) as features from v_elements")
def t10_gnn_features(spark, sf):
    rows = features.gnn_features(elements(spark, sf), CLASSES)
    return rows.select("global_id", F.array_join(F.transform("features", lambda v: v.cast("int").cast("string")), ",").alias("features"))


@query("""select a.idx as src_idx, b.idx as dst_idx from (select *, row_number() over (order by ord) - 1 as idx from v_elements) a join (select *, row_number() over (order by ord) - 1 as idx from v_elements) b
    on a.ord <> b.ord and (a.container = b.container or a.material = b.material)""")
def t11_gnn_edges(spark, sf):
    numbered = ranks.dense_index(elements(spark, sf).select("ord", "container", "material"), [F.col("ord")]).withColumnRenamed("idx", "global_id")
    pairs = cliques.sharing(numbered, ["container", "material"])
    # The two directions share the tiles, and one after the other they are runs of a number, which files hold in little space.
    way = lambda a, b: pairs.select(F.col(a).alias("src_idx"), F.col(b).alias("dst_idx"))
    return way("src", "dst").unionByName(way("dst", "src"))


# Rows of that coordinate list: where each node's neighbours begin, and how many it has.
@query("""select idx, degree, cast(coalesce(sum(degree) over (order by idx rows between unbounded preceding and 1 preceding), 0) as bigint) as first from (
    select row_number() over (order by ord) - 1 as idx, case when container is null then 0 else count(*) over (partition by container) - 1 end + case when material is null then 0 else count(*) over (partition by material) - 1 end
      - case when container is null or material is null then 0 else count(*) over (partition by container, material) - 1 end as degree from v_elements) t""")
def t11_row_offsets(spark, sf):
    found = cliques.degrees(elements(spark, sf), ["container", "material"])
    return ranks.running_total(ranks.dense_index(found, [F.col("ord")]), [F.col("idx")], "degree", "first").select("idx", "degree", "first")


LABELS = literals(list(graph.CLASS_LABELS.items()), "ifc_class, code")
FIRE = "case when contains(upper(fire), 'REI30') then 0.5 when contains(upper(fire), 'REI60') then 1.0 when contains(upper(fire), 'REI90') then 1.5 when contains(upper(fire), 'REI120') then 2.0 when contains(upper(fire), 'REI180') then 2.5 when contains(upper(fire), 'REI240') then 3.0 else 0.0 end"


@query(f"""select id, node_type, label, array_to_string(list_transform(features, lambda v: cast(cast(round(v * 100) as bigint) as string)), ',') as features from (
    select e.global_id as id, case e.ifc_class when 'IfcSpace' then 'space' else 'element' end as node_type, e.ifc_class as label, [cast(coalesce(l.code, -1) as double), case when lower(ext) in ('true', 'yes', '1') then 1.0 else 0.0 end, case when lower(bears) in ('true', 'yes', '1') then 1.0 else 0.0 end, {FIRE}, x, y, z] as features
      from v_elements e left join {LABELS} l on l.ifc_class = e.ifc_class left join (select global_id, max(value) filter (where prop = 'IsExternal') as ext, max(value) filter (where prop = 'LoadBearing') as bears, max(value) filter (where prop = 'FireRating') as fire from v_properties group by 1) s on s.global_id = e.global_id
    union all select storey, 'storey', 'IfcBuildingStorey', [cast(elevation as double)] from v_spatial union all select distinct building, 'building', 'IfcBuilding', cast([] as double[]) from v_spatial union all select distinct site, 'site', 'IfcSite', cast([] as double[]) from v_spatial
    union all select distinct 'M:' || material, 'material', 'IfcMaterial', cast([] as double[]) from v_elements where material is not null union all select distinct 'C:' || uniclass, 'classification', 'Uniclass2015', cast([] as double[]) from v_elements join {CROSS} c using (ifc_class)) t""")
def t12_gnn_nodes(spark, sf):
    rows = graph.gnn_nodes(elements(spark, sf), properties(spark, sf), view(spark, sf, "v_spatial"), enrich.crosswalk(spark))
    return rows.withColumn("features", F.array_join(F.transform("features", lambda v: F.round(v * 100).cast("long").cast("string")), ","))


DOWN = "(select site as a, building as b from v_spatial union all select building, storey from v_spatial union all select container, global_id from v_elements where container is not null)"


@query(f"""select distinct src, dst, edge_type from (select a as src, b as dst, 'CONTAINS' as edge_type from {DOWN} t union all select b, a, 'CONTAINED_IN' from {DOWN} u union all select global_id, 'M:' || material, 'HAS_MATERIAL' from v_elements where material is not null
    union all select global_id, 'C:' || uniclass, 'HAS_CLASSIFICATION' from v_elements join {CROSS} c using (ifc_class)
    union all select source, target, 'CONNECTS_TO' from v_relationships where type = 'connected_to' union all select target, source, 'CONNECTS_TO' from v_relationships where type = 'connected_to') w""")
def t12_gnn_edges(spark, sf):
    return graph.gnn_edges(elements(spark, sf), view(spark, sf, "v_spatial"), view(spark, sf, "v_relationships"), enrich.crosswalk(spark))


@query("""select building, storey, coalesce(n, 0) as n_elements, row_number() over (partition by building order by coalesce(elevation, 0), storey) as level from v_spatial left join (select container, count(*) as n from v_elements group by 1) c on container = storey""")
def p7_spatial_hierarchy(spark, sf):
    from pyspark.sql import Window

    counts = elements(spark, sf).groupBy("container").agg(F.count("*").alias("n")).withColumnRenamed("container", "storey")
    level = F.row_number().over(Window.partitionBy("building").orderBy(F.coalesce("elevation", F.lit(0)), "storey"))
    return view(spark, sf, "v_spatial").join(counts, "storey", "left").select("building", "storey", F.coalesce("n", F.lit(0)).alias("n_elements"), level.cast("long").alias("level"))


@query("select global_id, x + y / 60.0e0 + z / 3600.0e0 as degrees from v_elements")
def p8_element_location(spark, sf):
    return elements(spark, sf).select("global_id", V.decimal_degrees(F.array("x", "y", "z")).alias("degrees"))


@query("""select count(*) as n_elements, count(*) filter (where ifc_class = 'IfcSpace') as n_spatial, count(*) filter (where ifc_class <> 'IfcSpace') as n_building, count(container) as n_contained, count(distinct ifc_class) as n_classes from v_elements""")
def p9_model_statistics(spark, sf):
    return elements(spark, sf).agg(F.count("*").alias("n_elements"), F.count_if(F.col("ifc_class") == "IfcSpace").alias("n_spatial"), F.count_if(F.col("ifc_class") != "IfcSpace").alias("n_building"), F.count("container").alias("n_contained"), F.count_distinct("ifc_class").alias("n_classes"))


@query("select global_id, concat_ws(' ', ifc_class, name, 'on', container, 'material:' || material) as text from v_elements")
def x18_element_text(spark, sf):
    return elements(spark, sf).select("global_id", F.concat_ws(" ", "ifc_class", "name", F.lit("on"), "container", F.concat(F.lit("material:"), F.col("material"))).alias("text"))


@query("""select substr(md5(e.global_id), 1, 12) as id, e.global_id, concat_ws(chr(10), 'IFC Element: ' || ifc_class, case when name <> '' then 'Name: ' || name end, 'GlobalId: ' || e.global_id, p.t, case when material is not null then chr(10) || 'Materials:' || chr(10) || '  - ' || material end) as text from v_elements e
    left join (select global_id, string_agg(t, chr(10) order by pset) as t from (select global_id, pset, chr(10) || pset || ':' || coalesce(chr(10) || string_agg('  - ' || prop || ': ' || value, chr(10) order by ord), '') as t from v_properties group by 1, 2) s group by 1) p on p.global_id = e.global_id""")
def x18_element_chunk(spark, sf):
    return features.element_chunks(with_materials(spark, sf), properties(spark, sf))


@query("""select cast(src_idx as string) || ' ' || cast(dst_idx as string) || ' 1.0' as value from """ + COO + " c")
def s10_edge_list(spark, sf):
    return coo(spark, sf).select(F.concat_ws(" ", F.col("src_idx").cast("string"), F.col("dst_idx").cast("string"), F.lit("1.0")).alias("value"))


@query(f"""select n_elements, n_checks, n_failed, n_properties, n_found from (select count(*) as n_elements from v_elements) a, (select count(*) as n_checks, count(*) filter (where result = 'FAIL') as n_failed from {CHECKS} c) b, (select count(*) as n_properties, count(*) filter (where match <> 'NOT_FOUND') as n_found from {FOUND} f) d""")
def a12_run_summary(spark, sf):
    a = elements(spark, sf).agg(F.count("*").alias("n_elements"))
    b = all_checks(spark, sf).agg(F.count("*").alias("n_checks"), F.count_if(F.col("result") == "FAIL").alias("n_failed"))
    d = lookup(spark, sf).agg(F.count("*").alias("n_properties"), F.count_if(F.col("match") != "NOT_FOUND").alias("n_found"))
    return a.join(b).join(d)  # one row each
