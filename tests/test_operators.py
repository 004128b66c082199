"""Hand cases: values, the nine-element model, texts in two languages, STEP records, streams."""

import json

import pytest
from pyspark.sql import functions as F

from lintel.functions import text as X
from lintel.functions import values as V
from lintel.operators import documents, graph, ids, lake, rules
from lintel.sources import readers, sinks, step


def one(spark, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("v"))).collect()]


def test_values(spark):
    assert one(spark, ["2HR", "2 Hour", "120", "90 min", "45", "1.5H", "REI60", None], V.fire_rating_duration) == ["P2H", "P2H", "P2H", "P1H30M", "P45M", "P1H30M", "REI60", None]
    assert one(spark, ["2.5 m", "10 cm", "abc", "-3"], lambda v: V.normalize_numeric(v, F.lit("mm"))) == [2500.0, 100.0, None, -3.0]
    assert one(spark, ["0.25"], lambda v: V.normalize_numeric(v, F.lit(None).cast("string"))) == [0.25]
    assert one(spark, ["Yes", "maybe", None], V.normalize_boolean) == ["true", "maybe", None]
    assert one(spark, ["REI60", "rei 60", "REI120", "", None], V.encode_fire_rating) == [1.0, 0.0, 2.0, 0.0, 0.0]
    assert one(spark, ["a b*c~d/e"], lambda v: V.entity_uri("http://x", v)) == ["http://x/a%20b%2Ac~d%2Fe"]
    assert one(spark, ['a"b\\c\nd'], V.escaped) == ['a\\"b\\\\c\\nd']


def test_nine_elements(spark):
    e = [("W1", "IfcWall", []), ("W2", "IfcWall", []), ("W3", "IfcWall", []), ("D1", "IfcDoor", []), ("D2", "IfcDoor", []), ("N1", "IfcWindow", []), ("B1", "IfcBeam", ["Steel"]), ("C1", "IfcColumn", []), ("S1", "IfcSlab", [])]
    elements = spark.createDataFrame([(i, c, m, "Ground Floor") for i, c, m in e], "global_id string, ifc_class string, materials array<string>, container string")
    p = [("W1", "Pset_WallCommon", k, v) for k, v in (("FireRating", "2HR"), ("IsExternal", "true"), ("LoadBearing", "true"), ("ThermalTransmittance", "0.25"))]
    p += [("W2", "Pset_WallCommon", "IsExternal", "false"), ("W2", "Pset_WallCommon", "LoadBearing", "true"), ("D1", "Pset_DoorCommon", "FireRating", "1HR"), ("D1", "Pset_DoorCommon", "IsExternal", "true"), ("S1", "Pset_SlabCommon", "LoadBearing", "true")]
    properties = spark.createDataFrame([(*x, i) for i, x in enumerate(p)], "global_id string, pset string, prop string, value string, ord int")
    found = rules.checks(elements, properties, rules.build_rules(rules.requirements(spark)))
    status = {r["global_id"]: (r["n_pass"], r["n_fail"], r["status"]) for r in rules.element_status(elements, found).collect()}
    assert status == {"W1": (5, 0, "PASS"), "W2": (3, 1, "FAIL"), "W3": (1, 3, "FAIL"), "D1": (3, 0, "PASS"), "D2": (1, 2, "FAIL"), "N1": (1, 2, "FAIL"), "B1": (2, 0, "PASS"), "C1": (1, 1, "FAIL"), "S1": (2, 0, "PASS")}
    summary = rules.validation_summary(elements, found).first()
    assert (summary["n_checks"], summary["checks_passed"], summary["element_pass_rate"], summary["check_pass_rate"]) == (37, 19, 44.4, 51.4)
    topics = rules.issue_topics(found)
    assert topics.count() == 9 and topics.select("guid").distinct().count() == 9


def test_documents(spark):
    assert one(spark, ["site_plan.pdf", "현장일보.docx", "x.pdf"], X.detect_phase) == ["design", "construction", "design"]
    types = one(spark, ["m.ifc", "x.zzz"], lambda v: X.classify_filename(v, F.lit(None).cast("string")))
    assert [(t["type_id"], round(t["confidence"], 3)) for t in types] == [("bim_model", 1.0), ("bim_model", 0.2)]
    assert one(spark, ["test_structural_report.pdf"], lambda v: X.classify_filename(v, F.lit("design"))["type_id"]) == ["design_drawing"]
    got = one(spark, ["x" * 1000, "ab", ""], X.chunk_fixed)
    assert [(c["start"], c["end"]) for c in got[0]] == [(0, 512), (462, 974), (924, 1000)] and [c["chunk"] for c in got[1]] == ["ab"] and got[2] == []
    rows = spark.createDataFrame([(1, "The bridge and 교량 교량 Bridge load"), (2, None)], "doc_id long, text string")
    words = [(r["word"], r["n"]) for r in lake.document_keywords(rows).orderBy("rank").collect()]
    assert words == [("bridge", 2), ("교량", 2), ("load", 1)]
    relevance = one(spark, ["BIM construction of steel", None], lambda v: X.domain_relevance(v))
    assert (relevance[0]["score"], relevance[0]["domain"]) == (13, "Construction-related") and not relevance[1]["is_relevant"]
    pieces = one(spark, ["A b. C d! " * 100], lambda v: X.chunk_recursive(64)(v))[0]
    assert max(map(len, pieces)) <= 64 and "".join(pieces).replace(" ", "").replace(".", "") == ("Ab.Cd!" * 100).replace(".", "")
    assert documents.loin_gap and one(spark, ["LOI Low"], lambda v: documents.loin_gap(v, F.lit("design"))) == [True]
    with pytest.raises(ValueError):
        X.chunk_fixed(F.lit("a"), 10, 10)


def test_proximity(spark):
    rows = spark.createDataFrame([("a", 0.0, 0.0, 0.0), ("b", 1.0, 1.0, 0.4), ("c", 0.5, 0.5, 1.0), ("d", None, 0.0, 0.0)], "global_id string, x double, y double, z double")
    found = {(r["src"], r["dst"]): round(r["weight"], 6) for r in graph.proximity_edges(rows, 2.0).collect()}
    assert found == {("a", "b"): round(1 - 2**0.5 / 2, 6), ("b", "a"): round(1 - 2**0.5 / 2, 6)}


def test_step(spark, tmp_path):
    text = "ISO-10303-21;\nDATA;\n#1=IFCWALL('0123456789012345678901',$,'A; b, (c)',$,$);\n#2 = IFCPROPERTYSINGLEVALUE('P;1',$,IFCLABEL('x'),$);\n#3=IFCPROPERTYSET('g',$,'Pset_X',$,(#2));\n#4=IFCRELDEFINESBYPROPERTIES('g',$,$,$,(#1),#3);\nENDSEC;\n"
    (tmp_path / "m.ifc").write_text(text)
    records = step.read_step(spark, str(tmp_path))
    assert {r["id"]: r["args"][2] for r in records.collect() if len(r["args"]) > 2}[1] == "'A; b, (c)'"
    found = step.properties(records).first()
    assert (found["global_id"], found["pset"], found["prop"], found["value"]) == ("0123456789012345678901", "Pset_X", "P;1", "x")
    assert {(r["source"], r["target"]) for r in step.reference_edges(records).collect()} == {(3, 2), (4, 1), (4, 3)}


def test_readers(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x_parsed.json").write_text(json.dumps({"file_id": "1", "status": "completed", "full_text": "hi", "extra": 1}))
    (tmp_path / "a" / "y_parsed.json").write_text(json.dumps({"file_id": "2", "status": "failed", "full_text": "no"}))
    assert [r["file_id"] for r in readers.read_parsed_documents(spark, str(tmp_path)).collect()] == ["1"]
    (tmp_path / "rules.json").write_text(json.dumps({"requirements": {"IfcWall": {"properties": [{"propertySet": "P", "name": "N", "required": True}]}}}))
    assert readers.read_rule_config(spark, str(tmp_path / "rules.json")).first()["ifc_class"] == "IfcWall"
    (tmp_path / "r.ids").write_text('<ids><specification name="s"><applicability><entity><name><simpleValue>IFCWALL</simpleValue></name></entity></applicability><requirements><property><propertySet><simpleValue>P</simpleValue></propertySet><baseName><simpleValue>N</simpleValue></baseName></property></requirements></specification></ids>')
    assert tuple(readers.read_ids(spark, str(tmp_path / "r.ids")).first()) == ("s", "IFCWALL", "property", "P", "N", None, None, None)
    (tmp_path / "x.ids").write_text('''<ids xmlns="http://standards.buildingsmart.org/IDS" xmlns:xs="http://www.w3.org/2001/XMLSchema"><specifications><specification name="t"><applicability><entity><name><simpleValue>IFCDOOR</simpleValue></name></entity></applicability><requirements>
      <property><propertySet><simpleValue>P</simpleValue></propertySet><baseName><simpleValue>N</simpleValue></baseName><value><xs:restriction base="xs:string"><xs:enumeration value="a"/><xs:enumeration value="b"/></xs:restriction></value></property>
      <attribute><name><simpleValue>Name</simpleValue></name><value><xs:restriction><xs:pattern value="D.*"/></xs:restriction></value></attribute><material><value><simpleValue>oak</simpleValue></value></material>
      <classification><system><simpleValue>U</simpleValue></system></classification><partOf relation="R"><entity><name><simpleValue>IfcBuildingStorey</simpleValue></name></entity></partOf></requirements></specification></specifications></ids>''')
    specs = readers.read_ids(spark, str(tmp_path / "x.ids"))
    assert [tuple(r)[2:] for r in specs.collect()] == [("property", "P", "N", "enumeration", None, ["a", "b"]), ("attribute", None, "Name", "pattern", "D.*", None), ("material", None, None, "simple", "oak", None), ("classification", None, "U", None, None, None), ("partof", None, None, None, "IfcBuildingStorey", None)]
    doors = spark.createDataFrame([("d1", "IfcDoor", "Door 1", ["oak"], ["U"]), ("d2", "IfcDoor", None, ["ash"], []), ("w", "IfcWall", "D", [], [])], "global_id string, ifc_class string, name string, materials array<string>, systems array<string>")
    values = spark.createDataFrame([("d1", "P", "N", "b", 1), ("d2", "P", "N", "c", 1)], "global_id string, pset string, prop string, value string, ord int")
    ends = spark.createDataFrame([("d1", "contained_in", "IfcBuildingStorey"), ("d2", "contained_in", "IfcSite")], "source string, type string, target_class string")
    results = ids.validate(doors, values, ends, specs)
    assert {(r["global_id"], r["result"]) for r in results.collect()} == {("d1", "PASS"), ("d2", "FAIL")} and results.count() == 10
    assert tuple(ids.summary(results).first()) == (2, 1, 1, 50.0) and tuple(ids.summary(results.limit(0)).first()) == (0, 0, 0, 0.0)
    (tmp_path / "dictionary.json").write_text(json.dumps({"classes": {"IfcWall": {"properties": [{"propertySet": "P", "name": "N", "dataType": "string", "unit": None}]}}}))
    (tmp_path / "crosswalk.json").write_text(json.dumps({"IfcWall": {"uniclass2015": {"code": "U1", "name": "Walls"}, "omniclass": {"code": "O1", "name": "w"}, "bsdd": {"uri": "u", "guid": "g"}}, "IfcDoor": {"uniclass2015": {"code": "U2"}}}))
    assert tuple(readers.read_dictionary(spark, str(tmp_path / "dictionary.json")).first()) == (0, "IfcWall", "P", "N", "string", None)
    assert {tuple(r) for r in readers.read_crosswalk(spark, str(tmp_path / "crosswalk.json")).collect()} == {("IfcWall", "U1", "Walls", "O1", "w", "u"), ("IfcDoor", "U2", None, None, None, None)}
    (tmp_path / "odd.json").write_text(json.dumps({"crosswalk": {"IfcWall": {"uniclass": "U1"}}}))
    with pytest.raises(Exception, match="no crosswalk"):
        readers.read_crosswalk(spark, str(tmp_path / "odd.json")).collect()
    rows = spark.createDataFrame([("s", "p", "a b", "uri"), ("s", "q", 'x"y', "literal")], "subject string, predicate string, object string, object_type string").withColumn("datatype", F.lit(None).cast("string"))
    assert sorted(r["value"] for r in graph.ntriples(rows).collect()) == ['<s> <p> <a b> .', '<s> <q> "x\\"y" .']
    assert sinks.json_ld(rows, graph.PREFIXES).count() == 1


def test_rule_files_in_published_layouts(spark, tmp_path):
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<ids xmlns="http://standards.buildingsmart.org/IDS" xmlns:xs="http://www.w3.org/2001/XMLSchema"><info><title>t</title></info><specifications>'
    prop = lambda pset, name, more="": f'<property dataType="IFCLABEL" minOccurs="1">\n <propertySet>\n  <simpleValue>{pset}</simpleValue></propertySet><baseName><simpleValue>{name}</simpleValue></baseName>{more}</property>'
    spec = lambda name, entity, *parts: f'<!-- c --><specification name="{name}" ifcVersion="IFC4X3"><applicability>\n<entity>\n  <name>{entity}</name>\n</entity></applicability><requirements>{"".join(parts)}</requirements></specification>'
    bounds = '<value><xs:restriction base="xs:double"><xs:minInclusive value="1.5"/><xs:maxInclusive value="9"/></xs:restriction></value>'
    least = '<value><xs:restriction base="xs:double"><xs:minInclusive value="2"/></xs:restriction></value>'
    body = spec("w", "IFCWALL", prop("P", "A"), prop("P", "B", bounds), prop("P", "C", least)) + spec("d", "\n IFCDOOR ", prop("P", "A", "<value>plain</value>")) + spec("s", "<simpleValue>IFCSLAB</simpleValue>", "<property><propertySet>Q</propertySet><name>N</name></property>")
    (tmp_path / "rules.ids").write_text(head + body + "</specifications></ids>")
    specs = readers.read_ids(spark, str(tmp_path / "rules.ids"))
    want = [("w", "IFCWALL", "A", None, None, None), ("w", "IFCWALL", "B", "bounds", None, ["1.5", "9"]), ("w", "IFCWALL", "C", "bounds", None, ["2", None]), ("d", "IFCDOOR", "A", "simple", "plain", None), ("s", "IFCSLAB", "N", None, None, None)]
    assert [(r["spec"], r["entity"], r["name"], r["kind"], r["expected"], r["options"]) for r in specs.collect()] == want
    sinks.write_ids(specs, str(tmp_path / "again"))
    assert sorted(map(str, readers.read_ids(spark, str(tmp_path / "again")).collect())) == sorted(map(str, specs.collect()))
    (tmp_path / "none.ids").write_text(head + '<specification name="x"><applicability/><requirements>' + prop("P", "A") + "</requirements></specification></specifications></ids>")
    with pytest.raises(Exception, match="without an entity"):
        readers.read_ids(spark, str(tmp_path / "none.ids")).collect()
    walls = spark.createDataFrame([(f"w{k}", "IfcWall", None, [], []) for k in range(4)], "global_id string, ifc_class string, name string, materials array<string>, systems array<string>")
    values = spark.createDataFrame([(f"w{k}", "P", p, v, 1) for k, row in enumerate((("x", "1.5", "2"), ("x", "9", "1.9"), ("x", "9.1", "3"), ("x", "wide", None))) for p, v in zip("ABC", row, strict=True)], "global_id string, pset string, prop string, value string, ord int")
    found = ids.validate(walls, values, spark.createDataFrame([], "source string, type string, target_class string"), specs.where("spec = 'w'"))
    assert {(r["global_id"], r["name"]) for r in found.where("result = 'FAIL'").collect()} == {("w1", "C"), ("w2", "B"), ("w3", "B"), ("w3", "C")}
    made = ids.specifications(spark.createDataFrame([("IfcWall", "property", "P", "B", True)], "ifc_class string, facet string, pset string, prop string, required boolean"), values.where("value <> 'wide'").withColumn("ifc_class", F.lit("IfcWall")), most_options=2)
    assert made.where("facet = 'property'").first()["options"] == ["1.5", "9.1"]
    asked = {"requirements": {"IfcWall": {"properties": [{"propertySet": "P", "name": "N", "required": True, "rationale": "r"}], "material": {"required": False, "rationale": "m"}}, "IfcDoor": {"properties": []}}, "global_requirements": {"spatial_containment": {"required": True, "rationale": "g"}, "classification": {"required": False, "systems": ["U"], "rationale": "c"}}}
    (tmp_path / "requirements.json").write_text(json.dumps(asked))
    assert [tuple(r) for r in readers.read_requirements(spark, str(tmp_path / "requirements.json")).collect()] == [("IfcWall", "property", "P", "N", True, "r", None), ("IfcWall", "material", None, None, False, "m", None), (None, "partof", None, None, True, "g", None), (None, "classification", None, None, False, "c", ["U"])]


def test_document_graph_counts_words_once(spark):
    from lintel.operators import lake

    docs = spark.createDataFrame([(1, "apache apache license"), (2, "license zebra"), (3, "")], "doc_id long, text string")
    terms = spark.createDataFrame([("license", "License"), ("license", "Law"), ("missing", "None")], "word string, class string")
    nodes, _ = lake.document_graph(lake.document_keywords(docs), terms)
    assert sorted(map(tuple, nodes.collect())) == [("cls:Law", "class"), ("cls:License", "class"), ("doc:1", "document"), ("doc:2", "document"), ("kw:apache", "keyword"), ("kw:license", "keyword"), ("kw:zebra", "keyword")]
    assert nodes._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 2  # texts once, terms once
