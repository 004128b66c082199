"""Patterns in any order, feature sets, profiles from sketches, non-conformances: hand cases."""

import itertools

import pytest
from pyspark.sql import functions as F

from lintel.operators import documents, features, graph


def test_patterns_in_any_order(spark):
    rows = [("e1", "in", "s1"), ("e2", "in", "s2"), ("e3", "in", "s1"), ("e1", "type", "door"), ("e2", "type", "door"), ("e3", "type", "wall"), ("b", "has", "s1"), ("b", "has", "s2"), ("c", "has", "s3"), ("t", "of", "b"), ("e1", "like", "e1"), ("e2", "like", "e1")]
    triples = spark.createDataFrame(rows, "subject string, predicate string, object string")
    patterns = [("?e", "type", "door"), ("?e", "in", "?s"), ("?b", "has", "?s"), ("?t", "of", "?b")]
    want = {("e1", "s1", "b", "t"), ("e2", "s2", "b", "t")}
    for order in itertools.islice(itertools.permutations(patterns), 0, 24, 5):
        found = graph.match_pattern(triples, list(order))
        assert {(r["e"], r["s"], r["b"], r["t"]) for r in found.collect()} == want
        assert "CartesianProduct" not in found._jdf.queryExecution().toString()
    assert [tuple(r) for r in graph.match_pattern(triples, [("?x", "like", "?x")]).collect()] == [("e1",)]
    with pytest.raises(ValueError, match="no variable"):
        graph.match_pattern(triples, [("?e", "type", "door"), ("?b", "has", "?s")])
    assert graph.pattern_order([("?a", "p", "?b"), ("?c", "p", "?d"), ("?b", "q", "?c")], [5, 1, 9]) == [1, 2, 0]


def test_feature_set(spark):
    elements = spark.createDataFrame([("a", "IfcWall", "A", 1.5), ("b", "IfcDoor", None, None)], "global_id string, ifc_class string, name string, x double")
    values = [("a", "Pset_WallCommon", "IsExternal", "no", 1), ("a", "Pset_DoorCommon", "IsExternal", "TRUE", 2), ("a", "PsetXWallCommon", "IsExternal", "false", 3), ("a", "Qto_Base", "Width", "2.5", 4), ("b", "Pset_WallCommon", "LoadBearing", "maybe", 5)]
    properties = spark.createDataFrame(values, "global_id string, pset string, prop string, value string, ord int")
    basic = {r["global_id"]: tuple(r)[1:] for r in features.feature_set(elements, properties, features.FEATURE_SETS["element_basic"]).collect()}
    assert basic == {"a": ("IfcWall", "A", 1.0, None, None), "b": ("IfcDoor", None, None, None, None)}
    geometry = features.feature_set(elements.withColumn("y", F.lit(0.0)).withColumn("z", F.lit(None).cast("double")), properties, features.FEATURE_SETS["element_geometry"])
    assert {r["global_id"]: (r["width"], r["center_x"], r["center_z"]) for r in geometry.collect()} == {"a": (2.5, 1.5, None), "b": (None, None, None)}
    chunk = {r["global_id"]: r["text"] for r in features.element_chunks(elements.withColumn("materials", F.array(F.lit("oak"), F.lit("tin"))), properties).collect()}
    assert chunk["b"] == "IFC Element: IfcDoor\nGlobalId: b\n\nPset_WallCommon:\n  - LoadBearing: maybe\n\nMaterials:\n  - oak\n  - tin"


def test_value_profile(spark):
    rows = spark.range(20_000).select(F.col("id").alias("n"), F.when(F.col("id") % 7 != 0, F.concat(F.lit("v"), (F.col("id") % 20).cast("string"))).alias("few"), F.concat(F.lit("k"), (F.col("id") % 3000).cast("string")).alias("many"), F.lit(None).cast("string").alias("none"))
    found = {r["column_name"]: r for r in features.value_profile(rows, ["n", "few", "many", "none"]).collect()}
    assert found["few"]["values"] == sorted(f"v{k}" for k in range(20)) and found["many"]["values"] is None and found["none"]["values"] is None
    assert abs(found["many"]["distinct_about"] - 3000) < 0.1 * 3000 and abs(found["n"]["distinct_about"] - 20_000) < 0.1 * 20_000
    assert all(abs(q - want) <= 40 for q, want in zip(found["n"]["quartiles"], (5000, 10_000, 15_000), strict=True))
    assert (found["few"]["least_text"], found["few"]["most_text"], found["none"]["least_text"]) == ("v0", "v9", None)


def test_ng_items(spark):
    checks = spark.createDataFrame([(1, "f", "a", "FAIL"), (1, "f", "b", "WARNING"), (1, "f", "c", "PASS"), (2, "f", "a", "PASS")], "doc_id long, facet string, check string, result string")
    levels = spark.createDataFrame([(1, "LOI High", "design"), (2, "LOI Low", "construction")], "doc_id long, level string, phase string")
    domains = spark.createDataFrame([(1, "BIM/Construction", True), (3, "Non-construction", False)], "doc_id long, domain string, is_relevant boolean")
    items = documents.ng_items(checks, levels, domains)
    assert {(r["doc_id"], r["severity"], r["facet"], r["description"]) for r in items.collect()} == {(1, "NG", "f", "a"), (1, "WARNING", "f", "b"), (2, "NG", "Information Level", "LOI Low"), (3, "NG", "Domain", "Non-construction")}
    assert sorted(map(tuple, documents.ng_counts(spark.range(1, 5).withColumnRenamed("id", "doc_id"), items).collect())) == [(1, 1, 1), (2, 1, 0), (3, 1, 0), (4, 0, 0)]


def test_scratch_is_for_local_masters():
    from types import SimpleNamespace

    from lintel.sources.scratch import scratch

    session = SimpleNamespace(sparkContext=SimpleNamespace(applicationId="none", master="spark://host:7077"), conf=SimpleNamespace(get=lambda *_: None))
    with pytest.raises(RuntimeError):
        scratch(session, "x")
