"""Paths into nested data, metadata filled by fixes, nested summaries."""

import json

from pyspark.sql import functions as F

from lintel.operators import documents as D
from lintel.operators.paths import extract_paths, value_at
from lintel.sources import sinks

DATA = {
    "name": "W1", "none": None, "quote's": {"a": 4}, "psets": {"Pset_WallCommon": {"FireRating": "2HR", "Loads": [1, {"kind": "live"}]}, "Pset_WallZCommon": {"FireRating": "later"}, "Other": {"FireRating": "no"}},
    "list": [[10, 11], [20]], "numbers": {"0": "zero", "1": {"x": True}},
}
PATHS = {
    "name": "W1", "psets.Pset_*Common.FireRating": "2HR", "psets.Pset_*Common.Loads.1.kind": "live", "psets.*.FireRating": "no", "psets.Pset_*None.FireRating": None, "list.0.1": "11", "list.1.0": "20", "list.1.1": None, "list.2": None,
    "list.x": None, "list.*.1.0": "20", "numbers.0": "zero", "numbers.1.x": "true", "none": None, "none.x": None, "none.*": None, "missing.x.y": None, "name.x": None, "name.0": None, "quote's.a": "4", "": None, "psets.Pset_.Common": None,
}


def test_paths(spark):
    rows = spark.createDataFrame([(1, json.dumps(DATA)), (2, None), (3, "[]"), (4, "7")], "id int, text string").select("id", F.parse_json("text").alias("data"))
    names = {f"p{i}": path for i, path in enumerate(PATHS)}
    got = {r["id"]: r for r in extract_paths(rows, "data", names).collect()}
    assert {path: got[1][name] for name, path in names.items()} == PATHS
    assert all(got[i][name] is None for i in (2, 3) for name in names)
    whole = rows.where("id = 1").select(F.to_json(value_at(F.col("data"), "psets.Pset_*Common.Loads")).alias("v")).first()["v"]
    assert json.loads(whole) == [1, {"kind": "live"}]
    assert extract_paths(rows.where("false"), "data", names).count() == 0


def test_fixes_fill_metadata(spark):
    docs = spark.createDataFrame([(1, "", None, 0, "a"), (2, "kept", "", 3, ""), (3, None, "me", None, None), (4, "no checks", "x", 1, "b")], "doc_id long, title string, author string, revision int, stem string")
    checks = spark.createDataFrame(
        [(1, "FAIL", "fix_title"), (1, "FAIL", "fix_revision"), (1, "FAIL", None), (2, "PASS", None), (2, "FAIL", "fix_author"), (3, "FAIL", "fix_title"), (3, "FAIL", "fix_revision")], "doc_id long, result string, fix string",
    )
    values = {"fix_title": F.col("stem"), "fix_author": F.col("stem"), "fix_revision": F.lit(1), "fix_date": F.lit("today")}
    seen = lambda fixes: {r["doc_id"]: (r["title"], r["author"], r["revision"], r["n_open"]) for r in D.fill_metadata(docs, D.auto_fix(checks, fixes), values).collect()}
    assert seen(None) == {1: ("a", None, 1, 1), 2: ("kept", "", 3, 0), 3: (None, "me", 1, 0), 4: ("no checks", "x", 1, 0)}
    assert seen(["fix_revision"]) == {1: ("", None, 1, 2), 2: ("kept", "", 3, 1), 3: (None, "me", 1, 1), 4: ("no checks", "x", 1, 0)}
    assert [c for c in D.fill_metadata(docs, checks, values).columns if c != "n_open"] == docs.columns


def test_nested_summary(spark):
    files = spark.createDataFrame([("file:/o/csv/a.csv", 1024), ("file:/o/csv/b.csv", 512), ("file:/o/graph/c.json", 0)], "path string, length long")
    parts = {"input": spark.createDataFrame([("it's \"x\"", 3)], "file string, n int"), "empty": spark.range(0).agg(F.count("*").alias("n"))}
    got = json.loads(sinks.nested_summary(parts, files).first()["value"])
    assert got == {"input": {"file": "it's \"x\"", "n": 3}, "empty": {"n": 0}, "output_files": [{"name": "csv", "type": "csv", "n_files": 2, "size_kb": 1.5}, {"name": "graph", "type": "json", "n_files": 1, "size_kb": 0.0}]}
    assert json.loads(sinks.nested_summary(parts, files.limit(0)).first()["value"])["output_files"] == []
