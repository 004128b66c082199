"""STEP files in blocks, placements and places, against plain walks."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lintel.sources import step


def whole_records(text):
    """Texts between ';' outside of quotes."""
    out, now, quoted = [], "", False
    for c in text:
        quoted ^= c == "'"
        if c == ";" and not quoted:
            out.append(now)
            now = ""
        else:
            now += c
    return [*out, now] if now else out


def model(random, n):
    words = ["plain", "a;b", "it''s", ";;", "''", "x;''y;", "(1,2)", "line\nbreak", ""]
    lines = ["ISO-10303-21", "HEADER", "DATA"]
    for i in range(1, n):
        texts = ",".join("'" + "".join(words[k] for k in random.integers(0, len(words), int(random.integers(0, 5)))) + "'" for _ in range(int(random.integers(1, 4))))
        lines.append(f"\n#{i}=IFCTHING({texts},#{max(1, i - 1)})")
    return ";".join(lines) + ";\n"


def test_records_over_block_borders(spark, tmp_path):
    random = np.random.default_rng(7)
    texts = [model(random, n) for n in (300, 40, 2, 1)]
    texts.append("#1=IFCTHING('" + ";" * 3000 + "');#2=IFCTHING('x');")  # a record over many blocks
    for i, text in enumerate(texts):
        (tmp_path / f"{i}.ifc").write_text(text)
    want = set()
    for i, text in enumerate(texts):
        for record in whole_records(text):
            if m := re.match(r"(?s)^\s*#(\d+)=(\w+)\((.*)\)\s*$", record):
                want.add((i, int(m[1]), len(step.top_level(m[3])), ",".join(step.top_level(m[3]))))
    sizes = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("97", "1000", "10m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            read = step.read_step(spark, str(tmp_path))
            rows = [(int(re.search(r"(\d+)\.ifc", r["file"])[1]), r["id"], len(r["args"]), ",".join(r["args"])) for r in read.collect()]
            assert len(rows) == len(set(rows)) and set(rows) == want, size
        spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
        assert spark.read.option("lineSep", ";").text(str(tmp_path)).rdd.getNumPartitions() > 50
    finally:
        for k, v in sizes.items():
            spark.conf.set(k, v)


def as_records(spark, lines):
    return step.parse_records(spark.createDataFrame([("m", x) for x in lines], "file string, value string"))


def turn(axis, ahead):
    z = np.array(axis, dtype=float) / np.linalg.norm(axis)
    x = np.array(ahead, dtype=float) - np.dot(ahead, z) * z
    x /= np.linalg.norm(x)
    return np.stack([x, np.cross(z, x), z], axis=1)


def test_placements_equal_a_walk(spark):
    random = np.random.default_rng(4)
    lines, world = [], {}
    for i in range(60):
        parent = None if i in (0, 30) else i - 1 if i < 25 else int(random.integers(0, i))  # a chain of 25, then a tree
        point, axis, ahead = random.normal(0, 5, 3).round(3), random.normal(0, 1, 3).round(3), random.normal(0, 1, 3).round(3)
        flat = i % 7 == 3
        text = lambda v: "(" + ",".join(f"{x:.3f}" if x >= 1 or x < 0 else f"{x:.3E}" for x in v) + ")"
        lines += [f"#{i * 10 + 1}=IFCCARTESIANPOINT({text(point[:2] if flat else point)})", f"#{i * 10 + 2}=IFCDIRECTION({text(axis)})", f"#{i * 10 + 3}=IFCDIRECTION({text(ahead)})"]
        lines += [f"#{i * 10 + 4}=IFCAXIS2PLACEMENT3D(#{i * 10 + 1},{'$' if i % 5 == 0 else f'#{i * 10 + 2}'},{'$' if i % 6 == 0 else f'#{i * 10 + 3}'})", f"#{i * 10 + 5}=IFCLOCALPLACEMENT({'$' if parent is None else f'#{parent * 10 + 5}'},#{i * 10 + 4})"]
        lines.append(f"#{i * 10 + 6}=IFCWALL('{i:022d}',$,'w',$,$,#{i * 10 + 5},$)")
        read = lambda v: np.array([float(f"{x:.3f}") if x >= 1 or x < 0 else float(f"{x:.3E}") for x in v])
        own = np.append(read(point[:2]), 0) if flat else read(point)
        rotation = turn([0, 0, 1] if i % 5 == 0 else read(axis), [1, 0, 0] if i % 6 == 0 else read(ahead))
        outer, origin = world[parent] if parent is not None else (np.eye(3), np.zeros(3))
        world[i] = outer @ rotation, outer @ own + origin
    got = {int(r["global_id"]): r for r in step.locations(as_records(spark, lines)).collect()}
    assert len(got) == 60
    for i, (_, at) in world.items():
        assert np.allclose([got[i][f"world_{c}"] for c in "xyz"], at, atol=1e-6), i


def test_placements_that_are_odd(spark):
    wall = "#9=IFCWALL('0000000000000000000009',$,'w',$,$,#5,$)"
    dangling = as_records(spark, ["#1=IFCCARTESIANPOINT((1.,2.))", "#4=IFCAXIS2PLACEMENT3D(#1,#77,#78)", "#5=IFCLOCALPLACEMENT(#99,#4)", wall, "#10=IFCDOOR('0000000000000000000010',$,'d',$,$,$,$)"])
    assert [tuple(r) for r in step.locations(dangling).select("x", "y", "z", "world_x", "world_y", "world_z").collect()] == [(1, 2, 0, 1, 2, 0)]
    circle = as_records(spark, ["#5=IFCLOCALPLACEMENT(#6,$)", "#6=IFCLOCALPLACEMENT(#5,$)", wall])
    with pytest.raises(ValueError, match="circle"):
        step.in_world(step.placements(circle), rounds=6)
    parallel = as_records(spark, ["#1=IFCCARTESIANPOINT((1.,0.,0.))", "#2=IFCDIRECTION((3.,0.,0.))", "#4=IFCAXIS2PLACEMENT3D(#1,#2,#2)", "#5=IFCLOCALPLACEMENT($,#4)", wall])
    assert step.locations(parallel).first()["world_x"] == 1 and step.in_world(step.placements(parallel)).first()["m"][:3] == [0, 1, 0]
    assert step.locations(as_records(spark, ["#1=IFCTHING($)"])).count() == 0


def test_hierarchy(spark):
    place = lambda n, kind, name, rest="$,$,$,$,$": f"#{n}={kind}('{n:022d}',$,{name},$,{rest})"
    part = lambda n, whole, *parts: f"#{n}=IFCRELAGGREGATES('{n:022d}',$,$,$,#{whole},({','.join(f'#{p}' for p in parts)}))"
    lines = [
        place(1, "IFCPROJECT", "'P'"), place(2, "IFCSITE", "'S'"), place(3, "IFCBUILDING", "'B'"), place(4, "IFCBUILDINGSTOREY", "'up'", "$,$,$,$,.ELEMENT.,3."), place(5, "IFCBUILDINGSTOREY", "'down'", "$,$,$,$,.ELEMENT.,-1."), place(6, "IFCBUILDINGSTOREY", "$"),
        place(7, "IFCSPACE", "'room'"), place(8, "IFCSPACE", "'closet'"), place(9, "IFCBUILDING", "'annex'"), place(10, "IFCWALL", "'w'"), place(11, "IFCDOOR", "'d'"),
        part(20, 1, 2), part(21, 2, 3), part(22, 3, 4, 5, 6, 9), part(23, 4, 7), part(24, 7, 8), f"#30=IFCRELCONTAINEDINSPATIALSTRUCTURE('{30:022d}',$,$,$,(#10,#11),#4)", f"#31=IFCRELCONTAINEDINSPATIALSTRUCTURE('{31:022d}',$,$,$,(#11),#7)",
    ]
    got = {int(r["global_id"]): (r["path"], r["depth"], r["n_elements"], r["level"]) for r in step.hierarchy(as_records(spark, lines)).collect()}
    assert got == {
        1: ("P", 0, 0, None), 2: ("P/S", 1, 0, None), 3: ("P/S/B", 2, 0, None), 4: ("P/S/B/up", 3, 2, 3), 5: ("P/S/B/down", 3, 0, 1), 6: (f"P/S/B/{6:022d}", 3, 0, 2), 7: ("P/S/B/up/room", 4, 1, None),
        8: ("P/S/B/up/room/closet", 5, 0, None), 9: ("P/S/B/annex", 3, 0, None),
    }
    with pytest.raises(ValueError, match="circle"):
        step.hierarchy(as_records(spark, [*lines, place(40, "IFCSPACE", "'a'"), place(41, "IFCSPACE", "'b'"), part(50, 40, 41), part(51, 41, 40)]))
    assert step.hierarchy(as_records(spark, ["#1=IFCTHING($)"])).count() == 0
    assert F is not None


def test_arguments_of_many_records_at_once():
    import pyarrow as pa

    random = np.random.default_rng(5)
    parts = ["'", "''", "(", ")", ",", ",", " ", "a", "\u00df", "\u00a0", "\n", "#12", "$", "','", "('"]
    texts = ["".join(parts[k] for k in random.integers(0, len(parts), int(random.integers(0, 14)))) for _ in range(5000)] + [None, "", ",", ",,"]
    for some in (texts, [x for x in texts if x and x.count("'") % 2 == 0], [None], []):
        assert step.top_levels(pa.array(some, pa.string())).to_pylist() == [step.top_level(x) for x in some]
    assert step.top_levels(pa.array(texts, pa.string())[7:90]).to_pylist() == [step.top_level(x) for x in texts[7:90]]


def test_parts_of_records_as_by_the_pattern(spark):
    texts = ["#1=IFCA('x')", "\n #22 = ifcB ( (1,(2)) , $ ) \n", "DATA", "/* a */#3=IFCC('(',')')", "#4=IFCD()", "#5=IFCE(1", "#6 =\tIFC_F('a=b(c')\t", "", None]
    rows = step.parse_records(spark.createDataFrame([("f", x) for x in texts], "file string, value string")).collect()
    found = [m for x in texts if x and (m := re.search(step.RECORD, x))]
    assert len(found) == 5
    assert {(r["id"], r["type"], tuple(r["args"])) for r in rows} == {(int(m[1]), m[2].upper(), tuple(step.top_level(m[3]))) for m in found}


def test_records_are_made_over_tasks_by_their_number(spark, sf):
    from lintel.plans import io_queries
    from lintel.plans.views import view

    rows = view(spark, sf, "v_elements")
    assert io_queries.dealt(rows, "global_id", rows_a_task=20).rdd.getNumPartitions() == -(-rows.count() // 20)
    plan = io_queries.p1_step_census(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "ArrowEval" not in plan  # types are counted without cutting arguments


def test_quoted_arguments_as_by_the_pattern(spark):
    texts = ["'a'", "''", "'", "'it''s'", "'a\nb'", "$", "*", "", ".T.", "a'", "'a", "#1", "'ü'", None]
    rows = spark.createDataFrame([(x,) for x in texts], "arg string")
    pattern = F.when(F.col("arg").isin("$", "*"), None).otherwise(F.regexp_extract("arg", r"(?s)^'(.*)'$", 1))
    assert all(a == b for a, b in rows.select(step.text_of(F.col("arg")), pattern).collect())


def test_only_placements_that_others_lead_to_take_rounds(spark, monkeypatch):
    lines = ["#1=IFCLOCALPLACEMENT($,$)", "#2=IFCLOCALPLACEMENT(#1,$)", "#3=IFCLOCALPLACEMENT(#2,$)", *[f"#{n}=IFCLOCALPLACEMENT(#3,$)" for n in range(10, 60)], "#60=IFCLOCALPLACEMENT(#99,$)"]
    paths, plain = [], step.scratch
    monkeypatch.setattr(step, "scratch", lambda spark, name: paths.append((name, plain(spark, name))) or paths[-1][1])
    found = step.in_world(step.placements(as_records(spark, lines)))
    assert found.count() == found.select("id").distinct().count() == 54
    sizes = [(name, spark.read.parquet(path).count()) for name, path in paths]
    assert sizes[0] == ("placed", 54) and len(sizes) > 2 and all(n == 3 for _, n in sizes[1:]), sizes


def test_relationships_read_records_once(spark):
    lines = [f"#{n}=IFCWALL('{n:022d}',$,'w',$,$,$,$)" for n in (1, 2, 3)] + [f"#{10 + i}={kind}('{10 + i:022d}',$,$,$,{','.join(ends)})" for i, (kind, ends) in enumerate({
        "IFCRELCONTAINEDINSPATIALSTRUCTURE": ("(#1,#2)", "#3"), "IFCRELAGGREGATES": ("#3", "(#1,#2)"), "IFCRELCONNECTSELEMENTS": ("$", "#1", "#3"), "IFCRELVOIDSELEMENT": ("#1", "#3"), "IFCRELFILLSELEMENT": ("#3", "#1"),
    }.items())]
    path = step.scratch(spark, "records")
    as_records(spark, lines).write.parquet(path)
    found = step.relationships(spark.read.parquet(path))
    got = sorted((r["type"], int(r["source"]), int(r["target"])) for r in found.collect())
    assert got == [("aggregated_by", 1, 3), ("aggregated_by", 2, 3), ("connected_to", 1, 3), ("contained_in", 1, 3), ("contained_in", 2, 3), ("fills", 1, 3), ("has_opening", 1, 3)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 3  # relations, and both ends
