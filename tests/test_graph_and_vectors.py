"""Classes instead of pairs, and nearest vectors by an index, against plain loops."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lintel.operators import cliques, graph, neighbours, ranks


@pytest.fixture(scope="module")
def elements(spark):
    random = np.random.default_rng(1)
    rows = [(f"e{i}", int(i * 7 % 101), [None, "a", "b", "c", "hot", "hot", "hot"][int(random.integers(0, 7))], [None, "m", "n"][int(random.integers(0, 3))]) for i in range(90)]
    return spark.createDataFrame([*rows, ("alone", 1000, "one", None)], "global_id string, ord long, container string, material string")


def test_classes_stand_for_all_pairs(spark, elements):
    rows = sorted(elements.collect(), key=lambda r: r["ord"])
    shared = lambda k: {(a["global_id"], b["global_id"]) for a, b in combinations(rows, 2) if a[k] is not None and a[k] == b[k]}
    found = cliques.members(elements, "container")
    assert found.agg(F.sum("n_links")).first()[0] == 2 * len(shared("container"))
    for block in (7, 10**6):
        pairs = [tuple(r) for r in cliques.expand(found, block).collect()]
        assert len(pairs) == len(set(pairs)) and set(pairs) == shared("container")
    assert {tuple(r) for r in graph.pairs_sharing(elements, "material").collect()} == shared("material")
    either = shared("container") | shared("material")
    wanted = {r["global_id"]: sum(r["global_id"] in p for p in either) for r in rows}
    degrees = cliques.degrees(elements, ["container", "material"])
    assert {r["global_id"]: r["degree"] for r in degrees.collect()} == wanted
    assert {r["global_id"]: r["first"] for r in ranks.running_total(degrees, [F.col("ord")], "degree", "first").collect()} == {r["global_id"]: sum(wanted[x["global_id"]] for x in rows[:i]) for i, r in enumerate(rows)}
    asked = elements.where("ord % 5 = 0")
    ids = {r["global_id"] for r in asked.collect()}
    both = either | {(b, a) for a, b in either}
    assert sorted(map(tuple, cliques.neighbours(elements, ["container", "material"], asked).collect())) == sorted((a, b) for a, b in both if a in ids)
    none = elements.limit(0)
    assert cliques.members(none, "container").count() == cliques.expand(cliques.members(none, "container")).count() == cliques.degrees(none, ["container"]).count() == 0


def test_pair_numbers(spark):
    def check(cases):
        rows = spark.createDataFrame(cases, "number long, n long").select("number", "n", cliques.pair_at(F.col("number"), F.col("n")).alias("at")).collect()
        for r in rows:
            i, j = r["at"]["i"], r["at"]["j"]
            assert 0 <= i < j < r["n"] and i * (2 * r["n"] - i - 1) // 2 + j - i - 1 == r["number"], r

    check([(p, n) for n in (2, 3, 9, 40) for p in range(n * (n - 1) // 2)])
    for n in (10**5 + 1, 3 * 10**7, 10**8):
        starts = [i * (2 * n - i - 1) // 2 for i in (0, 1, 2, n // 3, n // 2, n - 3, n - 2)]
        check([(p, n) for s in starts for p in (s - 1, s, s + 1) if 0 <= p < n * (n - 1) // 2])


def vectors(n, groups, seed, dim=12):
    random = np.random.default_rng(seed)
    centres = random.normal(0, 1, (groups, dim))
    made = centres[random.integers(0, groups, n)] + random.normal(0, 0.15, (n, dim))
    made[3], made[5], made[8] = 0, made[4], 2 * made[4]  # no direction, a tie, the same direction
    return made


@pytest.mark.parametrize(("n", "groups", "cells"), [(600, 12, 20), (300, 1, 6), (40, 3, 40), (9, 2, 1)])
def test_nearest(spark, n, groups, cells):
    made = vectors(n, groups, n)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(made)] + [(None, [1.0] * 12), (10**6, None)], "id long, v array<double>").repartition(3)
    index = neighbours.build(frame, cells, sample_rows=200)
    assert index.lists.count() == n and index.counts.sum() == n
    u = made / np.maximum(np.linalg.norm(made, axis=1, keepdims=True), 1e-12)
    asked = [i for i in range(n) if i % 4 == 0 or i in (3, 5)]
    want = set()
    for q in asked:
        s = np.round(u @ u[q], 12)
        best = [i for i in sorted(range(n), key=lambda i: (-s[i], i)) if i != q][:5]
        want |= {(q, i, k + 1) for k, i in enumerate(best)}
    queries = frame.where(F.col("id").isin(asked))
    for parts in ((20_000, 5_000), (30, 7)):  # whole lists, and lists and queries in parts
        assert {(r["query"], r["id"], r["rank"]) for r in neighbours.nearest_exact(index, queries, 5, 2, *parts).collect()} == want
    exact = neighbours.nearest_exact(index, queries, 5)
    probes = neighbours.probes_for(index, queries, 5, target=0.95, sample=50)
    assert neighbours.recall(neighbours.nearest(index, queries, 5, probes), exact) >= 0.9
    assert neighbours.recall(neighbours.nearest(index, queries, 5, len(index.centres)), exact) == 1
    assert neighbours.nearest_exact(neighbours.build(frame.limit(0)), queries, 5).count() == 0


def test_index_of_the_given_vectors(spark, sf):
    frame = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    index, queries = neighbours.build(frame), frame.where("id % 20 = 0")
    exact = neighbours.nearest_exact(index, queries, 5)
    assert neighbours.recall(neighbours.nearest(index, queries, 5, neighbours.probes_for(index, queries, 5)), exact) >= 0.9


def plain_pairs(rows, *keys):
    """Ids (earlier, later) of all pairs that share a value of any key."""
    rows = sorted(rows, key=lambda r: r["ord"])
    return {(a["global_id"], b["global_id"]) for a, b in combinations(rows, 2) if any(a[k] is not None and a[k] == b[k] for k in keys)}


def test_numbered_pairs_come_from_blocks(spark, elements):
    found = cliques.members(elements, "container")
    names = {(r["class"], r["rank"]): r["id"] for r in found.collect()}
    sizes = {c: sum(k[0] == c for k in names) for c, _ in names}
    want = set()
    for c, n in sizes.items():
        pairs = list(combinations(range(n), 2))
        want |= {(c, k, names[c, i], names[c, j]) for k, (i, j) in enumerate(pairs) if k % 7 == 0}
    for block in (1, 5, 1000):
        got = [tuple(r) for r in cliques.every(found, 7, block).collect()]
        assert len(got) == len(want) and set(got) == want
    # One row of the plan holds two blocks, never a class's numbers.
    assert cliques.tiles(found, 5).agg(F.max(F.size("src")), F.max(F.size("dst"))).first() == (5, 5)


def test_pairs_of_a_tile_come_one_by_one(spark):
    """A tile of 20,000 by 20,000: before, a task held all its pairs, 30 GB, before it gave the first."""
    rows = spark.range(20_000).select(F.lit("one").alias("container"), F.concat(F.lit("e"), "id").alias("global_id"), F.col("id").alias("ord"))
    assert [tuple(r) for r in cliques.expand(cliques.members(rows, "container"), 20_000).take(2)] == [("e0", "e1"), ("e0", "e2")]


def test_pairs_that_share_any_value(spark, elements):
    want = plain_pairs(elements.collect(), "container", "material")
    for block in (3, 1000):
        got = [tuple(r) for r in cliques.sharing(elements, ["container", "material"], block=block).collect()]
        assert len(got) == len(want) and set(got) == want


def test_proximity_repeats_no_element_for_a_broadcast(spark):
    random = np.random.default_rng(4)
    rows = [(f"p{i}", *(float(v) for v in random.integers(-4, 5, 2)), float(random.choice([0, 0.5, 1, 3]))) for i in range(120)] + [("none", None, 0.0, 0.0)]
    frame = spark.createDataFrame(rows, "global_id string, x double, y double, z double")
    for level in (True, False):
        found = graph.proximity_edges(frame, 1.5, level)
        gap = lambda a, b: ((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 + (0 if level else (a[3] - b[3]) ** 2)) ** 0.5  # noqa: E731, B023
        want = {(a[0], b[0]) for a in rows[:-1] for b in rows[:-1] if a is not b and gap(a, b) < 1.5 and (not level or abs(a[3] - b[3]) <= 0.5)}
        got = [(r["src"], r["dst"]) for r in found.collect()]
        assert len(got) == len(want) and set(got) == want
        # The tables of blocks meet by sorting: neither goes to the driver.
        assert "SortMergeJoin" in found._jdf.queryExecution().executedPlan().toString()


def test_steps_of_the_index_are_bounded(spark, monkeypatch):
    """A query that looks into every list leaves in frames of bounded size."""
    sizes = []
    frames = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i)]) for i in range(50)], "id long, v array<double>")
    index = neighbours.Index(neighbours.unit([[float(i), 1.0, 0.5] for i in range(900)]), np.full(900, np.pi), frames, np.ones(900, dtype=np.int64))

    class Rows:
        sparkSession = spark

        def select(self, *_):
            return self

        def mapInPandas(self, task, _):
            sizes.extend(len(f) for f in task(iter([frames.withColumn("kth", F.lit(-1.0)).toPandas()])))

    neighbours._probes(index, Rows(), 4, True)
    assert sum(sizes) == 50 * 896 and max(sizes) <= 10_000
    assert neighbours._rows(4096) * 4096 <= 1 << 20


def test_triples_are_dealt_by_their_number(spark, sf):
    from lintel.operators import enrich
    from lintel.plans.views import view

    parts = [view(spark, sf, n) for n in ("v_elements", "v_properties", "v_spatial")]
    found = graph.triples(*parts, enrich.crosswalk(spark), view(spark, sf, "v_documents"), rows_a_task=50)
    n = sum(view(spark, sf, v).count() for v in ("v_elements", "v_properties", "v_documents"))
    assert found.rdd.getNumPartitions() == -(-n // 50)
    plan = found._jdf.queryExecution().executedPlan().toString()
    # Nothing is gathered before the deal: both steps of the distinct stand above the one exchange by all columns.
    assert plan.rfind("HashAggregate(keys=[subject") < plan.find("REPARTITION_BY_NUM")
    assert found.count() == found.distinct().count()


def test_rows_are_dealt_before_triples_are_made(spark, sf):
    from lintel.operators import enrich
    from lintel.plans.views import view

    found = graph.triples(*[view(spark, sf, n) for n in ("v_elements", "v_properties", "v_spatial")], enrich.crosswalk(spark), view(spark, sf, "v_documents"), rows_a_task=50)
    made = found._jdf.queryExecution().sparkPlan().toString(), found._jdf.queryExecution().optimizedPlan().toString()
    for part in made[1].split("Generate inline")[1:]:
        assert "RepartitionByExpression" in part
    # Classes are the side that is broadcast, and what rows share is stated once: each material, class and site makes its triples in one row.
    assert all("BuildRight" in line and "LeftOuter" in line for line in made[0].splitlines() if "Join [ifc_class" in line) and "Join [ifc_class" in made[0]
    shared = [part.splitlines()[1] for part in made[1].split("Generate inline")[1:]]
    assert sum("Aggregate [" in line for line in shared) >= 4


def test_turtle_deals_subjects_by_their_number(spark):
    from lintel.sources import sinks

    rows = [("inst:a b", "rdfs:label", f"v{k}", "literal", None) for k in range(5)] + [("inst:a%20b", "rdfs:label", "v0", "literal", None)] + [(f"inst:{k}", "rdf:type", "bot:Site", "uri", None) for k in range(50)]
    triples = spark.createDataFrame(rows, "subject string, predicate string, object string, object_type string, datatype string").repartition(3)
    found = sinks.turtle(triples, {"bot": "https://w3id.org/bot#"}, tasks=7)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and ", 7), REPARTITION_BY_NUM" in plan
    assert sorted(found.collect()) == sorted(sinks.turtle(triples, {"bot": "https://w3id.org/bot#"}).collect())
    assert len(found.collect()) == 52
    # Subjects that have one address share a statement, and equal parts of different triples stay.
    assert any(r.value.count('"v0"') == 2 for r in found.collect())


def test_triples_that_no_pattern_matches_are_not_dealt(spark):
    rows = [("a", "type", "Door"), ("a", "type", "Door"), ("b", "type", "Wall"), ("a", "in", "s"), ("a", "same", "a")]
    triples = spark.createDataFrame(rows, "subject string, predicate string, object string").repartition(3, "subject", "predicate", "object").distinct()
    found = graph.pattern_sizes(triples, [("?e", "type", "Door"), ("?e", "in", "?s"), ("?x", "same", "?x")])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert tuple(found.first()) == (1, 1, 1)
    assert plan.find("Filter") > plan.find("RepartitionByExpression") > 0
    assert tuple(graph.pattern_sizes(triples, [("?e", "?p", "?s"), ("?e", "in", "?s")]).first()) == (4, 1)
