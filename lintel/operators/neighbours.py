"""Nearest vectors by an inverted file: a coarse quantiser, lists that hold every vector, several probes, exact similarities.

Centres are fitted on a bounded sample (SAMPLE rows with the least hashed ids, at most CELLS centres); every vector then goes into the list of its nearest
centre. A query meets the lists it probes and no others. Long lists and many queries of one list are dealt into parts, so that no task holds more than a
part of either. `nearest` looks into a given number of lists; `nearest_exact` then adds every list that may still hold a better vector: by the triangle
inequality of angles that is one whose centre is no further from the query than the k-th best so far plus the list's own radius.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lintel.sources.scratch import scratch

#: Vectors that centres are fitted on, most centres, vectors that a centre is worth, vectors and queries of one list that meet in a task.
SAMPLE, CELLS, SPARSE, LIST_ROWS, ASKED_ROWS = 20_000, 4096, 500, 20_000, 5_000
#: Numbers of a matrix that a step computes, and rows with vectors that leave it at once.
MATRIX, OUT_ROWS = 1 << 20, 10_000
#: Angles are taken from similarities of finite precision.
SLACK = 1e-5


@dataclass
class Index:
    """centres: a unit vector per cell; radii: the greatest angle between it and a vector of its list; lists: cell, id, v of every vector; counts: rows per cell."""

    centres: np.ndarray
    radii: np.ndarray
    lists: DataFrame
    counts: np.ndarray


def unit(rows) -> np.ndarray:
    rows = np.stack(rows).astype(float)
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def fit_centres(rows: np.ndarray, cells: int, rounds: int = 10, seed: int = 5) -> np.ndarray:
    """Centres of unit vectors by cosine: in each round vectors go to their nearest centre and centres to the mean direction of theirs; an empty one takes the vector worst served."""
    random = np.random.default_rng(seed)
    centres = rows[np.sort(random.choice(len(rows), min(cells, len(rows)), replace=False))].copy()
    for _ in range(rounds):
        near = np.concatenate([(rows[i : i + 4096] @ centres.T).argmax(axis=1) for i in range(0, len(rows), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, near, rows)
        empty = np.flatnonzero(np.bincount(near, minlength=len(centres)) == 0)
        sums[empty] = rows[np.argsort((rows * centres[near]).sum(axis=1), kind="stable")[: len(empty)]]
        centres = unit(sums)
    return centres


def _rows(columns: int) -> int:
    """Rows of so many numbers each that a step takes."""
    return max(1, min(2048, MATRIX // max(1, columns)))


def _angles(v: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(v @ centres.T, -1, 1))


def _assigned(centres):
    def task(frames):
        import pandas as pd

        for frame in frames:
            step = _rows(len(centres.value))
            for i in range(0, len(frame), step):
                part = frame.iloc[i : i + step]
                v = unit(part["v"])
                angles = _angles(v, centres.value)
                cell = angles.argmin(axis=1)
                # A zero vector has no direction: its list is looked into by every exact query.
                yield pd.DataFrame({"cell": cell, "id": part["id"], "v": part["v"], "angle": np.where(np.abs(v).max(axis=1) > 0, angles[np.arange(len(v)), cell], np.pi)})

    return task


def build(vectors: DataFrame, cells: int | None = None, sample_rows: int = SAMPLE) -> Index:
    """Index of vectors (id, v); null ids and vectors are left out. cells: by default the root of their number, CELLS at most, and no more than have SPARSE vectors each."""
    spark = vectors.sparkSession
    rows = vectors.where("id is not null and v is not null").select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"))
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(sample_rows).toPandas()
    if not len(sample):
        return Index(np.zeros((0, 0)), np.zeros(0), rows.select(F.lit(0).alias("cell"), "id", "v"), np.zeros(0, dtype=np.int64))
    n = rows.count()
    centres = fit_centres(unit(sample["v"]), cells or max(1, min(CELLS, int(n**0.5), n // SPARSE)))
    path = scratch(spark, "lists")
    rows.mapInPandas(_assigned(spark.sparkContext.broadcast(centres)), "cell int, id long, v array<double>, angle double").write.parquet(path)
    lists = spark.read.parquet(path)
    radii, counts = np.zeros(len(centres)), np.zeros(len(centres), dtype=np.int64)
    for r in lists.groupBy("cell").agg(F.max("angle").alias("radius"), F.count("*").alias("n")).collect():  # a row per cell
        radii[r["cell"]], counts[r["cell"]] = r["radius"], r["n"]
    return Index(centres, radii, lists.select("cell", "id", "v"), counts)


def _probes(index: Index, queries: DataFrame, probes: int, beyond: bool) -> DataFrame:
    """id, v, cell: the lists that each query looks into. beyond: queries have `kth`, a similarity; then all other lists that may hold a greater one."""
    spark = queries.sparkSession
    known = spark.sparkContext.broadcast((index.centres, index.radii))

    def task(frames):
        import pandas as pd

        centres, radii = known.value
        if not len(centres):
            return
        for frame in frames:
            step = _rows(len(centres))
            for i in range(0, len(frame), step):
                part = frame.iloc[i : i + step]
                angles = _angles(unit(part["v"]), centres)
                order = np.argsort(angles, axis=1, kind="stable")
                first = np.zeros(angles.shape, dtype=bool)
                np.put_along_axis(first, order[:, :probes], True, axis=1)
                if beyond:
                    reach = np.where(part["kth"].isna(), np.pi, np.arccos(np.clip(part["kth"].fillna(-1).to_numpy(float), -1, 1)))
                    first = ~first & (angles - radii[None, :] <= reach[:, None] + SLACK)
                of, cell = np.nonzero(first)
                ids, v = part["id"].to_numpy(), part["v"].to_numpy()
                for k in range(0, len(of), OUT_ROWS):  # a query may look into every list: its vector leaves once for each
                    yield pd.DataFrame({"id": ids[of[k : k + OUT_ROWS]], "v": v[of[k : k + OUT_ROWS]], "cell": cell[k : k + OUT_ROWS]})

    columns = ["id", "v", *(["kth"] if beyond else [])]
    return queries.select(*columns).mapInPandas(task, "id long, v array<double>, cell int")


def best_of(k: int):
    """Of two frames of a group (id, v), the k nearest rows of the first for each row of the second: query, id, similarity."""

    def task(left, right):
        import pandas as pd

        if left.empty or right.empty:
            return pd.DataFrame({"query": [], "id": [], "similarity": []})
        left = left.sort_values("id")  # a stable order by similarity then leaves ties by id
        a, b = unit(left["v"]), unit(right["v"])
        out, ids, own = [], left["id"].to_numpy(), right["id"].to_numpy()
        step = _rows(len(a))
        for i in range(0, len(b), step):
            s = np.round(b[i : i + step] @ a.T, 12)
            s[own[i : i + step, None] == ids[None, :]] = -2
            best = np.argsort(-s, axis=1, kind="stable")[:, :k]
            out.append(pd.DataFrame({"query": np.repeat(own[i : i + step], best.shape[1]), "id": ids[best].ravel(), "similarity": np.take_along_axis(s, best, 1).ravel()}))
        found = pd.concat(out)
        return found[found["similarity"] > -1.5]

    return task


def _looked_up(index: Index, asked: DataFrame, k: int, list_rows: int, asked_rows: int) -> DataFrame:
    """query, id, similarity: the k best of every list part for each query that looks into it. asked: id, v, cell."""
    spark = asked.sparkSession
    path = scratch(spark, "asked")
    asked.write.parquet(path)
    asked = spark.read.parquet(path)
    # A row per cell: how many parts its list and its queries are dealt into.
    parts = asked.groupBy("cell").agg(F.ceil(F.count("*") / asked_rows).alias("asked_parts"))
    lists = spark.createDataFrame([(c, -(-int(n) // list_rows)) for c, n in enumerate(index.counts) if n], "cell int, list_parts long")
    path = scratch(spark, "parts")
    parts.join(lists, "cell").write.parquet(path)
    parts = F.broadcast(spark.read.parquet(path))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    block = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    rows = index.lists.join(parts, "cell").select("cell", "id", "v", block("list_parts").alias("a"), every("asked_parts").alias("b"))
    own = asked.join(parts, "cell").select("cell", "id", "v", block("asked_parts").alias("b"), every("list_parts").alias("a"))
    return rows.groupBy("cell", "a", "b").cogroup(own.groupBy("cell", "a", "b")).applyInPandas(best_of(k), "query long, id long, similarity double")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "id"))
    return found.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def nearest(index: Index, queries: DataFrame, k: int, probes: int, list_rows: int = LIST_ROWS, asked_rows: int = ASKED_ROWS) -> DataFrame:
    """query, id, similarity, rank of the k nearest vectors of each query (id, v) in its `probes` nearest lists; the query's own id is left out, ties go by id."""
    rows = queries.where("id is not null and v is not null")
    return _ranked(_looked_up(index, _probes(index, rows, probes, False), k, list_rows, asked_rows), k)


def nearest_exact(index: Index, queries: DataFrame, k: int, probes: int = 4, list_rows: int = LIST_ROWS, asked_rows: int = ASKED_ROWS) -> DataFrame:
    """nearest() among all vectors: after the first `probes` lists, those that may hold a better vector than the k-th so far."""
    spark, path = queries.sparkSession, scratch(queries.sparkSession, "first")
    rows = queries.where("id is not null and v is not null")
    nearest(index, rows, k, probes, list_rows, asked_rows).write.parquet(path)
    first = spark.read.parquet(path)
    if probes >= len(index.centres):
        return first
    kth = first.where(F.col("rank") == k).select(F.col("query").alias("of"), F.col("similarity").alias("kth"))
    left = rows.join(kth, F.col("id") == F.col("of"), "left").select("id", "v", "kth")
    more = _looked_up(index, _probes(index, left, probes, True), k, list_rows, asked_rows)
    return _ranked(first.drop("rank").unionByName(more), k)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of the rows (query, id) of `exact` that `found` has."""
    both = exact.select("query", "id").distinct()
    return both.join(found.select("query", "id").distinct(), ["query", "id"], "left_semi").count() / max(1, both.count())


def probes_for(index: Index, queries: DataFrame, k: int, target: float = 0.95, sample: int = 200) -> int:
    """The least number of probes, doubling from 1, whose recall on at most `sample` of the queries (least hashed ids) reaches `target`."""
    spark, path = queries.sparkSession, scratch(queries.sparkSession, "tuned")
    some = queries.where("id is not null and v is not null").orderBy(F.xxhash64("id"), "id").limit(sample)
    some.write.parquet(path + "-asked")
    some = spark.read.parquet(path + "-asked")
    nearest_exact(index, some, k).write.parquet(path)
    exact, probes = spark.read.parquet(path), 1
    while probes < len(index.centres) and recall(nearest(index, some, k, probes), exact) < target:
        probes *= 2
    return min(probes, max(1, len(index.centres)))
