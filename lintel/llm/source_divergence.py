"""Source divergence audit: how far the sources of a language lie apart in their use of terms, and by which terms.

Tasks count terms per (lang, source) and hand on sums, never single terms, so that a source with a third of all rows
is summed up where it is read. A language keeps the terms that enough of its documents hold. Kept terms are dealt by hash
into chunks of a bounded number and numbered inside their chunk; a source's counts are then sorted (term id, count) arrays, one a chunk.

Each unordered pair of sources is a task per chunk: the two arrays are co-grouped and merged by galloping, the shorter leaping through the
longer. Terms of both sources are priced with both counts, terms of one with the other's price of an unseen term. Terms that neither
has are never listed: their number times the difference of two prices is added once a pair. The result holds for both directions.

A price is 1 + floor(SCALE * (count + SMOOTH) / (N + SMOOTH * V)): exact whole numbers, by long division, for N + SMOOTH * V up to 9 * 10^15.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lintel.llm.common import saved, text_bytes

#: Price of certainty, added to each count, documents a kept term needs, and ranks of terms that are reported.
SCALE, SMOOTH, MIN_DOCS, TOP = 10**9, 5, 30, 50
#: Kept terms of a chunk (on average), and distinct (lang, source, term) that a task holds before it hands on their sums.
CHUNK, HELD = 8192, 1 << 19
#: Needles that leap together.
LEAP = 256

#: Bytes: A-Z become a-z, other ASCII but letters ends a term, all else stays.
_TERM = bytes(x + 32 if 65 <= x <= 90 else x if 97 <= x <= 122 or x > 127 else 32 for x in range(256))


def _count_batches(batches):
    import pyarrow as pa

    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0

    def sums():
        columns: list[list] = [[], [], [], [], []]
        for (lang, source), (counts, having) in held.items():
            for column, x in zip(columns, ([lang] * len(counts), [source] * len(counts), counts, counts.values(), (having[t] for t in counts)), strict=True):
                column.extend(x)
        kinds = (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64())
        arrays = [pa.array(x, kind) for x, kind in zip(columns, kinds, strict=True)]
        arrays[2] = arrays[2].cast(pa.string())
        return pa.RecordBatch.from_arrays(arrays, ["lang", "source", "term", "n", "docs"])

    for batch in batches:
        data, bounds = text_bytes(batch.column("text"))
        terms = data.tobytes().translate(_TERM)
        for i, group in enumerate(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)):
            found = terms[bounds[i] : bounds[i + 1]].split()
            if found:
                counts, having = held.setdefault(group, (Counter(), Counter()))
                size -= len(counts)
                counts.update(found)
                having.update(set(found))
                size += len(counts)
                if size > HELD:
                    yield sums()
                    held.clear()
                    size = 0
    yield sums()


def price(count: np.ndarray, total: int, terms: int) -> np.ndarray:
    """Prices of terms with these counts in a source of `total` terms, `terms` different ones being kept."""
    whole = total + SMOOTH * terms
    out, rest = np.divmod(np.asarray(count, dtype=np.int64) + SMOOTH, whole)
    scale = SCALE
    while scale > 1:  # a thousandth at a time, so that no product is beyond 64 bits
        digit, rest = np.divmod(rest * 1000, whole)
        out, scale = out * 1000 + digit, scale // 1000
    return out + 1


def _price(count: str, total: str, terms: str) -> "F.Column":
    """price() as an expression."""
    return F.expr(f"1 + ({SCALE}BD * cast({count} + {SMOOTH} as decimal(20,0))) div cast({total} + {SMOOTH} * {terms} as decimal(20,0))")


def gallop(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Where each number of `short` stands in `long` or would stand; both ascend. The needles leap LEAP at a time, by doubled strides from where the last ones stopped."""
    out, at = np.empty(len(short), dtype=np.int64), 0
    for i in range(0, len(short), LEAP):
        needles = short[i : i + LEAP]
        stride = LEAP
        while at + stride < len(long) and long[at + stride] < needles[-1]:
            stride *= 2
        window = long[at : at + stride + 1]
        out[i : i + LEAP] = at + np.searchsorted(window, needles)
        at = int(out[min(i + LEAP, len(short)) - 1])
    return out


def _pair_task(key, left, right):
    """Sum of price differences over the terms that a source of the pair has in this chunk, and their number."""
    import pyarrow as pa

    def side(table):
        if not table.num_rows:
            return np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64)
        terms = table.column("terms").combine_chunks().flatten()
        return np.asarray(terms.field("id")), np.asarray(terms.field("n"))

    (ids, counts), (other_ids, other_counts) = side(left), side(right)
    has = left if left.num_rows else right
    total, other_total, kept = (has.column(x)[0].as_py() for x in ("n_a", "n_b", "terms_kept"))
    if len(ids) > len(other_ids):
        ids, counts, total, other_ids, other_counts, other_total = other_ids, other_counts, other_total, ids, counts, total
    at = gallop(ids, other_ids)
    both = np.flatnonzero(at < len(other_ids))
    both = both[other_ids[at[both]] == ids[both]]
    met = np.zeros(len(other_ids), dtype=bool)
    met[at[both]] = True
    lone = np.ones(len(ids), dtype=bool)
    lone[both] = False
    p, q = price(counts, total, kept), price(other_counts, other_total, kept)
    unseen, other_unseen = int(price(np.zeros(1), total, kept)[0]), int(price(np.zeros(1), other_total, kept)[0])
    value = np.abs(p[both] - q[at[both]]).sum() + np.abs(p[lone] - other_unseen).sum() + np.abs(q[~met] - unseen).sum()
    return pa.table({"lang": [key[0].as_py()], "a": [key[1].as_py()], "b": [key[2].as_py()], "value": pa.array([int(value)], pa.int64()), "listed": pa.array([len(ids) + len(other_ids) - len(both)], pa.int64())})


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank, for each (lang, source) that occurs.

    Part `pair`: item is another source of the language, value the summed price differences over all kept terms (0 where none is kept), every one ranked.
    Part `term`: item is a kept term that the source has and that costs more there than in its language, value the difference; the `top` first.
    Ranks count from 1 by value, descending, then item in the order of its bytes.

    Null text, lang and source are empty strings; empty strings are a language and a source like any others. Every row is a
    document, repeated ones too; ids don't matter. Texts are read whole; a text without terms still makes its source occur. A language
    with one source has no pairs. An empty table gives an empty result. Other columns are ignored.
    """
    name = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    texts = docs.select(name("lang"), name("source"), "text")
    found = texts.mapInArrow(_count_batches, "lang string, source string, term string, n long, docs long")
    counts = saved(found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "terms")
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n_lang")).where(F.col("docs") >= min_docs)
    kept = saved(kept.select("lang", "term", "n_lang"), "kept")
    langs = saved(kept.groupBy("lang").agg(F.count("*").alias("terms_kept"), F.sum("n_lang").alias("total_lang")), "langs")
    chunk = F.pmod(F.xxhash64("term"), F.ceil(F.col("terms_kept") / CHUNK)).cast("int").alias("chunk")
    numbered = kept.join(langs, "lang").select("lang", "term", "n_lang", chunk)
    numbered = saved(numbered.withColumn("id", F.row_number().over(Window.partitionBy("lang", "chunk").orderBy("term"))), "numbered")
    priced = saved(counts.select("lang", "source", "term", "n").join(numbered, ["lang", "term"]), "kept_counts")

    totals = priced.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = texts.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = saved(groups.na.fill(0, ["total", "terms_kept", "total_lang"]), "groups")

    side = lambda s, *more: groups.select("lang", F.col("source").alias(s), F.col("total").alias(f"n_{s}"), *more)
    pairs = saved(side("a", "terms_kept").join(side("b"), "lang").where("a < b"), "pairs")
    arrays = saved(priced.groupBy("lang", "source", "chunk").agg(F.array_sort(F.collect_list(F.struct("id", "n"))).alias("terms")), "arrays")
    # Columns are named anew on either side, as both come from the same tables.
    of = lambda s: (x := pairs.join(arrays.withColumnRenamed("source", s), ["lang", s])).select(*(F.col(c).alias(c) for c in x.columns)).groupBy("lang", "a", "b", "chunk")
    merged = of("a").cogroup(of("b")).applyInArrow(_pair_task, "lang string, a string, b string, value long, listed long")
    merged = merged.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("listed").alias("listed"))
    absent = (F.col("terms_kept") - F.coalesce("listed", F.lit(0))) * F.abs(_price("0", "n_a", "terms_kept") - _price("0", "n_b", "terms_kept"))
    value = F.when(F.col("terms_kept") > 0, F.coalesce("value", F.lit(0)) + absent).otherwise(0)
    apart = saved(pairs.join(merged, ["lang", "a", "b"], "left").select("lang", "a", "b", value.cast("long").alias("value")), "apart")

    one = lambda s, t: apart.select("lang", F.col(s).alias("source"), F.lit("pair").alias("part"), F.col(t).alias("item"), "value")
    cost = priced.join(groups, ["lang", "source"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (_price("n", "total", "terms_kept") - _price("n_lang", "total_lang", "terms_kept")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")).alias("rank")
    ranked = one("a", "b").unionByName(one("b", "a")).select("*", rank)
    return ranked.unionByName(cost.where("value > 0").select("*", rank).where(F.col("rank") <= top))
