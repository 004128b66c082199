"""Hierarchical best-fit packing: exact round trips, gapless sequences, few of them."""

import collections
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from lintel.llm import best_fit, packing

LOAD = packing.word_bpe(public_tokenizers.path("word_bpe_49k.json"))


def packed(rows, size):
    """Sequences of (offset, length); fails where a sequence has a gap or is too long."""
    by = collections.defaultdict(list)
    for sequence, offset, length in rows:
        by[sequence].append((offset, length))
    for parts in by.values():
        parts.sort()
        assert [o for o, _ in parts] == np.cumsum([0, *[n for _, n in parts]])[:-1].tolist() and sum(n for _, n in parts) <= size
    return by


def test_pack(spark):
    random = np.random.default_rng(4)
    texts = [" ".join(f"w{k}" for k in random.integers(0, 50, int(random.integers(0, 60)))) for _ in range(150)]
    texts += ["", None, "é " * 300, "x" * 700, texts[3], texts[3], "a b" * 64]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    for name in ("item", "bin", "into", "at", "fill", "group", "piece", "length"):
        docs = docs.withColumn(name, F.lit(1))
    encode = LOAD()[0]
    for group in (7, 10**6):  # several rounds, and one
        rows = best_fit.pack(docs, LOAD, size=64, with_ids=True, group=group, filled=3).collect()
        by_doc = collections.defaultdict(list)
        for r in sorted(rows, key=lambda r: r["piece"]):
            by_doc[r["doc_id"]].append(r)
            assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes()) and r["length"] == len(r["ids"]) and r["start"] == 64 * r["piece"]
        for i, text in enumerate(texts):
            whole = [*encode(text or ""), 1]
            assert [x for r in by_doc[i] for x in r["ids"]] == whole and len(by_doc[i]) == -(-len(whole) // 64)
        sequences = packed([(r["sequence_id"], r["offset"], r["length"]) for r in rows], 64)
        assert len(sequences) <= 1.05 * -(-sum(r["length"] for r in rows) // 64) + 1


def test_rows_alike(spark):
    docs = spark.createDataFrame([(None, 1)] * 500 + [(3, "same text here")] * 500, "doc_id long, text string").repartition(4)
    rows = best_fit.pack(docs, LOAD, size=64, group=20, filled=10).collect()
    assert len(rows) == 1000 and len({(r["sequence_id"], r["offset"]) for r in rows}) == 1000
    assert len(packed([(r["sequence_id"], r["offset"], r["length"]) for r in rows], 64)) <= 1.1 * sum(r["length"] for r in rows) / 64 + 1
    assert best_fit.pack(docs.limit(0), LOAD).count() == 0


def test_place(spark):
    random = np.random.default_rng(6)
    for fills, most in (
        (random.integers(1, 1001, 4000), 1.04),
        (random.integers(501, 1001, 3000), 1),  # nothing fits beside anything
        (np.full(3000, 333), 1),
        (np.concatenate([random.integers(501, 900, 1500), random.integers(1, 60, 6000)]), 1.04),
        (np.full(50, 1000), 1),
    ):
        items = spark.createDataFrame([(i, int(x)) for i, x in enumerate(fills)], "bin long, fill long")
        got = best_fit.place(items, 1000, group=300, filled=20).collect()
        assert sorted(r["bin"] for r in got) == list(range(len(fills)))
        sequences = packed([(r["into"], r["at"], int(fills[r["bin"]])) for r in got], 1000)
        together = len(set(best_fit.best_fit(sorted(fills.tolist(), reverse=True), 1000)[0].tolist()))  # all in one group
        assert len(sequences) <= most * together + 1


def best_by_scan(fills, size):
    rooms, out = [], []
    for x in fills:
        fit = min((r for r in rooms if r >= x), default=None)
        if fit is None:
            rooms.append(size - x)
        else:
            rooms[rooms.index(fit)] -= x
    return sorted(rooms)


def test_best_fit_by_scan():
    random = np.random.default_rng(8)
    for _ in range(20):
        fills = random.integers(1, 101, 200).tolist()
        into, _, full = best_fit.best_fit(fills, 100)
        firsts = {int(b): int(f) for b, f in zip(into, full, strict=True)}
        assert sorted(100 - f for f in firsts.values()) == best_by_scan(fills, 100)
