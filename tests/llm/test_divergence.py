"""The source divergence audit against plain counting."""

import collections
import re

import numpy as np
from pyspark.sql import functions as F

from lintel.llm import source_divergence
from lintel.llm.source_divergence import audit, gallop, price

SCHEMA = "doc_id long, text string, lang string, source string"


def plain(rows, min_docs, top):
    """The audit by its definition, with whole numbers."""
    counts, having, groups = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter), set()
    for _, text, lang, source in rows:
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        groups.add((lang or "", source or ""))
        counts[lang or "", source or ""].update(found)
        having[lang or ""].update(set(found))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = {t for t, n in having[lang].items() if n >= min_docs}
        sources = sorted(s for own, s in groups if own == lang)

        def prices(count, kept=kept):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 5) // (total + 5 * len(kept)) for t in kept}

        whole = prices(sum((counts[lang, s] for s in sources), collections.Counter()))
        own = {s: prices(counts[lang, s]) for s in sources}
        for s in sources:
            pairs = [(sum(abs(own[s][t] - own[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(own[s][t] - whole[t], t) for t in kept if counts[lang, s][t] and own[s][t] > whole[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                order = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(order if part == "pair" else order[:top])}
    return out


def corpus():
    random = np.random.default_rng(3)
    words = [f"w{a}{b}" for a in "abcdefghij" for b in "klmnopqrsté"] + ["Straße", "ÉCOLE", "ABC", "abc", "x_y", "𝒜b", "日本"]
    rows = []
    for i in range(160):
        near = int(random.integers(0, 60))
        text = " ".join(words[k % len(words)] for k in near + random.integers(0, 70, int(random.integers(0, 90))))
        rows.append((i, text, ["en", "de", None, ""][i % 4], [None, "s1", "s2", "s3", "é"][int(random.integers(0, 5))]))
    rows += [(1, None, "en", "empty"), (1, "", "en", "empty"), (None, "abc " * 3000, "en", "s1"), (None, "abc " * 3000, "en", "s1"), (7, "rare words only", "lonely", "one"), (8, "1234 !!", "none", "a"), (9, "", "none", "b")]
    return rows


def rows_of(df):
    return {(r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in df.collect()}


def test_audit_by_plain_counting(spark, monkeypatch):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    for clash in ("term", "n", "chunk", "value", "rank", "item", "id"):
        docs = docs.withColumn(clash, F.lit(1))
    for min_docs, top in ((4, 5), (1, 50), (10**6, 50)):
        assert rows_of(audit(docs, min_docs, top)) == plain(corpus(), min_docs, top)
    # Many chunks a pair, and sums handed on again and again.
    monkeypatch.setattr(source_divergence, "CHUNK", 9)
    got = audit(docs.repartition(3), 4, 5)
    assert got.count() == len(plain(corpus(), 4, 5)) and rows_of(got) == plain(corpus(), 4, 5)
    assert audit(docs.limit(0)).count() == 0


def test_terms_are_handed_on_in_parts(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(source_divergence, "HELD", 3)
    batch = pa.RecordBatch.from_pydict({"lang": ["l"] * 4, "source": ["s", "s", "t", "s"], "text": ["a b b", "c d A", "a", None]})
    parts = list(source_divergence._count_batches([batch]))
    assert len(parts) == 2
    total = collections.Counter()
    for part in parts:
        for r in part.to_pylist():
            total[r["source"], r["term"]] += r["n"] * 100 + r["docs"]
    assert total == {("s", "a"): 202, ("s", "b"): 201, ("s", "c"): 101, ("s", "d"): 101, ("t", "a"): 101}


def test_gallop_and_price():
    random = np.random.default_rng(1)
    for n, m in ((0, 5), (5, 0), (1, 9000), (3000, 9000), (700, 701), (600, 100000)):
        short, long = (np.unique(random.integers(0, 200000, k)).astype(np.int32) for k in (n, m))
        assert np.array_equal(gallop(short, long), np.searchsorted(long, short))
    for count, total, terms in ((0, 0, 1), (3, 10, 4), (10**12, 10**13 + 1, 10**6), (9 * 10**14, 9 * 10**14, 7)):
        assert price(np.array([count]), total, terms)[0] == 1 + 10**9 * (count + 5) // (total + 5 * terms)
