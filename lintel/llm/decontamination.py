"""Benchmark decontamination by spaced seeds, in DataFrame functions alone.

A seed is a fixed mask over neighbouring words: the words under 1 are hashed, those under 0 may be anything. Two
passages that differ by substituted words still share a hash wherever every difference falls under a 0. Several masks
with different gaps make it likely that one of them does.

1. Hashes of all positions of the benchmark texts, one row each.
2. Hashes of all positions of all documents, joined with them.
3. Verified around each hit: document and item are laid side by side, and the best window of `window` words near the hit (or
   the whole item, if shorter) must agree in `agree` of its words.

The benchmark's hashes are counted first. Up to `broadcast_rows` they are broadcast, and hits are verified where they
are found: nothing of a document but its verified hits is ever shuffled. Beyond that number the join shuffles by
hash, hits are gathered by diagonal (document, item, difference of positions), joined with the texts again and verified in the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintel.llm.common import long_id, row_key, saved

#: Weight 5 masks; a passage of 16 words with 3 substitutions always leaves a position of one of them whole.
MASKS = ("11011001", "1010010011", "11111")
#: The same for items of fewer words, by their number and for as many substitutions as an agreement of 0.8 allows; chosen by enumeration.
SHORT_MASKS = {
    1: ("1",), 2: ("11",), 3: ("111",), 4: ("1111",), 5: ("111", "1101"), 6: ("1111", "11011"), 7: ("11111", "111011", "110111"), 8: ("111111", "1111011", "1101111"),
    9: ("1111011", "1101111"), 10: ("111011", "11010011", "11111"), 11: ("1101011", "1110011"), 12: ("11101011", "101100111", "111111"), 13: ("11101011", "11001111"),
    14: ("111010011", "1111011"), 15: ("1111011", "11001000111", "11010110001"),
}
#: Benchmark hashes up to this number are broadcast: 16 bytes each.
BROADCAST_ROWS = 2_000_000


def words_of(text: Column) -> Column:
    """Lower-case words without punctuation; null has none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _positions(rows: DataFrame, masks: dict[str, Column]) -> DataFrame:
    """All columns of rows, pos and hash: one row for every position where a mask fits, for masks whose condition holds."""
    most = max(m.count("1") for m in masks)
    # Words under 1, as steps from the first; where a mask has fewer, nulls, which a hash passes over.
    steps = {m: [i for i, c in enumerate(m) if c == "1"] for m in masks}
    laid = {m: F.struct(F.lit(int(m, 2)).alias("mask"), F.lit(len(m)).alias("span"), *[F.lit(at[k] if k < len(at) else None).cast("int").alias(f"step{k}") for k in range(most)]) for m, at in steps.items()}
    # The outer forms: for the others Spark would put a filter on the arrays below the columns they are made of.
    each = rows.select(*rows.columns, F.explode_outer(F.array(*[laid[m] if where is None else F.when(where, laid[m]) for m, where in masks.items()])).alias("seed"))
    each = each.select(*rows.columns, "seed", F.posexplode_outer("words").alias("pos", "word")).where(F.col("pos") + F.col("seed.span") <= F.size("words"))
    return each.select(*rows.columns, "pos", F.xxhash64("seed.mask", *[F.get("words", F.col("pos") + F.col(f"seed.step{k}")) for k in range(most)]).alias("hash"))


def _near(words: Column, pos: Column, window: int) -> Column:
    """The words that a window over `pos` can hold."""
    begin = F.greatest(F.lit(0), pos - window + 1)
    return F.slice(words, begin + 1, F.least(F.size(words), pos + window) - begin)


def _verified(hits: DataFrame, window: int, agree: float) -> DataFrame:
    """The best window within `window` words of the document position `pos` along the diagonal `shift`, if it agrees enough. near: the words around pos, of n_words."""
    length = F.least(F.lit(window), F.size("item_words"))
    begin = F.greatest(F.lit(0), F.col("pos") - window + 1)
    first = F.greatest(begin, F.col("shift"))
    last = F.least(F.col("n_words"), F.size("item_words") + F.col("shift"), F.col("pos") + window)
    n = F.greatest(last - first, F.lit(0))
    # Hits of a text leave this step together: each holds no more than the words to compare, neither the text's words nor the item's.
    own, other = F.slice("near", first - begin + 1, n), F.slice("item_words", first - F.col("shift") + 1, n)
    laid = hits.where(n >= length).select("doc_id", "key", "item_key", "shift", length.alias("length"), first.alias("first"), own.alias("own"), other.alias("other"))
    same = F.zip_with("own", "other", lambda a, b: (a == b).cast("int"))
    laid = laid.select("doc_id", "key", "item_key", "shift", "length", "first", (F.size("own") - F.col("length")).alias("more"), F.size("other").alias("n"), same.alias("same"))
    counts = F.transform(F.sequence(F.lit(0), F.col("more")), lambda i: F.struct(F.aggregate(F.slice("same", i + 1, F.col("length")), F.lit(0), lambda a, x: a + x).alias("matches"), (-i).alias("back")))
    # Exploded, or Spark would put the filter with all that it counts into the join below, and count again for every window.
    best = laid.select("doc_id", "key", "item_key", "shift", "length", "first", F.explode_outer(F.array(F.array_max(counts))).alias("best")).where(F.col("best.matches") >= F.ceil(F.col("length") * agree))
    start = F.col("first") - F.col("best.back")
    return best.select("doc_id", "key", "item_key", start.alias("doc_start"), (start - F.col("shift")).alias("item_start"), "length", F.col("best.matches").alias("matches")).distinct()


def _found(docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, window: int = 16, agree: float = 0.8, broadcast_rows: int = BROADCAST_ROWS) -> tuple[DataFrame, DataFrame]:
    """overlaps() with item_key, which items of equal words share, in place of item_id; item_id and item_key of all items."""
    # From here on a word is its 64-bit hash.
    coded = lambda text: F.transform(words_of(text), lambda w: F.xxhash64(w))
    known = docs.where("doc_id is not null").select(long_id(docs), row_key().alias("key"), "text")
    texts = known.select("doc_id", "key", coded(F.col("text")).alias("words"))
    named = benchmark.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), coded(F.col("text")).alias("words")).withColumn("item_key", F.xxhash64("words"))
    items = named.select("item_key", "words").distinct()
    size = F.size("words")
    short = sorted(r["n"] for r in items.where(size.between(1, max(SHORT_MASKS))).select(size.alias("n")).distinct().collect())  # 15 at most
    lengths = {m: [n for n in short if m in SHORT_MASKS[n]] for m in dict.fromkeys([*masks, *(m for n in short for m in SHORT_MASKS[n])])}
    of_item = {m: size.isin(ns) | ((size > max(SHORT_MASKS)) & F.lit(m in masks)) for m, ns in lengths.items()}
    of_text = dict.fromkeys(lengths)
    needles = _positions(items, of_item).select("item_key", F.col("pos").alias("item_pos"), "hash").distinct()
    names, items = named.select("item_id", "item_key").distinct(), items.withColumnRenamed("words", "item_words")
    if needles.limit(broadcast_rows + 1).count() <= broadcast_rows:
        at = _positions(texts, of_text).join(F.broadcast(needles), "hash")
        at = at.select("doc_id", "key", "item_key", "pos", (F.col("pos") - F.col("item_pos")).alias("shift"), F.size("words").alias("n_words"), _near(F.col("words"), F.col("pos"), window).alias("near"))
        return _verified(at.join(F.broadcast(items), "item_key"), window, agree), names
    at = _positions(texts, of_text).select("doc_id", "key", "pos", "hash").join(needles, "hash")
    hits = at.groupBy("doc_id", "key", "item_key", (F.col("pos") - F.col("item_pos")).alias("shift")).agg(F.collect_set("pos").alias("at"))
    full = hits.join(known, ["doc_id", "key"]).withColumn("words", coded(F.col("text")))
    near = F.transform("at", lambda pos: F.struct(pos.alias("pos"), _near(F.col("words"), pos, window).alias("near")))
    full = full.select("doc_id", "key", "item_key", "shift", F.size("words").alias("n_words"), F.explode(near).alias("of")).select("doc_id", "key", "item_key", "shift", "n_words", "of.*")
    return _verified(full.join(items, "item_key"), window, agree), names


def overlaps(docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """Passages of `benchmark` (item_id, text) in `docs` (doc_id, text): doc_id, key, item_id, doc_start, item_start, length, matches.

    One row per document, item and best window near a hit: where it starts, in words of the lower-case text without punctuation,
    how many words it has (`window`, or all of an item's if those are fewer) and how many agree; at least `agree` of them do.
    Items of fewer than 16 words have masks of their own, so that whatever
    an agreement of 0.8 allows is found; a document takes those masks only if the benchmark has items of such lengths. Null texts have no words; rows with a null doc_id
    or item_id are left out, and repeated rows give their result once. Items of equal words are looked for once. Other columns are ignored. `key` tells texts of one doc_id apart.
    kw: masks, window (16), agree (0.8), broadcast_rows.
    """
    rows, names = _found(docs, benchmark, **kw)
    return rows.join(names, "item_key").select("doc_id", "key", "item_id", "doc_start", "item_start", "length", "matches").distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """doc_id, item_id, n_overlaps, matches, length of each document and item with a verified overlap; the last two of the best.

    Texts of any length are read whole; nulls, ties, repeated rows, empty tables and other columns as in overlaps().
    """
    return overlaps(docs, benchmark, **kw).groupBy("doc_id", "item_id").agg(F.count("*").alias("n_overlaps"), F.max(F.struct("matches", "length")).alias("best")).select("doc_id", "item_id", "n_overlaps", "best.matches", "best.length")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """`docs` without rows that overlap a benchmark item; all columns stay, and so do rows with a null doc_id."""
    # Saved: a small table, whose size then decides how it is joined, where the texts would be shuffled for a plan of unknown size.
    bad = saved(_found(docs, benchmark, **kw)[0].select(F.col("doc_id").alias("gone"), F.col("key").alias("gone_key")).distinct(), "leaks")
    return docs.join(bad, (docs.doc_id == bad.gone) & (row_key() == bad.gone_key), "left_anti")
