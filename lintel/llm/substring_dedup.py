"""Substring dedup by recompression.

Rounds rename a text's symbols: first each run of one symbol, then each pair of a "left" and a "right"
symbol. A name is a 64-bit hash of what it stands for (a word's bytes, a run's symbol and length, a pair's two symbols), so
every task on every executor gives equal stretches equal names without exchanging a table of names. Whether a symbol is renamed hangs only on its neighbours,
so two equal stretches of words agree on all symbols but a few at their ends. With each symbol go the bounds
of the words its name depends on; a symbol whose bounds lie inside a window is the same wherever that window
stands.

1. For each window of `width` words: the highest round with such a symbol, and there the longest, of those the
   one with the least name. That is the window's anchor; single words are round 0, so every window has one. Equal windows have equal anchors.
2. Anchors that stand in documents with different ids *reveal* possible repeats (one grouping by anchor).
3. Only windows below such anchors are *verified*, by 96-bit names of all their words: words are paired, pairs of words paired
   again and so on, each time through a mixing function, so that no structure of a text makes names meet. First whole spans
   (windows in a row with one anchor) are compared: where a smaller doc_id has an equal span, all of it goes. Of equal spans only
   that of the least doc_id goes on as single windows, and a window is removed where a smaller doc_id has one of the same name.
   Windows of one text with one name at equal distances, as in a passage that repeats a word or two, are one row.

Documents whose whole text equals that of a smaller doc_id need no windows: all their words go if there are at
least `width`. All groupings aggregate before they shuffle. Joins back to the rows are sort-merge joins between two plain
exchanges or saved tables, which adaptive execution can split, so a passage in a third of all documents stays harmless.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel.llm.common import Words, long_id, mix, row_key, saved, steps, text_bytes, word_names

#: Rounds of renaming; a symbol stands for about (4/3)^rounds words.
ROUNDS = 4


def _run(names, lo, hi, size, wall):
    """Name runs of one symbol. Where a run ends depends on the symbols beside it, so bounds grow by those."""
    new = np.empty(len(names), dtype=bool)
    new[0] = True
    np.not_equal(names[1:], names[:-1], out=new[1:])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(names)) - 1
    length = (last - first + 1).astype(np.uint64)
    out = names[first]
    many = length > 1
    if many.any():
        out[many] = mix(out[many] ^ (length[many] * np.uint64(0xA24BAED4963EE407)))
    return out, lo[np.maximum(first - 1, 0)], hi[np.minimum(last + 1, len(names) - 1)], size[first] * length.astype(np.int64), wall[first]


def _pair(names, lo, hi, size, wall, round_):
    """Join each left symbol with a right symbol after it; `wall` marks the places between texts."""
    left = (mix(names + np.uint64(round_ + 1)) >> np.uint64(63)).astype(bool)
    joins = np.zeros(len(names), dtype=bool)
    joins[:-1] = left[:-1] & ~left[1:] & ~wall[:-1] & ~wall[1:]
    taken = np.zeros(len(names), dtype=bool)
    taken[1:] = joins[:-1]
    ahead, behind = np.minimum(np.arange(len(names)) + 1, len(names) - 1), np.maximum(np.arange(len(names)) - 1, 0)
    out = names.copy()
    at = np.flatnonzero(joins)
    size = size.copy()
    size[at] += size[at + 1]
    out[at] = mix(names[at] * np.uint64(0x9FB21C651E98DF25) + mix(names[at + 1] + np.uint64(round_)))
    hi = np.where(left, hi[ahead], hi)
    lo = np.where(~left & ~taken, lo[behind], lo)
    keep = ~taken
    return out[keep], lo[keep], hi[keep], size[keep], wall[keep]


def anchors(word_names: np.ndarray, first: np.ndarray, width: int):
    """Stretches of windows with one anchor: (text number, first window, windows, anchor).

    word_names: of the words of all texts; first: number of each text's first word, and of all words at the end.
    """
    n = np.diff(first)
    texts = np.flatnonzero(n >= width)
    if not len(texts):
        return [np.zeros(0, dtype=np.int64)] * 3 + [np.zeros(0, dtype=np.uint64)]
    # Places: a wall, the words of a text, a wall, and so on.
    count = n[texts]
    base = np.cumsum(np.append(0, count + 1))[:-1] + 1
    total = int(count.sum() + len(texts) + 1)
    wall = np.ones(total, dtype=bool)
    places = np.repeat(base - np.append(0, np.cumsum(count))[:-1], count) + np.arange(int(count.sum()))
    wall[places] = False
    names = mix(np.arange(total, dtype=np.uint64) ^ np.uint64(0x5851F42D4C957F2D))
    names[places] = word_names[np.repeat(first[:-1][texts] - np.append(0, np.cumsum(count))[:-1], count) + np.arange(int(count.sum()))]
    lo, hi = np.arange(total, dtype=np.int64), np.arange(1, total + 1, dtype=np.int64)
    size = np.ones(total, dtype=np.int64)
    levels = []
    for round_ in range(ROUNDS + 1):
        fits = ~wall & (hi - lo <= width)
        # Long symbols come first: fewer unlike texts share them.
        rank = (np.uint64(255) - np.minimum(size[fits], 255).astype(np.uint64)) << np.uint64(56) | names[fits] >> np.uint64(8)
        levels.append((rank, lo[fits], hi[fits]))
        if round_ == ROUNDS:
            break
        names, lo, hi, size, wall = _pair(*_run(names, lo, hi, size, wall), round_)
    windows = count - width + 1
    starts = np.repeat(base - np.append(0, np.cumsum(windows))[:-1], windows) + np.arange(int(windows.sum()))
    anchor = np.zeros(len(starts), dtype=np.uint64)
    open_ = np.arange(len(starts))
    for names, lo, hi in reversed(levels):
        if not len(names) or not len(open_):
            continue
        at = starts[open_]
        begins = np.cumsum(np.bincount(lo, minlength=total + 1))
        ends = np.cumsum(np.bincount(hi, minlength=total + width + 1))
        a, b = begins[at - 1], ends[at + width]
        found = a < b
        if not found.any():
            continue
        a, b = a[found], b[found]
        new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
        cuts = np.empty(2 * int(new.sum()), dtype=np.int64)
        cuts[::2], cuts[1::2] = a[new], b[new]
        least = np.minimum.reduceat(np.append(names, np.uint64(2**64 - 1)), cuts)[::2]
        anchor[open_[found]] = least[np.cumsum(new) - 1]
        open_ = open_[~found]
    text = np.repeat(texts, windows)
    place = starts - np.repeat(base, windows)
    new = np.append(True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]))
    at = np.flatnonzero(new)
    return text[at], place[at], np.diff(np.append(at, len(starts))), anchor[at]


def window_names(words: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Names of the `width` words from each place in `at`, from names of 1, 2, 4 and so on words."""
    out, block, size = np.full(len(at), width, dtype=np.uint64), words, 1
    at = at.copy()
    while size <= width:
        if width & size:
            out = mix(out * np.uint64(0x9FB21C651E98DF25) + block[at])
            at += size
        block = mix(block[:-size] * np.uint64(0xA24BAED4963EE407) + block[size:])
        size *= 2
    return out


def span_windows(first: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of spans (first word of the text, first window, windows) each window's first word, counted over all texts and in its own."""
    place = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    return np.repeat(first, n) + place, place


def span_names(words: Words, at: np.ndarray, n: np.ndarray, width: int) -> list[np.ndarray]:
    """Two names of each span of `n` windows in a row: sums of its windows' names, each mixed with its place in the span."""
    begin = np.cumsum(n) - n
    place = mix(np.arange(len(at), dtype=np.uint64) - np.repeat(begin, n).astype(np.uint64))
    return [np.add.reduceat(mix(window_names(word_names(words, salt), at, width) + place), begin) for salt in (1, 2)]


def _name_columns(one: np.ndarray, two: np.ndarray) -> list:
    """64 bits of the first name, 32 of the second."""
    import pyarrow as pa

    return [pa.array(one.view(np.int64)), pa.array((two >> np.uint64(32)).astype(np.uint32).view(np.int32))]


def _anchor_batches(width: int):
    def task(batches):
        import pyarrow as pa

        for batch in batches:
            data, bounds = text_bytes(batch.column("text"))
            for i, j in steps(bounds):
                words = Words(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
                text, start, n, name = anchors(word_names(words), words.first, width)
                if len(text):
                    rows, (at, _) = pa.array(text + i), span_windows(words.first[:-1][text], start, n)
                    spans = span_names(words, at, n, width)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").take(rows), batch.column("key").take(rows), pa.array(name.view(np.int64)), *(pa.array(x.astype(np.int32)) for x in (start, n)), *_name_columns(*spans)],
                        ["doc_id", "key", "anchor", "start", "n", "h1", "h2"],
                    )

    return task


def progressions(group: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows sorted by group and place as progressions: the first row of each, its step and length. Neighbours may share a row."""
    n = len(group)
    gap = np.append(0, np.diff(place))
    same = np.append(False, group[1:] == group[:-1])
    goes = np.zeros(n, dtype=bool)
    goes[2:] = same[2:] & same[1:-1] & (gap[2:] == gap[1:-1])
    inside = goes.copy()
    inside[:-1] |= goes[1:]
    inside[:-2] |= goes[2:]
    begin = np.flatnonzero(goes & ~np.append(False, goes[:-1]))
    end = np.flatnonzero(goes & ~np.append(goes[1:], False))
    alone = np.flatnonzero(~inside)
    return np.append(begin - 2, alone), np.append(gap[begin], np.zeros(len(alone), dtype=np.int64)), np.append(end - begin + 3, np.ones(len(alone), dtype=np.int64))


def _window_batches(width: int):
    """96-bit names of the windows in `spans`: doc_id, key, h1, h2, and where they start: start, start + step, ... n times."""

    def task(batches):
        import pyarrow as pa

        for batch in batches:
            data, bounds = text_bytes(batch.column("text"))
            spans = batch.column("spans")
            for i, j in steps(bounds):
                words = Words(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
                part = spans.slice(i, j - i)
                flat = part.flatten()
                start, n = (np.asarray(flat.field(x), dtype=np.int64) for x in ("start", "n"))
                text = np.repeat(np.arange(j - i), np.asarray(part.value_lengths(), dtype=np.int64))
                at, place = span_windows(words.first[:-1][text], start, n)
                text = np.repeat(text, n)
                one, two = (window_names(word_names(words, salt), at, width) for salt in (1, 2))
                group = mix(one ^ mix(text.astype(np.uint64) + np.uint64(1)))
                order = np.lexsort((place, group))
                first, step, times = progressions(group[order], place[order])
                first = order[first]
                rows = pa.array(text[first] + i)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(rows), batch.column("key").take(rows), *_name_columns(one[first], two[first]), *(pa.array(x.astype(np.int32)) for x in (place[first], step, times))],
                    ["doc_id", "key", "h1", "h2", "start", "step", "n"],
                )

    return task


def _keep_batches(width: int):
    def task(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            ids, copies, starts = batch.column("doc_id"), batch.column("copy").to_pylist(), batch.column("starts")
            for i, text in enumerate(batch.column("text")):
                words = (text.as_py() or "").encode().split()
                gone = np.zeros(len(words) + 1, dtype=np.int64)
                if copies[i] and len(words) >= width:
                    gone[0], gone[-1] = 1, -1
                elif starts[i].is_valid:
                    start, step, n = (np.asarray(starts[i].values.field(x), dtype=np.int64) for x in ("start", "step", "n"))
                    k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                    at = np.repeat(start, n) + k * np.repeat(step, n)
                    np.add.at(gone, at, 1)
                    np.add.at(gone, at + width, -1)
                gone = np.cumsum(gone)[:-1] > 0
                kept = b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g) if gone.any() else b" ".join(words)
                out.append((len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode()))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [[]] * 4, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True))], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return task


def remove_repeats(docs: DataFrame, width: int = 50) -> DataFrame:
    """Texts without the windows of `width` words that a document with a smaller doc_id has too.

    Takes doc_id (long) and text; other columns are ignored. Returns doc_id, n_words, n_removed, kept_sha256 and
    kept (the kept words joined by one space). Judged on the input, not on what is left.
    A null or blank text has no words and stays. A null doc_id is not smaller or larger than any: such rows
    neither lose words nor take any. Rows that share a doc_id are judged each on its own and never against each
    other. An empty table gives an empty result. A very long text is handled whole, in a step of its own: memory follows the longest text.
    """
    docs = docs.select(long_id(docs), "text", row_key().alias("key"))
    known = docs.where("doc_id is not null")
    digest = F.md5(F.coalesce(F.col("text"), F.lit("")))
    digests = known.select("doc_id", "key", digest.alias("digest"))
    least = digests.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    copies = saved(digests.join(least.select("digest", "least"), "digest").where("doc_id > least").select("doc_id", "key").distinct(), "copies")

    spots = saved(known.mapInArrow(_anchor_batches(width), "doc_id long, key long, anchor long, start int, n int, h1 long, h2 int"), "anchors")
    shared = saved(spots.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("anchor"), "shared")
    found = saved(spots.join(shared, "anchor").join(copies, ["doc_id", "key"], "left_anti").drop("anchor"), "spans")
    equal = saved(found.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("least"), F.count("*").alias("times")).where("times > 1").drop("times"), "equal")
    found = saved(found.join(equal, ["h1", "h2", "n"], "left").withColumn("gone", F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))).select("doc_id", "key", "start", "n", "gone"), "spans")
    spans = found.where("not gone").groupBy("doc_id", "key").agg(F.collect_set(F.struct("start", "n")).alias("spans"))
    # Not written to disk: both uses and the last join read one shuffle of the texts.
    windows = known.join(spans, ["doc_id", "key"]).select("doc_id", "key", "text", "spans").mapInArrow(_window_batches(width), "doc_id long, key long, h1 long, h2 int, start int, step int, n int")
    sources = windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.count("*").alias("times")).where("times > 1").select(F.col("h1").alias("s1"), F.col("h2").alias("s2"), "least")
    # By h1 alone: the grouping above is by both, so that both sides of the join get an exchange of their own and a name that many texts have can be split.
    same = (F.col("h1") == F.col("s1")) & (F.col("h2") <= F.col("s2")) & (F.col("h2") >= F.col("s2"))
    single = windows.join(sources, same).where("doc_id > least").select("doc_id", "key", "start", "step", "n")
    whole = found.where("gone").select("doc_id", "key", "start", F.lit(1).alias("step"), "n")
    hits = single.unionByName(whole).groupBy("doc_id", "key").agg(F.collect_list(F.struct("start", "step", "n")).alias("starts"))
    marked = known.join(hits, ["doc_id", "key"], "left").join(copies.withColumn("copy", F.lit(True)), ["doc_id", "key"], "left")
    loose = docs.where("doc_id is null").select("doc_id", "text", F.lit(False).alias("copy"), F.lit(None).cast(dict(hits.dtypes)["starts"]).alias("starts"))
    rows = marked.select("doc_id", "text", F.coalesce("copy", F.lit(False)).alias("copy"), "starts").unionByName(loose)
    return rows.mapInArrow(_keep_batches(width), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
