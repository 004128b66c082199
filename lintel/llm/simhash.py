"""SimHash near-dedup by a self-join of binary tries.

A fingerprint holds one or more *words* of bits. Per word, all distinct values form a binary trie. The join
walks pairs of trie nodes together from the roots: a step down splits both nodes by the next bit, a pair on
different branches has spent one more unit of the error budget, and a pair beyond the budget is dropped with
all below it. Small nodes are compared outright.

At scale the trie is rotated. A word is cut into one part more than the budget has errors, so two words within the budget
agree in a part; each part in turn is put on top, and only nodes that agree in it are walked, with the whole budget for what is below. A row thus
goes to as many tries as there are parts, however large the input. Where the nodes of one part still hold too many rows for a task, the next
`depth` bits cut them into blocks, and a block is joined with itself and with those later blocks whose bits differ in no more places than the budget.

A task returns no pairs but a forest: for each linked value its task-wide representative, so the output stays in
proportion to the input even where thousands of copies link to each other. Node pairs whose values are
all known to be linked already are skipped; lower budgets are walked first for that. Components over all tasks
come from alternating large-star and small-star steps, which are groupings and joins of the edge table.

Where links are only candidates, to be verified on the texts, a task returns pairs with their distance. In a dense group it first returns a few
nearest pairs of each value and names the values of which it left pairs out. What verifies makes components; the named values alone are walked again,
starting from those, with more pairs each: only pairs inside a *verified* component are skipped for good. It ends when no value is named.
"""

from __future__ import annotations

import math
from math import comb

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel.llm.common import long_id, mix, saved

#: Node pairs with at most so many value pairs are compared outright.
LEAF = 64
#: Node pairs (or value pairs) held at once while walking.
FRONT = 1 << 19
#: Rows of a task that walks nodes of one part, and most rows where one such node has more.
BLOCK_ROWS, TASK_ROWS = 1 << 13, 2_000_000
#: Pairs of each value that a task returns in the first walk, and how many times as many in each walk after it.
FAN, FAN_GROWTH = 1, 8


def _counts_over_half(hashes: np.ndarray, lanes: int) -> np.ndarray:
    """Bits that are set in over half the hashes, as `lanes` 64-bit numbers; lane 0 counts the hashes themselves."""
    n = len(hashes)
    total = np.zeros(64 * lanes, dtype=np.int64)
    for i in range(0, n, 255 * 64):
        part = hashes[i : i + 255 * 64]
        wide = np.empty((len(part), lanes), dtype=np.uint64)
        for lane in range(lanes):
            wide[:, lane] = part if lane == 0 else mix(part + np.uint64(0x9E3779B97F4A7C15 * lane & (2**64 - 1)))
        bits = np.unpackbits(wide.view(np.uint8), axis=1, bitorder="little")
        for j in range(0, len(part), 255):
            total += bits[j : j + 255].sum(axis=0, dtype=np.uint8)
    return np.packbits(total * 2 > n, bitorder="little").view(np.uint64)


_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def _shingle_hashes(text: str | None, ngram: int) -> np.ndarray:
    """A hash for every `ngram` words in a row, with repeats."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    joined = b" ".join((text or "").encode().translate(_LOWER).split())
    if not joined:
        return np.zeros(0, dtype=np.uint64)
    ends = np.append(np.flatnonzero(np.frombuffer(joined, dtype=np.uint8) == 32), len(joined))
    if len(ends) <= ngram:
        return np.array([digest(joined, 42)], dtype=np.uint64)
    a = [0, *(ends[: len(ends) - ngram] + 1).tolist()]
    b = ends[ngram - 1 :].tolist()
    return np.fromiter((digest(joined[x:y], 42) for x, y in zip(a, b, strict=True)), dtype=np.uint64, count=len(a))


#: Buckets of a sketch.
BUCKETS = 256


def _sketch(hashes: np.ndarray) -> bytes:
    """How many distinct shingles fall into each bucket, a byte each; 255 everywhere if a bucket has more than 254. Two sets share no more than the sum of the lesser counts."""
    counts = np.bincount((mix(hashes) % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
    return (counts if counts.max() < 255 else np.full(BUCKETS, 255)).astype(np.uint8).tobytes()


def _possible(column, similarity: float):
    """From an Arrow column of sketches a function of places a, b: whether those sets may have this Jaccard similarity."""
    rows = np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, BUCKETS)
    size, full = rows.sum(axis=1, dtype=np.int64), rows[:, 0] == 255

    def possible(a, b):
        out = full[a] | full[b]
        for i in range(0, len(a), 8192):
            x, y = a[i : i + 8192], b[i : i + 8192]
            common = np.minimum(rows[x], rows[y]).sum(axis=1, dtype=np.int64)
            out[i : i + 8192] |= common >= similarity * (size[x] + size[y] - common) - 1e-6
        return out

    return possible


def _fingerprint_batches(ngram: int, lanes: int, keyed: bool):
    def task(batches):
        import pyarrow as pa

        for batch in batches:
            column, out, sets, sketches = batch.column("text"), np.zeros((batch.num_rows, lanes), dtype=np.uint64), np.zeros(batch.num_rows, dtype=np.uint64), [bytes(BUCKETS)] * batch.num_rows
            for i, text in enumerate(column):
                hashes = _shingle_hashes(text.as_py(), ngram)
                if len(hashes):
                    out[i] = _counts_over_half(hashes, lanes)
                    if keyed:
                        distinct = np.unique(hashes)
                        sets[i], sketches[i] = mix(distinct).sum(), _sketch(distinct)
            flat = pa.array(out.view(np.int64).ravel())
            made = {"fp": pa.ListArray.from_arrays(pa.array(np.arange(0, lanes * batch.num_rows + 1, lanes, dtype=np.int32)), flat), "shingles": pa.array(sets.view(np.int64)), "sketch": pa.array(sketches, pa.binary())}
            rest = {n: batch.column(n) for n in batch.schema.names if n != "text"} | (made if keyed else {"fp": made["fp"]})
            yield pa.RecordBatch.from_arrays(list(rest.values()), list(rest))

    return task


def fingerprints(docs: DataFrame, ngram: int, bits: int, keyed: bool = False) -> DataFrame:
    """doc_id, key (of the text) and fp, an array of bits/64 longs. No words: all zero. With `keyed` also shingles (a hash of their set) and its sketch."""
    schema = "doc_id long, key long, fp array<long>" + ", shingles long, sketch binary" * keyed
    return docs.select(long_id(docs), _text_key(), "text").mapInArrow(_fingerprint_batches(ngram, bits // 64, keyed), schema)


def _text_key():
    return F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("key")


def _set_batches(ngram: int):
    def task(batches):
        import pyarrow as pa

        for batch in batches:
            sets = [np.unique(_shingle_hashes(x.as_py(), ngram)).view(np.int64) for x in batch.column("text")]
            ends = np.append(0, np.cumsum([len(x) for x in sets], dtype=np.int64)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*sets, np.zeros(0, dtype=np.int64)])))
            yield pa.RecordBatch.from_arrays([batch.column("id"), lists], ["id", "shingles"])

    return task


def shingle_sets(links: DataFrame, values: DataFrame, docs: DataFrame, ngram: int) -> DataFrame:
    """id and shingles (hashes, each once) of every value with a link a, b. values: id and key of a text with it. Texts without a link are not hashed."""
    asked = links.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(values.select("id", "key"), "id")
    texts = docs.select(_text_key(), "text").join(asked, "key").select("id", "text").groupBy("id").agg(F.first("text").alias("text"))
    return saved(texts.mapInArrow(_set_batches(ngram), "id long, shingles array<long>"), "sets")


def similar_links(links: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of the links a, b (with all their columns) whose shingle sets have a Jaccard similarity of at least `similarity`."""
    side = lambda name: sets.select(F.col("id").alias(name), F.col("shingles").alias(f"of_{name}"))
    common = F.size(F.array_intersect("of_a", "of_b"))
    rated = links.join(side("a"), "a").join(side("b"), "b").select(*links.columns, common.alias("common"), (F.size("of_a") + F.size("of_b")).alias("both"))
    return rated.where(F.col("common") >= F.lit(similarity) * (F.col("both") - F.col("common"))).select(*links.columns)


def _merge(comp: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Join the components of a and b; comp holds each place's least known companion."""
    while True:
        x, y = comp[a], comp[b]
        differ = x != y
        if not differ.any():
            return comp
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(comp, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = comp[comp]
            if np.array_equal(up, comp):
                break
            comp = up


def walk(values: np.ndarray, roots: list[tuple[int, int, int, int, int]], depth: int, width: int, budget: int, wide: np.ndarray | None, most: int, fan: int = 0, pairs: list | None = None, held: np.ndarray | None = None, earlier: tuple[int, ...] = (), possible=None) -> np.ndarray:
    """Least linked companion of each place in `values`; with `fan`, which places it left pairs out of.

    values: sorted within each root node; roots: (first, end, first, end, differing bits) of node pairs `depth`
    bits down. With `wide`, rows of whole fingerprints, a pair within budget must also differ in at most `most` bits there.
    `pairs` takes the linked pairs and their distances; one is left out where `held` (the least place of each verified component) joins it, and for now where both
    values have `fan` pairs and are connected by them. earlier: masks of parts of which a pair that agrees in one belongs to another trie.
    possible: says of places a, b which of their pairs may link at all.
    """
    comp = np.arange(len(values)) if held is None else held.copy()
    held = comp.copy()
    inner = np.append(0, np.cumsum(held[1:] != held[:-1]))
    found, done = np.zeros(len(values), dtype=np.int64), -1
    left_out = np.zeros(len(values), dtype=bool)

    def rank(x):
        """How many pairs each value of x has before this one."""
        order = np.argsort(x, kind="stable")
        first = np.flatnonzero(np.append(True, x[order][1:] != x[order][:-1]))
        out = np.empty(len(x), dtype=np.int64)
        out[order] = np.arange(len(x)) - np.repeat(first, np.diff(np.append(first, len(x))))
        return out + found[x]

    def keep(a, b, bits):
        nonlocal comp
        near = np.argsort(bits, kind="stable")
        a, b, bits = a[near], b[near], bits[near]
        few = (rank(a) < fan) | (rank(b) < fan)
        comp = _merge(comp, a[few], b[few])
        new = np.flatnonzero(~few)
        new = new[comp[a[new]] != comp[b[new]]]
        if len(new):
            _, first = np.unique(np.sort(np.stack([comp[a[new]], comp[b[new]]]), axis=0), axis=1, return_index=True)
            few[new[first]] = True
            comp = _merge(comp, a[new[first]], b[new[first]])
        left_out[a[~few]] = left_out[b[~few]] = True
        pairs.append((a[few], b[few], bits[few]))
        np.add.at(found, a[few], 1)
        np.add.at(found, b[few], 1)
    one = np.uint64(1)

    def compare(lo1, hi1, lo2, hi2, allowed):
        nonlocal comp
        large = (hi1 - lo1) * (hi2 - lo2) > FRONT  # equal words of very many fingerprints: row by row, until all are linked
        for i in np.flatnonzero(large).tolist():
            wide2 = int(hi2[i] - lo2[i])
            for s in range(int(lo1[i]), int(hi1[i]), rows := max(1, FRONT // wide2)):
                e = min(s + rows, int(hi1[i]))
                if (held[s:e] == held[s]).all() and (held[lo2[i] : hi2[i]] == held[s]).all():
                    continue
                if (comp[s:e] == comp[s]).all() and (comp[lo2[i] : hi2[i]] == comp[s]).all() and (found[s:e] >= fan).all() and (found[lo2[i] : hi2[i]] >= fan).all():
                    left_out[s:e] = left_out[lo2[i] : hi2[i]] = True
                else:
                    for t in range(int(lo2[i]), int(hi2[i]), FRONT):
                        compare(*(np.array([x]) for x in (s, e, t, min(t + FRONT, int(hi2[i])))), allowed)
        if large.any():
            lo1, hi1, lo2, hi2 = (x[~large] for x in (lo1, hi1, lo2, hi2))
            if not len(lo1):
                return
        size = (hi1 - lo1) * (hi2 - lo2)
        cuts = np.append(np.searchsorted(np.cumsum(size), np.arange(0, int(size.sum()), FRONT), side="right"), len(size))
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            e = max(e, s + 1)
            n = size[s:e]
            at = np.repeat(np.arange(s, min(e, len(size))), n)
            k = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
            w = (hi2 - lo2)[at]
            a, b = lo1[at] + k // w, lo2[at] + k % w
            differ = values[a] ^ values[b]
            bits = np.bitwise_count(differ)
            near = (a < b) & (bits <= allowed) & (bits > done)  # fewer bits: compared with a lower budget
            a, b, differ = a[near], b[near], differ[near]
            for mask in earlier:
                apart = (differ & np.uint64(mask)) != 0
                a, b, differ = a[apart], b[apart], differ[apart]
            if wide is not None and len(a):
                fresh = held[a] != held[b]
                a, b = a[fresh], b[fresh]
                fresh = (comp[a] != comp[b]) | (found[a] < fan) | (found[b] < fan)
                left_out[a[~fresh]] = left_out[b[~fresh]] = True
                a, b = a[fresh], b[fresh]
                bits = np.bitwise_count(wide[a] ^ wide[b]).sum(axis=1)
                good = bits <= most
                a, b, bits = a[good], b[good], bits[good]
                if possible is not None and len(a):
                    good = possible(a, b)
                    a, b, bits = a[good], b[good], bits[good]
            if len(a) and pairs is not None:
                keep(a, b, bits)
            elif len(a):
                comp = _merge(comp, a, b)

    for allowed in range(min(1, budget), budget + 1) if budget else (0,):
        stack = [(depth, *np.array([r for r in roots if r[4] <= allowed], dtype=np.int64).reshape(-1, 5).T)]
        while stack:
            level, lo1, hi1, lo2, hi2, spent = stack.pop()
            if not len(lo1):
                continue
            # A node whose values are one component has no inner change; such pairs of one component need no more work.
            change = np.append(0, np.cumsum(comp[1:] != comp[:-1]))
            known = (change[hi1 - 1] == change[lo1]) & (change[hi2 - 1] == change[lo2]) & (comp[lo1] == comp[lo2])
            if fan:
                open_ = np.append(0, np.cumsum(found < fan))
                known &= (open_[hi1] == open_[lo1]) & (open_[hi2] == open_[lo2])
                verified = (inner[hi1 - 1] == inner[lo1]) & (inner[hi2 - 1] == inner[lo2]) & (held[lo1] == held[lo2])
                skipped, ends = np.zeros(len(values) + 1, dtype=np.int64), known & ~verified
                for lo, hi in ((lo1[ends], hi1[ends]), (lo2[ends], hi2[ends])):
                    np.add.at(skipped, lo, 1)
                    np.add.at(skipped, hi, -1)
                left_out |= np.cumsum(skipped[:-1]) > 0
                known |= verified
            small = ~known & (((hi1 - lo1) * (hi2 - lo2) <= LEAF) | (level >= width))
            if small.any():
                compare(lo1[small], hi1[small], lo2[small], hi2[small], allowed)
            rest = ~known & ~small
            if not rest.any():
                continue
            lo1, hi1, lo2, hi2, spent = (x[rest] for x in (lo1, hi1, lo2, hi2, spent))
            shift = np.uint64(width - 1 - level)
            bit = (values >> shift) & one
            ones = np.append(0, np.cumsum(bit.astype(np.int64)))
            mid1, mid2 = hi1 - (ones[hi1] - ones[lo1]), hi2 - (ones[hi2] - ones[lo2])
            same = lo1 == lo2
            kids = [
                np.concatenate(x)
                for x in zip(
                    (lo1, mid1, lo2, mid2, spent),
                    (mid1, hi1, mid2, hi2, spent),
                    (lo1, mid1, mid2, hi2, spent + 1),
                    tuple(x[~same] for x in (mid1, hi1, lo2, mid2, spent + 1)),
                    strict=True,
                )
            ]
            kept = (kids[0] < kids[1]) & (kids[2] < kids[3]) & (kids[4] <= allowed)
            kids = [x[kept] for x in kids]
            for s in range(0, len(kids[0]), FRONT):
                stack.append((level + 1, *(x[s : s + FRONT] for x in kids)))
        done = allowed
    return left_out if fan else comp


def parts(width: int, budget: int) -> list[tuple[int, int]]:
    """Where each of the budget + 1 parts of a word begins, from the top, and how many bits it has."""
    sizes = [width // (budget + 1) + (k < width % (budget + 1)) for k in range(budget + 1)]
    return [(sum(sizes[:k]), size) for k, size in enumerate(sizes)]


def earlier_parts(width: int, budget: int, part: int) -> tuple[int, ...]:
    """Masks of the parts before `part` in a word that is rotated so that `part` is on top."""
    cuts = parts(width, budget)
    return tuple(((1 << size) - 1) << (cuts[part][0] - at - size) for at, size in cuts[:part])


def _block_task(depths: list[int], width: int, budget: int, most: int | None, fan: int, similarity: float | None):
    """depths: bits below each part that cut its nodes into blocks. similarity: of texts, to be ruled out by sketches."""

    def task(table):
        import pyarrow as pa

        table = table.combine_chunks()
        part = table.column("part")[0].as_py()
        depth = parts(width, budget)[part][1] + depths[part]
        values = table.column("value").to_numpy().view(np.uint64)
        order = np.argsort(values, kind="stable")
        values = values[order]
        prefix = (values >> np.uint64(width - depth)).astype(np.int64)
        firsts = np.flatnonzero(np.append(True, prefix[1:] != prefix[:-1]))
        ends = np.append(firsts[1:], len(values))
        if depths[part]:
            # The block itself is the first; pairs of later blocks belong to other tasks.
            block = table.column("block")[0].as_py()
            roots = [(0, int(ends[0]), int(s), int(e), int(prefix[s] ^ block).bit_count()) for s, e in zip(firsts, ends, strict=True)] if prefix[0] == block else []
        else:
            roots = [(int(s), int(e), int(s), int(e), 0) for s, e in zip(firsts, ends, strict=True) if e - s > 1]
        wide = held = possible = None
        if similarity is not None:
            possible = _possible(table.column("sketch").combine_chunks().take(pa.array(order)), similarity)
        if most is not None:
            lists = table.column("fp").combine_chunks()
            wide = lists.flatten().to_numpy().view(np.uint64).reshape(len(values), -1)[order]
            _, first, of = np.unique(table.column("root").to_numpy()[order], return_index=True, return_inverse=True)
            held = first[of]
        pairs = [] if fan else None
        comp = walk(values, roots, depth, width, budget, wide, most or 0, fan, pairs, held, earlier_parts(width, budget, part), possible)
        ids = table.column("id").to_numpy()[order]
        if fan:
            a, b, bits = (np.concatenate([*x, np.zeros(0, dtype=np.int64)]).astype(np.int64) for x in (zip(*pairs, strict=True) if pairs else ((), (), ())))
            out = np.flatnonzero(comp)
            a, b, bits = (np.concatenate(x) for x in ((ids[a], ids[out]), (ids[b], ids[out]), (bits, np.zeros(len(out), dtype=np.int64))))
            return pa.table({"a": np.maximum(a, b), "b": np.minimum(a, b), "bits": bits})
        linked = np.flatnonzero(comp != np.arange(len(comp)))
        return pa.table({"a": ids[linked], "b": ids[comp[linked]]})

    return task


def trie_links(values: DataFrame, width: int, words: int, budget: int, most: int | None = None, fan: int = 0, similarity: float = 0.8) -> DataFrame:
    """Edges a, b (ids) that connect what links; with `fan` candidate pairs a, b, bits (their distance), of each value that many at least, if
    it has them, and a row with a = b for each value of which a pair was left out.

    values: id (long, one per fingerprint) and fp (array of longs). The first `words` words of `width` bits each
    are joined within `budget`; with `most`, whole fingerprints must also differ in at most that many bits, and pairs of one `root` (a column of
    values) are known; where values have a `sketch`, pairs whose sketches rule `similarity` out are none.
    """
    n = values.count()
    cuts, depths, coarse = parts(width, budget), [], []
    for _, size in cuts:
        depth = 0
        while depth < min(width - size, 20) and n / 2 ** (size + depth) * (sum(comb(depth, k) for k in range(budget + 1)) / 2 if depth else 1) > TASK_ROWS:
            depth += 1
        depths.append(depth)
        # Small nodes share a task, as many as make BLOCK_ROWS together.
        coarse.append(0 if depth else min(size, max(0, int(math.log2(max(1.0, BLOCK_ROWS * 2**size / max(1, n)))))))
    per = 64 // width
    whole = F.lit((1 << width) - 1 if width < 64 else -1)
    cut = [F.shiftrightunsigned(F.element_at("fp", w // per + 1), (w % per) * width).bitwiseAND(whole) for w in range(words)]
    carried = ["id", *([c for c in ("fp", "root", "sketch") if c in values.columns] if most is not None else [])]
    rows = values.select(*carried, F.posexplode(F.array(*cut)).alias("word", "bits_"))
    tries = []
    for k, (at, size) in enumerate(cuts):
        word = F.col("bits_")
        turned = F.shiftleft(word, at).bitwiseOR(F.shiftrightunsigned(word, width - at)).bitwiseAND(whole) if at else word
        own = F.shiftrightunsigned(turned, width - size - depths[k])
        masks = F.split(F.lit(",".join(str(m) for m in range(2 ** depths[k]) if m.bit_count() <= budget)), ",").cast("array<long>") if depths[k] else F.array(F.lit(0).cast("long"))
        tries.append(F.struct(F.lit(k).alias("part"), turned.alias("value"), own.alias("own"), F.lit(coarse[k]).alias("coarse"), *([masks.alias("masks")] if any(depths) else [])))
    rows = rows.select(*carried, "word", F.inline(F.array(*tries)))
    if any(depths):
        rows = rows.withColumn("mask", F.explode("masks")).withColumn("block", F.col("own").bitwiseXOR(F.col("mask"))).where("block <= own").drop("masks", "mask")
    else:
        rows = rows.withColumn("block", F.col("own"))
    rows = rows.withColumn("block", F.expr("shiftrightunsigned(block, coarse)")).drop("own", "coarse")
    return rows.groupBy("word", "part", "block").applyInArrow(_block_task(depths, width, budget, most, fan, similarity if "sketch" in values.columns else None), "a long, b long" + ", bits long" * bool(fan))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root (the least node reachable) for every node of an edge a, b with a different root.

    Alternating large-star and small-star steps; each halves the way to the root or better, and a step's table is
    written to the shared folder, so lineage stays short. Hot nodes only meet in aggregations with partial sums and in
    joins of two plain exchanges, which adaptive execution may split. Raises an error if `rounds` steps are not enough.
    """

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        if large:
            both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            both = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = saved(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        joined = both.join(least, "a")
        if large:
            return joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()

    pairs = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    for _ in range(rounds):
        pairs = saved(star(saved(star(pairs, True), "links"), False), "links")
        now = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now
    raise RuntimeError(f"components are not settled after {rounds} rounds")


def _grouped(docs: DataFrame, ngram: int = 5, bits: int = 256, width: int = 32, budget: int = 4, similarity: float | None = 0.8) -> DataFrame:
    """near_duplicates() with the rows' key and fp instead of the fingerprint."""
    keyed = similarity is not None
    prints = saved(fingerprints(docs, ngram, bits, keyed), "prints")
    copies = ["fp", "shingles"] if keyed else ["fp"]
    known = prints.groupBy(*copies).agg(F.min("doc_id").alias("least"), F.min("key").alias("key"), *([F.min("sketch").alias("sketch")] if keyed else []))
    if not keyed:
        values = saved(known.select(F.col("fp")[0].alias("id"), "fp", "least"), "values")
        return _named(prints, values, copies, components(trie_links(values, width, 1, budget)))
    # The angle between 0/1 vectors of sets with this Jaccard similarity.
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    most = round(bits * p + 3 * math.sqrt(bits * p * (1 - p)))
    values = saved(known.select(F.xxhash64(*copies).alias("id"), *copies, "least", "key", "sketch"), "values")
    return _named(prints, values, copies, _verified_components(values, docs, ngram, width, bits // width, budget, most, similarity))


def _verified_components(values: DataFrame, docs: DataFrame, ngram: int, width: int, words: int, budget: int, most: int, similarity: float) -> DataFrame:
    """components() of all candidates that hold, but for those that others connect.

    Walks and verifications take turns. The first walk reads fingerprints alone; later ones, of few values, also sketches, which rule out most pairs that would fail. A walk names the values of which it left pairs out; those are walked again, from the components verified so far and
    with FAN_GROWTH times as many pairs each, until none is named. So every candidate is verified or lies inside a verified component.
    """
    left, fan = values.select("id", "fp", F.col("id").alias("root")), FAN
    roots = tried = None
    while True:
        found = saved(trie_links(left, width, words, budget, most, fan, similarity).distinct(), "proposed")
        pairs = found.where("a <> b")
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = saved(pairs, "candidates")
        roots = _verified_roots(pairs, shingle_sets(pairs, values, docs, ngram), similarity, roots)
        named = found.where("a = b").select(F.col("a").alias("id"))
        if named.isEmpty():
            return roots
        tried = pairs.select("a", "b") if tried is None else tried.unionByName(pairs.select("a", "b"))
        again = values.select("id", "fp", "sketch").join(named, "id").join(roots.withColumnRenamed("node", "id"), "id", "left")
        left, fan = saved(again.select("id", "fp", "sketch", F.coalesce("root", "id").alias("root")), "left"), fan * FAN_GROWTH


def _verified_roots(proposed: DataFrame, sets: DataFrame, similarity: float, roots: DataFrame | None) -> DataFrame:
    """components() of the candidates that hold and of `roots`, found in two steps the first time (with no `roots` yet): first each value's
    nearest candidate, then the others between values that those don't connect. A link inside a component adds nothing, and in a dense group that is nearly every one."""
    ends = lambda links, roots: links if roots is None else links.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
    split = roots is None
    both = proposed.unionByName(proposed.select(F.col("b").alias("a"), F.col("a").alias("b"), "bits"))
    first = proposed.select("a", "b") if not split else both.groupBy("a").agg(F.min(F.struct("bits", "b")).alias("of")).select(F.greatest("a", "of.b").alias("a"), F.least("a", "of.b").alias("b")).distinct()
    first = saved(first, "nearest")
    roots = saved(components(ends(similar_links(first, sets, similarity), roots)), "roots")
    if not split:
        return roots
    of = lambda side: roots.select(F.col("node").alias(f"node_{side}"), F.col("root").alias(f"root_{side}"))
    rest = proposed.select("a", "b").join(first, ["a", "b"], "left_anti")
    rest = rest.join(of("a"), F.col("a") == F.col("node_a"), "left").join(of("b"), F.col("b") == F.col("node_b"), "left")
    rest = saved(rest.select("a", "b", F.coalesce("root_a", "a").alias("root_a"), F.coalesce("root_b", "b").alias("root_b")).where("root_a <> root_b"), "rest")
    links = similar_links(rest, sets, similarity).select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))
    return saved(components(ends(links, roots)), "roots")


def _named(prints: DataFrame, values: DataFrame, copies: list[str], roots: DataFrame) -> DataFrame:
    """doc_id, key, fp, component_id of each row of prints; roots: node, root of the values that don't stand alone."""
    of = values.join(roots, values.id == roots.node, "left").select(*copies, "least", F.coalesce("root", "id").alias("root"))
    of = saved(of, "rooted")
    # Saved, so that the join has two plain sides and a large component can be split.
    least = saved(of.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    named = of.join(least, "root").select(*copies, "component_id")
    return prints.join(named, copies).select("doc_id", "key", "fp", "component_id")


def near_duplicates(docs: DataFrame, **kw) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id: the least doc_id reachable over links, the row's own included.

    Parameters: ngram, bits, width, budget, similarity, as in _grouped.
    Texts are taken whole with A-Z in lower case; shingles are `ngram` words with repeats, a shorter text is one
    shingle, and a text without words has fingerprint zero and links like any other. With `similarity` (of shingle sets, Jaccard)
    the fingerprints only propose: a pair within the budget in one word is a candidate if whole fingerprints
    differ in no more bits than texts of that similarity do, plus 3 standard deviations, so that few true links get lost, and it
    links if the similarity of its shingle sets, without repeats, is that high. Equal sets with equal fingerprints are copies. Every candidate
    is verified unless verified links connect it already. The defaults propose for certain what
    differs in (budget + 1) * words - 1 = 39 of 256 bits, where similarity 0.8 is expected. Without `similarity` the first word alone decides.

    A null text is an empty one. Null doc_ids take part like others but never are a component's least id (null where
    nothing else is there). Repeated rows give repeated results. An empty table gives an empty result. Other columns are ignored.
    Very long texts are read whole, one at a time.
    """
    hexed = F.array_join(F.transform("fp", lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")
    return _grouped(docs, **kw).select("doc_id", hexed.alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, **kw) -> DataFrame:
    """The rows of `docs` that are of their group's least doc_id; all columns stay. Rows with a null doc_id stay.

    Rows of one doc_id with different texts are judged each on its own; rows that are equal in both stay or go together.
    """
    gone = _grouped(docs, **kw).where("doc_id <> component_id").select(F.col("doc_id").alias("gone"), F.col("key").alias("gone_key")).distinct()
    return docs.join(gone, (docs.doc_id == gone.gone) & (_text_key() == gone.gone_key), "left_anti")
