"""Packing of token sequences: shortest-pack-first over the histogram of lengths.

A document of n tokens is cut into pieces of `size` and a rest. The histogram of the pieces' lengths has at most
`size` rows however many documents there are, so the plan is made on the driver from counts alone: lengths are placed longest
first, each into the pack that is shortest so far if it still fits there, else into a new one; equal packs are one
pattern with a count. Every pattern's slot takes a range of ranks of its length. Pieces get their rank within their length
in Spark, from counts per (length, bucket) and a row number inside the bucket, so that a length that a third of
all pieces have is still dealt over many tasks, and a join by length and rank gives each its sequence and offset.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lintel.llm.common import long_id, row_key, saved, steps, text_bytes

#: Words a generation of a task's memory holds, bytes of text that share a look-up, and pieces of one length that share a bucket.
WORDS_KEPT, LOOKUP_BYTES, BUCKET_ROWS = 400_000, 4 << 20, 20_000


#: Letters that have one lower-case form everywhere, and signs after them that no contraction begins with.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?%*#$&|]*)")


class WordIds:
    """Token ids of texts through their distinct white-space words; for tokenizers that never join words.

    They must also ignore case and split words from punctuation: a word of plain letters with punctuation after it is looked up
    as two. Ids are remembered in two generations: once the younger is full it becomes the older, and words still in use move
    to the younger again, so that frequent words stay known however many rare ones pass.
    """

    def __init__(self, load: Callable):
        self.encode, self.letters, self.mark = load()
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _learn(self, words: list[str]) -> None:
        """Ids of new words: plain ones by the model alone, others many at once with the mark's token between them, or one by one."""
        sign, token = self.mark
        alone, odd = [], []
        for w in words:
            if w in self.old:
                self.young[w] = self.old[w]
            elif w and w.isalpha() and PLAIN.fullmatch(w) and w == w.lower():
                self.young[w] = self.letters(w)
            else:
                (alone if sign in w else odd).append(w)
        for i in range(0, len(odd), 5000):
            part = odd[i : i + 5000]
            ids = np.array(self.encode(f" {sign} ".join(part)), dtype="<u4")
            at = np.flatnonzero(ids == token)
            if len(at) != len(part) - 1:
                alone += part
                continue
            bounds = [-1, *at.tolist(), len(ids)]
            self.young.update((w, ids[a + 1 : b].tobytes()) for w, a, b in zip(part, bounds, bounds[1:], strict=False))
        self.young.update((w, np.array(self.encode(w), dtype="<u4").tobytes()) for w in alone)

    def __call__(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's begin."""
        from lintel.llm.toxicity import distinct_words

        if len(self.young) > WORDS_KEPT:
            self.young, self.old = {}, self.young
        words, index, bounds = distinct_words(texts)
        parts = [(m[1].lower(), m[2]) if (m := PLAIN.fullmatch(w)) else (w, "") for w in words]
        known = self.young
        self._learn([x for x in dict.fromkeys(x for p in parts for x in p) if x not in known])
        found = [known[a] + known[b] if b else known[a] for a, b in parts]
        n = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
        pool, starts = np.frombuffer(b"".join(found), dtype="<u4"), np.append(0, np.cumsum(n))
        n = n[index]
        ends = np.append(0, np.cumsum(n))
        return pool[np.repeat(starts[index] - ends[:-1], n) + np.arange(int(ends[-1]))], ends[bounds]


#: By loader, for all tasks of a Python worker.
_LOADED: dict[object, WordIds] = {}


def _byte_letters() -> dict[int, str]:
    """The printable stand-ins that byte-level vocabularies use: a byte's own character, or for blanks and controls the next free ones from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


def word_bpe(path: str, sign: str = "|") -> Callable:
    """Loader of a tokenizer file: ids of a text without special tokens, ids (as bytes) of a lower-case word of plain letters, and a sign that is one token wherever it stands alone."""

    def load():
        from tokenizers import Tokenizer

        tokenizer, shown = Tokenizer.from_file(path), _byte_letters()
        encode = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
        merge = tokenizer.model.tokenize
        # What stands before the model has nothing to do on such a word but to spell its bytes.
        letters = lambda w: np.array([t.id for t in merge(w if w.isascii() else w.encode().decode("latin-1").translate(shown))], dtype="<u4").tobytes()
        return encode, letters, (sign, encode(sign)[0])

    load.key = path, sign
    return load


def _piece_batches(load: Callable, size: int, end_id: int, with_ids: bool):
    def task(batches):
        import pyarrow as pa

        if load.key not in _LOADED:
            _LOADED[load.key] = WordIds(load)
        encode = _LOADED[load.key]
        for batch in batches:
            for i, j in steps(text_bytes(batch.column("text"))[1], LOOKUP_BYTES):
                part = batch.slice(i, j - i)
                ids, at = encode(part.column("text"))
                rows, start, length, crc, total, own = [], [], [], [], [], []
                for k in range(part.num_rows):
                    mine = np.append(ids[at[k] : at[k + 1]], np.uint32(end_id)).astype("<u4")
                    for s in range(0, len(mine), size):
                        piece = mine[s : s + size]
                        rows.append(k)
                        start.append(s)
                        length.append(len(piece))
                        crc.append(zlib.crc32(piece.tobytes()))
                        total.append(len(mine))
                        if with_ids:
                            own.append(piece.astype(np.int32))
                take = pa.array(rows, pa.int32())
                columns = [part.column("doc_id").take(take), part.column("key").take(take), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
                names = ["doc_id", "key", "start", "length", "ids_crc32", "doc_tokens"]
                if with_ids:
                    columns.append(pa.array(own, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return task


def plan(histogram: dict[int, int], size: int) -> list[tuple[int, int, int, int, int]]:
    """Slots (length, first rank, ranks, first sequence, offset) of a shortest-pack-first packing."""
    open_: dict[int, list[tuple[int, list[int]]]] = {}  # by the tokens in a pack: count, lengths
    closed: list[tuple[int, list[int]]] = []

    def put(count, lengths):
        total = sum(lengths)
        (closed if total == size else open_.setdefault(total, [])).append((count, lengths))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        fits = sorted(x for x in open_ if x + length <= size)
        taken = []
        for total in fits:  # shortest pack first
            while left and open_[total]:
                count, lengths = open_[total].pop()
                n = min(count, left)
                left -= n
                taken.append((n, [*lengths, length]))
                if count > n:
                    open_[total].append((count - n, lengths))
            if not open_[total]:
                del open_[total]
            if not left:
                break
        for pattern in taken:
            put(*pattern)
        # A new pack takes as many of this length as fit.
        each = size // length
        if left // each:
            put(left // each, [length] * each)
        if left % each:
            put(1, [length] * (left % each))
    used: dict[int, int] = {}
    slots, sequence = [], 0
    for count, lengths in [*closed, *(p for packs in open_.values() for p in packs)]:
        offset = 0
        for length in lengths:
            slots.append((length, used.get(length, 0), count, sequence, offset))
            used[length] = used.get(length, 0) + count
            offset += length
        sequence += count
    return slots


def pack(docs: DataFrame, load: Callable, size: int = 2048, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids if asked for.

    A null text is an empty one and holds just the end id. Null and repeated doc_ids are packed like any others. An empty
    table gives no pieces. Other columns are ignored. Sequences are numbered from 0 and filled without gaps from 0.
    """
    spark = docs.sparkSession
    schema = "doc_id long, key long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    pieces = saved(docs.select(long_id(docs), "text", row_key().alias("key")).mapInArrow(_piece_batches(load, size, end_id, with_ids), schema), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `size` rows
    slots = spark.createDataFrame(plan(histogram, size), "length long, first long, n long, sequence long, offset long")
    buckets = max(histogram.values(), default=0) // BUCKET_ROWS + 1
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "key", "start"), F.lit(buckets)))
    counts = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = counts.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    local = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "key", "start"))
    ranked = dealt.withColumn("local", local - 1).join(before, ["length", "bucket"]).withColumn("rank", F.col("local") + F.col("before")).drop("bucket", "local", "before")
    # The plan has a bounded number of slots, whatever the input.
    slots = F.broadcast(slots.withColumnRenamed("length", "slot_length"))
    found = ranked.join(slots, (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("n")))
    sequence = (F.col("sequence") + F.col("rank") - F.col("first")).alias("sequence_id")
    return found.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", sequence, "offset", *["ids"] * with_ids)
