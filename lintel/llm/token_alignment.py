"""Cross-tokenizer alignment: which tokens of two tokenizers stand for the same bytes of the documents.

Both token sequences of a text are laid over its bytes. Every place where one of them ends closes a segment, which lies in one
token of either side, so segments are the links; places where both end cut the tokens into groups.

Identity-map fast path: for each id of A the id of B with the same bytes is looked up once, ahead of all texts. A group of one token each
that this map names is counted in a vector as long as A's vocabulary, one vector a task. Only links of all other groups enter the shuffle of id
pairs, summed up per chunk of texts before. What both paths counted of a pair is added, and the highest count of each B id follows.

For the documents' own sums the vectors go back to the tasks (two numbers per id of A, whatever the corpus). Irregular pairs take another way: a chunk of
texts, bounded in bytes, asks for its distinct pairs once, however often its texts hold them, and meets its texts again in a co-group.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel.llm.common import long_id, saved, steps, text_bytes
from lintel.llm.packing import _byte_letters

#: Bytes of text whose pairs are looked up together; a longer text is a chunk of its own.
CHUNK_BYTES = 16 << 20
#: Bytes of text that one step aligns: a byte of text takes about 100 of numbers there.
STEP_BYTES = 1 << 17

_COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def byte_tokens(path: str) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary."""
    bytes_of = {c: b for b, c in _byte_letters().items()}
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    entries = made["model"]["vocab"] | {x["content"]: x["id"] for x in made["added_tokens"]}
    out = [b""] * (max(entries.values()) + 1)
    for entry, id_ in entries.items():
        out[id_] = bytes(bytes_of[c] for c in entry) if all(c in bytes_of for c in entry) else entry.encode()
    return out


def piece_tokens(model) -> list[bytes]:
    """The bytes of each id of a piece vocabulary: byte pieces stand for their byte, U+2581 for a blank."""
    return [bytes([int(p[3:-1], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(model.id_to_piece(list(range(model.get_piece_size()))))]


def byte_and_piece(byte_path: str, pattern: str, piece_path: str) -> Callable:
    """Loader of two tokenizers: for each a function from texts to lists of ids, and the bytes of its ids. The first one is given a blank before each text; the second one adds its own.

    A byte-level vocabulary whose ids ascend in the order of its merges is one of ranks, for which there is a faster reader with the same result.
    """

    def load():
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        own = byte_tokens(byte_path)
        with open(byte_path, encoding="utf-8") as f:
            made = json.load(f)
        vocabulary = made["model"]["vocab"]
        merged = [vocabulary["".join(x if isinstance(x, list) else x.split(" "))] for x in made["model"]["merges"]]
        if merged == sorted(merged):
            special = {x["id"] for x in made["added_tokens"]}
            ranks = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks={b: i for i, b in enumerate(own) if i not in special}, special_tokens={})
            encode = lambda texts: [ranks.encode_ordinary(" " + x) for x in texts]
        else:
            tokenizer = Tokenizer.from_file(byte_path)
            tokenizer.encode_special_tokens = True
            encode = lambda texts: [tokenizer.encode(" " + x, add_special_tokens=False).ids for x in texts]
        pieces = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        return (encode, own), (lambda texts: pieces.encode(texts, num_threads=1), piece_tokens(pieces))

    load.key = byte_path, pattern, piece_path
    return load


class Pair:
    """Two tokenizers, the map of equal bytes, and how ids are written."""

    def __init__(self, load: Callable):
        (self.encode_a, self.bytes_a), (self.encode_b, self.bytes_b) = load()
        self.size_a, self.size_b = len(self.bytes_a), len(self.bytes_b)
        self.length_a, self.length_b = (np.array([len(x) for x in own], dtype=np.int64) for own in (self.bytes_a, self.bytes_b))
        ids = {x: i for i, x in reversed(list(enumerate(self.bytes_b)))}
        #: A's id to B's id with the same bytes, the least; -1 where there is none.
        self.twin = np.array([ids.get(x, -1) for x in self.bytes_a], dtype=np.int64)
        self.written = [f"{i}{end}".encode() for size, ends in ((self.size_a, ",|"), (self.size_b, ",;")) for end in ends for i in range(size)]

    def align(self, texts: list[str]):
        """Alignment of texts that aren't empty: which ones have tokens, their counts and group digests, and their links: ids, owner, and whether the identity map names them."""
        blank, a_of, b_of = [(" " + x).encode() for x in texts], self.encode_a(texts), self.encode_b(texts)
        good = [i for i, x in enumerate(blank) if b"".join(map(self.bytes_a.__getitem__, a_of[i])) == x == b"".join(map(self.bytes_b.__getitem__, b_of[i]))]
        flat = lambda of: (np.fromiter(chain.from_iterable(of[i] for i in good), dtype=np.int64), np.append(0, np.cumsum([len(of[i]) for i in good], dtype=np.int64)))
        (a, a_bounds), (b, b_bounds) = flat(a_of), flat(b_of)
        end_a, end_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        ends = np.sort(np.concatenate([end_a, end_b]), kind="stable")  # two runs to merge
        ends = ends[np.append(True, ends[1:] != ends[:-1])[: len(ends)]]
        in_a, in_b = np.zeros(len(ends), dtype=bool), np.zeros(len(ends), dtype=bool)
        at_a, at_b = np.searchsorted(ends, end_a), np.searchsorted(ends, end_b)
        in_a[at_a] = in_b[at_b] = True
        both = in_a & in_b
        link_a, link_b = a[np.cumsum(in_a) - in_a], b[np.cumsum(in_b) - in_b]
        alone = both & np.append(True, both[:-1])[: len(both)]
        same = alone & (self.twin[link_a] == link_b)
        bounds = np.append(0, at_a[a_bounds[1:] - 1] + 1).astype(np.int64)  # of links, per text
        group = np.cumsum(both) - both
        closed = np.append(0, np.cumsum(both))[bounds]
        # A group's tokens of A stand before its tokens of B, and after those of all groups before.
        of_a, of_b, n = group[at_a], group[at_b], int(both.sum())
        before_b = np.append(0, np.cumsum(np.bincount(of_b, minlength=n)))
        upto_a = np.cumsum(np.bincount(of_a, minlength=n))
        order = np.empty(len(a) + len(b), dtype=np.int64)
        order[np.arange(len(a)) + before_b[of_a]] = a + self.size_a * both[at_a]
        order[np.arange(len(b)) + upto_a[of_b]] = b + 2 * self.size_a + self.size_b * both[at_b]
        cuts = a_bounds + b_bounds
        digests = [hashlib.sha256(b"".join(map(self.written.__getitem__, order[s:e].tolist()))[:-1]).hexdigest() for s, e in zip(cuts[:-1], cuts[1:], strict=True)]
        counts = np.stack([np.diff(a_bounds), np.diff(b_bounds), np.diff(closed), np.diff(bounds)], axis=1)
        owner = np.repeat(np.arange(len(good)), np.diff(bounds))
        return np.array(good, dtype=np.int64), counts, digests, link_a, link_b, owner, same


#: By loader, for all tasks of a Python worker.
_LOADED: dict[object, Pair] = {}


def _pair(load: Callable) -> Pair:
    if load.key not in _LOADED:
        _LOADED[load.key] = Pair(load)
    return _LOADED[load.key]


def _summed(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes, ascending, and the sums of their counts."""
    order = np.argsort(codes, kind="stable")
    codes, first = codes[order], None
    first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])[: len(codes)])
    return codes[first], np.add.reduceat(counts[order], first) if len(first) else counts[:0]


_ALIGNED = "part string, chunk long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, same array<int>, codes array<long>, totals array<long>"


def _align_batches(load: Callable, chunk_bytes: int):
    """Rows of part `text` (same: A ids of identity links; codes and totals: irregular pairs), of part `pairs` (a chunk's irregular pairs) and `vector` (a task's identity links)."""

    def task(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        pair = _pair(load)
        vector = np.zeros(pair.size_a, dtype=np.int64)
        number, held, codes, totals = TaskContext.get().partitionId() << 32, 0, [], []
        kinds = {"part": pa.string(), "chunk": pa.int64(), "doc_id": pa.int64(), **dict.fromkeys(_COUNTS, pa.int64()), "groups_sha256": pa.string(), "same": pa.list_(pa.int32()), "codes": pa.list_(pa.int64()), "totals": pa.list_(pa.int64())}

        def rows(n, **columns):
            return pa.RecordBatch.from_arrays([columns[c].cast(kind) if c in columns else pa.nulls(n, kind) for c, kind in kinds.items()], list(kinds))

        def lists(values, sizes):
            return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(values))

        def chunk():
            found, counts = _summed(*(np.concatenate([*x, np.zeros(0, dtype=np.int64)]) for x in (codes, totals)))
            return rows(1, part=pa.array(["pairs"]), chunk=pa.array([number]), codes=lists(found, [len(found)]), totals=lists(counts, [len(found)]))

        for batch in batches:
            bounds = text_bytes(batch.column("text"))[1]
            for i, j in steps(bounds, STEP_BYTES):
                size = int(bounds[j] - bounds[i])
                if held and held + size > chunk_bytes:
                    yield chunk()
                    number, held, codes, totals = number + 1, 0, [], []
                held += size
                texts = batch.column("text").slice(i, j - i).to_pylist()
                filled = [k for k, x in enumerate(texts) if x]
                good, counts, digests, a, b, owner, same = pair.align([texts[k] for k in filled])
                at = np.array(filled, dtype=np.int64)[good]
                vector += np.bincount(a[same], minlength=pair.size_a)
                width = pair.size_a * pair.size_b
                mine, n = _summed(owner[~same] * width + a[~same] * pair.size_b + b[~same], np.ones(int((~same).sum()), dtype=np.int64))
                whose, mine = np.divmod(mine, width)
                found, sums = _summed(mine, n)
                codes.append(found)
                totals.append(sums)
                # Every text has a row, those without tokens zeros and empty lists.
                per_text = lambda owners: np.bincount(at[owners], minlength=j - i)  # noqa: E731, B023
                numbers = np.zeros((j - i, 4), dtype=np.int64)
                numbers[at] = counts
                names = [""] * (j - i)
                for k, x in zip(at.tolist(), digests, strict=True):
                    names[k] = x
                size_same, size_mine = per_text(owner[same]), per_text(whose)
                yield rows(
                    j - i, part=pa.array(["text"] * (j - i)), chunk=pa.array([number] * (j - i)), doc_id=batch.column("doc_id").slice(i, j - i), groups_sha256=pa.array(names),
                    same=lists(a[same].astype(np.int32), size_same), codes=lists(mine, size_mine), totals=lists(n, size_mine), **{c: pa.array(numbers[:, k]) for k, c in enumerate(_COUNTS)},
                )
            pa.default_memory_pool().release_unused()  # a batch's rows; workers of other tasks share the executor's memory
        if held:
            yield chunk()
        known = np.flatnonzero(vector)
        yield rows(1, part=pa.array(["vector"]), codes=lists(known * pair.size_b + pair.twin[known], [len(known)]), totals=lists(vector[known], [len(known)]))

    return task


def _same_batches(vectors):
    """Adds the sums over a text's identity links (first_best, first_sum) and drops the links."""

    def task(batches):
        import pyarrow as pa

        n, best = vectors.value
        for batch in batches:
            same = batch.column("same")
            bounds = np.asarray(same.offsets, dtype=np.int64)
            ids = np.asarray(same.values)[bounds[0] : bounds[-1]]
            sums = [np.append(0, np.cumsum(v[ids])) for v in (best, n)]
            made = [pa.array(s[bounds[1:] - bounds[0]] - s[bounds[:-1] - bounds[0]]) for s in sums]
            kept = [c for c in batch.schema.names if c != "same"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *made], [*kept, "first_best", "first_sum"])
            pa.default_memory_pool().release_unused()

    return task


def _chunk_task(left, right):
    """Adds the sums over irregular links. left: a chunk's texts; right: its distinct pairs."""
    import pyarrow as pa

    left = left.combine_chunks()
    known, n, best = (right.column(c).to_numpy() for c in ("code", "n", "best"))
    order = np.argsort(known)
    known, n, best = known[order], n[order], best[order].astype(np.int64)
    lists = [left.column(c).combine_chunks() for c in ("codes", "totals")]
    bounds = np.asarray(lists[0].offsets, dtype=np.int64)
    codes, totals = (np.asarray(x.values)[bounds[0] : bounds[-1]] for x in lists)
    bounds -= bounds[0]
    at = np.searchsorted(known, codes)
    sums = [np.append(0, np.cumsum(totals * v[at]))[bounds] for v in (best, n)]
    made = {name: pa.array(left.column(f"first_{x}").to_numpy() + np.diff(s)) for name, x, s in zip(("n_best", "count_sum"), ("best", "sum"), sums, strict=True)}
    return pa.table({c: left.column(c) for c in ("doc_id", *_COUNTS)} | made | {"groups_sha256": left.column("groups_sha256")})


def align(docs: DataFrame, load: Callable, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per document: doc_id, n_a and n_b (tokens), n_groups, n_links, n_best, count_sum, groups_sha256.

    n_best counts the links whose pair of ids is linked as often in the corpus as its B id is with any A id; count_sum adds up
    how often each link's pair is linked in the corpus. A null or empty text, and one whose tokens of either side don't spell it, has
    no tokens: zeros and an empty digest. Null and repeated doc_ids are documents like any others. Texts are read whole, however
    long. An empty table gives an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    # Written once; the parts are read from it by their own filters.
    aligned = saved(docs.select(long_id(docs), "text").mapInArrow(_align_batches(load, chunk_bytes), _ALIGNED), "aligned", by="part")
    pair = _pair(load)
    linked = aligned.where("part <> 'text'").select(F.inline(F.arrays_zip("codes", "totals")))
    counts = saved(linked.groupBy(F.col("codes").alias("code")).agg(F.sum("totals").alias("n")), "counts")
    highest = counts.groupBy(F.pmod("code", F.lit(pair.size_b)).alias("b")).agg(F.max("n").alias("most"))
    # One row per id of B.
    rated = saved(counts.join(F.broadcast(highest), F.pmod("code", F.lit(pair.size_b)) == F.col("b")).select("code", "n", (F.col("n") == F.col("most")).alias("best")), "rated")
    twins = np.flatnonzero(pair.twin >= 0)
    asked = spark.createDataFrame([(int(a * pair.size_b + pair.twin[a]),) for a in twins], "code long")
    found = rated.join(F.broadcast(asked), "code").toArrow()  # one row per id of A at most
    vectors = np.zeros((2, pair.size_a), dtype=np.int64)
    ids = found.column("code").to_numpy() // pair.size_b
    vectors[0, ids], vectors[1, ids] = found.column("n").to_numpy(), found.column("best").to_numpy()
    texts = aligned.where("part = 'text'").select("chunk", "doc_id", *_COUNTS, "groups_sha256", "same", "codes", "totals")
    schema = "chunk long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, codes array<long>, totals array<long>, first_best long, first_sum long"
    texts = texts.mapInArrow(_same_batches(spark.sparkContext.broadcast(vectors)), schema)
    asked = aligned.where("part = 'pairs'").select("chunk", F.explode("codes").alias("code")).join(rated, "code")
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return texts.groupBy("chunk").cogroup(asked.groupBy("chunk")).applyInArrow(_chunk_task, schema)
