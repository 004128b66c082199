"""What the operators of this subpackage share: table access, shared scratch space, word splitting."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a longest run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that one numpy step holds; a longer text makes a step of its own.
STEP_BYTES = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_FOLDERS: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A folder for this application under spark.checkpoint.dir, which driver and executors share.

    Only where that setting is missing and the master is local, as in tests on one machine, a temporary folder takes its place; on a cluster that is an error.
    """
    sc = spark.sparkContext
    if sc.applicationId not in _FOLDERS:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise RuntimeError("spark.checkpoint.dir is not set: executors of a cluster share no temporary folder")
            base = "file://" + tempfile.mkdtemp(prefix="lintel-")
            sc.setCheckpointDir(base)
        _FOLDERS[sc.applicationId] = f"{base.rstrip('/')}/lintel-{sc.applicationId}"
        atexit.register(drop_folder, spark, _FOLDERS[sc.applicationId])
    return _FOLDERS[sc.applicationId]


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder through Spark's own file system layer; a session that has ended is left alone."""
    if spark.sparkContext._jsc is None:
        return
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except (OSError, ConnectionError):  # the gateway went first
        pass


def saved(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: computed once, and safe from lost executors. by: a column with a folder for each value."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path, partitionBy=by)
    return spark.read.schema(df.schema).parquet(path)


def long_id(docs: DataFrame) -> "F.Column":
    """doc_id as a long; a column that is one already stays as it is, so that equal scans remain equal plans."""
    return F.col("doc_id") if dict(docs.dtypes)["doc_id"] == "bigint" else F.col("doc_id").cast("long").alias("doc_id")


def row_key() -> "F.Column":
    """Tells rows of one doc_id with different texts apart; equal rows share it, and so their results."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def fold(id_: "F.Column", folds: int = 5) -> "F.Column":
    """crc32 of the id as text, modulo `folds`; fold 0 is held out from all training."""
    return F.pmod(F.crc32(id_.cast("string")), F.lit(folds))


#: Bytes of training texts of one class that come to the driver.
TRAINING_BYTES = 32 << 20


def training_rows(docs: DataFrame, labels: DataFrame, label: str, per_class: int, class_bytes: int = TRAINING_BYTES):
    """Texts (an Arrow column), 0/1 labels and weights of a bounded sample of labelled rows outside fold 0.

    Of each class the `per_class` ids with the least hash, as many of them in that order as hold `class_bytes` bytes of text. Texts longer than a sixteenth
    of those bytes come after all others, the shortest first, and a class's first text is taken whatever its length, so that no class with a text is
    empty. A class's weights add up to its number of labelled rows. Null labels and ids are left out; an id with several labels counts once, with the greatest;
    of several texts of one id the one with the least hash counts.
    """
    import pyarrow as pa

    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).where(fold(F.col("doc_id")) != 0)
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    picks = [known.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in (0, 1)]
    ids = F.broadcast(picks[0].unionByName(picks[1]))  # at most 2 * per_class rows
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(long_id(docs), text.alias("text")).join(ids, "doc_id").withColumn("key", F.xxhash64("text"))
    rows = saved(rows, "labelled")
    # One row per id, without texts: 2 * per_class at most.
    texts = rows.groupBy("doc_id", "label").agg(F.min(F.struct("key", F.octet_length("text").alias("n"))).alias("of")).select("doc_id", "label", "of.*")
    long = F.when(F.col("n") > class_bytes // 16, F.col("n")).otherwise(0)
    order = Window.partitionBy("label").orderBy(long, F.xxhash64("doc_id"), "doc_id")
    texts = texts.select("doc_id", "key", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("so_far"), F.row_number().over(order).alias("place"))
    texts = texts.where((F.col("so_far") <= class_bytes) | (F.col("place") == 1)).select("doc_id", "key")
    found = rows.join(F.broadcast(texts), ["doc_id", "key"]).dropDuplicates(["doc_id", "key"]).select("doc_id", "text", "label").toArrow().sort_by("doc_id")
    values = np.asarray(found.column("label"), dtype=np.int64)
    counts = np.bincount(values, minlength=2)
    weights = np.array([sizes.get(c, 0) / max(1, counts[c]) for c in (0, 1)])[values] if len(values) else np.zeros(0)
    texts = found.column("text").cast(pa.large_string()).combine_chunks()
    return texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts, values, weights


class Words:
    """The words of many texts as positions in one byte array."""

    __slots__ = ("data", "start", "end", "first")

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        """bounds: where each text starts in data, and where the last ends."""
        blank = _SPACE[data]
        before = np.empty(len(data), dtype=bool)
        before[1:] = blank[:-1]
        before[bounds[:-1][bounds[:-1] < len(data)]] = True
        self.data = data
        self.start = np.flatnonzero(~blank & before)
        after = np.empty(len(data), dtype=bool)
        after[:-1] = blank[1:]
        inner = bounds[1:]
        after[inner[inner > 0] - 1] = True
        self.end = np.flatnonzero(~blank & after) + 1
        #: first[i] is the number of the first word of text i; first[-1] is the number of words.
        self.first = np.searchsorted(self.start, bounds)


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string column without copies, and where each text starts; null is empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    if not len(offsets):
        return data[:0], np.zeros(1, dtype=np.int64)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def steps(bounds: np.ndarray, limit: int = STEP_BYTES):
    """Ranges of texts of about `limit` bytes together."""
    i, n = 0, len(bounds) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_names(words: Words, salt: int = 0) -> np.ndarray:
    """A 64-bit name for each word: its bytes, eight at a time, mixed into a state one after the other; those of long words by XXH64."""
    import xxhash

    size, short = words.end - words.start, 64
    padded = np.append(words.data, np.zeros(8, dtype=np.uint8))
    eights = np.ndarray(len(words.data) + 1, dtype="<u8", buffer=padded, strides=(1,))
    masks = np.append((np.uint64(1) << (np.uint64(8) * np.arange(8, dtype=np.uint64))) - np.uint64(1), np.uint64(2**64 - 1))
    names = mix(size.astype(np.uint64) + np.uint64(1 + 0x9E3779B97F4A7C15 * salt & (2**64 - 1)))
    live, done = np.flatnonzero(size <= short), 0
    while len(live):
        left = size[live] - done
        names[live] = mix((names[live] ^ (eights[words.start[live] + done] & masks[np.minimum(left, 8)])) + np.uint64(0xD6E8FEB86659FD93))
        live, done = live[left > 8], done + 8
    for i in np.flatnonzero(size > short).tolist():
        names[i] = xxhash.xxh64_intdigest(padded[words.start[i] : words.end[i]].data, salt)
    return names


class Rolling:
    """Hashes of any stretch of a sequence by one polynomial modulo 2^64 over spread values."""

    BASE = 0x9E3779B97F4A7C15 | 1

    def __init__(self, salt: int = 0):
        self.base = (self.BASE + 2 * salt * 0x632BE59BD9B4E019) & (2**64 - 1) | 1
        self.inverse = pow(self.base, -1, 2**64)
        self.letters = mix(np.arange(256, dtype=np.uint64) + np.uint64(1 + 977 * salt))
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) <= n:
            size = 1 << int(n + 1).bit_length()
            for name, base in (("up", self.base), ("down", self.inverse)):
                powers = np.full(size, base, dtype=np.uint64)
                powers[0] = 1
                setattr(self, name, np.cumprod(powers, dtype=np.uint64))

    def sums(self, values: np.ndarray) -> np.ndarray:
        self._powers(len(values))
        out = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * self.up[: len(values)], out=out[1:], dtype=np.uint64)
        return out

    def stretches(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((sums[end] - sums[start]) * self.down[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def words(self, words: Words) -> np.ndarray:
        return self.stretches(self.sums(self.letters[words.data]), words.start, words.end)
