"""Best-fit packing of whole documents: hierarchical residual packing.

Only documents of more than `size` tokens are cut; their full pieces are sequences of their own. All other pieces are
bins with one item. In each round the bins are dealt into groups of a bounded number, and every group packs its bins into larger
ones by best fit, the fullest first: into the open bin with the least room that suffices, else into a new one. Bins that
are nearly full leave; the others, as items of the next round, meet in fewer groups, a tree whose root is one group. Where large items are
left that nothing fits beside, the groups stay many, and a round that merges next to nothing is the last.

Rounds hold two numbers per bin. Where a bin went and at which offset is written as one table a round; these are composed from the last
to the first, and one join by item numbers gives each piece its sequence and place.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel.llm.common import long_id, row_key, saved
from lintel.llm.packing import _piece_batches

#: Bins of a group, on average, or as many more as hold the tokens of FILLED sequences; free tokens that a bin may leave with; the share of bins that a round must merge for another one to follow.
GROUP, FILLED, SLACK, WORTH = 8192, 256, 8, 0.01


def _items(load: Callable, size: int, end_id: int, with_ids: bool):
    pieces = _piece_batches(load, size, end_id, with_ids)

    def task(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 40  # no two pieces of a run share an item number
        for batch in pieces(batches):
            n, of = batch.num_rows, batch.column
            start = np.asarray(of("start"))
            columns = [pa.array(np.arange(number, number + n)), of("doc_id"), pa.array((start // size).astype(np.int32)), of("start"), of("length"), of("ids_crc32"), *([of("ids")] if with_ids else [])]
            number += n
            yield pa.RecordBatch.from_arrays(columns, ["item", "doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids])

    return task


def best_fit(fills, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each item, in the given order: the item that its bin began with, its offset there, and how full that bin is in the end."""
    into, at = np.empty(len(fills), dtype=np.int64), np.empty(len(fills), dtype=np.int64)
    full = np.zeros(len(fills), dtype=np.int64)
    open_: dict[int, list[int]] = {}
    rooms: list[int] = []  # ascending: every room that an open bin has
    for i, x in enumerate(fills):
        k = bisect_left(rooms, x)
        if k < len(rooms):
            room = rooms[k]
            bin_ = open_[room].pop()
            if not open_[room]:
                del rooms[k]
        else:
            room, bin_ = size, i
        into[i], at[i], full[bin_] = bin_, size - room, size - room + x
        if left := room - x:
            own = open_.setdefault(left, [])
            if not own:
                insort(rooms, left)
            own.append(bin_)
    return into, at, full[into]


def _group_task(size: int):
    def task(table):
        import pyarrow as pa

        bins, fills = (table.column(c).to_numpy() for c in ("bin", "fill"))
        order = np.lexsort((bins, -fills))
        bins = bins[order]
        into, at, full = best_fit(fills[order].tolist(), size)
        return pa.table({"bin": bins, "into": bins[into], "at": at, "fill": full})

    return task


def place(items: DataFrame, size: int, group: int = GROUP, filled: int = FILLED, slack: int = SLACK) -> DataFrame:
    """bin, into, at: the sequence of each item and its offset there. items: bin (distinct longs) and fill (1 to size)."""
    bins, moves = items, []
    numbers = lambda: bins.agg(F.count("*"), F.coalesce(F.sum("fill"), F.lit(0))).first()
    n, tokens = numbers()
    while n:
        groups = max(1, min(-(-n // group), tokens // (size * filled)))
        dealt = bins.withColumn("group", F.pmod(F.xxhash64("bin", F.lit(len(moves))), F.lit(groups)))
        moves.append(saved(dealt.groupBy("group").applyInArrow(_group_task(size), "bin long, into long, at long, fill long"), "moves"))
        before = n
        bins = moves[-1].where((F.col("at") == 0) & (F.col("fill") < size - slack)).select(F.col("into").alias("bin"), "fill")
        n, tokens = numbers()
        if groups == 1 or n > before * (1 - WORTH):
            break
    if not moves:
        return items.select("bin", F.col("bin").alias("into"), F.lit(0).cast("long").alias("at"))
    found = moves[-1].select("bin", "into", "at")
    for step in moves[-2::-1]:
        above = found.select(F.col("bin").alias("into"), F.col("into").alias("root"), F.col("at").alias("on"))
        found = step.select("bin", "into", "at").join(above, "into", "left").select("bin", F.coalesce("root", "into").alias("into"), (F.col("at") + F.coalesce("on", F.lit(0))).alias("at"))
    return found


def pack(docs: DataFrame, load: Callable, size: int = 4096, end_id: int = 1, with_ids: bool = False, group: int = GROUP, filled: int = FILLED) -> DataFrame:
    """One row per piece: doc_id, piece (from 0), start, length, ids_crc32, sequence_id, offset, and ids if asked for.

    A null text is an empty one and holds just the end id. Null and repeated doc_ids are packed like any others. A text of any length
    is read whole and cut into pieces of `size`. An empty table gives no pieces. Other columns are ignored. Sequences have any numbers and are filled without gaps from 0.
    """
    schema = "item long, doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    pieces = saved(docs.select(long_id(docs), "text", row_key().alias("key")).mapInArrow(_items(load, size, end_id, with_ids), schema), "pieces")
    found = place(pieces.where(F.col("length") < size).select(F.col("item").alias("bin"), F.col("length").alias("fill")), size, group, filled)
    out = pieces.join(found.withColumnRenamed("bin", "item"), "item", "left")
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("into", "item").alias("sequence_id"), F.coalesce("at", F.lit(0)).cast("long").alias("offset"), *["ids"] * with_ids)
