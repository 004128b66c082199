"""Tables with one row per key that batches are merged into, safe to repeat.

Rows are dealt into buckets by key. A batch writes the buckets that it changes anew (data/batch=N/bucket=B) and then, as its last step, a list of those
buckets (versions/batch=N): until that stands, readers see the table without the batch. The current version of a bucket is the greatest batch that lists it.
A batch that runs again reads only what batches before it wrote and replaces its own folders, with the same result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of a table; it can't change once the table has rows.
BUCKETS = 64


def _versions(spark: SparkSession, out: str, before: int | None) -> dict[int, int]:
    """bucket -> batch, a row per bucket."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/versions")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return {}
    rows = spark.read.schema("bucket int, batch long").parquet(f"{out}/versions")
    rows = rows if before is None else rows.where(F.col("batch") < before)
    return {r["bucket"]: r["batch"] for r in rows.groupBy("bucket").agg(F.max("batch").alias("batch")).collect()}


def _rows(spark: SparkSession, out: str, versions: dict[int, int], schema) -> DataFrame | None:
    """The rows of these versions of buckets, whose folders alone are listed."""
    if not versions:
        return None
    return spark.read.schema(schema).option("basePath", f"{out}/data").parquet(*[f"{out}/data/batch={n}/bucket={b}" for b, n in sorted(versions.items())]).drop("bucket", "batch")


def upsert(rows: DataFrame, out: str, number: int, key: str, order: list[str], buckets: int = BUCKETS) -> None:
    """Merge rows into the table as batch `number`. Of the rows of a key the last by `order` stays (nulls first), then that of the later batch, then the greatest. Null keys are left out."""
    spark = rows.sparkSession
    names = rows.columns
    new = rows.where(F.col(key).isNotNull()).withColumn("bucket", F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int"))
    new = new.withColumn("batch_", F.lit(number).cast("long"))
    changed = sorted(r["bucket"] for r in new.select("bucket").distinct().collect())  # `buckets` at most
    if not changed:
        return
    known = _versions(spark, out, number)
    old = _rows(spark, out, {b: known[b] for b in changed if b in known}, new.drop("bucket").schema)
    both = new if old is None else new.unionByName(old.withColumn("bucket", F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")))
    last = both.groupBy("bucket", key).agg(F.max(F.struct(*order, "batch_", F.struct(*[c for c in names if c != key]).alias("rest"))).alias("last"))
    merged = last.select(key, "last.rest.*", "last.batch_", "bucket").select(*names, "batch_", "bucket")
    merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{out}/data/batch={number}")
    spark.createDataFrame([(b,) for b in changed], "bucket int").coalesce(1).write.mode("overwrite").parquet(f"{out}/versions/batch={number}")


def read(spark: SparkSession, out: str, schema: str) -> DataFrame:
    """The table as of the last batch that has ended. schema: its columns, as DDL."""
    rows = _rows(spark, out, _versions(spark, out, None), schema)
    return spark.createDataFrame([], schema) if rows is None else rows
