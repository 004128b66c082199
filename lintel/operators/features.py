"""Machine-learning tables: wide rows, typed features, encodings, profiles, vectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lintel.operators.ranks import dense_index


def wide_dataset(elements: DataFrame, found: DataFrame, columns: list[str]) -> DataFrame:
    """One row per element: fixed columns, then one per standard property name in `columns`; of several values the last."""
    values = found.where(F.col("standard_name").isin(*columns)).groupBy("global_id").pivot("standard_name", sorted(columns)).agg(F.max_by("value", "ord"))
    return elements.select("global_id", "ifc_class", "name", "container", "material").join(values, "global_id", "left")


def feature_table(rows: DataFrame, features: list[tuple[str, str, object, object]]) -> DataFrame:
    """Declared features (name, kind, column, default) as typed columns beside global_id."""
    from lintel.functions.values import coerce

    return rows.select("global_id", *[coerce(column, kind, F.lit(default)).alias(name) for name, kind, column, default in features])


# Declared sets of features as (name, kind, source); a source with '*' is any property set of such a name.
FEATURE_SETS = {
    "element_basic": [
        ("ifc_class", "categorical", "ifc_class"), ("name", "text", "name"), ("is_external", "boolean", "Pset_*Common.IsExternal"), ("load_bearing", "boolean", "Pset_*Common.LoadBearing"), ("fire_rating", "categorical", "Pset_*Common.FireRating"),
    ],
    "element_geometry": [
        ("ifc_class", "categorical", "ifc_class"), ("width", "numeric", "Qto_*.Width"), ("height", "numeric", "Qto_*.Height"), ("length", "numeric", "Qto_*.Length"), ("area", "numeric", "Qto_*.Area"), ("volume", "numeric", "Qto_*.Volume"),
        ("center_x", "numeric", "x"), ("center_y", "numeric", "y"), ("center_z", "numeric", "z"),
    ],
    "validation_results": [
        ("ifc_class", "categorical", "ifc_class"), ("validation_status", "categorical", "status"), ("pass_count", "numeric", "n_pass"), ("fail_count", "numeric", "n_fail"), ("warning_count", "numeric", "n_warning"), ("completeness_score", "numeric", "pass_rate"),
    ],
}


def feature_set(elements: DataFrame, properties: DataFrame, declared: list[tuple[str, str, str]]) -> DataFrame:
    """global_id and the declared features, numbers as doubles, truth as 0 or 1 (null where nothing is said), all else as text.

    A source is a column of `elements` or, with a dot, a property: set and name, of several values the last by `ord`. All properties are taken in one pass.
    """
    from lintel.functions.values import coerce

    asked = [(name, *source.split(".", 1)) for name, _, source in declared if "." in source]
    rows = elements
    if asked:
        like = lambda pset: F.col("pset").like(pset.replace("_", "\\_").replace("*", "%"))
        taken = [F.max_by(F.when(like(pset) & (F.col("prop") == prop), F.col("value")), F.when(like(pset) & (F.col("prop") == prop), F.col("ord"))).alias(f"p_{name}") for name, pset, prop in asked]
        rows = elements.join(properties.where(F.col("prop").isin(*{prop for *_, prop in asked})).groupBy("global_id").agg(*taken), "global_id", "left")
    value = lambda name, source: F.col(f"p_{name}" if "." in source else source).cast("string")
    made = [value(name, source) if kind in ("text", "categorical") else coerce(value(name, source), kind, F.lit(None).cast("double")) for name, kind, source in declared]
    return rows.select("global_id", *[c.alias(name) for c, (name, *_) in zip(made, declared, strict=True)])


def label_encode(rows: DataFrame, column: str, order: str) -> DataFrame:
    """category and code, by first appearance (`order` is unique)."""
    first = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("category")).agg(F.min(order).alias("first"))
    return dense_index(first, [F.col("first")], "code").select("category", "code")


def one_hot(rows: DataFrame, column: str, categories: list[str]) -> DataFrame:
    return rows.select("global_id", *[F.when(F.col(column) == c, 1).otherwise(0).alias(f"{column}_{c}") for c in categories])


def normalize_column(rows: DataFrame, column: str, method: str) -> DataFrame:
    """minmax (0 where all are equal), center (minus the mean), zscore, or log (0 from 0 down), as column `normalized`."""
    c = F.col(column)
    if method == "log":
        return rows.withColumn("normalized", F.when(c > 0, F.log(c)).otherwise(0.0))
    stats = rows.agg(F.min(c).alias("lo"), F.max(c).alias("hi"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("sd"))
    rows = rows.join(F.broadcast(stats))  # one row
    made = {"minmax": F.when(F.col("hi") == F.col("lo"), 0.0).otherwise((c - F.col("lo")) / (F.col("hi") - F.col("lo"))), "center": c - F.col("mean"), "zscore": F.when(F.col("sd") == 0, 0.0).otherwise((c - F.col("mean")) / F.col("sd"))}[method]
    return rows.withColumn("normalized", made).drop("lo", "hi", "mean", "sd")


def column_profile(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column: rows, nulls, share of nulls, distinct values, least, greatest and mean number. One pass over the rows."""
    wide = rows.select(*[F.col(c).cast("string").alias(c) for c in columns])
    long = wide.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("v")) for c in columns])))
    number = F.col("v").try_cast("double")
    return long.groupBy("column_name").agg(F.count("*").alias("n_rows"), F.count_if(F.col("v").isNull()).alias("n_nulls"), (F.count_if(F.col("v").isNull()) / F.count("*")).alias("null_rate"), F.count_distinct("v").alias("n_distinct"), F.min(number).alias("least"), F.max(number).alias("most"), F.avg(number).alias("mean"))


def value_profile(rows: DataFrame, columns: list[str], most_values: int = 20) -> DataFrame:
    """One row per column: least and greatest text, its values (an ordered array) where there are at most `most_values`, and from sketches of bounded size the
    number of distinct values (HyperLogLog, relative standard deviation 2 %) and the quartiles of its numbers (rank error 1 in 1,000).

    Sketches of parts merge, so tasks hand on sketches instead of values; the exact list is of columns that the sketch finds few values in, in a second pass over those alone.
    """
    long = rows.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("v")) for c in columns])))
    number = F.col("v").try_cast("double")
    out = long.groupBy("column_name").agg(F.min("v").alias("least_text"), F.max("v").alias("most_text"), F.approx_count_distinct("v", 0.02).alias("distinct_about"), F.percentile_approx(number, [0.25, 0.5, 0.75], 1000).alias("quartiles"))
    few = [r["column_name"] for r in out.where(F.col("distinct_about") <= 1.2 * most_values + 5).select("column_name").collect()]  # a row per column
    listed = long.where(F.col("column_name").isin(few) & F.col("v").isNotNull()).distinct().groupBy("column_name").agg(F.array_sort(F.collect_list("v")).alias("values")).where(F.size("values") <= most_values)
    return out.join(listed, "column_name", "left")


def gnn_features(elements: DataFrame, classes: list[str]) -> DataFrame:
    """global_id and features: one-hot class over a sorted vocabulary, then x, y, z; joined by commas."""
    hot = [F.when(F.col("ifc_class") == c, 1.0).otherwise(0.0) for c in sorted(classes)]
    return elements.select("global_id", F.array(*hot, *[F.coalesce(F.col(c), F.lit(0.0)) for c in ("x", "y", "z")]).alias("features"))


def element_chunks(elements: DataFrame, properties: DataFrame) -> DataFrame:
    """id, global_id, text: an element with its property sets, their given values in order, and its materials, as one text to embed. elements: global_id, ifc_class, name, materials (array)."""
    line = F.when(F.col("value").isNotNull(), F.concat(F.lit("\n  - "), F.col("prop"), F.lit(": "), F.col("value")))
    sets = properties.groupBy("global_id", "pset").agg(F.array_sort(F.collect_list(F.struct("ord", line.alias("t")))).alias("lines"))
    sets = sets.select("global_id", "pset", F.concat(F.lit("\n"), F.col("pset"), F.lit(":"), F.array_join(F.transform("lines", lambda x: x["t"]), "")).alias("t"))
    sets = sets.groupBy("global_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pset", "t"))), lambda x: x["t"]), "\n").alias("sets"))
    made = F.when(F.size("materials") > 0, F.concat(F.lit("\nMaterials:"), F.array_join(F.transform("materials", lambda m: F.concat(F.lit("\n  - "), m)), "")))
    name = F.when(F.col("name") != "", F.concat(F.lit("Name: "), F.col("name")))
    text = F.concat_ws("\n", F.concat(F.lit("IFC Element: "), F.col("ifc_class")), name, F.concat(F.lit("GlobalId: "), F.col("global_id")), "sets", made)
    return elements.join(sets, "global_id", "left").select(F.substring(F.md5("global_id"), 1, 12).alias("id"), "global_id", text.alias("text"))


def hashing_encoder(dimensions: int = 64) -> Callable[[list[str]], list[list[float]]]:
    """A deterministic stand-in for a model: counts of hashed words, of unit length."""
    import zlib

    def encode(texts):
        out = []
        for text in texts:
            v = [0.0] * dimensions
            for w in (text or "").lower().split():
                h = zlib.crc32(w.encode())
                v[h % dimensions] += 1.0 if h >> 31 else -1.0
            n = sum(x * x for x in v) ** 0.5 or 1.0
            out.append([x / n for x in v])
        return out

    return encode


def embed_texts(rows: DataFrame, encoder_factory: Callable = hashing_encoder, batch_size: int = 100) -> DataFrame:
    """id and embedding of id, text. The encoder is made once per task; a batch that it fails on is left out and marked by `error`."""

    def task(frames):
        import pandas as pd

        encode = encoder_factory()
        for frame in frames:
            for i in range(0, len(frame), batch_size):
                part = frame.iloc[i : i + batch_size]
                try:
                    vectors, error = encode(part["text"].tolist()), None
                except Exception as e:  # the model's own errors go with the batch
                    vectors, error = [None] * len(part), str(e)
                yield pd.DataFrame({"id": part["id"], "embedding": vectors, "error": error})

    return rows.select("id", "text").mapInPandas(task, "id long, embedding array<double>, error string")


def pca(vectors: DataFrame, k: int = 2) -> DataFrame:
    """id and the first k principal components of v."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = vectors.select("id", array_to_vector("v").alias("raw"))
    centred = StandardScaler(inputCol="raw", outputCol="centred", withMean=True, withStd=False).fit(rows).transform(rows)
    return PCA(k=k, inputCol="centred", outputCol="pc").fit(centred).transform(centred).select("id", vector_to_array("pc").alias("pc"))
