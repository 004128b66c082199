"""Building models as STEP text: records, references, and what they say of elements."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lintel.operators.ranks import dense_index
from lintel.sources.scratch import scratch

#: The text between two records' ends, quotes respected: a record ends at a ';' outside quotes.
RECORD = r"(?s)#(\d+)\s*=\s*(\w+)\s*\((.*)\)\s*$"
# Relation types, and at which places their related and relating ends stand.
RELATIONS = {
    "IFCRELCONTAINEDINSPATIALSTRUCTURE": ("contained_in", 4, 5), "IFCRELAGGREGATES": ("aggregated_by", 5, 4), "IFCRELCONNECTSELEMENTS": ("connected_to", 5, 6),
    "IFCRELVOIDSELEMENT": ("has_opening", 4, 5), "IFCRELFILLSELEMENT": ("fills", 5, 4),
}


def split_args():
    """Arrow UDF: top-level arguments of a record; brackets and quoted commas stay together."""

    @F.arrow_udf("array<string>")
    def split(args):
        return top_levels(args)

    return split


def top_levels(texts):
    """top_level() of every text of an Arrow array, by counting quotes and brackets over all of them at once. Texts with an odd number of quotes go one by one."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    texts = pc.fill_null(texts, "").cast(pa.large_string())
    odd = pc.equal(pc.bit_wise_and(pc.count_substring(texts, "'"), 1), 1)
    plain, n = pc.if_else(odd, pa.scalar("", pa.large_string()), texts), len(texts)
    starts = np.frombuffer(plain.buffers()[1], np.int64)[plain.offset : plain.offset + n + 1]
    data = np.frombuffer(plain.buffers()[2] or b"", np.uint8)[starts[0] : starts[-1]]
    starts = starts - starts[0]
    quoted = np.bitwise_xor.accumulate(data == ord("'"))
    depth = np.concatenate([[0], np.cumsum((((data == ord("(")) & ~quoted).astype(np.int8) - ((data == ord(")")) & ~quoted)), dtype=np.int64)])
    cuts = np.flatnonzero((data == ord(",")) & ~quoted)
    row = np.searchsorted(starts, cuts, "right") - 1
    top = depth[cuts] == depth[starts[row]]
    cuts, row = cuts[top], row[top]
    # Commas that cut are taken out; the k-th one begins a part that has k cuts and the first parts of row + 1 texts before it.
    lists = np.concatenate([[0], np.cumsum(1 + np.bincount(row, minlength=n))])
    begins = np.empty(lists[-1] + 1, np.int64)
    begins[lists] = starts - (lists - np.arange(n + 1))
    begins[np.arange(len(cuts)) + row + 1] = cuts - np.arange(len(cuts))
    parts = pa.LargeStringArray.from_buffers(int(lists[-1]), pa.py_buffer(begins), pa.py_buffer(np.delete(data, cuts)))
    found = pa.ListArray.from_arrays(pa.array(lists, pa.int32()), pc.utf8_trim_whitespace(parts).cast(pa.string()))
    if not pc.any(odd).as_py():
        return found
    at = np.arange(n)
    at[odd.to_numpy(zero_copy_only=False)] = n + np.arange(pc.sum(odd).as_py())
    return pa.concat_arrays([found, pa.array([top_level(x) for x in texts.filter(odd).to_pylist()], found.type)]).take(pa.array(at))


def top_level(text: str | None) -> list[str]:
    cuts, depth = [-1], 0
    for m in TOKEN.finditer(text or ""):
        c = m[0]
        if c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
        elif c == "," and depth == 0:
            cuts.append(m.start())
    return [text[a + 1 : b].strip() for a, b in zip(cuts, [*cuts[1:], len(text)], strict=True)] if text else [""]


#: A quoted text as a whole (quotes in it are doubled), or a bracket or comma; anything else is skipped at once.
TOKEN = re.compile(r"'(?:[^']|'')*'|[(),]")


def read_step(spark: SparkSession, path: str) -> DataFrame:
    """file, id, type, args (array) of every record of the STEP files under a path.

    Texts between ';' are read as rows, so that a file of any size is split into blocks; a ';' inside quotes leaves a row with an odd number of quotes.
    Whether a block begins inside quotes is a parallel prefix over the blocks: each is numbered within itself, both for a start inside and outside of
    quotes, and leaves a summary (parity, record beginnings for either start) of one row; summaries are added up in the order of the
    blocks and say how each block truly starts. Only rows that are parts of a record are put together again.
    """
    lines = spark.read.option("lineSep", ";").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value", F.monotonically_increasing_id().alias("at"))
    return parse_records(join_records(lines))


def join_records(lines: DataFrame) -> DataFrame:
    """file, value: whole records of rows file, block, at (order in a block), value, the texts between ';'."""
    spark = lines.sparkSession
    odd = (F.char_length("value") - F.char_length(F.replace("value", F.lit("'")))) % 2
    own = Window.partitionBy("file", "block").orderBy("at")
    before = F.coalesce(F.sum("odd").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) % 2
    rows = lines.withColumn("odd", odd).withColumn("before", before)
    # A row begins a record if the number of odd rows before it is even: counted for a block that starts outside of quotes, and for one that starts inside.
    begun = lambda parity: F.sum((F.col("before") == parity).cast("long")).over(own)
    path = scratch(spark, "blocks")
    rows.withColumn("outside", begun(0)).withColumn("inside", begun(1)).write.parquet(path)
    rows = spark.read.parquet(path)
    blocks = rows.groupBy("file", "block").agg((F.sum("odd") % 2).alias("parity"), F.max("outside").alias("n_outside"), F.max("inside").alias("n_inside"))
    order = Window.partitionBy("file").orderBy("block")  # one row per block
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("start", F.coalesce(F.sum("parity").over(earlier), F.lit(0)) % 2)
    blocks = blocks.withColumn("first", F.coalesce(F.sum(F.when(F.col("start") == 0, F.col("n_outside")).otherwise(F.col("n_inside"))).over(earlier), F.lit(0)))
    path = scratch(spark, "starts")
    blocks.select("file", "block", "start", "first").write.parquet(path)
    rows = rows.join(spark.read.parquet(path), ["file", "block"])
    begins = (F.col("before") + F.col("start")) % 2 == 0
    rows = rows.select("file", "block", "at", "value", (begins & (F.col("odd") == 0)).alias("whole"), (F.col("first") + F.when(F.col("start") == 0, F.col("outside")).otherwise(F.col("inside"))).alias("number"))
    parts = rows.where("not whole").groupBy("file", "number").agg(F.array_sort(F.collect_list(F.struct("block", "at", "value"))).alias("parts"))
    return rows.where("whole").select("file", "value").unionByName(parts.select("file", F.array_join(F.transform("parts", lambda x: x["value"]), ";").alias("value")))


def parse_records(rows: DataFrame) -> DataFrame:
    """file, id, type, args of rows file, value that hold a record each; others are left out."""
    # The pattern is looked for once; where its parts lie follows from the first bracket and the last character.
    blank = F.lit(" \t\n\x0b\f\r")
    found = rows.select("file", F.rtrim(F.regexp_extract(F.trim(F.col("value")), RECORD, 0), blank).alias("record")).where("record <> ''")
    head = F.substring_index("record", "(", 1)
    args = F.substring("record", F.length(head) + 2, F.length("record") - F.length(head) - 2)
    return found.select("file", F.btrim(F.substring(F.substring_index(head, "=", 1), F.lit(2), F.length(head)), blank).cast("long").alias("id"), F.upper(F.btrim(F.substring_index(head, "=", -1), blank)).alias("type"), split_args()(args).alias("args"))


def census(records: DataFrame, top: int = 30) -> DataFrame:
    """file, type, n, rank of the most frequent types, with each file's total and number of types."""
    counts = records.groupBy("file", "type").agg(F.count("*").alias("n"))
    whole = Window.partitionBy("file")
    rank = F.row_number().over(whole.orderBy(F.desc("n"), "type"))
    return counts.select("file", "type", "n", rank.cast("long").alias("rank"), F.sum("n").over(whole).alias("total"), F.count("*").over(whole).alias("n_types")).where(F.col("rank") <= top)


def reference_edges(records: DataFrame) -> DataFrame:
    """file, source, target, pos: every '#n' in a record's arguments."""
    return records.select("file", F.col("id").alias("source"), F.posexplode(F.regexp_extract_all(F.array_join("args", ","), F.lit(r"#(\d+)"), F.lit(1))).alias("pos", "t")).select("file", "source", F.col("t").cast("long").alias("target"), "pos")


def text_of(arg):
    """A quoted argument's text; null for '$' and '*', empty for what is not quoted. Arguments have no blanks around them, so no pattern is needed."""
    quoted = arg.startswith("'") & arg.endswith("'") & (F.length(arg) > 1)
    return F.when(arg.isNull() | arg.isin("$", "*"), None).when(quoted, F.substring(arg, F.lit(2), F.length(arg) - 2)).otherwise("")


def _refs(arg):
    return F.transform(F.regexp_extract_all(arg, F.lit(r"#(\d+)"), F.lit(1)), lambda x: x.cast("long"))


def _ref(arg):
    """The first reference; null if there is none."""
    return F.nullif(F.regexp_extract(arg, r"#(\d+)", 1), F.lit("")).cast("long")


def objects(records: DataFrame) -> DataFrame:
    """file, id, type, global_id, name of records that begin with a 22-character id."""
    return records.where(F.length(text_of(F.get("args", 0))) == 22).select("file", "id", "type", text_of(F.get("args", 0)).alias("global_id"), text_of(F.get("args", 2)).alias("name"))


def relationships(records: DataFrame) -> DataFrame:
    """file, type, source, target, source_class, target_class by global ids."""
    # Records are read once for all types.
    by_type = lambda place: F.coalesce(*[F.when(F.col("type") == kind, F.lit(found[place])) for kind, found in RELATIONS.items()])
    rows = records.where(F.col("type").isin(*RELATIONS)).select("file", by_type(0).alias("kind"), F.get("args", by_type(1)).alias("many"), F.get("args", by_type(2)).alias("one"))
    out = rows.select("file", "kind", F.explode(_refs(F.col("many"))).alias("a"), _ref(F.col("one")).alias("b"))
    ends = objects(records).select("file", "id", "global_id", "type")
    a = ends.select("file", F.col("id").alias("a"), F.col("global_id").alias("source"), F.col("type").alias("source_class"))
    b = ends.select("file", F.col("id").alias("b"), F.col("global_id").alias("target"), F.col("type").alias("target_class"))
    return out.join(a, ["file", "a"]).join(b, ["file", "b"]).select("file", F.col("kind").alias("type"), "source", "target", "source_class", "target_class")


def properties(records: DataFrame) -> DataFrame:
    """file, global_id, pset, prop, value: single values of property sets; sets named Qto_ are quantities."""
    of = lambda kind: records.where(F.col("type") == kind)
    rel = of("IFCRELDEFINESBYPROPERTIES").select("file", F.explode(_refs(F.get("args", 4))).alias("element"), _ref(F.get("args", 5)).alias("set"))
    sets = of("IFCPROPERTYSET").unionByName(of("IFCELEMENTQUANTITY")).select("file", F.col("id").alias("set"), text_of(F.get("args", 2)).alias("pset"), F.explode(_refs(F.element_at("args", -1))).alias("p"))
    given = F.get("args", 2)
    value = F.when(~given.isin("$", "*"), F.regexp_extract(given, r"(?s)^\w+\(\s*'?(.*?)'?\s*\)$", 1))
    single = of("IFCPROPERTYSINGLEVALUE").select("file", F.col("id").alias("p"), text_of(F.get("args", 0)).alias("prop"), value.alias("value"))
    quantity = records.where(F.col("type").startswith("IFCQUANTITY")).select("file", F.col("id").alias("p"), text_of(F.get("args", 0)).alias("prop"), F.get("args", 3).alias("value"))
    owner = objects(records).select("file", F.col("id").alias("element"), "global_id")
    found = rel.join(sets, ["file", "set"]).join(single.unionByName(quantity), ["file", "p"]).join(owner, ["file", "element"])
    return found.select("file", "global_id", "pset", "prop", "value", F.col("pset").startswith("Qto_").alias("is_quantity"))


def materials(records: DataFrame) -> DataFrame:
    """file, global_id, kind, material, thickness: single, listed, layered and profile materials, the last two also through their usages."""
    of = lambda kind: records.where(F.col("type") == kind)
    one = lambda k: _ref(F.get("args", k))
    rel = of("IFCRELASSOCIATESMATERIAL").select("file", F.explode(_refs(F.get("args", 4))).alias("element"), one(5).alias("m"))
    base = of("IFCMATERIAL").select("file", F.col("id").alias("x"), F.coalesce(text_of(F.get("args", 0)), F.lit("Unknown")).alias("material"))
    columns = lambda df, kind, thickness: df.select("file", "m", F.lit(kind).alias("kind"), F.coalesce("material", F.lit("Unknown")).alias("material"), thickness.alias("thickness"))
    none = F.lit(None).cast("double")
    single = columns(base.withColumnRenamed("x", "m"), "single", none)
    listed = columns(of("IFCMATERIALLIST").select("file", F.col("id").alias("m"), F.explode(_refs(F.get("args", 0))).alias("x")).join(base, ["file", "x"]), "list", none)
    layers = of("IFCMATERIALLAYER").select("file", F.col("id").alias("part"), one(0).alias("x"), F.get("args", 1).try_cast("double").alias("t"))
    profiles = of("IFCMATERIALPROFILE").select("file", F.col("id").alias("part"), one(2).alias("x"), none.alias("t"))
    sets = of("IFCMATERIALLAYERSET").select("file", F.col("id").alias("m"), F.explode(_refs(F.get("args", 0))).alias("part"), F.lit("layer").alias("k"))
    sets = sets.unionByName(of("IFCMATERIALPROFILESET").select("file", F.col("id").alias("m"), F.explode(_refs(F.get("args", 2))).alias("part"), F.lit("profile").alias("k")))
    made = sets.join(layers.unionByName(profiles), ["file", "part"]).join(base, ["file", "x"], "left").select("file", "m", F.col("k").alias("kind"), F.coalesce("material", F.lit("Unknown")).alias("material"), F.col("t").alias("thickness"))
    usages = records.where(F.col("type").isin("IFCMATERIALLAYERSETUSAGE", "IFCMATERIALPROFILESETUSAGE")).select("file", F.col("id").alias("usage"), one(0).alias("m"))
    used = made.join(usages, ["file", "m"]).drop("m").withColumnRenamed("usage", "m")
    owner = objects(records).select("file", F.col("id").alias("element"), "global_id")
    every = single.unionByName(listed).unionByName(made).unionByName(used)
    return rel.join(every, ["file", "m"]).join(owner, ["file", "element"]).select("file", "global_id", "kind", "material", "thickness")


def classifications(records: DataFrame) -> DataFrame:
    """file, global_id, system, code, name of classification references."""
    of = lambda kind: records.where(F.col("type") == kind)
    rel = of("IFCRELASSOCIATESCLASSIFICATION").select("file", F.explode(_refs(F.get("args", 4))).alias("element"), _ref(F.get("args", 5)).alias("ref"))
    ref = of("IFCCLASSIFICATIONREFERENCE").select("file", F.col("id").alias("ref"), text_of(F.get("args", 1)).alias("code"), text_of(F.get("args", 2)).alias("name"), _ref(F.get("args", 3)).alias("s"))
    system = of("IFCCLASSIFICATION").select("file", F.col("id").alias("s"), text_of(F.get("args", 3)).alias("system"))
    owner = objects(records).select("file", F.col("id").alias("element"), "global_id")
    return rel.join(ref, ["file", "ref"]).join(system, ["file", "s"], "left").join(owner, ["file", "element"]).select("file", "global_id", "system", "code", "name")


# Places: an affine map is an array of twelve numbers, the images of the three axes and of the origin.


NUMBER = r"[-+]?\d[\d.]*(?:[eE][-+]?\d+)?"


def _vectors(records: DataFrame, kind: str, name: str) -> DataFrame:
    """file, <name>, <name>_0 to <name>_2: three numbers; the third is 0 where a record has two."""
    v = F.regexp_extract_all(F.get("args", 0), F.lit(NUMBER), F.lit(0))
    return records.where(F.col("type") == kind).select("file", F.col("id").alias(name), v.alias("v")).select("file", name, *[F.coalesce(F.get("v", k).try_cast("double"), F.lit(0.0)).alias(f"{name}_{k}") for k in range(3)])


def _dot(a, b):
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def _normal(rows: DataFrame, v: str) -> DataFrame:
    """rows with <v>_0 to <v>_2 as a vector of length 1; null for one without length."""
    rows = rows.withColumn("length", F.sqrt(_dot(_columns(v), _columns(v))))
    return rows.withColumns({f"{v}_{k}": F.when(F.col("length") > 0, x / F.col("length")) for k, x in enumerate(_columns(v))}).drop("length")


def _columns(v: str) -> list:
    return [F.col(f"{v}_{k}") for k in range(3)]


def _level(rows: DataFrame, v: str) -> DataFrame:
    """rows with the part of <v> that is at right angles to z, with length 1; null where there is none."""
    rows = rows.withColumn("along", _dot(_columns(v), _columns("z")))
    rows = rows.withColumns({f"{v}_{k}": x - z * F.col("along") for k, (x, z) in enumerate(zip(_columns(v), _columns("z"), strict=True))}).drop("along")
    return _normal(rows.withColumns({f"{v}_{k}": F.when(F.abs(x) > 1e-12, x).otherwise(0.0) for k, x in enumerate(_columns(v))}), v)


def _composed(outer, inner, known):
    """The twelve numbers of the map `inner` followed by `outer`, or of `inner` alone where not `known`."""
    image = lambda i, k: sum((F.get(outer, 3 * j + k) * F.get(inner, 3 * i + j) for j in range(3)), F.get(outer, 9 + k) if i == 3 else F.lit(0.0))
    return [F.when(known, image(i, k)).otherwise(F.get(inner, 3 * i + k)) for i in range(4) for k in range(3)]


def placements(records: DataFrame) -> DataFrame:
    """file, id, parent, m of every local placement: its map into the coordinates of its parent (null: the world). A missing axis is the z axis, a missing or
    parallel reference direction the x axis (or y, where the axis is x), directions have any length; a placement without a point is where its parent is."""
    one = lambda k: _ref(F.get("args", k))
    axes = records.where(F.col("type").isin("IFCAXIS2PLACEMENT3D", "IFCAXIS2PLACEMENT2D"))
    flat = F.col("type") == "IFCAXIS2PLACEMENT2D"
    axes = axes.select("file", F.col("id").alias("axes"), one(0).alias("point"), F.when(~flat, one(1)).alias("up"), F.when(flat, one(1)).otherwise(one(2)).alias("ahead"))
    for name, kind in (("point", "IFCCARTESIANPOINT"), ("up", "IFCDIRECTION"), ("ahead", "IFCDIRECTION")):
        axes = axes.join(_vectors(records, kind, name), ["file", name], "left")
    # Numbers are columns of their own, and each step is a projection: arrays with functions over them would be interpreted, and made anew for every use.
    filled = lambda name, source, other: {f"{name}_{k}": F.coalesce(x, other[k] if not isinstance(other[k], int) else F.lit(float(other[k]))) for k, x in enumerate(_columns(source))}
    axes = _normal(axes, "up").withColumns(filled("z", "up", (0, 0, 1)) | filled("x", "ahead", (1, 0, 0)) | {f"other_{k}": F.lit(float(k == 0)) for k in range(3)} | filled("point", "point", (0, 0, 0)))
    axes = _level(_level(axes, "x"), "other").withColumns(filled("other", "other", (0, 1, 0)))
    axes = axes.withColumns(filled("x", "x", _columns("other")))
    x, z = _columns("x"), _columns("z")
    cross = [z[(k + 1) % 3] * x[(k + 2) % 3] - z[(k + 2) % 3] * x[(k + 1) % 3] for k in range(3)]
    axes = axes.select("file", "axes", F.array(*x, *cross, *z, *_columns("point")).alias("m"))
    still = F.array(*[F.lit(float(v)) for v in (1, 0, 0, 0, 1, 0, 0, 0, 1, 0, 0, 0)])
    own = records.where(F.col("type") == "IFCLOCALPLACEMENT").select("file", "id", one(0).alias("parent"), one(1).alias("axes"))
    return own.join(axes, ["file", "axes"], "left").select("file", "id", "parent", F.coalesce("m", still).alias("m"))


def in_world(placed: DataFrame, rounds: int = 40) -> DataFrame:
    """file, id, m of placements(): each map into the coordinates of the world."""
    return _worlds(placed, rounds).select("file", "id", F.array(*WORLD).alias("m"))


WORLD = [f"world_{k}" for k in range(12)]


def _worlds(placed: DataFrame, rounds: int = 40) -> DataFrame:
    """placements() with the twelve numbers of each map into the coordinates of the world, as columns, so that a reader of some of them makes no others.

    Placements that others lead to, mostly few, are followed by pointer doubling: in each round a map is composed with that of the placement it leads to,
    which by then leads as far again; a chain of depth d takes log2(d) + 1 rounds, each written. All others take one join with these. A parent that is not
    there counts as the world. Placements in a circle lead nowhere: an error after `rounds`.
    """
    spark = placed.sparkSession

    def written(df, name):
        path = scratch(spark, name)
        df.write.parquet(path)
        return spark.read.parquet(path)

    def followed(df, to):
        up = to.select("file", F.col("id").alias("parent"), F.col("parent").alias("above"), F.col("m").alias("outer"))
        numbers = _composed(F.col("outer"), F.col("m"), F.col("outer").isNotNull())
        return df.join(up, ["file", "parent"], "left").select("file", "id", "parent", "above", "m", *[x.alias(name) for x, name in zip(numbers, WORLD, strict=True)])

    placed = written(placed, "placed")
    now = written(placed.join(placed.select("file", F.col("parent").alias("id")).distinct(), ["file", "id"], "left_semi"), "placements")
    for _ in range(rounds):
        if now.where("parent is not null").isEmpty():
            return followed(placed, now).drop("above")
        moved = followed(now.where("parent is not null"), now).select("file", "id", F.col("above").alias("parent"), F.array(*WORLD).alias("m"))
        now = written(now.where("parent is null").unionByName(moved), "placements")
    raise ValueError(f"placements lead to each other in a circle, or deeper than 2^{rounds - 1}")


def locations(records: DataFrame) -> DataFrame:
    """file, global_id, x, y, z (in the coordinates of the placement's parent) and world_x, world_y, world_z of every object with a local placement."""
    own = records.where(F.length(text_of(F.get("args", 0))) == 22).select("file", text_of(F.get("args", 0)).alias("global_id"), _ref(F.get("args", 5)).alias("id")).where("id is not null")
    at = [F.get("m", 9 + k).alias(c) for k, c in enumerate("xyz")] + [F.col(WORLD[9 + k]).alias(f"world_{c}") for k, c in enumerate("xyz")]
    return own.join(_worlds(placements(records)).select("file", "id", *at), ["file", "id"]).drop("id")


#: Classes of places, from the whole to its parts.
PLACES = ("IFCPROJECT", "IFCSITE", "IFCBUILDING", "IFCBUILDINGSTOREY", "IFCSPACE")


def hierarchy(records: DataFrame, deepest: int = 100) -> DataFrame:
    """file, global_id, type, depth, path, n_elements, level of every place, by the model's own relations.

    path: names from the outermost place down, joined by '/'; a place without a name goes by its id. A place is part of what it is aggregated by or, spaces, contained in; any
    depth, one join a depth. n_elements counts what is contained in it and is no place. level numbers the storeys of one building by elevation (null: 0), then
    name. A place of which another is a part several times over has one path for each. Places in a circle have no outermost one: an error, as beyond `deepest`.
    """
    spark = records.sparkSession
    named = objects(records).where(F.col("type").isin(*PLACES))
    raised = records.where(F.col("type") == "IFCBUILDINGSTOREY").select("file", "id", F.get("args", 9).try_cast("double").alias("elevation"))
    places = named.join(raised, ["file", "id"], "left").select("file", "global_id", "type", F.coalesce("name", "global_id").alias("name"), "elevation")
    related = relationships(records)
    parts = related.where(F.col("type").isin("aggregated_by", "contained_in") & F.col("source_class").isin(*PLACES) & F.col("target_class").isin(*PLACES)).select("file", F.col("source").alias("global_id"), F.col("target").alias("whole")).distinct()

    def written(df, name):
        path = scratch(spark, name)
        df.write.parquet(path)
        return spark.read.parquet(path)

    places, parts = written(places, "places"), written(parts, "parts")
    below = parts.join(places, ["file", "global_id"])
    now = written(places.join(parts, ["file", "global_id"], "left_anti").select("*", F.lit(0).alias("depth"), F.col("name").alias("path"), F.lit(None).cast("string").alias("whole")), "level")
    found, reached = now, now.select("file", "global_id")
    for depth in range(1, deepest + 1):
        above = now.select("file", F.col("global_id").alias("whole"), F.col("path").alias("above"))
        now = written(below.join(above, ["file", "whole"]).select("file", "global_id", "type", "name", "elevation", F.lit(depth).alias("depth"), F.concat_ws("/", "above", "name").alias("path"), "whole"), "level")
        if now.isEmpty():
            break
        found, reached = found.unionByName(now), reached.unionByName(now.select("file", "global_id"))
    else:
        raise ValueError(f"places lie in each other in a circle, or deeper than {deepest}")
    if not places.join(reached, ["file", "global_id"], "left_anti").isEmpty():
        raise ValueError("places lie in each other in a circle")
    held = related.where((F.col("type") == "contained_in") & ~F.col("source_class").isin(*PLACES)).groupBy("file", F.col("target").alias("global_id")).agg(F.count("*").alias("n"))
    level = F.when(F.col("type") == "IFCBUILDINGSTOREY", F.row_number().over(Window.partitionBy("file", "whole", "type").orderBy(F.coalesce("elevation", F.lit(0.0)), "name", "global_id")))
    return found.join(held, ["file", "global_id"], "left").select("file", "global_id", "type", "depth", "path", F.coalesce("n", F.lit(0)).alias("n_elements"), level.cast("long").alias("level"))


def model_text(elements: DataFrame, properties: DataFrame, spatial: DataFrame, first: int = 100) -> DataFrame:
    """line, text: the spatial tree (sites, buildings, storeys with elevations), then the first elements in order with properties and materials.

    A text has as many lines as a model has places, so lines are rows in the order of `line`; elements: global_id, ifc_class, name, material, ord; properties:
    global_id, pset, prop, value, ord; spatial: site, site_name, building, storey, elevation.
    """
    site, building = F.coalesce("site_name", "site"), F.concat_ws("/", "site", "building")
    place = lambda df, depth, key, text: df.select(F.lit(0).alias("part"), key.alias("place"), F.lit(depth).alias("depth"), text.alias("text")).distinct()
    tree = place(spatial, 0, F.col("site"), F.concat(F.lit("Site: "), site)).unionByName(place(spatial, 1, building, F.concat(F.lit("  Building: "), F.col("building"))))
    tree = tree.unionByName(place(spatial, 2, F.concat_ws("/", building, "storey"), F.concat(F.lit("    Storey: "), F.col("storey"), F.lit(" (Elevation: "), F.coalesce(F.col("elevation").cast("string"), F.lit("N/A")), F.lit(")"))))
    some = elements.orderBy("ord").limit(first)
    listed = properties.join(F.broadcast(some.select("global_id")), "global_id").groupBy("global_id").agg(F.array_sort(F.collect_list(F.struct("ord", F.concat(F.lit("  "), F.col("pset"), F.lit("."), F.col("prop"), F.lit(": "), F.coalesce("value", F.lit("None"))).alias("t")))).alias("p"))
    head = F.concat(F.col("ifc_class"), F.lit(": "), F.coalesce("name", F.lit("Unnamed")))
    lines = F.concat(F.array(head), F.coalesce(F.transform("p", lambda x: x["t"]), F.array().cast("array<string>")), F.array_compact(F.array(F.concat(F.lit("  Material: "), F.col("material")))))
    own = some.join(listed, "global_id", "left").select(F.lit(1).alias("part"), F.lpad(F.col("ord").cast("string"), 20, "0").alias("place"), F.lit(0).alias("depth"), F.array_join(lines, "\n").alias("text"))
    rows = dense_index(tree.unionByName(own), [F.col("part"), F.col("place"), F.col("depth")], "line")
    return rows.select("line", "text")
