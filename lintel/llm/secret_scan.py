"""Secret scans in DataFrame functions alone: fixed patterns, and character Markov models for what no pattern names.

Two first-order models give the probability of a character after another, one in random strings, one in ordinary identifiers.
A candidate (a run of token characters with both letters and digits) counts as a secret if its mean log-likelihood ratio per
character exceeds a threshold. Both models are counted in Spark: random strings are the values the fixed patterns
matched in the sample, and digests in the usual alphabets; ordinary identifiers are the other words of a bounded sample of documents.
The counts come to the driver as one row per pair of characters, which the alphabet bounds.

Positions are code points. They come from the texts between matches, so each pattern is run only where it matches at all.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintel.llm.common import long_id, saved

# What the three kinds of the base look like.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "markov")

#: Characters of candidates; a place before the first stands for the start.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Candidates have a letter, a digit and at least 20 characters. Looked for only where a run of such characters begins, so that a long run is read a bounded number of times.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])(?=[0-9+/_=-]*+[A-Za-z])[A-Za-z0-9+/_=-]{20,}"
#: Documents and generated strings that the models are counted on; threshold in nats per character.
SAMPLE_DOCS, SAMPLE_STRINGS, THRESHOLD = 2000, 4000, 1.6

_SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def spans(text: Column, pattern: str, kind: int, value: int = 0) -> Column:
    """Leftmost non-overlapping matches as (start, kind, end, value), null where there are none. value: the group kept."""
    whole, kept = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(value))
    parts = F.arrays_zip(whole.alias("whole"), kept.alias("kept"), F.split(text, pattern, -1).alias("gap"))

    def step(state, x):
        start = state["at"] + F.char_length(x["gap"])
        end = start + F.char_length(x["whole"])
        found = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["kept"].alias("value"))
        return F.struct(F.coalesce(end, start).alias("at"), F.when(end.isNull(), state["out"]).otherwise(F.array_append(state["out"], found)).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))
    return F.when(text.rlike(pattern), F.aggregate(parts, zero, step, lambda s: s["out"]))


def _pairs(strings: DataFrame) -> DataFrame:
    """a, b: characters in a row; '' stands before the first."""
    split = strings.where("s <> ''").select("label", F.filter(F.split("s", ""), lambda c: c != "").alias("chars"))
    before = F.concat(F.array(F.lit("")), F.slice("chars", 1, F.size("chars") - 1))
    return split.select("label", F.inline(F.arrays_zip(before.alias("a"), F.col("chars").alias("b"))))


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_strings: int = SAMPLE_STRINGS) -> list[float]:
    """Log-likelihood ratios, random against ordinary, for each pair of characters: row by the first, the start last."""
    spark = docs.sparkSession
    known = docs.where("doc_id is not null and text is not null").select(long_id(docs), "text")
    # Ids are picked first, so that no texts meet in one task; they are at most `sample_docs`.
    ids = known.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    # Saved, or the optimizer would run the patterns on all texts and pick then.
    picked = saved(known.join(F.broadcast(ids), "doc_id", "left_semi"), "sample")
    picked = picked.withColumn("values", F.concat(*[F.coalesce(spans(F.col("text"), p, 0, v), F.array().cast(_SPAN)) for p, v in ((ASSIGN, 2), (ACCESS, 0), (HEX, 0))]))
    matched = picked.select(F.lit(1).alias("label"), F.explode(F.col("values.value")).alias("s")).where("length(s) >= 20")
    words = picked.where("size(values) = 0").select(F.lit(0).alias("label"), F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z0-9+/_=-]{4,}"), F.lit(0))).alias("s"))
    digest = F.sha2(F.concat(F.lit("sample-"), F.col("id").cast("string")), 256)
    forms = F.array(F.substring(digest, 1, 40), F.substring(F.base64(F.unhex(digest)), 1, 40), F.regexp_replace(F.substring(F.base64(F.unhex(digest)), 1, 40), "[+/]", "0"), F.upper(F.substring(digest, 1, 32)))
    random = spark.range(sample_strings).select(F.lit(1).alias("label"), F.element_at(forms, (F.pmod("id", F.lit(4)) + 1).cast("int")).alias("s"))
    counts = _pairs(matched.unionByName(words).unionByName(random)).groupBy("label", "a", "b").agg(F.count("*").alias("n")).collect()
    n = {(r["label"], r["a"], r["b"]): r["n"] for r in counts}
    table = []
    for a in [*ALPHABET, ""]:
        totals = [sum(n.get((k, a, b), 0) for b in ALPHABET) for k in (0, 1)]
        for b in ALPHABET:
            p = [(n.get((k, a, b), 0) + 0.5) / (totals[k] + 0.5 * len(ALPHABET)) for k in (0, 1)]
            table.append(math.log(p[1]) - math.log(p[0]))
    return table


def mean_ratio(s: Column, table: list[float]) -> Column:
    """Mean log-likelihood ratio per character."""
    ratios = F.split(F.lit(",".join(f"{x:.5f}" for x in table)), ",").cast("array<double>")
    n = len(ALPHABET)
    code = F.transform(F.split(s, ""), lambda c: F.when(c == "", F.lit(-1)).otherwise(F.call_function("locate", c, F.lit(ALPHABET)) - 1))
    code = F.filter(code, lambda c: c >= 0)
    before = F.concat(F.array(F.lit(n)), code)
    return F.aggregate(F.zip_with(F.slice(before, 1, F.size(code)), code, lambda a, b: F.get(ratios, a * n + b)), F.lit(0.0), lambda t, x: t + x) / F.char_length(s)


def scan(docs: DataFrame, table: list[float], threshold: float = THRESHOLD) -> DataFrame:
    """row (all columns of docs, as they are), text and found: all spans in order of start, then kind.

    Null text is empty and has no spans. Base kinds: `assign` with values of 6 or more characters, `access`, `hex`.
    `markov` spans never overlap base ones. Null and repeated doc_ids are scanned like any others, equal rows alike. Spans of one start
    are in order of kind. Very long texts and runs take time in proportion, many spans in one text a little of their square. An empty table gives an empty result.
    """
    none = F.array().cast(_SPAN)
    rows = docs.select(F.struct("*").alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("*", spans(F.col("text"), ASSIGN, 0, 2).alias("assign"), spans(F.col("text"), ACCESS, 1).alias("access"), spans(F.col("text"), HEX, 2).alias("hex"), spans(F.col("text"), CANDIDATE, 3).alias("candidates"))
    base = F.concat(F.filter(F.coalesce("assign", none), lambda x: F.char_length(x["value"]) >= 6), F.coalesce("access", none), F.coalesce("hex", none))
    rows = rows.select("row", "text", "candidates", F.array_sort(base).alias("base"))
    apart = F.filter("candidates", lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    rows = rows.withColumn("candidates", apart)
    added = F.when(F.size("candidates") > 0, F.filter("candidates", lambda c: mean_ratio(c["value"], table) > threshold))
    return rows.withColumn("added", F.coalesce(added, none)).select("row", "text", F.array_sort(F.concat("base", "added")).alias("found"))


def mask(docs: DataFrame, table: list[float], **kw) -> DataFrame:
    """`docs` with every span of every text redacted; where there is a column n_chars, it counts the new text. Null texts stay null."""
    rows = scan(docs, table, **kw)
    text = F.when(F.col("row.text").isNotNull(), redacted(F.col("text"), F.col("found")))
    rows = rows.select("row", text.alias("text"))
    made = {"text": F.col("text"), "n_chars": F.char_length("text").cast("long")}
    return rows.select(*[made.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def named(found: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def redacted(text: Column, found: Column, mark: str = "[secret]") -> Column:
    """The text with each span, overlapping ones together, replaced by `mark`."""

    def step(state, x):
        inside = x["start"] < state["at"]
        gap = F.substring(text, state["at"] + 1, F.greatest(x["start"] - state["at"], F.lit(0)))
        return F.struct(F.greatest(state["at"], x["end"]).alias("at"), F.when(inside, state["out"]).otherwise(F.concat(state["out"], gap, F.lit(mark))).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.when(F.size(found) == 0, text).otherwise(F.aggregate(found, zero, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.char_length(text)))))
