"""Files, runs, documents and tables of a project lake: counts, latest rows, search, graphs."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lintel.operators.ranks import dense_index

# Words that are no keywords, and the pattern of a word.
STOPWORDS = (
    "the and for that this with from are was were been have has had not but what all can will one each which their there about other into more "
    "some than its also these such between through 이 그 저 것 수 등 및 또는 또한 그리고 하는 되는 있는 없는 위한 대한 따른 통한 none null true false"
).split()
KEYWORD = "([가-힣]{2,}|[A-Za-z]{3,})"
STAGES = ("parse", "validate", "enrich", "transform", "package")


def file_stats(files: DataFrame) -> DataFrame:
    """dimension, value, n: totals and counts by category, phase and status. Nulls have names of their own."""
    rows = files.select(F.coalesce("category", F.lit("other")).alias("category"), F.coalesce("phase", F.lit("unassigned")).alias("phase"), F.coalesce("status", F.lit("pending")).alias("status"))
    sets = rows.groupingSets([("category",), ("phase",), ("status",), ()], "category", "phase", "status").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    return sets.select(F.when(F.col("g") == 3, "category").when(F.col("g") == 5, "phase").when(F.col("g") == 6, "status").otherwise("total").alias("dimension"), F.coalesce("category", "phase", "status").alias("value"), "n")


def project_rollup(files: DataFrame) -> DataFrame:
    return files.groupBy("project_id").agg(F.count("*").alias("n_files"), F.count_if(F.col("filename").endswith(".ifc")).alias("n_ifc"))


def filter_files(files: DataFrame, project_id: int, category: str | None = None, phase: str | None = None) -> DataFrame:
    rows = files.where(F.col("project_id") == project_id)
    rows = rows.where(F.col("category") == category) if category else rows
    return rows.where(F.col("phase") == phase) if phase else rows


def latest_runs(runs: DataFrame, status: str | None = None) -> DataFrame:
    """The latest run of each project, ties to the greatest id. One aggregation, no sort."""
    rows = runs.where(F.col("status") == status) if status else runs
    best = rows.groupBy("project_id").agg(F.max_by(F.struct("run_id", "status", "created_at"), F.struct("created_at", "run_id")).alias("r"))
    return best.select("project_id", "r.*")


def run_history(runs: DataFrame, n: int) -> DataFrame:
    """The newest n runs of each project; progress is 100 once completed."""
    rank = F.row_number().over(Window.partitionBy("project_id").orderBy(F.desc("created_at"), F.desc("run_id")))
    return runs.withColumn("rank", rank.cast("long")).where(F.col("rank") <= n).select("project_id", "run_id", "status", F.when(F.col("status") == "completed", 100).otherwise(0).alias("progress"), "rank")


def stage_timeline(runs: DataFrame, stages: tuple[str, ...] = STAGES) -> DataFrame:
    """A row per run and stage: completed before the current one, running at it, pending after."""
    at = F.array_position(F.array(*[F.lit(s) for s in stages]), F.col("current_stage"))
    rows = runs.select("run_id", at.alias("at"), F.posexplode(F.array(*[F.lit(s) for s in stages])).alias("idx", "stage"))
    state = F.when(F.col("idx") + 1 < F.col("at"), "completed").when(F.col("idx") + 1 == F.col("at"), "running").otherwise("pending")
    return rows.select("run_id", "stage", state.alias("state"))


def document_keywords(docs: DataFrame, top: int = 30, stopwords: list[str] = STOPWORDS) -> DataFrame:
    """doc_id, word, n, rank: the most frequent words of each text, ties by first appearance.

    Words are counted inside their row, as runs of equal words in sorted order; only the `top` words leave it, and nothing is shuffled.
    """
    found = F.transform(F.regexp_extract_all("text", F.lit(KEYWORD), F.lit(1)), lambda w: F.lower(w))
    wanted = F.filter(F.transform(found, lambda w, i: F.struct(w.alias("word"), i.alias("pos"))), lambda x: ~x["word"].isin(*stopwords))
    rows = docs.select("doc_id", F.array_sort(wanted).alias("words"))
    begins = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: (i == 0) | (F.get("words", i)["word"] != F.get("words", i - 1)["word"]))
    rows = rows.where(F.size("words") > 0).select("doc_id", "words", begins.alias("begins"))
    counts = F.transform("begins", lambda b, i: F.struct((b - F.coalesce(F.get("begins", i + 1), F.size("words"))).alias("less"), F.get("words", b)["pos"].alias("first"), F.get("words", b)["word"].alias("word")))
    best = rows.select("doc_id", F.posexplode(F.slice(F.array_sort(counts), 1, top)).alias("rank", "w"))
    return best.select("doc_id", "w.word", (-F.col("w.less")).cast("long").alias("n"), (F.col("rank") + 1).cast("long").alias("rank"))


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_chars, n_lines, n_sentences, n_tables, n_sections. docs: doc_id, text, tables and sections (arrays)."""
    from lintel.functions.text import sentences

    count = lambda c, name: F.size(c).cast("long").alias(name)
    return docs.select("doc_id", count(F.regexp_extract_all("text", F.lit(r"(\S+)"), F.lit(1)), "n_words"), F.char_length("text").cast("long").alias("n_chars"), count(F.split("text", "\n", -1), "n_lines"), sentences(F.col("text")).cast("long").alias("n_sentences"), count("tables", "n_tables"), count("sections", "n_sections"))


def corpus_keywords(keywords: DataFrame, top: int = 100) -> DataFrame:
    """word, n, n_docs of the most frequent words over all documents' keywords."""
    return keywords.groupBy("word").agg(F.sum("n").alias("n"), F.count("*").alias("n_docs")).orderBy(F.desc("n"), "word").limit(top)


def search_documents(docs: DataFrame, phrase: str, top: int = 20, phase: str | None = None) -> DataFrame:
    """doc_id, score, snippets of the best `top` completed documents with text; if a phase is given, of those `top` the ones of that phase.

    score: 10 for the whole phrase and up to 5 for the occurrences of each of its words, over the number of words. snippets: of the first
    three words found (in order of the alphabet) 80 characters to either side, dots where the text goes on. docs: doc_id, text, and status and phase if there.
    """
    words = sorted(set(re.findall(KEYWORD, phrase.lower())))
    rows = docs.where("status = 'completed'") if "status" in docs.columns else docs
    low = F.lower(F.coalesce("text", F.lit("")))
    count = lambda w: F.least(F.lit(5), ((F.char_length(low) - F.char_length(F.replace(low, F.lit(w)))) / len(w)).cast("int"))
    score = reduce(lambda a, b: a + b, map(count, words), F.when(F.contains(low, F.lit(phrase.lower())), 10).otherwise(0))

    def snippet(w: str):
        at = F.instr(low, w) - 1
        start, end = F.greatest(F.lit(0), at - 80), F.least(F.char_length("text"), at + len(w) + 80)
        dots = lambda cut: F.when(cut, "...").otherwise("")
        return F.when(at >= 0, F.concat(dots(start > 0), F.trim(F.substring("text", start + 1, end - start)), dots(end < F.char_length("text"))))

    best = rows.select("doc_id", "text", *(["phase"] if phase else []), score.alias("points")).where("points > 0").orderBy(F.desc("points"), "doc_id").limit(top)
    best = best.where(F.col("phase") == phase) if phase else best
    return best.select("doc_id", F.round(F.col("points") / max(1, len(words)), 2).alias("score"), F.slice(F.array_compact(F.array(*map(snippet, words))), 1, 3).alias("snippets"))


def sort_rows(rows: DataFrame, column: str) -> DataFrame:
    """Numbers by value first, then the rest as text."""
    number = F.col(column).try_cast("double")
    return rows.orderBy(number.isNull(), number, column)


def sorted_ranks(rows: DataFrame, column: str) -> DataFrame:
    """rows with rank, from 1, in the order of sort_rows; values are distinct."""
    number = F.col(column).try_cast("double")
    return dense_index(rows.select("*", number.isNull().alias("is_text_"), number.alias("number_")), [F.col("is_text_"), F.col("number_"), F.col(column)], "rank").withColumn("rank", F.col("rank") + 1).drop("is_text_", "number_")


def paginate(rows: DataFrame, order: list, page: int, size: int) -> DataFrame:
    """One page of a total order."""
    return rows.orderBy(*order).offset((page - 1) * size).limit(size)


def document_graph(keywords: DataFrame, terms: DataFrame, top: int = 10) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, node_type), each once, and edges of documents, their first keywords, and classes that keywords stand for (terms: word, class)."""
    rows = keywords.where(F.col("rank") <= top)
    doc, word = F.concat(F.lit("doc:"), F.col("doc_id").cast("string")), F.concat(F.lit("kw:"), F.col("word"))
    mapped = rows.join(terms, "word")
    cls = F.concat(F.lit("cls:"), F.col("class"))
    # All nodes of a keyword in one pass, so that texts are read and their words counted once.
    node = lambda c, kind: F.struct(c.alias("id"), F.lit(kind).alias("node_type"))
    made = F.array_compact(F.array(node(doc, "document"), node(word, "keyword"), F.when(F.col("class").isNotNull(), node(cls, "class"))))
    nodes = rows.join(F.broadcast(terms), "word", "left").select(F.inline(made)).dropDuplicates(["id"])  # a dictionary of words
    edges = rows.select(doc.alias("src"), word.alias("dst"), F.lit("contains_keyword").alias("edge_type")).union(mapped.select(word, cls, F.lit("mapped_to")))
    return nodes, edges


def union_tables(docs: DataFrame) -> DataFrame:
    """doc_id, phase, idx and row of the lines of completed documents, read as one-column tables."""
    return docs.where("status = 'completed'").select("doc_id", "phase", F.posexplode(F.split("text", "\n", -1)).alias("idx", "row"))


def publish_trigger(transitions: DataFrame) -> DataFrame:
    """Transitions to published from any other state: file_id, event_id, previous."""
    previous = F.lag("state").over(Window.partitionBy("file_id").orderBy("ts", "event_id"))
    return transitions.withColumn("previous", previous).where("state = 'published' and (previous is null or previous <> 'published')").select("file_id", "event_id", "previous")


def run_progress(events: DataFrame) -> DataFrame:
    """Latest stage of each run and overall progress: idx * 20 and a fifth of the stage's, a completed stage counts in full."""
    last = events.groupBy("run_id").agg(F.max_by(F.struct("stage", "idx", "stage_progress", "stage_status"), F.struct("ts", "event_id")).alias("e"))
    part = F.floor(F.col("e.idx") * 20 + F.col("e.stage_progress") * 0.2)
    return last.select("run_id", "e.stage", F.when(F.col("e.stage_status") == "completed", (F.col("e.idx") + 1) * 20).otherwise(part).cast("long").alias("overall"))


def dedupe_uploads(files: DataFrame) -> DataFrame:
    """The first upload of each checksum."""
    return files.groupBy("checksum").agg(F.min_by(F.struct("id", "filename"), F.struct("uploaded_at", "id")).alias("f")).select("checksum", "f.id", "f.filename")


def topic_summary(topics: DataFrame) -> DataFrame:
    """dimension, value, n: topics by status, type and source, in all, open ones, and open critical ones. One pass over the topics."""
    row = lambda d, v: F.struct(F.lit(d).alias("dimension"), v.cast("string").alias("value"))
    none, is_open = F.lit(None), F.col("topic_status") == "Open"
    made = F.array(row("status", F.col("topic_status")), row("type", F.col("topic_type")), row("source", F.col("source")), row("total", none), F.when(is_open, row("open", none)), F.when(is_open & (F.col("priority") == "Critical"), row("critical", none)))
    return topics.select(F.inline(F.array_compact(made))).groupBy("dimension", "value").agg(F.count("*").alias("n"))
