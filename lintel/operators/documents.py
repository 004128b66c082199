"""Checks of project documents: what they should hold, how much information, what does not conform."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Ranks of information levels, and the rank each phase asks for.
LEVELS = ("LOI Low", "LOI Medium", "LOI High")
NEEDED = {"design": 2, "construction": 3, "operation": 2}


def loin_level(words: Column, tables: Column) -> Column:
    """High above 5000 words or 5 tables, medium above 500 words."""
    return F.when((words > 5000) | (tables > 5), LEVELS[2]).when(words > 500, LEVELS[1]).otherwise(LEVELS[0])


def model_level(entities: Column) -> Column:
    return F.when(entities > 1000, LEVELS[2]).when(entities > 100, LEVELS[1]).otherwise(LEVELS[0])


def loin_gap(level: Column, phase: Column) -> Column:
    rank = F.array_position(F.array(*[F.lit(x) for x in LEVELS]), level)
    needed = F.coalesce(F.element_at(F.create_map(*[x for k, v in NEEDED.items() for x in (F.lit(k), F.lit(v))]), phase), F.lit(1))
    return rank < needed


# Least words of a document by phase.
LEAST_WORDS = {"design": 200, "construction": 100, "operation": 100}
OFFICE, SHEETS, SLIDES = (".docx", ".hwpx", ".hwp"), (".xlsx", ".xls", ".csv"), (".pptx", ".ppt")


def document_checks(docs: DataFrame) -> DataFrame:
    """doc_id, facet, check, result (PASS or FAIL), note, fix: checks of every document and of its format, one pass over the rows.

    fix names what can mend a failed check, null where nothing can. docs: doc_id, filename, ext, phase, type_id, words, title, author, dated,
    n_sections, levels (array), n_tables, has_headers, n_rows, sheet_names (array), pages, revision, model_schema, entities (array, upper case), slides; nulls count
    as missing.
    """
    c, n = F.col, lambda x: F.coalesce(F.col(x), F.lit(0))
    size = lambda x: F.greatest(F.coalesce(F.size(x), F.lit(0)), F.lit(0))
    text = lambda x: F.coalesce(F.col(x), F.lit("")) != ""
    said = lambda cond, yes, no: F.when(cond, yes).otherwise(no)
    counted = lambda x, what: F.concat(x.cast("string"), F.lit(what))
    least = F.coalesce(F.element_at(F.create_map(*[x for k, v in LEAST_WORDS.items() for x in (F.lit(k), F.lit(v))]), c("phase")), F.lit(50))
    parts = F.size(F.split(F.replace("filename", F.lit("."), F.lit("_")), "_", -1))
    named = lambda word: F.exists("entities", lambda e: F.contains(e, F.lit(word)))
    spatial = F.size(F.array_intersect(F.coalesce("entities", F.array().cast("array<string>")), F.array(*[F.lit(x) for x in ("IFCSITE", "IFCBUILDING", "IFCBUILDINGSTOREY", "IFCSPACE")])))
    of = lambda *exts: c("ext").isin(*exts)
    checks = [  # when it applies, facet, check, whether it holds, note, fix
        (None, "Attribute", "title", text("title"), said(text("title"), F.concat(F.lit("Title: "), c("title")), "no title"), "fix_title"),
        (None, "Attribute", "author", text("author"), said(text("author"), F.concat(F.lit("Author: "), c("author")), "no author"), "fix_author"),
        (None, "Attribute", "date", F.coalesce("dated", F.lit(False)), said(c("dated"), "dated", "no date"), "fix_date"),
        (None, "Entity", "structure", (n("n_sections") > 0) | (of(".xlsx", ".xls") & (n("n_tables") > 0)), counted(n("n_sections"), " sections"), "fix_structure"),
        (None, "Property", "content", n("words") >= least, F.concat(counted(n("words"), " words of "), least.cast("string")), "fix_content"),
        (None, "Attribute", "naming", parts >= 3, counted(parts, " parts"), "fix_naming"),
        (of(".pdf"), "Property", "pages", n("pages") > 0, counted(n("pages"), " pages"), None),
        (of(".pdf") & (c("type_id") == "design_drawing"), "Property", "title block", n("n_tables") > 0, counted(n("n_tables"), " tables"), "fix_titleblock"),
        (of(*OFFICE), "Entity", "heading hierarchy", F.size(F.array_distinct("levels")) >= 2, counted(size("levels"), " headings"), "fix_headings"),
        (of(*OFFICE), "Attribute", "revision", n("revision") > 0, counted(n("revision"), ". revision"), "fix_revision"),
        (of(*SHEETS), "Entity", "header row", F.coalesce("has_headers", F.lit(False)), said(c("has_headers"), "headers", "no headers"), "fix_headers"),
        (of(*SHEETS), "Property", "data rows", n("n_rows") >= 3, counted(n("n_rows"), " rows"), None),
        (of(*SHEETS), "Attribute", "sheet names", F.exists("sheet_names", lambda x: F.char_length(x) > 6), F.concat_ws(", ", F.slice("sheet_names", 1, 5)), "fix_sheetnames"),
        (of(".ifc"), "Classification", "schema", text("model_schema"), said(text("model_schema"), c("model_schema"), "no schema"), None),
        (of(".ifc"), "Entity", "entity types", size("entities") >= 3, counted(size("entities"), " types"), "fix_entities"),
        (of(".ifc"), "PartOf", "spatial structure", spatial >= 2, counted(spatial, " spatial types"), "fix_spatial"),
        (of(".ifc"), "Property", "property sets", named("PROPERTYSET") | named("PSET"), F.lit(None), "fix_pset"),
        (of(".ifc"), "Material", "materials", named("MATERIAL"), F.lit(None), "fix_material"),
        (of(".ifc"), "Classification", "classification", named("CLASSIFICATION"), F.lit(None), "fix_classification"),
        (of(*SLIDES), "Property", "slides", n("slides") >= 2, counted(n("slides"), " slides"), None),
    ]
    rows = []
    for when, facet, check, good, note, fix in checks:
        good = F.coalesce(good, F.lit(False))
        row = F.struct(F.lit(facet).alias("facet"), F.lit(check).alias("check"), said(good, "PASS", "FAIL").alias("result"), note.cast("string").alias("note"), F.when(~good, F.lit(fix)).cast("string").alias("fix"))
        rows.append(row if when is None else F.when(when, row))
    return docs.select("doc_id", F.inline(F.array_compact(F.array(*rows))))


def ng_items(checks: DataFrame, levels: DataFrame, domains: DataFrame | None = None) -> DataFrame:
    """doc_id, severity (NG or WARNING), standard, facet, description: checks that failed or warn, documents below their phase's level, and documents of another domain.

    levels: doc_id, level, phase; domains: doc_id, domain, is_relevant.
    """
    item = lambda severity, standard, facet, description: ("doc_id", severity.alias("severity"), F.lit(standard).alias("standard"), facet.alias("facet"), description.alias("description"))
    ng = F.lit("NG")
    found = checks.where(F.col("result").isin("FAIL", "WARNING")).select(*item(F.when(F.col("result") == "FAIL", "NG").otherwise("WARNING"), "IDS 1.0", F.col("facet"), F.col("check")))
    found = found.unionByName(levels.where(loin_gap(F.col("level"), F.col("phase"))).select(*item(ng, "ISO 7817-1 (LOIN)", F.lit("Information Level"), F.col("level"))))
    if domains is not None:
        found = found.unionByName(domains.where("not is_relevant").select(*item(ng, "ISO 19650-1 / ISO 12006-2", F.lit("Domain"), F.col("domain"))))
    return found


def ng_counts(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, ng_count, warning_count of every document."""
    counts = items.groupBy("doc_id").agg(F.count_if(F.col("severity") == "NG").alias("ng_count"), F.count_if(F.col("severity") == "WARNING").alias("warning_count"))
    return docs.select("doc_id").join(counts, "doc_id", "left").fillna(0, ["ng_count", "warning_count"])


def compliance(checks: DataFrame, passing: tuple[str, ...] = ("PASS",)) -> DataFrame:
    """doc_id, n_checks, n_passed, percent."""
    good = F.count_if(F.col("result").isin(*passing))
    return checks.groupBy("doc_id").agg(F.count("*").alias("n_checks"), good.alias("n_passed"), F.bround(good * 100.0 / F.count("*")).cast("long").alias("percent"))


def auto_fix(checks: DataFrame, fixes: list[str] | None = None) -> DataFrame:
    """Failed checks that one of the given fixes mends become FIXED; without fixes all that any can mend."""
    chosen = F.col("fix").isin(*fixes) if fixes else F.col("fix").isNotNull()
    return checks.withColumn("result", F.when(chosen, "FIXED").otherwise(F.col("result")))


#: The field of a document that a fix fills.
FILLED = {"fix_title": "title", "fix_author": "author", "fix_date": "creation_date", "fix_revision": "revision"}


def fill_metadata(docs: DataFrame, checks: DataFrame, values: dict[str, Column]) -> DataFrame:
    """docs with the fields that FIXED checks fill, and n_open, the number of their checks that still fail.

    values: what a fix writes, by fix, as columns of docs. A fix without a value, or with a null or empty one, leaves its field as it is; fields that docs lack are left out.
    """
    fixed = F.when(F.col("result") == "FIXED", F.col("fix"))
    found = checks.groupBy("doc_id").agg(F.collect_set(fixed).alias("_fixed"), F.count_if(F.col("result") == "FAIL").alias("n_open"))
    given = lambda fix: F.array_contains("_fixed", fix) & (F.coalesce(values[fix].cast("string"), F.lit("")) != "")
    fields = {field: F.when(given(fix), values[fix]).otherwise(F.col(field)) for fix, field in FILLED.items() if fix in values and field in docs.columns}
    return docs.join(found, "doc_id", "left").withColumns(fields | {"n_open": F.coalesce("n_open", F.lit(0))}).drop("_fixed")


def standard_warnings(docs: DataFrame, required: DataFrame | None = None) -> DataFrame:
    """doc_id, warning: naming, author and date of every document, a title where it is a design, a scope section in construction.

    docs: doc_id, filename, phase, title, author, dated, headings (array). required: phase, requirement: further words that a heading of
    such a phase's documents needs; a table of rules.
    """
    lost = lambda x: F.coalesce(F.col(x), F.lit("")) == ""
    headings = F.lower(F.array_join(F.coalesce("headings", F.array().cast("array<string>")), " "))
    parts = F.size(F.split(F.get(F.split("filename", r"\."), 0), "-", -1))
    found = [("naming", parts < 7), ("author", lost("author")), ("created", ~F.coalesce("dated", F.lit(False))), ("title", (F.col("phase") == "design") & lost("title")), ("scope", (F.col("phase") == "construction") & ~F.contains(headings, F.lit("scope")))]
    rows = docs.select("doc_id", F.explode(F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in found]))).alias("warning"))
    if required is None:
        return rows
    asked = docs.select("doc_id", "phase", headings.alias("h")).join(required, "phase").where(~F.contains("h", F.lower("requirement")))
    return rows.unionByName(asked.select("doc_id", F.concat(F.lit("section "), F.col("requirement")).alias("warning")))


def table_schema_check(expected: DataFrame, found: DataFrame) -> DataFrame:
    """sheet, column, problem: expected columns that are missing, and sheets that are missing with all of them."""
    sheets = found.select("sheet").distinct()
    lost = expected.join(sheets, "sheet", "left_anti").select("sheet", "column", F.lit("missing sheet").alias("problem"))
    return lost.unionByName(expected.join(sheets, "sheet", "left_semi").join(found, ["sheet", "column"], "left_anti").select("sheet", "column", F.lit("missing column").alias("problem")))
