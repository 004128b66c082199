"""Queries over files, runs, documents and vectors."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from lintel.functions import text as X
from lintel.operators import documents as D
from lintel.operators import features, lake, neighbours
from lintel.plans.registry import query
from lintel.plans.views import table, view


def files(spark, sf):
    return view(spark, sf, "v_files")


def runs(spark, sf):
    return view(spark, sf, "v_runs")


def docs(spark, sf):
    return view(spark, sf, "v_documents")


@query("""select 'category' as dimension, coalesce(category, 'other') as value, count(*) as n from v_files group by 2 union all select 'phase', coalesce(phase, 'unassigned'), count(*) from v_files group by 2
    union all select 'status', coalesce(status, 'pending'), count(*) from v_files group by 2 union all select 'total', null, count(*) from v_files""")
def a1_file_stats(spark, sf):
    return lake.file_stats(files(spark, sf))


@query("select project_id, count(*) as n_files, count(*) filter (where filename like '%.ifc') as n_ifc from v_files group by 1")
def a10_project_rollup(spark, sf):
    return lake.project_rollup(files(spark, sf))


@query("select id, filename, category, phase from v_files where project_id = 7 and category = 'document'")
def f1_filter_files(spark, sf):
    return lake.filter_files(files(spark, sf), 7, category="document").select("id", "filename", "category", "phase")


@query("""select id, case when filename like '%plan%' or filename like '%bim%' then 'design' when filename like '%site%' then 'construction' when lower(filename) like '%inspection%' then 'operation' else 'design' end as phase from v_files""")
def f2_detect_phase(spark, sf):
    return files(spark, sf).select("id", X.detect_phase(F.col("filename")).alias("phase"))


@query("""select id, split_part(split_part(filename, '.', 1), '-', 3) as project, len(string_split(split_part(filename, '.', 1), '-')) as n_parts, len(string_split(split_part(filename, '.', 1), '-')) >= 7 as compliant from v_files""")
def f3_parse_iso_filename(spark, sf):
    parts = X.iso_parts(F.col("filename"))
    return files(spark, sf).select("id", F.coalesce(F.get(parts, 2), F.lit("")).alias("project"), F.size(parts).cast("long").alias("n_parts"), (F.size(parts) >= 7).alias("compliant"))


FIELDS = ("project", "originator", "volume", "level", "type", "role", "number")


# The name's parts by place; strictly, only names of seven parts have fields.
@query("select id, " + ", ".join(f"coalesce(string_split(split_part(filename, '.', 1), '-')[{k}], '') as {c}" for k, c in enumerate(FIELDS, 1)) + ", case when len(string_split(split_part(filename, '.', 1), '-')) >= 7 then string_split(split_part(filename, '.', 1), '-')[7] end as strict_number from v_files")
def f3_iso_fields(spark, sf):
    parts = X.iso_parts(F.col("filename"))
    return files(spark, sf).select("id", *[F.coalesce(F.get(parts, k), F.lit("")).alias(c) for k, c in enumerate(FIELDS)], F.when(F.size(parts) >= 7, F.get(parts, 6)).alias("strict_number"))


def _type_scores() -> str:
    low = "lower(filename)"
    rows = []
    for i, (name, words, exts, phase) in enumerate(X.FILE_TYPES):
        hits = " + ".join(f"case when contains({low}, '{w}') then 5 else 0 end" for w in words)
        ends = " or ".join(f"{low} like '%{e}'" for e in exts)
        when = "2" if phase == "any" else f"case when phase = '{phase}' then 2 else 0 end"
        rows.append(f"select id, {i} as o, '{name}' as type_id, case when {ends} then 3 else 0 end + {hits} + {when} as score from v_files")
    return " union all ".join(rows)


@query(f"select id, type_id, score, least(score / 10.0e0, 1.0e0) as confidence from ({_type_scores()}) t qualify row_number() over (partition by id order by score desc, o) = 1")
def f4_classify_by_filename(spark, sf):
    return files(spark, sf).select("id", X.classify_filename(F.col("filename"), F.col("phase")).alias("c")).select("id", "c.*")


TERMS = {"the": 5, "and": 4, "iso": 1, "license": 3, "nicht": 2, "zzz": 9, "pour": 3}
SCORE = " + ".join(f"case when contains(lower(text), '{t}') then {w} else 0 end" for t, w in TERMS.items())


@query(f"""select doc_id, score, case when score >= 15 then 'BIM/Construction' when score >= 5 then 'Construction-related' when score >= 2 then 'Partially related' else 'Non-construction' end as domain, score >= 2 as is_relevant,
    case when score >= 15 then least(score * 3, 100) when score >= 5 then least(score * 5, 80) when score >= 2 then least(score * 8, 50) else greatest(5, score * 10) end as confidence from (select doc_id, {SCORE} as score from v_documents) t""")
def f5_domain_relevance(spark, sf):
    return docs(spark, sf).select("doc_id", X.domain_relevance(F.col("text"), TERMS).alias("d")).select("doc_id", "d.*")


TYPES = [("english", ["the", "and", "this"]), ("german", ["nicht", "der", "die"]), ("french", ["pour", "est", "dans"])]


def _content_scores() -> str:
    return " union all ".join(f"select doc_id, {i} as o, '{n}' as type_id, {' + '.join(f'''case when contains(lower(text), '{w}') then 3 else 0 end''' for w in ws)} as score from v_documents" for i, (n, ws) in enumerate(TYPES))


@query(f"select doc_id, type_id, score, least(score / 15.0e0, 1.0e0) as confidence from ({_content_scores()}) t where true qualify row_number() over (partition by doc_id order by score desc, o) = 1 and score >= 6")
def f6_classify_by_content(spark, sf):
    found = docs(spark, sf).select("doc_id", X.classify_content(F.col("text"), F.lit(None).cast("array<string>"), TYPES).alias("c"))
    return found.where("c is not null").select("doc_id", "c.*")


@query(f"""select d.doc_id, case when c.confidence > f.confidence then c.type_id else f.type_id end as type_id from v_documents d
    join (select doc_id, type_id, least(score / 10.0e0, 1.0e0) as confidence from ({_type_scores().replace('select id,', 'select doc_id,').replace('v_files', 'v_documents')}) t qualify row_number() over (partition by doc_id order by score desc, o) = 1) f on f.doc_id = d.doc_id
    left join (select doc_id, type_id, least(score / 15.0e0, 1.0e0) as confidence from ({_content_scores()}) t qualify row_number() over (partition by doc_id order by score desc, o) = 1 and score >= 6) c on c.doc_id = d.doc_id""")
def f7_resolve_document_type(spark, sf):
    f, c = X.classify_filename(F.col("filename"), F.col("phase")), X.classify_content(F.col("text"), F.lit(None).cast("array<string>"), TYPES)
    rows = docs(spark, sf).select("doc_id", f.alias("f"), c.alias("c"))
    return rows.select("doc_id", F.when(F.col("c.confidence") > F.col("f.confidence"), F.col("c.type_id")).otherwise(F.col("f.type_id")).alias("type_id"))


@query("select doc_id, u.i as idx, u.line as line from (select doc_id, unnest(list_transform(string_split(text, chr(10)), lambda x, i: struct_pack(i := i - 1, line := x))) as u from v_documents where status = 'completed') t where contains(lower(u.line), 'license')")
def f10_search_table_rows(spark, sf):
    rows = lake.union_tables(docs(spark, sf))
    return rows.where(F.exists(F.array("row"), lambda c: F.contains(F.lower(c), F.lit("license")))).select("doc_id", F.col("idx").cast("long").alias("idx"), F.col("row").alias("line"))


@query("""select filename, case when n = 0 then 'General' else s end as standards, n from (select distinct filename, (case when filename like '%.ifc' then 1 else 0 end) + (case when filename like '%-de.%' then 1 else 0 end) as n,
    concat_ws(',', case when filename like '%.ifc' then 'ISO 16739' end, case when filename like '%-de.%' then 'DIN' end) as s from v_documents) t""")
def f11_tag_table_standards(spark, sf):
    tags = F.array_compact(F.array(F.when(F.col("filename").contains(".ifc"), "ISO 16739"), F.when(F.col("filename").contains("-de."), "DIN")))
    rows = docs(spark, sf).select("filename").distinct().withColumn("tags", tags)
    return rows.select("filename", F.when(F.size("tags") == 0, "General").otherwise(F.array_join("tags", ",")).alias("standards"), F.size("tags").alias("n"))


LATEST = "(select *, row_number() over (partition by project_id order by created_at desc, run_id desc) as rn from v_runs)"


@query(f"select project_id, run_id, status, created_at from {LATEST} t where rn = 1")
def w1_latest_run(spark, sf):
    return lake.latest_runs(runs(spark, sf))


@query(f"select project_id, run_id, status, case when status = 'completed' then 100 else 0 end as progress, rn as rank from {LATEST} t where rn <= 3")
def w2_run_history(spark, sf):
    return lake.run_history(runs(spark, sf), 3)


STAGE_ROWS = "(values (0, 'parse'), (1, 'validate'), (2, 'enrich'), (3, 'transform'), (4, 'package')) s(i, stage)"


@query(f"""select r.run_id, s.stage, case when s.i < c.i then 'completed' when s.i = c.i then 'running' else 'pending' end as state
    from v_runs r join {STAGE_ROWS.replace(' s(', ' c(')} on c.stage = r.current_stage cross join {STAGE_ROWS}""")
def w3_stage_timeline(spark, sf):
    return lake.stage_timeline(runs(spark, sf))


@query("select id, filename, size_kb, row_number() over (order by size_kb desc, id) as rank from v_files qualify rank between 21 and 40")
def w6_paginate(spark, sf):
    from pyspark.sql import Window

    page = lake.paginate(files(spark, sf), [F.desc("size_kb"), "id"], page=2, size=20)
    rank = F.row_number().over(Window.orderBy(F.desc("size_kb"), "id")) + 20  # twenty rows
    return page.select("id", "filename", "size_kb", rank.cast("long").alias("rank"))


@query("""select value, row_number() over (order by try_cast(value as double) is null, try_cast(value as double), value) as rank from (select distinct value from v_properties where value is not null) t""")
def w5_sort_table(spark, sf):
    values = view(spark, sf, "v_properties").where("value is not null").select("value").distinct()
    return lake.sorted_ranks(values, "value").select("value", "rank")


STOP = ", ".join(f"'{w}'" for w in lake.STOPWORDS)
WORDS = f"""(select doc_id, word, count(*) as n, min(pos) as first from (select doc_id, lower(u.w) as word, u.i as pos from (select doc_id, unnest(list_transform(regexp_extract_all(text, '[가-힣]{{2,}}|[A-Za-z]{{3,}}'), lambda x, i: struct_pack(i := i, w := x))) as u from documents) t) s where word not in ({STOP}) group by 1, 2)"""
KEYWORDS = f"(select doc_id, word, n, row_number() over (partition by doc_id order by n desc, first) as rank from {WORDS} w qualify rank <= 30)"


@query(f"select doc_id, word, n, rank from {KEYWORDS} k")
def a2_document_keywords(spark, sf):
    return lake.document_keywords(table(spark, sf, "documents"))


@query(f"select word, cast(sum(n) as bigint) as n, count(*) as n_docs from {KEYWORDS} k group by 1 order by 2 desc, 1 limit 100")
def a3_corpus_keywords(spark, sf):
    return lake.corpus_keywords(lake.document_keywords(table(spark, sf, "documents")))


@query(r"""select doc_id, len(regexp_extract_all(text, '[^ \t\n\r\f\v]+')) as n_words, length(text) as n_chars, len(string_split(text, chr(10))) as n_lines, len(regexp_split_to_array(text, '[.!?。][ \t\n\r\f\v]')) as n_sentences,
    len(list_filter(string_split(text, chr(10)), lambda x: contains(x, ','))) as n_tables, len(list_filter(string_split(text, chr(10)), lambda x: length(x) between 1 and 60)) as n_sections from documents""")
def a4_document_statistics(spark, sf):
    lines = F.split("text", "\n", -1)
    rows = table(spark, sf, "documents").withColumns({"tables": F.filter(lines, lambda x: F.contains(x, F.lit(","))), "sections": F.filter(lines, lambda x: F.char_length(x).between(1, 60))})
    return lake.document_statistics(rows)


def _snippet(w: str) -> str:
    at = f"(cast(instr(lower(text), '{w}') as int) - 1)"
    start, end = f"greatest(0, {at} - 80)", f"least(length(text), {at} + {len(w) + 80})"
    return f"case when {at} >= 0 then case when {start} > 0 then '...' else '' end || trim(substr(text, {start} + 1, {end} - {start}), ' ') || case when {end} < length(text) then '...' else '' end end"


@query(f"""select doc_id, round(points / 2.0e0, 2) as score, concat_ws(' / ', {_snippet('apache')}, {_snippet('license')}) as snippets from (select doc_id, text, case when contains(lower(text), 'license apache') then 10 else 0 end
      + least(5, cast((length(text) - length(replace(lower(text), 'apache', ''))) / 6 as int)) + least(5, cast((length(text) - length(replace(lower(text), 'license', ''))) / 7 as int)) as points, phase from v_documents where status = 'completed') t
    where doc_id in (select doc_id from (select doc_id, case when contains(lower(text), 'license apache') then 10 else 0 end + least(5, cast((length(text) - length(replace(lower(text), 'apache', ''))) / 6 as int)) + least(5, cast((length(text) - length(replace(lower(text), 'license', ''))) / 7 as int)) as points
      from v_documents where status = 'completed') u where points > 0 order by points desc, doc_id limit 20) and phase = 'design'""")
def w4_search_documents(spark, sf):
    return lake.search_documents(docs(spark, sf), "license apache", phase="design").withColumn("snippets", F.array_join("snippets", " / "))


GRAPH_TERMS = "(values ('apache', 'License'), ('license', 'License'), ('der', 'German'), ('les', 'French')) g(word, class)"
TOP = f"(select * from {KEYWORDS} k where rank <= 10)"


def _graph(spark, sf):
    terms = spark.createDataFrame([("apache", "License"), ("license", "License"), ("der", "German"), ("les", "French")], "word string, class string")
    return lake.document_graph(lake.document_keywords(table(spark, sf, "documents")), terms)


@query(f"""select 'doc:' || cast(doc_id as string) as id, 'document' as node_type from {TOP} t group by 1 union select 'kw:' || word, 'keyword' from {TOP} t group by 1 union select 'cls:' || class, 'class' from {TOP} t join {GRAPH_TERMS} on g.word = t.word group by 1""")
def u2_document_graph_nodes(spark, sf):
    return _graph(spark, sf)[0]


@query(f"""select 'doc:' || cast(doc_id as string) as src, 'kw:' || word as dst, 'contains_keyword' as edge_type from {TOP} t union all select 'kw:' || t.word, 'cls:' || class, 'mapped_to' from {TOP} t join {GRAPH_TERMS} on g.word = t.word""")
def u2_document_graph_edges(spark, sf):
    return _graph(spark, sf)[1]


@query(f"select t.doc_id, t.word, g.class from {KEYWORDS} t join {GRAPH_TERMS} on g.word = t.word")
def j14_term_dictionary_match(spark, sf):
    terms = spark.createDataFrame([("apache", "License"), ("license", "License"), ("der", "German"), ("les", "French")], "word string, class string")
    return lake.document_keywords(table(spark, sf, "documents")).join(terms, "word").select("doc_id", "word", "class")


@query("select doc_id, phase, len(string_split(text, chr(10))) as n_rows from v_documents where status = 'completed'")
def u3_union_tables(spark, sf):
    return lake.union_tables(docs(spark, sf)).groupBy("doc_id", "phase").agg(F.count("*").alias("n_rows"))


# Document checks


# What a parser says of a document, made from its text: short lines are headings, lines with a comma are tables.
FACTS = """(select doc_id, filename, phase, text, case doc_id % 4 when 0 then '.pdf' when 1 then '.docx' when 2 then '.xlsx' else '.ifc' end as ext, len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]+')) as words,
    case when doc_id % 5 = 0 then null else lang end as title, case when doc_id % 7 = 0 then '' else 'writer of ' || lang end as author, doc_id % 3 <> 0 as dated,
    list_filter(string_split(text, chr(10)), lambda x: length(x) between 1 and 60) as headings, len(list_filter(string_split(text, chr(10)), lambda x: contains(x, ','))) as n_tables, string_split(text, chr(10))[1] <> '' as has_headers,
    len(string_split(text, chr(10))) as n_rows, doc_id % 4 as revision, case when lang = 'en' then 'IFC4' end as model_schema, doc_id % 6 as k, lang, case when doc_id % 8 = 0 then 'design_drawing' else 'other' end as type_id from v_documents)"""
ENTITIES = "list_filter(['IFCSITE', case when k > 0 then 'IFCBUILDING' end, case when k > 1 then 'IFCPROPERTYSET' end, case when k > 2 then 'IFCMATERIAL' end, case when k > 3 then 'IFCRELASSOCIATESCLASSIFICATION' end], lambda x: x is not null)"


def _check(facet: str, name: str, good: str, note: str, fix: str | None, when: str = "true") -> str:
    mend = f"'{fix}'" if fix else "cast(null as string)"
    return f"select doc_id, '{facet}' as facet, '{name}' as \"check\", case when {good} then 'PASS' else 'FAIL' end as result, {note} as note, case when not ({good}) then {mend} end as fix from {FACTS} f where {when}"


DOC_CHECKS = "(" + " union all ".join([
    _check("Attribute", "title", "coalesce(title, '') <> ''", "case when coalesce(title, '') <> '' then 'Title: ' || title else 'no title' end", "fix_title"),
    _check("Attribute", "author", "author <> ''", "case when author <> '' then 'Author: ' || author else 'no author' end", "fix_author"), _check("Attribute", "date", "dated", "case when dated then 'dated' else 'no date' end", "fix_date"),
    _check("Entity", "structure", "len(headings) > 0 or (ext = '.xlsx' and n_tables > 0)", "len(headings) || ' sections'", "fix_structure"),
    _check("Property", "content", "words >= case phase when 'design' then 200 else 100 end", "words || ' words of ' || case phase when 'design' then 200 else 100 end", "fix_content"),
    _check("Attribute", "naming", "len(string_split(replace(filename, '.', '_'), '_')) >= 3", "len(string_split(replace(filename, '.', '_'), '_')) || ' parts'", "fix_naming"),
    _check("Property", "pages", "words // 300 > 0", "words // 300 || ' pages'", None, "ext = '.pdf'"), _check("Property", "title block", "n_tables > 0", "n_tables || ' tables'", "fix_titleblock", "ext = '.pdf' and type_id = 'design_drawing'"),
    _check("Entity", "heading hierarchy", "len(list_distinct(list_transform(headings, lambda x: length(x) % 3))) >= 2", "len(headings) || ' headings'", "fix_headings", "ext = '.docx'"), _check("Attribute", "revision", "revision > 0", "revision || '. revision'", "fix_revision", "ext = '.docx'"),
    _check("Entity", "header row", "has_headers", "case when has_headers then 'headers' else 'no headers' end", "fix_headers", "ext = '.xlsx'"), _check("Property", "data rows", "n_rows >= 3", "n_rows || ' rows'", None, "ext = '.xlsx'"),
    _check("Attribute", "sheet names", "length(lang || phase) > 6", "lang || phase", "fix_sheetnames", "ext = '.xlsx'"), _check("Classification", "schema", "model_schema is not null", "coalesce(model_schema, 'no schema')", None, "ext = '.ifc'"),
    _check("Entity", "entity types", f"len({ENTITIES}) >= 3", f"len({ENTITIES}) || ' types'", "fix_entities", "ext = '.ifc'"), _check("PartOf", "spatial structure", "k > 0", "case when k > 0 then '2' else '1' end || ' spatial types'", "fix_spatial", "ext = '.ifc'"),
    _check("Property", "property sets", "k > 1", "cast(null as string)", "fix_pset", "ext = '.ifc'"), _check("Material", "materials", "k > 2", "cast(null as string)", "fix_material", "ext = '.ifc'"), _check("Classification", "classification", "k > 3", "cast(null as string)", "fix_classification", "ext = '.ifc'"),
]) + ")"
LEVEL = "case when ext = '.ifc' then case when words > 1000 then 'LOI High' when words > 100 then 'LOI Medium' else 'LOI Low' end when words > 5000 or n_tables > 5 then 'LOI High' when words > 500 then 'LOI Medium' else 'LOI Low' end"
BELOW = f"case {LEVEL} when 'LOI High' then 3 when 'LOI Medium' then 2 else 1 end < case phase when 'construction' then 3 else 2 end"


def facts(spark, sf):
    lines = F.split("text", "\n", -1)
    rows = docs(spark, sf).select(
        "doc_id", "filename", "phase", "text", X.extension(F.col("filename")).alias("ext"), F.size(F.regexp_extract_all("text", F.lit(r"(\S+)"), F.lit(1))).alias("words"), F.when(F.col("doc_id") % 5 != 0, F.col("lang")).alias("title"),
        F.when(F.col("doc_id") % 7 == 0, "").otherwise(F.concat(F.lit("writer of "), F.col("lang"))).alias("author"), (F.col("doc_id") % 3 != 0).alias("dated"),
        F.filter(lines, lambda x: F.char_length(x).between(1, 60)).alias("headings"), F.size(F.filter(lines, lambda x: F.contains(x, F.lit(",")))).alias("n_tables"), (F.get(lines, 0) != "").alias("has_headers"), F.size(lines).alias("n_rows"),
        (F.col("doc_id") % 4).alias("revision"), F.when(F.col("lang") == "en", "IFC4").alias("model_schema"), F.array(F.concat("lang", "phase")).alias("sheet_names"), F.when(F.col("doc_id") % 8 == 0, "design_drawing").otherwise("other").alias("type_id"),
        F.slice(F.array(*[F.lit(x) for x in ("IFCSITE", "IFCBUILDING", "IFCPROPERTYSET", "IFCMATERIAL", "IFCRELASSOCIATESCLASSIFICATION")]), 1, F.least((F.col("doc_id") % 6 + 1).cast("int"), F.lit(5))).alias("entities"),
    )
    return rows.withColumns({"n_sections": F.size("headings"), "levels": F.transform("headings", lambda x: F.char_length(x) % 3), "pages": F.floor(F.col("words") / 300), "slides": F.lit(None).cast("int")})


def levels(spark, sf):
    level = F.when(F.col("ext") == ".ifc", D.model_level(F.col("words"))).otherwise(D.loin_level(F.col("words"), F.col("n_tables")))
    return facts(spark, sf).select("doc_id", "phase", level.alias("level"))


@query(f"select * from {DOC_CHECKS} d")
def v14_document_checks(spark, sf):
    return D.document_checks(facts(spark, sf))


@query(f"select doc_id, {LEVEL} as level, {BELOW} as below from {FACTS} c")
def v15_loin_level(spark, sf):
    return levels(spark, sf).select("doc_id", "level", D.loin_gap(F.col("level"), F.col("phase")).alias("below"))


# Warnings about a document's form are checks that warn.
WARNED = "(select doc_id, 'warning' as facet, name as \"check\" from (select doc_id, unnest(list_filter([case when author = '' then 'author' end, case when not dated then 'created' end], lambda x: x is not null)) as name from {0} f) t)"
NG_ITEMS = f"""(select doc_id, 'NG' as severity, 'IDS 1.0' as standard, facet, "check" as description from {DOC_CHECKS} d where result = 'FAIL' union all select doc_id, 'WARNING', 'IDS 1.0', facet, "check" from {WARNED.format(FACTS)} w
    union all select doc_id, 'NG', 'ISO 7817-1 (LOIN)', 'Information Level', {LEVEL} from {FACTS} c where {BELOW}
    union all select doc_id, 'NG', 'ISO 19650-1 / ISO 12006-2', 'Domain', 'Non-construction' from (select doc_id, {SCORE} as score from v_documents) t where score < 2)"""


def ng_items(spark, sf):
    found = facts(spark, sf)
    warned = D.standard_warnings(found).where(F.col("warning").isin("author", "created")).select("doc_id", F.lit("warning").alias("facet"), F.col("warning").alias("check"), F.lit("WARNING").alias("result"))
    domains = docs(spark, sf).select("doc_id", X.domain_relevance(F.col("text"), TERMS).alias("d")).select("doc_id", "d.domain", "d.is_relevant")
    return D.ng_items(D.document_checks(found).select("doc_id", "facet", "check", "result").unionByName(warned), levels(spark, sf), domains)


@query(f"select * from {NG_ITEMS} n")
def v16_ng_items(spark, sf):
    return ng_items(spark, sf)


@query(f"select doc_id, count(*) filter (where severity = 'NG') as ng_count, count(*) filter (where severity = 'WARNING') as warning_count from v_documents left join {NG_ITEMS} n using (doc_id) group by 1")
def v16_ng_counts(spark, sf):
    return D.ng_counts(docs(spark, sf), ng_items(spark, sf))


FIXED = "result = 'PASS' or fix in ('fix_title', 'fix_naming', 'fix_pset')"


@query(f"select doc_id, count(*) as n_checks, count(*) filter (where {FIXED}) as n_passed, cast(round_even(count(*) filter (where {FIXED}) * 100.0e0 / count(*), 0) as bigint) as percent from {DOC_CHECKS} d group by 1")
def v17_auto_fix(spark, sf):
    return D.compliance(D.auto_fix(D.document_checks(facts(spark, sf)), ["fix_title", "fix_naming", "fix_pset"]), ("PASS", "FIXED"))


STEM = "split_part(filename, '.', 1)"


@query(f"""select doc_id, case when coalesce(title, '') = '' then {STEM} else title end as title, case when author = '' then 'unnamed, ' || phase else author end as author, case when ext = '.docx' and revision = 0 then 1 else revision end as revision, n_open
    from {FACTS} f join (select doc_id, count(*) filter (where result = 'FAIL' and fix is null) as n_open from {DOC_CHECKS} d group by 1) o using (doc_id)""")
def v17_filled_metadata(spark, sf):
    found = facts(spark, sf)
    values = {"fix_title": F.split_part("filename", F.lit("."), F.lit(1)), "fix_author": F.concat(F.lit("unnamed, "), "phase"), "fix_revision": F.lit(1).cast("long")}
    return D.fill_metadata(found, D.auto_fix(D.document_checks(found)), values).select("doc_id", "title", "author", "revision", "n_open")


HEADINGS = "lower(array_to_string(headings, ' '))"


@query(f"""select doc_id, unnest(list_filter([case when len(string_split(split_part(filename, '.', 1), '-')) < 7 then 'naming' end, case when author = '' then 'author' end, case when not dated then 'created' end,
      case when phase = 'design' and coalesce(title, '') = '' then 'title' end, case when phase = 'construction' and not contains({HEADINGS}, 'scope') then 'scope' end], lambda x: x is not null)) as warning from {FACTS} f
    union all select doc_id, 'section ' || r.requirement from {FACTS} f join (values ('design', 'the'), ('construction', 'und'), ('operation', 'license')) r(phase, requirement) on r.phase = f.phase where not contains({HEADINGS}, r.requirement)""")
def v18_document_standard_warnings(spark, sf):
    required = spark.createDataFrame([("design", "the"), ("construction", "und"), ("operation", "license")], "phase string, requirement string")
    return D.standard_warnings(facts(spark, sf), required)


@query("""select e.sheet, e.col as "column", case when not exists (select 1 from v_documents d where d.lang = e.sheet) then 'missing sheet' else 'missing column' end as problem
    from (values ('en', 'design'), ('en', 'audit'), ('xx', 'design')) e(sheet, col) where not exists (select 1 from v_documents d where d.lang = e.sheet and d.phase = e.col)""")
def v19_table_schema_check(spark, sf):
    expected = spark.createDataFrame([("en", "design"), ("en", "audit"), ("xx", "design")], "sheet string, column string")
    return D.table_schema_check(expected, docs(spark, sf).select(F.col("lang").alias("sheet"), F.col("phase").alias("column")).distinct())


# Chunks


@query("""select doc_id, i as idx, i * 462 as start, least(i * 462 + 512, length(text)) as "end", trim(substr(text, i * 462 + 1, 512), ' ') as chunk from (select doc_id, text, unnest(range(0, greatest(0, cast(ceil((length(text) - 512) / 462.0) as bigint)) + 1)) as i from documents) t where trim(substr(text, i * 462 + 1, 512), ' ') <> ''""")
def x13_chunk_fixed(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.inline(X.chunk_fixed(F.col("text"))))
    return rows.select("doc_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "chunk", (F.col("start") / 462).cast("long").alias("idx"))


@query("""select doc_id, cast(offs as bigint) as start, trim(p, ' ') as chunk from (select doc_id, u.p as p, coalesce(sum(length(u.p) + 1) over (partition by doc_id order by u.i rows between unbounded preceding and 1 preceding), 0) as offs
    from (select doc_id, unnest(list_transform(string_split(text, chr(10)), lambda x, i: struct_pack(i := i, p := x))) as u from documents) t) s where trim(p, ' ') <> ''""")
def x14_chunk_paragraph(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.inline(X.chunk_paragraphs(F.col("text"), "\n"))).withColumn("start", F.col("start").cast("long"))


@query(r"""select doc_id, cast(u.i as int) as idx, u.c as chunk from (select doc_id, unnest(list_transform(string_split(list_reduce(string_split(regexp_replace(text, '([.!?])[ \t\n\r\f\v]+', '\1' || chr(2), 'g'), chr(2)),
      lambda acc, s: case when length(string_split(acc, chr(1))[-1]) + 1 + length(s) > 512 and string_split(acc, chr(1))[-1] <> '' then acc || chr(1) || s when string_split(acc, chr(1))[-1] = '' then acc || s else acc || ' ' || s end), chr(1)), lambda c, i: struct_pack(i := i - 1, c := c))) as u from documents) t where trim(u.c, ' ') <> ''""")
def x15_chunk_sentence(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.posexplode(X.chunk_sentences(F.col("text"))).alias("idx", "chunk"))


@query()
def x16_chunk_recursive(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.posexplode(X.chunk_recursive()("text")).alias("idx", "chunk"))


@query("""select doc_id, i as idx, source_id, trim(substr(text, i * 200 + 1, 256), ' ') as chunk from (select doc_id, source_id, text, unnest(range(0, greatest(0, cast(ceil((length(text) - 256) / 200.0) as bigint)) + 1)) as i
    from (select doc_id, 'doc_' || cast(doc_id as string) as source_id, filename || chr(10) || chr(10) || text as text from v_documents) d) t where trim(substr(text, i * 200 + 1, 256), ' ') <> ''""")
def x17_chunk_section(spark, sf):
    rows = docs(spark, sf).select("doc_id", F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("source_id"), F.concat("filename", F.lit("\n\n"), "text").alias("section"))
    return rows.select("doc_id", "source_id", F.inline(X.chunk_fixed(F.col("section"), 256, 56))).select("doc_id", "source_id", (F.col("start") / 200).cast("long").alias("idx"), "chunk")


@query("select doc_id, md5(regexp_replace(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g')) as digest from documents")
def x19_clean_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(X.clean(F.col("text"))).alias("digest"))


@query("select doc_id, array_to_string([case when trim(split_part(text, chr(10), 1)) = '' then 'Column_1' else split_part(text, chr(10), 1) end, 'Column_2', lang], '|') as headers from documents")
def x20_fill_headers(spark, sf):
    first = F.get(F.split("text", "\n", -1), 0)
    return table(spark, sf, "documents").select("doc_id", F.array_join(X.fill_headers(F.array(first, F.lit(""), F.col("lang"))), "|").alias("headers"))


@query(r"""select doc_id, cast(i as bigint) as idx, length(s) as content_length, len(regexp_extract_all(s, '[^ \t\n\r\f\v]+')) as n_words, contains(s, ' | ') as has_table from (select doc_id, u.i as i, u.s as s from (select doc_id, unnest(list_transform(string_split(text, chr(10)), lambda x, i: struct_pack(i := i - 1, s := x))) as u from documents) t) v where trim(s, ' ') <> ''""")
def x21_section_features(spark, sf):
    return X.section_features(table(spark, sf, "documents").select("doc_id", F.split("text", "\n", -1).alias("sections"))).withColumn("idx", F.col("idx").cast("long"))


# Events


# Files come in two drops; every third comes again with another category and a later date, and some of those with an earlier one.
@query("""select id, filename, case when id % 3 = 0 and id % 2 = 0 then 'again' else coalesce(category, 'other') end as category, 'completed' as status from v_files""")
def st1_ingest_stream(spark, sf):
    from lintel.sources.scratch import scratch
    from lintel.streaming import snapshots, streams

    path = scratch(spark, "uploads")
    rows = files(spark, sf).select("id", "filename", "category", F.lit(1).alias("version"))
    rows.coalesce(1).write.json(f"{path}/in")
    rows.where("id % 3 = 0").select("id", "filename", F.lit("again").alias("category"), F.when(F.col("id") % 2 == 0, 2).otherwise(0).alias("version")).coalesce(1).write.mode("append").json(f"{path}/in")
    job = lambda batch: batch.select("id", "filename", F.coalesce("category", F.lit("other")).alias("category"), F.lit("completed").alias("status"), "version")
    streams.ingest(spark, f"{path}/in", "id long, filename string, category string, version int", job, f"{path}/out", f"{path}/checkpoint", order=["version"], files_at_once=1).awaitTermination()
    return snapshots.read(spark, f"{path}/out", "id long, filename string, category string, status string, version int").drop("version")


@query("""select 'm' || cast(ord % 40 as string) as model, case when ord % 40 < 20 then '.ifc' else '.csv' end as extension, case when ord % 40 < 20 then 'bim_model' else 'spreadsheet' end as category, sha256(string_agg(global_id, chr(10) order by global_id) || chr(10)) as checksum from v_elements group by 1, 2, 3""")
def st1_ingest_files(spark, sf):
    from lintel.sources.scratch import scratch
    from lintel.streaming import snapshots, streams

    path = scratch(spark, "files")
    rows = view(spark, sf, "v_elements").select("global_id", (F.col("ord") % 40).alias("n"))
    name = F.concat(F.lit("m"), F.col("n").cast("string"), F.when(F.col("n") < 20, ".ifc").otherwise(".csv"))
    rows.select(name.alias("file"), "global_id").repartition("file").sortWithinPartitions("file", "global_id").write.partitionBy("file").text(f"{path}/in")
    streams.ingest_files(spark, f"{path}/in", f"{path}/out", f"{path}/checkpoint", lambda found: found.withColumn("file", F.regexp_extract("path", "file=([^/]+)/", 1)), files_at_once=15).awaitTermination()
    found = snapshots.read(spark, f"{path}/out", "path string, file string, checksum string")
    known = F.when(F.endswith("file", F.lit(".ifc")), F.struct(F.lit(".ifc").alias("extension"), F.lit("bim_model").alias("category"))).otherwise(F.struct(F.lit(".csv").alias("extension"), F.lit("spreadsheet").alias("category")))
    return found.select(F.substring_index("file", ".", 1).alias("model"), known.alias("k"), "checksum").select("model", "k.*", "checksum")


@query("select file_id, event_id, previous from (select *, lag(state) over (partition by file_id order by ts, event_id) as previous from v_transitions) t where state = 'published' and (previous is null or previous <> 'published')")
def st2_publish_trigger(spark, sf):
    return lake.publish_trigger(view(spark, sf, "v_transitions"))


# The same from a stream whose batches are shuffled; an event far behind all others lets the watermark pass them.
@query("select file_id, event_id from (select *, lag(state) over (partition by file_id order by ts, event_id) as previous from v_transitions) t where state = 'published' and (previous is null or previous <> 'published')")
def st2_publish_stream(spark, sf):
    from lintel.sources.scratch import scratch
    from lintel.streaming import streams

    path = scratch(spark, "events")
    rows = view(spark, sf, "v_transitions").select("file_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "state")
    at_once = max(1, math.ceil(rows.count() / 3_000_000))  # files of a batch
    for k in range(3):
        rows.where(F.pmod(F.xxhash64("event_id"), F.lit(3)) == k).repartition(at_once).write.mode("append").parquet(f"{path}/in")
    spark.sql("select -1L as file_id, -1L as event_id, timestamp '2250-01-01' as ts, 'end' as state").coalesce(1).write.mode("append").parquet(f"{path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", at_once).parquet(f"{path}/in")
    found = streams.publish_trigger(stream, delay="36500 days")
    write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")
    found.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("file_id long, event_id long").parquet(f"{path}/out").select("file_id", "event_id")


@query("select run_id, stage, cast(case when stage_status = 'completed' then (idx + 1) * 20 else floor(idx * 20 + stage_progress * 0.2e0) end as bigint) as overall from v_progress qualify row_number() over (partition by run_id order by ts desc, event_id desc) = 1")
def st3_run_progress(spark, sf):
    return lake.run_progress(view(spark, sf, "v_progress"))


@query("select checksum, id, filename from v_files qualify row_number() over (partition by checksum order by uploaded_at, id) = 1")
def st4_dedupe_uploads(spark, sf):
    return lake.dedupe_uploads(files(spark, sf))


# Vectors


VECTORS = "(select vec_id as id, cast(embedding as double[]) as v from embeddings)"


def vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"))


@query(f"""select query, id, round(similarity, 6) as similarity, rank from (select a.id as query, b.id as id, list_cosine_similarity(a.v, b.v) as similarity, row_number() over (partition by a.id order by list_cosine_similarity(a.v, b.v) desc, b.id) as rank
    from {VECTORS} a join {VECTORS} b on a.id <> b.id where a.id % 20 = 0) t where rank <= 5""")
def t4_cosine_neighbours(spark, sf):
    v = vectors(spark, sf)
    return neighbours.nearest_exact(neighbours.build(v), v.where("id % 20 = 0"), 5).withColumn("similarity", F.round("similarity", 6))


@query()
def t4_index_neighbours(spark, sf):
    v = vectors(spark, sf)
    index, asked = neighbours.build(v), v.where("id % 20 = 0")
    return neighbours.nearest(index, asked, 5, neighbours.probes_for(index, asked, 5))


@query()
def t3_embed_texts(spark, sf):
    return features.embed_texts(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")).select("id", "embedding")


@query()
def t5_pca(spark, sf):
    return features.pca(vectors(spark, sf))


@query("select vec_id as id, len(embedding) as dimensions, substr('label ' || cast(label as string), 1, 1000) as text from embeddings")
def s8_embedding_points(spark, sf):
    from lintel.sources.sinks import points

    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("embedding"), F.concat(F.lit("label "), F.col("label").cast("string")).alias("text"))
    return points(rows).select("id", F.size("values").cast("long").alias("dimensions"), F.col("metadata.text").alias("text"))
