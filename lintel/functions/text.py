"""Text: statistics, chunks, classification by words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Groups of words in file names, in the order that decides, and what they mean.
PHASE_WORDS = [("design", "설계 design 도면 drawing 계획 plan 기본 실시 bim".split()), ("construction", "시공 construction 공사 build 현장 site 공정 schedule".split()), ("operation", "유지 maintenance 운영 operation 점검 inspection 보수 repair".split())]
# Document types: words in the file name, extensions, phase.
FILE_TYPES = [
    ("design_drawing", "도면 drawing 배치 평면 단면 입면 상세".split(), [".pdf", ".dwg"], "design"), ("bim_model", "bim 모델 model ifc".split(), [".ifc"], "any"),
    ("design_spec", "설명서 시방서 specification spec 기준".split(), [".docx", ".hwpx", ".hwp", ".pdf"], "design"), ("boq", "물량 내역 산출 boq quantity cost 단가".split(), [".xlsx", ".xls", ".csv"], "design"),
    ("construction_report", "시공 공정 보고 progress 현장 일보 주보 월보".split(), [".docx", ".hwpx", ".pdf", ".pptx"], "construction"), ("quality_check", "품질 점검 체크 check quality 검사".split(), [".xlsx", ".pdf", ".docx"], "construction"),
    ("asbuilt", "준공 asbuilt as-built 완공".split(), [".ifc"], "construction"), ("inspection", "점검 진단 안전 inspection diagnosis 상태".split(), [".pdf", ".docx", ".hwpx"], "operation"),
    ("repair_history", "보수 보강 이력 repair maintenance 유지".split(), [".xlsx", ".csv"], "operation"), ("energy_data", "에너지 energy 환경 탄소 carbon".split(), [".xlsx", ".csv"], "operation"), ("presentation", "발표 presentation 회의".split(), [".pptx", ".ppt"], "any"),
]
# Weights of domain terms.
DOMAIN_TERMS = {
    **dict.fromkeys("bim ifc 건설 construction".split(), 5), **dict.fromkeys("building 설계 design 시공 구조 structural".split(), 4),
    **dict.fromkeys("콘크리트 concrete 철근 steel rebar 교량 bridge 도로 road 터널 tunnel 건축 architecture 토목 civil".split(), 3),
    **dict.fromkeys("물량 quantity 공정 schedule 유지관리 maintenance 점검 inspection 도면 drawing 단면 평면 하중 load 응력 stress 기초 foundation 슬래브 slab 벽체 wall 보 beam 기둥 column 배근 철골 프리스트레스 인프라 infrastructure".split(), 2),
    **dict.fromkeys("iso 표준 standard 규격".split(), 1),
}
# Content types and their indicators.
CONTENT_TYPES = [
    ("bim_research", "연구 research 분석 analysis 방법론 methodology 결론 conclusion".split()), ("structural_calc", "하중 load 응력 stress 모멘트 moment 전단 shear 처짐 deflection".split()),
    ("cost_estimate", "공사비 cost 단가 price 물량 quantity 금액 amount".split()), ("safety_plan", "안전 safety 위험 risk 보호 protection 사고 accident".split()), ("env_assessment", "환경 environment 영향 impact 탄소 carbon 에너지 energy".split()),
]


def _any(low: Column, words: list[str]) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(low, w))


def _hits(low: Column, words: list[str]) -> Column:
    return F.size(F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(low, w)))


def detect_phase(filename: Column, groups=PHASE_WORDS) -> Column:
    """The first group with a word in the name; else the first group's phase."""
    out = F.lit(groups[0][0])
    for phase, words in reversed(groups):
        out = F.when(_any(F.lower(filename), words), phase).otherwise(out)
    return out


def extension(filename: Column) -> Column:
    return F.lower(F.regexp_extract(filename, r"(\.[^.]*)$", 1))


def iso_parts(filename: Column) -> Column:
    """Dash-separated parts of the name before its first dot."""
    return F.split(F.get(F.split(filename, r"\."), 0), "-", -1)


def classify_filename(filename: Column, phase: Column, types=FILE_TYPES) -> Column:
    """struct(type_id, score, confidence): 3 for the extension, 5 per word, 2 for the phase; the first type with the greatest score."""
    low, ext = F.lower(filename), extension(filename)
    scores = []
    for i, (name, words, exts, when) in enumerate(types):
        score = F.when(ext.isin(*exts), 3).otherwise(0) + 5 * _hits(low, words) + (F.lit(2) if when == "any" else F.when(phase == when, 2).otherwise(0))
        scores.append(F.struct(score.alias("score"), F.lit(-i).alias("order"), F.lit(name).alias("type_id")))
    best = F.array_max(F.array(*scores))
    return F.struct(F.when(best["score"] > 0, best["type_id"]).otherwise("general").alias("type_id"), best["score"].alias("score"), F.when(best["score"] > 0, F.least(best["score"] / 10, F.lit(1.0))).otherwise(0.3).alias("confidence"))


def domain_relevance(text: Column, terms: dict[str, int] = DOMAIN_TERMS) -> Column:
    """struct(score, domain, is_relevant, confidence) from the weights of the terms that the text contains."""
    low = F.lower(F.coalesce(text, F.lit("")))
    known = F.array(*[F.struct(F.lit(t).alias("term"), F.lit(w).alias("weight")) for t, w in terms.items()])
    score = F.aggregate(F.filter(known, lambda x: F.contains(low, x["term"])), F.lit(0), lambda a, x: a + x["weight"])
    return F.transform(
        F.array(score),
        lambda s: F.struct(
            s.alias("score"),
            F.when(s >= 15, "BIM/Construction").when(s >= 5, "Construction-related").when(s >= 2, "Partially related").otherwise("Non-construction").alias("domain"),
            (s >= 2).alias("is_relevant"),
            F.when(s >= 15, F.least(s * 3, F.lit(100))).when(s >= 5, F.least(s * 5, F.lit(80))).when(s >= 2, F.least(s * 8, F.lit(50))).otherwise(F.greatest(F.lit(5), s * 10)).alias("confidence"),
        ),
    )[0]


def classify_content(text: Column, keywords: Column, types=CONTENT_TYPES) -> Column:
    """struct(type_id, score, confidence), null below 6: 3 per indicator in the text, 5 per indicator among the keywords."""
    low = F.lower(F.coalesce(text, F.lit("")))
    scores = []
    for i, (name, words) in enumerate(types):
        score = 3 * _hits(low, words) + 5 * F.size(F.array_intersect(F.coalesce(keywords, F.array().cast("array<string>")), F.array(*[F.lit(w) for w in words])))
        scores.append(F.struct(score.alias("score"), F.lit(-i).alias("order"), F.lit(name).alias("type_id")))
    best = F.array_max(F.array(*scores))
    return F.when(best["score"] >= 6, F.struct(best["type_id"].alias("type_id"), best["score"].alias("score"), F.least(best["score"] / 15, F.lit(1.0)).alias("confidence")))


def sentences(text: Column) -> Column:
    return F.size(F.split(text, r"[.!?。]\s", -1))


def section_features(docs: DataFrame) -> DataFrame:
    """doc_id, idx, content_length, n_words, has_table of every section that isn't blank. docs: doc_id, sections (array of texts)."""
    rows = docs.select("doc_id", F.posexplode("sections").alias("idx", "s")).where(F.trim("s") != "")
    return rows.select("doc_id", "idx", F.char_length("s").cast("long").alias("content_length"), F.size(F.regexp_extract_all("s", F.lit(r"(\S+)"), F.lit(1))).cast("long").alias("n_words"), F.contains("s", F.lit(" | ")).alias("has_table"))


def clean(text: Column) -> Column:
    """Without control characters other than tabs and line ends."""
    return F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")


def fill_headers(headers: Column) -> Column:
    return F.transform(headers, lambda h, i: F.when(F.trim(h) == "", F.concat(F.lit("Column_"), (i + 1).cast("string"))).otherwise(h))


def chunk_fixed(text: Column, size: int = 512, overlap: int = 50) -> Column:
    """array of struct(start, end, chunk): windows of `size` characters that share `overlap`; blank ones are left out."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be less than size")
    n = F.char_length(text)
    last = F.greatest(F.lit(0), F.ceil((n - size) / (size - overlap)).cast("int"))
    spans = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct((i * (size - overlap)).alias("start"), F.least(i * (size - overlap) + size, n).alias("end"), F.trim(F.substring(text, i * (size - overlap) + 1, F.lit(size))).alias("chunk")))
    return F.filter(spans, lambda c: c["chunk"] != "")


def chunk_paragraphs(text: Column, separator: str = "\n\n") -> Column:
    """array of struct(start, chunk): stripped paragraphs that aren't blank, with their offsets."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,chunk:string>>").alias("out"))

    def step(state, p):
        item = F.struct(state["at"].alias("start"), F.trim(p).alias("chunk"))
        return F.struct((state["at"] + F.char_length(p) + len(separator)).alias("at"), F.when(F.trim(p) != "", F.array_append(state["out"], item)).otherwise(state["out"]).alias("out"))

    return F.aggregate(F.split(text, separator, -1), zero, step, lambda s: s["out"])


def chunk_sentences(text: Column, size: int = 512) -> Column:
    """array of texts: sentences (up to a '.', '!' or '?' before white space) packed greedily up to `size` characters. Blank texts give none."""
    zero = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("now"))

    def step(state, s):
        full = (state["now"] != "") & (F.char_length(state["now"]) + 1 + F.char_length(s) > size)
        now = F.when(full | (state["now"] == ""), s).otherwise(F.concat_ws(" ", state["now"], s))
        return F.struct(F.when(full, F.array_append(state["out"], state["now"])).otherwise(state["out"]).alias("out"), now.alias("now"))

    last = lambda s: F.when(F.trim(s["now"]) != "", F.array_append(s["out"], s["now"])).otherwise(s["out"])
    return F.aggregate(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])[ \t\n\r\f\x0b]+", -1), zero, step, last)


def chunk_recursive(size: int = 512, separators: tuple[str, ...] = ("\n\n", "\n", ". ", " ")):
    """Pandas UDF: pieces of at most `size` characters, cut at the coarsest separator that does; the finest cut is by length."""

    @F.pandas_udf("array<string>")
    def chunks(texts):
        def cut(text, rank):
            if len(text) <= size:
                return [text] if text.strip() else []
            if rank == len(separators):
                return [text[i : i + size] for i in range(0, len(text), size)]
            out, now = [], ""
            for part in text.split(separators[rank]):
                whole = now + separators[rank] + part if now else part
                if len(whole) <= size:
                    now = whole
                    continue
                out += [now] if now.strip() else []
                now = ""
                if len(part) > size:
                    out += cut(part, rank + 1)
                else:
                    now = part
            return out + ([now] if now.strip() else [])

        return texts.map(lambda t: cut(t or "", 0))

    return chunks
